"""Line dedup, substring dedup, SimHash, sharding and packing against brute force on awkward tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash

from lexforge.llm import jaccard, line_dedup, packing, sharding, simhash, substring
from lexforge.llm.common import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, shard int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash", 1) for i, t in rows], SCHEMA)


def awkward(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    shared = " ".join(word() for _ in range(60))
    texts = [None, "", " \t\n", "one", "Alpha beta\xa0gamma\x0bdelta", "x " * 5000]
    texts += ["\n".join([" ".join(word() for _ in range(20)), "  " + shared.upper() if k % 2 else shared + "\r", "short"]) for k in range(8)]
    texts += [" ".join(word() for _ in range(rng.randint(30, 90))) for _ in range(10)]
    texts += [texts[-1], texts[-1], texts[-2] + " tail"]
    rows = list(enumerate(texts))
    return rows + [(rows[9][0], rows[9][1]), (None, texts[8]), (None, None)]


def lines_brute(rows, min_docs, min_chars):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    least = -(2**63)
    docs = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                docs.setdefault(key(line), set()).add(least if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(docs.get(key(x), ())) >= min_docs and max(docs[key(x)]) != (least if i is None else i))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def ordered(rows):
    return sorted(rows, key=repr)


def lines_of(out):
    return ordered([(r["row"]["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in out.collect()])


def test_line_dedup_and_its_reversal(spark):
    rows, scratch = awkward(), Scratch(spark)
    index = line_dedup.build(scratch, table(spark, rows), 5, 40)
    assert lines_of(line_dedup.apply(scratch, index, table(spark, rows))) == ordered(lines_brute(rows, 5, 40))
    ids = sorted({i for i, t in rows if i is not None and t and "short" in t})[-4:]
    fewer = [(i, t) for i, t in rows if i not in ids]
    less = line_dedup.delete(scratch, index, spark.createDataFrame([(i,) for i in ids], "doc_id long"))
    assert lines_of(line_dedup.apply(scratch, less, table(spark, fewer))) == ordered(lines_brute(fewer, 5, 40))
    again = line_dedup.insert(scratch, less, table(spark, [(i, t) for i, t in rows if i in ids]))
    assert lines_of(line_dedup.apply(scratch, again, table(spark, rows))) == ordered(lines_brute(rows, 5, 40))


def test_many_small_changes_of_the_line_index(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "MOST_LAYERS", 3)
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 12)
    rng, scratch = random.Random(4), Scratch(spark)
    lines = [f"a line that is long enough to be counted, number {k}" for k in range(60)]
    rows = [(i, "\n".join(rng.sample(lines, 12))) for i in range(60)]
    index = line_dedup.build(scratch, table(spark, rows[:6]), 3, 40)
    now = dict(rows[:6])
    for step in range(5):  # more keys become shared than the first filters hold
        new = rows[6 + 10 * step : 16 + 10 * step]
        index = line_dedup.insert(scratch, index, table(spark, new))
        now |= dict(new)
        out = sorted(now)[step :: 9]
        index = line_dedup.delete(scratch, index, spark.createDataFrame([(i,) for i in out], "doc_id long"))
        for i in out:
            del now[i]
    held = sorted(now.items())
    assert lines_of(line_dedup.apply(scratch, index, table(spark, held))) == ordered(lines_brute(held, 3, 40))
    assert index.shards > 1 and len(index.ref_layers) <= 3
    shared = {line for line in lines if sum(line in t.split("\n") for t in now.values()) >= 3}
    assert sum(r["n"] for r in index.filters.collect()) == len(shared) and all(r["n"] <= r["room"] for r in index.filters.collect())


def test_lines_of_long_documents(spark):
    line = lambda k: f"one of very many lines that all of the documents hold, no {k}"
    rows = [(i, "\n".join(line(k) for k in range(20_000))) for i in range(6)]
    scratch = Scratch(spark)
    out = line_dedup.apply(scratch, line_dedup.build(scratch, table(spark, rows), 5, 40), table(spark, rows)).collect()
    assert {(r["row"]["doc_id"], r["n_lines"], r["n_dropped"]) for r in out} == {(i, 20_000, 20_000 * (i < 5)) for i in range(6)}


def test_cuckoo_filter_has_no_false_negatives_and_forgets():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 256, (3000, 16), dtype=np.uint8)
    held = line_dedup.CuckooFilter(2500)
    held.add(keys[:2500])
    held = line_dedup.CuckooFilter.read(held.dump())
    assert held.probe(keys[:2500]).all() and held.probe(keys[2500:]).mean() < 0.01
    held.remove(keys[:1250])
    assert held.probe(keys[1250:2500]).all() and held.probe(keys[:1250]).mean() < 0.01
    full = line_dedup.CuckooFilter(4)
    full.add(keys[:200])  # far over its capacity: the stash takes the rest
    assert full.probe(keys[:200]).all()


def removed(out):
    return ordered([(r["id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in out.collect()])


def test_substring_dedup(spark, monkeypatch):
    rows = awkward()
    want = ordered([(i, *b) for (i, _), b in zip(rows, substring.brute([t for _, t in rows]), strict=True)])
    for wide in (512, 1):  # 1: nearly all minimizers take the way for wide ones
        monkeypatch.setattr(substring, "WIDE", wide)
        assert removed(substring.dedup(Scratch(spark), table(spark, rows))) == want


def test_words_whose_rolling_hashes_collide(spark, monkeypatch):
    thue = "".join("ab"[k.bit_count() % 2] for k in range(1024))
    other = thue.translate(str.maketrans("ab", "ba"))
    rest = " ".join(f"w{k}" for k in range(34))
    rows = [(1, f"{thue} {rest}"), (2, f"{other} {rest}"), (3, f"{other}  {rest}\n")]
    for wide in (512, 1):
        monkeypatch.setattr(substring, "WIDE", wide)
        assert {(i, gone) for i, _, gone, _ in removed(substring.dedup(Scratch(spark), table(spark, rows[:2])))} == {(1, 0), (2, 0)}
        assert {(i, gone) for i, _, gone, _ in removed(substring.dedup(Scratch(spark), table(spark, rows)))} == {(1, 0), (2, 35), (3, 35)}


def test_passage_that_very_many_documents_quote(spark):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage = " ".join(word() for _ in range(50))
    rows = [(i, " ".join([*(word() for _ in range(40)), passage, *(word() for _ in range(40))])) for i in range(700)]  # over WIDE different edges
    got = removed(substring.dedup(Scratch(spark), table(spark, rows)))
    assert got == ordered([(i, *b) for (i, _), b in zip(rows, substring.brute([t for _, t in rows]), strict=True)])
    assert all(gone == 50 for _, _, gone, _ in got)


def test_fm_index_counts_windows():
    rng = np.random.default_rng(3)
    text = np.concatenate([np.append(rng.integers(1, 4, n), 0) for n in (40, 25, 9, 3, 1)])
    start = np.array([0, 41, 67, 77, 81])
    index = substring.FMIndex(text, np.ones(len(text), int), 5)
    got = index.occurrences(text, start, np.array([40, 25, 9, 3, 1]))
    for i in range(len(text) - 4):
        window = text[i : i + 5].tolist()
        want = 0 if 0 in window else sum(text[j : j + 5].tolist() == window for j in range(len(text) - 4))
        assert got[i] == want


def fingerprint_brute(text, n=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] if len(words) >= n else [b" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components(spark):
    rows = awkward()
    rows += [(1000 + k, rows[10][1] + " end" * (k % 3)) for k in range(6)]
    prints = [fingerprint_brute(t) for _, t in rows]
    label = list(range(len(rows)))
    for _ in rows:
        label = [min(label[b] for b in range(len(rows)) if (prints[a] ^ prints[b]).bit_count() <= 3) for a in range(len(rows))]
    least = [min((rows[b][0] for b in range(len(rows)) if label[b] == label[a] and rows[b][0] is not None), default=None) for a in range(len(rows))]
    out = simhash.near_duplicates(Scratch(spark), table(spark, rows)).collect()
    assert ordered([(r["doc_id"], r["fp"] % 2**64, r["component"]) for r in out]) == ordered([(i, p, c) for (i, _), p, c in zip(rows, prints, least, strict=True)])
    kept = simhash.one_of_each(Scratch(spark), table(spark, rows), 3).collect()
    assert len(kept) == len(set(label)) and set(kept[0].asDict()) == set(table(spark, rows).columns)


def test_tiles_lose_no_link():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40).astype(np.uint64)
    fps = np.unique(np.concatenate([base, *(base ^ np.uint64(1 << int(b)) ^ np.uint64(1 << int(c)) for b, c in rng.integers(0, 63, (8, 2)))]))
    u, v = simhash.tile_links(fps, fps, 3)
    parent = {int(x): int(x) for x in fps.view(np.int64)}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in zip(u.tolist(), v.tolist(), strict=True):
        parent[root(a)] = root(b)
    near = np.argwhere(np.bitwise_count(fps[:, None] ^ fps[None]) <= 3)
    signed = fps.view(np.int64)
    assert all(root(int(signed[a])) == root(int(signed[b])) for a, b in near)


def test_sharding_splits_only_what_is_over(spark):
    rows = awkward() + [(5000 + k, "y" * 50) for k in range(200)]
    limit = 2000
    out = sharding.extendible_shards(Scratch(spark), table(spark, rows), limit).collect()
    assert len(out) == len(rows)
    size, members = {}, {}
    for r in out:
        size[r["shard"]] = size.get(r["shard"], 0) + r["bytes"]
        members.setdefault(r["shard"], set()).add(r["h"])
    for r in out:
        assert r["shard_bytes"] == size[r["shard"]] and r["shard"] == format(r["h"], "060b")[: r["depth"]]
        if size[r["shard"]] > limit:
            assert len(members[r["shard"]]) == 1
    names = sorted(size)
    assert not any(b.startswith(a) for a in names for b in names if a != b)
    for name in names:  # the parent was over the limit
        if name:
            assert sum(v for k, v in size.items() if k.startswith(name[:-1])) > limit


def packed_is_whole(rows, out, size):
    by, sequences = {}, {}
    for r in out:
        by.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    for held in sequences.values():
        at = 0
        for r in sorted(held, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size
    return by, sequences


def test_packing(spark):
    from tokenizers import Tokenizer

    import public_tokenizers
    from lexforge.llm import entry

    rows = awkward() + [(900, "a <|endoftext|> b"), (901, "word " * 3000)]
    ranks, pattern = entry.tokenizer_files()
    out = packing.pack(Scratch(spark), packing.pieces(table(spark, rows), ranks, pattern)).collect()
    coder = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    by, sequences = packed_is_whole(rows, out, 1024)
    want = []
    for i, t in rows:
        ids = np.array([*coder.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i, a, b - a, zlib.crc32(ids[a:b].tobytes()), len(ids)) for a, b in packing.cuts(len(ids))]
    assert ordered([tuple(r)[:5] for r in out]) == ordered(want)
    tokens = sum(w[2] for w in want)
    assert len(sequences) * 1024 - tokens < 1024 + 0.05 * tokens


def test_long_runs_get_the_ids_of_the_json_tokenizer(spark):
    from tokenizers import Tokenizer

    import public_tokenizers
    from lexforge.llm import entry

    rows = [(1, " " * 1_000_000), (2, "a" + "\n" * 60_000 + "b <|endoftext|>"), (3, "word " * 200_000), (4, "x" * 300_000)]
    coder = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    out = packing.pack(Scratch(spark), packing.pieces(table(spark, rows), *entry.tokenizer_files())).collect()
    packed_is_whole(rows, out, 1024)
    want = []
    for i, t in rows:
        ids = np.array([*coder.encode(t, add_special_tokens=False).ids, 0], "<u4")
        want += [(i, a, b - a, zlib.crc32(ids[a:b].tobytes()), len(ids)) for a, b in packing.cuts(len(ids))]
    assert ordered([tuple(r)[:5] for r in out]) == ordered(want)
    assert not packing.has_long_run(" x" * 100_000) and packing.has_long_run("x" + "\t " * 25_000)


def test_column_generation_reaches_the_bound():
    rng = np.random.default_rng(0)
    lengths, counts = np.unique(rng.integers(1, 40, 500), return_counts=True)
    demand = dict(zip(lengths.tolist(), counts.tolist(), strict=True))
    planned = packing.plan(demand, 64)
    held = {}
    for pattern, times in planned:
        assert sum(pattern) <= 64
        for x in pattern:
            held[x] = held.get(x, 0) + times
    assert held == demand
    assert sum(t for _, t in planned) <= 1.04 * sum(x * n for x, n in demand.items()) / 64 + 1
    value, count = packing.best_pattern(np.array([0.1, 0.0, 0.7]), 7)
    assert value == pytest.approx(1.5) and count.tolist() == [1, 0, 2]
    assert packing.plan({}, 64) == []


@pytest.mark.parametrize("rows", [[], [(None, None)], [(1, "")]])
def test_tiny_tables(spark, rows):
    docs = table(spark, rows)
    n = len(rows)
    scratch = Scratch(spark)
    assert line_dedup.apply(scratch, line_dedup.build(scratch, docs, 5, 40), docs).count() == n
    assert substring.dedup(Scratch(spark), docs).count() == n
    assert simhash.near_duplicates(Scratch(spark), docs).count() == n
    assert sharding.extendible_shards(Scratch(spark), docs, 100).count() == n
    from lexforge.llm import entry

    assert packing.pack(Scratch(spark), packing.pieces(docs, *entry.tokenizer_files())).count() == n


def test_near_copies_by_jaccard(spark):
    rng = np.random.default_rng(3)
    word = lambda: f"w{rng.integers(0, 5000)}"
    rows = []
    for _ in range(12):
        base = [word() for _ in range(rng.integers(60, 200))]
        for edits in (0, 1, 2, 3, 4, 6, 9):  # similarities on both sides of 0.8
            text = list(base)
            for at in rng.integers(0, len(base), edits):
                text[at] = word()
            rows.append((len(rows), " ".join(text)))
    rows += [(500, None), (501, ""), (None, " "), (502, "one two"), (503, "ONE  two"), (3, rows[3][1])]

    def grams(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    held = [grams(t) for _, t in rows]
    near = [(a, b) for a in range(len(rows)) for b in range(a) if held[a] == held[b] or 5 * len(held[a] & held[b]) >= 4 * len(held[a] | held[b])]
    label = list(range(len(rows)))
    for _ in rows:
        for a, b in near:
            label[a] = label[b] = min(label[a], label[b])
    assert sum(((simhash.fingerprint(rows[a][1], 5) ^ simhash.fingerprint(rows[b][1], 5)) % 2**64).bit_count() > 3 for a, b in near) > 20
    kept = [(r["doc_id"], r["text"]) for r in jaccard.one_of_each(Scratch(spark), table(spark, rows), 5).collect()]
    assert len(kept) == len(set(label)) == len({label[rows.index(x)] for x in kept})
    for i, text in kept:
        group = [len(t or "") for (_, t), k in zip(rows, label, strict=True) if k == label[rows.index((i, text))]]
        assert len(text or "") == max(group)
    assert jaccard.one_of_each(Scratch(spark), table(spark, []), 5).count() == 0


def test_tiles_of_a_bucket_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", 2)
    monkeypatch.setattr(jaccard, "COLUMNS", 7)
    rng = np.random.default_rng(1)
    sets = [rng.permutation(40).astype(np.uint64)[: rng.integers(1, 40)] for _ in range(9)]
    want = [[len(np.intersect1d(x, y)) for y in sets] for x in sets]
    assert jaccard.shared(sets, np.arange(9), np.arange(9)).tolist() == want
    base = [f"w{k}" for k in range(100)]
    # Each text goes on for some words more than the one before, so that neighbours are alike and the ends aren't.
    rows = [(k, " ".join(base[: 40 + 6 * k])) for k in range(10)]
    assert [r["doc_id"] for r in jaccard.one_of_each(Scratch(spark), table(spark, rows), 5).collect()] == [9]
