"""Operators that write files or score documents against items: brute-force versions and defined cases."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict
from datetime import datetime, timedelta
from functools import cache
from glob import glob

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexforge.llm import entry, late, lexical, token_files
from lexforge.llm.common import Scratch, small_batches


def tokenizer(name="word_bpe_49k.json"):
    import public_tokenizers

    return str(public_tokenizers.path(name))


# --- token ids


@cache
def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def whole_ids(texts, path, end=2):
    made = library(path)
    return [np.array([*made.encode(t or "", add_special_tokens=False).ids, end], "<u4") for t in texts]


LETTERS = st.sampled_from([*"ab Z\n\t\r'sStTΣσςéÉİıßﬁ中한가\x00\x1c\x85\xa0漢!?.,-½²09µȺ", "<|endoftext|>", "<|startoftext|>", "́", "̧", "'ll", "'S"])


@settings(max_examples=400, deadline=None)
@given(st.lists(LETTERS, max_size=25))
def test_pieces_encode_as_the_whole_text(chars):
    text, path = "".join(chars), tokenizer()
    assert (token_files.encoder(path)(text) == whole_ids([text], path)[0][:-1]).all()


def test_other_tokenizers_get_whole_texts():
    path = tokenizer("byte_bpe_50k.json")
    for text in ("", "Two  blanks\n\nand lines ", "é́ x"):
        assert (token_files.encoder(path)(text) == whole_ids([text], path)[0][:-1]).all()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=300), st.sampled_from([0, 50, 90, 100]))
def test_blocks_round_trip(ids, percentile):
    ids = np.array(ids, "<u4")
    assert (token_files.unpack(token_files.pack(ids, percentile)) == ids).all()


def test_outliers_do_not_widen_a_block():
    ids = np.array([7] * 4000 + [2**32 - 1] * 40, "<u4")
    assert len(token_files.pack(ids)) < 12 + 6 * 40 + 16


def test_any_run_of_ids_is_read(tmp_path):
    rng = np.random.default_rng(5)
    docs = [rng.integers(0, 50_000, size=n).astype("<u4") for n in (0, 1, 900, 64, 3, 0, 2000, 128)]
    with open(tmp_path / "x.ids", "wb") as file:
        to = token_files.Writer(file, block=64)
        for i, ids in enumerate(docs):
            to.add(i if i != 3 else None, ids)
        to.close()
    back, every = token_files.Reader(str(tmp_path / "x.ids")), np.concatenate(docs)
    for a, b in [(0, len(every)), (0, 0), (63, 65), (64, 128), (500, 501), (1000, 3000)]:
        assert (back.ids(a, b) == every[a:b]).all()
    found = list(back.digests())
    assert [f[0] for f in found] == [0, 1, 2, None, 4, 5, 6, 7]
    assert [f[2:] for f in found] == [(len(x), zlib.crc32(x.tobytes())) for x in docs]
    (tmp_path / "y.ids").write_bytes((tmp_path / "x.ids").read_bytes()[:-5])
    with pytest.raises(ValueError):
        token_files.Reader(str(tmp_path / "y.ids"))


def test_token_files(spark, tmp_path):
    rng = random.Random(3)
    words = ["Lorem", "ipsum,", "Ünder", "x" * 70, "don't", "中文", "1984"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(200)]
    rows += [(None, "of no id"), (None, None), (5000, None), (5001, ""), (5002, "many words here\n" * 40_000), (7, "again"), *[(8, "same text")] * 3]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, part string, n_ids long")
    made = token_files.write(Scratch(spark), docs, f"file://{tmp_path}/out", tokenizer(), 2, files=5)
    got = token_files.read(made).collect()
    assert len(glob(f"{tmp_path}/out/*")) == made.count() <= 5 and not glob(f"{tmp_path}/out/.*")
    by_start = sorted(got, key=lambda r: r.start)
    ids = [-1 if r.doc_id is None else r.doc_id for r in by_start]
    assert ids == sorted(ids) == sorted(-1 if i is None else i for i, _ in rows)
    assert [r.start for r in by_start] == [0, *np.cumsum([r.n_tokens for r in by_start])[:-1].tolist()]
    want = sorted((-1 if i is None else i, len(x), zlib.crc32(x.tobytes())) for (i, _), x in zip(rows, whole_ids([t for _, t in rows], tokenizer()), strict=True))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want


def test_no_documents_no_files(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_files.read(token_files.write(Scratch(spark), docs, f"file://{tmp_path}/out", tokenizer(), 2)).collect() == []


def test_op13_on_the_whole_table(spark):
    docs = sorted(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect())
    at, want = 0, []
    for (doc, _), ids in zip(docs, whole_ids([t for _, t in docs], tokenizer()), strict=True):
        want.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in entry.op13_token_blocks(spark, "/root/testdata/sf0.001").collect()) == want


# --- ranked lexical search


def split_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def lexical_brute(docs, items, k):
    held = [(i, Counter(split_terms(t))) for i, t in docs]
    n_docs, total = sum(1 for _, c in held if c), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in sorted(set(items), key=repr):
        found = []
        for no, (doc, c) in enumerate(held):
            m = 75 + 25 * sum(c.values()) * n_docs // max(1, total)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 12 * m)) for t in split_terms(text) if c[t])
            if score > 0:
                found.append((-score, -(2**63) if doc is None else doc, no))
        out += [(item, r + 1, None if d == -(2**63) else d, -s) for r, (s, d, _) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def test_lexical_search(spark, monkeypatch):
    rng = random.Random(4)
    words = ["the", "The", "öl", "Öl", "x_y", "a1", "2024", "rare", "中文字", "q", "semi;colon", "n\x00ul"]
    text = lambda n: " ".join(rng.choice(words[: rng.randint(1, len(words))]) for _ in range(n))
    docs = [(i, text(rng.randint(0, 30))) for i in range(300)] + [(None, "rare öl"), (None, None), (400, None), (401, "...")]
    docs += [(500 + i, "the very same rare text") for i in range(60)] + [(7, "rare rare")] * 3 + [(600, "long rare " * 50_000)]
    items = [(0, "the rare THE"), (1, "öl Öl 中文字"), (2, None), (3, "!"), (4, "unseen words"), (5, text(40)), (None, "rare"), (5, "another rare text"), (0, "the rare THE"), (6, "the very same rare text")]
    rng.shuffle(docs)
    doc_rows = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, score int").repartition(5)
    item_rows = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    want = lexical_brute(docs, items, 20)
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 50)
    for item_bytes in (lexical.ITEM_BYTES, 40):  # one block of items, or several
        found = lexical.search(Scratch(spark), doc_rows, item_rows, 20, item_bytes)
        assert sorted((tuple(r) for r in found.collect()), key=repr) == want
    none = doc_rows.limit(0)
    assert lexical.search(Scratch(spark), none, item_rows, 20).collect() == [] == lexical.search(Scratch(spark), doc_rows, item_rows.limit(0), 20).collect()


def test_lengths_beyond_64_bits():
    n = np.array([10, 2**40], np.int64)
    assert lexical.lengths(n, 10**9, 10**13).tolist() == [75 + 25 * x * 10**9 // 10**13 for x in (10, 2**40)]


# --- late arrivals

EPOCH = datetime(1970, 1, 1)
SALE = "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int"


def micros(t):
    return None if t is None else (t - EPOCH) // timedelta(microseconds=1)


def sale_day(t):
    return -1 if t is None else micros(t) // 86_400_000_000


def least(x):
    return (x is not None, x)


def layout(rows, size):
    """(day, file_no) -> rows, of the latest row of each id."""
    last = {}
    for r in rows:
        rank = tuple(map(least, (r[5], r[1], r[2], r[3], r[4], r[6])))
        if r[0] not in last or rank > last[r[0]][0]:
            last[r[0]] = rank, r
    days = defaultdict(list)
    for _, r in last.values():
        days[sale_day(r[4])].append(r)
    out = {}
    for day, rs in days.items():
        rs.sort(key=lambda r: (least(r[4]), least(r[0])))
        for i in range(0, len(rs), size):
            out[day, i // size] = rs[i : i + size]
    return out, {k: r for k, (_, r) in last.items()}


def described(rows):
    text = lambda x: "" if x is None else str(x)
    cents = sum(math.floor(100 * r[3] + 0.5) for r in rows if r[3] is not None)
    crc = sum(zlib.crc32(":".join(map(text, (r[0], micros(r[4]), micros(r[5])))).encode()) for r in rows)
    return len(rows), cents, crc, ",".join(x.split()[0] for x in SALE.split(", ")), hashlib.sha256(",".join(text(r[0]) for r in rows).encode()).hexdigest()


def late_brute(early, late_rows, size):
    start, was = layout(early, size)
    final, now = layout([*early, *late_rows], size)
    moved = [k for k in now if k not in was or was[k] is not now[k]]
    dirty = {sale_day(now[k][4]) for k in moved} | {sale_day(was[k][4]) for k in moved if k in was}
    return sorted((d, n, *described(rs), d in dirty) for (d, n), rs in final.items())


def with_copies(rows):
    out = list(rows)
    for r in rows:
        h = zlib.crc32(str(r[0]).encode()) if r[0] is not None else 1
        if h % 3 == 0 and sale_day(r[4]) % 10 == 0:
            later = None if r[5] is None else r[5] + timedelta(days=1 + h % 97)
            out.append((*r[:3], None if r[3] is None else r[3] + 1, r[4] + timedelta(days=h % 2), later, r[6]))
    return out


def found(df):
    cols = ("day", "file_no", "n_rows", "cents", "rows_crc", "columns", "ids_sha256", "rewritten")
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def sale_rows(rng, n, days=12):
    out = []
    for i in range(n):
        sold = None if i % 23 == 0 else datetime(2024, 1, 1) + timedelta(seconds=rng.choice([days * 57_600, rng.randrange(days * 86_400)]))
        arrived = None if i % 115 == 0 else (sold or datetime(2024, 1, 5)) + timedelta(seconds=rng.randrange(5 * 86_400), microseconds=rng.randrange(3))
        out.append((rng.randrange(40 * n), rng.randrange(9), rng.choice(["done", None, "open"]), rng.choice([None, 1.005, -2.5, 10.0]), sold, arrived, rng.choice([None, 1, 2])))
    return out + out[:20] + [(None, 1, "x", 1.0, datetime(2024, 1, 2, 3), datetime(2024, 1, 2, 4), 1), (None, 1, "x", 2.0, datetime(2024, 1, 3, 3), datetime(2024, 1, 9), 1)]


@pytest.mark.parametrize("run_files", [1, 2, 8])
def test_late_overwrite(spark, tmp_path, run_files):
    rows, size, cut = sale_rows(random.Random(9), 700, days=30), 20, datetime(2024, 1, 22)
    early, after = [r for r in rows if r[5] is not None and r[5] < cut], [r for r in rows if r[5] is None or r[5] >= cut]
    scratch, keys, root = Scratch(spark), entry.SALES, f"file://{tmp_path}/sales"
    late.write_layout(spark.createDataFrame(early, SALE), root, keys, size)
    start = {p: open(p, "rb").read() for p in glob(f"{tmp_path}/sales/**/*.parquet", recursive=True)}
    dirty = late.overwrite(scratch, root, spark.createDataFrame(after, SALE), keys, size, run_files)
    days = spark.createDataFrame([(sale_day(r[4]),) for r in rows], "day long").distinct()
    out = late.describe(scratch, root, days, keys, "total").join(dirty.withColumn("rewritten", F.lit(True)), "day", "left").fillna(False)
    want = late_brute(early, after, size)
    assert found(out) == want
    assert {r[-1] for r in want} == {True, False} and max(r[1] for r in want) >= 3
    left = set(glob(f"{tmp_path}/sales/**/*.parquet", recursive=True))
    assert left == {r.path for r in out.collect()}  # nothing else is left
    for r in out.filter("not rewritten").collect():
        assert start[r.path] == open(r.path, "rb").read()
    assert not glob(f"{tmp_path}/sales/_new*") and not glob(f"{scratch.root.removeprefix('file://')}/spill/*")


def test_a_swap_that_broke_off_is_ended(spark, tmp_path, monkeypatch):
    rows = sale_rows(random.Random(2), 200, days=4)
    early, after, keys, root = rows[:120], rows[120:], entry.SALES, f"{tmp_path}/sales"
    late.write_layout(spark.createDataFrame(early, SALE), root, keys, 15)
    calls, whole = [], late.swap
    monkeypatch.setattr(late, "swap", lambda *a: calls.append(a))
    late.overwrite(Scratch(spark), root, spark.createDataFrame(after, SALE), keys, 15)
    monkeypatch.undo()
    one = sorted(glob(f"{root}/_new-*/day=*/file_no=0/made.parquet"))[0]  # a file that was moved before, and one removed
    to = os.path.dirname(one).replace(f"_new-{calls[0][2]}/", "")
    os.makedirs(to, exist_ok=True)
    os.replace(one, f"{to}/late-{calls[0][2]}.parquet")
    whole(*calls[0])
    days = spark.createDataFrame([(sale_day(r[4]),) for r in rows], "day long")
    out = late.describe(Scratch(spark), root, days, keys, "total").withColumn("rewritten", F.lit(True))
    assert [r[:-1] for r in found(out)] == [r[:-1] for r in late_brute(early, after, 15)]


def test_late_defined_cases(spark, tmp_path):
    keys, none = entry.SALES, spark.createDataFrame([], SALE)
    late.write_layout(none, f"{tmp_path}/empty", keys, 5)
    days = spark.createDataFrame([(-1,), (19723,)], "day long")
    assert late.overwrite(Scratch(spark), f"{tmp_path}/empty", none, keys, 5).count() == 0 == late.describe(Scratch(spark), f"{tmp_path}/empty", days, keys, "total").count()
    rows = sale_rows(random.Random(1), 50, days=3)
    late.overwrite(Scratch(spark), f"{tmp_path}/empty", spark.createDataFrame(rows, SALE), keys, 5)  # all rows are late
    days = spark.createDataFrame([(sale_day(r[4]),) for r in rows], "day long")
    out = late.describe(Scratch(spark), f"{tmp_path}/empty", days, keys, "total").withColumn("rewritten", F.lit(True))
    assert found(out) == late_brute([], rows, 5)
    with pytest.raises(ValueError):
        late.write_layout(none.withColumn("day", F.lit(1)), f"{tmp_path}/no", keys, 5)
    with pytest.raises(ValueError):
        late.local_path("hdfs://host/x")


def test_op12_on_the_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/sales.parquet").collect()]
    every, cut = with_copies(rows), datetime(2024, 3, 1)
    early = [r for r in every if r[5] is not None and r[5] < cut]
    after = [r for r in every if r[5] is None or r[5] >= cut]
    assert found(entry.op12_late_overwrite(spark, "/root/testdata/sf0.001")) == late_brute(early, after, 1 + len(rows) // 900)


def test_batches_of_texts_are_cut_by_bytes(spark):
    import pyarrow as pa

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["bytes"])

    small_batches(spark, 256)
    rows = spark.range(60, numPartitions=1).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))
    got = [r.bytes for r in rows.mapInArrow(sizes, "bytes long").collect()]
    assert len(got) > 8 and max(got) <= 6 << 20


def test_a_written_table_leaves_no_garbage_on_the_driver(spark, monkeypatch):
    from lexforge.llm.common import Scratch

    calls = []
    monkeypatch.setattr(Scratch, "tidy", lambda self: calls.append(1))
    assert Scratch(spark).save(spark.range(3), "t").count() == 3 and calls == [1]
