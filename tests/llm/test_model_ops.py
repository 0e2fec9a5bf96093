"""Vector search, pages, language, mixing and the pipeline."""

import random
import zlib

import numpy as np
import pytest

from lexforge.llm import language, mixing, pages, vectors
from lexforge.llm.common import Scratch


def vector_table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1.0, True) for i, v in rows], "vec_id long, embedding array<float>, label int, v double, query boolean")


def vector_rows():
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(300)]
    rows += [(300 + i, [1.0] * 8) for i in range(60)]
    rows += [(400, None), (420, [1.0, None, 2.0]), (440, [float("nan")] * 8), (460, [0.0] * 8), (480, [float("inf")] * 8), (500, [1.0, 2.0]), (None, [1.0] * 8), (20, [0.5] * 8)]
    return rows


def valid(rows, zero):
    out = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v)):
            out.append((i, np.array([*v, *[0.0] * (8 - len(v))], np.float32).astype(float)))
    return out


def answers(held, every, k, score):
    """Of every query row its best candidates; rows of its id are none."""
    out = []
    for q, x in held:
        if q % every == 0:
            best = sorted((score(x, y), i) for i, y in held if i != q)[:k]
            out += [(q, r + 1, i, s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def test_exact_top(spark):
    rows = vector_rows()
    rows += [(300, [1.0] * 8)] * 30 + [(7, [1.0] * 8)] * 25 + [rows[3], rows[40], rows[60]]  # ids and whole rows that repeat
    held = [(i, np.floor(64 * v)) for i, v in valid(rows, True)]
    want = [(q, r, i, -s) for q, r, i, s in answers(held, 20, 20, lambda x, y: -int(x @ y))]
    got = sorted(tuple(r) for r in vectors.exact_top(Scratch(spark), vector_table(spark, rows), 20, 20).collect())
    assert got == want


def test_survivors_are_fewer_than_candidates():
    rng = np.random.default_rng(0)
    spread = np.exp(-np.arange(64) / 8.0)  # as of real embeddings: few directions hold most
    x = np.floor(64 * (rng.normal(size=(4000, 64)) * spread) @ np.linalg.qr(rng.normal(size=(64, 64)))[0])
    ids, queries = np.arange(4000), x[:50]
    scored = 0
    for i, found, scores in vectors.SegmentIndex(x, ids).top(queries, ids[:50], 20):
        exact = x @ queries[i]
        exact[i] = -np.inf
        assert set(np.argsort(-exact)[:15]) <= set(found.tolist()) and (exact[found] == scores).all()
        scored += len(found)
    assert scored < 0.1 * 50 * 4000


def test_bounds_hold():
    rng = np.random.default_rng(0)
    x, q = rng.integers(-50, 50, (200, 37)).astype(float), rng.integers(-50, 50, (1, 37)).astype(float)
    for n in (1, 4, 16, 64):
        cuts = vectors.cuts_of(x, n)
        assert cuts[0] == 0 and cuts[-1] == 37 and len(cuts) <= min(n, 37) + 1
        bound = vectors.segment_statistics(x, cuts) @ vectors.segment_statistics(q, cuts)[0]
        assert (bound >= x @ q[0] - 1e-6).all()
    big = np.array([[2.0**60, 1.0]])
    assert vectors._products(big, big[0]).tolist() == [2**63 - 1]


def test_nearest_recall(spark):
    """On three full shards of vectors without any structure, with the parameters of the query."""
    from lexforge.llm import entry

    rng = np.random.default_rng(8)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(3 * vectors.SHARD_ROWS, 64)).astype(np.float32))]
    rows += [rows[100], rows[500], (300, rows[7][1])]
    held = valid_wide(rows)
    got = vectors.nearest(Scratch(spark), vector_table(spark, rows), entry.NEAREST_EVERY, entry.NEAREST).collect()
    ids, x = np.array([i for i, _ in held]), np.stack([v for _, v in held])
    hits = total = 0
    want = {}
    for q, v in held:
        if q % entry.NEAREST_EVERY == 0:
            far = np.sqrt(((x - v) ** 2).sum(1))
            best = [j for j in np.lexsort((ids, far)) if ids[j] != q][:10]
            want.setdefault(q, []).append({ids[j] for j in best})
    for q, sets in want.items():
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r for r, _, _ in mine] == sorted(list(range(1, 11)) * len(sets))
        found = {i for _, i, _ in mine}
        assert q not in found and all(any(i == j and abs(np.sqrt(((x[k] - v) ** 2).sum()) - s) < 1e-9 for k, j in enumerate(ids) if j == i for p, v in held if p == q) for _, i, s in mine[:3])
        hits += sum(len(best & found) for best in sets) if len(sets) == 1 else 0
        total += 10 if len(sets) == 1 else 0
    assert hits / total >= 0.9, hits / total


def valid_wide(rows):
    return [(i, np.array(v, np.float32).astype(float)) for i, v in rows]


def test_nearest_of_awkward_rows(spark):
    rows = vector_rows() + [(300, [1.0] * 8)] * 30 + [(7, [1.0] * 8)] * 25
    held = valid(rows, False)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in vectors.nearest(Scratch(spark), vector_table(spark, rows), 20, 10, share=1.0).collect())
    assert got == [(q, r, i, round(s, 9)) for q, r, i, s in answers(held, 20, 10, lambda x, y: float(np.sqrt(((x - y) ** 2).sum())))]
    assert vectors.nearest(Scratch(spark), vector_table(spark, []), 20, 10).count() == 0
    assert vectors.exact_top(Scratch(spark), vector_table(spark, [(0, [1.0])]), 20, 10).count() == 0
    assert vectors.exact_top(Scratch(spark), vector_table(spark, [(0, []), (1, [])]), 20, 10).count() == 1


def test_footrule():
    rng = np.random.default_rng(1)
    x, p = rng.normal(size=(50, 4)), rng.normal(size=(12, 4))
    index, orders = vectors.PermutationIndex(x, p, 5), vectors.prefixes(x, p, 5)
    query = vectors.prefixes(rng.normal(size=(1, 4)), p, 5)[0].tolist()
    place = lambda order, k: order.index(k) if k in order else 5
    want = [sum(abs(place(query, k) - place(o, k)) for k in range(12)) for o in orders.tolist()]
    assert index.footrule(np.array(query)).tolist() == want


def brute_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_common_lines(monkeypatch):
    rng = random.Random(1)
    for room in (pages.ROOM, 4):  # 4: all tables are halved
        monkeypatch.setattr(pages, "ROOM", room)
        for _ in range(60):
            a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
            found = pages.common_lines(a, b)
            rest = iter(b)
            assert len(found) == brute_lcs(a, b) and found == sorted(found) and all(a[i] in rest for i in found)


def test_lines_of_very_long_pages_align_in_little_memory():
    import tracemalloc

    a = [k % 9973 for k in range(40_000)]
    tracemalloc.start()
    found = pages.common_lines(a, a[::2] + a[1::2])
    assert len(found) >= 20_000 and tracemalloc.get_traced_memory()[1] < 64 << 20
    tracemalloc.stop()


def pages_brute(rows):
    """Per page id the text: each page against the nearest of its neighbours, by a plain table of common subsequences."""
    def place(url):
        bare = (url or "").split("?")[0].split("#")[0].split("://")[-1]
        host, slash, path = bare.partition("/")
        return host.lower().rsplit("@", 1)[-1].split(":")[0], slash + path

    def shared(a, b):
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        out, i, j = set(), len(a), len(b)
        while i and j:
            if table[i][j] == table[i][j - 1]:
                j -= 1
            elif table[i][j] == table[i - 1][j]:
                i -= 1
            else:
                i, j = i - 1, j - 1
                out.add(i)
        return out

    read = sorted(((*place(url), no, *pages.read_lines(page)) for no, url, page in rows), key=lambda x: x[:3])
    main = lambda r: [x for x, k in zip(r[3], r[4]) if k == (pages.IN if pages.IN in r[4] else pages.OPEN)] + [pages.IN in r[4]]
    runs = []
    for r in read:
        if not runs or (runs[-1][0][0], main(runs[-1][0])) != (r[0], main(r)):
            runs.append([])
        runs[-1].append(r)
    out = {}
    for i, run in enumerate(runs):
        lines, kinds, near = run[0][3], run[0][4], []
        for j, mine, other in ((i - 1, 0, -1), (i + 1, -1, 0)):
            if 0 <= j < len(runs) and runs[j][0][0] == run[0][0]:
                a, b = run[mine][1], runs[j][other][1]
                alike = next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
                near.append((-alike, len(near), runs[j][0][3], runs[j][0][4]))
        opened = {k for k, kind in enumerate(kinds) if kind == pages.OPEN}
        sets = [(shared(lines, x), y.count(pages.OPEN)) for _, _, x, y in sorted(near, key=lambda x: x[:2])]
        gone = next((s for s, n in sets if len(s & opened) < 0.9 * max(len(opened), n)), sets[0][0] & sets[1][0] if len(sets) == 2 else set())
        keep = [x for k, x in enumerate(lines) if kinds[k] == pages.IN or (pages.IN not in kinds and kinds[k] == pages.OPEN and k not in gone)]
        out.update({r[2]: "\n".join(keep) for r in run})
    return out


@pytest.mark.parametrize("parts", [1, 5])
def test_whole_query_against_brute_force(spark, monkeypatch, parts):
    import os

    rng = random.Random(parts)
    monkeypatch.setattr(pages, "parts", lambda _: parts)
    rows = []
    for no in range(160):  # sites with templates of their own; some pages mark their article, some are copies
        site, story = no % 5, rng.randrange(60)
        top = "".join(f"<div>site {site} menu {m}</div>" for m in range(rng.choice([4, 5])))
        body = "".join(f"<p>story {story} part {m}</p>" for m in range(6)) + ("<p>quoted by all</p>" if no % 3 else "")
        body = f"<article>{body}</article>" if story % 4 == 0 else body
        rows.append((no, f"http://Site{site}.example/{rng.choice('ab')}/{rng.randrange(30):02}", f"<body>{top}{body}<div>end of site {site}</div></body>"))
    if os.path.exists("/root/testdata/sf0.001/pages.parquet"):
        rows += [(1000 + r["page_id"], r["url"], r["html"]) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    got = pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == pages_brute(rows)
    assert sum(r["n_shared"] for r in got) > 500 and sum(r["n_protected"] for r in got) > 10 and len(got) == len(rows)
    for r in got:
        assert r["n_own"] + r["n_protected"] == len(r["text"].split("\n")) * bool(r["text"])


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<body><nav>Menu</nav><main><h1>T</h1><p>A&nbsp;b\n c<br>d<p>e</main><footer>f</footer>", "T\nA b c d\ne"),
        ('<article><p>x</p><div class="share-bar">s</div><section id="comments"><p>c</p></section><form><p>q</p></form></article><p>out</p>', "x"),
        ('<div class="sidebar">s</div><div class="no-sidebar"><p>in</p></div><div role="banner">b</div><p hidden>h</p>', "in"),
        ('<script>var t="</p><p>no</p>";</script><style>p{}</style><p>yes</p><!-- <p>no</p> --><p>cut', "yes\ncut"),
        ("<article><p class='social-policy'>a</p><section class='related-work'>b</section><div class='related-posts'>c</div><p class='socialIcons'>d</p></article>", "a\nb"),
        ("<body><form action=x><div>top</div><article><p>a</p><form><p>find</p></form></article></form>", "a"),
        ("<body><form><h1>t</h1><p>one two three</p><p>four five six</p></form><form><p>find</p><p>it</p></form>", "t\none two three\nfour five six"),
        ("<p title=it's>first</p><p title=it's>second</p><p title='a>b'>third</p>", "first\nsecond\nthird"),
        ("<p>x</p><div class='legal'>l</div><article class='legal'><div class='legal'>y</div></article>", "y"),
        ("<title>t</title><body><header>site</header><article><header><h1>own</h1></header><p>1 < 2 &lt;b&gt;</p></article>", "own\n1 < 2 <b>"),
    ],
)
def test_page_text(page, text):
    lines, kinds = pages.read_lines(page)
    assert pages.main_text(lines, kinds, set()) == text


def test_nearest_pages_lose_shared_lines(spark):
    page = lambda k: f"<body><div>Welcome to the site</div><p>Story {k} begins</p><p>and ends {k}</p><div>Powered by x</div></body>"
    rows = [(k, f"http://Host.example/a/{k}.html?x=1", page(k), "clash") for k in range(30)]
    rows += [(100, "http://other.example/", page(100), "c"), (101, None, None, "c"), (102, "http://copy.example/1", page(5), "c"), (103, "http://copy.example/2", page(5), "c"), (None, "x", "<p>y", "c")]
    out = {r["page_id"]: r for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string, host string")).collect()}
    assert len(out) == len(rows)
    assert all(out[k]["text"] == f"Story {k} begins\nand ends {k}" for k in range(30))
    assert out[100]["text"].startswith("Welcome") and out[101]["text"] == "" and out[102]["text"] == out[103]["text"] != "" and out[None]["n_chars"] == 1
    assert pages.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_template_heavy_pages_and_copies(spark):
    menu = "<nav><ul>" + "".join(f"<li>menu {k}</li>" for k in range(30)) + "</ul></nav>"
    marked = lambda k: f"<body>{menu}<div>Powered by x</div><p>a {k}<p>b {k}<p>c {k}</body>"
    bare = lambda k: "<body>" + "".join(f"<div>menu {m}</div>" for m in range(40)) + f"<p>a {k}<p>b {k}</body>"
    rows = [(k, f"http://marked.example/a/{k:03}", marked(k)) for k in range(40)]
    rows += [(100 + k, f"http://bare.example/a/{k:03}", bare(k)) for k in range(40)]
    # Runs of copies, longer than a range and with paths nearer to either side; their menus may differ.
    rows += [(200 + k, f"http://runs.example/{'abc'[k // 40]}/{k:03}", f"<nav>{k}</nav>" + marked(k // 40 if 3 < k < 117 else k)) for k in range(120)]
    rows += [(400, "http://near.example/1", bare(1)), (401, "http://near.example/2", bare(2))]
    out = {r["page_id"]: r["text"] for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(out) == len(rows)
    assert all(out[k] == f"a {k}\nb {k}\nc {k}" for k in range(40))
    assert all(out[100 + k] == f"a {k}\nb {k}" for k in range(1, 39))
    for k in range(120):
        j = k // 40 if 3 < k < 117 else k
        assert out[200 + k] == f"a {j}\nb {j}\nc {j}"
    assert out[400] != out[401] and "menu 3" in out[400]  # two pages alone may be copies with a change


def test_backpropagation():
    rng = np.random.default_rng(0)
    w = {k: v.astype(float) for k, v in language._fresh(3, rng).items()}
    x, y = rng.integers(0, 256, (3, 5)), np.array([0, 1, 2])
    _, grad = language.gradients(w, x, y)
    for k in w:
        at = tuple(np.argwhere(np.abs(grad[k]) > 1e-6)[0])
        w[k][at] += 1e-5
        up, _ = language.gradients(w, x, y)
        w[k][at] -= 2e-5
        down, _ = language.gradients(w, x, y)
        w[k][at] += 1e-5
        assert (up - down) / 2e-5 == pytest.approx(grad[k][at], rel=1e-4)


SYLLABLES = {"aa": ["ka", "lo", "mi"], "bb": ["être", "oux", "né"]}


def text_of(lang, rng, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_letters():
    assert not any(map(language.has_letter, ["", " 12 ", "\u00bd \u00b2 \u2163 _"])) and all(map(language.has_letter, ["1a", "\u00aa", "\u4e2d", "\u02b0"]))


def test_sample_reads_whole_texts(spark):
    docs = spark.createDataFrame([(i, "x" * 50_000 + "y" * 50_000, "aa") for i in range(40)], "doc_id long, text string, lang string")
    got = language.sample(docs)
    assert all(len(t) == language.SAMPLE_WINDOWS * language.WINDOW for _, t in got) and any(b"y" in t for _, t in got) and any(b"x" in t for _, t in got)
    many = spark.range(1800).selectExpr("id doc_id", "'word' text", "cast(id as string) lang")
    with pytest.raises(ValueError, match="distinct values"):
        language.sample(many)


def test_positions_by_an_independent_forward_pass():
    """The pooled distributions, one byte and one unit at a time."""
    rng = np.random.default_rng(2)
    w = language._fresh(3, rng)
    model, text, h = language.Model(["a", "b", "c"], w), bytes(rng.integers(0, 256, 300, dtype=np.uint8)), language.HIDDEN
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    total = np.zeros(3)
    for at in range(0, len(text), language.SEGMENT):
        part, states = text[at : at + language.SEGMENT], {}
        for d in "fb":
            state, held = np.zeros(h), {}
            for i in range(len(part)) if d == "f" else reversed(range(len(part))):
                x, back = w[f"table_{d}"][part[i]].astype(float), state @ w[f"back_{d}"].astype(float)
                reset, update = sigmoid(x[:h] + back[:h]), sigmoid(x[h : 2 * h] + back[h : 2 * h])
                state = update * state + (1 - update) * np.tanh(x[2 * h :] + reset * (back[2 * h :] + w[f"inner_{d}"]))
                held[i] = state
            states[d] = held
        for i in range(len(part)):
            z = np.concatenate([states["f"][i], states["b"][i]]) @ w["out"] + w["bias"]
            total += np.exp(z) / np.exp(z).sum()
    assert np.allclose(language.distributions(model, [text])[0], total / len(text), atol=1e-5)


def test_language(spark):
    rng = random.Random(0)
    rows = [(i, text_of(lang := rng.choice("ab") * 2, rng, 40), lang, "x") for i in range(200)]
    rows += [(1000, None, "aa", "x"), (1001, "123 !?", "bb", "x"), (None, text_of("bb", rng, 300), None, "x"), (7, rows[7][1], rows[7][2], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    samples = language.sample(docs)
    assert len(samples) == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i, t, lang, _ in rows if t and lang)
    model = language.train(samples, steps=120)
    out = language.predict(docs, model).collect()
    got = {(r["row"]["doc_id"]): (r["lang_pred"], r["score"]) for r in out}
    assert len(out) == len(rows) and got[1000] == got[1001] == ("und", 0.0) and got[None][0] == "bb"
    held = [(got[i][0], lang) for i, t, lang, _ in rows[:200] if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([a == b for a, b in held]) > 0.95
    assert set(language.label_positions(model, "être né " * 40)) <= {"aa", "bb"}
    whole, parts = language.distributions(model, [b"kalo mi " * 100]), language.distributions(model, [b"", b"kalo mi " * 100, b"x"])
    assert np.allclose(whole[0], parts[1]) and parts[0].sum() == 0
    nothing = language.predict(docs, language.train([])).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}
    assert language.predict(docs.limit(0), model).count() == 0


def mixing_docs(spark):
    rng = random.Random(4)
    rows = []
    for i in range(300):
        bad = i % 5 == 0
        rows.append((i, " ".join(rng.choice(["awful", "nasty"]) if bad and rng.random() < 0.3 else rng.choice(["sun", "tree", "road", "sky"]) for _ in range(rng.randint(5, 40))), "clash"))
    rows += [(900, None, "c"), (901, "", "c"), (None, "sun tree", "c"), (3, rows[3][1], "c")]
    labels = [(i, int(i % 5 != 0), 0) for i in range(0, 300, 2)] + [(5000, 1, 0), (None, 1, 0), (7, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, rate string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_mixing_reaches_targets(spark):
    docs, labels = mixing_docs(spark)
    mixed = mixing.mix(Scratch(spark), docs, mixing.quality_domains(labels), {"good": 0.5, "low": 0.5})
    out = mixed.members.collect()
    assert len(out) == docs.count() and all(r["rate"] >= 0 for r in out)
    reached = sum(np.array(r["p"]) * r["n_tokens"] * r["rate"] for r in out)
    assert np.allclose(reached, mixed.targets, rtol=1e-3) and np.allclose(reached, mixed.reached, rtol=1e-6)
    assert {r["rate"] for r in out if not r["n_tokens"]} == {1.0}
    # No other nonnegative rates come nearer: where a rate is 0 the gradient points outward.
    none = mixing.mix(Scratch(spark), docs, mixing.quality_domains(labels), factors={"low": 0.0})
    assert none.reached[none.domains.index("low")] < 0.1 * sum(r["n_tokens"] * r["p"][none.domains.index("low")] for r in out)
    rest = mixing.mix(Scratch(spark), docs, mixing.quality_domains(labels), without=("low",))
    assert np.allclose(rest.reached, rest.targets, rtol=1e-3)
    nasty = {r["doc_id"] for r in docs.filter("text like '%awful%awful%nasty%' or text like '%nasty%nasty%awful%'").collect()}
    clean = {r["doc_id"] for r in docs.filter("text not like '%awful%' and text not like '%nasty%'").collect()} - {None}
    rates = {r["doc_id"]: r["rate"] for r in rest.members.collect()}
    assert all(rates[i] < 0.5 for i in nasty) and all(rates[i] >= 0.5 for i in clean) and nasty and clean
    empty = mixing.mix(Scratch(spark), docs.limit(0), mixing.quality_domains(labels.limit(0)), {"good": 1.0})
    assert empty.members.count() == 0
    one = mixing.mix(Scratch(spark), docs, mixing.quality_domains(labels.limit(0)), {"all": 1.0})
    assert one.domains == ["all"] and all(r["rate"] == pytest.approx(1.0) for r in one.members.collect())


def test_projected_gradient_is_least_squares():
    rng = np.random.default_rng(0)
    p, n = rng.dirichlet([1, 1, 1], 400), rng.integers(1, 50, 400).astype(float)

    def look(steps):
        got = mixing.held(p, n, steps)
        return got[:3], got[3:].reshape(3, 3)

    target = np.array([0.7, 0.25, 0.05]) * n.sum()
    steps, reached = mixing.descend(look, target)
    assert np.allclose(reached, target) and np.allclose((mixing.replay(p, steps) * n) @ p, target)
    plain, all_of = [], np.linalg.pinv((p * n[:, None]).T @ p)
    far = np.array([0.9, 0.08, 0.02]) * n.sum()
    for _ in range(40):
        plain.append(all_of @ ((mixing.replay(p, plain) * n) @ p - far))
    squares = lambda x: (x - far) @ all_of @ (x - far)
    _, reached = mixing.descend(look, far, 60)
    assert squares(reached) <= squares((mixing.replay(p, plain) * n) @ p)


@pytest.mark.parametrize("soft", [1, 3, 10])
def test_rates_end_at_the_least_squares(soft, caplog):
    rng = np.random.default_rng(soft)
    p, n = rng.dirichlet([soft] * 3, 5000), rng.integers(20, 500, 5000).astype(float)
    targets, looks = np.array([0.9, 0.08, 0.02]) * n.sum(), []

    def look(steps):
        looks.append(len(steps))
        got = mixing.held(p, n, steps)
        return got[:3], got[3:].reshape(3, 3)

    steps, reached = mixing.descend(look, targets)
    rate, gradient = mixing.replay(p, steps), p @ np.linalg.pinv((p * n[:, None]).T @ p) @ (reached - targets)
    assert np.allclose((rate * n) @ p, reached) and gradient.min() > -1e-3 and np.abs(gradient[rate > 0]).max() < 1e-3
    assert len(looks) < 150 and not caplog.records


def test_residual_tells_a_stopped_fit():
    rng = np.random.default_rng(3)
    p, n = rng.dirichlet([3, 3, 3], 5000), rng.integers(20, 500, 5000).astype(float)
    targets = np.array([0.9, 0.08, 0.02]) * n.sum()  # out of reach

    def look(steps):
        got = mixing.held(p, n, steps)
        return got[:3], got[3:].reshape(3, 3)

    done, stopped = (mixing.descend(look, targets, turns)[0] for turns in (mixing.STEPS, 1))
    assert mixing.residual(look, done, targets) <= 2 * mixing.FLAT < 1e-3 < mixing.residual(look, stopped, targets)


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    from lexforge.llm import simhash

    rng = random.Random(9)
    shared = "This very long line is shared by every one of these documents here"
    rows = [(i, "\n".join([text_of("aa" if i % 2 else "bb", rng, 30), shared]), "aa" if i % 2 else "bb", "s", 0) for i in range(60)]
    rows += [(100 + k, rows[4][1], rows[4][2], "s", 0) for k in range(3)] + [(200, None, "aa", "s", 0), (201, "123", "aa", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 3)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    first = pipeline.language_stage(spark, docs, str(tmp_path))
    assert {r["doc_id"] for r in first.collect()} == {i for i, *_ in rows} - {200, 201} and first.columns == docs.columns
    second = pipeline.line_stage(spark, docs, str(tmp_path)).collect()
    assert sum(shared in (r["text"] or "") for r in second) == 1
    third = pipeline.near_stage(spark, docs, str(tmp_path)).collect()
    prints = {i: simhash.fingerprint(t, pipeline.SHINGLE_WORDS) for i, t, *_ in rows}
    assert len({prints[r["doc_id"]] for r in third}) == len(third) == len(set(prints.values()))
    fourth = pipeline.mix_stage(spark, docs, str(tmp_path))
    assert fourth.count() == len(rows) and fourth.columns == docs.columns
    out = pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} <= {i for i, *_ in rows} - {200, 201}
    assert len({r["doc_id"] for r in out} & {4, 100, 101, 102}) == 2  # the last copy alone still has the shared line


def test_mix_stage_removes_rows_not_ids(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(6)
    text = lambda bad: " ".join(rng.choice(["awful", "nasty"]) if bad else rng.choice(["sun", "tree", "road", "sky"]) for _ in range(20))
    rows = [(i, text(i % 5 == 0), "aa", "s", 0) for i in range(200)]
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows += [(i, text(bad), "aa", "s", 0) for i in (None, 1000) for bad in (True, False, False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = pipeline.mix_stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    left = [(r["doc_id"], r["text"]) for r in out.collect()]
    bad = lambda t: "awful" in t or "nasty" in t
    assert sorted(left, key=str) == sorted(((i, t) for i, t, *_ in rows if not bad(t)), key=str)


def test_stages_on_defined_cases(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(11)
    rows = [(i, text_of("aa" if i % 2 else "bb", rng, 30), "aa" if i % 2 else "bb") for i in range(40)]
    odd = [(None, text_of("aa", rng, 25), None), (50, None, "aa"), (51, "", "bb"), (52, " \n ", None), (53, "1 2 3", "aa"), (54, text_of("bb", rng, 20_000), "bb"), (7, rows[7][1], "aa")]
    kind = "doc_id long, text string, lang string, source string, n_chars long, row string, whole string, rate double, _k1 long"
    docs = spark.createDataFrame([(*r, "s", 0, "x", "y", 0.0, 1) for r in rows + odd], kind)
    docs.limit(0).select("doc_id").selectExpr("doc_id", "1 as quality", "0 as toxic").write.parquet(f"{tmp_path}/labels.parquet")
    ids = lambda out: sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in out.collect())
    every, lettered = sorted([*range(40), -1, 50, 51, 52, 53, 54, 7]), sorted([*range(40), -1, 54, 7])
    first = pipeline.language_stage(spark, docs, str(tmp_path))
    assert first.columns == pipeline.COLUMNS and ids(first) == lettered and first.filter("lang is null").count() == 0
    assert ids(pipeline.line_stage(spark, docs, str(tmp_path))) == every
    third = ids(pipeline.near_stage(spark, docs, str(tmp_path)))
    assert len(third) == len(every) - 3 and third.count(7) == 1  # one of the three texts without a word, one of the repeated rows
    assert ids(pipeline.mix_stage(spark, docs, str(tmp_path))) == every
    packed = pipeline.pack_stage(spark, docs, str(tmp_path)).collect()
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in packed if r["start"] == 0) == every
    assert [r["doc_tokens"] for r in packed if r["doc_id"] == 50] == [1]
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
