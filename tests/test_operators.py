"""Properties of the engine's operators on small fixtures, against sequential restatements where SQL has no short form."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lexforge.functions import text as T
from lexforge.operators import bench, corpus, geometry, labels, metrics, orderstats, sampling, select, split
from lexforge.operators import ranks as ranks_of
from lexforge.sources import readers, sinks


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def lit(x):
    return F.lit(x)


@pytest.mark.parametrize(
    ("raw", "want"),
    [("", (None, "missing")), ("x", (None, "nonnumeric:'x'")), ("6", (None, "out_of_range:6")), ("-1", (None, "out_of_range:-1")), ("nan", (None, "out_of_range:nan")), (" 3.5 ", (3.5, None)), ("3d", (None, "nonnumeric:'3d'")), ("1_0", (None, "nonnumeric:'1_0'")), (None, (None, "missing"))],
)
def test_parse_score(spark, raw, want):
    assert (value(spark, T.parse_score(lit(raw).cast("string"))[0]), value(spark, T.parse_score(lit(raw).cast("string"))[1])) == want


def test_small_functions(spark):
    v = lambda c: value(spark, c)
    assert v(T.strip(lit("  a　"))) == "a" and v(T.collapse(lit(" a \n b "))) == "a b"
    assert v(T.domain_of(lit("https://www.Example.com/a/b"), lit("1"))) == "example.com" and v(T.domain_of(lit(""), lit("doc1"))) == "no-url:doc1"
    assert [v(T.parse_budget(lit(x))) for x in ("10M", "5K", "1B", "7")] == [10_000_000, 5000, 10**9, 7]
    assert [v(T.budget_label(lit(x))) for x in (20_000_000, 5000, 7)] == ["20M", "5K", "7"]
    assert v(T.seed_of_run(lit("run-seed12"))) == "12" and v(T.seed_of_run(lit("run"))) == "unknown" and v(T.dimension_name(lit("edu_mean"))) == "edu"
    assert v(T.common_prefix_len(F.array(lit(1), lit(2), lit(3)), F.array(lit(1), lit(2), lit(4), lit(5)))) == 2
    assert v(T.natural_key(lit("2-10"))) < v(T.natural_key(lit("10-2")))
    assert v(T.argmax_index(F.array(lit(1.0), lit(3.0), lit(3.0)))) == 1 and v(T.label_index(lit(" Neutral"), ["entailment", "neutral"])) == 1
    with pytest.raises(Exception, match="unknown label"):
        v(T.label_index(lit("?"), ["a"]))
    assert v(T.bits_per_byte(lit(math.log(2)), lit(100), lit(50))) == pytest.approx(2.0) and v(T.bits_per_byte(lit(1.0), lit(1), lit(0))) is None
    assert v(T.matched_words(lit("The BAD, bad worse"), ["worse", "bad"])) == "bad, worse" and v(T.normal_word(lit("# note"))) is None
    assert v(T.valid_repo_id(lit("a/b.c"))) and not v(T.valid_repo_id(lit("a b")))
    assert v(T.json_field(lit('{"a": 3}'), "a", "x")) == "3" and v(T.json_field(lit("oops"), "a", "x")) == "x"
    ids, mask = T.pad_batch(F.array(lit(5), lit(6)), lit(4))
    assert v(ids) == [5, 6, 0, 0] and v(mask) == [1, 1, 0, 0]
    values, status = T.parse_reply(lit('```json\n{"edu": 3, "clean": "x"}\n``` clean is: 4'), ["edu", "clean"])
    assert v(values) == {"edu": 3, "clean": 4} and v(status) == "ok"
    assert v(T.fill_prompt("Rate {text}!", text=lit("this"))) == "Rate this!"
    eligible = lambda t: v(T.eligible_article(lit(t)))
    assert not eligible("short") and not eligible("x" * 300 + "<div>") and not eligible("\n".join(["item"] * 60)) and eligible("Long prose. " * 40)
    rows = spark.createDataFrame([("é \x80",)], "t string")
    fix = T.fix_encoding_udf({"\x80": "€"}, {}, [], lambda t: 0.0)
    assert rows.select(fix("t").alias("t")).first()["t"] == "é €" and rows.select(T.nfc_udf()("t").alias("t")).first()["t"] == "é \x80"
    assert T.convert_legacy("abc", {"a": "x"}, {"bc": "y", "b": "z"}, [("xy", "yx")]) == "yx"


def test_words_are_found_by_a_pattern_as_among_all_words(spark, monkeypatch):
    """A few words make no array of a text's words; a longer list gives the same."""
    texts = ["the and THE", "then", "other", "", None, "le the-end", "x_the_y", "\u00fcthe", "the1", "a ab abc", "ab\nThe,the", "\u212aa ka"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    words = ["the", "a", "ab", "ka"]
    told = lambda: df.select(F.coalesce(T.has_any_word(F.col("t"), words), F.lit(False)).alias("any"), T.matched_words(F.col("t"), words).alias("w"))
    few = told()
    assert "split(" not in few._jdf.queryExecution().optimizedPlan().toString()
    got = [tuple(r) for r in few.collect()]
    assert [w for _, w in got] == ["the", "", "", "", None, "the", "the", "the", "", "a, ab", "ab, the", "ka"]
    monkeypatch.setattr(T, "FEW_WORDS", 0)
    assert [tuple(r) for r in told().collect()] == got and all(a == bool(w) for a, w in got)


def sequential(rows):
    ids, texts, out = set(), set(), {}
    for o, i, t in sorted(rows):
        out[o] = "duplicate_id" if i in ids else "duplicate_text" if t in texts else None
        if out[o] is None:
            ids.add(i)
            texts.add(t)
    return out


def test_sequential_dedup(spark):
    spark.sparkContext.setCheckpointDir("/tmp/lexforge-test-checkpoints")
    rng = random.Random(0)
    cases = [[(0, "1", "a"), (1, "1", "b"), (2, "2", "b")], [(0, "1", "a"), (1, "2", "a"), (2, "2", "c")]]
    cases += [[(k, str(rng.randint(0, 9)), "h" + str(rng.randint(0, 9))) for k in range(25)] for _ in range(2)]
    for rows in cases:
        got = corpus.sequential_dedup(spark.createDataFrame(rows, "ordinal long, doc_id string, text_hash string"))
        assert {r["ordinal"]: r["reason"] for r in got.collect()} == sequential(rows)


def test_corpus_filter_reasons(spark):
    long = lambda x: x * 30
    rows = [("a", "short"), ("b", "x" * 5000), ("c", long("text c ")), ("d", long("known text ")), ("e", long("good one ")), ("f", long("very bad ")), ("e", long("other ")), ("g", "  " + long("good one ") + " "), ("h", long("good two ")), ("i", long("good three ")), ("j", long("never read "))]
    stream = spark.createDataFrame([(k, i, t) for k, (i, t) in enumerate(rows)], "ordinal long, doc_id string, text string")
    known = stream.filter("doc_id = 'd'").select(T.text_hash(F.col("text")).alias("text_hash"))
    run = lambda target: corpus.collect_documents(stream, target=target, exclude_ids=spark.createDataFrame([("c",)], "doc_id string"), exclude_hashes=known, banned=["bad"], low=100)
    kept, counters = run(3)
    assert [r["doc_id"] for r in kept.orderBy("ordinal").collect()] == ["e", "h", "i"]
    got = {r["reason"]: r["n"] for r in counters.collect()}
    assert got == {"length": 2, "overlap_id": 1, "overlap_text": 1, "adult": 1, "duplicate_id": 1, "duplicate_text": 1, "kept": 3}
    assert not counters.first()["stream_exhausted"] and run(9)[1].first()["stream_exhausted"]
    report = corpus.overlap_report(kept, spark.createDataFrame([("c",)], "doc_id string"), known, low=100).first()
    assert all(x == 0 for x in report)


def test_unions_and_lookup(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "doc_id string, ordinal int")
    b = spark.createDataFrame([("y", 0), ("z", 1)], "doc_id string, ordinal int")
    assert sorted((r["doc_id"], r["ordinal"]) for r in corpus.union_keep_first([a, b], "doc_id", "ordinal").collect()) == [("x", 1), ("y", 2), ("z", 1)]
    assert corpus.quota_top_up(a, b, 3, "ordinal").count() == 3 and corpus.truncate(a, 1).count() == 1
    with pytest.raises(ValueError, match="no row"):
        corpus.require_complete(a, b)


def pool(spark, n, tokens=10):
    return spark.createDataFrame([("en", f"d{k:03}", k + 1, tokens) for k in range(n)], "language string, doc_id string, rn int, tokens int")


@pytest.mark.parametrize(("n", "target", "group", "docs"), [(20, 120, 5, 15), (7, 65, 5, 7), (10, 31, 1, 4)])
def test_token_budget(spark, n, target, group, docs):
    out = select.token_budget(pool(spark, n), target, group)
    assert out.count() == docs and out.agg(F.sum("tokens")).first()[0] == 10 * docs


def test_short_pools_and_missing_scores_are_errors(spark):
    with pytest.raises(ValueError, match="fewer than 1000"):
        select.token_budget(pool(spark, 4), 1000, 1)
    with pytest.raises(ValueError, match="no score"):
        select.require_scored(pool(spark, 2), spark.createDataFrame([("en", "d000", 1.0)], "language string, doc_id string, score_raw double"), ["language", "doc_id"])
    with pytest.raises(ValueError, match="fewer than 9"):
        select.top_k(pool(spark, 4), 9, strict=True)
    with pytest.raises(ValueError, match="not in all"):
        select.require_same_keys(spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "doc_id string, dimension string"), ["doc_id"], "dimension")


def test_equal_means_tie_in_any_order_of_rows(spark):
    """Sums of these doubles differ in the last bit by document and by order."""
    scores = {48146: [3.6870000000000003, 4.491, 3.115, 5.0, 4.749], 34986: [4.147, 4.851, 4.175, 2.869, 5.0]}
    for turn in (1, -1):
        long = spark.createDataFrame([("es", k, f"d{i}", x) for k, xs in scores.items() for i, x in list(enumerate(xs))[::turn]], "language string, doc_id long, dimension string, score_raw double").coalesce(1)
        placed = select.rank_by_score(select.combine_scores(long, ["language", "doc_id"]), whole=True)
        assert {r["doc_id"]: (r["score_raw"], r["rn"]) for r in placed.collect()} == {34986: (4.2084, 1), 48146: (4.2084, 2)}


def test_ranking_is_independent_of_input_order(spark):
    scores = [("en", f"d{k}", s) for k, s in enumerate([2.0, 5.3, 4.9, 5.3, 1.0, 5.3])]
    df = spark.createDataFrame(scores, "language string, doc_id string, score_raw double")
    back = spark.createDataFrame(scores[::-1], "language string, doc_id string, score_raw double")
    ids = lambda x: [r["doc_id"] for r in select.top_k(x, 4).orderBy("rn").collect()]
    assert ids(select.rank_by_score(df)) == ["d1", "d3", "d5", "d2"] == ids(select.rank_by_score(back))
    assert ids(select.rank_randomly(df, 1)) == ids(select.rank_randomly(back, 1)) != ids(select.rank_randomly(df, 3))
    assert {r["doc_id"]: r["high"] for r in select.high_quality(df, 0.5).collect()} == {"d0": False, "d1": True, "d2": False, "d3": True, "d4": False, "d5": True}


def robin(tokens, ranks, dims, k, target):
    place, got, total, rounds = {d: 0 for d in dims}, {}, 0, 0
    while total < target and any(place[d] < len(ranks[d]) for d in dims):
        rounds += 1
        for d in dims:
            for doc in ranks[d][place[d] : place[d] + k]:
                if doc not in got:
                    got[doc] = [rounds, [d]]
                    total += tokens[doc]
                else:
                    got[doc][1].append(d)
            place[d] += k
    return {doc: (r, "+".join(ds)) for doc, (r, ds) in got.items()} if total >= target else {}


def test_round_robin(spark):
    rng = random.Random(2)
    for _ in range(3):
        docs, dims = [f"d{k:02}" for k in range(20)], ["a", "b", "c"]
        tokens = {x: rng.randint(1, 9) for x in docs}
        score = {(d, x): rng.randint(0, 5) + 0.5 for d in dims for x in docs}
        ranks = {d: sorted(docs, key=lambda x: (-score[d, x], x)) for d in dims}
        rows = spark.createDataFrame([("en", x, t) for x, t in tokens.items()], "language string, doc_id string, tokens int")
        long = spark.createDataFrame([("en", x, d, s) for (d, x), s in score.items()], "language string, doc_id string, dimension string, score_raw double")
        got = {r["doc_id"]: (r["round"], r["selected_by"]) for r in select.round_robin(rows, long, dims, 2, 40).collect()}
        assert got == robin(tokens, ranks, dims, 2, 40)


def test_round_robin_of_a_pool_that_runs_out(spark):
    rows = spark.createDataFrame([(x, f"d{k}", 10) for x, n in (("en", 9), ("xx", 3)) for k in range(n)], "language string, doc_id string, tokens int")
    long = rows.select("language", "doc_id", F.lit("a").alias("dimension"), F.col("tokens").cast("double").alias("score_raw"))
    with pytest.raises(ValueError, match="1 pools are exhausted"):
        select.round_robin(rows, long, ["a"], 2, 40)
    got = select.round_robin(rows, long, ["a"], 2, 40, strict=False).groupBy("language").count().collect()
    assert {r["language"]: r["count"] for r in got} == {"en": 4, "xx": 3}


@pytest.mark.parametrize("largest", [0, 10**6])
def test_places_in_groups_of_any_size(spark, monkeypatch, largest):
    monkeypatch.setattr(ranks_of, "GROUP_ROWS", largest)  # 0: every group is a large one
    rng = random.Random(5)
    rows = spark.createDataFrame([(rng.choice(["a", "b", None]), k, rng.choice([None, 1.5, 2.0, 2.0004, 2.0005, -0.25, 7.0])) for k in range(200)], "language string, doc_id int, score_raw double")
    got = {r["doc_id"]: (r["rn"], r["n"]) for r in ranks_of.numbered(rows, ["language"], [F.col("score_raw").desc(), "doc_id"], total="n").collect()}
    held = [tuple(r) for r in rows.collect()]
    for x in ("a", "b", None):
        mine = sorted((r for r in held if r[0] == x), key=lambda r: (r[2] is None, -(r[2] or 0), r[1]))
        assert [got[i] for _, i, _ in mine] == [(k + 1, len(mine)) for k in range(len(mine))]
    ranked = {r["doc_id"]: r["r"] for r in ranks_of.with_mean_rank(rows.dropna(), "score_raw", ["language"], "r").collect()}
    for x in ("a", "b"):
        mine = sorted(r[2] for r in held if r[0] == x and r[2] is not None)
        assert all(ranked[i] == mine.index(v) + (mine.count(v) + 1) / 2 for g, i, v in held if g == x and v is not None)
    with_null = ranks_of.with_mean_rank(spark.createDataFrame([(None, x) for x in (1, 2, 2, 3)], "g string, v int"), "v", ["g"], "r")
    assert sorted(r["r"] for r in with_null.collect()) == [1, 2.5, 2.5, 4]
    rows = rows.dropna(subset=["language"])
    assert select.rank_randomly(rows, 3, whole=True).orderBy("doc_id").collect() == select.rank_randomly(rows, 3).select("language", "doc_id", "score_raw", "rn").orderBy("doc_id").collect()
    assert ranks_of.numbered(rows.limit(0), ["language"], ["doc_id"]).collect() == []


@pytest.mark.parametrize("kind", ["uniform", "whole numbers"])
def test_no_task_takes_a_group(spark, monkeypatch, kind):
    """One language, 60,000 scores: no partition of the sample sort, and of the mean ranks' counts, has over twice the mean."""
    monkeypatch.setattr(ranks_of, "GROUP_ROWS", 0)
    held, whole = [], ranks_of.written
    monkeypatch.setattr(ranks_of, "written", lambda rows: held.append(whole(rows)) or held[-1])
    score = F.rand(3) * 5 if kind == "uniform" else F.floor(F.rand(3) * 6).cast("double")
    rows = spark.range(60_000).select(F.lit("en").alias("language"), F.col("id").alias("doc_id"), score.alias("score_raw"))
    places = ranks_of.numbered(rows, ["language"], [F.col("score_raw").desc(), "doc_id"]).agg(F.count_distinct("rn"), F.min("rn"), F.max("rn")).first()
    assert tuple(places) == (60_000, 1, 60_000)
    sizes = [r["count"] for r in held[0].groupBy("_p" if "_p" in held[0].columns else F.shiftright("_at", 33)).count().collect()]
    assert len(sizes) > 1 and max(sizes) < 2 * 60_000 / len(sizes)
    ranked = ranks_of.with_mean_rank(rows, "score_raw", ["language"], "r").agg(F.avg("r")).first()[0]
    assert ranked == pytest.approx(30_000.5)
    if kind == "uniform":
        sizes = [r["count"] for r in held[2].groupBy("_p").count().collect()]
        assert len(sizes) > 1 and max(sizes) < 2 * 60_000 / len(sizes)


def test_order_statistics(spark):
    rng = random.Random(12)
    inf = float("inf")
    values = {"a": [rng.uniform(-3, 9) for _ in range(700)], "b": [float(rng.randint(0, 4)) for _ in range(400)], None: [2.5] * 90, "c": [10.0 ** rng.randint(-300, 300) for _ in range(60)] + [inf, -inf, 0.0], "d": [1.0], "e": []}
    rows = [(g, v) for g, vs in values.items() for v in vs] + [(g, v) for g in "abe" for v in (None, float("nan"))]
    frame = spark.createDataFrame(rows, "g string, v double")
    n = F.col("_n")
    wanted = {"low": F.lit(1), "mid": F.floor((n + 1) / 2), "high": n, "third": F.lit(3), "beyond": n + 1, "zero": F.lit(0)}
    for bins, few in ((8, 5), (1024, 10_000), (3, 0)):
        got = {r["g"]: r for r in orderstats.order_statistics(frame, ["g"], "v", wanted, bins, few).collect()}
        assert set(got) == set(values)
        for g, vs in values.items():
            held, row = sorted(vs), got[g]
            at = lambda k, held=held: held[k - 1] if 1 <= k <= len(held) else None
            assert (row["_n"], row["low"], row["mid"], row["high"], row["third"], row["beyond"], row["zero"]) == (len(held), at(1), at((len(held) + 1) // 2), at(len(held)), at(3), None, None)


def test_high_quality_takes_ties_by_id(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), k, rng.choice([None, 1.0, 2.0, 3.0, 3.5])) for k in range(150)]
    for fraction in (0.0, 0.3, 0.5, 1.0):
        got = {r["doc_id"] for r in select.high_quality(spark.createDataFrame(rows, "language string, doc_id int, score_raw double"), fraction).filter("high").collect()}
        want = set()
        for g in "ab":
            mine = sorted((r for r in rows if r[0] == g and r[2] is not None), key=lambda r: (-r[2], r[1]))
            want |= {r[1] for r in mine[: round(len(mine) * fraction)]}
        assert got == want


def test_validation_split_takes_one_of_two(spark):
    df = spark.createDataFrame([(k, 1.0) for k in range(2)] + [(k, 3.0) for k in range(2, 42)], "doc_id int, score double")
    got = split.validation_split(df, 0.1, 42).filter("split = 'validation'").groupBy("score").count().collect()
    assert {r["score"]: r["count"] for r in got} == {1.0: 1, 3.0: 4}


def test_metrics(spark):
    pairs = spark.createDataFrame([("en", x + 0.5, float(x)) for x in range(5)], "language string, human double, llm double")
    row = metrics.agreement(pairs).filter("language = 'all'").first()
    assert (row["n"], row["mae"]) == (5, 0.5) and row["pearson"] == pytest.approx(1) and row["spearman"] == pytest.approx(1)
    assert metrics.spearman(pairs.withColumn("llm", F.lit(1.0)), "human", "llm", ["language"]).first()["spearman"] is None
    out = metrics.losses(spark.createDataFrame([("a", 10.0, 2), ("a", 10.0, 98), ("b", 0.0, 0)], "language string, nll double, targets int")).collect()
    assert {r["language"]: r["loss"] for r in out} == {"a": pytest.approx(0.2), "macro": pytest.approx(0.2), "token_weighted": pytest.approx(0.2)}
    log = spark.createDataFrame([(k, x) for k, x in enumerate([5.0, 4.0, 3.999, 3.99, 4.2])], "epoch int, loss double")
    got = metrics.early_stop(log, 2, 0.1).orderBy("epoch").collect()
    assert [r["best"] for r in got] == [True, True, False, False, False] and [r["stopped"] for r in got] == [False, False, False, True, True]


def test_labels(spark):
    table = spark.createDataFrame([("en", "p", "one text"), ("en", "p", "two text"), ("en", "q", "three")], "language string, doc_id string, text string")
    table = table.withColumn("content", T.content_hash(F.col("text")))
    records = spark.createDataFrame([("f1", 1, "p", "two  text"), ("f1", 2, "q", "other"), ("f2", 1, "q", "three"), ("f2", 2, "?", "one text"), ("f2", 3, "p", "neither")], "file string, line int, id string, text string")
    got = {(r["file"], r["line"]): (r["doc_id"], r["text_matches"]) for r in labels.match_records(table, records).collect()}
    assert got == {("f1", 1): ("p", True), ("f1", 2): ("q", False), ("f2", 2): ("p", True)}
    assert labels.unambiguous(table, ["doc_id"]).count() == 1
    runs = spark.createDataFrame([("r1", "a"), ("r2", "a"), ("r1", "b")], "run string, bench string")
    assert [r["bench"] for r in labels.in_every(runs, "bench", "run").collect()] == ["a"]
    assert {r["bench"]: r["common"] for r in bench.common_to_all(runs, "run", "bench").collect()} == {"a": True, "b": False}
    with pytest.raises(ValueError, match="length"):
        labels.positional_join(spark.createDataFrame([(0, "a")], "n int, x string"), spark.createDataFrame([(0, "b"), (1, "c")], "n int, y string"), "n")


def test_shots_and_subsets(spark):
    items = spark.createDataFrame([(k, f"g{k % 4}", "ab"[k % 2]) for k in range(20)], "item_id int, group string, label string")
    examples = items.select(F.col("item_id").alias("example_id"), "group")
    got = sampling.shots(examples, items, 5, 1, ["a", "b"]).collect()
    group = {k: f"g{k % 4}" for k in range(20)}
    for e in range(20):
        mine = sorted((r["place"], r["shot_id"], r["label"]) for r in got if r["example_id"] == e)
        assert [p for p, _, _ in mine] == [1, 2, 3, 4, 5] and len({s for _, s, _ in mine}) == 5 and all(group[s] != group[e] for _, s, _ in mine)
        assert [{x for _, _, x in mine[1:3]}, {x for _, _, x in mine[3:]}] == [{"a", "b"}] * 2
    plan = sampling.shots(examples, items, 5, 1, ["a", "b"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan  # an example's shots are picked within its row
    short = sampling.shots(examples.filter("example_id = 1"), items.filter("label = 'b' or item_id in (0, 1)"), 5, 1, ["a", "b"]).collect()
    assert [r["place"] for r in short] == list(range(1, len(short) + 1)) and [r["shot_id"] for r in short if r["label"] == "a"] == [0] and len(short) in (3, 4)
    sub = sampling.fixed_subset(items, 3, 1, "b", "label", "item_id", cover="group").collect()
    assert len(sub) == 6 and all(len({r["group"] for r in sub if r["label"] == x}) == 2 for x in "ab")
    with pytest.raises(ValueError, match="no more than"):
        sampling.holdout(items, 10, 1, "label", "item_id")


def test_walks(spark):
    gaps = iter([{"x": 5}, {"x": 3}, {"x": 3}, {"x": 3}, {"x": 3}])
    end = sampling.scoring_rounds([1, 2, 3, 4], lambda: next(gaps), lambda b, most: min(most, 10), 100)
    assert end["attempted"] == 30 and end["dead"] == ["x"]
    steps = sampling.balanced_steps({"a": 1, "b": 1, "c": 1}, 4, 3)
    assert all(sum(s.values()) == 4 for s in steps) and {x: sum(s[x] for s in steps) for x in "abc"} == {"a": 4, "b": 4, "c": 4}
    assert sampling.least_loaded({"a": 3, "b": 5, "c": 2, "d": 0}, 2) == [["b", "d"], ["a", "c"]]


@pytest.mark.parametrize("target", [10, 25, 80])
def test_greedy_diversity_row_by_row(spark, target):
    """The rule of one row after the other: gaps of its values to the floor, a tenth and a twentieth of what its buckets lack."""
    import hashlib

    rng = random.Random(target)
    rows = [(k, "ab"[k % 2], rng.randint(0, 3), rng.randint(0, 2), rng.choice(["s", "l"])) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id int, source string, edu int, clean int, len_bucket string")
    shares, quotas = {"s": 0.7, "l": 0.3}, {"a": target // 3, "b": target}
    got = [r["doc_id"] for r in sampling.greedy_diversity(df, ["edu", "clean"], target, quotas, 1, floor=6, length_share=shares).orderBy("place").collect()]
    waiting = sorted(rows, key=lambda r: hashlib.sha256(f"1:greedy:{r[0]}".encode()).hexdigest())
    taken = []
    while waiting and len(taken) < target:
        def price(r):
            if sum(t[1] == r[1] for t in taken) >= quotas[r[1]]:
                return -1
            value = sum(max(0, 6 - sum(t[i] == r[i] for t in taken)) for i in (2, 3))
            return value + 0.1 * max(0, max(1, int(len(taken) * shares[r[4]])) - sum(t[4] == r[4] for t in taken))

        best = max(waiting, key=price)  # the first of equals
        if price(best) < 0 and len(rows) > target:
            break
        waiting.remove(best)
        taken.append(best)
    want = [r[0] for r in taken] if len(rows) > target else [r[0] for r in sorted(rows, key=lambda r: hashlib.sha256(f"1:greedy:{r[0]}".encode()).hexdigest())]
    assert got == want


def test_deals_of_like_rows_are_those_of_one_after_the_other():
    rng = random.Random(1)
    for _ in range(200):
        desire = {s: rng.choice([0.0, 1.5, -2.0, 7.25, 30.1]) + rng.choice([0, 0.5]) for s in "xyz"}
        room = {s: rng.randint(0, 20) for s in "xyz"}
        n = rng.randint(0, sum(room.values()))
        d, r, want = dict(desire), dict(room), {s: 0 for s in "xyz"}
        for _ in range(n):
            s = max((s for s in d if r[s]), key=lambda s: (d[s], r[s]))
            d[s], r[s], want[s] = d[s] - 1, r[s] - 1, want[s] + 1
        got = {s: 0 for s in "xyz"}
        for s, c in sampling.dealt(n, desire, room):
            got[s] += c
        assert got == want


def test_iterative_stratification(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice("aaab"), rng.randint(0, 4)) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id int, edu string, clean int")
    out = sampling.iterative_stratification(df, ["edu", "clean"], {"train": 280, "validation": 40, "test": 80}, 1).join(df, "doc_id").collect()
    assert len(out) == 400
    for s, size in (("train", 280), ("validation", 40), ("test", 80)):
        mine = [r for r in out if r["split"] == s]
        assert len(mine) == size
        for column, i in (("edu", 1), ("clean", 2)):
            for v in {r[i] for r in rows}:  # every label comes near its share
                assert abs(sum(r[column] == v for r in mine) - sum(r[i] == v for r in rows) * size / 400) <= 4
    with pytest.raises(ValueError, match="sizes sum"):
        sampling.iterative_stratification(df, ["edu"], {"train": 3}, 1)


def test_legacy_text_is_converted_by_its_exclusive_markers_only():
    fix = lambda t, p: T.fix_text(t, {"\x80": "€"}, {"a": "x"}, [("xb", "bx")], lambda _: p)
    assert fix("bab", 1.0) == "bab"  # ambiguous characters alone mark nothing
    assert fix("e\u0301", 0.0) == "\u00e9"  # composed, marker or not
    assert fix("ab\x80", 0.4) == "ab€" and fix("ab\x80", 0.9) == "bx€"


def test_geometry(spark):
    rows = spark.createDataFrame([(k, "en", n) for k, n in enumerate([10, 7, 11])], "doc_id int, language string, tokens int")
    packed = geometry.pack_streams(rows, 8, 1).collect()
    spans = sorted((r["begin"], r["begin"] + r["tokens"]) for r in packed)
    assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False)) and spans[-1][1] == 28
    stats = geometry.block_stats(rows, 8).filter("language = 'en'").first()
    assert (stats["blocks"], stats["padding"], stats["targets"]) == (4, 4, 24)
    for total, size, stride in ((10, 16, 8), (50, 16, 8), (50, 16, 5), (1, 16, 8)):
        wins = geometry.sliding_windows(spark.createDataFrame([(total,)], "tokens int"), size, stride).collect()
        seen = sorted(t for r in wins for t in range(r["target_begin"], r["target_end"]))
        assert seen == list(range(1, total))
    assert [r["step"] for r in geometry.evaluation_steps(spark, 1, 10, 4).orderBy("k").collect()] == [2, 5, 8, 10]
    prompt = spark.createDataFrame([(1, p, 10, 5) for p in range(5)], "example_id int, place int, tokens int, own int")
    assert sorted(r["place"] for r in geometry.fit_prompt(prompt, 36).collect()) == [2, 3, 4]
    ids = rows.join(spark.createDataFrame([(r["doc_id"], r["begin"]) for r in packed], "doc_id int, begin long"), "doc_id").withColumn("ids", F.sequence(F.lit(1), F.col("tokens")))
    assert sorted(len(r["ids"]) for r in geometry.explode_blocks(ids, 8, "ids").collect()) == [4, 8, 8, 8]


def test_benchmarks(spark):
    tasks = spark.createDataFrame([("nli_hard_khm",), ("nli",), ("nlix",)], "task string")
    conf = spark.createDataFrame([("nli_hard", 0), ("nli", 1)], "name string, place int")
    assert {r["task"]: r["configured"] for r in bench.configured_task(tasks, conf).collect()} == {"nli_hard_khm": "nli_hard", "nli": "nli", "nlix": None}
    groups = spark.createDataFrame([("all", "x"), ("all", "y"), ("y", "y1"), ("y", "y2")], "parent string, child string")
    assert sorted(r["task"] for r in bench.leaf_tasks(spark, groups, "all").collect()) == ["x", "y1", "y2"]
    names = bench.unique_names(spark.createDataFrame([("p", "a"), ("q", "a"), ("p", "b")], "parent string, name string"))
    assert sorted(r["unique_name"] for r in names.collect()) == ["b", "p/a", "q/a"]
    flat = bench.flat_metrics(spark.createDataFrame([('{"t": {"acc,none": 0.5}}',)], "results string")).first()
    assert tuple(flat) == ("t", "acc,none", 0.5)
    half = bench.pooled(spark.createDataFrame([("en", 0.5, 10), ("en", 1.0, 30)], "language string, score double, n int"), ["language"]).first()
    assert half["score"] == pytest.approx(0.875)


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "khm.csv").write_bytes("﻿doc_id,text\n1,\"two\nlines\"\n".encode())
    got = readers.language_files(spark, str(tmp_path / "*.csv"), ".csv", "doc_id string, text string").collect()
    assert [tuple(r) for r in got] == [("1", "two\nlines", "khm")]
    (tmp_path / "old.txt").write_bytes("doc_id,text\n1,caf\xe9\n".encode("cp1252"))
    assert readers.csv_with_fallback(spark, str(tmp_path / "old.txt"), "doc_id string, text string").first()["text"] == "café"
    (tmp_path / "kh_1.jsonl").write_text('{"id": "a", "text": "t"}\n\n')
    (tmp_path / "kh_checkpoint.jsonl").write_text('{"id": "b"}\n')
    docs, skipped = readers.llm_documents(spark, str(tmp_path / "*.jsonl"), {"kh": "khm"})
    assert [(r["language"], r["id"]) for r in docs.collect()] == [("khm", "a")] and [r["file"] for r in skipped.collect()] == ["kh_checkpoint"]
    lines = spark.createDataFrame([("c1", 1, "b"), ("c1", 0, "a"), ("c1", 2, "<range>")], "g string, n int, line string")
    assert readers.grouped_lines(lines, "g", "n").first()["text"] == "a\nb"
    table = spark.range(10).withColumn("block", F.col("id") % 2)
    path = str(tmp_path / "out")
    sinks.write_once(table, path, 10)
    assert sinks.is_complete(spark, path, 10) and not sinks.is_complete(spark, path, 11) and not sinks.is_complete(spark, path + "x", 0)
    assert sinks.manifest(spark, str(tmp_path), "*.csv").first()["bytes"] == (tmp_path / "khm.csv").stat().st_size
    rows = spark.createDataFrame([("1", "en", 5.25)], "doc_id string, language string, score_raw double")
    assert tuple(sinks.formatted_scores(rows).first()) == ("1", "en", "5.250000", "5.000000")
    assert sinks.to_markdown(rows).startswith("| doc_id |")


def test_models(spark):
    import numpy as np

    from lexforge.operators import models, tables

    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 6))
    y = x[:, 0] * 2 - x[:, 1]
    head = models.train_head(x[:300], y[:300], y[:300] * 0, (x[300:], y[300:], y[300:] * 0), hidden=16, rate=1e-2, dropout=0.0, epochs=40)
    assert head.loss < 0.4 and head.epochs <= 40
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x[:5])], "id int, v array<double>")
    assert [r["raw"] for r in models.predict(rows, head, "v").orderBy("id").collect()] == pytest.approx(head(x[:5]).tolist())
    texts = spark.createDataFrame([(1, "a b"), (2, None), (3, "a")], "id int, text string")
    got = models.score_with(texts, lambda: lambda batch: [float(len(t)) for t in batch]).collect()
    assert {r["id"]: r["score_raw"] for r in got} == {1: 3.0, 2: 0.0, 3: 1.0}
    public = pytest.importorskip("public_tokenizers")
    assert {r["id"]: r["tokens"] for r in models.count_tokens(texts, str(public.path("byte_bpe_50k.json"))).collect()} == {1: 3, 2: 1, 3: 2}
    asked = spark.createDataFrame([(0, "s"), (1, "b2"), (2, "b3")], "place int, name string")
    suites = spark.createDataFrame([("s", 0, "b1"), ("s", 1, "b2")], "suite string, position int, benchmark string")
    assert [r["benchmark"] for r in tables.expand_suites(asked, suites).orderBy("place", "position").collect()] == ["b1", "b2", "b3"]
    with pytest.raises(ValueError, match="no partner"):
        tables.aligned_pairs(texts, texts.filter("id = 1"), ["id"])
    cut = tables.truncated(texts.select(F.sequence(F.lit(1), F.col("id")).alias("ids")), "ids", 2).collect()
    assert sorted((len(r["ids"]), r["at_limit"]) for r in cut) == [(1, False), (2, True), (2, True)]


def test_scores_of_generated_text(spark):
    from collections import Counter

    from lexforge.operators import generation

    pairs = [("en", "the cat sat on the mat", "the cat is on the mat"), ("en", "a b c d e", "a b c d f"), ("xx", "", "nothing here"), ("xx", "one two", "one two")]
    df = spark.createDataFrame(pairs, "language string, hypothesis string, reference string")

    def overlap(items, n):
        made = wanted = both = 0
        for h, r in items:
            x, y = (Counter(tuple(s[i : i + n]) for i in range(len(s) - n + 1)) for s in (h, r))
            made, wanted, both = made + sum(x.values()), wanted + sum(y.values()), both + sum((x & y).values())
        return made, wanted, both

    got = {r["language"]: r["chrf"] for r in generation.chrf(df, ["language"]).collect()}
    tokens = df.select("language", F.split("hypothesis", " ").alias("hypothesis"), F.split("reference", " ").alias("reference"))
    blue = {r["language"]: r["bleu"] for r in generation.bleu(tokens, ["language"], 2).collect()}
    for x in ("en", "xx"):
        mine = [(h, r) for y, h, r in pairs if y == x]
        scores = []
        for cut, orders in ((lambda t: list(t.replace(" ", "")), 6), (str.split, 2)):
            for n in range(1, orders + 1):
                m, w, c = overlap([(cut(h), cut(r)) for h, r in mine], n)
                if m or w:
                    p, q = c / m if m else 0, c / w if w else 0
                    scores.append(5 * p * q / (4 * p + q) if p + q else 0)
        assert got[x] == pytest.approx(100 * sum(scores) / len(scores))
        two = [overlap([(h.split(" "), r.split(" ")) for h, r in mine], n) for n in (1, 2)]
        want = math.exp(sum(math.log(c / m) for m, _, c in two) / 2) * min(1.0, math.exp(1 - two[0][1] / two[0][0]))
        assert blue[x] == pytest.approx(100 * want)


def test_ngrams_are_counted_where_their_pair_is(spark):
    """Clipped pair by pair, characters or tokens, null and empty sides; no n-gram is a row or is exchanged."""
    from lexforge.operators import generation

    rows = [("x", "aaab", "aab"), ("x", "ab", None), ("x", "", "abc"), ("x", "b", "aaaa"), (None, "ab", "ab"), ("none", None, "")]
    df = spark.createDataFrame(rows, "k string, h string, r string")
    each = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    kinds = [("s", n, F.col("h"), F.col("r")) for n in (1, 2)] + [("t", n, each("h"), each("r")) for n in (1, 2)]
    found = generation.matches(df, ["k"], kinds)
    got = {(r["k"], r["kind"], r["n"]): (r["made"], r["wanted"], r["matched"]) for r in found.collect()}
    assert got == {(k, s, n): x for s in "st" for k, n, x in (("x", 1, (7, 10, 3)), ("x", 2, (4, 7, 2)), (None, 1, (2, 2, 2)), (None, 2, (1, 1, 1)))}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "gram" not in plan and plan.count("Aggregate") == 1


def test_asking_again_and_only_once(spark, tmp_path):
    from lexforge.operators import models

    calls, pauses = [], []

    def ask(prompt):
        calls.append(prompt)
        if len(calls) < 3:
            raise OSError("busy")
        return "fine"

    assert models.with_retries(ask, 4, 0.5, pauses.append)("p") == ("fine", None) and pauses == [0.5, 1.0]
    assert models.with_retries(lambda p: 1 / 0, 2, 0.5, pauses.append)("p") == (None, "ZeroDivisionError: division by zero")
    items = spark.createDataFrame([("a", "good"), ("b", "bad"), ("c", "down")], "id string, prompt string")

    def load():
        def answer(prompt):
            if prompt == "down":
                raise OSError("gone")
            return '{"edu": 3}' if prompt == "good" else "no idea"

        return answer

    path = str(tmp_path / "results")
    first = {r["id"]: (r["parse_status"], r["edu"], r["error"]) for r in models.score_batch(items, load, ["edu"], path, 2, 0.0).collect()}
    assert first == {"a": ("ok", 3, None), "b": ("failed", None, None), "c": ("failed", None, "OSError: gone")}
    more = items.unionByName(spark.createDataFrame([("d", "good")], "id string, prompt string"))
    assert sorted(r["id"] for r in models.score_batch(more, load, ["edu"], path, 2, 0.0).collect()) == ["a", "b", "c", "d"]  # none twice


def test_release_files_and_scored_texts(spark, tmp_path):
    from lexforge.sources import readers

    for name in ("a.csv", "sub/b.json", "sub/c.bin", ".hidden/d.csv", "__pycache__/e.json", "_x.csv"):
        (tmp_path / "from" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "from" / name).write_text(name)
    assert sinks.copy_artifacts(spark, str(tmp_path / "from"), str(tmp_path / "to"), [".csv", ".json"]) == ["a.csv", "sub/b.json"]
    assert (tmp_path / "to/sub/b.json").read_text() == "sub/b.json" and not (tmp_path / "to/sub/c.bin").exists()
    rows = spark.createDataFrame([("x" * 600, 1.5), ("y" * 600, None), ("short", 2.0)], "text string, score double")
    rows.write.parquet(str(tmp_path / "scored"))
    got = readers.scored_stream(spark, str(tmp_path / "scored"), "score").collect()
    assert len(got) == 2 and sum(math.isnan(r["score"]) for r in got) == 1
    rows.filter("score is null").write.parquet(str(tmp_path / "none"))
    with pytest.raises(ValueError, match="0 with a score"):
        readers.scored_stream(spark, str(tmp_path / "none"), "score")


def test_matching_of_chains_takes_few_rounds(spark, monkeypatch):
    """Each row waits for the one before it: 100,000 links, in under 40 joins; then chains among rows with several rows against them."""
    from lexforge.operators import matching

    n, calls, whole = 100_000, [], matching.written
    monkeypatch.setattr(matching, "written", lambda rows: calls.append(1) or whole(rows))
    chain = spark.range(n).select(F.col("id").alias("ordinal"), F.concat(F.lit("i"), F.floor(F.col("id") / 2).cast("string")).alias("a"), F.concat(F.lit("t"), F.floor((F.col("id") + 1) / 2).cast("string")).alias("b"))
    got = matching.first_matching(chain, "a", "b").agg(F.count("*"), F.count_if(F.col("ordinal") % 2 == 1)).first()
    assert tuple(got) == (n // 2, 0) and len(calls) < 40
    monkeypatch.undo()
    rng = random.Random(6)
    for span in (3, 12, 200):  # rows near each other share keys, so that many wait for several
        rows = [(k, f"i{(k + rng.randint(0, span)) // 3}", f"t{(k + rng.randint(0, span)) // 2}") for k in range(400)]
        got = {r.ordinal for r in matching.first_matching(spark.createDataFrame(rows, "ordinal long, a string, b string"), "a", "b").collect()}
        assert got == {o for o, reason in sequential(rows).items() if reason is None}
