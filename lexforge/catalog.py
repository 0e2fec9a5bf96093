"""Named queries of the engine over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import bench, corpus, embedding, geometry, labels, metrics, models, sampling, select, split, tables
from .plans.views import NAMES, SQL_CORPUS, SQL_SCORE, WITH, annotations, score_of, scores, table
from .plans.views import corpus as corpus_view
from .plans.written import new_folder, written
from .streaming import records

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

SEED, WORDS = 42, ["the", "und", "les", "para", "idiot"]
TARGET, GROUP = 20_000, 5
PARSED = "CASE doc_id % 9 WHEN 0 THEN '' WHEN 1 THEN 'x' WHEN 2 THEN '6' WHEN 3 THEN '-1' WHEN 4 THEN 'nan' WHEN 5 THEN ' 3.5 ' WHEN 6 THEN '3d' WHEN 7 THEN '1_0' ELSE CAST(doc_id % 5 AS STRING) END"


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name or f.__name__] = f
        if sql is not None:
            _SQL[name or f.__name__] = sql
        return f

    return add


def six(column, name: str):
    """Rounded to 6 decimals, for sums whose order is free."""
    return F.round(column if not isinstance(column, str) else F.col(column), 6).alias(name)


def edu(spark, d):
    return corpus_view(spark, d).withColumn("score_raw", score_of("edu"))


# --- scans, text, filters ------------------------------------------------------------------------------------------------------------


@query(f"{WITH} SELECT language, count(*) FILTER (WHERE char_len BETWEEN 500 AND 4000) AS inside, count(*) FILTER (WHERE NOT char_len BETWEEN 500 AND 4000) AS outside FROM corpus GROUP BY language")
def length_window_counts(spark, d):
    inside = corpus.in_window(F.col("text"))
    return corpus_view(spark, d).groupBy("language").agg(F.count_if(inside).alias("inside"), F.count_if(~inside).alias("outside"))


@query(f"{WITH} SELECT doc_id, language, text_hash FROM corpus QUALIFY row_number() OVER (PARTITION BY text_hash ORDER BY doc_id) = 1")
def text_hash_dedup(spark, d):
    return corpus.keep_first(corpus_view(spark, d).select("doc_id", "language", "text_hash"), ["text_hash"], ["doc_id"])


@query(r"SELECT doc_id, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS content_hash FROM documents")
def content_hashes(spark, d):
    return table(spark, d, "documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))


@query(f"{WITH} SELECT 'dup_' || substr(text_hash, 1, 16) AS group_id, count(*) AS n, min(doc_id) AS first_doc FROM corpus GROUP BY 1 HAVING count(*) > 1")
def duplicate_groups(spark, d):
    rows = split.duplicate_groups(corpus_view(spark, d).select("doc_id", "text"))
    return rows.groupBy("group_id").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).filter("n > 1")


@query(
    "WITH w AS (SELECT doc_id, list_distinct(regexp_split_to_array(lower(text), '[^a-zA-Z0-9]+')) AS ws FROM documents), "
    f"m AS (SELECT doc_id, list_sort(list_intersect(ws, {WORDS})) AS found FROM w) SELECT doc_id, array_to_string(found, ', ') AS matched FROM m WHERE len(found) > 0"
)
def banned_word_filter(spark, d):
    text = F.col("text")
    return table(spark, d, "documents").filter(T.has_any_word(text, WORDS)).select("doc_id", T.matched_words(text, WORDS).alias("matched"))


@query(r"SELECT domain, count(*) AS n FROM (SELECT regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)), '^www\.', '') AS domain FROM pages) GROUP BY domain")
def domain_of_url(spark, d):
    return table(spark, d, "pages").select(T.domain_of(F.col("url"), F.col("page_id")).alias("domain")).groupBy("domain").agg(F.count("*").alias("n"))


@query(
    "WITH r AS (SELECT doc_id, trim(" + PARSED.replace("STRING", "VARCHAR") + ") AS s FROM documents), "
    "p AS (SELECT *, CASE WHEN regexp_matches(s, '^[+-]?[0-9.]+$|^nan$') THEN s::DOUBLE END AS v FROM r), "
    "t AS (SELECT CASE WHEN s = '' THEN 'missing' WHEN v IS NULL THEN 'nonnumeric:''' || s || '''' WHEN isnan(v) OR NOT v BETWEEN 0 AND 5 THEN 'out_of_range:' || s END AS reason, v FROM p) "
    "SELECT reason, count(*) AS n, sum(CASE WHEN reason IS NULL THEN v END) AS total FROM t GROUP BY reason"
)
def parse_score_reasons(spark, d):
    value, reason = T.parse_score(F.expr(PARSED))
    rows = table(spark, d, "documents").select(value.alias("v"), reason.alias("reason"))
    return rows.groupBy("reason").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@query(f"{WITH} SELECT dimension, least(4, floor(least(5.0::DOUBLE, greatest(0.0::DOUBLE, score_raw))))::INTEGER AS bin, count(*) AS n FROM scores GROUP BY ALL")
def score_bins(spark, d):
    return scores(spark, d).groupBy("dimension", T.score_bin(T.clip(F.col("score_raw"))).alias("bin")).agg(F.count("*").alias("n"))


@query(
    r"WITH l AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM documents) "
    r"SELECT doc_id, length(trim(text)) >= 200 AND NOT regexp_matches(text, '(?i)<(div|table|span)') AND NOT (len(ls) >= 8 AND list_sum(list_transform(ls, lambda x: length(x)))::DOUBLE / len(ls) < 25) AS eligible FROM l"
)
def eligible_articles(spark, d):
    return table(spark, d, "documents").select("doc_id", T.eligible_article(F.col("text")).alias("eligible"))


@query(
    f"{WITH}, h AS (SELECT doc_id, text_hash FROM annotations), p AS (SELECT DISTINCT text_hash FROM corpus WHERE doc_id % 50 = 7), "
    "x AS (SELECT c.doc_id, c.text_hash, CASE WHEN trim(c.text) = '' THEN 'empty' WHEN c.doc_id IN (SELECT doc_id FROM h) OR c.text_hash IN (SELECT text_hash FROM h) THEN 'human' "
    "WHEN c.text_hash IN (SELECT text_hash FROM p) THEN 'pilot' END AS early FROM corpus c), "
    "y AS (SELECT *, row_number() OVER (PARTITION BY text_hash, early IS NULL ORDER BY doc_id) AS rn FROM x) SELECT coalesce(early, CASE WHEN rn > 1 THEN 'duplicate' END) AS reason, count(*) AS n FROM y GROUP BY 1"
)
def leakage_filter(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", F.col("doc_id").alias("ordinal"))
    rows = corpus.hashed(docs)
    human = rows.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").select("doc_id", "content")
    pilot = rows.filter("doc_id % 50 = 7").select("content")
    return corpus.leakage_reasons(rows, human=human, pilot=pilot).groupBy("reason").agg(F.count("*").alias("n"))


@query(
    f"{WITH}, f AS (SELECT doc_id, text_hash, text FROM corpus WHERE length(trim(text)) BETWEEN 500 AND 4000 AND doc_id NOT IN (SELECT doc_id FROM labels) AND len(list_intersect(regexp_split_to_array(lower(text), '[^a-zA-Z0-9]+'), ['idiot', 'scum'])) = 0) "
    "SELECT doc_id AS ordinal, doc_id::VARCHAR AS doc_id, text_hash FROM f QUALIFY row_number() OVER (PARTITION BY text_hash ORDER BY f.doc_id) = 1"
)
def corpus_filter(spark, d):
    """Ids are unique here, so the sequential rule is the first of each text among rows that pass."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("ordinal"), F.col("doc_id").cast("string").alias("doc_id"), "text")
    rows = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("doc_id"))
    none = docs.filter("false").select(F.lit("").alias("text_hash"))
    kept, _ = corpus.collect_documents(docs, target=1_000_000_000, exclude_ids=rows, exclude_hashes=none, banned=["idiot", "scum"])
    return kept.select("ordinal", "doc_id", "text_hash")


#: One id for every so many documents, so that rows clash by id, by text, and in chains of both.
TWO_KEY_IDS = 700
TWO_KEY_SQL = (
    f"WITH RECURSIVE {SQL_CORPUS}, d AS (SELECT row_number() OVER (ORDER BY doc_id) AS n, doc_id AS ordinal, text_hash, ((doc_id * 7) % {TWO_KEY_IDS})::VARCHAR AS id, text FROM corpus), "
    f"x AS MATERIALIZED (SELECT n, ordinal, id, text_hash, CASE WHEN NOT (length(trim(text)) BETWEEN 500 AND 4000) THEN 'length' WHEN id IN (SELECT doc_id::VARCHAR FROM labels WHERE toxic = 1) THEN 'overlap_id' END AS early, "
    "len(list_intersect(regexp_split_to_array(lower(text), '[^a-zA-Z0-9]+'), ['idiot', 'scum'])) > 0 AS adult FROM d), "
    "w(n, ordinal, reason, ids, texts) AS (SELECT 0::BIGINT, NULL::BIGINT, NULL::VARCHAR, []::VARCHAR[], []::VARCHAR[] UNION ALL SELECT n, ordinal, reason, CASE WHEN reason = 'kept' THEN list_append(ids, id) ELSE ids END, CASE WHEN reason = 'kept' THEN list_append(texts, text_hash) ELSE texts END "
    "FROM (SELECT x.*, w.ids, w.texts, CASE WHEN early IS NOT NULL THEN early WHEN list_contains(w.ids, id) THEN 'duplicate_id' WHEN list_contains(w.texts, text_hash) THEN 'duplicate_text' WHEN adult THEN 'adult' ELSE 'kept' END AS reason FROM w JOIN x ON x.n = w.n + 1)) "
    "SELECT ordinal, reason FROM w WHERE n > 0"
)


def _two_key_documents(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("ordinal"), (F.col("doc_id") * 7 % TWO_KEY_IDS).cast("string").alias("doc_id"), "text")
    known = {
        "exclude_ids": table(spark, d, "labels").filter("toxic = 1").select(F.col("doc_id").cast("string").alias("doc_id")),
        "exclude_hashes": rows.filter("false").select(F.lit("").alias("text_hash")),
    }
    return rows, known


@query(TWO_KEY_SQL)
def corpus_filter_two_keys(spark, d):
    rows, known = _two_key_documents(spark, d)
    narrow = corpus.prepared(rows, ["idiot", "scum"]).select("ordinal", "doc_id", "text_hash", "fits", "adult")
    return corpus.reasons(narrow, **known)


@query(TWO_KEY_SQL)
def corpus_filter_stream(spark, d):
    """The same documents as they arrive in three parts; each start goes on from the checkpoint of the one before."""
    rows, known = _two_key_documents(spark, d)
    folder = new_folder(spark)
    last = rows.agg(F.coalesce(F.max("ordinal"), F.lit(0))).first()[0]
    for part in range(3):
        low, high = last * part // 3, last * (part + 1) // 3
        arrived = rows.filter((F.col("ordinal") <= high) if part == 0 else (F.col("ordinal") > low) & (F.col("ordinal") <= high))
        arrived.write.mode("append").parquet(f"{folder}/arrived")
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/arrived")
        records.collect_stream(stream, f"{folder}/out", target=1_000_000_000_000, banned=["idiot", "scum"], **known)
    return records.told(spark, f"{folder}/out")


# --- splits --------------------------------------------------------------------------------------------------------------------------


@query(
    "WITH c AS (SELECT source AS domain, count(*) AS n FROM documents GROUP BY source), r(i, split, r) AS (VALUES (0, 'train', 0.7::DOUBLE), (1, 'validation', 0.1::DOUBLE), (2, 'test', 0.2::DOUBLE)), "
    "x AS (SELECT *, n * r AS raw, floor(n * r) AS f FROM c, r), y AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY raw - f DESC, i) AS p, n - sum(f) OVER (PARTITION BY domain) AS rest FROM x) "
    "SELECT domain, split, (f + CASE WHEN p <= rest THEN 1 ELSE 0 END)::BIGINT AS take FROM y"
)
def largest_remainder_split(spark, d):
    counts = table(spark, d, "documents").groupBy(F.col("source").alias("domain")).agg(F.count("*").alias("n"))
    return split.largest_remainder(counts).select("domain", "split", F.col("take").cast("long").alias("take"))


@query(
    f"{WITH}, g AS (SELECT language, 'dup_' || substr(text_hash, 1, 16) AS group_id, least(4, floor(avg(human)))::INTEGER AS bin FROM annotations GROUP BY 1, 2), "
    "o AS (SELECT *, row_number() OVER (PARTITION BY language, bin ORDER BY sha256('42:quality:' || group_id), group_id) AS rn, count(*) OVER (PARTITION BY language, bin) AS n FROM g), "
    "r(i, r) AS (VALUES (0, 0.7::DOUBLE), (1, 0.1::DOUBLE), (2, 0.2::DOUBLE)), c AS (SELECT DISTINCT language, bin, n FROM o), x AS (SELECT *, floor(n * r) AS f, n * r AS raw FROM c, r), "
    "y AS (SELECT *, row_number() OVER (PARTITION BY language, bin ORDER BY raw - f DESC, i) AS p, n - sum(f) OVER (PARTITION BY language, bin) AS rest FROM x), "
    "z AS (SELECT language, bin, i, f + CASE WHEN p <= rest THEN 1 ELSE 0 END AS take FROM y), e AS (SELECT *, sum(take) OVER (PARTITION BY language, bin ORDER BY i) AS hi FROM z), "
    "s AS (SELECT o.language, o.group_id, o.bin, CASE e.i WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END AS split FROM o JOIN e ON o.language = e.language AND o.bin = e.bin AND o.rn > e.hi - e.take AND o.rn <= e.hi) "
    "SELECT a.doc_id, s.bin, s.split FROM annotations a JOIN s ON s.language = a.language AND s.group_id = 'dup_' || substr(a.text_hash, 1, 16)"
)
def stratified_split(spark, d):
    rows = split.duplicate_groups(annotations(spark, d)).select("language", "doc_id", "group_id", F.col("human").alias("score"))
    return split.stratified_split(rows, SEED, "quality").select("doc_id", "bin", "split")


@query(
    f"{WITH}, x AS (SELECT doc_id, floor(human) AS s, count(*) OVER (PARTITION BY floor(human)) AS n FROM annotations), "
    "y AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY sha256('42:' || s::BIGINT || ':' || doc_id), doc_id) AS rn FROM x) "
    "SELECT doc_id, CASE WHEN rn <= greatest(round_even(n * 0.1::DOUBLE, 0), CASE WHEN n >= 2 THEN 1 ELSE 0 END) THEN 'validation' ELSE 'train' END AS split FROM y"
)
def validation_split(spark, d):
    rows = annotations(spark, d).select("doc_id", F.col("human").alias("score"))
    return split.validation_split(rows, 0.1, SEED).select("doc_id", "split")


def _walk(name, source, size):
    """First fit of the sites of source, in order, into size documents."""
    return f"{name}(rn, room, took) AS (SELECT 0::BIGINT, {size}::BIGINT, false UNION ALL SELECT s.rn, CASE WHEN s.n <= {name}.room THEN {name}.room - s.n ELSE {name}.room END, s.n <= {name}.room FROM {name} JOIN {source} s ON s.rn = {name}.rn + 1)"


@query(
    r"WITH RECURSIVE p AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)), '^www\.', '') AS domain FROM pages), "
    "a AS (SELECT domain, count(*) AS n, row_number() OVER (ORDER BY sha256('42:all:' || domain), domain) AS rn FROM p GROUP BY domain HAVING count(*) <= 10), "
    f"{_walk('t', 'a', 5)}, b AS (SELECT domain, n, row_number() OVER (ORDER BY a.rn) AS rn FROM a JOIN t USING (rn) WHERE NOT took), {_walk('v', 'b', 2)}, "
    "k AS (SELECT domain, 'test' AS split FROM a JOIN t USING (rn) WHERE took UNION ALL SELECT domain, 'validation' FROM b JOIN v USING (rn) WHERE took) "
    "SELECT 'all' AS language, p.domain, page_id, coalesce(k.split, 'train') AS split FROM p LEFT JOIN k USING (domain)"
)
def website_split(spark, d):
    rows = table(spark, d, "pages").select(F.lit("all").alias("language"), T.domain_of(F.col("url"), F.col("page_id")).alias("domain"), "page_id")
    return split.website_split(rows, 5, 2, SEED, 10)


@query(
    f"{WITH}, k AS (SELECT language, doc_id, domain, CASE WHEN doc_id % 20 = 0 THEN 'test' ELSE 'validation' END AS split FROM corpus WHERE doc_id % 10 = 0 AND domain IN ('src0', 'src5')) "
    "SELECT c.doc_id, coalesce(k.split, CASE WHEN (c.language, c.domain) IN (SELECT (language, domain) FROM k) THEN 'excluded' END, 'train') AS split FROM corpus c LEFT JOIN k ON k.doc_id = c.doc_id"
)
def website_split_keep_eval(spark, d):
    rows = corpus_view(spark, d).select("language", "doc_id", "domain")
    kept = rows.filter("doc_id % 10 = 0 and domain in ('src0', 'src5')").select("language", "doc_id", F.when(F.col("doc_id") % 20 == 0, "test").otherwise("validation").alias("split"))
    return split.keep_evaluation(rows, kept).select("doc_id", "split")


@query(
    f"{WITH}, s AS (SELECT *, CASE WHEN doc_id % 10 = 0 THEN 'test' ELSE 'train' END AS split FROM corpus), n AS (SELECT language, split, domain, count(*) AS n FROM s GROUP BY ALL), "
    "l AS (SELECT language, split, count(*) AS sites, max(n) AS largest_site FROM n GROUP BY ALL) SELECT * FROM (SELECT language, split, count(*) AS docs, median(char_len) AS median_chars FROM s GROUP BY ALL) JOIN l USING (language, split)"
)
def split_report(spark, d):
    return split.split_report(corpus_view(spark, d).withColumn("split", F.when(F.col("doc_id") % 10 == 0, "test").otherwise("train")))


@query(
    f"{WITH} SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'missing' WHEN doc_id % 7 = 0 THEN 'split' WHEN doc_id % 5 = 0 THEN 'score' ELSE 'range' END AS problem FROM annotations WHERE doc_id % 11 = 0 OR doc_id % 7 = 0 OR doc_id % 5 = 0 OR NOT human BETWEEN 0 AND 5"
)
def split_consistency_check(spark, d):
    rows = annotations(spark, d).select("doc_id", F.col("human").alias("score"), F.lit("train").alias("split"))
    other = rows.filter("doc_id % 11 <> 0").withColumn("split", F.when(F.col("doc_id") % 7 == 0, "test").otherwise("train")).withColumn("score", F.when(F.col("doc_id") % 5 == 0, -1.0).otherwise(F.col("score")))
    return split.consistency_errors(rows, other, ["doc_id"])


# --- selection -----------------------------------------------------------------------------------------------------------------------

RANDOM = "row_number() OVER (PARTITION BY language ORDER BY sha256('42:' || language || ':' || doc_id), doc_id)"
RANKED = "row_number() OVER (PARTITION BY language ORDER BY score_raw DESC, doc_id)"
EDU = f"edu AS (SELECT *, {SQL_SCORE['edu']} AS score_raw FROM corpus)"
BUDGET = (
    f"{WITH}, u AS (SELECT * FROM corpus WHERE char_len BETWEEN 500 AND 4000 QUALIFY row_number() OVER (PARTITION BY text_hash ORDER BY doc_id) = 1), "
    "m AS (SELECT language, doc_id, avg(least(5.0::DOUBLE, greatest(0.0::DOUBLE, score_raw))) AS score_raw FROM scores GROUP BY ALL), j AS (SELECT u.*, m.score_raw FROM u JOIN m USING (language, doc_id)), "
    f"r AS (SELECT *, {RANKED} AS rn FROM j), g AS (SELECT *, (rn - 1) // {GROUP} AS grp FROM r), s AS (SELECT language, grp, sum(tokens) AS t FROM g GROUP BY ALL), "
    "b AS (SELECT *, coalesce(sum(t) OVER (PARTITION BY language ORDER BY grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s), "
    f"k AS (SELECT g.* FROM g JOIN b USING (language, grp) WHERE before < {TARGET})"
)


@query(f"{WITH} SELECT language, doc_id, {RANDOM}::INTEGER AS rn FROM corpus QUALIFY rn <= 20")
def random_select_k(spark, d):
    return select.top_k(select.rank_randomly(corpus_view(spark, d).select("language", "doc_id"), SEED), 20)


@query(f"{WITH}, {EDU} SELECT language, doc_id, score_raw, {RANKED}::INTEGER AS rn FROM edu QUALIFY rn <= 20")
def top_k_per_language(spark, d):
    return select.top_k(select.rank_by_score(edu(spark, d).select("language", "doc_id", "score_raw")), 20)


def _selected(spark, d):
    rows = corpus_view(spark, d).filter(corpus.in_window(F.col("text"))).drop("text")
    rows = corpus.keep_first(rows, ["text_hash"], ["doc_id"])
    mean = select.combine_scores(scores(spark, d), ["language", "doc_id"]).select("language", "doc_id", "score_raw")
    pool = written(rows.join(mean, ["language", "doc_id"]).select("language", "doc_id", "char_len", "tokens", "score_raw"))  # texts are read once
    return select.token_budget(select.rank_by_score(pool, whole=True), TARGET, GROUP, strict=False)


@query(f"{BUDGET} SELECT language, doc_id, rn::INTEGER AS rn, tokens, round(score_raw, 6) AS score FROM k")
def selection_token_budget(spark, d):
    return _selected(spark, d).select("language", "doc_id", "rn", "tokens", six("score_raw", "score"))


@query(
    f"{BUDGET}, p AS (SELECT language, count(*) AS pool_docs, avg(char_len) AS pc FROM corpus GROUP BY language), q AS (SELECT language, count(*) AS docs, avg(char_len) AS mc, median(char_len) AS median_chars, avg(score_raw) AS ms, min(score_raw) AS mi, sum(tokens)::BIGINT AS tokens FROM k GROUP BY language) "
    f"SELECT language, pool_docs, round(pc, 6) AS pool_mean_chars, docs, round(mc, 6) AS mean_chars, median_chars, round(ms, 6) AS mean_score, round(mi, 6) AS min_score, tokens, tokens - {TARGET} AS over_target FROM p LEFT JOIN q USING (language)"
)
def selection_summary(spark, d):
    out = select.selection_summary(corpus_view(spark, d), _selected(spark, d), TARGET)
    return out.select("language", "pool_docs", six("pool_mean_chars", "pool_mean_chars"), "docs", six("mean_chars", "mean_chars"), "median_chars", six("mean_score", "mean_score"), six("min_score", "min_score"), "tokens", "over_target")


ROBIN = (
    f"{WITH}, r AS (SELECT *, row_number() OVER (PARTITION BY language, dimension ORDER BY score_raw DESC, doc_id) AS r, CASE dimension " + " ".join(f"WHEN '{n}' THEN {i + 1}" for i, n in enumerate(NAMES)) + " END AS dim FROM scores), "
    "p AS (SELECT *, ceil(r / 5.0)::INTEGER AS rd FROM r), f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY language, doc_id ORDER BY rd, dim, r) = 1), "
    "t AS (SELECT f.language, f.doc_id, f.rd, f.dim, f.r, f.dimension, c.tokens FROM f JOIN corpus c ON c.doc_id = f.doc_id), s AS (SELECT language, rd, sum(tokens) AS t FROM t GROUP BY ALL), "
    f"a AS (SELECT language, rd, sum(t) OVER (PARTITION BY language ORDER BY rd) AS acc FROM s), l AS (SELECT language, coalesce(min(rd) FILTER (WHERE acc >= {TARGET}), max(rd)) AS last FROM a GROUP BY language), "
    "n AS (SELECT p.language, p.doc_id, string_agg(p.dimension, '+' ORDER BY p.rd, p.dim) AS selected_by FROM p JOIN l ON l.language = p.language AND p.rd <= l.last GROUP BY ALL), "
    "k AS (SELECT t.*, n.selected_by, row_number() OVER (PARTITION BY t.language ORDER BY rd, dim, r) AS rn FROM t JOIN l ON l.language = t.language AND t.rd <= l.last JOIN n ON n.language = t.language AND n.doc_id = t.doc_id)"
)


def _robin(spark, d):
    return select.round_robin(corpus_view(spark, d), scores(spark, d), NAMES, 5, TARGET, strict=False)


@query(f"{ROBIN} SELECT language, doc_id, tokens, rd AS round, selected_by, dimension AS first_dimension, rn::INTEGER AS rn FROM k")
def selection_round_robin(spark, d):
    return _robin(spark, d)


@query(
    f"{ROBIN}, z AS (SELECT language, rd, sum(tokens) AS t FROM k GROUP BY ALL), w AS (SELECT *, coalesce(sum(t) OVER (PARTITION BY language ORDER BY rd ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM z) "
    "SELECT k.language, k.doc_id, k.rd AS round FROM k JOIN w ON w.language = k.language AND w.rd = k.rd WHERE before < 5000"
)
def budget_prefix(spark, d):
    return select.budget_prefix(_robin(spark, d), 5000).select("language", "doc_id", "round")


@query(f"{WITH} SELECT language, doc_id, round(avg(least(5.0::DOUBLE, greatest(0.0::DOUBLE, score_raw))), 6) AS score_raw, round(avg(score_raw), 6) AS raw_mean, count(*) AS n_dims FROM scores GROUP BY ALL")
def combine_scores(spark, d):
    return select.combine_scores(scores(spark, d), ["language", "doc_id"]).select("language", "doc_id", six("score_raw", "score_raw"), six("raw_mean", "raw_mean"), "n_dims")


@query(
    f"{WITH}, {EDU}, o AS (SELECT *, row_number() OVER (PARTITION BY language ORDER BY score_raw DESC) AS de, row_number() OVER (PARTITION BY language ORDER BY score_raw) AS a, count(*) OVER (PARTITION BY language) AS n FROM edu) "
    "SELECT language, count(*) AS n, max(score_raw) FILTER (WHERE de = 50) AS threshold, round(avg(score_raw), 6) AS mean, round(median(score_raw), 6) AS median, max(score_raw) FILTER (WHERE a = floor(0.9::DOUBLE * (n - 1)) + 1) AS p90, "
    "round(avg((score_raw > 5)::INT), 6) AS share_above_5, round(CASE WHEN max(score_raw) FILTER (WHERE de = 50) IS NOT NULL THEN 50.0::DOUBLE / count(*) END, 6) AS share_kept FROM o GROUP BY language"
)
def threshold_table(spark, d):
    out = select.threshold_table(edu(spark, d), 50)
    return out.select("language", "n", "threshold", six("mean", "mean"), six("median", "median"), "p90", six("share_above_5", "share_above_5"), six("share_kept", "share_kept"))


def _place(p):
    return f"{p}::DOUBLE * (n + 1)"


def _point(p):
    low = f"greatest(1, least(n - 1, floor({_place(p)})))::INT"
    return f"round(s[{low}] + (s[{low} + 1] - s[{low}]) * ({_place(p)} - {low}), 6)"


@query(
    f"{WITH}, {EDU}, g AS (SELECT language, avg(score_raw) AS m, stddev_pop(score_raw) AS sd, list(score_raw ORDER BY score_raw) AS s, count(*) AS n FROM edu GROUP BY language) "
    f"SELECT language, round(m, 6) AS mean, round(sd, 6) AS sd, {_point(0.05)} AS p5, {_point(0.5)} AS p50, {_point(0.95)} AS p95 FROM g"
)
def score_distribution(spark, d):
    return select.describe(edu(spark, d)).select("language", *[six(c, c) for c in ("mean", "sd", "p5", "p50", "p95")])


@query(f"{WITH}, {EDU} SELECT language, doc_id, row_number() OVER (PARTITION BY language ORDER BY score_raw DESC, doc_id) <= round_even(count(*) OVER (PARTITION BY language) * 0.5::DOUBLE, 0) AS high FROM edu")
def high_quality_half(spark, d):
    return select.high_quality(edu(spark, d), 0.5).select("language", "doc_id", "high")


@query(
    f"{WITH}, {EDU} SELECT member_of, count(*) AS n FROM (SELECT CASE WHEN a AND b THEN 'edu+long' WHEN a THEN 'edu' WHEN b THEN 'long' ELSE 'other' END AS member_of FROM (SELECT score_raw >= 4 AS a, char_len >= 4000 AS b FROM edu)) GROUP BY 1"
)
def membership_labels(spark, d):
    rows = edu(spark, d).withColumn("a", F.col("score_raw") >= 4).withColumn("b", F.col("char_len") >= 4000)
    return select.membership(rows, {"edu": "a", "long": "b"}).groupBy("member_of").agg(F.count("*").alias("n"))


@query(
    f"{WITH}, {EDU}, w AS (SELECT *, 0.5::DOUBLE + least(5.0::DOUBLE, greatest(0.0::DOUBLE, score_raw)) * 0.2::DOUBLE AS weight FROM edu), m AS (SELECT language, sum(tokens * weight) / sum(tokens) AS m FROM w GROUP BY language) "
    "SELECT doc_id, round(weight / m, 6) AS weight FROM w JOIN m USING (language)"
)
def loss_weights_normalised(spark, d):
    rows = edu(spark, d).withColumn("weight", T.score_to_weight(T.clip(F.col("score_raw"))))
    return select.normalised_weights(rows, "weight", "tokens").select("doc_id", six("weight", "weight"))


@query(
    f"{WITH}, {EDU}, h AS (SELECT *, row_number() OVER (PARTITION BY language ORDER BY score_raw DESC, doc_id) <= round_even(count(*) OVER (PARTITION BY language) * 0.5::DOUBLE, 0) AS high FROM edu) SELECT language, high, count(*) AS n, min(score_raw) AS lowest, max(score_raw) AS highest, round(avg(score_raw), 6) AS mean FROM h GROUP BY ALL"
)
def selection_inside_outside(spark, d):
    out = select.inside_outside(select.high_quality(edu(spark, d), 0.5), "high", "score_raw")
    return out.select("language", "high", "n", "lowest", "highest", six("mean", "mean"))


# --- metrics -------------------------------------------------------------------------------------------------------------------------

CLIPPED = "least(5.0::DOUBLE, greatest(0.0::DOUBLE, raw))"
RANKS = "rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0"


def _corr(x, y):
    return f"CASE WHEN stddev_pop({x}) * stddev_pop({y}) > 0 THEN round(covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})), 6) END"


CELLS = (
    f"{WITH}, a AS (SELECT *, {CLIPPED} AS p FROM annotations), r AS (SELECT *, {RANKS.format(by='language', x='human')} AS rx, {RANKS.format(by='language', x='p')} AS ry FROM a), "
    f"c AS (SELECT language, count(*) AS n, avg(abs(p - human)) AS mae, sqrt(avg((p - human) ** 2)) AS rmse, avg(p - human) AS bias, avg((abs(p - human) <= 0.5)::INT) AS within_half, avg((abs(p - human) <= 1.0)::INT) AS within_one, avg((NOT raw BETWEEN 0 AND 5)::INT) AS out_of_range, {_corr('rx', 'ry')} AS spearman FROM r GROUP BY language)"
)
CELL_COLUMNS = ["mae", "rmse", "bias", "within_half", "within_one", "out_of_range"]


@query(f"{CELLS} SELECT language, n, {', '.join(f'round({c}, 6) AS {c}' for c in CELL_COLUMNS)}, spearman FROM c")
def cell_metrics(spark, d):
    out = metrics.cell_metrics(annotations(spark, d), ["language"])
    return out.select("language", "n", *[six(c, c) for c in CELL_COLUMNS], six("spearman", "spearman"))


@query(f"{CELLS} SELECT round(avg(mae), 6) AS macro_mae FROM c")
def macro_mae(spark, d):
    return metrics.macro_mae(metrics.cell_metrics(annotations(spark, d), ["language"])).select(six("macro_mae", "macro_mae"))


@query(f"{WITH} SELECT language, round(avg(human), 6) AS baseline_mean, median(human) AS baseline_median FROM annotations GROUP BY language")
def constant_baselines(spark, d):
    return metrics.constant_baselines(annotations(spark, d), ["language"]).withColumn("baseline_mean", six("baseline_mean", "baseline_mean"))


@query(
    f"{WITH}, m AS (SELECT language, median(human) AS median FROM annotations WHERE doc_id % 2 = 0 GROUP BY language), "
    f"t AS (SELECT a.*, median, least(4, floor(human))::INT::VARCHAR AS bin, {CLIPPED} AS p FROM annotations a JOIN m USING (language) WHERE doc_id % 2 = 1), "
    "c AS (SELECT coalesce(language, 'All') AS language, coalesce(bin, 'ALL') AS bin, count(*) AS n_test, round(avg(abs(p - human)), 6) AS mae, round(sqrt(avg((p - human) ** 2)), 6) AS rmse, round(avg(p - human), 6) AS bias, round(avg(abs(median - human)), 6) AS median_mae, min(p) AS min_pred, max(p) AS max_pred FROM t GROUP BY CUBE (language, bin)), "
    "x AS (SELECT *, least(4, floor(human))::INT::VARCHAR AS bin FROM annotations WHERE doc_id % 2 = 0), n AS (SELECT coalesce(language, 'All') AS language, coalesce(bin, 'ALL') AS bin, count(*) AS n_train FROM x GROUP BY CUBE (language, bin)) "
    "SELECT c.*, coalesce(n_train, 0) AS n_train FROM c LEFT JOIN n USING (language, bin)"
)
def score_range_cube(spark, d):
    rows = annotations(spark, d)
    out = metrics.score_range_cube(rows.filter("doc_id % 2 = 0"), rows.filter("doc_id % 2 = 1"))
    return out.select("language", "bin", "n_test", *[six(c, c) for c in ("mae", "rmse", "bias", "median_mae")], "min_pred", "max_pred", "n_train")


LONG = f"{WITH}, l AS (SELECT a.language, a.doc_id, a.human, s.dimension, s.score_raw AS raw FROM annotations a JOIN scores s ON s.doc_id = a.doc_id)"


def _long(spark, d):
    return annotations(spark, d).select("language", "doc_id", "human").join(scores(spark, d).select("doc_id", "dimension", F.col("score_raw").alias("raw")), "doc_id")


@query(f"{LONG} SELECT coalesce(language, 'all') AS language, coalesce(dimension, 'all') AS dimension, count(*) AS n, round(avg(abs({CLIPPED} - human)), 6) AS mae, round(sqrt(avg(({CLIPPED} - human) ** 2)), 6) AS rmse FROM l GROUP BY CUBE (language, dimension)")
def pooled_error_cube(spark, d):
    return metrics.pooled_errors(_long(spark, d), ["language", "dimension"]).select("language", "dimension", "n", six("mae", "mae"), six("rmse", "rmse"))


@query(
    f"{LONG}, r AS (SELECT *, {RANKS.format(by='dimension', x='human')} AS px, {RANKS.format(by='dimension', x='raw')} AS py, {RANKS.format(by='dimension, language', x='human')} AS lx, {RANKS.format(by='dimension, language', x='raw')} AS ly FROM l), "
    f"b AS (SELECT dimension AS rater, count(*) AS n, round(avg(abs({CLIPPED} - human)), 6) AS mae, round(avg({CLIPPED} - human), 6) AS bias, {_corr('px', 'py')} AS pooled_spearman FROM r GROUP BY dimension), "
    "o AS (SELECT dimension AS rater, language, covar_pop(lx, ly) / nullif(stddev_pop(lx) * stddev_pop(ly), 0) AS s FROM r GROUP BY ALL) SELECT b.*, round(m, 6) AS mean_spearman FROM b JOIN (SELECT rater, avg(s) AS m FROM o GROUP BY rater) USING (rater)"
)
def rater_comparison(spark, d):
    out = metrics.rater_comparison(_long(spark, d).withColumnRenamed("dimension", "rater"))
    return out.select("rater", "n", *[six(c, c) for c in ("mae", "bias", "pooled_spearman", "mean_spearman")])


@query(
    f"{WITH}, p AS (SELECT language, human, raw AS llm FROM annotations WHERE doc_id % 3 <> 0), u AS (SELECT * FROM p UNION ALL SELECT 'all', human, llm FROM p), r AS (SELECT *, {RANKS.format(by='language', x='human')} AS rx, {RANKS.format(by='language', x='llm')} AS ry FROM u) "
    f"SELECT language, count(*) AS n, round(avg(abs(llm - human)), 6) AS mae, {_corr('human', 'llm')} AS pearson, {_corr('rx', 'ry')} AS spearman FROM r GROUP BY language"
)
def rater_agreement(spark, d):
    rows = annotations(spark, d).withColumn("llm", F.when(F.col("doc_id") % 3 != 0, F.col("raw")))
    return metrics.agreement(rows).select("language", "n", *[six(c, c) for c in ("mae", "pearson", "spearman")])


@query(f"{WITH}, r AS (SELECT doc_id, dimension, {RANKS.format(by='dimension', x='score_raw')} AS r FROM scores) SELECT x.dimension AS a, y.dimension AS b, round(covar_pop(x.r, y.r) / (stddev_pop(x.r) * stddev_pop(y.r)), 4) AS spearman FROM r x JOIN r y ON x.doc_id = y.doc_id AND x.dimension < y.dimension GROUP BY ALL")
def dimension_spearman(spark, d):
    return metrics.dimension_correlations(scores(spark, d).select("dimension", F.col("doc_id").alias("key"), F.col("score_raw").alias("value")))


LOSS = f"{WITH}, {EDU}, n AS (SELECT language, domain, (1.5::DOUBLE + score_raw / 10) * tokens AS nll, greatest(0, tokens - 1) AS targets, strlen(text) AS bytes, tokens, score_raw FROM edu)"


def _loss(spark, d):
    rows = edu(spark, d).withColumn("nll", (F.lit(1.5) + F.col("score_raw") / 10) * F.col("tokens"))
    return rows.withColumn("targets", F.greatest(F.lit(0), F.col("tokens") - 1)).withColumn("bytes", F.octet_length("text"))


@query(
    f"{LOSS}, p AS (SELECT language, sum(nll) / sum(targets) AS loss, sum(targets)::BIGINT AS targets FROM n GROUP BY language), u AS (SELECT * FROM p UNION ALL SELECT 'macro', avg(loss), sum(targets)::BIGINT FROM p UNION ALL SELECT 'token_weighted', sum(loss * targets) / sum(targets), sum(targets)::BIGINT FROM p) SELECT language, targets, round(loss, 6) AS loss, round(exp(loss), 6) AS perplexity FROM u"
)
def macro_vs_weighted(spark, d):
    return metrics.losses(_loss(spark, d)).select("language", "targets", six("loss", "loss"), six("perplexity", "perplexity"))


@query(
    f"{LOSS}, p AS (SELECT language, sum(nll) / ln(2) / sum(bytes) AS bpb, sum(bytes)::BIGINT AS bytes FROM n GROUP BY language), u AS (SELECT * FROM p UNION ALL SELECT 'macro', avg(bpb), sum(bytes)::BIGINT FROM p UNION ALL SELECT 'byte_weighted', sum(bpb * bytes) / sum(bytes), sum(bytes)::BIGINT FROM p) SELECT language, bytes, round(bpb, 6) AS bpb FROM u"
)
def bits_per_byte(spark, d):
    return metrics.bits_per_byte(_loss(spark, d)).select("language", "bytes", six("bpb", "bpb"))


@query(f"{LOSS} SELECT language, domain, round(sum(nll) / sum(targets), 6) AS loss, sum(targets)::BIGINT AS targets FROM n GROUP BY GROUPING SETS ((language), (language, domain))")
def topic_loss(spark, d):
    return metrics.group_loss(_loss(spark, d), [["language"], ["language", "domain"]], ["language", "domain"]).select("language", "domain", six("loss", "loss"), "targets")


@query(f"{LOSS} SELECT language, round(sum(nll * (0.5::DOUBLE + score_raw)) / sum(0.5::DOUBLE + score_raw), 6) AS loss FROM n GROUP BY language")
def weighted_loss(spark, d):
    rows = _loss(spark, d).select("language", F.col("nll").alias("loss"), (F.lit(0.5) + F.col("score_raw")).alias("weight"))
    return metrics.weighted_loss(rows, ["language"]).select("language", six("loss", "loss"))


@query(f"{WITH}, {EDU}, e AS (SELECT min(score_raw) AS lo, max(score_raw) AS hi FROM edu) SELECT least(49, floor((score_raw - lo) / ((hi - lo) / 50)))::INTEGER AS bin, count(*) AS n FROM edu, e GROUP BY 1")
def score_histogram(spark, d):
    return metrics.histogram(edu(spark, d), "score_raw")


@query(f"{WITH} SELECT coalesce(language, 'all') AS language, count(*) AS documents, sum(tokens)::BIGINT AS tokens, sum(char_len)::BIGINT AS chars FROM corpus GROUP BY ROLLUP (language)")
def corpus_totals(spark, d):
    return metrics.totals_by(corpus_view(spark, d), "language", [F.count("*").alias("documents"), F.sum("tokens").alias("tokens"), F.sum("char_len").alias("chars")])


@query(
    f"{WITH}, r AS (SELECT dimension AS run, language, avg(score_raw) AS value FROM scores GROUP BY ALL) SELECT r.run, r.language, round(r.value, 6) AS value, round(r.value - b.value, 6) AS delta FROM r LEFT JOIN r b ON b.language = r.language AND b.run = 'edu'"
)
def run_delta(spark, d):
    rows = scores(spark, d).groupBy(F.col("dimension").alias("run"), "language").agg(F.avg("score_raw").alias("value"))
    return metrics.run_deltas(rows, "edu", ["language"], "value").select("run", "language", six("value", "value"), six("delta", "delta"))


@query(
    "WITH f AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i, (1 + vec_id % 3) AS w FROM embeddings) SELECT label, i::INTEGER AS i, round(sum(x * w) / sum(w), 5) AS mean FROM f GROUP BY ALL"
)
def weighted_vector_mean(spark, d):
    rows = table(spark, d, "embeddings").withColumn("w", 1 + F.col("vec_id") % 3).withColumn("v", F.col("embedding").cast("array<double>"))
    out = metrics.weighted_vector_mean(rows, "label", "v", "w")
    return out.select("label", F.posexplode("mean").alias("p", "m")).select("label", (F.col("p") + 1).alias("i"), F.round("m", 5).alias("mean"))


# --- labels --------------------------------------------------------------------------------------------------------------------------


@query(
    f"{WITH}, r AS (SELECT CASE WHEN doc_id % 4 = 0 THEN 'u' || doc_id ELSE doc_id::VARCHAR END AS id, text_hash, doc_id AS line FROM corpus), c AS (SELECT *, doc_id::VARCHAR AS id FROM corpus), "
    "a AS (SELECT r.line, c.language, c.id AS doc_id, c.text_hash FROM r JOIN c ON r.id = c.id), b AS (SELECT r.line, c.language, c.id AS doc_id, c.text_hash FROM r JOIN c ON r.text_hash = c.text_hash WHERE r.id NOT IN (SELECT id FROM c)), "
    "u AS (SELECT * FROM a UNION ALL SELECT * FROM b) SELECT line, language, doc_id FROM u QUALIFY row_number() OVER (PARTITION BY doc_id, text_hash ORDER BY line, language) = 1"
)
def llm_human_match(spark, d):
    rows = corpus_view(spark, d).withColumn("id", F.col("doc_id").cast("string"))
    known = rows.select("language", F.col("id").alias("doc_id"), T.content_hash(F.col("text")).alias("content"))
    records = rows.select(F.lit("f").alias("file"), F.col("doc_id").alias("line"), F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("u"), "id")).otherwise(F.col("id")).alias("id"), "text")
    return labels.match_records(known, records).select("line", "language", "doc_id")


@query(
    f"{WITH}, m AS (SELECT doc_id, human AS score, CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM annotations) SELECT split, CASE WHEN split = 'test' THEN NULL WHEN doc_id % 3 = 0 THEN 'no_record' WHEN doc_id % 7 = 0 THEN 'no_score' END AS dropped, count(*) AS n, round(sum(CASE WHEN split = 'test' THEN score WHEN doc_id % 3 = 0 OR doc_id % 7 = 0 THEN NULL ELSE (doc_id % 6)::DOUBLE END), 6) AS total FROM m GROUP BY ALL"
)
def relabel_splits(spark, d):
    rows = annotations(spark, d).select("doc_id", F.col("human").alias("score"), F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train").alias("split"))
    given = rows.filter("doc_id % 3 <> 0").select("doc_id", F.when(F.col("doc_id") % 7 != 0, (F.col("doc_id") % 6).cast("double")).alias("score"))
    return labels.relabel(rows, given, ["doc_id"]).groupBy("split", "dropped").agg(F.count("*").alias("n"), six(F.sum("score"), "total"))


@query(
    f"{WITH} SELECT language, count(*) AS annotated, count(*) FILTER (WHERE doc_id % 3 <> 0) AS with_record, count(*) FILTER (WHERE doc_id % 3 <> 0 AND doc_id % 8 = 1) AS parse_failed, count(*) FILTER (WHERE doc_id % 3 <> 0 AND doc_id % 10 = 4) AS mismatched, count(*) FILTER (WHERE doc_id % 3 = 0) AS missing FROM annotations GROUP BY language"
)
def label_coverage(spark, d):
    rows = annotations(spark, d).select("language", "doc_id")
    records = rows.filter("doc_id % 3 <> 0").select("doc_id", F.when(F.col("doc_id") % 8 == 1, "failed").otherwise("ok").alias("status"), (F.col("doc_id") % 10 != 4).alias("text_matches"))
    return labels.coverage(rows, records, ["doc_id"], "language")


VALUES = "least(4, floor(least(5.0::DOUBLE, greatest(0.0::DOUBLE, score_raw))))::INTEGER"


@query(
    f"{WITH}, s AS (SELECT d AS dimension, v::INTEGER AS value FROM unnest({NAMES}) t(d), range(0, 6) r(v)), c AS (SELECT dimension, {VALUES} AS value, count(*) AS n FROM scores GROUP BY ALL) SELECT dimension, value, coalesce(n, 0) AS n, greatest(0, 200 - coalesce(n, 0)) AS gap FROM s LEFT JOIN c USING (dimension, value)"
)
def gap_table(spark, d):
    long = scores(spark, d).select("dimension", T.score_bin(T.clip(F.col("score_raw"))).alias("value"))
    return labels.gap_table(long, NAMES, 200)


@query(f"{WITH} SELECT 'language' AS name, language AS value, count(*) AS n, count(*) FILTER (WHERE doc_id % 10 = 0) AS n_in_split FROM corpus GROUP BY ALL UNION ALL SELECT 'domain', domain, count(*), count(*) FILTER (WHERE doc_id % 10 = 0) FROM corpus GROUP BY ALL")
def composition_report(spark, d):
    return labels.composition(corpus_view(spark, d), ["language", "domain"], F.col("doc_id") % 10 == 0)


@query("SELECT (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS only_first, (SELECT count(DISTINCT doc_id) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS only_second, (SELECT count(DISTINCT doc_id) FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)) AS both")
def key_set_differences(spark, d):
    return labels.set_differences(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


# --- sampling and geometry -----------------------------------------------------------------------------------------------------------


@query(
    f"{WITH}, o AS (SELECT language, doc_id, char_len, {RANDOM} AS rn, coalesce(sum(char_len) OVER (PARTITION BY language ORDER BY sha256('42:' || language || ':' || doc_id), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM corpus), "
    "b AS (SELECT min(t) AS b FROM (SELECT sum(char_len) AS t FROM corpus GROUP BY language)) SELECT language, doc_id, rn::INTEGER AS rn FROM o, b WHERE before < b"
)
def balanced_char_sample(spark, d):
    return sampling.balanced_characters(corpus_view(spark, d).select("language", "doc_id", "text"), SEED).select("language", "doc_id", "rn")


@query(
    f"{WITH}, n AS (SELECT ceil(count(*) / 300.0)::INT AS n FROM corpus) SELECT doc_id, ((row_number() OVER (PARTITION BY language, domain ORDER BY sha256('42:' || language || '|' || domain || ':' || doc_id), doc_id) - 1) % n)::INTEGER AS batch FROM corpus, n"
)
def stratum_batches(spark, d):
    return sampling.batches(corpus_view(spark, d).select("doc_id", "language", "domain"), ["language", "domain"], SEED, 300).select("doc_id", "batch")


@query(
    f"{WITH}, h AS (SELECT language, domain, doc_id, sha256('42:bench:' || language || ':' || doc_id) AS h FROM corpus), c AS (SELECT *, row_number() OVER (PARTITION BY language, domain ORDER BY h, doc_id) > 1 AS later FROM h) SELECT language, domain, doc_id FROM c QUALIFY row_number() OVER (PARTITION BY language ORDER BY later, h, doc_id) <= 30"
)
def fixed_subset(spark, d):
    return sampling.fixed_subset(corpus_view(spark, d).select("language", "domain", "doc_id"), 30, SEED, "bench", "language", "doc_id", cover="domain")


@query(f"{WITH} SELECT doc_id, {RANDOM} <= 5 AS demo FROM corpus")
def benchmark_holdout(spark, d):
    return sampling.holdout(corpus_view(spark, d).select("language", "doc_id"), 5, SEED, "language", "doc_id").select("doc_id", "demo")


@query(
    f"{WITH}, o AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY language ORDER BY sha256('42:' || language || ':' || doc_id), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b FROM corpus) SELECT doc_id, b AS begin, (b // 1024)::BIGINT AS first_block, ((b + greatest(1, tokens) - 1) // 1024)::BIGINT AS last_block FROM o"
)
def pack_offsets(spark, d):
    return geometry.pack_streams(corpus_view(spark, d).select("language", "doc_id", "tokens"), 1024, SEED).select("doc_id", "begin", "first_block", "last_block")


@query(
    f"{WITH}, p AS (SELECT language, count(*) AS documents, sum(tokens) AS tokens, ceil(sum(tokens) / 1024.0)::BIGINT AS blocks FROM corpus GROUP BY language), r AS (SELECT coalesce(language, 'all') AS language, sum(documents)::BIGINT AS documents, sum(tokens)::BIGINT AS tokens, sum(blocks)::BIGINT AS blocks FROM p GROUP BY ROLLUP (language)) SELECT *, blocks * 1024 - tokens AS padding, tokens - blocks AS targets FROM r"
)
def pack_block_stats(spark, d):
    return geometry.block_stats(corpus_view(spark, d), 1024)


@query(
    f"{WITH}, n AS (SELECT doc_id, tokens, (1 + ceil(greatest(0, tokens - 512) / 256.0))::BIGINT AS n FROM corpus), w AS (SELECT doc_id, tokens, unnest(range(0, n)) AS w FROM n), "
    "x AS (SELECT doc_id, w AS \"window\", w * 256 AS b, least(tokens, w * 256 + 512) AS e, CASE WHEN w = 0 THEN 0 ELSE least(tokens, (w - 1) * 256 + 512) END AS pe FROM w) SELECT doc_id, count(*) AS windows, sum(greatest(0, e - greatest(b + 1, pe)))::BIGINT AS targets FROM x GROUP BY doc_id"
)
def sliding_window_targets(spark, d):
    wins = geometry.sliding_windows(corpus_view(spark, d).select("doc_id", "tokens"), 512, 256)
    return wins.groupBy("doc_id").agg(F.count("*").alias("windows"), F.sum("n_targets").alias("targets"))


@query(f"{WITH}, x AS (SELECT doc_id, tokens, unnest(range(0, greatest(1, ceil(tokens / 510.0)::BIGINT))) AS chunk FROM corpus) SELECT doc_id, chunk, least(510, tokens - chunk * 510)::BIGINT AS n_tokens FROM x")
def document_chunks(spark, d):
    return geometry.chunks(corpus_view(spark, d).select("doc_id", "tokens"), 512).select("doc_id", "chunk", "n_tokens")


@query(
    f"{WITH}, b AS (SELECT language, CASE WHEN char_len <= floor(lo) THEN 'short' WHEN char_len >= floor(h) THEN 'long' ELSE 'medium' END AS bucket FROM corpus, (SELECT floor(quantile_cont(char_len, 0.2)) AS lo, floor(quantile_cont(char_len, 0.8)) AS h FROM corpus) q2) SELECT language, bucket, count(*) AS n FROM b GROUP BY ALL"
)
def length_and_language_buckets(spark, d):
    rows = corpus_view(spark, d).select("language", "char_len")
    ends = rows.agg(F.floor(F.percentile("char_len", 0.2)).alias("lo"), F.floor(F.percentile("char_len", 0.8)).alias("hi"))  # one row
    found = T.bucket(F.col("char_len"), F.col("lo"), F.col("hi"), ("short", "medium", "long"))
    return rows.join(F.broadcast(ends)).groupBy("language", found.alias("bucket")).agg(F.count("*").alias("n"))


# --- benchmarks ----------------------------------------------------------------------------------------------------------------------

ITEMS = "items AS (SELECT conv_id, turn, role, length(text) AS n_chars, (conv_id * 7 + turn * 3) % 5 < 3 AS correct FROM conversations)"


def _items(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n_chars"), ((F.col("conv_id") * 7 + F.col("turn") * 3) % 5 < 3).alias("correct"))


@query(f"WITH {ITEMS} SELECT role, count(*) AS n, round(avg(correct::INT), 6) AS accuracy FROM items GROUP BY role")
def benchmark_accuracy(spark, d):
    return bench.accuracy(_items(spark, d), ["role"]).select("role", "n", six("accuracy", "accuracy"))


@query(f"WITH {ITEMS}, c AS (SELECT turn, role, count(*) AS n FROM items GROUP BY ALL) SELECT turn, round(max(n) / sum(n), 6) AS majority FROM c GROUP BY turn")
def majority_baseline(spark, d):
    return bench.majority_baseline(_items(spark, d), "turn", "role").select("turn", six("majority", "majority"))


@query(f"WITH {ITEMS} SELECT 'role' AS name, role AS value, count(*) AS n, round(avg(correct::INT), 6) AS mean FROM items GROUP BY role UNION ALL SELECT 'turn', turn::VARCHAR, count(*), round(avg(correct::INT), 6) FROM items GROUP BY turn")
def metric_breakdown(spark, d):
    return bench.breakdown(_items(spark, d), ["role", "turn"], "correct").select("name", "value", "n", six("mean", "mean"))


@query(f"WITH {ITEMS} SELECT role, count(*) AS n, round(avg(n_chars), 6) AS mean, round(stddev_samp(n_chars) / sqrt(count(*)), 6) AS stderr FROM items WHERE conv_id % 3 = 0 GROUP BY role")
def subset_rescore(spark, d):
    rows = _items(spark, d)
    return bench.rescored(rows, rows.filter("conv_id % 3 = 0"), "conv_id", ["role"], "n_chars").select("role", "n", six("mean", "mean"), six("stderr", "stderr"))


@query(
    f"WITH {ITEMS}, l AS (SELECT role, turn, avg(correct::INT) AS s FROM items GROUP BY ALL), p AS (SELECT role AS benchmark, avg(s) AS score FROM l GROUP BY role) SELECT benchmark, round(score, 6) AS score FROM p UNION ALL SELECT 'overall', round(avg(score), 6) FROM p WHERE benchmark IN ('user', 'assistant')"
)
def benchmark_macro(spark, d):
    rows = _items(spark, d).groupBy(F.col("role").alias("benchmark"), F.col("turn").alias("language")).agg(F.avg(F.col("correct").cast("double")).alias("score"))
    return bench.benchmark_macro(rows, ["user", "assistant"]).select("benchmark", six("score", "score"))


@query("SELECT epoch(time_bucket(INTERVAL 1 hour, ts))::BIGINT AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, d):
    rows = table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.unix_timestamp("w.start").alias("hour"), "event_type", "n", "total")


# --- report tables -------------------------------------------------------------------------------------------------------------------


@query(f"{WITH} SELECT language, count(*) AS docs, min(char_len)::INTEGER AS min_chars, median(char_len) AS median_chars, round(avg(char_len), 6) AS mean_chars, max(char_len)::INTEGER AS max_chars FROM corpus GROUP BY language")
def corpus_summary(spark, d):
    return tables.corpus_summary(corpus_view(spark, d)).withColumn("mean_chars", six("mean_chars", "mean_chars"))


@query(f"{WITH} SELECT language, doc_id FROM corpus QUALIFY row_number() OVER (PARTITION BY language ORDER BY doc_id) <= 25")
def first_n_per_language(spark, d):
    return tables.first_n(corpus_view(spark, d).select("language", "doc_id"), 25, "language", "doc_id")


@query(f"{WITH} SELECT doc_id, text_hash FROM corpus WHERE doc_id NOT IN (SELECT doc_id FROM annotations) AND text_hash NOT IN (SELECT text_hash FROM annotations)")
def exclude_annotated(spark, d):
    rows, known = corpus_view(spark, d).select("doc_id", "text_hash"), annotations(spark, d)
    return tables.exclude(rows, known, known).select("doc_id", "text_hash")


@query("SELECT count(*) FILTER (WHERE l.doc_id IS NULL) AS missing FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id")
def join_missing_count(spark, d):
    return tables.join_counting_missing(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), ["doc_id"])[1]


@query(f"{WITH}, a AS (SELECT language, CASE WHEN doc_id % 4 = 0 THEN 'missing' END AS reason, human AS value, CASE doc_id % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS split FROM annotations) SELECT language, count(*) FILTER (WHERE reason IS NULL) AS valid, count(*) FILTER (WHERE reason IS NOT NULL) AS excluded, count(*) FILTER (WHERE reason IS NULL AND split = 'train') AS n_train, count(*) FILTER (WHERE reason IS NULL AND split = 'validation') AS n_validation, count(*) FILTER (WHERE reason IS NULL AND split = 'test') AS n_test, round(avg(value) FILTER (WHERE reason IS NULL), 6) AS mean, round(stddev_pop(value) FILTER (WHERE reason IS NULL), 6) AS sd FROM a GROUP BY language")
def quality_report(spark, d):
    split_of = F.when(F.col("doc_id") % 10 == 0, "test").when(F.col("doc_id") % 10 == 1, "validation").otherwise("train")
    rows = annotations(spark, d).select("language", F.when(F.col("doc_id") % 4 == 0, "missing").alias("reason"), F.col("human").alias("value"), split_of.alias("split"))
    out = tables.quality_report(rows, ["language"])
    return out.select("language", "valid", "excluded", "n_train", "n_validation", "n_test", six("mean", "mean"), six("sd", "sd"))


@query(f"{WITH}, r AS (SELECT language, quality AS gold, (doc_id % 2)::INTEGER AS predicted FROM annotations), l AS (SELECT language, gold, predicted, unnest(list_distinct([gold, predicted])) AS label FROM r), p AS (SELECT language, label, count(*) FILTER (WHERE gold = label AND predicted = label) AS tp, count(*) FILTER (WHERE gold = label) AS n, count(*) FILTER (WHERE predicted = label) AS p FROM l GROUP BY ALL), f AS (SELECT *, coalesce(2.0::DOUBLE * tp / nullif(n + p, 0), 0) AS f1 FROM p) SELECT language, round(avg(f1), 6) AS macro_f1, round(sum(f1 * n) / sum(n), 6) AS weighted_f1 FROM f GROUP BY language")
def f1_scores(spark, d):
    rows = annotations(spark, d).select("language", F.col("quality").cast("int").alias("gold"), (F.col("doc_id") % 2).cast("int").alias("predicted"))
    return tables.f1_scores(rows, "language").select("language", six("macro_f1", "macro_f1"), six("weighted_f1", "weighted_f1"))


@query(f"{WITH} SELECT 'test' AS split, 3 AS epoch, language, unnest(['docs', 'tokens']) AS metric, unnest([count(*)::DOUBLE, sum(tokens)::DOUBLE]) AS value FROM corpus GROUP BY language")
def log_rows(spark, d):
    rows = corpus_view(spark, d).groupBy("language").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens"))
    return tables.log_rows(rows, ["docs", "tokens"], {"split": "test", "epoch": 3})


RUN_NO = "CASE dimension " + " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(NAMES)) + " END"


@query(f"{WITH}, r AS (SELECT {RUN_NO} AS run_no, CASE WHEN dimension IN ('edu', 'style') THEN 'a' ELSE 'b' END AS tokenizer, language, avg(score_raw) AS loss FROM scores GROUP BY ALL) SELECT run_no, tokenizer, language, round(loss, 6) AS loss, tokenizer = 'a' AS same_tokenizer, round(loss - first_value(loss) OVER (PARTITION BY language ORDER BY run_no), 6) AS delta FROM r")
def compare_runs(spark, d):
    rows = scores(spark, d).groupBy("dimension", "language").agg(F.avg("score_raw").alias("loss"))
    rows = rows.select(F.expr(RUN_NO).alias("run_no"), F.when(F.col("dimension").isin("edu", "style"), "a").otherwise("b").alias("tokenizer"), "language", "loss")
    return tables.compare_runs(rows, "loss").select("run_no", "tokenizer", "language", six("loss", "loss"), "same_tokenizer", six("delta", "delta"))


@query(r"SELECT doc_id, length(text)::INTEGER AS chars, strlen(text)::INTEGER AS bytes, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))::INTEGER AS words FROM documents")
def text_measures(spark, d):
    return table(spark, d, "documents").select("doc_id", *tables.text_measures(F.col("text")))


@query("SELECT q.conv_id, q.turn, length(q.text)::INTEGER AS asked, length(a.text)::INTEGER AS answered FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user' AND a.role = 'assistant'")
def aligned_turns(spark, d):
    turns = table(spark, d, "conversations")
    q = turns.filter("role = 'user'").select("conv_id", "turn", F.length("text").alias("asked"))
    a = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.length("text").alias("answered"))
    keys = tables.in_all([q, a], ["conv_id", "turn"])
    return tables.aligned_pairs(q.join(keys, ["conv_id", "turn"], "left_semi"), a.join(keys, ["conv_id", "turn"], "left_semi"), ["conv_id", "turn"])


@query(f"{WITH} SELECT domain FROM corpus GROUP BY domain HAVING count(DISTINCT language) = (SELECT count(DISTINCT language) FROM corpus)")
def domains_in_every_language(spark, d):
    return sampling.complete_everywhere(corpus_view(spark, d), "domain", "language")


@query(f"{WITH}, {EDU}, w AS (SELECT *, 0.5::DOUBLE + least(5.0::DOUBLE, greatest(0.0::DOUBLE, score_raw)) * 0.2::DOUBLE AS weight FROM edu) SELECT language, count(*) AS documents, sum(tokens)::BIGINT AS tokens, ceil(sum(tokens) / 1024.0)::BIGINT AS blocks, round(sum(tokens * weight) / sum(tokens), 6) AS mean_weight FROM w GROUP BY language")
def weighted_block_stats(spark, d):
    rows = edu(spark, d).withColumn("weight", T.score_to_weight(T.clip(F.col("score_raw"))))
    return geometry.weighted_block_stats(rows, 1024, "weight").select("language", "documents", "tokens", "blocks", six("mean_weight", "mean_weight"))


#: Rows that a regression head is fitted to, those of smallest id hash.
HEAD_SAMPLE = 2000


@query()
def embedding_head(spark, d):
    """A head fitted to the label on a sample of at most HEAD_SAMPLE rows, applied to all."""
    rows = table(spark, d, "embeddings").select("vec_id", "embedding", "label")
    got = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(HEAD_SAMPLE).orderBy("vec_id").toPandas()
    x, y = np.stack(got["embedding"].to_numpy()).astype(float), got["label"].to_numpy(float)
    held = got["vec_id"].to_numpy() % 5 == 0
    head = models.train_head(x[~held], y[~held], y[~held], (x[held], y[held], y[held]), hidden=32, epochs=10)
    return models.predict(rows, head, "embedding").select("vec_id", "label", "raw")


@query()
def document_embeddings(spark, d):
    return embedding.embed(table(spark, d, "documents").select("doc_id", "text"))


from . import catalog_files as _files  # noqa: E402, F401  both register their queries here
from . import catalog_small as _small  # noqa: E402, F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection_token_budget(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
