"""The queries opN_<name> over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language, late, lexical, line_dedup, mixing, packing, pages, sharding, simhash, substring, token_files, vectors
from .common import Scratch, load

#: Production parameters of the queries.
LINE_MIN_DOCS, LINE_MIN_CHARS = 5, 40
SIMHASH_WORDS, SIMHASH_RADIUS = 3, 3
WINDOW_WORDS = 35
SHARD_BYTES = 1 << 20
#: Shares of tokens by domain.
TARGET_WEIGHTS = {"good": 0.9, "low": 0.08, "toxic": 0.02}
NEAREST, NEAREST_EVERY = 10, 100
PRODUCTS, PRODUCTS_EVERY, PRODUCTS_SCALE = 20, 20, 64
TOKENS_END = 2
BEST_DOCUMENTS = 20
#: Files of a layout hold one row more than this part of the table; sales that arrived before the microsecond are early.
LAYOUT_PARTS, EARLY_END = 900, 1_709_251_200_000_000
SALES = late.Keys("sale_id", "sold_at", "arrived_at")


def tokenizer_files() -> tuple[str, str]:
    """Rank file and split pattern of the 50k byte-level vocabulary; the place is a parameter of the installed tokenizer package."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


def op1_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.nearest(Scratch(spark), load(spark, sf_dir, "embeddings"), NEAREST_EVERY, NEAREST)


def op2_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(load(spark, sf_dir, "pages"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    index = line_dedup.build(scratch, docs, LINE_MIN_DOCS, LINE_MIN_CHARS)
    out = line_dedup.apply(scratch, index, docs)
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def line_dedup_reversible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without labels, then those with labels inserted, then the toxic ones deleted again; applied to those that are left."""
    scratch = Scratch(spark)
    docs, labels = load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "labels")
    marked, toxic = labels.select("doc_id"), labels.filter("toxic = 1").select("doc_id")
    index = line_dedup.build(scratch, docs.join(marked, "doc_id", "left_anti"), LINE_MIN_DOCS, LINE_MIN_CHARS)
    index = line_dedup.insert(scratch, index, docs.join(marked, "doc_id", "left_semi"))
    index = line_dedup.delete(scratch, index, toxic)
    out = line_dedup.apply(scratch, index, docs.join(toxic, "doc_id", "left_anti"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op4_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.dedup(Scratch(spark), load(spark, sf_dir, "documents"), WINDOW_WORDS)
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(Scratch(spark), load(spark, sf_dir, "documents"), SIMHASH_WORDS, SIMHASH_RADIUS)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.train(language.sample(docs))
    out = language.predict(docs.select("doc_id", "text"), model)
    return out.select("row.doc_id", language.held_out("row.doc_id").alias("held_out"), "lang_pred", "score")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.extendible_shards(Scratch(spark), load(spark, sf_dir, "documents"), SHARD_BYTES)
    return out.select(F.col("id").alias("doc_id"), "shard", F.col("depth").cast("long").alias("depth"), "bytes", "shard_bytes")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = mixing.quality_domains(load(spark, sf_dir, "labels"))
    mixed = mixing.mix(Scratch(spark), load(spark, sf_dir, "documents"), labels, TARGET_WEIGHTS)
    return mixed.members.withColumn("missed", F.lit(mixed.missed)).withColumn("residual", F.lit(mixed.residual))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = tokenizer_files()
    cut = packing.pieces(load(spark, sf_dir, "documents"), ranks, pattern)
    return packing.pack(Scratch(spark), cut)


def op10_exact_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.exact_top(Scratch(spark), load(spark, sf_dir, "embeddings"), PRODUCTS_EVERY, PRODUCTS, PRODUCTS_SCALE)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(Scratch(spark), load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"), BEST_DOCUMENTS)


def sales_with_copies(sales: DataFrame) -> DataFrame:
    """All sales, and later copies of some: another total, perhaps another day."""
    h = F.crc32(F.col("sale_id").cast("string").cast("binary"))
    again = sales.filter((h % 3 == 0) & (late.day_of(sales, "sold_at") % 10 == 0))
    days = lambda n: F.make_dt_interval(n.cast("int"))
    again = again.select(*[{"total": F.col("total") + 1, "sold_at": F.col("sold_at") + days(h % 2), "arrived_at": F.col("arrived_at") + days(1 + h % 97)}.get(c, F.col(c)).alias(c) for c in sales.columns])
    return sales.unionByName(again)


def op12_late_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, sales = Scratch(spark), load(spark, sf_dir, "sales")
    size, root = 1 + sales.count() // LAYOUT_PARTS, f"{scratch.kept()}/sales"
    rows = sales_with_copies(sales)
    early = F.coalesce(late.micros(rows, SALES.arrival) < EARLY_END, F.lit(False))
    late.write_layout(rows.filter(early), root, SALES, size)
    dirty = late.overwrite(scratch, root, rows.filter(~early), SALES, size)
    days = rows.select(late.day_of(rows, SALES.time).alias("day")).distinct()
    return late.describe(scratch, root, days, SALES, "total").join(dirty.withColumn("_dirty", F.lit(True)), "day", "left").withColumn("rewritten", F.coalesce("_dirty", F.lit(False))).drop("_dirty")


def op13_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    scratch = Scratch(spark)
    made = token_files.write(scratch, load(spark, sf_dir, "documents"), f"{scratch.kept()}/token_files", str(public_tokenizers.path("word_bpe_49k.json")), TOKENS_END)
    return token_files.read(made)


OP3_SQL = r"""
WITH doc AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS no FROM documents),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM doc),
shared AS (SELECT k, max(doc_id) AS keep FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT doc_id, no, line, s.k IS NOT NULL AND doc_id <> s.keep AS gone FROM keyed LEFT JOIN shared s ON keyed.k = s.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

LINE_DEDUP_REVERSIBLE_SQL = OP3_SQL.replace("FROM documents)", "FROM documents ANTI JOIN (SELECT doc_id FROM labels WHERE toxic = 1) USING (doc_id))")

OP4_SQL = rf"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW_WORDS} + 2)) AS i FROM d),
win AS (SELECT doc_id, i, array_to_string(w[i : i + {WINDOW_WORDS} - 1], ' ') AS s FROM places),
again AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, i + o AS p FROM win SEMI JOIN again USING (s), range(0, {WINDOW_WORDS}) t(o)),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, count(g.p) AS r, string_agg(word, ' ' ORDER BY p) FILTER (WHERE g.p IS NULL) AS k FROM words LEFT JOIN gone g USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(r, 0)::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

OP7_SQL = f"""
WITH hashed AS (
  SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 15))::BIGINT AS h, coalesce(strlen(text), 0) + {sharding.ROW_BYTES} AS bytes FROM documents),
deep AS (SELECT doc_id, h, bytes, d, h >> (60 - d) AS p FROM hashed, range(0, 25) t(d)),
sums AS (SELECT d, p, sum(bytes) AS b FROM deep GROUP BY ALL),
leaf AS (SELECT doc_id, h, a.bytes, min(d) AS depth FROM deep a JOIN sums USING (d, p) WHERE b <= {SHARD_BYTES} GROUP BY doc_id, h, a.bytes)
SELECT doc_id, CASE WHEN depth = 0 THEN '' ELSE right(repeat('0', 60) || bin(h >> (60 - depth)), depth::INT) END AS shard, depth::BIGINT AS depth, bytes::BIGINT AS bytes, b::BIGINT AS shard_bytes
FROM leaf JOIN sums ON sums.d = depth AND sums.p = h >> (60 - depth)
"""


OP10_SQL = f"""
WITH v AS (SELECT row_number() OVER () AS no, vec_id, list_transform(embedding, lambda x: floor({PRODUCTS_SCALE} * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
scored AS (SELECT q.no, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {PRODUCTS_EVERY} = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY no ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= {PRODUCTS}
"""


OP11_SQL = rf"""
WITH doc AS (SELECT row_number() OVER () AS no, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
whole AS (SELECT count(*) FILTER (len(ts) > 0) AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM doc),
item AS (SELECT DISTINCT item_id, text FROM benchmark),
asked AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM item),
often AS (SELECT item_id, t, count(*) AS q FROM asked GROUP BY ALL),
word AS (SELECT no, doc_id, len(ts) AS n, unnest(ts) AS t FROM doc),
tf AS (SELECT no, doc_id, n, t, count(*) AS tf FROM word SEMI JOIN often USING (t) GROUP BY ALL),
df AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, whole GROUP BY t, n_docs),
scored AS (SELECT item_id, no, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * n_docs) // n_terms)))))::BIGINT AS score
           FROM tf JOIN df USING (t) JOIN often USING (t), whole GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= {BEST_DOCUMENTS}
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_permutation_index, op2_page_differencing, op3_line_dedup, line_dedup_reversible, op4_fm_index, op5_simhash, op6_language, op7_sharding, op8_mixing, op9_packing, op10_exact_top, op11_lexical_search, op12_late_overwrite, op13_token_blocks)}


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": OP3_SQL, "line_dedup_reversible": LINE_DEDUP_REVERSIBLE_SQL, "op4_fm_index": OP4_SQL, "op7_sharding": OP7_SQL, "op10_exact_top": OP10_SQL, "op11_lexical_search": OP11_SQL}
