"""Named queries of readers and sinks: the driver's tables are written to new files in the shared folder and read back."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from .catalog import query, six
from .operators import corpus, generation, labels, metrics, models, ngram_lm, tables
from .plans.views import SQL_SCORES, table
from .plans.views import scores as scores_view
from .plans.written import new_folder
from .sources import readers, row_groups, sinks, snapshots

#: File name prefixes of languages; files of other prefixes, and checkpoints, are skipped.
PREFIXES = {"en": "eng", "es": "spa", "fr": "fra"}
BLOCK_ROWS = 1000


def docs(spark, d):
    return table(spark, d, "documents")


# --- readers -------------------------------------------------------------------------------------------------------------------------


@query("SELECT doc_id::VARCHAR AS doc_id, lang AS language, sha256(coalesce(text, '')) AS digest FROM documents")
def csv_language_files(spark, d):
    """Files <language>-<number>_docs.csv of quoted, multi-line texts; `source` is no field and is dropped by the sink's order."""
    folder = new_folder(spark)
    sinks.write_named(docs(spark, d).select("doc_id", "text", "lang"), folder, "lang", "_docs.csv")
    rows = readers.language_files(spark, f"{folder}/*_docs.csv", "_docs.csv", "doc_id string, text string")
    return rows.select("doc_id", "language", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))


@query("SELECT doc_id::VARCHAR AS doc_id, 'café ' || source || '–' AS text FROM documents")
def csv_with_legacy_bytes(spark, d):
    """Files in which 0x96 is a dash, as code page 1252 has it."""
    folder = new_folder(spark)
    rows = docs(spark, d).select("doc_id", F.concat(F.lit("café "), F.col("source"), F.lit("\x96")).alias("text"))
    rows.write.options(**sinks.EXACT, encoding="ISO-8859-1").csv(folder)
    return readers.csv_with_fallback(spark, folder, "doc_id string, text string")


@query(
    "WITH x AS (SELECT lang, CASE WHEN doc_id % 5 = 0 THEN lang || '_checkpoint' ELSE lang || '_a' END AS file, count(*) AS n FROM documents GROUP BY ALL) "
    "SELECT 'documents' AS kind, CASE lang WHEN 'en' THEN 'eng' WHEN 'es' THEN 'spa' WHEN 'fr' THEN 'fra' END AS name, n FROM x WHERE lang IN ('en', 'es', 'fr') AND file NOT LIKE '%checkpoint' "
    "UNION ALL SELECT 'skipped', file, 0 FROM x WHERE lang NOT IN ('en', 'es', 'fr') OR file LIKE '%checkpoint'"
)
def json_lines_by_prefix(spark, d):
    """JSON lines with blank ones between, in files of known and unknown prefixes and of checkpoints."""
    folder, whole = new_folder(spark), docs(spark, d)
    name = F.concat("lang", F.when(F.col("doc_id") % 5 == 0, "_checkpoint").otherwise("_a"))
    line = F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), F.lit("ok").alias("parse_status"), "text"))
    lines = whole.select(F.explode(F.array(line, F.lit("  "))).alias("value"), name.alias("name"))
    sinks.write_named(lines, folder, "name", ".jsonl", "text")
    found, skipped = readers.llm_documents(spark, f"{folder}/*.jsonl", PREFIXES)
    kept = found.groupBy(F.lit("documents").alias("kind"), F.col("language").alias("name")).agg(F.count("id").alias("n"))
    return kept.unionByName(skipped.select(F.lit("skipped").alias("kind"), F.col("file").alias("name"), F.lit(0).cast("long").alias("n")))


@query("SELECT doc_id, n_chars FROM documents WHERE length(text) >= 500")
def pruned_pool_scan(spark, d):
    return readers.parquet(spark, f"{d}/documents.parquet", 500, ["doc_id", "n_chars"])


@query("SELECT doc_id, coalesce(CASE WHEN doc_id % 3 > 0 THEN doc_id / 7.0::DOUBLE END, -1) AS score FROM documents WHERE length(text) >= 500")
def scored_texts(spark, d):
    """A scored stream where a third has no score, which is NaN there."""
    folder = new_folder(spark)
    docs(spark, d).select("doc_id", "text", F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") / F.lit(7.0)).alias("score")).write.parquet(folder)
    rows = readers.scored_stream(spark, folder, "score")
    return rows.select("doc_id", F.when(F.isnan("score"), F.lit(-1.0)).otherwise(F.col("score")).alias("score"))


@query(
    f"WITH {SQL_SCORES} SELECT language, doc_id::VARCHAR AS doc_id, round(score_raw, 6) AS score_raw, round(least(5.0::DOUBLE, greatest(0.0::DOUBLE, score_raw)), 6) AS score "
    "FROM scores WHERE dimension = 'edu' AND language <> 'de'"
)
def score_files(spark, d):
    """Two folders of score files, one without a language; scores, raw and clipped, of the languages that both have, by (language, doc_id)."""
    first, second = new_folder(spark), new_folder(spark)
    rows = scores_view(spark, d).filter("dimension = 'edu'")
    for folder, some in ((first, rows), (second, rows.filter("language != 'de'"))):
        six_digits = sinks.formatted_scores(some).select("doc_id", "language", "score_raw", "score", F.lit("7").alias("rater_tokens"), F.col("language").alias("_file"))
        sinks.write_named(six_digits, folder, "_file", "_scores.csv")
    both = tables.in_all([readers.scores(spark, f"{x}/*_scores.csv").select("language") for x in (first, second)], ["language"])
    names = [r["language"] for r in both.collect()]  # a name a language
    clipped = readers.scores_of(spark, f"{first}/*_scores.csv", names)
    return readers.scores(spark, f"{first}/*_scores.csv").join(clipped, ["language", "doc_id"])


@query("SELECT vec_id, len(embedding)::INTEGER AS size FROM embeddings")
def embedding_cache(spark, d):
    folder = new_folder(spark)
    table(spark, d, "embeddings").select("vec_id", "embedding").write.parquet(folder)
    return readers.embeddings(spark, folder, ["vec_id"], "embedding").select("vec_id", F.size("embedding").alias("size"))


@query("SELECT 'bench_' || lang AS task, doc_id AS id, (doc_id % 2)::DOUBLE AS acc FROM documents")
def benchmark_sample_files(spark, d):
    """Nested samples in files samples_<task>_<date>; the task is in the name."""
    folder = new_folder(spark)
    rows = docs(spark, d).select(F.struct(F.col("doc_id").alias("id"), "lang").alias("doc"), (F.col("doc_id") % 2).cast("double").alias("acc"), F.concat(F.lit("samples_bench_"), "lang", F.lit("_2024-05-01T10-00-00")).alias("name"))
    sinks.write_named(rows, folder, "name", ".jsonl", "json")
    return readers.benchmark_samples(spark, f"{folder}/*.jsonl", "doc struct<id:long,lang:string>, acc double").select("task", "doc.id", "acc")


@query("SELECT doc_id::VARCHAR AS doc_id, sha256(text) AS digest FROM documents WHERE text IS NOT NULL")
def numbered_lines_joined(spark, d):
    """Two folders of parallel text files, joined line by line."""
    rows = docs(spark, d).filter("text is not null").select("doc_id", F.sha2("text", 256).alias("digest"), F.floor(F.col("doc_id") / BLOCK_ROWS).alias("part"))
    rows = rows.repartition("part").sortWithinPartitions("part", "doc_id")
    sides = []
    for column in ("doc_id", "digest"):
        folder = new_folder(spark)
        sinks.write_named(rows.select(F.col(column).cast("string").alias("value"), "part"), folder, "part", ".txt", "text")
        lines = readers.numbered_lines(spark, f"{folder}/*.txt")
        sides.append(lines.select(F.concat_ws(":", F.regexp_extract("file", r"([^/]+)$", 1), F.col("line_no")).alias("at"), F.col("line").alias(column)))
    return labels.positional_join(*sides, "at").select("doc_id", "digest")


def row_group_sample(spark, d):
    """A tenth of the documents from the row groups that it takes, and no others."""
    folder = new_folder(spark)
    rows = docs(spark, d).select("doc_id", "lang", "text")
    rows.write.option("parquet.block.size", 256 << 10).parquet(folder)
    drawn, _ = row_groups.random_rows(spark, folder, rows.count() // 10, 42, "all", ["doc_id", "lang"])
    return drawn


query(name="row_group_sample")(row_group_sample)


# --- sinks ---------------------------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id // {BLOCK_ROWS} AS part, sum(length(doc_id::VARCHAR) + 1)::BIGINT AS bytes, sha256(string_agg(doc_id::VARCHAR, chr(10) ORDER BY doc_id) || chr(10)) AS sha256 FROM documents GROUP BY 1")
def file_inventory(spark, d):
    folder = new_folder(spark)
    rows = docs(spark, d).select(F.col("doc_id").cast("string").alias("value"), F.floor(F.col("doc_id") / BLOCK_ROWS).alias("part"), "doc_id")
    rows = rows.repartition("part").sortWithinPartitions("part", "doc_id").drop("doc_id")
    sinks.write_named(rows, folder, "part", ".txt", "text")
    return sinks.manifest(spark, folder, "*.txt").select(F.regexp_extract("path", r"([^/]+)-\d{5}\.txt$", 1).cast("long").alias("part"), "bytes", "sha256")


@query("SELECT event_id AS step, value FROM events WHERE event_id <= 500 UNION ALL SELECT event_id + 450, value * 2 FROM events WHERE event_id + 450 > 500")
def resumed_step_log(spark, d):
    """A log that a resumed run goes on from step 500; what the old one wrote beyond is dropped."""
    rows = table(spark, d, "events").select(F.col("event_id").alias("step"), "value")
    new = rows.select((F.col("step") + 450).alias("step"), (F.col("value") * 2).alias("value")).filter("step > 500")
    return sinks.resumed_log(rows, new, 500)


@query("SELECT doc_id, lang FROM documents")
def written_once(spark, d):
    """A table that is written, found complete and left as it is the second time, though the rows given then are others."""
    folder, rows = new_folder(spark), docs(spark, d).select("doc_id", "lang")
    n = rows.count()
    sinks.write_once(rows, folder, n)
    return sinks.write_once(rows.withColumn("lang", F.lit("other")), folder, n)


@query("SELECT row_number() OVER (ORDER BY doc_id) AS ordinal, doc_id FROM documents QUALIFY ordinal <= (SELECT count(*) // 2 FROM documents)")
def truncated_extraction(spark, d):
    rows = corpus.numbered_rows(docs(spark, d).select("doc_id"), "doc_id")
    return corpus.truncate(rows, rows.count() // 2)


@query("SELECT doc_id, lang, n_chars FROM documents")
def fetched_release(spark, d):
    """A release published twice, the second time with a column fewer and back, downloaded by its manifest and read."""
    source, folder, target, rows = new_folder(spark), new_folder(spark), new_folder(spark), docs(spark, d).select("doc_id", "lang", "n_chars")
    rows.write.parquet(source)
    first = snapshots.publish(spark, source, folder, rows.columns, {"no id": F.col("doc_id").isNull()})
    rows.drop("n_chars").write.mode("overwrite").parquet(source)
    snapshots.publish(spark, source, folder, rows.columns)
    snapshots.point(folder, first)
    snapshots.fetch(spark, folder, target).write.format("noop").mode("overwrite").save()
    return spark.read.parquet(target)


@query(
    "SELECT doc_id::VARCHAR AS id, CASE WHEN length(coalesce(text, '')) % 11 = 0 OR length(coalesce(text, '')) % 13 = 0 THEN 'failed' ELSE 'ok' END AS parse_status, "
    "CASE WHEN length(coalesce(text, '')) % 11 > 0 AND length(coalesce(text, '')) % 13 > 0 THEN (length(coalesce(text, '')) % 6)::INTEGER END AS edu, CASE WHEN length(coalesce(text, '')) % 11 = 0 THEN 'ValueError: no answer' END AS error FROM documents"
)
def recorded_answers(spark, d):
    """An answerer that fails for some prompts and gives what can't be read for others, asked in two calls over one record."""
    folder = new_folder(spark)
    items = docs(spark, d).select(F.col("doc_id").cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("prompt"))

    def load():
        def ask(prompt):
            if len(prompt) % 11 == 0:
                raise ValueError("no answer")
            return "nothing" if len(prompt) % 13 == 0 else json.dumps({"edu": len(prompt) % 6})

        return ask

    models.score_batch(items.filter(F.col("id").cast("long") % 2 == 0), load, ["edu"], folder, 2, 0.0)
    return models.score_batch(items, load, ["edu"], folder, 2, 0.0).select("id", "parse_status", "edu", "error")


# --- generated text ------------------------------------------------------------------------------------------------------------------

TURNS = "q AS (SELECT a.role, a.text AS a, b.text AS b, row_number() OVER () AS id FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)"
_COUNTS = (
    "p AS (SELECT role, id, kind, n, gram, count(*) FILTER (WHERE side = 'm') AS m, count(*) FILTER (WHERE side = 'w') AS w FROM g GROUP BY ALL), "
    "s AS (SELECT role, kind, n, sum(m)::DOUBLE AS m, sum(w)::DOUBLE AS w, sum(least(m, w))::DOUBLE AS c FROM p GROUP BY ALL)"
)


def _grams(side: str, items: str, source: str = "i") -> str:
    return f"SELECT role, id, kind, n, '{side}' AS side, array_to_string({items}[k : k + n - 1], chr(31)) AS gram FROM (SELECT *, unnest(range(1, len({items}) - n + 2)) AS k FROM {source})"


def _turns(spark, d):
    turns = table(spark, d, "conversations")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reference"))
    return turns.select("conv_id", "turn", "role", F.col("text").alias("hypothesis")).join(after, ["conv_id", "turn"])


@query(
    f"WITH {TURNS}, i AS (SELECT role, id, 't' AS kind, n, string_split(a, ' ') AS h, string_split(b, ' ') AS r FROM q, (SELECT unnest([1, 2, 3, 4]) AS n)), g AS ({_grams('m', 'h')} UNION ALL {_grams('w', 'r')}), {_COUNTS}, "
    "t AS (SELECT role, CASE WHEN count(*) = 4 AND min(c) > 0 THEN exp(avg(ln(greatest(c, 1e-9) / greatest(m, 1)))) ELSE 0 END AS p, max(m) FILTER (WHERE n = 1) AS m, max(w) FILTER (WHERE n = 1) AS w FROM s GROUP BY role) "
    "SELECT role, round(100 * p * CASE WHEN m >= w THEN 1 ELSE exp(1 - w / m) END, 6) AS bleu FROM t"
)
def generation_bleu(spark, d):
    pairs = _turns(spark, d).select("role", F.split("hypothesis", " ").alias("hypothesis"), F.split("reference", " ").alias("reference"))
    return generation.bleu(pairs, ["role"]).select("role", six("bleu", "bleu"))


@query(
    rf"WITH {TURNS}, c AS (SELECT role, id, 'c' AS kind, n, list_filter(string_split(regexp_replace(a, '\s+', '', 'g'), ''), lambda x: x <> '') AS h, list_filter(string_split(regexp_replace(b, '\s+', '', 'g'), ''), lambda x: x <> '') AS r FROM q, (SELECT unnest([1, 2, 3, 4, 5, 6]) AS n)), "
    r"v AS (SELECT role, id, 'w' AS kind, n, list_filter(regexp_split_to_array(a, '\s+'), lambda x: x <> '') AS h, list_filter(regexp_split_to_array(b, '\s+'), lambda x: x <> '') AS r FROM q, (SELECT unnest([1, 2]) AS n)), "
    f"i AS (SELECT * FROM c UNION ALL SELECT * FROM v), g AS ({_grams('m', 'h')} UNION ALL {_grams('w', 'r')}), {_COUNTS}, "
    "f AS (SELECT role, coalesce(c / nullif(m, 0), 0) AS p, coalesce(c / nullif(w, 0), 0) AS r FROM s) SELECT role, round(100 * avg(coalesce(5 * p * r / nullif(4 * p + r, 0), 0)), 6) AS chrf FROM f GROUP BY role"
)
def generation_chrf(spark, d):
    return generation.chrf(_turns(spark, d), ["role"]).select("role", six("chrf", "chrf"))


# --- a language model of counts ------------------------------------------------------------------------------------------------------

HELD_OUT, CONTEXT_TOKENS = 10, 24
_WORDS = r"regexp_extract_all(lower(coalesce({x}, '')), '[\p{{L}}\p{{M}}\p{{Nd}}]+')"
_TRIPLES = "unnest(range(1, len(p) - 1)) AS i, p"
_MODEL = (
    f"td AS (SELECT doc_id, ['<s>', '<s>'] || {_WORDS.format(x='text')} || ['</s>'] AS p FROM documents WHERE doc_id % {HELD_OUT} <> 0), "
    f"tt AS (SELECT p[i] AS u, p[i + 1] AS v, p[i + 2] AS w FROM (SELECT {_TRIPLES} FROM td)), "
    "t3 AS MATERIALIZED (SELECT u, v, w, count(*) AS c FROM tt GROUP BY ALL), c3 AS MATERIALIZED (SELECT u, v, sum(c) AS total, count(*) AS types FROM t3 GROUP BY ALL), "
    "t2 AS MATERIALIZED (SELECT v, w, count(*) AS c FROM t3 GROUP BY ALL), c2 AS MATERIALIZED (SELECT v, sum(c) AS total, count(*) AS types FROM t2 GROUP BY ALL), "
    "t1 AS MATERIALIZED (SELECT w, count(*) AS c FROM t2 GROUP BY ALL), c0 AS (SELECT sum(c) AS total, count(*) AS types FROM t1), "
)
_PROBABILITY = (
    "pp AS MATERIALIZED (SELECT q.u, q.v, q.w, coalesce(greatest(t1.c - 0.75::DOUBLE, 0) / c0.total, 0) + 0.75::DOUBLE * c0.types / c0.total / (c0.types + 1) AS p1, coalesce(greatest(t2.c - 0.75::DOUBLE, 0) / c2.total, 0) AS k2, 0.75::DOUBLE * c2.types / c2.total AS b2, "
    "coalesce(greatest(t3.c - 0.75::DOUBLE, 0) / c3.total, 0) AS k3, 0.75::DOUBLE * c3.types / c3.total AS b3 FROM (SELECT DISTINCT u, v, w FROM asked) q LEFT JOIN t3 USING (u, v, w) LEFT JOIN c3 USING (u, v) LEFT JOIN t2 ON t2.v = q.v AND t2.w = q.w LEFT JOIN c2 ON c2.v = q.v LEFT JOIN t1 ON t1.w = q.w, c0), "
    "pr AS (SELECT u, v, w, CASE WHEN b3 IS NULL THEN p2 ELSE k3 + b3 * p2 END AS p FROM (SELECT *, CASE WHEN b2 IS NULL THEN p1 ELSE k2 + b2 * p1 END AS p2 FROM pp)) "
)


def _model(spark, d):
    return ngram_lm.train(docs(spark, d).filter(F.col("doc_id") % HELD_OUT != 0).select("text"))


@query(
    f"WITH {_MODEL} hd AS (SELECT lang, ['<s>', '<s>'] || {_WORDS.format(x='text')} || ['</s>'] AS p FROM documents WHERE doc_id % {HELD_OUT} = 0), "
    f"asked AS MATERIALIZED (SELECT lang, p[i] AS u, p[i + 1] AS v, p[i + 2] AS w FROM (SELECT lang, {_TRIPLES} FROM hd)), {_PROBABILITY}, "
    "l AS (SELECT lang AS language, sum(-ln(p)) / count(*) AS loss, count(*)::BIGINT AS targets FROM asked JOIN pr USING (u, v, w) GROUP BY lang), "
    "x AS (SELECT * FROM l UNION ALL SELECT 'macro', avg(loss), sum(targets)::BIGINT FROM l UNION ALL SELECT 'token_weighted', sum(loss * targets) / sum(targets), sum(targets)::BIGINT FROM l) "
    "SELECT language, round(loss, 6) AS loss, targets, round(exp(loss), 3) AS perplexity FROM x"
)
def model_loss(spark, d):
    """Losses, by language, of a tenth of the documents under a model of the others."""
    held = docs(spark, d).filter(F.col("doc_id") % HELD_OUT == 0).select(F.col("lang").alias("language"), "text")
    sums = ngram_lm.nll(_model(spark, d), held, ["language"])
    return metrics.losses(sums).select("language", six("loss", "loss"), "targets", F.round("perplexity", 3).alias("perplexity"))


@query(
    f"WITH {_MODEL} h AS (SELECT item_id, {_WORDS.format(x='text')} AS ws FROM benchmark), n AS (SELECT item_id, ws[: len(ws) // 2] AS head, ws[len(ws) // 2 + 1 :] AS tail, coalesce(lead(ws) OVER (ORDER BY item_id), first_value(ws) OVER (ORDER BY item_id)) AS other FROM h), "
    "b AS (SELECT item_id, 0 AS choice, head, tail AS own FROM n UNION ALL SELECT item_id, 1, head, other[len(other) // 2 + 1 :] FROM n), "
    f"cut AS (SELECT item_id, choice, len(head) + len(own) > {CONTEXT_TOKENS} AS truncated, own[greatest(1, len(own) - {CONTEXT_TOKENS - 1}) :] AS o, head FROM b), "
    f"cc AS (SELECT item_id, choice, truncated, o, head[greatest(1, len(head) - ({CONTEXT_TOKENS} - len(o)) + 1) : len(head)] AS hh FROM cut), "
    "pd AS (SELECT item_id, choice, truncated, len(o) AS m, len(hh) AS k, ['<s>', '<s>'] || hh || o AS p FROM cc), "
    "asked AS MATERIALIZED (SELECT item_id, choice, truncated, p[i] AS u, p[i + 1] AS v, p[i + 2] AS w FROM (SELECT item_id, choice, truncated, p, unnest(range(k + 1, k + m + 1)) AS i FROM pd)), "
    f"{_PROBABILITY} SELECT item_id, choice::INTEGER AS choice, round(sum(ln(p)), 6) AS loglik, count(*)::BIGINT AS n_tokens, truncated FROM asked JOIN pr USING (u, v, w) GROUP BY item_id, choice, truncated"
)
def continuation_likelihoods(spark, d):
    """Of each benchmark item the second half of its text and that of the next item, after its first half, of at most 24 tokens together."""
    halves = table(spark, d, "benchmark").select("item_id", ngram_lm.words(F.col("text")).alias("ws"))
    half = lambda c, second: F.array_join(F.slice(c, F.floor(F.size(c) / 2).cast("int") + 1, F.size(c)) if second else F.slice(c, 1, F.floor(F.size(c) / 2).cast("int")), " ")
    first = halves.agg(F.min("item_id")).first()[0]
    order = halves.withColumn("_next", F.col("item_id") - 1).select("_next", F.col("ws").alias("other"))  # ids of items are without gaps
    around = halves.filter(F.col("item_id") == first).select(F.lit(halves.agg(F.max("item_id")).first()[0]).alias("_next"), F.col("ws").alias("other"))
    both = halves.join(order.filter(F.col("_next") >= F.lit(first)).unionByName(around), F.col("item_id") == F.col("_next"))
    each = F.explode(F.array(F.struct(F.lit(0).alias("choice"), half(F.col("ws"), True).alias("k")), F.struct(F.lit(1).alias("choice"), half(F.col("other"), True).alias("k"))))
    rows = both.select("item_id", half(F.col("ws"), False).alias("context"), each.alias("x")).select("item_id", "context", "x.choice", F.col("x.k").alias("continuation"))
    told = ngram_lm.continuations(_model(spark, d), rows, ["item_id", "choice"], "context", "continuation", CONTEXT_TOKENS)
    return told.filter("n_tokens > 0").select("item_id", "choice", six("loglik", "loglik"), "n_tokens", "truncated")
