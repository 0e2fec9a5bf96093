"""Named queries over the functions and operators that the larger queries of `catalog` don't call, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .catalog import SEED, annotations, corpus_view, edu, query, score_of, scores, six, table
from .functions import text as T
from .operators import bench, corpus, generation, geometry, labels, metrics, sampling, select, split, tables
from .operators.ranks import numbered
from .plans.views import NAMES, SQL_SCORE, WITH
from .sources import sinks

EDU = f"edu AS (SELECT *, {SQL_SCORE['edu']} AS score_raw FROM corpus)"


def docs(spark, d):
    return table(spark, d, "documents")


# --- text and names ------------------------------------------------------------------------------------------------------------------

REPLY = (
    "CASE doc_id % 5 WHEN 0 THEN '```json\n{\"edu\": 3, \"clean\": 2}\n```' WHEN 1 THEN '{\"edu\": 4, \"clean\": \"x\"} clean is: 1' "
    "WHEN 2 THEN 'Edu score: 5, CLEAN - 0' WHEN 3 THEN '{\"edu\": 2}' ELSE 'no idea' END"
)


@query(
    f"WITH r AS (SELECT doc_id, {REPLY} AS raw FROM documents), b AS (SELECT *, regexp_replace(trim(raw), '^```[a-zA-Z]*\\s*|\\s*```$', '', 'g') AS bare FROM r), "
    "j AS (SELECT *, CASE WHEN json_valid(bare) THEN json_extract_string(bare, '$.edu') END AS e, CASE WHEN json_valid(bare) THEN json_extract_string(bare, '$.clean') END AS c FROM b), "
    "v AS (SELECT doc_id, coalesce(CASE WHEN regexp_matches(e, '^[0-9]+$') THEN e::INT END, nullif(regexp_extract(raw, '(?i)edu[^0-9]{0,8}([0-5])', 1), '')::INT) AS edu, "
    "coalesce(CASE WHEN regexp_matches(c, '^[0-9]+$') THEN c::INT END, nullif(regexp_extract(raw, '(?i)clean[^0-9]{0,8}([0-5])', 1), '')::INT) AS clean FROM j) "
    "SELECT doc_id, edu, clean, CASE WHEN edu IS NOT NULL AND clean IS NOT NULL THEN 'ok' ELSE 'failed' END AS status FROM v"
)
def parse_replies(spark, d):
    values, status = T.parse_reply(F.expr(REPLY.replace("\n", "\\n")), ["edu", "clean"])
    return docs(spark, d).select("doc_id", values.alias("v"), status.alias("status")).select("doc_id", F.col("v")["edu"].alias("edu"), F.col("v")["clean"].alias("clean"), "status")


@query("SELECT doc_id, sha256('Rate this ' || lang || ' text:' || chr(10) || text || chr(10) || 'Score:') AS prompt FROM documents")
def rubric_prompts(spark, d):
    prompt = T.fill_prompt("Rate this {lang} text:\n{text}\nScore:", lang=F.col("lang"), text=F.col("text"))
    return docs(spark, d).select("doc_id", F.sha2(prompt, 256).alias("prompt"))


@query(
    "WITH t AS (SELECT doc_id, (doc_id % 37) || CASE doc_id % 4 WHEN 0 THEN 'K' WHEN 1 THEN 'm' WHEN 2 THEN 'B' ELSE '' END AS raw, (doc_id % 37) * CASE doc_id % 4 WHEN 0 THEN 1000 WHEN 1 THEN 1000000 WHEN 2 THEN 1000000000 ELSE 1 END AS n FROM documents) "
    "SELECT doc_id, raw, n::BIGINT AS n, CASE WHEN n % 1000000 = 0 THEN (n // 1000000) || 'M' WHEN n % 1000 = 0 THEN (n // 1000) || 'K' ELSE n::VARCHAR END AS label FROM t"
)
def budget_literals(spark, d):
    suffix = F.element_at(F.array(*[F.lit(x) for x in ("K", "m", "B", "")]), (F.col("doc_id") % 4 + 1).cast("int"))
    rows = docs(spark, d).select("doc_id", F.concat((F.col("doc_id") % 37).cast("string"), suffix).alias("raw"))
    rows = rows.withColumn("n", T.parse_budget(F.col("raw")))
    return rows.withColumn("label", T.budget_label(F.col("n")))


@query(
    "SELECT doc_id, lang AS dimension, CASE WHEN doc_id % 3 = 0 THEN doc_id::VARCHAR ELSE 'unknown' END AS seed FROM documents"
)
def names_of_runs(spark, d):
    run = F.concat("source", F.when(F.col("doc_id") % 3 == 0, "-seed").when(F.col("doc_id") % 3 == 1, "-seedx").otherwise("-"), F.col("doc_id").cast("string"))
    run = F.when(F.col("doc_id") % 3 == 1, F.concat(run, F.lit("x"))).otherwise(run)
    return docs(spark, d).select("doc_id", T.dimension_name(F.concat("lang", F.lit("_mean"))).alias("dimension"), T.seed_of_run(run).alias("seed"))


@query(
    "WITH e AS (SELECT DISTINCT source AS parent, lang || CASE WHEN source = 'src0' THEN '' ELSE source END AS name FROM documents UNION ALL SELECT DISTINCT 'extra', lang FROM documents), "
    "n AS (SELECT *, count(*) OVER (PARTITION BY name) AS c FROM e) SELECT parent, name, CASE WHEN c > 1 THEN parent || '/' || name ELSE name END AS unique_name FROM n"
)
def unique_names(spark, d):
    rows = docs(spark, d).select("source", "lang").distinct()
    own = rows.select(F.col("source").alias("parent"), F.concat("lang", F.when(F.col("source") == "src0", "").otherwise(F.col("source"))).alias("name"))
    return bench.unique_names(own.unionByName(rows.select(F.lit("extra").alias("parent"), F.col("lang").alias("name")).distinct()))


@query(
    "WITH q AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant') "
    "SELECT q.conv_id, q.turn, sha256('Passage:' || chr(10) || a.text || chr(10) || chr(10) || 'Question: ' || q.text || chr(10) || 'Answer:') AS passage, "
    "sha256(rtrim(q.text, ' .!?؟。') || ' because') AS premise, sha256('Topics: sport, law.' || chr(10) || chr(10) || 'Text:' || chr(10) || q.text || chr(10) || chr(10) || 'Topic:') AS topic "
    "FROM q JOIN a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1"
)
def candidate_prompts(spark, d):
    turns = table(spark, d, "conversations")
    q = turns.filter("role = 'user'").select("conv_id", "turn", "text")
    a = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    made = [T.passage_prompt(F.col("answer"), F.col("text")), T.premise_prompt(F.col("text"), F.lit("because")), T.topic_prompt(F.col("text"), ["sport", "law"])]
    return q.join(a, ["conv_id", "turn"]).select("conv_id", "turn", *[F.sha2(x, 256).alias(n) for x, n in zip(made, ("passage", "premise", "topic"), strict=True)])


@query(
    "WITH w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents), p AS (SELECT a.doc_id, list_transform(list_zip(a.w, b.w), lambda x: coalesce(x[1] = x[2], false)) AS same FROM w a JOIN w b ON b.doc_id = a.doc_id + 1) "
    "SELECT doc_id, coalesce(list_position(same, false) - 1, len(same))::BIGINT AS n FROM p"
)
def common_prefixes(spark, d):
    rows = docs(spark, d).select("doc_id", F.split("text", " ").alias("w"))
    after = rows.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("v"))
    return rows.join(after, "doc_id").select("doc_id", T.common_prefix_len(F.col("w"), F.col("v")).cast("long").alias("n"))


@query("SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id % 7, doc_id % 113, doc_id)::INTEGER AS place FROM documents")
def natural_order(spark, d):
    name = F.concat((F.col("doc_id") % 7).cast("string"), F.lit("-"), (F.col("doc_id") % 113).cast("string"))
    rows = docs(spark, d).select("doc_id", "lang", T.natural_key(name).alias("key"))
    return numbered(rows, ["lang"], ["key", "doc_id"], "place").select("doc_id", "place")


@query("SELECT conv_id, turn, CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END::INTEGER AS label FROM conversations")
def label_indexes(spark, d):
    role = F.concat(F.lit(" "), F.initcap("role"))
    return table(spark, d, "conversations").select("conv_id", "turn", T.label_index(role, ["user", "assistant", "system"]).alias("label"))


@query("SELECT doc_id, doc_id % 3 = 0 AS valid FROM documents")
def repository_ids(spark, d):
    owner = F.when(F.col("doc_id") % 3 == 2, F.concat(F.lit("."), "source")).otherwise(F.col("source"))
    name = F.concat(owner, F.when(F.col("doc_id") % 3 == 1, " ").otherwise("/"), "lang")
    return docs(spark, d).select("doc_id", T.valid_repo_id(name).alias("valid"))


@query(
    "WITH w AS (SELECT conv_id, max(turn) + 1 AS w FROM conversations GROUP BY conv_id) SELECT conv_id, turn, w::INTEGER AS padded, (turn + 1)::INTEGER AS held, ((turn + 1) * (turn + 2) // 2)::BIGINT AS total FROM conversations JOIN w USING (conv_id)"
)
def padded_batches(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", "turn")
    width = turns.groupBy("conv_id").agg((F.max("turn") + 1).cast("int").alias("w"))
    ids, mask = T.pad_batch(F.sequence(F.lit(1), F.col("turn").cast("int") + 1), F.col("w"))
    rows = turns.join(width, "conv_id").select("conv_id", "turn", ids.alias("ids"), mask.alias("mask"))
    add = lambda c, kind: F.aggregate(c, F.lit(0).cast(kind), lambda a, x: a + x.cast(kind))
    return rows.select("conv_id", "turn", F.size("ids").alias("padded"), add("mask", "int").alias("held"), add("ids", "long").alias("total"))


@query("SELECT event_id, coalesce(json_extract_string(props, '$.k'), '?') AS k, 'none' AS other FROM events")
def json_fields(spark, d):
    return table(spark, d, "events").select("event_id", T.json_field(F.col("props"), "k", "?").alias("k"), T.json_field(F.col("props"), "other", "none").alias("other"))


@query("SELECT lang AS task, unnest(['acc,none', 'n']) AS metric, unnest([0.25::DOUBLE, count(*)::DOUBLE]) AS value FROM documents GROUP BY lang")
def nested_metrics(spark, d):
    counts = docs(spark, d).groupBy("lang").agg(F.count("*").cast("double").alias("n"))
    held = F.create_map(F.lit("acc,none"), F.lit(0.25), F.lit("n"), F.col("n"))
    return bench.flat_metrics(counts.select(F.to_json(F.create_map("lang", held)).alias("results")))


@query("SELECT conv_id, turn, CASE WHEN NOT starts_with(trim(t), '#') AND regexp_replace(t, '[^a-zA-Z0-9]', '', 'g') <> '' THEN md5(lower(regexp_replace(t, '[^a-zA-Z0-9]', '', 'g'))) END AS word FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN ' # ' || text ELSE text END AS t FROM conversations)")
def normal_words(spark, d):
    line = F.when(F.col("turn") % 3 == 0, F.concat(F.lit(" # "), "text")).otherwise(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(T.normal_word(line)).alias("word"))


@query(
    "SELECT doc_id, sha256(nfc_normalize(CASE WHEN contains(text, 'é') AND contains(text, 'ê') THEN replace(replace(text, 'é', 'E'), 'ü', 'u') WHEN contains(text, 'é') THEN replace(text, 'é', 'E') ELSE text END)) AS fixed FROM documents"
)
def legacy_encoding(spark, d):
    fix = T.fix_encoding_udf({"é": "E"}, {"ü": "u"}, [], lambda t: 1.0 if "ê" in t else 0.0)
    return docs(spark, d).select("doc_id", F.sha2(fix("text"), 256).alias("fixed"))


PARSED = "CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'x' ELSE CAST(doc_id % 7 AS STRING) END"


@query(
    "WITH r AS (SELECT *, CASE WHEN doc_id % 6 = 0 THEN '  ' ELSE text END AS t, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'x' ELSE (doc_id % 7)::VARCHAR END AS raw FROM documents), "
    "u AS (SELECT t, raw AS s, 'a' AS dimension FROM r UNION ALL SELECT t, '3', 'b' FROM r), "
    "p AS (SELECT dimension, CASE WHEN trim(t) = '' THEN 'empty_text' WHEN s = '' THEN 'missing' WHEN s = 'x' THEN 'nonnumeric:''x''' WHEN s::INT > 5 THEN 'out_of_range:' || s END AS reason, s FROM u) "
    "SELECT dimension, reason, count(*) AS n, sum(CASE WHEN reason IS NULL THEN s::DOUBLE END) AS total FROM p GROUP BY ALL"
)
def dimension_validity(spark, d):
    """A row may be valid in one dimension and not in another; an empty text is valid in none."""
    rows = docs(spark, d).select(F.when(F.col("doc_id") % 6 == 0, "  ").otherwise(F.col("text")).alias("t"), F.expr(PARSED).alias("a"), F.lit("3").alias("b"))
    long = rows.select("t", F.explode(F.array(*[F.struct(F.lit(x).alias("dimension"), F.col(x).alias("raw")) for x in "ab"])).alias("s")).select("t", "s.*")
    value, reason = T.score_or_reason(F.col("t"), F.col("raw"))
    return long.select("dimension", value.alias("v"), reason.alias("reason")).groupBy("dimension", "reason").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


def _wide(name: str) -> str:
    return f"CASE WHEN doc_id % 13 = {NAMES.index(name)} THEN NULL ELSE {SQL_SCORE[name]} END AS {name}"


@query(
    f"WITH w AS (SELECT doc_id, {', '.join(map(_wide, NAMES))} FROM documents) SELECT doc_id, round(edu, 6) AS edu_only, round(({' + '.join(NAMES[:4])}) / 4, 6) AS avg4, round(({' + '.join(NAMES)}) / 5, 6) AS avg5 FROM w"
)
def importance_scores(spark, d):
    rows = docs(spark, d).select("doc_id", *[F.when(F.col("doc_id") % 13 != i, score_of(n)).alias(n) for i, n in enumerate(NAMES)])
    out = select.importance(rows, {"edu_only": NAMES[:1], "avg4": NAMES[:4], "avg5": NAMES})
    return out.select("doc_id", *[six(c, c) for c in ("edu_only", "avg4", "avg5")])


@query(f"{WITH}, {EDU} SELECT doc_id, language, printf('%.6f', score_raw) AS score_raw, printf('%.6f', least(5.0::DOUBLE, greatest(0.0::DOUBLE, score_raw))) AS score FROM edu")
def formatted_scores(spark, d):
    return sinks.formatted_scores(edu(spark, d))


# --- joins and restrictions ----------------------------------------------------------------------------------------------------------


@query(f"{WITH} SELECT doc_id, text_hash FROM corpus QUALIFY count(*) OVER (PARTITION BY text_hash) = 1")
def unambiguous_texts(spark, d):
    return labels.unambiguous(corpus_view(spark, d).select("doc_id", "text_hash"), ["text_hash"])


@query(f"{WITH}, {EDU} SELECT language, doc_id, char_len, round(score_raw, 6) AS score_raw FROM edu")
def scored_pool(spark, d):
    pool, held = corpus_view(spark, d).select("language", "doc_id", "char_len"), scores(spark, d).filter("dimension = 'edu'").drop("dimension")
    return select.require_scored(pool, held, ["language", "doc_id"]).select("language", "doc_id", "char_len", six("score_raw", "score_raw"))


@query(f"{WITH} SELECT language, doc_id, round(avg(least(5.0::DOUBLE, greatest(0.0::DOUBLE, score_raw))), 6) AS score_raw FROM scores GROUP BY ALL")
def combined_after_key_check(spark, d):
    return select.combine_scores(scores(spark, d), ["language", "doc_id"], strict=True).select("language", "doc_id", six("score_raw", "score_raw"))


@query("SELECT item_id AS line, length(text)::INTEGER AS chars, sha256(text) AS digest FROM benchmark")
def lines_side_by_side(spark, d):
    rows = table(spark, d, "benchmark").select(F.col("item_id").alias("line"), "text")
    return labels.positional_join(rows.select("line", F.length("text").alias("chars")), rows.select("line", F.sha2("text", 256).alias("digest")), "line")


@query("SELECT d.doc_id, l.quality, l.toxic FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality IS NOT NULL AND l.toxic IS NOT NULL")
def completely_labelled(spark, d):
    rows = docs(spark, d).select("doc_id").join(table(spark, d, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")
    return tables.complete_rows(rows, ["quality", "toxic"])


TASKS = "SELECT DISTINCT event_type || '_' || (user_id % 3) || '_' || (user_id % 2) AS task FROM events UNION SELECT DISTINCT event_type || 's' FROM events UNION SELECT DISTINCT event_type FROM events"
CONFIGURED = [("click_1", 0), ("click", 1), ("view", 2), ("error_2_1", 3)]


@query(
    f"WITH t AS ({TASKS}), c(name, place) AS (VALUES {', '.join(map(str, CONFIGURED))}), m AS (SELECT task, name FROM t JOIN c ON task = name OR starts_with(task, name || '_') QUALIFY row_number() OVER (PARTITION BY task ORDER BY place) = 1) "
    "SELECT t.task, m.name AS configured FROM t LEFT JOIN m USING (task)"
)
def configured_tasks(spark, d):
    tasks = spark.sql(TASKS.replace("FROM events", "FROM {events}"), events=table(spark, d, "events"))
    return bench.configured_task(tasks, spark.createDataFrame(CONFIGURED, "name string, place int"))


@query("SELECT DISTINCT n_name AS task FROM nation")
def leaf_tasks(spark, d):
    regions, nations = table(spark, d, "region"), table(spark, d, "nation")
    groups = regions.select(F.lit("world").alias("parent"), F.col("r_name").alias("child"))
    own = nations.join(regions, nations["n_regionkey"] == regions["r_regionkey"]).select(F.col("r_name").alias("parent"), F.col("n_name").alias("child"))
    return bench.leaf_tasks(spark, groups.unionByName(own), "world")


@query("SELECT d.doc_id, length(d.text)::INTEGER AS char_len FROM documents d SEMI JOIN labels l ON l.doc_id = d.doc_id")
def texts_of_split(spark, d):
    ids = table(spark, d, "labels").select("doc_id", F.lit("test").alias("split"))
    rows = docs(spark, d).select("doc_id", F.length("text").alias("char_len"))
    kept = tables.in_splits(rows, ids, ["test"], ["doc_id"])
    return corpus.require_complete(kept, kept.select("doc_id"))


@query("SELECT d.doc_id, length(d.text)::INTEGER AS char_len FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality = 1 AND l.toxic = 0")
def held_out_texts(spark, d):
    """Ids of one of three splits, and their texts, looked up in the document table; an id that isn't there would be an error."""
    split_of = F.when(F.col("toxic") == 1, "validation").when(F.col("quality") == 1, "test").otherwise("train")
    manifest = table(spark, d, "labels").select("doc_id", split_of.alias("split"))
    ids = tables.in_splits(manifest, manifest, ["test"], ["doc_id"])
    return corpus.require_complete(docs(spark, d).select("doc_id", F.length("text").alias("char_len")), ids)


@query("SELECT d.doc_id, d.lang AS language FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality = 1 AND (d.doc_id % 2 = 0 OR d.lang = 'en')")
def kept_by_language(spark, d):
    """A keep set by language and id: entries of odd ids name English, so those of other languages match nothing."""
    rows = docs(spark, d).select("doc_id", F.col("lang").alias("language"))
    entries = rows.join(table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "train").otherwise("test").alias("split")), "doc_id")
    entries = entries.withColumn("language", F.when(F.col("doc_id") % 2 == 0, F.col("language")).otherwise("en"))
    return tables.in_splits(rows, entries, ["train"], ["language", "doc_id"])


@query(
    "SELECT doc_id, coalesce(m.score, h.score) AS score, CASE WHEN m.doc_id IS NULL THEN 'human' END AS rater, m.status FROM (SELECT doc_id, (doc_id % 6)::DOUBLE AS score, 'ok' AS status FROM documents WHERE doc_id % 3 > 0) m "
    "FULL JOIN (SELECT doc_id, quality::DOUBLE AS score FROM labels) h USING (doc_id)"
)
def model_and_human_rows(spark, d):
    """Model rows, and those human rows whose document has none; each table lacks a column of the other."""
    model = docs(spark, d).filter("doc_id % 3 > 0").select("doc_id", (F.col("doc_id") % 6).cast("double").alias("score"), F.lit("ok").alias("status"))
    human = table(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("score"), F.lit("human").alias("rater"))
    return corpus.union_keep_first([model, human], "doc_id", "score").select("doc_id", "score", "rater", "status")


@query(
    "SELECT lang AS run, e AS epoch, k::INTEGER AS k, (e * s + round_even(k * s / 7.0::DOUBLE, 0))::BIGINT AS step FROM (SELECT lang, count(*) // 8 AS s FROM documents GROUP BY lang), range(0, 4) a(e), range(1, 8) b(k)"
)
def evaluation_schedule(spark, d):
    """Evaluations of a run a language, whose steps an epoch are its documents in batches of eight."""
    runs = docs(spark, d).groupBy(F.col("lang").alias("run")).agg(F.floor(F.count("*") / 8).alias("steps_per_epoch"))
    return geometry.evaluation_schedule(runs, 4, 7).select("run", "epoch", "k", "step")


# --- sampling, shots, splits ---------------------------------------------------------------------------------------------------------

KEY = "sha256('42:' || {a} || ':' || {b})"


@query(f"SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {KEY.format(a='lang', b='doc_id')}, doc_id)::INTEGER AS rn FROM documents QUALIFY rn <= 7")
def sampled_indices(spark, d):
    return sampling.sample_k(docs(spark, d).select("doc_id", "lang"), 7, SEED, "lang", "doc_id")


@query(
    f"WITH s AS (SELECT doc_id, lang AS language, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents QUALIFY rn <= 9) SELECT doc_id, row_number() OVER (ORDER BY rn, language)::INTEGER AS place FROM s"
)
def interleaved_languages(spark, d):
    rows = docs(spark, d).select("doc_id", F.col("lang").alias("language"))
    first = rows.withColumn("rn", F.row_number().over(Window.partitionBy("language").orderBy("doc_id"))).filter("rn <= 9")
    order = F.struct("rn", "language", "doc_id")
    held = sampling.interleave(first).agg(F.sort_array(F.collect_list(order)).alias("x"))  # nine rows a language
    return held.select(F.posexplode("x").alias("p", "r")).select("r.doc_id", (F.col("p") + 1).alias("place"))


@query(
    "WITH e AS (SELECT DISTINCT conv_id AS ex, 'g' || conv_id % 4 AS g FROM conversations), p AS (SELECT item_id, 'l' || item_id % 3 AS label, 'g' || item_id % 4 AS g FROM benchmark), "
    "l(i, label) AS (VALUES (0, 'l0'), (1, 'l1'), (2, 'l2')), a AS (SELECT ex, g, r AS round, label, row_number() OVER (PARTITION BY ex, r ORDER BY sha256('42:' || ex || '|' || r || ':' || label)) AS p FROM e, range(0, 2) t(r), l), "
    "k AS (SELECT * FROM a WHERE round > 0 OR p <= 1), n AS (SELECT *, row_number() OVER (PARTITION BY ex, label ORDER BY round) AS nth FROM k), "
    "i AS (SELECT ex, item_id, label, row_number() OVER (PARTITION BY ex, label ORDER BY sha256('42:' || ex || ':' || item_id), item_id) AS nth FROM e JOIN p ON p.g <> e.g) "
    "SELECT n.ex AS example_id, row_number() OVER (PARTITION BY n.ex ORDER BY round, p)::INTEGER AS place, i.item_id AS shot_id, n.label FROM n JOIN i ON i.ex = n.ex AND i.label = n.label AND i.nth = n.nth"
)
def balanced_shots(spark, d):
    examples = table(spark, d, "conversations").select(F.col("conv_id").alias("example_id"), F.concat(F.lit("g"), (F.col("conv_id") % 4).cast("string")).alias("group")).distinct()
    name = lambda letter, n: F.concat(F.lit(letter), (F.col("item_id") % n).cast("string"))
    pool = table(spark, d, "benchmark").select("item_id", name("l", 3).alias("label"), name("g", 4).alias("group"))
    return sampling.shots(examples, pool, 4, SEED, ["l0", "l1", "l2"])


@query(
    "WITH t AS (SELECT conv_id, turn, length(text) AS tokens, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS tail FROM conversations) SELECT conv_id AS example_id, turn AS place, tokens::INTEGER AS tokens FROM t WHERE tail + 10 <= 399"
)
def fitting_shots(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("example_id"), F.col("turn").alias("place"), F.length("text").alias("tokens"), F.lit(10).alias("own"))
    return geometry.fit_prompt(rows, 400).drop("own")


def _classed(spark, d):
    value = lambda n: T.score_bin(T.clip(score_of(n))).alias(n)
    rows = corpus_view(spark, d).select("doc_id", F.when(F.col("domain") == "src0", "removed").otherwise("clean").alias("source"), value("edu"), value("clean"), "char_len", "language")
    size = T.bucket(F.col("char_len"), F.lit(500), F.lit(4000), ("short", "medium", "long"))
    return rows.withColumn("len_bucket", size).withColumnRenamed("language", "lang_bucket")


@query()
def greedy_diversity(spark, d):
    return sampling.greedy_diversity(_classed(spark, d), ["edu", "clean"], 90, {"clean": 63, "removed": 27}, SEED, floor=25, length_share={"short": 0.3, "medium": 0.3, "long": 0.4}, language_share={"en": 0.4, "de": 0.2})


@query()
def iterative_stratification(spark, d):
    rows = _classed(spark, d)
    n = rows.count()
    sizes = {"test": n // 4, "validation": n // 10}
    return sampling.iterative_stratification(rows, ["edu", "clean", "lang_bucket"], sizes | {"train": n - sum(sizes.values())}, SEED)


@query(
    "WITH b AS (SELECT lang, source, ((row_number() OVER (PARTITION BY lang, source ORDER BY sha256('42:' || lang || '|' || source || ':' || doc_id), doc_id) - 1) % n) AS batch FROM documents, (SELECT ceil(count(*) / 300.0)::INT AS n FROM documents)), "
    "c AS (SELECT lang, source, batch, count(*) AS n FROM b GROUP BY ALL) SELECT lang AS language, source AS domain, min(n) AS low, max(n) AS high FROM c GROUP BY ALL"
)
def batch_ranges(spark, d):
    rows = sampling.batches(corpus_view(spark, d).select("doc_id", "language", "domain"), ["language", "domain"], SEED, 300)
    return sampling.batch_ranges(rows, ["language", "domain"])


@query(
    "WITH l AS (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT lang FROM documents)) SELECT s::INTEGER AS step, lang AS language, (10 // n + CASE WHEN (((i - s * (10 % n)) % n) + n) % n < 10 % n THEN 1 ELSE 0 END)::INTEGER AS rows FROM l, range(0, 12) t(s)"
)
def balanced_steps(spark, d):
    sizes = {r["lang"]: r["n"] for r in docs(spark, d).groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    steps = sampling.balanced_steps(sizes, 10, 12)
    return spark.createDataFrame([(s, x, n) for s, one in enumerate(steps) for x, n in one.items()], "step int, language string, rows int")


@query(
    "WITH RECURSIVE w AS (SELECT lang, sum(strlen(text)) AS work, row_number() OVER (ORDER BY sum(strlen(text)) DESC, lang) AS rn FROM documents GROUP BY lang), "
    "t(rn, lang, worker, a, b) AS (SELECT 0::BIGINT, '', -1, 0::HUGEINT, 0::HUGEINT UNION ALL SELECT w.rn, w.lang, CASE WHEN a <= b THEN 0 ELSE 1 END, CASE WHEN a <= b THEN a + w.work ELSE a END, CASE WHEN a <= b THEN b ELSE b + w.work END FROM t JOIN w ON w.rn = t.rn + 1) "
    "SELECT lang AS language, worker::INTEGER AS worker FROM t WHERE rn > 0"
)
def least_loaded_workers(spark, d):
    rows = docs(spark, d).groupBy("lang").agg(F.sum(F.octet_length("text")).alias("work")).orderBy("lang").collect()  # a row a language
    dealt = sampling.least_loaded({r["lang"]: float(r["work"]) for r in rows}, 2)
    return spark.createDataFrame([(x, i) for i, names in enumerate(dealt) for x in names], "language string, worker int")


@query("SELECT e AS epoch, k::INTEGER AS k, (e * 130 + round_even(k * 130 / 7.0::DOUBLE, 0))::BIGINT AS step FROM range(0, 4) a(e), range(1, 8) b(k)")
def evaluation_steps(spark, d):
    return geometry.evaluation_steps(spark, 4, 130, 7)


@query(
    "WITH l AS (SELECT epoch(time_bucket(INTERVAL 1 hour, ts))::BIGINT // 3600 AS epoch, avg(value) AS loss FROM events GROUP BY 1), b AS (SELECT *, min(loss) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM l), "
    "m AS (SELECT *, before IS NULL OR loss < before - 0.5 AS best FROM b), s AS (SELECT *, epoch - max(CASE WHEN best THEN epoch END) OVER (ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS stale FROM m) "
    "SELECT epoch, best, stale, max((stale >= 4)::INT) OVER (ORDER BY epoch ROWS UNBOUNDED PRECEDING) = 1 AS stopped FROM s"
)
def early_stopping(spark, d):
    log = table(spark, d, "events").groupBy(F.floor(F.unix_timestamp("ts") / 3600).alias("epoch")).agg(F.avg("value").alias("loss"))
    return metrics.early_stop(log, 4, 0.5).select("epoch", "best", "stale", "stopped")


@query(
    f"{WITH}, r AS (SELECT language, dimension, score_raw, doc_id, CASE WHEN doc_id % 2 = 0 THEN 'run1' ELSE 'run2' END AS folder FROM scores), s AS (SELECT folder, language, dimension, avg(score_raw) AS v FROM r GROUP BY ALL UNION ALL SELECT 'run0', language, dimension, 1.0::DOUBLE FROM (SELECT DISTINCT language, dimension FROM r WHERE dimension = 'edu')) "
    "SELECT language, dimension, folder, round(v, 6) AS v FROM s QUALIFY row_number() OVER (PARTITION BY language, dimension ORDER BY folder) = 1"
)
def first_folder_wins(spark, d):
    rows = scores(spark, d).groupBy(F.when(F.col("doc_id") % 2 == 0, "run1").otherwise("run2").alias("folder"), "language", "dimension").agg(F.avg("score_raw").alias("v"))
    first = rows.filter("dimension = 'edu'").select(F.lit("run0").alias("folder"), "language", "dimension", F.lit(1.0).alias("v")).distinct()
    return bench.first_folder_wins(rows.unionByName(first), ["language", "dimension"], "folder").select("language", "dimension", "folder", six("v", "v"))


# --- unions and checks ---------------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'labelled' ELSE 'plain' END AS origin FROM documents")
def union_keeping_first(spark, d):
    rows = docs(spark, d).select("doc_id", F.lit("plain").alias("origin"))
    marked = rows.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").withColumn("origin", F.lit("labelled"))
    return corpus.union_keep_first([marked, rows], "doc_id", "origin")


@query("WITH a AS (SELECT item_id AS id, 'benchmark' AS origin FROM benchmark ORDER BY item_id LIMIT 100), n AS (SELECT 100 - count(*) AS n FROM a), b AS (SELECT doc_id AS id, row_number() OVER (ORDER BY doc_id) AS rn FROM documents) SELECT id, origin FROM a UNION ALL SELECT id, 'documents' FROM b, n WHERE rn <= n")
def quota_top_up(spark, d):
    first = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.lit("benchmark").alias("origin"))
    return corpus.quota_top_up(first, docs(spark, d).select(F.col("doc_id").alias("id"), F.lit("documents").alias("origin")), 100, "id")


@query(
    f"{WITH}, l AS (SELECT doc_id, text_hash FROM annotations) SELECT count(*) - count(DISTINCT doc_id) AS repeated_ids, count(*) - count(DISTINCT text_hash) AS repeated_texts, count(*) FILTER (WHERE NOT char_len BETWEEN 500 AND 4000) AS outside_window, "
    "count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM l)) AS overlap_ids, count(*) FILTER (WHERE text_hash IN (SELECT text_hash FROM l)) AS overlap_texts FROM corpus"
)
def disjointness_report(spark, d):
    rows, known = corpus_view(spark, d), annotations(spark, d)
    return corpus.overlap_report(rows, known, known)


@query("WITH r AS (SELECT DISTINCT source AS run, lang AS benchmark FROM documents WHERE NOT (source = 'src1' AND lang = 'fr')), n AS (SELECT count(DISTINCT run) AS n FROM r) SELECT benchmark, count(DISTINCT run) AS n_runs, count(DISTINCT run) = max(n) AS common FROM r, n GROUP BY benchmark")
def benchmarks_common_to_runs(spark, d):
    rows = docs(spark, d).select(F.col("source").alias("run"), F.col("lang").alias("benchmark")).distinct().filter("not (run = 'src1' and benchmark = 'fr')")
    return bench.common_to_all(rows, "run", "benchmark")


@query("WITH s AS (SELECT role, turn, avg(length(text))::DOUBLE AS score, count(*) AS n FROM conversations GROUP BY ALL) SELECT role, round(sum(score * n) / sum(n), 6) AS score, sum(n)::BIGINT AS n FROM s GROUP BY role")
def pooled_benchmarks(spark, d):
    rows = table(spark, d, "conversations").groupBy("role", "turn").agg(F.avg(F.length("text")).alias("score"), F.count("*").alias("n"))
    return bench.pooled(rows, ["role"]).select("role", six("score", "score"), "n")


@query("WITH a AS (SELECT DISTINCT place, benchmark, position FROM (SELECT n_nationkey AS place, n_name AS benchmark, 0 AS position FROM nation WHERE n_nationkey < 3 UNION ALL SELECT 10 + r_regionkey, n_name, n_nationkey FROM region JOIN nation ON n_regionkey = r_regionkey)) SELECT place, position, benchmark FROM a QUALIFY row_number() OVER (PARTITION BY benchmark ORDER BY place, position) = 1")
def expanded_suites(spark, d):
    regions, nations = table(spark, d, "region"), table(spark, d, "nation")
    suites = nations.join(regions, nations["n_regionkey"] == regions["r_regionkey"]).select(F.col("r_name").alias("suite"), F.col("n_nationkey").alias("position"), F.col("n_name").alias("benchmark"))
    asked = nations.filter("n_nationkey < 3").select(F.col("n_nationkey").alias("place"), F.col("n_name").alias("name")).unionByName(regions.select((F.col("r_regionkey") + 10).alias("place"), F.col("r_name").alias("name")))
    return tables.expand_suites(asked, suites)


@query("SELECT conv_id, turn, least(20, n)::INTEGER AS kept, n >= 20 AS at_limit FROM (SELECT conv_id, turn, len(string_split(text, ' ')) AS n FROM conversations)")
def truncated_ids(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.split("text", " ").alias("ids"))
    return tables.truncated(rows, "ids", 20).select("conv_id", "turn", F.size("ids").alias("kept"), "at_limit")


@query(f"{WITH}, s AS (SELECT *, CASE WHEN doc_id % 10 = 0 THEN 'test' ELSE 'train' END AS split FROM corpus) SELECT language, domain, count(DISTINCT split) AS n_splits FROM s GROUP BY ALL HAVING count(DISTINCT split) > 1")
def crossing_sites(spark, d):
    return split.crossing_sites(corpus_view(spark, d).withColumn("split", F.when(F.col("doc_id") % 10 == 0, "test").otherwise("train")))


@query(
    "WITH c AS (SELECT doc_id, k AS choice, ((doc_id * (k + 3)) % 7)::DOUBLE AS loglik, doc_id % 4 AS gold FROM documents, range(0, 4) t(k)), b AS (SELECT doc_id, gold, choice FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY loglik DESC, choice) = 1) SELECT doc_id, choice, gold, choice = gold AS correct FROM b"
)
def chosen_answers(spark, d):
    rows = docs(spark, d).select("doc_id", (F.col("doc_id") % 4).alias("gold"), F.explode(F.array(*[F.lit(k).cast("long") for k in range(4)])).alias("choice"))
    rows = rows.withColumn("loglik", ((F.col("doc_id") * (F.col("choice") + 3)) % 7).cast("double"))
    return bench.chosen(rows, ["doc_id"])


PAIRS = "q AS (SELECT a.role, string_split(a.text, ' ') AS h, string_split(b.text, ' ') AS r, row_number() OVER () AS id FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)"


@query(
    f"WITH {PAIRS}, o(n) AS (SELECT unnest([1, 2, 3, 4])), g AS (SELECT role, id, n, 'm' AS side, array_to_string(h[i : i + n - 1], chr(31)) AS gram FROM q, o, range(1, 400) t(i) WHERE i + n - 1 <= len(h) UNION ALL SELECT role, id, n, 'w', array_to_string(r[i : i + n - 1], chr(31)) FROM q, o, range(1, 400) t(i) WHERE i + n - 1 <= len(r)), "
    "p AS (SELECT role, id, n, gram, count(*) FILTER (WHERE side = 'm') AS m, count(*) FILTER (WHERE side = 'w') AS w FROM g GROUP BY ALL), s AS (SELECT role, n, sum(m) AS m, sum(w) AS w, sum(least(m, w)) AS c FROM p GROUP BY ALL) "
    "SELECT role, round(avg(c / m), 6) AS precision, round(avg(c / w), 6) AS recall FROM s GROUP BY role"
)
def ngram_overlap(spark, d):
    turns = table(spark, d, "conversations")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.split("text", " ").alias("reference"))
    pairs = turns.select("conv_id", "turn", "role", F.split("text", " ").alias("hypothesis")).join(after, ["conv_id", "turn"])
    found = generation.matches(pairs, ["role"], [("t", n, F.col("hypothesis"), F.col("reference")) for n in range(1, 5)])
    return found.groupBy("role").agg(six(F.avg(F.col("matched") / F.col("made")), "precision"), six(F.avg(F.col("matched") / F.col("wanted")), "recall"))
