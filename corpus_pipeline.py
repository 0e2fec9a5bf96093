"""The corpus pipeline: STAGES over `documents`, each written as Parquet and read again as the next one's input.

All stages but the last return the columns of documents. Parameters are those of the operators' queries, but near-dedup takes shingles of
five words and confirms near copies by their exact similarity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm import entry, jaccard, language, line_dedup, mixing, packing
from lexforge.llm.common import Scratch, load

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document goes if its language's pooled probability is below this, or if it has no letter at all.
LEAST_SCORE = 0.4
SHINGLE_WORDS = 5
#: Domains that are to go: the target totals are those of the documents whose likeliest domain is another.
WITHOUT = ("toxic",)
#: Documents with a lower rate go; the others stay once.
LEAST_RATE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter or of no clear language; fills in a null lang.

    A null or empty text has no letter and goes. Repeated rows and rows of a null id are judged each for itself and all stay; texts are read
    whole, however long. An empty table, or one without a lang to learn from, leaves no row. Columns beyond COLUMNS are left out, here as in
    every stage.
    """
    docs = docs.select(*COLUMNS)
    out = language.predict(docs, language.train(language.sample(docs)))
    out = out.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return out.select("row.doc_id", "row.text", F.coalesce("row.lang", "lang_pred").alias("lang"), "row.source", "row.n_chars")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops shared lines; a document that loses lines and keeps nothing but blanks goes.

    A document that loses none is left as it is: a null text stays null and an empty one empty. Rows of one id count as one document, and
    those of a null id as one that comes before all others; repeated rows all stay. An empty table gives no rows.
    """
    scratch, docs = Scratch(spark), docs.select(*COLUMNS)
    index = line_dedup.build(scratch, docs.select("doc_id", "text"), entry.LINE_MIN_DOCS, entry.LINE_MIN_CHARS)
    out = line_dedup.apply(scratch, index, docs)
    out = out.filter((F.col("n_dropped") == 0) | (F.length(F.btrim("kept", F.lit(line_dedup.BLANKS))) > 0))
    text = F.when(F.col("n_dropped") == 0, F.col("row.text")).otherwise(F.col("kept"))
    size = F.when(F.col("n_dropped") == 0, F.col("row.n_chars")).otherwise(F.length("kept").cast("long"))
    return out.select("row.doc_id", text.alias("text"), "row.lang", "row.source", size.alias("n_chars"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (similarity 0.8 or more of shingles) stays, the longest, of equals the smallest id.

    Texts without a word, null and empty ones among them, are alike: one stays. Of fewer than five words the whole sequence is the shingle.
    Of repeated rows one stays; rows of a null id are documents like others. An empty table gives no rows.
    """
    return jaccard.one_of_each(Scratch(spark), docs.select(*COLUMNS), SHINGLE_WORDS)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose fitted rate rounds to one or more stay.

    A document without tokens, so with a null or empty text, has the rate 1 and stays. Rows are told apart by id and text: repeated rows
    stay or go together, and rows of a null id each by its own text. Without labels there is one domain and nothing goes; an empty table gives no rows.
    """
    docs = docs.select(*COLUMNS)
    # Rows are told apart by id and text: a low rate removes no other row of the same, or of no, id.
    keyed = docs.select("*", F.xxhash64("doc_id", "text").alias("_k1"), F.xxhash64("text", "doc_id", F.lit(1)).alias("_k2"))
    mixed = mixing.mix(Scratch(spark), keyed, mixing.quality_domains(load(spark, sf_dir, "labels")), without=WITHOUT, also=("_k1", "_k2"))
    gone = mixed.members.filter(F.col("rate") < LEAST_RATE).select("_k1", "_k2").distinct()
    return keyed.join(gone, ["_k1", "_k2"], "left_anti").select(*COLUMNS)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their sequences.

    A null or empty text is its end id alone; repeated rows and rows of a null id are packed as often as they come; an empty table gives no rows.
    """
    ranks, pattern = entry.tokenizer_files()
    return packing.pack(Scratch(spark), packing.pieces(docs, ranks, pattern))


STAGES = [("language", language_stage), ("lines", line_stage), ("near", near_stage), ("mix", mix_stage), ("pack", pack_stage)]

#: Learned models and sequential packing aren't SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark), load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        scratch.tidy()
    return docs
