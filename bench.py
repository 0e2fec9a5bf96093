"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS], and their SQL in DuckDB on as many threads; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from lexforge import catalog  # noqa: E402

HEADLINE = [
    "selection_token_budget", "selection_round_robin", "text_hash_dedup", "stratified_split", "score_range_cube", "rater_comparison",
    "dimension_spearman", "leakage_filter", "pack_offsets", "sliding_window_targets", "event_windows", "corpus_totals",
]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duckdb_seconds(sf_dir: str, cpus: str) -> dict[str, float]:
    """Seconds of the same queries' SQL; nothing where DuckDB isn't installed."""
    try:
        import duckdb
    except ImportError:
        return {}
    base = duckdb.connect(config={"threads": int(cpus)})
    base.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        base.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    sql, took = catalog.oracle_sql(), {}
    for name in HEADLINE:
        began = time.time()
        base.execute(sql[name]).fetchall()
        took[name] = round(time.time() - began, 3)
    return took


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found = catalog.queries()
    spark.range(1000).selectExpr("sum(id)").collect()  # the session's own start isn't a query's
    took = {}
    for name in HEADLINE:
        began = time.time()
        found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    spark.stop()
    other = duckdb_seconds(sf_dir, cpus)
    out = {"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}
    if other:
        out |= {"duckdb": other, "duckdb_total": round(sum(other.values()), 3), "ratio": round(sum(took.values()) / sum(other.values()), 2)}
    print(json.dumps(out))


if __name__ == "__main__":
    main()
