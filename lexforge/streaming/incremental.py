"""What resumable streams share: a settings fingerprint beside the checkpoint, what was not attempted, windowed counts. The extraction is in `records`."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fingerprint(settings: dict) -> str:
    return hashlib.sha256(json.dumps(settings, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def require_same_settings(spark: SparkSession, checkpoint: str, settings: dict) -> None:
    """Writes the settings' fingerprint beside a checkpoint, or compares it with the one there; an error if they differ."""
    path = f"{checkpoint.rstrip('/')}-settings"
    now = fingerprint(settings)
    try:
        was = spark.read.text(path).first()
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        was = None
    if was is None:
        spark.createDataFrame([(now,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    elif was["value"] != now:
        raise ValueError("the checkpoint was written with other settings")


def not_attempted(items: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Items that no result line, ok or failed, names."""
    return items.join(results.select(key).distinct(), key, "left_anti")


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
