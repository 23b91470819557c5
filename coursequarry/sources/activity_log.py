"""Append-only activity tables: one directory of parquet files each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from coursequarry import fixed_values as fv
from coursequarry import schemas
from coursequarry.operators.activity import search_events

DAY = "dia"


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def append_search_events(results: DataFrame, topics: DataFrame, ts: Column, path: str) -> None:
    """Log the topics that got results, in one directory per day."""
    rows = search_events(results, topics, ts)
    rows.withColumn(DAY, F.to_date("ts")).write.mode("append").partitionBy(DAY).parquet(path)


def append_favorites(favorites: DataFrame, path: str) -> None:
    """Duplicates are allowed; a missing note is the empty one."""
    favorites.withColumn("notas", F.coalesce("notas", F.lit(""))).write.mode("append").parquet(path)


def append_feedback(feedback: DataFrame, path: str) -> None:
    feedback.write.mode("append").parquet(path)


def session_rows(starts: DataFrame, features: dict | None = None) -> DataFrame:
    """Session starts with the device and the feature switches as JSON text."""
    flags = {**fv.DEFAULT_FEATURES, **(features or {})}
    prefs = F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in flags.items()]))
    return starts.select(
        "session_id", "started_at", F.lit(fv.SESSION_DEVICE).alias("device"), prefs.alias("prefs_json")
    )


def append_sessions(starts: DataFrame, path: str, features: dict | None = None) -> None:
    session_rows(starts, features).write.mode("append").parquet(path)


def append_setting(changes: DataFrame, path: str) -> None:
    """Settings are a change log; `settings_latest` reads the values in force."""
    changes.write.mode("append").parquet(path)


def clear_search_log(spark: SparkSession, path: str) -> None:
    """Empty the search log and keep its layout."""
    empty = spark.createDataFrame([], schemas.SEARCH_LOG)
    empty.write.mode("overwrite").parquet(path)
