"""Platform catalogue and known-platform templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from coursequarry import fixed_values as fv
from coursequarry import schemas


def seed_platforms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(fv.SEED_PLATFORMS, schemas.PLATFORMS)


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """The stored catalogue, or the first rows where it is empty."""
    stored = spark.read.schema(schemas.PLATFORMS).parquet(path)
    return seed_platforms(spark) if stored.isEmpty() else stored


def known_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(fv.KNOWN_TEMPLATES, schemas.KNOWN_TEMPLATES)


def active_platforms(catalogue: DataFrame) -> DataFrame:
    return catalogue.where(F.col("activa"))
