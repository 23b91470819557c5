"""Keep-first de-duplication and per-topic ranking of result rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from coursequarry import fixed_values as fv


def dedupe_first(results: DataFrame) -> DataFrame:
    """One row per topic and address: the first in source order, then place."""
    first = Window.partitionBy("query_id", "url").orderBy("fuente_orden", "pos")
    return (
        results.withColumn("vez", F.row_number().over(first)).where(F.col("vez") == 1).drop("vez")
    )


def rank(results: DataFrame, max_results: int = fv.DEFAULT_MAX_RESULTS,
         max_analysis: int | None = fv.DEFAULT_MAX_ANALYSIS) -> DataFrame:
    """The best rows per topic by confidence, ties in arrival order, as column `puesto` from 1.

    The first `max_analysis` places are marked as waiting for analysis, except fallback rows; None
    leaves the marks as they are.
    """
    order = Window.partitionBy("query_id").orderBy(F.col("confianza").desc(), "fuente_orden", "pos")
    ranked = results.withColumn("puesto", F.row_number().over(order)).where(
        F.col("puesto") <= max_results
    )
    if max_analysis is None:
        return ranked
    marked = (F.col("puesto") <= max_analysis) & (
        F.col("metadatos.fuente") != fv.SOURCE_FALLBACK
    )
    return ranked.withColumn("analisis_pendiente", marked)


def rerank(results: DataFrame) -> DataFrame:
    """Places again after confidences changed; equal ones keep their former order."""
    order = Window.partitionBy("query_id").orderBy(F.col("confianza").desc(), "puesto")
    return results.withColumn("nuevo", F.row_number().over(order)).drop("puesto").withColumnRenamed(
        "nuevo", "puesto"
    )
