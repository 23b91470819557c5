"""Display rows: the result report and the visible chat."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from coursequarry.functions import labels as lb
from coursequarry.functions.text import clean_chat

_CHAT_ROLES = ["assistant", "user"]


def report_rows(results: DataFrame) -> DataFrame:
    """The eight columns of the downloadable report."""
    return results.select(
        F.col("titulo").alias("Título"),
        F.col("url").alias("URL"),
        F.col("plataforma").alias("Plataforma"),
        F.col("nivel").alias("Nivel"),
        F.col("idioma").alias("Idioma"),
        F.col("categoria").alias("Categoría"),
        lb.confidence_percent(F.col("confianza")).alias("Confianza"),
        F.col("tipo").alias("Tipo"),
    )


def result_cards(results: DataFrame) -> DataFrame:
    """What a result card shows: status, whole-percent scores, badges, date and fallback texts."""
    analysis = F.col("metadatos_analisis")
    return results.select(
        "query_id", "puesto", "id",
        lb.shown_title(F.col("titulo")).alias("titulo"),
        lb.shown_description(F.col("descripcion")).alias("descripcion"),
        lb.analysis_status(analysis, F.col("analisis_pendiente")).alias("estado"),
        lb.score_percent(analysis["calidad_ia"]).alias("calidad"),
        lb.score_percent(analysis["relevancia_ia"]).alias("relevancia"),
        lb.badge_labels(F.col("certificacion")).alias("insignias"),
        lb.confidence_percent(F.col("confianza")).alias("confianza"),
        lb.shown_date(F.col("ultima_verificacion")).alias("verificado"),
    )


def visible_chat(messages: DataFrame) -> DataFrame:
    """Messages of the two visible roles with something left after cleaning."""
    return (
        messages.where(F.col("role").isin(_CHAT_ROLES))
        .withColumn("text", clean_chat(F.col("text")))
        .where(F.col("text") != "")
    )
