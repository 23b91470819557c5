"""The context digest handed to the assistant: trends, favourites, catalogue, results on screen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from coursequarry import fixed_values as fv
from coursequarry.functions.labels import score_percent
from coursequarry.operators.activity import top_favorites, top_topics

TRENDS, FAVORITES, CATALOGUE, SHOWN = "tendencias", "favoritos", "catalogo", "resultados"


def _placed(top: DataFrame, section: str, label: str) -> DataFrame:
    # At most five rows come in, so one task numbers them.
    place = F.row_number().over(Window.orderBy(F.col("total").desc(), F.col(label)))
    return top.select(
        F.lit(section).alias("seccion"), F.lit(None).cast("bigint").alias("query_id"),
        place.alias("pos"), F.col(label).alias("etiqueta"), F.lit(None).cast("string").alias("detalle"),
        F.col("total").alias("n"),
    )


def context_digest(search_log: DataFrame, favorites: DataFrame, catalogue: DataFrame,
                   results: DataFrame) -> DataFrame:
    """(seccion, query_id, pos, etiqueta, detalle, n).

    The first three sections are shared; the results section holds the first seven results of every
    topic, with the whole-percent score where there is one.
    """
    listed = (
        catalogue.where(F.col("activa")).select("id", "nombre", "categoria")
        .orderBy("id").limit(fv.DIGEST_PLATFORMS)
    )
    platforms = listed.select(
        F.lit(CATALOGUE).alias("seccion"), F.lit(None).cast("bigint").alias("query_id"),
        F.row_number().over(Window.orderBy("id")).alias("pos"),
        F.col("nombre").alias("etiqueta"), F.col("categoria").alias("detalle"),
        F.lit(None).cast("bigint").alias("n"),
    )
    shown = results.where(F.col("puesto") <= fv.DIGEST_RESULTS).select(
        F.lit(SHOWN).alias("seccion"), "query_id", F.col("puesto").alias("pos"),
        F.col("titulo").alias("etiqueta"), F.col("plataforma").alias("detalle"),
        score_percent(F.col("metadatos_analisis.calidad_ia")).cast("bigint").alias("n"),
    )
    return reduce(DataFrame.unionByName, [
        _placed(top_topics(search_log), TRENDS, "tema"),
        _placed(top_favorites(favorites), FAVORITES, "titulo"),
        platforms,
        shown,
    ])
