"""Model replies joined to ranked results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from coursequarry import schemas
from coursequarry.functions import replies as rp
from coursequarry.operators.ranking import rerank


def needs_analysis(results: DataFrame) -> DataFrame:
    """Rows marked for analysis that have none yet."""
    return results.where(F.col("analisis_pendiente") & F.col("metadatos_analisis").isNull())


def replies_from(results: DataFrame,
                 scorer: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> DataFrame:
    """Reply rows of a scorer supplied by the caller, asked only for the rows that wait.

    The scorer gets batches of (query_id, id, titulo, descripcion, nivel, categoria, plataforma) and
    yields batches of `schemas.AI_REPLIES`; it is where a model would be called.
    """
    asked = needs_analysis(results).select(
        "query_id", "id", "titulo", "descripcion", "nivel", "categoria", "plataforma"
    )
    return asked.mapInPandas(scorer, schemas.AI_REPLIES)


def enrich(results: DataFrame, replies: DataFrame, enabled: bool = True) -> DataFrame:
    """Results with the reply scores of the rows that wait for one.

    `replies` is (query_id, id, respuesta); of several replies for a row (retries) the last in text order
    counts. Only waiting rows with a reply change:
    they get their analysis, the blended confidence (unless the reply was an error) and lose the
    mark. Waiting rows without a reply go on waiting; an empty reply counts as an empty object.
    """
    if not enabled:
        return results
    answers = replies.groupBy("query_id", "id").agg(F.max("respuesta").alias("respuesta")).withColumn(
        "contestada", F.lit(True))
    waiting = F.col("analisis_pendiente") & F.col("metadatos_analisis").isNull()
    joined = results.join(
        answers,
        (results["query_id"] == answers["query_id"]) & (results["id"] == answers["id"]) & waiting,
        "left",
    ).select(*[results[c] for c in results.columns], "respuesta", "contestada")
    answered = F.col("contestada").isNotNull()
    parsed = joined.withColumn(
        "leida", F.when(answered, rp.parse_strict(F.col("respuesta"), F.col("confianza")))
    )
    analysis = F.col("leida.analisis")
    return parsed.select(
        *[c for c in results.columns
          if c not in ("confianza", "analisis_pendiente", "metadatos_analisis")],
        F.when(
            F.col("leida.valida"),
            rp.blend(F.col("confianza"), analysis["calidad_ia"], analysis["relevancia_ia"]),
        ).otherwise(F.col("confianza")).alias("confianza"),
        (F.col("analisis_pendiente") & ~answered).alias("analisis_pendiente"),
        F.coalesce(analysis, F.col("metadatos_analisis")).alias("metadatos_analisis"),
    ).select(*results.columns)


def enrich_and_rerank(results: DataFrame, replies: DataFrame, enabled: bool = True) -> DataFrame:
    """Enriched results in the order of the new confidences."""
    return rerank(enrich(results, replies, enabled))


def score_loose(replies: DataFrame) -> DataFrame:
    """Stand-alone scoring of reply texts that may hold prose around their object."""
    return replies.withColumn("leida", rp.parse_loose(F.col("respuesta"))).select(
        *replies.columns, F.col("leida.valida").alias("valida"), "leida.analisis.*"
    )
