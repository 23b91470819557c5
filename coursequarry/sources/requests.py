"""Search requests: language, and the work list of web requests to fetch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from coursequarry import fixed_values as fv
from coursequarry.functions.text import any_level, is_valid_resource, language_code, quote_plus

_EDGES = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def prepare_topics(requests: DataFrame) -> DataFrame:
    """Requests with trimmed topic and language code; blank topics are no requests."""
    return (
        requests.withColumn("tema", F.regexp_replace("tema", _EDGES, ""))
        .where(F.col("tema") != "")
        .withColumn("idioma", language_code(F.col("idioma_ui")))
    )


def _request_text(tema: Column, nivel: Column, extra: list[str]) -> Column:
    clean = F.replace(F.replace(F.regexp_replace(tema, _EDGES, ""), F.lit('"'), F.lit("")),
                      F.lit(":"), F.lit(""))
    low = F.lower(nivel)
    level_group = F.when(
        ~any_level(nivel),
        F.concat(F.lit("(nivel:"), low, F.lit(' OR "'), low, F.lit('" OR "nivel '), low, F.lit('")')),
    )
    return F.concat_ws(
        " ",
        F.concat(F.lit('"'), clean, F.lit('"')),
        *[F.lit(g) for g in fv.REQUEST_GROUPS],
        level_group,
        *[F.lit(e) for e in extra],
    )


def first_round_kept(items: DataFrame) -> DataFrame:
    """(query_id, quedan): how many landed items of the first round count; topics without any are absent."""
    counts = (F.col("ronda") == 1) & (F.col("pos") < fv.WEB_FIRST_ROUND_ITEMS) & is_valid_resource(
        F.col("link"), F.col("title"), F.col("snippet"))
    return items.where(counts).groupBy("query_id").agg(F.count("*").cast("int").alias("quedan"))


def web_requests(topics: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """The web requests of every topic: a first round, and a second for what is missing to the total.

    `items` is the landed first round; without it nothing has been kept. A topic that has its total gets
    no second row.
    """
    if items is None:
        topics = topics.withColumn("quedan", F.lit(0))
    else:
        topics = topics.join(first_round_kept(items), "query_id", "left")
    missing = F.lit(fv.WEB_TOTAL_ITEMS) - F.coalesce("quedan", F.lit(0))
    rounds = F.explode(
        F.array(
            F.struct(F.lit(1).alias("ronda"), F.lit(fv.WEB_FIRST_ROUND_ITEMS).alias("num"),
                     _request_text(F.col("tema"), F.col("nivel"), fv.REQUEST_SITES).alias("q")),
            F.struct(F.lit(2).alias("ronda"), missing.alias("num"),
                     _request_text(F.col("tema"), F.col("nivel"), fv.REQUEST_EXCLUSIONS).alias("q")),
        )
    )
    return topics.select(
        "query_id",
        F.concat(F.lit(fv.REQUEST_LANGUAGE_PREFIX), F.col("idioma")).alias("lr"),
        rounds.alias("r"),
    ).select("query_id", "r.ronda", "r.q", "r.num", "lr").where(F.col("num") > 0)


def fallback_requests(topics: DataFrame) -> DataFrame:
    wanted = F.when(F.col("nivel") == fv.ANY_LEVEL, "").otherwise(F.col("nivel"))
    text = F.regexp_replace(
        F.concat(F.col("tema"), F.lit(fv.FALLBACK_REQUEST_WORDS), wanted), _EDGES, ""
    )
    return topics.select("query_id", quote_plus(text).alias("q"))
