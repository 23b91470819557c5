"""Landed web replies and HTML pages as candidate items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from coursequarry import fixed_values as fv
from coursequarry import schemas
from coursequarry.functions.text import or_empty


def read_replies(spark: SparkSession, path: str) -> DataFrame:
    """Landed replies, one JSON document per line, read with a fixed layout."""
    return spark.read.schema(schemas.LANDED_REPLIES).json(path)


def landed_items(replies: DataFrame) -> DataFrame:
    """One row per item with its place in the reply; missing texts become ''."""
    kept = [c for c in replies.columns if c != "items"]
    return (
        replies.select(*kept, F.posexplode("items").alias("pos", "item"))
        .select(
            *kept,
            "pos",
            or_empty(F.col("item.link")).alias("link"),
            or_empty(F.col("item.title")).alias("title"),
            or_empty(F.col("item.snippet")).alias("snippet"),
        )
    )


def first_links(html: Column) -> Column:
    """The first absolute links of a page in document order, before any validation."""
    return F.slice(F.regexp_extract_all(html, F.lit(fv.HREF_PATTERN), F.lit(1)), 1, fv.FALLBACK_LINKS)


def html_links(pages: DataFrame) -> DataFrame:
    """(…, pos, link) for the first links of column `html`."""
    kept = [c for c in pages.columns if c != "html"]
    return pages.select(*kept, F.posexplode(first_links(F.col("html"))).alias("pos", "link"))
