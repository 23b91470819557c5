"""Helpers for tables: ranks over all rows, joins with a hot key, connected components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from coursequarry.sources.scratch import cut_lineage

HOT_SHARE = 1000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """`rows` left-joined with one row per group on a binary `key`, also where a few groups hold most rows.

    Groups of more than a thousandth of all `total` rows are at most a thousand, so they are broadcast; every
    other group is too small to make a task of the second join large. Rows that the first join has served
    get a key of their own, so that they are spread.
    """
    names = [c for c in groups.columns if c != key]
    hot = groups.filter(F.col(size) * HOT_SHARE > total).select(
        key, F.lit(True).alias("_served"), *[F.col(c).alias(f"_hot_{c}") for c in names])
    rest = groups.filter(F.col(size) * HOT_SHARE <= total).select(
        F.col(key).alias("_key"), *[F.col(c).alias(f"_own_{c}") for c in names])
    spread = F.to_binary(F.concat(F.lit("s"), F.monotonically_increasing_id().cast("string")), F.lit("utf-8"))
    served = rows.join(F.broadcast(hot), key, "left").withColumn(
        "_key", F.when(F.col("_served"), spread).otherwise(F.coalesce(F.col(key), spread)))
    return served.join(rest, "_key", "left").select(
        *[F.col(c) for c in rows.columns],
        *[F.coalesce(F.col(f"_hot_{c}"), F.col(f"_own_{c}")).alias(c) for c in names])


def connected(edges: DataFrame, name: str = "grafo") -> DataFrame:
    """(node, label) of every node that an edge (a, b) names; the label is the smallest node reachable.

    Alternating large-star and small-star rounds until every node hangs on its smallest one; each round is
    written to the shared folder, and only a flag of it reaches the driver.
    """
    now = cut_lineage(_star(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")),
                            large=False).distinct(), name)
    while not _is_flat(now):
        now = cut_lineage(_star(_star(now, large=True), large=False).distinct(), name)
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
        roots.select("node", F.col("node").alias("label")))


def _is_flat(edges: DataFrame) -> bool:
    """Whether every node has one edge down at most, and none if an edge leads to it."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.sum("up").alias("up")).filter(
        "down > 1 or down > 0 and up > 0").limit(1).count() == 0


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: the neighbours of a node (large: those above it, else it and those below) are tied to the smallest one."""
    near = edges
    if large:
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    joined = near.join(near.groupBy("a").agg(F.min("b").alias("m")), "a").withColumn("m", F.least("a", "m"))
    if large:
        return joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return joined.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).filter("a <> b")


def range_bounds(df: DataFrame, column: str, parts: int) -> list:
    """Values that cut the rows into about `parts` ranges of equal size; at most parts - 1 of them."""
    if parts < 2:
        return []
    cuts = df.approxQuantile(column, [i / parts for i in range(1, parts)], 1 / (4 * parts))
    return sorted(set(cuts))


def pack(array: np.ndarray) -> bytes:
    return np.ascontiguousarray(array).tobytes()
