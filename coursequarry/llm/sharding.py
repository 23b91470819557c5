"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has 65,536 positions. A row's position is a hash of its doc_id; every shard has virtual nodes on the
ring and a capacity, and the capacities add up to the number of rows, at most one apart. Rows are taken in
ring order to the next node clockwise; where that node's shard is full they go on clockwise. Only the count
per position reaches the driver (a table of fixed size); the walk gives each position the ranges of ranks
that each shard takes, so that a row's shard and slot follow from its rank inside its position.

Defined results: null text has no bytes; a row without doc_id takes its position from its text; rows with
the same doc_id are ordered by their text and get slots of their own. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from coursequarry.sources.scratch import cut_lineage

POSITIONS = 1 << 16
VIRTUAL_NODES = 128


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES) -> list[tuple[int, int]]:
    """(position, shard) of all virtual nodes in ring order."""
    nodes = []
    for shard in range(shards):
        for v in range(virtual_nodes):
            h = int.from_bytes(hashlib.blake2b(f"{shard}/{v}".encode(), digest_size=8).digest(), "big")
            nodes.append((h % POSITIONS, h, shard))
    return [(p, s) for p, _, s in sorted(nodes)]


def capacities(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def walk(counts: np.ndarray, shards: int, virtual_nodes: int = VIRTUAL_NODES) -> pd.DataFrame:
    """(position, low, high, shard, slot): the ranks low..high-1 of a position get slots from `slot` on."""
    nodes = ring(shards, virtual_nodes)
    places = [p for p, _ in nodes]
    room = capacities(int(counts.sum()), shards)
    used = [0] * shards
    ahead = list(range(len(nodes) + 1))  # the next node that may have room

    def next_node(i: int) -> int:
        path = []
        while i < len(nodes) and (ahead[i] != i or used[nodes[i][1]] == room[nodes[i][1]]):
            if ahead[i] == i:
                ahead[i] = i + 1
            path.append(i)
            i = ahead[i]
        for j in path:
            ahead[j] = i
        return i

    out = []
    for position in np.flatnonzero(counts).tolist():
        left, low, node = int(counts[position]), 0, bisect_left(places, position)
        while left:
            node = next_node(node)
            if node == len(nodes):
                node = next_node(0)
            shard = nodes[node][1]
            n = min(left, room[shard] - used[shard])
            out.append((position, low, low + n, shard, used[shard]))
            used[shard], left, low = used[shard] + n, left - n, low + n
    return pd.DataFrame(out, columns=["position", "low", "high", "shard", "slot"], dtype="int64")


def shard_rows(docs: DataFrame, shards: int = 24, virtual_nodes: int = VIRTUAL_NODES) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and ring position of every row; shard sizes at most one apart."""
    spark = docs.sparkSession
    text = F.encode(F.coalesce(docs["text"], F.lit("")), "UTF-8")
    key = F.when(docs["doc_id"].isNotNull(), F.xxhash64(docs["doc_id"])).otherwise(F.xxhash64(text, F.lit(1)))
    rows = cut_lineage(docs.select(
        docs["doc_id"].alias("doc_id"), F.octet_length(text).cast("long").alias("text_bytes"),
        F.crc32(text).alias("text_crc32"), key.alias("place")), "ring").withColumn(
        "position", F.shiftrightunsigned("place", 48))
    counts = np.zeros(POSITIONS, np.int64)
    for position, n in rows.groupBy("position").count().toPandas().itertuples(index=False):
        counts[position] = n
    ranges = spark.createDataFrame(
        walk(counts, shards, virtual_nodes), "position long, low long, high long, shard long, slot long")
    order = Window.partitionBy("position").orderBy("place", "doc_id", "text_crc32", "text_bytes")
    ranked = rows.withColumn("rank", F.row_number().over(order) - 1)
    return ranked.join(F.broadcast(ranges), "position").filter("rank >= low and rank < high").select(
        "doc_id", "text_bytes", "text_crc32", F.col("shard").cast("int").alias("shard"),
        (F.col("slot") + F.col("rank") - F.col("low")).alias("slot"), F.col("position").cast("int").alias("position"))
