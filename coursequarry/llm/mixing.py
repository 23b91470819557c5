"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Documents are cut into blocks of at most `block_words` words. A hash permutes the blocks of each source; the mix
takes a source's whole permutation as often as the target holds its size, then the permutation's first blocks
until the rest of the target is reached (the last block is cut). How many of a source's blocks each output
shard gets comes from a splitting tree: the shard range is halved again and again, and each half's share of
every source is drawn from the multivariate hypergeometric distribution, so the quotas add up exactly. A
shard takes the next run of the permuted blocks of each source, so draws are disjoint, and orders them by a
hash of its own.

The driver draws the tree for at most `SOURCE_GROUPS` groups of sources; inside a group the quotas are drawn in
the task that holds the group's sources (the same distribution, since hypergeometric draws nest).

Defined results: null text has size 0; documents of size 0 and empty tables take nothing; a null source is a
source of its own, last in order; rows given twice are two documents.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from coursequarry.llm.tables import join_groups
from coursequarry.sources.scratch import cut_lineage

WEIGHTS = (1.0, 2.0, 3.0)
MOST_COPIES = 3
BLOCK_WORDS = 512
SHARDS = 16
SOURCE_GROUPS = 1024
PIECE_WORDS = 1_000_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _source_key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), source))


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_rows, source_size, target) from one row (source, source_rows, source_size) per source.

    Sources are numbered by code point over sorted ranges, and the level at which targets stop is found from
    sums, so the number of sources is not bounded.
    """
    order = [F.col("source").asc_nulls_last()]
    numbered = cut_lineage(sizes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(
        "_m", F.monotonically_increasing_id()), "quellen")
    part = F.shiftright("_m", 33)
    before = numbered.groupBy(part.alias("_p")).count().withColumn(
        "_before", F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)))
    place = F.coalesce("_before", F.lit(0)) + F.col("_m").bitwiseAND((1 << 33) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    named = cut_lineage(
        numbered.withColumn("_p", part).join(F.broadcast(before.drop("count")), "_p").withColumn("weight", weight)
        .withColumn("most", F.col("source_size") * float(most)).drop("_p", "_m", "_before"), "gewichte")
    total = float(named.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, -1
    while True:
        at_most = F.col("most") <= F.col("weight") * level
        row = named.agg(F.sum(F.when(at_most, F.col("most")).otherwise(0.0)).alias("fixed"),
                        F.sum(F.when(at_most, 0.0).otherwise(F.col("weight"))).alias("open"),
                        F.sum(F.when(at_most, 1).otherwise(0)).alias("n")).first()
        if row["n"] is None or row["n"] == full or not row["open"]:
            break
        full, level = row["n"], (total - row["fixed"]) / row["open"]
    return named.withColumn("target", F.least(F.col("most"), F.col("weight") * level)).drop("most")


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Good ones among `draws` of good + bad; beyond numpy's range by the normal law, kept in its limits."""
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, draws)) if draws else 0
    n = good + bad
    mean = draws * good / n
    spread = (mean * (bad / n) * ((n - draws) / max(1, n - 1))) ** 0.5
    return int(min(max(round(rng.normal(mean, spread)), draws - bad, 0), good, draws))


def split_counts(rng: np.random.Generator, counts: list[int], draws: int) -> list[int]:
    """How many of each kind are among `draws` drawn without putting back."""
    out, rest = [], sum(counts)
    for n in counts:
        rest -= n
        got = hypergeometric(rng, n, rest, draws)
        out.append(got)
        draws -= got
    return out


def split_tree(counts: list[int], shards: int, seed: int) -> list[list[int]]:
    """Quotas of each shard: shards x kinds; shard totals are at most one apart."""
    rng = np.random.default_rng(seed)

    def halve(have: list[int], n: int) -> list[list[int]]:
        if n == 1:
            return [have]
        left = n // 2
        drawn = split_counts(rng, have, sum(have) * left // n)
        return halve(drawn, left) + halve([a - b for a, b in zip(have, drawn)], n - left)

    return halve(list(counts), shards)


def _quotas(counts: DataFrame, shards: int, seed: int) -> DataFrame:
    """(key, bounds): where each shard's run ends in the permuted blocks of a source."""
    grouped = counts.withColumn("_g", F.pmod(F.xxhash64("key"), F.lit(SOURCE_GROUPS)))
    groups = {g: n for g, n in grouped.groupBy("_g").agg(F.sum("n")).toPandas().sort_values("_g").itertuples(index=False)}
    tree = split_tree(list(groups.values()), shards, seed)
    quota = {g: [int(tree[s][i]) for s in range(shards)] for i, g in enumerate(groups)}

    def share(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("key")
        g = int(part["_g"].iloc[0])
        rng = np.random.default_rng([seed, g])
        left, ends = [int(n) for n in part["n"]], []
        for n in quota[g]:
            got = split_counts(rng, left, n)
            left = [a - b for a, b in zip(left, got)]
            ends.append(got)
        bounds = np.cumsum(np.array(ends), axis=0).T
        return pd.DataFrame({"key": part["key"].to_numpy(), "bounds": [b.tolist() for b in bounds]})

    return grouped.groupBy("_g").applyInPandas(share, "key string, bounds array<long>")


def mix_plan(docs: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES, block_words: int | None = BLOCK_WORDS,
             shards: int = SHARDS, seed: int = 7, *keep: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (row, doc_id, source, size), source targets, and the taken blocks.

    A block row is (row, first word, words, copy, shard, place): `words` words from `first` on are written
    to `shard` at the rank that `place` has there. With `block_words` None a block is a whole document, taken
    when more than half of it still fits the target.
    """
    rows = cut_lineage(docs.select(
        F.monotonically_increasing_id().alias("row"), docs["doc_id"].alias("doc_id"), docs["source"].alias("source"),
        word_count(docs["text"]).alias("size"), *[docs[c] for c in keep]).withColumn("key", _source_key(F.col("source"))),
        "mischung")
    targets = cut_lineage(source_targets(rows.groupBy("source").agg(
        F.count("*").alias("source_rows"), F.sum("size").alias("source_size"))).withColumn(
        "key", _source_key(F.col("source"))), "ziele")

    step = F.greatest(F.col("size"), F.lit(1)) if block_words is None else F.lit(block_words)
    cut = rows.filter("size > 0").select("row", "doc_id", "key", "size", F.explode(F.sequence(
        F.lit(0).cast("long"), F.col("size") - 1, step.cast("long"))).alias("first"))
    blocks = cut.select("row", "doc_id", "key", "first", F.least(
        F.col("size") - F.col("first"), step.cast("long")).alias("words"), F.xxhash64(
        "key", "doc_id", "row", "first", F.lit(seed)).alias("h")).withColumn("cell", F.shiftrightunsigned("h", 50))
    cells = blocks.groupBy("key", "cell").agg(F.count("*").alias("n"), F.sum("words").alias("w"))
    earlier = Window.partitionBy("key").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("rank0", F.coalesce(F.sum("n").over(earlier), F.lit(0))).withColumn(
        "words0", F.coalesce(F.sum("w").over(earlier), F.lit(0))).join(
        targets.select("key", "source_size", "target"), "key")
    inside = Window.partitionBy("key", "cell").orderBy("h", "row", "first")
    sofar = inside.rowsBetween(Window.unboundedPreceding, -1)
    ranked = blocks.withColumn("rank", F.row_number().over(inside) - 1).withColumn(
        "before", F.coalesce(F.sum("words").over(sofar), F.lit(0))).join(
        cells.select("key", "cell", "rank0", "words0", "source_size", "target"), ["key", "cell"])
    whole = F.floor(F.col("target") / F.col("source_size"))
    before = F.col("words0") + F.col("before")
    rest = F.col("target") - whole * F.col("source_size")
    if block_words is None:
        part = F.when(before + F.col("words") / 2 < rest, F.col("words")).otherwise(0)
    else:
        part = F.greatest(F.lit(0), F.least(F.col("words"), F.round(rest).cast("long") - before))
    ranked = cut_lineage(ranked.select(
        "row", "doc_id", "key", "cell", "first", "words", (F.col("rank0") + F.col("rank")).alias("rank"),
        whole.cast("int").alias("whole"), part.cast("long").alias("part")), "blocks")

    per_source = ranked.groupBy("key").agg(
        F.count("*").alias("blocks"), F.sum(F.col("whole") + F.when(F.col("part") > 0, 1).otherwise(0)).alias("n"))
    quotas = _quotas(per_source.select("key", "n"), shards, seed)
    bounds = ranked.select("key", "cell").distinct().join(
        quotas.join(per_source.select("key", "blocks"), "key"), "key")
    copies = ranked.join(bounds, ["key", "cell"]).select(
        "row", "doc_id", "key", "first", "words", "rank", "whole", "part", "bounds", "blocks",
        F.explode(F.sequence(F.lit(0), F.col("whole"))).alias("copy"))
    taken = copies.withColumn("words", F.when(F.col("copy") < F.col("whole"), F.col("words")).otherwise(
        F.col("part"))).filter("words > 0").withColumn("at", F.col("copy") * F.col("blocks") + F.col("rank"))
    shard = F.size(F.filter("bounds", lambda end: end <= F.col("at")))
    return rows, targets, taken.select(
        "row", "doc_id", "first", "words", "copy", shard.cast("int").alias("shard"),
        F.xxhash64("row", "first", "copy", F.lit(seed + 1)).alias("place"))


def shuffled(blocks: DataFrame, shards: int = SHARDS, pieces: int = 1) -> DataFrame:
    """The block rows of each output shard together and in their shuffled order, in `pieces` partitions a shard."""
    piece = F.least(F.floor((F.col("place") / 2.0**64 + 0.5) * pieces), F.lit(pieces - 1))
    return blocks.withColumn("_part", (F.col("shard") * pieces + piece).cast("int")).repartitionById(
        shards * pieces, "_part").sortWithinPartitions("shard", "place").drop("_part")


def mixed_sizes(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source, source_size, target, taken words and taken words by shard of every document."""
    rows, targets, blocks = mix_plan(docs, **options)
    by_shard = F.array(*[F.sum(F.when(F.col("shard") == s, F.col("words")).otherwise(0))
                         for s in range(options.get("shards", SHARDS))])
    taken = blocks.groupBy("row").agg(F.sum("words").alias("taken"), by_shard.alias("shard_words"))
    groups = targets.select(F.encode("key", "UTF-8").alias("group"), "source_rows", "source_size", "target")
    placed = join_groups(rows.withColumn("group", F.encode("key", "UTF-8")), groups, "group", "source_rows", rows.count())
    return placed.join(taken, "row", "left").select(
        "row", "doc_id", "source", "size", "source_size", F.col("target").cast("double").alias("target"),
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce(
            "shard_words", F.array_repeat(F.lit(0).cast("long"), options.get("shards", SHARDS))).alias("shard_words"))


def mixed_documents(docs: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES, seed: int = 7) -> DataFrame:
    """The rows of the mix: whole documents of `docs`, as often as the mix takes them, with all their columns.

    They come shard by shard, and in each shard in its shuffled order.
    """
    held = docs.withColumn("_document", F.struct(*[docs[c] for c in docs.columns]))
    rows, targets, blocks = mix_plan(held, weights, most, None, SHARDS, seed, "_document")
    words = targets.agg(F.sum("target")).first()[0] or 0
    # The taken documents are as many as the corpus has, so the join is one by shuffle at every size.
    mixed = rows.select("row", "_document").join(blocks.select("row", "shard", "place").hint("merge"), "row")
    return shuffled(mixed, SHARDS, max(1, -(-int(words) // (SHARDS * PIECE_WORDS)))).select(
        *[F.col("_document")[c].alias(c) for c in docs.columns])
