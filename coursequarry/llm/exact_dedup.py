"""Exact dedup against a minimal perfect hash over the distinct digests of earlier documents.

History is reduced to one row per distinct SHA-256 digest. Digests are dealt to shards; each shard is one
row of the index: the level bitmaps of a minimal perfect hash, and slots that hold the full digest, the
locator of the winning row and the number of rows. A batch is reduced the same way before it is shuffled, its
digests are looked up slot by slot and compared byte for byte, members join the slot's group and the others
form groups of their own.

Defined results: null text counts as the empty text. Of equal texts the row with the largest doc_id stays; a
null doc_id is smaller than any other, and of rows that share the doc_id as well exactly one stays. An empty
table gives an empty result. Other columns of the input are ignored by name.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from coursequarry.llm.tables import join_groups
from coursequarry.llm.words import mix
from coursequarry.sources.scratch import cut_lineage

SHARD_DIGESTS = 2_000
INDEX_SCHEMA = "shard long, n long, levels binary, digests binary, winners binary, places binary, counts binary"
_GROUP_SCHEMA = "digest binary, keep_id long, keep_row long, group_size long, member boolean"
_NO_ID = -(2**63)


def _keys(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words = np.ascontiguousarray(digests).view(np.uint64).reshape(len(digests), 4)
    return mix(words[:, 0] ^ (words[:, 2] << np.uint64(1))), mix(words[:, 1] + words[:, 3]) | np.uint64(1)


def build_hash(digests: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Level bitmaps of a minimal perfect hash over distinct digests (n x 32 bytes), and the slot of each.

    On each level the digests left over are hashed into twice as many places; those alone in theirs get it,
    the others go on to the next level. A digest's slot is the number of places taken before its own.
    """
    a, b = _keys(digests)
    left, levels, slots, taken, level = np.arange(len(digests)), [], np.zeros(len(digests), np.int64), 0, 0
    while len(left):
        size = -(-max(16, 2 * len(left)) // 8) * 8
        place = ((a[left] + np.uint64(level) * b[left]) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(place, minlength=size) == 1
        settled = alone[place]
        rank = np.cumsum(alone) - 1
        slots[left[settled]] = taken + rank[place[settled]]
        taken += int(settled.sum())
        levels.append(struct.pack("<q", size) + np.packbits(alone).tobytes())
        left, level = left[~settled], level + 1
        if level % 64 == 0:  # the same step for two digests would never part them
            a, b = mix(a ^ b), mix(b) | np.uint64(1)
    return b"".join(levels), slots


def find_slots(levels: bytes, digests: np.ndarray) -> np.ndarray:
    """The only slot that may hold each digest, or -1 where no level has a place for it."""
    a, b = _keys(digests)
    slots, left, taken, level, at = np.full(len(digests), -1, np.int64), np.arange(len(digests)), 0, 0, 0
    while at < len(levels) and len(left):
        size = struct.unpack_from("<q", levels, at)[0]
        alone = np.unpackbits(np.frombuffer(levels, np.uint8, size // 8, at + 8)).astype(bool)
        place = ((a[left] + np.uint64(level) * b[left]) % np.uint64(size)).astype(np.int64)
        hit = alone[place]
        slots[left[hit]] = taken + (np.cumsum(alone) - 1)[place[hit]]
        left, taken, level, at = left[~hit], taken + int(alone.sum()), level + 1, at + 8 + size // 8
        if level % 64 == 0:
            a, b = mix(a ^ b), mix(b) | np.uint64(1)
    return slots


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, 32)


def digest_rows(docs: DataFrame, *keep: str) -> DataFrame:
    """(row, doc_id, digest, kept columns) of every row; written, so that row numbers stay what they are."""
    return cut_lineage(docs.select(
        F.monotonically_increasing_id().alias("row"), docs["doc_id"].cast("long").alias("doc_id"),
        F.unhex(F.sha2(F.coalesce(docs["text"], F.lit("")), 256)).alias("digest"), *[docs[c] for c in keep]), "kopien")


def _grouped(rows: DataFrame, shards: int) -> DataFrame:
    """One row per distinct digest: its winner, its size, its shard."""
    first = F.max(F.struct(F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"), (-F.col("row")).alias("row")))
    return rows.groupBy("digest").agg(first.alias("w"), F.count("*").alias("n")).select(
        F.pmod(F.xxhash64("digest"), F.lit(shards)).alias("shard"), "digest", F.col("w.id").alias("winner"),
        (-F.col("w.row")).alias("place"), "n")


def build_index(rows: DataFrame, shards: int) -> DataFrame:
    """The index over the digests of `rows` (row, doc_id, digest): one row per shard."""

    def build(part: pd.DataFrame) -> pd.DataFrame:
        digests = _matrix(part["digest"])
        levels, slots = build_hash(digests)
        order = np.argsort(slots)
        return pd.DataFrame({
            "shard": part["shard"].iloc[:1], "n": [len(part)], "levels": [levels],
            "digests": [digests[order].tobytes()],
            **{name: [part[c].to_numpy(np.int64)[order].tobytes()]
               for name, c in (("winners", "winner"), ("places", "place"), ("counts", "n"))},
        })

    return _grouped(rows, shards).groupBy("shard").applyInPandas(build, INDEX_SCHEMA)


def look_up(rows: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """All groups of history and batch together: digest, winner, size, and whether history has the digest."""

    def resolve(index_part: pd.DataFrame, batch: pd.DataFrame) -> pd.DataFrame:
        new = _matrix(batch["digest"])
        winner, place, n = (batch[c].to_numpy(np.int64).copy() for c in ("winner", "place", "n"))
        if not len(index_part):
            return _groups(new, winner, place, n, np.zeros(len(new), bool))
        shard = index_part.iloc[0]
        held = np.frombuffer(shard["digests"], np.uint8).reshape(-1, 32)
        old = [np.frombuffer(shard[c], np.int64).copy() for c in ("winners", "places", "counts")]
        slot = find_slots(shard["levels"], new)
        member = slot >= 0
        member[member] = (held[slot[member]] == new[member]).all(axis=1)
        at = slot[member]
        later = (winner[member] > old[0][at]) | ((winner[member] == old[0][at]) & (place[member] < old[1][at]))
        old[0][at[later]], old[1][at[later]] = winner[member][later], place[member][later]
        old[2][at] += n[member]
        rest = ~member
        return pd.concat([_groups(held, *old, np.ones(len(held), bool)),
                          _groups(new[rest], winner[rest], place[rest], n[rest], member[rest])])

    batch = _grouped(rows, shards)
    return index.groupBy("shard").cogroup(batch.groupBy("shard")).applyInPandas(resolve, _GROUP_SCHEMA)


def _groups(digests, winner, place, n, member) -> pd.DataFrame:
    return pd.DataFrame({"digest": [d.tobytes() for d in digests], "keep_id": pd.array(
        np.where(winner == _NO_ID, 0, winner), "Int64").copy(), "keep_row": place, "group_size": n, "member": member}
    ).assign(keep_id=lambda d: d["keep_id"].mask(pd.Series(winner == _NO_ID)))


def resolve_copies(rows: DataFrame, history: str) -> DataFrame:
    """Every row of `digest_rows` with keep_id, group_size and kept; `history` is the condition of earlier rows.

    Rows of groups of one never take part in the last join's groups, so it moves little; hot groups are
    broadcast (see `join_groups`).
    """
    total = rows.count()
    shards = max(1, -(-total // SHARD_DIGESTS))
    index = build_index(rows.filter(history), shards)
    groups = look_up(rows.filter(f"not ({history})"), index, shards).filter("group_size > 1")
    groups = cut_lineage(groups.drop("member"), "gruppen")
    joined = join_groups(rows, groups, "digest", "group_size", total)
    alone = F.col("group_size").isNull()
    return joined.select(
        *rows.columns, F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"))


def exact_dedup(docs: DataFrame, history_share: int = 2) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row.

    One row in `history_share`, by a hash of its doc_id, stands for what was delivered earlier and is indexed; the
    others are looked up.
    """
    history = f"pmod(xxhash64(doc_id), {history_share}) = 0"
    return resolve_copies(digest_rows(docs), history).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, history_share: int = 2) -> DataFrame:
    """The rows of `docs` that stay, with all their columns."""
    rows = digest_rows(docs)
    kept = cut_lineage(resolve_copies(rows, f"pmod(xxhash64(doc_id), {history_share}) = 0").filter("kept").select(
        F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")), "bleibt")
    repeated = rows.groupBy("doc_id", "digest").count().filter("count > 1").limit(1).count() > 0
    digest = F.unhex(F.sha2(F.coalesce(docs["text"], F.lit("")), 256))
    out = docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept["_id"]) & (digest == kept["_digest"]), "left_semi")
    if not repeated:
        return out
    # Rows given twice with their doc_id: partial aggregation leaves one of each before the shuffle.
    tagged = out.withColumn("_copy", F.sha2(F.coalesce("text", F.lit("")), 256))
    return tagged.dropDuplicates(["doc_id", "_copy"]).drop("_copy")
