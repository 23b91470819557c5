"""N-gram Jaccard join with signature trees: all links between documents of similar shingle sets.

1. A shingle that no other set has cannot be shared, so a document with too few shared shingles to reach the
   similarity has no partner. Chunks of documents send each range of the hash space their distinct
   shingles once; what comes back is each document's shared shingles. Equal sets are taken as one from here.
2. Two similar sets share one of their first shingles in a common order (by rising number of documents, then by hash; how many
   follows from the similarity). Documents that share one fall into the same group.
3. In each group a signature tree is built: leaves are documents, nodes hold the OR of their token bitmaps and their range of
   sizes. The tree is joined with itself; node pairs are left out when their sizes, or the largest overlap that
   their bitmaps allow, rule out a link, or when all below them is connected already. Leaf pairs are decided on
   the exact sets. Groups beyond a block are cut into blocks, block results are joined over one document of
   each part found so far, and only documents outside a group's largest part meet the other blocks again.

Sets are compared by 64-bit shingle hashes (chunk and equality) and by hash range and 32 bits (overlaps).

Defined results: null or wordless texts have no shingles and link with nothing; fewer words than a shingle make one
shingle of them all. A row without doc_id links with nothing and has no component; rows with the same doc_id are one node.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from coursequarry.llm.chunks import CHUNK_BYTES, range_count, release
from coursequarry.llm.tables import connected, join_groups, pack
from coursequarry.llm.words import column_bytes, mix, shingle_hashes, word_hashes
from coursequarry.sources.scratch import cut_lineage

PERCENT = 75
BLOCK_DOCUMENTS = 4000
BLOCK_BYTES = 16_000_000
FAN = 8
_SEVERAL = np.uint32(0x80000000)  # in place of an owner: a token's number of owners in its chunk
_SENT = "key long, chunk long, doc_ids array<long>, sizes binary, prints binary, tokens binary, owners binary"
_BACK = "key long, chunk long, doc_ids array<long>, sizes binary, prints binary, tokens binary, owners binary, spread binary"
_SETS = "doc_id long, n_shingles long, print binary, tokens binary, first binary"
_EDGE = "a long, b long"


def need(size: int) -> int:
    """Shingles that a set of this size must share with any partner."""
    return -(-PERCENT * size // 100)


def linked(common, size_a, size_b, percent=PERCENT):
    """Whether the Jaccard similarity of sets of these sizes reaches the bound."""
    return (100 + percent) * common >= percent * (size_a + size_b)


# ---- shared shingles


def _chunk(doc_ids: list, texts: list[np.ndarray], ranges: int, chunk: int) -> Iterator[tuple]:
    lengths = np.array([len(t) for t in texts], np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    h, row = shingle_hashes(*word_hashes(np.concatenate(texts), offsets, lower=True))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[keep], row[keep]
    ends = np.searchsorted(row, np.arange(len(texts) + 1))
    sizes = np.diff(ends)
    prints = [hashlib.blake2b(h[ends[i]:ends[i + 1]].tobytes(), digest_size=16).digest() for i in range(len(texts))]
    lead = np.zeros(len(texts), bool)
    seen = set()
    for i, p in enumerate(prints):
        if sizes[i] and doc_ids[i] is not None and p not in seen:
            lead[i] = True
            seen.add(p)
    h, row = h[lead[row]], row[lead[row]]
    order = np.argsort(h, kind="stable")
    h, row = h[order], row[order]
    new = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, len(h)))
    where = ((h >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    token = where << np.uint64(32) | (h & np.uint64(0xFFFFFFFF))
    many = (count > 1)[np.cumsum(new) - 1] if len(h) else np.zeros(0, bool)
    yield (-1 - chunk, chunk, doc_ids, pack(sizes), b"".join(prints), pack(token[many]), pack(row[many].astype(np.uint32)))
    u, owner = token[start], np.where(count > 1, _SEVERAL | count.astype(np.uint32), row[start].astype(np.uint32))
    # By owner within a range: runs of equal owners take next to no room in the shuffle.
    order = np.argsort(np.where(count > 1, 0xFFFF, row[start]).astype(np.uint16), kind="stable")
    order = order[np.argsort(where[start][order].astype(np.uint32), kind="stable")]
    u, owner = u[order], owner[order]
    at = np.searchsorted(where[start], np.arange(ranges + 1, dtype=np.uint64))
    for r in np.flatnonzero(np.diff(at)).tolist():
        lo, hi = at[r], at[r + 1]
        yield (r, chunk, None, None, None, pack(u[lo:hi].astype(np.uint32)), pack(owner[lo:hi]))


def _send(docs: DataFrame, ranges: int) -> DataFrame:
    def out(rows):
        key, chunk, ids, sizes, prints, tokens, owners = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(key, pa.int64()), pa.array(chunk, pa.int64()), pa.array(ids, pa.list_(pa.int64())),
             *[pa.array(c, pa.binary()) for c in (sizes, prints, tokens, owners)]],
            ["key", "chunk", "doc_ids", "sizes", "prints", "tokens", "owners"])

    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        ids, texts, size = [], [], 0
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                text = data[offsets[i]:offsets[i + 1]]
                if ids and size + len(text) > CHUNK_BYTES:
                    yield out(list(_chunk(ids, texts, ranges, part << 32 | number)))
                    ids, texts, size, number = [], [], 0, number + 1
                ids.append(doc_id), texts.append(text.copy())
                size += len(text)
        if ids:
            yield out(list(_chunk(ids, texts, ranges, part << 32 | number)))

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(run, _SENT)


def _meet(part: pd.DataFrame) -> pd.DataFrame:
    """One hash range: tokens of several documents go back to every chunk that has them, with their number of documents."""
    columns = ["key", "chunk", "doc_ids", "sizes", "prints", "tokens", "owners"]
    if part["key"].iloc[0] < 0:
        return part[columns].assign(spread=None)
    tokens = np.concatenate([np.frombuffer(t, np.uint32) for t in part["tokens"]])
    owners = np.concatenate([np.frombuffer(o, np.uint32) for o in part["owners"]])
    lengths = np.array([len(t) // 4 for t in part["tokens"]])
    order = np.argsort(tokens, kind="stable")
    group = np.concatenate([[0], np.cumsum(tokens[order][1:] != tokens[order][:-1])])
    several = owners >= _SEVERAL
    weight = np.bincount(group, np.where(several, owners & ~_SEVERAL, 1)[order])
    spread = np.zeros(len(tokens), np.uint32)
    spread[order] = np.minimum(weight[group], 2**32 - 1).astype(np.uint32)
    key = int(part["key"].iloc[0])
    out, at = [], 0
    for chunk, n in zip(part["chunk"], lengths):
        shared = np.flatnonzero(spread[at:at + n] > 1) + at
        if len(shared):
            out.append((key, chunk, None, None, None, pack(tokens[shared]), pack(owners[shared]), pack(spread[shared])))
        at += n
    return pd.DataFrame(out, columns=[*columns, "spread"])


def _gather(part: pd.DataFrame) -> pd.DataFrame:
    """One chunk: every document with its size; the shared shingles of those that may have a partner.

    A document's first shingles are the rarest among the shared ones, as many as leave too few for a partner
    that has none of them.
    """
    heads = part["doc_ids"].notna()
    head, replies = part[heads].iloc[0], part[~heads]
    sizes = np.frombuffer(head["sizes"], np.int64)
    answered = np.concatenate([np.zeros(0, np.uint64), *(
        np.frombuffer(t, np.uint32) | np.uint64(k) << np.uint64(32) for t, k in zip(replies["tokens"], replies["key"]))])
    owner, count = (np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(x, np.uint32) for x in replies[c])])
                    for c in ("owners", "spread"))
    order = np.argsort(answered, kind="stable")
    answered, owner, count = answered[order], owner[order], count[order]
    inside, inside_owner = np.frombuffer(head["tokens"], np.uint64), np.frombuffer(head["owners"], np.uint32)
    single = owner < _SEVERAL
    tokens = np.concatenate([answered[single], inside])
    owners = np.concatenate([owner[single], inside_owner]).astype(np.int64)
    counts = np.concatenate([count[single], count[np.searchsorted(answered, inside)] if len(inside) else count[:0]])
    order = np.lexsort((tokens, counts, owners))
    tokens, owners = tokens[order], owners[order]
    ends = np.searchsorted(owners, np.arange(len(sizes) + 1))
    sets, first = [None] * len(sizes), [None] * len(sizes)
    for i, n in enumerate(sizes.tolist()):
        own = tokens[ends[i]:ends[i + 1]]
        if n and len(own) >= need(n):
            sets[i], first[i] = pack(np.sort(own)), pack(own[:len(own) - need(n) + 1])
    return pd.DataFrame({
        "doc_id": pd.array(list(head["doc_ids"]), "Int64"), "n_shingles": sizes,
        "print": [head["prints"][16 * i:16 * i + 16] for i in range(len(sizes))], "tokens": sets, "first": first})


def shingle_sets(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, print of the set, and its shared tokens where it may have a partner."""
    ranges = range_count(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    met = _send(docs, ranges).groupBy("key").applyInPandas(_meet, _BACK)
    return cut_lineage(met.groupBy("chunk").applyInPandas(_gather, _SETS), "mengen")


# ---- groups


def _pairs_of(tokens: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (smallest, other) ids over all tokens; and for each token its first place in token order."""
    order = np.lexsort((ids, tokens))
    t, i = tokens[order], ids[order]
    start = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else np.zeros(0, np.int64)
    least = np.repeat(i[start], np.diff(np.append(start, len(t))))
    pairs = np.unique(np.stack([least, i], 1)[least != i], axis=0) if len(t) else np.zeros((0, 2), np.int64)
    return pairs, t[start], i[start]


def token_edges(sets: DataFrame, ranges: int) -> DataFrame:
    """(a, b): a path of edges joins any two sets (id, first) with a common one among their first tokens."""

    def send(batches):
        own = -1 - TaskContext.get().partitionId()
        for batch in batches:
            token, owner = [], []
            for i, t in zip(batch.column("id").to_pylist(), batch.column("first").to_pylist()):
                token.append(np.frombuffer(t, np.uint64)), owner.append(np.full(len(t) // 8, i, np.int64))
            pairs, t, i = _pairs_of(np.concatenate(token), np.concatenate(owner))
            spread = mix(t)
            order = np.argsort(spread)
            t, i = t[order], i[order]
            at = np.searchsorted(((spread[order] >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32),
                                 np.arange(ranges + 1, dtype=np.uint64))
            rows = [(own, pack(pairs[:, 0]), pack(pairs[:, 1]))] + [
                (r, pack(t[at[r]:at[r + 1]]), pack(i[at[r]:at[r + 1]])) for r in np.flatnonzero(np.diff(at)).tolist()]
            key, x, y = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(x, pa.binary()), pa.array(y, pa.binary())],
                                             ["key", "x", "y"])

    def meet(part: pd.DataFrame) -> pd.DataFrame:
        x = b"".join(part["x"])
        y = np.frombuffer(b"".join(part["y"]), np.int64)
        if part["key"].iloc[0] < 0:
            pairs = np.unique(np.stack([np.frombuffer(x, np.int64), y], 1), axis=0)
        else:
            pairs = _pairs_of(np.frombuffer(x, np.uint64), y)[0]
        return pd.DataFrame(pairs, columns=["a", "b"])

    return sets.select("id", "first").mapInArrow(send, "key long, x binary, y binary").groupBy("key").applyInPandas(
        meet, _EDGE)


# ---- signature trees


class Tree:
    """Levels of nodes over sets in an order that keeps like ones near each other; level 0 are the sets."""

    def __init__(self, sizes: np.ndarray, sets: list[np.ndarray], bits: int):
        n = len(sets)
        lengths = np.array([len(s) for s in sets])
        flags = np.zeros((n, bits), bool)
        flags[np.repeat(np.arange(n), lengths), (np.concatenate(sets) & np.uint64(bits - 1)).astype(np.int64)] = True
        maps = np.packbits(flags, axis=1).view(np.uint64)
        over = lengths - flags.sum(axis=1)
        self.levels = [(maps, sizes, sizes, lengths, over)]
        while len(self.levels[-1][0]) > 1:
            maps, low, high, most, over = self.levels[-1]
            at = np.arange(0, len(maps), FAN)
            self.levels.append((np.bitwise_or.reduceat(maps, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at),
                                np.maximum.reduceat(most, at), np.maximum.reduceat(over, at)))
        self.n = n

    def below(self, level: int, i: int) -> tuple[int, int]:
        return i * FAN**level, min(self.n, (i + 1) * FAN**level)

    def children(self, level: int, i: int) -> range:
        return range(i * FAN, min((i + 1) * FAN, len(self.levels[level - 1][0])))


def may_link(tree: Tree, left: range, right: range, level: int, percent=PERCENT) -> np.ndarray:
    """Which node pairs can hold a link, by sizes and by the largest overlap of the bitmaps."""
    map_a, low_a, high_a, most_a, over_a = (x[left.start:left.stop] for x in tree.levels[level])
    map_b, low_b, high_b, most_b, over_b = (x[right.start:right.stop] for x in tree.levels[level])
    common = np.bitwise_count(map_a[:, None, :] & map_b[None, :, :]).sum(axis=2) + np.minimum(over_a[:, None], over_b[None, :])
    common = np.minimum(common, np.minimum(most_a[:, None], most_b[None, :]))
    return (linked(common.astype(np.int64), low_a[:, None], low_b[None, :], percent)
            & (100 * high_a[:, None] >= percent * low_b[None, :]) & (100 * high_b[None, :] >= percent * low_a[:, None]))


class TreeJoin:
    """Links that connect sets of one block, one for each pair of parts joined."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray], parts: np.ndarray | None = None,
                 percent=PERCENT):
        order = np.lexsort((sizes, [int(s[0]) if len(s) else 0 for s in sets])) if len(sets) else np.zeros(0, np.int64)
        self.ids, self.sizes, self.sets = ids[order], sizes[order], [sets[i] for i in order]
        self.part = np.arange(len(ids)) if parts is None else np.unique(parts[order], return_inverse=True)[1]
        self.found: list[tuple[int, int]] = []
        self.percent = percent

    def bits(self) -> int:
        middle = max(1, int(np.median([len(s) for s in self.sets])))
        return 1 << min(12, max(6, int(np.ceil(np.log2(2 * middle)))))

    def join_self(self) -> list[tuple[int, int]]:
        if len(self.ids) > 1:
            tree = Tree(self.sizes, self.sets, self.bits())
            self._self(tree, len(tree.levels) - 1, 0)
        return self.found

    def _one(self, *ranges: tuple[int, int]) -> bool:
        first = self.part[ranges[0][0]]
        return all((self.part[lo:hi] == first).all() for lo, hi in ranges)

    def _self(self, tree: Tree, level: int, i: int) -> None:
        if level == 0 or self._one(tree.below(level, i)):
            return
        own = tree.children(level, i)
        for c in own:
            self._self(tree, level - 1, c)
        may = may_link(tree, own, own, level - 1, self.percent)
        for x in range(len(own)):
            for y in range(x + 1, len(own)):
                if may[x, y]:
                    self._pair(tree, level - 1, own[x], own[y])

    def _pair(self, tree: Tree, level: int, i: int, j: int) -> None:
        if self._one(tree.below(level, i), tree.below(level, j)):
            return
        if level == 0:
            self._decide(i, j)
            return
        own, other = tree.children(level, i), tree.children(level, j)
        for x, y in zip(*np.nonzero(may_link(tree, own, other, level - 1, self.percent))):
            self._pair(tree, level - 1, own[x], other[y])

    def _decide(self, x: int, y: int) -> None:
        common = len(np.intersect1d(self.sets[x], self.sets[y], assume_unique=True))
        if linked(common, self.sizes[x], self.sizes[y], self.percent):
            self.found.append((int(self.ids[x]), int(self.ids[y])))
            self.part[self.part == self.part[y]] = self.part[x]


def join_block(block: pd.DataFrame, percent) -> pd.DataFrame:
    block = block.drop_duplicates("id")
    sets = [np.frombuffer(t, np.uint64) for t in block["tokens"]]
    parts = block["part"].to_numpy() if "part" in block else None
    join = TreeJoin(block["id"].to_numpy(np.int64), block["n"].to_numpy(np.int64), sets, parts, percent)
    join.join_self()
    if parts is not None:
        return pd.DataFrame(np.array(join.found, np.int64).reshape(-1, 2), columns=["a", "b"])
    least = pd.Series(join.ids).groupby(join.part).transform("min").to_numpy()
    return pd.DataFrame({"a": join.ids, "b": least})[join.ids != least]


def _join_block(block: pd.DataFrame) -> pd.DataFrame:
    return join_block(block, PERCENT)


def _sliced(sets: DataFrame) -> tuple[DataFrame, bool]:
    """The sets (group, id, n, tokens) with the slice of their group; whether any group has more than one."""
    groups = cut_lineage(sets.groupBy("group").agg(
        F.count("*").alias("members"), F.sum(F.length("tokens")).alias("bytes")).select(
        F.col("group").cast("string").cast("binary").alias("key"), "members", F.greatest(
            F.ceil(F.col("members") / BLOCK_DOCUMENTS), F.ceil(F.col("bytes") / BLOCK_BYTES)).alias("slices")), "gruppen")
    row = groups.agg(F.max("slices"), F.sum("members")).first()
    keyed = sets.withColumn("key", F.col("group").cast("string").cast("binary"))
    joined = join_groups(keyed, groups, "key", "members", row[1] or 0)
    return joined.withColumn("slice", F.pmod(F.xxhash64("id"), F.greatest("slices", F.lit(1)))).drop("key", "members"), \
        (row[0] or 0) > 1


def _labelled(sets: DataFrame, edges: DataFrame) -> DataFrame:
    labels = connected(edges, "teile").select(F.col("node").alias("id"), F.col("label").alias("part"))
    return cut_lineage(sets.join(labels, "id", "left").withColumn("part", F.coalesce("part", "id")), "teile")


def group_labels(sets: DataFrame) -> DataFrame:
    """(a, b): every set (group, id, n, tokens) that verified links lead to a smaller one from, and the smallest of them.

    A group of one block is settled in it. The blocks of larger groups are linked further and their parts found by
    `connected`.
    """
    sliced, large = _sliced(sets)
    sliced = cut_lineage(sliced, "bloecke")
    if not large:
        return sliced.groupBy("group", "slice").applyInPandas(_join_block, _EDGE)
    whole = sliced.filter("slices = 1").groupBy("group", "slice").applyInPandas(_join_block, _EDGE)
    members = sliced.filter("slices > 1")
    edges = cut_lineage(members.groupBy("group", "slice").applyInPandas(_join_block, _EDGE), "kanten")
    members = members.drop("slice", "slices")
    for _ in range(20):  # join the blocks' parts over one document of each
        labelled = _labelled(members, edges)
        heads = labelled.filter("id = part").drop("part")
        open_groups = heads.groupBy("group").count().filter("count > 1").select("group")
        again, large = _sliced(cut_lineage(heads.join(open_groups, "group", "left_semi"), "koepfe"))
        more = cut_lineage(again.groupBy("group", "slice").applyInPandas(_join_block, _EDGE), "kanten")
        grown = more.limit(1).count() > 0
        edges = edges.unionByName(more)
        if not large or not grown:
            break
    parts = connected(edges.unionByName(_rest_links(members, edges)), "teile")
    return whole.unionByName(parts.filter("node <> label").toDF("a", "b"))


def overlapping_links(sets: DataFrame, percent) -> DataFrame:
    """(a, b): links that connect the sets (group, id, n, tokens) of every group; a set may be in several groups.

    A group of one block is settled in it. Larger ones go on over one set of each part found in the group, then
    the sets outside a group's largest part meet all its others, so no pair of a group is left out.
    """
    def join(block: pd.DataFrame) -> pd.DataFrame:
        return join_block(block, percent)

    sliced, large = _sliced(sets)
    sliced = cut_lineage(sliced, "bloecke")
    edges = cut_lineage(sliced.groupBy("group", "slice").applyInPandas(join, _EDGE), "kanten")
    if not large:
        return edges
    members = sliced.filter("slices > 1").drop("slice", "slices")
    labelled = _labelled(members, edges)
    heads = labelled.groupBy("group", "part").agg(F.min("id").alias("id"))
    again, _ = _sliced(cut_lineage(labelled.drop("part").join(heads.drop("part"), ["group", "id"], "left_semi"), "koepfe"))
    edges = edges.unionByName(cut_lineage(again.groupBy("group", "slice").applyInPandas(join, _EDGE), "kanten"))
    return edges.unionByName(_rest_links(members, edges, join))


def _rest_links(members: DataFrame, edges: DataFrame, join=_join_block) -> DataFrame:
    """Links between a group's documents outside its largest part and all its others."""
    labelled = _labelled(members, edges)
    counts = cut_lineage(labelled.groupBy("group", "part").count(), "anteile")
    largest = counts.groupBy("group").agg(
        F.max_by("part", F.struct("count", "part")).alias("largest"), F.sum("count").alias("members"),
        F.count("*").alias("parts")).filter("parts > 1").drop("parts")
    sides = labelled.join(cut_lineage(largest, "groesste"), "group").withColumn(
        "slices", F.ceil(F.col("members") / (BLOCK_DOCUMENTS // 2)))
    minor = sides.filter("part <> largest")
    small = cut_lineage(minor.groupBy("group").agg(F.ceil(F.count("*") / (BLOCK_DOCUMENTS // 2)).alias("minor_slices")), "kleine")
    every = sides.join(small, "group").withColumn("i", F.pmod(F.xxhash64("id"), F.col("slices"))).withColumn(
        "j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("minor_slices") - 1)))
    few = minor.join(small, "group").withColumn("j", F.pmod(F.xxhash64("id"), F.col("minor_slices"))).withColumn(
        "i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
    columns = ["group", "i", "j", "id", "n", "tokens", "part"]
    both = every.select(*columns).unionByName(few.select(*columns))  # documents of one part are not compared
    return cut_lineage(both.groupBy("group", "i", "j").applyInPandas(join, _EDGE), "kanten")


def similar_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    spark = docs.sparkSession
    sets = shingle_sets(docs)
    release(spark)
    known = sets.filter("n_shingles > 0 and doc_id is not null")
    classes = cut_lineage(known.groupBy("print").agg(
        F.min("doc_id").alias("id"), F.count("*").alias("copies"), F.max("n_shingles").alias("n"),
        F.max(F.struct("tokens", "first")).alias("set")), "klassen")
    candidates = classes.filter("set.tokens is not null").select("id", "n", "set.tokens", "set.first")
    size = candidates.agg(F.sum(F.length("first"))).first()[0] or 0
    groups = connected(token_edges(candidates, range_count(size)), "gruppen")
    labels = group_labels(cut_lineage(candidates.drop("first").join(groups.select(
        F.col("node").alias("id"), F.col("label").alias("group")), "id"), "kandidaten"))
    labels = labels.select(F.col("a").alias("id"), F.col("b").alias("label"))
    # Every class of a component leads to its smallest one, which has no row of its own.
    labels = cut_lineage(labels.unionByName(labels.select(F.col("label").alias("id"), "label").distinct()), "komponenten")
    release(spark)
    found = classes.select("print", "id", "copies").join(labels, "id", "left").filter(
        "copies > 1 or label is not null").select("print", "copies", F.coalesce("label", "id").alias("component"))
    rows = sets.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("print")).alias("print"))
    joined = join_groups(rows, cut_lineage(found, "ergebnis"), "print", "copies", rows.count())
    return joined.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(
        F.coalesce("component", "doc_id")).alias("component_id"))


def drop_similar(docs: DataFrame) -> DataFrame:
    """The rows of `docs` but one document for each component: the one with the smallest doc_id."""
    found = similar_documents(docs).filter("doc_id is not null and doc_id <> component_id").select(
        F.col("doc_id").alias("_gone")).distinct()
    return docs.join(cut_lineage(found, "weg"), docs["doc_id"].cast("long") == F.col("_gone"), "left_anti")
