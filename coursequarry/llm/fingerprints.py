"""Document fingerprints: MinHash with many universal hash permutations over word shingles.

A fingerprint is, for each of `PERMUTATIONS` maps x -> a * x + b (mod 2**32, a odd), the smallest value over the
text's distinct 5-word shingles; numpy applies a map to all shingles of a block of texts at once. The share of equal
places estimates the Jaccard similarity. `near_classes` joins bands of the signatures in Spark and decides every pair
of a bucket on the exact Jaccard similarity of the shingle sets, large buckets in blocks.

Defined results: null is the empty text; texts without words share one fingerprint that no other text has, and are
alike (1.0) to each other; texts of fewer words than a shingle have their whole sequence as the only one. Rows
without doc_id come after all others in descending order, rows with equal doc_id in order of their text. A table of
one row is its own next row; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from coursequarry.llm.jaccard_join import overlapping_links
from coursequarry.llm.tables import connected, join_groups, pack, range_bounds
from coursequarry.llm.words import column_bytes, row_blocks, shingle_hashes, word_hashes
from coursequarry.sources.scratch import cut_lineage

PERMUTATIONS = 64
BAND_ROWS = 3
SIMILARITY = 0.75
PART_BYTES = 24_000_000
EMPTY = np.uint32(0xFFFFFFFF)
_RNG = np.random.default_rng(20_240)
_A = _RNG.integers(0, 1 << 32, 256, np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, 256, np.uint32)


def signatures(data: np.ndarray, offsets: np.ndarray, permutations: int = PERMUTATIONS) -> np.ndarray:
    """rows x permutations; `data` and `offsets` as of `words.column_bytes`."""
    out = np.full((len(offsets) - 1, permutations), EMPTY, np.uint32)
    for i, j in row_blocks(offsets, 1 << 20):
        words, first = word_hashes(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
        h, row = shingle_hashes(words, first)
        if not len(h):
            continue
        h = (h >> np.uint64(32)).astype(np.uint32)
        starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        own = row[starts] + i
        for k in range(permutations):
            # The last value is left to texts without words.
            out[own, k] = np.minimum(np.minimum.reduceat(h * _A[k] + _B[k], starts), EMPTY - np.uint32(1))
    return out


def text_signatures(texts: Sequence[str], permutations: int = PERMUTATIONS) -> np.ndarray:
    return signatures(*column_bytes(pa.array(texts, pa.large_string())), permutations)


def hex_of(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame, permutations: int = PERMUTATIONS) -> DataFrame:
    """doc_id, fingerprint and the number of code points of every row."""

    def run(batches):
        for batch in batches:
            sig = signatures(*column_bytes(batch.column("text")), permutations)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array([hex_of(s) for s in sig], pa.string())],
                ["doc_id", "fingerprint"])

    return docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text")).mapInArrow(
        run, "doc_id long, fingerprint string")


def _range_of(value: Column, bounds: list) -> Column:
    """The number of bounds that are not above the value: a binary search in a constant array, whatever their number."""
    if not bounds:
        return F.lit(0)
    listed = F.array(*[F.lit(b) for b in bounds])
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    # A step past the last bound compares with null.
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda found, step: found + F.when(
        F.get(listed, found + step - 1) <= value, step).otherwise(0))


def with_next(docs: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """Partitions of (guest, doc_id, text) in descending doc_id order, each with the row that follows its last.

    Ranges of doc_id are cut by quantiles; the first row of each range is also sent, as a guest, to the
    range before it, and the very first one to the last range. Texts are shuffled once. The driver holds three
    numbers a range, in arrays that a row looks up by its range, so the plan is as deep for thousands of ranges as for two.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bounds = range_bounds(rows, "doc_id", max(1, -(-size // part_bytes)))
    n = len(bounds) + 1
    place = F.when(F.col("doc_id").isNull(), F.lit(n)).otherwise(F.lit(n - 1) - _range_of(F.col("doc_id"), bounds))
    heads = dict(rows.groupBy(place.alias("r")).agg(F.max("doc_id")).collect())  # n + 1 rows at most
    filled = sorted(heads)
    before = {r: filled[i - 1] for i, r in enumerate(filled)}  # the one before the first is the last
    head, goes_to = (F.array(*[F.lit(of.get(r)).cast(kind) for r in range(n + 1)]) for of, kind in ((heads, "long"), (before, "int")))
    copies = F.array(F.struct(F.col("part"), F.lit(0).alias("guest")),
                     F.struct(F.when(F.col("doc_id").eqNullSafe(F.get(head, F.col("part"))), F.get(goes_to, F.col("part"))).alias("part"),
                              F.lit(1).alias("guest")))
    return rows.withColumn("part", place.cast("int")).withColumn(
        "_c", F.explode(F.filter(copies, lambda c: c["part"].isNotNull()))).select(
        "_c.part", "_c.guest", "doc_id", "text").repartitionById(n + 1, "part").sortWithinPartitions(
        "guest", F.col("doc_id").desc_nulls_last(), "text").select("guest", "doc_id", "text")


_EDITED = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double")


def edited_fingerprints(docs: DataFrame, permutations: int = PERMUTATIONS, part_bytes: int = PART_BYTES) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose second half is the start of the next text."""

    def run(batches):
        held = None
        for batch in batches:
            guests, ids = batch.column("guest").to_pylist(), batch.column("doc_id").to_pylist()
            texts = [t or "" for t in batch.column("text").to_pylist()]
            lo = 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size < 1 << 21):
                    size, hi = size + len(texts[hi]), hi + 1
                held, done = _pairs(held, list(zip(guests[lo:hi], ids[lo:hi], texts[lo:hi])), permutations)
                lo = hi
                if done is not None:
                    yield done

    return with_next(docs, part_bytes).mapInArrow(run, _EDITED)


def _pairs(held, rows, permutations):
    """Results of all rows but the last, which waits for the row after it."""
    sig = text_signatures([t for _, _, t in rows], permutations)
    rows = [(g, i, t, s) for (g, i, t), s in zip(rows, sig)]
    if held is not None:
        rows.insert(0, held)
    own = [(a, b) for a, b in zip(rows, rows[1:]) if not a[0]]
    if not own:
        return rows[-1], None
    edited = []
    for (_, _, text, _), (_, _, after, _) in own:
        k = len(text) // 2
        edited.append(text[:len(text) - k] + after[:k])
    edited_sig = text_signatures(edited, permutations)
    now = np.array([a[3] for a, _ in own])
    following = np.array([b[3] for _, b in own])
    return rows[-1], pa.RecordBatch.from_arrays([
        pa.array([a[1] for a, _ in own], pa.int64()), pa.array([len(a[2]) for a, _ in own], pa.int64()),
        pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
        pa.array([hex_of(s) for s in now], pa.string()), pa.array([hex_of(s) for s in edited_sig], pa.string()),
        pa.array((now == edited_sig).mean(axis=1)), pa.array((now == following).mean(axis=1)),
    ], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def _print_sets(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, number and sorted hashes of the shingles, and their print, of every row."""

    def run(batches):
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            prints, sizes, tokens, marks = [], [], [], []
            for i, j in row_blocks(offsets, 1 << 20):
                part, ends = data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
                prints += [hex_of(s) for s in signatures(part, ends)]
                h, row = shingle_hashes(*word_hashes(part, ends))
                for own in np.split(h, np.searchsorted(row, np.arange(1, j - i))):
                    own = np.unique(own)
                    sizes.append(len(own)), tokens.append(pack(own))
                    marks.append(hashlib.blake2b(tokens[-1], digest_size=16).digest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(prints, pa.string()), pa.array(sizes, pa.int64()),
                 pa.array(tokens, pa.binary()), pa.array(marks, pa.binary())],
                ["doc_id", "fingerprint", "n", "tokens", "print"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(
        run, "doc_id long, fingerprint string, n long, tokens binary, print binary")


def band_groups(prints: DataFrame, band_rows: int = BAND_ROWS) -> DataFrame:
    """(group, id): the members of every bucket of a band that holds several; of buckets with the same members one."""
    width = 8 * band_rows
    bands = F.transform(F.sequence(F.lit(0), F.floor(F.length("fingerprint") / width).cast("int") - 1),
                        lambda k: F.xxhash64(k, F.substring(F.col("fingerprint"), k * width + 1, F.lit(width))))
    rows = cut_lineage(prints.select("id", F.explode(bands).alias("band")), "baender")
    same = [F.min("id").alias("least"), F.max("id").alias("most"), F.count("*").alias("members"),
            F.bit_xor(F.xxhash64("id")).alias("mark"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("other_mark")]
    buckets = rows.groupBy("band").agg(*same).filter("members > 1").groupBy(
        "least", "most", "members", "mark", "other_mark").agg(F.min("band").alias("band"))
    kept = cut_lineage(buckets.select(
        F.col("band").cast("string").cast("binary").alias("key"), "members", F.lit(True).alias("kept")), "eimer")
    joined = join_groups(rows.withColumn("key", F.col("band").cast("string").cast("binary")), kept, "key", "members", rows.count())
    return joined.filter("kept").select(F.col("band").alias("group"), "id")


def near_classes(docs: DataFrame, similarity: float = SIMILARITY, band_rows: int = BAND_ROWS) -> DataFrame:
    """doc_id and class_id of every row: the smallest doc_id reached over near copies that meet in a band.

    Every pair of a bucket is decided on the exact shingle sets unless both are connected already. Equal sets
    are one node, and so are rows with the same doc_id.
    """
    rows = cut_lineage(_print_sets(docs), "abdruck")
    nodes = cut_lineage(rows.groupBy("print").agg(
        F.count("*").alias("members"), F.first(F.struct("fingerprint", "n", "tokens")).alias("_f")).select(
        "print", "members", "_f.*").withColumn("id", F.monotonically_increasing_id()), "knoten")
    members = band_groups(nodes.filter("n > 0"), band_rows).join(nodes.select("id", "n", "tokens"), "id")
    links = overlapping_links(cut_lineage(members, "mitglieder"), round(100 * similarity, 9))
    known = nodes.select("print", "id", "members")
    placed = cut_lineage(join_groups(rows.select("doc_id", "print"), known, "print", "members", rows.count()), "zeilen")
    repeated = placed.filter("doc_id is not null").groupBy("doc_id").agg(
        F.min("id").alias("a"), F.collect_set("id").alias("_ids")).filter("size(_ids) > 1").select("a", F.explode("_ids").alias("b"))
    labels = connected(links.unionByName(repeated), "klassen")
    named = known.join(labels.select(F.col("node").alias("id"), "label"), "id", "left").select(
        "id", "members", F.coalesce("label", "id").alias("label"))
    least = placed.groupBy("id").agg(F.min("doc_id").alias("least"))
    classes = named.join(least, "id").groupBy("label").agg(F.min("least").alias("class_id"))
    answer = cut_lineage(named.join(classes, "label").select("id", "members", "class_id").join(
        nodes.select("id", "print"), "id").select("print", "members", "class_id"), "klassen")
    return join_groups(rows.select("doc_id", "print"), answer, "print", "members", rows.count()).select("doc_id", "class_id")
