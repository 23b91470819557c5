"""Quality classifier: nearest-neighbour voting over latent-semantic vectors.

A text's terms are the written forms of its words (runs of capitals, small letters, digits and single signs),
pairs of neighbouring forms, immediate repetitions and the words themselves, hashed. Terms of a bounded sample of
labelled rows are weighted by rarity and reduced by a truncated singular value decomposition. The sample's
vectors and labels are broadcast; every document takes its exact cosine with all of them, in blocks, and its
nearest neighbours vote with their similarity.

Bounds: `SAMPLE` labelled rows (those with the smallest hash of doc_id), `TERMS` terms, `RANK` dimensions, so what is
broadcast does not grow with the corpus. Labels, lang, source and doc_id are no inputs of a score.

Defined results: null text counts as the empty text; a text without any known term gets the share of good rows in the
sample; without any labelled row every score is 0.5. Several labels of a row are averaged, null ones ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from coursequarry.llm.words import column_bytes, mix, row_blocks, word_hashes

SAMPLE = 6000
SLOTS = 1 << 15
TERMS = 3000
RANK = 64
NEIGHBOURS = 24
SHARPNESS = 6.0
THRESHOLD = 0.3
FOLDS = 5
WORD_WEIGHT = 0.25

_FORM = np.arange(256, dtype=np.uint8)
_FORM[65:91], _FORM[97:123], _FORM[48:58], _FORM[128:] = ord("X"), ord("x"), ord("9"), ord("x")
_FORM[[0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0x20


def _slots(h: np.ndarray, kind: int) -> np.ndarray:
    return (mix(h + np.uint64(kind)) >> np.uint64(49)).astype(np.int64)


def term_weights(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, slot, weight) of the terms of every row; a row's forms, pairs and words each weigh by their share."""
    words, first = word_hashes(data, offsets, lower=True)
    form = _FORM[data]
    keep = np.ones(len(form), bool)
    keep[1:] = form[1:] != form[:-1]
    keep[offsets[:-1][offsets[:-1] < len(form)]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    forms, _ = word_hashes(form[keep], kept[offsets])
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    same = row[1:] == row[:-1] if len(row) else np.zeros(0, bool)
    again = np.flatnonzero(same & (words[1:] == words[:-1])) if len(row) else np.zeros(0, np.int64)
    pair = np.flatnonzero(same)
    keys = np.concatenate([
        row * SLOTS + _slots(forms, 1),
        row[pair] * SLOTS + _slots(forms[pair] * np.uint64(0x9E3779B97F4A7C15) + forms[pair + 1], 2),
        row[again] * SLOTS + _slots(np.zeros(len(again), np.uint64), 3),
        row * SLOTS + _slots(words, 4)])
    kind = np.concatenate([np.ones(len(row)), np.ones(len(pair)), np.ones(len(again)), np.full(len(row), WORD_WEIGHT)])
    key, inverse = np.unique(keys, return_inverse=True)
    total = np.bincount(inverse, kind)
    n = np.maximum(np.diff(first), 1)
    return key // SLOTS, key % SLOTS, np.sqrt(total / n[key // SLOTS])


class Model:
    """Terms, projection, sample vectors and labels."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 11):
        self.prior = float(labels.mean()) if len(labels) else 0.5
        self.labels = labels.astype(np.float32)
        seen = np.bincount(np.concatenate([s for s, _ in rows] or [np.zeros(0, np.int64)]), minlength=SLOTS)
        chosen = np.lexsort([np.arange(SLOTS), -seen])[:TERMS]
        chosen = chosen[seen[chosen] >= min(3, max(1, len(rows)))]
        self.column = np.full(SLOTS, -1)
        self.column[chosen] = np.arange(len(chosen))
        self.rarity = np.log((1 + len(rows)) / (1 + seen[chosen])).astype(np.float32) + 1
        matrix = np.zeros((len(rows), len(chosen)), np.float32)
        for i, (slots, weights) in enumerate(rows):
            at = self.column[slots]
            matrix[i, at[at >= 0]] = weights[at >= 0]
        matrix *= self.rarity
        matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-9)
        self.projection = self._projection(matrix, np.random.default_rng(seed))
        self.sample = self._unit(matrix @ self.projection)

    @staticmethod
    def _projection(matrix: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """Right singular vectors of the largest singular values, by power iterations on a random start."""
        rank = min(RANK, *matrix.shape)
        if not rank:
            return np.zeros((matrix.shape[1], 0), np.float32)
        basis = rng.standard_normal((matrix.shape[1], min(rank + 16, matrix.shape[1]))).astype(np.float32)
        for _ in range(4):
            basis, _ = np.linalg.qr(matrix.T @ (matrix @ basis))
        small = matrix @ basis
        _, _, right = np.linalg.svd(small.T @ small)
        return (basis @ right[:rank].T).astype(np.float32)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def vectors(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        row, slot, weight = term_weights(data, offsets)
        at = self.column[slot]
        row, at, weight = row[at >= 0], at[at >= 0], weight[at >= 0]
        out = np.zeros((len(offsets) - 1, self.projection.shape[1]), np.float32)
        for i in range(0, len(out), 128):  # a block's dense terms stay small
            lo, hi = np.searchsorted(row, [i, i + 128])
            dense = np.zeros((min(128, len(out) - i), len(self.rarity)), np.float32)
            dense[row[lo:hi] - i, at[lo:hi]] = weight[lo:hi]
            out[i:i + 128] = (dense * self.rarity) @ self.projection
        return self._unit(out)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.full(len(offsets) - 1, self.prior)
        if not len(self.labels) or not self.projection.shape[1]:
            return out
        for i, j in row_blocks(offsets, 1 << 20):
            for lo in range(i, j, 1024):
                hi = min(j, lo + 1024)
                x = self.vectors(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                for k in range(0, len(x), 256):
                    out[lo + k:min(lo + k + 256, hi)] = self._vote(x[k:k + 256])
        return out

    def _vote(self, x: np.ndarray) -> np.ndarray:
        near = x @ self.sample.T
        n = min(NEIGHBOURS, near.shape[1])
        at = np.argpartition(near, near.shape[1] - n, axis=1)[:, near.shape[1] - n:]
        weight = np.maximum(np.take_along_axis(near, at, 1), 0).astype(np.float64) ** SHARPNESS
        total = weight.sum(axis=1)
        vote = (weight * self.labels[at]).sum(axis=1)
        return np.clip((vote + 1e-3 * self.prior) / (total + 1e-3), 0.0, 1.0)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, label: str = "quality") -> Model:
    """A model from the labelled rows outside the held-out fold, at most `sample` of them."""
    known = labels.filter(labels[label].isNotNull() & labels["doc_id"].isNotNull() & ~held_out(labels["doc_id"]))
    chosen = known.groupBy("doc_id").agg(F.avg(label).alias("_label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = chosen.select(F.col("doc_id").alias("_id"), (F.col("_label") >= 0.5).cast("int").alias("label"))
    rows = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text")).join(
        F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "label", "text")  # `sample` rows at most

    def terms(batches):
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            slots, weights = [], []
            for i, j in row_blocks(offsets, 1 << 20):
                row, slot, weight = term_weights(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                cut = np.searchsorted(row, np.arange(1, j - i))
                slots += [s.astype("<i4").tobytes() for s in np.split(slot, cut)]
                weights += [w.astype("<f4").tobytes() for w in np.split(weight, cut)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.array(slots, pa.binary()), pa.array(weights, pa.binary())],
                ["doc_id", "label", "slots", "weights"])

    got: pd.DataFrame = rows.mapInArrow(terms, "doc_id long, label int, slots binary, weights binary").toPandas()
    got = got.sort_values(["doc_id", "slots"]).drop_duplicates("doc_id")
    return Model([(np.frombuffer(s, "<i4").astype(np.int64), np.frombuffer(w, "<f4")) for s, w in zip(got["slots"], got["weights"])],
                 got["label"].to_numpy(np.float64))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with `score` and `predicted` behind its own columns (those must not be named so)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches):
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            s = shared.value.scores(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(len(names))], pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                [*names, "score", "predicted"])

    out = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.mapInArrow(run, out)


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    narrow = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(fit(narrow, labels, sample))

    def run(batches):
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            s = shared.value.scores(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                ["doc_id", "score", "predicted"])

    schema = f"doc_id {dict(narrow.dtypes)['doc_id']}, score double, predicted int"
    return narrow.mapInArrow(run, schema).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that the classifier does not reject, with all their columns."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    model = fit(docs, labels, sample)
    text = docs.columns.index("text")
    plain = docs.toDF(*[("text" if i == text else n) for i, n in enumerate(names)])
    good = score(plain, model, threshold).filter("predicted = 1").drop("score", "predicted")
    return good.toDF(*docs.columns)
