"""Token files: frequency-ranked ids in byte-aligned variable-length code with separate control bytes.

Ids are replaced by their rank by frequency over the whole corpus, so the 256 most frequent ids take one byte.
Four values share a control byte (two bits each: bytes less one); control and data bytes stand apart, and numpy
decodes a block by looking all control bytes up in one table of lengths. A document's control bytes start at a
byte of their own.

Files are Parquet tables of blocks in ascending doc_id order; `part` and `block` give the order, `start` the
ids before a block within its part. The rank table is stored beside them.

Defined results: null is the empty text, which has the end id alone; null doc_ids come first; rows with the same
doc_id follow each other; an empty table gives empty files.
"""

from __future__ import annotations

import json
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from coursequarry.llm.bpe import PIECE_MEMO, WORD_MEMO, Words, cut_word, encode_texts, in_symbols, read_definition, text_blocks
from coursequarry.llm.tables import range_bounds
from coursequarry.llm.words import column_bytes, row_blocks
from coursequarry.sources.scratch import cut_lineage, scratch_path

END_ID = 1
PART_IDS = 4_000_000
BLOCK_IDS = 500_000
CODE_BYTES = 2_000_000  # ids are coded together up to this many bytes (a longer document alone)
BLOCKS = ("part int, block int, start long, n long, doc_ids array<long>, lengths array<int>, "
          "control binary, data binary")
_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.int64) + 1


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values."""
    values = np.ascontiguousarray(values, "<u4")
    more = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[:len(values)] = more
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) <= more[:, None]]
    return control.tobytes(), data.tobytes()


def encode_rows(values: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """`encode_values` of many documents end to end: control and data bytes of each. `offsets`: where they begin."""
    lengths = np.diff(offsets)
    values = np.ascontiguousarray(values, "<u4")
    more = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    control_at = np.concatenate([[0], np.cumsum(-(-lengths // 4))])
    codes = np.zeros(int(control_at[-1]) * 4, np.uint8)
    codes[np.repeat(control_at[:-1] * 4 - offsets[:-1], lengths) + np.arange(len(values))] = more
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) <= more[:, None]]
    data_at = np.concatenate([[0], np.cumsum(more, dtype=np.int64)])[offsets] + offsets
    return tuple(pa.Array.from_buffers(pa.large_binary(), len(lengths), [
        None, pa.py_buffer(np.ascontiguousarray(at, np.int64)), pa.py_buffer(own)]).cast(pa.binary())
        for at, own in ((control_at, control), (data_at, data)))


def decode_values(control: np.ndarray, data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The values of consecutive documents; `lengths` has the number of values of each."""
    width = _LENGTHS[control].ravel()
    padded = -(-lengths // 4) * 4
    filler = np.ones(len(width), bool)  # places of a document's last control byte that hold no value
    ends = np.cumsum(padded)
    for k in range(1, 4):
        filler[(ends - k)[padded - lengths >= k]] = False
    width = width[filler]
    at = np.cumsum(width) - width
    data = np.concatenate([data, np.zeros(4, np.uint8)]).astype(np.uint32)
    out = data[at]
    for k in range(1, 4):
        wide = np.flatnonzero(width > k)
        if len(wide):
            out[wide] |= data[at[wide] + k] << np.uint32(8 * k)
    return out


class _Encoder:
    """The library's encoder behind bounded memos: it sees each distinct word of one piece, or piece of other words, once."""

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.model = self.tokenizer.model
        self.pieces = Words(self._piece, PIECE_MEMO)
        self.words = Words(self._word, WORD_MEMO)

    def _piece(self, piece: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(in_symbols(piece))]).tobytes()

    def _word(self, word: bytes) -> bytes:
        if word.isalpha():  # ASCII letters
            return self._piece(word.lower().decode())
        pieces = cut_word(word)
        if pieces is None:
            return array("I", self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids).tobytes()
        return self._piece(pieces[0]) if len(pieces) == 1 else b"".join([self.pieces[p] for p in pieces])


_encoders: dict[str, _Encoder] = {}


def _encoder(path: str, definition: str) -> _Encoder:
    if path not in _encoders:
        _encoders[path] = _Encoder(definition)
    return _encoders[path]


def id_kind(definition: str) -> str:
    """The numpy type that holds every id of the vocabulary."""
    spec = json.loads(definition)
    most = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])], default=0)
    return "<u2" if most < 1 << 16 else "<u4"


def encoded(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, ids, counts) as a table in the shared folder: the ids of every text and the end id, in the type of `id_kind`.

    Each task adds one row without ids, with how often each id occurs in its own texts.
    """
    definition = docs.sparkSession.sparkContext.broadcast(read_definition(path))
    kind = id_kind(definition.value)

    def run(batches):
        encoder, end = _encoder(path, definition.value), np.array([end_id], kind).tobytes()
        counts = np.zeros(end_id + 1, np.int64)
        for batch in batches:
            for i, j, texts in text_blocks(batch):
                ids, offsets = encode_texts(texts, encoder.words)
                more = np.bincount(ids, minlength=len(counts))
                more[:len(counts)] += counts
                counts = more
                counts[end_id] += j - i
                ids = ids.astype(kind)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i),
                     pa.array([ids[a:b].tobytes() + end for a, b in zip(offsets, offsets[1:])], pa.binary()),
                     pa.nulls(j - i, pa.binary())], ["doc_id", "ids", "counts"])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()),
                                          pa.array([counts.tobytes()], pa.binary())], ["doc_id", "ids", "counts"])

    folder = scratch_path(docs.sparkSession, "ids")
    schema = "doc_id long, ids binary, counts binary"
    docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(
        run, schema).write.option("compression", "zstd").parquet(folder)
    return docs.sparkSession.read.schema(schema).parquet(folder)


def id_counts(coded: DataFrame) -> DataFrame:
    """(id, n): how often each id occurs in all documents, end ids included."""

    def run(batches):
        counts = np.zeros(1, np.int64)
        for batch in batches:
            for row in batch.column("counts"):
                own = np.frombuffer(row.as_buffer(), np.int64)
                more = np.zeros(max(len(counts), len(own)), np.int64)
                more[:len(counts)] = counts
                more[:len(own)] += own
                counts = more
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(counts[seen], pa.int64())], ["id", "n"])

    return coded.select("counts").filter("counts is not null").mapInArrow(run, "id long, n long").groupBy("id").agg(
        F.sum("n").alias("n"))


def rank_table(counts: DataFrame) -> np.ndarray:
    """Ids by falling frequency, ties by id. At most one entry per id of the vocabulary."""
    rows = counts.toPandas()
    order = np.lexsort([rows["id"].to_numpy(), -rows["n"].to_numpy()])
    return rows["id"].to_numpy(np.int64)[order]


def write_token_files(docs: DataFrame, path: str, folder: str, end_id: int = END_ID) -> None:
    """Encode every text and write its ids to `folder` (blocks and ranks)."""
    spark = docs.sparkSession
    table, kind = encoded(docs, path, end_id), id_kind(read_definition(path))
    counts = cut_lineage(id_counts(table), "haeufigkeit")
    plain = table.filter("counts is null").select("doc_id", "ids")
    ids = rank_table(counts)
    total = counts.agg(F.sum("n")).first()[0] or 0
    spark.createDataFrame([(int(r), int(i)) for r, i in enumerate(ids)], "rank long, id long").coalesce(1).write.parquet(
        f"{folder}/ranks")
    rank_of = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.uint32)
    rank_of[ids] = np.arange(len(ids))
    shared = spark.sparkContext.broadcast(rank_of)
    bounds = range_bounds(plain, "doc_id", max(1, -(-total // PART_IDS)))

    def code(batches):
        width = np.dtype(kind).itemsize
        for batch in batches:
            ids, offsets = column_bytes(batch.column("ids"))
            for i, j in row_blocks(offsets, CODE_BYTES):
                own = np.frombuffer(ids[offsets[i]:offsets[j]].tobytes(), kind)
                doc_ids = batch.column("doc_id").slice(i, j - i)
                part = [0 if d is None else bisect_right(bounds, d) for d in doc_ids.to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.int32()), doc_ids, *encode_rows(shared.value[own], (offsets[i:j + 1] - offsets[i]) // width)],
                    ["part", "doc_id", "control", "data"])

    coded = plain.mapInArrow(code, "part int, doc_id long, control binary, data binary")
    ordered = coded.repartitionById(len(bounds) + 1, "part").sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    ordered.mapInArrow(_blocks, BLOCKS).write.parquet(f"{folder}/blocks")


def _count(control: bytes, data: bytes) -> int:
    """Values in a document's code: whole control bytes, less the fillers its data bytes leave over."""
    width = _LENGTHS[np.frombuffer(control, np.uint8)]
    n, over = width.size, int(width.sum()) - len(data)
    return n - over  # a filler counts one byte


def _blocks(batches) -> Iterator[pa.RecordBatch]:
    ids, lengths, control, data, size, block, start, part = [], [], [], [], 0, 0, 0, None

    def flush():
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([start], pa.int64()),
             pa.array([size], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int32())),
             pa.array([b"".join(control)], pa.binary()), pa.array([b"".join(data)], pa.binary())],
            ["part", "block", "start", "n", "doc_ids", "lengths", "control", "data"])

    for batch in batches:
        for p, doc_id, c, d in zip(*(batch.column(k).to_pylist() for k in ("part", "doc_id", "control", "data"))):
            if size >= BLOCK_IDS:
                yield flush()
                start, block = start + size, block + 1
                ids, lengths, control, data, size = [], [], [], [], 0
            n = _count(c, d)
            ids.append(doc_id), lengths.append(n), control.append(c), data.append(d)
            size, part = size + n, p
    if ids:
        yield flush()


def read_token_files(spark: SparkSession, folder: str, digest_only: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids of every document (`digest_only`: the crc32 of the ids instead)."""
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    ranks = spark.read.parquet(f"{folder}/ranks").toPandas()
    table = np.zeros(len(ranks), "<u4")
    table[ranks["rank"].to_numpy()] = ranks["id"].to_numpy()
    table = spark.sparkContext.broadcast(table)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = blocks.groupBy("part").agg(F.sum("n").alias("ids")).select(  # one row for each part
        "part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("part_start"))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.array(row["lengths"], np.int64)
                ids = table.value[decode_values(
                    np.frombuffer(row["control"], np.uint8), np.frombuffer(row["data"], np.uint8), lengths)]
                ends = np.cumsum(lengths)
                first = row["part_start"] + row["start"] + ends - lengths
                own = [ids[e - n:e].tobytes() for e, n in zip(ends.tolist(), lengths.tolist())]
                last = pa.array([zlib.crc32(o) for o in own], pa.int64()) if digest_only else pa.array(own, pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(first, pa.int64()), pa.array(lengths, pa.int64()), last],
                    ["doc_id", "start", "n_tokens", "ids_crc32" if digest_only else "ids"])

    out = "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digest_only else "ids binary")
    return blocks.join(F.broadcast(parts), "part").select(
        "part_start", "start", "doc_ids", "lengths", "control", "data").mapInArrow(run, out)
