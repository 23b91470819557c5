"""Chunks of documents and packed exchanges between chunks and hash ranges.

A chunk holds the texts of some documents in one compressed row. Hashes that chunks have to compare are dealt to
ranges of the hash space; a chunk sends each range one array of its distinct hashes instead of one row per
hash, so a hash that a hot text repeats leaves every chunk once at most.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from coursequarry.llm.words import column_bytes
from coursequarry.sources.scratch import scratch_path

CHUNK_BYTES = 4_000_000
RANGE_BYTES = 12_000_000
CHUNKS = "chunk long, doc_ids array<long>, ends array<long>, bytes long, texts binary"


def write_chunks(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(chunk, doc_ids, ends, bytes, texts) of all documents as a table in the shared folder."""
    path = scratch_path(docs.sparkSession, "chunks")

    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        ids, parts, ends, size = [], [], [], 0

        def flush():
            return pa.RecordBatch.from_arrays(
                [pa.array([part << 32 | number], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
                 pa.array([ends], pa.list_(pa.int64())), pa.array([size], pa.int64()),
                 pa.array([pa.compress(b"".join(parts), "zstd", asbytes=True)], pa.binary())],
                ["chunk", "doc_ids", "ends", "bytes", "texts"])

        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                text = data[offsets[i]:offsets[i + 1]].tobytes()
                if ids and size + len(text) > chunk_bytes:
                    yield flush()
                    ids, parts, ends, size, number = [], [], [], 0, number + 1
                size += len(text)
                ids.append(doc_id), parts.append(text), ends.append(size)
        if ids:
            yield flush()

    docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(
        run, CHUNKS).write.parquet(path)
    return docs.sparkSession.read.schema(CHUNKS).parquet(path)


def open_chunk(row: dict) -> tuple[np.ndarray, np.ndarray, list]:
    """Bytes, offsets and doc_ids of a chunk."""
    data = np.frombuffer(pa.decompress(row["texts"], row["bytes"], "zstd"), np.uint8) if row["bytes"] else np.zeros(0, np.uint8)
    return data, np.concatenate([[0], np.array(row["ends"], np.int64)]), row["doc_ids"]


def chunk_rows(batches) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def range_count(total_bytes: int) -> int:
    return max(16, -(-total_bytes // RANGE_BYTES))


def range_starts(sorted_hashes: np.ndarray, ranges: int) -> np.ndarray:
    """Where each hash range begins in sorted 64-bit hashes (one more at the end)."""
    return np.searchsorted(((sorted_hashes >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32),
                           np.arange(ranges + 1, dtype=np.uint64))


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of steps whose results have been written."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def by_chunk(replies: DataFrame, name: str) -> DataFrame:
    """One row per chunk with all of its replies (one per hash range, so bounded by the chunk's own hashes)."""
    return replies.groupBy("chunk").agg(F.collect_list(F.struct("range", "bits")).alias(name))


def reply_bits(starts: np.ndarray, replies) -> np.ndarray:
    """The replies of all ranges in the order of the chunk's sorted hashes; ranges without a reply are all 0."""
    out = np.zeros(int(starts[-1]), bool)
    for reply in replies or []:
        lo, hi = starts[reply["range"]], starts[reply["range"] + 1]
        out[lo:hi] = np.unpackbits(np.frombuffer(reply["bits"], np.uint8), count=hi - lo).astype(bool)
    return out
