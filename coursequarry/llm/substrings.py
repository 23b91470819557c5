"""Substring dedup by level-wise doubling of repeated windows.

All windows of the shortest length (the asked length halved while it is even and stays at `SHORTEST` words or more) are compared
between documents. Only where a window repeats is it extended: at the next level a window of twice the length is
looked at where both of its halves repeat. This goes on to the asked length or until no candidates survive; longer
windows could not change which words are covered. At the last level the smallest doc_id with each window is
found, and all words of that window in documents with a larger doc_id are removed.

A level compares hashes of windows: 32 bits and the hash range on the shorter levels, where a false match only
leaves one more candidate, 64 bits on the last.

Defined results: null and wordless texts have no words; windows never cross documents; windows are judged on the
input. A row without doc_id counts as larger than all others; rows with the same doc_id remove nothing from each
other. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from coursequarry.llm.chunks import (by_chunk, chunk_rows, open_chunk, range_count, range_starts, release, reply_bits,
                                     write_chunks)
from coursequarry.llm.tables import pack
from coursequarry.llm.words import window_hashes, word_hashes
from coursequarry.sources.scratch import cut_lineage

WINDOW = 50
SHORTEST = 20
_LAST_ID = 2**63 - 1
_REQUEST = "range int, chunk long, hashes binary, ids binary"
_REPLY = "chunk long, range int, bits binary"


def levels_of(window: int, shortest: int = SHORTEST) -> list[int]:
    out = [window]
    while out[0] % 2 == 0 and out[0] // 2 >= shortest:
        out.insert(0, out[0] // 2)
    return out


class _Level:
    """The windows of one level in a chunk: where they start, their distinct hashes, the documents that have them."""

    def __init__(self, words, first, length, ids, at, ranges):
        h, every = window_hashes(words, first, length)
        if at is not None:
            chosen = at[every]
            h, every = h[chosen], every[chosen]
        order = np.argsort(h, kind="stable")
        self.at = every[order]
        h = h[order]
        self.owner = ids[np.searchsorted(first, self.at, "right") - 1]
        new = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
        start = np.flatnonzero(new)
        self.distinct = h[start]
        self.which = np.cumsum(new) - 1
        self.least = np.minimum.reduceat(self.owner, start) if len(start) else self.owner
        most = np.maximum.reduceat(self.owner, start) if len(start) else self.owner
        self.shared = most > self.least
        self.starts = range_starts(self.distinct, ranges)


def _levels(row: dict, lengths: list[int], upto: int, ranges: int):
    """The levels of a chunk up to number `upto`, each cut down by the replies to the one before."""
    data, offsets, ids = open_chunk(row)
    ids = np.array([_LAST_ID if i is None else i for i in ids], np.int64)
    words, first = word_hashes(data, offsets)
    at, level = None, None
    for k, length in enumerate(lengths[:upto + 1]):
        level = _Level(words, first, length, ids, at, ranges)
        if k < upto:
            again = level.shared | reply_bits(level.starts, row[f"replies{k}"])
            at = np.zeros(len(words) + length, bool)
            at[level.at[again[level.which]]] = True
            at[:len(words)] &= at[length:]
    return data, offsets, first, ids, level


def _requests(row, lengths, k, ranges):
    last = k == len(lengths) - 1
    level = _levels(row, lengths, k, ranges)[-1]
    for r in np.flatnonzero(np.diff(level.starts)):
        lo, hi = level.starts[r], level.starts[r + 1]
        h = level.distinct[lo:hi]
        yield (int(r), row["chunk"], pack(h if last else h.astype(np.uint32)), pack(level.least[lo:hi]) if last else b"")


def _ask(source: DataFrame, lengths: list[int], k: int, ranges: int) -> DataFrame:
    def run(batches):
        for row in chunk_rows(batches):
            out = list(_requests(row, lengths, k, ranges))
            if out:
                r, c, h, i = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r, pa.int32()), pa.array(c, pa.int64()), pa.array(h, pa.binary()), pa.array(i, pa.binary())],
                    ["range", "chunk", "hashes", "ids"])

    return source.mapInArrow(run, _REQUEST)


def _answer(requests: DataFrame, last: bool) -> DataFrame:
    """Per request one bit for each hash: another chunk has it too, at the last level in a smaller document."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        kind = np.uint64 if last else np.uint32
        arrays = [np.frombuffer(h, kind) for h in part["hashes"]]
        h = np.concatenate(arrays)
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        group = np.concatenate([[0], np.cumsum(~same)])
        if last:
            ids = np.concatenate([np.frombuffer(i, np.int64) for i in part["ids"]])[order]
            least = np.minimum.reduceat(ids, np.flatnonzero(np.concatenate([[True], ~same])))
            hit = least[group] < ids
        else:
            hit = np.bincount(group)[group] > 1
        flags = np.zeros(len(h), bool)
        flags[order] = hit
        out, at = [], 0
        for chunk, array in zip(part["chunk"], arrays):
            own = flags[at:at + len(array)]
            at += len(array)
            if own.any():
                out.append((chunk, part["range"].iloc[0], np.packbits(own).tobytes()))
        return pd.DataFrame(out, columns=["chunk", "range", "bits"])

    return requests.groupBy("range").applyInPandas(run, _REPLY)


def remove_repeats(docs: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row (`with_text`: the kept words as well)."""
    spark = docs.sparkSession
    chunks = write_chunks(docs)
    ranges = range_count(chunks.agg(F.sum("bytes")).first()[0] or 0)
    lengths = levels_of(window)
    source = chunks
    for k in range(len(lengths)):
        replies = cut_lineage(_answer(_ask(source, lengths, k, ranges), k == len(lengths) - 1), f"stufe{k}")
        source = source.join(by_chunk(replies, f"replies{k}"), "chunk", "left")
        release(spark)

    def finish(batches):
        for row in chunk_rows(batches):
            data, offsets, first, ids, level = _levels(row, lengths, len(lengths) - 1, ranges)
            beaten = reply_bits(level.starts, row[f"replies{len(lengths) - 1}"])
            gone = beaten[level.which] | (level.owner > level.least[level.which])
            edge = np.zeros(int(first[-1]) + window + 1, np.int32)
            np.add.at(edge, level.at[gone], 1)
            np.add.at(edge, level.at[gone] + window, -1)
            removed = np.cumsum(edge)[:int(first[-1])] > 0
            n_removed = np.diff(np.concatenate([[0], np.cumsum(removed)])[first])
            shas, texts, raw = [], [], data.tobytes()
            for i in range(len(ids)):
                own = raw[offsets[i]:offsets[i + 1]].split()
                if n_removed[i]:
                    own = compress(own, (~removed[first[i]:first[i + 1]]).tolist())
                kept = b" ".join(own)
                shas.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    texts.append(kept.decode())
            columns = {"doc_id": pa.array(row["doc_ids"], pa.int64()), "n_words": pa.array(np.diff(first)),
                       "n_removed": pa.array(n_removed.astype(np.int64)), "kept_sha256": pa.array(shas, pa.string())}
            if with_text:
                columns["text"] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    return source.mapInArrow(finish, "doc_id long, n_words long, n_removed long, kept_sha256 string"
                             + (", text string" if with_text else ""))
