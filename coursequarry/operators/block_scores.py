"""The work of `topic_match.block_max_best` on the workers: pages packed by shard, and topics scored over whole shards.

A packed shard holds its pages best first (higher confidence, then smaller page_id) and, per keyword, the places of
the pages that hold it and their weights in halves. Scores are sums of whole numbers, so they are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PACKED = "shard int, palabra string, lugares binary, pesos binary"
SCORED = "tema string, page_id long, relevancia double, confianza double"
TOPICS = -1
_BATCH = 20_000
_DENSE = 16  # keywords of more than one page in so many are kept as one weight per page


def _by_shard(batches) -> Iterator[tuple[int, pa.Table]]:
    """(shard, rows) of rows in shard order, one shard at a time."""
    now, held = None, []
    for batch in batches:
        shards = batch.column("shard").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo == hi:
                continue
            if held and shards[lo] != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = int(shards[lo])
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield now, pa.Table.from_batches(held)


def _slices(table: pa.Table) -> Iterator[pa.RecordBatch]:
    for lo in range(0, table.num_rows, _BATCH):
        yield from table.slice(lo, _BATCH).combine_chunks().to_batches()


def _whole(column: pa.ChunkedArray) -> pa.Array:
    whole = column.combine_chunks()
    return whole.combine_chunks() if isinstance(whole, pa.ChunkedArray) else whole


def _binary(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """One value per start, each up to the next one."""
    ends = np.append(starts, len(data)).astype(np.int64) * data.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data)]).cast(pa.binary())


def pack(batches) -> Iterator[pa.RecordBatch]:
    """`PACKED` rows of matches (shard, palabra, page_id, peso, confianza), one shard after the other.

    The first row of a shard has no keyword: its pages, best first, and their confidences. A page without
    confidence comes last.
    """
    for shard, rows in _by_shard(batches):
        ids, of = np.unique(rows.column("page_id").to_numpy(), return_inverse=True)
        sure = np.full(len(ids), -np.inf)
        np.maximum.at(sure, of, pc.fill_null(rows.column("confianza"), -np.inf).to_numpy())
        best = np.lexsort((ids, -sure))
        place = np.empty(len(ids), np.uint16 if len(ids) <= 1 << 16 else np.uint32)
        place[best] = np.arange(len(ids))
        words = _whole(rows.column("palabra").dictionary_encode())
        word = words.indices.to_numpy()
        order = np.lexsort((place[of], word))
        starts = np.searchsorted(word[order], np.arange(len(words.dictionary)))
        halves = np.rint(rows.column("peso").to_numpy() * 2).astype(np.uint8)
        yield from _slices(pa.table({
            "shard": pa.array(np.full(len(starts) + 1, shard, np.int32)),
            "palabra": pa.concat_arrays([pa.nulls(1, pa.string()), words.dictionary]),
            "lugares": pa.concat_arrays([pa.array([ids[best].astype(np.int64).tobytes()], pa.binary()), _binary(place[of][order], starts)]),
            "pesos": pa.concat_arrays([pa.array([sure[best].tobytes()], pa.binary()), _binary(halves[order], starts)]),
        }))


class _Topics:
    """The topics of a task: their keywords laid end to end, and the score each has to reach so far."""

    def __init__(self, rows: pa.Table):
        self.names = _whole(rows.column("tema"))
        lists = _whole(rows.column("lista"))
        self.first = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
        flat = lists.flatten()
        self.words, times = flat.field("palabra"), flat.field("veces").to_numpy()
        self.times = times.astype(np.int64)
        self.floor = np.zeros(len(self.names), np.int64)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """The sum of a value per keyword, by topic."""
        running = np.concatenate([[0], np.cumsum(values)])
        return running[self.first[1:]] - running[self.first[:-1]]


def _score_shard(topics: _Topics, rows: pa.Table, limit: int, block: int):
    """Topic, page_id, confidence and score in halves of the pages that can be among the best `limit` of each topic.

    The score a topic's `limit`-th page has in some shard is a floor for later ones: shards whose largest weights
    do not add up to it are skipped. Where there is none yet, the best of each block of pages is taken first and the
    `limit`-th of them is the floor. Only pages that reach it are looked at.
    """
    places, weights = _whole(rows.column("lugares")), _whole(rows.column("pesos"))
    ids, sure = np.frombuffer(places[0].as_py(), np.int64), np.frombuffer(weights[0].as_py(), np.float64)
    at = pc.fill_null(pc.index_in(topics.words, value_set=_whole(rows.column("palabra"))), -1).to_numpy()
    weights = weights.slice(1)
    ends = np.concatenate([[0], np.cumsum(pc.binary_length(weights).to_numpy())])
    weights = np.concatenate([np.frombuffer(w, np.uint8) for w in weights.to_pylist()] or [np.zeros(0, np.uint8)])
    kind = np.uint16 if len(ids) <= 1 << 16 else np.uint32
    places = np.frombuffer(b"".join(places.slice(1).to_pylist()), kind).astype(np.intp)
    most = np.concatenate([np.maximum.reduceat(weights, ends[:-1]) if len(weights) else weights, [0]]).astype(np.int64)
    at = np.where(at > 0, at - 1, -1)  # the first row is the pages'
    bound = topics.sums(most[at] * topics.times)

    columns = -(-len(ids) // block)
    small, large = np.zeros(columns * block, np.uint8), np.zeros(columns * block, np.int64)
    dense: dict[int, np.ndarray] = {}
    first, flat, times, ends, floors = topics.first.tolist(), at.tolist(), topics.times.tolist(), ends.tolist(), topics.floor.tolist()
    out = []
    for t in np.flatnonzero((bound > 0) & (bound >= topics.floor)).tolist():
        full = small if bound[t] <= 255 else large
        full.fill(0)
        sums = full[:len(ids)]
        for k in range(first[t], first[t + 1]):
            j, n = flat[k], times[k]
            if j < 0:
                continue
            lo, hi = ends[j], ends[j + 1]
            own = dense.get(j)
            if own is None and (hi - lo) * _DENSE > len(ids):
                own = dense[j] = np.zeros(len(ids), np.uint8)
                own[places[lo:hi]] = weights[lo:hi]
            if own is not None:
                sums += own if n == 1 else own.astype(sums.dtype) * sums.dtype.type(n)
            elif n == 1:
                sums[places[lo:hi]] += weights[lo:hi]
            else:
                sums[places[lo:hi]] += weights[lo:hi].astype(sums.dtype) * sums.dtype.type(n)
        floor = floors[t]
        if floor == 0 and columns >= limit:
            tops = full.reshape(block, columns).max(axis=0)
            tops.partition(columns - limit)
            floor = int(tops[columns - limit])
        found = (sums > floor).nonzero()[0]
        if floor and len(found) < limit:
            found = np.concatenate([found, (sums == floor).nonzero()[0][:limit - len(found)]])
        score = sums[found]
        if len(found) > limit:
            best = np.argsort(score.max() - score, kind="stable")[:limit]
            found, score = found[best], score[best]
        if len(found) == limit:
            topics.floor[t] = score.min()
        if len(found):
            out.append((t, found, score))
    if not out:
        return None
    topic, found, score = zip(*out)
    found = np.concatenate(found)
    return [np.repeat(topic, [len(x) for x in score]), ids[found], sure[found], np.concatenate([x.astype(np.int64) for x in score])]


def scorer(limit: int, block: int):
    """A function of batches of (shard, palabra, lugares, pesos, tema, lista) in shard order, topics as shard `TOPICS`
    first and pages before keywords, that gives the best `limit` pages of each topic over all those shards as `SCORED`."""

    def run(batches):
        topics, parts = None, []
        for shard, rows in _by_shard(batches):
            if shard == TOPICS:
                topics = _Topics(rows)
            elif topics is not None:
                part = _score_shard(topics, rows, limit, block)
                if part is not None:
                    parts.append(part)
        if not parts:
            return
        topic, ids, sure, score = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((ids, -sure, -score, topic))
        topic = topic[order]
        place = np.arange(len(topic)) - np.searchsorted(topic, topic, "left")
        order, topic = order[place < limit], topic[place < limit]
        sure = sure[order]
        yield from _slices(pa.table({
            "tema": topics.names.take(pa.array(topic)), "page_id": pa.array(ids[order]),
            "relevancia": pa.array(score[order] / 2), "confianza": pa.array(sure, mask=np.isneginf(sure)),
        }))

    return run
