"""Streaming jobs give the batch result on the same rows, fed in several files and out of order."""

import os
from datetime import datetime

import pytest
from pyspark.sql import Window, functions as F

from bindings import tables as b
from coursequarry import schemas
from coursequarry.operators import activity, cache, enrich as en
from coursequarry.streaming import jobs

FAR = datetime(2030, 1, 1)


def feed(df, path, parts=3, shuffled=False, last=None):
    """Write the rows as files with rising modification times; the last row moves the watermark on."""
    ordered = df.orderBy(F.rand(7) if shuffled else F.col(df.columns[-1])).toPandas()
    step = -(-len(ordered) // parts)
    chunks = [ordered.iloc[i * step:(i + 1) * step] for i in range(parts)]
    spark = df.sparkSession
    os.makedirs(path)
    for i, chunk in enumerate(chunks):
        spark.createDataFrame(chunk, df.schema).coalesce(1).write.parquet(f"{path}/f{i}")
    if last is not None:
        spark.createDataFrame([last], df.schema).coalesce(1).write.parquet(f"{path}/z")
    n = 0
    for folder in sorted(os.listdir(path)):
        for name in os.listdir(f"{path}/{folder}"):
            if name.endswith(".parquet"):
                os.utime(f"{path}/{folder}/{name}", (1_700_000_000 + n * 60,) * 2)
                n += 1
    return f"{path}/*"


def run_to_table(stream, tmp_path, name, mode="append"):
    query = (
        stream.writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", str(tmp_path / f"cp-{name}"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination(300)
    assert query.exception() is None
    return stream.sparkSession.table(name)


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_search_log_append(spark, sf_dir, tmp_path):
    log = b.search_log(spark, sf_dir)
    src = feed(log, str(tmp_path / "in"))
    stream = jobs.read_stream(spark, src, schemas.SEARCH_LOG, 1)
    jobs.start_search_log(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(300)
    got = spark.read.schema(schemas.SEARCH_LOG).parquet(str(tmp_path / "out"))
    assert rows_of(got, "search_id", "tema", "ts") == rows_of(log, "search_id", "tema", "ts")


def test_running_top(spark, sf_dir, tmp_path):
    log = b.search_log(spark, sf_dir)
    stream = jobs.read_stream(spark, feed(log, str(tmp_path / "in")), schemas.SEARCH_LOG, 1)
    got = run_to_table(jobs.running_top_topics(stream), tmp_path, "top_now", "complete")
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in activity.top_topics(log).collect()]


@pytest.mark.parametrize("shuffled", [False, True])
def test_click_credit(spark, sf_dir, tmp_path, shuffled):
    log, clicks = b.search_log(spark, sf_dir), b.clicks(spark, sf_dir)
    searches = log.select("search_id", "tema", "ts")
    s = feed(searches, str(tmp_path / "s"), 3, shuffled, (-1, "end", FAR))
    c = feed(clicks.select("click_id", "tema", "ts"), str(tmp_path / "c"), 3, shuffled, (-1, "end", FAR))
    # Shuffled files span the whole month, so nothing may be late within it.
    stream = jobs.credit_clicks(
        jobs.read_stream(spark, s, "search_id bigint, tema string, ts timestamp_ntz", 1),
        jobs.read_stream(spark, c, "click_id bigint, tema string, ts timestamp_ntz", 1),
        delay="40 days" if shuffled else "15 days", shares=3,
    )
    got = run_to_table(stream, tmp_path, f"clicks_{shuffled}").where("click_id >= 0")
    assert rows_of(got, "click_id", "search_id") == rows_of(
        activity.clicks_to_searches(log, clicks), "click_id", "search_id"
    )


def test_session_ends(spark, sf_dir, tmp_path):
    starts, ends = b.session_starts(spark, sf_dir), b.session_ends(spark, sf_dir)
    s = feed(starts, str(tmp_path / "s"), 3, True, ("end", FAR))
    e = feed(ends, str(tmp_path / "e"), 3, True, ("end", FAR))
    stream = jobs.close_sessions(
        jobs.read_stream(spark, s, "session_id string, started_at timestamp_ntz", 1),
        jobs.read_stream(spark, e, schemas.SESSION_ENDS, 1), delay="40 days",
    )
    got = run_to_table(stream, tmp_path, "ended").where("session_id <> 'end'")
    want = activity.close_sessions(starts, ends).where("ended_at IS NOT NULL")
    columns = ("session_id", "started_at", "ended_at")
    assert rows_of(got, *columns) == rows_of(want, *columns)


def test_cache_requests(spark, sf_dir, tmp_path):
    requests = b.cache_requests(spark, sf_dir).select("event_id", "clave", "n_resultados", "ts")
    src = feed(requests, str(tmp_path / "in"), 4, True, (-1, "end", 0, FAR))
    stream = jobs.judge_cache_requests(
        jobs.read_stream(spark, src, "event_id bigint, clave string, n_resultados int, ts timestamp_ntz", 1),
        delay="40 days",
    )
    got = run_to_table(stream, tmp_path, "cache_now").where("event_id >= 0")
    assert rows_of(got, "event_id", "acierto") == rows_of(cache.cache_hits(requests), "event_id", "acierto")


def test_scoring(spark, sf_dir, tmp_path):
    results, replies = b.ai_input(spark, sf_dir), b.ai_replies(spark, sf_dir)
    replies.write.parquet(str(tmp_path / "replies"))
    flat = results.drop("certificacion", "metadatos_analisis")
    src = feed(flat, str(tmp_path / "in"))
    empty = [results.schema["metadatos_analisis"].dataType, results.schema["certificacion"].dataType]
    stream = jobs.read_stream(spark, src, flat.schema, 1).select(
        "*", F.lit(None).cast(empty[0]).alias("metadatos_analisis"),
        F.lit(None).cast(empty[1]).alias("certificacion"),
    )
    out = str(tmp_path / "scored")
    os.makedirs(out)
    for run in ("a", "b"):  # the second run sees the same rows again and must add nothing
        query = jobs.start_scoring(stream, str(tmp_path / "replies"), schemas.AI_REPLIES, out,
                                   str(tmp_path / f"cp-{run}"))
        query.awaitTermination(300)
        assert query.exception() is None
    got = spark.read.parquet(out)
    want = en.enrich(results, replies).where("metadatos_analisis IS NOT NULL")
    columns = ("query_id", "id", "confianza", "analisis_pendiente")
    assert rows_of(got, *columns) == rows_of(want, *columns)


class _Value:
    def __init__(self):
        self.rows = None

    def exists(self):
        return self.rows is not None

    def get(self):
        return self.rows or []

    def update(self, rows):
        self.rows = rows

    put = update

    def appendList(self, rows):
        self.rows = [*self.get(), *rows]

    def clear(self):
        self.rows = None


class _Handle:
    """State of one key kept in memory."""

    def __init__(self):
        self.timers = set()

    def getListState(self, name, layout):
        return _Value()

    getValueState = getListState

    def registerTimer(self, ms):
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.timers.discard(ms)


def _run(processor, key, rows, until_ms):
    import pandas as pd

    handle = _Handle()
    processor.init(handle)
    list(processor.handleInputRows(key, iter([pd.DataFrame(rows, columns=["us", "clase", "id", "extra"])]), None))
    out = []

    class Now:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):
            return self.ms

    while handle.timers and min(handle.timers) <= until_ms:
        now = min(handle.timers)
        handle.timers.discard(now)
        for part in processor.handleExpiredTimer(key, Now(now), None):
            out += [tuple(r) for r in part.itertuples(index=False)]
    return out


def test_state_is_gone_after_a_session_and_after_a_lifetime():
    second = 1_000_000
    session = jobs._SessionEnd()
    got = _run(session, ("s",), [(1 * second, 0, 0, 0), (2 * second, 0, 0, 0), (3 * second, 1, 0, 0), (4 * second, 1, 0, 0),
                                 (5 * second, 0, 0, 0)], 4_000)
    assert got == [("s", second, 3 * second)] and not session.memory.exists()

    entry = jobs._CacheEntry(10)
    assert _run(entry, ("k",), [(1 * second, 0, 7, 3), (5 * second, 0, 8, 3)], 6_000) == [(7, False), (8, True)]
    assert entry.memory.exists()
    assert _run(entry, ("k",), [(1 * second, 0, 7, 3), (5 * second, 0, 8, 3)], 20_000) == [(7, False), (8, True)]
    assert not entry.memory.exists() and not entry.handle.timers


def test_click_counts_chained(spark, sf_dir, tmp_path):
    log, clicks = b.search_log(spark, sf_dir), b.clicks(spark, sf_dir)
    searches = log.select("search_id", "tema", "ts")
    s = feed(searches, str(tmp_path / "s"), 3, True, (-1, "end", FAR))
    c = feed(clicks.select("click_id", "tema", "ts"), str(tmp_path / "c"), 3, True, (-1, "end", FAR))
    stream = jobs.count_clicks(
        jobs.read_stream(spark, s, "search_id bigint, tema string, ts timestamp_ntz", 1),
        jobs.read_stream(spark, c, "click_id bigint, tema string, ts timestamp_ntz", 1), delay="40 days", shares=3)
    got = run_to_table(stream, tmp_path, "click_counts").where("search_id >= 0")
    # A search's count is final once a later search of its topic has come: those are all but the last per topic.
    later = F.lead("search_id").over(Window.partitionBy("tema").orderBy("ts", "search_id"))
    closed = searches.withColumn("siguiente", later).where("siguiente IS NOT NULL").select("search_id")
    want = activity.click_attribution(log, clicks).join(closed, "search_id")
    assert rows_of(got, "search_id", "veces_clickeado") == rows_of(want, "search_id", "veces_clickeado")
    assert got.count() > 0 and got.where("veces_clickeado > 0").count() > 0


def test_session_ends_by_stream_join(spark, sf_dir, tmp_path):
    starts, ends = b.session_starts(spark, sf_dir), b.session_ends(spark, sf_dir)
    s = feed(starts, str(tmp_path / "s"), 3, True, ("end", FAR))
    e = feed(ends, str(tmp_path / "e"), 3, True, ("end", FAR))
    stream = jobs.close_sessions_joined(
        jobs.read_stream(spark, s, "session_id string, started_at timestamp_ntz", 1),
        jobs.read_stream(spark, e, schemas.SESSION_ENDS, 1), delay="40 days", longest="40 days")
    got = run_to_table(stream, tmp_path, "ended_joined").where("session_id <> 'end'")
    want = activity.close_sessions(starts, ends).where("ended_at IS NOT NULL")
    columns = ("session_id", "started_at", "ended_at")
    assert rows_of(got, *columns) == rows_of(want, *columns)
    assert got.count() > 0
