"""The online jobs: search log, running top topics, click credit, session ends, cache, scoring."""

from __future__ import annotations

from functools import partial

import pandas as pd

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from coursequarry import fixed_values as fv
from coursequarry.operators.activity import top_topics
from coursequarry.operators.enrich import enrich, needs_analysis
from coursequarry.sources.activity_log import DAY
from coursequarry.streaming.ordered import OrderedReplay, _to_us, from_us, replay_stream

DELAY = "1 hour"
ONCE = {"availableNow": True}


def read_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    )


def start_search_log(events: DataFrame, path: str, checkpoint: str, trigger: dict = ONCE) -> StreamingQuery:
    """Append search events as they occur, in one directory per day; `trigger` as of `DataStreamWriter.trigger`."""
    return (
        events.withColumn(DAY, F.to_date("ts")).writeStream.format("parquet").outputMode("append")
        .partitionBy(DAY).option("checkpointLocation", checkpoint)
        .trigger(**trigger).start(path)
    )


def running_top_topics(events: DataFrame) -> DataFrame:
    """The most searched topics so far; to be written in complete mode."""
    return top_topics(events)


# --- clicks ---------------------------------------------------------------------------------------------


class _ClickCredit(OrderedReplay):
    """Memory: the last search of the topic."""

    columns = ["click_id", "search_id"]

    def replay(self, key, memory, rows):
        out = []
        for _, clase, number, _ in rows:
            if clase == 0:
                memory = (number,)
            elif memory is not None:
                out.append((number, memory[0]))
        return memory, out


def credit_clicks(searches: DataFrame, clicks: DataFrame, delay: str = DELAY, shares: int = 8) -> DataFrame:
    """(click_id, search_id): clicks with the latest search of their topic at that moment.

    A topic's clicks are dealt over `shares` keys and its searches copied to each, so a topic with most
    of the clicks is not left to one task.
    """
    every_share = F.explode(F.array(*[F.lit(i) for i in range(shares)]))
    searched = searches.select(
        "tema", every_share.alias("parte"), "ts", F.lit(0).alias("clase"), F.col("search_id").alias("id")
    )
    clicked = clicks.select(
        "tema", F.pmod(F.hash("click_id"), F.lit(shares)).alias("parte"), "ts", F.lit(1).alias("clase"),
        F.col("click_id").alias("id"),
    )
    rows = searched.unionByName(clicked).withColumn("extra", F.lit(0).cast("bigint"))
    return replay_stream(rows, ["tema", "parte"], _ClickCredit(), "click_id bigint, search_id bigint", delay)


class _ClickCounts(OrderedReplay):
    """Memory: the topic's last search on this share and the clicks it has had here so far."""

    memory_layout = "search_id bigint, clicks bigint"
    columns = ["search_id", "clicks"]

    def replay(self, key, memory, rows):
        out = []
        for _, clase, number, _ in rows:
            if clase == 0:
                if memory is not None:
                    out.append(memory)
                memory = (number, 0)
            elif memory is not None:
                memory = (memory[0], memory[1] + 1)
        return memory, out


class _ShareSum(StatefulProcessor):
    """Per search: the clicks its shares have reported; emitted and forgotten once all shares have."""

    def __init__(self, shares: int) -> None:
        self.shares = shares

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sum = handle.getValueState("suma", "clicks bigint, parts int")

    def handleInputRows(self, key, rows, timerValues):
        clicks, parts = tuple(self.sum.get()) if self.sum.exists() else (0, 0)
        for pdf in rows:
            clicks, parts = clicks + int(pdf["clicks"].sum()), parts + len(pdf)
        if parts < self.shares:
            self.sum.update((clicks, parts))
            return
        self.sum.clear()
        yield pd.DataFrame({"search_id": [key[0]], "veces_clickeado": [clicks]})

    def close(self) -> None:
        pass


def count_clicks(searches: DataFrame, clicks: DataFrame, delay: str = DELAY, shares: int = 8) -> DataFrame:
    """(search_id, veces_clickeado): the clicks credited to a search, once its count is final.

    Two stateful operators in a row, both in append mode. The first replays each (topic, share) in event order
    and, when a later search of the topic passes the watermark, emits the closed search's clicks on that share
    (0 included). The closing search reaches every share, so each search gets exactly `shares` such rows; the
    second operator, keyed by search, adds them up, emits the sum with the last one and forgets the search. The
    last search of a topic stays open (its clicks keep counting in state) until a later search closes it.
    """
    every_share = F.explode(F.array(*[F.lit(i) for i in range(shares)]))
    searched = searches.select(
        "tema", every_share.alias("parte"), "ts", F.lit(0).alias("clase"), F.col("search_id").alias("id"))
    clicked = clicks.select(
        "tema", F.pmod(F.hash("click_id"), F.lit(shares)).alias("parte"), "ts", F.lit(1).alias("clase"),
        F.col("click_id").alias("id"))
    rows = searched.unionByName(clicked).withColumn("extra", F.lit(0).cast("bigint"))
    closed = replay_stream(rows, ["tema", "parte"], _ClickCounts(), "search_id bigint, clicks bigint", delay)
    return closed.groupBy("search_id").transformWithStateInPandas(
        statefulProcessor=_ShareSum(shares), outputStructType="search_id bigint, veces_clickeado bigint",
        outputMode="Append", timeMode="None")


# --- sessions ---------------------------------------------------------------------------------------------


class _SessionEnd(OrderedReplay):
    """Memory: start of the open session; a session that has ended leaves none."""

    memory_layout = "inicio bigint"
    columns = ["session_id", "inicio_us", "fin_us"]

    def replay(self, key, memory, rows):
        out = []
        for us, clase, _, _ in rows:
            if clase == 0:
                memory = memory or (us,)
            elif memory is not None:
                out.append((key[0], memory[0], us))
                memory = None
        return memory, out


def close_sessions(starts: DataFrame, ends: DataFrame, delay: str = DELAY) -> DataFrame:
    """(session_id, started_at, ended_at) of sessions as they end; the first end wins.

    A further start while the session is open changes nothing; one after its end opens it again.
    """
    started = starts.select("session_id", F.col("started_at").alias("ts"), F.lit(0).alias("clase"))
    ended = ends.select("session_id", "ts", F.lit(1).alias("clase"))
    rows = started.unionByName(ended).withColumn("id", F.lit(0).cast("bigint")).withColumn(
        "extra", F.lit(0).cast("bigint")
    )
    closed = replay_stream(rows, ["session_id"], _SessionEnd(),
                           "session_id string, inicio_us bigint, fin_us bigint", delay)
    return closed.select("session_id", from_us(F.col("inicio_us")).alias("started_at"),
                         from_us(F.col("fin_us")).alias("ended_at"))


def close_sessions_joined(starts: DataFrame, ends: DataFrame, delay: str = DELAY,
                          longest: str = "1 day") -> DataFrame:
    """(session_id, started_at, ended_at) of every start with its first end, as a stream-stream join.

    Both streams are watermarked; a start meets the ends of its session from its own moment up to `longest`
    after it (a time-range condition, so Spark can drop a start from state once the watermark is past that range,
    and an end once no start can still reach it). The joined rows go on to a second stateful operator that keeps
    the earliest end per start and emits it, in append mode, when the watermark has passed the start's whole
    range. No Python worker takes part. A session that lasts longer than `longest` counts as not ended here; the
    batch operator has no such bound.
    """
    started = starts.select("session_id", F.timestamp_micros(_to_us(F.col("started_at"))).alias("inicio")) \
        .withWatermark("inicio", delay)
    ended = ends.select(F.col("session_id").alias("sesion"), F.timestamp_micros(_to_us(F.col("ts"))).alias("fin")) \
        .withWatermark("fin", delay)
    joined = started.join(ended, F.expr(
        f"session_id = sesion AND fin >= inicio AND fin <= inicio + INTERVAL {longest}"))
    first = joined.groupBy("session_id", "inicio").agg(F.min("fin").alias("fin"))
    return first.select("session_id", from_us(_to_us(F.col("inicio"))).alias("started_at"),
                        from_us(_to_us(F.col("fin"))).alias("ended_at"))


# --- cache --------------------------------------------------------------------------------------------------


class _CacheEntry(OrderedReplay):
    """Memory: when the key's result was stored, and how many rows it has."""

    memory_layout = "guardado bigint, filas bigint"
    columns = ["event_id", "acierto"]

    def __init__(self, ttl: int) -> None:
        self.ttl_us = ttl * 1_000_000

    def expires(self, memory):
        return memory[0] + self.ttl_us

    def replay(self, key, memory, rows):
        out = []
        for us, _, number, n in rows:
            hit = memory is not None and memory[1] > 0 and us - memory[0] < self.ttl_us
            if not hit:
                memory = (us, n)
            out.append((number, hit))
        return memory, out


def judge_cache_requests(requests: DataFrame, ttl: int = fv.CACHE_TTL_SECONDS,
                         delay: str = DELAY) -> DataFrame:
    """(event_id, acierto) for requests in event order."""
    rows = requests.select(
        "clave", "ts", F.lit(0).alias("clase"), F.col("event_id").alias("id"),
        F.col("n_resultados").cast("bigint").alias("extra"),
    )
    return replay_stream(rows, ["clave"], _CacheEntry(ttl), "event_id bigint, acierto boolean", delay)


# --- scoring ------------------------------------------------------------------------------------------------


def _score_batch(batch: DataFrame, batch_id: int, *, replies_path: str, replies_schema: str,
                 path: str) -> None:
    spark = batch.sparkSession
    replies = spark.read.schema(replies_schema).parquet(replies_path)
    waiting = needs_analysis(batch).dropDuplicates(["query_id", "id"])
    scored = enrich(waiting, replies).where(F.col("metadatos_analisis").isNotNull())
    earlier = (
        spark.read.schema(scored.schema).option("recursiveFileLookup", True)
        .option("ignoreMissingFiles", True).parquet(path)
        .where(~F.col("_metadata.file_path").contains(f"/lote={batch_id}/"))
        .select("query_id", "id")
    )
    # A repeated batch overwrites its own directory, so every row is scored once.
    scored.join(earlier, ["query_id", "id"], "left_anti").write.mode("overwrite").parquet(
        f"{path}/lote={batch_id}"
    )


def start_scoring(results: DataFrame, replies_path: str, replies_schema: str, path: str,
                  checkpoint: str, trigger: dict = ONCE) -> StreamingQuery:
    """Score waiting result rows batch by batch against the reply table; rows already scored are left.

    `path` is an existing directory.
    """
    step = partial(_score_batch, replies_path=replies_path, replies_schema=replies_schema, path=path)
    return (
        results.writeStream.foreachBatch(lambda batch, batch_id: step(batch, batch_id))
        .option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )
