"""Which stored result answers a request, over a log of requests with expiring results.

A request is a hit if its key holds a non-empty result stored less than the lifetime ago. Hits do not
renew the entry; every miss stores its own result, and an empty stored result never makes a hit. So the
entries that make hits ("anchors") of a key form a chain: the first non-empty request, then always the
first non-empty request at least one lifetime later. Once the anchors are known, every request is
judged by itself.

Time is cut into frames as long as the lifetime. A frame holds at most one anchor of a key, and only the
anchors of a request's own and previous frame can matter to it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from coursequarry import fixed_values as fv
from coursequarry.sources.scratch import cut_lineage


def _span(seconds: int) -> Column:
    return F.make_dt_interval(secs=F.lit(seconds))


def _frame(ts: str, seconds: int) -> Column:
    return F.window(ts, f"{seconds} seconds")["start"]


def possible_anchors(requests: DataFrame) -> DataFrame:
    """(clave, ts, event_id): non-empty requests, one per key and moment."""
    return requests.where(F.col("n_resultados") > 0).groupBy("clave", "ts").agg(F.min("event_id").alias("event_id"))


def _next_store(stores: DataFrame, ttl: int) -> DataFrame:
    """(clave, ts, sig): the first possible anchor at least one lifetime after each one.

    Both sides meet in short slots of time, so a hot key is spread over many tasks; what lies beyond a
    slot comes from one row per key and slot.
    """
    slot = max(ttl // 64, 1)
    key = ["clave"]
    points = stores.select(*key, F.col("ts").alias("t"), F.col("ts").alias("sig"),
                           F.lit(1).alias("clase"))
    probes = stores.select(*key, (F.col("ts") + _span(ttl)).alias("t"), F.col("ts").alias("origen"),
                           F.lit(0).alias("clase"))
    both = points.unionByName(probes, allowMissingColumns=True).withColumn("ranura", _frame("t", slot))
    later = Window.partitionBy(*key).orderBy(F.col("ranura").desc()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    beyond = (
        both.groupBy(*key, "ranura").agg(F.min("sig").alias("primera"))
        .withColumn("despues", F.last("primera", ignorenulls=True).over(later))
        .select(*key, "ranura", "despues")
    )
    at_or_after = Window.partitionBy(*key, "ranura").orderBy(F.col("t").desc(), F.col("clase").desc())
    return (
        both.withColumn("hallada", F.last("sig", ignorenulls=True).over(at_or_after))
        .where(F.col("clase") == 0)
        .join(beyond, [*key, "ranura"])
        .select(*key, F.col("origen").alias("ts"), F.coalesce("hallada", "despues").alias("sig"))
        .where(F.col("sig").isNotNull())
    )


def cache_anchors(requests: DataFrame, ttl: int = fv.CACHE_TTL_SECONDS) -> DataFrame:
    """(clave, ts, event_id) of the stored results that make hits.

    No chain is ever walked in one task: jump tables of 1, 2, 4, … links are made by joining each with
    itself. The chain from a key's first point is then marked from the longest jump down: whatever a
    marked point jumps to is marked.
    """
    stores = cut_lineage(possible_anchors(requests), "guardados")
    spans = stores.groupBy("clave").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    longest = spans.agg(F.max((F.col("b") - F.col("a")).cast("interval second").cast("bigint"))).first()[0]
    links = max(int(longest or 0) // ttl, 1)
    jumps = [cut_lineage(_next_store(stores, ttl), "saltos")]
    for _ in range(math.ceil(math.log2(links + 1))):
        far = jumps[-1].withColumnRenamed("ts", "medio").withColumnRenamed("sig", "lejos")
        near = jumps[-1].withColumnRenamed("sig", "medio")
        jumps.append(cut_lineage(
            near.join(far, ["clave", "medio"]).select("clave", "ts", F.col("lejos").alias("sig")), "saltos"))
    marked = spans.select("clave", F.col("a").alias("ts"))
    for jump in reversed(jumps):
        reached = marked.join(jump, ["clave", "ts"]).select("clave", F.col("sig").alias("ts"))
        marked = cut_lineage(marked.unionByName(reached).distinct(), "anclas")
    return stores.join(marked, ["clave", "ts"]).select("clave", "ts", "event_id")


def cache_hits(requests: DataFrame, ttl: int = fv.CACHE_TTL_SECONDS) -> DataFrame:
    """The requests (event_id, ts, clave, n_resultados) with `respuesta_de`, the request whose stored result answers
    it, null where none does, and `acierto`, whether one does."""
    anchors = cache_anchors(requests, ttl).withColumn("tramo", _frame("ts", ttl))
    own = anchors.select("clave", "tramo", F.struct("ts", "event_id").alias("propia"))
    before = anchors.select(
        "clave", (F.col("tramo") + _span(ttl)).alias("tramo"), F.struct("ts", "event_id").alias("previa")
    )
    lookup = (
        own.unionByName(before, allowMissingColumns=True)
        .groupBy("clave", "tramo").agg(F.max("propia").alias("propia"), F.max("previa").alias("previa"))
    )
    in_previous = F.col("ts") < F.col("previa.ts") + _span(ttl)
    in_own = F.struct("ts", "event_id") > F.col("propia")
    return (
        requests.withColumn("tramo", _frame("ts", ttl))
        .join(lookup, ["clave", "tramo"], "left")
        .withColumn("respuesta_de", F.when(in_previous, F.col("previa.event_id"))
                    .when(in_own, F.col("propia.event_id")))
        .withColumn("acierto", F.col("respuesta_de").isNotNull())
        .select(*requests.columns, "respuesta_de", "acierto")
    )


def cache_snapshot(judged: DataFrame, now: Column) -> DataFrame:
    """Entries held at `now`: (clave, edad_s, n_resultados, entradas), from the output of `cache_hits`.

    A key holds what its last miss stored, expired or not. The row with null key carries the number of
    entries.
    """
    last = F.max_by(F.struct("ts", "n_resultados"), F.struct("ts", "event_id"))
    entries = judged.where(~F.col("acierto")).groupBy("clave").agg(last.alias("e"))
    # The roll-up runs over one row per key and gives the total without judging the requests again.
    per_key = F.grouping("clave") == 0
    return entries.rollup("clave").agg(
        F.when(
            per_key, (now - F.max("e.ts")).cast("interval second").cast("bigint")
        ).alias("edad_s"),
        F.when(per_key, F.max("e.n_resultados")).alias("n_resultados"),
        F.when(~per_key, F.count("*")).alias("entradas"),
    )
