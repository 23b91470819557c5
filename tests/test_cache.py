"""Cache replay against a plain walk through the requests."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F
import pytest

from coursequarry import schemas
from coursequarry.operators.cache import cache_hits, cache_snapshot

T0 = datetime(2024, 3, 1)


def walk(rows, ttl):
    """Whose stored result answers each request: the results kept in a dict, requests in time order."""
    stored, hits = {}, {}
    for event_id, ts, key, n in sorted(rows, key=lambda r: (r[1], r[0])):
        entry = stored.get(key)
        hit = entry is not None and entry[1] > 0 and ts - entry[0] < timedelta(seconds=ttl)
        hits[event_id] = entry[2] if hit else None
        if not hit:
            stored[key] = (ts, n, event_id)
    return hits, stored


def frame(spark, rows):
    return spark.createDataFrame(rows, schemas.CACHE_REQUESTS)


def test_lifetime_is_strict_and_not_renewed(spark):
    hours = [0, 5, 12, 13, 24, 25]
    rows = [(i, T0 + timedelta(hours=h), "k", 3) for i, h in enumerate(hours)]
    got = {r.event_id: r.acierto for r in cache_hits(frame(spark, rows)).collect()}
    assert [got[i] for i in range(6)] == [False, True, False, True, False, True]


def test_empty_result_is_no_hit(spark):
    rows = [(0, T0, "k", 0), (1, T0 + timedelta(hours=5), "k", 2), (2, T0 + timedelta(hours=6), "k", 0)]
    got = {r.event_id: r.acierto for r in cache_hits(frame(spark, rows)).collect()}
    assert got == {0: False, 1: False, 2: True}


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_walk(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(900):
        # One key holds a third of the requests; others have pauses and moments shared by requests.
        key = "hot" if i % 3 == 0 else f"k{rnd.randrange(6)}"
        span = 40_000 if key == "hot" else 400_000
        ts = T0 + timedelta(seconds=rnd.randrange(span) if key == "hot" else rnd.randrange(0, span, 50))
        rows.append((i, ts, key, rnd.choice([0, 0, 1, 5])))
    ttl = 1000
    hits, stored = walk(rows, ttl)
    judged = cache_hits(frame(spark, rows), ttl)
    assert {r.event_id: r.respuesta_de for r in judged.collect()} == hits
    assert judged.where(F.col("acierto") != F.col("respuesta_de").isNotNull()).count() == 0

    now = T0 + timedelta(days=30)
    snap = cache_snapshot(judged, F.lit(now).cast("timestamp_ntz")).collect()
    total = [r.entradas for r in snap if r.clave is None]
    assert total == [len(stored)]
    assert {r.clave: (r.edad_s, r.n_resultados) for r in snap if r.clave} == {
        k: (int((now - ts).total_seconds()), n) for k, (ts, n, _) in stored.items()
    }
