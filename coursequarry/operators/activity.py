"""Reports over the activity tables: search log, clicks, favourites, feedback, sessions, settings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from coursequarry import fixed_values as fv

# Short, so that the clicks of a topic in the news are spread: a task gets one topic's rows of a slot.
SLOT = "1 minute"


def top_counts(df: DataFrame, column: str, n: int = fv.TOP_N) -> DataFrame:
    """The n most frequent values, ties in value order."""
    return (
        df.groupBy(column).agg(F.count("*").alias("total"))
        .orderBy(F.col("total").desc(), F.col(column)).limit(n)
    )


def top_topics(search_log: DataFrame) -> DataFrame:
    return top_counts(search_log, "tema")


def top_favorites(favorites: DataFrame) -> DataFrame:
    return top_counts(favorites, "titulo")


def count_active(catalogue: DataFrame) -> DataFrame:
    return catalogue.where(F.col("activa")).agg(F.count("*").alias("plataformas_activas"))


def admin_counts(search_log: DataFrame, catalogue: DataFrame, favorites: DataFrame,
                 feedback: DataFrame) -> DataFrame:
    """The four dashboard counts as one row."""
    parts = {
        "busquedas": search_log,
        "plataformas_activas": catalogue.where(F.col("activa")),
        "favoritos": favorites,
        "feedback": feedback,
    }
    counted = reduce(
        DataFrame.unionByName,
        [df.agg(F.count("*").alias("n")).withColumn("parte", F.lit(p)) for p, df in parts.items()],
    )
    return counted.agg(*[F.max(F.when(F.col("parte") == p, F.col("n"))).alias(p) for p in parts])


def list_favorites(favorites: DataFrame) -> DataFrame:
    """Newest first."""
    return favorites.orderBy(F.col("creado_en").desc(), F.col("id").desc())


def settings_latest(settings_log: DataFrame) -> DataFrame:
    """(clave, valor, activada): the last value written per key."""
    return (
        settings_log.groupBy("clave")
        .agg(F.max_by("valor", F.struct("ts", "seq")).alias("valor"))
        .withColumn("activada", F.coalesce(F.col("valor") == "1", F.lit(False)))
    )


def flag_is_on(settings_log: DataFrame, key: str) -> DataFrame:
    """One row: whether the key's last value is '1'; a key never written is off."""
    last = F.max_by("valor", F.struct("ts", "seq"))
    return settings_log.where(F.col("clave") == key).agg(
        F.coalesce(last == "1", F.lit(False)).alias("activada")
    )


def close_sessions(starts: DataFrame, ends: DataFrame) -> DataFrame:
    """Sessions with `ended_at`, the first end at or after their start; open ones keep null.

    The ends are matched in an inner join, which adaptive execution can split on either side where a
    session has very many ends, and reduced before they meet the sessions again.
    """
    first_end = (
        starts.select("session_id", "started_at")
        .join(ends.select("session_id", "ts"), "session_id")
        .where(F.col("ts") >= F.col("started_at"))
        .groupBy("session_id", "started_at")
        .agg(F.min("ts").alias("ended_at"))
    )
    return starts.join(first_end, ["session_id", "started_at"], "left")


def clicks_to_searches(search_log: DataFrame, clicks: DataFrame, slot: str = SLOT) -> DataFrame:
    """(click_id, search_id): every click with the latest search of its topic at that moment.

    At the same moment a search comes before a click, and searches in id order. Clicks before the
    first search of their topic are dropped.

    Time is cut into slots, so one topic, however hot, is worked on by many tasks: each slot starts
    with the last search of the topic's earlier slots, found from one row per topic and slot.
    """
    start = F.window("ts", slot)["start"]
    searched = search_log.select("tema", "ts", F.col("search_id").alias("busqueda"),
                                 start.alias("tramo"))
    clicked = clicks.select("tema", "ts", "click_id", start.alias("tramo"))

    last_in_slot = searched.groupBy("tema", "tramo").agg(
        F.max_by("busqueda", F.struct("ts", "busqueda")).alias("ultima")
    )
    click_slots = clicked.select("tema", "tramo").distinct()
    earlier = Window.partitionBy("tema").orderBy("tramo").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        click_slots.join(last_in_slot, ["tema", "tramo"], "full_outer")
        .withColumn("busqueda", F.last("ultima", ignorenulls=True).over(earlier))
        .where(F.col("busqueda").isNotNull())
        .select("tema", "tramo", "busqueda", F.col("tramo").alias("ts"), F.lit(0).alias("clase"),
                F.lit(None).cast("bigint").alias("click_id"))
    )
    so_far = Window.partitionBy("tema", "tramo").orderBy("ts", "clase", "orden")
    return (
        carried
        .unionByName(searched.withColumn("clase", F.lit(1)), allowMissingColumns=True)
        .unionByName(clicked.withColumn("clase", F.lit(2)), allowMissingColumns=True)
        .withColumn("orden", F.coalesce("click_id", "busqueda"))
        .withColumn("search_id", F.last("busqueda", ignorenulls=True).over(so_far))
        .where((F.col("clase") == 2) & F.col("search_id").isNotNull())
        .select("click_id", "search_id")
    )


def click_attribution(search_log: DataFrame, clicks: DataFrame, slot: str = SLOT) -> DataFrame:
    """The search log with `veces_clickeado`, 0 for searches nobody clicked after."""
    counts = clicks_to_searches(search_log, clicks, slot).groupBy("search_id").agg(
        F.count("*").alias("n")
    )
    return (
        search_log.join(counts, "search_id", "left")
        .withColumn("veces_clickeado", F.coalesce("n", F.lit(0)))
        .drop("n")
    )


def search_events(results: DataFrame, topics: DataFrame, ts: Column) -> DataFrame:
    """One log row per topic with results: language code, platforms label, number shown."""
    shown = results.groupBy("query_id").agg(
        F.array_join(F.array_sort(F.collect_set("plataforma")), ", ").alias("plataforma_origen"),
        F.count("*").cast("int").alias("veces_mostrado"),
    )
    return topics.join(shown, "query_id").select(
        F.col("query_id").alias("search_id"), ts.alias("ts"), "tema", "idioma", "nivel",
        "plataforma_origen", "veces_mostrado",
    )
