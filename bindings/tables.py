"""The library's input tables, derived with Spark from the given parquet tables.

`bindings.oracle` holds the same derivations in SQL. Every table here grows with the given ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from coursequarry.schemas import CERTIFICACION, METADATOS_ANALISIS
from coursequarry.sources.catalogue import seed_platforms

NOW_TEXT = "2024-02-01 00:00:00"

TOPIC_LEADS = ["python", "curso de datos", "diseño", "negocios", "historia", ""]
LABELS = ["Español (es)", "Inglés (en)", "Portugués (pt)", "es", "en", "xx"]
LEVELS = ["Cualquiera", "Principiante", "Intermedio", "Avanzado", "Todos"]
SUFFIXES = ["curso básico gratis", "advanced tutorial", "precio especial", "learn free", "",
            "certificate expert"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def now() -> Column:
    return F.lit(NOW_TEXT).cast("timestamp_ntz")


# --- search requests and the tables they meet ------------------------------------------------------


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn is a search request; its topic is taken from the words of the whole text."""
    turns = read(spark, sf_dir, "conversations").where(F.col("role") == "user")
    letters = F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))
    sized = F.transform(letters, lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))
    short = F.array_max(F.filter(sized, lambda s: s["n"] <= 5))["w"]
    conv, turn = F.col("conv_id"), F.col("turn")
    lead = pick(TOPIC_LEADS, (conv + turn) % 6)
    tema = F.concat_ws(
        " ",
        F.when(lead != "", lead),
        short,
        F.array_max(sized)["w"],
        F.when(conv % 5 == 0, short),
        F.when(conv % 7 == 0, "& *~"),
    )
    return turns.select(
        (conv * 1000 + turn).alias("query_id"),
        tema.alias("tema"),
        pick(LABELS, conv % 6).alias("idioma_ui"),
        pick(LEVELS, (conv + F.floor(turn / 2)) % 5).alias("nivel"),
    )


def resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as candidate resources: title, whole visible text with a suffix, edited address."""
    page = F.col("page_id")
    visible = F.col("html")
    for pattern in [r"(?s)<script.*?</script>", r"(?s)<style.*?</style>", r"(?s)<!--.*?-->", r"<[^>]+>",
                    r"[ \t\r\n]+"]:
        visible = F.regexp_replace(visible, pattern, " ")
    url = (
        F.when(page % 7 == 0, F.replace("url", F.lit(".example."), F.lit(".edu.example.")))
        .when(page % 11 == 0, F.replace("url", F.lit(".example."), F.lit(".gov.example.")))
        .otherwise(F.col("url"))
    )
    return read(spark, sf_dir, "pages").select(
        "page_id",
        url.alias("url"),
        F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("titulo"),
        F.concat(F.trim(visible), F.lit(" "), pick(SUFFIXES, page % 6)).alias("descripcion"),
        F.regexp_extract("html", r'<html lang="([^"]*)"', 1).alias("idioma"),
    )


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First catalogue rows plus one platform per host seen in the pages."""
    hosts = (
        read(spark, sf_dir, "pages")
        .select(
            F.regexp_extract("url", r"^https?://([^/]*)", 1).alias("host"),
            "page_id",
            F.regexp_extract("html", r'<html lang="([^"]*)"', 1).alias("lang"),
        )
        .groupBy("host")
        .agg(F.min(F.struct("page_id", "lang")).alias("p"))
        .select("host", (F.col("p.page_id") + 1000).alias("id"), F.col("p.lang").alias("lang"))
    )
    i = F.col("id")
    derived = hosts.select(
        "id",
        F.col("host").alias("nombre"),
        F.concat(F.lit("https://"), "host", F.lit("/buscar?q={}")).alias("url_base"),
        F.when(i % 9 != 0, F.concat(F.lit("Cursos de "), "host")).alias("descripcion"),
        F.when(F.col("lang") == "fr", "pt").otherwise(F.col("lang")).alias("idioma"),
        F.lit("General").alias("categoria"),
        pick(["Principiante", "Intermedio", "Avanzado", "Todos", None], i % 5).alias("nivel"),
        F.when(i % 13 == 0, None).when(i % 11 == 0, 0.0)
        .otherwise(F.lit(0.5) + (i % 50) / F.lit(100.0)).alias("confianza"),
        (i % 6 != 0).alias("activa"),
        pick(["gratuito", "audit", "pago", "none", None], F.floor(i / 2) % 5).alias("tipo_certificacion"),
        (i % 2 == 0).alias("validez_internacional"),
        pick(['["es"]', '{"paises":["mx","ar"]}', "{}", "oops", "3", None, '["uk", "us"] x'], i % 7)
        .alias("paises_validos"),
        pick([None, 0.0, 0.7, 0.95], i % 4).alias("reputacion_academica"),
    )
    return seed_platforms(spark).unionByName(derived)


_SLOTS = [(1, pos, off) for pos, off in enumerate([0, 1, 2, 3, 1, 5, 6, 7])] + [
    (2, pos, off) for pos, off in enumerate([8, 0, 9, 2, 10, 11, 8, 12, 13, 14, 15, 16])
]


def _turn_number() -> Column:
    """A request's number among all turns; its page numbers step through all pages."""
    query = F.col("query_id")
    return F.floor(query / 1000) * 13 + query % 1000


def _page_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").agg((F.max("page_id") + 1).alias("n")).scalar()


def web_items(spark: SparkSession, sf_dir: str, topics: DataFrame | None = None) -> DataFrame:
    """Landed items: twenty places over two rounds per topic, with repeats in and across rounds.

    One topic in six gets no reply at all. Columns of `topics` (query_id and others) are joined to the places before
    these meet the pages, so that no page text is shuffled once for every place that shows it.
    """
    pages = resources(spark, sf_dir)
    n_pages = _page_count(spark, sf_dir)
    slots = F.array(*[
        F.struct(F.lit(r).alias("ronda"), F.lit(p).alias("pos"), F.lit(o).alias("salto"))
        for r, p, o in _SLOTS
    ])
    wanted = (
        requests(spark, sf_dir).where(F.col("query_id") % 6 != 5)
        .select("query_id", F.inline(slots))
        .withColumn("page_id", (_turn_number() * 17 + F.col("salto") * 11) % n_pages)
    )
    more = [] if topics is None else [c for c in topics.columns if c != "query_id"]
    if topics is not None:
        wanted = wanted.join(topics, "query_id")
    return wanted.join(pages, "page_id").select(
        "query_id", "ronda", "pos",
        F.col("url").alias("link"),
        F.when(F.col("page_id") % 17 == 0, "").otherwise(F.col("titulo")).alias("title"),
        F.when(F.col("page_id") % 19 != 0, F.col("descripcion")).alias("snippet"),
        *more,
    )


def fallback_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One landed fallback page per topic; two thirds of them link to course addresses."""
    pages = read(spark, sf_dir, "pages")
    n_pages = _page_count(spark, sf_dir)
    course = F.replace("html", F.lit('href="/'), F.lit('href="https://site.example/curso/'))
    plain = F.replace("html", F.lit('href="/'), F.lit('href="https://site.example/'))
    return (
        requests(spark, sf_dir)
        .select("query_id", (_turn_number() % n_pages).alias("page_id"))
        .join(pages, "page_id")
        .select("query_id", F.when(F.col("page_id") % 3 != 0, course).otherwise(plain).alias("html"))
    )


def landed_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The menu links of every page, written as the JSON text of one landed reply."""
    found = F.regexp_extract_all("html", F.lit(r'(<a href="[^"]*">[^<]*</a>)'), F.lit(1))
    items = F.transform(
        found,
        lambda a: F.struct(
            F.nullif(F.regexp_extract(a, r'href="([^"]*)"', 1), F.lit("/de")).alias("link"),
            F.nullif(F.regexp_extract(a, r">([^<]*)<", 1), F.lit("the")).alias("title"),
        ),
    )
    return read(spark, sf_dir, "pages").select(
        F.col("page_id").alias("query_id"),
        F.to_json(F.struct(items.alias("items"))).alias("respuesta"),
    )


# --- activity tables -----------------------------------------------------------------------------------


def _events(spark: SparkSession, sf_dir: str, kind: str | None = None) -> DataFrame:
    df = read(spark, sf_dir, "events")
    if kind:
        df = df.where(F.col("event_type") == kind)
    return df.withColumn("k", F.get_json_object("props", "$.k"))


def search_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir, "view").select(
        F.col("event_id").alias("search_id"),
        "ts",
        F.concat(F.lit("tema "), "k").alias("tema"),
        pick(["es", "en", "pt"], F.col("user_id") % 3).alias("idioma"),
        pick(LEVELS[:4], F.col("event_id") % 4).alias("nivel"),
        F.lit("Web").alias("plataforma_origen"),
        (F.floor("value") % 16).cast("int").alias("veces_mostrado"),
    )


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir, "click").select(
        F.col("event_id").alias("click_id"), "ts", F.concat(F.lit("tema "), "k").alias("tema")
    )


def favorites(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.lit("https://site.example/curso/"), "k")
    return _events(spark, sf_dir, "purchase").select(
        F.col("event_id").alias("id"),
        F.substring(F.md5(url), 1, 10).alias("id_recurso"),
        F.concat(F.lit("Curso "), "k").alias("titulo"),
        url.alias("url"),
        F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("nota "), F.col("user_id").cast("string")))
        .alias("notas"),
        F.col("ts").alias("creado_en"),
    )


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir, "error").select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("r"), "k").alias("id_recurso"),
        F.concat(F.lit("opinión "), "k").alias("opinion"),
        (F.floor("value") % 5 + 1).cast("int").alias("rating"),
        F.col("ts").alias("creado_en"),
    )


def session_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _events(spark, sf_dir, "signup")
        .groupBy(F.concat(F.lit("sess_"), F.col("user_id").cast("string")).alias("session_id"))
        .agg(F.min("ts").alias("started_at"))
    )


def session_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir, "purchase").select(
        F.concat(F.lit("sess_"), F.col("user_id").cast("string")).alias("session_id"), "ts"
    )


def settings_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select(
        F.col("event_id").alias("seq"),
        "ts",
        F.concat(F.lit("opt_"), (F.col("user_id") % 20).cast("string")).alias("clave"),
        F.when(F.floor("value") % 2 == 1, "1").otherwise("0").alias("valor"),
    )


def cache_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    return _events(spark, sf_dir, "view").select(
        "event_id",
        "ts",
        F.concat_ws("|", (u % 10).cast("string"), pick(["es", "en", "pt"], u % 3),
                    pick(LEVELS[:4], F.col("event_id") % 4)).alias("clave"),
        (F.floor("value") % 16).cast("int").alias("n_resultados"),
    )


# --- resources waiting for a model reply, replies, chat --------------------------------------------------


def ai_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    url = F.concat(F.lit("https://"), "source", F.lit(".example.org/"), d.cast("string"))
    return read(spark, sf_dir, "documents").select(
        F.floor(d / 5).alias("query_id"),
        (d % 5 + 1).cast("int").alias("puesto"),
        F.substring(F.md5(url), 1, 10).alias("id"),
        url.alias("url"),
        F.when(d % 9 != 0, F.concat(F.lit("Documento "), d.cast("string"))).alias("titulo"),
        F.when(d % 10 != 0, F.concat(F.lit("Texto de "), "source")).alias("descripcion"),
        F.lit(None).cast(CERTIFICACION).alias("certificacion"),
        now().alias("ultima_verificacion"),
        (F.lit(0.5) + (d % 50) / F.lit(100.0)).alias("confianza"),
        (d % 2 == 1).alias("analisis_pendiente"),
        F.lit(None).cast(METADATOS_ANALISIS).alias("metadatos_analisis"),
    )


def ai_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies for labelled documents, in twelve shapes from clean to broken; one in ten gets a second one."""
    labels = read(spark, sf_dir, "labels")
    docs = read(spark, sf_dir, "documents").select("doc_id", "source")
    d = F.col("doc_id")
    url = F.concat(F.lit("https://"), "source", F.lit(".example.org/"), d.cast("string"))
    q = (F.lit(0.25) + F.col("quality") / F.lit(2.0)).cast("string")
    r = (F.lit(1.0) - F.col("toxic") / F.lit(2.0)).cast("string")

    def text(*parts):
        return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])

    full = text('{"calidad_educativa": ', q, ', "relevancia_usuario": ', r,
                ', "razones_calidad": ["clara", "breve"], "recomendacion_personalizada": "Vale la pena.",'
                ' "advertencias": []}')
    shapes = [
        full,
        text('{"calidad_educativa": "', q, '", "relevancia_usuario": "', r, '"}'),
        text('{"calidad_educativa": ', q, ', "advertencias": ["larga"]}'),
        text('{"calidad_educativa": null, "relevancia_usuario": ', r, "}"),
        text('{"calidad_educativa": ', q, ", oops"),
        text('["calidad_educativa", ', q, "]"),
        text("Claro:\n", full, "\nSuerte."),
        text('{"calidad_educativa": "alta", "relevancia_usuario": ', r, "}"),
        text('{"calidad_educativa": "nan", "relevancia_usuario": ', r, "}"),
        text('{"calidad_educativa": "1e300", "relevancia_usuario": ', r, "}"),
        text('{"calidad_educativa": ', q, ', "relevancia_usuario": "-Infinity"}'),
        text('{"calidad_educativa": "', F.repeat(F.lit("9"), 2000), '", "relevancia_usuario": ', r, "}"),
    ]
    shape = F.lit(None).cast("string")
    for i, s in enumerate(shapes):
        shape = F.when(d % 12 == i, s).otherwise(shape)
    again = F.when(d % 10 == 3, '{"calidad_educativa": 0.5, "relevancia_usuario": 0.5}')
    return labels.join(docs, "doc_id").select(
        F.floor(d / 5).alias("query_id"), F.substring(F.md5(url), 1, 10).alias("id"),
        F.explode(F.array_compact(F.array(shape, again))).alias("respuesta"),
    )


def search_replies(items: DataFrame) -> DataFrame:
    """Replies for two thirds of the landed items, by request and resource id; an address given twice has two."""
    digit, other = (F.col("pos") % 10).cast("string"), (F.col("query_id") % 10).cast("string")
    return items.where((F.col("query_id") + F.col("pos")) % 3 != 0).select(
        "query_id", F.substring(F.md5("link"), 1, 10).alias("id"),
        F.concat(F.lit('{"calidad_educativa": 0.'), digit, F.lit(', "relevancia_usuario": 0.'), other, F.lit("}"))
        .alias("respuesta"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat turns dressed with the artefacts that cleaning has to remove."""
    c = F.col("conv_id") % 4
    t = F.col("text")
    dressed = (
        F.when(c == 0, F.concat(t, F.lit("\n```json\n{\"a\": 1}\n```\n")))
        .when(c == 1, F.concat(F.lit('  {"tipo": "x",\n "y": 2}  \n'), t))
        .when(c == 2, F.concat(F.lit("<b>"), t, F.lit('</b> <br/>{"z": [1,\n2]}  ')))
        .otherwise(t)
    )
    return read(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role",
        F.when(F.col("turn") % 5 == 4, '```x```\n{"solo": 1}').otherwise(dressed).alias("text"),
    )
