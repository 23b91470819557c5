"""Candidate results of the four sources.

Topics are requests prepared by `sources.requests.prepare_topics`. Each source first adds a short
list column to the topic row (`*_lists`), bounded by the source's own limit, so that a topic stays one
narrow row through every join; `expand` turns the lists into result rows in the layout of
`schemas.RESULTS`. `now` is the verification time given by the caller; nothing here reads the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from coursequarry import fixed_values as fv
from coursequarry import schemas
from coursequarry.functions import text as tx
from coursequarry.functions.labels import certificate, zero_as
from coursequarry.sources.landed import first_links

# Source order; earlier sources win when two bring the same address.
HIDDEN, WEB, KNOWN, FALLBACK = 0, 1, 2, 3

LIST_COLUMNS = {HIDDEN: "ocultas", WEB: "web", KNOWN: "conocidas", FALLBACK: "respaldo"}

# --- hidden platforms -----------------------------------------------------------------------------

_ANY = "*"
_LEVELS = [fv.ANY_LEVEL, fv.ALL_LEVELS, fv.BEGINNER, fv.INTERMEDIATE, fv.ADVANCED]


def platform_shortlist(catalogue: DataFrame) -> DataFrame:
    """Best active platforms per language and level key, before any topic is looked at.

    Level key '*' ranks every level of a language, the others one level each. A topic needs no
    platform outside its two keys' lists, so topics never have to be ranked against the catalogue.
    Result: (idioma, clave_nivel, lista), the list being best first.
    """
    best = Window.partitionBy("idioma", "clave_nivel").orderBy(
        F.col("confianza").desc_nulls_last(), "id"
    )
    entry = F.struct(
        F.col("confianza").isNull().cast("int").alias("sin_confianza"),
        (-F.col("confianza")).alias("orden"),
        "id", "nombre", "url_base", "descripcion", "nivel", "confianza", "tipo_certificacion",
        "validez_internacional", "paises_validos", "reputacion_academica",
    )
    return (
        catalogue.where(F.col("activa") & F.col("idioma").isNotNull())
        .withColumn("clave_nivel", F.explode(F.array(F.lit(_ANY), F.col("nivel"))))
        .where(F.col("clave_nivel").isNotNull())
        .withColumn("puesto", F.row_number().over(best))
        .where(F.col("puesto") <= fv.HIDDEN_LIMIT)
        .groupBy("idioma", "clave_nivel")
        .agg(F.array_sort(F.collect_list(entry)).alias("lista"))
    )


def hidden_lists(topics: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Topics with `ocultas`: the six best platforms for their language and level.

    Requests have the languages and levels of the form; the short list is cut to those, so it has one row
    for each language and level key at most, whatever the catalogue holds, and is broadcast.
    """
    shortlist = F.broadcast(platform_shortlist(catalogue.where(F.col("idioma").isin(*set(fv.LANGUAGE_CODES.values())))).where(
        F.col("clave_nivel").isin(_ANY, *_LEVELS)))
    own = shortlist.select("idioma", "clave_nivel", F.col("lista").alias("propia"))
    for_all = shortlist.where(F.col("clave_nivel") == fv.ALL_LEVELS).select(
        "idioma", F.lit(False).alias("abierta"), F.col("lista").alias("comun")
    )
    open_level = tx.any_level(F.col("nivel"))
    both = F.array_sort(F.concat(F.coalesce("propia", F.array()), F.coalesce("comun", F.array())))
    return (
        topics.withColumn("abierta", open_level)
        .withColumn("clave_nivel", F.when(open_level, _ANY).otherwise(F.col("nivel")))
        .join(own, ["idioma", "clave_nivel"], "left")
        .join(for_all, ["idioma", "abierta"], "left")
        .select(*topics.columns, F.slice(both, 1, fv.HIDDEN_LIMIT).alias("ocultas"))
    )


# --- web results ------------------------------------------------------------------------------------


def web_kept(topics: DataFrame, items: DataFrame) -> DataFrame:
    """Topics (all of them) with the landed items that count.

    `items` is (query_id, ronda, pos, link, title, snippet). The first round keeps up to six raw
    items; the second takes ten less the kept first-round items, also counted before validation, and
    none whose address is kept already. The budgets apply to raw places, so each topic has a bounded
    handful of rows from here on, and invalid rows are gone before the shuffle.
    """
    per_topic = Window.partitionBy("query_id")
    same_link = Window.partitionBy("query_id", "link").orderBy("ronda", "pos")
    first, second = F.col("ronda") == 1, F.col("ronda") == 2
    in_reach = (first & (F.col("pos") < fv.WEB_FIRST_ROUND_ITEMS)) | (
        second & (F.col("pos") < fv.WEB_TOTAL_ITEMS)
    )
    valid = tx.is_valid_resource(F.col("link"), F.col("title"), F.col("snippet"))
    left_over = fv.WEB_TOTAL_ITEMS - F.sum(F.when(first, 1).otherwise(0)).over(per_topic)
    nothing = F.col("ronda").isNull()
    return (
        topics.join(items.where(in_reach & valid), "query_id", "left")
        .withColumn("cupo", left_over)
        .where(nothing | first | (F.col("pos") < F.col("cupo")))
        .withColumn("vez", F.row_number().over(same_link))
        .where(nothing | first | (F.col("vez") == 1))
        .drop("cupo", "vez")
    )


def web_lists(topics: DataFrame, items: DataFrame) -> DataFrame:
    """Topics with `web`: the ten best items, priority round first, then relevance, then confidence."""
    priority = F.col("ronda") == 1
    order = Window.partitionBy("query_id").orderBy(
        F.col("prioritario").desc(), F.col("relevancia").desc(), F.col("confianza").desc(),
        "ronda", "pos",
    )
    entry = F.struct("puesto", "link", "title", "snippet", "prioritario", "relevancia", "confianza")
    return (
        web_kept(topics, items)
        .withColumn("prioritario", priority)
        .withColumn("relevancia", tx.relevance(F.col("title"), F.col("snippet"), F.col("tema")))
        .withColumn("confianza", tx.domain_confidence(F.col("link"), priority))
        .withColumn("puesto", F.row_number().over(order))
        .where(F.col("puesto") <= fv.WEB_TOTAL_ITEMS)
        .groupBy(*topics.columns)
        .agg(F.array_sort(F.collect_list(F.when(F.col("ronda").isNotNull(), entry))).alias("web"))
    )


# --- known platforms and fallback -----------------------------------------------------------------------


def known_lists(topics: DataFrame, templates: DataFrame) -> DataFrame:
    """Topics with `conocidas`: the platforms of the topic's language (English where unknown)."""
    languages = sorted({t[0] for t in fv.KNOWN_TEMPLATES})
    key = F.when(F.col("idioma").isin(languages), F.col("idioma")).otherwise(
        fv.DEFAULT_TEMPLATE_LANGUAGE
    )
    per_language = (
        templates.where(F.col("pos") < fv.KNOWN_LIMIT)
        .groupBy(F.col("idioma").alias("clave_idioma"))
        .agg(F.array_sort(F.collect_list(F.struct("pos", "nombre", "plantilla"))).alias("conocidas"))
    )
    # One row per template language: three, whatever the data.
    return (
        topics.withColumn("clave_idioma", key)
        .join(F.broadcast(per_language), "clave_idioma", "left")
        .drop("clave_idioma")
    )


def fallback_lists(topics: DataFrame, pages: DataFrame) -> DataFrame:
    """Topics with `respaldo`: valid links of their landed fallback page, `pages` being (query_id, html).

    Validation sees the fixed title and description, so the address alone decides. Links are cut out
    before the join: the shuffle carries at most five addresses per topic, not pages.
    """
    links = F.filter(
        first_links(F.col("html")),
        lambda u: tx.is_valid_resource(u, F.lit(fv.FALLBACK_TITLE), F.lit(fv.FALLBACK_DESCRIPTION)),
    )
    return topics.join(pages.select("query_id", links.alias("respaldo")), "query_id", "left")


# --- lists to result rows ---------------------------------------------------------------------------------


def _metadata(source: str, relevance: Column | None = None, priority: Column | None = None,
              stored: Column | None = None) -> Column:
    def value(c, kind):
        return (F.lit(None) if c is None else c).cast(kind)

    return F.struct(
        F.lit(source).alias("fuente"),
        value(relevance, "double").alias("relevancia"),
        value(priority, "boolean").alias("prioritario"),
        value(stored, "double").alias("confianza_db"),
    ).cast(schemas.METADATOS)


def _hidden_record(p: Column, now: Column) -> dict[str, Column]:
    tema, nivel = F.col("tema"), F.col("nivel")
    return {
        "titulo": F.concat(F.lit(fv.HIDDEN_MARK), p["nombre"], F.lit(fv.TITLE_DASH), tema),
        "url": tx.fill_template(p["url_base"], tema),
        "descripcion": tx.if_empty(p["descripcion"], fv.NO_DESCRIPTION),
        "plataforma": p["nombre"],
        "nivel": F.when(tx.any_level(nivel), p["nivel"]).otherwise(nivel),
        "certificacion": certificate(
            p["nombre"], tema, p["tipo_certificacion"], p["validez_internacional"],
            p["paises_validos"], p["reputacion_academica"], now,
        ),
        "confianza": zero_as(p["confianza"], fv.HIDDEN_DEFAULT_CONFIDENCE),
        "tipo": F.lit("oculta"),
        "metadatos": _metadata(fv.SOURCE_HIDDEN, stored=p["confianza"]),
    }


def _web_record(w: Column) -> dict[str, Column]:
    title, snippet = tx.or_empty(w["title"]), tx.or_empty(w["snippet"])
    named = F.concat(F.lit(fv.WEB_TITLE_PREFIX), tx.resource_id(w["link"]))
    return {
        "titulo": tx.if_empty(title, named),
        "url": w["link"],
        "descripcion": tx.if_empty(snippet, fv.NO_DESCRIPTION),
        "plataforma": tx.platform(w["link"]),
        "nivel": tx.level(F.concat(title, F.lit(" "), snippet), F.col("nivel")),
        "certificacion": F.lit(None).cast(schemas.CERTIFICACION),
        "confianza": w["confianza"],
        "tipo": F.lit("verificada"),
        "metadatos": _metadata(fv.SOURCE_WEB, w["relevancia"], w["prioritario"]),
    }


def _known_record(t: Column) -> dict[str, Column]:
    tema = F.col("tema")
    return {
        "titulo": F.concat(F.lit(fv.KNOWN_MARK), t["nombre"], F.lit(fv.TITLE_DASH), tema),
        "url": tx.fill_template(t["plantilla"], tema),
        "descripcion": F.concat(F.lit(fv.KNOWN_DESCRIPTION_PREFIX), t["nombre"]),
        "plataforma": t["nombre"],
        "nivel": tx.level_or_intermediate(F.col("nivel")),
        "certificacion": F.lit(None).cast(schemas.CERTIFICACION),
        "confianza": F.lit(fv.KNOWN_CONFIDENCE),
        "tipo": F.lit("conocida"),
        "metadatos": _metadata(fv.SOURCE_KNOWN),
    }


def _fallback_record(link: Column) -> dict[str, Column]:
    return {
        "titulo": F.concat(F.lit(fv.FALLBACK_MARK + fv.FALLBACK_TITLE + fv.TITLE_DASH), F.col("tema")),
        "url": link,
        "descripcion": F.lit(fv.FALLBACK_DESCRIPTION),
        "plataforma": tx.platform(link),
        "nivel": tx.level_or_intermediate(F.col("nivel")),
        "certificacion": F.lit(None).cast(schemas.CERTIFICACION),
        "confianza": F.lit(fv.FALLBACK_CONFIDENCE),
        "tipo": F.lit("verificada"),
        "metadatos": _metadata(fv.SOURCE_FALLBACK),
    }


def expand(lists: DataFrame, now: Column) -> DataFrame:
    """Result rows of every list column present, in source order.

    Fallback entries count only for topics whose other lists are all empty.
    """
    present = [s for s in LIST_COLUMNS if LIST_COLUMNS[s] in lists.columns]
    others = [F.size(F.coalesce(LIST_COLUMNS[s], F.array())) for s in present if s != FALLBACK]
    empty_so_far = sum(others[1:], others[0]) == 0 if others else F.lit(True)

    def entries(source: int) -> Column:
        name = LIST_COLUMNS[source]
        listed = F.when(empty_so_far, F.col(name)) if source == FALLBACK else F.col(name)

        def tagged(e: Column, i: Column) -> Column:
            return F.struct(
                F.lit(source).alias("fuente_orden"),
                i.alias("pos"),
                *[(e if s == source else F.lit(None)).cast(lists.schema[LIST_COLUMNS[s]].dataType.elementType)
                  .alias(LIST_COLUMNS[s]) for s in present],
            )

        tagged_list = F.transform(listed, tagged)
        return F.coalesce(tagged_list, F.slice(tagged_list, 1, 0), F.array())

    rows = lists.select(
        "query_id", "tema", "idioma", "nivel",
        F.inline(F.concat(*[entries(s) for s in present])),
    )
    records = {
        HIDDEN: lambda c: _hidden_record(c, now),
        WEB: _web_record,
        KNOWN: _known_record,
        FALLBACK: _fallback_record,
    }
    by_source = {s: records[s](F.col(LIST_COLUMNS[s])) for s in present}

    def value(field: str) -> Column:
        expr = by_source[present[-1]][field]
        for s in reversed(present[:-1]):
            expr = F.when(F.col("fuente_orden") == s, by_source[s][field]).otherwise(expr)
        return expr.alias(field)

    return rows.select(
        "query_id", "fuente_orden", "pos", "idioma",
        tx.category(F.col("tema")).alias("categoria"),
        *[value(f) for f in by_source[present[0]]],
    ).select(
        "query_id", "fuente_orden", "pos",
        tx.resource_id(F.col("url")).alias("id"),
        "titulo", "url", "descripcion", "plataforma", "idioma", "nivel", "categoria", "certificacion",
        "confianza", "tipo",
        now.alias("ultima_verificacion"),
        F.lit(True).alias("activo"),
        "metadatos",
        F.lit(None).cast(schemas.METADATOS_ANALISIS).alias("metadatos_analisis"),
        F.lit(False).alias("analisis_pendiente"),
    )
