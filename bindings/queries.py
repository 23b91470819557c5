"""The registered queries: library operators over the tables of `bindings.tables`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from bindings import tables as b
from coursequarry import fixed_values as fv
from coursequarry.functions import labels as lb
from coursequarry.functions import text as tx
from coursequarry.operators import activity, cache, candidates as cand, enrich as en
from coursequarry.operators.ranking import dedupe_first
from coursequarry.operators.topic_match import topic_search as match_topics
from coursequarry.plans import digest, report
from coursequarry.plans.search import SearchOptions, multilayer_search as search, scored_search, search_candidates
from coursequarry.sources import activity_log, catalogue as cat, csv_files, landed, requests as rq
from coursequarry.sources.scratch import scratch_path

_META = ["fuente", "relevancia", "prioritario", "confianza_db"]


def _topics(spark, d):
    return rq.prepare_topics(b.requests(spark, d))


def _shown(df: DataFrame, place: str = "pos", *extra: str) -> DataFrame:
    return df.select(
        "query_id", place, "id", "titulo", "url", "descripcion", "plataforma", "idioma", "nivel",
        "categoria", "confianza", "tipo", *[F.col(f"metadatos.{m}").alias(m) for m in _META], *extra,
    )


def _results(spark, d):
    return search(_topics(spark, d), b.now(), catalogue=b.catalogue(spark, d), items=b.web_items(spark, d))


def _scored(spark, d):
    items = b.web_items(spark, d)
    return scored_search(_topics(spark, d), b.now(), b.search_replies(items), catalogue=b.catalogue(spark, d),
                         items=items)


def platforms_active(spark, d):
    return cat.active_platforms(b.catalogue(spark, d))


def platform_count(spark, d):
    return activity.count_active(b.catalogue(spark, d))


def known_platforms(spark, d):
    lists = cand.known_lists(_topics(spark, d), cat.known_templates(spark))
    return _shown(cand.expand(lists, b.now()))


def hidden_search(spark, d):
    lists = cand.hidden_lists(_topics(spark, d), b.catalogue(spark, d))
    return _shown(cand.expand(lists, b.now()))


def cert_structs(spark, d):
    lists = cand.hidden_lists(_topics(spark, d), b.catalogue(spark, d))
    c = F.col("certificacion")
    compact = F.to_json(F.struct(c["tipo"].alias("tipo"), c["paises_validos"].alias("paises")))
    return cand.expand(lists, b.now()).select(
        "query_id", "pos", "plataforma",
        c["tipo"].alias("cert_tipo"),
        F.array_join(c["paises_validos"], "|").alias("cert_paises"),
        c["costo_certificado"].alias("cert_costo"),
        c["reputacion_academica"].alias("cert_reputacion"),
        c["validez_internacional"].alias("cert_valida"),
        lb.badge_labels(c).alias("insignias"),
        F.when(c.isNotNull(), compact).alias("json"),
    )


def web_candidates(spark, d):
    kept = cand.web_kept(_topics(spark, d), b.web_items(spark, d)).where(F.col("ronda").isNotNull())
    first = F.col("ronda") == 1
    return kept.select(
        "query_id", "ronda", "pos", "link", "title",
        tx.relevance(F.col("title"), F.col("snippet"), F.col("tema")).alias("relevancia"),
        tx.domain_confidence(F.col("link"), first).alias("confianza"),
        first.alias("prioritario"),
    )


def web_ranked(spark, d):
    return _shown(cand.expand(cand.web_lists(_topics(spark, d), b.web_items(spark, d)), b.now()))


def fallback_search(spark, d):
    options = SearchOptions(enable_known_platforms=False, enable_hidden_platforms=False,
                            enable_ddg_fallback=True)
    found = search(_topics(spark, d), b.now(), items=b.web_items(spark, d),
                   fallback_pages=b.fallback_pages(spark, d), options=options)
    return found.select("query_id", "puesto", "id", "titulo", "url", "plataforma", "idioma", "nivel",
                        "confianza", F.col("metadatos.fuente").alias("fuente"), "analisis_pendiente")


def dedupe(spark, d):
    found = search_candidates(_topics(spark, d), b.now(), catalogue=b.catalogue(spark, d),
                              items=b.web_items(spark, d))
    return dedupe_first(found).select("query_id", "fuente_orden", "pos", "id", "url")


def multilayer_search(spark, d):
    return _shown(_results(spark, d), "puesto", "analisis_pendiente")


def ai_pending(spark, d):
    return en.needs_analysis(_results(spark, d)).select("query_id", "puesto", "id", "url")


def search_events(spark, d):
    return activity.search_events(_results(spark, d), _topics(spark, d), b.now())


def search_enriched(spark, d):
    analysis = F.col("metadatos_analisis")
    return _scored(spark, d).select(
        "query_id", "puesto", "id", "url", "confianza", "analisis_pendiente",
        analysis["calidad_ia"].alias("calidad_ia"), analysis["relevancia_ia"].alias("relevancia_ia"))


def report_rows(spark, d):
    return report.report_rows(_results(spark, d))


def csv_roundtrip(spark, d):
    path = scratch_path(spark, "resultados")
    csv_files.export_results(_results(spark, d), path)
    back = csv_files.import_results(spark, path, b.now())
    return back.withColumn("fuente", F.col("metadatos.fuente")).drop("certificacion", "metadatos")


def context_digest(spark, d):
    return digest.context_digest(b.search_log(spark, d), b.favorites(spark, d), b.catalogue(spark, d),
                                 _scored(spark, d))


def topic_search(spark, d):
    return match_topics(_topics(spark, d), b.resources(spark, d))


def request_rows(spark, d):
    topics = _topics(spark, d)
    fallback = rq.fallback_requests(topics).select(
        "query_id", F.lit(3).alias("ronda"), "q", F.lit(fv.FALLBACK_LINKS).alias("num"),
        F.lit(None).cast("string").alias("lr"),
    )
    return rq.web_requests(topics, b.web_items(spark, d)).unionByName(fallback)


def landed_items(spark, d):
    layout = "struct<items:array<struct<link:string,title:string,snippet:string>>>"
    replies = b.landed_replies(spark, d).select(
        "query_id", F.from_json("respuesta", layout)["items"].alias("items")
    )
    return landed.landed_items(replies)


def html_links(spark, d):
    return landed.html_links(b.fallback_pages(spark, d))


def lang_code(spark, d):
    return b.requests(spark, d).select(
        "query_id", "idioma_ui", tx.language_code(F.col("idioma_ui")).alias("idioma")
    )


def url_ids(spark, d):
    ids = tx.resource_id(F.col("url")).alias("id")
    pages = b.read(spark, d, "pages").select(F.lit("page").alias("origen"), F.col("page_id").alias("n"), ids)
    docs = b.ai_input(spark, d).select(F.lit("document").alias("origen"), F.col("query_id").alias("n"), ids)
    return pages.unionByName(docs)


def level_tags(spark, d):
    asked = b.pick(b.LEVELS, F.col("page_id") % 5)
    return b.resources(spark, d).select(
        "page_id", asked.alias("pedido"),
        tx.level(F.concat("titulo", F.lit(" "), "descripcion"), asked).alias("nivel"),
    )


def category_tags(spark, d):
    asked = b.requests(spark, d).select("query_id", "tema", tx.category(F.col("tema")).alias("categoria"))
    docs = b.read(spark, d, "documents").select(
        F.col("doc_id").alias("query_id"), F.substring(F.md5("text"), 1, 10).alias("tema"),
        tx.category(F.col("text")).alias("categoria"),
    )
    return asked.unionByName(docs)


def platform_names(spark, d):
    return b.resources(spark, d).select("page_id", "url", tx.platform(F.col("url")).alias("plataforma"))


def relevance(spark, d):
    topics = _topics(spark, d).select("query_id", "tema")
    return b.web_items(spark, d, topics).select(
        "query_id", "ronda", "pos",
        tx.relevance(F.col("title"), F.col("snippet"), F.col("tema")).alias("relevancia"),
    )


def valid_resources(spark, d):
    return b.resources(spark, d).where(
        tx.is_valid_resource(F.col("url"), F.col("titulo"), F.col("descripcion"))
    ).select("page_id", "url", "titulo")


def resource_validity(spark, d):
    url = F.concat(F.lit("https://"), "source", F.lit(".example.org/"), F.col("doc_id").cast("string"))
    return b.read(spark, d, "documents").select(
        "doc_id", tx.is_valid_resource(url, F.col("lang"), F.col("text")).alias("valida")
    )


def chat_clean(spark, d):
    return report.visible_chat(b.messages(spark, d))


def html_strip(spark, d):
    return b.read(spark, d, "pages").select("page_id", tx.clean_chat(F.col("html")).alias("texto"))


def _flat_analysis(source: str) -> list:
    a = F.col(source)
    return [
        a["calidad_ia"].alias("calidad_ia"), a["relevancia_ia"].alias("relevancia_ia"),
        a["recomendacion_personalizada"].alias("recomendacion"),
        F.array_join(a["razones_calidad"], "|").alias("razones"),
        F.array_join(a["advertencias"], "|").alias("advertencias"),
    ]


def ai_enrich(spark, d):
    scored = en.enrich_and_rerank(b.ai_input(spark, d), b.ai_replies(spark, d))
    return scored.select("query_id", "puesto", "id", "confianza", "analisis_pendiente",
                         *_flat_analysis("metadatos_analisis"))


def result_cards(spark, d):
    return report.result_cards(en.enrich(b.ai_input(spark, d), b.ai_replies(spark, d)))


def ai_parse_loose(spark, d):
    scored = en.score_loose(b.ai_replies(spark, d))
    return scored.select(
        "query_id", "id", "valida", "calidad_ia", "relevancia_ia",
        F.col("recomendacion_personalizada").alias("recomendacion"),
        F.array_join("razones_calidad", "|").alias("razones"),
        F.array_join("advertencias", "|").alias("advertencias"),
    )


def top_topics(spark, d):
    return activity.top_topics(b.search_log(spark, d))


def top_favorites(spark, d):
    return activity.top_favorites(b.favorites(spark, d))


def admin_counts(spark, d):
    return activity.admin_counts(b.search_log(spark, d), b.catalogue(spark, d), b.favorites(spark, d),
                                 b.feedback(spark, d))


def favorites_list(spark, d):
    return activity.list_favorites(b.favorites(spark, d))


def settings_latest(spark, d):
    return activity.settings_latest(b.settings_log(spark, d))


def session_close(spark, d):
    starts = activity_log.session_rows(b.session_starts(spark, d))
    return activity.close_sessions(starts, b.session_ends(spark, d)).select(
        "session_id", "started_at", "device", "ended_at"
    )


def click_attribution(spark, d):
    return activity.click_attribution(b.search_log(spark, d), b.clicks(spark, d)).select(
        "search_id", "tema", "ts", "veces_clickeado"
    )


def cache_hits(spark, d):
    return cache.cache_hits(b.cache_requests(spark, d))


def cache_snapshot(spark, d):
    return cache.cache_snapshot(cache.cache_hits(b.cache_requests(spark, d)), b.now())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "platforms_active": platforms_active,
    "platform_count": platform_count,
    "known_platforms": known_platforms,
    "hidden_search": hidden_search,
    "cert_structs": cert_structs,
    "web_candidates": web_candidates,
    "web_ranked": web_ranked,
    "fallback_search": fallback_search,
    "dedupe_first": dedupe,
    "multilayer_search": multilayer_search,
    "search_enriched": search_enriched,
    "ai_pending": ai_pending,
    "search_events": search_events,
    "report_rows": report_rows,
    "csv_roundtrip": csv_roundtrip,
    "context_digest": context_digest,
    "topic_search": topic_search,
    "request_rows": request_rows,
    "landed_items": landed_items,
    "html_links": html_links,
    "lang_code": lang_code,
    "url_ids": url_ids,
    "level_tags": level_tags,
    "category_tags": category_tags,
    "platform_names": platform_names,
    "relevance": relevance,
    "valid_resources": valid_resources,
    "resource_validity": resource_validity,
    "chat_clean": chat_clean,
    "html_strip": html_strip,
    "ai_enrich": ai_enrich,
    "result_cards": result_cards,
    "ai_parse_loose": ai_parse_loose,
    "top_topics": top_topics,
    "top_favorites": top_favorites,
    "admin_counts": admin_counts,
    "favorites_list": favorites_list,
    "settings_latest": settings_latest,
    "session_close": session_close,
    "click_attribution": click_attribution,
    "cache_hits": cache_hits,
    "cache_snapshot": cache_snapshot,
}
