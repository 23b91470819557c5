"""The whole search for a table of requests: sources, de-duplication, ranking."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from coursequarry import fixed_values as fv
from coursequarry.operators import candidates as cand
from coursequarry.operators.enrich import enrich_and_rerank
from coursequarry.operators.ranking import dedupe_first, rank
from coursequarry.sources.catalogue import known_templates


@dataclass(frozen=True)
class SearchOptions:
    """Source switches and result limits of one search job."""

    enable_google_api: bool = True
    enable_known_platforms: bool = True
    enable_hidden_platforms: bool = True
    enable_ddg_fallback: bool = False
    enable_groq_analysis: bool = True
    max_results: int = fv.DEFAULT_MAX_RESULTS
    max_analysis: int = fv.DEFAULT_MAX_ANALYSIS


def search_candidates(topics: DataFrame, now: Column, *, catalogue: DataFrame | None = None,
                      items: DataFrame | None = None, fallback_pages: DataFrame | None = None,
                      options: SearchOptions = SearchOptions()) -> DataFrame:
    """All candidates of the enabled sources, in the layout of `schemas.RESULTS`.

    Topics and landed items meet once on query_id; the small platform lists are looked up on the
    topic rows that come out of that join, so nothing is shuffled for them. A topic has at most six
    hidden, ten web, six known and five fallback entries, so no topic can make a group large.
    """
    lists = topics
    if options.enable_google_api and items is not None:
        lists = cand.web_lists(lists, items)
    else:
        lists = lists.repartition("query_id")
    if options.enable_hidden_platforms and catalogue is not None:
        lists = cand.hidden_lists(lists, catalogue)
    if options.enable_known_platforms:
        lists = cand.known_lists(lists, known_templates(topics.sparkSession))
    elif options.enable_ddg_fallback and fallback_pages is not None:
        # The known platforms answer every topic, so with them on the fallback is never needed.
        lists = cand.fallback_lists(lists, fallback_pages)
    return cand.expand(lists, now)


def multilayer_search(topics: DataFrame, now: Column, *, catalogue: DataFrame | None = None,
                      items: DataFrame | None = None, fallback_pages: DataFrame | None = None,
                      options: SearchOptions = SearchOptions()) -> DataFrame:
    """Ranked results for all topics: `schemas.RESULTS` plus the place `puesto`."""
    found = search_candidates(topics, now, catalogue=catalogue, items=items,
                              fallback_pages=fallback_pages, options=options)
    return rank(
        dedupe_first(found), options.max_results,
        options.max_analysis if options.enable_groq_analysis else 0,
    )


def scored_search(topics: DataFrame, now: Column, replies: DataFrame, *, catalogue: DataFrame | None = None,
                  items: DataFrame | None = None, fallback_pages: DataFrame | None = None,
                  options: SearchOptions = SearchOptions()) -> DataFrame:
    """`multilayer_search` with the model replies (query_id, id, respuesta) to its waiting rows, ranked again."""
    results = multilayer_search(topics, now, catalogue=catalogue, items=items, fallback_pages=fallback_pages,
                                options=options)
    return enrich_and_rerank(results, replies, options.enable_groq_analysis)
