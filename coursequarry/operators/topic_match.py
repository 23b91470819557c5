"""Topics against a table of resources by keyword containment, without comparing every pair.

A keyword holds no white space, so where it occurs in a text it lies inside one white-space separated
token of that text. The match is therefore worked out once per distinct token, not once per text:

1. the distinct tokens of all texts and the distinct keywords of all topics meet on the longest listed
   beginning of the keyword (`PIECES`: up to twelve letters; equi-join), and containment is checked on those few pairs;
2. the surviving (token, keyword) pairs are written down and lead back to the resources over the token
   (equi-join; adaptive execution knows the written table's size and broadcasts it where it is small);
3. keywords that very many resources hold are scored once for all topics that have the same ones; only resources with
   one of a topic's rarer keywords are scored for that topic (`best_matches`);
4. or, exactly and without a notion of common keywords, over packed shards of pages (`block_max_best`): the scores of
   a whole shard are added up in numpy per topic, and only pages of blocks whose best score reaches the `limit`-th
   found so far are looked at.
"""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from coursequarry import fixed_values as fv
from coursequarry.functions import text as tx
from coursequarry.operators import block_scores
from coursequarry.sources.scratch import cut_lineage

# The workers get this module's code with the job: they need numpy and pyarrow, not the package on their path.
cloudpickle.register_pickle_by_value(block_scores)

# A keyword is looked up by its first 1, 2, 3, 5, 8 or 12 letters, the most it has. Words are made of few syllables, so
# that beginnings of three letters alone are shared by hundreds of keywords.
PIECES = [1, 2, 3, 5, 8, 12]
BROADCAST_KEYWORDS = 300_000
_BLOCK = 256
COMMON = 150
BLOCK_PAGES = 4
SHARD_POSTINGS = 2_000_000
GROUP_TOPICS = 65_536
STRIPES = 4


def topic_keywords(topics: DataFrame) -> DataFrame:
    """(tema, palabra, veces) over distinct topics: hot topics are matched once, repeats count."""
    all_words = tx.words(F.col("tema"))
    return (
        topics.select("tema").distinct()
        .select("tema", F.explode(all_words).alias("palabra"))
        .groupBy("tema", "palabra").agg(F.count("*").alias("veces"))
    )


def _tokens(text: Column) -> Column:
    return F.array_distinct(tx.words(tx.or_empty(text)))


def resource_tokens(resources: DataFrame) -> DataFrame:
    """(page_id, confianza, ficha, en_titulo): the distinct tokens of title and description."""
    def side(name: str, in_title: bool) -> Column:
        return F.transform(
            _tokens(F.col(name)),
            lambda w: F.struct(w.alias("ficha"), F.lit(in_title).alias("en_titulo")),
        )

    return resources.select(
        "page_id", "confianza", F.inline(F.concat(side("titulo", True), side("descripcion", False)))
    )


def _blocks(token: Column) -> Column:
    """The token in overlapping blocks that hold all its pieces, so that a very long one is never one array of pieces."""
    return F.transform(F.sequence(F.lit(1), F.length(token), F.lit(_BLOCK)),
                       lambda i: F.substring(token, i, F.lit(_BLOCK + PIECES[-1] - 1)))


def _pieces(token: Column) -> Column:
    """All pieces of the listed lengths."""
    def of(size: int) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.length(token) - (size - 1), F.lit(1)))
        # a token shorter than `size` gives itself, which is one of its shorter pieces or looks up nothing
        return F.transform(places, lambda i: F.substring(token, i, F.lit(size)))

    return F.array_distinct(F.concat(*[of(size) for size in PIECES]))


def _beginning(keyword: Column) -> Column:
    size = F.lit(PIECES[0])
    for more in PIECES[1:]:
        size = F.when(F.length(keyword) >= more, more).otherwise(size)
    return F.substring(keyword, F.lit(1), size)


def looked_up(keywords: DataFrame) -> DataFrame:
    """(palabra, trozo): every distinct keyword and the beginning it is looked up by; broadcast where they are few."""
    wanted = cut_lineage(keywords.select("palabra").distinct().withColumn("trozo", _beginning(F.col("palabra"))), "claves")
    return F.broadcast(wanted) if wanted.count() <= BROADCAST_KEYWORDS else wanted


def may_contain(known: DataFrame, keywords: DataFrame) -> DataFrame:
    """(clave, palabra): the tokens (ficha, clave) with every keyword whose looked-up beginning they contain.

    `keywords` may be as of `looked_up`.
    """
    wanted = keywords if "trozo" in keywords.columns else looked_up(keywords)
    pieces = (
        known.select("clave", F.explode(_blocks(F.col("ficha"))).alias("bloque"))
        .select("clave", F.explode(_pieces(F.col("bloque"))).alias("trozo"))
    )
    return pieces.join(wanted, "trozo").select("clave", "palabra").distinct()


def token_keywords(tokens: DataFrame, keywords: DataFrame) -> DataFrame:
    """(ficha, palabra): every distinct token with every keyword it contains.

    A token of one block travels with its pieces, which are distinct, so that it meets a keyword once and is compared on
    the spot. A longer one would be copied once for each of its pieces; it is met again by its key instead.
    """
    wanted = looked_up(keywords)
    known = tokens.select("ficha").distinct()
    holds = F.col("ficha").contains(F.col("palabra"))
    short = known.where(F.length("ficha") <= _BLOCK)
    long = known.where(F.length("ficha") > _BLOCK).withColumn("clave", F.xxhash64("ficha"))
    at_once = short.select("ficha", F.explode(_pieces(F.col("ficha"))).alias("trozo")).join(wanted, "trozo")
    by_key = may_contain(long, wanted).join(long, "clave")
    return at_once.where(holds).select("ficha", "palabra").unionByName(by_key.where(holds).select("ficha", "palabra"))


def keyword_matches(keywords: DataFrame, resources: DataFrame) -> DataFrame:
    """(page_id, palabra, peso, confianza) for every keyword and the resources that hold it."""
    tokens = cut_lineage(resource_tokens(resources), "fichas")
    pairs = cut_lineage(token_keywords(tokens, keywords), "parejas")
    in_title = F.max(F.col("en_titulo").cast("int"))
    in_text = F.max((~F.col("en_titulo")).cast("int"))
    return (
        tokens.join(pairs, "ficha")
        .groupBy("page_id", "palabra")
        .agg((in_title * F.lit(1.0) + in_text * F.lit(0.5)).alias("peso"),
             F.max("confianza").alias("confianza"))
    )


def _summed(matches: DataFrame, *by: str) -> DataFrame:
    return matches.groupBy(*by).agg(
        F.sum(F.col("peso") * F.col("veces")).alias("relevancia"), F.max("confianza").alias("confianza"))


def topic_matches(topics: DataFrame, resources: DataFrame) -> DataFrame:
    """(tema, page_id, confianza, relevancia) for every topic and resource with relevance above zero.

    As many rows as there are such pairs; for the best ones alone see `best_matches`.
    """
    keywords = topic_keywords(topics)
    return _summed(keyword_matches(keywords, resources).join(keywords, "palabra"), "tema", "page_id")


def _best(scored: DataFrame, by: str, limit: int) -> DataFrame:
    order = Window.partitionBy(by).orderBy(F.col("relevancia").desc(), F.col("confianza").desc(), "page_id")
    return scored.withColumn("puesto", F.row_number().over(order)).where(F.col("puesto") <= limit)


def best_matches(topics: DataFrame, resources: DataFrame, limit: int = fv.WEB_TOTAL_ITEMS,
                 common: int = COMMON) -> DataFrame:
    """(tema, page_id, relevancia, confianza, puesto): the best `limit` resources of every topic, exactly.

    Keywords of more than `common` resources are scored once for every different list of them that some topic has, and
    only the best resources by that list are kept. The resources that hold one of a topic's other keywords are
    scored in full. A resource that is in neither lot is beaten by `limit` others that score at least as much by the
    common keywords alone.
    """
    keywords = topic_keywords(topics)
    found = cut_lineage(keyword_matches(keywords, resources), "palabras")
    spread = found.groupBy("palabra").agg((F.count("*") > common).alias("comun"))
    listed = cut_lineage(keywords.join(spread, "palabra"), "temas")
    shared = listed.where("comun").groupBy("tema").agg(
        F.array_sort(F.collect_list(F.struct("palabra", "veces"))).alias("lista"))
    by_list = (
        shared.select("lista").distinct()
        .select("lista", F.inline("lista")).join(found, "palabra")
    )
    by_common = shared.join(_best(_summed(by_list, "lista", "page_id"), "lista", limit).drop("puesto"), "lista").drop("lista")
    in_reach = listed.where("not comun").join(found, "palabra").select("tema", "page_id").distinct()
    in_full = _summed(in_reach.join(listed, "tema").join(found, ["page_id", "palabra"]), "tema", "page_id")
    either = by_common.unionByName(in_full).groupBy("tema", "page_id").agg(
        F.max("relevancia").alias("relevancia"), F.max("confianza").alias("confianza"))
    return _best(either, "tema", limit)


def block_max_best(topics: DataFrame, resources: DataFrame, limit: int = fv.WEB_TOTAL_ITEMS,
                   block: int = BLOCK_PAGES) -> DataFrame:
    """(tema, page_id, relevancia, confianza, puesto): the best `limit` resources of every topic, exactly.

    Pages are dealt by hash to shards of about `SHARD_POSTINGS` (keyword, page) pairs, topics to groups of about
    `GROUP_TOPICS`. A shard is packed once, one row per keyword, and a group gets the rows of its own keywords; so no
    row is made per pair of topic and page, nor per topic and block. A task scores a group over every `STRIPES`-th
    shard, one shard in memory at a time: the scores of all pages of a shard are added up in an array, the best score
    of every block of `block` pages is taken from it, and the `limit`-th of these (or of an earlier shard's best) is a
    floor that no page of the answer is below. Only pages that reach it are looked at, and shards whose
    largest weights do not add up to it are skipped. A task gives `limit` rows per topic, so that the last
    window meets `STRIPES` times as many at most. A page's confidence is the highest among its rows.
    """
    keywords = topic_keywords(topics)
    lists = cut_lineage(keywords.groupBy("tema").agg(F.collect_list(F.struct("palabra", "veces")).alias("lista")), "temas")
    found = cut_lineage(keyword_matches(lists.select(F.inline("lista")), resources), "palabras")
    shards = max(1, -(-found.count() // SHARD_POSTINGS))
    stripes = min(shards, STRIPES)
    groups = max(1, -(-lists.count() // GROUP_TOPICS))
    packed = cut_lineage(
        found.where("page_id is not null")
        .withColumn("shard", F.pmod(F.xxhash64("page_id"), F.lit(shards)).cast("int"))
        .repartitionById(shards, "shard").mapInArrow(block_scores.pack, block_scores.PACKED), "indice")
    grouped = lists.withColumn("grupo", F.pmod(F.xxhash64("tema"), F.lit(groups)).cast("int"))
    wanted = grouped.select("grupo", F.explode("lista.palabra").alias("palabra")).distinct()
    all_groups = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grupo")
    part = (F.col("grupo") * stripes + F.col("shard") % stripes).alias("parte")
    postings = packed.where("palabra is not null").join(wanted, "palabra").unionByName(
        packed.where("palabra is null").select("*", all_groups)).select(part, "shard", "palabra", "lugares", "pesos")
    asked = grouped.select(
        F.explode(F.sequence(F.col("grupo") * stripes, F.col("grupo") * stripes + (stripes - 1))).alias("parte"),
        F.lit(block_scores.TOPICS).alias("shard"), "tema", "lista")
    scored = (
        asked.unionByName(postings, allowMissingColumns=True)
        .repartitionById(groups * stripes, "parte").sortWithinPartitions("parte", "shard", F.col("palabra").isNotNull())
        .drop("parte").mapInArrow(block_scores.scorer(limit, block), block_scores.SCORED)
    )
    return _best(scored, "tema", limit)


def topic_search(topics: DataFrame, resources: DataFrame,
                 limit: int = fv.WEB_TOTAL_ITEMS) -> DataFrame:
    """The best valid resources per topic by relevance, then confidence, then page_id.

    `resources` is (page_id, url, titulo, descripcion). Intermediate tables are written: requests and valid pages (so that
    deriving them is done once), tokens, token pairs, topics, keyword matches, their packed shards and winners. Texts are
    read once more, only for pages that won somewhere, and are reduced to their level before they meet winners and requests.
    """
    topics = cut_lineage(topics.select("query_id", "tema", "nivel"), "peticiones")
    valid = cut_lineage(resources.select("page_id", "url", "titulo", "descripcion").where(
        tx.is_valid_resource(F.col("url"), F.col("titulo"), F.col("descripcion"))
    ).withColumn("confianza", tx.domain_confidence(F.col("url"), F.lit(False))), "paginas")
    winners = cut_lineage(block_max_best(topics, valid, limit).drop("confianza"), "ganadores")
    pages = valid.join(winners.select("page_id").distinct(), "page_id", "left_semi").select(
        "page_id", "url", "titulo",
        tx.platform(F.col("url")).alias("plataforma"),
        tx.level(F.concat("titulo", F.lit(" "), "descripcion"), F.lit(fv.ANY_LEVEL)).alias("nivel_texto"),
        "confianza",
    )
    described = winners.join(pages, "page_id").withColumn("categoria", tx.category(F.col("tema")))
    requested = F.when(tx.any_level(F.col("nivel")), F.col("nivel_texto")).otherwise(F.col("nivel"))
    return topics.join(described, "tema").select(
        "query_id", "tema", "puesto", "page_id", "url", "titulo", "plataforma",
        requested.alias("nivel"), "categoria", "confianza", "relevancia",
    )
