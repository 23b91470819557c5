"""The registered queries of the operators for training data."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from coursequarry.llm import (alignment, bpe, exact_dedup as copies, fingerprints, jaccard_join, merkle, mixing, pii, quality,
                              sharding, substrings, token_files, url_filter)
from coursequarry.sources.scratch import cut_lineage, scratch_path

# The rules of the url filter.
URL_RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
]


def vocabulary() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, good) of the pages that show a labelled document; its number is the first one in the url's path."""
    _, path = url_filter.url_parts(pages["url"])
    shown = pages.select("page_id", F.regexp_extract(
        path, r"/([0-9]{1,18})(?:[^0-9]|$)", 1).try_cast("long").alias("doc_id"))
    return shown.join(labels.select("doc_id", F.col("quality").alias("good")), "doc_id").select("page_id", "good").filter(
        "good is not null")


def op1_token_files(spark, sf_dir):
    folder = scratch_path(spark, "token-files")
    token_files.write_token_files(_table(spark, sf_dir, "documents"), vocabulary(), folder)
    return token_files.read_token_files(spark, folder, digest_only=True)


def op2_substring_dedup(spark, sf_dir):
    return substrings.remove_repeats(_table(spark, sf_dir, "documents"))


def op3_quality(spark, sf_dir):
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_jaccard_join(spark, sf_dir):
    return jaccard_join.similar_documents(_table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark, sf_dir):
    return copies.exact_dedup(_table(spark, sf_dir, "documents"))


def op6_bpe(spark, sf_dir):
    return bpe.round_trip_digests(_table(spark, sf_dir, "documents"), vocabulary())


def op7_minhash(spark, sf_dir):
    return fingerprints.edited_fingerprints(_table(spark, sf_dir, "documents"))


def op8_mixing(spark, sf_dir):
    return mixing.mixed_sizes(_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "shard_words")


def op9_url_filter(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages")
    return url_filter.judge_urls(pages, page_outcomes(pages, _table(spark, sf_dir, "labels")), URL_RULES).drop("good_rate")


def op10_sharding(spark, sf_dir):
    return sharding.shard_rows(_table(spark, sf_dir, "documents")).select(
        "doc_id", F.col("text_bytes").alias("_b"), "text_crc32", "shard", "slot").select(
        "doc_id", (F.col("_b") + 8).alias("size"), "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def alignment_digests(docs, name="alignment"):
    """The contract's columns from the operator's groups and links, over all rows of `docs`."""
    found = alignment.aligned(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    rows = cut_lineage(found.select(
        F.monotonically_increasing_id().alias("_al_row"), "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_shared",
        F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2("groups", 256)).alias("groups_sha256"),
        "pair_keys", "pair_counts"), name)
    return alignment.scored_links(rows, name).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_shared")


def op11_alignment(spark, sf_dir):
    return alignment_digests(_table(spark, sf_dir, "documents"))


def pii_digests(docs):
    """The contract's columns from the spans the operator finds."""
    s = F.col("spans")
    return pii.find_spans(docs).select(
        "doc_id", *[pii.counted(s, kind).alias(f"n_{kind}") for kind in pii.BASE],
        F.sha2(pii.joined(s, base_only=True), 256).alias("base_sha256"), pii.joined(s).alias("spans"))


def op12_pii(spark, sf_dir):
    return pii_digests(_table(spark, sf_dir, "documents"))


def op13_merkle(spark, sf_dir):
    return merkle.manifest(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_token_files, op2_substring_dedup, op3_quality, op4_jaccard_join, op5_exact_dedup, op6_bpe, op7_minhash, op8_mixing,
    op9_url_filter, op10_sharding, op11_alignment, op12_pii, op13_merkle)}

# SQL that DuckDB runs over the same tables. The other operators have no SQL form.
ORACLE_SQL = {
    "op5_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
    """,
    "op2_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        windows AS (
            SELECT doc_id, k, md5(array_to_string(words[k:k + 49], ' ')) AS h
            FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS k FROM w)),
        first AS (SELECT h, min(doc_id) AS least FROM windows GROUP BY h HAVING min(doc_id) < max(doc_id)),
        gone AS (
            SELECT DISTINCT doc_id, unnest(range(k, k + 50)) AS k
            FROM windows JOIN first USING (h) WHERE doc_id > least),
        each_word AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS k FROM w),
        kept AS (
            SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.k) AS text, count(*) AS n
            FROM each_word e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.k = g.k GROUP BY e.doc_id)
        SELECT w.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed,
               sha256(coalesce(kept.text, '')) AS kept_sha256
        FROM w LEFT JOIN kept USING (doc_id)
    """,
    "op4_jaccard_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
        s AS MATERIALIZED (
            SELECT DISTINCT doc_id, hash(array_to_string(words[k:k + 4], ' ')) AS h
            FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS k FROM w WHERE len(words) > 0)),
        n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        links AS MATERIALIZED (
            SELECT a, b FROM (
                SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.h = y.h AND x.doc_id <> y.doc_id GROUP BY ALL)
            JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
        reach(doc_id, other) AS (
            SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
        SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(other) AS component_id
        FROM w JOIN reach USING (doc_id) LEFT JOIN n ON n.doc_id = w.doc_id GROUP BY w.doc_id, n.n
    """,
    "op9_url_filter": r"""
        WITH u AS (
            SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest
            FROM (SELECT page_id, coalesce(url, '') AS url FROM pages)),
        v AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
        p AS (
            SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(substr(rest, len(raw) + 1), '^[^?#]*') AS path FROM v),
        good AS (
            SELECT page_id, avg(quality) AS good
            FROM (SELECT page_id, try_cast(regexp_extract(path, '/([0-9]{1,18})([^0-9]|$)', 1) AS BIGINT) AS doc_id FROM p)
            JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY page_id),
        hosts AS (
            SELECT host, string_split(host, '.') AS parts, coalesce(sum(good), 0)::DOUBLE AS good, count(good) AS n
            FROM p LEFT JOIN good USING (page_id) GROUP BY host),
        suffixed AS (
            SELECT *, CASE WHEN array_to_string(parts[-2:], '.') IN ({two}) THEN array_to_string(parts[-2:], '.')
                           ELSE parts[-1] END AS suffix FROM hosts),
        named AS (
            SELECT *, CASE WHEN len(parts) < len(string_split(suffix, '.')) + 1 THEN host
                           ELSE array_to_string(parts[-(len(string_split(suffix, '.')) + 1):], '.') END AS domain FROM suffixed),
        mean AS (SELECT CASE WHEN sum(n) > 0 THEN (sum(good) + 1) / (sum(n) + 2) ELSE 1.0 END AS m FROM named),
        {levels}
        judged AS (SELECT host, rate + {width} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) < {floor} AS blocked FROM host_rate),
        ruled AS (
            SELECT page_id, host, path, CASE
                {rules}
                END AS hit FROM p)
        SELECT r.page_id, r.host, r.path, substr(hit, 7) AS rule,
               CASE WHEN hit IS NOT NULL THEN trim(left(hit, 6)) WHEN blocked THEN 'block' ELSE 'allow' END AS verdict
        FROM ruled r JOIN judged USING (host)
    """,
}

_LEVEL_SQL = """
        {level}_sum AS (
            SELECT {names}, sum(good) AS good, sum(n) AS n, any_value({prior}) AS prior FROM named {source} GROUP BY {names}),
        {level}_k AS (
            SELECT CASE WHEN count(*) = 0 OR sum(n) <= count(*) THEN 1 / {low}::DOUBLE - 1 ELSE 1 / least(greatest(
                (sum(n * (good / n - prior) * (good / n - prior) / (prior * (1 - prior))) - count(*)) / (sum(n) - count(*)),
                {low}), {high}) - 1 END AS k FROM {level}_sum WHERE n > 1 AND prior > 0 AND prior < 1),
        {level}_rate AS (
            SELECT *, a / (a + b) AS rate FROM (
                SELECT {names}, good + k * prior AS a, n - good + k * (1 - prior) AS b FROM {level}_sum, {level}_k)),
"""


def _url_sql(text: str) -> str:
    levels, names, prior, source = "", [], "m", ", mean"
    for level in url_filter.LEVELS:
        names.append(level)
        levels += _LEVEL_SQL.format(level=level, names=", ".join(names), prior=prior, source=source,
                                    low=url_filter.CORRELATION[0], high=url_filter.CORRELATION[1])
        prior, source = "rate", f"JOIN {level}_rate USING ({', '.join(names)})"
    rules = "\n".join(
        f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND path LIKE '{p}%' THEN '{v:6}{h}{p}'"
        for v, h, p in sorted(URL_RULES, key=lambda r: -len(r[1] + r[2])))
    two = ", ".join(f"'{s}'" for s in url_filter.TWO_PART_SUFFIXES)
    for name, value in (("two", two), ("levels", levels.strip()), ("rules", rules), ("width", str(url_filter.RANGE)),
                        ("floor", str(url_filter.FLOOR))):
        text = text.replace("{" + name + "}", value)
    return text


ORACLE_SQL["op9_url_filter"] = _url_sql(ORACLE_SQL["op9_url_filter"])
