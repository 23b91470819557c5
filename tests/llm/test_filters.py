"""Quality classifier, mixing, URL filter and sharding."""

import glob
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from coursequarry.llm import mixing as mx, quality as ql, sharding as sh, url_filter as uf
from coursequarry.llm.queries import ORACLE_SQL, QUERIES, URL_RULES, page_outcomes
from tests.compare import connect, differences
from tests.llm import brute
from tests.llm.conftest import by_id, frame

# ---- quality


def labelled(spark, n=400):
    good = "The small river runs past old houses, and people walk there in the evening."
    rows = []
    for i in range(n):
        bad = i % 4 == 0
        tail = " ".join(f"w{(i * 7 + k) % 90}" for k in range(30))
        rows.append((i, f"{'BUY NOW!! ' * 12}{tail.upper()}" if bad else f"{good} {tail}."))
    labels = [(i, int(i % 4 > 0), 0) for i in range(n)] + [(5, None, 0), (None, 1, 0), (7, 1, 0), (7, 1, 1)]
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    got = by_id(ql.quality_scores(docs, labels), "held_out", "score", "predicted")
    assert len(got) == 400
    for i, (held, score, predicted) in got.items():
        assert held == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= score <= 1 and predicted == int(score >= 0.3) == int(i % 4 > 0)
    kept = ql.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 300


def test_labels_of_the_held_out_fold_are_not_used(spark):
    docs, labels = labelled(spark)
    turned = labels.withColumn("quality", F.when(ql.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert by_id(ql.quality_scores(docs, labels), "score") == by_id(ql.quality_scores(docs, turned), "score")


def test_quality_of_edges(spark, edge_docs, edges, no_docs):
    docs, labels = labelled(spark)
    one = ql.fit(docs, labels)
    got = by_id(ql.score(edge_docs.select("doc_id", "text"), one), "score", "predicted")
    assert set(got) == {i for i, _ in edges} and got[-20] == got[-13] == (one.prior, 1)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {s for (s,) in by_id(ql.quality_scores(edge_docs, none), "score").values()} == {0.5}
    assert ql.quality_scores(no_docs, labels).count() == 0
    assert ql.quality_scores(frame(spark, [(None, "a"), (1, "b"), (1, "b")]), labels).count() == 3


def test_quality_sample_is_bounded(spark):
    docs, labels = labelled(spark)
    assert len(ql.fit(docs, labels, sample=50).labels) == 50


def test_quality_query(spark):
    sf_dir = "/root/testdata/sf0.01"  # the smallest table with enough held-out labels
    got = by_id(QUERIES["op3_quality"](spark, sf_dir), "held_out", "predicted")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    held = [(labels[i], p) for i, (h, p) in got.items() if h and i in labels]
    assert sum(a == b for a, b in held) >= 0.9 * len(held)


# ---- mixing


def mix_result(docs, **options):
    return [r.asDict() for r in mx.mixed_sizes(docs, **options).collect()]


@pytest.mark.parametrize("block", [512, 40, None])
def test_mix_over_edges(edge_docs, edges, block):
    rows = mix_result(edge_docs, block_words=block)
    text = dict(edges)
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        assert r["size"] == len(brute.WORD.findall(text[r["doc_id"]] or ""))
        assert r["taken"] <= 3 * r["size"]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    want = brute.targets({r["source"]: sizes[r["source"]] for r in rows})
    for source in target:
        assert target[source] == pytest.approx(want[source], rel=1e-12)
        if block:
            assert abs(taken[source] - target[source]) <= 1
    assert all(r["source_size"] == sizes[r["source"]] for r in rows)
    again = mix_result(edge_docs, block_words=block)
    assert {r["doc_id"]: r["taken"] for r in rows} == {r["doc_id"]: r["taken"] for r in again}


def test_blocks_are_disjoint_and_cover_whole_copies(spark):
    docs = frame(spark, [(i, " ".join(["w"] * (i % 23))) for i in range(200)])
    rows, targets, blocks = mx.mix_plan(docs, block_words=5, shards=6)
    got = blocks.collect()
    assert len({(b["row"], b["first"], b["copy"]) for b in got}) == len(got)
    per_shard = Counter(b["shard"] for b in got)
    assert set(per_shard) == set(range(6)) and max(per_shard.values()) - min(per_shard.values()) <= 2
    ordered = mx.shuffled(blocks, 6).select("shard", "place").collect()
    by_shard = defaultdict(list)
    for r in ordered:
        by_shard[r["shard"]].append(r["place"])
    assert all(p == sorted(p) for p in by_shard.values())


def test_split_tree_quotas():
    counts = [1000, 0, 37, 5000, 1]
    quotas = np.array(mx.split_tree(counts, 7, 3))
    assert quotas.sum(axis=0).tolist() == counts and (quotas >= 0).all()
    assert quotas.sum(axis=1).max() - quotas.sum(axis=1).min() <= 1
    assert (quotas == np.array(mx.split_tree(counts, 7, 3))).all()
    assert abs(quotas[:, 3] / quotas.sum(axis=1) - 5000 / 6038).max() < 0.06
    assert mx.hypergeometric(np.random.default_rng(1), 3 * 10**9, 10**9, 10**9) == pytest.approx(75 * 10**7, rel=1e-3)


def test_mix_of_nothing_and_repeated_rows(spark, no_docs):
    assert mix_result(no_docs) == []
    rows = mix_result(frame(spark, [(1, "a b"), (1, "a b"), (None, "c d e"), (None, None)]))
    assert len(rows) == 4 and all(r["taken"] <= 3 * r["size"] for r in rows)
    empty = mix_result(frame(spark, [(1, ""), (2, None)]))
    assert [(r["target"], r["taken"]) for r in empty] == [(0.0, 0), (0.0, 0)]


def test_mixing_query_deals_words_to_shards(spark, sf_dir):
    rows = QUERIES["op8_mixing"](spark, sf_dir).collect()
    assert all(sum(r.shard_words) == r.taken and len(r.shard_words) == mx.SHARDS for r in rows)
    blocks = mx.mix_plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))[2].groupBy("shard").agg(F.sum("words").alias("w"))
    want = {r.shard: r.w for r in blocks.collect()}
    assert dict(enumerate(np.array([r.shard_words for r in rows]).sum(axis=0).tolist())) == want and len(want) == mx.SHARDS


def test_mix_stage_writes_shards_in_their_order(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").dropDuplicates(["doc_id"]).localCheckpoint()
    corpus_pipeline.mix_sources(spark, docs, sf_dir).write.parquet(f"{tmp_path}/mix")
    got = [r.doc_id for f in sorted(glob.glob(f"{tmp_path}/mix/part-*")) for r in spark.read.parquet(f).collect()]
    rows, _, blocks = mx.mix_plan(docs, block_words=None)
    want = [r.doc_id for r in blocks.join(rows.select("row", "doc_id"), "row").orderBy("shard", "place").collect()]
    assert got == want and len(got) > 50


def test_mixed_documents(edge_docs, edges, no_docs):
    mixed = mx.mixed_documents(edge_docs)
    assert mixed.columns == edge_docs.columns
    assert mixed.groupBy("doc_id").count().filter("count > 3").count() == 0
    assert {(r.doc_id, r.text) for r in mixed.select("doc_id", "text").collect()} <= set(edges)
    assert mx.mixed_documents(no_docs).count() == 0


def test_mixing_query(spark, sf_dir, sf_docs):
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    taken, target = Counter(), {}
    for r in QUERIES["op8_mixing"](spark, sf_dir).collect():
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)


# ---- urls

URLS = [
    None, "", "example.com/en/", "HTTP://www.EXAMPLE.com/en/1", "http://EXAMPLE.com/en/1?x#y", "http://blog.example.com/en/",
    "http://example.com/EN/1", "x://b.net/es/#t", "x://b.net/esx/", "x://net/fr/", "x://com", "x://com/", "a://b://c.com/d",
    "https://bad.co.uk/1", "https://www.bad.co.uk/2", "https://good.co.uk?x=/3", "https://x.telecom/", "http://www.example.com/en",
    "https://ÉÀ.com/é?", "https://host.net:80/es/5",
]


def plain_url(url):
    url = url or ""
    if "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    path = rest[cut:]
    end = next((i for i, c in enumerate(path) if c in "?#"), len(path))
    return brute.lower(rest[:cut]), path[:end]


def plain_rule(host, path):
    fits = [(len(h + p), v, h + p) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_urls_and_rules(spark):
    pages = spark.createDataFrame([(i, u, None, i) for i, u in enumerate(URLS)], "page_id long, url string, html string, host int")
    none = spark.createDataFrame([], "page_id long, good int")
    got = {r.page_id: r for r in uf.judge_urls(pages, none, URL_RULES).collect()}
    assert len(got) == len(URLS)
    for i, url in enumerate(URLS):
        host, path = plain_url(url)
        verdict, rule = plain_rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict or "allow"), url
    assert uf.judge_urls(pages.limit(0), none, URL_RULES).count() == 0


def test_hosts_are_shrunk_to_their_parents(spark):
    rows, outcomes = [], []

    def add(host, good, bad, open_pages=1):
        for k in range(good + bad + open_pages):
            rows.append((len(rows), f"http://{host}/{k}"))
            if k < good + bad:
                outcomes.append((len(rows) - 1, int(k < good)))

    for k in range(12):
        add(f"a{k}.fine.org", 9, 1)
        add(f"b{k}.awful.org", 0, 10)
    add("new.awful.org", 0, 0)
    add("new.fine.org", 0, 1)
    add("x.unknown.co.uk", 0, 0)
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = uf.judge_urls(pages, spark.createDataFrame(outcomes + [(0, 1), (None, 0)], "page_id long, good int"), [])
    verdicts = {r.host: r.verdict for r in got.collect()}
    assert verdicts["b3.awful.org"] == verdicts["new.awful.org"] == "block"
    assert verdicts["a3.fine.org"] == verdicts["new.fine.org"] == verdicts["x.unknown.co.uk"] == "allow"


def test_domains(spark):
    hosts = {"a.b.co.uk": ("co.uk", "b.co.uk"), "co.uk": ("co.uk", "co.uk"), "x.example.com": ("com", "example.com"), "com": ("com", "com"),
             "": ("", "")}
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    suffix = uf.suffix_of(F.col("host"))
    got = {r.host: (r.s, r.d) for r in df.select("host", suffix.alias("s"), uf.domain_of(F.col("host"), suffix).alias("d")).collect()}
    assert got == hosts


def test_outcomes_follow_the_documents_number(spark):
    pages = spark.createDataFrame([(1, "http://a.com/en/7.html?p=9"), (2, "http://a.com/x"), (3, None), (4, "http://a.com/en/8#3")],
                                  "page_id long, url string")
    labels = spark.createDataFrame([(7, 1), (8, None), (9, 0)], "doc_id long, quality int")
    assert [tuple(r) for r in page_outcomes(pages, labels).collect()] == [(1, 1)]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, sf_dir, name):
    assert differences(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLE_SQL[name]) is None


# ---- sharding


def check_shards(rows, n, shards):
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert sum(map(len, slots.values())) == len(rows) == n
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots.get(k, [])) for k in range(shards)]
    assert max(sizes) - min(sizes) <= 1


def test_shards_over_edges(spark, edge_docs, edges, no_docs):
    for shards in (1, 5, 24):
        rows = [r.asDict() for r in sh.shard_rows(edge_docs, shards).collect()]
        check_shards(rows, len(edges), shards)
    text = dict(edges)
    for r in rows:
        own = (text[r["doc_id"]] or "").encode()
        assert (r["text_bytes"], r["text_crc32"]) == (len(own), zlib.crc32(own))
    assert sh.shard_rows(no_docs).count() == 0
    repeated = frame(spark, [(5, "a")] * 50 + [(None, "b")] * 30 + [(None, None)])
    check_shards([r.asDict() for r in sh.shard_rows(repeated, 7).collect()], 81, 7)


def test_one_more_shard_moves_little():
    rng = np.random.default_rng(0)
    counts = np.bincount(rng.integers(0, sh.POSITIONS, 200_000), minlength=sh.POSITIONS)

    def of(shards):
        out = np.zeros(int(counts.sum()), np.int64)
        base = np.concatenate([[0], np.cumsum(counts)])
        for p, lo, hi, s, _ in sh.walk(counts, shards).itertuples(index=False):
            out[base[p] + lo:base[p] + hi] = s
        return out

    moved = (of(24) != of(25)).mean()
    assert 0.03 < moved < 0.25
    assert (of(24) == of(24)).all()


def test_sharding_query(spark, sf_dir, sf_docs):
    rows = [r.asDict() for r in QUERIES["op10_sharding"](spark, sf_dir).collect()]
    check_shards(rows, len(sf_docs), 24)
    text = dict(sf_docs)
    assert all(r["size"] == len((text[r["doc_id"]] or "").encode()) + 8 and r["law"] == "rows" for r in rows)
