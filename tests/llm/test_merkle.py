import random

from coursequarry.llm import merkle
from tests.llm import brute
from tests.llm.conftest import DOCS, frame


def _rows(df):
    return [tuple(r) for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()]


def _check(df):
    want = sorted(brute.merkle(_rows(df)).values())
    got = merkle.manifest(df).collect()
    assert sorted((r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root) for r in got) == want
    assert all(r.verified == (r.folded_root == r.root) for r in got)
    return got


def test_edges_against_plain_tree(edge_docs):
    got = _check(edge_docs)
    assert len(got) == edge_docs.count()


def test_hot_source_many_levels_repeats_and_newlines(spark):
    rng = random.Random(3)
    rows = []
    for k in range(400):
        source = "hot" if k % 3 else rng.choice([None, "", "a", "b", "é", "Z"])
        text = rng.choice([None, "", "one\ntwo", "plain", "x\n\ny" * rng.randint(1, 4)])
        rows.append((rng.randint(0, 120) if k % 17 else None, text, rng.choice([None, "en"]), source,
                     None if text is None else len(text)))
    rows += rows[:30]  # repeated rows are leaves of their own
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    got = _check(df)
    assert len(got) == 430
    assert any(not r.verified for r in got) and any(r.verified for r in got)


def test_single_row_and_single_source(spark):
    one = spark.createDataFrame([(5, "a\nb", "en", "s", 3)], DOCS)
    (r,) = _check(one)
    assert r.leaf == r.subroot == r.root and r.proof_sha256 == brute.sha("")
    two = spark.createDataFrame([(1, "a", None, "s", 1), (2, "b", None, "s", 1)], DOCS)
    _check(two)


def test_empty_and_clashing_columns(no_docs, edge_docs, spark):
    assert merkle.manifest(no_docs).count() == 0
    clash = edge_docs.selectExpr("*", "1 as tree", "2 as pos", "'x' as h", "'y' as fh", "3 as level", "4 as children",
                                 "5 as _mk_part", "6 as up_tree", "7 as slot", "8 as step", "9 as siblings")
    _check(clash)
