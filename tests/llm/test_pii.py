import random

from pyspark.sql import functions as F

from coursequarry.llm import pii
from tests.llm import brute
from tests.llm.conftest import DOCS, frame

SAMPLES = [
    "write to ann.lee+x@mail.example.org or bob@host today", "a@b.c_x@y.z and x@y", "no@domain here@x. fine@a-b.co.uk",
    "ip 10.0.0.1, 256.1.1.1 and 1.2.3.4.5 or 001.002.003.004", "card 4111 1111 1111 1111 and 4111-1111-1111-1112",
    "4111111111111111 is 16; 5500 0000 0000 0004 ok; 1234567890123456789012 too long",
    "phone +1 (555) 123-4567, +44 20 7946 0958 and +12 34", "+123456789012345678 and +1-2", "call me at 555-123-4567",
    "555-123-4567 alone", "iban GB82 WEST 1234 5698 7654 32 and GB82WEST12345698765433", "my ssn 123-45-6789; 666-45-6789",
    "a" * 5000 + "@", "1" * 5000 + ".", "x.y." * 2000, "@" * 100 + "a@b.cd", "", None, "ünïcödé ✉ ann@ex.com 🙂 +49 30 1234567",
]


def test_base_spans_equal_plain_finditer(spark, edges):
    rng = random.Random(9)
    texts = SAMPLES + [t for _, t in edges] + ["".join(rng.choice("0123456789 .-+@a()") for _ in range(300)) for _ in range(40)]
    rows = [(k, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame([(k, t, None, None, None) for k, t in rows], DOCS)
    got = {r.doc_id: r.spans for r in pii.find_spans(df).collect()}
    for k, t in rows:
        base = [(s.kind, s.start, s.end) for s in got[k] if s.base]
        assert base == brute.pii_base(t), (k, t)
        starts = [(s.start, pii.KINDS.index(s.kind)) for s in got[k]]
        assert starts == sorted(starts)
        assert [tuple(s) for s in got[k] if s.base] == [s for s in pii.scan(t) if s[4]]


def test_added_spans_need_checksum_or_context():
    kinds = lambda t: [(s[0], t[s[1]:s[2]]) for s in pii.scan(t) if not s[4]]
    assert kinds("call me at 555-123-4567") == [("phone_local", "555-123-4567")]
    assert kinds("555-123-4567 alone") == []
    assert kinds("my ssn 123-45-6789") == [("ssn", "123-45-6789")]
    assert kinds("ssn 666-45-6789") == []
    assert ("iban", "GB82WEST12345698765432") in kinds("send to GB82WEST12345698765432 now")
    assert kinds("send to GB82WEST12345698765433 now") == []
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_query_columns_and_edges(spark, edge_docs, no_docs):
    from coursequarry.llm.queries import pii_digests
    out = pii_digests(edge_docs).collect()
    assert len(out) == edge_docs.count()
    for r in out:
        assert r.base_sha256 == brute.sha(",".join(f"{k}:{a}:{b}" for k, a, b in brute.pii_base(
            dict(brute_rows(edge_docs))[r.doc_id])))
    assert pii_digests(no_docs).count() == 0
    clash = frame(spark, [(1, "a@b.cd"), (1, "a@b.cd"), (None, None)]).selectExpr("*", "1 as spans", "2 as _pii_doc",
                                                                                  "3 as _pii_text")
    got = pii_digests(clash).orderBy(F.col("doc_id").asc_nulls_first()).collect()
    assert [(r.doc_id, r.n_email, r.spans) for r in got] == [(None, 0, ""), (1, 1, "email:0:6"), (1, 1, "email:0:6")]


def brute_rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
