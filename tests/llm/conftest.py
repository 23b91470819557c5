import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
# Columns of the caller named like working columns of the operators.
CLASHING = ["row", "key", "digest", "size", "part", "chunk", "h", "cell", "host", "member", "_id", "score", "rank"]


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


def edge_texts() -> list[tuple[int, str | None]]:
    """Null, empty, blank, short, equal, near and very long texts, shared passages, odd characters."""
    rng = random.Random(5)
    base, passage, long = words(rng, 120), words(rng, 70), words(rng, 30_000)
    near = base.split()
    near[60] = "other"
    texts = [
        None, "", " \t\n\x0b\x0c\r ", "one two three four", "One TWO three four", "one  two\tthree\nfour", base, base,
        " ".join(near), base.upper(), passage, words(rng, 40) + " " + passage, passage + "\n" + words(rng, 30), long,
        long + " tail", "a" * 3000, "x" * 70 + "y" * 70, "<|endoftext|> it's <|startoftext|>'ll <|x", "naïve Äpfel ΣΑΣ İi x y é",
        "é ẛ̣ Å ﬁ 日本語 🙂🙂 ５", "don't 'september !!'s 12345 a1b2 --- \x1c\x1d x", base + " " + base, passage,
        "the the the the the the", words(rng, 55), words(rng, 50),
    ]
    return [(7 * i - 20, t) for i, t in enumerate(texts)]


def frame(spark, rows, extra=True):
    """A documents table with clashing columns; sources are null, empty, hot and others."""
    sources = ["hot", "hot", None, "", "b", "é", "hot"]
    data = [(i, t, "en" if k % 3 else None, sources[k % len(sources)], None if t is None else len(t))
            for k, (i, t) in enumerate(rows)]
    df = spark.createDataFrame(data, DOCS).repartition(3)
    if extra:
        for k, name in enumerate(CLASHING):
            df = df.selectExpr("*", f"cast(case when doc_id % 2 = 0 then {k} end as int) as {name}")
    return df


@pytest.fixture(scope="session")
def edges():
    return edge_texts()


@pytest.fixture(scope="session")
def edge_docs(spark, edges):
    df = frame(spark, edges).cache()
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return frame(spark, [])


@pytest.fixture(scope="session")
def sf_docs(spark, sf_dir):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


def by_id(df, *columns):
    out = {}
    for r in df.collect():
        assert r["doc_id"] not in out
        out[r["doc_id"]] = tuple(r[c] for c in columns)
    return out
