"""The corpus pipeline, stage by stage, on one small table."""

from collections import Counter

import corpus_pipeline
import numpy as np
from tokenizers import Tokenizer

from coursequarry.llm import quality
from coursequarry.llm.queries import vocabulary
from tests.llm import brute


def test_stages_follow_each_other(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, held = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{tmp_path}/{name}")
        held[name] = (docs, spark.read.parquet(f"{tmp_path}/{name}"))
        docs = held[name][1]
        assert name == "bpe" or docs.columns == columns

    def pairs(df):
        return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]

    before, after = map(pairs, held["quality_classifier"])
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scores = {r.doc_id: r.predicted for r in quality.quality_scores(held["quality_classifier"][0], labels).collect()}
    assert sorted(after) == sorted((i, t) for i, t in before if scores[i]) and len(after) < len(before)

    before, after = map(pairs, held["exact_dedup"])
    assert sorted(after) == sorted((i, t) for i, t in before if brute.exact(before)[i][2])

    before, after = map(pairs, held["jaccard_join"])
    comp = brute.jaccard(before)
    assert sorted(after) == sorted((i, t) for i, t in before if comp[i][1] == i)

    before, after = map(pairs, held["mixing"])
    assert set(after) <= set(before) and max(Counter(after).values()) <= 3
    source = {r.doc_id: r.source for r in held["mixing"][0].collect()}
    size = {i: len(brute.WORD.findall(t or "")) for i, t in before}
    sizes, taken = Counter(), Counter()
    for i, _ in before:
        sizes[source[i]] += size[i]
    for i, _ in after:
        taken[source[i]] += size[i]
    for s, target in brute.targets(dict(sizes)).items():
        assert abs(taken[s] - target) <= max(size[i] for i in size if source[i] == s)

    tokenizer = Tokenizer.from_file(vocabulary())
    want = brute.bpe(list(dict(pairs(held["bpe"][0])).items()), tokenizer)
    rows = held["bpe"][1].collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in after)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert (len(ids), r.decoded_sha256) == (want[r.doc_id][0], want[r.doc_id][2]) and r.n_tokens == len(ids)
    assert Counter((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, sf_dir).collect()) == Counter(
        (r.doc_id, r.n_tokens) for r in rows)


def test_stages_take_empty_tables_and_odd_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, None, None, None, 0), (1, None, None, None, 0),
                                 (2, "", "en", "", 0)], docs.schema)
    for rows in (docs.limit(0), odd):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, rows, sf_dir).count() <= 3 * rows.count()
