import public_tokenizers
from pyspark.sql import functions as F

from coursequarry.llm import alignment
from coursequarry.llm.queries import alignment_digests
from tests.llm import brute
from tests.llm.conftest import DOCS, frame

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _compare(spark, rows):
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS).repartition(3)
    want = brute.alignment(rows, A, B)
    got = alignment_digests(df.withColumn("k", F.col("doc_id"))).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got}
    for k, (i, _) in enumerate(rows):
        assert by_id[i] == want[k], (i, rows[k][1][:60] if rows[k][1] else rows[k][1])
    return by_id


def test_against_plain_loops(spark, edges, sf_docs):
    rows = edges + [(10_000 + i, t) for i, t in sf_docs[:60]]
    got = _compare(spark, rows)
    assert any(v[3] > 0 for v in got.values())
    assert got[edges[0][0]] == (0, 0, 0, 0, 0, 0, "")


def test_product_counts_shared_groups():
    _, _, ta, tb = alignment.load(A, B)
    a, b, _, _ = alignment.load(A, B)
    text = "hello wonderful world"
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    ids_b = b.encode(text)
    import numpy as np
    got = alignment.align_one(np.array(ids_a), np.array(ids_b), np.frombuffer((" " + text).encode(), np.uint8), ta, tb)
    groups = [g.split("|") for g in got["groups"].split(";")]
    assert got["n_shared"] == sum(len(x.split(",")) * len(y.split(",")) for x, y in groups)
    assert got["n_links"] == got["n_groups"] == len(groups)


def test_repeats_empty_and_clashes(spark, no_docs):
    assert alignment_digests(no_docs).count() == 0
    df = frame(spark, [(1, "same text"), (1, "same text"), (None, None), (2, "")]).selectExpr(
        "*", "1 as _al_row", "2 as _al_doc", "3 as groups", "4 as pair_keys", "5 as n_best")
    got = sorted((r.doc_id or -1, r.n_links, r.count_sum) for r in alignment_digests(df).collect())
    assert got[0] == (-1, 0, 0) and got[1] == (1, got[1][1], 2 * got[1][1]) and got[2] == got[1]


def test_block_equals_one_by_one(edges, sf_docs):
    import numpy as np
    a, b, ta, tb = alignment.load(A, B)
    texts = [t or "" for _, t in edges] + [t or "" for _, t in sf_docs[:200]] + ["", "x", " two  spaces ", "ΣΑΣ"]
    ids_a = [np.array(a.encode(" " + t, add_special_tokens=False).ids if t else [], np.int64) for t in texts]
    ids_b = [np.array(b.encode(t) if t else [], np.int64) for t in texts]
    got = alignment.align_block(ids_a, ids_b, texts, ta, tb)
    for t, x, y, g in zip(texts, ids_a, ids_b, got):
        one = alignment.align_one(x, y, np.frombuffer((" " + t).encode(), np.uint8) if t else np.zeros(0, np.uint8), ta, tb)
        assert g == one, t[:40]
    assert alignment.align_block([], [], [], ta, tb) == []


def test_block_groups_without_sorting(monkeypatch, edges):
    """Groups and their text come from running counts; sorts and searches over all tokens cost CPU time."""
    import numpy as np
    a, b, ta, tb = alignment.load(A, B)
    texts = [t or "" for _, t in edges if len(t or "") < 5000]
    ids_a = [np.array(a.encode(" " + t, add_special_tokens=False).ids if t else [], np.int64) for t in texts]
    ids_b = [np.array(b.encode(t) if t else [], np.int64) for t in texts]
    want = [alignment.align_one(x, y, np.frombuffer((" " + t).encode(), np.uint8) if t else np.zeros(0, np.uint8), ta, tb)
            for t, x, y in zip(texts, ids_a, ids_b)]
    for name in ("lexsort", "isin"):
        monkeypatch.delattr(np, name)
    assert alignment.align_block(ids_a, ids_b, texts, ta, tb) == want


def _odd_texts(edges, sf_docs):
    return [t or "" for _, t in edges if len(t or "") < 50_000] + [t or "" for _, t in sf_docs[:100]] + [
        "", " ", "  ", "x ", " x", "a  b", "a \n b", "a\n\nb c", "a\n b", "a b\n", "a\tb c", "a b c", "▁", "a▁ b", "a ▁b",
        "it's don't 'tis l'été 12 a1b2!! x.\nAnd... <|endoftext|> <s> <0x41>", "é a ́b", "　a b\x85", "a\x1cb \x1f c",
        "日本 🙂🙂 x ½ª²", "a\x00 b", "ÀÖ×÷øÿ ªº É.\nÉ"]


def test_words_give_the_ids_of_whole_texts(monkeypatch, edges, sf_docs):
    import numpy as np
    a, b, _, _ = alignment.load(A, B)
    texts = _odd_texts(edges, sf_docs)
    whole_a = [e.ids for e in a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
    whole_b = [[] if "▁" in t else x for t, x in zip(texts, b.encode(texts))]  # these have no tokens in either form
    words = alignment.WordIds(a, b)
    assert words.cuts
    for limit, cuts in ((alignment.WORD_MEMO, True), (0, True), (0, False)):
        monkeypatch.setattr(alignment, "WORD_MEMO", limit)
        words.cuts = cuts
        for part in (slice(None), slice(5, 30), slice(30, None)):
            ids_a, n_a, ids_b, n_b = alignment.encode_block(texts[part], words)
            assert [x.tolist() for x in np.split(ids_a, np.cumsum(n_a)[:-1])] == whole_a[part]
            got = [x.tolist() for x in np.split(ids_b, np.cumsum(n_b)[:-1])]
            assert [[] if "▁" in t else x for t, x in zip(texts[part], got)] == whole_b[part]


def test_tokenizers_see_a_word_once():
    a, b, _, _ = alignment.load(A, B)
    seen = []

    class Seen:
        def encode(self, texts, num_threads):
            seen.extend(texts)
            return b.encode(texts, num_threads=num_threads)

    words = alignment.WordIds(a, b)
    words.b = Seen()
    for _ in range(2):
        alignment.encode_block(["one two one.\nTwo one", "two " * 500 + "three"], words)
    assert sorted(seen) == ["one", "one.\nTwo", "three", "two"]


def test_tokenizers_that_look_past_spaces_get_whole_texts():
    from tokenizers import Tokenizer, normalizers
    a, b, _, _ = alignment.load(A, B)
    assert alignment.cuts_at_spaces(a, b)
    other = Tokenizer.from_file(A)
    assert not alignment.cuts_at_spaces(other, b)  # takes strings of special tokens out of a text
    other.encode_special_tokens = True
    assert alignment.cuts_at_spaces(other, b)
    other.normalizer = normalizers.NFC()
    assert not alignment.cuts_at_spaces(other, b)
    words = alignment.WordIds(other, b)
    text = "one two " * 3 + "é"
    ids_a, _, ids_b, _ = alignment.encode_block([text], words)
    assert ids_a.tolist() == other.encode(" " + text, add_special_tokens=False).ids and ids_b.tolist() == b.encode(text)
    assert len(words) == 0
