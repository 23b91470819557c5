"""Token files and BPE against the tokenizers library."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from coursequarry.llm import bpe, token_files as tf
from coursequarry.llm.queries import QUERIES, vocabulary
from tests.llm import brute
from tests.llm.conftest import by_id, frame


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(vocabulary())


@pytest.fixture(scope="module")
def own():
    return bpe.Bpe(bpe.read_definition(vocabulary()))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=40).flatmap(
    lambda v: st.tuples(st.just(v), st.lists(st.integers(0, len(v)), max_size=4))))
def test_values_come_back(case):
    values, cuts = case
    bounds = [0, *sorted(cuts), len(values)]
    docs = [np.array(values[a:b], np.uint32) for a, b in zip(bounds, bounds[1:])]
    coded = [tf.encode_values(d) for d in docs]
    assert [tf._count(c, d) for c, d in coded] == [len(d) for d in docs]
    control, data = (np.frombuffer(b"".join(x), np.uint8) for x in zip(*coded))
    out = tf.decode_values(control, data, np.array([len(d) for d in docs]))
    assert out.tolist() == values


def test_small_values_take_one_byte():
    control, data = tf.encode_values(np.arange(256))
    assert (len(control), len(data)) == (64, 256)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdetIN'sS!?19 \n\t  \x1céÉßİΣς日🙂́<|>"), max_size=40))
def test_same_ids_as_the_library(own, tokenizer, text):
    want = tokenizer.encode(text, add_special_tokens=False).ids
    got = np.frombuffer(own.encode(text), "<u4")
    assert got.tolist() == want
    assert own.decode(got).decode() == tokenizer.decode(want, skip_special_tokens=False)


def test_long_words_merge_alike(own):
    rng = np.random.default_rng(1)
    for n in (2, 3, 30, 64, 65, 400):
        parts = [own.vocab["abcdefghin"[k]] for k in rng.integers(0, 10, n)]
        assert own.merge_short(list(parts)) == own.merge_long(list(parts))


def test_memo_stays_bounded():
    memo = bpe.Words(len, 10)
    assert [memo[b"x" * k] for k in range(40)] == list(range(40))
    assert len(memo) <= 10


@pytest.mark.parametrize("lengths", [[], [0], [1], [3, 0, 4, 5, 0, 1, 9, 400]])
def test_rows_are_coded_like_single_documents(lengths):
    rng = np.random.default_rng(3)
    docs = [(rng.integers(0, 2**32, n) >> rng.integers(0, 32, n)).astype("<u4") for n in lengths]
    offsets = np.concatenate([[0], np.cumsum(np.array(lengths, np.int64))]).astype(np.int64)
    control, data = tf.encode_rows(np.concatenate([np.zeros(0, "<u4"), *docs]), offsets)
    assert list(zip(control.to_pylist(), data.to_pylist())) == [tf.encode_values(d) for d in docs]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abstIé.,!'?1 \n\u0301\u0338<|>×"), max_size=40))
def test_signs_cut_off_words_change_no_id(own, tokenizer, text):
    texts = [text, "", text + "a", ".", text]
    ids, offsets = bpe.encode_texts(pa.array(texts), own.words)
    got = [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])]
    assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_word_is_looked_up_once_whatever_sign_follows(tokenizer):
    encoder = tf._Encoder(bpe.read_definition(vocabulary()))
    text = "one, One! one. one two... two"
    assert bpe.encode_texts(pa.array([text]), encoder.words)[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert sorted(encoder.words) == [b"!", b",", b".", b"...", b"one", b"two"] and set(encoder.pieces) == set()


def test_token_files_over_edges(spark, edge_docs, edges, tokenizer, tmp_path, monkeypatch):
    monkeypatch.setattr(tf, "PART_IDS", 5000)
    monkeypatch.setattr(tf, "BLOCK_IDS", 700)
    folder = str(tmp_path / "files")
    tf.write_token_files(edge_docs, vocabulary(), folder)
    assert by_id(tf.read_token_files(spark, folder, digest_only=True), "start", "n_tokens", "ids_crc32") == \
        brute.token_files(edges, tokenizer)
    ids = by_id(tf.read_token_files(spark, folder), "ids")
    for i, text in edges:
        assert np.frombuffer(ids[i][0], "<u4").tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def test_token_files_of_nothing_and_repeated_rows(spark, no_docs, tmp_path):
    tf.write_token_files(no_docs, vocabulary(), str(tmp_path / "none"))
    assert tf.read_token_files(spark, str(tmp_path / "none"), digest_only=True).count() == 0
    docs = frame(spark, [(5, "a b"), (5, "a b"), (None, "c"), (1, "d")])
    tf.write_token_files(docs, vocabulary(), str(tmp_path / "twice"))
    rows = tf.read_token_files(spark, str(tmp_path / "twice"), digest_only=True).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens) for r in rows] == [(None, 0, 2), (1, 2, 2), (5, 4, 3), (5, 7, 3)]


def test_bpe_over_edges(spark, edge_docs, edges, no_docs, tokenizer):
    want = brute.bpe(edges, tokenizer)
    assert by_id(bpe.round_trip_digests(edge_docs, vocabulary()), "n_tokens", "ids_sha256", "decoded_sha256") == want
    coded = bpe.encode_documents(edge_docs, vocabulary())
    texts = by_id(bpe.decode_documents(coded, vocabulary()), "text")
    assert {i: brute.sha(t) for i, (t,) in texts.items()} == {i: w[2] for i, w in want.items()}
    assert {i: s for i, (s,) in by_id(bpe.encoded_with_check(edge_docs, vocabulary()), "decoded_sha256").items()} == \
        {i: w[2] for i, w in want.items()}
    assert bpe.round_trip_digests(no_docs, vocabulary()).count() == 0
    assert bpe.round_trip_digests(frame(spark, [(None, "a"), (2, "b"), (2, "b")]), vocabulary()).count() == 3


def test_queries(spark, sf_dir, sf_docs, tokenizer):
    assert by_id(QUERIES["op1_token_files"](spark, sf_dir), "start", "n_tokens", "ids_crc32") == \
        brute.token_files(sf_docs, tokenizer)
    assert by_id(QUERIES["op6_bpe"](spark, sf_dir), "n_tokens", "ids_sha256", "decoded_sha256") == \
        brute.bpe(sf_docs, tokenizer)
