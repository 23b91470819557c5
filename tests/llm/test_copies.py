"""Exact dedup, substring dedup, Jaccard join and fingerprints against plain Python."""

import random
from collections import Counter

import numpy as np
import pytest

from coursequarry.llm import exact_dedup as ed, fingerprints as fp, jaccard_join as jj, substrings as ss
from coursequarry.llm.queries import QUERIES
from coursequarry.llm.tables import connected, join_groups
from tests.llm import brute
from tests.llm.conftest import by_id, frame, words


def near_groups(seed=3, groups=4, members=30):
    """Groups of near copies, chains of them and texts on their own."""
    rng = random.Random(seed)
    out, i = [], 0
    for g in range(groups):
        base = words(rng, rng.randint(20, 150)).split()
        for m in range(members):
            if m % 10 == 0:
                base = list(base)
                base[rng.randrange(len(base))] = f"new{g}{m}"  # the group drifts on
            own = list(base)
            if m % 3:
                own[rng.randrange(len(own))] = f"w{m}"
            out.append((i, " ".join(own)))
            i += rng.randint(1, 3)
    return out + [(10_000 + k, words(rng, rng.randint(1, 40))) for k in range(40)]


# ---- minimal perfect hash and exact dedup


@pytest.mark.parametrize("n", [0, 1, 2, 17, 1000, 5000])
def test_hash_is_minimal_and_perfect(n):
    digests = np.random.default_rng(n).integers(0, 256, (n, 32), np.uint8)
    levels, slots = ed.build_hash(digests)
    assert sorted(slots.tolist()) == list(range(n))
    assert ed.find_slots(levels, digests).tolist() == slots.tolist()
    others = np.random.default_rng(n + 1).integers(0, 256, (50, 32), np.uint8)
    found = ed.find_slots(levels, others)
    assert ((found >= -1) & (found < max(n, 1))).all()


def test_exact_dedup_over_edges(edge_docs, edges, no_docs):
    assert by_id(ed.exact_dedup(edge_docs), "keep_id", "group_size", "kept", "text_sha256") == brute.exact(edges)
    assert ed.exact_dedup(no_docs).count() == 0


def test_exact_dedup_with_repeated_and_null_ids(spark):
    rows = [(5, "a")] * 40 + [(3, "a"), (None, "a"), (None, "b"), (None, "b"), (9, None), (9, ""), (None, "c")]
    got = ed.exact_dedup(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in got if r.kept) == Counter(
        [(5, 5, 42), (None, None, 2), (9, 9, 2), (None, None, 1)])
    kept = ed.drop_copies(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert Counter((r.doc_id, r.text or "") for r in kept.collect()) == Counter([(5, "a"), (None, "b"), (9, ""), (None, "c")])


def test_history_is_looked_up(spark):
    rows = ed.digest_rows(frame(spark, [(i, f"t{i % 7}") for i in range(60)]))
    index = ed.build_index(rows.filter("doc_id < 3"), 4)
    groups = {bytes(r.digest).hex(): r for r in ed.look_up(rows.filter("doc_id >= 3"), index, 4).collect()}
    import hashlib
    for k in range(7):
        row = groups[hashlib.sha256(f"t{k}".encode()).hexdigest()]
        assert (row.keep_id, row.group_size, row.member) == (max(i for i in range(60) if i % 7 == k), 9 if k < 4 else 8, k < 3)


def test_hot_groups_join(spark):
    rows = spark.range(3000).selectExpr("id", "cast(case when id % 3 = 0 then 'hot' when id % 50 = 1 then null "
                                        "else concat('k', id) end as binary) as g")
    groups = rows.groupBy("g").count().selectExpr("g", "count as n", "1 as one").filter("g is not null")
    got = join_groups(rows, groups, "g", "n", 3000)
    assert got.count() == 3000 and got.filter("one is null").count() == rows.filter("g is null").count()
    assert got.filter("n = 1000").count() == 1000


# ---- substrings


def test_substrings_over_edges(edge_docs, edges, no_docs):
    assert by_id(ss.remove_repeats(edge_docs), "n_words", "n_removed", "kept_sha256") == brute.substrings(edges)
    assert ss.remove_repeats(no_docs).count() == 0


@pytest.mark.parametrize("window", [7, 40, 80])
def test_substrings_of_other_windows(spark, window):
    docs = near_groups(window)
    texts = by_id(ss.remove_repeats(frame(spark, docs), window, with_text=True), "n_words", "n_removed", "kept_sha256", "text")
    assert {i: r[:3] for i, r in texts.items()} == brute.substrings(docs, window)
    assert all(brute.sha(r[3]) == r[2] for r in texts.values())


def test_substrings_of_rows_without_an_id(spark):
    text = words(random.Random(1), 60)
    got = ss.remove_repeats(frame(spark, [(None, text), (4, text), (4, text), (9, text)])).collect()
    assert Counter((r.doc_id, r.n_removed) for r in got) == Counter([(None, 60), (4, 0), (4, 0), (9, 60)])


def test_levels_double():
    assert ss.levels_of(50) == [25, 50] and ss.levels_of(160) == [20, 40, 80, 160] and ss.levels_of(7) == [7]


# ---- Jaccard join


def test_jaccard_over_edges(edge_docs, edges, no_docs):
    assert by_id(jj.similar_documents(edge_docs), "n_shingles", "component_id") == brute.jaccard(edges)
    assert jj.similar_documents(no_docs).count() == 0


def test_jaccard_of_rows_without_an_id(spark):
    got = jj.similar_documents(frame(spark, [(None, "a b"), (4, "a b"), (4, "a b"), (9, "A B"), (None, None)])).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(
        [(None, 1, None), (4, 1, 4), (4, 1, 4), (9, 1, 4), (None, 0, None)])


@pytest.mark.parametrize("block", [2000, 12, 3])
def test_jaccard_in_blocks(spark, monkeypatch, block):
    """Groups larger than a block give the same components."""
    monkeypatch.setattr(jj, "BLOCK_DOCUMENTS", block)
    docs = near_groups(8, 2 if block == 3 else 4)
    assert by_id(jj.similar_documents(frame(spark, docs)), "n_shingles", "component_id") == brute.jaccard(docs)


def test_tree_join_finds_what_all_pairs_find():
    rng = np.random.default_rng(4)
    sets, sizes = [], []
    for g in range(12):
        base = rng.integers(0, 2**63, rng.integers(5, 200), np.uint64)
        for _ in range(rng.integers(1, 12)):
            own = np.unique(np.concatenate([base[rng.random(len(base)) < 0.93], rng.integers(0, 2**63, 5, np.uint64)]))
            sets.append(own)
            sizes.append(len(own) + rng.integers(0, 3))
    ids = rng.permutation(len(sets)).astype(np.int64)
    found = jj.TreeJoin(ids, np.array(sizes), sets).join_self()
    every = [(int(ids[a]), int(ids[b])) for a in range(len(sets)) for b in range(a)
             if jj.linked(len(np.intersect1d(sets[a], sets[b])), sizes[a], sizes[b])]
    nodes = [(int(i), None) for i in ids]
    assert set(map(tuple, map(sorted, found))) <= set(map(tuple, map(sorted, every)))
    assert brute.components(nodes, found) == brute.components(nodes, every)


def test_connected_components(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(5, 5)]
    got = {r.node: r.label for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = brute.components([(i, None) for e in edges for i in e], edges)
    assert got == {i: want[i] for e in edges if e[0] != e[1] for i in e}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each_component_stays(spark):
    docs = near_groups()
    comp = brute.jaccard(docs)
    kept = jj.drop_similar(frame(spark, docs))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in comp.values()})


# ---- fingerprints


def test_edited_texts_over_edges(edge_docs, edges, no_docs):
    for part in (fp.PART_BYTES, 50_000):
        assert by_id(fp.edited_fingerprints(edge_docs, part_bytes=part), "n_chars", "edited_sha256") == brute.edited(edges)
    assert fp.edited_fingerprints(no_docs).count() == 0


def test_edited_texts_of_odd_ids(spark):
    rows = [(None, "p q r s"), (3, "a b"), (3, "a b"), (None, None)]
    got = fp.edited_fingerprints(frame(spark, rows)).collect()
    assert Counter(r.doc_id for r in got) == Counter([None, 3, 3, None])
    one = fp.edited_fingerprints(frame(spark, [(1, "abcd")])).collect()
    assert [(r.n_chars, r.edited_sha256, r.near_next) for r in one] == [(4, brute.sha("abab"), 1.0)]


def test_edited_texts_over_many_ranges(spark):
    """As many ranges as 24 GB of texts have; a plan that nests one expression a range overflows the stack."""
    rows = [(7 * i, f"{i} a{i % 5} b") for i in range(1500)]
    assert fp.with_next(frame(spark, rows), 10).rdd.getNumPartitions() > 1000
    assert by_id(fp.edited_fingerprints(frame(spark, rows), part_bytes=10), "n_chars", "edited_sha256") == brute.edited(rows)


def test_fingerprints_estimate_jaccard():
    rng = random.Random(9)
    a = words(rng, 400).split()
    for cut in (0, 20, 60, 150):
        b = a[:len(a) - cut] + words(rng, cut).split()
        x, y = brute.shingle_set(" ".join(a), False), brute.shingle_set(" ".join(b), False)
        s = fp.text_signatures([" ".join(a), " ".join(b)], 256)
        assert abs((s[0] == s[1]).mean() - len(x & y) / len(x | y)) < 0.12
    s = fp.text_signatures(["", " ", "x"])
    assert (s[0] == s[1]).all() and not (s[0] == s[2]).any()


def test_near_classes(spark):
    docs = near_groups(5)
    got = by_id(fp.near_classes(frame(spark, docs)), "class_id")
    sets = {i: brute.shingle_set(t, False) for i, t in docs}
    for i, (c,) in got.items():
        assert c <= i
        assert c == i or any(j != i and got[j] == (c,) and len(sets[i] & sets[j]) >= 0.75 * len(sets[i] | sets[j]) for j in got)
    assert len({c for (c,) in got.values()}) < len(docs) / 2


def boilerplate(seed=11, pairs=60):
    """Texts that share a passage (Jaccard 0.69), each with one near copy (0.8) far from it in doc_id order."""
    rng = random.Random(seed)
    shared, out = words(rng, 140), []
    for k in range(pairs):
        own = words(rng, 30).split()
        near = own[:12] + words(rng, 18).split()
        out += [(k, f"{shared} {' '.join(own)}"), (1000 + (37 * k) % pairs, f"{shared} {' '.join(near)}")]
    return out


def near_components(docs, similarity=0.75):
    sets = {i: brute.shingle_set(t, False) for i, t in docs}
    ids = list(sets)
    return brute.components(docs, [(a, b) for k, a in enumerate(ids) for b in ids[:k] if sets[a] and len(
        sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])])


@pytest.mark.parametrize("block", [4000, 20])
def test_near_classes_of_texts_with_shared_passages(spark, monkeypatch, block):
    """Buckets full of texts that are no partners lose no pair, in one block or in several."""
    monkeypatch.setattr(jj, "BLOCK_DOCUMENTS", block)
    docs = boilerplate()
    want = near_components(docs)
    assert len(set(want.values())) == len(docs) / 2
    assert {i: c for i, (c,) in by_id(fp.near_classes(frame(spark, docs)), "class_id").items()} == want


def test_near_classes_of_odd_rows(spark, no_docs):
    base = [f"w{k}" for k in range(60)]
    rows = [(7, " ".join(base)), (3, " ".join(base[1:])), (3, "other words"), (9, "other words"), (None, "other words"),
            (None, "alone"), (5, None), (4, " ")]
    got = Counter((r.doc_id, r.class_id) for r in fp.near_classes(frame(spark, rows)).collect())
    assert got == Counter([(7, 3), (3, 3), (3, 3), (9, 3), (None, 3), (None, None), (5, 4), (4, 4)])
    docs = near_groups(5, 2)
    assert {i: c for i, (c,) in by_id(fp.near_classes(frame(spark, docs), 0.6), "class_id").items()} == near_components(docs, 0.6)
    assert fp.near_classes(no_docs).count() == 0


def test_queries(spark, sf_dir, sf_docs):
    assert by_id(QUERIES["op7_minhash"](spark, sf_dir), "n_chars", "edited_sha256") == brute.edited(sf_docs)
    assert by_id(QUERIES["op4_jaccard_join"](spark, sf_dir), "n_shingles", "component_id") == brute.jaccard(sf_docs)
    prints = by_id(QUERIES["op7_minhash"](spark, sf_dir), "fingerprint")
    text = dict(sf_docs)
    seen = {}
    for i, p in prints.items():
        assert seen.setdefault(text[i], p) == p
