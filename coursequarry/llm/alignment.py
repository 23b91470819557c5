"""Alignment of two tokenizers over the bytes of each text, and corpus-wide counts of aligned token pairs.

A encodes space + text with a byte-level BPE (`tokenizers`, special-token strings taken as plain text); B encodes
the text with a sentencepiece BPE that puts the space in front itself. A token's bytes: A's vocabulary entry
byte-level decoded; B's piece in UTF-8 with U+2581 as a space and `<0xHH>` as the byte HH. A text whose tokens
of A or of B do not join to exactly space + text (null, empty, or changed by a tokenizer's normalisation) has no
tokens: all counts 0 and groups ''.

Per text, both token sequences are incidence matrices in CSR form over the text's bytes: A (tokens x bytes) and
Bᵀ (bytes x tokens). Gustavson's row-by-row product A·Bᵀ gives every pair of overlapping tokens with the number
of bytes they share; links are the pairs whose byte ranges end together. Offsets where tokens of both end cut
the text into groups; the group-incidence product G_A·G_Bᵀ counts the pairs of tokens sharing a group
(`n_shared`, its number of entries, computed from the group sizes without listing the pairs).

Neither tokenizer lets a token or a merge cross from a letter or sign to a space before another one, so texts are
cut there and the tokenizers see each distinct word of a block once (a bounded memo per worker keeps its ids); the
products still run over every text's own tokens and bytes. Texts with other spaces, and all texts where `cuts_at_spaces`
does not find such a pair of tokenizers, are encoded whole.

Corpus-wide, Spark counts every (A id, B id) pair over the links of all rows (map-side partial sums, so a pair
that a third of all links hold does not make one task large), finds each B id's highest count, and scores every
row's links against them: `n_best` links whose count is their B id's highest (ties included) and `count_sum`.
The pair table is broadcast only when its measured size is below `BROADCAST_PAIRS` rows, else joined by shuffle.

Edge cases: null doc_id is carried as null; repeated rows are separate rows and count separately; very long texts
are handled in numpy in time linear in their bytes; extra columns of the caller are not read.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from coursequarry.llm.bpe import _SYMBOLS
from coursequarry.sources.scratch import cut_lineage

BROADCAST_PAIRS = 2_000_000
BLOCK_BYTES = 1 << 20  # texts are encoded together up to this many bytes (a longer text alone)
# A worker forgets the words it keeps before a block when they are more, or have more ids, than this.
WORD_MEMO, MEMO_IDS = 300_000, 8_000_000
_PAIR_SHIFT = 16  # B ids are below 2**16 in the vocabularies in use
_LOADED: dict = {}
# Words of printable ASCII, Latin letters and line feeds, and A's pattern over them. No lone surrogates or marks.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_PLAIN = re.compile(f"[!-~\n{_LETTERS}]+")
_CUT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\\s0-9{_LETTERS}]+|\\s+(?!\\S)|\\s+")
_OUTER = re.compile(r"\S(.*\S)?", re.DOTALL)

OUT = ("_al_doc long, n_a long, n_b long, n_groups long, n_links long, n_shared long, groups string, "
       "pair_keys array<long>, pair_counts array<long>")


def _byte_decoder() -> dict[str, int]:
    """Characters of a byte-level vocabulary back to bytes: printable Latin-1 bytes stand for themselves, the
    others for 256, 257, ... in byte order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    chars = {b: chr(b) for b in own}
    extra = 0
    for b in range(256):
        if b not in chars:
            chars[b] = chr(256 + extra)
            extra += 1
    return {c: b for b, c in chars.items()}


def _flat(entries: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.array([len(e) for e in entries], np.int64)
    starts = np.zeros(len(entries), np.int64)
    np.cumsum(lengths[:-1], out=starts[1:])
    return np.frombuffer(b"".join(entries), np.uint8), starts, lengths


def load(path_a: str, path_b: str):
    """Both tokenizers and the bytes of every id, once per Python worker."""
    key = (path_a, path_b)
    if key not in _LOADED:
        # Spark runs one task per core; the tokenizers' own thread pools would only contend with the other tasks.
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer
        a = Tokenizer.from_file(path_a)
        a.encode_special_tokens = True
        back = _byte_decoder()
        table_a = [b""] * a.get_vocab_size()
        for token, i in a.get_vocab().items():
            table_a[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        table_b = []
        for i in range(b.get_piece_size()):
            piece = b.id_to_piece(i)
            table_b.append(bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode())
        _LOADED[key] = (a, b, _flat(table_a), _flat(table_b))
        _LOADED["words", key] = WordIds(a, b)
        _LOADED["digits"] = _flat([str(i).encode() for i in range(max(len(table_a), len(table_b)))])
    return _LOADED[key]


def word_ids(path_a: str, path_b: str) -> WordIds:
    """The words this Python worker keeps."""
    load(path_a, path_b)
    return _LOADED["words", (path_a, path_b)]


def cuts_at_spaces(a, b) -> bool:
    """Whether no token of A or B can depend on both sides of a space that stands between two other characters.

    A: GPT-2's pattern without a normaliser; B: merges over unnormalised text, and no piece with a space after
    another character.
    """
    rules = json.loads(a.to_str())
    cutter = rules["pre_tokenizer"] or {}
    if not (rules["normalizer"] is None and rules["model"]["type"] == "BPE" and cutter.get("type") == "ByteLevel"
            and cutter.get("use_regex") and not cutter.get("add_prefix_space")
            and not rules["truncation"] and not rules["padding"] and a.encode_special_tokens
            and all(t["special"] for t in rules["added_tokens"])):
        return False
    try:
        from sentencepiece import sentencepiece_model_pb2
    except ImportError:  # the model's settings cannot be read without protobuf
        return False
    model = sentencepiece_model_pb2.ModelProto.FromString(b.serialized_model_proto())
    normal, trained = model.normalizer_spec, model.trainer_spec
    plain = all(p.type not in (p.USER_DEFINED, p.UNUSED) and "▁" not in p.piece.lstrip("▁") for p in model.pieces)
    return plain and trained.model_type == trained.BPE and not trained.treat_whitespace_as_suffix and not (
        normal.precompiled_charsmap or normal.remove_extra_whitespaces) and (
        normal.add_dummy_prefix and normal.escape_whitespaces)


class WordIds(dict):
    """Word -> its number among the words this worker keeps, for words without outer spaces.

    `sides` has, for A (each word with the space before it) and for B, the ids of all kept words end to end and where
    each word's begin (one more at the end). All is forgotten when full, so that it stays bounded.
    """

    def __init__(self, a, b):
        super().__init__()
        self.a, self.b, self.model, self.cuts = a, b, a.model, cuts_at_spaces(a, b)
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.sides = [(np.zeros(0, np.int32), np.zeros(1, np.int64)) for _ in range(2)]

    def _word(self, word: str) -> list[int]:
        """A's ids of a word and the space before it."""
        text = " " + word
        if not _PLAIN.fullmatch(word):
            return self.a.encode(text, add_special_tokens=False).ids
        out = []
        for piece in _CUT.findall(text):
            symbols = piece.replace(" ", "Ġ").replace("\n", "Ċ") if piece.isascii() else "".join(
                [_SYMBOLS[c] for c in piece.encode()])
            out += [t.id for t in self.model.tokenize(symbols)]
        return out

    def look_up(self, words: list[bytes]) -> np.ndarray:
        """The numbers of distinct words; those not kept are encoded together and kept."""
        if len(self) > WORD_MEMO or max(len(ids) for ids, _ in self.sides) > MEMO_IDS:
            self.forget()
        new = [w for w in words if w not in self]
        texts = [w.decode() for w in new]
        self.update(zip(new, range(len(self), len(self) + len(new))))
        self.sides = [_appended(side, more) for side, more in zip(
            self.sides, ([self._word(t) for t in texts], self.b.encode(texts, num_threads=1)))]
        return np.array([self[w] for w in words], np.int64)


def _appended(side, more: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    ids, begin = side
    sizes = np.array([len(m) for m in more], np.int64)
    own = np.fromiter(chain.from_iterable(more), np.int32, int(sizes.sum()))
    return np.concatenate([ids, own]), np.concatenate([begin, begin[-1] + np.cumsum(sizes)])


def encode_block(texts: list[str], words: WordIds) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A ids of all texts end to end, how many each text has, and the same of B."""
    split = pc.split_pattern(pa.array(texts, pa.large_string()).cast(pa.large_binary()), b" ")
    known = split.flatten().dictionary_encode()
    which, first = known.indices.to_numpy(), split.offsets.to_numpy()
    distinct = known.dictionary.to_numpy(zero_copy_only=False)
    text_of = np.repeat(np.arange(len(texts)), np.diff(first))
    # Texts with spaces at an end or beside white space are encoded whole: they become words of their own.
    whole = np.full(len(texts), not words.cuts)
    bad = np.array([not w or not (w[0] > 32 and 32 < w[-1] < 128 or _OUTER.fullmatch(w.decode()))
                    for w in distinct.tolist()], bool)
    whole[text_of[bad[which]]] = True
    by_words = ~whole[text_of]
    use = np.flatnonzero(np.bincount(which[by_words], minlength=len(distinct)))
    number = np.zeros(len(distinct), np.int64)
    number[use] = words.look_up(distinct[use].tolist())
    at_whole = np.flatnonzero(whole)
    units = number[which]
    units[~by_words] = len(words)  # no ids
    units[first[at_whole]] = len(words) + 1 + np.arange(len(at_whole))
    odd = [texts[k] for k in at_whole]
    ids_a = [e.ids for e in words.a.encode_batch_fast([" " + t for t in odd], add_special_tokens=False)] if odd else []
    ids_b = words.b.encode(odd, num_threads=1) if odd else []
    out = []
    for side, more in zip(words.sides, (ids_a, ids_b)):
        every, begin = _appended(side, [[], *more])
        size = np.diff(begin)[units]
        end = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat((begin[units] - end[:-1]).astype(np.int32), size)
        at += np.arange(end[-1], dtype=np.int32)
        out += [every[at], np.diff(end[first])]
    return tuple(out)


def _gather(ids: np.ndarray, table) -> np.ndarray:
    flat, starts, lengths = table
    size = lengths[ids]
    first = np.repeat(starts[ids] - (np.cumsum(size) - size), size)
    return flat[first + np.arange(int(size.sum()))]


def align_one(ids_a: np.ndarray, ids_b: np.ndarray, target: np.ndarray, table_a, table_b) -> dict | None:
    """Groups, links and shared-group count of one text, or None where the tokens do not join to `target`."""
    len_a, len_b = table_a[2][ids_a], table_b[2][ids_b]
    if len(target) == 0 or len_a.sum() != len(target) or len_b.sum() != len(target):
        return None
    if not (np.array_equal(_gather(ids_a, table_a), target) and np.array_equal(_gather(ids_b, table_b), target)):
        return None
    end_a, end_b = np.cumsum(len_a), np.cumsum(len_b)
    # CSR of A (rows: A tokens, columns: bytes) and of Bᵀ (rows: bytes, one column each: the B token holding it).
    indptr_a, indices_a = np.concatenate(([0], end_a)), np.arange(len(target))
    b_of_byte = np.repeat(np.arange(len(ids_b)), len_b)
    # Gustavson: row i of A·Bᵀ accumulates Bᵀ's rows for the bytes of row i; entries come ordered, so the
    # accumulator is a run-length count of (row, column).
    rows = np.repeat(np.arange(len(ids_a)), np.diff(indptr_a))
    cols = b_of_byte[indices_a]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (cols[1:] != cols[:-1])
    pr, pc = rows[new], cols[new]
    linked = end_a[pr] == end_b[pc]
    la, lb = ids_a[pr[linked]], ids_b[pc[linked]]
    cuts = end_a[np.isin(end_a, end_b, assume_unique=True)]
    group_a = np.searchsorted(cuts, end_a)
    group_b = np.searchsorted(cuts, end_b)
    shared = int((np.bincount(group_a, minlength=len(cuts)) * np.bincount(group_b, minlength=len(cuts))).sum())
    groups = _group_text(ids_a, ids_b, group_a, group_b)
    keys, counts = np.unique((la.astype(np.int64) << _PAIR_SHIFT) | lb.astype(np.int64), return_counts=True)
    return {"n_a": len(ids_a), "n_b": len(ids_b), "n_groups": len(cuts), "n_links": int(linked.sum()),
            "n_shared": shared, "groups": groups, "pair_keys": keys.tolist(), "pair_counts": counts.tolist()}


def _group_text(ids_a, ids_b, group_a, group_b) -> str:
    """`a1,a2|b1;a3|b2,b3`: per group its A ids, `|`, its B ids; groups joined by `;`. Built as bytes in numpy:
    every id's decimal digits gathered from a table, then the separators put between them."""
    side = np.concatenate([np.zeros(len(ids_a), np.int8), np.ones(len(ids_b), np.int8)])
    group = np.concatenate([group_a, group_b])
    ids = np.concatenate([ids_a, ids_b])
    order = np.lexsort((np.arange(len(ids)), side, group))
    ids, side, group = ids[order], side[order], group[order]
    last = np.ones(len(ids), bool)
    last[:-1] = (side[1:] != side[:-1]) | (group[1:] != group[:-1])
    sep = np.full(len(ids), ord(","), np.uint8)
    sep[last & (side == 0)] = ord("|")
    sep[last & (side == 1)] = ord(";")
    digits = _LOADED["digits"]
    width = digits[2][ids] + 1
    out = np.empty(int(width.sum()), np.uint8)
    at = np.cumsum(width) - 1
    keep = np.ones(len(out), bool)
    keep[at] = False
    out[keep] = _gather(ids, digits)
    out[at] = sep
    return out[:-1].tobytes().decode()


def align_block(ids_a: list, ids_b: list, texts: list[str], table_a, table_b) -> list[dict | None]:
    """`align_one` for many texts at once: their bytes, tokens and products laid end to end.

    A text's end is an end of both tokenizations, so groups and links never cross texts, and one pass of numpy over
    the block does the work of a pass per text. Texts whose token bytes differ from space + text give None.
    """
    n = len(texts)
    count_a = np.array([len(x) for x in ids_a], np.int64)
    count_b = np.array([len(x) for x in ids_b], np.int64)
    all_a = np.concatenate(ids_a).astype(np.int64) if n else np.zeros(0, np.int64)
    all_b = np.concatenate(ids_b).astype(np.int64) if n else np.zeros(0, np.int64)
    ok, frame = align_flat(all_a, count_a, all_b, count_b, texts, table_a, table_b)
    return [row if good else None for good, row in zip(ok, frame.to_pylist())]


def align_flat(all_a: np.ndarray, count_a: np.ndarray, all_b: np.ndarray, count_b: np.ndarray, texts: list[str],
               table_a, table_b) -> tuple[np.ndarray, pa.RecordBatch]:
    """`align_block` over the ids of all texts end to end: which texts have tokens, and the columns of all texts."""
    n = len(texts)
    doc_a, doc_b = np.repeat(np.arange(n), count_a), np.repeat(np.arange(n), count_b)
    targets = [(" " + t).encode() if t else b"" for t in texts]
    size = np.array([len(t) for t in targets], np.int64)
    ok = (size > 0) & (np.bincount(doc_a, table_a[2][all_a], n) == size) & (
        np.bincount(doc_b, table_b[2][all_b], n) == size)
    keep_a, keep_b = ok[doc_a], ok[doc_b]
    all_a, all_b, doc_a, doc_b = all_a[keep_a], all_b[keep_b], doc_a[keep_a], doc_b[keep_b]
    target = np.frombuffer(b"".join(t for t, good in zip(targets, ok) if good), np.uint8)
    byte_doc = np.repeat(np.arange(n), np.where(ok, size, 0))
    wrong = (_gather(all_a, table_a) != target) | (_gather(all_b, table_b) != target)
    ok[np.unique(byte_doc[wrong])] = False
    len_a, len_b = table_a[2][all_a], table_b[2][all_b]
    end_a, end_b = np.cumsum(len_a), np.cumsum(len_b)
    # Gustavson's product over the block, as in `align_one`.
    rows = np.repeat(np.arange(len(all_a), dtype=np.int32), len_a)
    cols = np.repeat(np.arange(len(all_b), dtype=np.int32), len_b)
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (cols[1:] != cols[:-1])
    pr, pc = rows[new], cols[new]
    linked = end_a[pr] == end_b[pc]
    link_doc = doc_a[pr[linked]]
    key = (link_doc << 32) | (all_a[pr[linked]].astype(np.int64) << _PAIR_SHIFT) | all_b[pc[linked]]
    keys, counts = np.unique(key, return_counts=True)
    # Ends rise within each side, so groups are running counts of the common ends, without a sort or a search.
    ends_here = np.zeros(len(target) + 1, bool)
    ends_here[end_b] = True
    cut_a = ends_here[end_a]
    ends_here[:] = False
    ends_here[end_a] = True
    cut_b = ends_here[end_b]
    cuts = end_a[cut_a]
    group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
    cut_doc = doc_a[cut_a]
    size_a, size_b = np.bincount(group_a, minlength=len(cuts)), np.bincount(group_b, minlength=len(cuts))
    in_group = size_a * size_b
    n_groups = np.bincount(cut_doc, minlength=n)
    n_links = np.bincount(link_doc, minlength=n)
    shared = np.bincount(cut_doc, in_group, n).astype(np.int64)
    # The group text of the block; a text's part ends before the `;` after its last group.
    # A token stands after all tokens of earlier groups and, on side B, after its group's A tokens.
    place_a = np.arange(len(all_a)) + (np.cumsum(size_b) - size_b)[group_a]
    place_b = np.arange(len(all_b)) + np.cumsum(size_a)[group_b]
    ids = np.empty(len(all_a) + len(all_b), np.int64)
    ids[place_a], ids[place_b] = all_a, all_b
    sep = np.full(len(ids), ord(","), np.uint8)
    sep[place_a[cut_a]] = ord("|")
    sep[place_b[cut_b]] = ord(";")
    digits = _LOADED["digits"]
    width = digits[2][ids] + 1
    text = np.empty(int(width.sum()), np.uint8)
    at = np.cumsum(width) - 1
    hole = np.ones(len(text), bool)
    hole[at] = False
    text[hole] = _gather(ids, digits)
    text[at] = sep
    # Texts found wrong by their bytes alone stand among the others still; they get no row of any column.
    tokens = np.concatenate([[0], np.cumsum(np.bincount(doc_a, minlength=n) + np.bincount(doc_b, minlength=n))])
    begin = np.concatenate([[0], at + 1])[tokens]
    own = text.tobytes()
    groups = [own[i:j - 1].decode() if good else "" for good, i, j in zip(ok, begin.tolist(), begin[1:].tolist())]
    good_key = ok[keys >> 32]
    key_cut = np.concatenate([[0], np.cumsum(np.bincount((keys >> 32)[good_key], minlength=n))]).astype(np.int32)
    columns = {name: pa.array(np.where(ok, v, 0).astype(np.int64)) for name, v in (
        ("n_a", count_a), ("n_b", count_b), ("n_groups", n_groups), ("n_links", n_links), ("n_shared", shared))}
    columns["groups"] = pa.array(groups, pa.string())
    for name, v in (("pair_keys", keys & 0xFFFFFFFF), ("pair_counts", counts)):
        columns[name] = pa.ListArray.from_arrays(pa.array(key_cut), pa.array(v[good_key]))
    return ok, pa.RecordBatch.from_pydict(columns)


def _blocks(sizes: list[int]):
    start, size = 0, 0
    for k, more in enumerate(sizes):
        if size and size + more > BLOCK_BYTES:
            yield start, k
            start, size = k, 0
        size += more
    if start < len(sizes):
        yield start, len(sizes)


def _batches(path_a: str, path_b: str):
    def run(batches):
        _, _, table_a, table_b = load(path_a, path_b)
        words = word_ids(path_a, path_b)
        for batch in batches:
            texts = [t or "" for t in batch.column("_al_text").to_pylist()]
            for i, j in _blocks([len(t) for t in texts]):
                part = texts[i:j]
                _, found = align_flat(*encode_block(part, words), part, table_a, table_b)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_al_doc").slice(i, j - i), *found.columns], ["_al_doc", *found.schema.names])
    return run


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per row of `docs`: doc_id, n_a, n_b, n_groups, n_links, n_shared, groups and its links as (pair key, count)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("_al_doc"), F.col("text").cast("string").alias("_al_text"))
    return rows.mapInArrow(_batches(path_a, path_b), OUT).withColumnRenamed("_al_doc", "doc_id")


def pair_id(key):
    return (key.bitwiseAND((1 << _PAIR_SHIFT) - 1)).alias("b_id")


def scored_links(rows: DataFrame, name: str = "alignment") -> DataFrame:
    """`rows` (with `_al_row`, pair_keys, pair_counts) with n_best and count_sum over corpus-wide pair counts."""
    links = rows.select("_al_row", F.explode(F.arrays_zip("pair_keys", "pair_counts")).alias("_al_p")).select(
        "_al_row", F.col("_al_p.pair_keys").alias("_al_key"), F.col("_al_p.pair_counts").alias("_al_k"))
    counts = links.groupBy("_al_key").agg(F.sum("_al_k").alias("_al_count"))
    best = counts.groupBy(pair_id(F.col("_al_key"))).agg(F.max("_al_count").alias("_al_best"))
    pairs = cut_lineage(counts.join(best, pair_id(F.col("_al_key")) == best["b_id"]).select(
        "_al_key", "_al_count", (F.col("_al_count") == F.col("_al_best")).alias("_al_is_best")), f"{name}-pairs")
    small = pairs.count() <= BROADCAST_PAIRS
    joined = links.join(F.broadcast(pairs) if small else pairs, "_al_key")
    per_row = joined.groupBy("_al_row").agg(
        F.sum(F.when(F.col("_al_is_best"), F.col("_al_k")).otherwise(0)).alias("n_best"),
        F.sum(F.col("_al_k") * F.col("_al_count")).alias("count_sum"))
    return rows.join(per_row, "_al_row", "left").select(
        *[c for c in rows.columns], F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"))
