"""BPE encoding and decoding with a contiguous array of ranks per word.

Text is cut at ASCII white space, which no token crosses. The rest of a tokenizer's text rules (normal form, case,
splitting, added tokens) is applied per distinct word; its merges are done here: a word's part ids and the ranks of
adjacent parts stand in two arrays, the smallest rank is looked for, its boundary is deleted, and the two
ranks beside it are refreshed. Words of more than `SHORT` parts keep their ranks in a heap instead, with the
same result. Words seen before are taken from a bounded memo of the Python worker.

Covers vocabularies of byte-level symbols with an end-of-word suffix whose rules drop white space. Decoding joins
the tokens' strings by one space, as such a file without a decoder asks for.

Defined results: null is the empty text, which has no ids; texts of any length are encoded whole; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from coursequarry.llm.words import column_bytes, row_blocks

SHORT = 64
# Entries at most. Words of one piece are in the memo of words alone, which is therefore the larger one.
WORD_MEMO, PIECE_MEMO = 500_000, 120_000
# Words of printable ASCII and Latin letters that are single code points in normal form and have a lower case of one.
_PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e]+")
_CUT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u017e]+|[0-9]|[^a-z0-9\u00df-\u017e]+")
_SPACES = np.arange(256, dtype=np.uint8)
_SPACES[9:14] = 0x20
_SMALL = _SPACES.copy()
_SMALL[65:91] += 32
_LETTER, _SIGN = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = _SIGN[list(b".,!")] = True
BLOCK_BYTES = 4_000_000
_NONE = 1 << 60


def _byte_symbols() -> list[str]:
    """The character that stands for each byte: printable Latin-1 ones for themselves, the others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(others)) for b in range(256)]


_SYMBOLS = _byte_symbols()


class Words(dict):
    """Word -> something derived from them; forgets all when full, so that it stays bounded."""

    def __init__(self, derive, limit: int):
        super().__init__()
        self.derive, self.limit = derive, limit

    def __missing__(self, word):
        out = self.derive(word)
        if len(word) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[word] = out
        return out


def cut_word(word: bytes) -> list[str] | None:
    """The pieces of a plain word, lower-cased; None for words that need the full text rules."""
    stem = word.rstrip(b".,!")
    if stem.isalpha():  # ASCII letters, then perhaps one run of signs
        pieces = [stem.lower().decode()]
        return pieces if len(stem) == len(word) else [*pieces, word[len(stem):].decode()]
    text = word.decode("utf-8", "replace")
    return _CUT.findall(text.lower()) if _PLAIN.fullmatch(text) and "<|" not in text else None


def in_symbols(piece: str) -> str:
    return piece if piece.isascii() else "".join([_SYMBOLS[b] for b in piece.encode()])


def encode_texts(texts: pa.Array, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, and where each text's ids begin (one more at the end).

    The texts are cut into words and the words numbered by Arrow, so that each distinct word of the block is
    looked up once and the ids are gathered by numpy. Signs after an ASCII letter become words of their own: a token
    ends there in any case, and what is left repeats far more often. ASCII letters are made small first, which leaves fewer
    words and changes no token, unless there are marks that combine with letters or what may be an added token.
    """
    data, offsets = column_bytes(texts)
    raw = data.tobytes()
    odd = b"<|" in raw or b"\xcc" in raw or b"\xcd" in raw
    cut = np.flatnonzero(_LETTER[data[:-1]] & _SIGN[data[1:]]) + 1
    data = np.insert((_SPACES if odd else _SMALL)[data], cut, 0x20)
    offsets = offsets + np.searchsorted(cut, offsets)
    texts = pa.Array.from_buffers(pa.large_binary(), len(texts), [
        None, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(data)])
    split = pc.split_pattern(texts, b" ")
    known = split.flatten().dictionary_encode()
    which = known.indices.to_numpy()
    ids = [words[w] for w in known.dictionary.to_numpy(zero_copy_only=False).tolist()]
    size = np.array([len(i) // 4 for i in ids], np.int64)
    every = np.frombuffer(b"".join(ids), "<u4")
    begin = np.cumsum(size) - size
    own = size[which]
    end = np.concatenate([[0], np.cumsum(own)])
    at = np.arange(end[-1], dtype=np.int32)
    at += np.repeat((begin[which] - end[:-1]).astype(np.int32), own)
    offsets = split.offsets.to_numpy()
    return every[at], end[offsets - offsets[0]]


def text_blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, pa.Array]]:
    """Runs of rows of a batch whose texts have a bounded size together: first row, end, texts."""
    column = batch.column("text").cast(pa.large_string())
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0))
    for i, j in row_blocks(np.concatenate([[0], np.cumsum(sizes)]), BLOCK_BYTES):
        yield i, j, column.slice(i, j - i)


class Bpe:
    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        spec = json.loads(definition)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.rules = Tokenizer.from_str(definition)
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added = added
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") \
            if added else None
        self.strings = {i: s.encode() for s, i in {**self.vocab, **added}.items()}
        self.ranks: dict[tuple[int, int], int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[self.vocab[a], self.vocab[b]] = rank
            self.merged.append(self.vocab[a + b])
        self.pieces = Words(self._encode_piece, PIECE_MEMO)
        self.words = Words(self._encode_word, WORD_MEMO)

    def encode(self, text: str) -> bytes:
        """All ids of a text as little-endian unsigned 32-bit integers."""
        return encode_texts(pa.array([text]), self.words)[0].tobytes()

    def decode(self, ids: np.ndarray) -> bytes:
        return b" ".join(map(self.strings.__getitem__, ids.tolist()))

    def _encode_word(self, word: bytes) -> bytes:
        pieces = cut_word(word)
        if pieces is not None:
            return self._encode_piece(pieces[0]) if len(pieces) == 1 else b"".join([self.pieces[p] for p in pieces])
        word, out = word.decode("utf-8", "replace"), []
        for part in self.special.split(word) if self.special else [word]:
            if part in self.added:
                out.append(self.added[part].to_bytes(4, "little"))
            elif part:
                text = self.rules.normalizer.normalize_str(part)
                out += [self._merge(piece) for piece, _ in self.rules.pre_tokenizer.pre_tokenize_str(text)]
        return b"".join(out)

    def _encode_piece(self, piece: str) -> bytes:
        return self._merge(in_symbols(piece))

    def _merge(self, piece: str) -> bytes:
        """Ids of a piece written in byte-level symbols."""
        symbols = [*piece[:-1], piece[-1] + self.suffix]
        parts = [i for i in map(self.vocab.get, symbols) if i is not None]
        parts = self.merge_short(parts) if len(parts) <= SHORT else self.merge_long(parts)
        return array("I", parts).tobytes()

    def merge_short(self, parts: list[int]) -> list[int]:
        find = self.ranks.get
        ranks = [find(pair, _NONE) for pair in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == _NONE:
                break
            i = ranks.index(least)
            parts[i] = self.merged[least]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = find((parts[i], parts[i + 1]), _NONE)
            if i:
                ranks[i - 1] = find((parts[i - 1], parts[i]), _NONE)
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        find, n = self.ranks.get, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1)
                if (r := find((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = self.merged[rank], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else n
                if left >= 0 and right < n and (r := find((parts[left], parts[right]))) is not None:
                    heapq.heappush(heap, (r, left, parts[left], parts[right]))
        return [p for p in parts if p >= 0]


_loaded: dict[str, Bpe] = {}


def load(path: str, definition: str) -> Bpe:
    """This worker's tokenizer of that path."""
    if path not in _loaded:
        _loaded[path] = Bpe(definition)
    return _loaded[path]


def read_definition(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


_CODED = "doc_id long, ids binary, n_tokens long"


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers) and n_tokens of every row."""
    definition = docs.sparkSession.sparkContext.broadcast(read_definition(path))

    def run(batches):
        bpe = load(path, definition.value)
        for batch in batches:
            for i, j, texts in text_blocks(batch):
                ids, offsets = encode_texts(texts, bpe.words)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i).cast(pa.int64()),
                     pa.array([ids[a:b].tobytes() for a, b in zip(offsets, offsets[1:])], pa.binary()),
                     pa.array(np.diff(offsets))], ["doc_id", "ids", "n_tokens"])

    return docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text")).mapInArrow(run, _CODED)


def decode_documents(coded: DataFrame, path: str) -> DataFrame:
    """doc_id and the decoded text of every row of `encode_documents`."""
    definition = coded.sparkSession.sparkContext.broadcast(read_definition(path))

    def run(batches):
        bpe = load(path, definition.value)
        for batch in batches:
            texts = [bpe.decode(np.frombuffer(i or b"", "<u4")).decode() for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def _checked(docs: DataFrame, path: str, with_ids: bool) -> DataFrame:
    """The ids (or their digest) of every row and the digest of the text decoded from them, in one pass."""
    definition = docs.sparkSession.sparkContext.broadcast(read_definition(path))

    def run(batches):
        bpe = load(path, definition.value)
        for batch in batches:
            for i, j, texts in text_blocks(batch):
                ids, offsets = encode_texts(texts, bpe.words)
                own = [ids[a:b] for a, b in zip(offsets, offsets[1:])]
                coded = pa.array([o.tobytes() for o in own], pa.binary()) if with_ids else pa.array(
                    [hashlib.sha256(o.tobytes()).hexdigest() for o in own], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i).cast(pa.int64()), pa.array(np.diff(offsets)), coded,
                     pa.array([hashlib.sha256(bpe.decode(o)).hexdigest() for o in own], pa.string())],
                    ["doc_id", "n_tokens", "ids" if with_ids else "ids_sha256", "decoded_sha256"])

    return docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text")).mapInArrow(
        run, f"doc_id long, n_tokens long, {'ids binary' if with_ids else 'ids_sha256 string'}, decoded_sha256 string")


def encoded_with_check(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids and the SHA-256 of the text decoded from them, of every row."""
    return _checked(docs, path, True)


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids and of the text decoded from them."""
    return _checked(docs, path, False)
