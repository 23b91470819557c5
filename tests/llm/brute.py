"""Plain Python forms of the operators' contracts, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def token_files(docs, tokenizer):
    start, out = 0, {}
    for i, text in sorted(docs):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        out[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    return out


def substrings(docs, window=50):
    words = {i: WORD.findall(t or "") for i, t in docs}
    first = {}
    for i, w in sorted(words.items()):
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k:k + window]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k:k + window])] < i:
                gone.update(range(k, k + window))
        out[i] = (len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def shingle_set(text, lower_case=True, n=5):
    w = WORD.findall(lower(text or "") if lower_case else text or "")
    if not w:
        return set()
    return {tuple(w)} if len(w) < n else {tuple(w[k:k + n]) for k in range(len(w) - n + 1)}


def components(docs, links):
    parent = {i: i for i, _ in docs}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in parent}


def jaccard(docs):
    sets = {i: shingle_set(t) for i, t in docs}
    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    common = Counter()
    for ids in where.values():
        for x in range(len(ids)):
            for y in range(x + 1, len(ids)):
                common[ids[x], ids[y]] += 1
    links = [(a, b) for (a, b), n in common.items() if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n)]
    comp = components(docs, links)
    return {i: (len(s), comp[i]) for i, s in sets.items()}


def exact(docs):
    groups = defaultdict(list)
    for i, t in docs:
        groups[t or ""].append(i)
    return {i: (max(groups[t or ""]), len(groups[t or ""]), i == max(groups[t or ""]), sha(t or "")) for i, t in docs}


def bpe(docs, tokenizer):
    out = {}
    for i, t in docs:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        out[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                  sha(tokenizer.decode(ids, skip_special_tokens=False)))
    return out


def edited(docs):
    order = sorted(docs, reverse=True)
    out = {}
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1] or ""
        t = t or ""
        n = len(t) // 2
        out[i] = (len(t), sha(t[:len(t) - n] + after[:n]))
    return out


def targets(sizes: dict, weights=(1, 2, 3), most=3):
    """Target of each source; None is last in order."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = [s for s in rest if share[s] >= most * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: most * sizes[s] for s in over}
        if len(fixed) == len(names):
            return fixed


def merkle(rows, fan=3):
    """{row index: (leaf, subroot, root, proof_sha256, folded_root)} of rows (doc_id, source, lang, n_chars, text)."""
    def enc(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def h(parts):
        return sha("".join(parts))

    def tamper(r):
        hit = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
        return r[4].replace("\n", "") if hit else r[4]

    def tree(hashes):
        out = [hashes]
        while len(out[-1]) > 1:
            now = out[-1]
            out.append([h(now[k:k + fan]) for k in range(0, len(now), fan)])
        return out

    def climb(levels, k, folded):
        siblings = ""
        for now in levels[:-1]:
            first = k - k % fan
            run = now[first:first + fan]
            siblings += "".join(x for j, x in enumerate(run) if first + j != k)
            folded = h([folded if first + j == k else x for j, x in enumerate(run)])
            k //= fan
        return siblings, folded

    leaf = {i: h([enc(v) for v in r]) for i, r in enumerate(rows)}
    bad = {i: h([enc(v) for v in (*r[:4], tamper(r))]) for i, r in enumerate(rows)}
    by_source = defaultdict(list)
    for i, r in enumerate(rows):
        by_source[r[1]].append(i)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees, subroot = {}, {}
    for s in names:
        by_source[s].sort(key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, leaf[i]))
        trees[s] = tree([leaf[i] for i in by_source[s]])
        subroot[s] = trees[s][-1][0]
    top = tree([subroot[s] for s in names]) if names else [[None]]
    out = {}
    for t, s in enumerate(names):
        for k, i in enumerate(by_source[s]):
            low, folded = climb(trees[s], k, bad[i])
            high, folded = climb(top, t, folded)
            out[i] = (leaf[i], subroot[s], top[-1][0], sha(low + high), folded)
    return out


def pii_base(text):
    """Base spans of the contract with Python's `re`, unguarded: (kind, start, end) by start, then kind."""
    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
             ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"),
             ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]
    out = []
    for order, (kind, pattern) in enumerate(kinds):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card":
                total = sum(int(c) if k % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c))
                            for k, c in enumerate(reversed(digits)))
                if not 12 <= len(digits) <= 19 or total % 10:
                    continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), order, kind, m.end()))
    return [(k, a, b) for a, _, k, b in sorted(out)]


def alignment(docs, path_a, path_b):
    """{row index: (n_a, n_b, n_groups, n_links, n_best, count_sum, groups)} with plain Python loops."""
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(path_a)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=path_b)
    keep = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or 174 <= c <= 255]
    rest = [c for c in range(256) if c not in keep]
    back = {chr(c): c for c in keep} | {chr(256 + k): c for k, c in enumerate(rest)}

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    per_row, pairs = [], Counter()
    for _, t in docs:
        target = (" " + (t or "")).encode()
        ta = a.encode(" " + (t or ""), add_special_tokens=False).ids if t else []
        tb = b.encode(t) if t else []
        bytes_a = [bytes(back[c] for c in a.id_to_token(i)) for i in ta]
        bytes_b = [piece(i) for i in tb]
        if not t or b"".join(bytes_a) != target or b"".join(bytes_b) != target:
            per_row.append(None)
            continue
        ends_a, ends_b, x, y = {}, {}, 0, 0
        for i, tok in zip(ta, bytes_a):
            x += len(tok)
            ends_a[x] = i
        for i, tok in zip(tb, bytes_b):
            y += len(tok)
            ends_b[y] = i
        links = [(ends_a[e], ends_b[e]) for e in sorted(set(ends_a) & set(ends_b))]
        groups, ga, gb, cur_a, cur_b = [], [], [], 0, 0
        cuts = sorted(set(ends_a) & set(ends_b))
        pos_a, pos_b = sorted(ends_a), sorted(ends_b)
        for c in cuts:
            ga = [ends_a[e] for e in pos_a if cur_a < e <= c]
            gb = [ends_b[e] for e in pos_b if cur_b < e <= c]
            groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
            cur_a = cur_b = c
        pairs.update(links)
        per_row.append((len(ta), len(tb), len(cuts), links, ";".join(groups)))
    best = defaultdict(int)
    for (x, y), n in pairs.items():
        best[y] = max(best[y], n)
    out = {}
    for k, row in enumerate(per_row):
        if row is None:
            out[k] = (0, 0, 0, 0, 0, 0, "")
            continue
        na, nb, ng, links, groups = row
        out[k] = (na, nb, ng, len(links), sum(pairs[l] == best[l[1]] for l in links), sum(pairs[l] for l in links),
                  sha(groups))
    return out
