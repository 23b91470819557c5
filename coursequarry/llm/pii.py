"""Personal data in texts: regular expressions propose spans, checksums confirm them, context words score them.

Base kinds, each scanned on its own, leftmost and without overlap, as Python's `finditer` does; a match that fails
its check is dropped and the scan goes on after it (no retry inside it):

- email: the pattern alone;
- ip: four dotted numbers, each at most 255;
- card: 12 to 19 digits (spaces or hyphens between) that pass the Luhn check;
- phone: `+` and 9 to 15 digits.

The method adds spans of further kinds where a checksum or the words just before them confirm them:

- iban: two letters, two check digits and 11 to 30 letters or digits (single spaces allowed) whose mod-97
  remainder is 1;
- phone_local: a ten-digit national number, kept only when a context word (phone, call, ...) stands within
  `CONTEXT_CHARS` code points before it;
- ssn: `ddd-dd-dddd` with a valid area, group and serial, kept only with a context word (ssn, social security).

Every span carries a score: its kind's prior plus `CONTEXT_BOOST` where a context word of its kind is near. Added
spans are kept from `KEEP_SCORE` on; base spans always stay, and an added span that overlaps a base span or a
better added one goes. Offsets are in code points, ends exclusive; spans are ordered by start, then kind in the
order of `KINDS`.

Edge cases: a null text is scanned as empty (no spans); a null doc_id is carried as null; repeated rows give
equal rows; very long texts are scanned in linear time (the email and ip patterns only start where their run of
characters starts or where the last match ended, which finds the same leftmost matches); extra columns of the
caller are not read.

Spark reads the documents, hands Arrow batches of (doc_id, text) to `mapInPandas`, and the scan of one text is a
small Python helper; the result is an array of span structs per row.
"""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

# The base patterns and their limits.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
CARD_DIGITS = (12, 19)
PHONE_DIGITS = (9, 15)
IP_PART_MAX = 255

KINDS = ("email", "ip", "card", "phone", "iban", "phone_local", "ssn")
BASE = KINDS[:4]
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.9, "phone": 0.8, "iban": 0.8, "phone_local": 0.3, "ssn": 0.3}
CONTEXT_BOOST = 0.4
KEEP_SCORE = 0.6
CONTEXT_CHARS = 40
CONTEXT_WORDS = {
    "email": ("email", "e-mail", "mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "credit", "visa", "mastercard", "amex", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "cell", "fax", "whatsapp", "contact"),
    "iban": ("iban", "account", "bank", "transfer", "wire"),
    "phone_local": ("phone", "tel", "call", "mobile", "cell", "fax", "whatsapp", "contact"),
    "ssn": ("ssn", "social security", "social-security"),
}

# The email and ip patterns may only start where their run of characters starts or at the end of the last match
# (`\G`): a match starting inside a run implies one starting at its first character, so the leftmost matches are
# the same, and a long run without a match is read once instead of once per character.
_SCANS = {
    "email": regex.compile(r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"),
    "ip": regex.compile(r"(?:\G|(?<![0-9]))[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"),
    "card": regex.compile(CARD),
    "phone": regex.compile(PHONE),
    "iban": regex.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])"),
    "phone_local": regex.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
    "ssn": regex.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
}
_CONTEXT = {k: regex.compile(r"(?<![a-z])(?:" + "|".join(regex.escape(w) for w in v) + r")(?![a-z])")
            for k, v in CONTEXT_WORDS.items()}

SPAN = "struct<kind:string,start:long,end:long,score:double,base:boolean>"
SCHEMA = f"_pii_doc long, spans array<{SPAN}>"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if k % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def mod97(code: str) -> bool:
    moved = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def confirmed(kind: str, found: str) -> bool:
    """Whether a proposed span passes its kind's check."""
    if kind == "ip":
        return all(int(p) <= IP_PART_MAX for p in found.split("."))
    if kind == "card":
        d = _digits(found)
        return CARD_DIGITS[0] <= len(d) <= CARD_DIGITS[1] and luhn(d)
    if kind in ("phone", "phone_local"):
        d = _digits(found)
        return PHONE_DIGITS[0] <= len(d) <= PHONE_DIGITS[1]
    if kind == "iban":
        return mod97(found.replace(" ", ""))
    if kind == "ssn":
        area, group, serial = found.split("-")
        return area not in ("000", "666") and area[0] != "9" and group != "00" and serial != "0000"
    return True


def _score(kind: str, text: str, start: int) -> float:
    near = text[max(0, start - CONTEXT_CHARS):start].lower()
    return round(min(1.0, PRIOR[kind] + (CONTEXT_BOOST if _CONTEXT[kind].search(near) else 0.0)), 6)


def scan(text: str | None) -> list[tuple[str, int, int, float, bool]]:
    """All spans of one text as (kind, start, end, score, base), ordered by start, then kind."""
    text = text or ""
    spans = []
    for kind in KINDS:
        for m in _SCANS[kind].finditer(text):
            if confirmed(kind, m.group()):
                spans.append((kind, m.start(), m.end(), _score(kind, text, m.start()), kind in BASE))
    base = [s for s in spans if s[4]]
    kept = list(base)
    for s in sorted((s for s in spans if not s[4] and s[3] >= KEEP_SCORE), key=lambda s: (-s[3], s[1], KINDS.index(s[0]))):
        if all(s[2] <= o[1] or o[2] <= s[1] for o in kept):
            kept.append(s)
    return sorted(kept, key=lambda s: (s[1], KINDS.index(s[0])))


def _batches(frames):
    for pdf in frames:
        yield pd.DataFrame({
            "_pii_doc": pdf["_pii_doc"],
            "spans": [[{"kind": k, "start": a, "end": b, "score": c, "base": base} for k, a, b, c, base in scan(t)]
                      for t in pdf["_pii_text"]]})


def find_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) for every row of `docs`: the spans of its text, base and added, in order."""
    rows = docs.select(F.col("doc_id").cast("long").alias("_pii_doc"), F.col("text").cast("string").alias("_pii_text"))
    return rows.mapInPandas(_batches, SCHEMA).withColumnRenamed("_pii_doc", "doc_id")


def joined(spans, base_only: bool = False):
    """`kind:start:end` of the spans (base ones only, if asked), comma-joined in their order."""
    chosen = F.filter(spans, lambda s: s["base"]) if base_only else spans
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def counted(spans, kind: str):
    return F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == kind))).cast("long")
