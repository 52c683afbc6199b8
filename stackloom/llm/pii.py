"""Personal data by anchor expansion.

One Aho-Corasick pass finds at-signs, schemes, plus signs, digits and identifier cues; a deterministic parser at
each anchor expands and validates the span around it. Text without an anchor costs that pass only.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kinds in the order of ties, words that announce an identifier, and what replaces a span.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "account")
CUES = ("token", "secret", "password", "passwd", "api_key", "apikey", "account", "iban")
MASK = {k: f"[{k.upper()}]" for k in KINDS}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_USERINFO = re.compile(r"[^\s/?#@\"'<>]+@[A-Za-z0-9.-]+(?::[0-9]+)?[^\s\"'<>]*")
_VALUE = re.compile(r"(?:[ \t]*[:=#][ \t]*|[ \t]+)[\"']?([A-Za-z0-9_-]{16,})")
# what may stand between the cue of an account and its value, an IBAN in one run or in groups of four, and grouped digits
_LABEL = re.compile(r"(?:[ \t]+(?:number|no|nr)\b\.?)?(?:[ \t]*[:=#][ \t]*|[ \t]+)[\"']?", re.IGNORECASE)
_IBAN = re.compile(r"[A-Za-z]{2}[0-9]{2}(?:[A-Za-z0-9]{11,30}|(?: [A-Za-z0-9]{4}){2,7}(?: [A-Za-z0-9]{1,3})?)(?![A-Za-z0-9])")
_NUMBER = re.compile(r"[0-9]{2,}(?:[ -][0-9]{2,})*(?![A-Za-z0-9])")
_DATE = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9])")
ACCOUNT_DIGITS = (8, 34)


@cache
def _anchors() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for d in "0123456789":
        a.add_word(d, ("digit", 1))
    for word, what in (("@", "at"), ("+", "plus"), ("://", "scheme")):
        a.add_word(word, (what, len(word)))
    for cue in CUES:
        for form in {cue, cue.upper(), cue.capitalize()}:
            a.add_word(form, ("cue", len(form)))
    a.make_automaton()
    return a


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _iban(value: str) -> bool:
    v = value.upper()
    return bool(re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", v)) and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def _account(text: str, at: int, numbers: bool) -> tuple[int, int] | None:
    """The span of an IBAN, longest first, or, with ``numbers``, of a number of 8 to 34 digits, that follows a cue's end."""
    start = m.end() if (m := _LABEL.match(text, at)) else None
    if start is None:
        return None
    if m := _IBAN.match(text, start):
        value = m.group()
        while value:
            if _iban(value.replace(" ", "")):
                return start, start + len(value)
            value = value.rpartition(" ")[0]
    if numbers and not _DATE.match(text, start) and (m := _NUMBER.match(text, start)):
        if ACCOUNT_DIGITS[0] <= sum(c.isdigit() for c in m.group()) <= ACCOUNT_DIGITS[1]:
            return start, m.end()
    return None


def find(text: str | None) -> list[tuple[int, str, int]]:
    """(start, kind, end) in code points, end exclusive, by start and then kind; spans of one kind don't overlap.

    Null and empty texts have none.
    """
    if not text:
        return []
    out: list[tuple[int, str, int]] = []
    done = dict.fromkeys(KINDS, 0)  # where the search for a kind goes on
    for end, (what, n) in _anchors().iter(text):
        at = end - n + 1
        if what == "digit":
            if at >= done["ip"]:
                if m := _IP.match(text, at):
                    done["ip"] = m.end()
                    if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m.group().split(".")):
                        out.append((at, "ip", m.end()))
                else:
                    done["ip"] = _DIGITS.match(text, at).end()
            if at >= done["card"]:
                if m := _CARD.match(text, at):
                    done["card"] = m.end()
                    digits = m.group().replace(" ", "").replace("-", "")
                    if 14 <= len(digits) <= 19 and _luhn(digits):
                        out.append((at, "card", m.end()))
                else:
                    done["card"] = at + 1
        elif what == "at":
            s = at
            while s > done["email"] and text[s - 1] in _LOCAL:
                s -= 1
            if done["email"] <= s < at and (m := _DOMAIN.match(text, at + 1)):
                done["email"] = m.end()
                out.append((s, "email", m.end()))
        elif what == "plus":
            if at >= done["phone"] and (m := _PHONE.match(text, at)):
                done["phone"] = m.end()
                if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                    out.append((at, "phone", m.end()))
        elif what == "scheme":
            s = at
            while s > done["url"] and text[s - 1] in _SCHEME:
                s -= 1
            if done["url"] <= s < at and (m := _USERINFO.match(text, at + 3)):
                done["url"] = m.end()
                out.append((s, "url", m.end()))
        elif at >= done["account"]:
            cue, span = text[at : end + 1].lower(), None
            if m := _VALUE.match(text, end + 1):
                value = m.group(1)
                if _iban(value) if cue == "iban" else any(c.isdigit() for c in value):
                    span = m.start(1), m.end()
            if span is None and cue in ("account", "iban"):
                span = _account(text, end + 1, cue == "account")
            if span:
                done["account"] = span[1]
                out.append((span[0], "account", span[1]))
    out.sort(key=lambda x: (x[0], KINDS.index(x[1])))
    return out


def mask(text: str | None) -> str | None:
    """The text with every span replaced by its kind; spans that overlap are replaced together, by the first one's kind."""
    spans = find(text)
    if not spans:
        return text
    parts, at, i = [], 0, 0
    while i < len(spans):
        start, kind, end = spans[i]
        while i + 1 < len(spans) and spans[i + 1][0] < end:
            i += 1
            end = max(end, spans[i][2])
        parts += [text[at:start], MASK[kind]]
        at, i = end, i + 1
    return "".join([*parts, text[at:]])


def _joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame) -> DataFrame:
    """Counts and spans for each row, whole texts, in place. Repeated rows are scanned each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [find(t.as_py()) for t in b.column(1)]
            base = [[x for x in f if x[1] in BASE_KINDS] for f in found]
            counts = [pa.array([sum(x[1] == k for x in f) for f in base], pa.int64()) for k in BASE_KINDS]
            digest = pa.array([hashlib.sha256(_joined(f).encode()).hexdigest() for f in base], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, digest, pa.array([_joined(f) for f in found], pa.string())], ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with spans masked and n_chars counted anew; every row stays, null texts stay null."""
    names = docs.columns
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = list(b.columns)
            texts = [mask(t.as_py()) for t in b.column(names.index("text"))]
            cols[names.index("text")] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.char_length("text").cast(kinds["n_chars"])) if "n_chars" in kinds else out
