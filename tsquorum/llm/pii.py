"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust their score.

Base kinds (email, ip, card, phone) are kept whenever their pattern and checksum hold. The other kinds (iban,
ssn, local) must reach ``MIN_SCORE``: their prior, plus or minus what the words around them say.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsquorum.llm.common import released

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "local")
BASE_KINDS = KINDS[:4]
MIN_SCORE = 0.6
#: Characters on either side in which context words count.
REACH = 48

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PLUS = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"\b([A-Z]{2})[0-9]{2}(?=((?: ?[A-Z0-9]){11,30}))")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+.-])(?:\([0-9]{2,4}\) ?|0[0-9]{1,3}[ /-])[0-9]{3,4}[ -][0-9]{3,5}(?![0-9-])")

_PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.9, "phone": 0.8, "iban": 0.9, "ssn": 0.4, "local": 0.4}
#: The lengths of account numbers by country.
_IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22,
    "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24,
    "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SE": 24,
    "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
_FOR = {
    "email": ("mail", "contact", "write to"),
    "ip": ("ip", "host", "address", "server"),
    "card": ("card", "visa", "mastercard", "credit", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "konto", "bankkonto", "kontonummer", "cuenta", "compte"),
    "ssn": ("ssn", "social security", "social-security"),
    "local": ("phone", "tel", "call", "mobile", "fax", "telefon", "telefonnummer", "handy", "handynummer", "teléfono", "téléphone"),
}
_AGAINST = ("version", "isbn", "order no", "serial", "invoice", "part no", "example")


def _any_of(words: tuple[str, ...]) -> re.Pattern[str]:
    return re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, words)) + r")s?(?!\w)")


_CONTEXT, _COUNTER = {kind: _any_of(words) for kind, words in _FOR.items()}, _any_of(_AGAINST)


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for run in _DOTTED.finditer(text):
        parts = [m.span() for m in re.finditer("[0-9]+", run[0])] if run[0].count(".") >= 3 else []
        for i in range(0, len(parts) - 3, 4):
            if all(b - a <= 3 or not run[0][a : b - 3].strip("0") for a, b in parts[i : i + 4]) and all(int(run[0][max(a, b - 3) : b]) <= 255 for a, b in parts[i : i + 4]):
                yield run.start() + parts[i][0], run.start() + parts[i + 3][1]


def _digit_count(text: str) -> int:
    return sum(c.isdigit() for c in text)


def _checked(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans of every kind whose pattern and checksum hold; per kind leftmost and not overlapping."""
    if "@" in text:
        for a, b in _emails(text):
            yield "email", a, b
    if not _DIGIT.search(text):
        return
    if "." in text:
        for a, b in _ips(text):
            yield "ip", a, b
    for m in _DIGITS.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "") if 12 <= m.end() - m.start() <= 37 else ""
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield "card", m.start(), m.end()
    if "+" in text:
        for m in _PLUS.finditer(text):
            if 9 <= _digit_count(m[0]) <= 15:
                yield "phone", m.start(), m.end()
    done = 0
    for m in _IBAN.finditer(text):
        if m.start() < done or not (length := _IBAN_LENGTH.get(m[1])):
            continue
        end, left = m.end(), length - 4
        while left and end < m.end(2):
            left -= text[end] != " "
            end += 1
        whole = not left and not (end < len(text) and (text[end].isalnum() or text[end] == "_"))
        if whole and mod97(text[m.start() : end].replace(" ", "")):
            done = end
            yield "iban", m.start(), end
    if "-" in text:
        for m in _SSN.finditer(text):
            yield "ssn", m.start(), m.end()
    for m in _LOCAL_PHONE.finditer(text):
        yield "local", m.start(), m.end()


_DIGIT = re.compile("[0-9]")


def scored(text: str, kind: str, start: int, end: int) -> float:
    around = (text[max(0, start - REACH) : start] + "\n" + text[end : end + REACH]).lower()
    up = 0.3 if _CONTEXT[kind].search(around) else 0.0
    down = 0.3 if _COUNTER.search(around) else 0.0
    return round(min(1.0, max(0.0, _PRIOR[kind] + up - down)), 2)


def spans_of(text: str | None) -> list[Span]:
    """All spans by start, then kind as listed; offsets in code points, end exclusive. None counts as empty."""
    found = [Span(k, a, b, scored(text, k, a, b)) for k, a, b in _checked(text)] if text else []
    kept = [s for s in found if s.kind in BASE_KINDS or s.score >= MIN_SCORE]
    return sorted(kept, key=lambda s: (s.start, KINDS.index(s.kind)))


def redacted(text: str | None, spans: list[Span]) -> str | None:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first names the whole."""
    if not spans:
        return text
    out, at = [], 0
    merged: list[list] = []
    for s in spans:
        if merged and s.start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], s.end)
        else:
            merged.append([s.start, s.end, s.kind])
    for start, end, kind in merged:
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
SPANS_DDL = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"


def find_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): one row per input row. Null or empty text has no spans; an empty table gives no rows.

    Works row by row on whole texts in one pass without a shuffle; memory is one Arrow batch. Repeated rows and
    null ids are rows like any other; columns other than the two named ones aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[s._asdict() for s in spans_of(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _SPANS)], ["doc_id", "spans"])

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(released(run), f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, spans {SPANS_DDL}")


def redact(docs: DataFrame, *, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The input with spans in ``text_col`` replaced by their kind, and ``length_col``, if there, set to the new length.

    All rows and columns stay; null text stays null (its length isn't touched).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.get_field_index(text_col)
            texts = batch.column(i).to_pylist()
            new = [redacted(t, spans_of(t)) for t in texts]
            batch = batch.set_column(i, batch.schema.field(i), pa.array(new, batch.schema.field(i).type))
            j = batch.schema.get_field_index(length_col) if length_col else -1
            if j >= 0:
                field, old = batch.schema.field(j), batch.column(j).to_pylist()
                lengths = [n if t is None else len(t) for t, n in zip(new, old, strict=True)]
                batch = batch.set_column(j, field, pa.array(lengths, field.type))
            yield batch

    return docs.mapInArrow(released(run), docs.schema)
