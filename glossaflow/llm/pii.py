"""Personal data: patterns propose, checksums confirm, near words adjust.

Every kind has a pattern that proposes spans, a validator that confirms them,
and a prior score. Words within ``CONTEXT_CHARS`` code points before or after a
span raise or lower the score. The four base kinds (email, ip, card, phone) keep
every confirmed span whatever its score; the added kinds (iban by mod-97, ssn,
phone numbers without a plus sign, and secrets: long runs of letters and digits
as random as keys are) are kept at ``THRESHOLD`` or more. An ssn, phone number
or secret that overlaps a base span is dropped; an iban is confirmed by itself
and stays beside it.

Defined cases: a null text is empty and has no spans; repeated rows have equal spans, a row each; a text has any number of
equal spans; spans are in code points with an exclusive end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame

from glossaflow.plans.scratch import bounded_batches

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "local_phone", "secret")
CONTEXT_CHARS = 40
THRESHOLD = 0.6

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A run of digits either starts a match at its first digit or nowhere, so the
# lookbehind changes no match and keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_TEL = re.compile(r"(?<![0-9+().-])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9-])")
_SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,200}={0,2}(?![A-Za-z0-9+/_-])")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[a-z]+")

PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.7, "iban": 0.7, "ssn": 0.4, "local_phone": 0.35, "secret": 0.35}
SUPPORT = {
    "email": {"mail", "email", "contact", "write"},
    "ip": {"ip", "address", "host", "server"},
    "card": {"card", "visa", "mastercard", "credit", "payment"},
    "phone": {"phone", "tel", "call", "mobile", "fax"},
    "iban": {"iban", "account", "bank", "transfer"},
    "ssn": {"ssn", "social", "security"},
    "local_phone": {"phone", "tel", "call", "mobile", "fax", "telephone"},
    "secret": {"token", "secret", "password", "passwd", "key", "apikey", "auth", "bearer", "credential", "credentials"},
}
CONFIRMED = ("card", "iban")  # by a checksum, which no word beside them outvotes
DOUBT = {"version", "order", "isbn", "page", "token", "invoice", "example"}
DOUBT_SECRET = {"commit", "checksum", "digest", "hash", "sha", "md", "version", "example"}


def luhn_ok(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97_ok(iban: str) -> bool:
    flat = iban.replace(" ", "")
    return 15 <= len(flat) <= 34 and int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """The longest part of each candidate, from its start to the end of a group, that passes mod-97."""
    m = _IBAN.search(text)
    while m:
        start, groups = m.start(), m[0]
        while groups and not mod97_ok(groups):
            groups = groups.rpartition(" ")[0]
        if groups:
            yield start, start + len(groups)
        m = _IBAN.search(text, start + max(1, len(groups)))


def random_enough(run: str) -> bool:
    """Letters and digits mixed, and as many different ones as a key of this length has."""
    if run.isalpha() or run.isdigit():
        return False
    share = [run.count(c) / len(run) for c in set(run)]
    return -sum(p * log2(p) for p in share) >= min(3.0, 0.75 * log2(len(run)))


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the email pattern, tried only around each ``@``."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _EMAIL.match(text, start) if start < at else None
        if m:
            yield m.span()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _proposed(text: str, numeric: bool) -> Iterator[tuple[str, int, int]]:
    if "@" in text:
        for a, b in emails(text):
            yield "email", a, b
    if not numeric:
        return
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            yield "ip", *m.span()
    for m in _CARD.finditer(text):
        if len(m[0]) >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn_ok(d):
            yield "card", *m.span()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                yield "phone", *m.span()
    for a, b in ibans(text):
        yield "iban", a, b
    for m in _SSN.finditer(text):
        if m[0][:3] not in ("000", "666") and m[0][4:6] != "00" and m[0][7:] != "0000":
            yield "ssn", *m.span()
    for m in _TEL.finditer(text):
        if 9 <= len(_digits(m[0])) <= 11:
            yield "local_phone", *m.span()
    for m in _SECRET.finditer(text):
        if random_enough(m[0].rstrip("=")):
            yield "secret", *m.span()


def score(kind: str, text: str, start: int, stop: int) -> float:
    around = text[max(0, start - CONTEXT_CHARS) : start], text[stop : stop + CONTEXT_CHARS]
    near = {w for part in around for w in _WORD.findall(part.lower())}
    doubt = set() if kind in CONFIRMED else DOUBT_SECRET if kind == "secret" else DOUBT
    return min(1.0, max(0.0, PRIOR[kind] + 0.3 * bool(near & SUPPORT[kind]) - 0.2 * bool(near & doubt)))


def find_spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by start, then kind as listed in KINDS."""
    text = text or ""
    numeric = _DIGIT.search(text) is not None
    found = [(k, a, b, score(k, text, a, b)) for k, a, b in _proposed(text, numeric)]
    taken = [(a, b) for k, a, b, _ in found if k in BASE]
    apart = lambda x: x[0] == "iban" or not any(a < x[2] and x[1] < b for a, b in taken)
    found = [x for x in found if x[0] in BASE or x[3] >= THRESHOLD and apart(x)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def spans_of(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id and an array of spans with scores."""
    bounded_batches(docs.sparkSession)
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [[{"kind": k, "start": s, "stop": e, "score": p} for k, s, e, p in find_spans(t)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(span))], names=["doc_id", "spans"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,stop:bigint,score:double>>")

