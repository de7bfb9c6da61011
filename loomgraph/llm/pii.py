"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

Base kinds are e-mail and IP addresses, card numbers (Luhn) and phone numbers: the
leftmost non-overlapping matches of each kind's pattern, those failing its check
dropped. Base spans always stay; their score tells how sure they are. Two further
kinds are added where the score reaches ``LEAST``: IBANs (mod-97 and the length
their country has) and US social security numbers (valid areas, and only near a
word that says so). Offsets count code points, ends are exclusive.

Null and empty texts have no spans. Patterns are anchored so that long runs of
digits, word characters or separators cost linear time: an e-mail is looked for at
each ``@``, from the start of the run before it, and digit runs are never retried
from their middle, where the pattern would fail again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import given_back, read, small_batches

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
LEAST = 0.6
NEAR = 40

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_ANY = re.compile(r"[0-9@]")
_DIGITS = re.compile(r"[^0-9]")

# fixed values: IBAN lengths by country, as published in the registry
_IBAN_LENGTH = {
    "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27,
    "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IT": 27, "LT": 20, "LU": 20, "LV": 21, "MT": 31, "NL": 18, "NO": 15,
    "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24, "TR": 26,
}

# fixed values: words that make a kind likelier when they stand near
_CONTEXT = {
    "email": re.compile(r"mail|contact|kontakt|correo|courriel|write", re.I),
    "ip": re.compile(r"\bip\b|address|host|server|adresse", re.I),
    "card": re.compile(r"card|visa|credit|karte|tarjeta|carte|payment", re.I),
    "phone": re.compile(r"phone|call|tel\b|mobile|fax|telefon|tel[eé]fono|t[eé]l[eé]phone", re.I),
    "iban": re.compile(r"iban|bank|account|konto|cuenta|compte", re.I),
    "ssn": re.compile(r"\bssn\b|social security", re.I),
}
# fixed values: score of a span that passed its pattern and check
_PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.4}


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _AT.match(text, at) if start < at else None
        done = found.end() if found else at + 1
        if found:
            yield start, done
        at = text.find("@", done)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    while found := _IP.search(text, at):
        at = found.end()
        parts = [p.lstrip("0") for p in found[0].split(".")]  # cut first: int() takes no run of thousands of digits
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
            yield found.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for found in _CARD.finditer(text):
        digits = _DIGITS.sub("", found[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield found.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" in text:
        for found in _PHONE.finditer(text):
            if 9 <= len(_DIGITS.sub("", found[0])) <= 15:
                yield found.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    for found in _IBAN.finditer(text):
        want = _IBAN_LENGTH.get(found[0][:2])
        end = found.start()
        for n in range(want or 0):
            end += (n > 0 and text[end : end + 1] == " ") + 1
        body = text[found.start() : end].replace(" ", "")
        if want and end <= found.end() and len(body) == want and not text[end : end + 1].isalnum() and mod97(body):
            yield found.start(), end


def _ssns(text: str) -> Iterator[tuple[int, int]]:
    for found in _SSN.finditer(text):
        yield found.span()


_FINDERS = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones, "iban": _ibans, "ssn": _ssns}


def find(text: str | None) -> list[Span]:
    """Spans by kind as in KINDS, then by start."""
    if not text or not _ANY.search(text):
        return []
    out = []
    for kind in KINDS:
        for start, end in _FINDERS[kind](text):
            near = text[max(0, start - NEAR) : start] + "\n" + text[end : end + NEAR]
            score = _PRIOR[kind] + (1 - _PRIOR[kind]) / 2 * bool(_CONTEXT[kind].search(near))
            if kind in BASE or score >= LEAST:
                out.append(Span(kind, start, end, score))
    return out


def redact(text: str, spans: list[Span]) -> str:
    """text with each span, or run of overlapping spans, replaced by the first's kind in angle brackets."""
    out, done = [], 0
    for kind, start, end, _ in sorted(spans, key=lambda s: (s.start, -s.end)):
        if start >= done:
            out += [text[done:start], f"<{kind}>"]
        done = max(done, end)
    return "".join([*out, text[done:]])


SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"


def detect(df: DataFrame, text: str = "text", redacted: bool = False) -> DataFrame:
    """df with ``pii_spans``; with ``redacted``, the text column holds the redacted text and n_chars, if there, its length."""
    small_batches(df.sparkSession)
    names = [c for c in df.columns if c != "pii_spans"]
    schema = StructType([*(df.schema[c] for c in names), *StructType.fromDDL(f"pii_spans {SPANS}")])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
    which = names.index(text)
    counted = names.index("n_chars") if redacted and "n_chars" in names else None

    @given_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            columns = list(x.columns)
            texts = columns[which].to_pylist()
            found = [find(t) for t in texts]
            if redacted and any(found):
                texts = [redact(t, s) if s else t for t, s in zip(texts, found, strict=True)]
                columns[which] = pa.array(texts, columns[which].type)
                if counted is not None:
                    old = columns[counted].to_pylist()
                    columns[counted] = pa.array([len(t) if s else n for t, s, n in zip(texts, found, old, strict=True)], columns[counted].type)
            spans = pa.array([[s._asdict() for s in f] for f in found], kind)
            yield pa.RecordBatch.from_arrays([*columns, spans], [*names, "pii_spans"])

    return df.select(*names).mapInArrow(run, schema)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_pii(spark, sf_dir: str) -> DataFrame:
    found = detect(read(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))).select("doc_id", "pii_spans")
    spans = F.col("pii_spans")

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter(spans, lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *(count(k) for k in BASE), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(spans).alias("spans"), *(count(k) for k in KINDS[len(BASE) :]))
