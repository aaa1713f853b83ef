"""Personal data: patterns propose spans, checksums confirm them, context words move their score.

Kinds ``email, ip, card, phone`` follow fixed patterns and always stay, whatever their score. The
method adds ``iban`` (mod-97), ``card`` numbers of 13 to 15 digits (Luhn) and ``national_id``; these
need a confirming checksum or context words to reach ``MIN_SCORE``. Offsets are code points.

Defined results: a missing text is an empty one and has no spans; rows are independent, so repeated
rows repeat their result; an empty table yields no rows; texts are read whole and in linear time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentatlas.llm.common import arrow_map, blocks, text_of

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "national_id")
KINDS = BASE_KINDS + ADDED_KINDS
ORDER = {kind: i for i, kind in enumerate(KINDS)}

# Patterns start at the first character of a run and never give characters back where the next one
# rules a match out; both leave the matches as they are and keep the search linear.
EMAIL_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
DIGIT_RUN = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN_START = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}")
IBAN_ANY = r"(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
# Characters of an account number by country, from the IBAN registry. What stands behind that many
# belongs to the text that follows; for other codes as much as the pattern takes counts.
IBAN_LENGTH = {
    country: length
    for length, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK",
        21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
        24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR",
        27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}
IBAN_REST = {
    length: re.compile(
        rf"(?: ?[A-Z0-9]{{4}}){{{length // 4 - 1}}}"
        + (rf" ?[A-Z0-9]{{{length % 4}}}" if length % 4 else "")
        + "(?![A-Za-z0-9])"
    )
    for length in set(IBAN_LENGTH.values())
} | {None: re.compile(IBAN_ANY)}
NATIONAL_ID = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")

#: Characters on either side of a span in which context words count.
CONTEXT_CHARS = 48
CONTEXT_STEP = 0.2
MIN_SCORE = 0.6
# Words near a span that make its kind likelier.
CONTEXT = {
    "email": ("mail", "email", "contact", "write", "reach"),
    "ip": ("ip", "address", "host", "server", "login"),
    "card": ("card", "credit", "visa", "mastercard", "payment", "pay"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "contact"),
    "iban": ("iban", "bank", "account", "transfer", "konto"),
    "national_id": ("ssn", "social", "security", "insurance", "tax"),
}
START_SCORE = {
    "email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "national_id": 0.5,
}
WORD = re.compile(r"[a-z]+")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d)
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def mod97(code: str) -> bool:
    """The account number check: four characters moved behind, letters as numbers, rest 1."""
    moved = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each ``@`` to the left as far as the local part goes, to the right by pattern.

    The local part holds no ``@``, so this is the leftmost non-overlapping match.
    """
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in EMAIL_LOCAL:
            start -= 1
        found = EMAIL_DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
            yield m.span()


def digit_runs(text: str) -> Iterator[tuple[int, int, str]]:
    for m in DIGIT_RUN.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield (*m.span(), digits)


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 8 <= sum(map(str.isdigit, m.group())) <= 15:
            yield m.span()


def accounts(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers of their country's length; the search goes on behind each start that fails."""
    end = 0
    for m in IBAN_START.finditer(text):
        if m.start() < end:
            continue
        rest = IBAN_REST[IBAN_LENGTH.get(m.group()[:2])].match(text, m.end())
        if rest and mod97(text[m.start() : rest.end()].replace(" ", "")):
            end = rest.end()
            yield m.start(), end


def context_score(text: str, kind: str, start: int, end: int) -> float:
    """The kind's own score plus a step for each distinct context word nearby, at most 1."""
    near = f"{text[max(0, start - CONTEXT_CHARS):start]} {text[end:end + CONTEXT_CHARS]}".lower()
    words = set(WORD.findall(near))
    hits = sum(w in words for w in CONTEXT[kind])
    return min(1.0, round(START_SCORE[kind] + CONTEXT_STEP * hits, 2))


def find(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, spans the method adds), by kind and start. Added spans overlap no base span."""
    base: list[tuple[str, int, int]] = []
    extra: list[tuple[str, int, int]] = []
    if "@" in text:
        base += [("email", *s) for s in emails(text)]
    base += [("ip", *s) for s in addresses(text)]
    for start, end, digits in digit_runs(text):
        (base if len(digits) >= 16 else extra).append(("card", start, end))
    if "+" in text:
        base += [("phone", *s) for s in phones(text)]
    extra += [("iban", *s) for s in accounts(text)]
    if "-" in text:
        extra += [("national_id", *m.span()) for m in NATIONAL_ID.finditer(text)]

    def scored(found: list[tuple[str, int, int]]) -> list[Span]:
        found.sort(key=lambda s: (ORDER[s[0]], s[1]))
        return [Span(*s, context_score(text, *s)) for s in found]

    taken = sorted((s, e) for _, s, e in base)
    free = [x for x in extra if not _overlaps(taken, x[1], x[2])]
    return scored(base), [s for s in scored(free) if s.score >= MIN_SCORE]


def _overlaps(taken: list[tuple[int, int]], start: int, end: int) -> bool:
    return any(s < end and start < e for s, e in taken)


def masked(text: str, spans: list[Span]) -> str:
    """Each span replaced by its kind in angle brackets; overlapping spans by the first one."""
    out, at = [], 0
    for span in sorted(spans, key=lambda s: (s.start, -s.end)):
        if span.start < at:
            at = max(at, span.end)
            continue
        out += [text[at : span.start], f"<{span.kind.upper()}>"]
        at = span.end
    return "".join([*out, text[at:]])


SPANS = "doc_id long, base array<struct<kind:string,start:int,end:int,score:double>>, " \
    "added array<struct<kind:string,start:int,end:int,score:double>>"
SPAN_TYPE = pa.list_(pa.struct([
    ("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()),
]))


def find_spans(docs: DataFrame) -> DataFrame:
    """``doc_id``, base spans and added spans of every whole text."""

    def run(batches):
        for batch in blocks(batches):
            found = [find(t) for t in batch.column("text").to_pylist()]
            rows = [[[s._asdict() for s in side] for side in pair] for pair in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([r[0] for r in rows], SPAN_TYPE),
                    pa.array([r[1] for r in rows], SPAN_TYPE),
                ],
                names=["doc_id", "base", "added"],
            )

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return arrow_map(chosen, lambda: run, SPANS)


def digest(spans: list[dict]) -> str:
    return ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in spans)


def span_digests(found: DataFrame) -> DataFrame:
    """Counts and digests of the spans of ``find_spans``."""
    text = F.transform(
        F.col("base"), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    )
    merged = F.array_sort(
        F.concat("base", "added"),
        lambda a, b: F.when(_rank(a) != _rank(b), _rank(a) - _rank(b)).otherwise(
            a["start"] - b["start"]
        ),
    )
    every = F.transform(merged, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    counts = [
        F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{k}") for k in BASE_KINDS
    ]
    return found.select(
        "doc_id", *counts,
        F.sha2(F.array_join(text, ","), 256).alias("base_sha256"),
        F.array_join(every, ",").alias("spans"),
        F.size("added").alias("n_added"),
    )


def _of_kind(kind):
    return lambda span: span["kind"] == kind


def _rank(span):
    return F.array_position(F.array(*[F.lit(k) for k in KINDS]), span["kind"]).cast("int")


def base_sha256(spans: list[Span]) -> str:
    return hashlib.sha256(digest([s._asdict() for s in spans]).encode()).hexdigest()


def mask_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of every text replaced, ``n_chars`` corrected, all columns kept.

    A missing text stays missing.
    """
    columns = docs.columns
    text_at = columns.index("text")

    def run(batches):
        for batch in blocks(batches):
            texts = [
                t if t is None else masked(t, [s for side in find(t) for s in side])
                for t in batch.column(text_at).to_pylist()
            ]
            yield batch.set_column(
                text_at, batch.schema.field(text_at), pa.array(texts, batch.schema.types[text_at])
            )

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn(
            "n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(
                F.char_length("text").cast(kind)
            ),
        )
    return out
