"""Substring dedup by content-defined chunking.

A gear hash rolls over the bytes of a text; the text is cut behind white space where the hash of the last
sixteen bytes is small; where ``LONG_WORD`` bytes held no white space, as in Chinese, Japanese, Thai
or minified code, it is cut between any two characters by the same rule. A cut depends on the bytes
before it alone, so an insertion shifts chunks but leaves those behind it as they are. Chunks meet by
digest: of the texts that hold one, the text with the smallest key keeps it. A text loses each run of
such chunks that is at least ``MIN_WORDS`` words long, or as long in bytes as that many words of
``WORD_BYTES``; shorter repeats, such as a line of boilerplate, stay.

Defined results: a missing text stays missing and has no chunks; rows equal in id and text count as
one text and keep or lose the same; repeats within one text stay; an empty table yields no rows; texts
of any length are read whole; further columns pass through ``drop_repeats`` untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentatlas.llm.common import arrow_map, blocks

#: A candidate less than this many bytes behind another one is no cut.
MIN_BYTES = 16
#: Stretches without a candidate are cut into pieces of this size.
MAX_BYTES = 512
#: One white space in about so many is a candidate.
SPACES_PER_CUT = 5
#: Bytes without white space behind which a text is cut between characters.
LONG_WORD = 64
#: One character boundary in about so many is a candidate there.
CHARS_PER_CUT = 16
#: Words a repeated run must have to be dropped.
MIN_WORDS = 16
#: A run of fewer words is dropped if it has so many bytes for each of ``MIN_WORDS``; words that
#: stand between white space are shorter on average.
WORD_BYTES = 16
WINDOW = 16


def gear_table() -> np.ndarray:
    """256 16-bit numbers by the splitmix rule."""
    z = (np.arange(1, 257, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) & np.uint64(0xFFFF)).astype(np.uint16)


GEAR = gear_table()
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """Rolling hash at every byte: ``h = 2 h + gear[byte]`` in 16 bits, by doubling spans."""
    h = GEAR[data]
    span = 1
    while span < WINDOW:
        shifted = np.zeros_like(h)
        shifted[span:] = h[:-span] << np.uint16(span)
        h = h + shifted
        span *= 2
    return h


class Cuts(NamedTuple):
    """Chunks of a block of texts as byte ranges of ``data``, in order; ``doc`` is their text."""

    data: bytes
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def digests(self, of: np.ndarray | None = None) -> list[bytes]:
        view = memoryview(self.data)
        start, end = (a if of is None else a[of] for a in (self.start, self.end))
        make = hashlib.blake2b
        return [
            make(view[a:b], digest_size=16).digest()
            for a, b in zip(start.tolist(), end.tolist(), strict=True)
        ]


def inside_words(
    data: np.ndarray, space: np.ndarray, hashes: np.ndarray, bounds: np.ndarray
) -> np.ndarray:
    """Last bytes of characters that are candidates as no white space stands shortly before them."""
    out = np.zeros(len(data), bool)
    edge = np.zeros(len(data) + 1, bool)
    edge[1:] = space
    edge[bounds] = True
    edges = np.flatnonzero(edge)
    for i in np.flatnonzero(np.diff(edges) > LONG_WORD).tolist():
        start, end = int(edges[i]) + LONG_WORD - 1, int(edges[i + 1])
        new = np.ones(end - start, bool)  # the next byte begins a character
        after = data[start + 1 : end + 1]
        new[: len(after)] = (after & 0xC0) != 0x80
        out[start:end] = new & ~space[start:end] & (hashes[start:end] < 0x10000 // CHARS_PER_CUT)
    return out


def cut(texts: list[str | None]) -> Cuts:
    """Chunks of each text, the same whatever other texts the block holds."""
    encoded = [(t or "").encode() for t in texts]
    raw = b"".join(encoded)
    data = np.frombuffer(raw, np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(e) for e in encoded], dtype=np.int64)])
    if not len(data):
        none = np.zeros(0, np.int64)
        return Cuts(raw, none, none, none)
    hashes, space = gear_hashes(data), SPACE[data]
    at_space = space & (hashes < 0x10000 // SPACES_PER_CUT)
    candidate = np.flatnonzero(at_space | inside_words(data, space, hashes, bounds)) + 1
    doc = np.searchsorted(bounds, candidate - 1, "right") - 1
    inside = candidate - bounds[doc] >= WINDOW  # elsewhere the hash reaches into the text before
    candidate, doc = candidate[inside], doc[inside]
    before = np.concatenate([[0], candidate[:-1]])
    before = np.maximum(before, bounds[doc])
    candidate = candidate[(candidate - before >= MIN_BYTES) & (candidate < bounds[doc + 1])]

    edges = np.unique(np.concatenate([candidate, bounds]))
    gaps = np.diff(edges)
    pieces = -(-gaps // MAX_BYTES)
    if (pieces > 1).any():
        first = np.repeat(edges[:-1], pieces)
        step = np.arange(len(first)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        inner = first + step * MAX_BYTES
        for _ in range(3):  # to the next character; edges stand at one already
            inner = inner + ((data[np.minimum(inner, len(data) - 1)] & 0xC0) == 0x80)
        edges = np.unique(np.concatenate([inner, edges]))
    start, end = edges[:-1], edges[1:]
    return Cuts(raw, np.searchsorted(bounds, start, "right") - 1, start, end)


def row_key(id_column: str = "doc_id", text: str = "text") -> Column:
    return F.xxhash64(F.col(f"`{id_column}`"), F.col(f"`{text}`"))


CHUNKS = "digest binary, row_key long, place int"


def chunk_rows(docs: DataFrame) -> DataFrame:
    """``digest, row_key, place`` of every chunk of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            cuts = cut(batch.column("text").to_pylist())
            keys = batch.column("row_key").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(cuts.digests(), pa.binary()), pa.array(keys[cuts.doc]),
                    pa.array(_places(cuts.doc).astype(np.int32)),
                ],
                names=["digest", "row_key", "place"],
            )

    chosen = docs.select(row_key().alias("row_key"), "text").where(F.col("text").isNotNull())
    return arrow_map(chosen, lambda: run, CHUNKS)


def _places(doc: np.ndarray) -> np.ndarray:
    """0, 1, 2 ... within each text."""
    if not len(doc):
        return doc
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    return np.arange(len(doc)) - np.repeat(first, np.diff(np.append(first, len(doc))))


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """``row_key, places``: the chunks of a text that other texts hold, with who keeps them.

    Smallest and largest key of a digest are partial aggregates; the join back can split a digest
    that very many texts share. Only the chunks of one text are gathered in one row; equal rows
    have the same hits, which the set holds once.
    """
    chunks = chunk_rows(docs)
    shared = (
        chunks.groupBy("digest")
        .agg(F.min("row_key").alias("keeper"), F.max("row_key").alias("last"))
        .where(F.col("keeper") != F.col("last"))
        .drop("last")
    )
    hits = chunks.join(shared, "digest").select(
        "row_key",
        F.struct("place", (F.col("row_key") == F.col("keeper")).alias("kept"),
                 F.substring("digest", 1, 8).alias("check")).alias("hit"),
    )
    return hits.groupBy("row_key").agg(F.collect_set("hit").alias("hits"))


def runs(
    cuts: Cuts, chosen: np.ndarray, min_words: int = MIN_WORDS
) -> list[tuple[int, int, int]]:
    """(text, start, end) in bytes of each run of chosen neighbouring chunks that is long enough."""
    if not len(chosen):
        return []
    breaks = np.flatnonzero(
        (np.diff(chosen) != 1) | (cuts.doc[chosen[1:]] != cuts.doc[chosen[:-1]])
    )
    firsts = chosen[np.concatenate([[0], breaks + 1])]
    lasts = chosen[np.concatenate([breaks, [len(chosen) - 1]])]
    out = []
    for a, b in zip(firsts.tolist(), lasts.tolist(), strict=True):
        start, end = int(cuts.start[a]), int(cuts.end[b])
        if (
            end - start >= min_words * WORD_BYTES
            or len(cuts.data[start:end].split()) >= min_words
        ):
            out.append((int(cuts.doc[a]), start, end))
    return out


class Found(NamedTuple):
    """What a text loses: the text that stays, code point ranges dropped, ranges it keeps for all."""

    text: str | None
    dropped: list[tuple[int, int]]
    kept: list[tuple[int, int]]


def apply_hits(texts: list[str | None], hits: list, min_words: int = MIN_WORDS) -> list[Found]:
    """The texts without their repeated runs. A hit counts only if the digest is its chunk's."""
    at = [i for i, h in enumerate(hits) if h]
    out = [Found(t, [], []) for t in texts]
    if not at:
        return out
    cuts = cut([texts[i] for i in at])
    first = np.searchsorted(cuts.doc, np.arange(len(at) + 1))
    dropped, kept = [], []
    for d, i in enumerate(at):
        for hit in hits[i]:
            c = first[d] + hit["place"]
            if c < first[d + 1]:
                (kept if hit["kept"] else dropped).append((int(c), hit["check"]))
    found = {}
    for name, pairs in (("dropped", dropped), ("kept", kept)):
        chunk = np.array([c for c, _ in pairs], np.int64)
        real = [x[:8] == y for x, (_, y) in zip(cuts.digests(chunk), pairs, strict=True)]
        found[name] = runs(cuts, np.unique(chunk[np.array(real, bool)]), min_words)
    base = cuts.start[first[:-1]].tolist() if len(cuts.start) else []
    for d, i in enumerate(at):
        text, ranges = texts[i], {}
        raw = text.encode()
        for name, spans in found.items():
            mine = [(a - base[d], b - base[d]) for doc, a, b in spans if doc == d]
            ranges[name] = [(len(raw[:a].decode()), len(raw[:b].decode())) for a, b in mine]
            if name == "dropped":
                rest, end = [], 0
                for a, b in mine:
                    rest.append(raw[end:a])
                    end = b
                text = b"".join([*rest, raw[end:]]).decode()
        out[i] = Found(text, ranges["dropped"], ranges["kept"])
    return out


def _with_hits(docs: DataFrame) -> DataFrame:
    """``docs`` as one struct beside the repeated chunks of its text."""
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumn(
        "row_key", F.xxhash64(F.col("row.doc_id"), F.col("row.text"))
    )
    return keyed.join(repeated_chunks(docs), "row_key", "left")


def drop_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with repeated passages cut out of its texts and ``n_chars`` corrected."""
    columns, schema = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("row")
            fields = dict(zip(columns, rows.flatten(), strict=True))
            small = pa.RecordBatch.from_pydict({"text": fields["text"], "row": pa.array(
                range(len(rows)))})
            for part in blocks([small]):
                at = part.column("row").to_numpy()
                span = slice(int(at[0]), int(at[-1]) + 1)
                found = apply_hits(
                    part.column("text").to_pylist(),
                    batch.column("hits")[span].to_pylist(), min_words,
                )
                out = [fields[c][span] for c in columns]
                texts = pa.array([f.text for f in found], fields["text"].type)
                out[columns.index("text")] = texts
                if "n_chars" in fields:
                    old = out[columns.index("n_chars")].to_pylist()
                    n = [o if f.text is None else len(f.text) for o, f in zip(old, found, strict=True)]
                    out[columns.index("n_chars")] = pa.array(n, fields["n_chars"].type)
                yield pa.RecordBatch.from_arrays(out, names=columns)

    return arrow_map(_with_hits(docs).select("row", "hits"), lambda: run, schema)


RESULT = (
    "doc_id long, text string, n_dropped long, dropped string, n_kept long, kept string"
)


def find_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Per row: the text that stays, the ranges dropped from it and the ranges kept for others."""

    def spelled(ranges: list[tuple[int, int]]) -> str:
        return ",".join(f"{a}:{b}" for a, b in ranges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            found = apply_hits(
                batch.column("text").to_pylist(), batch.column("hits").to_pylist(), min_words
            )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([f.text for f in found], pa.string()),
                    pa.array([sum(b - a for a, b in f.dropped) for f in found], pa.int64()),
                    pa.array([spelled(f.dropped) for f in found], pa.string()),
                    pa.array([sum(b - a for a, b in f.kept) for f in found], pa.int64()),
                    pa.array([spelled(f.kept) for f in found], pa.string()),
                ],
                names=["doc_id", "text", "n_dropped", "dropped", "n_kept", "kept"],
            )

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = _with_hits(chosen).select("row.doc_id", "row.text", "hits")
    return arrow_map(rows, lambda: run, RESULT)
