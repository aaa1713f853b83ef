"""Fill-in-middle texts from seekable compressed frames.

``store`` cuts every text into independent Zstandard frames of at most ``FRAME_UNITS`` code points
and keeps how many code points end with each frame. ``transform`` draws the form and the two cuts of
a document from its id alone, finds the frames that hold a cut by the cumulative counts, decompresses
those only, and puts the output together from whole frames as they are stored, the cut pieces and the
marks. ``digests`` streams frames in order, one at a time; the text behind an output is found from
output and form alone, by its marks. No step holds a whole text but the one that first reads it, and
nothing is shuffled. The stored frames are a table in the shared folder, so other seeds or passes
start from them.

Defined results: a missing text is an empty one and stays plain, as does a text that holds a mark; a
missing id draws as the empty string would; repeated rows give the same row each; an empty table
yields no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentatlas.llm.common import arrow_map, blocks, stage, text_of

FRAME_UNITS = 16_384
LEVEL = 1
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Order of marks and of the regions behind them, by form.
ORDERS = {
    "psm": ((PREFIX, "prefix"), (SUFFIX, "suffix"), (MIDDLE, "middle")),
    "spm": ((SUFFIX, "suffix"), (PREFIX, "prefix"), (MIDDLE, "middle")),
}
PLAIN_FROM = 90
SPM_BELOW = 20

STORE = "doc_id long, marked boolean, ends array<long>, frames array<binary>"
OUTPUT = (
    "doc_id long, n long, form string, prefix_chars long, middle_chars long, "
    "ends array<long>, frames array<binary>"
)
DIGESTS = (
    "doc_id long, n long, form string, prefix_chars long, middle_chars long, "
    "output_sha256 string, restored_sha256 string"
)


class Codec:
    """Frames to text and back."""

    def __init__(self) -> None:
        import zstandard

        self.pack = zstandard.ZstdCompressor(level=LEVEL).compress
        self.unpack = zstandard.ZstdDecompressor().decompress
        self.marks = {m: self.pack(m.encode()) for m in (PREFIX, SUFFIX, MIDDLE)}

    def frames(self, text: str, units: int) -> Frames:
        cuts = range(0, len(text), units)
        parts = [text[i : i + units] for i in cuts]
        return Frames(
            list(accumulate(map(len, parts))), [self.pack(p.encode()) for p in parts], self
        )


@dataclass
class Frames:
    """A text as frames: ``ends[i]`` code points end with frame ``i``."""

    ends: list[int]
    frames: list[bytes]
    codec: Codec = field(repr=False)

    def __len__(self) -> int:
        return self.ends[-1] if self.ends else 0

    def add(self, units: int, frame: bytes) -> None:
        if units:
            self.ends.append(len(self) + units)
            self.frames.append(frame)

    def raw(self, k: int) -> bytes:
        return self.codec.unpack(self.frames[k])

    def span(self, start: int, stop: int) -> Iterator[tuple[int, int | None, str]]:
        """(code points, whole frame or None, cut text) of a range; only cut frames are read."""
        if start >= stop:
            return
        for k in range(bisect_right(self.ends, start), bisect_left(self.ends, stop) + 1):
            first = self.ends[k - 1] if k else 0
            a, b = max(start, first) - first, min(stop, self.ends[k]) - first
            if b - a == self.ends[k] - first:
                yield b - a, k, ""
            else:
                yield b - a, None, self.raw(k).decode()[a:b]

    def append_span(self, other: Frames, start: int, stop: int) -> None:
        for units, k, cut in other.span(start, stop):
            self.add(units, self.codec.pack(cut.encode()) if k is None else other.frames[k])

    def hash_into(self, digest, start: int, stop: int) -> None:
        for _, k, cut in self.span(start, stop):
            digest.update(cut.encode() if k is None else self.raw(k))

    def find(self, marks: Sequence[str]) -> list[int]:
        """Place of each mark, in order, each behind the one before; -1 from the first missing on."""
        found, carry, at, marks = [], "", 0, list(marks)
        for k in range(len(self.frames)):
            text = carry + self.raw(k).decode()
            start = at - len(carry)
            here = 0
            while len(found) < len(marks):
                hit = text.find(marks[len(found)], here)
                if hit < 0:
                    break
                found.append(start + hit)
                here = hit + len(marks[0])
            if len(found) == len(marks):
                break
            at = self.ends[k]
            carry = text[max(here, len(text) - len(marks[0]) + 1) :]
        return found + [-1] * (len(marks) - len(found))


def drawn(doc_id: int | None, n: int, marked: bool) -> tuple[str, int, int]:
    """(form, end of the prefix, end of the middle) of a document."""
    seen = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(seen[i : i + 8], 16) for i in range(0, 32, 8)]
    if not n or marked or h[2] % 100 >= PLAIN_FROM:
        return "plain", 0, 0
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    return ("spm" if h[3] % 100 < SPM_BELOW else "psm"), a, b


def rearranged(text: Frames, form: str, a: int, b: int) -> Frames:
    """The output of a form as frames."""
    if form == "plain":
        return text
    spans = {"prefix": (0, a), "middle": (a, b), "suffix": (b, len(text))}
    out = Frames([], [], text.codec)
    for mark, region in ORDERS[form]:
        out.add(len(mark), text.codec.marks[mark])
        out.append_span(text, *spans[region])
    return out


def regions(output: Frames, form: str) -> list[tuple[int, int]]:
    """Where prefix, middle and suffix lie in an output, from its marks alone."""
    if form == "plain":
        return [(0, len(output))]
    order = ORDERS[form]
    places = output.find([mark for mark, _ in order])
    if -1 in places:
        raise ValueError(f"an output of form {form} without its marks")
    stops = [*places[1:], len(output)]
    found = {
        region: (place + len(mark), stop)
        for (mark, region), place, stop in zip(order, places, stops, strict=True)
    }
    return [found[r] for r in ("prefix", "middle", "suffix")]


def store(docs: DataFrame, units: int = FRAME_UNITS, keep: bool = True) -> DataFrame:
    """``doc_id, marked, ends, frames`` of every text; written to the shared folder if ``keep``."""

    def make():
        codec = Codec()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in blocks(batches):
                texts = batch.column("text").to_pylist()
                framed = [codec.frames(t, units) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        pa.array([any(m in t for m in codec.marks) for t in texts], pa.bool_()),
                        pa.array([f.ends for f in framed], pa.list_(pa.int64())),
                        pa.array([f.frames for f in framed], pa.list_(pa.binary())),
                    ],
                    ["doc_id", "marked", "ends", "frames"],
                )

        return run

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    framed = arrow_map(chosen, make, STORE)
    return stage(framed, "frames") if keep else framed


def transform(stored: DataFrame) -> DataFrame:
    """Output frames of every stored text, with form and cuts."""

    def make():
        codec = Codec()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for row in batch.to_pylist():
                    text = Frames(row["ends"], row["frames"], codec)
                    n = len(text)
                    form, a, b = drawn(row["doc_id"], n, row["marked"])
                    out = rearranged(text, form, a, b)
                    cuts = (None, None) if form == "plain" else (a, b - a)
                    rows.append((row["doc_id"], n, form, *cuts, out.ends, out.frames))
                columns = list(zip(*rows, strict=True)) or [()] * 7
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(),
                         pa.list_(pa.int64()), pa.list_(pa.binary())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "ends", "frames"],
                )

        return run

    return arrow_map(stored, make, OUTPUT)


def digests(outputs: DataFrame) -> DataFrame:
    """SHA-256 of every output and of the text that output and form give back."""

    def make():
        codec = Codec()

        def digest(frames: Frames, spans: list[tuple[int, int]]) -> str:
            found = hashlib.sha256()
            for start, stop in spans:
                frames.hash_into(found, start, stop)
            return found.hexdigest()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made, back = [], []
                for row in batch.select(["form", "ends", "frames"]).to_pylist():
                    output = Frames(row["ends"], row["frames"], codec)
                    made.append(digest(output, [(0, len(output))]))
                    back.append(digest(output, regions(output, row["form"])))
                names = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in names),
                     pa.array(made, pa.string()), pa.array(back, pa.string())],
                    [*names, "output_sha256", "restored_sha256"],
                )

        return run

    return arrow_map(outputs, make, DIGESTS)


def texts(outputs: DataFrame) -> DataFrame:
    """``doc_id, form, output``: the outputs as strings, for training."""

    def make():
        codec = Codec()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                whole = [
                    b"".join(map(codec.unpack, frames)).decode()
                    for frames in batch.column("frames").to_pylist()
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("form"), pa.array(whole, pa.string())],
                    ["doc_id", "form", "output"],
                )

        return run

    return arrow_map(outputs, make, "doc_id long, form string, output string")


def oracle_sql() -> str:
    """DuckDB SQL of the query over ``documents``."""
    return """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x
  FROM documents),
h AS (
  SELECT *, CAST('0x' || substr(x, 1, 8) AS UBIGINT) % (n + 1) AS c1,
         CAST('0x' || substr(x, 9, 8) AS UBIGINT) % (n + 1) AS c2,
         CAST('0x' || substr(x, 17, 8) AS UBIGINT) % 100 AS h3,
         CAST('0x' || substr(x, 25, 8) AS UBIGINT) % 100 AS h4
  FROM d),
f AS (
  SELECT *, CAST(least(c1, c2) AS BIGINT) AS a, CAST(greatest(c1, c2) AS BIGINT) AS b,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h)
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t
         WHEN 'psm' THEN '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1)
                         || '<M>' || substr(t, a + 1, b - a)
         ELSE '<S>' || substr(t, b + 1) || '<P>' || substr(t, 1, a)
              || '<M>' || substr(t, a + 1, b - a) END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM f"""
