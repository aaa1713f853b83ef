"""Toxicity by a factorization machine over hashed terms.

A text becomes a set of hashed terms: its words and their beginnings, each with how often it occurs
(at least once, twice, four and eight times), a row of a table of fixed size. A linear weight per row
and a vector per row, whose inner products weigh every pair of terms, give the log-odds; pairs that
matter only together need no weight of their own, so no term is left out for telling little alone. The
model is fitted on a bounded sample of labelled rows, in one task. It has the rows that the sample
uses, at most ``TERMS``: below 50 megabytes whatever the corpus.

Defined results: a missing text scores as an empty one; repeated rows repeat their score, and of the
rows of a labelled id one is learned from, that with the smallest hash of its text; an empty
table yields no rows; without a positive and a negative label every score is the share of positive
ones (0 without labels); texts of any length are read whole; further columns are ignored.
"""

from __future__ import annotations

import io
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentatlas.llm.common import arrow_map, blocks, give_back, text_of
from rentatlas.llm.labelled import SAMPLE_ROWS, is_held_out, training_rows

THRESHOLD = 0.3
BITS = 18
LEVELS = (1, 2, 4, 8)
PREFIXES = (3, 4, 5, 6)
#: Rows of the table.
TERMS = len(LEVELS) << BITS
RANK = 8
EPOCHS = 30
BATCH = 512
WORD = re.compile(r"\w+")
#: Longest step of a weight and of a vector's number.
RATE = (0.05, 0.005)
#: A weight needs a mean slope beyond this: about half a text of a batch.
L1 = np.float32(1e-3)
DECAY = (np.float32(1e-4), np.float32(1e-3))
#: Words a worker remembers the terms of, none of them longer than ``LONGEST_REMEMBERED``.
CACHED_WORDS = 100_000
LONGEST_REMEMBERED = 64


def word_terms(word: str) -> tuple[int, ...]:
    """Hash buckets of a word and of its beginnings."""
    terms = [word, *(f"{word[:n]}-" for n in PREFIXES if len(word) > n)]
    return tuple(zlib.crc32(t.encode()) & ((1 << BITS) - 1) for t in terms)


def text_terms(text: str, known: dict[str, tuple[int, ...]] | None = None) -> np.ndarray:
    """All (bucket, level) numbers of a text, sorted; ``known`` keeps the buckets of words."""
    known = {} if known is None else known
    if len(known) > CACHED_WORDS:
        known.clear()
    words = Counter(WORD.findall(text.lower()))
    if not words:
        return np.zeros(0, np.int64)
    terms = []
    for word in words:
        found = known.get(word)
        if found is None:
            found = word_terms(word)
            if len(word) <= LONGEST_REMEMBERED:
                known[word] = found
        terms.append(found)
    sizes = np.fromiter(map(len, terms), np.int64, len(terms))
    each = np.fromiter(chain.from_iterable(terms), np.int64, int(sizes.sum()))
    counts = np.repeat(np.fromiter(words.values(), np.int64, len(terms)), sizes)
    bucket, place = np.unique(each, return_inverse=True)
    times = np.bincount(place, counts)
    levels = [bucket[times >= at] * len(LEVELS) + i for i, at in enumerate(LEVELS)]
    return np.sort(np.concatenate(levels))


@dataclass
class Machine:
    """``terms`` sorted; linear ``weights``; ``vectors`` with a row per term."""

    terms: np.ndarray
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def score(self, active: list[int] | np.ndarray) -> float:
        """Probability for the active terms, given by their places in ``terms``."""
        z = self.bias
        if len(active):
            v = self.vectors[active]
            total = v.sum(0)
            z += self.weights[active].sum() + 0.5 * float((total * total - (v * v).sum(0)).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(
            out, terms=self.terms, bias=self.bias, weights=self.weights, vectors=self.vectors
        )
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Machine:
        held = np.load(io.BytesIO(data))
        return cls(held["terms"], float(held["bias"]), held["weights"], held["vectors"])


def constant(share: float) -> Machine:
    share = min(max(share, 1e-9), 1 - 1e-9)
    empty = np.zeros((0, RANK), np.float32)
    return Machine(
        np.zeros(0, np.int64), float(np.log(share / (1 - share))), np.zeros(0, np.float32), empty
    )


def rows_of(docs: list[np.ndarray], terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The used rows of the table; places in them, text by text; and where each text begins."""
    used = np.zeros(terms, bool)
    if terms < TERMS:
        docs = [np.unique(found % terms) for found in docs]
    for found in docs:
        used[found] = True
    place = np.cumsum(used, dtype=np.int32) - 1
    starts = np.concatenate([[0], np.cumsum([len(f) for f in docs], dtype=np.int64)])
    places = np.empty(starts[-1], np.int32)
    for found, a, b in zip(docs, starts.tolist(), starts[1:].tolist(), strict=False):
        places[a:b] = place[found]
    return np.flatnonzero(used), places, starts


def fit(
    docs: list[np.ndarray], labels: np.ndarray, terms: int = TERMS, rank: int = RANK,
    epochs: int = EPOCHS, seed: int = 7,
) -> Machine:
    """Logistic loss, mini-batches with momentum; L1 on the weights, decay on the vectors.

    Steps are in proportion to the slopes, with one scale for all weights and one for all vectors: a
    scale per row would let terms of single texts learn those texts by heart. Weights see terms less
    their share of texts, so that terms of nearly all texts do not swing together; what that shifts
    goes to the bias at the end.
    """
    labels = np.asarray(labels, np.float32)
    share = float(labels.mean()) if len(labels) else 0.0
    if not 0 < share < 1:
        return constant(share)
    used, places, starts = rows_of(docs, terms)
    n_rows = len(used)
    usual = (np.bincount(places, minlength=n_rows) / len(docs)).astype(np.float32)
    rng = np.random.default_rng(seed)
    bias = np.array([np.log(share / (1 - share)), 0, 0])  # with its two moments
    # Columns of the table: the weights, then the vectors.
    held = [np.zeros(n_rows, np.float32)]
    held += list(rng.normal(0, 0.01, (rank, n_rows)).astype(np.float32))
    first = [np.zeros(n_rows, np.float32) for _ in held]
    scale = np.zeros(2)  # mean square of the largest slope of weights and of vectors
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), BATCH):
            pick = np.sort(order[at : at + BATCH])
            sizes = starts[pick + 1] - starts[pick]
            text = np.repeat(np.arange(len(pick)), sizes)
            active = places[
                np.repeat(starts[pick] - np.cumsum(sizes) + sizes, sizes) + np.arange(len(text))
            ]

            def by_text(values: np.ndarray) -> np.ndarray:
                return np.bincount(text, values[active], len(pick))

            def by_row(values: np.ndarray) -> np.ndarray:
                return np.bincount(active, values[text], n_rows).astype(np.float32)

            weights, vectors = held[0], held[1:]
            total = [by_text(v) for v in vectors]
            z = bias[0] - float(usual @ weights)
            z = z + by_text(weights - 0.5 * sum(v * v for v in vectors))
            z += 0.5 * sum(t * t for t in total)
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[pick]) / len(pick)
            gap, back = float(error.sum()), by_row(error)
            slopes = [back - usual * np.float32(gap) + DECAY[0] * weights]
            slopes += [
                by_row(error * t) - v * back + DECAY[1] * v
                for v, t in zip(vectors, total, strict=True)
            ]
            step += 1
            ahead = (1 - 0.9**step, 1 - 0.999**step)
            most = np.array([np.abs(slopes[0]).max(), max(np.abs(g).max() for g in slopes[1:])])
            scale = 0.999 * scale + 0.001 * most * most
            unit = np.sqrt(scale / ahead[1]) + 1e-12
            for i, slope in enumerate(slopes):
                first[i] = 0.9 * first[i] + 0.1 * slope
                stride = np.float32(RATE[min(i, 1)] / unit[min(i, 1)])
                held[i] = held[i] - stride * first[i] / np.float32(ahead[0])
                if i == 0:
                    held[0] = np.sign(held[0]) * np.maximum(np.abs(held[0]) - stride * L1, 0)
            bias[1:] = 0.9 * bias[1] + 0.1 * gap, 0.999 * bias[2] + 0.001 * gap * gap
            bias[0] -= RATE[0] * (bias[1] / ahead[0]) / (np.sqrt(bias[2] / ahead[1]) + 1e-8)
    return Machine(used, float(bias[0] - usual @ held[0]), held[0], np.stack(held[1:], 1))


def sample_terms(sample: DataFrame) -> DataFrame:
    """``doc_id, key, label, terms`` of labelled texts, one row for each id: the smallest key's.

    Terms are made where the texts are, so the fitting task receives numbers and no text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}
        for batch in blocks(batches):
            found = [
                text_terms(t, known).astype("<i4").tobytes()
                for t in batch.column("text").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), batch.column("label"),
                 pa.array(found, pa.binary())],
                names=["doc_id", "key", "label", "terms"],
            )

    keyed = sample.select("doc_id", F.xxhash64("text").alias("key"), "label", "text")
    rows = arrow_map(keyed, lambda: run, "doc_id long, key long, label int, terms binary")
    one = F.min(F.struct("key", "label", "terms")).alias("one")
    return rows.groupBy("doc_id").agg(one).select("doc_id", "one.*")


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Machine:
    """Fit on the bounded sample in one task; only the model comes to the driver."""

    def fit_all(sample: pa.Table) -> pa.Table:
        sample = sample.sort_by([("doc_id", "ascending"), ("key", "ascending")])
        found = [np.frombuffer(t.as_buffer(), "<i4") for t in sample["terms"]]
        made = fit(found, sample["label"].to_numpy()).dump()
        del found, sample
        give_back()
        return pa.table({"model": pa.array([made], pa.binary())})

    sample = sample_terms(training_rows(docs, labels, "toxic", rows)).withColumn("all", F.lit(0))
    made = sample.groupBy("all").applyInArrow(fit_all, "model binary").collect()
    return Machine.load(bytes(made[0].model)) if made else constant(0.0)


class Scorer:
    """Scores texts; remembers the buckets of words it has met."""

    def __init__(self, machine: Machine):
        self.machine = machine
        self.place = np.full(TERMS, -1, np.int32)
        self.place[machine.terms] = np.arange(len(machine.terms), dtype=np.int32)
        self.words: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str) -> float:
        active = self.place[text_terms(text, self.words)]
        return self.machine.score(active[active >= 0])


def score_documents(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    chosen = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        is_held_out(F.col("doc_id")).alias("held_out"), text_of().alias("text"),
    )

    def make():
        scorer = Scorer(machine)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in blocks(batches):
                scores = [scorer(t) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"), batch.column("held_out"),
                        pa.array(scores, pa.float64()),
                        pa.array([int(s >= threshold) for s in scores], pa.int32()),
                    ],
                    names=["doc_id", "held_out", "score", "predicted"],
                )

        return run

    return arrow_map(chosen, make, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(machine)
        for batch in blocks(batches):
            keep = [scorer(t or "") < threshold for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return arrow_map(docs, lambda: run, docs.schema)
