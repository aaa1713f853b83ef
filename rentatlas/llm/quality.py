"""Quality rules: counts over whole texts and boosted trees over the statistics they give.

Trees are fitted by histograms on a bounded sample of labelled rows. Splits on features that only
ever speak against a text keep its score falling as they rise (monotonic constraints). The fitted
trees are flattened into node arrays, so scoring is a few vectorised steps per tree.

Words are runs of characters other than ASCII white space. Defined results: a missing text has no
words; repeated rows repeat their result; an empty table yields no rows; without both labels the
trees keep everything; texts of any length are read whole; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentatlas.llm.common import arrow_map, blocks, text_of
from rentatlas.llm.labelled import SAMPLE_ROWS, training_rows

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
THRESHOLD = 0.5

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (
    "log_words", "word_length", "symbols", "dup_lines", "repeats", "distinct", "upper", "digits",
    "stops", "shouts", "line_words", "longest", "top_word", "other_marks",
)
#: -1: the score may not rise with the feature.
CONSTRAINTS = {"symbols": -1, "dup_lines": -1, "repeats": -1, "upper": -1, "shouts": -1}

SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


def _table(chars: bytes) -> np.ndarray:
    found = np.zeros(256, bool)
    found[np.frombuffer(chars, np.uint8)] = True
    return found


CLASSES = {
    "space": SPACE,
    "symbols": _table(SYMBOLS),
    "upper": _table(bytes(range(65, 91))),
    "digits": _table(bytes(range(48, 58))),
    "stops": _table(b".?"),
    "shouts": _table(b"!"),
    "other": _table(b"\"'()/:;=@[]^_`{}~+-,"),
}


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def repeated_words(words: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """Per text, words inside a three-word window that the text holds twice or more."""
    if len(words) < 3:
        return np.zeros(docs, np.int64)
    w = words.astype(np.uint64)
    mix = (w[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (w[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F))
    mix ^= (mix >> np.uint64(29)) + w[2:] * np.uint64(0x165667B19E3779F9)
    mix = (mix + doc[:-2].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
    order = np.argsort(mix, kind="stable")
    order = order[doc[order] == doc[order + 2]]  # a window lies within one text
    same = np.ones(max(len(order) - 1, 0), bool)
    for shift in range(3):
        same &= words[order[:-1] + shift] == words[order[1:] + shift]
    same &= doc[order[:-1]] == doc[order[1:]]
    twice = np.zeros(len(words), bool)
    starts = np.unique(np.concatenate([order[:-1][same], order[1:][same]]))
    for shift in range(3):
        twice[starts + shift] = True
    return np.bincount(doc[twice], minlength=docs)


def measure(texts: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """(the counts, the features) of each text of a block."""
    n = len(texts)
    texts = texts.cast(pa.large_string())
    data = np.frombuffer(b"".join(b.as_py() for b in texts.cast(pa.large_binary())), np.uint8)
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(size)])
    of = {name: _sums(table[data], bounds) for name, table in CLASSES.items()}
    chars = _sums((data & 0xC0) != 0x80, bounds)

    split = pc.ascii_split_whitespace(texts)
    coded = split.flatten().dictionary_encode()
    ids = coded.indices.to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(n), np.diff(split.offsets.to_numpy()))
    spelled = pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False)
    real = spelled[ids] > 0 if len(ids) else np.zeros(0, bool)
    ids, doc = ids[real], doc[real]
    words = np.bincount(doc, minlength=n)

    lines = pc.split_pattern(texts, "\n")
    flat = lines.flatten()
    line_doc = np.repeat(np.arange(n), np.diff(lines.offsets.to_numpy()))
    full = pc.binary_length(pc.ascii_trim_whitespace(flat)).to_numpy(zero_copy_only=False) > 0
    line_ids = flat.dictionary_encode().indices.to_numpy().astype(np.int64)[full]
    line_doc = line_doc[full]
    n_lines = np.bincount(line_doc, minlength=n)
    once = np.unique(line_doc * (line_ids.max(initial=0) + 1) + line_ids)
    distinct_lines = np.bincount(once // (line_ids.max(initial=0) + 1), minlength=n)

    pairs, times = np.unique(doc * (ids.max(initial=0) + 1) + ids, return_counts=True)
    pair_doc = pairs // (ids.max(initial=0) + 1)
    top, longest = np.zeros(n), np.zeros(n)
    np.maximum.at(top, pair_doc, times)
    np.maximum.at(longest, doc, spelled[ids] if len(ids) else [])

    counts = {
        "n_words": words, "word_chars": chars - of["space"], "n_symbols": of["symbols"],
        "n_dup_lines": n_lines - distinct_lines,
        "n_repeat_words": repeated_words(ids, doc, n),
    }
    w, c, one = np.maximum(words, 1), np.maximum(chars, 1), np.maximum(n_lines, 1)
    features = np.column_stack([
        np.log1p(words), counts["word_chars"] / w, of["symbols"] / w,
        counts["n_dup_lines"] / one, counts["n_repeat_words"] / w,
        np.bincount(pair_doc, minlength=n) / w, of["upper"] / c, of["digits"] / c,
        of["stops"] / w, of["shouts"] / w, words / one, np.minimum(longest, 200), top / w,
        of["other"] / w,
    ])
    return counts, features


@dataclass
class Trees:
    """Complete binary trees as arrays: ``feature, cut, value`` with a row per tree.

    Node ``i`` goes on to ``2 i + 1`` if its feature is at most the cut, else to ``2 i + 2``.
    """

    start: float
    depth: int
    feature: np.ndarray = field(default_factory=lambda: np.zeros((0, 1), np.int32))
    cut: np.ndarray = field(default_factory=lambda: np.zeros((0, 1)))
    value: np.ndarray = field(default_factory=lambda: np.zeros((0, 1)))

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            total += value[at]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -30, 30)))


def fit(
    x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2,
    bins: int = 64, ridge: float = 1.0, least: int = 20,
    constraints: dict[str, int] = CONSTRAINTS,
) -> Trees:
    """Second-order boosting on histograms.

    A split that would break a constraint is not taken; the middle of its two values bounds all
    leaves below either side, so that later splits keep the order too.
    """
    share = float(np.mean(y)) if len(y) else 1.0
    if not 0 < share < 1:
        return Trees(30.0 if share else -30.0, depth)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    coded = np.column_stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)])
    sign = np.array([constraints.get(name, 0) for name in FEATURES[: x.shape[1]]])
    start = float(np.log(share / (1 - share)))
    out = Trees(start, depth)
    z = np.full(len(y), start)
    made: list[tuple[np.ndarray, ...]] = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        slope, curve = p - y, p * (1 - p)
        nodes = 2 ** (depth + 1) - 1
        feature, cut = np.zeros(nodes, np.int32), np.full(nodes, np.inf)
        value = np.zeros(nodes)
        low, high = np.full(nodes, -np.inf), np.full(nodes, np.inf)
        at = np.zeros(len(y), np.int64)
        for node in range(nodes):
            here = np.flatnonzero(at == node)
            g, h = slope[here].sum(), curve[here].sum()
            value[node] = np.clip(-g / (h + ridge), low[node], high[node])
            if node >= nodes // 2 or not len(here):
                if node < nodes // 2:
                    value[2 * node + 1] = value[2 * node + 2] = value[node]
                continue
            found = _best_split(coded[here], slope[here], curve[here], cuts, sign, ridge, least,
                                (low[node], high[node]))
            left, right = 2 * node + 1, 2 * node + 2
            low[left] = low[right] = low[node]
            high[left] = high[right] = high[node]
            if found is None:
                at[here] = left
                continue
            f, b, left_value, right_value = found
            feature[node], cut[node] = f, cuts[f][b]
            at[here] = np.where(coded[here, f] <= b, left, right)
            if sign[f]:
                middle = (left_value + right_value) / 2
                if sign[f] < 0:
                    low[left], high[right] = middle, middle
                else:
                    high[left], low[right] = middle, middle
        value *= rate
        z += value[at]
        made.append((feature, cut, value))
    out.feature, out.cut, out.value = (np.array(part) for part in zip(*made, strict=True))
    return out


def _best_split(coded, slope, curve, cuts, sign, ridge, least, bound):
    g, h = slope.sum(), curve.sum()
    best, found = 1e-6, None
    for f, edges in enumerate(cuts):
        size = len(edges) + 1
        if size < 2:
            continue
        gl = np.cumsum(np.bincount(coded[:, f], slope, size))[:-1]
        hl = np.cumsum(np.bincount(coded[:, f], curve, size))[:-1]
        nl = np.cumsum(np.bincount(coded[:, f], minlength=size))[:-1]
        gr, hr = g - gl, h - hl
        left = np.clip(-gl / (hl + ridge), *bound)
        right = np.clip(-gr / (hr + ridge), *bound)
        gain = (
            -(gl * left + 0.5 * (hl + ridge) * left**2)
            - (gr * right + 0.5 * (hr + ridge) * right**2)
            - 0.5 * g * g / (h + ridge)
        )
        ok = (nl >= least) & (len(coded) - nl >= least) & (sign[f] * (right - left) >= 0)
        gain = np.where(ok, gain, -np.inf)
        at = int(np.argmax(gain))
        if gain[at] > best:
            best, found = gain[at], (f, at, left[at], right[at])
    return found


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Trees:
    """Fit on the features of the bounded sample, the only rows that come to the driver."""
    sample = training_rows(docs, labels, "quality", rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            features = measure(batch.column("text"))[1]
            values = pa.array(list(features), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), values], ["doc_id", "label", "x"]
            )

    held = sample.mapInArrow(run, "doc_id long, label int, x array<double>").toArrow()
    held = held.sort_by("doc_id")
    if not len(held):
        return Trees(30.0, 1)
    x = np.array(held["x"].to_pylist(), float)
    return fit(x, held["label"].to_numpy().astype(float))


RESULT = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, base_failed boolean, kept boolean, score double"
)


def judge_documents(docs: DataFrame, trees: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """Counts, rules and verdict of every row."""
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            counts, features = measure(batch.column("text"))
            score = trees.score(features)
            failed = (counts["n_words"] < MIN_WORDS) | (
                100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * counts["n_words"]
            )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    *(pa.array(counts[c].astype(np.int64)) for c in COUNTS),
                    pa.array(failed), pa.array(~failed & (score >= threshold)), pa.array(score),
                ],
                names=["doc_id", *COUNTS, "base_failed", "kept", "score"],
            )

    return arrow_map(chosen, lambda: run, RESULT)
