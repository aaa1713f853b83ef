"""Exact Jaccard join of word 4-gram sets by vertical partitioning.

Global order: all shingles are ordered from rare to frequent. How frequent one is comes from a table
of ``2 ** COUNTER_BITS`` counters that all documents are counted into (a fixed size; two shingles that
share a counter only share their place in the order, results never depend on it). A shingle's number
carries its frequency class in the top bits, so sorting numbers sorts by the global order.

Candidates: two sets of similarity ``PERCENT`` share a shingle within their first
``n - ceil(PERCENT n / 100) + 1`` shingles, and the first one they share leaves enough behind it in
both. Equal sets are one set from here on. Sets meet by such a shingle and a class of sizes. Each set goes
to the home of the smallest set it meets, and homes are cut into blocks of bounded size. Blocks whose sets meet
are compared, and a comparison is sent the sets that meet there: a task holds their first shingles and
writes, in one row, the pairs that pass. A pair passes if all it shares among its first shingles and
all that is left behind them is enough for a link; few pairs that share a shingle by chance do.

Vertical counting: the global order is cut into ``FRAGMENTS`` ranges that hold about equally many
shingle occurrences. Each pair of blocks counts the partial overlaps of its candidate pairs in each
fragment apart, then the partial overlaps are summed per pair and held against the threshold. Only a
forest of the links leaves the task, so a group of near copies costs as many rows as it has members.

Defined results: a missing text, and one without words, has no shingle, is alone and its own
component; equal texts and rows with equal ids are linked; a component is named by its smallest id,
null only if none of its rows has an id; an empty table yields no rows; further columns are ignored.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentatlas.llm.common import arrow_map, blocks, counter_table, stage, text_of
from rentatlas.llm.minhash import components, mixed

SHINGLE = 4
PERCENT = 85
COUNTER_BITS = 22
FRAGMENTS = 8
#: Sets and shingles that a block of a home holds about.
BLOCK_SETS = 1_024
BLOCK_SHINGLES = 1_000_000
#: A spot with more sets to a block than this has its blocks compared as wholes.
CROWDED = 4
#: Bits of a shingle's number below its frequency class.
HASH_BITS = 58
#: Size of the table that marks wanted texts, and of the slices it is put together from, as powers of two.
MARK_BITS = 26
MARK_SLICE = 16

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

U = np.uint64
M1 = U(0x9E3779B97F4A7C15)


def _staged(df: DataFrame, name: str) -> DataFrame:
    """``stage``; the shuffle files of the finished step go at once, not when the driver's memory is full."""
    out = stage(df, name)
    gc.collect()
    df.sparkSession._jvm.System.gc()
    return out


# -- shingles


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of words of each text); A-Z count as a-z."""
    split = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    coded = split.flatten().dictionary_encode()
    different = [w.translate(LOWER) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, different), U, len(different))
    real = np.fromiter(map(bool, different), bool, len(different))
    at = coded.indices.to_numpy()
    keep = real[at] if len(at) else np.zeros(0, bool)
    owner = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
    return hashes[at[keep]], np.bincount(owner[keep], minlength=len(texts))


def shingle_hashes(texts: pa.Array) -> list[np.ndarray]:
    """Distinct 64-bit shingle hashes of each text, ascending."""
    words, n_words = word_hashes(texts)
    windows = np.where(n_words > 0, np.maximum(n_words - (SHINGLE - 1), 1), 0)
    first = np.cumsum(n_words) - n_words
    start = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows - first, windows)
    last = np.repeat(first + n_words, windows)
    h = np.zeros(len(start), U)
    for k in range(SHINGLE):
        here = start + k
        word = words[np.minimum(here, len(words) - 1)] if len(words) else words
        h = np.where(here < last, mixed(h * M1 + word + U(k)), h)
    out = []
    for part in np.split(h, np.cumsum(windows)[:-1]):
        part.sort()
        out.append(part[np.concatenate([[True], part[1:] != part[:-1]])] if len(part) > 1 else part)
    return out


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches, limit=2_000_000):
        for at in range(0, batch.num_rows, 1 << 15):
            yield batch.slice(at, 1 << 15)


# -- global order


def count_table(texts: DataFrame) -> np.ndarray:
    """How many texts have shingles on each counter."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for part in parts(batches):
            for found in shingle_hashes(part.column("text")):
                yield (found >> U(64 - COUNTER_BITS)).astype(np.int64)

    return counter_table(texts, COUNTER_BITS, places)


def classes_of(table: np.ndarray) -> np.ndarray:
    """A frequency class per counter, two for each doubling: 0 to 63."""
    return np.minimum(np.floor(2 * np.log2(np.maximum(table, 1))), 63).astype(np.uint8)


def pivots_of(table: np.ndarray, classes: np.ndarray, fragments: int = FRAGMENTS) -> np.ndarray:
    """Numbers at which the global order is cut, so that fragments hold equal occurrences."""
    mass = np.bincount(classes, table, 64)
    ends = np.cumsum(mass)
    out = []
    for k in range(1, fragments):
        want = ends[-1] * k / fragments
        c = min(int(np.searchsorted(ends, want)), 63)
        inside = (want - (ends[c] - mass[c])) / mass[c] if mass[c] else 0.0
        out.append((c << HASH_BITS) + min(int(inside * 2.0**HASH_BITS), (1 << HASH_BITS) - 1))
    return np.array(out, U)


def numbered(shingles: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Numbers of shingles in the global order, ascending."""
    top = classes[(shingles >> U(64 - COUNTER_BITS)).astype(np.int64)].astype(U) << U(HASH_BITS)
    out = top | (shingles >> U(64 - HASH_BITS))
    out.sort()
    return out


def head_length(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1


# -- candidates

SETS = "doc_id long, h1 long, h2 long, h3 long, id long, check long, size int, head array<long>"


def sets_of(texts: DataFrame, classes: np.ndarray) -> DataFrame:
    """The set of every row: its name (``id``, ``check``), size and first shingles."""
    sent = texts.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            found = [numbered(s, sent.value) for s in shingle_hashes(part.column("text"))]
            raw = [f.tobytes() for f in found]
            names = [
                np.array([f(r, seed=7) for r in raw], U).view(np.int64)
                for f in (xxhash.xxh64_intdigest, xxhash.xxh3_64_intdigest)
            ]
            heads = [f[: head_length(len(f))] if len(f) else f for f in found]
            flat = np.concatenate(heads) if heads else np.zeros(0, U)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in heads])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    *(part.column(c) for c in ("doc_id", "h1", "h2", "h3")),
                    pa.array(names[0]), pa.array(names[1]),
                    pa.array([len(f) for f in found], pa.int32()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64))),
                ],
                ["doc_id", "h1", "h2", "h3", "id", "check", "size", "head"],
            )

    return arrow_map(texts, lambda: run, SETS)


def shared_heads(sets: DataFrame) -> DataFrame:
    """``shingle, id, size, at``: first shingles that several sets hold.

    Where two sets alone hold a shingle and their sizes lie too far apart for a link, it is left out.
    Counting and joining use one exchange of the rows (so the same columns of it); both stream through a
    shingle's rows and hold none of them.
    """
    place = F.shiftleft(F.col("size").cast("long"), 32).bitwiseOR(F.col("at").cast("long"))
    rows = sets.select("id", "size", F.posexplode("head").alias("at", "shingle")).select(
        "shingle", "id", place.alias("place")
    ).repartition(_tasks(sets), "shingle")
    size = F.shiftright("place", 32).cast("int")
    held = rows.groupBy("shingle").agg(
        F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n"),
        F.min("place").alias("least"), F.max("place").alias("most"),
    )
    near = 100 * F.shiftright("least", 32) >= PERCENT * F.shiftright("most", 32)
    held = held.where((F.col("low") != F.col("high")) & ((F.col("n") > 2) | near)).select("shingle")
    return rows.join(held.hint("merge"), "shingle").select(
        "shingle", "id", size.alias("size"),
        F.col("place").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("at"),
    )


def _tasks(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def _size_class(size: Column) -> Column:
    return F.floor(F.log(size) / math.log(100 / PERCENT)).cast("int")


def meetings(shared: DataFrame) -> DataFrame:
    """``spot, id, size, hub``: where sets may meet for the first time; ``hub`` the least set there.

    A spot is a shingle and a class of sizes. A set comes to the spots of the sizes that a partner no larger
    than itself may have: not under ``PERCENT`` of its own, and no more than what the shingle leaves behind
    it in the set allows. Where a set of the class itself is among those that come, they may be linked.
    """
    size, at = F.col("size"), F.col("at")
    most = F.floor((100 * size - (100 + PERCENT) * at) / PERCENT)
    low, high = F.ceil(PERCENT * size / 100), F.least(size, most)
    rows = shared.where(high >= low).select(
        "shingle", "id", "size", (most >= size).alias("early"),
        F.explode(F.sequence(_size_class(low), _size_class(high))).alias("class"),
    )
    # A set of the class itself has its size, another one the size below zero: one exchange for both uses.
    own = F.col("early") & (F.col("class") == _size_class(size))
    rows = rows.select(
        "shingle", "class", "id", F.when(own, size).otherwise(-size).alias("mark")
    ).repartition(_tasks(shared), "shingle", "class")
    held = rows.groupBy("shingle", "class").agg(
        F.count("*").alias("n"), F.max("mark").alias("own"), F.min("id").alias("hub")
    ).where("n > 1 and own > 0").select("shingle", "class", "hub")
    return rows.join(held.hint("merge"), ["shingle", "class"]).select(
        F.xxhash64("shingle", "class").alias("spot"), "id", F.abs("mark").alias("size"), "hub"
    )


def block_routes(meets: DataFrame) -> DataFrame:
    """``a, b, id, left``: the blocks that are to be compared and the sets that each comparison needs."""
    homes = meets.groupBy("id").agg(
        F.min("hub").alias("home"), F.max("size").alias("size")
    )
    # A home whose own set has moved on moves with it, once, so groups do not fall apart.
    moved = homes.select(F.col("id").alias("home"), F.col("home").alias("next"))
    homes = homes.join(moved, "home").select("id", "size", F.col("next").alias("home"))
    sizes = homes.groupBy("home").agg(
        F.greatest(
            F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("size") / BLOCK_SHINGLES)
        ).cast("int").alias("parts")
    )
    members = _staged(
        homes.join(sizes, "home").select(
            "id", F.xxhash64("home", F.pmod(F.xxhash64("id", F.lit("part")), "parts")).alias("block")
        ),
        "members",
    )
    # A spot met by the sets of one block alone is compared within that block only.
    met = meets.select("spot", "id").join(members, "id")
    blocks_of = met.groupBy("spot", "block").agg(F.count("*").alias("n"))
    several = blocks_of.groupBy("spot").agg(
        F.count("*").alias("blocks"), F.sum("n").alias("sets")
    ).where("blocks > 1")
    spots = several.select("spot", (F.col("sets") > CROWDED * F.col("blocks")).alias("crowded"))
    met = _staged(met.join(spots, "spot"), "met")
    # Spots of few sets to a block: those sets alone go to the other blocks of the spot.
    few = met.where("not crowded")
    other = few.select("spot", F.col("block").alias("other")).distinct()
    single = few.join(other, "spot").where("block <> other").select(
        F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "id",
        (F.col("block") < F.col("other")).alias("left"),
    )
    # Spots of many: the blocks are compared as wholes.
    many = met.where("crowded").select("spot", "block").distinct()
    left, right = (many.select("spot", F.col("block").alias(c)) for c in "ab")
    pairs = _staged(
        left.join(right, "spot").where("a < b").select("a", "b").distinct(), "block-pairs"
    )
    whole = [
        members.join(pairs.withColumn("block", F.col(c)), "block").select(
            "a", "b", "id", F.lit(c == "a").alias("left"))
        for c in "ab"
    ]
    alone = members.select(
        F.col("block").alias("a"), F.col("block").alias("b"), "id", F.lit(True).alias("left")
    )
    routes = single.union(whole[0]).union(whole[1]).distinct()
    return _staged(routes.union(alone), "routes")


def _grouped(
    batches: Iterator[pa.RecordBatch], keys: list[str]
) -> Iterator[pa.Table]:
    """One table per run of equal keys in sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        columns = [batch.column(k).to_numpy() for k in keys]
        new = np.zeros(batch.num_rows, bool)
        new[:1] = True
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(new).tolist()
        for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(values of a list column one after the other, number in each row)."""
    n = pc.list_value_length(column).to_numpy()
    return pc.list_flatten(column).to_numpy(), n


def pairs_that_pass(
    owner: np.ndarray, shingle: np.ndarray, at: np.ndarray, size: np.ndarray, side: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets (of different sides, where there are two) whose first shared shingle leaves enough.

    ``owner, shingle, at`` are rows of first shingles; ``size, side`` belong to the sets.
    """
    n = len(size)
    order = np.argsort(shingle, kind="stable")
    owner, shingle, at = owner[order], shingle[order], at[order]
    start = np.flatnonzero(np.concatenate([[True], shingle[1:] != shingle[:-1]]))
    length = np.diff(np.append(start, len(shingle)))
    two_sides = side.any() and not side.all()
    found = []

    def keep() -> None:
        found[:] = [np.unique(np.concatenate(found))]

    held = 0
    for width in np.unique(length[length > 1]).tolist():
        i, j = np.triu_indices(width, 1)
        rows = start[length == width]
        step = max(1, 1_000_000 // len(i))
        for k in range(0, len(rows), step):
            place = rows[k : k + step, None] + np.arange(width)
            left, right = place[:, i].ravel(), place[:, j].ravel()
            x, y = owner[left], owner[right]
            sx, sy = size[x], size[y]
            need = (PERCENT * (sx + sy) + 99 + PERCENT) // (100 + PERCENT)
            ok = np.minimum(sx - at[left], sy - at[right]) >= need
            ok &= 100 * np.minimum(sx, sy) >= PERCENT * np.maximum(sx, sy)
            if two_sides:
                ok &= side[x] != side[y]
            x, y = x[ok], y[ok]
            found.append(np.unique(np.minimum(x, y) * n + np.maximum(x, y)))
            held += len(found[-1])
            if held > 4_000_000:
                keep()
                held = 0
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keep()
    return found[0] // n, found[0] % n


def within_reach(
    x: np.ndarray, y: np.ndarray, owner: np.ndarray, shingle: np.ndarray, at: np.ndarray,
    size: np.ndarray, tail: np.ndarray,
) -> np.ndarray:
    """Which of the pairs (``x`` ascending) can still overlap enough, given all they share at first.

    Up to the lesser of the two last first shingles (``tail``) all that is shared is known; behind it no
    more can be than what either set has left.
    """
    values, code = np.unique(np.concatenate([shingle.view(U), tail.view(U)]), return_inverse=True)
    code, last = code[: len(shingle)], code[len(shingle) :]
    spot = owner * len(values) + code
    order = np.argsort(spot, kind="stable")
    spot, at = spot[order], at[order]
    first = np.searchsorted(owner[order], np.arange(len(size) + 1))
    known = [code[order[a:b]].astype(U) for a, b in zip(first, first[1:], strict=False)]
    shared = overlaps(known, x, y)
    end = np.minimum(last[x], last[y])

    def passed(s: np.ndarray) -> np.ndarray:
        k = np.searchsorted(spot, s * len(values) + end, side="right")
        seen = np.where(k > first[s], at[k - 1] + 1, 0)
        return np.where(last[s] <= end, size[s] - -(-PERCENT * size[s] // 100) + 1, seen)

    need = (PERCENT * (size[x] + size[y]) + 99 + PERCENT) // (100 + PERCENT)
    return shared + np.minimum(size[x] - passed(x), size[y] - passed(y)) >= need


CANDIDATES = "a long, b long, ids array<long>, xs array<int>, ys array<int>"


def candidates(shared: DataFrame, sets: DataFrame, routes: DataFrame) -> DataFrame:
    """One row per pair of blocks: the sets it needs, and its candidate pairs by place among them."""
    routed = routes.select("id").distinct()
    heads = shared.join(routed, "id").groupBy("id").agg(
        F.first("size").alias("size"),
        F.collect_list(F.struct("shingle", "at")).alias("head"),  # no longer than a set's head
    ).join(sets.select("id", "tail"), "id")
    rows = heads.join(routes, "id").select(
        "a", "b", "id", "size", "left", "tail",
        F.col("head.shingle").alias("shingle"), F.col("head.at").alias("at"),
    )
    schema = pa.schema([
        ("a", pa.int64()), ("b", pa.int64()), ("ids", pa.list_(pa.int64())),
        ("xs", pa.list_(pa.int32())), ("ys", pa.list_(pa.int32())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches, ["a", "b"]):
            shingle, n = _lists(table["shingle"])
            at, _ = _lists(table["at"])
            owner, at = np.repeat(np.arange(table.num_rows), n), at.astype(np.int64)
            size = table["size"].to_numpy().astype(np.int64)
            x, y = pairs_that_pass(owner, shingle, at, size, table["left"].to_numpy())
            if len(x):
                ok = within_reach(x, y, owner, shingle, at, size, table["tail"].to_numpy())
                x, y = x[ok], y[ok]
            if not len(x):
                continue
            used = np.unique(np.concatenate([x, y]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([table["a"][0].as_py()]), pa.array([table["b"][0].as_py()]),
                    pa.array([table["id"].to_numpy()[used]], pa.list_(pa.int64())),
                    pa.array([np.searchsorted(used, x)], pa.list_(pa.int32())),
                    pa.array([np.searchsorted(used, y)], pa.list_(pa.int32())),
                ],
                schema=schema,
            )

    dealt = rows.repartition("a", "b").sortWithinPartitions("a", "b")
    return arrow_map(dealt, lambda: run, CANDIDATES)


# -- vertical counting


def forest(n: int, xs: np.ndarray, ys: np.ndarray) -> list[tuple[int, int]]:
    """Of the pairs, enough to connect what all of them connect."""
    above = list(range(n))

    def root(x: int) -> int:
        while above[x] != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    out = []
    for x, y in zip(xs.tolist(), ys.tolist(), strict=True):
        a, b = root(x), root(y)
        if a != b:
            above[b] = a
            out.append((x, y))
    return out


def name_of(numbers: np.ndarray) -> int:
    """The name of a set as ``sets_of`` gives it."""
    return int(np.uint64(xxhash.xxh64_intdigest(numbers.tobytes(), seed=7)).view(np.int64))


def marks_of(keys: DataFrame) -> np.ndarray:
    """A table of ``2 ** MARK_BITS`` bits, those of the keys set: a fixed size however many there are."""

    def packed(rows: pa.Table) -> pa.Table:
        bits = np.zeros(1 << MARK_SLICE, np.uint8)
        bits[rows["bit"].to_numpy()] = 1
        return pa.table({
            "slice": rows["slice"].slice(0, 1), "bits": pa.array([np.packbits(bits).tobytes()]),
        })

    place = F.shiftrightunsigned("key", 64 - MARK_BITS)
    found = keys.select(
        F.shiftright(place, MARK_SLICE).cast("int").alias("slice"),
        F.pmod(place, F.lit(1 << MARK_SLICE)).cast("int").alias("bit"),
    ).distinct().groupBy("slice").applyInArrow(packed, "slice int, bits binary").toArrow()
    table = np.zeros((1 << MARK_BITS - MARK_SLICE, 1 << MARK_SLICE - 3), np.uint8)
    for k, data in zip(found["slice"].to_pylist(), found["bits"].to_pylist(), strict=True):
        table[k] = np.frombuffer(data, np.uint8)
    return table.ravel()


def marked(keys: np.ndarray, marks: np.ndarray) -> np.ndarray:
    place = (keys.view(U) >> U(64 - MARK_BITS)).astype(np.int64)
    return (marks[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1).astype(bool)


def segments(
    texts: DataFrame, classes: np.ndarray, pivots: np.ndarray, marks: np.ndarray
) -> DataFrame:
    """``id, size, fragment, segment`` of the sets of rows whose ``key`` is marked.

    Fragments without shingles are left out.
    """
    sent = texts.sparkSession.sparkContext.broadcast((classes, pivots, marks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, pivots, marks = sent.value

        def wanted() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(marked(batch.column("key").to_numpy(), marks)))

        for part in parts(wanted()):
            names, sizes, fragments, cut = [], [], [], []
            for found in shingle_hashes(part.column("text")):
                found = numbered(found, classes)
                name = name_of(found)
                ends = [0, *np.searchsorted(found, pivots).tolist(), len(found)]
                for k, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
                    if a < b:
                        names.append(name)
                        sizes.append(len(found))
                        fragments.append(k)
                        cut.append(found[a:b].tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int64()), pa.array(sizes, pa.int32()),
                 pa.array(fragments, pa.int32()), pa.array(cut, pa.binary())],
                ["id", "size", "fragment", "segment"],
            )

    return arrow_map(texts, lambda: run, "id long, size int, fragment int, segment binary")


def overlaps(
    segment: list[np.ndarray], xs: np.ndarray, ys: np.ndarray
) -> np.ndarray:
    """Shared shingles of each pair of segments; ``xs`` ascending."""
    out = np.zeros(len(xs), np.int32)
    sizes = np.array([len(s) for s in segment], np.int64)
    if not sizes.sum():
        return out
    _, code = np.unique(np.concatenate(segment), return_inverse=True)
    first = np.cumsum(sizes) - sizes
    here = np.zeros(code.max() + 2, bool)
    starts = np.flatnonzero(np.concatenate([[True], xs[1:] != xs[:-1]]))
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(xs)], strict=True):
        x = xs[a]
        own = code[first[x] : first[x] + sizes[x]]
        here[own] = True
        for k in range(a, b, 256):
            other = ys[k : min(b, k + 256)]
            n = sizes[other]
            ends = np.cumsum(n)
            place = np.arange(ends[-1]) + np.repeat(first[other] - (ends - n), n)
            hit = np.concatenate([[0], np.cumsum(here[code[place]])])
            out[k : k + len(other)] = hit[ends] - hit[ends - n]
        here[own] = False
    return out


def links_of(found: DataFrame, cut: DataFrame) -> DataFrame:
    """Links ``a, b`` between sets, as a forest per pair of blocks."""
    wanted = found.select("a", "b", F.posexplode("ids").alias("at", "id"))
    cut = cut.join(wanted.hint("merge"), "id").select(
        "a", "b", "fragment", "at", "size", "segment", F.lit(None).cast("array<int>").alias("xs"),
        F.lit(None).cast("array<int>").alias("ys"),
    )
    every = F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1))).alias("fragment")
    lists = found.select(
        "a", "b", every, F.lit(-1).alias("at"), F.size("ids").alias("size"),
        F.lit(None).cast("binary").alias("segment"), "xs", "ys",
    )
    schema = pa.schema([
        ("a", pa.int64()), ("b", pa.int64()), ("fragment", pa.int32()),
        ("shared", pa.list_(pa.int32())), ("at", pa.list_(pa.int32())),
        ("sizes", pa.list_(pa.int32())),
    ])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches, ["a", "b", "fragment"]):
            # The row of candidate pairs sorts before the segments.
            n = table["size"][0].as_py()
            xs, ys = (np.array(table[c][0].as_py(), np.int64) for c in ("xs", "ys"))
            segment = [np.zeros(0, U)] * n
            rows = table.slice(1)
            for at, data in zip(rows["at"].to_pylist(), rows["segment"].to_pylist(), strict=True):
                segment[at] = np.frombuffer(data, U)
            yield pa.RecordBatch.from_arrays(
                [
                    table["a"].slice(0, 1).combine_chunks(), table["b"].slice(0, 1).combine_chunks(),
                    table["fragment"].slice(0, 1).combine_chunks(),
                    pa.array([overlaps(segment, xs, ys)], pa.list_(pa.int32())),
                    pa.array([rows["at"].to_numpy()], pa.list_(pa.int32())),
                    pa.array([rows["size"].to_numpy()], pa.list_(pa.int32())),
                ],
                schema=schema,
            )

    names = "a long, b long, fragment int, shared array<int>, at array<int>, sizes array<int>"
    dealt = cut.union(lists).repartition("a", "b", "fragment").sortWithinPartitions(
        "a", "b", "fragment", "at"
    )
    counted = arrow_map(dealt, lambda: partial, names)
    empty = {c: F.lit(None).cast("array<int>") for c in ("shared", "sizes")}
    whole = counted.select("a", "b", "fragment", "shared", "at", "sizes", F.lit(None).cast(
        "array<long>").alias("ids"), F.lit(None).cast("array<int>").alias("ys")).union(
        found.select("a", "b", F.lit(-1), empty["shared"], F.col("xs"), empty["sizes"], "ids", "ys")
    )

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches, ["a", "b"]):
            # First the candidate pairs (their xs in the column ``at``), then a row per fragment.
            ids = np.array(table["ids"][0].as_py(), np.int64)
            xs, ys = (np.array(table[c][0].as_py(), np.int64) for c in ("at", "ys"))
            shared, size = np.zeros(len(xs), np.int64), np.zeros(len(ids), np.int64)
            for row in table.slice(1).select(["shared", "at", "sizes"]).to_pylist():
                shared += np.array(row["shared"], np.int64)
                size[np.array(row["at"], np.int64)] = row["sizes"]
            linked = 100 * shared >= PERCENT * (size[xs] + size[ys] - shared)
            pairs = forest(len(ids), xs[linked], ys[linked])
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[p[k]] for p in pairs], pa.int64()) for k in (0, 1)],
                ["a", "b"],
            )

    dealt = whole.repartition("a", "b").sortWithinPartitions("a", "b", "fragment")
    return arrow_map(dealt, lambda: summed, "a long, b long")


# -- the join


def _keys() -> list[Column]:
    """Three hashes that stand for a row's id and text."""
    return [
        F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("second"), "text").alias("h2"),
        F.xxhash64("doc_id").alias("h3"),
    ]


def link_sets(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with the name of their set, links ``a, b`` that connect all components of sets)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    table = count_table(texts.select("text"))
    classes = classes_of(table)
    rows = _staged(sets_of(texts.select("doc_id", "text", *_keys()), classes), "rows")
    # Equal sets are one; of the texts that have it, the one whose keys are least gives the set.
    names = rows.where("size > 0").groupBy("id").agg(
        F.min(F.struct("h1", "h2", "h3")).alias("text_key"), F.min("check").alias("low"),
        F.max("check").alias("high"), F.first("size").alias("size"), F.first("head").alias("head"),
    ).withColumn("tail", F.element_at("head", -1))
    sets = _staged(names, "sets")
    if not sets.where("low <> high").isEmpty():
        raise ValueError("two different sets have the same 64-bit name")
    shared = _staged(shared_heads(sets), "shared")
    routes = block_routes(_staged(meetings(shared), "meets"))
    found = _staged(candidates(shared, sets, routes), "candidates")
    # Whole texts only of sets in a candidate pair: a table of bits tells a task which texts those are.
    # The few others whose bits are set too, and rows equal in id and text, do no harm.
    key = F.xxhash64("h1", "h2", "h3").alias("key")
    wanted = found.select(F.explode("ids").alias("id")).distinct().join(
        sets.select("id", "text_key.*"), "id"
    )
    marks = marks_of(wanted.select(key))
    keyed = texts.select("text", *_keys()).select("text", key)
    cut = segments(keyed, classes, pivots_of(table, classes), marks)
    return rows, _staged(links_of(found, cut), "links")


def join_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row."""
    rows, links = link_sets(docs)
    labels = (
        links.select(F.col("a").alias("id"), F.col("b").alias("label")) if links.isEmpty()
        else components(links, "components").select(F.col("node").alias("id"), "label")
    )
    named = rows.where("size > 0").groupBy("id").agg(F.min("doc_id").alias("least"))
    named = named.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    named = named.join(least, "label").select("id", "component_id")
    full = rows.where("size > 0").select("doc_id", "size", "id").join(named, "id").select(
        "doc_id", F.col("size").cast("long").alias("n_shingles"), "component_id"
    )
    alone = rows.where("size = 0").select(
        "doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id")
    )
    return full.union(alone)


def oracle_sql() -> str:
    """DuckDB SQL of the query over ``documents``."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'),
                                    '[^\\x20\\x09-\\x0D]+') AS words
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN []
    WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))
    END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (
  SELECT x, y FROM i JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y
  WHERE 100 * c >= 85 * (p.n + q.n - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents
      UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
SELECT CAST(d.doc_id AS BIGINT) AS doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles,
       CAST(m.y AS BIGINT) AS component_id
FROM documents d LEFT JOIN n USING (doc_id)
JOIN (SELECT x, min(y) AS y FROM r GROUP BY x) m ON m.x = d.doc_id"""
