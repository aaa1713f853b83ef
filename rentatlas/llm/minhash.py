"""Near-duplicate classes by consistent weighted sampling over TF-IDF shingles.

A text is a weighted set of five-word shingles (all words, if it has fewer): how often one occurs,
times an inverse document frequency. Improved consistent weighted sampling draws ``BANDS * ROWS``
samples per text; texts that agree on a band are candidates. Candidates are compared by their exact
weighted Jaccard similarity, and texts linked by ``SIMILARITY`` or more form a class.

Inverse document frequency: ``1 + log(1 / max(share, RARE)) / log(1 / RARE)`` with ``share`` the
share of all documents that hold the shingle, so weights lie between 1 and 2. Only shingles in more
than ``RARE`` of all documents need a count of their own; these are at most (mean number of shingles
of a text) / RARE whatever the corpus, so they can be sent to all tasks. They are found exactly: a
fixed table of counters tells which shingles may be that frequent, and those are counted one by one.

Comparison: candidates are joined to components first (ids only), each component is dealt out in
blocks of bounded size, and every pair of blocks is compared as a whole inside one task that returns
links, never pairs. So no candidate is lost to a representative that happens to differ.

Defined results: a missing text is an empty one; equal texts, empty ones too, are one class; rows
with equal ids and texts stay apart as rows; a class is named by its smallest id; texts without words
are near nothing but their equals; an empty table yields no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentatlas.llm.common import arrow_map, blocks, counter_table, stage, text_of

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 10
ROWS = 3
RARE = 1e-3
#: Counters that frequent shingles are looked for with, and variates each hash draws from.
COUNTER_BITS = 22
POOL_BITS = 17
#: Text and texts that one block of a comparison holds.
BLOCK_TEXT = 4_000_000
BLOCK_DOCS = 1_000

U = np.uint64
M1, M2 = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    """Every input bit spread over all 64 output bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@dataclass
class Shingled:
    """Shingles of a block: ``doc`` ascending, within it ``shingle`` (48 bits) ascending."""

    doc: np.ndarray
    shingle: np.ndarray
    times: np.ndarray
    docs: int

    def bounds(self) -> np.ndarray:
        return np.searchsorted(self.doc, np.arange(self.docs + 1))


def shingled(texts: pa.Array) -> Shingled:
    """All shingles of all texts, at most 65,536 texts at once."""
    n = len(texts)
    split = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    coded = split.flatten().dictionary_encode()
    different = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, different), U, len(different))
    real = np.fromiter(map(bool, different), bool, len(different))
    at = coded.indices.to_numpy()
    doc = np.repeat(np.arange(n), np.diff(split.offsets.to_numpy()))
    keep = real[at] if len(at) else np.zeros(0, bool)
    words, doc = hashes[at[keep]], doc[keep]
    if not len(words):
        none = np.zeros(0, np.int64)
        return Shingled(none, none.astype(U), none, n)
    per_doc = np.bincount(doc, minlength=n)
    first = np.cumsum(per_doc) - per_doc
    # A window starts at each word but the last four of its text; short texts have one window.
    windows = np.where(per_doc > 0, np.maximum(per_doc - (SHINGLE - 1), 1), 0)
    owner = np.repeat(np.arange(n), windows)
    start = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    start += first[owner]
    last = (first + per_doc)[owner]
    h = np.zeros(len(owner), U)
    for k in range(SHINGLE):
        here = start + k
        inside = here < last
        word = words[np.minimum(here, len(words) - 1)]
        h = np.where(inside, mixed(h * M1 + word + U(k)), h)
    key = (owner.astype(U) << U(48)) | (h >> U(16))
    key, times = np.unique(key, return_counts=True)
    return Shingled((key >> U(48)).astype(np.int64), key & U((1 << 48) - 1), times, n)


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches, limit=2_000_000):
        for at in range(0, batch.num_rows, 1 << 15):
            yield batch.slice(at, 1 << 15)


# -- document frequencies


def frequent_shingles(docs: DataFrame, share: float = RARE) -> tuple[np.ndarray, np.ndarray, int]:
    """(shingles ascending, documents that hold each, number of documents) above ``share``.

    Two passes over all documents. The first counts the documents on each of ``2 ** COUNTER_BITS``
    counters; a shingle whose counter stays below the share is surely rarer. The second counts the
    other shingles exactly. Neither depends on how the documents are partitioned, and what comes to
    the driver is bounded by the number of counters and by the share.
    """
    texts = docs.select(text_of().alias("text"))
    total = texts.count()
    least = max(2, int(np.ceil(share * total)))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for part in parts(batches):
            block = shingled(part.column("text"))
            counter = (block.shingle >> U(48 - COUNTER_BITS)).astype(np.int64)
            bounds = block.bounds().tolist()
            for a, b in zip(bounds, bounds[1:], strict=False):
                yield counter[a:b]

    heavy = counter_table(texts, COUNTER_BITS, places) >= least
    if not heavy.any():
        return np.zeros(0, U), np.zeros(0, np.int64), total
    sent = texts.sparkSession.sparkContext.broadcast(np.packbits(heavy))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy = np.unpackbits(sent.value).astype(bool)
        for part in parts(batches):
            block = shingled(part.column("text"))
            likely = block.shingle[heavy[(block.shingle >> U(48 - COUNTER_BITS)).astype(np.int64)]]
            found, n = np.unique(likely, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.astype(np.int64)), pa.array(n)], ["shingle", "n"]
            )

    counts = arrow_map(texts, lambda: count, "shingle long, n long").groupBy("shingle").agg(
        F.sum("n").alias("n")
    )
    held = counts.where(F.col("n") >= least).toArrow()
    order = np.argsort(held["shingle"].to_numpy())
    return (
        held["shingle"].to_numpy()[order].astype(U), held["n"].to_numpy()[order], total
    )


@dataclass
class Weights:
    """Inverse document frequencies; shingles not listed weigh 2."""

    shingles: np.ndarray
    idf: np.ndarray

    @classmethod
    def of(cls, shingles: np.ndarray, counts: np.ndarray, total: int) -> Weights:
        share = np.maximum(counts / max(total, 1), RARE)
        return cls(shingles, 1 + np.log(1 / share) / np.log(1 / RARE))

    def idf_of(self, shingle: np.ndarray) -> np.ndarray:
        out = np.full(len(shingle), 2.0)
        if len(self.shingles):
            at = np.searchsorted(self.shingles, shingle)
            at[at == len(self.shingles)] = 0
            known = self.shingles[at] == shingle
            out[known] = self.idf[at[known]]
        return out


# -- sampling


class Sampler:
    """Improved consistent weighted sampling.

    For element x of weight w and hash k: ``t = floor(ln w / r + b)`` and
    ``ln a = ln c - r (t + 1 - b)`` with r, c gamma(2, 1) and b uniform variates that depend on x
    and k alone; the element with the smallest ``ln a``, together with its ``t``, is the sample.
    The variates come from a fixed pool that x and k index, so none is drawn per element.
    """

    def __init__(self, hashes: int = BANDS * ROWS, seed: int = 20_010):
        rng = np.random.default_rng(seed)
        size = 1 << POOL_BITS
        self.r = rng.gamma(2, 1, size).astype(np.float32)
        self.b = rng.random(size).astype(np.float32)
        self.c = np.log(rng.gamma(2, 1, size)).astype(np.float32)
        self.odd = rng.integers(1 << 62, size=hashes, dtype=U) * U(2) + U(1)

    def __call__(self, block: Shingled, weight: np.ndarray) -> np.ndarray:
        """Sample numbers, one row per text and one column per hash; texts without words have 0."""
        out = np.zeros((block.docs, len(self.odd)), U)
        bounds = block.bounds()
        full = np.flatnonzero(np.diff(bounds))
        if not len(full):
            return out
        starts = bounds[full]
        size = np.diff(bounds)[full]
        log_w = np.log(weight).astype(np.float32)
        x = mixed(block.shingle)
        for k, odd in enumerate(self.odd):
            pick = ((x * odd) >> U(64 - POOL_BITS)).astype(np.int32)
            r, b = self.r[pick], self.b[pick]
            t = np.floor(log_w / r + b)
            a = self.c[pick] - r * (t + 1 - b)
            least = np.minimum.reduceat(a, starts)
            at = np.flatnonzero(a == np.repeat(least, size))
            doc = block.doc[at]
            at = at[np.concatenate([[True], doc[1:] != doc[:-1]])]
            out[full, k] = mixed(x[at] + (t[at].astype(np.int64).astype(U) + U(1)) * M2)
        return out


def bands_of(samples: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One number per band of samples."""
    out = np.zeros((len(samples), samples.shape[1] // rows), U)
    for k in range(rows):
        out = mixed(out * M1 + samples[:, k::rows] + U(k))
    return out.view(np.int64)


def text_id(column: str = "text") -> Column:
    """128 bits that stand for a whole text."""
    return F.unhex(F.md5(F.col(column)))


def band_rows(docs: DataFrame, weights: Weights) -> DataFrame:
    """``id, band, key`` of every different text with words."""
    sent = docs.sparkSession.sparkContext.broadcast((weights.shingles, weights.idf))
    texts = docs.select(text_of().alias("text")).withColumn("id", text_id())

    def make():
        sampler, idf = Sampler(), Weights(*sent.value)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts(batches):
                block = shingled(part.column("text"))
                weight = block.times * idf.idf_of(block.shingle)
                keys = bands_of(sampler(block, weight))
                full = np.flatnonzero(np.diff(block.bounds()))
                ids = part.column("id").take(pa.array(full))
                offsets = pa.array(np.arange(len(full) + 1, dtype=np.int32) * keys.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.ListArray.from_arrays(offsets, pa.array(keys[full].ravel()))],
                    ["id", "keys"],
                )

        return run

    found = arrow_map(texts, make, "id binary, keys array<long>")
    return found.select("id", F.posexplode("keys").alias("band", "key")).distinct()


# -- components


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node, label``: the smallest node each node of ``a, b`` is connected with (or nearly so).

    Every round each node joins its smallest neighbour and the joined nodes form the next, smaller
    graph, until no edge is left. All of it stays distributed; each round starts from files.
    """
    rounds = []
    while True:
        both = edges.select("a", "b").union(edges.select("b", "a"))
        parents = stage(
            both.groupBy("a").agg(F.min("b").alias("m")).select(
                F.col("a").alias("node"), F.least("a", "m").alias("label")
            ),
            name,
        )
        rounds.append(parents)
        left = parents.select(F.col("node").alias("a"), F.col("label").alias("la"))
        right = parents.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        edges = stage(
            edges.join(left, "a").join(right, "b").where("la <> lb")
            .select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct(),
            name,
        )
        if edges.isEmpty():
            break
    out = rounds[0]
    for later in rounds[1:]:
        step = later.select(F.col("node").alias("label"), F.col("label").alias("next"))
        out = out.join(step, "label", "left").select(
            "node", F.coalesce("next", "label").alias("label")
        )
    return out


# -- comparison


def similar(block: Shingled, weight: np.ndarray, idf: np.ndarray, least: float) -> np.ndarray:
    """Matrix of the pairs of texts whose weighted Jaccard similarity is at least ``least``.

    The smaller weight of a shared shingle is its idf times the smaller count, so shingles are laid
    out once per repetition. Shingles many texts share are multiplied as dense columns; those few
    share are added pair by pair.
    """
    n = block.docs
    total = np.bincount(block.doc, weight, n)
    level = np.arange(block.times.sum()) - np.repeat(
        np.cumsum(block.times) - block.times, block.times
    )
    doc, value = np.repeat(block.doc, block.times), np.repeat(idf, block.times)
    element = mixed(np.repeat(block.shingle, block.times) + level.astype(U) * M1)
    order = np.argsort(element, kind="stable")
    element, doc, value = element[order], doc[order], value[order]
    first = np.flatnonzero(np.concatenate([[True], element[1:] != element[:-1]]))
    size = np.diff(np.append(first, len(element)))
    shared = np.zeros((n, n))
    dense = np.flatnonzero(size > max(8, n // 64))
    for at in range(0, len(dense), 1024):
        some = dense[at : at + 1024]
        x = np.zeros((n, len(some)), np.float32)
        column = np.repeat(np.arange(len(some)), size[some])
        where = np.repeat(first[some], size[some]) + _counting(size[some])
        x[doc[where], column] = np.sqrt(value[where])
        shared += x @ x.T
    few = np.flatnonzero((size > 1) & (size <= max(8, n // 64)))
    for width in np.unique(size[few]).tolist():
        rows = first[few[size[few] == width]]
        for at in range(0, len(rows), max(1, 2_000_000 // width**2)):
            some = rows[at : at + max(1, 2_000_000 // width**2)]
            held = doc[some[:, None] + np.arange(width)]
            pairs = (held[:, :, None] * n + held[:, None, :]).ravel()
            shared += np.bincount(
                pairs, np.repeat(value[some], width * width), n * n
            ).reshape(n, n)
    union = total[:, None] + total[None, :] - shared
    return (shared >= (least - 1e-6) * union) & (shared > 0)


def _counting(sizes: np.ndarray) -> np.ndarray:
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def spanning(linked: np.ndarray) -> list[tuple[int, int]]:
    """A forest that connects what the matrix connects."""
    n = len(linked)
    free = np.ones(n, bool)
    out = []
    for root in range(n):
        if not free[root]:
            continue
        free[root] = False
        front = [root]
        while front:
            node = front.pop()
            new = np.flatnonzero(linked[node] & free)
            free[new] = False
            out += [(node, int(v)) for v in new]
            front += new.tolist()
    return out


def compare_groups(rows: DataFrame, weights: Weights, least: float) -> DataFrame:
    """Links ``a, b`` within each ``group`` of ``id, text``, as a forest per group."""
    sent = rows.sparkSession.sparkContext.broadcast((weights.shingles, weights.idf))

    def make():
        idf = Weights(*sent.value)

        def links(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            group = table["group"].to_numpy()
            ids = table["id"].combine_chunks()
            ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
            texts = table["text"].combine_chunks()
            texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
            edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            pairs = []
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(group)], strict=True):
                if b - a < 2:
                    continue
                block = shingled(texts.slice(a, b - a))
                value = idf.idf_of(block.shingle)
                matrix = similar(block, block.times * value, value, least)
                pairs += [(a + i, a + j) for i, j in spanning(matrix)]
            left, right = zip(*pairs, strict=True) if pairs else ((), ())
            return pa.RecordBatch.from_arrays(
                [ids.take(pa.array(left, pa.int64())), ids.take(pa.array(right, pa.int64()))],
                ["a", "b"],
            )

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            size, last = 0, None
            for batch in batches:
                group = batch.column("group").to_numpy()
                starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
                for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(group)], strict=True):
                    if size > BLOCK_TEXT and group[a] != last:
                        yield links(held)
                        held, size = [], 0
                    held.append(batch.slice(a, b - a))
                    size += held[-1].column("text").nbytes * (b - a) // max(batch.num_rows, 1)
                    last = group[a]
            if held:
                yield links(held)

        return run

    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    dealt = rows.select("group", "id", "text").repartition(n, "group").sortWithinPartitions("group")
    return arrow_map(dealt, make, "a binary, b binary")


def link_texts(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Links ``a, b`` between the ids of different texts that connect all classes."""
    weights = Weights.of(*frequent_shingles(docs))
    found = stage(band_rows(docs, weights), "bands")
    heads = found.groupBy("band", "key").agg(F.min("id").alias("b"), F.count("*").alias("n"))
    candidates = (
        found.join(heads.where("n > 1"), ["band", "key"])
        .where("id <> b").select(F.col("id").alias("a"), "b").distinct()
    )
    candidates = stage(candidates, "candidates")
    if candidates.isEmpty():
        return candidates
    texts = docs.select(
        text_of().alias("text"), F.xxhash64("doc_id").alias("row")
    ).withColumn("id", text_id())
    one = texts.groupBy("id").agg(
        F.min("row").alias("row"), F.max(F.octet_length("text")).alias("size")
    )
    members = components(candidates, "candidates").select(
        F.col("node").alias("id"), F.col("label").alias("component")
    )
    members = stage(members.join(one, "id"), "members")
    sizes = members.groupBy("component").agg(
        F.greatest(
            F.ceil(F.sum("size") / BLOCK_TEXT), F.ceil(F.count("*") / BLOCK_DOCS)
        ).cast("int").alias("parts")
    )
    # A text of part p meets part q in the group of the pair (p, q); one part is one group.
    part = F.pmod(F.xxhash64("id", F.lit("part")), F.col("parts")).cast("int")
    placed = (
        members.join(sizes, "component").withColumn("part", part)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .where((F.col("parts") == 1) | (F.col("part") != F.col("other")))
        .select("id", "row", F.xxhash64(
            "component", F.least("part", "other"), F.greatest("part", "other")
        ).alias("group"))
    )
    # The ids grow with the corpus, so they are not broadcast at any size.
    rows = texts.join(placed.hint("merge"), ["id", "row"])
    return stage(compare_groups(rows, weights, least).where("a <> b").distinct(), "links")


def classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``id, class`` of every text that is near a different one."""
    links = link_texts(docs, least)
    if links.isEmpty():
        return links.select(F.col("a").alias("id"), F.col("b").alias("class"))
    return components(links, "classes").select(
        F.col("node").alias("id"), F.col("label").alias("class")
    )


def near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``doc_id, class_id, kept, n_class`` of every row; one row of each class is kept.

    The kept row has the smallest id (rows without an id come last).
    """
    rows, keepers = _with_classes(docs.select("doc_id", "text"), least)
    named = rows.drop("row").join(keepers, "class")
    return named.select(
        F.col("doc_id").cast("long").alias("doc_id"), "class_id",
        F.coalesce(F.col("doc_id") == F.col("class_id"), F.col("class_id").isNull()).alias("kept"),
        "n_class",
    )


def _with_classes(docs: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(rows with their class, one row per class with its smallest id and its number of rows)."""
    near = classes(docs, least)
    ids = docs.select("doc_id", text_id_of().alias("id"))
    rows = ids.join(near, "id", "left").select(
        "doc_id", "id", F.coalesce("class", "id").alias("class"), F.lit(0).alias("row")
    )
    rows = stage(rows, "rows")
    keepers = rows.groupBy("class").agg(
        F.min(F.col("doc_id").cast("long")).alias("class_id"), F.count("*").alias("n_class")
    )
    return rows, keepers


def text_id_of() -> Column:
    return F.unhex(F.md5(text_of()))


def drop_near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row of each class of ``docs``, with all its columns.

    The row with the smallest id stays; of rows with that id the one whose columns hash lowest. Rows
    equal in every column are one. Classes come from files, so the choice is made once.
    """
    columns = docs.columns
    whole = F.xxhash64(*[F.col(f"`{c}`") for c in columns])
    near = classes(docs, least)
    first = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    slim = docs.select(first.alias("order"), whole.alias("row"), text_id_of().alias("id"))
    ranked = slim.join(near, "id", "left").select(
        F.coalesce("class", "id").alias("class"), "order", "row"
    )
    firsts = ranked.groupBy("class").agg(F.min("order").alias("order"))
    chosen = (
        ranked.join(firsts, ["class", "order"]).groupBy("class", "order")
        .agg(F.min("row").alias("row"))
    )
    equal = ranked.groupBy("class", "order", "row").agg(F.count("*").alias("copies"))
    chosen = stage(
        chosen.join(equal, ["class", "order", "row"]).select("order", "row", "copies"), "chosen"
    )
    # The columns of a row travel as one, so none of theirs can meet a working column.
    packed = docs.select(
        first.alias("order"), whole.alias("row"),
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("whole"),
    )
    kept = packed.join(chosen, ["order", "row"])
    if not chosen.where("copies > 1").isEmpty():
        several = kept.where("copies > 1").dropDuplicates(["order", "row"])
        kept = kept.where("copies = 1").unionByName(several)
    return kept.select(*[F.col("whole").getField(c).alias(c) for c in columns])
