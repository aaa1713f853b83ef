"""Document fingerprints: SimHash of weighted terms, and a search by permuted block tables.

Everything is built from DataFrame functions. A term is a window of five words (the whole text if it
has fewer); its weight is how often it occurs. Each occurrence votes, bit by bit, with its 128 hash
bits; a fingerprint bit is set where more than half of the weight has it. Two counters of 32 bits share
a sum, so 64 sums count all votes.

Defined results: a missing text is an empty one; rows with one id follow each other by a hash of
their texts, missing ids come last; a single row is its own next one; an empty table yields no rows;
texts of any length are read whole; further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rentatlas.llm.common import text_of

WINDOW = 5
BITS = 128
HALF = 32
LANES = 0x1_0000_0001
#: Rows a bucket of neighbours holds on average, and how many buckets there are at most.
BUCKET_ROWS = 4096
MAX_BUCKETS = 100_000


def term_hashes(text: Column) -> Column:
    """One 64-bit hash per window of words; words stand between single spaces."""
    words = F.transform(F.split(text, " "), lambda w: F.xxhash64(w))
    return words


def windows(words: Column) -> Column:
    """Hashes of every window of ``WINDOW`` words from the hashes of the words."""

    def window(first: Column, i: Column) -> Column:
        return F.xxhash64(first, *[F.get(words, i + k) for k in range(1, WINDOW)])

    whole = F.greatest(F.size(words) - (WINDOW - 1), F.lit(1))
    return F.transform(F.slice(words, F.lit(1), whole), window)


def vote_sums(term: Column) -> list[Column]:
    """Sums that hold the set bits of all terms, two counters in each."""
    halves = [term, F.xxhash64(term, F.lit(1))]
    return [
        F.sum(F.shiftrightunsigned(half, i).bitwiseAND(F.lit(LANES))).alias(f"s{part}_{i}")
        for part, half in enumerate(halves)
        for i in range(HALF)
    ]


def majority(total: Column, part: int) -> Column:
    """64 fingerprint bits from the sums of one half."""
    bits = []
    for i in range(HALF):
        held = F.col(f"s{part}_{i}")
        low, high = held.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(held, 32)
        for count, bit in ((low, i), (high, i + HALF)):
            one = F.shiftleft(F.lit(1).cast("long"), bit)
            bits.append(F.when(count * 2 > total, one).otherwise(F.lit(0).cast("long")))
    while len(bits) > 1:  # a balanced tree keeps the expression shallow
        bits = [reduce(Column.bitwiseOR, bits[i : i + 2]) for i in range(0, len(bits), 2)]
    return bits[0]


def spelled(high: Column, low: Column) -> Column:
    """A fingerprint as 32 hexadecimal digits."""
    return F.lower(F.concat(*[F.lpad(F.hex(part), 16, "0") for part in (high, low)]))


def likeness(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Share of equal bits of two fingerprints, given as two halves each."""
    apart = sum(F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b, strict=True))
    return 1 - apart / F.lit(float(BITS))


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` and the halves ``f0, f1`` of the fingerprint of each text.

    ``keys`` identify a row. Where the rows are already dealt out by some of them the votes are
    counted without another shuffle; otherwise map-side sums leave one row per text to shuffle.
    """
    hashed = texts.select(*keys, term_hashes(F.col(text)).alias("words"))
    terms = hashed.select(*keys, F.explode(windows(F.col("words"))).alias("term"))
    sums = terms.groupBy(*keys).agg(F.count("term").alias("n"), *vote_sums(F.col("term")))
    return sums.select(*keys, *[majority(F.col("n"), p).alias(f"f{p}") for p in (0, 1)])


def with_neighbours(docs: DataFrame) -> DataFrame:
    """Rows in buckets of neighbouring ids, each with the text that follows it as ``next_text``.

    Ids are cut into a grid of buckets; the first row of each bucket is also sent, as ``halo``,
    to the bucket before it (of the first bucket: to the last), so no row needs a look beyond its
    own bucket. Only one row per bucket comes to the driver. Crowded ids make large buckets, which
    are sorted with spilling.
    """
    spark: SparkSession = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    span = base.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n"))
    lo, hi, n = span.first()
    lo, hi = (0, 0) if lo is None else (lo - 1, hi)  # missing ids stand before the smallest
    buckets = max(1, min(-(-n // BUCKET_ROWS), MAX_BUCKETS))
    width = -(-(hi - lo + 1) // buckets)
    key = F.coalesce(F.col("doc_id"), F.lit(lo))
    rows = base.withColumns({"key": key, "tie": F.xxhash64("text")}).withColumn(
        "bucket", F.floor((F.col("key") - F.lit(lo)) / F.lit(width)).cast("int")
    )
    heads = rows.groupBy("bucket").agg(F.max(F.struct("key", "tie")).alias("head")).collect()
    heads.sort(key=lambda r: r.bucket)
    above = [*heads[1:], *heads[:1]]
    targets = spark.createDataFrame(
        [(h.head.key, h.head.tie, a.bucket) for h, a in zip(heads, above, strict=True)],
        "key long, tie long, target int",
    )
    own = F.struct(F.col("bucket"), F.lit(0).alias("halo"))
    other = F.struct(F.col("target").alias("bucket"), F.lit(1).alias("halo"))
    placed = rows.join(F.broadcast(targets), ["key", "tie"], "left").select(
        "doc_id", "text", "key", "tie",
        F.explode(F.when(F.col("target").isNull(), F.array(own)).otherwise(F.array(own, other)))
        .alias("to"),
    )
    order = Window.partitionBy("bucket").orderBy(
        "halo", F.col("key").desc(), F.col("tie").desc()
    )
    return placed.select("doc_id", "text", "key", "tie", "to.bucket", "to.halo").select(
        "bucket", "halo", "doc_id",
        F.row_number().over(order).alias("place"), "text",
        F.lead("text").over(order).alias("next_text"),
    )


def edited(text: Column, following: Column) -> Column:
    """The last half of the text replaced by as much of the beginning of the following one."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(
        F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half)
    )


SHA = ("sha0", "sha1", "sha2", "sha3")


def sha_parts(text: Column) -> list[Column]:
    """A SHA-256 as four numbers, so that it can pass through a hash aggregate."""
    digits = F.sha2(text, 256)
    return [
        F.conv(F.substring(digits, 16 * i + 1, 16), 16, -10).cast("long").alias(name)
        for i, name in enumerate(SHA)
    ]


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    Texts are shuffled once, to the buckets of their neighbours; all later steps stay there.
    """
    pairs = with_neighbours(docs).withColumn(
        "edited", edited(F.col("text"), F.coalesce(F.col("next_text"), F.lit("")))
    )
    facts = ["doc_id", "n_chars", *SHA]
    rows = pairs.select(
        "bucket", "place", "halo", "doc_id", F.char_length("text").cast("long").alias("n_chars"),
        *sha_parts(F.col("edited")),
        F.explode(
            F.when(
                F.col("halo") == 0,
                F.array(
                    F.struct(F.lit(0).alias("version"), F.col("text")),
                    F.struct(F.lit(1).alias("version"), F.col("edited").alias("text")),
                ),
            ).otherwise(F.array(F.struct(F.lit(0).alias("version"), F.col("text"))))
        ).alias("v"),
    )
    keys = ["bucket", "place", "halo", "version"]
    hashed = rows.select(
        "bucket", "place", "halo", "v.version", *facts, term_hashes(F.col("v.text")).alias("words")
    )
    terms = hashed.select(*keys, *facts, F.explode(windows(F.col("words"))).alias("term"))
    sums = terms.groupBy(*keys).agg(
        F.count("term").alias("n"), *[F.max(f).alias(f) for f in facts],
        *vote_sums(F.col("term")),
    )
    prints = sums.select(*keys, *facts, *[majority(F.col("n"), p).alias(f"f{p}") for p in (0, 1)])
    whole, changed = F.col("version") == 0, F.col("version") == 1
    one = prints.groupBy("bucket", "place", "halo").agg(
        *[F.max(f).alias(f) for f in facts],
        *[F.max(F.when(whole, F.col(f"f{p}"))).alias(f"f{p}") for p in (0, 1)],
        *[F.max(F.when(changed, F.col(f"f{p}"))).alias(f"e{p}") for p in (0, 1)],
    )
    order = Window.partitionBy("bucket").orderBy("place")
    own, changed_print = (F.col("f0"), F.col("f1")), (F.col("e0"), F.col("e1"))
    following = (F.lead("f0").over(order), F.lead("f1").over(order))
    return (
        one.withColumns({"g0": following[0], "g1": following[1]})
        .where(F.col("halo") == 0)
        .select(
            "doc_id", "n_chars",
            F.lower(F.concat(*[F.lpad(F.hex(s), 16, "0") for s in SHA])).alias("edited_sha256"),
            spelled(*own).alias("fingerprint"),
            spelled(*changed_print).alias("edited_fingerprint"),
            likeness(own, changed_print).alias("near_edited"),
            likeness(own, (F.col("g0"), F.col("g1"))).alias("near_next"),
        )
    )


def block_tables(prints: DataFrame, radius: int) -> DataFrame:
    """One row per fingerprint and block: ``table_no, block`` beside ``f0, f1``.

    Fingerprints within the radius agree on at least one of ``radius + 1`` blocks. Each table
    brings another block to the front, which is its key.
    """
    digits = spelled(F.col("f0"), F.col("f1"))
    size = -(-(BITS // 4) // (radius + 1))
    cuts = range(0, BITS // 4, size)
    blocks = F.array(*[F.substring(digits, at + 1, size) for at in cuts])
    return prints.select("*", F.posexplode(blocks).alias("table_no", "block"))


def find_near(prints: DataFrame, queries: DataFrame, radius: int = 3) -> DataFrame:
    """All fingerprints of ``prints`` within ``radius`` bits of a fingerprint of ``queries``.

    Both need ``f0, f1``. Equal fingerprints count as one: the result has ``q0, q1, f0, f1,
    distance`` per pair of different or equal fingerprints, and how many rows have the found one.
    """
    if not 0 <= radius < BITS // 4:
        raise ValueError("the radius must leave a block of four bits")
    held = prints.groupBy("f0", "f1").agg(F.count("*").alias("rows"))
    asked = queries.select(F.col("f0").alias("q0"), F.col("f1").alias("q1")).distinct()
    tables = block_tables(held, radius)
    wanted = block_tables(
        asked.withColumns({"f0": F.col("q0"), "f1": F.col("q1")}), radius
    ).drop("f0", "f1")
    apart = F.bit_count(F.col("q0").bitwiseXOR(F.col("f0"))) + F.bit_count(
        F.col("q1").bitwiseXOR(F.col("f1"))
    )
    return (
        wanted.join(tables, ["table_no", "block"])
        .withColumn("distance", apart)
        .where(F.col("distance") <= radius)
        .groupBy("q0", "q1", "f0", "f1")
        .agg(F.max("distance").alias("distance"), F.max("rows").alias("rows"))
    )
