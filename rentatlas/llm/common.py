"""Helpers shared by the text operators."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rentatlas.session import shared_dir

#: Texts worked on at a time inside a task, in bytes; one longer text makes a block alone.
BLOCK_BYTES = 4_000_000


def text_of(column: str = "text") -> Column:
    """The text, a missing one as the empty text."""
    return F.coalesce(F.col(f"`{column}`"), F.lit(""))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: later steps start from whole files."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def content_key(text: Column) -> list[Column]:
    """Two independent 64-bit hashes that stand for a whole text."""
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("second"), text).alias("h2")]


def blocks(
    batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES
) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into pieces of bounded text size."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(lengths):
            if total and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < len(lengths):
            yield batch.slice(start)


def give_back() -> None:
    """Memory that is free within this worker goes back to the system; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def arrow_map(
    df: DataFrame, make: Callable[[], Callable], schema: str | StructType
) -> DataFrame:
    """``mapInArrow`` over a function that ``make`` builds inside each task and that ends with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from make()(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


#: Counters sent in one row of a counter table, as a power of two.
SLICE_BITS = 16


def counter_table(
    df: DataFrame, bits: int, places: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]]
) -> np.ndarray:
    """Sums in ``2 ** bits`` counters over all rows; ``places`` gives the counters to add one to.

    A counter goes up by one for each array that names it, however often. Tasks send their own counters in compressed slices, which are
    added slice by slice; what reaches the driver has a fixed size whatever the rows.
    """
    import zstandard

    size = 1 << SLICE_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        table = np.zeros(1 << bits, np.int64)
        for found in places(batches):
            table[found] += 1
        slices = [table[k : k + size] for k in range(0, len(table), size)]
        used = [k for k, part in enumerate(slices) if part.any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()),
             pa.array([pack(slices[k].tobytes()) for k in used], pa.binary())],
            ["slice", "counts"],
        )

    def added(rows: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor().decompress
        total = np.zeros(size, np.int64)
        for data in rows["counts"].to_pylist():
            total += np.frombuffer(unpack(data), np.int64)
        packed = zstandard.ZstdCompressor(level=1).compress(total.tobytes())
        return pa.table({
            "slice": rows["slice"].slice(0, 1), "counts": pa.array([packed], pa.binary()),
        })

    names = "slice int, counts binary"
    held = arrow_map(df, lambda: run, names).groupBy("slice").applyInArrow(added, names).toArrow()
    table = np.zeros(1 << bits, np.int64)
    for k, data in zip(held["slice"].to_pylist(), held["counts"].to_pylist(), strict=True):
        part = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.int64)
        table[k * size : (k + 1) * size] = part
    return table
