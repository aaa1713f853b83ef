"""Column checks, renames and unions by name."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentatlas.functions.text import drop_header_dots, snake_case, unique_names

# Names the row-number column of an extract can carry.
INDEX_NAMES = {"", "X", "X1", "...1", "_c0"}


class MissingColumns(ValueError):
    pass


def assert_columns(df: DataFrame, names: Iterable[str], what: str) -> DataFrame:
    present = {c.lower() for c in df.columns}
    missing = [n for n in names if n.lower() not in present]
    if missing:
        raise MissingColumns(f"{what} lacks the columns {', '.join(missing)}")
    return df


def drop_index_column(df: DataFrame) -> DataFrame:
    """Drop the first column when it is a row number, never a data column."""
    first = df.columns[0]
    return df.drop(first) if first in INDEX_NAMES else df


def rename_present(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def clean_names(df: DataFrame) -> DataFrame:
    return df.toDF(*unique_names([snake_case(c) for c in df.columns]))


def clean_header(df: DataFrame) -> DataFrame:
    return df.toDF(*unique_names([drop_header_dots(c) for c in df.columns]))


def first_of_repeated(df: DataFrame) -> DataFrame:
    """Keep the first of several columns with the same name."""
    numbered = unique_names(df.columns)
    first = [n for n, original in zip(numbered, df.columns) if n == original]
    return df.toDF(*numbered).select(*[F.col(f"`{n}`") for n in first])


def keep_columns_of(df: DataFrame, other: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in other.columns])


def union_by_name(frames: Iterable[DataFrame]) -> DataFrame:
    """All rows of all frames; a column a frame lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_keep_left(older: DataFrame, update: DataFrame) -> DataFrame:
    """All rows of both frames with only the columns of the first."""
    return keep_columns_of(union_by_name([older, update]), older)
