"""First pass over an extract: recodes, day lag and coordinate override."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentatlas.functions.dates import day_lag, quarter_label
from rentatlas.functions.recode import eight_bedroom_flag, merged_coordinate


def normalize_listings(df: DataFrame, parity: bool = True) -> DataFrame:
    """Add ``update_lag``, recode ``eight_bedroom`` and apply the geocoded coordinates.

    The coordinate columns before the override stay in ``*_original``. Extracts of the
    vintages without ``*_merge`` columns keep their coordinates.
    """
    columns = {"update_lag": day_lag(F.col("updated_date"), F.col("post_date"))}
    if "eight_bedroom" in df.columns:
        columns["eight_bedroom"] = eight_bedroom_flag(F.col("numRooms"), F.col("eight_bedroom"))
    for axis in ("latitude", "longitude"):
        merged = f"{axis}_merge"
        if merged in df.columns:
            columns[f"{axis}_original"] = F.col(axis)
            columns[axis] = merged_coordinate(
                F.col(axis), F.col(merged), F.col("source_id"), parity
            )
            columns[merged] = F.coalesce(F.col(merged), F.lit(0.0))
    return df.withColumns(columns)


def add_quarter(df: DataFrame) -> DataFrame:
    return df.withColumn("quarter", quarter_label(F.col("year"), F.col("month")))
