"""Whole-unit, freshness and probable-scam rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentatlas.functions.recode import neighborhood_or_tract
from rentatlas.functions.text import is_room_rent, is_shared, is_short_term, is_sublet

# The published rules.
MAX_LAG_DAYS = 30
SCAM_ZIP = "02108"
SCAM_STREETS = ["Acorn", "Willow"]
SCAM_BELOW = 700
UNKNOWN_ROOMS = -1
TOWNS = ["BOSTON", "CAMBRIDGE", "QUINCY", "SOMERVILLE", "ARLINGTON"]


def add_flags(df: DataFrame) -> DataFrame:
    title = F.col("title")
    return df.withColumns(
        {
            "roomrent": is_room_rent(title),
            "sublet": is_sublet(title),
            "shortterm": is_short_term(title),
            "shared": is_shared(title),
        }
    )


FLAGS = ["roomrent", "sublet", "shortterm", "shared"]


def whole_units(df: DataFrame) -> DataFrame:
    """Fresh offers of whole units; a NULL lag or flag drops the row.

    What passes has all flags false, so they are constants from here on and the titles are
    searched only once, in the filter.
    """
    flagged = reduce(lambda a, b: a | b, [F.col(c) for c in FLAGS])
    kept = df.where(~flagged & (F.col("update_lag") <= MAX_LAG_DAYS))
    return kept.withColumns({c: F.lit(False) for c in FLAGS})


def drop_probable_scams(df: DataFrame, rule: str | None = None) -> DataFrame:
    """Drop cheap offers in the suspect ZIP and rows without a known room count.

    ``"address"`` limits the ZIP rule to two streets, ``"zip"`` does not; by default the first
    where the street column exists. A condition that comes out NULL drops the row.
    """
    rule = rule or ("address" if "BASE_merge" in df.columns else "zip")
    suspect = (F.col("zip_code") == SCAM_ZIP) & (F.col("ask") < SCAM_BELOW)
    if rule == "address":
        suspect = suspect & F.col("BASE_merge").isin(SCAM_STREETS)
    elif rule != "zip":
        raise ValueError(f"unknown scam rule {rule!r}")
    return df.where(~suspect & (F.col("numRooms") != UNKNOWN_ROOMS))


def name_neighborhoods(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "neighborhood_01",
        neighborhood_or_tract(F.col("muni"), F.col("ct10_id"), F.col("neighborhood_01")),
    )


def clean_units(units: DataFrame, rule: str | None = None) -> DataFrame:
    return name_neighborhoods(drop_probable_scams(units, rule))


def in_towns(df: DataFrame, towns: list[str] | None = None) -> DataFrame:
    return df.where(F.col("muni").isin(towns or TOWNS))


def forward_geocoded(df: DataFrame) -> DataFrame:
    return df.where(F.col("fwd_geolocated"))
