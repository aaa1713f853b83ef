"""Conditional columns that keep the missing-value rules of the analysis."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The building-age bands of the published tables.
BUILT_BEFORE = "a_Before 2011"
BUILT_LATER = "b_2011 or later"
BUILT_UNKNOWN = "d_NA"
BAND_YEAR = 2011

TRACT_TOWN = "ARLINGTON"
GEOCODED_SOURCE = 2


def eight_bedroom_flag(rooms: Column, flag: Column) -> Column:
    """1/0 for eight-room units, 0 for others, NULL when the room count is NULL."""
    return F.when(rooms == 8, (flag == 1).cast("int")).when(rooms.isNotNull(), F.lit(0))


def merged_coordinate(
    original: Column, merged: Column, source: Column, parity: bool = True
) -> Column:
    """Geocoded coordinate for rows of the geocoded source, the original one otherwise.

    ``parity`` tests the merged value for ``< 0``, so positive latitudes are never taken;
    without it any non-zero value is. A NULL source gives NULL where the test holds.
    """
    merged = F.coalesce(merged, F.lit(0.0))
    usable = (merged < 0) if parity else (merged != 0)
    known = F.coalesce(source == GEOCODED_SOURCE, F.lit(False))
    return F.when(usable & known, merged).when(~usable | source.isNotNull(), original)


def neighborhood_or_tract(muni: Column, tract: Column, neighborhood: Column) -> Column:
    """Census tract as text in the one town without neighborhood names; NULL town, NULL result."""
    return F.when(muni == TRACT_TOWN, tract.cast("bigint").cast("string")).when(
        muni.isNotNull(), neighborhood
    )


def known_year(year: Column) -> Column:
    """Year as an integer, 0 when missing or not a number."""
    return F.coalesce(year.try_cast("double").try_cast("int"), F.lit(0))


def year_built(parcel: Column, start: Column, completion: Column) -> Column:
    """Completion year over housing-start year over parcel year; inputs use 0 for unknown."""
    return F.when(completion > 0, completion).when(start > 0, start).otherwise(parcel)


def age_band(year: Column) -> Column:
    return (
        F.when(F.coalesce(year, F.lit(0)) == 0, BUILT_UNKNOWN)
        .when(year >= BAND_YEAR, BUILT_LATER)
        .otherwise(BUILT_BEFORE)
    )
