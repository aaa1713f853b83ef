"""Canonical columns of each source and how the vintages are brought to them."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentatlas.operators.columns import assert_columns, rename_present

# The column names and types of the extracts.
ROOM_COLUMNS = ["studio", "one_bedroom", "two_bedroom", "three_bedroom", "four_bedroom"]
LONG_ROOM_COLUMNS = ["five_bedroom", "six_bedroom"]

LISTING_TYPES: dict[str, str] = {
    "id": "string",
    "ask": "double",
    "bedrooms": "string",
    "numRooms": "int",
    "title": "string",
    "original_title": "string",
    "source_id": "int",
    "survey_id": "string",
    "post_date": "string",
    "created_date": "string",
    "updated_date": "string",
    "month": "int",
    "year": "int",
    "latitude": "double",
    "longitude": "double",
    "ct10_id": "bigint",
    "muni_ID": "string",
    "muni": "string",
    "comm_type": "string",
    "neighborhood_01": "string",
    "neighborhood_02": "string",
    "neighborhood_03": "string",
    **{name: "int" for room in ROOM_COLUMNS for name in (room, f"{room}_not_in_range")},
    "eight_bedroom": "int",
    "post_at": "string",
    "created_at": "string",
    "updated_at": "string",
    "uniqueid": "string",
}

# The columns every vintage must have.
REQUIRED_LISTING_COLUMNS = [
    "ask", "numRooms", "title", "source_id", "post_date", "updated_date", "month", "year",
    "latitude", "longitude", "ct10_id", "muni", "neighborhood_01",
]

# Columns of the geocoded vintages only; never made up for the others.
GEOCODED_TYPES: dict[str, str] = {
    "fwd_geolocated": "boolean",
    "rev_geolocated": "boolean",
    "mapzen_geolocated": "boolean",
    "mapzen_confidence": "string",
    "tract10": "string",
    "tract10_fwd_geocode": "string",
    "latitude_original": "double",
    "longitude_original": "double",
    "latitude_merge": "double",
    "longitude_merge": "double",
    "census_tract": "string",
    "ADDR_NUM_merge": "string",
    "BASE_merge": "string",
    "COMMUNITY_Merge": "string",
    "joint_addresses_merge": "string",
}

# Columns a finished unit table carries beyond those of an extract.
UNIT_TYPES: dict[str, str] = {
    "update_lag": "int",
    "quarter": "string",
    "zip_code": "string",
    "zip_muni": "string",
    **{name: "int" for room in LONG_ROOM_COLUMNS for name in (room, f"{room}_not_in_range")},
    "periodblt": "string",
    "roomrent": "boolean",
    "sublet": "boolean",
    "shortterm": "boolean",
    "shared": "boolean",
    "parloc_id": "string",
    "luc_adj_1": "string",
    "luc_adj_2": "string",
    "yr_built": "int",
    "camb_yr_built": "int",
    "bos_yr_built": "int",
}

# Names that differ between vintages.
LISTING_NAMES: dict[str, str] = {
    "Year": "year",
    "Month": "month",
    **{
        f"{room}{gap}_not_in_range": f"{room}_not_in_range"
        for room in (*ROOM_COLUMNS, *LONG_ROOM_COLUMNS)
        for gap in (" ", ".")
    },
}

# Column order of the published unit tables. Columns a vintage lacks are left out.
UNIT_COLUMNS = [
    "id", "ask", "bedrooms", "numRooms", "title", "original_title", "source_id", "survey_id",
    "post_date", "created_date", "updated_date", "update_lag", "month", "year", "quarter",
    "latitude", "longitude", "ct10_id", "muni_ID", "muni", "zip_code", "zip_muni", "comm_type",
    "neighborhood_01", "neighborhood_02", "neighborhood_03",
    *[n for room in (*ROOM_COLUMNS, *LONG_ROOM_COLUMNS) for n in (room, f"{room}_not_in_range")],
    "periodblt", "roomrent", "sublet", "shortterm", "shared",
    *GEOCODED_TYPES,
    "post_at", "created_at", "updated_at", "uniqueid",
    "parloc_id", "luc_adj_1", "luc_adj_2", "yr_built", "camb_yr_built", "bos_yr_built",
]

# The yearly unit tables are published without these.
NOT_ANNUAL = ["id", "ADDR_NUM_merge"]

PARCEL_ATTRS = ["parloc_id", "luc_adj_1", "luc_adj_2", "yr_built"]
ZIP_ATTRS = ["postcode", "pc_name"]

STARTS_NAMES = {
    "Year.Permitted": "camb_yr_built",
    "Year Permitted": "camb_yr_built",
    "year_permitted": "camb_yr_built",
    "Order": "ord",
    "Location": "location",
}

# The header of the completions file.
COMPLETION_COLUMNS = [
    "Project", "Street Number", "Street Name", "Total New Units", "Complete Date", "COO Number",
    "Permit #", "Agency", "Planning District", "Market Area", "TOD 5 Min Walk", "TOD 1/2 Mile",
    "Ward & Parcel", "parloc_id", "Census Tract", "Council District", "LAT", "LONG",
    "DESCRIPTION",
]


def conform(
    df: DataFrame,
    types: Mapping[str, str],
    names: Mapping[str, str],
    required: Iterable[str],
    optional: Mapping[str, str],
    what: str,
) -> DataFrame:
    """Canonical names and types; missing ``types`` become typed NULLs, unknown columns stay.

    A value that does not fit its type becomes NULL, a missing required column is an error.
    """
    df = assert_columns(rename_present(df, names), required, what)
    present = {c.lower(): c for c in df.columns}
    wanted = {**types, **{c: t for c, t in optional.items() if c.lower() in present}}

    def typed(name: str, kind: str):
        if name.lower() not in present:
            return F.lit(None).cast(kind).alias(name)
        return F.col(f"`{present[name.lower()]}`").try_cast(kind).alias(name)

    known = {c.lower() for c in wanted}
    rest = [F.col(f"`{c}`") for c in df.columns if c.lower() not in known]
    return df.select(*[typed(c, t) for c, t in wanted.items()], *rest)


def conform_listings(df: DataFrame) -> DataFrame:
    return conform(
        df, LISTING_TYPES, LISTING_NAMES, REQUIRED_LISTING_COLUMNS,
        {**GEOCODED_TYPES, **UNIT_TYPES}, "the listings extract",
    )


def unit_columns(df: DataFrame, without: Iterable[str] = ()) -> list[str]:
    present = {c.lower() for c in df.columns}
    return [c for c in UNIT_COLUMNS if c.lower() in present and c not in without]


def unreadable(raw: DataFrame, names: Mapping[str, str], types: Mapping[str, str]) -> DataFrame:
    """How many values of each typed column hold text that is not of the type: ``column, rows``."""
    named = rename_present(raw, names)
    present = {c.lower(): c for c in named.columns}
    checked = [c for c, t in types.items() if t != "string" and c.lower() in present]
    counts = named.agg(*[
        F.count_if(
            (F.trim(F.col(f"`{present[c.lower()]}`").cast("string")) != "")
            & F.col(f"`{present[c.lower()]}`").try_cast(types[c]).isNull()
        ).alias(c)
        for c in checked
    ])
    return counts.unpivot([], checked, "column", "rows").where("rows > 0")
