"""The yearly roll-up of quarterly unit tables, and the point export."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rentatlas.functions.dates import day_lag
from rentatlas.functions.recode import eight_bedroom_flag
from rentatlas.operators.classify import add_flags, clean_units, forward_geocoded, whole_units
from rentatlas.operators.columns import drop_index_column, first_of_repeated, union_by_name
from rentatlas.operators.normalize import add_quarter
from rentatlas.operators.spatial import add_state_plane, attach_polygons
from rentatlas.operators.summarize import summarize, summarize_all
from rentatlas.plans.catalogue import (
    ANNUAL_COUNTS,
    ANNUAL_FORWARD,
    ANNUAL_PRODUCTS,
)
from rentatlas.plans.period import stage_products, write_products, write_units
from rentatlas.session import Staging, required_conf
from rentatlas.sinks.publish import Publication
from rentatlas.sinks.points import unit_points, write_points
from rentatlas.sources.schema import (
    NOT_ANNUAL,
    PARCEL_ATTRS,
    UNIT_TYPES,
    ZIP_ATTRS,
    conform_listings,
    unit_columns,
)


def union_extracts(quarters: Sequence[DataFrame]) -> DataFrame:
    """Quarterly tables, each brought to canonical names and types, stacked by name."""
    return union_by_name(
        [conform_listings(first_of_repeated(drop_index_column(q))) for q in quarters]
    )


def overlay_again(
    df: DataFrame, parcels: DataFrame, zips: DataFrame, xy: tuple[str, str]
) -> DataFrame:
    """Fresh ZIP codes; parcel columns the quarterly tables already carry are kept."""
    points = add_state_plane(df.drop("zip_code", "zip_muni"), xy)
    missing = [a for a in PARCEL_ATTRS if a not in df.columns]
    if missing:
        points = attach_polygons(points, parcels, missing)
    points = attach_polygons(points, zips, ZIP_ATTRS)
    return points.drop("x", "y").withColumnsRenamed(
        {"postcode": "zip_code", "pc_name": "zip_muni"}
    )


def annual_units(
    quarters: Sequence[DataFrame],
    parcels: DataFrame | None = None,
    zips: DataFrame | None = None,
    xy: tuple[str, str] = ("longitude", "latitude"),
) -> DataFrame:
    """Whole fresh units of the year; coordinates were already settled in the quarterly job."""
    df = add_quarter(union_extracts(quarters)).withColumns(
        {
            "update_lag": day_lag(F.col("updated_date"), F.col("post_date")),
            "eight_bedroom": eight_bedroom_flag(F.col("numRooms"), F.col("eight_bedroom")),
        }
    )
    df = whole_units(add_flags(df))
    if parcels is not None and zips is not None:
        df = overlay_again(df, parcels, zips, xy)
    absent = {
        name: F.lit(None).cast(kind)
        for name, kind in UNIT_TYPES.items() if name not in df.columns
    }
    df = df.withColumns(absent)
    return df.select(*unit_columns(df, NOT_ANNUAL))


def run_year(
    spark: SparkSession,
    quarters: Sequence[DataFrame],
    out: str,
    period: str,
    parcels: DataFrame | None = None,
    zips: DataFrame | None = None,
    scam: str | None = None,
    forward: bool = False,
    xy: tuple[str, str] = ("longitude", "latitude"),
) -> None:
    """Write the unit tables, counts and all annual and quarterly summaries of one year.

    ``forward`` adds the summary of the forward-geocoded units, which is not published as a rule.
    """
    with (
        required_conf(spark), Staging(spark) as staging,
        Publication(spark, out, period) as publication,
    ):
        units = staging.stage(annual_units(quarters, parcels, zips, xy), "units")
        clean = clean_units(units, scam)
        long = stage_products(staging, summarize_all(clean, ANNUAL_PRODUCTS))
        single = [(ANNUAL_COUNTS, summarize(units, ANNUAL_COUNTS))]
        if forward:
            single.append((ANNUAL_FORWARD, forward_summary(clean)))
        products = list(ANNUAL_PRODUCTS)
        for product, rows in single:
            long = long.unionByName(
                rows.withColumn("product", F.lit(product.name)), allowMissingColumns=True
            )
            products.append(product)
        write_units(publication, units, clean)
        write_products(publication, long, products)


def forward_summary(clean: DataFrame) -> DataFrame:
    """Summary of the forward-geocoded units."""
    return summarize(forward_geocoded(clean), ANNUAL_FORWARD)


def run_export(
    units: DataFrame, out: str, xy: tuple[str, str] = ("longitude", "latitude"),
    srid: int = 26986, formats: Sequence[str] = ("parquet", "geojson"),
) -> None:
    """Write the points of a clean unit table, one folder per town."""
    points = unit_points(units, xy, srid)
    for fmt in formats:
        write_points(points, f"{out}/format={fmt}", fmt)
