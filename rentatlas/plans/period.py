"""The month and quarter jobs."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rentatlas.operators.classify import add_flags, clean_units, in_towns, whole_units
from rentatlas.operators.normalize import normalize_listings
from rentatlas.operators.spatial import (
    PolygonIndex,
    add_state_plane,
    attach_polygons,
    index_polygons,
)
from rentatlas.operators.summarize import summarize_all
from rentatlas.operators.year_built import (
    completion_years,
    join_partner_years,
    latest_per_key,
    override_year_built,
)
from rentatlas.plans.catalogue import PERIOD_PRODUCTS, Product
from rentatlas.session import Staging, required_conf
from rentatlas.sinks.csv import write_by_town, write_csv, write_tables
from rentatlas.sinks.publish import Publication
from rentatlas.sources.schema import PARCEL_ATTRS, ZIP_ATTRS, unit_columns


@dataclass(frozen=True)
class Inputs:
    """``listings`` and ``starts`` as the readers give them.

    ``parcels`` and ``zips`` are layers with ``poly_idx, rings`` or indexes made of them.
    """

    listings: DataFrame
    parcels: DataFrame | PolygonIndex
    zips: DataFrame | PolygonIndex
    starts: DataFrame
    completions: DataFrame


@dataclass(frozen=True)
class Rules:
    """Choices on which the published vintages differ; the defaults are the current ones."""

    xy: tuple[str, str] = ("longitude", "latitude")
    starts_xy: tuple[str, str] = ("longitude", "latitude")
    starts_town: str = "Cambridge"
    parity: bool = True
    match: str = "last"
    latest: str = "both_max"
    completions_dedupe: str | None = None
    scam: str | None = None


OVERLAY = [
    *PARCEL_ATTRS, *ZIP_ATTRS, "zip_code", "zip_muni", "camb_yr_built", "bos_yr_built", "periodblt",
    "x", "y",
]


def indexed(inputs: Inputs, staging: Staging | None = None) -> Inputs:
    """The layers as indexes: each is planned and cut into cells once for all its joins.

    With ``staging`` the cells are written once as well.
    """

    def one(layer: DataFrame | PolygonIndex, attrs: list[str], name: str) -> PolygonIndex:
        if isinstance(layer, PolygonIndex):
            return layer
        if staging is None:
            return index_polygons(layer, attrs)
        return index_polygons(layer, attrs, stage=lambda rows: staging.stage(rows, name))

    return replace(
        inputs,
        parcels=one(inputs.parcels, [*PARCEL_ATTRS, "muni"], "parcel-cells"),
        zips=one(inputs.zips, ZIP_ATTRS, "zip-cells"),
    )


def starts_by_parcel(inputs: Inputs, rules: Rules) -> DataFrame:
    """Latest housing start of each parcel of the permitting town."""
    town = inputs.parcels.where(F.col("muni") == rules.starts_town)
    points = add_state_plane(inputs.starts, rules.starts_xy)
    placed = attach_polygons(points, town, ["parloc_id"], match=rules.match).select(
        "parloc_id", "camb_yr_built", "ord"
    )
    return latest_per_key(placed, "parloc_id", "camb_yr_built", "ord", rules.latest)


def enrich(listings: DataFrame, inputs: Inputs, rules: Rules) -> DataFrame:
    """Parcel, ZIP area, year built and age band of each listing."""
    df = add_state_plane(listings, rules.xy)
    df = attach_polygons(df, inputs.parcels, PARCEL_ATTRS, match=rules.match)
    df = attach_polygons(df, inputs.zips, ZIP_ATTRS, match=rules.match)
    df = df.withColumnsRenamed({"postcode": "zip_code", "pc_name": "zip_muni"})
    done = completion_years(inputs.completions, dedupe=rules.completions_dedupe)
    df = join_partner_years(df, starts_by_parcel(inputs, rules), done)
    return override_year_built(df).drop("x", "y")


def build_units(inputs: Inputs, rules: Rules = Rules()) -> DataFrame:
    """Fresh whole units with the published columns in their order.

    The unit filter needs listing columns only, so it runs before the joins. What an extract
    already carries of the columns the joins attach (``OVERLAY``) is replaced.
    """
    fresh = inputs.listings.drop(*OVERLAY)
    listings = whole_units(add_flags(normalize_listings(fresh, rules.parity)))
    units = enrich(listings, indexed(inputs), rules)
    return units.select(*unit_columns(units))


def write_units(
    publication: Publication, units: DataFrame, clean: DataFrame
) -> None:
    """The unit tables, the clean units of each published town among them."""
    town = "towns/clean_units"
    write_csv(publication.counted(units, {"units": None}), f"{publication.region}/product=units")
    write_csv(
        publication.counted(clean, {"clean_units": None}),
        f"{publication.region}/product=clean_units",
    )
    write_by_town(
        publication.counted(in_towns(clean), {town: None}),
        f"{publication.towns}/product=clean_units", rebalance=True,
    )


def write_products(publication: Publication, long: DataFrame, products: list[Product]) -> None:
    """All summaries in two writes: region-wide, and by town where a product has towns."""
    tables = {p.name: F.col("product") == p.name for p in products}
    write_tables(
        long, products, publication.region, watch=lambda df: publication.counted(df, tables)
    )
    local = [p for p in products if p.by_town]
    tables = {f"towns/{p.name}": F.col("product") == p.name for p in local}
    towns = in_towns(long.where(F.col("product").isin([p.name for p in local])))
    write_tables(
        towns.withColumn("town", F.col("muni")), local, publication.towns, ["town"],
        lambda df: publication.counted(df, tables),
    )


def run_period(
    spark: SparkSession, inputs: Inputs, out: str, period: str, rules: Rules = Rules()
) -> None:
    """Write all tables of one month or quarter under ``out``.

    The units are staged once, as the spatial and partner joins are the costly part; the clean
    units are a filter on the staged files, pushed into their scan. Readers see all of the tables or
    those of the run before (``sinks.publish``).
    """
    with (
        required_conf(spark), Staging(spark) as staging,
        Publication(spark, out, period) as publication,
    ):
        units = staging.stage(build_units(indexed(inputs, staging), rules), "units")
        clean = clean_units(units, rules.scam)
        long = stage_products(staging, summarize_all(clean, PERIOD_PRODUCTS))
        write_units(publication, units, clean)
        write_products(publication, long, PERIOD_PRODUCTS)


def stage_products(staging: Staging, long: DataFrame) -> DataFrame:
    """The summaries with a folder per product, so that each table reads its own files only."""
    return staging.stage(long, "summaries", ["product"])
