"""Advertisements, parcels and partner records derived from the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rentatlas.functions.geometry import RINGS_TYPE
from workload.tables import (
    COMPLETIONS_COLUMNS,
    LISTING_COLUMNS,
    PARCEL_COLUMNS,
    STARTS_COLUMNS,
    ZIP_COLUMNS,
    parcel_text,
)

#: Parts of more rows are not broadcast. Spark goes by the size of compressed files, of which few bytes may
#: hold more rows than the driver's memory has room for.
BROADCAST_PARTS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derive(
    df: DataFrame, columns: dict[str, str], names: list[str] | None = None
) -> DataFrame:
    return df.selectExpr(*[f"{columns[n]} as {n}" for n in names or columns])


def listings(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> DataFrame:
    """One advertisement per line item; ``id`` is not unique, as in the supplied tables."""
    lines = table(spark, sf_dir, "lineitem")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    if parts.count() > BROADCAST_PARTS:  # from the files' footers
        parts = parts.hint("merge")
    joined = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return derive(joined, LISTING_COLUMNS, names)


def starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(table(spark, sf_dir, "orders"), STARTS_COLUMNS)


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(table(spark, sf_dir, "orders"), COMPLETIONS_COLUMNS)


def _ring(*corners: tuple[str, str]) -> str:
    points = ", ".join(f"struct(double({x}) as x, double({y}) as y)" for x, y in corners)
    return f"array({points})"


def parcel_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(table(spark, sf_dir, "supplier"), PARCEL_COLUMNS)


def parcel_texts(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Every parcel box as well-known text (``wkt``) or as a GeoJSON geometry (``geojson``)."""
    return parcel_boxes(spark, sf_dir).selectExpr("poly_idx", f"{parcel_text(kind)} as text")


def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping rectangles, every third one cut to its lower-left triangle."""
    boxes = parcel_boxes(spark, sf_dir)
    box = _ring(("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0"))
    triangle = _ring(("x0", "y0"), ("x1", "y0"), ("x0", "y1"), ("x0", "y0"))
    rings = f"array(if(poly_idx%3=0, {triangle}, {box}))"
    return boxes.selectExpr(
        "poly_idx", "parloc_id", "town", "yr_built", f"cast({rings} as {RINGS_TYPE}) as rings"
    )


def zip_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tessellation of rectangles that share their edges, each with a hole."""
    boxes = derive(table(spark, sf_dir, "supplier"), ZIP_COLUMNS)
    outer = _ring(
        ("x0", "y0"), ("x0+200", "y0"), ("x0+200", "y0+100"), ("x0", "y0+100"), ("x0", "y0")
    )
    hole = _ring(
        ("x0+50", "y0+25"), ("x0+100", "y0+25"), ("x0+100", "y0+50"), ("x0+50", "y0+50"),
        ("x0+50", "y0+25"),
    )
    return boxes.selectExpr(
        "poly_idx", "postcode", "pc_name", f"cast(array({outer}, {hole}) as {RINGS_TYPE}) as rings"
    )
