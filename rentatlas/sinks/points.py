"""Unit points for mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentatlas.functions.geometry import STATE_PLANE_SRID, WGS84_SRID
from rentatlas.operators.classify import in_towns
from rentatlas.operators.spatial import add_state_plane


def unit_points(
    units: DataFrame,
    xy: tuple[str, str] = ("longitude", "latitude"),
    srid: int = STATE_PLANE_SRID,
) -> DataFrame:
    """Units with ``x, y, srid``; ``xy`` names the degree columns, which may be text."""
    degrees = [F.col(c).try_cast("double") for c in xy]
    if srid == STATE_PLANE_SRID:
        named = units.withColumns({"x": degrees[0], "y": degrees[1]})
        points = add_state_plane(named, ("x", "y"))
    elif srid == WGS84_SRID:
        points = units.withColumns({"x": degrees[0], "y": degrees[1]})
    else:
        raise ValueError(f"unknown reference system {srid}")
    return points.withColumn("srid", F.lit(srid))


def geojson_features(points: DataFrame) -> DataFrame:
    """One GeoJSON feature per row in ``value``; rows without coordinates have no geometry."""
    properties = F.struct(*[F.col(f"`{c}`") for c in points.columns if c not in ("x", "y", "srid")])
    geometry = F.when(
        F.col("x").isNotNull() & F.col("y").isNotNull(),
        F.struct(F.lit("Point").alias("type"), F.array("x", "y").alias("coordinates")),
    )
    feature = F.struct(
        F.lit("Feature").alias("type"),
        geometry.alias("geometry"),
        properties.alias("properties"),
    )
    return points.select(
        F.col("muni").alias("town"),
        F.to_json(feature, {"ignoreNullFields": "false"}).alias("value"),
    )


def write_points(points: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Points of the published towns, one folder per town."""
    towns = in_towns(points)
    if fmt == "parquet":
        towns.withColumn("town", F.col("muni")).write.mode("overwrite").partitionBy(
            "town"
        ).parquet(path)
    elif fmt == "geojson":
        geojson_features(towns).write.mode("overwrite").partitionBy("town").text(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")
