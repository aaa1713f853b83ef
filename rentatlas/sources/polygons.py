"""Polygon layers from Parquet, well-known text or GeoJSON.

Every reader gives ``poly_idx, rings`` and attributes. A feature whose rings cannot be read fails the
job; an empty geometry stays as a polygon without rings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rentatlas.functions.geometry import RINGS_TYPE
from rentatlas.operators.columns import assert_columns

WKT_HEAD = r"(?i)^\s*(?:SRID=\d+;)?\s*(?:MULTI)?POLYGON\s*(?:ZM|Z|M)?\s*"
LAYOUTS = ("collection", "lines")


def no_rings() -> Column:
    return F.array().cast(RINGS_TYPE)


def rings_from_wkt(wkt: Column) -> Column:
    """Rings of ``POLYGON`` and ``MULTIPOLYGON`` text, holes and parts in one list.

    ``EMPTY`` gives an empty list, a text that is neither gives NULL.
    """
    body = F.regexp_replace(wkt, WKT_HEAD, "")
    inner = F.regexp_replace(F.regexp_replace(body, r"^[(\s]+", ""), r"[)\s]+$", "")

    def point(text: Column) -> Column:
        numbers = F.split(F.trim(text), r"\s+")
        return F.struct(
            F.get(numbers, F.lit(0)).try_cast("double").alias("x"),
            F.get(numbers, F.lit(1)).try_cast("double").alias("y"),
        )

    rings = F.transform(
        F.split(inner, r"\)[\s)]*,[\s(]*\("), lambda r: F.transform(F.split(r, ","), point)
    )
    readable = ~F.exists(F.flatten(rings), lambda p: p["x"].isNull() | p["y"].isNull())
    return (
        F.when(wkt.rlike(WKT_HEAD + r"EMPTY\s*$"), no_rings())
        .when(wkt.rlike(WKT_HEAD + r"\(\s*\(.*\)\s*\)\s*$") & readable, rings)
    )


def rings_from_geojson(geometry: Column) -> Column:
    """Rings of a GeoJSON ``Polygon`` or ``MultiPolygon`` text.

    A null geometry or one without coordinates gives an empty list, anything else NULL.
    """
    kind = F.get_json_object(geometry, "$.type")
    text = F.get_json_object(geometry, "$.coordinates")
    polygon = F.from_json(text, "array<array<array<double>>>")
    parts = F.from_json(text, "array<array<array<array<double>>>>")

    def point(pair: Column) -> Column:
        return F.struct(
            F.get(pair, F.lit(0)).alias("x"), F.get(pair, F.lit(1)).alias("y")
        )

    found = F.when(kind == "Polygon", polygon).when(kind == "MultiPolygon", F.flatten(parts))
    rings = F.transform(found, lambda ring: F.transform(ring, point))
    readable = ~F.exists(F.flatten(rings), lambda p: p["x"].isNull() | p["y"].isNull())
    empty = geometry.isNull() | (F.trim(geometry) == "null")
    return F.when(empty, no_rings()).when(readable, rings)


def readable(rings: Column, name: Column) -> Column:
    """The rings, or an error that names the feature that has none to read."""
    what = F.concat(F.coalesce(name.cast("string"), F.lit("a feature")),
                    F.lit(" has no readable rings"))
    return F.when(rings.isNull(), F.raise_error(what).cast(RINGS_TYPE)).otherwise(
        rings.cast(RINGS_TYPE)
    )


def with_rings(df: DataFrame, wkt: str, order: str) -> DataFrame:
    """A table with a well-known-text column as a layer; ``order`` numbers its polygons."""
    rings = readable(rings_from_wkt(F.col(wkt)), F.col(order))
    return df.select(
        F.col(order).cast("bigint").alias("poly_idx"),
        *[F.col(f"`{c}`") for c in df.columns if c not in (wkt, "poly_idx")],
        rings.alias("rings"),
    )


def _properties(attrs: dict[str, str], order: str) -> str:
    types = {**attrs, order: "bigint"}
    return f"struct<{', '.join(f'`{n}`: {t}' for n, t in types.items())}>"


def _feature_type(attrs: dict[str, str], order: str) -> str:
    return f"struct<type: string, properties: {_properties(attrs, order)}, geometry: string>"


def _layer(features: DataFrame, attrs: dict[str, str], order: str) -> DataFrame:
    """Rows with one struct ``f`` per feature as a layer."""
    number = F.col(f"f.properties.{order}")
    wrong = F.raise_error(F.lit("a row of the layer is no GeoJSON feature"))
    kind = F.when(F.col("f.type") == "Feature", F.col("f.geometry")).otherwise(wrong.cast("string"))
    return features.select(
        number.alias("poly_idx"),
        *[F.col(f"f.properties.{a}").alias(a) for a in attrs],
        readable(rings_from_geojson(kind), number).alias("rings"),
    )


def read_geojson(
    spark: SparkSession, path: str, attrs: dict[str, str], order: str = "objectid",
    layout: str = "collection",
) -> DataFrame:
    """A GeoJSON layer; ``attrs`` types the properties.

    ``collection``: files that hold one feature collection or one feature each, however they are
    broken into lines; a file is one task. ``lines``: one feature per line, split freely. Whatever is
    not of the layout fails the job.
    """
    feature = _feature_type(attrs, order)
    if layout == "lines":
        rows = spark.read.text(path).where(F.trim("value") != "")
        parsed = F.from_json("value", feature, {"mode": "FAILFAST"})
        return _layer(rows.select(parsed.alias("f")), attrs, order)
    if layout != "collection":
        raise ValueError(f"unknown layout {layout!r}")
    whole = spark.read.schema(
        f"type string, features array<{feature}>, properties {_properties(attrs, order)},"
        " geometry string"
    ).json(path, multiLine=True, mode="FAILFAST")
    single = F.struct("type", "properties", "geometry")
    features = F.when(F.col("type") == "FeatureCollection", F.col("features")).otherwise(
        F.array(single)
    )
    return _layer(whole.select(F.explode(features).alias("f")), attrs, order)


def read_layer(spark: SparkSession, path: str, attrs: list[str]) -> DataFrame:
    """A polygon layer in Parquet with ``poly_idx``, ``rings`` and the attributes asked for."""
    layer = spark.read.parquet(path)
    return assert_columns(layer, ["poly_idx", "rings", *attrs], f"the layer {path}")
