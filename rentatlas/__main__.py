"""Command line: ``python -m rentatlas month|quarter|year|export …``."""

from __future__ import annotations

import argparse
import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from rentatlas.functions.dates import previous_month, previous_quarter
from rentatlas.functions.geometry import STATE_PLANE_SRID
from rentatlas.operators.columns import assert_columns
from rentatlas.plans.annual import run_export, run_year
from rentatlas.plans.period import Inputs, Rules, run_period
from rentatlas.sources.csv import (
    read_completions,
    read_csv,
    read_listings,
    read_recoded,
    read_starts,
)
from rentatlas.sources.polygons import read_geojson, read_layer, with_rings
from rentatlas.sources.schema import PARCEL_ATTRS, ZIP_ATTRS


def _add_reading(p: argparse.ArgumentParser) -> None:
    p.add_argument("--no-multiline", action="store_true",
                   help="no line breaks inside fields: large files are split")
    p.add_argument("--encoding", default="UTF-8")
    p.add_argument("--blank", choices=["text", "null"], default="text")
    p.add_argument("--swapped-axes", action="store_true")
    p.add_argument("--scam", choices=["address", "zip"])
    p.add_argument("--layer-format", default="parquet",
                   choices=["parquet", "geojson", "geojson-lines", "wkt"])
    p.add_argument("--parcel-order", default="poly_idx", help="column that numbers the parcels")
    p.add_argument("--zip-order", default="objectid", help="column that numbers the ZIP areas")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="rentatlas")
    jobs = top.add_subparsers(dest="job", required=True)
    for job in ("month", "quarter"):
        p = jobs.add_parser(job)
        p.add_argument("listings", nargs="+")
        p.add_argument("-y", "--year", type=int)
        p.add_argument(f"-{job[0]}", f"--{job}", dest="part", type=int)
        for name in ("parcels", "zips", "starts", "completions"):
            p.add_argument(f"--{name}", required=True)
        p.add_argument("--completions-update")
        p.add_argument("--completions-key", default="parloc_id")
        p.add_argument("--completions-dedupe", choices=["max_year"])
        p.add_argument("--completions-declared", action="store_true")
        p.add_argument("--match", choices=["last", "all"], default="last")
        p.add_argument("--latest", choices=["both_max", "lexicographic"], default="both_max")
        p.add_argument("--any-merged", action="store_true",
                       help="take every geocoded coordinate, not only negative ones")
        p.add_argument("--starts-town", default="Cambridge")
        p.add_argument("--starts-swapped", action="store_true")
        p.add_argument("--out", required=True)
        _add_reading(p)
    p = jobs.add_parser("year")
    p.add_argument("quarters", nargs="+")
    p.add_argument("-y", "--year", type=int)
    p.add_argument("--parcels")
    p.add_argument("--zips")
    p.add_argument("--forward", action="store_true", help="also the forward-geocoded summary")
    p.add_argument("--out", required=True)
    _add_reading(p)
    p = jobs.add_parser("export")
    p.add_argument("units")
    p.add_argument("--x", default="longitude")
    p.add_argument("--y", default="latitude")
    p.add_argument("--srid", type=int, default=STATE_PLANE_SRID)
    p.add_argument("--encoding", default="ISO-8859-1")
    p.add_argument("--infer-types", action="store_true")
    p.add_argument("--out", required=True)
    return top


def rules_of(args: argparse.Namespace) -> Rules:
    axes = ("longitude", "latitude")
    return Rules(
        xy=axes[::-1] if args.swapped_axes else axes,
        starts_xy=axes[::-1] if args.starts_swapped else axes,
        starts_town=args.starts_town, parity=not args.any_merged, match=args.match,
        latest=args.latest, completions_dedupe=args.completions_dedupe, scam=args.scam,
    )


def read_polygons(
    spark: SparkSession, path: str, attrs: list[str], fmt: str, order: str, text: str = "wkt"
) -> DataFrame:
    """A layer in any of the formats; ``wkt`` is a delimited file with the column ``wkt``."""
    if fmt == "parquet":
        return read_layer(spark, path, attrs)
    if fmt == "wkt":
        table = read_csv(spark, path, blank="null")
        return assert_columns(with_rings(table, text, order), attrs, f"the layer {path}")
    layout = "lines" if fmt == "geojson-lines" else "collection"
    return read_geojson(spark, path, dict.fromkeys(attrs, "string"), order, layout)


def period_label(job: str, year: int | None, part: int | None, today: dt.date) -> str:
    """``2021-01`` or ``2021Q1``; what is not given comes from the last completed period."""
    last_year, last_part = previous_month(today) if job == "month" else previous_quarter(today)
    part = part or last_part
    year = year or last_year
    top = 12 if job == "month" else 4
    if not 1 <= part <= top:
        raise ValueError(f"{job} must be between 1 and {top}")
    return f"{year}-{part:02d}" if job == "month" else f"{year}Q{part}"


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"rentatlas-{args.job}").getOrCreate()
    today = dt.date.today()
    if args.job == "export":
        units = read_recoded(spark, args.units, args.encoding, args.infer_types)
        run_export(units, args.out, (args.x, args.y), args.srid)
        return
    reading = dict(encoding=args.encoding, multiline=not args.no_multiline, blank=args.blank)

    def layers(parcel_attrs: list[str]) -> list[DataFrame]:
        return [
            read_polygons(spark, args.parcels, parcel_attrs, args.layer_format, args.parcel_order),
            read_polygons(spark, args.zips, ZIP_ATTRS, args.layer_format, args.zip_order),
        ]

    if args.job == "year":
        quarters = [read_csv(spark, p, repeated="first", **reading) for p in args.quarters]
        given = layers(PARCEL_ATTRS) if args.parcels and args.zips else [None, None]
        axes = ("latitude", "longitude") if args.swapped_axes else ("longitude", "latitude")
        run_year(
            spark, quarters, args.out, str(args.year or today.year - 1), *given,
            scam=args.scam, forward=args.forward, xy=axes,
        )
        return
    partner = dict(multiline=not args.no_multiline, blank=args.blank)
    inputs = Inputs(
        read_listings(spark, args.listings, **reading),
        *layers([*PARCEL_ATTRS, "muni"]),
        read_starts(spark, args.starts, **partner),
        read_completions(
            spark, args.completions, args.completions_update, args.completions_key,
            declared=args.completions_declared, **partner,
        ),
    )
    label = period_label(args.job, args.year, args.part, today)
    run_period(spark, inputs, args.out, label, rules_of(args))


if __name__ == "__main__":
    main()
