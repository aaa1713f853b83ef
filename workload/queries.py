"""One query per operator, over whole supplied tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rentatlas.functions import dates, recode, text
from rentatlas.functions.geometry import to_degrees
from rentatlas.functions.numbers import na_max
from rentatlas.operators import classify, columns, normalize, spatial, summarize, year_built
from rentatlas.plans import catalogue
from rentatlas.sinks import csv, points
from rentatlas.sources import csv as source_csv
from rentatlas.sources import schema
from rentatlas.sources.polygons import readable, rings_from_geojson, rings_from_wkt
from workload import views

Query = Callable[[SparkSession, str], DataFrame]


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = views.listings(spark, sf_dir).drop("eight_bedroom", "longitude_merge", "latitude_merge")
    return classify.add_flags(normalize.normalize_listings(df))


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = classify.whole_units(flagged(spark, sf_dir))
    return df.withColumn("periodblt", recode.age_band(recode.known_year(F.col("yr_built"))))


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.clean_units(units(spark, sf_dir))


def units_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = classify.whole_units(flagged(spark, sf_dir))
    return kept.select("id", "ask", "numRooms", "source_id", "muni", "update_lag")


def _scam_filter(rule: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        names = ["id", "ask", "zip_code", "BASE_merge", "numRooms"]
        return classify.drop_probable_scams(views.listings(spark, sf_dir, names), rule)

    return query


def _flag(name: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = views.listings(spark, sf_dir, ["id", "title"])
        return classify.add_flags(df).select("id", "title", name)

    return query


def update_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = views.listings(spark, sf_dir, ["id", "post_date", "updated_date"])
    return df.withColumn(
        "update_lag", dates.day_lag(F.col("updated_date"), F.col("post_date"))
    )


def quarter_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.add_quarter(views.listings(spark, sf_dir, ["id", "year", "month"]))


def _coord_override(parity: bool) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        names = [
            "id", "source_id", "post_date", "updated_date",
            "longitude", "latitude", "longitude_merge", "latitude_merge",
        ]
        df = normalize.normalize_listings(views.listings(spark, sf_dir, names), parity)
        return df.drop("post_date", "updated_date", "update_lag")

    return query


def recode_if_null_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = views.listings(spark, sf_dir, ["id", "rooms8", "eight_bedroom"])
    return df.withColumn(
        "eight_bedroom", recode.eight_bedroom_flag(F.col("rooms8"), F.col("eight_bedroom"))
    )


def arlington_nhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["id", "muni", "ct10_id", "neighborhood_01"]
    return classify.name_neighborhoods(views.listings(spark, sf_dir, names))


def split_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    location = F.col("location")
    return views.starts(spark, sf_dir).select(
        "ord",
        text.location_part(location, 0).alias("latitude"),
        text.location_part(location, 1).alias("longitude"),
    )


def completion_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return year_built.completion_years(views.completions(spark, sf_dir))


def latest_starts(spark: SparkSession, sf_dir: str, mode: str = "both_max") -> DataFrame:
    df = views.starts(spark, sf_dir).select("parloc_id", "camb_yr_built", "ord")
    return year_built.latest_per_key(df, "parloc_id", "camb_yr_built", "ord", mode)


def _latest(mode: str) -> Query:
    return lambda spark, sf_dir: latest_starts(spark, sf_dir, mode)


def max_year_per_parcel(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = completion_year(spark, sf_dir)
    return done.groupBy("parloc_id").agg(na_max(F.col("bos_yr_built")).alias("bos_yr_built"))


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.listings(spark, sf_dir, ["id", "parloc_id", "yr_built"])


def join_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return year_built.join_starts(_keyed(spark, sf_dir), latest_starts(spark, sf_dir))


def join_completions_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return year_built.join_completions(_keyed(spark, sf_dir), completion_year(spark, sf_dir))


def join_completions_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = year_built.completion_years(views.completions(spark, sf_dir), dedupe="max_year")
    return year_built.join_completions(_keyed(spark, sf_dir), done)


def completions_fanout_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return year_built.repeated_by_completions(completion_year(spark, sf_dir))


def year_built_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = year_built.join_partner_years(
        _keyed(spark, sf_dir), latest_starts(spark, sf_dir), completion_year(spark, sf_dir)
    )
    return year_built.override_year_built(joined)


def age_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = views.listings(spark, sf_dir, ["id", "yr_built"])
    return df.withColumn("periodblt", recode.age_band(recode.known_year(F.col("yr_built"))))


def union_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["id", "month", "zip_code", "BASE_merge"]
    df = views.listings(spark, sf_dir, names)
    quarters = [df.where(F.ceil(F.col("month") / 3) == q) for q in (1, 2, 3, 4)]
    quarters[0] = quarters[0].drop("BASE_merge")
    quarters[2] = quarters[2].drop("zip_code")
    return columns.union_by_name(quarters)


def union_keep_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    older = views.completions(spark, sf_dir).select("parloc_id", "complete_date")
    update = views.starts(spark, sf_dir).select("parloc_id", "ord")
    return columns.union_keep_left(older, update)


def project_to_state_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = views.listings(spark, sf_dir, ["id", "longitude", "latitude"])
    return spatial.add_state_plane(df).select(
        "id", F.round("x", 2).alias("x"), F.round("y", 2).alias("y")
    )


def project_and_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = views.listings(spark, sf_dir, ["id", "longitude", "latitude"])
    lon, lat = to_degrees(F.col("x"), F.col("y"))
    return spatial.add_state_plane(df).select(
        "id", F.round(lon, 6).alias("longitude"), F.round(lat, 6).alias("latitude")
    )


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.listings(spark, sf_dir, ["id", "x", "y"])


def _pip_parcels(match: str, strategy: str = "auto") -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spatial.attach_polygons(
            _points(spark, sf_dir), views.parcels(spark, sf_dir), ["poly_idx", "parloc_id"],
            match=match, strategy=strategy,
        )

    return query


def pip_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.attach_polygons(
        _points(spark, sf_dir), views.zip_areas(spark, sf_dir),
        ["poly_idx", "postcode", "pc_name"],
    )


def pip_town_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    permits = views.starts(spark, sf_dir).select("ord", "camb_yr_built", "x", "y")
    town = views.parcels(spark, sf_dir).where(F.col("town") == "Cambridge")
    return spatial.attach_polygons(permits, town, ["parloc_id"])


def _product(product: catalogue.Product) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = units(spark, sf_dir) if product.source == "units" else clean(spark, sf_dir)
        if product.source == "forward":
            df = classify.forward_geocoded(df)
        if "quarter" in product.keys:
            df = normalize.add_quarter(df)
        return summarize.summarize(df, product)

    return query


def summaries_one_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarize.summarize_all(clean(spark, sf_dir), catalogue.PERIOD_TABLES)


def annual_one_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = normalize.add_quarter(clean(spark, sf_dir))
    return summarize.summarize_all(df, catalogue.ANNUAL_PRODUCTS)


def town_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.in_towns(
        summarize.rent_stats(clean(spark, sf_dir), ["muni", "numRooms"])
    )


def enriched_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The period job from points to clean units, on parcels, ZIP areas and partner records."""
    names = [
        "id", "ask", "numRooms", "source_id", "muni", "neighborhood_01", "ct10_id", "BASE_merge",
        "post_date", "updated_date", "year", "month", "title", "x", "y",
    ]
    df = classify.add_flags(normalize.normalize_listings(views.listings(spark, sf_dir, names)))
    df = spatial.attach_polygons(
        df, views.parcels(spark, sf_dir), ["parloc_id", "yr_built"]
    )
    df = spatial.attach_polygons(df, views.zip_areas(spark, sf_dir), ["postcode"])
    df = year_built.join_partner_years(
        df, latest_starts(spark, sf_dir), completion_year(spark, sf_dir)
    )
    df = year_built.override_year_built(df.withColumnRenamed("postcode", "zip_code"))
    return classify.clean_units(classify.whole_units(df))


def period_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarize.rent_stats(
        enriched_units(spark, sf_dir), ["source_id", "muni", "zip_code", "numRooms", "periodblt"]
    )


def _rings(kind: str) -> Query:
    read = rings_from_wkt if kind == "wkt" else rings_from_geojson

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        texts = views.parcel_texts(spark, sf_dir, kind)
        rings = readable(read(F.col("text")), F.col("poly_idx"))
        flat = texts.select("poly_idx", rings.alias("rings")).withColumn("p", F.flatten("rings"))

        def total(axis: str) -> Column:
            return F.aggregate("p", F.lit(0.0), lambda t, p: t + p[axis])

        return flat.select(
            "poly_idx", F.size("rings").alias("n_rings"), F.size("p").alias("n_points"),
            total("x").alias("sum_x"), total("y").alias("sum_y"),
        )

    return query


def unit_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = views.listings(spark, sf_dir, ["id", "longitude", "latitude"])
    return points.unit_points(df).select(
        "id", F.round("x", 2).alias("x"), F.round("y", 2).alias("y"), "srid"
    )


def geojson_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = views.listings(spark, sf_dir, ["id", "muni", "x", "y"])
    return points.geojson_features(df.withColumn("srid", F.lit(26986)))


def printable(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = views.listings(spark, sf_dir, ["id", "ask", "fwd_geolocated", "latitude"])
    return csv.printable(df.withColumn("ask", F.col("ask").cast("double"))).withColumn(
        "latitude", F.col("latitude").cast("string")
    )


def parse_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = views.starts(spark, sf_dir).select(
        F.when(F.col("ord") % 17 == 0, "soon").otherwise(F.col("camb_yr_built").cast("string"))
        .alias("Year Permitted"),
        F.col("ord").cast("string").alias("Order"), F.col("location").alias("Location"),
    )
    return source_csv.parse_starts(raw)


def _raw_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings as an extract holds them: text, other names, some values that do not fit."""
    df = views.listings(spark, sf_dir).drop("eight_bedroom")
    bad = {"ask": (53, "1,000"), "year": (59, "soon")}
    texts = []
    for name in ("id", *schema.REQUIRED_LISTING_COLUMNS):
        text = F.col(name).cast("string")
        if name in bad:
            every, wrong = bad[name]
            unfit = (F.col("id") % every == 0) & text.isNotNull()
            text = F.when(unfit, wrong).otherwise(text)
        texts.append(text.alias({"year": "Year", "month": "Month"}.get(name, name)))
    return df.select(*texts)


def conform_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema.conform_listings(_raw_listings(spark, sf_dir)).select(
        "id", "ask", "numRooms", "year", "month", "ct10_id", "source_id", "muni", "four_bedroom"
    )


def unreadable_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema.unreadable(
        _raw_listings(spark, sf_dir), schema.LISTING_NAMES, schema.LISTING_TYPES
    )


def clean_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = views.table(spark, sf_dir, "orders")
    exprs = {**views.COMPLETIONS_COLUMNS, "ord": "o_orderkey", "again": "o_orderkey%7"}
    raw = views.derive(orders, exprs).toDF(
        "Ward & Parcel", "Complete Date", "Permit #", "complete.date"
    )
    return columns.clean_names(raw)


def first_of_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = views.listings(spark, sf_dir, ["id", "muni", "numRooms"])
    wide = df.select(F.lit(1), "id", "muni", F.lit("other"), "numRooms", F.lit(0)).toDF(
        "X", "id", "muni", "muni", "numRooms", "ID"
    )
    return columns.first_of_repeated(columns.drop_index_column(wide))


def ordered_by_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place each row of a published table has in its output."""
    keys = ["muni", "numRooms"]
    groups = clean(spark, sf_dir).select(*keys).distinct()
    placed = summarize.sorted_by_keys(groups, keys).withColumn(
        "seen", F.monotonically_increasing_id()
    )
    return placed.select(
        *keys, F.row_number().over(Window.orderBy("seen")).alias("place")
    )


PRODUCTS: dict[str, catalogue.Product] = {
    "counts": catalogue.COUNTS,
    **{f"sum_{p.name}": p for p in catalogue.PERIOD_TABLES},
    **{
        p.name: p
        for p in (
            catalogue.ANNUAL_COUNTS, *catalogue.ANNUAL_TABLES, catalogue.ANNUAL_FORWARD,
            *catalogue.QUARTERLY_TABLES,
        )
    },
}

QUERIES: dict[str, Query] = {
    "units_filter": units_filter,
    "scam_filter_address": _scam_filter("address"),
    "scam_filter_zip": _scam_filter("zip"),
    "flag_roomrent": _flag("roomrent"),
    "flag_sublet": _flag("sublet"),
    "flag_shortterm": _flag("shortterm"),
    "flag_shared": _flag("shared"),
    "update_lag": update_lag,
    "quarter_label": quarter_label,
    "coord_override": _coord_override(parity=True),
    "coord_override_nonzero": _coord_override(parity=False),
    "recode_if_null_safe": recode_if_null_safe,
    "arlington_nhood": arlington_nhood,
    "split_location": split_location,
    "completion_year": completion_year,
    "year_built_override": year_built_override,
    "age_band": age_band,
    "latest_per_parcel": _latest("both_max"),
    "latest_per_parcel_lexicographic": _latest("lexicographic"),
    "max_year_per_parcel": max_year_per_parcel,
    "join_starts": join_starts,
    "join_completions_fanout": join_completions_fanout,
    "join_completions_latest": join_completions_latest,
    "completions_fanout_report": completions_fanout_report,
    "union_quarters": union_quarters,
    "union_keep_left": union_keep_left,
    "project_to_state_plane": project_to_state_plane,
    "project_and_back": project_and_back,
    "pip_parcels_one": _pip_parcels("last"),
    "pip_parcels_one_shuffled": _pip_parcels("last", "shuffle"),
    "pip_parcels_all": _pip_parcels("all"),
    "pip_parcels_all_shuffled": _pip_parcels("all", "shuffle"),
    "pip_zip": pip_zip,
    "pip_town_subset": pip_town_subset,
    **{name: _product(p) for name, p in PRODUCTS.items()},
    "parcel_rings_wkt": _rings("wkt"),
    "parcel_rings_geojson": _rings("geojson"),
    "unit_points": unit_points,
    "geojson_features": geojson_features,
    "printable": printable,
    "parse_starts": parse_starts,
    "conform_types": conform_types,
    "unreadable_values": unreadable_values,
    "clean_names": clean_names,
    "first_of_repeated": first_of_repeated,
    "ordered_by_keys": ordered_by_keys,
    "summaries_one_pass": summaries_one_pass,
    "annual_one_pass": annual_one_pass,
    "town_partition": town_partition,
    "period_end_to_end": period_end_to_end,
}
