"""Readers, writers and whole jobs on small files."""

import csv
import glob
import json
import os
from dataclasses import replace

import pytest
from conftest import values
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from rentatlas.__main__ import main, parser, read_polygons, rules_of
from rentatlas.functions.geometry import RINGS_TYPE
from rentatlas.operators.columns import MissingColumns
from rentatlas.plans.annual import annual_units, forward_summary, run_year
from rentatlas.operators.classify import clean_units
from rentatlas.operators.summarize import sorted_by_keys, summarize
from rentatlas.plans import period
from rentatlas.plans.catalogue import PERIOD_TABLES, Product
from rentatlas.plans.period import Inputs, Rules, build_units, run_period
from rentatlas.sinks import publish
from rentatlas.sinks.csv import table_columns, write_csv, write_tables
from rentatlas.sinks.points import unit_points
from rentatlas.sinks.publish import published
from rentatlas.sources.csv import (
    MissingSource,
    read_completions,
    read_csv,
    read_declared_text,
    read_listings,
    read_recoded,
    read_starts,
)
from rentatlas.sources.polygons import read_geojson, read_layer, with_rings
from rentatlas.sources.schema import (
    COMPLETION_COLUMNS,
    LISTING_NAMES,
    LISTING_TYPES,
    PARCEL_ATTRS,
    ZIP_ATTRS,
    unreadable,
)

HEADER = [
    "", "id", "ask", "bedrooms", "numRooms", "title", "original_title", "source_id", "survey_id",
    "post_date", "created_date", "updated_date", "Month", "Year", "latitude", "longitude",
    "ct10_id", "muni_ID", "muni", "comm_type", "neighborhood_01", "neighborhood_02",
    "neighborhood_03", "studio", "studio _not_in_range", "one_bedroom", "eight_bedroom",
    "latitude_merge", "longitude_merge", "BASE_merge", "fwd_geolocated", "uniqueid",
]


def listing(i, **over):
    row = dict.fromkeys(HEADER, "NA")
    row.update({
        "": i, "id": i, "ask": 1000 + i, "bedrooms": "2", "numRooms": 2, "title": " NICE FLAT ",
        "source_id": 1, "post_date": "2021-01-01", "updated_date": "2021-01-05 10:00:00",
        "Month": 1, "Year": 2021, "latitude": 42.36, "longitude": -71.06, "ct10_id": 25017356100,
        "muni": "BOSTON", "neighborhood_01": "N1", "studio": 0, "studio _not_in_range": 1,
        "eight_bedroom": 1, "fwd_geolocated": "TRUE", "uniqueid": f"u{i}",
    })
    row.update(over)
    return row


LISTINGS = [
    listing(1, title=' LOFT, "BRIGHT"\nAND NEW '),
    listing(2, longitude=-71.0),                                   # other ZIP, no parcel
    listing(3, title=" SUBLET "),
    listing(4, updated_date="2021-03-01"),
    listing(5, numRooms=-1),
    listing(6, ask=500, BASE_merge="Acorn"),
    listing(7, ask=500, BASE_merge="Main"),
    listing(8, muni="ARLINGTON"),
    listing(9, muni="MEDFORD", ask="NA", longitude=-71.12),
    listing(10, source_id=2, longitude=-71.0, longitude_merge=-71.06),
    listing(11, latitude="NA", longitude="NA"),
    listing(12, muni="CAMBRIDGE", longitude=-71.12),
    listing(13, ask=20000000, title="NA"),
]


def write_rows(path, header, rows, encoding="utf-8"):
    with open(path, "w", newline="", encoding=encoding) as f:
        writer = csv.DictWriter(f, header)
        writer.writeheader()
        writer.writerows(rows)
    return str(path)


def square(x0, y0, x1, y1):
    return [[(float(x0), float(y0)), (float(x1), float(y0)), (float(x1), float(y1)),
             (float(x0), float(y1)), (float(x0), float(y0))]]


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("input")
    listings = write_rows(d / "listings.csv", HEADER, LISTINGS)
    # (-71.06, 42.36) lies near (236247, 901149), (-71.12, 42.36) near (231304, 901127).
    parcels = spark.createDataFrame(
        [(0, "P1", "Boston", "1950", "L1", "L2", square(236000, 901000, 236500, 901500)),
         (1, "P2", "Cambridge", "1980", "L1", "L2", square(231000, 901000, 231500, 901500))],
        "poly_idx bigint, parloc_id string, muni string, yr_built string, luc_adj_1 string,"
        f" luc_adj_2 string, rings {RINGS_TYPE}",
    )
    parcels.write.parquet(str(d / "parcels"))
    zips = spark.createDataFrame(
        [(0, "02108", "Boston", square(235000, 900000, 238000, 903000)),
         (1, "02139", "Cambridge", square(225000, 900000, 235000, 903000))],
        f"poly_idx bigint, postcode string, pc_name string, rings {RINGS_TYPE}",
    )
    zips.write.parquet(str(d / "zips"))
    starts = write_rows(d / "starts.csv", ["Year Permitted", "Order", "Location"], [
        {"Year Permitted": 2012, "Order": 1, "Location": "(42.36, -71.12)"},
        {"Year Permitted": 2014, "Order": 2, "Location": "(42.36, -71.12)"},
        {"Year Permitted": 2015, "Order": 9, "Location": "nowhere"},
    ])
    row = dict.fromkeys(COMPLETION_COLUMNS, "NA")
    done = write_rows(d / "completions.csv", COMPLETION_COLUMNS, [
        {**row, "Project": "Café", "Complete Date": "3/5/2018", "parloc_id": "P1",
         "Ward & Parcel": "W1"},
        {**row, "Complete Date": "n/a", "parloc_id": "P9", "Ward & Parcel": "P1"},
    ], "latin-1")
    update = write_rows(d / "update.csv", ["Ward & Parcel", "Complete Date", "Extra"], [
        {"Ward & Parcel": "W7", "Complete Date": "01/02/2019", "Extra": "x"}], "latin-1")
    return {"dir": str(d), "listings": listings, "parcels": str(d / "parcels"),
            "zips": str(d / "zips"), "starts": starts, "completions": done, "update": update}


@pytest.fixture(scope="module")
def inputs(spark, files):
    return Inputs(
        read_listings(spark, files["listings"]),
        read_layer(spark, files["parcels"], [*PARCEL_ATTRS, "muni"]),
        read_layer(spark, files["zips"], ZIP_ATTRS),
        read_starts(spark, files["starts"]),
        read_completions(spark, files["completions"]),
    )


def test_listings_reader(spark, files):
    df = read_listings(spark, files["listings"])
    assert df.columns[0] == "id" and "studio_not_in_range" in df.columns
    kinds = dict(df.dtypes)
    assert kinds["ct10_id"] == "bigint" and kinds["ask"] == "double" and kinds["year"] == "int"
    assert kinds["four_bedroom"] == "int" and "census_tract" not in kinds
    row = df.where("id = '1'").first()
    assert row.title == ' LOFT, "BRIGHT"\nAND NEW ' and row.four_bedroom is None
    assert df.where("id = '9'").first().ask is None


def test_reader_errors(spark, files, tmp_path):
    with pytest.raises(MissingSource, match="does not exist"):
        read_csv(spark, str(tmp_path / "absent.csv"))
    write_rows(tmp_path / "short.csv", ["id", "ask"], [{"id": 1, "ask": 2}])
    with pytest.raises(MissingColumns, match="numRooms"):
        read_listings(spark, str(tmp_path / "short.csv"))
    with pytest.raises(MissingColumns, match="yr_built"):
        read_layer(spark, files["zips"], ["yr_built"])
    write_rows(tmp_path / "other.csv", ["ask", "id"], [{"id": 1, "ask": 2}])
    both = read_csv(spark, [str(tmp_path / "short.csv"), str(tmp_path / "other.csv")])
    with pytest.raises(Exception, match="(?i)header"):
        both.collect()


def test_latin_1_and_completion_keys(spark, files):
    text = read_declared_text(spark, files["completions"])
    assert text.columns == COMPLETION_COLUMNS and text.first()["Project"] == "Café"
    by_parcel = read_completions(spark, files["completions"])
    assert values(by_parcel) == [("P1", "3/5/2018"), ("P9", "n/a")]
    by_ward = read_completions(spark, files["completions"], files["update"], key="ward_parcel")
    assert sorted(values(by_ward)) == [("P1", "n/a"), ("W1", "3/5/2018"), ("W7", "01/02/2019")]


def test_swapped_location_order(spark, files):
    row = read_starts(spark, files["starts"], order=("longitude", "latitude")).first()
    assert (row.longitude, row.latitude) == (42.36, -71.12)


# The published headers.
ROOMS = ["studio", "one_bedroom", "two_bedroom", "three_bedroom", "four_bedroom"]
PERIOD_HEADER = [
    "id", "ask", "bedrooms", "numRooms", "title", "original_title", "source_id", "survey_id",
    "post_date", "created_date", "updated_date", "update_lag", "month", "year",
    "latitude", "longitude", "ct10_id", "muni_ID", "muni", "zip_code", "zip_muni", "comm_type",
    "neighborhood_01", "neighborhood_02", "neighborhood_03",
    *[n for r in ROOMS for n in (r, r + "_not_in_range")],
    "periodblt", "roomrent", "sublet", "shortterm", "shared",
    "fwd_geolocated", "latitude_original", "longitude_original", "latitude_merge",
    "longitude_merge", "BASE_merge", "post_at", "created_at", "updated_at", "uniqueid",
    "parloc_id", "luc_adj_1", "luc_adj_2", "yr_built", "camb_yr_built", "bos_yr_built",
]
LONG_ROOMS = ["five_bedroom", "six_bedroom"]
ANNUAL_HEADER = [
    "ask", "bedrooms", "numRooms", "title", "original_title", "source_id", "survey_id",
    "post_date", "created_date", "updated_date", "update_lag", "month", "year", "quarter",
    "latitude", "longitude", "ct10_id", "muni_ID", "muni", "zip_code", "zip_muni", "comm_type",
    "neighborhood_01", "neighborhood_02", "neighborhood_03",
    *[n for r in (*ROOMS, *LONG_ROOMS) for n in (r, r + "_not_in_range")],
    "periodblt", "roomrent", "sublet", "shortterm", "shared",
    "fwd_geolocated", "latitude_original", "longitude_original", "latitude_merge",
    "longitude_merge", "BASE_merge", "post_at", "created_at", "updated_at", "uniqueid",
    "parloc_id", "luc_adj_1", "luc_adj_2", "yr_built", "camb_yr_built", "bos_yr_built",
]


def test_units(inputs):
    units = build_units(inputs)
    rows = {r.id: r for r in units.collect()}
    assert set(rows) == {"1", "2", "5", "6", "7", "8", "9", "10", "11", "12", "13"}
    assert (rows["1"].parloc_id, rows["1"].zip_code, rows["1"].yr_built) == ("P1", "02108", 2018)
    assert rows["1"].periodblt == "b_2011 or later" and rows["1"].update_lag == 4
    assert (rows["12"].camb_yr_built, rows["12"].yr_built) == (2014, 2014)
    assert rows["10"].parloc_id == "P1" and rows["10"].longitude_original == -71.0
    assert rows["11"].zip_code is None and rows["11"].periodblt == "d_NA"
    assert units.columns == PERIOD_HEADER


def test_overlay_columns_of_an_extract_are_replaced(inputs):
    own = inputs.listings.withColumns({"parloc_id": F.lit("old"), "zip_code": F.lit("old")})
    row = build_units(replace(inputs, listings=own)).where("id = '1'").first()
    assert (row.parloc_id, row.zip_code) == ("P1", "02108")


def test_blank_text_is_a_value(spark, inputs, tmp_path):
    """A blank street in the suspect ZIP is another street, a blank town a group of its own."""
    rows = [listing(40, ask=500, BASE_merge=""), listing(41, ask=500, BASE_merge="NA"),
            listing(42, muni=""), listing(43, muni="NA"), listing(44, numRooms="", title="")]
    path = write_rows(tmp_path / "blank.csv", HEADER, rows)
    for blank, kept, towns in (("text", {"40", "42", "43"}, {"", None}),
                               ("null", {"42", "43"}, {None})):
        raw = read_listings(spark, path, blank=blank)
        clean = clean_units(build_units(replace(inputs, listings=raw)))
        out = {r.id: r for r in clean.collect()}
        assert set(out) == kept and {out[i].muni for i in ("42", "43")} == towns
        assert out["42"].neighborhood_01 == ("N1" if blank == "text" else None)
        summary = summarize(clean, next(p for p in PERIOD_TABLES if p.name == "muni"))
        assert {r.muni for r in summary.collect()} >= towns


def test_swapped_axes(inputs):
    swapped = Inputs(
        inputs.listings.withColumns({"latitude": F.col("longitude"), "longitude": F.col("latitude")}),
        inputs.parcels, inputs.zips, inputs.starts, inputs.completions,
    )
    rules = Rules(xy=("latitude", "longitude"))
    row = build_units(swapped, rules).where("id = '1'").first()
    assert row.parloc_id == "P1"


def read_back(path):
    names = glob.glob(os.path.join(path, "part-*.csv"))
    rows = []
    for name in names:
        with open(name, newline="", encoding="utf-8") as f:
            rows += list(csv.DictReader(f))
    return rows


def test_month_job(spark, inputs, tmp_path):
    out = str(tmp_path / "out")
    run_period(spark, inputs, out, "2021-01")
    region = f"{out}/period=2021-01"
    assert len(os.listdir(region)) == 13
    clean = {r["id"]: r for r in read_back(f"{region}/product=clean_units")}
    assert set(clean) == {"1", "2", "7", "8", "9", "10", "11", "12", "13"}
    assert clean["1"]["title"] == ' LOFT, "BRIGHT"\nAND NEW ' and clean["1"]["roomrent"] == "FALSE"
    assert clean["9"]["ask"] == "NA" and clean["13"]["ask"] == "20000000"
    assert clean["8"]["neighborhood_01"] == "25017356100" and clean["1"]["ask"] == "1001"
    assert len(read_back(f"{region}/product=units")) == 11
    muni = read_back(f"{region}/product=muni")
    assert [r["muni"] for r in muni] == ["ARLINGTON", "BOSTON", "CAMBRIDGE", "MEDFORD"]
    boston = next(r for r in muni if r["muni"] == "BOSTON")
    assert boston == {"muni": "BOSTON", "numRooms": "2", "rentcount": "6",
                      "meanrent": "3334087", "medrent": "1006"}
    assert next(r for r in muni if r["muni"] == "MEDFORD")["medrent"] == "NA"
    counts = read_back(f"{region}/product=counts")
    assert list(counts[0]) == ["year", "month", "source_id", "rentcount", "medrent"]
    towns = f"{out}/towns/period=2021-01"
    assert sorted(os.listdir(towns)) == [f"product={p}" for p in (
        "clean_units", "muni", "muni_age", "nhood", "nhood_age")]
    for product in os.listdir(towns):
        names = {n for n in os.listdir(f"{towns}/{product}") if n.startswith("town=")}
        assert names == {"town=ARLINGTON", "town=BOSTON", "town=CAMBRIDGE"}
    assert read_back(f"{towns}/product=muni/town=BOSTON")[0]["muni"] == "BOSTON"


def test_year_job_and_export(spark, inputs, files, tmp_path):
    out = str(tmp_path / "out")
    write_csv(build_units(inputs), f"{out}/q1")
    later = [listing(i, Month=5, title=" FLAT ") for i in range(20, 24)]
    raw = write_rows(tmp_path / "q2.csv", HEADER, later)
    quarters = [read_csv(spark, f"{out}/q1"), read_csv(spark, raw)]
    units = annual_units(quarters)
    labels = {r[0]: r[1] for r in units.groupBy("quarter").count().collect()}
    assert labels == {"2021 Q1": 11, "2021 Q2": 4}
    assert units.columns == ANNUAL_HEADER
    assert units.where("uniqueid = 'u1'").first().zip_code == "02108"
    again = annual_units(quarters, inputs.parcels, inputs.zips)
    assert again.where("uniqueid = 'u20'").first().zip_code == "02108"
    assert again.where("uniqueid = 'u1'").first().parloc_id == "P1"
    run_year(spark, quarters, out, "2021", inputs.parcels, inputs.zips)
    region, towns = f"{out}/period=2021", f"{out}/towns/period=2021"
    # Three unit and count tables, nine annual and ten quarterly summaries.
    assert len(os.listdir(region)) == 22
    # Units and eight summaries for each town: 45 town tables.
    assert len(os.listdir(towns)) == 9
    assert sum(int(r["rentcount"]) for r in read_back(f"{region}/product=annual_counts")) == 15
    full = read_back(f"{region}/product=quarterly_full")
    assert {r["quarter"] for r in full} == {"2021 Q1", "2021 Q2"}
    clean = read_csv(spark, f"{region}/product=clean_units")
    assert clean.count() == 13
    assert forward_summary(units.where("numRooms <> -1")).agg(F.sum("rentcount")).first()[0] == 14

    main(["export", f"{region}/product=clean_units", "--out", f"{out}/points",
          "--encoding", "UTF-8"])
    points = spark.read.parquet(f"{out}/points/format=parquet")
    boston = points.where("town = 'BOSTON' and uniqueid = 'u1'").first()
    assert (round(boston.x), round(boston.y), boston.srid) == (236247, 901149, 26986)
    lines = spark.read.text(f"{out}/points/format=geojson/town=CAMBRIDGE").collect()
    feature = json.loads(lines[0].value)
    assert feature["type"] == "Feature" and feature["properties"]["uniqueid"] == "u12"
    assert feature["geometry"]["coordinates"][0] == pytest.approx(231304, abs=1)


def test_header_clean_and_typed_points(spark, tmp_path):
    path = write_rows(tmp_path / "c.csv", ["id", "studio._not_in_range", "lon", "lat", "muni"], [
        {"id": 1, "studio._not_in_range": 3, "lon": -71.5, "lat": 41, "muni": "Café"}],
        "latin-1")
    df = read_recoded(spark, path, infer_types=True)
    assert dict(df.dtypes)["studio_not_in_range"] == "int" and df.first().muni == "Café"
    point = unit_points(df, ("lon", "lat")).first()
    assert (point.x, point.y) == pytest.approx((200000, 750000), abs=1e-6)
    same = unit_points(df, ("lon", "lat"), srid=4326).first()
    assert (same.x, same.y, same.srid) == (-71.5, 41.0, 4326)


def test_numbers_and_text_survive_a_round_trip(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, 1e7, -71.0589, True, ' a "b", c '), (2, None, 12345678.25, None, None),
         (3, 2.5e-5, 1e20, False, "x\ny")],
        "i int, d double, e double, b boolean, s string",
    )
    write_csv(df, str(tmp_path / "t"))
    rows = {r["i"]: r for r in read_back(str(tmp_path / "t"))}
    assert rows["1"] == {"i": "1", "d": "10000000", "e": "-71.0589", "b": "TRUE",
                         "s": ' a "b", c '}
    assert rows["2"] == {"i": "2", "d": "NA", "e": "12345678.25", "b": "NA", "s": "NA"}
    assert rows["3"]["d"] == "0.000025" and float(rows["3"]["e"]) == 1e20
    back = read_csv(spark, str(tmp_path / "t"))
    assert back.where("i = '3'").first().s == "x\ny" and back.where("i = '2'").first().b is None


def test_layer_texts(spark, tmp_path):
    table = spark.createDataFrame([(3, "02108", "POLYGON ((0 0, 1 0, 1 1, 0 0))")],
                                  "objectid int, postcode string, wkt string")
    layer = with_rings(table, "wkt", "objectid")
    row = layer.first()
    assert row.poly_idx == 3 and len(row.rings[0]) == 4
    feature = ('{ "type": "Feature", "properties": { "objectid": 7, "postcode": "02139" },'
               ' "geometry": { "type": "Polygon", "coordinates":'
               ' [ [ [0, 0], [1, 0], [1, 1], [0, 0] ] ] } }')
    other = feature.replace("7", "8")
    broken = feature.replace("7", "9").replace('"Polygon"', '"LineString"')
    empty = '{"type":"Feature","properties":{"objectid":9},"geometry":null}'
    head = '{"type": "FeatureCollection", "features": ['
    layouts = {
        "one line": f"{head}{feature}, {other}]}}",
        "first line": f"{head}{feature},\n{other}\n]}}\n",
        "indented": json.dumps(json.loads(f"{head}{feature}, {other}]}}"), indent=2),
        "own lines": f"{head}\n{feature},\n{other}\n]}}\n",
    }

    def read(text, **options):
        path = tmp_path / f"zips{len(os.listdir(tmp_path))}.geojson"
        path.write_text(text)
        rows = read_geojson(spark, str(path), {"postcode": "string"}, **options)
        return [(r.poly_idx, r.postcode, [len(x) for x in r.rings])
                for r in rows.orderBy("poly_idx").collect()]

    both = [(7, "02139", [4]), (8, "02139", [4])]
    for text in layouts.values():
        assert read(text) == both
    assert read(feature) == both[:1]
    assert read(f"{feature}\n\n{other}\n", layout="lines") == both
    assert read(f"{head}{feature}, {empty}]}}")[1] == (9, None, [])
    for text, options in ((f"{head}{feature}, {broken}]}}", {}), (head + feature, {}),
                          (layouts["own lines"], {"layout": "lines"}), ('{"type": "x"}', {})):
        with pytest.raises(Exception, match="(?i)readable|feature|malformed"):
            read(text, **options)


def test_first_of_repeated_names(spark, tmp_path):
    path = tmp_path / "again.csv"
    path.write_text("id,x,X,id\n1,2,3,4\n")
    assert read_csv(spark, str(path)).columns == ["id", "x", "X_2", "id_2"]
    first = read_csv(spark, str(path), repeated="first")
    assert first.columns == ["id", "x"] and values(first) == [("1", "2")]


def test_values_that_do_not_fit_are_counted(spark, tmp_path):
    rows = [listing(1, ask="1,000"), listing(2, Year="soon"), listing(3, ask="")]
    raw = read_csv(spark, write_rows(tmp_path / "l.csv", HEADER, rows))
    report = unreadable(raw, LISTING_NAMES, LISTING_TYPES)
    assert sorted(values(report)) == [("ask", 1), ("year", 1)]


def test_settings_and_staged_tables_do_not_outlive_a_job(spark, inputs, tmp_path):
    key = "spark.sql.codegen.hugeMethodLimit"
    before, shared = spark.conf.get(key, None), spark.conf.get("spark.checkpoint.dir")
    run_period(spark, inputs, str(tmp_path / "out"), "2021-01")
    assert spark.conf.get(key, None) == before
    assert not [n for n in os.listdir(shared) if n.startswith("rentatlas-")]


def test_starts_carry_their_town(spark, files):
    row = read_starts(spark, files["starts"]).first()
    assert (row.Muni, row.State) == ("Cambridge", "MA")


def test_command_line_month(spark, files, tmp_path):
    out = str(tmp_path / "out")
    main(["month", files["listings"], "-y", "2021", "-m", "1", "--parcels", files["parcels"],
          "--zips", files["zips"], "--starts", files["starts"], "--completions",
          files["completions"], "--match", "all", "--out", out])
    assert len(os.listdir(f"{out}/period=2021-01")) == 13


def test_command_line_switches(spark, files, tmp_path):
    args = parser().parse_args([
        "month", "l.csv", "--parcels", "P", "--zips", "Z", "--starts", "S", "--completions", "C",
        "--out", "O", "--swapped-axes", "--starts-swapped", "--starts-town", "Boston",
        "--any-merged", "--match", "all", "--latest", "lexicographic", "--completions-dedupe",
        "max_year", "--scam", "zip", "--no-multiline", "--encoding", "ISO-8859-1", "--blank", "null",
        "--layer-format", "geojson-lines", "--completions-declared",
    ])
    assert rules_of(args) == Rules(
        xy=("latitude", "longitude"), starts_xy=("latitude", "longitude"), starts_town="Boston",
        parity=False, match="all", latest="lexicographic", completions_dedupe="max_year",
        scam="zip",
    )
    assert (args.no_multiline, args.encoding, args.blank) == (True, "ISO-8859-1", "null")
    wkt = tmp_path / "zips.csv"
    wkt.write_text('objectid,postcode,pc_name,wkt\n1,02108,Boston,"POLYGON ((0 0, 1 0, 1 1, 0 0))"\n'
                   "2,02109,Boston,POLYGON EMPTY\n")
    layer = read_polygons(spark, str(wkt), ZIP_ATTRS, "wkt", "objectid").orderBy("poly_idx")
    assert [(r.poly_idx, len(r.rings)) for r in layer.collect()] == [(1, 1), (2, 0)]


def all_files(folder):
    found = {}
    for at, _, names in os.walk(folder):
        for name in names:
            if not name.endswith(".crc"):
                path = os.path.join(at, name)
                with open(path, "rb") as f:
                    found[os.path.relpath(path, folder)] = f.read()
    return found


def tables_of(out, period):
    return {
        part: all_files(f"{out}/{folder}")
        for part, folder in (("region", f"period={period}"), ("towns", f"towns/period={period}"))
    }


def test_manifest_counts_the_rows_of_every_table(spark, inputs, tmp_path):
    out = str(tmp_path / "out")
    run_period(spark, inputs, out, "2021-01")
    manifest = published(spark, out, "2021-01")
    region = f"{out}/period=2021-01"
    names = {n.removeprefix("product=") for n in os.listdir(region)}
    towns = {n.removeprefix("product=") for n in os.listdir(f"{out}/towns/period=2021-01")}
    assert set(manifest["tables"]) == names | {f"towns/{n}" for n in towns}
    for name in names:
        assert manifest["tables"][name] == len(read_back(f"{region}/product={name}"))
    for name in towns:
        rows = [
            r for town in glob.glob(f"{out}/towns/period=2021-01/product={name}/town=*")
            for r in read_back(town)
        ]
        assert manifest["tables"][f"towns/{name}"] == len(rows)
    with pytest.raises(FileNotFoundError):
        published(spark, out, "2020-12")


def test_a_stopped_run_leaves_the_old_period_whole(spark, inputs, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    run_period(spark, inputs, out, "2021-01")
    before, manifest = tables_of(out, "2021-01"), published(spark, out, "2021-01")

    def broken(*args, **kwargs):
        raise RuntimeError("stopped")

    smaller = replace(inputs, listings=inputs.listings.where("id < 5"))
    with monkeypatch.context() as m:
        m.setattr(period, "write_products", broken)
        with pytest.raises(RuntimeError, match="stopped"):
            run_period(spark, smaller, out, "2021-01")
    assert tables_of(out, "2021-01") == before
    assert published(spark, out, "2021-01") == manifest

    # A process that dies leaves its attempt behind; the next run of the period clears it.
    lost = f"{out}/_attempts/2021-01/lost/region/product=units"
    os.makedirs(lost)
    with monkeypatch.context() as m:
        m.setattr(publish, "roll_forward", broken)
        with pytest.raises(RuntimeError, match="stopped"):
            run_period(spark, smaller, out, "2021-01")
    assert not os.path.exists(lost)
    assert tables_of(out, "2021-01") == before
    # It stopped behind the switch: the next reader finishes it.
    done = published(spark, out, "2021-01")
    assert done["tables"]["units"] == len(read_back(f"{out}/period=2021-01/product=units")) == 2
    assert os.listdir(f"{out}/_attempts/2021-01") == []


@pytest.mark.parametrize("stop", [0, 1, 2, 3])
def test_roll_forward_from_any_point(spark, tmp_path, stop):
    out = str(tmp_path / "out")

    class Stops(publish.Files):
        moves = 0

        def move(self, source, target):
            if self.moves == stop:
                raise OSError("stopped")
            self.moves += 1
            super().move(source, target)

    def version(text):
        with publish.Publication(spark, out, "p") as p:
            for part in (p.region, p.towns):
                p.files.write(f"{part}/product=x/part-0.csv", text)

    version("old")
    try:
        with publish.Publication(spark, out, "p") as p:
            for part in (p.region, p.towns):
                p.files.write(f"{part}/product=x/part-0.csv", "new")
            files, p.files = p.files, Stops(spark, out)
    except OSError:
        pass
    published(spark, out, "p")
    want = b"old" if stop == 0 else b"new"
    assert tables_of(out, "p") == {
        part: {"product=x/part-0.csv": want} for part in ("region", "towns")
    }


def test_lines_are_those_of_the_csv_writer(spark, tmp_path):
    products = [Product("a", ("name", "n")), Product("b", ("n",), mean=False)]
    long = spark.createDataFrame(
        [("a", 'say "hi", you', 2, 5, 1234.0, 1e-5), ("a", None, 1, 1, None, 2.5),
         ("a", "", 10, 1, 3.0, 2e8), ("a", "", 9, 1, 3.0, 2.0), ("a", " x\ny ", 3, 1, 3.0, None),
         ("b", None, None, 7, None, 1.0), ("b", None, 11, 7, None, 1.0), ("b", None, 2, 7, None, 1.0)],
        "product string, name string, n int, rentcount long, meanrent double, medrent double",
    )
    write_tables(long, products, str(tmp_path / "all"))
    for p in products:
        rows = long.where(f"product = '{p.name}'").select(*table_columns(p))
        write_csv(sorted_by_keys(rows, p.keys).coalesce(1), str(tmp_path / p.name))
        texts = []
        for folder in (tmp_path / "all" / f"product={p.name}", tmp_path / p.name):
            (name,) = glob.glob(f"{folder}/part-*.csv")
            with open(name, encoding="utf-8") as f:
                texts.append(f.read())
        assert texts[0] == texts[1]


def test_year_job_makes_five_writes(spark, inputs, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    write_csv(build_units(inputs), f"{out}/q1")
    writes = []
    for kind in ("csv", "text"):
        old = getattr(DataFrameWriter, kind)
        monkeypatch.setattr(
            DataFrameWriter, kind,
            lambda self, path, *a, old=old, **k: writes.append(path) or old(self, path, *a, **k),
        )
    run_year(spark, [read_csv(spark, f"{out}/q1")], out, "2021", forward=True)
    assert len(writes) == 5
    assert published(spark, out, "2021")["tables"]["annual_fwd"] > 0


def test_declared_completions_follow_the_reading_switches(spark, tmp_path):
    row = dict.fromkeys(COMPLETION_COLUMNS, "x")
    row["Project"], row["Agency"] = "two\nlines", ""
    names = list(row)
    path = write_rows(tmp_path / "declared.csv", names, [row])
    text = read_declared_text(spark, path).first()
    assert text["Project"] == "two\nlines" and text[names.index("Agency")] == ""
    assert read_declared_text(spark, path, blank="null").first()["Agency"] is None
    with pytest.raises(Exception, match="(?i)malformed|header|column"):
        read_declared_text(spark, path, multiline=False).collect()
