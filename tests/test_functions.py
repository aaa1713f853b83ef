import datetime as dt

import pytest
from conftest import values
from pyspark.sql import functions as F

from rentatlas.__main__ import period_label
from rentatlas.functions import dates, geometry, numbers, recode, text


def test_ties_round_to_even(spark):
    df = spark.createDataFrame([(1250.5,), (1251.5,), (-0.5,), (2.4,)], "v double")
    out = values(df.select(numbers.round_half_even(F.col("v"))))
    assert out == [(1250.0,), (1252.0,), (0.0,), (2.0,)]


def test_bands_keep_order_and_cover_extremes(spark):
    data = [-1e300, -1250.0, -1249.0, -1e-300, 0.0, 1e-300, 0.01, 0.5, 1.0, 2.0, 2999.99, 3000.0,
            1e300, float("inf")]
    df = spark.createDataFrame([(v,) for v in data], "v double")
    bands = [r[0] for r in values(df.select(numbers.value_band(F.col("v"))))]
    assert bands == sorted(bands)
    assert len(set(bands)) > 8


def test_null_value_has_no_band(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert values(df.select(numbers.value_band(F.col("v")))) == [(None,)]


@pytest.mark.parametrize(
    "title,expected",
    [
        (None, (False, False, False, False)),
        ("SUBLET", (False, False, False, False)),
        (" sublet ", (False, False, False, False)),
        (" NICE SUBLET NOW ", (False, True, False, False)),
        (" ROOMMATE", (False, False, False, False)),
        (" ROOMMATE ", (True, False, False, False)),
        (" ROOM RENT ", (True, False, False, False)),
        (" ONE BEDROOM IN CONDO ", (True, False, False, False)),
        (" ROOM AVAILABLE IN NINE ", (True, False, False, False)),
        (" ROOM IN TWO ", (False, False, False, False)),
        (" ONE ROOM IN TEN ", (False, False, False, False)),
        (" SHORT TERM ", (False, False, True, False)),
        (" SHARE ", (False, False, False, True)),
        (" SHARED ", (False, False, False, True)),
        (" SHARES ", (False, False, False, False)),
    ],
)
def test_title_flags(spark, title, expected):
    df = spark.createDataFrame([(title,)], "title string")
    c = F.col("title")
    tests = [text.is_room_rent, text.is_sublet, text.is_short_term, text.is_shared]
    assert values(df.select(*[t(c) for t in tests])) == [expected]


def test_location_text(spark):
    df = spark.createDataFrame(
        [("(42.37, -71.1)",), ("42.37",), ("unknown",), (None,), ("(1, 2, 3)",)], "t string"
    )
    out = values(df.select(text.location_part(F.col("t"), 0), text.location_part(F.col("t"), 1)))
    assert out == [(42.37, -71.1), (42.37, None), (None, None), (None, None), (1.0, 2.0)]


def test_names():
    assert text.drop_header_dots("studio._not_in_range") == "studio_not_in_range"
    names = ["Complete Date", "Permit #", "TOD 1/2 Mile", "Ward & Parcel", "LAT", "numRooms"]
    assert [text.snake_case(n) for n in names] == [
        "complete_date", "permit_number", "tod_1_2_mile", "ward_parcel", "lat", "num_rooms",
    ]
    assert text.unique_names(["a", "b", "A", "a"]) == ["a", "b", "A_2", "a_3"]
    assert text.unique_names(["a", "a", "a_2"]) == ["a", "a_3", "a_2"]
    assert text.unique_names(["a_2", "a", "A"]) == ["a_2", "a", "A_3"]


def test_day_lag(spark):
    df = spark.createDataFrame(
        [("2021-01-31", "2021-01-01"), ("2021-01-01 08:15:00", "2021-01-04T10:00:00"),
         (None, "2021-01-01"), ("soon", "2021-01-01")], "u string, p string",
    )
    out = values(df.select(dates.day_lag(F.col("u"), F.col("p"))))
    assert out == [(30,), (-3,), (None,), (None,)]


def test_year_of_mdy(spark):
    df = spark.createDataFrame([("3/5/2018",), ("03/05/2018",), ("n/a",), (None,)], "d string")
    out = values(df.select(dates.year_of_mdy(F.col("d"))))
    assert out == [(2018,), (2018,), (None,), (None,)]


def test_quarter_label(spark):
    df = spark.createDataFrame([(2020, 1), (2020, 3), (2021, 4), (2021, 12), (2021, None),
                                (None, 1), (2020, 13)], "y int, m int")
    out = [r[0] for r in values(df.select(dates.quarter_label(F.col("y"), F.col("m"))))]
    assert out == ["2020 Q1", "2020 Q1", "2021 Q2", "2021 Q4", None, None, None]


def test_previous_periods():
    assert dates.previous_month(dt.date(2021, 1, 15)) == (2020, 12)
    assert dates.previous_quarter(dt.date(2021, 1, 15)) == (2020, 4)
    assert dates.previous_quarter(dt.date(2021, 7, 1)) == (2021, 2)
    assert period_label("month", None, None, dt.date(2021, 1, 5)) == "2020-12"
    assert period_label("quarter", 2021, 3, dt.date(2022, 1, 5)) == "2021Q3"
    with pytest.raises(ValueError):
        period_label("quarter", 2021, 5, dt.date(2022, 1, 5))


def test_recode(spark):
    df = spark.createDataFrame([(8, 1), (8, 0), (3, 1), (None, 1), (8, None)], "n int, e int")
    out = values(df.select(recode.eight_bedroom_flag(F.col("n"), F.col("e"))))
    assert out == [(1,), (0,), (0,), (None,), (None,)]


def test_coordinate_override(spark):
    df = spark.createDataFrame(
        [(-71.0, -71.1, 2), (-71.0, -71.1, 1), (-71.0, None, 2), (-71.0, -71.1, None),
         (-71.0, 0.0, None), (42.0, 42.3, 2)], "o double, m double, s int",
    )
    args = F.col("o"), F.col("m"), F.col("s")
    out = values(df.select(recode.merged_coordinate(*args),
                           recode.merged_coordinate(*args, parity=False)))
    assert [r[0] for r in out] == [-71.1, -71.0, -71.0, None, -71.0, 42.0]
    assert [r[1] for r in out] == [-71.1, -71.0, -71.0, None, -71.0, 42.3]


def test_neighborhood_or_tract(spark):
    df = spark.createDataFrame(
        [("ARLINGTON", 25017356100, "N1"), ("BOSTON", 1, "N1"), (None, 1, "N1")],
        "m string, t bigint, n string",
    )
    out = values(df.select(recode.neighborhood_or_tract(F.col("m"), F.col("t"), F.col("n"))))
    assert out == [("25017356100",), ("N1",), (None,)]


def test_year_built_order_and_bands(spark):
    df = spark.createDataFrame([("1950", 2012, 2016), ("1950", 2012, 0), ("n/a", 0, 0),
                                ("1950.0", 0, 0), ("2010", 0, 0), ("2011", 0, 0), (None, 0, 0)],
                               "p string, s int, c int")
    year = recode.year_built(recode.known_year(F.col("p")), F.col("s"), F.col("c"))
    out = values(df.select(year.alias("y")).select("y", recode.age_band(F.col("y"))))
    assert out == [
        (2016, "b_2011 or later"), (2012, "b_2011 or later"), (0, "d_NA"),
        (1950, "a_Before 2011"), (2010, "a_Before 2011"), (2011, "b_2011 or later"), (0, "d_NA"),
    ]


def test_projection_and_back(spark):
    df = spark.createDataFrame([(-71.5, 41.0), (-71.0589, 42.3601), (-73.4, 42.74), (None, 42.0),
                                (-71.0, 95.0)], "lon double, lat double")
    x, y = geometry.to_state_plane(F.col("lon"), F.col("lat"))
    out = df.select("lon", "lat", x.alias("x"), y.alias("y"))
    rows = values(out)
    assert rows[0][2:] == pytest.approx((200000, 750000), abs=1e-6)
    assert rows[1][2:] == pytest.approx((236337.394, 901160.640), abs=1e-3)
    assert rows[3][2:] == (None, None) and rows[4][2:] == (None, None)
    lon, lat = geometry.to_degrees(F.col("x"), F.col("y"))
    for row in values(out.where("x is not null").select("lon", "lat", lon, lat)):
        assert row[2:] == pytest.approx(row[:2], abs=1e-9)
