import random

import pytest
from conftest import plan_text, values
from pyspark.sql import functions as F

from rentatlas.functions.numbers import round_half_even
from rentatlas.operators import summarize
from rentatlas.plans import catalogue


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, ask double")


def test_rounding_poison_and_null_groups(spark):
    df = frame(spark, [("even", 1250.0), ("even", 1251.0), ("odd", 1251.0), ("odd", 1252.0),
                       ("poison", 1000.0), ("poison", None), ("nan", float("nan")),
                       (None, 5.0), ("empty", None), ("neg", -3.0), ("neg", -1.0), ("neg", 4.0)])
    out = {r[0]: r[1:] for r in values(summarize.rent_stats(df, ["k"]))}
    assert out == {
        "even": (2, 1250.0, 1250.0), "odd": (2, 1252.0, 1252.0), "poison": (2, None, None),
        "nan": (1, None, None), None: (1, 5.0, 5.0), "empty": (1, None, None),
        "neg": (3, 0.0, -1.0),
    }


def poisoned(aggregate):
    return F.when(F.count("ask") == F.count(F.lit(1)), aggregate)


def test_agrees_with_plain_aggregates(spark):
    """Continuous, repeated, tiny and huge rents; groups from one row to most of the rows."""
    rng = random.Random(11)
    rows = []
    for i in range(6000):
        key = "hot" if i % 3 else f"g{rng.randrange(80)}"
        rows.append((key, rng.choice([
            rng.lognormvariate(7, 1), float(rng.randrange(500, 5000)), 1500.0,
            -rng.random(), 0.0, rng.random() * 1e-9, rng.random() * 1e12,
        ])))
    df = frame(spark, rows)
    plain = df.groupBy("k").agg(
        F.count(F.lit(1)), round_half_even(poisoned(F.avg("ask"))),
        round_half_even(poisoned(F.median("ask"))),
    )
    expected = {r[0]: r[1:] for r in values(plain)}
    found = {r[0]: r[1:] for r in values(summarize.rent_stats(df, ["k"]))}
    assert found.keys() == expected.keys()
    for key, (count, mean, median) in expected.items():
        assert found[key][0] == count and found[key][2] == median
        assert found[key][1] == pytest.approx(mean, abs=1)


@pytest.fixture(scope="module")
def clean(spark):
    rng = random.Random(5)
    rows = [
        (2020, rng.randrange(1, 13), rng.randrange(1, 3), rng.choice(["BOSTON", "QUINCY", None]),
         rng.choice(["N1", "N2", None]), rng.randrange(5), rng.choice(["02108", None]),
         rng.randrange(0, 3), rng.choice(["a_Before 2011", "d_NA"]),
         None if rng.random() < 0.005 else float(rng.randrange(900, 930)), "2020 Q1")
        for _ in range(1500)
    ]
    return spark.createDataFrame(
        rows, "year int, month int, source_id int, muni string, neighborhood_01 string,"
        " ct10_id bigint, zip_code string, numRooms int, periodblt string, ask double,"
        " quarter string",
    ).cache()


def test_one_pass_equals_each_product(clean):
    products = catalogue.PERIOD_PRODUCTS
    long = summarize.summarize_all(clean, products).cache()
    for product in products:
        one = values(summarize.summarize(clean, product))
        assert sorted(values(summarize.product_rows(long, product)), key=str) == sorted(
            one, key=str)
    assert long.where("product is null").count() == 0


def test_counts_add_up(clean):
    totals = set()
    by_name = {p.name: p for p in catalogue.PERIOD_TABLES}
    for name in ("full", "muni", "nhood", "ct", "zip"):
        out = summarize.summarize(clean, by_name[name])
        totals.add(out.agg(F.sum("rentcount")).first()[0])
    assert totals == {1500}
    ages = summarize.summarize(clean, by_name["full_age"]).groupBy("numRooms").agg(
        F.sum("rentcount").alias("n"))
    full = summarize.summarize(clean, by_name["full"]).select("numRooms", "rentcount")
    assert sorted(values(ages)) == sorted(values(full))


def test_catalogue_is_complete():
    names = [p.name for p in (*catalogue.PERIOD_PRODUCTS, catalogue.ANNUAL_COUNTS,
                              *catalogue.ANNUAL_PRODUCTS, catalogue.ANNUAL_FORWARD)]
    assert len(names) == len(set(names)) == 11 + 1 + 9 + 10 + 1
    assert "annual_ct_age" not in names


def test_sorted_with_missing_values_last(spark):
    df = spark.createDataFrame([(None, 1), ("b", 2), ("a", None), ("a", 1)], "k string, n int")
    out = values(summarize.sorted_by_keys(df, ["k", "n"]))
    assert out == [("a", 1), ("a", None), ("b", 2), (None, 1)]


def test_rents_are_counted_before_the_first_shuffle(clean, tmp_path):
    clean.write.parquet(str(tmp_path / "clean"))
    df = clean.sparkSession.read.parquet(str(tmp_path / "clean"))
    out = summarize.rent_stats(df, ["muni", "numRooms"])
    out.collect()
    plan = plan_text(out)
    assert "partial_count" in plan and "ReadSchema: struct<muni:string,numRooms:int,ask:double>" in plan
    # The counted rents feed both the band totals and the ranking, and are shuffled once.
    assert "ReusedExchange" in plan


def test_all_products_share_one_expansion(clean, tmp_path):
    """One expansion of the counted rows, whose shuffle feeds band totals and ranking."""
    clean.write.parquet(str(tmp_path / "clean"))
    df = clean.sparkSession.read.parquet(str(tmp_path / "clean"))
    for products in (catalogue.PERIOD_TABLES, catalogue.ANNUAL_PRODUCTS):
        out = summarize.summarize_all(df.withColumn("n_extra", F.lit(1)), products)
        out.collect()
        plan = plan_text(out).split("== Initial Plan ==")[0]
        assert plan.count("Generate explode") == 1 and "Expand" not in plan
        assert "ReusedExchange" in plan
        shuffles = [x for x in plan.splitlines() if " Exchange hashpartitioning" in x]
        assert len([x for x in shuffles if "ReusedExchange" not in x]) <= 5
