import pytest
from conftest import plan_text, values
from pyspark.sql import functions as F

from rentatlas.operators import classify, columns, normalize, year_built


def test_scam_rules_drop_unknown_conditions(spark):
    df = spark.createDataFrame(
        [("02108", "Acorn", 500.0, 1), ("02108", "Main", 500.0, 1), ("02108", "Acorn", 700.0, 1),
         (None, "Acorn", 500.0, 1), (None, "Acorn", 900.0, 1), (None, "Main", 500.0, 1),
         ("02139", "Acorn", 500.0, -1), ("02139", "Acorn", 500.0, None),
         ("02139", "Acorn", None, 2), ("02108", "Acorn", None, 2), ("02108", None, 500.0, 2)],
        "zip_code string, BASE_merge string, ask double, numRooms int",
    )
    address = values(classify.drop_probable_scams(df))
    assert address == [
        ("02108", "Main", 500.0, 1), ("02108", "Acorn", 700.0, 1), (None, "Acorn", 900.0, 1),
        (None, "Main", 500.0, 1), ("02139", "Acorn", None, 2),
    ]
    coarse = values(classify.drop_probable_scams(df.drop("BASE_merge")))
    assert coarse == [("02108", 700.0, 1), (None, 900.0, 1), ("02139", None, 2)]


def test_unit_filter_lags(spark):
    df = spark.createDataFrame(
        [(" FLAT ", -3), (" FLAT ", 30), (" FLAT ", 31), (" FLAT ", None), (None, 1),
         (" SUBLET ", 1)], "title string, update_lag int",
    )
    kept = classify.whole_units(classify.add_flags(df)).select("title", "update_lag")
    assert values(kept) == [(" FLAT ", -3), (" FLAT ", 30), (None, 1)]


def test_towns(spark):
    df = spark.createDataFrame([("BOSTON",), ("MEDFORD",), (None,)], "muni string")
    assert values(classify.in_towns(df)) == [("BOSTON",)]


def test_normalize_keeps_originals(spark):
    df = spark.createDataFrame(
        [(2, -71.0, 42.0, -71.1, 42.3, "2021-01-05", "2021-01-01", 8, 1)],
        "source_id int, longitude double, latitude double, longitude_merge double,"
        " latitude_merge double, updated_date string, post_date string, numRooms int,"
        " eight_bedroom int",
    )
    row = normalize.normalize_listings(df).first()
    assert (row.longitude, row.longitude_original, row.latitude) == (-71.1, -71.0, 42.0)
    assert (row.update_lag, row.eight_bedroom) == (4, 1)


STARTS = "parloc_id string, camb_yr_built int, ord bigint"


def test_both_maxima(spark):
    df = spark.createDataFrame(
        [("a", 2015, 1), ("a", 2014, 9), ("b", 2015, 9), ("b", 2015, 9), ("c", 2010, 1),
         ("c", None, 2), (None, 2011, 5), (None, 2010, 4)], STARTS,
    )
    out = year_built.latest_per_key(df, "parloc_id", "camb_yr_built", "ord")
    assert sorted(values(out), key=str) == [("b", 2015, 9), ("b", 2015, 9), (None, 2011, 5)]
    one = year_built.latest_per_key(df, "parloc_id", "camb_yr_built", "ord", "lexicographic")
    assert sorted(values(one), key=str) == [
        ("a", 2015, 1), ("b", 2015, 9), ("c", 2010, 1), (None, 2011, 5),
    ]


def test_partner_joins(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "z")], "id int, parloc_id string")
    starts = spark.createDataFrame([("a", 2012, 1), ("a", 2012, 1), (None, 1999, 1)], STARTS)
    done = spark.createDataFrame([("a", 2016), ("a", 2017), ("b", 2018), (None, 2019)],
                                 "parloc_id string, bos_yr_built int")
    joined = year_built.join_partner_years(df, starts, done)
    rows = sorted(values(joined.select("id", "camb_yr_built", "bos_yr_built")))
    assert rows == [(1, 2012, 2016)] * 2 + [(1, 2012, 2017)] * 2 + [
        (2, 0, 2018), (3, 0, 0), (4, 0, 0),
    ]
    in_a_row = year_built.join_completions(year_built.join_starts(df, starts), done)
    assert sorted(values(in_a_row.select("id", "camb_yr_built", "bos_yr_built"))) == rows
    assert values(year_built.repeated_by_completions(done)) == [("a", 2)]


def test_null_keys_are_scattered(spark):
    df = spark.range(10000).select("id", F.lit(None).cast("string").alias("parloc_id"))
    salts = df.select(year_built.key_salt(df, "parloc_id").alias("k")).distinct().count()
    assert salts == 10000


def test_any_text_is_a_key(spark):
    df = spark.createDataFrame([(1, "\0k"), (2, ""), (3, None)], "id int, parloc_id string")
    done = spark.createDataFrame([("\0k", 2016), ("", 2017), (None, 2018)],
                                 "parloc_id string, bos_yr_built int")
    joined = year_built.join_completions(df, done).select("id", "bos_yr_built")
    assert sorted(values(joined)) == [(1, 2016), (2, 2017), (3, 0)]


def test_hot_partner_parcel_is_no_full_outer_join(spark):
    """Starts and completions that pile up on one parcel can be split too."""
    starts = spark.range(60000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string"))
        .alias("parloc_id"), F.lit(2012).alias("camb_yr_built"), F.col("id").alias("ord"),
    )
    done = spark.createDataFrame([("hot", 2016), ("x", 2017)],
                                 "parloc_id string, bos_yr_built int")
    df = spark.createDataFrame([(1, "x"), (2, "1"), (3, "hot")], "id int, parloc_id string")
    joined = year_built.join_partner_years(df, starts, done)
    assert "FullOuter" not in plan_text(joined)
    counts = {r[0]: r[1:] for r in values(joined.groupBy("id").agg(
        F.count(F.lit(1)), F.max("camb_yr_built"), F.max("bos_yr_built")))}
    assert counts == {1: (1, 0, 2017), 2: (1, 2012, 0), 3: (20000, 2012, 2016)}


def test_hot_parcel_is_split_by_the_adaptive_join(spark):
    df = spark.range(200000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string"))
        .alias("parloc_id"), F.sha2(F.col("id").cast("string"), 256).alias("body"),
    ).repartition(8)
    done = spark.range(200000).select(
        F.when(F.col("id") == 0, "hot").otherwise(F.col("id").cast("string")).alias("parloc_id"),
        F.lit(2015).alias("bos_yr_built"),
    )
    changed = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1MB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1MB",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "256KB",
    }
    before = {k: spark.conf.get(k, None) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    try:
        joined = year_built.join_completions(df, done)
        size = F.max(F.length("body"))
        out = joined.groupBy().agg(F.count(F.lit(1)), F.sum("bos_yr_built"), size)
        assert values(out) == [(200000, 200000 * 2015, 64)]
        assert "skew=true" in plan_text(out)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_completion_years(spark):
    df = spark.createDataFrame([("a", "3/5/2018"), ("a", "n/a"), ("a", "1/1/2019")],
                               "parloc_id string, complete_date string")
    all_years = year_built.completion_years(df)
    assert values(all_years) == [("a", 2018), ("a", None), ("a", 2019)]
    assert values(year_built.completion_years(df, dedupe="max_year")) == [("a", 2019)]


def test_unions_and_names(spark):
    older = spark.createDataFrame([(1, 2)], "a int, b int")
    update = spark.createDataFrame([(3, 4)], "b int, c int")
    assert sorted(values(columns.union_by_name([older, update])), key=str) == [
        (1, 2, None), (None, 3, 4),
    ]
    assert values(columns.union_keep_left(older, update)) == [(1, 2), (None, 3)]
    repeated = older.crossJoin(spark.createDataFrame([(9,)], "a int"))
    assert columns.first_of_repeated(repeated).columns == ["a", "b"]
    assert values(columns.first_of_repeated(repeated)) == [(1, 2)]
    indexed = spark.createDataFrame([(1, 2)], "X int, id int")
    assert columns.drop_index_column(indexed).columns == ["id"]
    assert columns.drop_index_column(older).columns == ["a", "b"]
    with pytest.raises(columns.MissingColumns, match="lacks the columns d"):
        columns.assert_columns(older, ["a", "d"], "the table")
