"""Listing counts with mean and exact median rents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rentatlas.functions.numbers import null_if_nan, round_half_even, value_band
from rentatlas.plans.catalogue import Product


def rent_stats(df: DataFrame, keys: Sequence[str], mean: bool = True) -> DataFrame:
    """``rentcount, meanrent, medrent`` of ``ask`` per group; NULL is a group value of its own.

    One NULL ``ask`` makes mean and median of its group NULL. Rents are counted per distinct
    value first, so a group that holds most of the rows is spread over its rents.
    """
    asks = (
        df.select(*keys, null_if_nan(F.col("ask")).alias("ask"))
        .groupBy(*keys, "ask")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return stats_of_counts(asks, keys, mean)


def stats_of_counts(asks: DataFrame, keys: Sequence[str], mean: bool = True) -> DataFrame:
    """Statistics from rows of ``keys, ask, n``.

    The median is found in two steps: the band that holds the middle rank is known from band
    totals alone, and only the rents inside that band are then ranked. No task ever sees all
    distinct rents of a group.
    """
    banded = asks.withColumn("band", value_band(F.col("ask")))
    group = Window.partitionBy(*keys)
    before = group.orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        banded.groupBy(*keys, "band")
        .agg(F.sum("n").alias("band_n"), F.sum(F.col("n") * F.col("ask")).alias("band_ask"))
        .select(
            *keys,
            "band",
            "band_n",
            F.sum("band_n").over(group).alias("rentcount"),
            F.sum("band_ask").over(group).alias("total"),
            F.max(F.col("band").isNull()).over(group).alias("poisoned"),
            F.coalesce(F.sum("band_n").over(before), F.lit(0)).alias("below"),
        )
    )
    low = F.floor((F.col("rentcount") + 1) / 2)
    high = F.floor(F.col("rentcount") / 2) + 1
    holds_middle = (F.col("below") < high) & (F.col("below") + F.col("band_n") >= low)
    middle = placed.where(
        F.when(F.col("poisoned"), F.col("band").isNull()).otherwise(holds_middle)
    ).select(
        *[F.col(k).alias(f"m_{k}") for k in keys],
        F.col("band").alias("m_band"), "rentcount", "total", "poisoned", "below",
    )
    same = F.col("band").eqNullSafe(F.col("m_band"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"m_{k}"))
    ranked = banded.join(middle, same).select(
        *keys, "ask", "rentcount", "total", "poisoned",
        (
            F.min("below").over(group)
            + F.sum("n").over(
                group.orderBy("ask").rowsBetween(Window.unboundedPreceding, Window.currentRow)
            )
        ).alias("rank"),
    )
    stats = ranked.groupBy(*keys).agg(
        F.max("rentcount").alias("rentcount"),
        F.max("total").alias("total"),
        F.max("poisoned").alias("poisoned"),
        F.min(F.when(F.col("rank") >= low, F.col("ask"))).alias("low_ask"),
        F.min(F.when(F.col("rank") >= high, F.col("ask"))).alias("high_ask"),
    )
    clean = ~F.col("poisoned")
    meanrent = F.when(clean, round_half_even(F.col("total") / F.col("rentcount")))
    medrent = F.when(clean, round_half_even((F.col("low_ask") + F.col("high_ask")) / 2))
    return stats.select(
        *keys,
        "rentcount",
        *([meanrent.alias("meanrent")] if mean else []),
        medrent.alias("medrent"),
    )


def summarize(df: DataFrame, product: Product) -> DataFrame:
    return rent_stats(df, product.keys, product.mean)


def summarize_all(df: DataFrame, products: Sequence[Product]) -> DataFrame:
    """All products in one pass as a long table of ``product``, every key and the statistics.

    Rows are first counted at the finest grain. Each counted row then becomes one row per product,
    with the keys the product does not have left empty, and these are counted once more; both the
    band totals and the ranking start from that one shuffle.
    """
    dims = list(dict.fromkeys(k for p in products for k in p.keys))
    grain = (
        df.select(*dims, null_if_nan(F.col("ask")).alias("ask"))
        .groupBy(*dims, "ask")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    types = {f.name: f.dataType for f in grain.schema.fields}

    def keys_of(p: Product) -> Column:
        return F.struct(
            F.lit(p.name).alias("product"),
            *[
                (F.col(d) if d in p.keys else F.lit(None).cast(types[d])).alias(d) for d in dims
            ],
        )

    asks = (
        grain.select(F.explode(F.array(*[keys_of(p) for p in products])).alias("key"), "ask", "n")
        .select("key.*", "ask", "n")
        .groupBy("product", *dims, "ask")
        .agg(F.sum("n").alias("n"))
    )
    return stats_of_counts(asks, ["product", *dims])


def product_rows(long: DataFrame, product: Product) -> DataFrame:
    """One product of the long table with its own columns."""
    values = ["rentcount", "meanrent", "medrent"] if product.mean else ["rentcount", "medrent"]
    return long.where(F.col("product") == product.name).select(*product.keys, *values)


def sorted_by_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Published order: by the group keys, missing values last."""
    return df.orderBy(*[F.col(k).asc_nulls_last() for k in keys])
