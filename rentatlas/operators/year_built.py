"""Year built per parcel from housing starts and completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentatlas.functions.dates import year_of_mdy
from rentatlas.functions.numbers import na_max
from rentatlas.functions.recode import age_band, known_year, year_built


def latest_per_key(
    df: DataFrame, key: str, year: str, order: str, mode: str = "both_max"
) -> DataFrame:
    """Latest record per key.

    ``both_max`` keeps the rows that hold both the largest year and the largest order of their
    group: ties stay, and a group whose largest order lies in an earlier year yields nothing.
    A NULL year or order empties its group. ``lexicographic`` keeps one row per group, the
    largest order within the largest year.
    """
    if mode == "lexicographic":
        rest = [c for c in df.columns if c not in (key, year, order)]
        top = F.max(F.struct(year, order, *rest)).alias("top")
        return df.groupBy(key).agg(top).select(key, "top.*").select(*df.columns)
    if mode != "both_max":
        raise ValueError(f"unknown mode {mode!r}")
    best = df.groupBy(F.col(key).alias("best_key")).agg(
        na_max(F.col(year)).alias("best_year"), na_max(F.col(order)).alias("best_order")
    )
    # All three columns are join keys, so a hot group spreads over its years and orders.
    match = (
        F.col(key).eqNullSafe(F.col("best_key"))
        & (F.col(year) == F.col("best_year"))
        & (F.col(order) == F.col("best_order"))
    )
    return df.join(best, match, "left_semi")


def completion_years(
    completions: DataFrame, key: str = "parloc_id", date: str = "complete_date",
    dedupe: str | None = None,
) -> DataFrame:
    """``parloc_id, bos_yr_built`` of every completion, or of the latest with ``max_year``."""
    years = completions.select(
        F.col(key).cast("string").alias("parloc_id"),
        year_of_mdy(F.col(date)).alias("bos_yr_built"),
    )
    if dedupe is None:
        return years
    if dedupe != "max_year":
        raise ValueError(f"unknown dedupe {dedupe!r}")
    return years.groupBy("parloc_id").agg(F.max("bos_yr_built").alias("bos_yr_built"))


def key_salt(df: DataFrame, key: str) -> Column:
    """0 beside a key, a hash of the whole row beside a missing one."""
    plain = [
        f.name for f in df.schema.fields
        if f.dataType.typeName() not in ("array", "map", "struct", "variant")
    ]
    row = F.xxhash64(*[F.col(f"`{c}`") for c in plain])
    return F.when(F.col(key).isNull(), row).otherwise(F.lit(0))


def left_join_on_key(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Left join where NULL keys never match and do not pile up in one task.

    The salt is a join key of its own, so rows without a key spread over all tasks however many
    there are, and any text may be a key.
    """
    right = other.where(F.col(key).isNotNull()).withColumnRenamed(key, "other_key").withColumn(
        "other_salt", F.lit(0).cast("bigint")
    )
    left = df.withColumn("key_salt", key_salt(df, key))
    same = (F.col(key) == F.col("other_key")) & (F.col("key_salt") == F.col("other_salt"))
    return left.join(right, same, "left").drop("key_salt", "other_key", "other_salt")


def join_starts(df: DataFrame, starts: DataFrame) -> DataFrame:
    """Attach ``camb_yr_built``, 0 where the parcel has no start."""
    years = starts.select("parloc_id", "camb_yr_built")
    return left_join_on_key(df, years, "parloc_id").withColumn(
        "camb_yr_built", F.coalesce(F.col("camb_yr_built"), F.lit(0))
    )


def join_completions(df: DataFrame, completions: DataFrame) -> DataFrame:
    """Attach ``bos_yr_built``; several completions on a parcel repeat the listing."""
    years = completions.select("parloc_id", "bos_yr_built")
    return left_join_on_key(df, years, "parloc_id").withColumn(
        "bos_yr_built", F.coalesce(F.col("bos_yr_built"), F.lit(0))
    )


def join_partner_years(df: DataFrame, starts: DataFrame, completions: DataFrame) -> DataFrame:
    """Both partner joins at once, so the listings are shuffled by parcel at most once.

    A parcel with ``a`` starts and ``b`` completions repeats its listings ``max(a,1)*max(b,1)``
    times, just as the two joins in a row.
    """
    known = F.col("parloc_id").isNotNull()
    starts = starts.where(known).select("parloc_id", "camb_yr_built")
    done = completions.where(known).select("parloc_id", "bos_yr_built")
    # A left join and its complement: unlike a full outer join both can split a hot parcel.
    years = starts.join(done, "parloc_id", "left").unionByName(
        done.join(starts, "parloc_id", "left_anti"), allowMissingColumns=True
    )
    return left_join_on_key(df, years, "parloc_id").withColumns(
        {c: F.coalesce(F.col(c), F.lit(0)) for c in ("camb_yr_built", "bos_yr_built")}
    )


def repeated_by_completions(completions: DataFrame) -> DataFrame:
    """Parcels with more than one completion, whose listings are repeated by the join."""
    return (
        completions.where(F.col("parloc_id").isNotNull())
        .groupBy("parloc_id")
        .agg(F.count(F.lit(1)).alias("completions"))
        .where(F.col("completions") > 1)
    )


def override_year_built(df: DataFrame) -> DataFrame:
    """Resolve ``yr_built`` from the three sources and add the age band ``periodblt``."""
    resolved = year_built(
        known_year(F.col("yr_built")), F.col("camb_yr_built"), F.col("bos_yr_built")
    )
    return df.withColumn("yr_built", resolved).withColumn("periodblt", age_band(F.col("yr_built")))
