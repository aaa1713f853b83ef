"""Delimited extracts and partner files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rentatlas.functions.text import location_part, unique_names
from rentatlas.operators.columns import (
    assert_columns,
    clean_header,
    clean_names,
    drop_index_column,
    rename_present,
    union_keep_left,
)
from rentatlas.sources.schema import COMPLETION_COLUMNS, STARTS_NAMES, conform_listings

LATIN_1 = "ISO-8859-1"
MISSING = "NA"
INDEX_NAME = "_c0"
#: Stands for an unquoted blank while a file is parsed; no text holds it.
BLANK_MARK = "\u0001blank\u0001"
# What the permitting town's records are marked with.
STARTS_TOWN, STARTS_STATE = "Cambridge", "MA"


class MissingSource(FileNotFoundError):
    pass


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    encoding: str = "UTF-8",
    multiline: bool = True,
    infer_types: bool = False,
    blank: str = "text",
    repeated: str = "number",
) -> DataFrame:
    """All columns as text, ``NA`` as NULL, names from the header.

    ``blank="text"`` keeps an empty field as an empty text, which is no missing value (it is none
    of any number either once a column is typed); ``"null"`` reads it as NULL. ``repeated`` numbers
    names that occur again, or keeps the ``"first"`` of them.

    Every file must carry the header of the first one; a file that differs, or a record that
    does not fit, fails the job. Files with line breaks inside quotes need ``multiline``; without
    it Spark can split large files, and a broken record still fails rather than passing.
    """
    if blank not in ("text", "null") or repeated not in ("number", "first"):
        raise ValueError(f"unknown choice {blank!r} or {repeated!r}")
    options = dict(
        nullValue=BLANK_MARK, quote='"', escape='"', encoding=encoding, multiLine=multiline,
        mode="FAILFAST",
    )
    try:
        sample = spark.read.options(header=False, **options).csv(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise MissingSource(f"the file {path} does not exist") from error
        raise
    header = sample.first()
    if header is None:
        raise MissingSource(f"the file {path} is empty")
    names = ["" if name is None else name for name in header]
    final = unique_names([INDEX_NAME if name in (MISSING, "") else name for name in names])
    again = len({n.lower() for n in names}) < len(names)
    if again and len(sample.inputFiles()) > 1:
        raise ValueError(f"the header of {path} repeats a name; read such files one by one")
    if infer_types:
        reader = spark.read.options(header=True, **{**options, "nullValue": MISSING})
        df = reader.option("inferSchema", True).csv(path).toDF(*final)
    else:
        # The parser names a blank header field by the mark as well.
        seen = [BLANK_MARK if name == "" else name for name in names]
        schema = T.StructType([T.StructField(n, T.StringType()) for n in (final if again else seen)])
        reader = spark.read.options(header=True, enforceSchema=again, **options)
        df = _without_missing(reader.schema(schema).csv(path).toDF(*final), blank)
    if repeated == "first":
        lower = [n.lower() for n in names]
        first = [n for i, n in enumerate(final) if not lower[i] or lower.index(lower[i]) == i]
        df = df.select(*[F.col(f"`{n}`") for n in first])
    return df


def _without_missing(df: DataFrame, blank: str) -> DataFrame:
    """``NA`` as NULL and blanks, which the parser shows as NULL, as asked for."""

    def cell(name: str):
        value = F.col(f"`{name}`")
        if blank == "text":
            kept = F.when(value.isNull(), F.lit("")).when(value != MISSING, value)
        else:
            kept = F.when((value != MISSING) & (value != ""), value)
        return kept.alias(name)

    return df.select(*[cell(c) for c in df.columns])


def read_listings(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    """One extract, or several of the same vintage, with canonical names and types."""
    return conform_listings(drop_index_column(read_csv(spark, path, **options)))


def read_starts(
    spark: SparkSession, path: str, order: tuple[str, str] = ("latitude", "longitude"),
    **options,
) -> DataFrame:
    """Housing starts as ``camb_yr_built, ord, latitude, longitude, Muni, State``."""
    return parse_starts(read_csv(spark, path, **options), order)


def parse_starts(
    raw: DataFrame, order: tuple[str, str] = ("latitude", "longitude")
) -> DataFrame:
    """``order`` names the two numbers of the location text."""
    named = assert_columns(
        rename_present(raw, STARTS_NAMES), ["camb_yr_built", "ord", "location"], "housing starts"
    )
    return named.select(
        F.col("camb_yr_built").try_cast("int").alias("camb_yr_built"),
        F.col("ord").try_cast("bigint").alias("ord"),
        *[location_part(F.col("location"), i).alias(name) for i, name in enumerate(order)],
        F.lit(STARTS_TOWN).alias("Muni"),
        F.lit(STARTS_STATE).alias("State"),
    )


def read_completions(
    spark: SparkSession,
    older: str,
    update: str | None = None,
    key: str = "parloc_id",
    encoding: str = LATIN_1,
    declared: bool = False,
    **options,
) -> DataFrame:
    """Housing completions as ``parloc_id, complete_date``, both text.

    ``key`` is ``parloc_id`` or ``ward_parcel``; with ``update`` its rows are added to the older
    file, reduced to the columns of that file. ``declared`` holds the older file to the known
    header.
    """
    if declared:
        done = clean_names(read_declared_text(spark, older, encoding=encoding, **options))
    else:
        done = clean_names(read_csv(spark, older, encoding, **options))
    if key != "parloc_id":
        done = done.drop("parloc_id").withColumnRenamed(key, "parloc_id")
    if update:
        added = clean_names(read_csv(spark, update, encoding, **options))
        if key != "parloc_id":
            added = added.drop("parloc_id").withColumnRenamed(key, "parloc_id")
        done = union_keep_left(done, added)
    assert_columns(done, ["parloc_id", "complete_date"], "housing completions")
    return done.select("parloc_id", "complete_date")


def read_declared_text(
    spark: SparkSession, path: str, names: list[str] = COMPLETION_COLUMNS,
    encoding: str = LATIN_1, multiline: bool = True, blank: str = "text", **options,
) -> DataFrame:
    """A file whose columns are all declared as text; a differing header fails the job.

    ``multiline`` and ``blank`` mean what they mean for ``read_csv``.
    """
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    read = spark.read.schema(schema).options(
        header=True, nullValue=BLANK_MARK, escape='"', encoding=encoding, mode="FAILFAST",
        enforceSchema=False, multiLine=multiline, **options,
    )
    return _without_missing(read.csv(path), blank)


def read_recoded(
    spark: SparkSession, path: str, encoding: str = LATIN_1, infer_types: bool = False, **options
) -> DataFrame:
    """A finished table for export: other encoding, header without dots, types on request."""
    return clean_header(read_csv(spark, path, encoding, infer_types=infer_types, **options))
