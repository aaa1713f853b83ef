"""Published tables as delimited files."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentatlas.operators.classify import in_towns
from rentatlas.operators.summarize import sorted_by_keys
from rentatlas.plans.catalogue import Product
from rentatlas.sinks.publish import Files


def plain_number(value: Column) -> Column:
    """A double as text without exponent, whole numbers without a decimal point."""
    whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
    plain = F.abs(value).between(1e-3, 1e7)
    digits = F.regexp_replace(value.try_cast("decimal(38,12)").cast("string"), r"\.?0+$", "")
    return (
        F.when(whole, value.cast("bigint").cast("string"))
        .when(plain, value.cast("string"))
        .otherwise(F.coalesce(digits, value.cast("string")))
    )


def cell(name: str, kind: str) -> Column:
    value = F.col(f"`{name}`")
    if kind == "boolean":
        return F.upper(value.cast("string")).alias(name)
    if kind in ("double", "float"):
        return plain_number(value.cast("double")).alias(name)
    return value


def printable(df: DataFrame) -> DataFrame:
    """Booleans as ``TRUE``/``FALSE`` and numbers without exponents."""

    return df.select(*[cell(n, k) for n, k in df.dtypes])


#: How a table's cells become text, for whole files and for single lines.
CELLS = dict(
    nullValue="NA", quote='"', escape='"',
    ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
)


def table_lines(
    df: DataFrame, products: Sequence[Product], by: Sequence[str] = (),
    watch: Callable[[DataFrame], DataFrame] = lambda rows: rows,
) -> DataFrame:
    """Several tables as lines of text: ``product``, ``by``, what sorts the lines, and ``line``.

    ``df`` is a long table with ``product`` and the keys and statistics of all of them. Every product
    and value of ``by`` that has rows gets a header line, which sorts first; rows sort by the
    product's own keys, missing values last. ``watch`` sees the rows that become lines.
    """
    types = dict(df.dtypes)
    names = list(dict.fromkeys(c for p in products for c in table_columns(p)))

    def chosen(pick: Callable[[Product], Sequence[str]]) -> Column:
        """Places of a product's columns among all of them."""
        pairs = [(F.lit(p.name), F.array(*[F.lit(names.index(c)) for c in pick(p)])) for p in products]
        return F.create_map(*[x for pair in pairs for x in pair])[F.col("product")]

    def place(name: str) -> Column:
        text = types[name] == "string"
        return F.struct(
            F.col(name).isNull().alias("missing"),
            (F.col(name) if text else F.lit(None).cast("string")).alias("text"),
            (F.lit(None) if text else F.col(name)).cast("double").alias("number"),
        )

    # One cell is a line of its own, so each is written as the file writer would.
    texts = F.array(*[F.to_csv(F.struct(cell(c, types[c])), options(CELLS)) for c in names])
    places = F.array(*[place(c) for c in names])
    rows = watch(df).select(
        "product", *by, F.lit(1).alias("behind"),
        F.transform(chosen(lambda p: p.keys), lambda i: F.get(places, i)).alias("place"),
        F.concat_ws(",", F.transform(chosen(table_columns), lambda i: F.get(texts, i))).alias("line"),
    )
    headers = F.create_map(*[
        F.lit(x) for p in products for x in (p.name, ",".join(table_columns(p)))
    ])
    first = df.select("product", *by).distinct().select(
        "product", *by, F.lit(0).alias("behind"),
        F.lit(None).cast(rows.schema["place"].dataType).alias("place"),
        headers[F.col("product")].alias("line"),
    )
    return first.union(rows)


def options(values: dict) -> dict[str, str]:
    return {k: str(v).lower() if isinstance(v, bool) else v for k, v in values.items()}


def table_columns(product: Product) -> list[str]:
    return [*product.keys, "rentcount", *(["meanrent"] if product.mean else []), "medrent"]


def write_tables(
    df: DataFrame, products: Sequence[Product], path: str, by: Sequence[str] = (),
    watch: Callable[[DataFrame], DataFrame] = lambda rows: rows,
) -> None:
    """All tables of a long table in one write to a new place, a folder for each product and ``by``.

    A folder has one file, header first and rows in order, as a table has a row per group. Its lines
    pass through one task, sorted outside of its memory; the folders are spread over the tasks.
    """
    lines = table_lines(df, products, by, watch)
    dealt = lines.repartition("product", *by).sortWithinPartitions(
        "product", *by, "behind", "place"
    )
    dealt.select("product", *by, "line").write.mode("append").partitionBy(
        "product", *by
    ).text(path)
    files = Files(df.sparkSession, path)
    files.rename_suffix(path, ".txt", ".csv")
    files.delete(f"{path}/_SUCCESS")


def write_csv(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """A directory of files with headers; NULL is written as ``NA``.

    Number and size of the files follow the data: small tables come out as one file because
    adaptive execution merges their partitions, large ones stay distributed.
    """
    writer = printable(df).write.mode("overwrite").options(header=True, **CELLS)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.csv(path)


def write_by_town(
    df: DataFrame, path: str, keys: Sequence[str] = (), rebalance: bool = False
) -> None:
    """One folder per published town, in one pass; ``muni`` also stays a column of the files.

    Rows are sorted by ``keys`` within their town. ``rebalance`` evens out file sizes for large
    tables and splits a town that dominates.
    """
    towns = in_towns(df).withColumn("town", F.col("muni"))
    if rebalance:
        towns = towns.hint("rebalance", "town")
    elif keys:
        towns = sorted_by_keys(towns, ["town", *keys])
    write_csv(towns, path, ["town"])
