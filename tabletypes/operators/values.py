"""The value dictionary: every different value of a column once, with its number of cells and its marks.

Marks are expressions over ``value`` of fixed width (hits, counts, digests, a parsed number). A value of at most ``SHORT`` bytes is its own name: it is counted
first and marked once. A longer one is marked where it is read and known by a 128-bit digest, so no long text is shuffled or compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Marks = dict[str, Callable[[Column], Column]]

SHORT = 32  # bytes


def digest(value: Column) -> tuple[Column, Column]:
    """The two halves of a 128-bit digest; null for null."""
    some = value.isNotNull()
    return F.when(some, F.xxhash64(value)), F.when(some, F.xxhash64(F.lit(1), value))


EXACT: Marks = {"v1": lambda v: digest(v)[0], "v2": lambda v: digest(v)[1]}
LOWER: Marks = {"low1": lambda v: digest(F.lower(v))[0], "low2": lambda v: digest(F.lower(v))[1]}
NUMBER: Marks = {"x": lambda v: v.try_cast("double")}


def value_table(cells: DataFrame, marks: Marks, short: int = SHORT) -> DataFrame:
    """(dataset_id, name, d1, d2, c, *marks): ``name`` is the value if short (null for a null cell), ``d1`` and ``d2`` its digest if long.

    A mark of null must be null or the least of its values.
    """
    value = F.col("value")
    long = F.octet_length(value) > short  # null for a null cell, which is then short
    split = cells.select("dataset_id", F.when(long, F.lit(None)).otherwise(value).alias("name"), F.when(long, value).alias("text"))
    d1, d2 = digest(F.col("text"))
    seen = split.select("dataset_id", "name", d1.alias("d1"), d2.alias("d2"), *[mark(F.col("text")).alias(k) for k, mark in marks.items()])
    counted = seen.groupBy("dataset_id", "name", "d1", "d2").agg(F.count(F.lit(1)).alias("c"), *[F.max(k).alias(k) for k in marks])
    # greatest rather than a case: its arguments are always evaluated, so that marks share their common parts
    return counted.select("dataset_id", "name", "d1", "d2", "c", *[F.greatest(k, mark(F.col("name"))).alias(k) for k, mark in marks.items()])


def is_null() -> Column:
    """Whether a row of the table stands for the null cells."""
    return F.col("name").isNull() & F.col("d1").isNull()


def numeric_histogram(table: DataFrame) -> DataFrame:
    """(dataset_id, x, cnt) from a table with the marks ``NUMBER``."""
    return table.where(F.col("x").isNotNull() & ~F.isnan("x")).groupBy("dataset_id", "x").agg(F.sum("c").alias("cnt"))
