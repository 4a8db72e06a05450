"""Sinks for labels and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_labels(df: DataFrame, path: str, run: str, fmt: str = "parquet", append: bool = False, single_file: bool = False) -> None:
    """Labels of one run below ``run=<name>``. Overwriting replaces that run alone.

    ``single_file`` is for small exports: it brings all rows of the run to one writer.
    """
    out = df.coalesce(1) if single_file else df
    writer = out.write.mode("append" if append else "overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", "true")
    writer.save(f"{path.rstrip('/')}/run={run}")


def read_labels(spark, path: str, fmt: str = "parquet") -> DataFrame:
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", "true")
    return reader.load(path)


def write_trec(lines: DataFrame, path: str) -> None:
    lines.select(F.col("line").alias("value")).write.mode("overwrite").text(path)
