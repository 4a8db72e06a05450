"""Readers on malformed and nested inputs."""

from pyspark.sql import functions as F

from tabletypes.functions import scalars as S
from tabletypes.sources import readers as R


def test_delimited_lines_of_other_widths(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a|b\na|b|c\na|b||\nx\n"q|r"|s\n|\n\n5" pipe|"n\\"|o"\n')
    df = R.read_delimited(spark, f"{tmp_path}/t.csv", ["x", "y"])
    assert sorted(map(tuple, df.collect()), key=repr) == sorted([("a", "b"), ("x", None), ("q|r", "s"), (None, None), ('5" pipe', 'n"|o')], key=repr)
    assert df.count() == 5 and [r.y for r in R.read_delimited(spark, f"{tmp_path}/t.csv", ["x", "y"], usecols=[1]).where("y = 's'").collect()] == ["s"]


def test_part_files_are_one_table(spark, tmp_path):
    spark.range(10).repartition(3).write.parquet(f"{tmp_path}/c/first.parquet")
    spark.range(4).repartition(2).write.parquet(f"{tmp_path}/c/second")
    named = R.read_parquet_corpus(spark, f"{tmp_path}/c/first.parquet").groupBy("table_id").count()
    assert [tuple(r) for r in named.collect()] == [("first", 10)]
    folders = R.read_parquet_corpus(spark, f"{tmp_path}/c", up=1).groupBy(F.regexp_replace("table_id", r"\.parquet$", "").alias("t")).count()
    assert {tuple(r) for r in folders.collect()} == {("first", 10), ("second", 4)}


def test_clocks_and_zones(spark):
    cases = {
        "1999-12-31T10:00:00+02:00": "1999-12-31 08:00:00", "31/12/1999 10:30UTC": "1999-12-31 10:30:00", "31/12/1999 10:30": None, "1999-12-31 23:30:00-0100": "2000-01-01 00:30:00",
        "1999-12-31 10:00:00Z": "1999-12-31 10:00:00", "12/31/1999": "1999-12-31 00:00:00", "31 Dec 1999 10:30gmt": "1999-12-31 10:30:00", "1999-12-31 10:00:00EST": None, "": None,
    }
    rows = spark.createDataFrame([*((k,) for k in cases), (None,)], "v string").select("v", F.date_format(S.parse_date("v"), "yyyy-MM-dd HH:mm:ss").alias("t")).collect()
    assert {r.v: r.t for r in rows} == cases | {None: None}
