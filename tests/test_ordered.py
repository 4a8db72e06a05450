"""The blocked plans for hot groups give the plain results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabletypes.plans.ordered import position, running, split_hot, top, weighted_quantiles


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    rows = [("hot", float(x), int(c)) for x, c in zip(rng.permutation(6000) / 7, rng.integers(1, 9, 6000))]
    rows += [(f"k{i}", float(i * j), j + 1) for i in range(20) for j in range(1, 6)]
    return spark.createDataFrame(rows, "g string, x double, c long").cache()


def collected(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_running_over_a_hot_group(skewed):
    def run(hot_rows):
        return running(skewed, ["g"], ["x"], {"u": F.col("c")}, {"nx": F.col("x")}, hot_rows=hot_rows).fillna(-1.0, ["nx"])

    assert collected(run(500), "g", "x", "u", "nx") == collected(run(10**9), "g", "x", "u", "nx")


def test_position_over_the_whole_frame(skewed):
    keyed = skewed.select("g", "x")
    blocked = position(keyed, [], ["x", "g"], "p", hot_rows=400)
    rows = collected(blocked, "x", "g", "p")
    assert [r[2] for r in rows] == list(range(1, len(rows) + 1))


def test_descending_and_several_columns(skewed):
    neg = skewed.withColumn("neg", -F.col("c"))
    a = position(neg, ["g"], ["neg", "x"], "p", hot_rows=300)
    b = position(neg, ["g"], ["neg", "x"], "p", hot_rows=10**9)
    assert collected(a, "g", "x", "p") == collected(b, "g", "x", "p")


def test_quantiles_match_numpy(skewed):
    out = weighted_quantiles(skewed, ["g"], "x", "c", {"a": 0.25, "b": 0.5, "d": 0.9}, hot_rows=500).where("g = 'hot'").first()
    rows = skewed.where("g = 'hot'").toPandas()
    values = np.repeat(rows.x.to_numpy(), rows.c.to_numpy())
    assert np.allclose([out.a, out.b, out.d], np.quantile(values, [0.25, 0.5, 0.9]))


def test_top_keeps_the_first_rows(skewed):
    rows = top(skewed, ["g"], [F.desc("x")], 2).where("g = 'k3'").orderBy("rank").collect()
    assert [r.x for r in rows] == [15.0, 12.0]


@pytest.mark.parametrize("groups", [1, 300])
def test_any_number_of_groups_and_blocks(spark, groups):
    rows = spark.range(60_000).select((F.col("id") % groups).cast("string").alias("g"), F.col("id").alias("x")).withColumn("g", F.when(F.col("g") != "0", F.col("g")))
    cold, hot = split_hot(rows, ["g"], ["x"], hot_rows=150)
    assert cold.count() == 0
    sizes = hot.groupBy("g", "__block").count().agg(F.max("count"), F.count("*")).first()
    assert sizes[0] <= 300 and sizes[1] >= max(groups, 400)
    out = position(rows, ["g"], ["x"], "p", hot_rows=150)
    assert out.where(F.col("p") != F.floor(F.col("x") / groups) + 1).count() == 0 and out.count() == 60_000
