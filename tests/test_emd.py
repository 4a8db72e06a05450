import numpy as np
import pytest
from pyspark.sql import functions as F

from tabletypes.operators import emd as E
from tabletypes.operators import profile as P
from tabletypes.operators import stats as T


def brute(a, b):
    xs = np.unique(np.concatenate([a, b]))
    fa = np.searchsorted(np.sort(a), xs, side="right") / len(a)
    fb = np.searchsorted(np.sort(b), xs, side="right") / len(b)
    return float(np.sum(np.abs(fa - fb)[:-1] * np.diff(xs)))


@pytest.fixture(scope="module")
def columns(spark):
    rng = np.random.default_rng(1)
    data = {
        "a": rng.integers(0, 30, 400).astype(float),
        "b": rng.integers(0, 50, 300).astype(float),
        "c": rng.normal(5, 2, 200).round(2),
        "one": np.array([7.0]),
    }
    data["shifted"] = data["a"] + 3
    rows = [(k, float(x)) for k, v in data.items() for x in v]
    return data, P.value_histogram(spark.createDataFrame(rows, "dataset_id string, x double")).cache()


def distances(spark, hist, pairs, hot_rows=10**6):
    df = spark.createDataFrame(pairs, "u string, l string")
    return {(r.u, r.l): r.emd for r in E.emd_of_pairs(df, hist, hist, hot_rows).collect()}


@pytest.mark.parametrize("hot_rows", [10**6, 20])
def test_emd_equals_brute_force(spark, columns, hot_rows):
    data, hist = columns
    pairs = [(u, l) for u in data for l in data]
    got = distances(spark, hist, pairs, hot_rows)
    for u, l in pairs:
        assert got[u, l] == pytest.approx(brute(data[u], data[l]), abs=1e-9)
    assert got["a", "a"] == 0
    assert got["a", "shifted"] == pytest.approx(3)
    assert got["a", "b"] == pytest.approx(got["b", "a"])


def test_band_join_misses_no_close_pair(spark, columns):
    _, hist = columns
    m = E.moments(hist).where("std is not null")
    for factor in (0.01, 0.5, 1.0, 4.0):
        near = {(r.u, r.l) for r in E.near_means(m, m, F.lit(factor) * F.col("std")).collect()}
        rows = m.collect()
        assert near == {(u.dataset_id, l.dataset_id) for u in rows for l in rows if abs(u["mean"] - l["mean"]) < factor * u["std"]}


def test_vote_abstains_on_ties_between_types(spark, columns):
    _, hist = columns
    copies = hist.where("dataset_id = 'a'").withColumn("dataset_id", F.explode(F.array(F.lit("l1"), F.lit("l2"))))
    types = spark.createDataFrame([("l1", "x"), ("l2", "y")], "dataset_id string, semantic_type string")
    u = hist.where("dataset_id = 'a'")
    assert E.lf_numeric_emd(u, copies, types, 0.1).count() == 0
    same = types.withColumn("semantic_type", F.lit("x"))
    assert E.lf_numeric_emd(u, copies, same, 0.1).first().label == "x"


def test_cdf_ends_at_one_and_quantiles_interpolate(columns):
    data, hist = columns
    assert all(r.m == pytest.approx(1) for r in P.cdf(hist, hot_rows=25).groupBy("dataset_id").agg(F.max("cdf").alias("m")).collect())
    got = {r.i: r.x for r in P.inverse_transform(hist, 10).where("dataset_id = 'a'").collect()}
    xs, counts = np.unique(data["a"], return_counts=True)
    want = np.interp(np.arange(1, 11) / 10, np.cumsum(counts) / counts.sum(), xs)
    assert np.allclose([got[i] for i in range(1, 11)], want)


def test_chi_square_survival(spark):
    df = spark.createDataFrame([(3.841458820694124, 1), (5.991464547107979, 2), (18.307038053275146, 10), (0.0, 3)], "h double, k int")
    got = [r.p for r in df.select(T.chi2_survival("h", "k").alias("p")).collect()]
    assert got == pytest.approx([0.05, 0.05, 0.05, 1.0], abs=1e-9)


def test_kruskal_known_value(spark):
    # ranks 1..6 split as (1, 2, 3) and (4, 5, 6): H = 27/7
    rows = [("k", "a", 1.0), ("k", "a", 2.0), ("k", "a", 3.0), ("k", "b", 4.0), ("k", "b", 5.0), ("k", "b", 6.0)]
    r = T.kruskal_wallis(spark.createDataFrame(rows, "key string, g string, x double"), ["key"], "g").first()
    assert r.h == pytest.approx(27 / 7) and r.df == 1 and r.p == pytest.approx(0.04953461, abs=1e-7)


def test_joined_emd_equals_the_join(spark):
    rng = np.random.default_rng(2)
    o = spark.createDataFrame([(f"g{rng.integers(4)}", float(rng.integers(20))) for _ in range(60)], "s string, v double").cache()
    i = spark.createDataFrame([(f"g{rng.integers(5)}", float(rng.integers(30))) for _ in range(50)], "s string, v double").cache()
    pdf = o.toPandas().merge(i.toPandas(), on="s", suffixes=("_o", "_i"))
    assert E.emd_joined(o, i, ["s"], ["v"]).first().emd == pytest.approx(brute(pdf.v_o.to_numpy(), pdf.v_i.to_numpy()))
    groups = [brute(g.v_o.to_numpy(), g.v_i.to_numpy()) for _, g in pdf.groupby("s")]
    assert E.group_emd(o, i, ["s"], ["v"]).first().emd == pytest.approx(np.mean(groups))


def test_group_emd_finds_the_column_of_the_same_type(spark):
    rng = np.random.default_rng(8)
    rows, vals = [], {}
    for t, spec in {"t1": {1: (0, 50)}, "t2": {1: (0, 50), 2: (20, 90)}}.items():
        for r in range(120):
            g = f"g{r % 3}"
            rows.append((f"{t}+column_0", t, r, g))
            for c, (lo, step) in spec.items():
                x = float(lo + step * (r % 3) + rng.integers(0, 5))
                rows.append((f"{t}+column_{c}", t, r, str(x)))
                vals.setdefault((t, c, g), []).append(x)
    cells = spark.createDataFrame(rows, "dataset_id string, table_id string, row_id int, value string")
    labeled = spark.createDataFrame(
        [("t1+column_0", "t1", "grp", "text"), ("t2+column_0", "t2", "grp", "text"), ("t2+column_1", "t2", "right", "numeric"), ("t2+column_2", "t2", "wrong", "numeric")],
        "dataset_id string, table_id string, semantic_type string, kind string",
    )
    unlabeled = spark.createDataFrame([("t1+column_1",)], "dataset_id string")
    r = E.lf_group_emd_correlated(cells, unlabeled, labeled).collect()
    want = np.mean([brute(np.array(vals["t1", 1, g]), np.array(vals["t2", 1, g])) for g in ("g0", "g1", "g2")])
    assert len(r) == 1 and r[0].label == "right" and r[0].n_groups == 3 and r[0].emd == pytest.approx(want)
