import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabletypes.operators import clusters as K
from tabletypes.operators import corpus as C
from tabletypes.operators import joins as J
from tabletypes.operators import lfs as L
from tabletypes.operators import types as Y
from tabletypes.operators import votes as V


def test_majority_vote_equals_brute_force(spark):
    rnd = random.Random(4)
    rows = [(f"c{i}", f"lf{j}", rnd.choice("xyz")) for i in range(200) for j in range(5) if rnd.random() < 0.6]
    want = {}
    for c in {r[0] for r in rows}:
        top = Counter(r[2] for r in rows if r[0] == c).most_common(2)
        if len(top) == 1 or top[0][1] > top[1][1]:
            want[c] = top[0][0]
    got = {r.dataset_id: r.label for r in V.majority_vote(spark.createDataFrame(rows, "dataset_id string, lf string, label string")).collect()}
    assert got == want


def test_label_model_trusts_the_better_function(spark):
    rows = []
    for i in range(120):
        truth = "xyz"[i % 3]
        rows += [(f"c{i}", "good1", truth), (f"c{i}", "good2", truth), (f"c{i}", "noise", "xyz"[(i * 7 + i // 3) % 3])]
    posterior = V.label_model(spark.createDataFrame(rows, "dataset_id string, lf string, label string"), 3, 4)
    got = {r.dataset_id: r.label for r in V.label_model_vote(posterior).collect()}
    assert all(got[f"c{i}"] == "xyz"[i % 3] for i in range(120))


def brute_linkage(x, t):
    clusters = [[i] for i in range(len(x))]
    d = 1 - x @ x.T
    while len(clusters) > 1:
        best = min((float(np.mean(d[np.ix_(a, b)])), i, j) for i, a in enumerate(clusters) for j, b in enumerate(clusters) if i < j)
        if best[0] >= t:
            break
        clusters[best[1]] = clusters[best[1]] + clusters.pop(best[2])
    return sorted(sorted(c) for c in clusters)


@pytest.mark.parametrize("t", [0.05, 0.3])
def test_average_linkage_equals_brute_force(spark, t):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(5, 6))
    x = np.concatenate([c + 0.35 * rng.normal(size=(5, 6)) for c in centres] + [centres[:1]] * 2)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id int, v array<double>")
    got = {}
    for r in K.average_linkage(df, "id", "v", t).collect():
        got.setdefault(r.cluster, []).append(r.id)
    assert sorted(sorted(c) for c in got.values()) == brute_linkage(x, t)


def test_cosine_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(60, 5))
    x[10:14] = x[3]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id int, v array<double>")
    for t in (0.2, 0.9):
        got = {(r.a, r.b) for r in K.cosine_pairs(df, "id", "v", t).collect()}
        assert got == {(i, j) for i in range(60) for j in range(i + 1, 60) if u[i] @ u[j] >= t}


def test_pivots_meet_every_near_pair_and_few_others(spark):
    rng = np.random.default_rng(10)
    centres = rng.normal(size=(40, 8)) * 4
    x = np.concatenate([c + 0.05 * rng.normal(size=(30, 8)) for c in centres] + [np.repeat(centres[:1], 40, axis=0)])
    points = spark.createDataFrame([(f"p{i}", [float(v) for v in row]) for i, row in enumerate(x)], "id string, vec array<double>").cache()
    d = np.linalg.norm(x[:, None] - x, axis=2)
    for chunk in (4096, 7):
        met = K.near_candidates(points, 0.2, chunk).groupBy("cell", "chunk").agg(F.count_if("home").alias("h"), F.count_if(~F.col("home")).alias("q")).collect()
        assert sum(r.h for r in met) == len(x) and sum(r.h * r.q for r in met) < len(x) ** 2 / 10
        rows = K.near_pairs(points, 0.2, chunk).collect()
        got = {(r.a, r.b) for r in rows}
        assert len(rows) == len(got) and all(a < b for a, b in got)
        assert {(f"p{i}", f"p{j}") for i in range(len(x)) for j in range(len(x)) if f"p{i}" < f"p{j}" and d[i, j] <= 0.2} <= got
    assert K.near_pairs(points.limit(0), 0.2).collect() == [] and K.near_pairs(points.limit(1), 0.2).collect() == []


def test_no_two_clusters_are_closer_than_the_cut(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(150, 3))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id int, v array<double>")
    groups = {}
    for r in K.average_linkage(df, "id", "v", 0.1).collect():
        groups.setdefault(r.cluster, []).append(r.id)
    means = np.array([x[g].mean(axis=0) for g in groups.values()])
    apart = 1 - means @ means.T
    assert 1 < len(groups) < 150 and (apart[~np.eye(len(means), dtype=bool)] >= 0.1 - 1e-9).all()


def test_overlap_candidates_equal_brute_force(spark):
    rnd = random.Random(5)
    sets = {f"c{i}": {f"v{min(int(rnd.expovariate(0.15)), 40)}" for _ in range(rnd.randint(1, 25))} for i in range(40)}
    sets["copy"] = set(sets["c0"])
    rows = [(c, "t", v) for c, vs in sets.items() for v in vs]
    df = spark.createDataFrame(rows, "dataset_id string, semantic_type string, value string")
    for t in (0.2, 0.75, 1.0):
        got = {(r.a, r.b) for r in J.overlap_candidates(df, t).collect()}
        assert got == {(a, b) for a in sets for b in sets if a != b and len(sets[a] & sets[b]) >= t * len(sets[a]) - 1e-9}


def test_value_overlap_needs_two_hits_and_counts_nulls(spark):
    rows = [("a", "x"), ("a", None), ("b", "x"), ("b", "X"), ("c", "x"), ("c", "x")] + [("c", None)] * 9
    cells = spark.createDataFrame(rows, "dataset_id string, value string")
    words = spark.createDataFrame([("t", "x")], "sem_type string, element string")
    assert {r.dataset_id for r in L.lf_value_overlap(cells, words).collect()} == {"b"}


def test_splits_cover_and_do_not_overlap(spark):
    gold = spark.createDataFrame([(f"t{i}+column_0", f"type{i % 7}") for i in range(97)], "dataset_id string, semantic_type string")
    parts = C.split_absolute(gold, 2, 0.2, 3)
    rows = parts.collect()
    assert len(rows) == 97 == len({r.dataset_id for r in rows})
    assert sum(r.split == "test" for r in rows) == 20
    per = parts.where("split = 'labeled'").join(gold, "dataset_id").groupBy("semantic_type").count().collect()
    assert all(r["count"] <= 2 for r in per)
    assert rows != C.split_absolute(gold, 2, 0.2, 4).collect()


def test_cluster_overlap_equals_brute_force(spark):
    rnd = random.Random(6)
    tables = {f"t{i}": [rnd.choice("abc") for _ in range(rnd.randint(1, 4))] for i in range(30)}
    clusters = {t: i % 3 for i, t in enumerate(tables)}
    types = spark.createDataFrame([(t, x) for t, xs in tables.items() for x in xs], "table_id string, semantic_type string")
    cl = spark.createDataFrame(list(clusters.items()), "table_id string, cluster int")
    got = {r.cluster: r.overlap for r in Y.type_overlap_per_cluster(cl, types).collect()}
    for c in range(3):
        names = [t for t in tables if clusters[t] == c]
        o = [sum((Counter(tables[a]) & Counter(tables[b])).values()) / min(len(tables[a]), len(tables[b])) for i, a in enumerate(names) for b in names[i + 1 :]]
        assert got[c] == pytest.approx(np.mean(o))


def test_sampling_is_per_column_and_repeatable(spark):
    cells = spark.range(300).select(F.concat(F.lit("c"), (F.col("id") % 3).cast("string")).alias("dataset_id"), F.col("id").alias("row_id"), F.col("id").cast("string").alias("value"))
    a = C.sample_column(cells, 10, 1).collect()
    assert len(a) == 30 and sorted(a) == sorted(C.sample_column(cells.repartition(5), 10, 1).collect())
    assert C.sample_with_replacement(cells, 7, 1).groupBy("dataset_id").count().where("count = 7").count() == 3
