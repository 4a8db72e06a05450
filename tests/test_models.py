"""Sparse topic vectors, header vectors, seeded bijections and many small fits."""

from collections import Counter

import numpy as np
import pytest
from pyspark.ml.linalg import SparseVector
from pyspark.sql import functions as F

from tabletypes.operators import ml as ML
from tabletypes.operators import votes as V


def test_count_vectors_hold_the_whole_vocabulary(spark):
    rng = np.random.default_rng(1)
    bags = {f"t{i}": Counter(f"w{int(x)}" for x in rng.integers(0, 900, 40)) for i in range(60)}
    terms = spark.createDataFrame([(t, w, n) for t, ws in bags.items() for w, n in ws.items()], "table_id string, term string, tf long")
    number = {r.term: r.i for r in ML.number_terms(terms).collect()}
    df = Counter(w for ws in bags.values() for w in ws)
    assert sorted(number.values()) == list(range(len(df))) and [df[w] for w in sorted(number, key=number.get)] == sorted(df.values(), reverse=True)
    for r in ML.count_vectors(terms).collect():
        assert isinstance(r.features, SparseVector) and r.features.size == len(df)
        assert {int(i): v for i, v in zip(r.features.indices, r.features.values, strict=True)} == {number[w]: n for w, n in bags[r.table_id].items()}


def test_topics_cover_every_table(spark):
    terms = spark.createDataFrame([(f"t{i}", f"{'ab'[i % 2]}{j}", 1 + j) for i in range(20) for j in range(8)], "table_id string, term string, tf long")
    _, topics = ML.topic_model(terms, 2, 20)
    rows = {r.table_id: r.topic for r in topics.collect()}
    assert len(rows) == 20 and all(sum(t) == pytest.approx(1) for t in rows.values())
    assert len({int(np.argmax(rows[f"t{i}"])) for i in range(0, 20, 2)}) == 1


def test_topic_weights_are_a_table_of_all_terms(spark):
    bags = {f"t{i}": {f"{'ab'[i % 2]}{j}": 1 + j for j in range(30)} for i in range(40)}
    terms = spark.createDataFrame([(t, w, n) for t, ws in bags.items() for w, n in ws.items()], "table_id string, term string, tf long")
    model, topics = ML.topic_model(terms, 2, 5, share=1.0)
    number = {r.term: r.i for r in ML.number_terms(terms).collect()}
    weights = {r.i: r.w for r in model.collect()}  # rows, no model in the driver
    assert sorted(weights) == sorted(number.values()) and all(len(w) == 2 and min(w) > 0 for w in weights.values())
    side = {w: int(np.argmax(weights[i])) for w, i in number.items()}
    assert {side[w] for w in number if w[0] == "a"} != {side[w] for w in number if w[0] == "b"} and len({(w[0], side[w]) for w in number}) == 2
    rows = {r.table_id: r.topic for r in topics.collect()}
    assert len(rows) == 40 and all(int(np.argmax(rows[t])) == side[next(iter(bags[t]))] and max(rows[t]) > 0.9 for t in bags)


def test_digamma_and_trigamma():
    euler = 0.5772156649015329
    assert ML.psi(np.array([1.0, 0.5, 1e-3])) == pytest.approx([-euler, -euler - 2 * np.log(2), -1000.5755719318103], rel=1e-10)
    assert ML.psi(np.array([1.0, 0.5]), 1) == pytest.approx([np.pi**2 / 6, np.pi**2 / 2], rel=1e-9)


def test_topics_of_nothing(spark):
    terms = spark.createDataFrame([], "table_id string, term string, tf long")
    assert ML.topic_model(terms, 2, 2)[1].collect() == []


@pytest.mark.parametrize("size", [1, 2, 5, 64, 65, 1000])
def test_shuffled_numbers_are_a_bijection(spark, size):
    df = spark.range(size).withColumn("seed", F.explode(F.array(F.lit(1), F.lit(2))))
    rows = df.select("id", "seed", ML.shuffled_number(F.col("id"), F.col("seed"), size).alias("to")).collect()
    for seed in (1, 2):
        assert sorted(r.to for r in rows if r.seed == seed) == list(range(size))
    if size == 1000:
        assert sum(r.to == r.id for r in rows) < 20 and len({(r.id, r.to) for r in rows}) > 1900


def test_a_group_comes_from_one_other_table(spark):
    rows = [(f"t{t}+column_{c}", f"t{t}", c, [float(t), float(10 * t + c), 7.0]) for t in range(9) for c in range(1 + t % 3)]
    matrix = spark.createDataFrame(rows, "dataset_id string, table_id string, col_idx int, features array<double>")
    got = ML.permute_groups(matrix, {"first": [0], "rest": [1, 2]}, [1, 2], -5.0).collect()
    assert len(got) == 4 * len(rows)
    for r in got:
        t, c = int(r.dataset_id[1]), int(r.dataset_id[-1])
        if r.grp == "first":
            assert r.features[1:] == [10.0 * t + c, 7.0] and (r.features[0] == -5 or c < 1 + int(r.features[0]) % 3)
        else:
            assert r.features[0] == t and (r.features[1:] == [-5.0, -5.0] or r.features[1] % 10 == c)
    for seed in (1, 2):
        sources = {r.dataset_id[1]: r.features[0] for r in got if r.grp == "first" and r.seed == seed and r.dataset_id.endswith("_0")}
        assert sorted(sources.values()) == list(range(9))


def test_importance_of_the_feature_that_decides(spark):
    rng = np.random.default_rng(2)
    rows = [(f"t{i}+column_0", f"t{i}", 0, [float(i % 2), float(rng.normal())], "ab"[i % 2]) for i in range(120)]
    data = spark.createDataFrame(rows, "dataset_id string, table_id string, col_idx int, features array<double>, semantic_type string").cache()
    model = ML.train_column_classifier(data.select("dataset_id", "features"), data.select("dataset_id", F.col("semantic_type").alias("label")))
    got = {(r.grp, r.seed, r.metric): r.loss_pct for r in ML.permutation_importance(model, data.drop("semantic_type"), data, {"yes": [0], "no": [1]}, [1, 2]).collect()}
    assert len(got) == 8 and all(v > 20 if g == "yes" else abs(v) < 5 for (g, _, _), v in got.items())


def test_fits_of_all_runs_in_one_job(spark):
    rng = np.random.default_rng(3)
    centres = {"a": (0, 0), "b": (5, 0), "c": (0, 5)}
    rows = [(f"{t}{i}", [float(x) for x in np.array(centres[t]) + rng.normal(size=2)], t) for t in centres for i in range(60)]
    data = spark.createDataFrame(rows, "dataset_id string, features array<double>, semantic_type string").cache()
    labeled = data.where("dataset_id like '%0'").select(F.explode(F.array(F.lit(0), F.lit(1))).alias("run_id"), "dataset_id", "semantic_type")
    # run 0 gets right labels for half of the columns; run 1 wrong ones, also for known columns
    right = data.where("cast(substring(dataset_id, 2, 9) as int) % 2 = 0").select(F.lit(0).alias("run_id"), "dataset_id", F.col("semantic_type").alias("label"))
    wrong = data.where("dataset_id like '%0'").select(F.lit(1).alias("run_id"), "dataset_id", F.translate("semantic_type", "abc", "bca").alias("label"))
    sets = ML.training_sets(labeled, right.unionByName(wrong))
    sizes = {(r.run_id, r.variant): r["count"] for r in sets.groupBy("run_id", "variant").count().collect()}
    assert sizes == {(0, "labeled"): 18, (0, "overwrite"): 90, (0, "keep_gold"): 90, (1, "labeled"): 18, (1, "overwrite"): 18, (1, "keep_gold"): 18}
    models = ML.fit_grid(sets, data).cache()
    test = data.where("cast(substring(dataset_id, 2, 9) as int) % 2 = 1").select(F.explode(F.array(F.lit(0), F.lit(1))).alias("run_id"), "dataset_id")
    hits = {}
    for r in ML.predict_grid(models, test, data).collect():
        hits.setdefault((r.run_id, r.variant), []).append(r.pred == r.dataset_id[0])
    share = {k: np.mean(v) for k, v in hits.items()}
    assert all(len(v) == 90 for v in hits.values())
    assert min(share[k] for k in share if k != (1, "overwrite")) > 0.9 and share[1, "overwrite"] < 0.1


def test_label_runs(spark):
    labeled = spark.createDataFrame([("a", "x"), ("b", "y")], "dataset_id string, semantic_type string")
    votes = spark.createDataFrame([("b", "z"), ("c", "w")], "dataset_id string, label string")
    got = {(r.run_id, r.dataset_id): r.label for r in V.label_runs(labeled, votes).collect()}
    assert got == {
        ("overwrite", "a"): "x", ("overwrite", "b"): "z", ("overwrite", "c"): "w", ("no_overwrite", "a"): "x", ("no_overwrite", "b"): "y", ("no_overwrite", "c"): "w",
        ("no_steering", "a"): "x", ("no_steering", "b"): "y",
    }


def topical_headers(spark):
    rng = np.random.default_rng(4)
    topics = [[f"{t}{i}" for i in range(6)] for t in "abc"]
    rows = [(t, i, h) for t in range(150) for i, h in enumerate(rng.choice(topics[t % 3], 4, replace=False).tolist() + (["common"] if t % 2 else []))]
    return spark.createDataFrame(rows, "table_id long, col_idx int, header string").cache()


def test_header_vectors_are_the_factorisation(spark):
    heads = topical_headers(spark)
    pairs = ML.header_pairs(heads)
    tables = {}
    for r in heads.collect():
        tables.setdefault(r.table_id, set()).add(r.header)
    n = Counter((a, b) for hs in tables.values() for a in hs for b in hs if a != b)
    assert {(r.h1, r.h2): r.n for r in pairs.collect()} == n
    weights = ML.shifted_information(pairs).cache()
    got = {r.h: np.array(r.v) for r in ML.header_vectors(weights, 19, 6).collect()}
    names = sorted(got)
    m = np.zeros((len(names), len(names)))
    for r in weights.collect():
        m[names.index(r.h1), names.index(r.h2)] = r.w
    one = {h: sum(c for (a, _), c in n.items() if a == h) for h in names}
    for (a, b), c in n.items():
        assert m[names.index(a), names.index(b)] == pytest.approx(max(0, np.log(c * sum(n.values()) / (one[a] * one[b]))))
    values, turn = np.linalg.eigh(m)
    v = np.array([got[h] for h in names])
    absolute = (turn * np.abs(values)) @ turn.T
    assert np.allclose(v @ v.T, absolute, atol=1e-5)  # of full size nothing is lost


def test_nearest_headers_and_their_precision(spark):
    heads = topical_headers(spark)
    vectors = ML.header_vectors(ML.shifted_information(ML.header_pairs(heads)), 4).cache()
    near = ML.nearest_headers(vectors, heads.select(F.col("header").alias("seed")).where("header <> 'common'"), 5, block=3)
    assert np.mean([r.seed[0] == r.header[0] for r in near.collect()]) > 0.8
    retrieved = ML.header_retrieval(vectors, heads.unionByName(spark.createDataFrame([(999, 0, "new"), (999, 1, "a1")], heads.schema)), 5).collect()
    assert {r.query_id for r in retrieved} == {*range(150), 999} and [r.rel for r in retrieved if r.query_id == 999] == [0]
    assert np.mean([r.rel for r in retrieved]) > 0.5
    none = ML.header_vectors(ML.shifted_information(ML.header_pairs(heads.limit(0))))
    assert none.collect() == [] and ML.nearest_headers(none, heads.select(F.col("header").alias("seed")), 5).collect() == []
