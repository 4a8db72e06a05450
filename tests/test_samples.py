"""Samples, noise, chunks and weighted draws."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabletypes.operators import corpus as C
from tabletypes.operators import prep as D


def test_sketches_keep_the_least_digests(spark, monkeypatch):
    rnd = random.Random(1)
    rows = [(rnd.choice(["hot", "hot", "a", "b", None]), i, str(i)) for i in range(3000)]
    cells = spark.createDataFrame(rows, "dataset_id string, row_id long, value string")
    want = {tuple(r) for r in C.sample_column(cells.coalesce(1), 7, 3).collect()}
    assert Counter(d for d, _, _ in want) == {"hot": 7, "a": 7, "b": 7, None: 7}
    monkeypatch.setattr(C, "SKETCH_ROWS", 20)  # sketches are given out and begun anew all the time
    assert {tuple(r) for r in C.sample_column(cells.repartition(6), 7, 3).collect()} == want
    assert C.sample_column(cells.limit(0), 7, 3).collect() == []
    shuffled = cells.withColumn("__o", F.lit("x")).mapInArrow(C._bottom(7, []), "dataset_id string, row_id long, value string, __o string").coalesce(1)
    assert shuffled.count() < 300


def test_draws_with_replacement_are_even(spark):
    cells = spark.range(12).select(F.lit("c").alias("dataset_id"), F.col("id").alias("row_id"))
    counts, repeats = Counter(), 0
    for seed in range(30):
        got = C.sample_with_replacement(cells, 20, seed).collect()
        assert sorted(r.draw for r in got) == list(range(1, 21))
        counts.update(r.row_id for r in got)
        repeats += len({r.row_id for r in got}) < 20
    assert repeats == 30 and set(counts) == set(range(12)) and max(counts.values()) < 3 * min(counts.values())


def test_noise_has_the_deviation_and_keeps_the_rest(spark):
    df = spark.range(4000).select("id", (F.col("id") % 100).cast("double").alias("x"), F.when(F.col("id") % 2 == 0, 5.0).alias("flat"))
    rows = C.add_gaussian_noise(df, ["x", "flat"], 0.25, ["id"], 2).collect()
    added = np.array([r.x - r.id % 100 for r in rows if r.noisy])
    assert len(rows) == 4000 and 0.2 < len(added) / 4000 < 0.3
    assert all(r.x == r.id % 100 for r in rows if not r.noisy) and all((r.flat is None) == (r.id % 2 == 1) for r in rows)
    assert abs(added.mean()) < 3 and 25 < added.std() < 33 and all(r.flat in (5.0, None) for r in rows)
    again = C.add_gaussian_noise(df.repartition(7), ["x", "flat"], 0.25, ["id"], 2).orderBy("id").collect()
    assert [(r.id, r.noisy, round(r.x, 9)) for r in again] == [(r.id, r.noisy, round(r.x, 9)) for r in rows]


def chunks_of(widths, budget):
    out, held, chunk = [], 0, 0
    for w in widths:
        out.append(chunk)
        held += w
        if held >= budget:
            held, chunk = 0, chunk + 1
    return out


def test_chunks_restart_after_each_cut(spark):
    rnd = random.Random(2)
    tables = {t: [rnd.randrange(1, 9) for _ in range(rnd.randrange(1, 70))] for t in range(25)} | {99: [1] * 500, 98: [50]}
    rows = spark.createDataFrame([(t, 3 * i, w) for t, ws in tables.items() for i, w in enumerate(ws)], "t long, r long, w long").repartition(5)
    got = {}
    for r in D.restarting_chunks(rows, "t", "r", "w", 11).orderBy("t", "r").collect():
        got.setdefault(r.t, []).append(r.chunk)
    assert got == {t: chunks_of(ws, 11) for t, ws in tables.items()}
    assert D.restarting_chunks(rows.limit(0), "t", "r", "w", 11).collect() == []


@pytest.mark.parametrize("small", [None, 2])
def test_draws_fill_up_beside_a_frequent_entity(spark, small):
    counts = {0: 100_000, 1: 30_000} | {i: 1 + i % 9 for i in range(2, 60)} | {70: 0}
    vocabulary = spark.createDataFrame(list(counts.items()), "entity long, cnt long")
    examples = spark.createDataFrame([(e, 5) for e in range(40)], "example_id long, gold long")
    given = spark.createDataFrame([(e, 6 + e % 3) for e in range(40)], "example_id long, cand long")
    for n in (12, 200):
        got = D.negative_candidates(examples, given, vocabulary, n, 3, small).collect()
        per = Counter(r.example_id for r in got)
        assert per == {e: min(n, 60) for e in range(40)}
        assert len({(r.example_id, r.cand) for r in got}) == len(got)
        by = {(r.example_id, r.slot): r for r in got}
        assert all(by[e, 1].cand == 5 and by[e, 1].kind == "gold" and by[e, 2].kind == "provided" for e in range(40))
    first = Counter(r.cand for r in D.negative_candidates(examples, given, vocabulary, 12, 3, small).where("slot = 3").collect())
    assert first[0] > 20  # of nearly all tickets


def test_draws_follow_the_weights(spark):
    counts = {i: 1 + i for i in range(30)}
    vocabulary = spark.createDataFrame(list(counts.items()), "entity long, cnt long")
    examples = spark.range(3000).select(F.col("id").alias("example_id"), F.lit(-1).cast("long").alias("gold"))
    none = spark.createDataFrame([], "example_id long, cand long")
    for small in (0, 100):
        drawn = Counter(r.cand for r in D.negative_candidates(examples, none, vocabulary, 2, 1, small).where("slot = 2").collect())
        total = sum(counts.values())
        assert sum((drawn[i] - 3000 * w / total) ** 2 / (3000 * w / total) for i, w in counts.items()) < 60  # chi-squared, 29 degrees


def test_draws_that_cannot_be_among_the_first_are_dropped(spark):
    vocabulary = spark.createDataFrame([(i, 8 + i % 8, 3) for i in range(200)], "entity long, cnt long, cls int")
    numbered = vocabulary.withColumn("at", F.col("entity") + 1)
    examples = spark.range(100).select(F.col("id").alias("example_id"))
    large = [(3, 200, sum(8 + i % 8 for i in range(200)))]
    firsts, rows = [], []
    for scale in (1, 8):
        best = {}
        drawn = D._draws(examples, large, [], numbered, 5, scale, 3).collect()
        for r in drawn:
            best[r.example_id, r.cand] = min(r.time, best.get((r.example_id, r.cand), r.time))
        firsts.append({e: sorted((t, c) for (x, c), t in best.items() if x == e)[:5] for e in range(100)})
        rows.append(len(drawn))
    assert firsts[0] == firsts[1] and all(len(x) == 5 for x in firsts[0].values())
    assert rows[1] < 100 * 15  # of 168 arrivals of an example
