"""Candidates of mentions, unions and column pairs against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tabletypes.operators import corpus as C
from tabletypes.operators import entities as E
from tabletypes.operators import joins as J
from tabletypes.operators import retrieval as R
from tabletypes.plans import skew as W


def test_linking_examples_equal_brute_force(spark):
    rnd = random.Random(7)
    cands = {f"s{k}": sorted({rnd.randrange(30) for _ in range(rnd.randrange(1, 9))}) for k in range(6)}
    mentions = [(t, i, 0, s := f"s{rnd.randrange(7)}", rnd.choice([*cands.get(s, [1]), 99])) for t in range(12) for i in range(rnd.randrange(1, 9))]
    rows = [(s, p + 1, c) for s, cs in cands.items() for p, c in enumerate(cs)]
    got = E.linking_examples(spark.createDataFrame(mentions, "t_id long, i int, j int, surface string, gold long"), spark.createDataFrame(rows, "surface string, pos long, cand long"), 3)
    want = set()
    for t in range(12):
        known = sorted(m for m in mentions if m[0] == t and m[4] in cands.get(m[3], []))
        for k in range(0, len(known), 3):
            vocab = sorted({c for m in known[k : k + 3] for c in cands[m[3]]})
            want |= {(t, k // 3, m[1], 0, c, vocab.index(c), c == m[4]) for m in known[k : k + 3] for c in cands[m[3]]}
    assert {tuple(r) for r in got.collect()} == want
    # candidates travel in lists: the rows that are shuffled are as many as the mentions
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate explode") < plan.index("REPARTITION_BY_COL")


def test_long_lists_come_in_pieces(spark):
    df = spark.range(5000).select(F.when(F.col("id") < 4000, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 100)).alias("k"), F.col("id").alias("v"))
    rows = W.listed(df, "k", "v", 100).collect()
    assert sorted(v for r in rows for v in r.v) == list(range(5000)) and max(len(r.v) for r in rows) < 200 and len(rows) < 200


def test_targets_by_key_are_not_built(spark):
    a = spark.createDataFrame([(1, 10), (1, 11), (2, 10), (None, 10)], "q long, cand long")
    b = spark.createDataFrame([(1, 10), (3, 12), (4, 13)], "q long, cand long")
    first = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z"), (3, None)], "q long, k string")
    second = spark.createDataFrame([(10, "y"), (10, "y"), (11, "w"), (12, None)], "cand long, k string")
    built = first.join(second, "k").select("q", "cand")
    got = J.candidate_union(a, b, (first, second, "k"), ["q", "cand"])
    assert sorted(map(str, got.collect())) == sorted(map(str, J.candidate_union(a, b, built, ["q", "cand"]).collect()))
    assert [(r.q, r.cand) for r in got.where("hit").collect()] == [(1, 10)]


@pytest.mark.parametrize("columns", [0, 64])
def test_shared_values_both_ways(spark, monkeypatch, columns):
    monkeypatch.setattr(J, "COLUMNS_OF_VALUE", columns)
    rnd = random.Random(8)
    sets = {f"c{i}": {f"v{rnd.randrange(14)}" for _ in range(rnd.randint(1, 20))} for i in range(30)}
    df = spark.createDataFrame([(c, "t" if int(c[1:]) % 2 else "s", v) for c, vs in sets.items() for v in vs], "dataset_id string, semantic_type string, value string")
    got = {(r.a, r.b, r.shared) for r in J.overlap_candidates(df, 0.6).collect()}
    assert got == {(a, b, len(x & y)) for a, x in sets.items() for b, y in sets.items() if a != b and (int(a[1:]) - int(b[1:])) % 2 == 0 and len(x & y) >= 0.6 * len(x) - 1e-9}


def test_tables_by_entity_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(R, "MEETINGS", 200)
    rnd = random.Random(9)
    of = sorted({(f"e{int(20 * rnd.random() ** 2)}", rnd.randrange(40)) for _ in range(300)})
    df = spark.createDataFrame(of, "entity string, t_id long")
    found = R.tables_by_entity(df.withColumnRenamed("t_id", "query_id"), df, 6)
    want = set()
    for q in {t for _, t in of}:
        mine = {e for e, t in of if t == q}
        k = {t: len(mine & {e for e, s in of if s == t}) for t in {t for _, t in of}}
        want |= {(q, t) for t in sorted((t for t in k if k[t]), key=lambda t: (-k[t], t))[:6]}
    assert {tuple(r) for r in found.collect()} == want
    assert "hashpartitioning(query_id#" in (plan := found._jdf.queryExecution().executedPlan().toString()) and "hashpartitioning(query_id, t_id" not in plan


def test_early_cells_hold_the_first(spark):
    rnd = random.Random(10)
    rows = [(f"t+column_{c}", "t", c, r, "v") for c in range(3) for r in [*(f"{rnd.randrange(10**9)}-{k}" for k in range((3, 20, 3000)[c])), None, ""]]
    df = spark.createDataFrame(rows, "dataset_id string, table_id string, col_idx int, row_id string, value string")
    kept = [(r.dataset_id, r.row_id) for r in C._early(df, 8).collect()]
    for c in {r[0] for r in rows}:
        ids = sorted((r[3] or "" for r in rows if r[0] == c), key=lambda x: x)
        assert sorted(r or "" for d, r in kept if d == c)[:8] == ids[:8]
    assert len(kept) < 100
    assert C._early(df.withColumn("row_id", F.lit(1)), 8).count() == len(rows)
