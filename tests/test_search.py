"""Impact-ordered search against scoring everything, and candidates by column."""

import random
from collections import Counter
from math import log

import pytest
from pyspark.sql import functions as F

from tabletypes.operators import entities as E
from tabletypes.operators import retrieval as R
from tabletypes.operators import topdocs as T


def corpus(seed, n, words=60):
    rnd = random.Random(seed)
    pick = lambda: f"t{int(words * rnd.random() ** 2.5)}"
    texts = {i: [pick() for _ in range(rnd.randrange(1, 25))] for i in range(n)}
    for i in range(0, n, 9):
        texts[i] = texts[0]  # many ties
    return texts


def frames(spark, texts, queries):
    post = [(d, t, c) for d, ts in texts.items() for t, c in Counter(ts).items()]
    asked = [(q, t) for q, ts in queries.items() for t in sorted(set(ts))]
    return spark.createDataFrame(post, "doc_id long, term string, tf long").cache(), spark.createDataFrame(asked, "query_id long, term string").cache()


def brute_bm25(texts, queries, n):
    size = {d: len(ts) for d, ts in texts.items()}
    mean, df = sum(size.values()) / len(size), Counter(t for ts in texts.values() for t in set(ts))
    out = set()
    for q, ts in queries.items():
        score = Counter()
        for d, held in texts.items():
            for t in set(ts) & set(held):
                tf = held.count(t)
                score[d] += log(1 + (len(texts) - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size[d] / mean))
        for r, d in enumerate(sorted(score, key=lambda d: (-round(score[d], 9), d))[:n]):
            out.add((q, d, r + 1, round(score[d], 6)))
    return out


@pytest.mark.parametrize(("size", "n"), [(256, 5), (3, 5), (3, 1000), (1, 1)])
def test_search_equals_scoring_everything(spark, monkeypatch, size, n):
    monkeypatch.setattr(T.best_candidates, "__defaults__", (None, size))
    texts = corpus(1, 300)
    queries = {i: ts for i, ts in corpus(2, 12).items()} | {90: ["none", "t1"], 91: ["none"]}
    post, asked = frames(spark, texts, queries)
    got = {(r.query_id, r.doc_id, r["rank"], round(r.score, 6)) for r in R.bm25(asked, post, n).collect()}
    assert got == brute_bm25(texts, queries, n)


def test_low_blocks_stay_closed(spark):
    """A rare term with high weight decides; the long list of a common one is not opened."""
    weighted = [(d, "common", 0.1 + (d % 7) / 100) for d in range(5000)] + [(d, "rare", 5.0 + d / 100) for d in range(40)]
    w = spark.createDataFrame(weighted, "doc_id long, term string, w double").cache()
    asked = spark.createDataFrame([(1, "common", 1.0), (1, "rare", 1.0)], "query_id long, term string, q double")
    blocks = T.impact_blocks(w, 16).cache()
    bounds = spark.createDataFrame([(1, 5.0)], "query_id long, bound double")
    opened = T._opened(asked, blocks, bounds)
    assert opened.where("term = 'common'").isEmpty() and opened.count() == 3 and blocks.count() > 300
    assert opened.agg(F.max(F.size("docs"))).first()[0] <= 16
    best = T.best_candidates(asked, w, 10, size=16).orderBy(F.desc("score")).limit(10).collect()
    assert [r.doc_id for r in best] == sorted(range(40), key=lambda d: -(5.1 + d / 100 + (d % 7) / 100))[:10]


def test_neighbours_leave_out_the_query(spark):
    texts = corpus(3, 80, 30)
    post, _ = frames(spark, texts, {})
    v = R.tfidf(post).cache()
    got = R.text_neighbours(v.withColumnRenamed("doc_id", "query_id"), v, 4).collect()
    dots = v.withColumnsRenamed({"doc_id": "query_id", "w": "q"}).join(v, "term").where("query_id <> doc_id").groupBy("query_id", "doc_id").agg(F.sum(F.col("q") * F.col("w")).alias("s")).collect()
    want = {}
    for r in dots:
        want.setdefault(r.query_id, []).append((round(max(0, round(2 - 2 * r.s, 9)) ** 0.5, 9), r.doc_id))
    want = {(q, d, i + 1) for q, ds in want.items() for i, (_, d) in enumerate(sorted(ds)[:4])}
    assert {(r.query_id, r.doc_id, r["rank"]) for r in got} == want
    none = v.limit(0)
    assert R.text_neighbours(none.withColumnRenamed("doc_id", "query_id"), none, 4).collect() == []


def test_candidates_by_column(spark):
    rnd = random.Random(4)
    cells = {(f"t{rnd.randrange(8)}", rnd.randrange(3), f"e{rnd.randrange(12)}") for _ in range(120)}
    seeds = {q: {f"e{rnd.randrange(12)}" for _ in range(rnd.randrange(1, 4))} for q in range(10)} | {50: {"unknown"}}
    got = E.cell_candidates_by_column(
        spark.createDataFrame([(q, s) for q, ss in seeds.items() for s in ss], "query_id long, seed string"),
        spark.createDataFrame([(e, t, c) for t, c, e in cells], "entity string, t_id string, c_id int"),
    )
    want = set()
    for q, ss in seeds.items():
        for cand in {e for _, _, e in cells}:
            both = {(s, t, c) for s in ss for t, c, e in cells if e == cand and (t, c, s) in cells}
            if both:
                want.add((q, cand, len({s for s, _, _ in both}), len({(t, c) for _, t, c in both})))
    assert {tuple(r) for r in got.collect()} == want
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 3  # the entities of the columns are met once


def test_entities_of_a_column_travel_as_lists(spark, monkeypatch):
    monkeypatch.setattr(E, "LIST_ROWS", 3)
    columns = spark.createDataFrame([(f"e{i}", t, 1) for t in range(3) for i in range(t, 9 + t)] + [(None, 0, 1)], "entity string, t_id long, c_id int")
    seeds = spark.createDataFrame([(1, "e0"), (2, "e2"), (2, "e10"), (3, "e2"), (3, "e10"), (4, None)], "query_id long, seed string")
    got = E.cell_candidates_by_column(seeds, columns)
    want = {(1, f"e{i}", 1, 1) for i in range(9)}
    want |= {(q, f"e{i}", 1 + (i >= 2), sum(t <= i < 9 + t for t in range(3))) for q in (2, 3) for i in range(11)}
    assert {tuple(r) for r in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert not any("cand#" in x for x in plan.split("\n") if "Exchange hashpartitioning(sid" in x)  # no row of a query and an entity is shuffled


def test_caption_sources_join_the_candidates(spark):
    of = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2), ("d", 3), ("a", 3)], "entity string, t_id long")
    seeds = spark.createDataFrame([(1, "a"), (2, "zz")], "query_id long, seed string")
    by_caption = spark.createDataFrame([(1, 2), (2, 2), (2, 3)], "query_id long, t_id long")
    got = {(r.query_id, r.cand, r.source) for r in R.row_candidates(seeds, of, by_caption).collect()}
    assert got == {(1, "b", "entity"), (1, "d", "entity"), (1, "c", "caption"), (2, "c", "caption"), (2, "d", "caption"), (2, "a", "caption")}


def test_own_caption_score(spark):
    caps = {1: "big red", 2: "big red", 3: "red", 4: "small blue blue"}
    got = {r.t_id: r.score for r in R.own_caption_score(spark.createDataFrame(list(caps.items()), "t_id long, caption string"), []).collect()}
    coll = Counter(t for c in caps.values() for t in c.split())
    for t, c in caps.items():
        ts = c.split()
        assert got[t] == pytest.approx(sum(log((n + 50 * coll[w] / coll.total()) / (len(ts) + 50)) for w, n in Counter(ts).items()))


@pytest.mark.parametrize("shared", [10**6, 0])
def test_scored_where_they_lie_as_by_bounds(spark, monkeypatch, shared):
    """Few queries: one shuffle of postings by document and none of (query, document, term) rows."""
    monkeypatch.setattr(T, "SHARED", shared)
    monkeypatch.setattr(T, "MEETINGS", 100)
    texts = corpus(4, 200)
    queries = dict(corpus(5, 10).items())
    post, asked = frames(spark, texts, queries)
    found = R.bm25(asked, post, 7)
    assert {(r.query_id, r.doc_id, r["rank"], round(r.score, 6)) for r in found.collect()} == brute_bm25(texts, queries, 7)
    if shared:
        plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert plan.count("Exchange hashpartitioning(query_id") <= 1 and "hashpartitioning(doc_id" in plan and "Exchange hashpartitioning(doc_id#" in plan


def test_pairs_of_alike_tables_are_weighted(spark):
    pairs = spark.createDataFrame([(1, 1, 1000000), (1, 0, 400000), (2, 1, 3), (3, None, 5)], "query_id long, label int, n long")
    queries = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "b")], "query_id long, split string")
    got = {(r.split, r.query_id, r.n_pos, r.n_neg, r.ratio) for r in R.query_table_pairs(pairs, queries).collect()}
    assert got == {("a", 1, 1000000, 400000, 2.5), ("a", 2, 3, 0, None), ("b", 3, 0, 0, None)}
