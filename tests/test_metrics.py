import math

import pytest

from tabletypes.operators import metrics as M


def ranking(spark, lists):
    rows = [(q, i, i, r) for q, rels in enumerate(lists) for i, r in enumerate(rels, 1)]
    return spark.createDataFrame(rows, "query_id long, cand long, rank long, rel long")


def test_mrr_examples(spark):
    m = M.mean_measures(M.ranking_measures(ranking(spark, [[0, 0, 1], [0, 1, 0], [1, 0, 0]]))).first()
    assert m.mrr == pytest.approx(0.6111111111)
    m = M.mean_measures(M.ranking_measures(ranking(spark, [[0, 0, 0], [0, 1, 0], [1, 0, 0]]))).first()
    assert m.mrr == pytest.approx(0.5)


def test_average_precision_example(spark):
    r = M.ranking_measures(ranking(spark, [[1, 1, 0, 1, 0, 1, 0, 0, 0, 1]])).first()
    assert r.ap == pytest.approx(0.7833333333)
    assert r.r_precision == pytest.approx(5 / 10) and r.p_at_1 == 1 and r.p_at_5 == pytest.approx(3 / 5)


def test_measures_do_not_change_with_blocks(spark):
    rk = ranking(spark, [[int((i * 7) % 5 == 0) for i in range(900)], [0, 1]])
    a = M.ranking_measures(rk, hot_rows=100).orderBy("query_id").collect()
    assert a == M.ranking_measures(rk).orderBy("query_id").collect()


@pytest.mark.parametrize(
    "rels, k, method, want",
    [([3, 2, 3, 0, 0, 1, 2, 2, 3, 0], 1, 0, 1.0), ([2, 1, 2, 0], 4, 0, 0.9203032077642922), ([2, 1, 2, 0], 4, 1, 0.96519546960144276), ([0], 1, 0, 0.0), ([1], 2, 0, 1.0)],
)
def test_ndcg_examples(spark, rels, k, method, want):
    assert M.ndcg(ranking(spark, [rels]), k, method).first().ndcg == pytest.approx(want)


@pytest.mark.parametrize("k, method, want", [(1, 0, 3.0), (1, 1, 3.0), (2, 0, 5.0), (2, 1, 4.2618595071429155), (10, 0, 9.6051177391888114)])
def test_dcg_examples(spark, k, method, want):
    assert M.ndcg(ranking(spark, [[3, 2, 3, 0, 0, 1, 2, 2, 3, 0]]), k, method).first().dcg == pytest.approx(want)


def test_classification_report(spark):
    rows = [("a", "a"), ("a", "b"), ("b", "b"), ("b", None), ("c", "a")]
    df = spark.createDataFrame(rows, "truth string, pred string")
    r = {x.cls: x for x in M.classification_report(df).collect()}
    assert r["a"].precision == 0.5 and r["a"].recall == 0.5 and r["abstain"].support == 0
    assert r["accuracy"].f1 == pytest.approx(0.4) and r["c"].f1 == 0
    g = {x.cls: x for x in M.classification_report(df, keep_abstain=False).collect()}
    assert g["accuracy"].f1 == pytest.approx(0.5) and "abstain" not in g
    assert not any(math.isnan(x.f1) for x in g.values())
