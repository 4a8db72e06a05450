"""Quality measures on votes, type scores and document rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import metrics as M
from ..operators import votes as V
from . import fixtures as X
from .emd_queries import SIDES, emd_cte, numeric_sides
from .join_queries import _SC, type_scores
from .label_queries import _V, MAJORITY, REPORT, votes_of
from .registry import query
from ..operators import emd as E

_TP = "tp0 AS (SELECT semantic_type AS truth, {p} AS pred FROM gold LEFT JOIN mv USING (dataset_id){w})"
_JUDGED = f"{_V}, {MAJORITY}, {X.columns_cte()}, " + _TP.format(p="coalesce(label, 'abstain')", w="")


def judged(spark, sf):
    gold = X.gold(spark, sf)
    return gold.join(V.majority_vote(votes_of(spark, sf)), "dataset_id", "left").select("dataset_id", F.col("semantic_type").alias("truth"), F.col("label").alias("pred"))


def _rounded(report):
    return report.select(*[c for c in report.columns if c not in ("precision", "recall", "f1")], *[S.rnd(c).alias(c) for c in ("precision", "recall", "f1")])


@query("m1_classification_report", f"{_JUDGED}, {REPORT} SELECT * FROM rr")
def m1(spark, sf):
    return _rounded(M.classification_report(judged(spark, sf)))


@query(
    "m1_report_generation_mode",
    f"{_V}, {MAJORITY}, {X.columns_cte()}, {_TP.format(p='label', w=' WHERE label IS NOT NULL')}, {REPORT} SELECT * FROM rr",
)
def m1_gen(spark, sf):
    return _rounded(M.classification_report(judged(spark, sf), keep_abstain=False))


@query("m2_confusion_matrix", f"{_JUDGED} SELECT truth, pred, count(*) AS n FROM tp0 GROUP BY ALL")
def m2(spark, sf):
    return M.confusion_matrix(judged(spark, sf).withColumn("pred", F.coalesce("pred", F.lit("abstain"))))


@query("m2b_confusion_rates", f"{_JUDGED} SELECT truth, pred, round(count(*) / sum(count(*)) OVER (PARTITION BY truth), 6) AS rate FROM tp0 GROUP BY truth, pred")
def m2b(spark, sf):
    cm = M.confusion_matrix(judged(spark, sf).withColumn("pred", F.coalesce("pred", F.lit("abstain"))))
    return M.confusion_rates(cm).withColumn("rate", S.rnd("rate"))


@query(
    "m2c_label_set_stats",
    f"{_V}, {MAJORITY}, {X.columns_cte()}, {_TP.format(p='label', w='')} SELECT count(DISTINCT pred) AS n_predicted, count(DISTINCT truth) AS n_present, "
    "(SELECT count(DISTINCT pred) FROM tp0 WHERE pred NOT IN (SELECT truth FROM tp0)) AS n_never_present, round(count(pred) / count(*), 6) AS coverage FROM tp0",
)
def m2c(spark, sf):
    return M.label_set_stats(judged(spark, sf)).withColumn("coverage", S.rnd("coverage"))


@query(
    "m2d_multi_view_accuracy",
    f"WITH {X.columns_cte()}, {_SC}, v AS (SELECT dataset_id, semantic_type AS type, score AS s FROM sc UNION ALL SELECT dataset_id, semantic_type, score * (length(semantic_type) % 3) FROM sc), "
    "m AS (SELECT dataset_id, type, round(avg(s), 9) AS s FROM v GROUP BY ALL), b AS (SELECT dataset_id, first(type ORDER BY s DESC, type DESC) AS pred FROM m GROUP BY 1) "
    "SELECT count(*) AS n, round(count(*) FILTER (WHERE pred = semantic_type) / count(*), 6) AS accuracy FROM b JOIN gold USING (dataset_id)",
)
def m2d(spark, sf):
    gold = X.gold(spark, sf)
    s = type_scores(gold)
    views = F.array(F.struct(F.lit(0).alias("view"), F.col("score").alias("s")), F.struct(F.lit(1).alias("view"), (F.col("score") * (F.length("semantic_type") % 3)).alias("s")))
    scores = s.select("dataset_id", F.col("semantic_type").alias("type"), F.inline(views)).withColumnRenamed("s", "score")
    return M.multi_view_accuracy(scores, gold).withColumn("accuracy", S.rnd("accuracy"))


@query(
    "m3_top_confusions",
    f"WITH {X.columns_cte()}, {_SC}, b AS (SELECT dataset_id, first(semantic_type ORDER BY score DESC, semantic_type) AS pred FROM sc GROUP BY 1), "
    "cm AS (SELECT semantic_type AS truth, pred, count(*) AS n FROM b JOIN gold USING (dataset_id) WHERE semantic_type <> pred GROUP BY ALL), "
    "d AS (SELECT truth AS cls, pred AS other, n, 'mis_to' AS direction FROM cm UNION ALL SELECT pred, truth, n, 'mis_from' FROM cm) "
    "SELECT *, (row_number() OVER (PARTITION BY direction, cls ORDER BY n DESC, other))::INTEGER AS rank FROM d QUALIFY rank <= 5",
)
def m3(spark, sf):
    return M.top_confusions(M.confusion_matrix(argmax(X.gold(spark, sf))), 5)


# each document is taken to have the language that its source has most
@query(
    "t4_top_confusions",
    "WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL), p AS (SELECT source, first(lang ORDER BY n DESC, lang) AS pred FROM c GROUP BY 1), "
    "cm AS (SELECT lang AS truth, pred, count(*) AS n FROM documents JOIN p USING (source) WHERE lang <> pred GROUP BY ALL), "
    "d AS (SELECT truth AS cls, pred AS other, n, 'mis_to' AS direction FROM cm UNION ALL SELECT pred, truth, n, 'mis_from' FROM cm) "
    "SELECT *, (row_number() OVER (PARTITION BY direction, cls ORDER BY n DESC, other))::INTEGER AS rank FROM d QUALIFY rank <= 5",
)
def t4(spark, sf):
    docs = X.base(spark, sf, "documents").select("source", "lang")
    counts = docs.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    most = counts.groupBy("source").agg(F.min(F.struct((-F.col("n")).alias("n"), "lang"))["lang"].alias("pred"))
    return M.top_confusions(M.confusion_matrix(docs.join(most, "source").select(F.col("lang").alias("truth"), "pred")), 5)


def argmax(gold):
    s = type_scores(gold)
    best = s.groupBy("dataset_id").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("semantic_type").alias("t")))["t"].alias("pred"))
    return best.join(gold.select("dataset_id", F.col("semantic_type").alias("truth")), "dataset_id")


_RA = REPORT.replace("tp0", "ta").replace("ct AS", "ct_a AS").replace("FROM ct)", "FROM ct_a)").replace("rp", "rp_a").replace("ra AS", "ra_a AS").replace("FROM ra)", "FROM ra_a)").replace("rr AS", "rr_a AS")
_COMPARE = (
    f"{_JUDGED}, {_SC}, ta AS (SELECT semantic_type AS truth, pred FROM gold JOIN (SELECT dataset_id, first(semantic_type ORDER BY score DESC, semantic_type) AS pred FROM sc GROUP BY 1) USING (dataset_id)), "
    f"{REPORT}, {_RA}, cp AS (SELECT cls, a.f1 AS f1_a, b.f1 AS f1_b, b.f1 - a.f1 AS diff, CASE WHEN a.f1 > 0 THEN 100 * (b.f1 - a.f1) / a.f1 END AS gain_pct FROM rr_a a FULL JOIN rr b USING (cls))"
)


def _comparison(spark, sf):
    gold = X.gold(spark, sf)
    a = _rounded(M.classification_report(argmax(gold)))
    b = _rounded(M.classification_report(judged(spark, sf)))
    return M.compare_models(a, b)


@query("m4_compare_models", f"{_COMPARE} SELECT cls, f1_a, f1_b, round(diff, 6) + 0.0 AS diff, round(gain_pct, 4) + 0.0 AS gain_pct FROM cp")
def m4(spark, sf):
    return _comparison(spark, sf).withColumn("diff", S.rnd("diff")).withColumn("gain_pct", S.rnd("gain_pct", 4))


@query(
    "t7_best_worst_types",
    f"{_COMPARE}, z AS (SELECT cls, round(diff, 9) AS d, diff FROM cp WHERE diff IS NOT NULL) SELECT * FROM (SELECT 'best' AS side, cls, round(diff, 6) + 0.0 AS diff FROM z ORDER BY d DESC, cls LIMIT 3) "
    "UNION ALL SELECT * FROM (SELECT 'worst', cls, round(diff, 6) + 0.0 FROM z ORDER BY d, cls LIMIT 3)",
)
def t7(spark, sf):
    return M.best_worst_types(_comparison(spark, sf).where("diff is not null"), 3).withColumn("diff", S.rnd("diff"))


@query(
    "m4_method_table",
    f"{_COMPARE} SELECT 'votes' AS method, cls, max(f1_a) AS scores, max(f1_b) AS lf FROM cp WHERE cls IN ('macro avg', 'weighted avg') GROUP BY cls",
)
def m4_table(spark, sf):
    gold = X.gold(spark, sf)
    a = _rounded(M.classification_report(argmax(gold))).withColumn("variant", F.lit("scores"))
    b = _rounded(M.classification_report(judged(spark, sf))).withColumn("variant", F.lit("lf"))
    return M.method_table(a.unionByName(b).withColumn("method", F.lit("votes")), ["scores", "lf"])


# --- rankings: parts ranked per supplier by sold quantity; relevant are those ever returned ('R') more than once ------

_RK = (
    "q0 AS (SELECT l_suppkey AS query_id, l_partkey AS cand, sum(l_quantity) AS score, CASE WHEN count(*) FILTER (WHERE l_returnflag = 'R') > 0 THEN 1 ELSE 0 END + CASE WHEN count(*) > 1 THEN 1 ELSE 0 END AS rel FROM lineitem GROUP BY ALL), "
    "rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cand) AS rank FROM q0)"
)


def ranking(spark, sf):
    li = X.base(spark, sf, "lineitem")
    rel = F.when(F.count_if(F.col("l_returnflag") == "R") > 0, 1).otherwise(0) + F.when(F.count(F.lit(1)) > 1, 1).otherwise(0)
    scored = li.groupBy(F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("cand")).agg(F.sum("l_quantity").alias("score"), rel.alias("rel"))
    return M.rank_by_score(scored)


@query(
    "m5_ranking_measures",
    f"WITH {_RK}, c AS (SELECT *, sum((rel > 0)::INT) OVER (PARTITION BY query_id ORDER BY rank) / rank AS pr FROM rk) SELECT query_id, round(coalesce(max(1 / rank) FILTER (WHERE rel > 0), 0), 6) + 0.0 AS rr, "
    "round(coalesce(count(*) FILTER (WHERE rel > 0) / max(rank) FILTER (WHERE rel > 0), 0), 6) + 0.0 AS r_precision, round(coalesce(avg(pr) FILTER (WHERE rel > 0), 0), 6) + 0.0 AS ap, "
    + ", ".join(f"round(count(*) FILTER (WHERE rel > 0 AND rank <= {k}) / {k}, 6) + 0.0 AS p_at_{k}" for k in (1, 3, 5, 10))
    + ", count(*) AS size FROM c GROUP BY 1",
)
def m5(spark, sf):
    m = M.ranking_measures(ranking(spark, sf))
    return m.select("query_id", "size", *[S.rnd(c).alias(c) for c in m.columns if c not in ("query_id", "size")])


@query(
    "m5_mean_measures",
    f"WITH {_RK}, c AS (SELECT *, sum((rel > 0)::INT) OVER (PARTITION BY query_id ORDER BY rank) / rank AS pr FROM rk), p AS (SELECT query_id, coalesce(max(1 / rank) FILTER (WHERE rel > 0), 0) AS rr, "
    "coalesce(count(*) FILTER (WHERE rel > 0) / max(rank) FILTER (WHERE rel > 0), 0) AS rp, coalesce(avg(pr) FILTER (WHERE rel > 0), 0) AS ap FROM c GROUP BY 1) "
    "SELECT round(avg(rr), 6) AS mrr, round(avg(rp), 6) AS r_precision, round(avg(ap), 6) AS map FROM p",
)
def m5_mean(spark, sf):
    m = M.mean_measures(M.ranking_measures(ranking(spark, sf)))
    return m.select(*[S.rnd(c).alias(c) for c in m.columns])


@query("w6_cumulative_precision", f"WITH {_RK} SELECT query_id, rank, round(sum((rel > 0)::INT) OVER (PARTITION BY query_id ORDER BY rank) / rank, 6) AS precision FROM rk")
def w6(spark, sf):
    return M.cumulative_precision(ranking(spark, sf)).select("query_id", "rank", S.rnd("precision").alias("precision"))


@query("t3_top_n", f"WITH {_RK} SELECT query_id, cand, round(score, 6) + 0.0 AS score, rank FROM rk WHERE rank <= 20")
def t3(spark, sf):
    li = X.base(spark, sf, "lineitem")
    scored = li.groupBy(F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("cand")).agg(F.sum("l_quantity").alias("score"))
    from ..plans.ordered import top

    return top(scored, ["query_id"], [F.desc("score"), F.col("cand")], 20).withColumn("rank", F.col("rank").cast("long")).withColumn("score", S.rnd("score"))


@query("t5_precision_at", f"WITH {_RK} SELECT query_id, " + ", ".join(f"round(count(*) FILTER (WHERE rel > 0 AND rank <= {k}) / {k}, 6) + 0.0 AS p_at_{k}" for k in (1, 3, 5, 10)) + " FROM rk GROUP BY 1")
def t5(spark, sf):
    m = M.ranking_measures(ranking(spark, sf))
    return m.select("query_id", *[S.rnd(f"p_at_{k}").alias(f"p_at_{k}") for k in (1, 3, 5, 10)])


def _ndcg_sql(gain):
    return (
        f"WITH {_RK}, b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, rank) AS best FROM rk), "
        f"d AS (SELECT query_id, sum({gain.format(r='rank')}) FILTER (WHERE rank <= 10) AS dcg, sum({gain.format(r='best')}) FILTER (WHERE best <= 10) AS idcg FROM b GROUP BY 1) "
        "SELECT query_id, round(dcg, 6) + 0.0 AS dcg, round(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END, 6) + 0.0 AS ndcg FROM d"
    )


@query("m6_ndcg_method_0", _ndcg_sql("CASE WHEN {r} = 1 THEN rel ELSE rel / log2(greatest({r}, 2)) END"))
def m6_0(spark, sf):
    return M.ndcg(ranking(spark, sf), 10, 0).select("query_id", S.rnd("dcg").alias("dcg"), S.rnd("ndcg").alias("ndcg"))


@query("m6_ndcg_method_1", _ndcg_sql("rel / log2({r} + 1)"))
def m6_1(spark, sf):
    return M.ndcg(ranking(spark, sf), 10, 1).select("query_id", S.rnd("dcg").alias("dcg"), S.rnd("ndcg").alias("ndcg"))


@query(
    "m7_accuracy_at",
    f"WITH {_RK}, f AS (SELECT query_id, min(rank) FILTER (WHERE rel > 1) AS r FROM rk GROUP BY 1) SELECT round(count(*) FILTER (WHERE r <= 1) / count(*), 6) AS acc_at_1, round(count(*) FILTER (WHERE r <= 5) / count(*), 6) AS acc_at_5, round(avg(r), 6) AS mean_rank FROM f",
)
def m7(spark, sf):
    strict = ranking(spark, sf).withColumn("rel", (F.col("rel") > 1).cast("int"))
    out = M.accuracy_at(strict)
    return out.select(*[S.rnd(c).alias(c) for c in out.columns])


# gold candidate of a supplier: its part with the smallest key sold in the largest single quantity, or a part it never sold
_GOLD = "gd AS (SELECT l_suppkey AS query_id, CASE WHEN l_suppkey % 10 = 3 THEN -1 ELSE min(l_partkey) END AS cand FROM lineitem GROUP BY 1)"


def gold_candidates(spark, sf):
    li = X.base(spark, sf, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("query_id")).agg(F.min("l_partkey").alias("m")).select(
        "query_id", F.when(F.col("query_id") % 10 == 3, F.lit(-1)).otherwise(F.col("m")).cast("long").alias("cand")
    )


@query("w5_gold_rank", f"WITH {_RK}, {_GOLD} SELECT query_id, coalesce(rank, 999) AS gold_rank FROM gd LEFT JOIN rk USING (query_id, cand)")
def w5(spark, sf):
    return M.gold_rank(ranking(spark, sf), gold_candidates(spark, sf))


@query(
    "a18_describe_ranks",
    "SELECT count(*) AS n, min(l_extendedprice) AS min, max(l_extendedprice) AS max, round(avg(l_extendedprice) + 1e-10, 6) AS mean, round(stddev_samp(l_extendedprice), 5) AS std, "
    + ", ".join(f"round(quantile_cont(l_extendedprice, {d / 100}), 6) + 0.0 AS p{d}" for d in range(10, 100, 10))
    + " FROM lineitem",
)
def a18(spark, sf):
    out = M.describe_ranks(X.base(spark, sf, "lineitem"), "l_extendedprice")
    return out.select("n", "min", "max", S.rnd(F.col("mean") + 1e-10).alias("mean"), S.rnd("std", 5).alias("std"), *[S.rnd(f"p{d}").alias(f"p{d}") for d in range(10, 100, 10)])


@query(
    "a19_seen_ratio",
    "WITH v AS (SELECT DISTINCT l_partkey AS entity FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45), m AS (SELECT l_orderkey AS mention_id, CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_partkey END AS entity FROM lineitem), "
    "s AS (SELECT mention_id, bool_or(m.entity IS NULL OR v.entity IS NOT NULL) AS seen FROM m LEFT JOIN v USING (entity) GROUP BY 1) SELECT count(*) FILTER (WHERE seen) AS n_seen, count(*) AS n, round(count(*) FILTER (WHERE seen) / count(*), 6) AS ratio FROM s",
)
def a19(spark, sf):
    li = X.base(spark, sf, "lineitem")
    vocab = li.where("l_returnflag = 'R' and l_quantity > 45").select(F.col("l_partkey").alias("entity"))
    mentions = li.select(F.col("l_orderkey").alias("mention_id"), F.when(F.col("l_orderkey") % 7 != 0, F.col("l_partkey")).alias("entity"))
    return M.seen_ratio(mentions, vocab).withColumn("ratio", S.rnd("ratio"))


# --- label sets: types of a supplier's parts (true: sold, predicted: sold in large quantity) --------------------------

_SETS = (
    "tr AS (SELECT DISTINCT l_suppkey AS dataset_id, p_type AS type FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'A' AND l_quantity > 48), "
    "pd AS (SELECT DISTINCT l_suppkey AS dataset_id, p_type AS type FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity > 49)"
)
_MULTI = (
    "b AS (SELECT coalesce(t.type, p.type) AS type, t.type IS NOT NULL AS t, p.type IS NOT NULL AS p FROM {t} t FULL JOIN {p} p ON t.dataset_id = p.dataset_id AND t.type = p.type), "
    "g AS (SELECT type, count(*) FILTER (WHERE t) AS n_true, count(*) FILTER (WHERE p) AS n_pred, count(*) FILTER (WHERE t AND p) AS tp FROM b GROUP BY 1 UNION ALL SELECT 'micro', count(*) FILTER (WHERE t), count(*) FILTER (WHERE p), count(*) FILTER (WHERE t AND p) FROM b) "
    "SELECT type, n_true, n_pred, tp, round(CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0 END, 6) + 0.0 AS precision, round(CASE WHEN n_true > 0 THEN tp / n_true ELSE 0 END, 6) + 0.0 AS recall, round(CASE WHEN n_true + n_pred > 0 THEN 2 * tp / (n_true + n_pred) ELSE 0 END, 6) + 0.0 AS f1 FROM g"
)


def label_sets(spark, sf):
    li, p = X.base(spark, sf, "lineitem"), X.base(spark, sf, "part")
    both = li.join(p, li.l_partkey == p.p_partkey)
    t = both.where("l_returnflag = 'A' and l_quantity > 48").select(F.col("l_suppkey").alias("dataset_id"), F.col("p_type").alias("type")).distinct()
    q = both.where("l_quantity > 49").select(F.col("l_suppkey").alias("dataset_id"), F.col("p_type").alias("type")).distinct()
    return t, q


@query("m8_multilabel_report", f"WITH {_SETS}, {_MULTI.format(t='tr', p='pd')}")
def m8(spark, sf):
    return _rounded(M.multilabel_report(*label_sets(spark, sf)))


@query(
    "m8_labels_within_true_count",
    f"WITH {_SETS}, sc AS (SELECT l_suppkey AS dataset_id, p_type AS type, sum(l_quantity) AS score FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY score DESC, type) AS rank FROM sc), k AS (SELECT dataset_id, count(*) AS k FROM tr GROUP BY 1) "
    "SELECT type, count(*) AS n, round(count(*) FILTER (WHERE rank <= k) / count(*), 6) AS accuracy FROM tr JOIN k USING (dataset_id) LEFT JOIN r USING (dataset_id, type) GROUP BY 1",
)
def m8_within(spark, sf):
    li, p = X.base(spark, sf, "lineitem"), X.base(spark, sf, "part")
    scores = li.join(p, li.l_partkey == p.p_partkey).groupBy(F.col("l_suppkey").alias("dataset_id"), F.col("p_type").alias("type")).agg(F.sum("l_quantity").alias("score"))
    return M.labels_within_true_count(scores, label_sets(spark, sf)[0]).withColumn("accuracy", S.rnd("accuracy"))


_MAPPING = {"STANDARD": ["plain"], "MEDIUM": ["plain", "mid"], "SMALL": ["mid"], "PROMO": ["sale"], "ECONOMY": ["sale"]}
_MAP_SQL = "mp(type, mapped) AS (VALUES " + ", ".join(f"('{t}', '{m}')" for t, ms in _MAPPING.items() for m in ms) + ")"


@query(
    "m9_mapped_report",
    f"WITH {_SETS}, {_MAP_SQL}, t2 AS (SELECT DISTINCT dataset_id, mapped AS type FROM tr JOIN mp USING (type)), p2 AS (SELECT DISTINCT dataset_id, mapped AS type FROM pd JOIN mp USING (type)), {_MULTI.format(t='t2', p='p2')}",
)
def m9(spark, sf):
    mapping = spark.createDataFrame([(t, m) for t, ms in _MAPPING.items() for m in ms], "type string, mapped string")
    return _rounded(M.mapped_report(*label_sets(spark, sf), mapping))


@query(
    "m11_candidate_report",
    "WITH c AS (SELECT DISTINCT l_suppkey AS query_id, l_returnflag AS source, l_partkey AS cand FROM lineitem), t AS (SELECT DISTINCT l_suppkey AS query_id, l_partkey AS cand FROM lineitem WHERE l_quantity > 40) "
    "SELECT source, round(count(t.cand) / (SELECT count(*) FROM t), 6) AS recall, round(count(*) / (SELECT count(DISTINCT query_id) FROM t), 6) AS mean_size FROM c LEFT JOIN t USING (query_id, cand) GROUP BY 1",
)
def m11(spark, sf):
    li = X.base(spark, sf, "lineitem")
    cand = li.select(F.col("l_suppkey").alias("query_id"), F.col("l_returnflag").alias("source"), F.col("l_partkey").alias("cand"))
    targets = li.where("l_quantity > 40").select(F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("cand"))
    out = M.candidate_report(cand, targets)
    return out.select("source", S.rnd("recall").alias("recall"), S.rnd("mean_size").alias("mean_size"))


_WEIGHTS = [0.0, 0.25, 0.5, 0.75, 1.0]


@query(
    "m11_weight_sweep",
    "WITH s AS (SELECT l_suppkey AS query_id, l_partkey AS cand, sum(l_quantity) AS a, 100 * max(l_discount) AS b, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS rel FROM lineitem GROUP BY ALL), "
    "w(w) AS (VALUES (0.0::DOUBLE), (0.25), (0.5), (0.75), (1.0)), r AS (SELECT w, query_id, rel, row_number() OVER (PARTITION BY w, query_id ORDER BY round(w * a + (1 - w) * b, 9) DESC, cand) AS rank FROM s, w), "
    "c AS (SELECT *, sum(rel) OVER (PARTITION BY w, query_id ORDER BY rank) / rank AS pr FROM r), p AS (SELECT w, query_id, coalesce(avg(pr) FILTER (WHERE rel > 0), 0) AS ap FROM c GROUP BY ALL) "
    "SELECT w AS weight, round(avg(ap), 6) AS map FROM p GROUP BY 1",
)
def m11_sweep(spark, sf):
    li = X.base(spark, sf, "lineitem")
    scores = li.groupBy(F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("cand")).agg(F.sum("l_quantity").alias("a"), (100 * F.max("l_discount")).alias("b"))
    targets = li.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("cand"))
    return M.weight_sweep(scores, targets, _WEIGHTS).withColumn("map", S.rnd("map"))


_FACTORS = [0.01, 0.02, 0.05, 0.2]


@query(
    "m13_threshold_sweep",
    f"WITH {SIDES}, {emd_cte('SELECT u, l FROM uu, ll')}, ty AS (SELECT u, l, semantic_type, emd, round(emd, 9) AS d, min(round(emd, 9)) OVER (PARTITION BY u) AS best FROM em JOIN gold ON dataset_id = l), "
    "nl AS (SELECT u, min(emd) AS emd, min(semantic_type) AS label, count(DISTINCT semantic_type) AS k FROM ty WHERE d = best GROUP BY u), "
    "fc(factor) AS (VALUES (0.01::DOUBLE), (0.02), (0.05), (0.2)), "
    "pz AS (SELECT factor, g.semantic_type AS truth, CASE WHEN k = 1 AND (std IS NULL OR emd < factor * std) THEN label END AS pred FROM nl JOIN mom ON mom.dataset_id = u JOIN gold g ON g.dataset_id = u, fc), "
    "cs AS (SELECT DISTINCT factor, truth AS c FROM pz WHERE pred IS NOT NULL UNION SELECT DISTINCT factor, pred FROM pz WHERE pred IS NOT NULL), "
    "ct AS (SELECT cs.factor, c, count(*) FILTER (WHERE truth = c) AS sup, count(*) FILTER (WHERE pred = c) AS prd, count(*) FILTER (WHERE truth = c AND pred = c) AS tp FROM cs JOIN pz ON pz.factor = cs.factor AND pred IS NOT NULL GROUP BY ALL), "
    "mf AS (SELECT factor, avg(2 * tp / (sup + prd)) AS f FROM ct GROUP BY 1) "
    "SELECT factor, round(count(pred) / count(*), 6) + 0.0 AS coverage, round(any_value(f), 6) + 0.0 AS macro_f1 FROM pz LEFT JOIN mf USING (factor) GROUP BY factor",
)
def m13(spark, sf):
    gold, _, u, l = numeric_sides(spark, sf)
    # stored once: the pairs within the widest threshold decide all the smaller ones
    best = E.nearest_within(u, l, gold, max(_FACTORS)).drop("std")
    every = E.moments(u).select("dataset_id", "std").join(best, "dataset_id", "left")
    out = M.threshold_sweep(every, gold, _FACTORS)
    return out.select("factor", S.rnd("coverage").alias("coverage"), S.rnd("macro_f1").alias("macro_f1"))


@query(
    "a17_run_summary",
    f"{_V}, {X.columns_cte()}, runs AS (SELECT 'all' AS run_id, * FROM votes UNION ALL SELECT 'no_pattern', * FROM votes WHERE lf NOT LIKE 'value_pattern%' UNION ALL SELECT 'no_overlap', * FROM votes WHERE lf NOT LIKE 'value_overlap%'), "
    "c AS (SELECT run_id, dataset_id, label, count(*) AS c FROM runs GROUP BY ALL), m AS (SELECT *, max(c) OVER (PARTITION BY run_id, dataset_id) AS m FROM c), "
    "lb AS (SELECT run_id, dataset_id, min(label) AS pred FROM m WHERE c = m GROUP BY ALL HAVING count(*) = 1), pr AS (SELECT run_id, semantic_type AS truth, pred FROM lb JOIN gold USING (dataset_id)), "
    "cs AS (SELECT DISTINCT run_id, truth AS c FROM pr UNION SELECT DISTINCT run_id, pred FROM pr), "
    "ct AS (SELECT cs.run_id, c, count(*) FILTER (WHERE truth = c) AS sup, count(*) FILTER (WHERE pred = c) AS prd, count(*) FILTER (WHERE truth = c AND pred = c) AS tp FROM cs JOIN pr ON pr.run_id = cs.run_id GROUP BY ALL), "
    "rp AS (SELECT run_id, CASE WHEN prd > 0 THEN tp / prd ELSE 0 END AS p, CASE WHEN sup > 0 THEN tp / sup ELSE 0 END AS r, 2 * tp / (sup + prd) AS f, sup FROM ct), "
    "s AS (SELECT run_id, 'macro avg' AS cls, avg(p) AS precision, avg(r) AS recall, avg(f) AS f1, sum(sup)::DOUBLE AS support FROM rp GROUP BY 1 "
    "UNION ALL SELECT run_id, 'weighted avg', sum(p * sup) / sum(sup), sum(r * sup) / sum(sup), sum(f * sup) / sum(sup), sum(sup) FROM rp GROUP BY 1), "
    "lg AS (UNPIVOT s ON precision, recall, f1, support INTO NAME metric VALUE v) "
    "SELECT cls, metric, round(avg(v), 6) + 0.0 AS mean, round(stddev_samp(v), 6) + 0.0 AS std, round(var_samp(v), 6) + 0.0 AS var FROM lg GROUP BY ALL",
)
def a17(spark, sf):
    labels = V.ablation(votes_of(spark, sf), {"all": [], "no_pattern": ["value_pattern"], "no_overlap": ["value_overlap"]})
    data = labels.join(X.gold(spark, sf), "dataset_id").select("run_id", F.col("semantic_type").alias("truth"), F.col("label").alias("pred"))
    out = M.run_summary(M.classification_report(data, False, ("run_id",)))
    return out.select("cls", "metric", *[S.rnd(c).alias(c) for c in ("mean", "std", "var")])
