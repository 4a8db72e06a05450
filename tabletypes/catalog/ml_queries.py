"""Models; what is iterative or random in them is checked by the tests, their inputs and shapes by SQL."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import corpus as C
from ..operators import ml as ML
from ..operators import prep as D
from ..operators import profile as P
from ..operators import types as Y
from ..operators import votes as VO
from ..plans.session import cut
from . import fixtures as X
from .registry import query

FEATURES = ["col_entropy", "frac_unique", "frac_numcells", "frac_textcells", "avg_num_cells", "std_num_cells", "avg_text_cells", "std_text_cells", "avg_spec_cells", "std_spec_cells", "avg_word_cells", "std_word_cells"]
_TYPES = X.NUMERIC + X.TEXT + ["date"]


def long_features(spark, sf):
    stats = P.text_stats(X.cells(spark, sf, _TYPES))
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in FEATURES])
    long = stats.select("dataset_id", F.inline(rows))
    return long.withColumn("table_id", S.parse_column_id("dataset_id")[0])


_STAT = (
    f"WITH {X.cells_cte(_TYPES)}, p AS (SELECT dataset_id, value, count(*) AS f FROM cells GROUP BY ALL), q AS (SELECT *, sum(f) OVER (PARTITION BY dataset_id) AS n FROM p) "
    "SELECT dataset_id, round(-sum(f / n * log2(f / n)), 6) + 0.0 AS entropy, -1.0::DOUBLE AS missing, 4 AS n_topics, 1.0::DOUBLE AS topic_sum, dataset_id[1:6] <> 'events' AS has_topic FROM q GROUP BY 1"
)


@query("d5_feature_matrix", _STAT)
def d5(spark, sf):
    _, topics = _topics(spark, sf)
    known = topics.where("table_id NOT LIKE 'events%'")  # tables without a topic get the uniform one
    m = D.feature_matrix(long_features(spark, sf), ["col_entropy", "not_a_feature"], cut(known), 4)
    even = F.forall("topic", lambda x: F.abs(x - 0.25) < 1e-12)
    return m.select(
        "dataset_id", S.rnd(F.col("features")[0]).alias("entropy"), F.col("features")[1].alias("missing"), F.size("topic").alias("n_topics"),
        F.round(F.aggregate("topic", F.lit(0.0), lambda a, x: a + x), 6).alias("topic_sum"), (~even).alias("has_topic"),
    )


_TERM_TYPES = X.TEXT + ["size", "description"]


def _topics(spark, sf, k=4):
    terms = cut(ML.table_terms(X.cells(spark, sf, _TERM_TYPES), 20, ["the"]))
    return ML.topic_model(terms, k, 5)


_BAG = (
    f"{X.cells_cte(_TERM_TYPES)}, vt AS (SELECT table_id, CASE WHEN TRY_CAST(value AS DOUBLE) IS NOT NULL THEN 'float64' ELSE value END AS v, count(*) AS c FROM cells WHERE value IS NOT NULL GROUP BY ALL), "
    "tt AS (SELECT table_id, c, unnest(CASE WHEN length(v) > 20 THEN list_append(list_filter(string_split_regex(translate(lower(v), '''.:,/()-+', '         '), '\\s+'), lambda t: t NOT IN ('', 'the')), 'longstr') ELSE [lower(v)] END) AS term FROM vt), "
    "bag AS (SELECT table_id, term, sum(c) AS tf FROM tt GROUP BY ALL)"
)


@query("k1_count_vectors", f"WITH {_BAG} SELECT table_id, count(*) AS n_terms, sum(tf)::DOUBLE AS n_tokens, (SELECT count(DISTINCT term) FROM bag) AS size FROM bag GROUP BY 1")
def k1_vectors(spark, sf):
    terms = cut(ML.table_terms(X.cells(spark, sf, _TERM_TYPES), 20, ["the"]))
    dense = ML.count_vectors(terms).select("table_id", vector_to_array("features").alias("v"))
    some = F.filter("v", lambda x: x != 0)
    return dense.select("table_id", F.size(some).cast("long").alias("n_terms"), F.aggregate(some, F.lit(0.0), lambda a, x: a + x).alias("n_tokens"), F.size("v").cast("long").alias("size"))


# a model is not repeatable in SQL; that every table has each topic once and shares that add up is
@query("k1_table_topics", f"WITH {_BAG} SELECT table_id, 4::BIGINT AS n_topics, 1.0::DOUBLE AS total, true AS valid FROM bag GROUP BY 1")
def k1(spark, sf):
    _, topics = _topics(spark, sf)
    shares = topics.select("table_id", F.posexplode("topic").alias("topic", "share"))
    return shares.groupBy("table_id").agg(F.count_distinct("topic").alias("n_topics"), F.round(F.sum("share"), 6).alias("total"), (F.min("share") >= 0).alias("valid"))


@query("k2_topic_clusters")
def k2(spark, sf):
    _, topics = _topics(spark, sf)
    clusters = cut(ML.topic_clusters(cut(topics), 5))
    return Y.type_overlap_per_cluster(clusters, X.gold(spark, sf)).withColumn("overlap", S.rnd("overlap"))


# --- header vectors: co-occurrence counts, their factorisation, nearest headers ---------------------


def table_headers(spark, sf):
    return X.columns(spark, sf).select("table_id", "col_idx", "header")


_PAIRS = "hp AS (SELECT a.header AS h1, b.header AS h2, count(DISTINCT table_id) AS n FROM columns_ a JOIN columns_ b USING (table_id) WHERE a.header <> b.header GROUP BY ALL)"


@query("k3_header_pairs", f"WITH {X.columns_cte()}, {_PAIRS} SELECT h1, h2, n FROM hp")
def k3_pairs(spark, sf):
    return ML.header_pairs(table_headers(spark, sf))


@query(
    "k3_shifted_information",
    f"WITH {X.columns_cte()}, {_PAIRS}, o AS (SELECT h1 AS h, sum(n) AS c FROM hp GROUP BY 1) "
    "SELECT h1, h2, round(ln(n * (SELECT sum(n) FROM hp) / (a.c * b.c)), 6) AS w FROM hp JOIN o a ON a.h = h1 JOIN o b ON b.h = h2 WHERE n * (SELECT sum(n) FROM hp) > a.c * b.c",
)
def k3_information(spark, sf):
    return ML.shifted_information(ML.header_pairs(table_headers(spark, sf))).withColumn("w", S.rnd("w"))


def _header_vectors(spark, sf):
    heads = table_headers(spark, sf)
    return cut(heads), cut(ML.header_vectors(ML.shifted_information(ML.header_pairs(heads)), 8))


# vectors are not repeatable in SQL; which headers stand with another, and so have one, is
@query("k3_word_vectors", f"WITH {X.columns_cte()}, {_PAIRS}, o AS (SELECT h1 AS h, sum(n) AS c FROM hp GROUP BY 1) SELECT DISTINCT h1 AS word, true AS has_vector FROM hp JOIN o a ON a.h = h1 JOIN o b ON b.h = h2 WHERE n * (SELECT sum(n) FROM hp) > a.c * b.c")
def k3(spark, sf):
    _, vectors = _header_vectors(spark, sf)
    return vectors.select(F.col("h").alias("word"), (F.size("v") > 0).alias("has_vector"))


@query("k3_nearest_headers")
def k3_nearest(spark, sf):
    heads, vectors = _header_vectors(spark, sf)
    return ML.nearest_headers(vectors, heads.select(F.col("header").alias("seed")), 10).withColumn("sim", S.rnd("sim", 4))


@query("k3_header_map")
def k3_map(spark, sf):
    from ..operators.metrics import mean_measures, ranking_measures

    heads, vectors = _header_vectors(spark, sf)
    means = mean_measures(ranking_measures(ML.header_retrieval(vectors, heads, 1000)))
    return means.select(*[S.rnd(c, 4).alias(c) for c in means.columns])


# --- column classifiers -----------------------------------------------------------------------------


def _matrix(spark, sf):
    place = S.parse_column_id("dataset_id")[1].alias("col_idx")
    return cut(D.feature_matrix(long_features(spark, sf), FEATURES).select("dataset_id", "table_id", place, "features"))


def _classifier(spark, sf):
    gold = X.gold(spark, sf)
    splits = cut(C.split_absolute(gold, 5))
    matrix = _matrix(spark, sf)
    labeled = gold.join(splits.where("split = 'labeled'"), "dataset_id", "left_semi").select("dataset_id", F.col("semantic_type").alias("label"))
    return gold, splits, matrix, ML.train_column_classifier(matrix, labeled)


@query("k4_train_column_classifier")
def k4(spark, sf):
    from ..operators.metrics import classification_report

    gold, splits, matrix, model = _classifier(spark, sf)
    test = splits.where("split = 'test'")
    judged = ML.predict_types(model, matrix.drop("table_id", "col_idx")).join(test, "dataset_id", "left_semi").join(gold, "dataset_id")
    report = classification_report(judged.select(F.col("semantic_type").alias("truth"), "pred"))
    return report.select("cls", *[S.rnd(c).alias(c) for c in ("precision", "recall", "f1")], "support")


GRID = [{"k": k, "seed": s, "test": 0.2} for k in (1, 2, 3, 4) for s in (1, 2)]


def _grid(spark, sf):
    """Splits and training sets of all set-ups; the generated labels are the majority votes of the labeling functions."""
    from .label_queries import votes_of

    splits = cut(VO.split_grid(X.gold(spark, sf), GRID))
    votes = cut(VO.majority_vote(votes_of(spark, sf)))
    # what a set-up may not see: the labels of its test columns
    generated = splits.where("split <> 'test'").select("run_id", "dataset_id").join(votes, "dataset_id").select("run_id", "dataset_id", "label")
    return splits, cut(ML.training_sets(splits.where("split = 'labeled'"), generated))


def _grid_sql():
    from .label_queries import _V, MAJORITY

    runs = ", ".join(
        f"r{i} AS (WITH {X.splits_cte(g['k'], 0.2, g['seed'])} SELECT {i} AS run_id, dataset_id, semantic_type, split FROM gold JOIN splits USING (dataset_id))" for i, g in enumerate(GRID)
    )
    union = " UNION ALL ".join(f"SELECT * FROM r{i}" for i in range(len(GRID)))
    return (
        f"{_V}, {MAJORITY}, {X.columns_cte()}, {runs}, al AS ({union}), b AS (SELECT run_id, dataset_id, CASE WHEN split = 'labeled' THEN semantic_type END AS gold, label FROM al LEFT JOIN mv USING (dataset_id) WHERE split <> 'test'), "
        "t AS (SELECT run_id, 'labeled' AS variant, dataset_id, gold AS label, gold FROM b UNION ALL SELECT run_id, 'overwrite', dataset_id, coalesce(label, gold), gold FROM b UNION ALL SELECT run_id, 'keep_gold', dataset_id, coalesce(gold, label), gold FROM b) "
        "SELECT run_id, variant, label, count(*) AS n FROM t WHERE label IS NOT NULL GROUP BY ALL"
    )


@query("k4_training_sets", _grid_sql())
def k4_sets(spark, sf):
    _, sets = _grid(spark, sf)
    return sets.groupBy("run_id", "variant", "label").agg(F.count(F.lit(1)).alias("n"))


@query("k4_retraining_grid")
def k4_grid(spark, sf):
    """Macro and weighted F1 on the test columns of every set-up, trained on known labels alone, and with the generated ones in either order."""
    from ..operators.metrics import classification_report

    splits, sets = _grid(spark, sf)
    matrix = _matrix(spark, sf)
    test = splits.where("split = 'test'")
    models = cut(ML.fit_grid(sets, matrix))
    judged = ML.predict_grid(models, test, matrix).join(test.select(F.col("run_id").cast("int"), "dataset_id", F.col("semantic_type").alias("truth")), ["run_id", "dataset_id"])
    report = classification_report(judged.select("run_id", "variant", "truth", "pred"), True, ("run_id", "variant")).where("cls in ('macro avg', 'weighted avg')")
    sizes = F.array(*[F.struct(F.lit(i).alias("run_id"), F.lit(g["k"]).alias("k"), F.lit(g["seed"]).alias("seed")) for i, g in enumerate(GRID)])
    runs = report.withColumn("r", F.element_at(sizes, F.col("run_id") + 1))
    return runs.select(F.col("r.k").alias("k"), F.col("r.seed").alias("seed"), "variant", "cls", S.rnd("f1", 4).alias("f1"))


@query("m12_permutation_importance")
def m12(spark, sf):
    """On tables without any labeled column."""
    gold, splits, matrix, model = _classifier(spark, sf)
    seen = gold.join(splits.where("split = 'labeled'"), "dataset_id", "left_semi").select("table_id").distinct()
    held_out = cut(matrix.join(seen, "table_id", "left_anti").select(*matrix.columns))
    groups = {"value": [0, 1, 2, 3], "numbers": [4, 5], "letters": [6, 7], "other": [8, 9, 10, 11]}
    return ML.permutation_importance(model, held_out, gold, groups, [1, 2]).withColumn("loss_pct", S.rnd("loss_pct", 4))
