"""Labeling functions, votes and the flagship report."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import clusters as K
from ..operators import corpus as C
from ..operators import emd as E
from ..operators import joins as J
from ..operators import lfs as L
from ..operators import metrics as M
from ..operators import profile as P
from ..operators import votes as V
from ..operators.values import NUMBER, numeric_histogram, value_table
from ..plans.session import cut
from . import fixtures as X
from .emd_queries import FACTOR, NEAREST, SIDES, emd_cte
from .profile_queries import WORD_TYPES, WORDS_CTE, word_vectors
from .registry import query

LF_TYPES = X.TEXT + ["description", "size"]
DICTIONARY = {
    "segment": ["automobile", "building", "furniture", "machinery"],
    "language": ["en", "fr", "de"],
    "flag": ["a", "n", "r"],
    "status": ["f", "o", "p"],
    "category": ["promo", "standard", "economy"],
}
PATTERNS = {
    "company": [r"customer#\d+", r"supplier#\d+"],
    "payload": [r'\{"k'],
    "flag": ["[anr]$"],
    "description": [r"[^\p{L}\p{N}_]*([\p{L}\p{N}_]+[^\p{L}\p{N}_]+){5}[\p{L}\p{N}_]"],
}
DESCRIPTION_FAST = r"[^\p{L}\p{N}_]*+(?:[\p{L}\p{N}_]++[^\p{L}\p{N}_]++){5}[\p{L}\p{N}_]"


def dictionary(spark):
    return spark.createDataFrame([(t, w) for t, ws in DICTIONARY.items() for w in ws], "sem_type string, element string")


def patterns():
    return {**PATTERNS, "description": [DESCRIPTION_FAST]}


def votes_of(spark, sf):
    """Both functions on one value table, so the corpus is read once."""
    table = cut(value_table(X.cells(spark, sf, LF_TYPES), {**L.OVERLAP_MARKS, **L.pattern_marks(patterns())}))
    return L.overlap_votes(table, dictionary(spark)).unionByName(L.pattern_votes(table, patterns()))


_DICT = "dict(sem_type, element) AS (VALUES " + ", ".join(f"('{t}', '{w}')" for t, ws in DICTIONARY.items() for w in ws) + ")"
_HITS = ", ".join(
    "(" + " + ".join(f"count(*) FILTER (WHERE regexp_matches(value, '(?i)^(?:{p})'))" for p in ps) + f") AS h_{t}" for t, ps in PATTERNS.items()
)
_PAT_ROWS = " UNION ALL ".join(f"SELECT dataset_id, '{t}' AS sem_type, h_{t} AS hits, n FROM ph" for t in PATTERNS)
VOTES = (
    f"{_DICT}, sz AS (SELECT dataset_id, count(*) AS n FROM cells GROUP BY 1), "
    "v1 AS (SELECT dataset_id, sem_type FROM cells JOIN dict ON lower(value) = element JOIN sz USING (dataset_id) GROUP BY dataset_id, sem_type, n "
    "HAVING count(*) >= CASE WHEN 0.2 * n <= 1 THEN 2 ELSE 0.2 * n END), "
    f"ph AS (SELECT dataset_id, count(*) AS n, {_HITS} FROM cells GROUP BY 1), "
    f"v2 AS (SELECT dataset_id, sem_type FROM ({_PAT_ROWS}) WHERE hits >= CASE WHEN floor(0.2 * n) <= 1 THEN 2 ELSE floor(0.2 * n) END), "
    "votes AS (SELECT dataset_id, 'value_overlap:' || sem_type AS lf, sem_type AS label FROM v1 UNION ALL SELECT dataset_id, 'value_pattern:' || sem_type, sem_type FROM v2)"
)
_V = f"WITH {X.cells_cte(LF_TYPES)}, {VOTES}"


@query("l1_lf_value_overlap", f"{_V} SELECT * FROM votes WHERE lf LIKE 'value_overlap%'")
def l1(spark, sf):
    return L.lf_value_overlap(X.cells(spark, sf, LF_TYPES), dictionary(spark))


@query("l2_lf_value_pattern", f"{_V} SELECT * FROM votes WHERE lf LIKE 'value_pattern%'")
def l2(spark, sf):
    return L.lf_value_pattern(X.cells(spark, sf, LF_TYPES), patterns())


def _grams(source, key, text):
    return (
        f"SELECT {key}, dim, count(*)::DOUBLE AS w FROM (SELECT {key}, unnest(list_transform(range(1, length(' ' || {text} || ' ') - 1), lambda i: (' ' || lower({text}) || ' ')[i:i + 2])) AS dim "
        f"FROM {source}) GROUP BY ALL"
    )


def _sims(left, lk, lt, right):
    return (
        f"hv AS ({_grams(left, lk, lt)}), tv AS ({_grams(right, 'semantic_type', 'semantic_type')}), "
        f"hn AS (SELECT {lk}, sqrt(sum(w * w)) AS n FROM hv GROUP BY 1), tn AS (SELECT semantic_type, sqrt(sum(w * w)) AS n FROM tv GROUP BY 1), "
        f"sm AS (SELECT {lk}, semantic_type, sum(hv.w * tv.w) / (any_value(hn.n) * any_value(tn.n)) AS sim FROM hv JOIN tv USING (dim) JOIN hn USING ({lk}) JOIN tn USING (semantic_type) GROUP BY ALL), "
        f"bt AS (SELECT {lk}, first(semantic_type ORDER BY round(sim, 9) DESC, semantic_type) AS semantic_type, max(sim) AS sim FROM sm GROUP BY 1)"
    )


@query(
    "l3_lf_header_similarity",
    f"WITH {X.columns_cte()}, hd AS (SELECT DISTINCT header FROM columns_), ts AS (SELECT DISTINCT semantic_type FROM columns_), {_sims('hd', 'header', 'header', 'ts')} "
    "SELECT dataset_id, 'header_similarity' AS lf, bt.semantic_type AS label, round(sim, 6) + 0.0 AS sim FROM columns_ JOIN bt USING (header) WHERE sim >= 0.6",
)
def l3(spark, sf):
    cols = X.columns(spark, sf)
    return L.lf_header_similarity(cols, cols, 0.6).withColumn("sim", S.rnd("sim"))


@query(
    "t2_best_type",
    f"WITH {X.columns_cte()}, hd AS (SELECT DISTINCT header FROM columns_), ts AS (SELECT DISTINCT semantic_type FROM columns_), {_sims('hd', 'header', 'header', 'ts')} "
    "SELECT header, semantic_type, round(sim, 6) + 0.0 AS sim FROM bt WHERE sim >= 0.3",
)
def t2(spark, sf):
    cols = X.columns(spark, sf)
    hv = L.ngram_vectors(cols.select("header").distinct(), "header", "header")
    tv = L.ngram_vectors(cols.select("semantic_type").distinct(), "semantic_type", "semantic_type")
    return L.best_type(L.sparse_cosine(hv, tv, "header", "semantic_type"), "header", 0.3).withColumn("sim", S.rnd("sim"))


@query(
    "l9_lf_known_labels",
    f"{_V}, mv AS (SELECT dataset_id, label, count(*) AS c FROM votes GROUP BY ALL), {X.columns_cte()}, "
    "g AS (SELECT dataset_id, first(label ORDER BY c DESC, label) AS label, count(*) FILTER (WHERE c = m) AS k FROM (SELECT *, max(c) OVER (PARTITION BY dataset_id) AS m FROM mv) GROUP BY 1) "
    "SELECT dataset_id, 'known_labels' AS lf, label FROM g JOIN columns_ USING (dataset_id) WHERE k = 1",
)
def l9(spark, sf):
    return L.lf_known_labels(X.columns(spark, sf), V.majority_vote(votes_of(spark, sf)))


_KB = (
    "kb AS (SELECT DISTINCT c_mktsegment AS entity, 'segments' AS type FROM customer UNION SELECT p_type, 'category' FROM part UNION SELECT p_name, 'product' FROM part "
    "UNION SELECT p_name, 'goods' FROM part UNION SELECT lang, 'language' FROM documents)"
)


def knowledge_base(spark, sf):
    b = lambda t: X.base(spark, sf, t)
    parts = [
        b("customer").select(F.col("c_mktsegment").alias("entity"), F.lit("segments").alias("type")),
        b("part").select(F.col("p_type").alias("entity"), F.lit("category").alias("type")),
        b("part").select(F.col("p_name").alias("entity"), F.explode(F.array(F.lit("product"), F.lit("goods"))).alias("type")),
        b("documents").select(F.col("lang").alias("entity"), F.lit("language").alias("type")),
    ]
    return J.union_results(parts, distinct=True)


@query(
    "l10_lf_kb_types",
    f"WITH {X.cells_cte(X.TEXT)}, {X.columns_cte()}, {_KB}, k AS (SELECT dataset_id, type, count(*) AS k FROM cells JOIN kb ON value = entity GROUP BY ALL), "
    "f AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY k DESC, type) AS r FROM k), ts AS (SELECT DISTINCT semantic_type FROM columns_), kt AS (SELECT DISTINCT type FROM kb), "
    f"{_sims('kt', 'type', 'type', 'ts')} "
    "SELECT dataset_id, 'kb_types' AS lf, first(bt.semantic_type ORDER BY r) AS label FROM f JOIN bt USING (type) WHERE r <= 3 AND sim >= 0.8 GROUP BY dataset_id",
)
def l10(spark, sf):
    return L.lf_kb_types(X.cells(spark, sf, X.TEXT), knowledge_base(spark, sf), X.columns(spark, sf), least=0.8)


DIM = 64


def column_vectors(spark, sf):
    cells = X.cells(spark, sf, WORD_TYPES)
    return cut(P.column_embedding(cells, cut(word_vectors(spark, sf))))


_EMBED = (
    "wd2 AS (SELECT dataset_id, dim, sum(f * x) / sum(f) AS x FROM pl GROUP BY ALL), ev AS (SELECT dataset_id, list(x ORDER BY dim) AS v FROM wd2 GROUP BY 1)"
)


@query(
    "j14_cosine_pairs",
    f"WITH {X.cells_cte(WORD_TYPES)}, {WORDS_CTE}, {_EMBED} SELECT a.dataset_id AS a, b.dataset_id AS b, round(list_cosine_similarity(a.v, b.v), 6) + 0.0 AS sim FROM ev a JOIN ev b ON a.dataset_id < b.dataset_id "
    "WHERE list_cosine_similarity(a.v, b.v) >= 0.95",
)
def j14(spark, sf):
    return K.cosine_pairs(column_vectors(spark, sf), "dataset_id", "embedding", 0.95).withColumn("sim", S.rnd("sim"))


# one merge at a time: the two clusters of the least mean distance, until it reaches the cut
_LINKAGE = (
    "uv AS (SELECT dataset_id AS id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM ev WHERE list_dot_product(v, v) > 0), "
    "pd AS (SELECT a.id AS a, b.id AS b, 1 - list_dot_product(a.v, b.v) AS d FROM uv a JOIN uv b ON a.id <> b.id), "
    "cl AS (SELECT 0 AS step, id, id AS c FROM uv UNION ALL "
    "SELECT step + 1, id, CASE WHEN c = m.b THEN m.a ELSE c END FROM cl, (SELECT x.c AS a, y.c AS b FROM cl x JOIN cl y ON x.c < y.c JOIN pd ON pd.a = x.id AND pd.b = y.id "
    "GROUP BY ALL HAVING round(avg(d), 12) < 0.1 ORDER BY round(avg(d), 12), a, b LIMIT 1) m), "
    "fc AS (SELECT id, c FROM cl WHERE step = (SELECT max(step) FROM cl)), "
    "tc AS (SELECT c, semantic_type, count(*) AS n FROM fc JOIN gold ON dataset_id = id JOIN splits USING (dataset_id) WHERE split = 'labeled' GROUP BY ALL), "
    "mt AS (SELECT c, first(semantic_type ORDER BY n DESC, semantic_type) AS label FROM tc GROUP BY c)"
)


@query(
    "l8_lf_embedding_cluster",
    f"WITH RECURSIVE {X.cells_cte(WORD_TYPES)}, {WORDS_CTE}, {_EMBED}, {X.columns_cte()}, {X.splits_cte()}, {_LINKAGE} "
    "SELECT id AS dataset_id, 'embedding_cluster' AS lf, label FROM fc JOIN mt USING (c) WHERE id NOT IN (SELECT dataset_id FROM splits WHERE split = 'labeled')",
)
def l8(spark, sf):
    gold = X.gold(spark, sf)
    labeled = C.split_absolute(gold, 3).where("split = 'labeled'")
    known = gold.join(labeled, "dataset_id", "left_semi").select(F.col("dataset_id").alias("id"), "semantic_type")
    return K.lf_embedding_cluster(column_vectors(spark, sf), "dataset_id", "embedding", known, 0.1)


# clusters given by the label of the embeddings, types by the parity of the id
@query(
    "a12_majority_type",
    "WITH c AS (SELECT label AS cluster, CASE WHEN vec_id % 3 = 0 THEN 'x' ELSE 'y' END AS t, count(*) AS n FROM embeddings GROUP BY ALL) "
    "SELECT cluster, first(t ORDER BY n DESC, t) AS semantic_type FROM c GROUP BY 1",
)
def a12(spark, sf):
    e = X.base(spark, sf, "embeddings")
    clusters = e.select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"))
    labeled = e.select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 3 == 0, "x").otherwise("y").alias("semantic_type"))
    return K.majority_type(clusters, labeled)


# --- votes ---------------------------------------------------------------------------------------

MAJORITY = (
    "mc AS (SELECT dataset_id, label, count(*) AS c FROM votes GROUP BY ALL), mm AS (SELECT *, max(c) OVER (PARTITION BY dataset_id) AS m FROM mc), "
    "mv AS (SELECT dataset_id, min(label) AS label FROM mm WHERE c = m GROUP BY 1 HAVING count(*) = 1)"
)


@query("v1_majority_vote", f"{_V}, {MAJORITY} SELECT * FROM mv")
def v1(spark, sf):
    return V.majority_vote(votes_of(spark, sf))


def _em(n_iter, n_classes):
    parts = ["a0 AS (SELECT DISTINCT lf, 0.7::DOUBLE AS a FROM votes)"]
    for i in range(n_iter):
        parts.append(f"s{i} AS (SELECT dataset_id, label, sum(ln(a * {n_classes - 1} / (1 - a))) AS s FROM votes JOIN a{i} USING (lf) GROUP BY ALL)")
        parts.append(
            f"p{i} AS (SELECT dataset_id, label, exp(s) / (sum(exp(s)) OVER (PARTITION BY dataset_id) + {n_classes} - count(*) OVER (PARTITION BY dataset_id)) AS p FROM s{i})"
        )
        parts.append(f"a{i + 1} AS (SELECT lf, least(greatest(avg(p), 0.01), 0.99) AS a FROM votes JOIN p{i} USING (dataset_id, label) GROUP BY 1)")
    return ", ".join(parts)


@query(
    "v2_label_model",
    f"{_V}, {_em(3, 19)} SELECT dataset_id, label, round(p, 6) + 0.0 AS p FROM p2",
)
def v2(spark, sf):
    return V.label_model(votes_of(spark, sf), 19, 3).withColumn("p", S.rnd("p"))


@query(
    "v3_lf_analysis",
    f"{_V}, {X.columns_cte()}, n AS (SELECT count(*) AS n FROM columns_), pc AS (SELECT dataset_id, count(DISTINCT lf) AS nl, count(DISTINCT label) AS nn FROM votes GROUP BY 1) "
    "SELECT lf, count(DISTINCT label) AS polarity, round(count(DISTINCT dataset_id) / any_value(n), 6) AS coverage, round(count(*) FILTER (WHERE nl > 1) / any_value(n), 6) AS overlaps, "
    "round(count(*) FILTER (WHERE nn > 1) / any_value(n), 6) AS conflicts, count(*) FILTER (WHERE label = semantic_type) AS correct, count(*) FILTER (WHERE label <> semantic_type) AS incorrect, "
    "round(count(*) FILTER (WHERE label = semantic_type) / count(*), 6) AS accuracy FROM votes JOIN pc USING (dataset_id) JOIN gold USING (dataset_id), n GROUP BY lf",
)
def v3(spark, sf):
    gold = X.gold(spark, sf)
    out = V.lf_analysis(votes_of(spark, sf), gold, gold.count())
    return out.withColumns({c: S.rnd(c) for c in ("coverage", "overlaps", "conflicts", "accuracy")})


@query(
    "v4_generated_training_data",
    f"{_V}, {MAJORITY}, {X.columns_cte()}, {X.splits_cte()} SELECT table_id, col_idx, dataset_id, label AS predicted_semantic_type FROM mv JOIN splits USING (dataset_id) JOIN gold USING (dataset_id) WHERE split = 'unlabeled'",
)
def v4(spark, sf):
    return V.generated_training_data(V.majority_vote(votes_of(spark, sf)), C.split_absolute(X.gold(spark, sf), 3))


@query(
    "v5_run_grid",
    f"WITH {X.columns_cte()}, "
    + ", ".join(
        f"r{i} AS (WITH {X.splits_cte(k, 0.2, s)} SELECT {i} AS run_id, dataset_id, semantic_type, split FROM gold JOIN splits USING (dataset_id))"
        for i, (k, s) in enumerate([(k, s) for k in (1, 2) for s in (1, 2)])
    )
    + " SELECT * FROM r0 UNION ALL SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3",
)
def v5(spark, sf):
    return V.split_grid(X.gold(spark, sf), [{"k": k, "seed": s, "test": 0.2} for k in (1, 2) for s in (1, 2)])


@query(
    "v6_ablation",
    f"{_V}, runs AS (SELECT 'all' AS run_id, * FROM votes UNION ALL SELECT 'no_pattern', * FROM votes WHERE lf NOT LIKE 'value_pattern%' UNION ALL SELECT 'no_overlap', * FROM votes WHERE lf NOT LIKE 'value_overlap%'), "
    "c AS (SELECT run_id, dataset_id, label, count(*) AS c FROM runs GROUP BY ALL), m AS (SELECT *, max(c) OVER (PARTITION BY run_id, dataset_id) AS m FROM c) "
    "SELECT run_id, dataset_id, min(label) AS label FROM m WHERE c = m GROUP BY ALL HAVING count(*) = 1",
)
def v6(spark, sf):
    return V.ablation(votes_of(spark, sf), {"all": [], "no_pattern": ["value_pattern"], "no_overlap": ["value_overlap"]})


# the runs that differ in what a generated label does to a known one; "no_steering" trains on known labels alone
@query(
    "v6_no_overwrite",
    f"{_V}, {MAJORITY}, {X.columns_cte()}, {X.splits_cte()}, l AS (SELECT dataset_id, semantic_type FROM gold JOIN splits USING (dataset_id) WHERE split = 'labeled'), "
    "b AS (SELECT dataset_id, semantic_type, label FROM l FULL JOIN mv USING (dataset_id)), "
    "r AS (SELECT 'overwrite' AS run_id, dataset_id, coalesce(label, semantic_type) AS label FROM b UNION ALL SELECT 'no_overwrite', dataset_id, coalesce(semantic_type, label) FROM b "
    "UNION ALL SELECT 'no_steering', dataset_id, semantic_type FROM b) SELECT * FROM r WHERE label IS NOT NULL",
)
def v6_keep(spark, sf):
    gold = X.gold(spark, sf)
    labeled = J.in_split(gold, C.split_absolute(gold, 3), "labeled")
    return V.label_runs(labeled, V.majority_vote(votes_of(spark, sf)))


@query(
    "v7_same_size_sample",
    f"{_V}, {MAJORITY}, {X.columns_cte()} SELECT dataset_id, semantic_type FROM (SELECT *, row_number() OVER (ORDER BY md5('8|' || dataset_id), dataset_id) AS p FROM gold) WHERE p <= (SELECT count(*) FROM mv)",
)
def v7(spark, sf):
    return V.same_size_sample(X.gold(spark, sf), V.majority_vote(votes_of(spark, sf)), 8)


@query(
    "j15_override_labels",
    f"{_V}, {MAJORITY}, {X.columns_cte()}, {X.splits_cte()}, l AS (SELECT dataset_id, semantic_type FROM gold JOIN splits USING (dataset_id) WHERE split = 'labeled') "
    "SELECT dataset_id, coalesce(mv.label, semantic_type) AS label, mv.label IS NOT NULL AS generated FROM l FULL JOIN mv USING (dataset_id)",
)
def j15(spark, sf):
    gold = X.gold(spark, sf)
    labeled = J.in_split(gold, C.split_absolute(gold, 3), "labeled")
    return J.override_labels(labeled, V.majority_vote(votes_of(spark, sf)))


_LFS = [f"value_overlap:{t}" for t in DICTIONARY] + [f"value_pattern:{t}" for t in PATTERNS]


@query(
    "j17_align_votes",
    f"{_V} SELECT dataset_id, " + ", ".join(f"min(label) FILTER (WHERE lf = '{lf}') AS {lf.replace(':', '_')}" for lf in _LFS) + " FROM votes GROUP BY 1",
)
def j17(spark, sf):
    wide = J.align_votes(votes_of(spark, sf), _LFS)
    return wide.select("dataset_id", *[F.col(f"`{lf}`").alias(lf.replace(":", "_")) for lf in _LFS])


# --- flagship ------------------------------------------------------------------------------------

_FLAG_TYPES = LF_TYPES + [t for t in X.NUMERIC if t not in LF_TYPES]
_FLAG_VOTES = (
    f"{VOTES}, nv AS (SELECT u AS dataset_id, semantic_type AS label FROM nl JOIN mom ON dataset_id = u WHERE n_types = 1 AND (std IS NULL OR emd < {FACTOR} * std)), "
    "av AS (SELECT dataset_id, label FROM votes UNION ALL SELECT dataset_id, label FROM nv), "
    "mc AS (SELECT dataset_id, label, count(*) AS c FROM av GROUP BY ALL), mm AS (SELECT *, max(c) OVER (PARTITION BY dataset_id) AS m FROM mc), "
    "mv AS (SELECT dataset_id, min(label) AS label FROM mm WHERE c = m GROUP BY 1 HAVING count(*) = 1)"
)
REPORT = (
    "ct AS (SELECT c AS cls, count(*) FILTER (WHERE truth = c) AS sup, count(*) FILTER (WHERE pred = c) AS prd, count(*) FILTER (WHERE truth = c AND pred = c) AS tp "
    "FROM tp0, (SELECT DISTINCT truth AS c FROM tp0 UNION SELECT DISTINCT pred FROM tp0) GROUP BY 1), "
    "rp AS (SELECT cls, CASE WHEN prd > 0 THEN tp / prd ELSE 0 END AS precision, CASE WHEN sup > 0 THEN tp / sup ELSE 0 END AS recall, CASE WHEN sup + prd > 0 THEN 2 * tp / (sup + prd) ELSE 0 END AS f1, sup AS support, tp FROM ct), "
    "ra AS (SELECT cls, precision, recall, f1, support FROM rp UNION ALL SELECT 'accuracy', sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support), sum(support) FROM rp "
    "UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM rp "
    "UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM rp), "
    "rr AS (SELECT cls, round(precision, 6) + 0.0 AS precision, round(recall, 6) + 0.0 AS recall, round(f1, 6) + 0.0 AS f1, support::BIGINT AS support FROM ra)"
)


@query(
    "flagship_label_report",
    f"WITH {X.cells_cte(_FLAG_TYPES)}, num AS (SELECT dataset_id, TRY_CAST(value AS DOUBLE) AS x FROM cells WHERE TRY_CAST(value AS DOUBLE) IS NOT NULL), "
    "hist AS (SELECT dataset_id, x, count(*) AS cnt FROM num GROUP BY ALL), "
    + SIDES.split("GROUP BY ALL), ", 1)[1]
    + f", {emd_cte('SELECT u, l FROM uu, ll')}, {NEAREST}, {_FLAG_VOTES}, "
    "tp0 AS (SELECT semantic_type AS truth, coalesce(mv.label, 'abstain') AS pred FROM gold JOIN splits USING (dataset_id) LEFT JOIN mv USING (dataset_id) WHERE split = 'unlabeled'), "
    f"{REPORT} SELECT * FROM rr",
)
def flagship(spark, sf):
    gold = X.gold(spark, sf)
    splits = cut(C.split_absolute(gold, 3))
    table = cut(value_table(X.cells(spark, sf, _FLAG_TYPES), {**NUMBER, **L.OVERLAP_MARKS, **L.pattern_marks(patterns())}))
    hist = cut(numeric_histogram(table))
    unlabeled, labeled = (cut(J.in_split(hist, splits, side)) for side in ("unlabeled", "labeled"))
    numeric = cut(E.lf_numeric_emd(unlabeled, labeled, gold, FACTOR))
    votes = J.union_results(
        [
            L.overlap_votes(table, dictionary(spark)),
            L.pattern_votes(table, patterns()),
            numeric.select("dataset_id", F.lit("numeric_emd").alias("lf"), "label"),
        ]
    )
    labels = V.majority_vote(votes)
    judged = cut(J.in_split(gold, splits, "unlabeled").join(labels, "dataset_id", "left"))  # the report reads it several times
    report = M.classification_report(judged.select(F.col("semantic_type").alias("truth"), F.col("label").alias("pred")))
    return report.select("cls", *[S.rnd(c).alias(c) for c in ("precision", "recall", "f1")], "support")
