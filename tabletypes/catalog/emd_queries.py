"""Earth mover's distance and tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import corpus as C
from ..operators import emd as E
from ..operators import stats as T
from ..plans.session import cut
from . import fixtures as X
from .profile_queries import hist
from .registry import query

FACTOR = 0.05
_NUM = ", ".join(f"'{t}'" for t in X.NUMERIC)
_TXT = ", ".join(f"'{t}'" for t in X.TEXT)


def numeric_sides(spark, sf, k=3):
    """Histograms of unlabeled and labeled numeric columns and the gold types."""
    gold = X.gold(spark, sf)
    splits = cut(C.split_absolute(gold, k))
    h = cut(hist(spark, sf))
    u = h.join(splits.where("split = 'unlabeled'"), "dataset_id", "left_semi")
    l = h.join(splits.where("split = 'labeled'"), "dataset_id", "left_semi")
    return gold, splits, u, l


SIDES = (
    f"{X.hist_cte()}, {X.columns_cte()}, {X.splits_cte()}, "
    "tot AS (SELECT dataset_id, sum(cnt) AS n FROM hist GROUP BY 1), sh AS (SELECT dataset_id, x, cnt / n AS w FROM hist JOIN tot USING (dataset_id)), "
    "uu AS (SELECT DISTINCT dataset_id AS u FROM hist JOIN splits USING (dataset_id) WHERE split = 'unlabeled'), "
    "ll AS (SELECT DISTINCT dataset_id AS l FROM hist JOIN splits USING (dataset_id) WHERE split = 'labeled'), "
    "mom AS (SELECT dataset_id, avg(x) AS mean, stddev_samp(x) AS std FROM num GROUP BY 1)"
)


def emd_cte(pairs: str) -> str:
    return (
        f"pr AS ({pairs}), wt AS (SELECT u, l, x, w FROM pr JOIN sh ON dataset_id = u UNION ALL SELECT u, l, x, -w FROM pr JOIN sh ON dataset_id = l), "
        "nt AS (SELECT u, l, x, sum(w) AS w FROM wt GROUP BY ALL), "
        "st AS (SELECT u, l, abs(sum(w) OVER o) * coalesce(lead(x) OVER o - x, 0) AS a FROM nt WINDOW o AS (PARTITION BY u, l ORDER BY x)), "
        "em AS (SELECT u, l, sum(a) AS emd FROM st GROUP BY ALL)"
    )


NEAREST = (
    "ty AS (SELECT u, l, semantic_type, emd, round(emd, 9) AS d, min(round(emd, 9)) OVER (PARTITION BY u) AS best FROM em JOIN gold ON dataset_id = l), "
    "nl AS (SELECT u, min(emd) AS emd, min(l) AS l, min(semantic_type) AS semantic_type, count(DISTINCT semantic_type) AS n_types FROM ty WHERE d = best GROUP BY u)"
)


def vote_sql(factor=FACTOR):
    return (
        f"SELECT u AS dataset_id, semantic_type AS label, round(emd, 6) + 0.0 AS emd FROM nl JOIN mom ON dataset_id = u WHERE n_types = 1 AND (std IS NULL OR emd < {factor} * std)"
    )


# the SQL side compares all pairs; the Spark side only those that can pass, so agreement also checks the pruning
@query("l4_numeric_emd", f"WITH {SIDES}, {emd_cte('SELECT u, l FROM uu, ll')}, {NEAREST} {vote_sql()}")
def l4(spark, sf):
    gold, _, u, l = numeric_sides(spark, sf)
    return E.lf_numeric_emd(u, l, gold, FACTOR).withColumn("emd", S.rnd("emd"))


@query("j11_cross_compare", f"WITH {SIDES}, {emd_cte('SELECT u, l FROM uu, ll')} SELECT u, l, round(ln(1 + emd), 6) + 0.0 AS log_emd FROM em")
def j11(spark, sf):
    _, _, u, l = numeric_sides(spark, sf)
    # distances reach from 0 to 100 000; their logarithms agree to as many digits for all
    return E.cross_compare(u, l).select("u", "l", S.rnd(F.log1p("emd")).alias("log_emd"))


_SAME = (
    "SELECT a.dataset_id AS u, b.dataset_id AS l FROM gold a JOIN gold b USING (semantic_type) WHERE semantic_type IN ('quantity', 'discount', 'tax') AND a.dataset_id < b.dataset_id"
)


@query("w3_emd", f"WITH {SIDES}, {emd_cte(_SAME)} SELECT u, l, round(emd, 9) + 0.0 AS emd FROM em")
def w3(spark, sf):
    """Distances between the columns of one type, without sampling or pruning."""
    few = X.gold(spark, sf).where("semantic_type IN ('quantity', 'discount', 'tax')").select("dataset_id", "semantic_type")
    pairs = few.withColumnRenamed("dataset_id", "u").join(few.withColumnRenamed("dataset_id", "l"), "semantic_type").where("u < l")
    h = cut(hist(spark, sf))
    return E.emd_of_pairs(cut(pairs.select("u", "l")), h, h).withColumn("emd", S.rnd("emd", 9))


@query("t1_nearest_labeled", f"WITH {SIDES}, {emd_cte('SELECT u, l FROM uu, ll')}, {NEAREST} SELECT u, l, semantic_type, round(emd, 6) + 0.0 AS emd, n_types FROM nl")
def t1(spark, sf):
    gold, _, u, l = numeric_sides(spark, sf)
    return E.nearest(cut(u), cut(l), gold).withColumn("emd", S.rnd("emd"))


def kinds(gold):
    kind = F.when(F.col("semantic_type").isin(X.NUMERIC), "numeric").when(F.col("semantic_type").isin(X.TEXT), "text")
    return gold.withColumn("kind", kind).where("kind is not null")


_LAB = (
    f"kd AS (SELECT gold.*, split, CASE WHEN semantic_type IN ({_NUM}) THEN 'numeric' ELSE 'text' END AS kind FROM gold JOIN splits USING (dataset_id) "
    f"WHERE semantic_type IN ({_NUM}, {_TXT})), lab AS (SELECT * FROM kd WHERE split = 'labeled'), "
    "tx AS (SELECT DISTINCT table_id, semantic_type FROM lab WHERE kind = 'text'), "
    "al AS (SELECT table_id FROM lab GROUP BY 1 HAVING count(*) FILTER (WHERE kind = 'numeric') > 0 AND count(*) FILTER (WHERE kind = 'text') = 0)"
)
_PR0 = (
    "SELECT DISTINCT a.dataset_id AS u, b.dataset_id AS l FROM kd a JOIN tx ta ON a.table_id = ta.table_id JOIN tx tb ON ta.semantic_type = tb.semantic_type "
    "JOIN lab b ON b.table_id = tb.table_id WHERE a.split = 'unlabeled' AND a.kind = 'numeric' AND b.kind = 'numeric' AND a.table_id <> b.table_id"
)
_PR1 = _PR0 + " UNION SELECT a.dataset_id, b.dataset_id FROM kd a, lab b WHERE a.split = 'unlabeled' AND a.kind = 'numeric' AND b.kind = 'numeric' AND b.table_id IN (SELECT table_id FROM al)"


def _pruned(spark, sf, mode):
    gold, splits, u, l = numeric_sides(spark, sf)
    tagged = kinds(gold).join(splits, "dataset_id")
    mine, theirs = tagged.where("split = 'unlabeled' and kind = 'numeric'"), tagged.where("split = 'labeled'").drop("split")
    return E.lf_numeric_emd_pruned(u, l, gold, FACTOR, mine.select("dataset_id", "table_id"), theirs, mode).withColumn("emd", S.rnd("emd"))


@query("l5_numeric_emd_pruned_0", f"WITH {SIDES}, {_LAB}, {emd_cte(_PR0)}, {NEAREST} {vote_sql()}")
def l5_0(spark, sf):
    return _pruned(spark, sf, 0)


@query("l5_numeric_emd_pruned_1", f"WITH {SIDES}, {_LAB}, {emd_cte(_PR1)}, {NEAREST} {vote_sql()}")
def l5_1(spark, sf):
    return _pruned(spark, sf, 1)


@query(
    "j9_related_tables",
    f"WITH {X.columns_cte()}, {X.splits_cte()}, {_LAB} SELECT a.table_id AS t1, b.table_id AS t2, count(*) AS shared FROM tx a JOIN tx b USING (semantic_type) "
    "WHERE a.table_id <> b.table_id GROUP BY ALL",
)
def j9(spark, sf):
    gold = X.gold(spark, sf)
    lab = kinds(gold).join(C.split_absolute(gold, 3).where("split = 'labeled'"), "dataset_id", "left_semi")
    return E.related_tables(lab.where("kind = 'text'"))


@query("j10_tables_without_text_labels", f"WITH {X.columns_cte()}, {X.splits_cte()}, {_LAB} SELECT table_id FROM al")
def j10(spark, sf):
    gold = X.gold(spark, sf)
    lab = kinds(gold).join(C.split_absolute(gold, 3).where("split = 'labeled'"), "dataset_id", "left_semi")
    return E.tables_without_text(lab)


# --- two tables joined over their shared string column (the nation's name) ------------------------

ATTRS = ["acctbal", "key"]


def two_tables(spark, sf):
    nation = X.base(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("nation"))
    customer = X.base(spark, sf, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("acctbal"), F.col("c_custkey").cast("double").alias("key"))
    supplier = X.base(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_acctbal").alias("acctbal"), F.col("s_suppkey").cast("double").alias("key"))
    named = F.broadcast(nation)  # one row per nation
    return customer.join(named, "k").drop("k"), supplier.join(named, "k").drop("k")


_TWO = (
    "o AS (SELECT n_name AS nation, c_acctbal AS acctbal, c_custkey::DOUBLE AS key FROM customer JOIN nation ON n_nationkey = c_nationkey), "
    "i AS (SELECT n_name AS nation, s_acctbal AS acctbal, s_suppkey::DOUBLE AS key FROM supplier JOIN nation ON n_nationkey = s_nationkey), "
    "j AS (SELECT o.nation, o.acctbal AS oa, o.key AS ok, i.acctbal AS ia, i.key AS ik FROM o JOIN i USING (nation))"
)


def _two_emd(source_o: str, source_i: str, group: str = "''") -> str:
    """EMD of (o attribute, i attribute) from long rows (g, attr, x)."""
    return (
        f"lo AS ({source_o}), li AS ({source_i}), "
        "so AS (SELECT g, attr, x, count(*) / sum(count(*)) OVER (PARTITION BY g, attr) AS w FROM lo GROUP BY g, attr, x), "
        "si AS (SELECT g, attr, x, count(*) / sum(count(*)) OVER (PARTITION BY g, attr) AS w FROM li GROUP BY g, attr, x), "
        "ao AS (SELECT DISTINCT attr FROM lo), ai AS (SELECT DISTINCT attr FROM li), "
        "wt AS (SELECT g, so.attr AS o_attr, ai.attr AS i_attr, x, w FROM so, ai UNION ALL SELECT g, ao.attr, si.attr, x, -w FROM si, ao), "
        "nt AS (SELECT g, o_attr, i_attr, x, sum(w) AS w FROM wt GROUP BY ALL), "
        "st AS (SELECT g, o_attr, i_attr, abs(sum(w) OVER z) * coalesce(lead(x) OVER z - x, 0) AS a FROM nt WINDOW z AS (PARTITION BY g, o_attr, i_attr ORDER BY x)), "
        "em AS (SELECT g, o_attr, i_attr, sum(a) AS emd FROM st GROUP BY ALL)"
    )


_RAW = ("SELECT '' AS g, 'acctbal' AS attr, acctbal AS x FROM {t} UNION ALL SELECT '', 'key', key FROM {t}")
_JO = "SELECT {g} AS g, 'acctbal' AS attr, oa AS x FROM {t} UNION ALL SELECT {g}, 'key', ok FROM {t}"
_JI = "SELECT {g} AS g, 'acctbal' AS attr, ia AS x FROM {t} UNION ALL SELECT {g}, 'key', ik FROM {t}"


@query("l6_emd_no_join", f"WITH {_TWO}, {_two_emd(_RAW.format(t='o'), _RAW.format(t='i'))} SELECT o_attr, i_attr, round(emd, 6) + 0.0 AS emd FROM em")
def l6_raw(spark, sf):
    o, i = two_tables(spark, sf)
    return E.emd_no_join(o, i, ATTRS, ATTRS).withColumn("emd", S.rnd("emd"))


_NOG = "''"


@query("l6_emd_joined", f"WITH {_TWO}, {_two_emd(_JO.format(g=_NOG, t='j'), _JI.format(g=_NOG, t='j'))} SELECT o_attr, i_attr, round(emd, 6) + 0.0 AS emd FROM em")
def l6_joined(spark, sf):
    o, i = two_tables(spark, sf)
    return E.emd_joined(o, i, ["nation"], ATTRS).withColumn("emd", S.rnd("emd"))


_B = "b AS (SELECT * FROM j WHERE nation IN (SELECT nation FROM j GROUP BY 1 HAVING count(*) <= 250))"


@query(
    "l6_emd_bounded",
    f"WITH {_TWO}, {_B}, {_two_emd(_JO.format(g=_NOG, t='b'), _JI.format(g=_NOG, t='b'))} SELECT o_attr, i_attr, round(emd, 6) + 0.0 AS emd FROM em",
)
def l6_bounded(spark, sf):
    o, i = two_tables(spark, sf)
    return E.emd_joined(o, i, ["nation"], ATTRS, 250).withColumn("emd", S.rnd("emd"))


_GROUPED = f"WITH {_TWO}, {_B}, {{body}} SELECT o_attr, i_attr, count(*) AS n_groups, round({{agg}}(emd), 6) + 0.0 AS emd FROM em GROUP BY ALL"
_GJ = _two_emd(_JO.format(g="nation", t="j"), _JI.format(g="nation", t="j"))
_GB = _two_emd(_JO.format(g="nation", t="b"), _JI.format(g="nation", t="b"))


@query("a15_emd_group_mean", _GROUPED.format(body=_GB, agg="avg"))
def a15(spark, sf):
    o, i = two_tables(spark, sf)
    return E.group_emd(o, i, ["nation"], ATTRS, "mean", 250).withColumn("emd", S.rnd("emd"))


@query("h4_group_emd_median", _GROUPED.format(body=_GJ, agg="median"))
def h4_median(spark, sf):
    o, i = two_tables(spark, sf)
    return E.group_emd(o, i, ["nation"], ATTRS, "median").withColumn("emd", S.rnd("emd"))


@query("h4_group_emd_min", _GROUPED.format(body=_GJ, agg="min"))
def h4_min(spark, sf):
    o, i = two_tables(spark, sf)
    return E.group_emd(o, i, ["nation"], ATTRS, "min").withColumn("emd", S.rnd("emd"))


# --- tests -----------------------------------------------------------------------------------------


@query(
    "w4_mid_rank",
    f"WITH {X.hist_cte()} SELECT dataset_id, x, cnt, (sum(cnt) OVER (PARTITION BY dataset_id ORDER BY x) - cnt + (cnt + 1) / 2)::DOUBLE AS mid_rank FROM hist",
)
def w4(spark, sf):
    return T.mid_ranks(hist(spark, sf), ["dataset_id"])


def samples(spark, sf):
    """Numeric line item attributes grouped by the text attributes of the same row."""
    li = X.base(spark, sf, "lineitem")
    return li.selectExpr(
        "stack(2, 'l_quantity', l_quantity, 'l_discount', l_discount) as (attr, x)", "l_returnflag", "l_linestatus", "l_linenumber"
    ).selectExpr("attr", "x", "stack(3, 'returnflag', l_returnflag, 'linestatus', l_linestatus, 'linenumber', cast(l_linenumber as string)) as (text_col, grp)")


_SAMPLES = "s AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS attr, {a} AS x, '{t}' AS text_col, l_{t}::VARCHAR AS grp FROM lineitem" for a in ("l_quantity", "l_discount") for t in ("returnflag", "linestatus", "linenumber")
) + ")"


@query(
    "h1_kruskal_wallis",
    f"WITH {_SAMPLES}, r AS (SELECT attr, text_col, grp, rank() OVER (PARTITION BY attr, text_col ORDER BY x) + (count(*) OVER (PARTITION BY attr, text_col, x) - 1) / 2 AS r FROM s), "
    "g AS (SELECT attr, text_col, grp, sum(r) AS r, count(*)::DOUBLE AS n FROM r GROUP BY ALL), "
    "t AS (SELECT attr, text_col, sum(c ** 3 - c) AS ties FROM (SELECT attr, text_col, x, count(*)::DOUBLE AS c FROM s GROUP BY ALL) GROUP BY ALL), "
    "a AS (SELECT attr, text_col, sum(n) AS n, count(*) AS k, sum(r * r / n) AS rr FROM g GROUP BY ALL) "
    "SELECT attr, text_col, k - 1 AS df, n::BIGINT AS n, round((12 / (n * (n + 1)) * rr - 3 * (n + 1)) / (1 - ties / (n ** 3 - n)), 4) + 0.0 AS h FROM a JOIN t USING (attr, text_col)",
)
def h1(spark, sf):
    out = T.kruskal_wallis(samples(spark, sf), ["attr", "text_col"], "grp")
    return out.select("attr", "text_col", "df", "n", S.rnd("h", 4).alias("h"))


@query(
    "h2_anova_oneway",
    f"WITH {_SAMPLES}, g AS (SELECT attr, text_col, grp, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM s GROUP BY ALL), "
    "z AS (SELECT attr, text_col, avg(x) AS gm FROM s GROUP BY ALL) "
    "SELECT attr, text_col, count(*) AS k, sum(n)::BIGINT AS n, round((sum(n * (m - gm) ** 2) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))), 6) + 0.0 AS f FROM g JOIN z USING (attr, text_col) GROUP BY ALL",
)
def h2(spark, sf):
    return T.anova(samples(spark, sf), ["attr", "text_col"], "grp").withColumn("f", S.rnd("f"))


def _sides(spark, sf):
    o, i = two_tables(spark, sf)
    return E.attribute_values(o, ATTRS, []), E.attribute_values(i, ATTRS, [])


@query(
    "h3_rank_pairs_emd",
    f"WITH {_TWO}, {_two_emd(_RAW.format(t='o'), _RAW.format(t='i'))} SELECT o_attr AS a, i_attr AS b, round(emd, 6) + 0.0 AS score FROM em",
)
def h3_emd(spark, sf):
    return T.rank_column_pairs(*_sides(spark, sf), "emd").withColumn("score", S.rnd("score")).orderBy("score")


_PAIRED = (
    f"lo AS ({_RAW.format(t='o')}), li AS ({_RAW.format(t='i')}), "
    "p AS (SELECT lo.attr AS a, bb.attr AS b, 'a' AS side, x FROM lo, (SELECT DISTINCT attr FROM li) bb UNION ALL "
    "SELECT aa.attr, li.attr, 'b', x FROM li, (SELECT DISTINCT attr FROM lo) aa)"
)


@query(
    "h3_rank_pairs_kruskal",
    f"WITH {_TWO}, {_PAIRED}, r AS (SELECT a, b, side, rank() OVER (PARTITION BY a, b ORDER BY x) + (count(*) OVER (PARTITION BY a, b, x) - 1) / 2 AS r FROM p), "
    "g AS (SELECT a, b, side, sum(r) AS r, count(*)::DOUBLE AS n FROM r GROUP BY ALL), "
    "t AS (SELECT a, b, sum(c ** 3 - c) AS ties FROM (SELECT a, b, x, count(*)::DOUBLE AS c FROM p GROUP BY ALL) GROUP BY ALL), "
    "q AS (SELECT a, b, sum(n) AS n, sum(r * r / n) AS rr FROM g GROUP BY ALL) "
    "SELECT a, b, round((12 / (n * (n + 1)) * rr - 3 * (n + 1)) / (1 - ties / (n ** 3 - n)), 4) + 0.0 AS score FROM q JOIN t USING (a, b)",
)
def h3_kruskal(spark, sf):
    return T.rank_column_pairs(*_sides(spark, sf), "kruskal").withColumn("score", S.rnd("score", 4)).orderBy("score")


@query(
    "h3_rank_pairs_anova",
    f"WITH {_TWO}, {_PAIRED}, g AS (SELECT a, b, side, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM p GROUP BY ALL), z AS (SELECT a, b, avg(x) AS gm FROM p GROUP BY ALL) "
    "SELECT a, b, round(sum(n * (m - gm) ** 2) / (sum(n * v) / (sum(n) - 2)), 4) + 0.0 AS score FROM g JOIN z USING (a, b) GROUP BY ALL",
)
def h3_anova(spark, sf):
    return T.rank_column_pairs(*_sides(spark, sf), "anova").withColumn("score", S.rnd("score", 4)).orderBy(F.desc("score"))


@query("l7_lf_group_emd_correlated")
def l7(spark, sf):
    gold = X.gold(spark, sf)
    splits = cut(C.split_absolute(gold, 8))
    tagged = kinds(gold).join(splits, "dataset_id")
    out = E.lf_group_emd_correlated(
        X.cells(spark, sf, X.NUMERIC + X.TEXT),
        tagged.where("split = 'unlabeled' and kind = 'numeric'"),
        tagged.where("split = 'labeled'").drop("split"),
        alpha=0.5,  # the given columns hardly go together, a strict level would leave no column
    )
    return out.withColumn("emd", S.rnd("emd"))
