"""Quality measures of labels, rankings, sets and models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordered import HOT_ROWS, position, running, top


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def confusion_matrix(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*keys, "truth", "pred").agg(F.count(F.lit(1)).alias("n"))


def confusion_rates(cm: DataFrame) -> DataFrame:
    total = cm.groupBy("truth").agg(F.sum("n").alias("__t"))
    return cm.join(total, "truth").select("truth", "pred", (F.col("n") / F.col("__t")).alias("rate"))


def classification_report(df: DataFrame, keep_abstain: bool = True, keys: tuple[str, ...] = ()) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted averages as rows.

    ``df(truth, pred)``; a NULL prediction is an abstain: a class of its own (``abstain``) or left out.
    All figures come from the confusion counts, whose size depends on the classes alone.
    """
    data = df.withColumn("pred", F.coalesce("pred", F.lit("abstain"))) if keep_abstain else df.where(F.col("pred").isNotNull())
    cm = confusion_matrix(data, keys)
    sides = cm.select(*keys, F.col("truth").alias("cls"), F.col("n").alias("sup"), F.lit(0).cast("long").alias("prd"), F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"))
    sides = sides.unionByName(cm.select(*keys, F.col("pred").alias("cls"), F.lit(0).cast("long").alias("sup"), F.col("n").alias("prd"), F.lit(0).cast("long").alias("tp")))
    per = sides.groupBy(*keys, "cls").agg(F.sum("sup").alias("support"), F.sum("prd").alias("predicted"), F.sum("tp").alias("tp"))
    p, r = _ratio(F.col("tp"), F.col("predicted")), _ratio(F.col("tp"), F.col("support"))
    rows = per.select(
        *keys, "cls", p.alias("precision"), r.alias("recall"),
        _ratio(2.0 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1"), "support", "tp",
    )
    measures = ("precision", "recall", "f1")
    weighted = [(F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(f"w_{m}") for m in measures]
    summary = rows.groupBy(*keys).agg(
        *[F.avg(m).alias(f"m_{m}") for m in measures], *weighted, F.sum("support").alias("support"), (F.sum("tp") / F.sum("support")).alias("acc")
    )
    lines = F.array(
        F.struct(F.lit("accuracy").alias("cls"), *[F.col("acc").alias(m) for m in measures]),
        F.struct(F.lit("macro avg").alias("cls"), *[F.col(f"m_{m}").alias(m) for m in measures]),
        F.struct(F.lit("weighted avg").alias("cls"), *[F.col(f"w_{m}").alias(m) for m in measures]),
    )
    totals = summary.select(*keys, F.inline(lines), "support")
    cols = [*keys, "cls", *measures, "support"]
    return rows.select(*cols).unionByName(totals.select(*cols))


def label_set_stats(df: DataFrame, n_columns: int | Column | None = None) -> DataFrame:
    """Number of types predicted and present, predicted types that never occur in the gold, coverage."""
    predicted = df.where(F.col("pred").isNotNull()).select(F.col("pred").alias("t")).distinct()
    present = df.select(F.col("truth").alias("t")).distinct()
    never = predicted.join(present, "t", "left_anti")
    base = df.agg(F.count(F.lit(1)).alias("n"), F.count("pred").alias("labeled"), F.count_distinct("pred").alias("n_predicted"), F.count_distinct("truth").alias("n_present"))
    spare = never.agg(F.count(F.lit(1)).alias("n_never_present"))
    return base.crossJoin(spare).select("n_predicted", "n_present", "n_never_present", (F.col("labeled") / F.col("n")).alias("coverage"))  # one row each


def multi_view_accuracy(scores: DataFrame, gold: DataFrame) -> DataFrame:
    """Mean score over the views of a column, best type, share correct; ``scores(dataset_id, view, type, score)``."""
    mean = scores.groupBy("dataset_id", "type").agg(F.avg("score").alias("s"))
    s = F.round("s", 9)
    best = mean.groupBy("dataset_id").agg(F.max(F.struct(s.alias("s"), F.col("type").alias("type"))).alias("m"))
    joined = best.select("dataset_id", F.col("m.type").alias("pred")).join(gold, "dataset_id")
    return joined.agg(F.count(F.lit(1)).alias("n"), (F.count_if(F.col("pred") == F.col("semantic_type")) / F.count(F.lit(1))).alias("accuracy"))


def top_confusions(cm: DataFrame, n: int = 5) -> DataFrame:
    """Per type the most frequent wrong predictions (``mis_to``) and wrong sources (``mis_from``)."""
    wrong = cm.where("truth <> pred")
    to = top(wrong.select(F.col("truth").alias("cls"), F.col("pred").alias("other"), "n"), ["cls"], [F.desc("n"), F.col("other")], n)
    source = top(wrong.select(F.col("pred").alias("cls"), F.col("truth").alias("other"), "n"), ["cls"], [F.desc("n"), F.col("other")], n)
    return to.withColumn("direction", F.lit("mis_to")).unionByName(source.withColumn("direction", F.lit("mis_from")))


def compare_models(a: DataFrame, b: DataFrame) -> DataFrame:
    """F1 of two reports per class with the difference and the gain in percent."""
    x = a.select("cls", F.col("f1").alias("f1_a"))
    y = b.select("cls", F.col("f1").alias("f1_b"))
    gain = F.when(F.col("f1_a") > 0, 100 * (F.col("f1_b") - F.col("f1_a")) / F.col("f1_a"))
    return x.join(y, "cls", "full_outer").select("cls", "f1_a", "f1_b", (F.col("f1_b") - F.col("f1_a")).alias("diff"), gain.alias("gain_pct"))


def best_worst_types(comparison: DataFrame, n: int) -> DataFrame:
    """The ``n`` classes that gain most and those that lose most."""
    d = F.round("diff", 9)
    best = comparison.orderBy(F.desc(d), "cls").limit(n).withColumn("side", F.lit("best"))
    worst = comparison.orderBy(d, "cls").limit(n).withColumn("side", F.lit("worst"))
    return best.unionByName(worst).select("side", "cls", "diff")


def method_table(reports: DataFrame, variants: list[str]) -> DataFrame:
    """Method by variant table of the summary lines; ``reports(method, variant, cls, f1)``."""
    return reports.where(F.col("cls").isin("macro avg", "weighted avg")).groupBy("method", "cls").pivot("variant", variants).agg(F.first("f1"))


# --- rankings: (query_id, cand, rank from 1, rel) ---------------------------------------------------


def rank_by_score(scored: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rank from 1 by falling score; equal scores in the order of the candidates."""
    neg = scored.withColumn("__neg", -F.col("score"))
    return position(neg, ["query_id"], ["__neg", "cand"], "rank", hot_rows).drop("__neg")


def cumulative_precision(ranking: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    hits = running(ranking, ["query_id"], ["rank"], {"__h": (F.col("rel") > 0).cast("long")}, hot_rows=hot_rows)
    return hits.withColumn("precision", F.col("__h") / F.col("rank")).drop("__h")


def ranking_measures(ranking: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10), hot_rows: int = HOT_ROWS) -> DataFrame:
    """Per query: reciprocal rank, R-precision, average precision (both 0 without a relevant one), precision at k.

    R-precision here is the share of relevant ones down to the last relevant one.
    """
    cp = cumulative_precision(ranking, hot_rows)
    hit = F.col("rel") > 0
    return cp.groupBy("query_id").agg(
        F.coalesce(F.max(F.when(hit, 1.0 / F.col("rank"))), F.lit(0.0)).alias("rr"),
        F.coalesce(F.count_if(hit) / F.max(F.when(hit, F.col("rank"))), F.lit(0.0)).alias("r_precision"),
        F.coalesce(F.avg(F.when(hit, F.col("precision"))), F.lit(0.0)).alias("ap"),
        *[(F.count_if(hit & (F.col("rank") <= k)) / k).alias(f"p_at_{k}") for k in ks],
        F.count(F.lit(1)).alias("size"),
    )


def mean_measures(per_query: DataFrame) -> DataFrame:
    """MRR, mean R-precision and MAP over the queries."""
    return per_query.agg(F.avg("rr").alias("mrr"), F.avg("r_precision").alias("r_precision"), F.avg("ap").alias("map"))


def ndcg(ranking: DataFrame, k: int, method: int = 0) -> DataFrame:
    """DCG and NDCG at ``k``. Method 0 weighs ranks 1 and 2 by one and rank r by 1/log2(r); method 1 by 1/log2(r + 1)."""
    if method not in (0, 1):
        raise ValueError("method must be 0 or 1")

    def gain(rank, rel):
        if method == 0:
            return F.when(rank == 1, rel).otherwise(rel / F.log2(F.greatest(rank, F.lit(2)).cast("double")))
        return rel / F.log2(rank.cast("double") + 1)

    actual = ranking.where(F.col("rank") <= k).groupBy("query_id").agg(F.sum(gain(F.col("rank"), F.col("rel").cast("double"))).alias("dcg"))
    ideal = top(ranking, ["query_id"], [F.desc("rel"), F.col("rank")], k, "best").groupBy("query_id").agg(
        F.sum(gain(F.col("best"), F.col("rel").cast("double"))).alias("idcg")
    )
    return actual.join(ideal, "query_id").select("query_id", "dcg", _ratio(F.col("dcg"), F.col("idcg")).alias("ndcg"))


def accuracy_at(ranking: DataFrame, ks: tuple[int, ...] = (1, 5)) -> DataFrame:
    """Share of queries whose relevant candidate is within the first k, and the mean rank of it."""
    first = ranking.groupBy("query_id").agg(F.min(F.when(F.col("rel") > 0, F.col("rank"))).alias("r"))
    n = F.count(F.lit(1))
    return first.agg(*[(F.count_if(F.col("r") <= k) / n).alias(f"acc_at_{k}") for k in ks], F.avg("r").alias("mean_rank"))


def gold_rank(candidates: DataFrame, gold: DataFrame, absent: int = 999) -> DataFrame:
    """Rank of the gold candidate per query; ``absent`` where it is not in the list."""
    hit = candidates.join(gold, ["query_id", "cand"]).select("query_id", "rank")
    return gold.join(hit, "query_id", "left").select("query_id", F.coalesce("rank", F.lit(absent)).cast("long").alias("gold_rank"))


def describe_ranks(values: DataFrame, x: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """count, min, max, mean, std and the deciles 10..90 of a column of numbers."""
    from ..plans.ordered import weighted_quantiles

    hist = values.where(F.col(x).isNotNull()).select(F.col(x).cast("double").alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("cnt"))
    hist = hist.withColumn("all", F.lit(0))
    deciles = weighted_quantiles(hist, ["all"], "x", "cnt", {f"p{d}": d / 100 for d in range(10, 100, 10)}, hot_rows)
    base = values.agg(
        F.count(x).alias("n"), F.min(x).cast("double").alias("min"), F.max(x).cast("double").alias("max"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std")
    ).withColumn("all", F.lit(0))
    return base.join(deciles, "all").drop("all")


def seen_ratio(mentions: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Share of mentions with an entity known in training; a mention without entities counts as seen.

    ``mentions(mention_id, entity)`` with a NULL entity for an empty list.
    """
    known = vocabulary.select("entity", F.lit(True).alias("k")).distinct()
    per = mentions.join(known, "entity", "left").groupBy("mention_id").agg(
        F.max(F.coalesce("k", F.lit(False)) | F.col("entity").isNull()).alias("seen")
    )
    return per.agg(F.count_if("seen").alias("n_seen"), F.count(F.lit(1)).alias("n"), (F.count_if("seen") / F.count(F.lit(1))).alias("ratio"))


# --- label sets ------------------------------------------------------------------------------------


def multilabel_report(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """Micro precision, recall and F1 of label sets, and the same per type; both ``(dataset_id, type)``."""
    t = truth.select("dataset_id", "type", F.lit(1).alias("t")).distinct()
    p = pred.select("dataset_id", "type", F.lit(1).alias("p")).distinct()
    both = t.join(p, ["dataset_id", "type"], "full_outer")
    counts = [F.count("t").alias("n_true"), F.count("p").alias("n_pred"), F.count_if(F.col("t").isNotNull() & F.col("p").isNotNull()).alias("tp")]
    per = both.groupBy("type").agg(*counts)
    micro = per.agg(*[F.sum(c).alias(c) for c in ("n_true", "n_pred", "tp")]).select(F.lit("micro").alias("type"), "n_true", "n_pred", "tp")
    out = per.unionByName(micro)
    return out.select(
        "type", "n_true", "n_pred", "tp",
        _ratio(F.col("tp"), F.col("n_pred")).alias("precision"), _ratio(F.col("tp"), F.col("n_true")).alias("recall"),
        _ratio(2.0 * F.col("tp"), F.col("n_pred") + F.col("n_true")).alias("f1"),
    )


def labels_within_true_count(scores: DataFrame, truth: DataFrame) -> DataFrame:
    """Per type the share of its true columns where it ranks among as many types as the column has.

    ``scores(dataset_id, type, score)``; a column has a bounded number of scored types (the vocabulary).
    """
    w = Window.partitionBy("dataset_id").orderBy(F.desc("score"), "type")
    ranked = scores.withColumn("rank", F.row_number().over(w))
    size = truth.groupBy("dataset_id").agg(F.count_distinct("type").alias("k"))
    hits = truth.join(size, "dataset_id").join(ranked.select("dataset_id", "type", "rank"), ["dataset_id", "type"], "left")
    return hits.groupBy("type").agg(F.count(F.lit(1)).alias("n"), (F.count_if(F.col("rank") <= F.col("k")) / F.count(F.lit(1))).alias("accuracy"))


def mapped_report(truth: DataFrame, pred: DataFrame, mapping: DataFrame) -> DataFrame:
    """The label-set report after both sides are translated by ``mapping(type, mapped)``; unmapped types drop out."""
    m = mapping.select("type", "mapped").distinct()

    def translate(df):
        return df.join(m, "type").select("dataset_id", F.col("mapped").alias("type")).distinct()

    return multilabel_report(translate(truth), translate(pred))


def linking_report(df: DataFrame) -> DataFrame:
    """Entity linking quality; ``df(gold, first, in_list, lookup, score, lookup_score)``.

    ``first`` is the model's best candidate and ``lookup`` the look-up's. The fallback takes the
    look-up unless 0.8 times the model's score beats the look-up's score. Oracle: gold in the list.
    """
    fallback = F.when(F.col("lookup").isNull() | (0.8 * F.col("score") > F.col("lookup_score")), F.col("first")).otherwise(F.col("lookup"))
    wide = df.withColumn("fallback", fallback).withColumn("oracle", F.when(F.col("in_list"), F.col("gold")))
    answers = F.array(*[F.struct(F.lit(m).alias("method"), F.col(c).alias("answer")) for m, c in (("model", "first"), ("lookup", "lookup"), ("fallback", "fallback"), ("oracle", "oracle"))])
    long = wide.select("gold", F.inline(answers))
    g = long.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.count("answer").alias("answered"), F.count_if(F.col("answer") == F.col("gold")).alias("tp"))
    return g.select(
        "method", _ratio(F.col("tp"), F.col("answered")).alias("precision"), _ratio(F.col("tp"), F.col("n")).alias("recall"),
        _ratio(2.0 * F.col("tp"), F.col("answered") + F.col("n")).alias("f1"),
    )


def candidate_report(candidates: DataFrame, targets: DataFrame) -> DataFrame:
    """Recall and mean size of the candidates by source; ``candidates(query_id, source, cand)``."""
    c = candidates.select("query_id", "source", "cand").distinct()
    t = targets.select("query_id", "cand").distinct()
    n_t = t.agg(F.count(F.lit(1)).alias("n_targets"))
    n_q = t.agg(F.count_distinct("query_id").alias("n_queries"))
    hits = c.join(t.withColumn("hit", F.lit(1)), ["query_id", "cand"], "left").groupBy("source").agg(F.count("hit").alias("found"), F.count(F.lit(1)).alias("size"))
    both = hits.crossJoin(n_t).crossJoin(n_q)  # one row each
    return both.select("source", (F.col("found") / F.col("n_targets")).alias("recall"), (F.col("size") / F.col("n_queries")).alias("mean_size"))


def weight_sweep(scores: DataFrame, targets: DataFrame, weights: list[float], hot_rows: int = HOT_ROWS) -> DataFrame:
    """MAP of ``w * a + (1 - w) * b`` for each weight; ``scores(query_id, cand, a, b)``."""
    mixes = F.array(*[F.struct(F.lit(w).alias("weight"), (F.lit(w) * F.col("a") + F.lit(1 - w) * F.col("b")).alias("score")) for w in weights])
    rel = targets.select("query_id", "cand", F.lit(1).alias("rel")).distinct()
    long = scores.join(rel, ["query_id", "cand"], "left").select("query_id", "cand", F.coalesce("rel", F.lit(0)).alias("rel"), F.inline(mixes))
    keyed = long.withColumn("query_id", F.struct("weight", "query_id")).withColumn("score", F.round("score", 9))
    per = ranking_measures(rank_by_score(keyed, hot_rows), (1,), hot_rows)
    return per.groupBy(F.col("query_id.weight").alias("weight")).agg(F.avg("ap").alias("map"))


def threshold_sweep(nearest: DataFrame, gold: DataFrame, factors: list[float]) -> DataFrame:
    """Coverage and macro F1 of stored nearest distances under each threshold factor.

    ``nearest(dataset_id, label, emd, std, n_types)``.
    """
    steps = F.array(*[F.struct(F.lit(f).alias("factor"), F.when((F.col("n_types") == 1) & (F.col("std").isNull() | (F.round("emd", 9) < F.round(f * F.col("std"), 9))), F.col("label")).alias("pred")) for f in factors])
    long = nearest.join(gold.select("dataset_id", F.col("semantic_type").alias("truth")), "dataset_id").select("truth", F.inline(steps))
    cover = long.groupBy("factor").agg((F.count("pred") / F.count(F.lit(1))).alias("coverage"))
    report = classification_report(long, False, ("factor",)).where("cls = 'macro avg'").select("factor", F.col("f1").alias("macro_f1"))
    return cover.join(report, "factor", "left")


def run_summary(reports: DataFrame) -> DataFrame:
    """Mean, deviation and variance over the runs; ``reports(run_id, cls, precision, recall, f1, support)``."""
    measures = ("precision", "recall", "f1", "support")
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in measures])
    long = reports.where(F.col("cls").isin("macro avg", "weighted avg")).select("cls", F.inline(rows))
    return long.groupBy("cls", "metric").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.var_samp("v").alias("var"))


def label_distribution(labels: DataFrame) -> DataFrame:
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def columns_per_table(labels: DataFrame) -> DataFrame:
    """Number of tables with labels, their labels, and the mean per table; ``labels(table_id, ...)``."""
    per = labels.groupBy("table_id").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("n_tables"), F.sum("n").alias("n_labels"), F.avg("n").alias("mean_per_table"))
