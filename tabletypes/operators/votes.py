"""Combination of votes (dataset_id, lf, label) and diagnostics of labeling functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..plans.ordered import position
from ..plans.session import cut


def majority_vote(votes: DataFrame, keys: tuple[str, ...] = ("dataset_id",)) -> DataFrame:
    """Most voted label per column; a tie at the top abstains."""
    counted = votes.where(F.col("label").isNotNull()).groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n"))
    top = counted.groupBy(*keys).agg(F.max("n").alias("n"))
    at = counted.join(top, [*keys, "n"]).groupBy(*keys).agg(F.min("label").alias("label"), F.count(F.lit(1)).alias("k"))
    return at.where("k = 1").select(*keys, "label")


def label_model(votes: DataFrame, n_classes: int, n_iter: int = 5, start: float = 0.7) -> DataFrame:
    """Posterior of each voted label from labeling-function accuracies learnt without gold.

    Every function is right with one unknown probability, otherwise any other class is equally likely.
    Columns with the same votes share a posterior, so the rounds run over distinct vote patterns.
    """
    packed = votes.groupBy("dataset_id").agg(F.array_sort(F.collect_set(F.struct("lf", "label"))).alias("pattern"))
    packed = packed.withColumn("pid", F.md5(F.to_json("pattern")))
    patterns = cut(packed.groupBy("pid").agg(F.count(F.lit(1)).alias("c"), F.first("pattern").alias("pattern")).select("pid", "c", F.inline("pattern")))
    low, high = F.lit(0.01), F.lit(0.99)
    acc = patterns.select("lf").distinct().withColumn("a", F.lit(start))
    post = None
    for _ in range(n_iter):
        weight = F.log(F.col("a") * (n_classes - 1) / (1 - F.col("a")))
        scores = patterns.join(acc, "lf").groupBy("pid", "label").agg(F.sum(weight).alias("s"))
        w = F.sum(F.exp("s")).over(Window.partitionBy("pid"))  # as many rows as labels voted for one pattern
        seen = F.count(F.lit(1)).over(Window.partitionBy("pid"))
        post = cut(scores.select("pid", "label", (F.exp("s") / (w + n_classes - seen)).alias("p")))
        acc = cut(
            patterns.join(post, ["pid", "label"])
            .groupBy("lf")
            .agg((F.sum(F.col("c") * F.col("p")) / F.sum("c")).alias("a"))
            .withColumn("a", F.least(F.greatest("a", low), high))
        )
    return packed.select("dataset_id", "pid").join(post, "pid").select("dataset_id", "label", "p")


def label_model_vote(posterior: DataFrame) -> DataFrame:
    """Most probable label; a tie abstains."""
    p = F.round("p", 9)
    best = posterior.groupBy("dataset_id").agg(F.max(p).alias("b"))
    at = posterior.join(best, "dataset_id").where(p == F.col("b")).groupBy("dataset_id").agg(
        F.min("label").alias("label"), F.count(F.lit(1)).alias("k"), F.max("p").alias("p")
    )
    return at.where("k = 1").select("dataset_id", "label", "p")


def lf_analysis(votes: DataFrame, gold: DataFrame, n_columns: int) -> DataFrame:
    """Per labeling function: polarity, coverage, overlaps, conflicts, correct, incorrect, accuracy.

    Other votes of a column are summarised per column instead of pairing the votes.
    """
    per_column = votes.groupBy("dataset_id").agg(F.count_distinct("lf").alias("n_lf"), F.count_distinct("label").alias("n_label"))
    v = votes.join(per_column, "dataset_id").join(gold.select("dataset_id", "semantic_type"), "dataset_id", "left")
    right = F.count_if(F.col("label") == F.col("semantic_type"))
    wrong = F.count_if(F.col("label") != F.col("semantic_type"))
    return v.groupBy("lf").agg(
        F.count_distinct("label").alias("polarity"),
        (F.count_distinct("dataset_id") / n_columns).alias("coverage"),
        (F.count_if(F.col("n_lf") > 1) / n_columns).alias("overlaps"),
        (F.count_if(F.col("n_label") > 1) / n_columns).alias("conflicts"),
        right.alias("correct"),
        wrong.alias("incorrect"),
        (right / F.nullif(right + wrong, F.lit(0))).alias("accuracy"),
    )


def generated_training_data(labels: DataFrame, splits: DataFrame, split: str = "unlabeled") -> DataFrame:
    """Labels of the unlabeled columns with the parts of the column id."""
    table, idx = S.parse_column_id("dataset_id")
    kept = labels.where(F.col("label").isNotNull()).join(splits.where(F.col("split") == split), "dataset_id", "left_semi")
    return kept.select(table.alias("table_id"), idx.alias("col_idx"), "dataset_id", F.col("label").alias("predicted_semantic_type"))


def ablation(votes: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """Majority vote of each run, where a run leaves out the labeling functions starting with its prefixes."""
    dropped = F.array(
        *[
            F.struct(
                F.lit(run).alias("run_id"),
                F.when(F.lit(bool(prefixes)), F.exists(F.array(*[F.lit(p) for p in (prefixes or [""])]), lambda p: F.startswith("lf", p)))
                .otherwise(F.lit(False))
                .alias("out"),
            )
            for run, prefixes in groups.items()
        ]
    )
    runs = votes.select("dataset_id", "lf", "label", F.inline(dropped)).where("not out")
    return majority_vote(runs, ("run_id", "dataset_id"))


def label_runs(labeled: DataFrame, generated: DataFrame) -> DataFrame:
    """(run_id, dataset_id, label) of three runs: generated labels replace known ones (``overwrite``), only fill what is not known (``no_overwrite``), or are left out
    (``no_steering``). ``labeled(dataset_id, semantic_type)``; ``generated(dataset_id, label)``."""
    both = labeled.select("dataset_id", "semantic_type").join(generated.select("dataset_id", "label"), "dataset_id", "full")
    runs = {"overwrite": F.coalesce("label", "semantic_type"), "no_overwrite": F.coalesce("semantic_type", "label"), "no_steering": F.col("semantic_type")}
    each = F.array(*[F.struct(F.lit(run).alias("run_id"), label.alias("run_label")) for run, label in runs.items()])
    return both.withColumn("each", each).select("dataset_id", F.inline("each")).where("run_label IS NOT NULL").select("run_id", "dataset_id", F.col("run_label").alias("label"))


def same_size_sample(gold: DataFrame, generated: DataFrame, seed: int = 0) -> DataFrame:
    """Gold labels of as many columns as were generated."""
    n = generated.select("dataset_id").distinct().agg(F.count(F.lit(1)).alias("__n"))
    ranked = position(gold.withColumn("__o", S.seeded_order(seed, "dataset_id")), [], ["__o", "dataset_id"], "__p")
    return ranked.crossJoin(F.broadcast(n)).where("__p <= __n").select("dataset_id", "semantic_type")  # one row


def run_grid(frame: DataFrame, runs: list[dict]) -> DataFrame:
    """Every row once per set-up, with the set-up's parameters as columns: one job instead of one per set-up."""
    structs = F.array(*[F.struct(F.lit(i).alias("run_id"), *[F.lit(v).alias(k) for k, v in r.items()]) for i, r in enumerate(runs)])
    return frame.select("*", F.inline(structs))


def split_grid(gold: DataFrame, runs: list[dict]) -> DataFrame:
    """The absolute split of every (k, seed, test) set-up in one job."""
    g = run_grid(gold.select("dataset_id", "semantic_type"), runs)
    keyed = g.withColumn("__o", F.md5(F.concat_ws("|", F.col("seed").cast("string"), "dataset_id")))
    size = g.groupBy("run_id").agg(F.count(F.lit(1)).alias("__n"))
    ranked = position(keyed, ["run_id"], ["__o", "dataset_id"], "__p").join(size, "run_id")
    marked = ranked.withColumn("is_test", F.col("__p") <= F.ceil(F.round(F.col("test") * F.col("__n"), 9)))
    rest = marked.where("not is_test").withColumn("__l", F.md5(F.concat_ws("|", (F.col("seed") + 1).cast("string"), "dataset_id")))
    inner = position(rest, ["run_id", "semantic_type"], ["__l", "dataset_id"], "__r")
    labeled = inner.where(F.col("__r") <= F.col("k")).select("run_id", "dataset_id", F.lit(True).alias("lab"))
    out = marked.join(labeled, ["run_id", "dataset_id"], "left")
    split = F.when(F.col("is_test"), "test").when(F.col("lab"), "labeled").otherwise("unlabeled")
    return out.select("run_id", "dataset_id", "semantic_type", split.alias("split"))
