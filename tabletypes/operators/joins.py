"""Joins and set operations between columns, tables, labels and votes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import HOT_ROWS, position
from ..plans.session import cut
from .corpus import NUMERIC_TYPES

COLUMNS_OF_VALUE = 64  # mean number of columns that a cell's value has, up to which all their pairs are counted


def with_gold(x: DataFrame, gold: DataFrame) -> DataFrame:
    """Attach the known type (NULL where none)."""
    return x.join(gold.select("dataset_id", "semantic_type"), "dataset_id", "left")


def in_split(x: DataFrame, splits: DataFrame, split: str) -> DataFrame:
    return x.join(splits.where(F.col("split") == split), "dataset_id", "left_semi")


def minus(a: DataFrame, b: DataFrame, on: str | list[str]) -> DataFrame:
    return a.join(b, on, "left_anti")


def shared_columns(outer: DataFrame, inner: DataFrame) -> tuple[list[str], list[str]]:
    """Names of the string columns and of the numeric columns that both schemas have."""
    there = dict(inner.dtypes)
    strings = [c for c, t in outer.dtypes if t == "string" and there.get(c) == "string"]
    numeric = [
        c for c, t in outer.dtypes if t.split("(")[0] in NUMERIC_TYPES and there.get(c, "").split("(")[0] in NUMERIC_TYPES
    ]
    return strings, numeric


def natural_string_join(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """Inner join on all shared string columns; shared numeric columns come as ``o.x`` and ``i.x``; no nulls."""
    strings, numeric = shared_columns(outer, inner)
    used = strings + numeric
    o = outer.select(*used).dropna().select(*strings, *[F.col(c).alias(f"o.{c}") for c in numeric])
    i = inner.select(*used).dropna().select(*strings, *[F.col(c).alias(f"i.{c}") for c in numeric])
    return o.join(i, strings, "inner")


def bounded_group_join(outer: DataFrame, inner: DataFrame, keys: list[str], max_group_size: int) -> DataFrame:
    """Inner join on ``keys`` of the groups whose joined size stays within the bound.

    Group sizes are known before the join, so a group beyond the bound is never built.
    """
    n_o = outer.groupBy(*keys).agg(F.count(F.lit(1)).alias("__o"))
    n_i = inner.groupBy(*keys).agg(F.count(F.lit(1)).alias("__i"))
    fits = n_o.join(n_i, keys).where(F.col("__o") * F.col("__i") <= max_group_size).select(*keys)
    return outer.join(fits, keys, "left_semi").join(inner, keys, "inner")


def overlap_candidates(cells: DataFrame, least: float, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Column pairs (a, b) of one semantic type with #(A and B) / #A >= ``least`` over distinct values.

    ``cells(dataset_id, semantic_type, value)``. Columns with one and the same set of values are compared
    once. Where a value has few columns on average, the pairs of its columns are counted as they lie, which adds up in each task. Otherwise
    A must share one of its ``#A - ceil(least #A) + 1`` rarest values with B, so only those are
    joined with the full sets, and the surviving pairs are counted exactly.
    """
    values = cells.select("dataset_id", "semantic_type", "value").where(F.col("value").isNotNull()).distinct()
    prints = values.groupBy("dataset_id", "semantic_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64("value")).alias("f1"),
        F.bit_xor(F.xxhash64("value", F.lit("second"))).alias("f2"),
    )
    classes = prints.groupBy("semantic_type", "n", "f1", "f2").agg(F.min("dataset_id").alias("rep"))
    member = prints.join(classes, ["semantic_type", "n", "f1", "f2"]).select("dataset_id", "rep", "semantic_type", "n")
    reps = classes.select(F.col("rep").alias("dataset_id"), "semantic_type", "n")
    kept = _shared_values(values, reps, hot_rows, least)
    kept = kept.where(F.col("shared") >= F.round(F.col("n") * least, 9)).withColumn("containment", F.col("shared") / F.col("n"))
    ma = member.select(F.col("rep").alias("ra"), F.col("dataset_id").alias("a"))
    mb = member.select(F.col("rep").alias("rb"), F.col("dataset_id").alias("b"))
    return kept.join(ma, "ra").join(mb, "rb").where("a <> b").select("a", "b", "shared", "containment")


def _shared_values(values: DataFrame, reps: DataFrame, hot_rows: int, least: float) -> DataFrame:
    """(ra, rb, shared, n) of pairs of columns among which are all that share ``least`` of the values of ``ra``."""
    sets = cut(values.join(reps, ["dataset_id", "semantic_type"]))
    sizes = sets.groupBy("semantic_type", "value").agg(F.count(F.lit(1)).alias("df")).agg(F.sum("df"), F.sum(F.col("df") * F.col("df"))).first()
    if (sizes[1] or 0) <= COLUMNS_OF_VALUE * (sizes[0] or 0):
        held = sets.groupBy("semantic_type", "value").agg(F.collect_list(F.struct("dataset_id", "n")).alias("c"))  # few columns, as just counted
        pairs = held.select(F.explode("c").alias("a"), "c").select("a", F.explode("c.dataset_id").alias("rb"))
        return pairs.groupBy(F.col("a.dataset_id").alias("ra"), "rb").agg(F.count(F.lit(1)).alias("shared"), F.first("a.n").alias("n"))
    rarity = sets.groupBy("semantic_type", "value").agg(F.count(F.lit(1)).alias("df"))
    ranked = position(sets.join(rarity, ["semantic_type", "value"]), ["dataset_id"], ["df", "value"], "pos", hot_rows)
    prefix = ranked.where(F.col("pos") <= F.col("n") - F.ceil(F.round(F.col("n") * least, 9)) + 1)
    a = prefix.select(F.col("dataset_id").alias("ra"), "semantic_type", "value")
    b = sets.select(F.col("dataset_id").alias("rb"), "semantic_type", "value")
    pairs = a.join(b, ["semantic_type", "value"]).select("semantic_type", "ra", "rb").distinct()
    full = sets.select(F.col("dataset_id").alias("ra"), "semantic_type", "value", "n")
    return (
        pairs.join(full, ["semantic_type", "ra"])
        .join(b, ["semantic_type", "rb", "value"], "left_semi")
        .groupBy("ra", "rb")
        .agg(F.count(F.lit(1)).alias("shared"), F.first("n").alias("n"))
    )


def attach_candidates(mentions: DataFrame, candidates: DataFrame, ids: DataFrame) -> DataFrame:
    """Candidate lists by mention text (left) and the known id of the gold title (inner)."""
    return mentions.join(candidates, "mention", "left").join(ids, "title", "inner")


def override_labels(gold: DataFrame, generated: DataFrame, keep_gold: bool = False) -> DataFrame:
    """Training labels: generated ones replace gold ones of the same column (or the other way round)."""
    g = gold.select("dataset_id", F.col("semantic_type").alias("g"))
    n = generated.select("dataset_id", F.col("label").alias("n"))
    both = g.join(n, "dataset_id", "full_outer")
    first, second = ("g", "n") if keep_gold else ("n", "g")
    return both.select("dataset_id", F.coalesce(first, second).alias("label"), F.col("n").isNotNull().alias("generated"))


def union_results(frames: list[DataFrame], distinct: bool = False) -> DataFrame:
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return out.distinct() if distinct else out


def align_votes(votes: DataFrame, lfs: list[str]) -> DataFrame:
    """Wide label matrix: one row per column with a vote, one column per labeling function, NULL = abstain."""
    return votes.groupBy("dataset_id").pivot("lf", lfs).agg(F.min("label"))


def candidate_union(a: DataFrame, b: DataFrame, targets: DataFrame | tuple[DataFrame, DataFrame, str], on: list[str]) -> DataFrame:
    """Distinct union of two candidate sets with a flag for those among the targets.

    Targets that are all pairs of two frames with an equal key, each holding one column of ``on``, are passed as (first, second, key): the keys of
    both ends of a candidate are then compared, and the pairs, which may be far more than the candidates, are never built.
    """
    both = a.select(*on).union(b.select(*on)).distinct()
    if isinstance(targets, tuple):
        *ends, key = targets
        for i, (end, c) in enumerate(zip(ends, on, strict=True)):
            both = both.join(end.groupBy(c).agg(F.collect_set(key).alias(f"__k{i}")), c, "left")  # the keys of one value
        return both.select(*on, F.coalesce(F.arrays_overlap("__k0", "__k1"), F.lit(False)).alias("hit"))
    return both.join(targets.select(*on).distinct().withColumn("hit", F.lit(True)), on, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def column_sets(columns: DataFrame, t1: str, t2: str) -> DataFrame:
    """Headers of two tables: in both, only in the first, only in the second."""
    a = columns.where(F.col("table_id") == t1).select("header").distinct()
    b = columns.where(F.col("table_id") == t2).select("header").distinct()
    return (
        a.intersect(b).withColumn("side", F.lit("both"))
        .unionByName(a.exceptAll(b).withColumn("side", F.lit("first")))
        .unionByName(b.exceptAll(a).withColumn("side", F.lit("second")))
    )


def having_all(pairs: DataFrame, owner: str, item: str, wanted: DataFrame) -> DataFrame:
    """Owners that have every wanted item (relational division)."""
    need = wanted.select(item).distinct()
    hits = pairs.join(need, item, "left_semi").groupBy(owner).agg(F.count_distinct(item).alias("__h"))
    size = need.agg(F.count(F.lit(1)).alias("__k"))
    return hits.crossJoin(F.broadcast(size)).where("__h = __k").select(owner)  # one row


def having_all_per_query(pairs: DataFrame, owner: str, item: str, wanted: DataFrame, query: str) -> DataFrame:
    """Per query, the owners that have every item the query asks for."""
    need = wanted.select(query, item).distinct()
    size = need.groupBy(query).agg(F.count(F.lit(1)).alias("__k"))
    hits = pairs.select(owner, item).distinct().join(need, item).groupBy(query, owner).agg(F.count(F.lit(1)).alias("__h"))
    return hits.join(size, query).where("__h = __k").select(query, owner)
