"""Statistics of known and generated types: co-occurrence, vocabulary weights, overlap inside clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import top


def type_cooccurrence(gold: DataFrame) -> DataFrame:
    """How often two columns of one table have types (t1, t2), symmetric, with ``log(n + 1)``.

    Types are counted per table first, so a table contributes one row per pair of its types and not one
    per pair of its columns.
    """
    counts = gold.groupBy("table_id", "semantic_type").agg(F.count(F.lit(1)).alias("n"))
    a = counts.select("table_id", F.col("semantic_type").alias("t1"), F.col("n").alias("n1"))
    b = counts.select("table_id", F.col("semantic_type").alias("t2"), F.col("n").alias("n2"))
    pairs = F.when(F.col("t1") == F.col("t2"), F.col("n1") * (F.col("n1") - 1) / 2).otherwise(F.col("n1") * F.col("n2"))
    m = a.join(b, "table_id").groupBy("t1", "t2").agg(F.sum(pairs).cast("long").alias("n")).where("n > 0")
    return m.withColumn("log_n", F.log1p("n"))


def attribute_cooccurrence(schemas: DataFrame) -> DataFrame:
    """Header pairs weighted by how often their schema occurs; ``schemas(schema_id, header, freq)``."""
    a = schemas.select("schema_id", F.col("header").alias("a"), "freq")
    b = schemas.select("schema_id", F.col("header").alias("b"))
    return a.join(b, "schema_id").where("a <> b").groupBy("a", "b").agg(F.sum("freq").alias("weight"))


def schema_frequencies(columns: DataFrame) -> DataFrame:
    """Distinct schemas (sets of headers) with the number of tables: the compact input of the co-occurrence."""
    per = columns.groupBy("table_id").agg(F.array_sort(F.collect_set("header")).alias("headers"))
    freq = per.groupBy("headers").agg(F.count(F.lit(1)).alias("freq"))
    return freq.select(F.md5(F.to_json("headers")).alias("schema_id"), F.explode("headers").alias("header"), "freq")


def vocab_distribution(vocab: DataFrame, reserved: int = 0) -> DataFrame:
    """``log10(count)`` normalised to sum 1; the ``reserved`` first ids count 2."""
    w = F.log10(F.when(F.col("idx") < reserved, F.lit(2)).otherwise(F.col("cnt")).cast("double"))
    weighted = vocab.withColumn("w", w)
    total = weighted.agg(F.sum("w").alias("__t"))
    return weighted.crossJoin(F.broadcast(total)).select("idx", "entity", (F.col("w") / F.col("__t")).alias("p"))  # one row


def type_overlap_per_cluster(clusters: DataFrame, types: DataFrame) -> DataFrame:
    """Mean pairwise overlap #(A and B) / min(#A, #B) of the tables' type lists per cluster (multisets).

    Tables with one and the same list form a class with a weight, so the pairs run over classes.
    ``clusters(table_id, cluster)``; ``types(table_id, semantic_type)``.
    """
    counts = clusters.join(types, "table_id").groupBy("cluster", "table_id", "semantic_type").agg(F.count(F.lit(1)).alias("n"))
    lists = counts.groupBy("cluster", "table_id").agg(
        F.md5(F.to_json(F.array_sort(F.collect_list(F.struct("semantic_type", "n"))))).alias("cls"), F.sum("n").alias("size")
    )
    classes = lists.groupBy("cluster", "cls").agg(F.count(F.lit(1)).alias("w"), F.first("size").alias("size"), F.min("table_id").alias("table_id"))
    items = classes.join(counts, ["cluster", "table_id"]).select("cluster", "cls", "semantic_type", "n")
    a = items.select("cluster", F.col("cls").alias("ca"), "semantic_type", F.col("n").alias("na"))
    b = items.select("cluster", F.col("cls").alias("cb"), "semantic_type", F.col("n").alias("nb"))
    shared = a.join(b, ["cluster", "semantic_type"]).groupBy("cluster", "ca", "cb").agg(F.sum(F.least("na", "nb")).alias("both"))
    wa = classes.select("cluster", F.col("cls").alias("ca"), F.col("w").alias("wa"), F.col("size").alias("sa"))
    wb = classes.select("cluster", F.col("cls").alias("cb"), F.col("w").alias("wb"), F.col("size").alias("sb"))
    pairs = F.when(F.col("ca") == F.col("cb"), F.col("wa") * (F.col("wa") - 1) / 2).otherwise(F.col("wa") * F.col("wb") / 2)
    total = shared.join(wa, ["cluster", "ca"]).join(wb, ["cluster", "cb"]).groupBy("cluster").agg(
        F.sum(pairs * F.col("both") / F.least("sa", "sb")).alias("s")
    )
    sizes = lists.groupBy("cluster").agg(F.count(F.lit(1)).alias("k"))
    n_pairs = F.col("k") * (F.col("k") - 1) / 2
    return sizes.join(total, "cluster").select("cluster", F.col("k").alias("n_tables"), F.when(n_pairs > 0, F.col("s") / n_pairs).alias("overlap"))


def top_types_per_cluster(clusters: DataFrame, types: DataFrame, n: int = 5) -> DataFrame:
    counts = clusters.join(types, "table_id").groupBy("cluster", "semantic_type").agg(F.count(F.lit(1)).alias("n"))
    return top(counts, ["cluster"], [F.desc("n"), F.col("semantic_type")], n)


def context_rescore(scores: DataFrame, cooccurrence: DataFrame, weight: float = 1.0) -> DataFrame:
    """Add to each (column, type) score the co-occurrence evidence of the other columns' current best types.

    One pass; ``scores(dataset_id, table_id, semantic_type, score)``; ``cooccurrence(t1, t2, log_n)``.
    Best types are counted per table, so a table contributes one row per type and not per pair of columns.
    """
    s = F.round("score", 9)
    best = scores.groupBy("table_id", "dataset_id").agg(F.min(F.struct((-s).alias("s"), F.col("semantic_type").alias("t")))["t"].alias("best"))
    votes = best.groupBy("table_id", F.col("best").alias("t2")).agg(F.count(F.lit(1)).alias("k"))
    wanted = scores.select("table_id", F.col("semantic_type").alias("t1")).distinct()
    co = cooccurrence.select("t1", "t2", "log_n")
    evidence = wanted.join(votes, "table_id").join(co, ["t1", "t2"]).groupBy("table_id", "t1").agg(F.sum(F.col("k") * F.col("log_n")).alias("e"))
    own = co.withColumnRenamed("t2", "best").withColumnRenamed("log_n", "own")
    joined = (
        scores.join(best, ["table_id", "dataset_id"])
        .join(evidence.withColumnRenamed("t1", "semantic_type"), ["table_id", "semantic_type"], "left")
        .join(own.withColumnRenamed("t1", "semantic_type"), ["semantic_type", "best"], "left")
    )
    total = F.col("score") + F.lit(weight) * (F.coalesce("e", F.lit(0.0)) - F.coalesce("own", F.lit(0.0)))
    rescored = joined.select("dataset_id", "semantic_type", total.alias("score"))
    r = F.round("score", 9)
    top1 = rescored.groupBy("dataset_id").agg(F.min(F.struct((-r).alias("s"), F.col("semantic_type").alias("t"))).alias("m"))
    return top1.select("dataset_id", F.col("m.t").alias("label"), (-F.col("m.s")).alias("score"))
