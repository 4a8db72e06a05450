"""Labeling functions: each takes cells or columns and returns votes (dataset_id, lf, label), no row = abstain."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .values import EXACT, LOWER, Marks, digest, is_null, value_table


OVERLAP_MARKS = LOWER


def pattern_marks(patterns: dict[str, list[str]]) -> Marks:
    """For each type the number of its patterns that a cell matches."""
    return {f"hits_{i}": lambda v, ps=ps: S.regex_hits(v, ps) for i, ps in enumerate(patterns.values())}


def lf_value_overlap(cells: DataFrame, dictionary: DataFrame, share: float = 0.2) -> DataFrame:
    """Vote for a type if enough cells are in its word list; ``dictionary(sem_type, element)``.

    Cells count with repeats and null cells count in the size. At least two hits are needed.
    """
    return overlap_votes(value_table(cells, OVERLAP_MARKS), dictionary, share)


def overlap_votes(table: DataFrame, dictionary: DataFrame, share: float = 0.2) -> DataFrame:
    """``lf_value_overlap`` on a value table with ``OVERLAP_MARKS``."""
    size = table.groupBy("dataset_id").agg(F.sum("c").alias("n"))
    low1, low2 = digest(F.lower("element"))
    words = dictionary.where(F.col("element").isNotNull()).select("sem_type", low1.alias("low1"), low2.alias("low2")).distinct()
    hits = table.where(~is_null()).join(words, ["low1", "low2"]).groupBy("dataset_id", "sem_type").agg(F.sum("c").alias("hits"))
    need = F.lit(share) * F.col("n")
    voted = hits.join(size, "dataset_id").where(F.col("hits") >= F.when(need <= 1, F.lit(2.0)).otherwise(need))
    return voted.select("dataset_id", F.concat(F.lit("value_overlap:"), "sem_type").alias("lf"), F.col("sem_type").alias("label"))


def lf_value_pattern(cells: DataFrame, patterns: dict[str, list[str]], share: float = 0.2) -> DataFrame:
    """Vote for a type if enough cells match its patterns; a cell counts once per pattern it matches."""
    return pattern_votes(value_table(cells, pattern_marks(patterns)), patterns, share)


def pattern_votes(table: DataFrame, patterns: dict[str, list[str]], share: float = 0.2) -> DataFrame:
    """``lf_value_pattern`` on a value table with the marks of the patterns: one aggregation, no row per type. Null cells are tested as ``nan``."""
    marks = dict(zip(pattern_marks(patterns), patterns.items(), strict=True))
    hits = {k: F.when(is_null(), S.regex_hits(F.lit("nan"), ps)).otherwise(F.col(k)) for k, (_, ps) in marks.items()}
    sums = table.groupBy("dataset_id").agg(F.sum("c").alias("n"), *[F.sum(F.col("c") * h).alias(k) for k, h in hits.items()])
    tested = F.array(*[F.struct(F.lit(t).alias("sem_type"), F.col(k).alias("hits")) for k, (t, _) in marks.items()])
    need = F.floor(F.lit(share) * F.col("n"))
    voted = sums.select("dataset_id", "n", F.inline(tested)).where(F.col("hits") >= F.when(need <= 1, F.lit(2)).otherwise(need))
    return voted.select("dataset_id", F.concat(F.lit("value_pattern:"), "sem_type").alias("lf"), F.col("sem_type").alias("label"))


def ngram_vectors(texts: DataFrame, key: str, text: str, n: int = 3) -> DataFrame:
    """Sparse vector (key, dim, w) of character n-grams of the padded lower-case text."""
    padded = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - n + 1, F.lit(1))), lambda i: F.substring(padded, i, n))
    return (
        texts.select(F.col(key), F.explode(grams).alias("dim")).groupBy(key, "dim").agg(F.count(F.lit(1)).cast("double").alias("w"))
    )


def sparse_cosine(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Cosine of all pairs that share a dimension."""
    ln = left.groupBy(left_key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("ln"))
    rn = right.groupBy(right_key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("rn"))
    r = right.withColumnRenamed("w", "w2")
    dots = left.join(r, "dim").groupBy(left_key, right_key).agg(F.sum(F.col("w") * F.col("w2")).alias("dot"))
    return dots.join(ln, left_key).join(rn, right_key).select(left_key, right_key, (F.col("dot") / (F.col("ln") * F.col("rn"))).alias("sim"))


def best_type(sims: DataFrame, key: str, least: float) -> DataFrame:
    """Most similar type per key, if the similarity reaches ``least``; equal similarity goes to the first name."""
    s = F.round("sim", 9)
    best = sims.groupBy(key).agg(F.max(F.struct(s.alias("s"))).alias("m"))
    at = sims.join(best, key).where(s == F.col("m.s")).groupBy(key).agg(F.min("semantic_type").alias("semantic_type"), F.max("sim").alias("sim"))
    return at.where(F.col("sim") >= least)


def lf_header_similarity(columns: DataFrame, types: DataFrame, least: float = 0.9, n: int = 3) -> DataFrame:
    """Vote of the type name most like the header (cosine of character n-grams of header and short type name)."""
    headers = columns.select("header").distinct()
    hv = ngram_vectors(headers, "header", "header", n)
    tv = ngram_vectors(types.select("semantic_type").distinct().withColumn("short", S.short_type("semantic_type")), "semantic_type", "short", n)
    best = best_type(sparse_cosine(hv, tv, "header", "semantic_type"), "header", least)
    return columns.select("dataset_id", "header").join(best, "header").select("dataset_id", F.lit("header_similarity").alias("lf"), F.col("semantic_type").alias("label"), "sim")


def lf_known_labels(columns: DataFrame, generated: DataFrame) -> DataFrame:
    """Vote of a label produced earlier for the column."""
    known = columns.select("dataset_id").join(generated.select("dataset_id", "label"), "dataset_id", "inner")
    return known.select("dataset_id", F.lit("known_labels").alias("lf"), "label")


def lf_kb_types(cells: DataFrame, kb: DataFrame, types: DataFrame, top_n: int = 3, least: float = 0.9) -> DataFrame:
    """Vote from a knowledge-base table ``kb(entity, type)``: the ``top_n`` types of a column's cells, mapped to
    the vocabulary by name; the most frequent type that maps wins."""
    counts = value_table(cells.where(F.col("value").isNotNull()), EXACT)
    v1, v2 = digest(F.col("entity"))
    typed = counts.join(kb.where(F.col("entity").isNotNull()).select(v1.alias("v1"), v2.alias("v2"), "type"), ["v1", "v2"]).groupBy("dataset_id", "type").agg(F.sum("c").alias("k"))
    w = Window.partitionBy("dataset_id").orderBy(F.desc("k"), "type")
    first = typed.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top_n)
    names = first.select("type").distinct()
    kv = ngram_vectors(names, "type", "type")
    tv = ngram_vectors(types.select("semantic_type").distinct().withColumn("short", S.short_type("semantic_type")), "semantic_type", "short")
    mapped = best_type(sparse_cosine(kv, tv, "type", "semantic_type"), "type", least).select("type", "semantic_type")
    best = first.join(mapped, "type").groupBy("dataset_id").agg(F.min_by("semantic_type", "r").alias("label"))
    return best.select("dataset_id", F.lit("kb_types").alias("lf"), "label")
