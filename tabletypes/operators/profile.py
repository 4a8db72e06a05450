"""Profiles of columns: numeric summaries, value distributions, character, token and vector features."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..plans.ordered import HOT_ROWS, running, weighted_quantiles
from .values import value_table

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}

# printable characters whose counts become features
FEATURE_CHARS = [c for c in string.printable if c not in "\n\v\r\t"]


def value_histogram(numeric: DataFrame) -> DataFrame:
    """(dataset_id, x, cnt) of numeric cells; every later step works on it instead of the cells."""
    return numeric.groupBy("dataset_id", "x").agg(F.count(F.lit(1)).alias("cnt"))


def numeric_profile(hist: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """count, mean, std, min, quartiles, max and number of distinct values per column, from the histogram."""
    base = hist.groupBy("dataset_id").agg(
        F.sum("cnt").alias("n"),
        (F.sum(F.col("cnt") * F.col("x")) / F.sum("cnt")).alias("mean"),
        F.min("x").alias("min"),
        F.max("x").alias("max"),
        F.count(F.lit(1)).alias("nunique"),
    )
    spread = (
        hist.join(base.select("dataset_id", "mean", "n"), "dataset_id")
        .groupBy("dataset_id")
        .agg(F.sum(F.col("cnt") * (F.col("x") - F.col("mean")) ** 2).alias("ss"), F.first("n").alias("n"))
        .select("dataset_id", F.when(F.col("n") > 1, F.sqrt(F.col("ss") / (F.col("n") - 1))).alias("std"))
    )
    quart = weighted_quantiles(hist, ["dataset_id"], "x", "cnt", QUARTILES, hot_rows)
    return base.join(spread, "dataset_id").join(quart, "dataset_id")


def same_summary(profile: DataFrame) -> DataFrame:
    """Groups of columns with one and the same five-number summary, counted (members stay in long form)."""
    key = ["min", "q1", "median", "q3", "max"]
    groups = profile.groupBy(*key).agg(F.count(F.lit(1)).alias("n_columns")).where("n_columns > 1")
    return profile.join(groups, key).select("dataset_id", *key, "n_columns")


def constant_columns(profile: DataFrame) -> DataFrame:
    return profile.where("nunique < 2").select("dataset_id")


def zero_quartiles(profile: DataFrame) -> DataFrame:
    return profile.where("q1 = 0 and median = 0 and q3 = 0").select("dataset_id")


def cdf(hist: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Cumulative distribution per column: (dataset_id, x, cdf)."""
    sizes = hist.groupBy("dataset_id").agg(F.sum("cnt").alias("__n"))
    upto = running(hist, ["dataset_id"], ["x"], {"__u": F.col("cnt")}, hot_rows=hot_rows)
    return upto.join(sizes, "dataset_id").select("dataset_id", "x", (F.col("__u") / F.col("__n")).alias("cdf"))


def inverse_transform(hist: DataFrame, n: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Value at p = 1/n, 2/n, .. 1 by linear interpolation of the cumulative distribution, clamped at the ends.

    Each step of the distribution finds the wanted probabilities it covers by arithmetic, so there is
    no join of steps with probabilities.
    """
    sizes = hist.groupBy("dataset_id").agg(F.sum("cnt").alias("__n"))
    steps = running(hist, ["dataset_id"], ["x"], {"__u": F.col("cnt")}, {"__next": F.col("x"), "__more": F.col("cnt")}, hot_rows)
    steps = steps.join(sizes, "dataset_id")
    # p = i/n lies in [u/N, (u + more)/N)  <=>  i in [ceil(u n / N), ceil((u + more) n / N) - 1]
    lo = F.ceil(F.col("__u") * n / F.col("__n"))
    hi = F.when(F.col("__next").isNull(), F.lit(n)).otherwise(F.ceil((F.col("__u") + F.col("__more")) * n / F.col("__n")) - 1)
    inner = steps.where(hi >= lo).select("*", F.explode(F.sequence(lo, hi)).alias("i"))
    share = (F.col("i") * F.col("__n") / n - F.col("__u")) / F.col("__more")
    value = F.when(F.col("__next").isNull(), F.col("x")).otherwise(F.col("x") + (F.col("__next") - F.col("x")) * share)
    inside = inner.select("dataset_id", F.col("i").cast("int").alias("i"), value.alias("x"))
    first = hist.groupBy("dataset_id").agg(F.min_by("cnt", "x").alias("c"), F.min("x").alias("x"), F.sum("cnt").alias("__n"))
    before = F.ceil(F.col("c") * n / F.col("__n")) - 1
    below = first.where(before >= 1).select("dataset_id", F.explode(F.sequence(F.lit(1), before.cast("int"))).alias("i"), "x")
    return inside.unionByName(below)


def _moments(n: Column, s1: Column, s2: Column, s3: Column, s4: Column) -> dict[str, Column]:
    mean = s1 / n
    m2 = s2 / n - mean * mean
    m3 = s3 / n - 3 * mean * s2 / n + 2 * mean * mean * mean
    m4 = s4 / n - 4 * mean * s3 / n + 6 * mean * mean * s2 / n - 3 * mean * mean * mean * mean
    varies = m2 > 1e-9
    return {
        "mean": mean,
        "var": F.when(varies, m2).otherwise(F.lit(0.0)),
        "kurtosis": F.when(varies, m4 / (m2 * m2) - 3),
        "skewness": F.when(varies, m3 / F.pow(m2, F.lit(1.5))),
    }


SLICE_BYTES = 8_000_000


def _count_bins(chars: list[str]):
    """Arrow batches of cells to (dataset_id, char, k, f): in ``f`` cells the character occurs ``k`` times.

    Counting bytes with numpy is many times cheaper than taking strings apart character by character.
    Batches are worked off in slices of bounded size, so long texts do not pile up.
    """
    codes = [ord(c) for c in chars]
    if max(codes) > 127:
        raise ValueError("character features are counted for ASCII characters")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        wanted = np.zeros(256, dtype=bool)
        wanted[codes] = True
        names = np.array([chr(c) for c in range(128)] + ["length"], dtype=object)
        for batch in batches:
            ids = batch.column(0).dictionary_encode()
            values = batch.column(1).cast(pa.large_binary())
            offsets = np.frombuffer(values.buffers()[1], dtype=np.int64)[values.offset : values.offset + len(values) + 1]
            if values.buffers()[2] is None:
                continue
            data = np.frombuffer(values.buffers()[2], dtype=np.uint8)
            owner = ids.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            start = 0
            while start < len(values):
                stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + SLICE_BYTES, side="right")) - 1)
                stop = min(stop, len(values), start + 20_000)
                text = data[offsets[start] : offsets[stop]]
                cell = np.repeat(np.arange(stop - start, dtype=np.int64), np.diff(offsets[start : stop + 1]))
                keep = wanted[text]
                symbol = np.concatenate([text[keep].astype(np.int64), np.full(int(((text & 0xC0) != 0x80).sum()), 128)])
                where = np.concatenate([cell[keep], cell[(text & 0xC0) != 0x80]])
                counts = np.bincount(where * 129 + symbol, minlength=(stop - start) * 129)
                at = np.flatnonzero(counts)
                k = counts[at]
                width = int(k.max()) + 1 if len(k) else 1
                packed, f = np.unique((owner[start:stop][at // 129] * 129 + at % 129) * width + k, return_counts=True)
                key = packed // width
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.dictionary.take(pa.array(key // 129)),
                        pa.array(names[key % 129], type=pa.string()),
                        pa.array(packed % width, type=pa.int64()),
                        pa.array(f.astype(np.int64), type=pa.int64()),
                    ],
                    names=["dataset_id", "char", "k", "f"],
                )
                start = stop

    return run


def char_features(cells: DataFrame, chars: list[str] | None = None) -> DataFrame:
    """Per column and character, statistics of the count per cell; the pseudo character ``length`` counts all.

    Only (character, count) pairs that occur travel; the cells without the character are the remainder
    of the column size. A character that never occurs in a column has no row (all its statistics are 0).
    """
    present = cells.where(F.col("value").isNotNull()).select("dataset_id", "value")
    bins = (
        present.mapInArrow(_count_bins(chars or FEATURE_CHARS), "dataset_id string, char string, k bigint, f bigint")
        .groupBy("dataset_id", "char", "k")
        .agg(F.sum("f").alias("f"))
    )
    sizes = present.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n"))
    # the number of different counts is bounded by the longest cell, so this window stays small
    w = Window.partitionBy("dataset_id", "char").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy("dataset_id", "char")
    steps = bins.where("k > 0").withColumns({"u": F.sum("f").over(w), "some": F.sum("f").over(every)}).join(sizes, "dataset_id")
    zeros = F.col("n") - F.col("some")

    def at(i):
        return F.coalesce(F.min(F.when((i >= zeros) & (zeros + F.col("u") > i), F.col("k"))), F.lit(0))

    k, f = F.col("k").cast("double"), F.col("f")
    grouped = steps.groupBy("dataset_id", "char").agg(
        F.first("n").alias("n"),
        F.first("some").alias("some"),
        F.min("k").alias("least"),
        F.max("k").alias("max"),
        *[F.sum(f * F.pow(k, F.lit(float(p)))).alias(f"s{p}") for p in (1, 2, 3, 4)],
        at(F.floor((F.col("n") - 1) / 2)).alias("lo"),
        at(F.ceil((F.col("n") - 1) / 2)).alias("hi"),
    )
    m = _moments(F.col("n").cast("double"), *[F.col(f"s{p}") for p in (1, 2, 3, 4)])
    return grouped.select(
        "dataset_id",
        "char",
        (F.col("some") > 0).alias("any"),
        (F.col("some") == F.col("n")).alias("all"),
        m["mean"].alias("mean"),
        m["var"].alias("var"),
        F.when(F.col("some") == F.col("n"), F.col("least")).otherwise(F.lit(0)).alias("min"),
        "max",
        ((F.col("lo") + F.col("hi")) / 2).alias("median"),
        F.col("s1").cast("long").alias("sum"),
        m["kurtosis"].alias("kurtosis"),
        m["skewness"].alias("skewness"),
    )


def null_features(cells: DataFrame) -> DataFrame:
    """Number of cells, and has / share / number / all of the null ones; empty strings are not null."""
    n_null = F.count_if(F.col("value").isNull())
    n = F.count(F.lit(1))
    return cells.groupBy("dataset_id").agg(
        n.alias("n_values"),
        (n_null > 0).alias("none_has"),
        (n_null / n).alias("none_percent"),
        n_null.alias("none_num"),
        (n_null == n).alias("none_all"),
    )


def text_stats(cells: DataFrame) -> DataFrame:
    """Entropy, uniqueness, shares of cells with digits and letters, and counts of digits, letters, specials and words.

    Works on the value table: short values are counted first and scanned once, long ones never leave the scan.
    """
    marks = {k: lambda v, k=k: S.char_class_counts(v)[k] for k in ("num", "text", "spec", "space")}
    table = value_table(cells.where(F.col("value").isNotNull()), marks)
    per_value = table.select("dataset_id", F.col("c").alias("f"), "num", "text", "spec", (F.col("space") + 1).alias("word"))
    f = F.col("f")
    agg = per_value.groupBy("dataset_id").agg(
        F.sum(f).alias("n"),
        F.count(F.lit(1)).alias("distinct"),
        F.sum(f * F.log2(f)).alias("flogf"),
        F.sum(F.when(F.col("num") > 0, f).otherwise(0)).alias("with_num"),
        F.sum(F.when(F.col("text") > 0, f).otherwise(0)).alias("with_text"),
        *[F.sum(f * F.col(c)).alias(f"{c}1") for c in ("num", "text", "spec", "word")],
        *[F.sum(f * F.col(c) * F.col(c)).alias(f"{c}2") for c in ("num", "text", "spec", "word")],
    )
    n = F.col("n")
    out = {
        "col_entropy": F.log2(n) - F.col("flogf") / n,
        "frac_unique": F.col("distinct") / n,
        "frac_numcells": F.col("with_num") / n,
        "frac_textcells": F.col("with_text") / n,
    }
    for c in ("num", "text", "spec", "word"):
        mean = F.col(f"{c}1") / n
        out[f"avg_{c}_cells"] = mean
        # the variance numerator is a whole number, so a constant count gives an exact zero
        whole = n.cast("decimal(38,0)") * F.col(f"{c}2") - F.col(f"{c}1").cast("decimal(38,0)") * F.col(f"{c}1")
        out[f"std_{c}_cells"] = F.sqrt(whole.cast("double")) / n
    return agg.select("dataset_id", *[e.alias(k) for k, e in out.items()])


def storage_types(columns: DataFrame, cells: DataFrame) -> DataFrame:
    """Storage type per column: by the end of the header, else by weighted votes of the cells, first type on ties."""
    named = columns.withColumn("storage", S.storage_from_header("header"))
    votes = {t: lambda v, t=t: S.storage_votes(v)[t] for t in S.STORAGE_WEIGHTS}
    table = value_table(cells.where(F.col("value").isNotNull() & (F.col("value") != "")), votes)
    scores = table.groupBy("dataset_id").agg(
        *[(F.sum(F.when(F.col(t), F.col("c") * S.STORAGE_WEIGHTS[t]).otherwise(0)) + (1 if t == "string" else 0)).alias(t) for t in votes]
    )
    # struct order: highest score, then earliest in the list of types
    ranked = F.array_max(F.array(*[F.struct(F.col(t).alias("s"), F.lit(-i).alias("o"), F.lit(t).alias("t")) for i, t in enumerate(votes)]))
    voted = scores.select("dataset_id", ranked["t"].alias("voted"))
    out = named.join(voted, "dataset_id", "left")
    storage = F.coalesce("storage", "voted", F.lit("string"))
    return out.select("dataset_id", storage.alias("storage_type"), S.general_type(storage).alias("general_type"))


def value_vectors(values: DataFrame, vectors: DataFrame) -> DataFrame:
    """Vector of each distinct value in long form (value, dim, x).

    A value that is a known word (lower case) takes that vector, any other the mean of its known words.
    ``vectors(token, vec)`` may be large: it is joined on the token, never broadcast by force.
    """
    distinct = values.select("value").where(F.col("value").isNotNull()).distinct().withColumn("low", F.lower("value"))
    known = vectors.select("token", F.lit(True).alias("hit"))
    marked = distinct.join(known, F.col("low") == F.col("token"), "left")
    words = marked.select(
        "value",
        F.explode(F.when(F.col("hit"), F.array("low")).otherwise(F.split("low", " "))).alias("token"),
    )
    counted = words.groupBy("value", "token").agg(F.count(F.lit(1)).alias("times"))
    dims = counted.join(vectors, "token").select("value", "times", F.posexplode("vec").alias("dim", "x"))
    total = F.sum(F.col("times") * F.col("x").cast("double"))
    return dims.groupBy("value", "dim").agg((total / F.sum("times")).alias("x"))


def vector_stats(cells: DataFrame, vectors: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """avg, std, median and mode (smallest of the most frequent) of the cell vectors per column and dimension."""
    freq = cells.where(F.col("value").isNotNull()).groupBy("dataset_id", "value").agg(F.count(F.lit(1)).alias("f"))
    placed = freq.join(value_vectors(freq, vectors), "value")
    hist = placed.groupBy("dataset_id", "dim", "x").agg(F.sum("f").alias("f"))
    f, x = F.col("f"), F.col("x")
    base = hist.groupBy("dataset_id", "dim").agg(
        (F.sum(f * x) / F.sum(f)).alias("avg"),
        (F.sum(f * x * x) / F.sum(f)).alias("sq"),
        F.max(F.struct(f.alias("f"), (-x).alias("neg"))).alias("m"),
    )
    med = weighted_quantiles(hist, ["dataset_id", "dim"], "x", "f", {"median": 0.5}, hot_rows)
    var = F.col("sq") - F.col("avg") * F.col("avg")
    return base.join(med, ["dataset_id", "dim"]).select(
        "dataset_id", "dim", "avg", F.when(var > 1e-15, F.sqrt(var)).otherwise(F.lit(0.0)).alias("std"), "median", (-F.col("m.neg")).alias("mode")
    )


def column_embedding(cells: DataFrame, vectors: DataFrame) -> DataFrame:
    """Mean vector of the column's cells as an array, and the number of cells that had a vector."""
    freq = cells.where(F.col("value").isNotNull()).groupBy("dataset_id", "value").agg(F.count(F.lit(1)).alias("f"))
    placed = freq.join(value_vectors(freq, vectors), "value")
    per_dim = placed.groupBy("dataset_id", "dim").agg(
        (F.sum(F.col("f") * F.col("x")) / F.sum("f")).alias("x"), F.sum("f").alias("used")
    )
    # one entry per dimension: the array is as long as the vectors
    return per_dim.groupBy("dataset_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda d: d["x"]).alias("embedding"),
        F.max("used").alias("used_values"),
    )
