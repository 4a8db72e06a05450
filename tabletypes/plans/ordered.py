"""Running totals and ranks over groups of any size.

A window partitioned by a key puts the whole key into one task. Where a key may hold a large share
of the rows, ``running`` splits such keys into ordered blocks, accumulates inside the blocks and adds
the total of the blocks before. Keys of ordinary size keep the plain window. The number of split keys
and of blocks has no limit: the large keys are a table, and the blocks come from a range partitioning.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabletypes.plans.session import cut

HOT_ROWS = 1_000_000

_BLOCK = "__block"


def split_hot(df: DataFrame, keys: list[str], order: list[str], hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame | None]:
    """(rows of ordinary keys, rows of keys with more than ``hot_rows`` rows with their block number).

    The second is None without such keys. Blocks follow the order and hold half of ``hot_rows`` on average, as their
    borders are sampled. They are written, so that every use sees the same borders.
    """
    if not keys:
        rows = df.count()
        if rows <= hot_rows:
            return df, None
        return df.limit(0), _blocks(df, order, rows, hot_rows)
    names = [f"__key{i}" for i in range(len(keys))]
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > hot_rows)
    hot = cut(sizes.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], "__n"))
    rows = hot.agg(F.sum("__n")).first()[0]
    if not rows:
        return df, None
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)]
    large = df.join(hot.drop("__n"), same, "left_semi")
    return df.join(hot.drop("__n"), same, "left_anti"), _blocks(large, [*keys, *order], rows, hot_rows)


def _blocks(df: DataFrame, order: list[str], rows: int, hot_rows: int) -> DataFrame:
    return cut(df.repartitionByRange(ceil(2 * rows / hot_rows), *order).withColumn(_BLOCK, F.spark_partition_id()))


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    sums: dict[str, Column],
    following: dict[str, Column] | None = None,
    hot_rows: int = HOT_ROWS,
    largest: int | None = None,
) -> DataFrame:
    """Add inclusive running sums along ``order`` inside ``keys`` and, optionally, the next row's values.

    ``order`` names ascending columns that tell the rows of a key apart. A caller that knows how many
    rows a key can have at most passes it as ``largest`` and saves counting them.
    """
    following = following or {}

    def inside(rows: DataFrame, by: list[str]) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(*order)
        upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return rows.withColumns(
            {**{k: F.sum(v).over(upto) for k, v in sums.items()}, **{k: F.lead(v).over(w) for k, v in following.items()}}
        )

    if largest is not None and largest <= hot_rows:
        return inside(df, keys)
    cold, hot = split_hot(df, keys, order, hot_rows)
    if hot is None:
        return inside(cold, keys)
    point = F.struct(*[F.col(c) for c in order])
    names = [f"__key{i}" for i in range(len(keys))]
    per_block = hot.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], _BLOCK).agg(
        *[F.sum(v).alias(f"__t_{k}") for k, v in sums.items()],
        *[F.min_by(v, point).alias(f"__f_{k}") for k, v in following.items()],
        F.count(F.lit(1)).alias("__rows"),
    )
    along = Window.partitionBy(*names).orderBy(_BLOCK)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_block.select(
        *names,
        F.col(_BLOCK).alias("__at"),
        *[F.sum(f"__t_{k}").over(before).alias(f"__o_{k}") for k in sums],
        *[F.lead(f"__f_{k}").over(along).alias(f"__x_{k}") for k in following],
    )
    same = [F.col(_BLOCK) == F.col("__at"), *[F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)]]
    out = inside(hot, [*keys, _BLOCK]).join(offsets, same, "left")
    out = out.withColumns(
        {
            **{k: F.when(F.col(f"__o_{k}").isNull(), F.col(k)).otherwise(F.col(k) + F.col(f"__o_{k}")) for k in sums},
            **{k: F.coalesce(F.col(k), F.col(f"__x_{k}")) for k in following},
        }
    )
    out = out.drop(_BLOCK, "__at", *names, *[f"__o_{k}" for k in sums], *[f"__x_{k}" for k in following])
    return inside(cold, keys).unionByName(out)


def position(df: DataFrame, keys: list[str], order: list[str], out: str = "pos", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Row number from 1 along ``order`` inside ``keys``; with no keys, over the whole frame."""
    return running(df, keys, order, {out: F.lit(1).cast("long")}, hot_rows=hot_rows)


def top(df: DataFrame, keys: list[str], order: list[Column], n: int, out: str = "rank") -> DataFrame:
    """First ``n`` rows per key. The constant limit lets Spark cut each key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= n)


def weighted_quantiles(
    hist: DataFrame, keys: list[str], x: str, weight: str, probs: dict[str, float], hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Exact interpolated quantiles of a histogram with one row per (key, value); no group is held in memory."""
    sizes = hist.groupBy(*keys).agg(F.sum(weight).alias("__n"))
    upto = running(hist.select(*keys, x, weight), keys, [x], {"__u": F.col(weight)}, hot_rows=hot_rows).join(sizes, keys)

    def at(k):
        return F.min(F.when(F.col("__u") > k, F.col(x)))

    out = upto.groupBy(*keys).agg(
        F.first("__n").alias("__n"),
        *[at(F.floor(F.lit(p) * (F.col("__n") - 1))).alias(f"__lo_{name}") for name, p in probs.items()],
        *[at(F.ceil(F.lit(p) * (F.col("__n") - 1))).alias(f"__hi_{name}") for name, p in probs.items()],
    )
    cols = []
    for name, p in probs.items():
        at_p = F.lit(p) * (F.col("__n") - 1)
        lo, hi = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        cols.append((lo + (hi - lo) * (at_p - F.floor(at_p))).alias(name))
    return out.select(*keys, *cols)
