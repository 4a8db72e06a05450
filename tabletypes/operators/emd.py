"""Earth mover's distance between numeric columns, from histograms and running sums."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordered import HOT_ROWS, position, running
from ..plans.session import cut

TIE_DIGITS = 9
BLOCK = 1000  # columns of the right side in a block of a full comparison
VALUES = 25_000  # values of all columns in a block of the line
COPIES = 8  # times a value may travel with pairs of its column, on average
SIDE = 256  # columns of either side in a cell of pairs
MOST_TASKS = 4096


def emd(weights: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS, largest: int | None = None) -> DataFrame:
    """Distance per key of signed weights ``(keys, x, w)``: +share of the left side, -share of the right one.

    The area between the two cumulative distributions is the sum of |running weight| times the gap to
    the next value.
    """
    net = weights.groupBy(*keys, "x").agg(F.sum("w").alias("w"))
    steps = running(net, keys, ["x"], {"__u": F.col("w")}, {"__next": F.col("x")}, hot_rows, largest)
    gap = F.coalesce(F.col("__next") - F.col("x"), F.lit(0.0))
    return steps.groupBy(*keys).agg(F.sum(F.abs("__u") * gap).alias("emd"))


def shares(hist: DataFrame, keys: list[str]) -> DataFrame:
    """Histogram counts as shares of the key's total."""
    total = hist.groupBy(*keys).agg(F.sum("cnt").alias("__n"))
    return hist.join(total, keys).select(*keys, "x", (F.col("cnt") / F.col("__n")).alias("w"))


def _block_areas():
    """Function from the rows of one cell within one block of the line to the (u, l, emd) of its pairs."""

    def areas(table):
        import numpy as np
        import pyarrow as pa

        def codes(name):
            indices = table[name].combine_chunks().dictionary_encode().indices
            return indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)

        u, l = codes("u"), codes("l")
        x, cnt = (table[name].combine_chunks().fill_null(0).to_numpy(zero_copy_only=False) for name in ("x", "cnt"))
        n = table["n"].combine_chunks().fill_null(-1).to_numpy(zero_copy_only=False)
        stop = table["stop"].drop_null()[0].as_py()

        def columns(code, at):
            # places and cumulative shares by column: the border row comes first; a column without values has no shares
            inside = n[at] < 0
            order = at[np.lexsort((x[at], inside, code[at]))]
            firsts = np.flatnonzero(n[order] >= 0).tolist()
            out = {}
            for a, b in zip(firsts, [*firsts[1:], len(order)], strict=True):
                rows = order[a:b]
                size = n[rows[0]]
                out[int(code[rows[0]])] = x[rows], np.cumsum(cnt[rows]) / size if size else None
            return out

        def area(d, w):
            # a width without end counts only if the difference is not 0
            return float(d @ w) if np.isfinite(w).all() else float(np.sum(d[d != 0] * w[d != 0]))

        def widths(x):
            following = np.append(x[1:], stop)
            return np.subtract(following, x, out=np.zeros(len(x)), where=following != x)

        known = {}

        def aside(side, key, steps, c):
            # steps beside a constant; against a column without values (None) a column counts up to its last value
            if (side, key, c) not in known:
                v = np.zeros(1) if steps[1] is None else steps[1]
                known[side, key, c] = area(np.where(v < 1, v, 0.0) if c is None else np.abs(v - c), widths(steps[0]))
            return known[side, key, c]

        def between(a, b):
            # steps beside steps; both start at the border, so the width after the first place is 0
            x = np.concatenate([a[0], b[0]])
            order = np.argsort(x, kind="stable")  # two sorted runs
            i = np.cumsum(order < len(a[0]))
            return area(np.abs(a[1][i - 1] - b[1][np.arange(1, len(x) + 1) - i - 1])[1:], widths(x[order][1:]))

        def constant(steps):
            return None if steps[1] is None else float(steps[1][0])

        left, right = columns(u, np.flatnonzero((u >= 0) & (l < 0))), columns(l, np.flatnonzero((u < 0) & (l >= 0)))
        paired = np.flatnonzero((u >= 0) & (l >= 0))
        found = []
        for i, j in zip(u[paired].tolist(), l[paired].tolist(), strict=True):
            a, b = left[i], right[j]
            if len(b[0]) == 1:
                found.append(aside(0, i, a, constant(b)))
            elif len(a[0]) == 1:
                found.append(aside(1, j, b, constant(a)))
            else:
                found.append(between(a, b))
        return table.select(["u", "l"]).take(pa.array(paired)).append_column("emd", pa.array(found, pa.float64()))

    return areas


def _line_blocks(rows: DataFrame, values: int) -> tuple[DataFrame, DataFrame]:
    """(rows with their block of the line, (block, start, stop)): blocks follow x and hold about ``values`` rows."""
    rows = cut(rows)
    many = rows.count()
    if many <= values:
        placed = rows.withColumn("block", F.lit(0))
    else:
        placed = cut(rows.repartitionByRange(-(-many // values), "x").withColumn("block", F.spark_partition_id()))
    ends = placed.groupBy("block").agg(F.min("x").alias("start"), F.max("x").alias("most"))
    along = Window.orderBy("block")  # one row per block
    return placed, cut(ends.select("block", "start", F.coalesce(F.lead("start").over(along), "most").alias("stop")))


def block_distances(pairs: DataFrame, left: DataFrame, right: DataFrame, hot_rows: int = HOT_ROWS, side: int = SIDE) -> DataFrame:
    """``emd_of_pairs`` for columns with many pairs each.

    The line is cut into blocks of values and the pairs into cells of at most ``side`` columns either way. A column's values travel once to each cell
    it has a pair in, not once per pair, together with its count before the block; a task merges the columns of a cell in one block, and the areas of a pair add up over the blocks.
    """
    pairs = cut(pairs.select("u", "l").where("u IS NOT NULL AND l IS NOT NULL"))
    sides = (("u", left), ("l", right))
    used = [cut(pairs.groupBy(name).agg(F.count(F.lit(1)).alias("pairs"))) for name, _ in sides]
    at = [F.pmod(F.xxhash64(name), F.lit(max(1, -(-many.count() // side)))) for (name, _), many in zip(sides, used, strict=True)]
    values = [
        hist.select(F.col("dataset_id").alias(name), "x", "cnt").join(many.select(name), name, "left_semi") for (name, hist), many in zip(sides, used, strict=True)
    ]
    none = [F.lit(None).cast(pairs.schema[name].dataType).alias(name) for name, _ in sides]
    rows = values[0].select("u", none[1], "x", "cnt").unionByName(values[1].select(none[0], "l", "x", "cnt"))
    placed, blocks = _line_blocks(rows, max(1, min(hot_rows, VALUES)))
    celled = pairs.select("u", "l", at[0].alias("i"), at[1].alias("j"))
    shape = ["i", "j", "block", "u", "l", "x", "cnt", "n", "stop"]
    long, real = F.lit(None).cast("long"), F.lit(None).cast("double")
    parts, sizes = [], []
    for (name, _), many in zip(sides, used, strict=True):
        other = none[1 - len(sizes)]
        mine = placed.where(F.col(name).isNotNull())
        held = cut(mine.groupBy(name, "block").agg(F.sum("cnt").cast("long").alias("cnt")))
        total = held.groupBy(name).agg(F.sum("cnt").alias("n"))
        before = Window.partitionBy(name).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
        borders = many.select(name).crossJoin(F.broadcast(blocks)).join(held, [name, "block"], "left")
        borders = borders.withColumn("cnt", F.coalesce(F.sum("cnt").over(before), F.lit(0))).join(total, name, "left")
        borders = borders.select(name, other, "block", F.col("start").cast("double").alias("x"), "cnt", F.coalesce("n", F.lit(0)).alias("n"), F.col("stop").cast("double").alias("stop"))
        marks = mine.select(name, other, "block", F.col("x").cast("double").alias("x"), F.col("cnt").cast("long").alias("cnt"), long.alias("n"), real.alias("stop"))
        parts.append(borders.unionByName(marks).join(celled.select(name, "i", "j").distinct(), name).select(shape))
        sizes.append(total)
    # a pair of two columns without values has no distance
    met = celled.join(sizes[0].select("u", F.lit(1).alias("a")), "u", "left").join(sizes[1].select("l", F.lit(1).alias("b")), "l", "left").where("a IS NOT NULL OR b IS NOT NULL")
    asked = met.crossJoin(F.broadcast(blocks.select("block"))).select("i", "j", "block", "u", "l", real.alias("x"), long.alias("cnt"), long.alias("n"), real.alias("stop"))
    whole = parts[0].unionByName(parts[1]).unionByName(asked)
    cells = celled.select("i", "j").distinct().count() * blocks.count()
    dealt = whole.repartition(max(1, min(cells, MOST_TASKS)), "i", "j", "block")  # the work of a cell is more than its bytes tell
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}
    areas = dealt.groupBy("i", "j", "block").applyInArrow(_block_areas(), f"u {kinds['u']}, l {kinds['l']}, emd double")
    return areas.groupBy("u", "l").agg(F.sum("emd").alias("emd"))


def emd_of_pairs(pairs: DataFrame, left: DataFrame, right: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Distance of each pair ``(u, l)`` of columns; ``left`` and ``right`` are histograms by dataset_id.

    A few pairs carry the values of both columns each; where values would be copied more than ``COPIES`` times, columns are compared in blocks.
    """
    sizes = [h.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("dataset_id").alias(name), F.col("n").alias(f"n_{name}")) for name, h in (("u", left), ("l", right))]
    asked = pairs.select("u", "l").join(sizes[0], "u", "left").join(sizes[1], "l", "left").fillna(0, ["n_u", "n_l"])
    held = [asked.groupBy(name).agg(F.first(f"n_{name}").alias("n"), F.sum(f"n_{name}").alias("copied")) for name in ("u", "l")]
    met = held[0].select("n", "copied").unionByName(held[1].select("n", "copied")).agg(F.sum("n").alias("n"), F.sum("copied").alias("copied")).first()
    if (met["copied"] or 0) > COPIES * (met["n"] or 0):
        return block_distances(pairs, left, right, hot_rows)
    lw = shares(left, ["dataset_id"]).withColumnRenamed("dataset_id", "u")
    rw = shares(right, ["dataset_id"]).withColumnRenamed("dataset_id", "l")
    weights = (
        pairs.select("u", "l").join(lw, "u").select("u", "l", "x", "w")
        .unionByName(pairs.select("u", "l").join(rw, "l").select("u", "l", "x", (-F.col("w")).alias("w")))
    )
    # a pair has at most the different values of both sides, which is cheap to know beforehand
    return emd(weights, ["u", "l"], hot_rows, _most_values(left) + _most_values(right))


def constant_distances(pairs: DataFrame, labeled: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(u, l, emd) for pairs ``(u, l, c)`` of a column with the one value c and a histogram.

    The distance of a constant is the mean of |x - c|. With the share W and the weighted sum S of the values up to c, all taken from the
    histogram's mean, it is c (2 W - 1) - 2 S, so each constant only looks up the running sums at its place: one ordered pass over
    the histogram, however many constants there are.
    """
    hist = shares(labeled, ["dataset_id"]).select(F.col("dataset_id").alias("l"), "x", "w")
    hist = cut(hist.join(pairs.select("l").distinct(), "l", "left_semi"))
    mean = cut(hist.groupBy("l").agg(F.sum(F.col("w") * F.col("x")).alias("__mean")))
    marks = hist.join(mean, "l").select("l", (F.col("x") - F.col("__mean")).alias("x"), F.lit(0).alias("asks"), F.lit("").alias("u"), "w")
    asks = pairs.join(mean, "l").select("l", (F.col("c") - F.col("__mean")).alias("x"), F.lit(1).alias("asks"), F.col("u").cast("string"), F.lit(0.0).alias("w"))
    sums = {"__share": F.col("w"), "__sum": F.col("w") * F.col("x")}
    upto = running(marks.unionByName(asks), ["l"], ["x", "asks", "u"], sums, hot_rows=hot_rows).where("asks = 1")
    found = F.col("x") * (2 * F.col("__share") - 1) - 2 * F.col("__sum")
    return upto.select("u", "l", F.greatest(found, F.lit(0.0)).alias("emd"))


def distances(pairs: DataFrame, left: DataFrame, right: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``emd_of_pairs`` where columns of ``left`` with one value only look their distance up. ``pairs`` is read more than once."""
    single = left.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("c")).where("n = 1")
    single = cut(single.select(F.col("dataset_id").alias("u"), "c"))
    pairs = pairs.select("u", "l")
    if single.isEmpty():
        return emd_of_pairs(pairs, left, right, hot_rows)
    full = emd_of_pairs(pairs.join(single, "u", "left_anti"), left, right, hot_rows)
    return full.unionByName(constant_distances(pairs.join(single, "u"), right, hot_rows))


def _most_values(hist: DataFrame) -> int:
    sizes = hist.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.max("n").alias("n")).first()["n"] or 0


def moments(hist: DataFrame) -> DataFrame:
    """n, mean and sample deviation per column (deviation NULL for a single value)."""
    base = hist.groupBy("dataset_id").agg(F.sum("cnt").alias("n"), (F.sum(F.col("cnt") * F.col("x")) / F.sum("cnt")).alias("mean"))
    dev = hist.join(base, "dataset_id").groupBy("dataset_id").agg(
        F.first("n").alias("n"), F.first("mean").alias("mean"), F.sum(F.col("cnt") * (F.col("x") - F.col("mean")) ** 2).alias("ss")
    )
    return dev.select("dataset_id", "n", "mean", F.when(F.col("n") > 1, F.sqrt(F.col("ss") / (F.col("n") - 1))).alias("std"))


def near_means(unlabeled: DataFrame, labeled: DataFrame, reach: Column) -> DataFrame:
    """Pairs ``(u, l)`` of columns whose means differ by less than ``reach`` of the unlabeled column.

    Means differ by at most the distance of the columns, so every pair with distance under the reach is
    kept. The band join becomes an equality join: each unlabeled column picks the cell width (a power of
    two above its reach), labeled columns enter each width in use, and only neighbouring cells meet.
    """
    u = unlabeled.withColumn("__reach", reach.cast("double")).where(F.col("__reach") > 0)
    level = F.ceil(F.log2(F.col("__reach"))).cast("int")
    u = u.select(F.col("dataset_id").alias("u"), F.col("mean").alias("mu"), "__reach", level.alias("level"))
    levels = [r.level for r in u.select("level").distinct().collect()]  # at most as many as a double has exponents
    width = F.pow(F.lit(2.0), F.col("level"))
    lab = labeled.select(F.col("dataset_id").alias("l"), F.col("mean").alias("ml"), F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>")).alias("level"))
    lab = lab.withColumn("cell", F.floor(F.col("ml") / width))
    cells = u.withColumn("cell", F.explode(F.array(*[F.floor(F.col("mu") / width) + d for d in (-1, 0, 1)])))
    close = cells.join(lab, ["level", "cell"]).where(F.abs(F.col("mu") - F.col("ml")) < F.col("__reach"))
    return close.select("u", "l")


def nearest_labeled(scored: DataFrame, types: DataFrame) -> DataFrame:
    """Nearest labeled column per unlabeled one and how many types share the smallest distance.

    ``scored(u, l, emd)``; ``types(dataset_id, semantic_type)`` of the labeled columns.
    """
    typed = scored.join(types.select(F.col("dataset_id").alias("l"), "semantic_type"), "l").withColumn(
        "d", F.round("emd", TIE_DIGITS)
    )
    best = typed.groupBy("u").agg(F.min("d").alias("d"))
    at = typed.join(best, ["u", "d"])
    return at.groupBy("u").agg(
        F.min("emd").alias("emd"), F.min("l").alias("l"), F.min("semantic_type").alias("semantic_type"),
        F.count_distinct("semantic_type").alias("n_types"),
    )


def column_classes(hist: DataFrame) -> DataFrame:
    """(dataset_id, rep): columns with the same values in the same shares are named by their smallest id."""
    row = [F.xxhash64(F.lit(seed), "x", "w").cast("decimal(38,0)") for seed in (1, 2)]
    shape = shares(hist, ["dataset_id"]).groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n"), *[F.sum(h).alias(f"h{i}") for i, h in enumerate(row)])
    reps = shape.groupBy("n", "h0", "h1").agg(F.min("dataset_id").alias("rep"))
    return shape.join(reps, ["n", "h0", "h1"]).select("dataset_id", "rep")


def _of_reps(hist: DataFrame, classes: DataFrame) -> DataFrame:
    return hist.join(classes.where("dataset_id = rep").select("dataset_id"), "dataset_id", "left_semi")


def band_pairs(unlabeled: DataFrame, labeled: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(u, l, emd) of pairs among which are, for every column of ``unlabeled``, all nearest columns of ``labeled``.

    Labeled columns are numbered by their means, and each unlabeled one finds its place among them. Its band holds the ``step`` means on either side
    and doubles each round. Means differ by at most the distance, so a column is done as soon as the gaps to the next means outside its band exceed
    the best distance found; inside the band only pairs whose gap can still reach that are measured. Rounds grow
    with the logarithm of the number of labeled columns.
    """
    mu = cut(moments(unlabeled)).select(F.col("dataset_id").alias("u"), F.col("mean").alias("mu"))
    ml = cut(moments(labeled)).select(F.col("dataset_id").alias("l"), F.col("mean").alias("ml"))
    marks = cut(position(ml, [], ["ml", "l"], "at", hot_rows))
    both = ml.select(F.lit(0).alias("asks"), F.col("l").alias("id"), F.col("ml").alias("x")).unionByName(mu.select(F.lit(1).alias("asks"), F.col("u").alias("id"), F.col("mu").alias("x")))
    placed = running(both, [], ["x", "asks", "id"], {"place": F.when(F.col("asks") == 0, 1).otherwise(0).cast("long")}, hot_rows=hot_rows)
    todo = cut(placed.where("asks = 1").select(F.col("id").alias("u"), F.col("x").alias("mu"), "place", F.lit(float("inf")).alias("best")))
    slack = F.lit(1e-8) + 1e-11 * F.abs("mu")  # distances that are equal after rounding count as ties
    scored, step, half = [], 1, 0
    while True:
        lower = F.sequence(F.col("place") - step + 1, F.col("place") - half)
        upper = F.sequence(F.col("place") + half + 1, F.col("place") + step)
        near = todo.select("u", "mu", "best", F.explode(F.concat(lower, upper)).alias("at")).join(marks, "at")
        near = cut(near.where(F.abs(F.col("mu") - F.col("ml")) <= F.col("best") + slack).select("u", "l"))
        found = cut(distances(near, unlabeled, labeled, hot_rows))
        scored.append(found)
        least = found.groupBy("u").agg(F.min("emd").alias("found"))
        todo = todo.join(least, "u", "left").withColumn("best", F.least("best", F.coalesce("found", F.lit(float("inf"))))).drop("found")
        outside = F.array(F.col("place") - step, F.col("place") + step + 1)
        gaps = todo.select("u", "mu", F.explode(outside).alias("at")).join(marks, "at").groupBy("u").agg(F.min(F.abs(F.col("mu") - F.col("ml"))).alias("gap"))
        todo = cut(todo.join(gaps, "u").where(F.col("gap") <= F.col("best") + slack).drop("gap"))
        if todo.isEmpty():
            return reduce(DataFrame.unionByName, scored)
        step, half = 2 * step, step


def nearest(unlabeled: DataFrame, labeled: DataFrame, types: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``nearest_labeled`` of every unlabeled column, exact, without comparing all pairs. Columns of equal shares are compared once."""
    cu, cl = cut(column_classes(unlabeled)), cut(column_classes(labeled))
    scored = band_pairs(cut(_of_reps(unlabeled, cu)), cut(_of_reps(labeled, cl)), hot_rows)
    kinds = types.select("dataset_id", "semantic_type").join(cl, "dataset_id").select(F.col("rep").alias("dataset_id"), "semantic_type").distinct()
    best = nearest_labeled(scored, kinds).withColumnRenamed("u", "rep")
    return best.join(cu, "rep").select(F.col("dataset_id").alias("u"), "emd", "l", "semantic_type", "n_types")


def cross_compare(unlabeled: DataFrame, labeled: DataFrame, hot_rows: int = HOT_ROWS, block: int = BLOCK) -> DataFrame:
    """(u, l, emd) of every unlabeled column with every labeled one.

    All pairs are the result here. They meet in blocks of labeled columns, classes of equal columns are measured once, and the distances are joined to the members.
    """
    cu, cl = cut(column_classes(unlabeled)), cut(column_classes(labeled))
    us, ls = cu.select(F.col("rep").alias("u")).distinct(), cl.select(F.col("rep").alias("l")).distinct()
    blocks = max(1, -(-ls.count() // block))
    right = ls.withColumn("b", F.pmod(F.xxhash64("l"), F.lit(blocks)))
    left = us.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    found = distances(cut(left.join(right, "b").select("u", "l")), cut(_of_reps(unlabeled, cu)), cut(_of_reps(labeled, cl)), hot_rows)
    mine, theirs = cu.select(F.col("rep").alias("u"), F.col("dataset_id").alias("uu")), cl.select(F.col("rep").alias("l"), F.col("dataset_id").alias("ll"))
    return found.join(mine, "u").join(theirs, "l").select(F.col("uu").alias("u"), F.col("ll").alias("l"), "emd")


def _voted(best: DataFrame, unlabeled: DataFrame) -> DataFrame:
    held = best.join(moments(unlabeled).select(F.col("dataset_id").alias("u"), "std"), "u")
    return held.select(F.col("u").alias("dataset_id"), "l", F.col("semantic_type").alias("label"), "emd", "n_types", "std")


def nearest_within(unlabeled: DataFrame, labeled: DataFrame, types: DataFrame, factor: float, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Nearest labeled column of every unlabeled one that has any within ``factor`` times its deviation:
    (dataset_id, l, label, emd, n_types, std).

    Columns of a single cell have no deviation and hence no reach; they get their nearest column at any distance.
    """
    mu, ml = cut(moments(unlabeled)), cut(moments(labeled))
    pairs = cut(near_means(mu.where("std is not null"), ml, F.lit(factor) * F.col("std")))
    best = nearest_labeled(distances(pairs, unlabeled, labeled, hot_rows), types)
    single = cut(unlabeled.join(mu.where("std is null").select("dataset_id"), "dataset_id", "left_semi"))
    return _voted(best.unionByName(nearest(single, labeled, types, hot_rows).select(*best.columns)), unlabeled)


def nearest_related(
    unlabeled: DataFrame,
    labeled: DataFrame,
    types: DataFrame,
    factor: float,
    u_tables: DataFrame,
    l_tables: DataFrame,
    mode: int = 0,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``nearest_within`` among numeric columns of other tables that share a labeled text type with the column's table (mode 0), and
    also of tables without any labeled text column (mode 1).

    ``u_tables(dataset_id, table_id)``; ``l_tables(dataset_id, table_id, semantic_type, kind)`` of all labeled columns. Pairs come from the band of means first
    and are then checked for a shared type, so related tables are never multiplied out; only columns of a single cell meet all of them.
    """
    text = l_tables.where("kind = 'text'").select("table_id", "semantic_type").distinct()
    numeric = l_tables.where("kind = 'numeric'").select(F.col("dataset_id").alias("l"), F.col("table_id").alias("lt"))
    u_types = cut(u_tables.join(text, "table_id").select(F.col("dataset_id").alias("u"), F.col("table_id").alias("ut"), "semantic_type"))
    l_types = cut(numeric.join(text.withColumnRenamed("table_id", "lt"), "lt").select("l", "lt", "semantic_type"))
    mu, ml = cut(moments(unlabeled)), cut(moments(labeled))
    near = cut(near_means(mu.where("std is not null"), ml, F.lit(factor) * F.col("std")))
    single = cut(mu.where("std is null").select(F.col("dataset_id").alias("u")))
    related = near.join(u_types, "u").join(l_types, ["l", "semantic_type"]).where("ut <> lt").select("u", "l")
    of_single = u_types.join(single, "u", "left_semi").join(l_types, "semantic_type").where("ut <> lt").select("u", "l")
    pairs = related.unionByName(of_single)
    alone = cut(numeric.join(tables_without_text(l_tables).withColumnRenamed("table_id", "lt"), "lt", "left_semi").select("l"))
    if mode == 1:
        pairs = pairs.unionByName(near.join(alone, "l", "left_semi"))
    scored = distances(cut(pairs.distinct()), unlabeled, labeled, hot_rows)
    if mode == 1:
        mine = unlabeled.join(single.withColumnRenamed("u", "dataset_id"), "dataset_id", "left_semi")
        theirs = labeled.join(alone.withColumnRenamed("l", "dataset_id"), "dataset_id", "left_semi")
        scored = scored.unionByName(band_pairs(cut(mine), cut(theirs), hot_rows))
    return _voted(nearest_labeled(scored, types), unlabeled)


def _passes(best: DataFrame, factor: float) -> DataFrame:
    keep = (F.col("n_types") == 1) & (F.col("std").isNull() | (F.round("emd", 9) < F.round(F.lit(factor) * F.col("std"), 9)))
    return best.where(keep).select("dataset_id", "label", "emd")


def lf_numeric_emd(unlabeled: DataFrame, labeled: DataFrame, types: DataFrame, factor: float = 0.01, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Vote of the nearest labeled numeric column: (dataset_id, label, emd).

    Abstains (no row) if the best distance reaches ``factor`` times the column's deviation or if
    different types tie for it. A column with a single value has no deviation and hence no threshold.
    """
    return _passes(nearest_within(unlabeled, labeled, types, factor, hot_rows), factor)


def lf_numeric_emd_pruned(
    unlabeled: DataFrame, labeled: DataFrame, types: DataFrame, factor: float, u_tables: DataFrame, l_tables: DataFrame, mode: int = 0, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """``lf_numeric_emd`` against the columns of related tables only, see ``nearest_related``."""
    return _passes(nearest_related(unlabeled, labeled, types, factor, u_tables, l_tables, mode, hot_rows), factor)


def related_tables(labels: DataFrame) -> DataFrame:
    """Pairs of tables that share labeled text types, with the number of shared types.

    Tables with one and the same set of types form a class, so the self join runs over classes;
    ``labels(table_id, semantic_type)``.
    """
    typed = labels.select("table_id", "semantic_type").distinct()
    classes = typed.groupBy("table_id").agg(F.concat_ws("|", F.array_sort(F.collect_list("semantic_type"))).alias("cls"))
    members = typed.join(classes, "table_id").select("cls", "semantic_type").distinct()
    a = members.select(F.col("cls").alias("c1"), "semantic_type")
    b = members.select(F.col("cls").alias("c2"), "semantic_type")
    shared = a.join(b, "semantic_type").groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("shared"))
    t1 = classes.select(F.col("table_id").alias("t1"), F.col("cls").alias("c1"))
    t2 = classes.select(F.col("table_id").alias("t2"), F.col("cls").alias("c2"))
    return shared.join(t1, "c1").join(t2, "c2").where("t1 <> t2").select("t1", "t2", "shared")


def tables_without_text(labels: DataFrame) -> DataFrame:
    """Tables with labeled numeric columns and no labeled text column; ``labels(table_id, kind)``."""
    g = labels.groupBy("table_id").agg(F.count_if(F.col("kind") == "numeric").alias("n"), F.count_if(F.col("kind") == "text").alias("t"))
    return g.where("n > 0 and t = 0").select("table_id")


# --- distances of the attributes of two tables ----------------------------------------------------


def attribute_values(df: DataFrame, numeric: list[str], strings: list[str]) -> DataFrame:
    """(strings.., attr, x, cnt): histogram of every numeric attribute within each group of string values."""
    kept = df.dropna(subset=strings) if strings else df
    pairs = ", ".join(f"'{c}', cast(`{c}` as double)" for c in numeric)
    long = kept.selectExpr(*[f"`{s}`" for s in strings], f"stack({len(numeric)}, {pairs}) as (attr, x)").where("x is not null")
    return long.groupBy(*strings, "attr", "x").agg(F.count(F.lit(1)).alias("cnt"))


def _pair_weights(o: DataFrame, i: DataFrame, keys: list[str], o_attrs: list[str], i_attrs: list[str]) -> DataFrame:
    """Signed weights of all attribute pairs; the attribute lists come from the schemas of two tables."""
    left = o.withColumn("i_attr", F.explode(F.array(*[F.lit(a) for a in i_attrs]))).withColumnRenamed("attr", "o_attr")
    right = i.withColumn("o_attr", F.explode(F.array(*[F.lit(a) for a in o_attrs]))).withColumnRenamed("attr", "i_attr")
    cols = [*keys, "o_attr", "i_attr", "x", "w"]
    return left.select(*cols).unionByName(right.withColumn("w", -F.col("w")).select(*cols))


def emd_no_join(outer: DataFrame, inner: DataFrame, o_attrs: list[str], i_attrs: list[str]) -> DataFrame:
    """Distance of every numeric attribute of one table to every one of the other."""
    o = shares(attribute_values(outer, o_attrs, []), ["attr"])
    i = shares(attribute_values(inner, i_attrs, []), ["attr"])
    return emd(_pair_weights(o, i, [], o_attrs, i_attrs), ["o_attr", "i_attr"])


def emd_joined(
    outer: DataFrame, inner: DataFrame, strings: list[str], attrs: list[str], max_group_size: int | None = None
) -> DataFrame:
    """Distances after the inner join on all shared string columns, without building the joined rows.

    In the join a row of the outer table appears once per inner row of its group, so its weight is the
    inner group's size (and the other way round). Groups whose joined size exceeds ``max_group_size``
    are left out when that is given.
    """
    complete_o, complete_i = outer.dropna(subset=[*strings, *attrs]), inner.dropna(subset=[*strings, *attrs])
    n_o = complete_o.groupBy(*strings).agg(F.count(F.lit(1)).alias("n_o"))
    n_i = complete_i.groupBy(*strings).agg(F.count(F.lit(1)).alias("n_i"))
    groups = n_o.join(n_i, strings)
    if max_group_size is not None:
        groups = groups.where(F.col("n_o") * F.col("n_i") <= max_group_size)

    def side(df, times):
        h = attribute_values(df, attrs, strings).join(groups, strings)
        return shares(h.groupBy("attr", "x").agg(F.sum(F.col("cnt") * F.col(times)).alias("cnt")), ["attr"])

    return emd(_pair_weights(side(complete_o, "n_i"), side(complete_i, "n_o"), [], attrs, attrs), ["o_attr", "i_attr"])


def group_emd(
    outer: DataFrame,
    inner: DataFrame,
    strings: list[str],
    attrs: list[str],
    how: str = "mean",
    max_group_size: int | None = None,
) -> DataFrame:
    """Distance within each join group, reduced over the groups by mean, median or min.

    Within a group the join repeats all values of a side equally often, so the group's own shares do.
    """
    complete_o, complete_i = outer.dropna(subset=[*strings, *attrs]), inner.dropna(subset=[*strings, *attrs])
    n_o = complete_o.groupBy(*strings).agg(F.count(F.lit(1)).alias("n_o"))
    n_i = complete_i.groupBy(*strings).agg(F.count(F.lit(1)).alias("n_i"))
    groups = n_o.join(n_i, strings)
    if max_group_size is not None:
        groups = groups.where(F.col("n_o") * F.col("n_i") <= max_group_size)
    keys = strings + ["attr"]
    o = shares(attribute_values(complete_o, attrs, strings).join(groups, strings, "left_semi"), keys)
    i = shares(attribute_values(complete_i, attrs, strings).join(groups, strings, "left_semi"), keys)
    per_group = emd(_pair_weights(o, i, strings, attrs, attrs), [*strings, "o_attr", "i_attr"])
    merged = {"mean": F.avg, "median": F.median, "min": F.min}[how]
    return per_group.groupBy("o_attr", "i_attr").agg(merged("emd").alias("emd"), F.count(F.lit(1)).alias("n_groups"))


def lf_group_emd_correlated(
    cells: DataFrame, unlabeled: DataFrame, labeled: DataFrame, most_distinct: float = 0.1, alpha: float = 0.05, how: str = "mean"
) -> DataFrame:
    """Nearest labeled numeric column by the distance within groups of the text columns that go with a column.

    For each unlabeled numeric column the labeled text columns of its table count that have few different
    values (at most ``most_distinct`` of the rows) and whose groups differ in the column (Kruskal-Wallis
    p below ``alpha``). Tables that have all their types are grouped by the same types, and the distances
    of equal groups are reduced by mean, median or min. ``cells(dataset_id, table_id, row_id, value)``;
    ``unlabeled(dataset_id)`` numeric; ``labeled(dataset_id, table_id, semantic_type, kind)``. Result:
    (dataset_id, label, emd, n_groups).
    """
    from .corpus import numeric_cells
    from .joins import having_all_per_query
    from .stats import kruskal_wallis

    text = labeled.where("kind = 'text'").select("dataset_id", "semantic_type")
    texts = cells.where("value is not null").join(text, "dataset_id").select("table_id", "row_id", F.col("dataset_id").alias("g"), "semantic_type", "value")
    size = texts.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    kinds = texts.select("g", "value").distinct().groupBy("g").agg(F.count(F.lit(1)).alias("d"))
    few = size.join(kinds, "g").where(F.col("d") <= most_distinct * F.col("n")).select("g")
    texts = cut(texts.join(few, "g", "left_semi"))
    numbers = numeric_cells(cells)
    mine = cut(numbers.join(unlabeled.select("dataset_id"), "dataset_id", "left_semi").select("table_id", "row_id", F.col("dataset_id").alias("u"), "x"))
    samples = mine.join(texts, ["table_id", "row_id"]).select("u", "g", "value", "x")
    chosen = cut(kruskal_wallis(samples, ["u", "g"], "value").where(F.col("p") < alpha).select("u", "g"))
    wanted = cut(chosen.join(text.withColumnRenamed("dataset_id", "g"), "g").select("u", "semantic_type").distinct())
    tables = having_all_per_query(texts.select("table_id", "semantic_type").distinct(), "table_id", "semantic_type", wanted, "u")
    own = unlabeled.select(F.col("dataset_id").alias("u"), F.regexp_extract("dataset_id", r"^(.*)\+column_\d+$", 1).alias("home"))
    tables = cut(tables.join(own, "u").where("table_id <> home").select("u", "table_id"))
    # the group of a row: its values of the wanted types, one entry per type
    key = F.to_json(F.array_sort(F.collect_set(F.struct("semantic_type", "value"))))
    u_rows = mine.select("u", "table_id", "row_id").join(chosen, "u").join(texts, ["table_id", "row_id", "g"]).groupBy("u", "row_id").agg(key.alias("grp"))
    left = mine.join(u_rows, ["u", "row_id"]).groupBy("u", "grp", "x").agg(F.count(F.lit(1)).alias("cnt"))
    l_rows = tables.join(wanted, "u").join(texts, ["table_id", "semantic_type"]).groupBy("u", "table_id", "row_id").agg(key.alias("grp"))
    theirs = numbers.join(labeled.where("kind = 'numeric'").select("dataset_id"), "dataset_id", "left_semi")
    right = theirs.select("table_id", "row_id", F.col("dataset_id").alias("l"), "x").join(l_rows, ["table_id", "row_id"])
    right = cut(right.groupBy("u", "l", "grp", "x").agg(F.count(F.lit(1)).alias("cnt")))
    met = right.select("u", "l", "grp").distinct().join(left.select("u", "grp").distinct(), ["u", "grp"])
    lw = met.join(shares(left, ["u", "grp"]), ["u", "grp"]).select("u", "l", "grp", "x", "w")
    rw = shares(right, ["u", "l", "grp"]).join(met, ["u", "l", "grp"], "left_semi").select("u", "l", "grp", "x", (-F.col("w")).alias("w"))
    per_group = emd(lw.unionByName(rw), ["u", "l", "grp"])
    merged = {"mean": F.avg, "median": F.median, "min": F.min}[how]
    scored = cut(per_group.groupBy("u", "l").agg(merged("emd").alias("emd"), F.count(F.lit(1)).alias("n_groups")))
    best = nearest_labeled(scored, labeled).where("n_types = 1")
    return best.join(scored.select("u", "l", "n_groups"), ["u", "l"]).select(F.col("u").alias("dataset_id"), F.col("semantic_type").alias("label"), "emd", "n_groups")
