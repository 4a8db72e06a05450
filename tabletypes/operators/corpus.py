"""From wide tables to the long cells form; column filters, samples and splits.

Frames used throughout:

* ``cells(dataset_id, table_id, col_idx, row_id, value)`` - one row per cell, values as text
* ``columns(dataset_id, table_id, col_idx, header)`` - one row per column
* ``gold(dataset_id, table_id, col_idx, semantic_type)`` - known types
* ``splits(dataset_id, split)`` - labeled, unlabeled, test
"""

from __future__ import annotations

from collections.abc import Iterator
from math import pi

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..plans.ordered import position, running, top
from ..plans.session import cut


def to_cells(df: DataFrame, table: Column, row_id: Column, columns: dict[str, Column] | list[str]) -> DataFrame:
    """Wide to long. Only the named columns are read; each becomes column 0, 1, ... of its table."""
    picked = columns if isinstance(columns, dict) else {c: F.col(c) for c in columns}
    wide = df.select(
        table.alias("table_id"),
        row_id.alias("row_id"),
        *[c.cast("string").alias(f"c{i}") for i, c in enumerate(picked.values())],
    )
    pairs = ", ".join(f"{i}, c{i}" for i in range(len(picked)))
    long = wide.selectExpr("table_id", "row_id", f"stack({len(picked)}, {pairs}) as (col_idx, value)")
    return long.select(S.column_id("table_id", "col_idx").alias("dataset_id"), "table_id", "col_idx", "row_id", "value")


def filter_tables(columns: DataFrame, least: int = 1, most: int | None = None, exact: int | None = None) -> DataFrame:
    """Columns of the tables whose number of columns lies in the range (or equals ``exact``)."""
    width = columns.groupBy("table_id").agg(F.count_distinct("col_idx").alias("width"))
    keep = F.col("width") == exact if exact is not None else F.col("width") >= least
    if most is not None and exact is None:
        keep = keep & (F.col("width") <= most)
    return columns.join(width.where(keep).select("table_id"), "table_id", "left_semi")


def valid_headers(columns: DataFrame, types: DataFrame, most_fields: int = 10_000) -> DataFrame:
    """Columns whose canonical header is in the vocabulary, from tables of at most ``most_fields`` columns."""
    kept = filter_tables(columns, 1, most_fields)
    named = kept.withColumn("semantic_type", S.canonical_header("header"))
    return named.join(types.select("semantic_type").distinct(), "semantic_type", "inner").select(
        "dataset_id", "table_id", "col_idx", "header", "semantic_type"
    )


def header_lists(valid: DataFrame) -> DataFrame:
    """Per table the sorted field numbers and their types (a table has a bounded number of fields)."""
    packed = valid.groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("col_idx", "semantic_type"))).alias("f"))
    return packed.select("table_id", F.col("f.col_idx").alias("field_list"), F.col("f.semantic_type").alias("field_names"))


def project_columns(cells: DataFrame, keep: DataFrame) -> DataFrame:
    """Cells of the listed columns; survivors are numbered 0..k-1 per table in ``new_idx``."""
    listed = keep.select("dataset_id").distinct().select("dataset_id", *S_parse("dataset_id"))
    w = Window.partitionBy("table_id").orderBy("col_idx")
    renumbered = listed.withColumn("new_idx", F.row_number().over(w) - 1).select("dataset_id", "new_idx")
    return cells.join(renumbered, "dataset_id", "inner")


def S_parse(dataset_id: str) -> list[Column]:
    table, idx = S.parse_column_id(dataset_id)
    return [table.alias("table_id"), idx.alias("col_idx")]


def drop_null_cells(cells: DataFrame) -> DataFrame:
    return cells.where(F.col("value").isNotNull())


def drop_sparse_rows(cells: DataFrame) -> DataFrame:
    """Cells of the rows that have a value in every column present."""
    holed = cells.where(F.col("value").isNull()).select("table_id", "row_id").distinct()
    return cells.join(holed, ["table_id", "row_id"], "left_anti")


def drop_small_tables(cells: DataFrame, least: int) -> DataFrame:
    """Cells of the tables with at least ``least`` non-null cells."""
    size = cells.groupBy("table_id").agg(F.count("value").alias("n")).where(F.col("n") >= least)
    return cells.join(size.select("table_id"), "table_id", "left_semi")


SKETCH_ROWS = 200_000  # rows a map task holds in sketches


def _bottom(n: int, columns: list[str]):
    """Keep the ``n`` rows of least digest of each column of a task; rows are (columns.., __o) with the digest last."""

    def compact(rows: pa.Table) -> pa.Table:
        code = rows.column("dataset_id").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        order = pc.sort_indices(rows.append_column("__c", pa.array(code)), [("__c", "ascending"), ("__o", "ascending"), ("row_id", "ascending")]).to_numpy()
        code = code[order]
        place = np.arange(len(code)) - np.searchsorted(code, code)
        return rows.take(pa.array(order[place < n]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, fresh, waiting = None, [], 0
        for batch in batches:
            fresh.append(batch)
            waiting += batch.num_rows
            if waiting >= max(SKETCH_ROWS // 4, 0 if held is None else held.num_rows):
                new = pa.Table.from_batches(fresh)
                held, fresh, waiting = compact(new if held is None else pa.concat_tables([held, new])), [], 0
                if held.num_rows > SKETCH_ROWS:
                    yield from held.to_batches()
                    held = None
        if fresh or held is not None:
            parts = [held] if held is not None else []
            yield from compact(pa.concat_tables([*parts, pa.Table.from_batches(fresh)] if fresh else parts)).to_batches()

    return run


def sample_column(cells: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` cells per column, the same in every run: those of the least digest.

    Each task merges its cells into sketches of ``n`` rows per column without sorting them by column first; only the sketches are shuffled.
    """
    keyed = cells.withColumn("__o", S.seeded_order(seed, "dataset_id", "row_id"))
    sketches = keyed.mapInArrow(_bottom(n, keyed.columns), keyed.schema)
    return top(sketches, ["dataset_id"], [F.col("__o"), F.col("row_id")], n, "__r").drop("__o", "__r")


def sample_fraction(cells: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """About ``fraction`` of the cells of every column: a filter, no shuffle."""
    bound = format(min(int(fraction * 16**8), 16**8 - 1), "08x")
    return cells.where(F.substring(S.seeded_order(seed, "dataset_id", "row_id"), 1, 8) < bound)


def sample_with_replacement(cells: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` draws per column, a cell may be drawn more than once: the cells with ``draw``.

    A draw is a number up to the column's size. Which cell a number stands for does not matter, so the numbers drawn first, second, ... stand for the cells of
    a sample without replacement; no cell is numbered.
    """
    sizes = cells.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("__n"))
    draws = sizes.select("dataset_id", "__n", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("draw"))
    hashed = F.conv(F.substring(S.seeded_order(seed, "dataset_id", "draw"), 1, 8), 16, 10).cast("long")
    wanted = draws.select("dataset_id", "draw", (hashed % F.col("__n")).alias("number"))
    firsts = wanted.groupBy("dataset_id", "number").agg(F.min("draw").alias("first"))
    w = Window.partitionBy("dataset_id").orderBy("first")  # ``n`` rows at most
    firsts = firsts.withColumn("__r", F.row_number().over(w)).drop("first")
    keyed = sample_column(cells, n, seed).withColumn("__o", S.seeded_order(seed, "dataset_id", "row_id"))
    ranked = keyed.withColumn("__r", F.row_number().over(Window.partitionBy("dataset_id").orderBy("__o", "row_id"))).drop("__o")
    return wanted.join(firsts, ["dataset_id", "number"]).join(ranked, ["dataset_id", "__r"]).drop("number", "__r")


def numeric_cells(cells: DataFrame) -> DataFrame:
    """Cells that parse as a number, as ``x DOUBLE``."""
    x = F.col("value").try_cast("double")
    return cells.withColumn("x", x).where(F.col("x").isNotNull() & ~F.isnan("x")).drop("value")


NUMERIC_TYPES = ("tinyint", "smallint", "int", "integer", "bigint", "float", "double", "decimal")


def attribute_classes(columns: DataFrame) -> DataFrame:
    """Per column ``string``, ``numeric`` or ``neither`` from its declared type; computed fields are left out."""
    base = F.regexp_extract(F.lower("type"), r"^([a-z]+)", 1)
    kind = (
        F.when(base.isin("string", "varchar", "char"), "string")
        .when(base.isin(*NUMERIC_TYPES), "numeric")
        .otherwise("neither")
    )
    return columns.where(~F.col("header").startswith("Calculation")).withColumn("kind", kind)


def compare_schemas(columns: DataFrame, left: Column, right: Column) -> DataFrame:
    """Positions at which two sets of tables differ: every differing (name, type) with the table counts.

    Tables enter through their distinct (position, name, type) entries, so equal schemas are compared once.
    """
    entries = columns.groupBy("col_idx", "header", "type").agg(
        F.count_if(left).alias("n_left"), F.count_if(right).alias("n_right")
    )
    a = entries.where("n_left > 0").select("col_idx", F.col("header").alias("header_l"), F.col("type").alias("type_l"), "n_left")
    b = entries.where("n_right > 0").select("col_idx", F.col("header").alias("header_r"), F.col("type").alias("type_r"), "n_right")
    both = a.join(b, "col_idx", "full_outer")
    return both.where(~(F.col("header_l").eqNullSafe(F.col("header_r")) & F.col("type_l").eqNullSafe(F.col("type_r"))))


def add_gaussian_noise(df: DataFrame, columns: list[str], fraction: float, keys: list[str], seed: int = 0) -> DataFrame:
    """The rows, where a ``fraction`` of them has N(0, deviation of the column) added to each of ``columns``, with a flag ``noisy``.

    Rows are chosen, and their noise is made, from digests of the ``keys``; rows that share all keys share both. Nulls stay null; a column
    without a deviation gets no noise.
    """
    bound = format(min(int(fraction * 16**8), 16**8 - 1), "08x")
    spread = df.agg(*[F.stddev_samp(c).alias(f"__{c}") for c in columns])
    chosen = F.substring(S.seeded_order(seed, *keys), 1, 8) < bound

    def normal(i: int) -> Column:
        digest = S.seeded_order(seed + 1 + i, *keys)
        u, v = ((F.conv(F.substring(digest, at, 10), 16, 10).cast("double") + 1) / float(16**10) for at in (1, 11))
        return F.sqrt(-2 * F.log(u)) * F.cos(2 * pi * v)

    marked = df.crossJoin(F.broadcast(spread)).withColumn("noisy", chosen)  # one row of deviations
    noisy = {c: F.when(F.col("noisy"), F.col(c) + normal(i) * F.coalesce(f"__{c}", F.lit(0.0))).otherwise(F.col(c)) for i, c in enumerate(columns)}
    return marked.withColumns(noisy).drop(*[f"__{c}" for c in columns])


def dedupe_rows(entity_cells: DataFrame) -> DataFrame:
    """Drop a row whose entities equal those of an earlier row of the same table.

    Rows compare by their cells packed in column order (a row is as wide as its table, never longer).
    """
    rows = entity_cells.groupBy("t_id", "r_id").agg(
        F.array_sort(F.collect_list(F.struct("c_id", "entity"))).alias("__v")
    )
    first = rows.groupBy("t_id", F.sha2(F.to_json("__v"), 256).alias("__h")).agg(F.min("r_id").alias("r_id"))
    return entity_cells.join(first.select("t_id", "r_id"), ["t_id", "r_id"], "left_semi")


def extract_tables(cells: DataFrame, valid: DataFrame, sample_every: int = 1) -> DataFrame:
    """Cells of the valid columns of every ``sample_every``-th table with a short digest of the table name."""
    tables = position(valid.select("table_id").distinct(), [], ["table_id"], "__p")
    kept = tables.where((F.col("__p") - 1) % sample_every == 0).select("table_id", S.name_digest("table_id").alias("digest"))
    return cells.join(valid.select("dataset_id"), "dataset_id", "left_semi").join(kept, "table_id", "inner")


# --- splits ---------------------------------------------------------------------------------------


def split_percent(ids: DataFrame, labeled: float, unlabeled: float, test: float, seed: int = 0) -> DataFrame:
    """Random three-way split of the column ids; test gets ceil(test * n) ids, labeled ceil(labeled * n)."""
    keyed = ids.select("dataset_id").distinct().withColumn("__o", S.seeded_order(seed, "dataset_id"))
    ranked = position(keyed, [], ["__o", "dataset_id"], "__p")
    n = ids.select("dataset_id").distinct().agg(F.count(F.lit(1)).alias("__n"))
    total = labeled + unlabeled + test
    sized = ranked.crossJoin(F.broadcast(n))  # one row
    n_test = F.ceil(F.round(F.lit(test / total) * F.col("__n"), 9))
    n_lab = F.ceil(F.round(F.lit(labeled / total) * F.col("__n"), 9))
    split = F.when(F.col("__p") <= n_test, "test").when(F.col("__p") <= n_test + n_lab, "labeled").otherwise("unlabeled")
    return sized.select("dataset_id", split.alias("split"))


def split_absolute(gold: DataFrame, k: int, test_fraction: float = 0.2, seed: int = 0) -> DataFrame:
    """Test first; of the rest the first ``k`` columns per semantic type are labeled, others unlabeled."""
    parts = split_percent(gold, 0.0, 1.0 - test_fraction, test_fraction, seed)
    rest = gold.select("dataset_id", "semantic_type").join(parts.where("split <> 'test'"), "dataset_id", "left_semi")
    keyed = rest.withColumn("__o", S.seeded_order(seed + 1, "dataset_id"))
    labeled = top(keyed, ["semantic_type"], [F.col("__o"), F.col("dataset_id")], k).select("dataset_id")
    marked = parts.join(labeled.withColumn("__l", F.lit(True)), "dataset_id", "left")
    return marked.select("dataset_id", F.when(F.col("__l"), F.lit("labeled")).otherwise(F.col("split")).alias("split"))


def types_without(gold: DataFrame, splits: DataFrame, split: str = "labeled") -> DataFrame:
    """Semantic types with no column in the split."""
    present = gold.join(splits.where(F.col("split") == split), "dataset_id", "left_semi").select("semantic_type").distinct()
    return gold.select("semantic_type").distinct().join(present, "semantic_type", "left_anti")


def kfold(columns: DataFrame, k: int, seed: int = 0, multi_only: bool = False) -> DataFrame:
    """Fold 0..k-1 per table, near-equal sizes; optionally only tables with more than one column."""
    tables = columns.groupBy("table_id").agg(F.count_distinct("col_idx").alias("width"))
    if multi_only:
        tables = tables.where("width > 1")
    ranked = position(tables.withColumn("__o", S.seeded_order(seed, "table_id")), [], ["__o", "table_id"], "__p")
    return ranked.select("table_id", ((F.col("__p") - 1) % k).cast("int").alias("fold"))


def split_stats(gold: DataFrame, splits: DataFrame) -> DataFrame:
    """Columns per type in each split."""
    return (
        gold.join(splits, "dataset_id", "left")
        .groupBy("semantic_type")
        .agg(*[F.count_if(F.col("split") == s).alias(s) for s in ("labeled", "unlabeled", "test")])
    )


def dense_encode(values: DataFrame, column: str, out: str = "code") -> DataFrame:
    """Distinct values with codes 0.. in sorted order."""
    distinct = values.select(column).where(F.col(column).isNotNull()).distinct()
    return position(distinct, [], [column], out).withColumn(out, F.col(out) - 1)


def chunk_by_rows(rows: DataFrame, table: str, order: list[str], limit: Column) -> DataFrame:
    """Chunk number of every row when a table is cut after each ``limit`` rows."""
    numbered = position(rows, [table], order, "__p")
    return numbered.withColumn("chunk", F.floor((F.col("__p") - 1) / limit).cast("long")).drop("__p")


def chunk_by_budget(items: DataFrame, table: str, order: list[str], size: Column, budget: int) -> DataFrame:
    """Chunk number of every item from the running size of the items before it."""
    summed = running(items.withColumn("__z", size.cast("long")), [table], order, {"__u": F.col("__z")})
    return summed.withColumn("chunk", F.floor((F.col("__u") - F.col("__z")) / budget).cast("long")).drop("__u", "__z")


def column_text(cells: DataFrame, per_part: int = 1000) -> DataFrame:
    """Text of every column in row order, in numbered parts of ``per_part`` cells, so no column must fit one task."""
    parts = chunk_by_rows(cells.where(F.col("value").isNotNull()), "dataset_id", ["row_id"], F.lit(per_part))
    packed = parts.groupBy("dataset_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("row_id", "value"))).alias("v"))
    return packed.select("dataset_id", F.col("chunk").alias("part"), F.array_join("v.value", " ").alias("text"))


def _early(cells: DataFrame, head: int) -> DataFrame:
    """Cells among which are the first ``head`` of every column by row id, without sorting the others.

    The least row ids of hashed parts of a column are rows of it, so the ``head``-th of them is not before the ``head``-th row. Row ids are compared by their first 7
    bytes, as numbers; cells that tie there are kept. Ids that are no strings are all kept.
    """
    if dict(cells.dtypes)["row_id"] != "string":
        return cells
    start = F.conv(F.rpad(F.hex(F.substring(F.encode("row_id", "utf-8"), 1, 7)), 14, "0"), 16, 10).cast("long")
    marked = cells.withColumn("__start", start)
    parts = marked.groupBy("dataset_id", F.pmod(F.xxhash64("row_id"), F.lit(16 * head)).alias("part")).agg(F.min("__start").alias("least"))
    bounds = cut(parts.groupBy("dataset_id").agg(F.get(F.sort_array(F.collect_list("least")), F.lit(head - 1)).alias("__bound")))
    return marked.join(bounds, "dataset_id").where(F.coalesce(F.col("__start") <= F.col("__bound"), F.lit(True))).drop("__start", "__bound")


def context_text(cells: DataFrame, head: int = 64) -> DataFrame:
    """First ``head`` cells of a column, preceded by about ``head``/(k-1) words of each other column.

    A column that is alone in its table is preceded by ``head`` times the word None.
    """
    first = top(_early(cells.where(F.col("value").isNotNull()), head), ["dataset_id"], [F.col("row_id")], head, "__r")
    own = first.groupBy("table_id", "col_idx").agg(
        F.expr("transform(array_sort(collect_list(struct(__r, value))), v -> v.value)").alias("own")
    )
    width = cells.groupBy("table_id").agg(F.count_distinct("col_idx").alias("width"))
    base = own.join(width, "table_id")
    share = F.floor(F.lit(head) / (F.col("width") - 1)).cast("int")
    words = F.slice(F.split(F.array_join(F.slice("own", F.lit(1), F.greatest(share, F.lit(1))), " "), " "), F.lit(1), F.greatest(share, F.lit(1)))
    lead = base.where("width > 1").select("table_id", "col_idx", F.when(share > 0, F.array_join(words, " ")).otherwise("").alias("lead"))
    other = lead.withColumnRenamed("col_idx", "other_idx")
    around = (
        base.select("table_id", "col_idx")
        .join(other, "table_id")
        .where("col_idx <> other_idx")
        .groupBy("table_id", "col_idx")
        .agg(F.expr("array_join(transform(array_sort(collect_list(struct(other_idx, lead))), v -> v.lead), ' ')").alias("around"))
    )
    out = base.join(around, ["table_id", "col_idx"], "left")
    alone = F.lit(" ".join(["None"] * head))
    return out.select(
        S.column_id("table_id", "col_idx").alias("dataset_id"),
        F.concat_ws(" ", F.coalesce("around", alone), F.array_join("own", " ")).alias("text"),
    )


def attribute_pairs(attributes: DataFrame) -> DataFrame:
    """Ordered pairs, equal ones included, of the attributes of one table."""
    a = attributes.select("table_id", F.col("header").alias("a"))
    b = attributes.select("table_id", F.col("header").alias("b"))
    return a.join(b, "table_id")


def attribute_subsets(attributes: DataFrame) -> DataFrame:
    """Unordered pairs of different attributes of one table."""
    return attribute_pairs(attributes).where("a < b")
