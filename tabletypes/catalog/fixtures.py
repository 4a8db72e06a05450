"""The given tables seen as a corpus of many tables: one virtual table per line number, nation, brand, ...

``cells``/``gold`` build the corpus on Spark, ``CELLS``/``GOLD`` are the same definitions as SQL text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.corpus import to_cells
from ..plans.session import cut

# base table -> (table id, row id, [(column expression, header, semantic type)]); the expressions are valid in both dialects
CORPUS = {
    "lineitem": (
        "concat('lineitem_', l_linenumber)",
        "concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, '-', l_extendedprice)",
        [
            ("l_quantity", "Quantity", "quantity"),
            ("l_extendedprice", "Extended Price", "price"),
            ("l_discount", "Discount (rate)", "discount"),
            ("l_tax", "Tax", "tax"),
            ("l_returnflag", "ReturnFlag", "flag"),
            ("l_linestatus", "LineStatus", "status"),
            ("cast(l_shipdate as date)", "Ship Date", "date"),
        ],
    ),
    "orders": (
        "concat('orders_', substring(o_orderpriority, 1, 1))",
        "cast(o_orderkey as varchar(20))",
        [
            ("o_orderstatus", "Order Status", "status"),
            ("o_totalprice", "TotalPrice", "price"),
            ("cast(o_orderdate as date)", "Order Date", "date"),
            ("o_custkey", "Customer Id", "key"),
        ],
    ),
    "customer": (
        "concat('customer_', c_nationkey)",
        "cast(c_custkey as varchar(20))",
        [("c_name", "Company", "company"), ("c_acctbal", "Balance", "balance"), ("c_mktsegment", "Market Segment", "segment")],
    ),
    "supplier": (
        "concat('supplier_', s_nationkey)",
        "cast(s_suppkey as varchar(20))",
        [("s_name", "Company", "company"), ("s_acctbal", "Balance", "balance")],
    ),
    "part": (
        "concat('part_', p_brand)",
        "cast(p_partkey as varchar(20))",
        [
            ("p_name", "Product", "product"),
            ("p_type", "Category", "category"),
            ("p_size", "Size", "size"),
            ("p_retailprice", "Retail Price", "price"),
        ],
    ),
    "documents": (
        "concat('documents_', source)",
        "cast(doc_id as varchar(20))",
        [("text", "Description", "description"), ("lang", "Language", "language"), ("n_chars", "Length", "length")],
    ),
    "events": (
        "concat('events_', event_type)",
        "cast(event_id as varchar(20))",
        [("user_id", "User Id", "key"), ("value", "Amount", "amount"), ("props", "Payload", "payload")],
    ),
}

NUMERIC = ["quantity", "price", "discount", "tax", "balance", "size", "length", "amount", "key"]
TEXT = ["flag", "status", "company", "segment", "product", "category", "language", "payload"]

# a null and an empty string at fixed places, so that null handling shows; keyed on the length of the row id
DIRTY = "case when length(row_id) % 5 = 0 and substring(row_id, 1, 1) = '1' then null when substring(row_id, 1, 2) = '22' then '' else value end"


def base(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def cells(spark: SparkSession, sf: str, types: list[str] | None = None, dirty: bool = False) -> DataFrame:
    """The corpus in long form; ``types`` limits which columns are read at all."""
    parts = []
    for name, (table, row_id, cols) in CORPUS.items():
        chosen = [(i, e) for i, (e, _, t) in enumerate(cols) if types is None or t in types]
        if not chosen:
            continue
        part = to_cells(base(spark, sf, name), F.expr(table), F.expr(row_id), {str(i): F.expr(e) for i, e in chosen})
        if [i for i, _ in chosen] != list(range(len(chosen))):
            numbers = F.array(*[F.lit(i) for i, _ in chosen])
            part = part.withColumn("col_idx", F.element_at(numbers, F.col("col_idx") + 1))
            part = part.withColumn("dataset_id", F.concat("table_id", F.lit("+column_"), F.col("col_idx").cast("string")))
        parts.append(part)
    out = reduce(DataFrame.unionByName, parts)
    return out.withColumn("value", F.expr(DIRTY)) if dirty else out


def columns(spark: SparkSession, sf: str) -> DataFrame:
    """One row per column with header, declared type and semantic type."""
    parts = []
    for name, (table, _, cols) in CORPUS.items():
        df = base(spark, sf, name)
        kinds = dict(df.select(*[F.expr(e).alias(str(i)) for i, (e, _, _) in enumerate(cols)]).dtypes)
        rows = F.array(
            *[
                F.struct(F.lit(i).alias("col_idx"), F.lit(h).alias("header"), F.lit(t).alias("semantic_type"), F.lit(kinds[str(i)]).alias("type"))
                for i, (_, h, t) in enumerate(cols)
            ]
        )
        parts.append(df.select(F.expr(table).alias("table_id")).distinct().select("table_id", F.inline(rows)))
    out = reduce(DataFrame.unionByName, parts)
    # the catalogue of columns is small beside the cells and is used many times over: write it once
    return cut(out.withColumn("dataset_id", F.concat("table_id", F.lit("+column_"), F.col("col_idx").cast("string"))))


def gold(spark: SparkSession, sf: str) -> DataFrame:
    return columns(spark, sf).select("dataset_id", "table_id", "col_idx", "semantic_type")


def _cells_sql(types: list[str] | None = None, dirty: bool = False) -> str:
    selects = []
    for name, (table, row_id, cols) in CORPUS.items():
        for i, (e, _, t) in enumerate(cols):
            if types is None or t in types:
                selects.append(
                    f"SELECT {table} || '+column_{i}' AS dataset_id, {table} AS table_id, {i} AS col_idx, {row_id} AS row_id, "
                    f"CAST({e} AS VARCHAR) AS value FROM {name}"
                )
    union = "\nUNION ALL ".join(selects)
    if dirty:
        return f"SELECT dataset_id, table_id, col_idx, row_id, {DIRTY} AS value FROM ({union})"
    return union


def cells_cte(types: list[str] | None = None, dirty: bool = False) -> str:
    return f"cells AS ({_cells_sql(types, dirty)})"


def columns_cte() -> str:
    selects = []
    for name, (table, _, cols) in CORPUS.items():
        for i, (e, h, t) in enumerate(cols):
            selects.append(
                f"SELECT DISTINCT {table} AS table_id, {i} AS col_idx, '{h}' AS header, '{t}' AS semantic_type, "
                f"{table} || '+column_{i}' AS dataset_id FROM {name}"
            )
    return "columns_ AS MATERIALIZED (" + "\nUNION ALL ".join(selects) + "), gold AS (SELECT dataset_id, table_id, col_idx, semantic_type FROM columns_)"


def hist_cte(types: list[str] | None = None) -> str:
    """Value histogram of the numeric columns."""
    return cells_cte(types or NUMERIC) + (
        ", num AS (SELECT dataset_id, table_id, col_idx, row_id, TRY_CAST(value AS DOUBLE) AS x FROM cells WHERE TRY_CAST(value AS DOUBLE) IS NOT NULL)"
        ", hist AS (SELECT dataset_id, x, count(*) AS cnt FROM num GROUP BY ALL)"
    )


def splits_cte(k: int = 3, test: float = 0.2, seed: int = 0) -> str:
    """The absolute split; expects ``gold``."""
    return (
        f"sp0 AS (SELECT dataset_id, row_number() OVER (ORDER BY md5('{seed}|' || dataset_id), dataset_id) AS p, count(*) OVER () AS n FROM gold), "
        f"sp1 AS (SELECT dataset_id, CASE WHEN p <= ceil(round({test} * n, 9)) THEN 'test' ELSE 'unlabeled' END AS split FROM sp0), "
        f"sp2 AS (SELECT g.dataset_id, row_number() OVER (PARTITION BY semantic_type ORDER BY md5('{seed + 1}|' || g.dataset_id), g.dataset_id) AS r "
        "FROM gold g JOIN sp1 USING (dataset_id) WHERE split <> 'test'), "
        f"splits AS MATERIALIZED (SELECT sp1.dataset_id, CASE WHEN r <= {k} THEN 'labeled' ELSE split END AS split FROM sp1 LEFT JOIN sp2 USING (dataset_id))"
    )
