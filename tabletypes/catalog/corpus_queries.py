"""Corpus building, filters, samples and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import corpus as C
from . import fixtures as X
from .registry import query

ROUND = "round({}, 6) + 0.0"


@query(
    "c1_to_cells",
    f"WITH {X.cells_cte(X.NUMERIC + X.TEXT)} SELECT dataset_id, count(*) AS n, count(DISTINCT value) AS n_distinct, min(value) AS lo, max(value) AS hi FROM cells GROUP BY ALL",
)
def c1(spark, sf):
    cells = X.cells(spark, sf, X.NUMERIC + X.TEXT)
    return cells.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("value").alias("n_distinct"), F.min("value").alias("lo"), F.max("value").alias("hi")
    )


@query(
    "c2_filter_tables",
    f"WITH {X.columns_cte()} SELECT dataset_id, table_id FROM columns_ WHERE table_id IN (SELECT table_id FROM columns_ GROUP BY 1 HAVING count(DISTINCT col_idx) BETWEEN 3 AND 4)",
)
def c2(spark, sf):
    return C.filter_tables(X.columns(spark, sf), 3, 4).select("dataset_id", "table_id")


# words a canonical header may take in this vocabulary
HEADER_TYPES = ["quantity", "extendedPrice", "discount", "shipDate", "totalPrice", "company", "balance", "marketSegment", "size", "language"]
_CANON = (
    "list_filter(string_split_regex(lower(regexp_replace(regexp_replace(header, '\\([^)]*\\)', '', 'g'), '([A-Z][a-z])', ' \\1', 'g')), '\\W'), lambda w: w <> '')"
)
_CAMEL = (
    "CASE WHEN length(header) > 30 OR len(words) = 0 THEN '-' ELSE array_to_string(list_transform(words, "
    "lambda w, i: CASE WHEN i = 1 THEN w ELSE upper(w[1]) || w[2:] END), '') END"
)
_TYPES_VALUES = ", ".join(f"('{t}')" for t in HEADER_TYPES)


@query(
    "c3_valid_headers",
    f"WITH {X.columns_cte()}, w AS (SELECT *, {_CANON} AS words FROM columns_), c AS (SELECT table_id, col_idx, {_CAMEL} AS t FROM w) "
    f"SELECT table_id, array_to_string(list(col_idx ORDER BY col_idx), ',') AS field_list, array_to_string(list(t ORDER BY col_idx), ',') AS field_names "
    f"FROM c WHERE t IN (SELECT col0 FROM (VALUES {_TYPES_VALUES}) v(col0)) GROUP BY table_id",
)
def c3(spark, sf):
    types = spark.createDataFrame([(t,) for t in HEADER_TYPES], "semantic_type string")
    lists = C.header_lists(C.valid_headers(X.columns(spark, sf), types))
    return lists.select(
        "table_id",
        F.array_join(F.transform("field_list", lambda i: i.cast("string")), ",").alias("field_list"),
        F.array_join("field_names", ",").alias("field_names"),
    )


@query(
    "c4_project_columns",
    f"WITH {X.cells_cte()}, {X.columns_cte()}, {X.splits_cte()}, k AS (SELECT dataset_id, dense_rank() OVER (PARTITION BY table_id ORDER BY col_idx) - 1 AS new_idx "
    "FROM gold JOIN splits USING (dataset_id) WHERE split <> 'test') "
    "SELECT c.dataset_id, new_idx, count(*) AS n, sum(length(value))::BIGINT AS chars FROM cells c JOIN k USING (dataset_id) GROUP BY ALL",
)
def c4(spark, sf):
    gold = X.gold(spark, sf)
    keep = C.split_absolute(gold, 3).where("split <> 'test'")
    out = C.project_columns(X.cells(spark, sf), keep)
    return out.groupBy("dataset_id", "new_idx").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("value")).alias("chars"))


@query(
    "c5_drop_sparse",
    f"WITH {X.cells_cte(X.NUMERIC + X.TEXT, True)}, r AS (SELECT * FROM cells c WHERE NOT EXISTS (SELECT 1 FROM cells d WHERE d.table_id = c.table_id AND d.row_id = c.row_id AND d.value IS NULL)), "
    "b AS (SELECT table_id FROM r GROUP BY 1 HAVING count(value) >= 200) SELECT dataset_id, count(*) AS n FROM r WHERE table_id IN (SELECT table_id FROM b) GROUP BY ALL",
)
def c5(spark, sf):
    kept = C.drop_small_tables(C.drop_sparse_rows(X.cells(spark, sf, X.NUMERIC + X.TEXT, dirty=True)), 200)
    return kept.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "c6_sample_column",
    f"WITH {X.cells_cte()}, o AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY md5('7|' || dataset_id || '|' || row_id), row_id) AS r FROM cells) "
    "SELECT dataset_id, row_id, value FROM o WHERE r <= 5",
)
def c6(spark, sf):
    return C.sample_column(X.cells(spark, sf), 5, 7).select("dataset_id", "row_id", "value")


@query(
    "c6_sample_fraction",
    f"WITH {X.cells_cte()} SELECT dataset_id, count(*) AS n, min(row_id) AS lo, max(value) AS hi FROM cells "
    "WHERE substring(md5('7|' || dataset_id || '|' || row_id), 1, 8) < '19999999' GROUP BY ALL",
)
def c6_fraction(spark, sf):
    kept = C.sample_fraction(X.cells(spark, sf), 0.1, 7)
    return kept.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("lo"), F.max("value").alias("hi"))


@query(
    "c6_sample_with_replacement",
    f"WITH {X.cells_cte()}, s AS (SELECT dataset_id, count(*) AS n FROM cells GROUP BY 1), "
    "d AS (SELECT dataset_id, draw, ('0x' || substring(md5('3|' || dataset_id || '|' || draw), 1, 8))::BIGINT % n AS number FROM s, range(1, 11) t(draw)), "
    # the numbers in the order of their first draw stand for the cells in the order of their digests
    "g AS (SELECT dataset_id, number, min(draw) AS d1 FROM d GROUP BY ALL), f AS (SELECT dataset_id, number, row_number() OVER (PARTITION BY dataset_id ORDER BY d1) AS r FROM g), "
    "p AS (SELECT dataset_id, value, row_number() OVER (PARTITION BY dataset_id ORDER BY md5('3|' || dataset_id || '|' || row_id), row_id) AS r FROM cells) "
    "SELECT dataset_id, draw::INTEGER AS draw, value FROM d JOIN f USING (dataset_id, number) JOIN p USING (dataset_id, r)",
)
def c6_replacement(spark, sf):
    return C.sample_with_replacement(X.cells(spark, sf), 10, 3).select("dataset_id", "draw", "value")


@query(
    "c7_numeric_cells",
    f"WITH {X.cells_cte(X.NUMERIC + X.TEXT, True)} SELECT dataset_id, count(*) AS n, round(min(TRY_CAST(value AS DOUBLE)), 6) AS lo, round(max(TRY_CAST(value AS DOUBLE)), 6) AS hi "
    "FROM cells WHERE TRY_CAST(value AS DOUBLE) IS NOT NULL GROUP BY ALL",
)
def c7(spark, sf):
    numeric = C.numeric_cells(X.cells(spark, sf, X.NUMERIC + X.TEXT, dirty=True))
    return numeric.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n"), S.rnd(F.min("x")).alias("lo"), S.rnd(F.max("x")).alias("hi"))


_KINDS = (
    "CASE WHEN semantic_type IN ('flag','status','company','segment','product','category','description','language','payload') THEN 'string' "
    "WHEN semantic_type = 'date' THEN 'neither' ELSE 'numeric' END"
)


@query(
    "c8_attribute_classes",
    f"WITH {X.columns_cte()} SELECT table_id, count(*) FILTER (WHERE k = 'string') AS n_string, count(*) FILTER (WHERE k = 'numeric') AS n_numeric, "
    f"count(*) FILTER (WHERE k = 'neither') AS n_neither FROM (SELECT table_id, {_KINDS} AS k FROM columns_) GROUP BY ALL",
)
def c8(spark, sf):
    kinds = C.attribute_classes(X.columns(spark, sf))
    return kinds.groupBy("table_id").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("string", "numeric", "neither")])


@query(
    "c9_compare_schemas",
    f"WITH {X.columns_cte()}, e AS (SELECT col_idx, header, {_KINDS} AS k, count(*) FILTER (WHERE table_id LIKE 'customer%') AS n_left, "
    "count(*) FILTER (WHERE table_id LIKE 'supplier%' OR table_id LIKE 'part%') AS n_right FROM columns_ GROUP BY ALL), "
    "a AS (SELECT col_idx, header AS header_l, n_left FROM e WHERE n_left > 0), b AS (SELECT col_idx, header AS header_r, n_right FROM e WHERE n_right > 0) "
    "SELECT col_idx, header_l, header_r, n_left, n_right FROM a FULL JOIN b USING (col_idx) WHERE header_l IS DISTINCT FROM header_r",
)
def c9(spark, sf):
    t = F.col("table_id")
    out = C.compare_schemas(X.columns(spark, sf), t.startswith("customer"), t.startswith("supplier") | t.startswith("part"))
    return out.select("col_idx", "header_l", "header_r", "n_left", "n_right")


_KEY = "l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey"


def _normal(seed):
    u, v = (f"((('0x' || md5('{seed}|' || {_KEY})[{a}:{a + 9}])::BIGINT::DOUBLE + 1) / 1099511627776.0::DOUBLE)" for a in (1, 11))
    return f"sqrt(-2 * ln({u})) * cos(2 * pi() * {v})"


@query(
    "c10_add_gaussian_noise",
    f"WITH d AS (SELECT stddev_samp(l_quantity) AS dq, stddev_samp(l_extendedprice) AS de FROM lineitem), n AS (SELECT *, md5('5|' || {_KEY})[1:8] < '19999999' AS noisy FROM lineitem) "
    f"SELECT noisy, l_linenumber, count(*) AS n, round(sum(CASE WHEN noisy THEN l_quantity + {_normal(6)} * dq ELSE l_quantity END), 3) AS quantity, "
    f"round(sum(CASE WHEN noisy THEN l_extendedprice + {_normal(7)} * de ELSE l_extendedprice END), 1) AS price FROM n, d GROUP BY ALL",
)
def c10(spark, sf):
    noisy = C.add_gaussian_noise(X.base(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"], 0.1, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], 5)
    sums = S.rnd(F.sum("l_quantity"), 3).alias("quantity"), S.rnd(F.sum("l_extendedprice"), 1).alias("price")
    return noisy.groupBy("noisy", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), *sums)


@query(
    "c12_extract_tables",
    f"WITH {X.cells_cte(X.NUMERIC)}, {X.columns_cte()}, v AS (SELECT * FROM gold WHERE semantic_type IN ({', '.join(repr(t) for t in X.NUMERIC)})), "
    "t AS (SELECT table_id, row_number() OVER (ORDER BY table_id) AS p FROM (SELECT DISTINCT table_id FROM v)) "
    "SELECT c.dataset_id, substring(sha1(c.table_id), 1, 20) AS digest, count(*) AS n FROM cells c JOIN t USING (table_id) WHERE (p - 1) % 2 = 0 "
    "AND c.dataset_id IN (SELECT dataset_id FROM v) GROUP BY ALL",
)
def c12(spark, sf):
    valid = X.gold(spark, sf).where(F.col("semantic_type").isin(X.NUMERIC))
    out = C.extract_tables(X.cells(spark, sf, X.NUMERIC), valid, 2)
    return out.groupBy("dataset_id", "digest").agg(F.count(F.lit(1)).alias("n"))


_PERCENT = (
    "p0 AS (SELECT dataset_id, row_number() OVER (ORDER BY md5('4|' || dataset_id), dataset_id) AS p, count(*) OVER () AS n FROM gold) "
)


@query(
    "p1_split_percent",
    f"WITH {X.columns_cte()}, {_PERCENT} SELECT dataset_id, CASE WHEN p <= ceil(round(0.2 * n, 9)) THEN 'test' "
    "WHEN p <= ceil(round(0.2 * n, 9)) + ceil(round(0.1 * n, 9)) THEN 'labeled' ELSE 'unlabeled' END AS split FROM p0",
)
def p1(spark, sf):
    return C.split_percent(X.gold(spark, sf), 10, 70, 20, 4)


@query("p2_split_absolute", f"WITH {X.columns_cte()}, {X.splits_cte(2, 0.2, 6)} SELECT dataset_id, split FROM splits")
def p2(spark, sf):
    return C.split_absolute(X.gold(spark, sf), 2, 0.2, 6)


@query(
    "p2_types_without_labels",
    f"WITH {X.columns_cte()}, {X.splits_cte(2, 0.9, 6)} SELECT DISTINCT semantic_type FROM gold WHERE semantic_type NOT IN "
    "(SELECT semantic_type FROM gold JOIN splits USING (dataset_id) WHERE split = 'labeled')",
)
def p2_without(spark, sf):
    gold = X.gold(spark, sf)
    return C.types_without(gold, C.split_absolute(gold, 2, 0.9, 6))


@query(
    "p3_kfold",
    f"WITH {X.columns_cte()} SELECT table_id, ((row_number() OVER (ORDER BY md5('9|' || table_id), table_id) - 1) % 5)::INTEGER AS fold "
    "FROM (SELECT table_id FROM columns_ GROUP BY 1 HAVING count(DISTINCT col_idx) > 1)",
)
def p3(spark, sf):
    return C.kfold(X.columns(spark, sf), 5, 9, multi_only=True)


@query(
    "p4_split_stats",
    f"WITH {X.columns_cte()}, {X.splits_cte()} SELECT semantic_type, count(*) FILTER (WHERE split = 'labeled') AS labeled, "
    "count(*) FILTER (WHERE split = 'unlabeled') AS unlabeled, count(*) FILTER (WHERE split = 'test') AS test FROM gold LEFT JOIN splits USING (dataset_id) GROUP BY ALL",
)
def p4(spark, sf):
    gold = X.gold(spark, sf)
    return C.split_stats(gold, C.split_absolute(gold, 3))


@query(
    "w9_dense_encode",
    f"WITH {X.cells_cte(X.TEXT)}, d AS (SELECT DISTINCT value FROM cells WHERE value IS NOT NULL) SELECT value, row_number() OVER (ORDER BY value) - 1 AS code FROM d",
)
def w9(spark, sf):
    return C.dense_encode(X.cells(spark, sf, X.TEXT), "value")


@query(
    "w7_chunk_rows",
    "WITH o AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS r, "
    "sum(length(l_returnflag || l_shipdate::VARCHAR)) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS u FROM lineitem) "
    "SELECT l_suppkey, ((r - 1) // 50)::BIGINT AS chunk, count(*) AS n, min(l_orderkey) AS lo FROM o GROUP BY ALL",
)
def w7(spark, sf):
    rows = X.base(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")
    chunks = C.chunk_by_rows(rows, "l_suppkey", ["l_orderkey", "l_linenumber", "l_partkey"], F.lit(50))
    return chunks.groupBy("l_suppkey", "chunk").agg(F.count(F.lit(1)).alias("n"), F.min("l_orderkey").alias("lo"))


@query(
    "w7_chunk_budget",
    "WITH o AS (SELECT source, doc_id, n_chars, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS u FROM documents) "
    "SELECT source, ((u - n_chars) // 20000)::BIGINT AS chunk, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM o GROUP BY ALL",
)
def w7_budget(spark, sf):
    docs = X.base(spark, sf, "documents").select("source", "doc_id", "n_chars")
    chunks = C.chunk_by_budget(docs, "source", ["doc_id"], F.col("n_chars"), 20000)
    return chunks.groupBy("source", "chunk").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query(
    "f16_column_text",
    f"WITH {X.cells_cte(X.TEXT + ['size'])}, p AS (SELECT dataset_id, row_id, value, (row_number() OVER (PARTITION BY dataset_id ORDER BY row_id) - 1) // 1000 AS part FROM cells WHERE value IS NOT NULL) "
    "SELECT dataset_id, part::BIGINT AS part, md5(string_agg(value, ' ' ORDER BY row_id)) AS text_md5 FROM p GROUP BY ALL",
)
def f16(spark, sf):
    return C.column_text(X.cells(spark, sf, X.TEXT + ["size"])).select("dataset_id", "part", F.md5("text").alias("text_md5"))


@query(
    "f16_context_text",
    f"WITH {X.cells_cte(X.TEXT + ['price', 'date'])}, h AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY row_id) AS r FROM cells WHERE value IS NOT NULL), "
    "o AS (SELECT table_id, col_idx, list(value ORDER BY r) AS own FROM h WHERE r <= 64 GROUP BY ALL), "
    "b AS (SELECT *, count(*) OVER (PARTITION BY table_id) AS width FROM o), "
    "l AS (SELECT table_id, col_idx, array_to_string(string_split(array_to_string(own[1:(64 // (width - 1))], ' '), ' ')[1:(64 // (width - 1))], ' ') AS lead FROM b WHERE width > 1), "
    "a AS (SELECT b.table_id, b.col_idx, string_agg(l.lead, ' ' ORDER BY l.col_idx) AS around FROM b JOIN l ON l.table_id = b.table_id AND l.col_idx <> b.col_idx GROUP BY ALL) "
    "SELECT b.table_id || '+column_' || b.col_idx AS dataset_id, md5(coalesce(around, rtrim(repeat('None ', 64))) || ' ' || array_to_string(own, ' ')) AS text_md5 "
    "FROM b LEFT JOIN a ON a.table_id = b.table_id AND a.col_idx = b.col_idx",
)
def f16_context(spark, sf):
    return C.context_text(X.cells(spark, sf, X.TEXT + ["price", "date"])).select("dataset_id", F.md5("text").alias("text_md5"))


@query(
    "j12_ordered_pairs",
    f"WITH {X.columns_cte()} SELECT x.table_id, x.header AS a, y.header AS b FROM columns_ x JOIN columns_ y USING (table_id)",
)
def j12(spark, sf):
    return C.attribute_pairs(X.columns(spark, sf))
