"""Readers and writers: the given tables are rendered in each format into the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.votes import majority_vote
from ..plans.session import shared_folder
from ..sources import readers as R
from ..sources import writers as W
from . import fixtures as X
from .label_queries import _V, MAJORITY, votes_of
from .registry import query


def folder(spark, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def put_lines(df, column: str, path: str) -> str:
    df.select(F.col(column).cast("string").alias("value")).write.text(path)
    return path


ORDER_NAMES = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


def pipe_orders(spark, sf):
    o = X.base(spark, sf, "orders")
    line = F.concat_ws("|", *[F.col(c).cast("string") for c in ORDER_NAMES])
    bad = F.when(F.col("o_orderkey") % 50 == 0, F.concat(line, F.lit("|surplus"))).otherwise(line)
    return put_lines(o.select(bad.alias("line")), "line", folder(spark, "pipe"))


@query("s1_read_delimited", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders WHERE o_orderkey % 50 <> 0 GROUP BY ALL")
def s1(spark, sf):
    df = R.read_delimited(spark, pipe_orders(spark, sf), ORDER_NAMES, "|", [2, 4])
    return df.groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("s2_read_with_sidecar", "SELECT o_orderstatus, count(*) AS n, sum(CASE WHEN o_custkey <= 32767 THEN o_custkey END)::BIGINT AS keys, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderkey % 50 <> 0 GROUP BY 1")
def s2(spark, sf):
    data = pipe_orders(spark, sf)
    side = spark.createDataFrame([("|".join(ORDER_NAMES), "varchar(20)|smallint|varchar(1)|decimal(12, 2)|varchar(20)")], "h string, t string")
    head, types = put_lines(side, "h", folder(spark, "head")), put_lines(side, "t", folder(spark, "types"))
    df = R.read_with_sidecar(spark, data, head, types)
    return df.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("o_custkey") <= 32767, F.col("o_custkey"))).alias("keys"), F.round(F.sum("o_totalprice").cast("double"), 2).alias("total")
    )


# one statement per supplier
@query(
    "s3_names_from_ddl",
    "SELECT 't_' || s_suppkey AS table_id, unnest([0, 1, 2]) AS col_idx, unnest(['key', 'full name', 'balance_' || s_nationkey]) AS name, unnest(['integer NOT NULL', 'varchar(25)', 'decimal(15, 2)']) AS type FROM supplier",
)
def s3(spark, sf):
    s = X.base(spark, sf, "supplier")
    text = F.format_string('CREATE TABLE t_%d (\n  key integer NOT NULL,\n  "full name" varchar(25),\n  balance_%d decimal(15, 2)\n);', "s_suppkey", "s_nationkey")
    return R.names_from_ddl(spark, put_lines(s.select(text.alias("line")), "line", folder(spark, "ddl")))


@query(
    "s4_corpus_schemas",
    "SELECT table_name || '.parquet' AS file, (ordinal_position - min(ordinal_position) OVER (PARTITION BY table_name))::INTEGER AS col_idx, column_name AS name, "
    "CASE data_type WHEN 'BIGINT' THEN 'int64' WHEN 'INTEGER' THEN 'int32' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' WHEN 'FLOAT' THEN 'float' WHEN 'BOOLEAN' THEN 'bool' "
    "WHEN 'DATE' THEN 'date32[day]' WHEN 'TIMESTAMP' THEN 'timestamp[us]' WHEN 'TIMESTAMP_NS' THEN 'timestamp[ns]' WHEN 'FLOAT[]' THEN 'list<element: float>' ELSE lower(data_type) END AS type FROM information_schema.columns "
    "WHERE table_name IN ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events', 'documents', 'embeddings', 'pages', 'benchmark', 'labels', 'conversations')",
)
def s4_schemas(spark, sf):
    return R.corpus_schemas(spark, sf).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "col_idx", "name", "type")


@query(
    "s4_read_parquet_corpus",
    "SELECT 'nation' AS table_id, count(*) AS n, count(n_name) AS with_name FROM nation UNION ALL SELECT 'region', count(*), 0 FROM region UNION ALL SELECT 'supplier', count(*), 0 FROM supplier",
)
def s4(spark, sf):
    path = folder(spark, "corpus")
    for t in ("nation", "region", "supplier"):
        X.base(spark, sf, t).write.parquet(f"{path}/{t}.parquet")
    return R.read_parquet_corpus(spark, path).groupBy("table_id").agg(F.count(F.lit(1)).alias("n"), F.count("n_name").alias("with_name"))


# one web table per order, some without a header in the first row
@query(
    "s5_read_webtables_jsonl",
    "WITH r AS (SELECT l_orderkey, l_quantity, l_returnflag FROM lineitem WHERE l_orderkey % 7 <> 0) "
    "SELECT header, is_numeric, count(*) AS n, count(value) AS n_value, min(value) AS lo, max(value) AS hi FROM (SELECT 'Quantity' AS header, true AS is_numeric, CASE WHEN l_quantity > 48 THEN NULL ELSE l_quantity::VARCHAR END AS value FROM r UNION ALL SELECT 'Flag', false, l_returnflag FROM r) GROUP BY ALL",
)
def s5(spark, sf):
    li = X.base(spark, sf, "lineitem")
    rows = li.groupBy("l_orderkey").agg(F.collect_list(F.struct("l_quantity", "l_returnflag")).alias("r"))
    q = F.concat(F.array(F.lit("Quantity")), F.transform("r", lambda x: F.when(x["l_quantity"] > 48, "-").otherwise(x["l_quantity"].cast("string"))))
    f = F.concat(F.array(F.lit("Flag")), F.transform("r", lambda x: x["l_returnflag"]))
    table = F.struct(
        F.lit(True).alias("hasHeader"), F.when(F.col("l_orderkey") % 7 == 0, "FIRST_COLUMN").otherwise("FIRST_ROW").alias("headerPosition"), F.lit(0).alias("headerRowIndex"),
        F.lit("orders").alias("pageTitle"), F.col("l_orderkey").cast("int").alias("tableNum"), F.array(q, f).alias("relation"),
    )
    path = folder(spark, "web")
    rows.select(F.to_json(table).alias("value")).write.option("compression", "gzip").text(path)
    cells = R.read_webtables_jsonl(spark, path)
    # a quantity column whose values are all missing is numeric as well
    return cells.groupBy("header", "is_numeric").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("n_value"), F.min("value").alias("lo"), F.max("value").alias("hi"))


@query(
    "s6_read_chart_tsv",
    "SELECT header, col_idx::INTEGER AS col_idx, count(*) AS n, min(value) AS lo, max(value) AS hi FROM (SELECT 'status' AS header, 0 AS col_idx, o_orderstatus AS value FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT 'key', 1, o_custkey::VARCHAR FROM orders WHERE o_orderkey % 5 <> 0) GROUP BY ALL",
)
def s6(spark, sf):
    o = X.base(spark, sf, "orders")
    cols = F.map_from_arrays(
        F.array(F.lit("key"), F.lit("status")),
        F.array(
            F.struct(F.lit(1).alias("order"), F.array(F.col("o_custkey").cast("string")).alias("data")),
            F.struct(F.lit(0).alias("order"), F.array("o_orderstatus").alias("data")),
        ),
    )
    data = F.when(F.col("o_orderkey") % 5 == 0, F.lit("{}")).otherwise(F.to_json(F.create_map(F.col("o_orderkey").cast("string"), F.struct(cols.alias("cols")))))
    line = F.concat_ws("\t", F.col("o_orderkey").cast("string"), data, F.lit("{}"), F.lit('[{"x": 1}]'))
    cells = R.read_chart_tsv(spark, put_lines(o.select(line.alias("line")), "line", folder(spark, "chart")))
    return cells.groupBy("header", "col_idx").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))


@query("s7_read_plain_tsv_tree", "SELECT col_idx::INTEGER AS col_idx, count(*) AS n, min(value) AS lo FROM (SELECT 0 AS col_idx, s_name AS value FROM supplier UNION ALL SELECT 1, s_nationkey::VARCHAR FROM supplier) GROUP BY ALL")
def s7(spark, sf):
    # Spark writes part files of its own naming; each starts with the header line
    s = X.base(spark, sf, "supplier").select("s_name", "s_nationkey", (F.col("s_suppkey") % 3).alias("year"), (F.col("s_suppkey") % 2).alias("month"))
    path = folder(spark, "tree")
    s.write.partitionBy("year", "month").csv(path, sep="\t", header=True)
    cells = R.read_plain_tsv_tree(spark, path, "*.csv")
    return cells.groupBy("col_idx").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"))


@query(
    "s8_read_sniffed_csv",
    "SELECT sep, col_idx::INTEGER AS col_idx, count(*) AS n, min(value) AS lo, max(value) AS hi FROM (SELECT CASE s_nationkey % 3 WHEN 0 THEN ',' WHEN 1 THEN ';' ELSE chr(9) END AS sep, unnest([0, 1, 2]) AS col_idx, unnest([s_name, s_suppkey::VARCHAR, 'a, b; c' || s_nationkey]) AS value FROM supplier WHERE s_nationkey <> 7) GROUP BY ALL",
)
def s8(spark, sf):
    s = X.base(spark, sf, "supplier")
    sep = F.when(F.col("s_nationkey") % 3 == 0, ",").when(F.col("s_nationkey") % 3 == 1, ";").otherwise("\t")
    quoted = F.concat(F.lit('"a, b; c'), F.col("s_nationkey").cast("string"), F.lit('"'))
    line = F.concat("s_name", sep, F.col("s_suppkey").cast("string"), sep, quoted)
    line = F.when(F.col("s_nationkey") == 7, F.concat(F.lit("<html>"), line)).otherwise(line)
    path = folder(spark, "sniff")
    s.select(line.alias("value"), F.col("s_nationkey").alias("nation")).repartition("nation").write.partitionBy("nation").text(path)
    cells = R.read_sniffed_csv(spark, path, "*.txt")
    return cells.groupBy("sep", "col_idx").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))


@query(
    "s9_read_entity_tables",
    "SELECT c_name, is_subject, count(*) AS n, count(DISTINCT entity) AS n_entities, min(mention) AS lo FROM (SELECT 'part' AS c_name, true AS is_subject, l_partkey AS entity, 'p' || l_partkey AS mention FROM lineitem UNION ALL SELECT 'supplier', false, 100000000 + l_suppkey, 's' || l_suppkey FROM lineitem WHERE l_suppkey % 4 <> 0) GROUP BY ALL",
)
def s9(spark, sf):
    li = X.base(spark, sf, "lineitem")

    def cell(prefix, key, linked=F.lit(True)):
        mention = F.concat(F.lit(prefix), key.cast("string"))
        target = F.struct((key + (100000000 if prefix == "s" else 0)).alias("id"), mention.alias("title"))
        links = F.when(linked, F.array(F.struct(mention.alias("surface"), target.alias("target")))).otherwise(F.array().cast("array<struct<surface:string,target:struct<id:bigint,title:string>>>"))
        return F.struct(mention.alias("text"), links.alias("surfaceLinks"))

    row = F.array(cell("p", F.col("l_partkey")), cell("s", F.col("l_suppkey"), F.col("l_suppkey") % 4 != 0))
    tables = li.groupBy(F.col("l_orderkey").cast("string").alias("_id")).agg(F.collect_list(row).alias("tableData"))
    full = tables.select("_id", "tableData", F.array(F.lit("part"), F.lit("supplier")).alias("processed_tableHeaders"), F.lit(0).alias("subject_column"))
    path = folder(spark, "entity")
    full.write.json(path)
    cells = R.entity_cells_of(R.read_entity_tables(spark, path))
    return cells.groupBy("c_name", "is_subject").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("entity").alias("n_entities"), F.min("mention").alias("lo"))


@query("s10_read_gold_json", f"WITH {X.columns_cte()} SELECT dataset_id, table_id, col_idx, semantic_type FROM gold")
def s10(spark, sf):
    lines = R.gold_json_lines(X.gold(spark, sf))
    return R.read_gold_json(spark, put_lines(lines, "value", folder(spark, "gold")))


@query(
    "s10_read_gold_csv",
    f"WITH {X.columns_cte()} SELECT 'corpus+' || table_id AS table_id, col_idx, length(semantic_type)::INTEGER AS type_id FROM gold",
)
def s10_csv(spark, sf):
    per = X.gold(spark, sf).groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("col_idx", F.length("semantic_type").alias("t")))).alias("f"))

    def literal(a):
        return F.concat(F.lit("["), F.array_join(F.transform(a, lambda x: x.cast("string")), ", "), F.lit("]"))

    path = folder(spark, "goldcsv")
    per.select(F.lit("corpus").alias("locator"), F.col("table_id").alias("dataset_id"), literal(F.col("f.col_idx")).alias("field_list"), literal(F.col("f.t")).alias("field_names")).write.csv(path, header=True)
    return R.read_gold_csv(spark, path)


@query(
    "s11_read_vocab_tsv",
    "WITH v AS (SELECT l_partkey AS idx, CASE WHEN l_partkey % 9 = 0 THEN '' ELSE 'part ' || l_partkey END AS title, count(*) AS cnt FROM lineitem GROUP BY ALL) "
    "SELECT count(*) FILTER (WHERE title <> '' AND cnt >= 30) AS n_kept, sum(cnt) FILTER (WHERE title <> '' AND cnt >= 30)::BIGINT AS total, count(*) FILTER (WHERE title = '') AS n_untitled, count(*) FILTER (WHERE title <> '' AND cnt < 30) AS n_rare FROM v",
)
def s11(spark, sf):
    v = X.base(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("cnt"))
    title = F.when(F.col("l_partkey") % 9 == 0, "").otherwise(F.concat(F.lit("part "), F.col("l_partkey").cast("string")))
    line = F.concat_ws("\t", F.col("l_partkey").cast("string"), F.concat(F.lit("e"), F.col("l_partkey").cast("string")), title, F.lit("m"), F.col("cnt").cast("string"))
    kept, dropped = R.read_vocab_tsv(spark, put_lines(v.select(line.alias("line")), "line", folder(spark, "vocab")), 30)
    return kept.agg(F.count(F.lit(1)).alias("n_kept"), F.sum("cnt").alias("total")).crossJoin(dropped)  # one row each


@query("s12_read_triples", "SELECT object, count(*) AS n, min(subject) AS lo FROM (SELECT 'Part ' || p_partkey || ' (x)' AS subject, p_type AS object FROM part UNION ALL SELECT 'Part ' || p_partkey || ' (x)', 'a \"short\" text' FROM part) GROUP BY 1")
def s12(spark, sf):
    p = X.base(spark, sf, "part")
    subject = F.concat(F.lit("<http://kb.example.org/resource/Part_"), F.col("p_partkey").cast("string"), F.lit("_%28x%29>"))
    typed = F.concat_ws(" ", subject, F.lit("<http://kb.example.org/type>"), F.concat(F.lit("<http://kb.example.org/onto/"), "p_type", F.lit(">")), F.lit("."))
    text = F.concat_ws(" ", subject, F.lit("<http://kb.example.org/abstract>"), F.lit('"a "short" text"@en'), F.lit("."))
    lines = p.select(F.explode(F.array(typed, text)).alias("line"))
    t = R.read_triples(spark, put_lines(lines, "line", folder(spark, "triples")))
    return t.groupBy("object").agg(F.count(F.lit(1)).alias("n"), F.min("subject").alias("lo"))


@query("s14_read_csv_files_as_rows", "SELECT 3 AS width, count(*) AS n, max(s_name) AS hi FROM supplier")
def s14(spark, sf):
    path = folder(spark, "rows")
    X.base(spark, sf, "supplier").select("s_name", F.lit("x, y").alias("t"), "s_acctbal", "s_nationkey").write.partitionBy("s_nationkey").csv(path)
    rows = R.read_csv_files_as_rows(spark, path)
    return rows.groupBy(F.size("values").alias("width")).agg(F.count(F.lit(1)).alias("n"), F.max(F.col("values")[0]).alias("hi"))


# one table per order: part, supplier and quantity; tables with a returned row are ragged
@query(
    "s15_read_query_table_tsv",
    "WITH r AS (SELECT l_orderkey, l_partkey, l_suppkey, l_returnflag, l_quantity FROM lineitem), g AS (SELECT l_orderkey FROM r GROUP BY 1 HAVING count(*) FILTER (WHERE l_returnflag = 'R' AND l_quantity > 40) = 0) "
    "SELECT header, count(*) AS n, count(DISTINCT table_id) AS n_tables, min(value) AS lo FROM (SELECT 't' || l_orderkey AS table_id, unnest(['part', 'supplier']) AS header, unnest([l_partkey::VARCHAR, CASE WHEN l_suppkey % 6 = 0 THEN 'None' ELSE l_suppkey::VARCHAR END]) AS value FROM r JOIN g USING (l_orderkey)) WHERE value <> 'None' GROUP BY 1",
)
def s15(spark, sf):
    li = X.base(spark, sf, "lineitem")
    sup = F.when(F.col("l_suppkey") % 6 == 0, "None").otherwise(F.col("l_suppkey").cast("string"))
    row = F.concat_ws("_|_", F.concat(F.lit(" "), F.col("l_partkey").cast("string")), sup)
    row = F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 40), F.concat(row, F.lit("_|_more"))).otherwise(row)
    t = li.groupBy("l_orderkey").agg(F.array_join(F.collect_list(row), "_||_").alias("rows"))
    key = F.col("l_orderkey").cast("string")
    path = folder(spark, "query")
    t.select(key.alias("idx"), F.concat(F.lit("t"), key).alias("table_id"), F.lit("title").alias("title"), F.lit("caption").alias("caption"), F.lit("part_|_supplier").alias("headers"), "rows", F.lit("-").alias("rest")).write.csv(
        path, sep="\t", header=True, quote="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    cells = R.read_query_table_tsv(spark, path)
    return cells.groupBy("header").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("table_id").alias("n_tables"), F.min("value").alias("lo"))


@query("s16_write_labels", f"{_V}, {MAJORITY} SELECT run, dataset_id, label FROM mv, (VALUES ('a'), ('b')) r(run)")
def s16(spark, sf):
    labels = majority_vote(votes_of(spark, sf))
    path = folder(spark, "labels")
    W.write_labels(labels, path, "a")
    W.write_labels(W.read_labels(spark, path).drop("run"), path, "b", single_file=True)
    return W.read_labels(spark, path).select("run", "dataset_id", "label")

