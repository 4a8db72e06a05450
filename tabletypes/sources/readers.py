"""Readers of table corpora in their various file formats."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S

TABLE_SEPARATORS = [",", ";", "\t", ":"]

WEB_TABLE = "struct<hasHeader:boolean,headerPosition:string,headerRowIndex:int,pageTitle:string,tableNum:int,relation:array<array<string>>>"
ENTITY_TABLE = (
    "_id string, pgTitle string, sectionTitle string, tableCaption string, pgId bigint, tableId bigint, "
    "tableData array<array<struct<text:string,surfaceLinks:array<struct<surface:string,target:struct<id:bigint,title:string>>>>>>, "
    "processed_tableHeaders array<string>, entityCell array<array<int>>, entityColumn array<int>, subject_column int"
)
GOLD_JSON = "map<string,map<string,struct<semanticType:string>>>"
CHART_DATA = "map<string,struct<cols:map<string,struct<order:int,data:array<string>>>>>"


def read_delimited(
    spark: SparkSession, path: str, names: list[str], sep: str = "|", usecols: list[int] | None = None, frac: float | None = None, seed: int = 0
) -> DataFrame:
    """Headerless delimited text as strings. Lines with too many fields are skipped (also if the fields in excess are empty),
    short ones are filled with nulls; only the columns at the ordinals ``usecols`` are parsed out. Separators in quoted fields
    do not count, blank lines are skipped."""
    mark = re.escape(sep)
    bare = F.regexp_replace("value", rf'(?:^|(?<={mark}))"(?:[^"\\]|\\.)*"', "")
    lines = spark.read.text(path).where((F.trim("value") != "") & (F.size(F.split(bare, mark)) <= len(names)))
    schema = ", ".join(f"`{n}` string" for n in names)
    df = lines.select(F.from_csv("value", schema, {"sep": sep}).alias("line")).select("line.*")
    df = df.select(*[f"`{names[i]}`" for i in (usecols if usecols is not None else range(len(names)))])
    return df.sample(False, frac, seed) if frac is not None else df


def spark_type(name: str) -> T.DataType:
    """Type of a side-car name: smallint is an integer, decimal keeps its precision, all else is text."""
    name = name.strip().lower()
    m = re.match(r"decimal\((\d+)\s*,\s*(\d+)\)", name)
    if m:
        return T.DecimalType(int(m.group(1)), int(m.group(2)))
    return T.IntegerType() if name == "smallint" else T.StringType()


def sidecar_line(spark: SparkSession, path: str, sep: str = "|") -> list[str]:
    return spark.read.text(path).first()["value"].split(sep)


def read_with_sidecar(spark: SparkSession, data: str, header_file: str, types_file: str, sep: str = "|", view: str | None = None) -> DataFrame:
    """Headerless file with names and types from one-line side files; optionally registered as a view."""
    names, types = sidecar_line(spark, header_file, sep), sidecar_line(spark, types_file, sep)
    raw = read_delimited(spark, data, names, sep)
    df = raw.select(*[F.col(f"`{n}`").try_cast(spark_type(t)).alias(n) for n, t in zip(names, types)])
    if view:
        df.createOrReplaceTempView(view)
    return df


def names_from_ddl(spark: SparkSession, path: str) -> DataFrame:
    """(table_id, col_idx, name, type) of all ``CREATE TABLE`` texts below a folder (plain column lists)."""
    text = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    statements = text.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?is)(create\s+table\s+.*?;|create\s+table\s+[^;]+$)"), F.lit(1))).alias("s"))
    table = F.regexp_extract("s", r'(?is)create\s+table\s+(?:if\s+not\s+exists\s+)?["`]?([\w.$-]+)', 1)
    body = F.regexp_extract("s", r"(?s)\((.*)\)", 1)
    cols = statements.select(table.alias("table_id"), F.posexplode(F.split(body, r",(?![^(]*\))")).alias("col_idx", "c"))
    form = r'(?s)^\s*(?:"([^"]+)"|`([^`]+)`|(\S+))\s+(.*?)\s*$'
    name = F.concat(*[F.regexp_extract("c", form, i) for i in (1, 2, 3)])
    return cols.select("table_id", "col_idx", name.alias("name"), F.regexp_extract("c", form, 4).alias("type"))


def read_parquet_corpus(spark: SparkSession, path: str, up: int | None = None) -> DataFrame:
    """All parquet tables below a folder with their name as ``table_id``; columns a table lacks are null.

    The name is the first file or folder of the path that ends in ``.parquet``, so the part files of a table are one table;
    with ``up`` it is the folder so many levels above the file (0: the file itself).
    """
    df = spark.read.option("mergeSchema", "true").option("recursiveFileLookup", "true").parquet(path)
    name = F.regexp_extract("_metadata.file_path", r"([^/]+)\.parquet(?:/|$)", 1)
    if up is not None:
        name = F.regexp_replace(F.element_at(F.split("_metadata.file_path", "/"), -1 - up), r"\.parquet$", "")
    return df.select(name.alias("table_id"), "*")


def corpus_schemas(spark: SparkSession, path: str) -> DataFrame:
    """(path, col_idx, name, type) of every parquet file below a folder, from the footers alone."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path).select("path")

    def footers(batches):
        import pyarrow.fs as pafs
        import pyarrow.parquet as pq

        for batch in batches:
            rows = []
            for p in batch["path"]:
                fs, name = pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", p))
                schema = pq.read_schema(name, filesystem=fs)
                rows += [(p, i, f.name, str(f.type)) for i, f in enumerate(schema)]
            yield pd.DataFrame(rows, columns=["path", "col_idx", "name", "type"])

    return files.mapInPandas(footers, "path string, col_idx int, name string, type string")


def read_webtables_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Cells of web tables in (gzipped) JSON lines: (table_id, col_idx, header, row_id, value, is_numeric).

    Only tables whose header is the first row count. The relation is column-major; the header row is cut
    out; ``-`` is null. A column is numeric if all its values are. The table id is a digest of the line,
    the page title and the table number, since line numbers do not exist in a distributed read.
    """
    lines = spark.read.text(path).select("value", F.from_json("value", WEB_TABLE).alias("t"))
    kept = lines.where("t.hasHeader and t.headerPosition = 'FIRST_ROW'")
    table = F.concat_ws("-", F.substring(F.md5("value"), 1, 12), "t.pageTitle", F.col("t.tableNum").cast("string"))
    head = F.coalesce("t.headerRowIndex", F.lit(0))
    cols = kept.select(table.alias("table_id"), head.alias("h"), F.posexplode("t.relation").alias("col_idx", "c"))
    body = F.transform(F.filter("c", lambda v, i: i != F.col("h")), lambda v: F.when(v != "-", v))
    named = cols.select("table_id", "col_idx", F.element_at("c", F.col("h") + 1).alias("header"), body.alias("body"))
    numeric = F.forall("body", lambda v: v.isNull() | v.try_cast("double").isNotNull())
    return named.withColumn("is_numeric", numeric).select("table_id", "col_idx", "header", "is_numeric", F.posexplode("body").alias("row_id", "value"))


def read_chart_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Cells of charts' tables: TSV lines of id, table JSON, ...; columns in their ``order``; empty JSON dropped."""
    schema = "fid string, table_data string, layout string, chart_data string"
    raw = spark.read.csv(path, schema=schema, sep="\t", quote="", escape="")
    shown = raw.where(F.col("chart_data").isNotNull() & ~F.trim("chart_data").isin("", "{}", "[]", "null"))
    parsed = shown.select("fid", F.from_json("table_data", CHART_DATA).alias("d")).where("d is not null and size(d) > 0")
    entries = parsed.select("fid", F.map_entries(F.map_values("d")[0]["cols"]).alias("e"))
    ordered = F.array_sort(F.transform("e", lambda x: F.struct(x["value"]["order"].alias("order"), x["key"].alias("header"), x["value"]["data"].alias("data"))))
    cols = entries.select(F.col("fid").alias("table_id"), F.posexplode(ordered).alias("col_idx", "c"))
    return cols.select("table_id", "col_idx", "c.header", F.posexplode("c.data").alias("row_id", "value"))


def _whole_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """One row per small file: its path and its text, UTF-8 or else Latin-1."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(F.decode("content", "ISO-8859-1"))
    return files.select("path", text.alias("text"))


def _lines(files: DataFrame) -> DataFrame:
    kept = F.filter(F.split("text", r"\r?\n"), lambda x: x != "")
    return files.select("*", kept.alias("lines"))


def read_plain_tsv_tree(spark: SparkSession, path: str, pattern: str = "*.tsv") -> DataFrame:
    """Cells of a folder tree of small tab-separated tables whose first line is the header."""
    files = _lines(_whole_files(spark, path, pattern)).where(F.size("lines") > 0)
    heads = F.split(F.col("lines")[0], "\t")
    rows = files.select("path", heads.alias("heads"), F.posexplode(F.slice("lines", F.lit(2), F.size("lines"))).alias("row_id", "line"))
    cells = rows.select("path", "heads", "row_id", F.posexplode(F.split("line", "\t")).alias("col_idx", "value"))
    return cells.select(F.col("path").alias("table_id"), "col_idx", F.get("heads", F.col("col_idx")).alias("header"), "row_id", "value")


def read_sniffed_csv(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Cells of small files with an unknown separator: the one found on every line, most often, wins.

    Files that start like HTML are refused. Separators inside double quotes do not count.
    """
    files = _lines(_whole_files(spark, path, pattern)).where(~F.col("text").rlike(r"(?is)^\s*<(!doctype|html|head|\?xml)"))
    bare = F.transform("lines", lambda x: F.regexp_replace(x, '"[^"]*"', ""))

    def score(sep):
        counts = F.transform(bare, lambda x: F.length(x) - F.length(F.replace(x, F.lit(sep), F.lit(""))))
        return F.struct(F.array_min(counts).alias("least"), F.array_max(counts).alias("most"), F.lit(sep).alias("sep"))

    # a separator on every line beats one on some lines; then the steadier and more frequent one
    scores = F.array(*[score(s) for s in TABLE_SEPARATORS])
    best = F.array_max(F.transform(scores, lambda s: F.struct(s["least"].alias("least"), (-(s["most"] - s["least"])).alias("steady"), s["sep"].alias("sep"))))
    found = files.withColumn("best", best).where("best.least > 0")
    quoted = r'(?=(?:[^"]*"[^"]*")*[^"]*$)'
    parts = None
    for sep in TABLE_SEPARATORS:
        cut = lambda line, s=sep: F.split(line, re.escape(s) + quoted)
        cond = F.col("best.sep") == sep
        parts = F.when(cond, cut(F.col("line"))) if parts is None else parts.when(cond, cut(F.col("line")))
    rows = found.select("path", "best", F.posexplode("lines").alias("row_id", "line"))
    cells = rows.select("path", "row_id", F.col("best.sep").alias("sep"), F.posexplode(parts).alias("col_idx", "value"))
    return cells.select(F.col("path").alias("table_id"), "sep", "row_id", "col_idx", F.regexp_replace("value", r'^"(.*)"$', "$1").alias("value"))


def read_entity_tables(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ENTITY_TABLE).json(path)


def entity_cells_of(tables: DataFrame) -> DataFrame:
    """(t_id, r_id, c_id, c_name, entity, mention, is_subject) of the linked cells of nested tables."""
    rows = tables.select("_id", "processed_tableHeaders", "subject_column", F.posexplode("tableData").alias("r_id", "row"))
    cells = rows.select("_id", "processed_tableHeaders", "subject_column", "r_id", F.posexplode("row").alias("c_id", "cell"))
    link = F.get("cell.surfaceLinks", F.lit(0))
    return cells.select(
        F.col("_id").alias("t_id"), "r_id", "c_id", F.get("processed_tableHeaders", F.col("c_id")).alias("c_name"),
        link["target"]["id"].alias("entity"), link["surface"].alias("mention"), (F.col("c_id") == F.col("subject_column")).alias("is_subject"),
    ).where("entity is not null")


def read_gold_json(spark: SparkSession, path: str) -> DataFrame:
    """Known types from JSON maps table -> column_<n> -> semanticType, in one document or one per line."""
    docs = spark.read.text(path).select(F.from_json("value", GOLD_JSON).alias("m"))
    tables = docs.select(F.explode("m").alias("table_id", "cols")).select("table_id", F.explode("cols").alias("column", "v"))
    idx = F.regexp_extract("column", r"(\d+)$", 1).cast("int")
    return tables.select(S.column_id("table_id", idx).alias("dataset_id"), "table_id", idx.alias("col_idx"), F.col("v.semanticType").alias("semantic_type"))


def gold_json_lines(gold: DataFrame) -> DataFrame:
    """The way back: one JSON map per table (as many entries as it has columns)."""
    per = gold.groupBy("table_id").agg(
        F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("column_"), F.col("col_idx").cast("string")), F.struct(F.col("semantic_type").alias("semanticType"))))).alias("m")
    )
    return per.select(F.to_json(F.create_map("table_id", "m")).alias("value"))


def read_gold_csv(spark: SparkSession, path: str) -> DataFrame:
    """Known types from ``locator, dataset_id, field_list, field_names`` with list literals."""
    raw = spark.read.csv(path, header=True)
    pairs = raw.select("locator", "dataset_id", F.inline(F.arrays_zip(S.parse_list("field_list").alias("col_idx"), S.parse_list("field_names").alias("type_id"))))
    table = F.concat_ws("+", "locator", "dataset_id")
    return pairs.select(table.alias("table_id"), F.col("col_idx"), F.col("type_id"))


def read_vocab_tsv(spark: SparkSession, path: str, min_count: int = 0) -> tuple[DataFrame, DataFrame]:
    """Entity vocabulary and one row counting what was dropped (no title, too rare)."""
    raw = spark.read.csv(path, schema="idx bigint, entity_id string, title string, mid string, cnt bigint", sep="\t", quote="")
    untitled = F.col("title").isNull() | (F.col("title") == "")
    kept = raw.where(~untitled & (F.col("cnt") >= min_count))
    dropped = raw.agg(F.count_if(untitled).alias("n_untitled"), F.count_if(~untitled & (F.col("cnt") < min_count)).alias("n_rare"))
    return kept, dropped


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """(subject, predicate, object) of N-Triples-like lines; subjects as page titles, objects as last part or text."""
    form = r'^\s*(<[^>]*>)\s+<([^>]*)>\s+(?:<([^>]*)>|"(.*)"(?:@\w+|\^\^\S+)?)\s*\.\s*$'
    raw = spark.read.text(path).where(F.col("value").rlike(form))
    g = [F.regexp_extract("value", form, i) for i in range(1, 5)]
    obj = F.when(g[2] != "", F.regexp_extract(g[2], r"([^/#]+)$", 1)).otherwise(g[3])
    return raw.select(S.clean_title(g[0]).alias("subject"), g[1].alias("predicate"), obj.alias("object"))


def read_csv_files_as_rows(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Rows of small CSV files, one table per file: (table_id, row_id, values[])."""
    files = _lines(_whole_files(spark, path, "*.csv"))
    table = F.regexp_extract("path", r"([^/]+)\.csv$", 1)
    rows = files.select(table.alias("table_id"), F.posexplode("lines").alias("row_id", "line"))
    parts = F.split("line", re.escape(sep) + r'(?=(?:[^"]*"[^"]*")*[^"]*$)')
    return rows.select("table_id", "row_id", F.transform(parts, lambda v: F.regexp_replace(v, r'^"(.*)"$', "$1")).alias("values"))


def parse_query_tables(tables: DataFrame, max_cols: int = 5, max_rows: int = 20) -> DataFrame:
    """Cells of tables held as text: cells joined by ``_|_``, rows by ``_||_``; the first 20 rows of 5 cells.

    Blank cells and ``None`` are left out. A table has no cells if one of these rows is not as wide as
    the header (more than five counts as one width). ``tables(table_id, headers, rows)``.
    """
    rows = F.transform(F.slice(F.split("rows", r"_\|\|_"), 1, max_rows), lambda r: F.split(r, r"_\|_"))
    t = tables.select("table_id", F.split("headers", r"_\|_").alias("heads"), rows.alias("first_rows"))
    over = F.lit(max_cols + 1)
    even = F.forall("first_rows", lambda r: F.least(F.size(r), over) == F.least(F.size("heads"), over))
    kept = t.where(even).select("table_id", "heads", F.posexplode("first_rows").alias("row_id", "r"))
    cells = kept.select("table_id", "heads", "row_id", F.posexplode(F.slice("r", 1, max_cols)).alias("col_idx", "raw"))
    value = F.trim("raw")
    return cells.where((value != "") & (value != "None")).select(
        "table_id", "row_id", "col_idx", F.trim(F.get("heads", F.col("col_idx"))).alias("header"), value.alias("value")
    )


def read_query_table_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Query tables of a TSV with a header line and the fields number, id, title, caption, headers, rows, rest."""
    schema = "idx bigint, table_id string, title string, caption string, headers string, rows string, rest string"
    return parse_query_tables(spark.read.csv(path, schema=schema, sep="\t", header=True, quote="", escape=""))
