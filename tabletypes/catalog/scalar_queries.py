"""Scalar functions on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import vectors as V
from ..operators import stats as T
from ..operators.retrieval import postings
from . import fixtures as X
from .corpus_queries import _CAMEL, _CANON
from .registry import query


@query(
    "f1_canonical_header",
    f"WITH h AS (SELECT DISTINCT c_mktsegment || ' OrderKey (' || c_nationkey || ') no_' || c_nationkey AS header FROM customer), w AS (SELECT header, {_CANON} AS words FROM h) SELECT header, {_CAMEL} AS canonical FROM w",
)
def f1(spark, sf):
    c = X.base(spark, sf, "customer")
    n = F.col("c_nationkey").cast("string")
    h = c.select(F.concat("c_mktsegment", F.lit(" OrderKey ("), n, F.lit(") no_"), n).alias("header")).distinct()
    return h.withColumn("canonical", S.canonical_header("header"))


_DATES = (
    "CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN strftime(o_orderdate, '%Y/%m/%d %H:%M:%S') "
    "WHEN 3 THEN strftime(o_orderdate, '%d.%m.%y') WHEN 4 THEN strftime(o_orderdate, '%d %b %Y') ELSE 'no date ' || o_orderkey END"
)


def rendered_dates(spark, sf):
    o = X.base(spark, sf, "orders")
    k, d = F.col("o_orderkey") % 6, F.col("o_orderdate")
    text = (
        F.when(k == 0, F.date_format(d, "dd/MM/yyyy")).when(k == 1, F.date_format(d, "yyyy-MM-dd")).when(k == 2, F.date_format(d, "yyyy/MM/dd HH:mm:ss"))
        .when(k == 3, F.date_format(d, "dd.MM.yy")).when(k == 4, F.date_format(d, "dd MMM yyyy")).otherwise(F.concat(F.lit("no date "), F.col("o_orderkey").cast("string")))
    )
    return o.select("o_orderkey", text.alias("v"))


@query("f3_is_date", f"SELECT o_orderkey, regexp_matches({_DATES}, '^\\d{{1,4}}[-/]\\S+[-/]\\S+') AS is_date FROM orders")
def f3_is(spark, sf):
    return rendered_dates(spark, sf).select("o_orderkey", S.is_date("v").alias("is_date"))


@query("f3_parse_date", "SELECT o_orderkey, CASE WHEN o_orderkey % 6 < 5 THEN strftime(o_orderdate, '%Y-%m-%d') END AS parsed FROM orders")
def f3(spark, sf):
    return rendered_dates(spark, sf).select("o_orderkey", F.date_format(S.parse_date("v"), "yyyy-MM-dd").alias("parsed"))


# every minute of the day, by turns with a zone name, with an offset, without the zone that bare minutes need, and with seconds and a zone name
@query(
    "f3_parse_clock",
    "WITH m AS (SELECT o_orderkey, o_orderdate::TIMESTAMP + to_minutes((o_orderkey % 1440)::BIGINT) AS t FROM orders) SELECT o_orderkey, CASE o_orderkey % 4 WHEN 1 THEN strftime(t - INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M') "
    "WHEN 2 THEN NULL ELSE strftime(t, '%Y-%m-%d %H:%M') END AS parsed FROM m",
)
def f3_clock(spark, sf):
    o = X.base(spark, sf, "orders")
    k, t = F.col("o_orderkey") % 4, F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(mins=(F.col("o_orderkey") % 1440).cast("int"))
    text = F.when(k == 0, F.date_format(t, "dd/MM/yyyy HH:mm'UTC'")).when(k == 1, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'+01:30'")).when(k == 2, F.date_format(t, "yyyy-MM-dd HH:mm")).otherwise(F.date_format(t, "yyyy-MM-dd HH:mm:ss'GMT'"))
    return o.select("o_orderkey", F.date_format(S.parse_date(text), "yyyy-MM-dd HH:mm").alias("parsed"))


@query("f4_in_dictionary", "SELECT c_custkey, lower(c_mktsegment) IN ('automobile', 'furniture') AS hit FROM customer")
def f4(spark, sf):
    return X.base(spark, sf, "customer").select("c_custkey", S.in_dictionary("c_mktsegment", ["Automobile", "Furniture"]).alias("hit"))


@query("f5_regex_hits", "SELECT p_partkey, regexp_matches(p_name, '(?i)^(?:SMALL)')::INTEGER + regexp_matches(p_name, '(?i)^(?:.*ring)')::INTEGER + regexp_matches(p_name, '(?i)^(?:ring)')::INTEGER AS hits FROM part")
def f5(spark, sf):
    return X.base(spark, sf, "part").select("p_partkey", S.regex_hits("p_name", ["SMALL", ".*ring", "ring"]).alias("hits"))


@query(
    "f6_char_class_counts",
    "SELECT doc_id, length(regexp_replace(text, '[^0-9]', '', 'g')) AS num, length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) AS text, length(text) - length(translate(text, '!@#$%^&*(),.?\":{}|<>', '')) AS spec, length(text) - length(translate(text, '\" ', '')) AS space FROM documents",
)
def f6(spark, sf):
    return X.base(spark, sf, "documents").select("doc_id", *[c.alias(k) for k, c in S.char_class_counts("text").items()])


_TOK = "list_filter(string_split_regex(translate(lower(text), '''.:,/()-+', '         '), '\\s+'), lambda t: t NOT IN ('', 'the', 'and'))"


@query("f7_clean_tokens", f"SELECT doc_id, len({_TOK}) AS n, md5(array_to_string({_TOK}, ' ')) AS digest FROM documents")
def f7(spark, sf):
    t = X.base(spark, sf, "documents").select("doc_id", S.clean_tokens("text", ["the", "and"]).alias("t"))
    return t.select("doc_id", F.size("t").alias("n"), F.md5(F.array_join("t", " ")).alias("digest"))


@query("f7_marked_tokens", f"SELECT doc_id, CASE WHEN length(text) > 300 THEN len({_TOK}) + 1 ELSE 1 END AS n, length(text) > 300 AS long FROM documents")
def f7_marked(spark, sf):
    t = X.base(spark, sf, "documents").select("doc_id", S.marked_tokens("text", 300, ["the", "and"]).alias("t"))
    return t.select("doc_id", F.size("t").alias("n"), (F.element_at("t", -1) == "longstr").alias("long"))


@query(
    "f8_number_token",
    f"WITH {X.cells_cte(X.NUMERIC + X.TEXT)} SELECT CASE WHEN TRY_CAST(value AS DOUBLE) IS NOT NULL THEN 'float64' ELSE value END AS token, count(*) AS n FROM cells GROUP BY 1",
)
def f8(spark, sf):
    return X.cells(spark, sf, X.NUMERIC + X.TEXT).groupBy(S.number_token("value").alias("token")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "f9_parse_column_id",
    f"WITH {X.columns_cte()} SELECT dataset_id, table_id, col_idx, semantic_type AS short FROM gold",
)
def f9(spark, sf):
    t, i = S.parse_column_id("dataset_id")
    return X.gold(spark, sf).select("dataset_id", t.alias("table_id"), i.alias("col_idx"), S.short_type(F.concat(F.lit("group.sub."), "semantic_type")).alias("short"))


@query(
    "f10_cosine",
    "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) + 0.0 AS sim FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
)
def f10(spark, sf):
    e = X.base(spark, sf, "embeddings")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("e2"))
    return e.join(other, "vec_id").select("vec_id", S.rnd(V.cosine("embedding", "e2")).alias("sim"))


@query("f11_parse_list", "SELECT o_orderkey, (o_orderkey % 10 + o_custkey)::BIGINT AS total, o_orderstatus AS first FROM orders")
def f11(spark, sf):
    o = X.base(spark, sf, "orders")
    numbers = F.format_string("[%d, %d]", F.col("o_orderkey") % 10, "o_custkey")
    words = F.format_string("('%s', 'x')", "o_orderstatus")
    n, w = S.parse_list(numbers, "bigint"), S.parse_list(words, "string")
    return o.select("o_orderkey", (n[0] + n[1]).alias("total"), w[0].alias("first"))


@query("f12_clean_title", "SELECT p_partkey, p_name || ' (' || p_type || ')' AS title FROM part")
def f12(spark, sf):
    p = X.base(spark, sf, "part")
    uri = F.concat(F.lit("<http://kb.example.org/resource/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_%28"), "p_type", F.lit("%29>"))
    return p.select("p_partkey", S.clean_title(uri).alias("title"))


@query("f13_strip_nonword", "SELECT p_partkey, '(' || p_name || ')' AS bare FROM part")
def f13(spark, sf):
    p = X.base(spark, sf, "part")
    return p.select("p_partkey", S.strip_nonword(F.concat(F.lit("[("), "p_name", F.lit(")]"))).alias("bare"))


@query("f14_flatten_header", "SELECT l_orderkey, string_agg(l_returnflag || l_linenumber, ' ' ORDER BY l_linenumber, l_partkey, l_suppkey) AS header FROM lineitem GROUP BY 1")
def f14(spark, sf):
    from ..operators.entities import flatten_header

    li = X.base(spark, sf, "lineitem")
    rows = li.select(F.col("l_orderkey").alias("table_id"), F.lit(0).alias("col_idx"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("row_id"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("text"))
    return flatten_header(rows).select(F.col("table_id").alias("l_orderkey"), "header")


@query("f15_name_digest", "SELECT c_custkey, substring(sha1(c_name), 1, 20) AS digest FROM customer")
def f15(spark, sf):
    return X.base(spark, sf, "customer").select("c_custkey", S.name_digest("c_name").alias("digest"))


@query(
    "f17_log_sum_exp",
    "SELECT l_returnflag, round(max(l_quantity) + ln(sum(exp(l_quantity - m))), 6) AS lse FROM lineitem JOIN (SELECT l_returnflag, max(l_quantity) AS m FROM lineitem GROUP BY 1) USING (l_returnflag) GROUP BY 1",
)
def f17(spark, sf):
    return T.log_sum_exp(X.base(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity").withColumn("lse", S.rnd("lse"))


@query(
    "f17_log_normalise",
    "WITH s AS (SELECT o_custkey, o_orderkey, o_totalprice / 1e5 AS x FROM orders), z AS (SELECT o_custkey, ln(sum(exp(x))) AS z FROM s GROUP BY 1) SELECT o_orderkey, round(x - z, 6) + 0.0 AS x FROM s JOIN z USING (o_custkey)",
)
def f17_normalise(spark, sf):
    s = X.base(spark, sf, "orders").select("o_custkey", "o_orderkey", (F.col("o_totalprice") / 1e5).alias("x"))
    return T.log_normalise(s, ["o_custkey"], "x").select("o_orderkey", S.rnd("x").alias("x"))


@query(
    "f17_smoothing",
    "WITH po AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(list_filter(string_split_regex(translate(lower(text), '''.:,/()-+', '         '), '\\s+'), lambda t: t <> '')) AS term FROM documents) GROUP BY ALL), "
    "c AS (SELECT term, sum(tf) AS ctf FROM po GROUP BY 1), d AS (SELECT doc_id, sum(tf) AS len FROM po GROUP BY 1), k AS (SELECT sum(tf) AS coll FROM po) "
    "SELECT doc_id, round(sum(ln((tf + 100 * ctf / coll) / (len + 100))), 4) AS dirichlet, round(sum(ln(0.5 * tf / len + 0.5 * ctf / coll)), 4) AS jm FROM po JOIN c USING (term) JOIN d USING (doc_id), k GROUP BY 1",
)
def f17_smoothing(spark, sf):
    post = postings(X.base(spark, sf, "documents"), [])
    c = post.groupBy("term").agg(F.sum("tf").alias("ctf"))
    d = post.groupBy("doc_id").agg(F.sum("tf").alias("len"))
    k = post.agg(F.sum("tf").alias("coll"))
    j = post.join(c, "term").join(d, "doc_id").crossJoin(k).withColumn("pc", F.col("ctf") / F.col("coll"))  # one row
    return j.groupBy("doc_id").agg(
        S.rnd(F.sum(F.log(V.dirichlet("tf", "len", "pc", 100))), 4).alias("dirichlet"), S.rnd(F.sum(F.log(V.jelinek_mercer("tf", "len", "pc", 0.5))), 4).alias("jm")
    )
