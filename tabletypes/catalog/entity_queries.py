"""Entity tables (one per order), linking and training samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import corpus as C
from ..operators import entities as E
from ..operators import joins as J
from ..operators import metrics as M
from ..operators import prep as D
from ..plans.session import cut
from . import fixtures as X
from .registry import query

# one table per order: subject column = part, other columns = supplier and the customer's nation
_R0 = (
    "r0 AS (SELECT l_orderkey AS t_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS r_id, l_partkey, l_suppkey, o_orderstatus, o_orderpriority, "
    "c_nationkey, c_mktsegment FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey)"
)
EC = (
    f"{_R0}, ec AS (SELECT t_id, r_id, 0 AS c_id, 'part' AS c_name, 'part_' || l_partkey AS entity FROM r0 "
    "UNION ALL SELECT t_id, r_id, 1, 'supplier ' || o_orderstatus, 'supplier_' || l_suppkey FROM r0 "
    "UNION ALL SELECT t_id, r_id, 2, 'nation ' || substring(o_orderpriority, 1, 1), 'nation_' || c_nationkey FROM r0)"
)
RP = f"{EC}, rp AS (SELECT s.t_id, s.r_id, o.c_id, o.c_name, s.entity AS e1, o.entity AS e2 FROM ec s JOIN ec o ON s.t_id = o.t_id AND s.r_id = o.r_id AND s.c_id = 0 AND o.c_id <> 0)"


def order_rows(spark, sf):
    li, o, c = (X.base(spark, sf, t) for t in ("lineitem", "orders", "customer"))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    rows = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.row_number().over(w) - 1).alias("r_id"))
    joined = rows.join(o, rows.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == c.c_custkey)
    return joined.select(F.col("l_orderkey").alias("t_id"), "r_id", "l_partkey", "l_suppkey", "o_orderstatus", "o_orderpriority", "c_nationkey", "c_mktsegment")


def entity_cells(spark, sf):
    columns = F.array(
        F.struct(F.lit(0).alias("c_id"), F.lit("part").alias("c_name"), F.concat(F.lit("part_"), F.col("l_partkey").cast("string")).alias("entity")),
        F.struct(F.lit(1).alias("c_id"), F.concat(F.lit("supplier "), "o_orderstatus").alias("c_name"), F.concat(F.lit("supplier_"), F.col("l_suppkey").cast("string")).alias("entity")),
        F.struct(F.lit(2).alias("c_id"), F.concat(F.lit("nation "), F.substring("o_orderpriority", 1, 1)).alias("c_name"), F.concat(F.lit("nation_"), F.col("c_nationkey").cast("string")).alias("entity")),
    )
    return order_rows(spark, sf).select("t_id", "r_id", F.inline(columns))


def pairs(spark, sf):
    return E.same_row_pairs(entity_cells(spark, sf))


@query("j7_same_row_pairs", f"WITH {RP} SELECT c_name, e2, count(*) AS n, count(DISTINCT e1) AS n_e1, count(DISTINCT t_id) AS n_tables FROM rp GROUP BY ALL")
def j7(spark, sf):
    return pairs(spark, sf).groupBy("c_name", "e2").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("e1").alias("n_e1"), F.count_distinct("t_id").alias("n_tables"))


_HH = (
    "rd AS (SELECT DISTINCT t_id, e1, e2, c_name AS h FROM rp), mt AS (SELECT DISTINCT a.t_id AS t1, b.t_id AS t2, a.h AS h1, b.h AS h2 FROM rd a JOIN rd b USING (e1, e2) WHERE a.h <> b.h), "
    "hh AS (SELECT h1, h2, count(*) AS n FROM mt GROUP BY ALL)"
)


@query("j8_header_header", f"WITH {RP}, {_HH} SELECT h1, h2, n FROM hh")
def j8(spark, sf):
    return E.header_header(cut(pairs(spark, sf)))


@query("a11_entity_columns", f"WITH {EC} SELECT entity, t_id, c_id, count(*) AS n FROM ec GROUP BY ALL")
def a11(spark, sf):
    return E.entity_columns(entity_cells(spark, sf))


_TERMS = (
    "cp AS (SELECT DISTINCT t_id, lower(c_mktsegment || ' ' || o_orderpriority) AS caption FROM r0), "
    "tm AS (SELECT t_id, term, count(*) AS tf FROM (SELECT t_id, unnest(string_split_regex(translate(caption, '''.:,/()-+', '         '), '\\s+')) AS term FROM cp) WHERE term NOT IN ('', 'not') GROUP BY ALL), "
    "et AS (SELECT DISTINCT entity, t_id FROM ec WHERE c_id = 0), hd AS (SELECT DISTINCT t_id, c_name AS header FROM ec), "
    "ht AS (SELECT t_id, term, count(*) AS tf FROM (SELECT t_id, unnest(string_split(lower(header), ' ')) AS term FROM hd) GROUP BY ALL)"
)
STOP = ["not"]


def captions(spark, sf):
    return order_rows(spark, sf).select("t_id", F.lower(F.concat_ws(" ", "c_mktsegment", "o_orderpriority")).alias("caption")).distinct()


def caption_terms(caps):
    return caps.select("t_id", F.explode(S.clean_tokens("caption", STOP)).alias("term")).groupBy("t_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def header_terms(headers):
    return headers.select("t_id", F.explode(S.clean_tokens("header", STOP)).alias("term")).groupBy("t_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def headers(cells):
    return cells.select("t_id", F.col("c_name").alias("header")).distinct()


def core_tables(cells):
    return E.entity_tables(cells.where("c_id = 0"))


@query("a10_entity_term_freq", f"WITH {EC}, {_TERMS} SELECT entity, term, sum(tf)::BIGINT AS tf FROM et JOIN tm USING (t_id) GROUP BY ALL")
def a10_terms(spark, sf):
    return E.entity_term_freq(core_tables(entity_cells(spark, sf)), caption_terms(captions(spark, sf)))


@query("a10_entity_header_freq", f"WITH {EC}, {_TERMS} SELECT entity, header, count(*) AS n FROM et JOIN hd USING (t_id) GROUP BY ALL")
def a10_headers(spark, sf):
    cells = entity_cells(spark, sf)
    return E.entity_header_freq(core_tables(cells), headers(cells))


@query("a10_collection_term_freq", f"WITH {EC}, {_TERMS} SELECT term, sum(tf)::BIGINT AS ctf FROM tm GROUP BY 1")
def a10_collection(spark, sf):
    return E.collection_term_freq(caption_terms(captions(spark, sf)))


@query("a10_entity_tables", f"WITH {EC}, {_TERMS} SELECT entity, count(*) AS n_tables FROM et GROUP BY 1")
def a10_tables(spark, sf):
    return core_tables(entity_cells(spark, sf)).groupBy("entity").agg(F.count(F.lit(1)).alias("n_tables"))


# part and supplier reduced to few values, so that rows of one order do repeat
_EC2 = "e2 AS (SELECT t_id, r_id, c_id, CASE WHEN c_id = 0 THEN 'p' || (l_partkey % 3) ELSE 's' || (l_suppkey % 2) END AS entity FROM r0, (VALUES (0), (1)) c(c_id))"


def coarse_cells(spark, sf):
    cols = F.array(
        F.struct(F.lit(0).alias("c_id"), F.concat(F.lit("p"), (F.col("l_partkey") % 3).cast("string")).alias("entity")),
        F.struct(F.lit(1).alias("c_id"), F.concat(F.lit("s"), (F.col("l_suppkey") % 2).cast("string")).alias("entity")),
    )
    return order_rows(spark, sf).select("t_id", "r_id", F.inline(cols))


@query(
    "c11_dedupe_rows",
    f"WITH {_R0}, {_EC2}, v AS (SELECT t_id, r_id, list(entity ORDER BY c_id) AS v FROM e2 GROUP BY ALL), k AS (SELECT t_id, min(r_id) AS r_id FROM v GROUP BY t_id, v) "
    "SELECT t_id, r_id, c_id, entity FROM e2 JOIN k USING (t_id, r_id)",
)
def c11(spark, sf):
    return C.dedupe_rows(coarse_cells(spark, sf)).select("t_id", "r_id", "c_id", "entity")


_CHUNKS = (
    "sh AS (SELECT t_id, count(DISTINCT r_id) AS rows_, count(DISTINCT c_id) AS cols_ FROM ec GROUP BY 1), "
    "lm AS (SELECT t_id, greatest(1, floor(rows_ / ceil(rows_ * cols_ / 12)))::BIGINT AS lim FROM sh), "
    "ck AS (SELECT DISTINCT t_id, r_id, r_id // lim AS chunk FROM ec JOIN lm USING (t_id))"
)


@query("d1_chunk_tables", f"WITH {EC}, {_CHUNKS} SELECT t_id, r_id, chunk FROM ck")
def d1(spark, sf):
    return E.table_chunks(entity_cells(spark, sf), 12)


@query(
    "j16_visibility_edges",
    f"WITH {EC}, {_CHUNKS}, n AS (SELECT t_id, chunk, r_id AS r, c_id AS c FROM ec JOIN ck USING (t_id, r_id)), "
    "e AS (SELECT DISTINCT a.t_id, a.chunk, 'cell:' || a.r || ':' || a.c AS a, 'cell:' || b.r || ':' || b.c AS b FROM n a JOIN n b ON a.t_id = b.t_id AND a.chunk = b.chunk AND (a.r = b.r OR a.c = b.c) AND NOT (a.r = b.r AND a.c = b.c) "
    "UNION ALL SELECT t_id, chunk, 'header:' || c, 'cell:' || r || ':' || c FROM n UNION ALL SELECT t_id, chunk, 'cell:' || r || ':' || c, 'header:' || c FROM n UNION ALL SELECT t_id, chunk, 'title', 'cell:' || r || ':' || c FROM n) "
    "SELECT t_id, chunk, count(*) AS n_edges, min(a || '>' || b) AS lo, max(a || '>' || b) AS hi FROM e GROUP BY ALL",
)
def j16(spark, sf):
    e = E.visibility_edges(entity_cells(spark, sf), 12)
    edge = F.concat_ws(">", "a", "b")
    return e.groupBy("t_id", "chunk").agg(F.count(F.lit(1)).alias("n_edges"), F.min(edge).alias("lo"), F.max(edge).alias("hi"))


# every row asks for its subject's entity under the header "supplier O"
_ASK = "ak AS (SELECT DISTINCT e1 AS query_id, e1 AS subject, 'supplier O' AS header FROM rp), cd AS (SELECT DISTINCT query_id, ak.header, rp.c_name AS source, rp.e2 AS cand FROM ak JOIN rp ON rp.e1 = ak.subject)"


def asked(row_pairs):
    return row_pairs.select(F.col("e1").alias("query_id"), F.col("e1").alias("subject"), F.lit("supplier O").alias("header")).distinct()


@query("r8_cell_candidates", f"WITH {RP}, {_ASK} SELECT query_id, count(DISTINCT cand) AS n, count(*) AS n_sources FROM cd GROUP BY 1")
def r8(spark, sf):
    p = cut(pairs(spark, sf))
    return E.cell_candidates(asked(p), p).groupBy("query_id").agg(F.count_distinct("cand").alias("n"), F.count(F.lit(1)).alias("n_sources"))


@query(
    "r8_cell_candidates_related",
    f"WITH {RP}, {_HH}, {_ASK} SELECT query_id, count(DISTINCT cand) AS n FROM cd WHERE source = header OR source IN (SELECT h2 FROM hh WHERE h1 = 'supplier O') GROUP BY 1",
)
def r8_related(spark, sf):
    p = cut(pairs(spark, sf))
    return E.cell_candidates(asked(p), p, cut(E.header_header(p))).groupBy("query_id").agg(F.count_distinct("cand").alias("n"))


# the other entities of the columns that hold a supplier
@query(
    "r8_cell_candidates_by_column",
    f"WITH {EC}, co AS (SELECT DISTINCT entity, t_id, c_id FROM ec) SELECT a.entity AS query_id, b.entity AS cand, 1::BIGINT AS n_seeds, count(*) AS n_columns "
    "FROM co a JOIN co b USING (t_id, c_id) WHERE a.c_id = 1 GROUP BY ALL",
)
def r8_by_column(spark, sf):
    cells = cut(entity_cells(spark, sf))
    seeds = cells.where("c_id = 1").select(F.col("entity").alias("query_id"), F.col("entity").alias("seed")).distinct()
    return E.cell_candidates_by_column(seeds, cells)


def _rank_sql(score):
    return f"sc AS (SELECT query_id, cand, max({score}) AS score FROM cd LEFT JOIN hh ON h1 = header AND h2 = source GROUP BY ALL) SELECT query_id, cand, score::DOUBLE AS score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cand))::INTEGER AS rank FROM sc QUALIFY rank <= 100"


@query("r9_rank_cells_exact", f"WITH {RP}, {_HH}, {_ASK}, {_rank_sql('CASE WHEN source = header THEN 10000 ELSE -1 END')}")
def r9_exact(spark, sf):
    p = cut(pairs(spark, sf))
    return E.rank_cells(E.cell_candidates(asked(p), p), "exact")


@query("r9_rank_cells_h2h", f"WITH {RP}, {_HH}, {_ASK}, {_rank_sql('CASE WHEN source = header THEN 10000 ELSE coalesce(n, -1) END')}")
def r9_h2h(spark, sf):
    p = cut(pairs(spark, sf))
    hh = E.header_header(p).withColumnRenamed("n", "sim")
    return E.rank_cells(E.cell_candidates(asked(p), p), "h2h", hh)


@query(
    "r9_rank_cells_vector",
    f"WITH {RP}, {_HH}, {_ASK}, nn AS (SELECT h1, sqrt(sum(n * n)) AS l FROM hh GROUP BY 1), "
    "cs AS (SELECT a.h1 AS ha, b.h1 AS hb, sum(a.n * b.n) / (any_value(x.l) * any_value(y.l)) AS sim FROM hh a JOIN hh b ON a.h2 = b.h2 JOIN nn x ON x.h1 = a.h1 JOIN nn y ON y.h1 = b.h1 WHERE a.h1 <> b.h1 GROUP BY ALL), "
    "sc AS (SELECT query_id, cand, max(CASE WHEN source = header THEN 10000 ELSE coalesce(round(sim, 9), -1) END) AS score FROM cd LEFT JOIN cs ON ha = header AND hb = source GROUP BY ALL) "
    "SELECT query_id, cand, round(score, 6)::DOUBLE AS score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cand))::INTEGER AS rank FROM sc QUALIFY rank <= 100",
)
def r9_vector(spark, sf):
    from ..operators.lfs import sparse_cosine

    p = cut(pairs(spark, sf))
    hh = cut(E.header_header(p))
    v = hh.select(F.col("h1").alias("ha"), F.col("h2").alias("dim"), F.col("n").cast("double").alias("w"))
    sim = sparse_cosine(v, v.withColumnRenamed("ha", "hb"), "ha", "hb").where("ha <> hb")
    sim = sim.select(F.col("ha").alias("h1"), F.col("hb").alias("h2"), F.round("sim", 9).alias("sim"))
    return E.rank_cells(E.cell_candidates(asked(p), p), "vector", sim).withColumn("score", S.rnd("score"))


@query("r11_cell_fill_testset", f"WITH {RP} SELECT t_id, c_id, c_name, e1, e2 FROM rp WHERE (t_id, c_id) IN (SELECT (t_id, c_id) FROM rp GROUP BY t_id, c_id HAVING count(*) > 3)")
def r11(spark, sf):
    return E.cell_fill_testset(pairs(spark, sf))


@query("w8_kth_of_group", f"WITH {EC} SELECT t_id, entity FROM (SELECT t_id, entity, row_number() OVER (PARTITION BY t_id ORDER BY r_id, c_id) AS k FROM ec) WHERE k = 2")
def w8(spark, sf):
    return E.kth_of_group(entity_cells(spark, sf), ["t_id"], [F.col("r_id"), F.col("c_id")], 2).select("t_id", "entity")


# --- linking: a mention is a part's name in an order, candidates are the parts of that name. A number in the
# name keeps the ambiguity of a name the same at every scale, as in a real knowledge base -------------

_MN = (
    "mn AS (SELECT l_orderkey AS t_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS i, 0 AS j, p_name || ' ' || (p_partkey // 2000) AS surface, l_partkey AS gold, c_mktsegment AS page, l_quantity "
    "FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey), "
    "cn AS (SELECT p_name || ' ' || (p_partkey // 2000) AS surface, p_partkey AS cand, row_number() OVER (PARTITION BY p_name, p_partkey // 2000 ORDER BY p_retailprice DESC, p_partkey) AS pos FROM part WHERE p_size < 40)"
)


def part_name():
    return F.concat("p_name", F.lit(" "), F.floor(F.col("p_partkey") / 2000).cast("string"))


def mentions(spark, sf):
    rows = order_rows(spark, sf)
    p = X.base(spark, sf, "part")
    return rows.join(p, rows.l_partkey == p.p_partkey).select("t_id", F.col("r_id").alias("i"), F.lit(0).alias("j"), part_name().alias("surface"), F.col("l_partkey").alias("gold"), F.col("c_mktsegment").alias("page"))


def candidates(spark, sf):
    p = X.base(spark, sf, "part").where("p_size < 40")
    ranked = p.select(part_name().alias("surface"), F.col("p_partkey").alias("cand"), (-F.col("p_retailprice")).alias("neg"))
    from ..plans.ordered import position

    return position(ranked, ["surface"], ["neg", "cand"], "pos").drop("neg")


@query("e1_entity_mentions", f"WITH {_MN} SELECT surface, count(*) AS n, count(DISTINCT gold) AS n_gold, count(DISTINCT t_id) AS n_tables FROM mn GROUP BY 1")
def e1(spark, sf):
    # the nested form of the tables, read back by the double explode
    cell = F.struct(
        F.col("surface").alias("text"),
        F.array(F.struct("surface", F.struct(F.col("gold").alias("id"), F.col("surface").alias("title")).alias("target"))).alias("surfaceLinks"),
    )
    rows = mentions(spark, sf).select("t_id", "i", F.array(cell).alias("row"))
    nested = rows.groupBy(F.col("t_id").alias("_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "row"))), lambda x: x["row"]).alias("tableData"))
    m = E.read_mentions(nested)
    return m.groupBy("surface").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("entity").alias("n_gold"), F.count_distinct("t_id").alias("n_tables"))


@query("e2_decontaminate", f"WITH {_MN} SELECT page, count(*) AS n FROM mn WHERE page NOT IN (SELECT c_mktsegment FROM customer WHERE c_mktsegment LIKE 'M%') GROUP BY 1")
def e2(spark, sf):
    test_pages = X.base(spark, sf, "customer").where("c_mktsegment like 'M%'").select(F.col("c_mktsegment").alias("page"))
    return E.decontaminate(mentions(spark, sf), test_pages).groupBy("page").agg(F.count(F.lit(1)).alias("n"))


@query(
    "e3_with_candidates",
    f"WITH {_MN}, k AS (SELECT * FROM mn WHERE (surface, gold) IN (SELECT (surface, cand) FROM cn)) SELECT t_id, i, count(*) AS n_cand, min(pos) FILTER (WHERE cand = gold) AS gold_pos FROM k JOIN cn USING (surface) GROUP BY ALL",
)
def e3(spark, sf):
    long = E.with_candidates(mentions(spark, sf), candidates(spark, sf))
    return long.groupBy("t_id", "i").agg(F.count(F.lit(1)).alias("n_cand"), F.min(F.when(F.col("cand") == F.col("gold"), F.col("pos"))).alias("gold_pos"))


@query(
    "e4_linking_examples",
    f"WITH {_MN}, k AS (SELECT t_id, i, j, surface, gold, (row_number() OVER (PARTITION BY t_id ORDER BY i, j) - 1) // 4 AS chunk FROM mn WHERE (surface, gold) IN (SELECT (surface, cand) FROM cn)), "
    "l AS (SELECT t_id, chunk, i, cand, cand = gold AS g, dense_rank() OVER (PARTITION BY t_id, chunk ORDER BY cand) - 1 AS local_id FROM k JOIN cn USING (surface)) "
    "SELECT t_id, chunk, count(*) AS n, max(local_id) AS last_id, sum(local_id) FILTER (WHERE g)::BIGINT AS gold_ids FROM l GROUP BY ALL",
)
def e4(spark, sf):
    ex = E.linking_examples(mentions(spark, sf), cut(candidates(spark, sf)), 4)
    return ex.groupBy("t_id", "chunk").agg(F.count(F.lit(1)).alias("n"), F.max("local_id").alias("last_id"), F.sum(F.when(F.col("is_gold"), F.col("local_id"))).alias("gold_ids"))


@query(
    "e5_merge_fallback",
    f"WITH {_MN}, m AS (SELECT t_id, i, CASE WHEN i % 2 = 0 THEN '(' || surface || ')' ELSE surface END AS surface FROM mn), "
    "f AS (SELECT *, CASE WHEN surface IN (SELECT surface FROM cn) THEN surface ELSE regexp_replace(regexp_replace(surface, '^\\W', ''), '\\W$', '') END AS look FROM m) "
    "SELECT t_id, i, count(cand) AS n_cand FROM f LEFT JOIN cn ON cn.surface = look GROUP BY ALL",
)
def e5(spark, sf):
    m = mentions(spark, sf).withColumn("surface", F.when(F.col("i") % 2 == 0, F.concat(F.lit("("), "surface", F.lit(")"))).otherwise(F.col("surface")))
    return E.merge_fallback(m, candidates(spark, sf)).groupBy("t_id", "i").agg(F.count("cand").alias("n_cand"))


@query(
    "e6_mention_coverage",
    f"WITH {_MN} SELECT count(*) AS n, count(*) FILTER (WHERE surface NOT IN (SELECT p_name || ' ' || (p_partkey // 2000) FROM part WHERE p_type = 'PROMO')) AS n_unseen, "
    "count(*) FILTER (WHERE gold IN (SELECT p_partkey FROM part WHERE p_type <> 'SMALL')) AS n_typed, count(*) FILTER (WHERE gold IN (SELECT cand FROM cn)) AS n_in_vocabulary FROM mn",
)
def e6(spark, sf):
    p = X.base(spark, sf, "part")
    return E.mention_coverage(
        mentions(spark, sf), p.where("p_type = 'PROMO'").select(part_name().alias("surface")),
        p.where("p_type <> 'SMALL'").select(F.col("p_partkey").alias("entity")), candidates(spark, sf).select(F.col("cand").alias("entity")),
    )


def _systems(spark, sf):
    c = candidates(spark, sf)
    m = mentions(spark, sf).select("t_id", "i", "j", "surface", "gold")
    first = c.where("pos = 1").select("surface", F.col("cand").alias("pred"))
    low = c.groupBy("surface").agg(F.min("cand").alias("pred"))
    return m.join(first, "surface", "left"), m.join(low, "surface", "left")


@query(
    "e7_error_diff",
    f"WITH {_MN}, a AS (SELECT surface, cand AS p FROM cn WHERE pos = 1), b AS (SELECT surface, min(cand) AS p FROM cn GROUP BY 1), "
    "x AS (SELECT t_id, i, gold, a.p AS pred_a, b.p AS pred_b FROM mn LEFT JOIN a USING (surface) LEFT JOIN b USING (surface)) "
    "SELECT t_id, i, pred_a, pred_b, CASE WHEN pred_b = gold THEN 'only_b_right' ELSE 'only_a_right' END AS side FROM x WHERE (pred_a = gold) <> (pred_b = gold)",
)
def e7(spark, sf):
    a, b = _systems(spark, sf)
    return E.error_diff(a, b, ["t_id", "i", "j"]).select("t_id", "i", "pred_a", "pred_b", "side")


@query(
    "m10_linking_report",
    f"WITH {_MN}, a AS (SELECT surface, cand AS p FROM cn WHERE pos = 1), b AS (SELECT surface, min(cand) AS p FROM cn GROUP BY 1), "
    "x AS (SELECT gold, a.p AS first, b.p AS lookup, (surface, gold) IN (SELECT (surface, cand) FROM cn) AS il, ((gold * 7) % 10) / 10.0 AS score, ((gold * 3) % 10) / 10.0 AS ls FROM mn LEFT JOIN a USING (surface) LEFT JOIN b USING (surface)), "
    "y AS (SELECT gold, unnest(['model', 'lookup', 'fallback', 'oracle']) AS method, unnest([first, lookup, CASE WHEN lookup IS NULL OR 0.8 * score > ls THEN first ELSE lookup END, CASE WHEN il THEN gold END]) AS ans FROM x), "
    "g AS (SELECT method, count(*) AS n, count(ans) AS k, count(*) FILTER (WHERE ans = gold) AS tp FROM y GROUP BY 1) "
    "SELECT method, round(tp / k, 6) AS precision, round(tp / n, 6) AS recall, round(2 * tp / (k + n), 6) AS f1 FROM g",
)
def m10(spark, sf):
    a, b = _systems(spark, sf)
    both = a.withColumnRenamed("pred", "first").join(b.select("t_id", "i", "j", F.col("pred").alias("lookup")), ["t_id", "i", "j"])
    inside = candidates(spark, sf).select("surface", F.col("cand").alias("gold"), F.lit(True).alias("in_list")).distinct()
    scored = both.join(inside, ["surface", "gold"], "left").withColumns(
        {"in_list": F.coalesce("in_list", F.lit(False)), "score": (F.col("gold") * 7 % 10) / F.lit(10.0), "lookup_score": (F.col("gold") * 3 % 10) / F.lit(10.0)}
    )
    out = M.linking_report(scored)
    return out.select("method", *[S.rnd(c).alias(c) for c in ("precision", "recall", "f1")])


@query(
    "j13_attach_candidates",
    f"WITH {_MN}, c1 AS (SELECT surface, count(*) AS n_cand, min(cand) AS first_cand FROM cn GROUP BY 1), ids AS (SELECT p_name || ' ' || (p_partkey // 2000) AS title, min(p_partkey) AS id FROM part WHERE p_type <> 'SMALL' GROUP BY 1) "
    "SELECT surface AS mention, n_cand, first_cand, id, count(*) AS n FROM mn LEFT JOIN c1 USING (surface) JOIN ids ON title = surface GROUP BY ALL",
)
def j13(spark, sf):
    m = mentions(spark, sf).select(F.col("surface").alias("mention"), F.col("surface").alias("title"))
    c = candidates(spark, sf).groupBy(F.col("surface").alias("mention")).agg(F.count(F.lit(1)).alias("n_cand"), F.min("cand").alias("first_cand"))
    ids = X.base(spark, sf, "part").where("p_type <> 'SMALL'").groupBy(part_name().alias("title")).agg(F.min("p_partkey").alias("id"))
    return J.attach_candidates(m, c, ids).groupBy("mention", "n_cand", "first_cand", "id").agg(F.count(F.lit(1)).alias("n"))


# --- training samples ------------------------------------------------------------------------------


@query(
    "d2_entity_examples",
    f"WITH RECURSIVE {EC}, vo AS (SELECT entity FROM ec GROUP BY 1 HAVING count(*) >= 25), k0 AS (SELECT * FROM ec WHERE entity IN (SELECT entity FROM vo)), "
    "v AS (SELECT t_id, r_id, list(c_id || entity ORDER BY c_id) AS v FROM k0 GROUP BY ALL), f AS (SELECT t_id, min(r_id) AS r_id FROM v GROUP BY t_id, v), k1 AS (SELECT k0.* FROM k0 JOIN f USING (t_id, r_id)), "
    "co AS (SELECT t_id FROM k1 WHERE c_id = 0 GROUP BY 1 HAVING count(*) >= 3), "
    "ww AS (SELECT t_id, r_id, count(*) AS w FROM k1 WHERE t_id IN (SELECT t_id FROM co) GROUP BY ALL), rw AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY t_id ORDER BY r_id) AS i FROM ww), "
    # row by row: a chunk that has reached 8 cells is closed
    "ck AS (SELECT t_id, r_id, i, w AS held, 0 AS ch FROM rw WHERE i = 1 UNION ALL "
    "SELECT rw.t_id, rw.r_id, rw.i, CASE WHEN held >= 8 THEN rw.w ELSE held + rw.w END, CASE WHEN held >= 8 THEN ch + 1 ELSE ch END FROM ck JOIN rw ON rw.t_id = ck.t_id AND rw.i = ck.i + 1), "
    "it AS (SELECT k1.*, ch, row_number() OVER (PARTITION BY k1.t_id ORDER BY k1.r_id, c_id) AS pos, count(*) OVER (PARTITION BY k1.t_id) AS n FROM k1 JOIN ck USING (t_id, r_id)), "
    "sz AS (SELECT t_id, max(ch) AS la FROM it GROUP BY 1), nl AS (SELECT t_id, la, count(*) FILTER (WHERE ch = la) AS n_last FROM it JOIN sz USING (t_id) GROUP BY ALL) "
    "SELECT t_id, (CASE WHEN n_last < 3 AND la > 0 AND pos > n - 3 THEN la ELSE ch END)::BIGINT AS chunk, pos, r_id, c_id, entity FROM it JOIN nl USING (t_id)",
)
def d2(spark, sf):
    cells = entity_cells(spark, sf)
    vocab = cells.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).where("n >= 25")
    return D.entity_examples(cells, vocab, 8, 3)


_TOK = (
    "tk AS (SELECT doc_id, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos, unnest(string_split(text, ' ')) AS token FROM documents), "
    "vc AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS idx FROM (SELECT DISTINCT lang AS token FROM documents))"
)


@query(
    "d3_mask_tokens",
    f"WITH {_TOK}, h AS (SELECT *, md5('5|' || doc_id || '|' || pos)[1:8] AS u, md5('6|' || doc_id || '|' || pos)[1:8] AS k, md5('7|' || doc_id || '|' || pos)[1:8] AS d FROM tk), "
    "a AS (SELECT *, CASE WHEN u < '26666666' AND token NOT IN ('', 'the') THEN CASE WHEN k < 'cccccccc' THEN 'mask' WHEN k < 'e6666666' THEN 'swap' ELSE 'keep' END END AS action FROM h), "
    "s AS (SELECT a.*, vc.token AS w FROM a LEFT JOIN vc ON action = 'swap' AND idx = ('0x' || d)::BIGINT % (SELECT count(*) FROM vc)) "
    "SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE action = 'mask') AS n_mask, count(*) FILTER (WHERE action = 'swap') AS n_swap, count(*) FILTER (WHERE action = 'keep') AS n_keep, min(w) AS lo FROM s GROUP BY 1",
)
def d3(spark, sf):
    docs = X.base(spark, sf, "documents")
    tokens = docs.select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "token"))
    vocab = C.dense_encode(docs.withColumnRenamed("lang", "token"), "token", "idx")
    m = D.mask_positions(tokens, ["doc_id", "pos"], "token", vocab, special=["", "the"], seed=5)
    return m.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("action") == a).alias(f"n_{a}") for a in ("mask", "swap", "keep")],
        F.min(F.when(F.col("action") == "swap", F.col("new_token"))).alias("lo"),
    )


@query(
    "d3_mask_entities",
    f"WITH {EC}, h AS (SELECT CASE WHEN c_id = 0 THEN 'subject' ELSE 'object' END AS role, md5('2|' || t_id || '|' || r_id || '|' || c_id)[1:8] AS u, md5('3|' || t_id || '|' || r_id || '|' || c_id)[1:8] AS v FROM ec), "
    "k AS (SELECT role, CASE WHEN u < CASE role WHEN 'subject' THEN '40000000' ELSE '80000000' END THEN CASE WHEN v < CASE role WHEN 'subject' THEN '80000000' ELSE 'c0000000' END THEN 'both' ELSE 'entity' END END AS mask_kind FROM h) "
    "SELECT role, mask_kind, count(*) AS n FROM k GROUP BY ALL",
)
def d3_entities(spark, sf):
    items = entity_cells(spark, sf).withColumn("role", F.when(F.col("c_id") == 0, "subject").otherwise("object"))
    m = D.mask_entities(items, ["t_id", "r_id", "c_id"], {"subject": (0.25, 0.5), "object": (0.5, 0.75)}, 2)
    return m.groupBy("role", "mask_kind").agg(F.count(F.lit(1)).alias("n"))


# the streams run longer here than any example needs
@query(
    "d4_negative_candidates",
    "WITH ex AS (SELECT o_orderkey AS example_id, min(l_partkey) AS gold FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1), pv AS (SELECT DISTINCT l_orderkey AS example_id, l_partkey AS cand FROM lineitem), "
    "v0 AS (SELECT l_partkey AS entity, count(*) AS cnt, floor(log2(count(*)))::INTEGER AS cls FROM lineitem GROUP BY 1), vo AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY entity) AS place FROM v0), "
    "cl AS (SELECT cls, count(*) AS size, 2.0::DOUBLE ** (cls + 1) AS cap FROM vo GROUP BY 1), "
    "ar AS (SELECT example_id, cls, size, cap, i, md5('9|' || example_id || '|' || cls || '|' || i) AS h FROM ex, cl, range(1, 61) r(i) WHERE size > 40), "
    "tm AS (SELECT *, sum(-ln((('0x' || h[1:10])::BIGINT::DOUBLE + 1) / 1099511627776.0::DOUBLE)) OVER (PARTITION BY example_id, cls ORDER BY i) / (size * cap) AS time, "
    "floor((1 - (('0x' || h[11:20])::BIGINT::DOUBLE + 1) / 1099511627776.0::DOUBLE) * size)::BIGINT + 1 AS place FROM ar), "
    "dr AS (SELECT example_id, entity AS cand, time FROM tm JOIN vo USING (cls, place) WHERE (('0x' || h[21:30])::BIGINT::DOUBLE + 1) / 1099511627776.0::DOUBLE * cap <= cnt UNION ALL "
    "SELECT example_id, entity, -ln((('0x' || md5('10|' || example_id || '|' || cls || '|' || place)[1:10])::BIGINT::DOUBLE + 1) / 1099511627776.0::DOUBLE) / cnt FROM ex, vo JOIN cl USING (cls) WHERE size <= 40), "
    "al AS (SELECT example_id, cand, 2 AS prio, time FROM dr UNION ALL SELECT example_id, gold, 0, 0 FROM ex UNION ALL SELECT example_id, cand, 1, 0 FROM pv), "
    "u AS (SELECT example_id, cand, min(prio) AS prio, min(time) AS time FROM al GROUP BY ALL) "
    "SELECT example_id, cand, (row_number() OVER (PARTITION BY example_id ORDER BY prio, CASE WHEN prio = 2 THEN time ELSE 0 END, cand))::INTEGER AS slot, CASE prio WHEN 0 THEN 'gold' WHEN 1 THEN 'provided' ELSE 'random' END AS kind FROM u QUALIFY slot <= 10",
)
def d4(spark, sf):
    li = X.base(spark, sf, "lineitem")
    ex = li.groupBy(F.col("l_orderkey").alias("example_id")).agg(F.min("l_partkey").alias("gold"))
    given = li.select(F.col("l_orderkey").alias("example_id"), F.col("l_partkey").alias("cand")).distinct()
    vocab = li.groupBy(F.col("l_partkey").alias("entity")).agg(F.count(F.lit(1)).alias("cnt"))
    return D.negative_candidates(cut(ex), cut(given), vocab, 10, 9)


@query(
    "d6_header_examples",
    f"WITH {X.columns_cte()} SELECT table_id, first(header ORDER BY col_idx) AS seed, array_to_string(list_sort(list_distinct(list(header ORDER BY col_idx)[2:])), '|') AS target FROM columns_ GROUP BY 1 HAVING count(*) > 1",
)
def d6(spark, sf):
    return D.header_examples(X.columns(spark, sf)).withColumn("target", F.array_join("target", "|"))


@query(
    "d7_relation_pairs",
    f"WITH {X.columns_cte()} SELECT a.table_id, b.col_idx, a.header AS subject, b.header AS object, array_to_string(list_sort(list_distinct([a.semantic_type || '/' || b.semantic_type, 'any'])), '|') AS labels "
    "FROM columns_ a JOIN columns_ b ON a.table_id = b.table_id AND a.col_idx = 0 AND b.col_idx > 0",
)
def d7(spark, sf):
    cols = X.columns(spark, sf)
    first = cols.where("col_idx = 0").select("table_id", F.col("semantic_type").alias("s"))
    rel = cols.where("col_idx > 0").join(first, "table_id").select("table_id", "col_idx", F.explode(F.array(F.concat_ws("/", "s", "semantic_type"), F.lit("any"))).alias("relation"))
    return D.relation_pairs(cols, rel).select("table_id", "col_idx", "subject", "object", F.array_join("labels", "|").alias("labels"))
