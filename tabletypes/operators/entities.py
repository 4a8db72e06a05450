"""Entity tables: cells linked to entities, their co-occurrence, cell filling and graph edges.

``entity_cells(t_id, r_id, c_id, c_name, entity)``; the subject column is number 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordered import running, top
from ..plans.session import cut
from ..plans.skew import CELL_ROWS, LIST_ROWS, heavy_light_join, listed


def same_row_pairs(entity_cells: DataFrame) -> DataFrame:
    """Subject entity ``e1`` with every other entity ``e2`` of its row and the header it stands under."""
    subject = entity_cells.where("c_id = 0").select("t_id", "r_id", F.col("entity").alias("e1"))
    other = entity_cells.where("c_id <> 0").select("t_id", "r_id", "c_id", "c_name", F.col("entity").alias("e2"))
    return subject.join(other, ["t_id", "r_id"])


def header_header(row_pairs: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Pairs of different headers that hold the same (e1, e2), with the number of different table pairs.

    Tables with exactly the same entity pairs and headers form a class that is joined once; its members
    enter the count as a product, and travel with it. A pair of entities that many tables hold is joined in blocks.
    """
    rows = row_pairs.select("t_id", "e1", "e2", F.col("c_name").alias("h")).distinct()
    item = F.xxhash64("e1", "e2", "h")
    prints = rows.groupBy("t_id").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(item).alias("f1"), F.sum(item.cast("decimal(38,0)")).alias("f2"))
    classes = prints.groupBy("n", "f1", "f2").agg(F.min("t_id").alias("t_id"), F.count(F.lit(1)).alias("w"))
    reps = cut(rows.join(classes.select("t_id", "w"), "t_id"))
    a = reps.select(F.col("t_id").alias("t1"), F.col("w").alias("w1"), "e1", "e2", F.col("h").alias("h1"))
    b = reps.select(F.col("t_id").alias("t2"), F.col("w").alias("w2"), "e1", "e2", F.col("h").alias("h2"))
    met = heavy_light_join(a, b, ["e1", "e2"], cell_rows).where("h1 < h2").select("t1", "t2", "h1", "h2", "w1", "w2").distinct()
    one = met.groupBy("h1", "h2").agg(F.sum(F.col("w1") * F.col("w2")).alias("n"))
    both = F.array(F.struct("h1", "h2"), F.struct(F.col("h2").alias("h1"), F.col("h1").alias("h2")))  # the pairs of headers are the same read either way
    return one.select(F.inline(both), "n").select("h1", "h2", "n")


def entity_columns(entity_cells: DataFrame) -> DataFrame:
    """Entity to the columns that hold it, and read the other way column to entities: long form, any size."""
    return entity_cells.groupBy("entity", "t_id", "c_id").agg(F.count(F.lit(1)).alias("n"))


def entity_tables(entity_cells: DataFrame) -> DataFrame:
    return entity_cells.select("entity", "t_id").distinct()


def entity_term_freq(tables_of: DataFrame, terms: DataFrame) -> DataFrame:
    """Term counts over the captions (or headers) of an entity's tables; ``terms(t_id, term, tf)``."""
    return tables_of.join(terms, "t_id").groupBy("entity", "term").agg(F.sum("tf").alias("tf"))


def entity_header_freq(tables_of: DataFrame, headers: DataFrame) -> DataFrame:
    """Number of an entity's tables that have each header; ``headers(t_id, header)``."""
    return tables_of.join(headers.select("t_id", "header").distinct(), "t_id").groupBy("entity", "header").agg(F.count(F.lit(1)).alias("n"))


def collection_term_freq(terms: DataFrame) -> DataFrame:
    return terms.groupBy("term").agg(F.sum("tf").alias("ctf"))


def table_chunks(entity_cells: DataFrame, max_cell: int) -> DataFrame:
    """Chunk of near-equal size of each row so that a chunk has at most ``max_cell`` cells (one row at least)."""
    shape = entity_cells.groupBy("t_id").agg(F.count_distinct("r_id").alias("rows"), F.count_distinct("c_id").alias("cols"))
    pieces = F.ceil(F.col("rows") * F.col("cols") / max_cell)
    limit = F.greatest(F.lit(1), F.floor(F.col("rows") / pieces))
    rows = entity_cells.select("t_id", "r_id").distinct()
    numbered = running(rows, ["t_id"], ["r_id"], {"p": F.lit(1).cast("long")})
    return numbered.join(shape.select("t_id", limit.alias("limit")), "t_id").select("t_id", "r_id", F.floor((F.col("p") - 1) / F.col("limit")).cast("long").alias("chunk"))


def visibility_edges(entity_cells: DataFrame, max_cell: int = 100) -> DataFrame:
    """Pairs of cells that see each other: same row or same column of one chunk; header and its cells; title and all.

    Edges exist inside chunks of bounded size, so they grow with the number of cells. A chunk's cells come together once and its
    edges are made there: no edge is shuffled.
    """
    chunks = table_chunks(entity_cells, max_cell)
    cells = entity_cells.select("t_id", "r_id", "c_id").distinct().join(chunks, ["t_id", "r_id"])
    packed = cells.groupBy("t_id", "chunk").agg(F.collect_list(F.struct("r_id", "c_id")).alias("cells"))  # a chunk's, or one row's
    here = packed.select("t_id", "chunk", "cells", F.explode("cells").alias("x"))

    def node(x):
        return F.concat_ws(":", F.lit("cell"), x["r_id"], x["c_id"])

    def beside(x):
        return ((x["r_id"] == F.col("x.r_id")) | (x["c_id"] == F.col("x.c_id"))) & (node(x) != F.col("a"))

    def edge(a, b):
        return F.struct(a.alias("a"), b.alias("b"))

    a, header, title = F.col("a"), F.concat_ws(":", F.lit("header"), F.col("x.c_id")), F.lit("title")
    here = here.withColumn("a", node(F.col("x")))
    seen = F.transform(F.filter("cells", beside), lambda y: edge(a, node(y)))
    return here.select("t_id", "chunk", F.inline(F.concat(seen, F.array(edge(header, a), edge(a, header), edge(title, a)))))


def cell_candidates(asked: DataFrame, row_pairs: DataFrame, related: DataFrame | None = None) -> DataFrame:
    """Entities seen in a row with the subject, with the headers they stood under; ``asked(query_id, subject, header)``.

    With ``related(h1, h2)`` only headers that are the asked one or related to it count, unless the asked
    header has no relations at all.
    """
    seen = row_pairs.select(F.col("e1").alias("subject"), F.col("c_name").alias("source"), F.col("e2").alias("cand")).distinct()
    got = asked.join(seen, "subject")
    if related is not None:
        rel = related.select(F.col("h1").alias("header"), F.col("h2").alias("source"), F.lit(True).alias("ok")).distinct()
        known = related.select(F.col("h1").alias("header"), F.lit(True).alias("any")).distinct()
        got = got.join(rel, ["header", "source"], "left").join(known, "header", "left")
        got = got.where(F.col("ok") | F.col("any").isNull() | (F.col("source") == F.col("header"))).drop("ok", "any")
    return got.select("query_id", "subject", "header", "source", "cand")


def cell_candidates_by_column(seeds: DataFrame, columns: DataFrame) -> DataFrame:
    """(query_id, cand, n_seeds, n_columns): entities of the columns that hold a seed, with the number of the query's seeds and of such columns they share.

    ``seeds(query_id, seed)``; ``columns(entity, t_id, c_id)``. Queries with the same seeds share the work.
    """
    packed = seeds.groupBy("query_id").agg(F.array_sort(F.collect_set("seed")).alias("seeds")).withColumn("sid", F.unhex(F.md5(F.to_json("seeds"))))
    asked = packed.select("sid", F.explode("seeds").alias("entity")).distinct()
    held = columns.select("entity", "t_id", "c_id").distinct()
    # a column travels once with the query's seeds it holds and lists of its entities, which are opened with the query; equal sets of seeds are counted together
    hits = asked.join(held, "entity").groupBy("sid", "t_id", "c_id").agg(F.array_sort(F.collect_list("entity")).alias("seeds"))
    along = Window.partitionBy("t_id", "c_id").orderBy("entity")
    pieces = held.where("entity IS NOT NULL").withColumn("piece", F.floor((F.row_number().over(along) - 1) / LIST_ROWS))
    lists = pieces.groupBy("t_id", "c_id", "piece").agg(F.collect_list("entity").alias("cands"))
    met = hits.join(lists, ["t_id", "c_id"]).select("sid", "seeds", "cands").repartition("sid")
    met = met.select("sid", "seeds", F.explode("cands").alias("cand")).groupBy("sid", "cand", "seeds").agg(F.count(F.lit(1)).alias("n"))
    each = met.select("sid", "cand", "n", F.posexplode("seeds").alias("at", "seed"))
    counted = each.groupBy("sid", "cand").agg(F.count_distinct("seed").alias("n_seeds"), F.sum(F.when(F.col("at") == 0, F.col("n"))).alias("n_columns"))
    return packed.select("query_id", "sid").join(counted, "sid").select("query_id", "cand", "n_seeds", "n_columns")


def rank_cells(candidates: DataFrame, method: str, similarity: DataFrame | None = None, n: int = 100) -> DataFrame:
    """Best ``n`` candidates per query. Same header scores 10000; another one -1 (``exact``) or the given
    similarity of the headers (``h2h`` co-occurrence count, ``vector`` cosine; -1 where unknown)."""
    if method == "exact":
        scored = candidates.withColumn("s", F.lit(-1.0))
    else:
        sim = similarity.select(F.col("h1").alias("header"), F.col("h2").alias("source"), F.col("sim").cast("double").alias("sim"))
        scored = candidates.join(sim, ["header", "source"], "left").withColumn("s", F.coalesce("sim", F.lit(-1.0)))
    score = F.max(F.when(F.col("source") == F.col("header"), F.lit(10000.0)).otherwise(F.col("s"))).alias("score")
    best = scored.groupBy("query_id", "cand").agg(score)
    return top(best, ["query_id"], [F.desc("score"), F.col("cand")], n)


def cell_fill_testset(row_pairs: DataFrame, more_than: int = 3) -> DataFrame:
    """(subject, object) pairs of the non-subject columns with more than ``more_than`` pairs."""
    sizes = row_pairs.groupBy("t_id", "c_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > more_than)
    return row_pairs.join(sizes.select("t_id", "c_id"), ["t_id", "c_id"], "left_semi").select("t_id", "c_id", "c_name", "e1", "e2")


def kth_of_group(df: DataFrame, keys: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The ``k``-th row of every group."""
    return top(df, keys, order, k, "__r").where(F.col("__r") == k).drop("__r")


# --- entity linking --------------------------------------------------------------------------------


def read_mentions(tables: DataFrame) -> DataFrame:
    """(t_id, i, j, surface, entity, title) of the linked cells of nested tables with ``tableData[][]``."""
    rows = tables.select(F.col("_id").alias("t_id"), F.posexplode("tableData").alias("i", "row"))
    cells = rows.select("t_id", "i", F.posexplode("row").alias("j", "cell"))
    links = cells.select("t_id", "i", "j", F.element_at(F.filter("cell.surfaceLinks", lambda x: x["target"]["id"].isNotNull()), 1).alias("link"))
    return links.where("link is not null").select("t_id", "i", "j", F.col("link.surface").alias("surface"), F.col("link.target.id").alias("entity"), F.col("link.target.title").alias("title"))


def flatten_header(header_cells: DataFrame) -> DataFrame:
    """Header text of every column: its header cells joined in row order; ``header_cells(table_id, row_id, col_idx, text)``
    (a table has a few header rows)."""
    packed = header_cells.groupBy("table_id", "col_idx").agg(F.array_sort(F.collect_list(F.struct("row_id", "text"))).alias("h"))
    return packed.select("table_id", "col_idx", F.array_join("h.text", " ").alias("header"))


def decontaminate(mentions: DataFrame, test_pages: DataFrame, page: str = "page") -> DataFrame:
    """Drop training mentions whose page is part of the test corpus."""
    return mentions.join(test_pages.select(page).distinct(), page, "left_anti")


def with_known_gold(mentions: DataFrame, candidates: DataFrame) -> DataFrame:
    """The mentions whose gold is among the candidates of their surface."""
    hit = candidates.select("surface", F.col("cand").alias("gold")).distinct()
    return mentions.join(hit, ["surface", "gold"], "left_semi")


def with_candidates(mentions: DataFrame, candidates: DataFrame, gold_only: bool = True, lists: bool = False) -> DataFrame:
    """Join mentions with the candidates of their surface, long form (one row per candidate with its position).

    Mentions without candidates drop out; with ``gold_only`` also those whose gold is not among them.
    ``candidates(surface, pos, cand)``. Lists of popular surfaces stay spread over rows. With ``lists`` a row holds an array of candidates
    in place of one of them and its position; a long list comes in several rows.
    """
    kept = with_known_gold(mentions, candidates) if gold_only else mentions
    return kept.join(listed(candidates.select("surface", "cand"), "surface", "cand") if lists else candidates, "surface")


def linking_examples(mentions: DataFrame, candidates: DataFrame, chunk: int = 50) -> DataFrame:
    """Mentions with known gold of a table in chunks of ``chunk`` with a shared candidate vocabulary per chunk.

    Every (mention, candidate) row gets the candidate's local id in the chunk and whether it is the gold. Mentions are numbered before they get their
    candidates, and travel to their chunk with lists of them; the lists are opened there.
    """
    kept = cut(with_known_gold(mentions, candidates).select("t_id", "i", "j", "surface", "gold"))
    numbered = running(kept.select("t_id", "i", "j").distinct(), ["t_id"], ["i", "j"], {"p": F.lit(1).cast("long")})
    placed = numbered.select("t_id", "i", "j", F.floor((F.col("p") - 1) / chunk).cast("long").alias("chunk"))
    asked = kept.join(placed, ["t_id", "i", "j"]).select("t_id", "chunk", "i", "j", "surface", "gold")
    held = with_candidates(asked, candidates, False, True).drop("surface").repartition("t_id", "chunk")
    rows = held.withColumn("cand", F.explode("cand"))
    local = F.dense_rank().over(Window.partitionBy("t_id", "chunk").orderBy("cand")).cast("long") - 1  # bounded by the lists of a chunk's mentions
    return rows.select("t_id", "chunk", "i", "j", "cand", local.alias("local_id"), (F.col("cand") == F.col("gold")).alias("is_gold"))


def merge_fallback(mentions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates of the surface, or of the surface without its outer non-word characters where there are none."""
    from ..functions.scalars import strip_nonword

    have = candidates.select("surface").distinct()
    plain = mentions.join(have, "surface", "left_semi").withColumn("look", F.col("surface"))
    rest = mentions.join(have, "surface", "left_anti").withColumn("look", strip_nonword("surface"))
    return plain.unionByName(rest).join(candidates.withColumnRenamed("surface", "look"), "look", "left")


def mention_coverage(mentions: DataFrame, seen: DataFrame, typed: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Counts of mentions: all, unseen surface, gold with a type, gold in the vocabulary."""
    s = seen.select("surface", F.lit(1).alias("s")).distinct()
    t = typed.select(F.col("entity").alias("gold"), F.lit(1).alias("t")).distinct()
    v = vocabulary.select(F.col("entity").alias("gold"), F.lit(1).alias("v")).distinct()
    j = mentions.join(s, "surface", "left").join(t, "gold", "left").join(v, "gold", "left")
    return j.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("s").isNull()).alias("n_unseen"), F.count("t").alias("n_typed"), F.count("v").alias("n_in_vocabulary")
    )


def error_diff(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Cases one system gets right and the other wrong; both ``(keys, gold, pred)``."""
    x = a.select(*keys, "gold", F.col("pred").alias("pred_a"))
    y = b.select(*keys, F.col("pred").alias("pred_b"))
    both = x.join(y, keys)
    ra, rb = F.col("pred_a").eqNullSafe(F.col("gold")), F.col("pred_b").eqNullSafe(F.col("gold"))
    side = F.when(~ra & rb, "only_b_right").when(ra & ~rb, "only_a_right")
    return both.withColumn("side", side).where("side is not null")
