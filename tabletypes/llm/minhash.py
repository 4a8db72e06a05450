"""Near-duplicate documents: universal-hash minima, banding, signature verification, exact confirmation, components.

Lost links: a pair at the threshold 0.8 shares no band with probability (1 - 0.8^5)^32 = 3e-6. Everything after the
bands is exact: a bucket links its members to its smallest one, and where its members are then still in several components, these are
compared in blocks through the rarest shingles of their whole sets. No pairs but confirmed links leave a task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabletypes.plans.session import cut

from .arrays import column_bytes, mix, shingle_sets
from .components import components

BANDS, ROWS = 32, 5
BLOCK = 2000  # members of a bucket that one task compares
_random = np.random.default_rng(20_240_607)
FACTORS = (_random.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1))[:, None]
SHIFTS = _random.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)[:, None]


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minimum of each hash function over the shingles, in blocks that fit a core's cache."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(FACTORS), np.uint32(0xFFFFFFFF))
    for a in range(0, len(x), 1024):
        np.minimum(best, (FACTORS * x[None, a : a + 1024] + SHIFTS).min(axis=1), out=best)
    return best


def _signatures(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, k1, k2, sig, keys = [], [], [], [], []
            for s in shingle_sets(*column_bytes(batch.column(1)), size):
                n.append(len(s))
                k1.append(int(mix(s).sum(dtype=np.uint64).view(np.int64)))
                k2.append(int(np.bitwise_xor.reduce(mix(s + np.uint64(0x51ED))).view(np.int64)) if len(s) else 0)
                best = signature(s)
                sig.append((best & np.uint32(0xFF)).astype(np.uint8).tobytes() if len(s) else None)
                bands = mix(mix(best[0::ROWS].astype(np.uint64)) + np.arange(BANDS, dtype=np.uint64))
                for r in range(1, ROWS):
                    bands = mix(bands * np.uint64(0x9E3779B97F4A7C15) + best[r::ROWS])
                keys.append(bands.tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sig, pa.binary()), pa.array(keys, pa.binary())], names=["id", "n", "k1", "k2", "sig", "bands"])

    return run


Sets = Callable[[np.ndarray, np.ndarray], Iterator[np.ndarray]]  # offsets and bytes of texts to their sorted distinct shingles


def likely(percent: int, total: int = BANDS * ROWS):
    """Pairs whose signatures (a byte of each minimum) agree often enough; five and a half standard deviations below the threshold stay."""
    p = percent / 100
    least = total * p - 5.5 * math.sqrt(total * p * (1 - p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, total) for i in (2, 3))
                batch = batch.filter(pa.array((x == y).sum(axis=1) >= least))
            yield batch.select(["u", "v"])

    return run


def confirmed(sets_of: Sets, percent: int):
    """Pairs whose whole sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = zip(*(sets_of(*column_bytes(batch.column(i))) for i in (2, 3)), strict=True)
            keep = []
            for x, y in sets:
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(bool(100 * both >= percent * (len(x) + len(y) - both)) and both > 0)
            yield batch.filter(pa.array(keep, pa.bool_())).select(["u", "v"])

    return run


def both_sides(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """Pairs (u, v) with the column of either side."""
    x = table.select(F.col("id").alias("u"), F.col(column).alias("x"))
    y = table.select(F.col("id").alias("v"), F.col(column).alias("y"))
    return pairs.join(x.hint("merge"), "u").join(y.hint("merge"), "v").select("u", "v", "x", "y")


def _links(pairs: DataFrame, reps: DataFrame, texts: DataFrame, sets_of: Sets, percent: int) -> DataFrame:
    close = cut(both_sides(pairs, reps, "sig").mapInArrow(likely(percent), "u long, v long"))
    ids = close.select(F.col("u").alias("id")).unionByName(close.select(F.col("v").alias("id"))).distinct()
    needed = texts.join(ids.hint("shuffle_hash"), "id")
    return both_sides(close, needed, "text").mapInArrow(confirmed(sets_of, percent), "u long, v long")


def confirmed_links(ids: np.ndarray, component: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between components among a few thousand sets, enough to join all that belong together.

    A set of n shingles that reaches the threshold with another shares ceil(percent * n / 100) with it, so in one order for all, here by
    frequency, the first n - that + 1 shingles of both have one in common. Only sets that meet so are compared, as wholes.
    """
    n = np.array([len(s) for s in sets], np.int64)
    doc = np.repeat(np.arange(len(sets)), n)
    _, token, often = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True, return_counts=True)
    place = np.empty(len(often), np.int64)
    place[np.argsort(often, kind="stable")] = np.arange(len(often))
    token = place[token]
    order = np.lexsort((token, doc))
    token, begin = token[order], np.cumsum(n) - n
    in_prefix = np.arange(len(token)) - begin[doc] < (n - -(-n * percent // 100) + 1)[doc]

    def postings(docs: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        by = np.argsort(tokens, kind="stable")
        return docs[by], np.searchsorted(tokens[by], np.arange(len(often) + 1))

    rare, rare_at = postings(doc[in_prefix], token[in_prefix])
    every, every_at = postings(doc, token)
    parent = {int(c): int(c) for c in component}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    links = []
    for x in range(len(sets)):
        mine = token[begin[x] : begin[x] + n[x]]
        heads = mine[in_prefix[begin[x] : begin[x] + n[x]]]
        heads = heads[rare_at[heads + 1] - rare_at[heads] > 1]
        if not len(heads):
            continue
        met = np.unique(np.concatenate([rare[rare_at[t] : rare_at[t + 1]] for t in heads]))
        met = met[(met > x) & (100 * n[met] >= percent * n[x]) & (100 * n[x] >= percent * n[met]) & (component[met] != component[x])]
        if not len(met):
            continue
        if len(met) < 8:
            both = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for y in met])
        else:
            both = np.bincount(np.concatenate([every[every_at[t] : every_at[t + 1]] for t in mine]), minlength=len(sets))[met]
        for y in met[100 * both >= percent * (n[x] + n[met] - both)]:
            a, b = root(int(component[x])), root(int(component[y]))
            if a != b:
                parent[a] = b
                links.append((int(ids[x]), int(ids[y])))
    return links


def _settle(sets_of: Sets, percent: int):
    def run(table: pa.Table) -> pa.Table:
        ids, first = np.unique(table.column("id").to_numpy(), return_index=True)
        component = table.column("component").to_numpy()[first]
        links = []
        if len(np.unique(component)) > 1:
            sets = list(sets_of(*column_bytes(table.column("text").take(pa.array(first)))))
            links = confirmed_links(ids, component, sets, percent)
        return pa.table({"u": pa.array([x for x, _ in links], pa.int64()), "v": pa.array([y for _, y in links], pa.int64())})

    return run


def open_links(found: DataFrame, texts: DataFrame, sets_of: Sets, percent: int, block: int = BLOCK) -> DataFrame:
    """Links between components that meet in a bucket; ``found``: (key, id, component).

    Small buckets are put together into tasks of some thousand members, large ones are split into blocks, and each pair of blocks is a
    task. Tasks compare what they hold exactly and emit at most one link for each two components.
    """
    open_ = found.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count("*").alias("members")).where("c0 < c1")
    rows = cut(found.join(open_.select("key", "members"), "key"))
    bins = max(1, rows.count() // block)
    parts = F.ceil(F.col("members") / block).cast("int")
    rows = rows.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    small = rows.where("parts = 1").select("id", "component", F.pmod("key", F.lit(bins)).alias("key"), F.lit(-1).alias("p"), F.lit(-1).alias("q")).distinct()
    large = rows.where("parts > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    large = large.select("id", "component", "key", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"))
    needed = texts.join(rows.select("id").distinct().hint("shuffle_hash"), "id").dropDuplicates(["id"]).select("id", "text")
    return small.unionByName(large).join(needed.hint("merge"), "id").groupBy("key", "p", "q").applyInArrow(_settle(sets_of, percent), "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of ``docs``.

    Words are runs of non-white bytes with A-Z in lower case; a document's set is its distinct shingles of ``size`` words, the whole
    sequence when it has fewer words. Documents whose sets reach ``percent`` (of the union) are linked; component_id
    is the smallest id that links reach, kept marks that document.
    Null, empty or blank texts have an empty set and are linked with nothing; a row without an id is its own component (null) and kept.
    Rows that share an id are taken as repeats of one document. Exact copies of a set are handled once. Other columns of ``docs`` are not read.
    """
    sets_of = partial(shingle_sets, size=size)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sigs = cut(texts.mapInArrow(_signatures(size), "id long, n long, k1 long, k2 long, sig binary, bands binary"))
    live = sigs.where("n > 0 AND id IS NOT NULL")
    classes = live.groupBy("n", "k1", "k2").agg(F.min(F.struct("id", "sig", "bands")).alias("first"))
    classes = cut(classes.select("n", "k1", "k2", F.col("first.id").alias("id"), F.col("first.sig").alias("sig"), F.col("first.bands").alias("bands")))
    reps = classes.select("id", "n", "sig", "bands").dropDuplicates(["id"])
    keys = [F.xxhash64(F.expr(f"substring(bands, {8 * b + 1}, 8)")) for b in range(BANDS)]
    keyed = reps.select("id", F.explode(F.array(*keys)).alias("key"))
    heads = keyed.groupBy("key").agg(F.min("id").alias("head"), F.max("id").alias("last")).where("head < last")
    met = cut(keyed.join(heads.select("key", "head"), "key"))
    stars = met.where("id != head").select(F.col("id").alias("u"), F.col("head").alias("v")).distinct()
    links = cut(_links(stars, reps, texts, sets_of, percent))
    first = components(links)
    found = met.join(first, "id", "left").select("id", "key", F.coalesce("component", "id").alias("component"))
    more = cut(open_links(found, texts, sets_of, percent))
    copies = live.join(classes.select("n", "k1", "k2", F.col("id").alias("v")), ["n", "k1", "k2"]).select(F.col("id").alias("u"), "v")
    found = components(links.unionByName(more))
    rep = copies.join(found.withColumnRenamed("id", "v"), "v", "left").groupBy("u").agg(F.min(F.coalesce("component", "v")).alias("component"))
    out = sigs.select("id", "n").join(rep.withColumnRenamed("u", "id"), "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
