"""Exact top-k search by inner product, as tiled matrix products.

Vectors are scaled to integers and packed into blocks on the map side. Query blocks form tiles and all blocks form shards; a cell is one
tile against one shard. A cell holds its tile, streams the shard's blocks, and multiplies piece by piece; of each product only entries that reach
a query's k-th score so far are looked at. The cells' lists are merged in a tree, ``FAN`` shards at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabletypes.plans.session import cut

from .suffix_index import _pack, _unpack

BLOCK = 1024  # vectors in a block
TILE_VALUES, SHARD_VALUES = 1 << 20, 1 << 22  # components a tile and a shard hold on average
PIECE = 2048  # queries multiplied at once
FAN = 8  # lists merged by one task
CELLS_PER_CORE = 4  # cells wanted on small tables, so that all cores have work
MOST_PARTITIONS = 100_000
SMALLEST = np.iinfo(np.int64).min


def quantised(column: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """floor(scale * x) of all components, the vectors' lengths, and which vectors are whole (neither null nor with a null or non-finite component)."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.fill_null(column.flatten().cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    good = np.isfinite(flat)
    row = np.repeat(np.arange(len(lengths)), lengths)
    whole = column.is_valid().to_numpy(zero_copy_only=False) & (np.bincount(row[~good], minlength=len(lengths)) == 0)
    return np.floor(scale * np.where(good, flat, 0.0)), lengths, whole


def _narrow(values: np.ndarray) -> tuple[str, bytes]:
    """The values in the smallest integer type that holds them."""
    most = float(np.abs(values).max(initial=0.0))
    if most >= 2.0**62:
        raise ValueError("scaled components do not fit into a long")
    kind = next(t for t, top in (("i1", 127), ("i2", 32767), ("i4", 2**31 - 1), ("i8", 2**63)) if most <= top)
    return kind, values.astype(kind).tobytes()


def _blocks(scale: int, every: int):
    """Map side: blocks of vectors of one length, queries (ids divisible by ``every``) and all vectors apart."""

    def pack(rows: list[tuple[np.ndarray, np.ndarray]], size: int) -> Iterator[tuple]:
        ids, values = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
        for is_query, take in ((True, np.flatnonzero(ids % every == 0)), (False, np.arange(len(ids)))):
            for a in range(0, len(take), BLOCK):
                part = take[a : a + BLOCK]
                kind, blob = _narrow(values[part])
                yield is_query, size, len(part), kind, ids[part].tobytes(), blob

    def table(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.bool_(), pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], names=["is_query", "size", "n", "kind", "ids", "vectors"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            ids = pc.fill_null(batch.column(0), 0).to_numpy(zero_copy_only=False)
            values, lengths, whole = quantised(batch.column(1), scale)
            whole &= batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            start = np.cumsum(lengths) - lengths
            for size in np.unique(lengths[whole]).tolist():
                rows = np.flatnonzero(whole & (lengths == size))
                held.setdefault(size, []).append((ids[rows], values[start[rows, None] + np.arange(size)]))
                if sum(len(r[0]) for r in held[size]) >= 16 * BLOCK:
                    yield table(list(pack(held.pop(size), size)))
        for size, rows in held.items():
            yield table(list(pack(rows, size)))

    return run


def best(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (query, vec, score) of each query, ties to the smaller id; a pair that is there twice counts with its best score."""
    order = np.lexsort((-score, vec, query))
    query, vec, score = query[order], vec[order], score[order]
    fresh = np.ones(len(query), bool)
    fresh[1:] = (query[1:] != query[:-1]) | (vec[1:] != vec[:-1])
    query, vec, score = query[fresh], vec[fresh], score[fresh]
    order = np.lexsort((vec, -score, query))
    query, vec, score = query[order], vec[order], score[order]
    keep = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[keep], vec[keep], score[keep]


class Tile:
    """Queries of one length with their best lists so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int) -> None:
        self.ids, self.vectors, self.k = ids, vectors, k
        self.vec = np.zeros((len(ids), k), np.int64)
        self.score = np.full((len(ids), k), SMALLEST)
        self.most = int(np.abs(vectors).max(initial=0))

    def offer(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Multiply with a block, and take what is better than the lists."""
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        bound = self.most * int(np.abs(vectors).max(initial=0)) * vectors.shape[1]
        if bound >= 1 << 62:
            raise ValueError("scores do not fit into a long")
        kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64  # all exact
        least = -np.inf if kind is not np.int64 else SMALLEST
        block = np.ascontiguousarray(vectors.T, kind)
        firsts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        for a in range(0, len(self.ids), PIECE):
            queries = self.ids[a : a + PIECE]
            scores = self.vectors[a : a + PIECE].astype(kind) @ block
            names = ids
            if len(firsts) < len(ids):  # rows that share an id count as one, with the best score
                scores, names = np.maximum.reduceat(scores, firsts, axis=1), ids[firsts]
            at = np.minimum(np.searchsorted(names, queries), len(names) - 1)
            own = np.flatnonzero(names[at] == queries)
            scores[own, at[own]] = least
            self._take(a, scores, names, least)

    def _take(self, a: int, scores: np.ndarray, names: np.ndarray, least: float) -> None:
        k, bound = self.k, self.score[a : a + len(scores), -1]
        reach = scores >= np.where(bound == SMALLEST, least, bound.astype(scores.dtype))[:, None]
        count = reach.sum(axis=1)
        if scores.shape[1] > k:
            many = np.flatnonzero(count > 4 * k)
            if len(many):
                part = scores[many]
                kth = np.partition(part, part.shape[1] - k, axis=1)[:, [part.shape[1] - k]]
                more, tie = part > kth, part == kth
                tie &= np.cumsum(tie, axis=1) <= k - more.sum(axis=1)[:, None]  # of equal scores the smaller ids
                reach[many] &= more | tie
        row, column = np.nonzero(reach)
        value = scores[row, column]
        real = value != least
        row, column, value = row[real], column[real], value[real]
        if not len(row):
            return
        rows = np.unique(row)
        old = np.flatnonzero(self.score[a + rows].ravel() != SMALLEST)
        known = np.repeat(rows, k)[old], self.vec[a + rows].ravel()[old], self.score[a + rows].ravel()[old]
        query, vec, score = best(*(np.concatenate([x, y]) for x, y in zip(known, (row, names[column], value.astype(np.int64)), strict=True)), k)
        place = np.arange(len(query)) - np.searchsorted(query, query)
        self.vec[a + query, place], self.score[a + query, place] = vec, score

    def lists(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, place = np.nonzero(self.score != SMALLEST)
        return self.ids[row], self.vec[row, place], self.score[row, place]


def _cells(k: int):
    """Each cell's lists; a cell's query blocks come before its other blocks."""

    def done(cell: tuple[int, int], tiles: list[Tile]) -> pa.RecordBatch:
        found = best(*(np.concatenate(x) for x in zip(*(t.lists() for t in tiles), strict=True)), k)
        return pa.RecordBatch.from_arrays([pa.array([cell[0]], pa.int64()), pa.array([cell[1]], pa.int64()), pa.array([_pack(*found)], pa.binary())], names=["tile", "shard", "lists"])

    def read(row: dict) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vectors"], row["kind"]).reshape(-1 if row["size"] else len(row["ids"]) // 8, row["size"]).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, waiting, tiles = None, {}, {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if (row["tile"], row["shard"]) != cell:
                    if tiles:
                        yield done(cell, list(tiles.values()))
                    cell, waiting, tiles = (row["tile"], row["shard"]), {}, {}
                ids, vectors = read(row)
                if row["is_query"]:
                    waiting.setdefault(row["size"], []).append((ids, vectors))
                    continue
                for size, parts in waiting.items():
                    tiles[size] = Tile(*(np.concatenate(x) for x in zip(*parts, strict=True)), k)
                waiting = {}
                if row["size"] in tiles:
                    tiles[row["size"]].offer(ids, vectors)
        if tiles:
            yield done(cell, list(tiles.values()))

    return run


def _merged(k: int):
    def run(table: pa.Table) -> pa.Table:
        lists = [_unpack(b, "i8", "i8", "i8") for b in table.column("lists").to_pylist()]
        found = best(*(np.concatenate(x) for x in zip(*lists, strict=True)), k)
        return pa.table({"tile": table.column("tile")[:1], "shard": table.column("shard")[:1], "lists": pa.array([_pack(*found)], pa.binary())})

    return run


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob in batch.column(0).to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in _unpack(blob, "i8", "i8", "i8")], names=["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", tile_values: int = TILE_VALUES, shard_values: int = SHARD_VALUES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every`` the k other rows of highest integer inner product.

    Components count as floor(scale * x). Ties go to the smaller id; with fewer rows all are given, and a query without any other row has none. Rows with a null
    id, and vectors that are null or hold null or non-finite components take no part. Vectors of different lengths have no score with each other. Rows
    that share an id are copies of one: the best score counts, and an id never finds itself. Other columns are not read; an empty table gives no
    rows. Scores beyond a long raise an error.

    Shuffled are each vector once per tile, each query once per shard, and the lists; a task holds one tile and one block.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    blocks = cut(rows.mapInArrow(_blocks(scale, every), "is_query boolean, size int, n long, kind string, ids binary, vectors binary"))
    sums = {r.is_query: r for r in blocks.groupBy("is_query").agg(F.sum(F.col("n") * F.greatest("size", F.lit(1))).alias("values"), F.count("*").alias("blocks")).collect()}
    values = {q: sums[q]["values"] if q in sums else 0 for q in (True, False)}
    tiles, shards = max(1, -(-values[True] // tile_values)), max(1, -(-values[False] // shard_values))
    wanted = -(-CELLS_PER_CORE * spark.sparkContext.defaultParallelism // tiles)
    shards = max(shards, min(wanted, sums[False].blocks if False in sums else 1))
    place = F.xxhash64("ids")
    names = ["is_query", "size", "kind", "ids", "vectors"]
    queries = blocks.where("is_query").select(F.pmod(place, F.lit(tiles)).alias("tile"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), *names)
    others = blocks.where("NOT is_query").select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long"))).alias("tile"), F.pmod(place, F.lit(shards)).alias("shard"), *names)
    cells = queries.unionByName(others).repartition(min(tiles * shards, MOST_PARTITIONS), "tile", "shard").sortWithinPartitions("tile", "shard", F.desc("is_query"))
    lists = cells.mapInArrow(_cells(k), "tile long, shard long, lists binary")
    while shards > 1:
        shards = -(-shards // FAN)
        lists = lists.withColumn("shard", F.floor(F.col("shard") / FAN)).groupBy("tile", "shard").applyInArrow(_merged(k), "tile long, shard long, lists binary")
    found = lists.select("lists").mapInArrow(_rows, "query_id long, vec_id long, score long")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))  # an id that several rows or tiles have as a query
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
