"""Similar column embeddings: exact pairs over a cosine threshold and average-linkage clusters.

Near vectors are found by pivots: every vector is at home with its nearest pivot and visits those others whose homes can hold a vector in reach. With a pivot, the
distance to it is the sort key. Homes are cut along it into chunks, and by the triangle inequality a vector only meets chunks whose keys
differ from its own by no more than the reach. A chunk and the vectors that meet it are compared by matrix products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..plans.ordered import position
from ..plans.session import cut

PIVOT_SAMPLE = 4096  # vectors among which pivots are chosen
MOST_PIVOTS = 256
CHUNK = 4096  # vectors of a home compared at a time
SLACK = 1e-7  # for rounding in distances; pairs are checked exactly afterwards


def fit_pivots(points: DataFrame, n: int) -> np.ndarray:
    """About sqrt(n) pivots: of a sample the vector farthest from those chosen so far, again and again."""
    rows = points.orderBy(F.xxhash64("id")).limit(PIVOT_SAMPLE).select("vec").collect()
    sample = np.array([r.vec for r in rows], float)
    count = min(MOST_PIVOTS, len(sample), int(np.ceil(np.sqrt(n))))
    chosen, gap = [0], np.full(len(sample), np.inf)
    while len(chosen) < count:
        gap = np.minimum(gap, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
        if not gap.max() > 0:
            break
        chosen.append(int(gap.argmax()))
    return sample[chosen]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of the rows of x to those of y."""
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * x @ y.T, 0.0))


def _visits(pivots: np.ndarray, reach: float):
    """(cell, key, home, id, vec): a vector y near x that is at home with q has d(x, q) <= d(y, q) + r <= d(y, p) + r <= d(x, p) + 2 r."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, CHUNK):
                part = batch.slice(a, CHUNK)
                d = _apart(_matrix(part.column("vec")), pivots)
                own = d.argmin(axis=1)
                row, cell = np.nonzero(d <= d.min(axis=1)[:, None] + 2 * (reach + SLACK))
                take = part.take(pa.array(row))
                arrays = [pa.array(cell, pa.int64()), pa.array(d[row, cell]), pa.array(own[row] == cell), take.column("id"), take.column("vec")]
                yield pa.RecordBatch.from_arrays(arrays, names=["cell", "key", "home", "id", "vec"])

    return run


def near_candidates(points: DataFrame, reach: float, chunk: int = CHUNK) -> DataFrame:
    """(cell, chunk, home, id, vec): the members of each chunk (home) and the vectors of ``points(id, vec)`` to compare with them."""
    n = points.count()
    kind = points.schema["id"].dataType.simpleString()
    shape = f"cell long, key double, home boolean, id {kind}, vec array<double>"
    if not n:
        return points.sparkSession.createDataFrame([], f"cell long, chunk long, home boolean, id {kind}, vec array<double>")
    typed = points.select("id", F.col("vec").cast("array<double>"))
    placed = cut(typed.mapInArrow(_visits(fit_pivots(typed, n), reach), shape))
    homes = position(placed.where("home").drop("home"), ["cell"], ["key", "id"], "at").withColumn("chunk", F.floor((F.col("at") - 1) / chunk))
    homes = cut(homes.select("cell", "chunk", "key", "id", "vec"))
    ranges = homes.groupBy("cell", "chunk").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    ranges = ranges.groupBy("cell").agg(F.collect_list(F.struct("chunk", "low", "high")).alias("chunks"))  # one entry per chunk of a home
    met = placed.join(ranges, "cell").withColumn(
        "chunk", F.explode(F.filter("chunks", lambda c: (F.col("key") >= c.low - reach - SLACK) & (F.col("key") <= c.high + reach + SLACK)).chunk)
    )
    return homes.select("cell", "chunk", F.lit(True).alias("home"), "id", "vec").unionByName(met.select("cell", "chunk", F.lit(False).alias("home"), "id", "vec"))


def _products(reach: float, kind: pa.DataType):
    """Pairs of a chunk's members, which come first, with the vectors that meet it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, rows = None, [], np.zeros((0, 0))
        for batch in batches:
            cell, chunk, home = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "chunk", "home"))
            change = np.flatnonzero((cell[1:] != cell[:-1]) | (chunk[1:] != chunk[:-1]) | (home[1:] != home[:-1])) + 1
            for a, b in zip([0, *change], [*change, len(cell)], strict=True):
                for c in range(a, b, CHUNK):
                    part = batch.slice(c, min(CHUNK, b - c))
                    names, x = part.column("id").to_pylist(), _matrix(part.column("vec"))
                    if home[a]:
                        if now != (cell[a], chunk[a]):
                            now, ids, rows = (cell[a], chunk[a]), [], np.zeros((0, x.shape[1]))
                        ids, rows = ids + names, np.concatenate([rows, x])
                        continue
                    i, j = np.nonzero(_apart(x, rows) <= reach + SLACK)
                    keep = np.array([names[p] < ids[q] for p, q in zip(i.tolist(), j.tolist(), strict=True)], bool)  # each pair is met from both sides
                    i, j = i[keep], j[keep]
                    dot = np.einsum("ij,ij->i", x[i], rows[j])
                    yield pa.RecordBatch.from_arrays([pa.array([names[p] for p in i], kind), pa.array([ids[q] for q in j], kind), pa.array(dot, pa.float64())], names=["a", "b", "dot"])

    return run


def near_pairs(points: DataFrame, reach: float, chunk: int = CHUNK) -> DataFrame:
    """(a, b, dot) for all pairs a < b of ``points(id, vec)`` whose Euclidean distance is at most ``reach``, and perhaps for some a little farther apart."""
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = points.schema["id"].dataType
    dealt = near_candidates(points, reach, chunk).repartition("cell", "chunk").sortWithinPartitions("cell", "chunk", F.desc("home"))
    return dealt.mapInArrow(_products(reach, to_arrow_type(id_type)), f"a {id_type.simpleString()}, b {id_type.simpleString()}, dot double")


def unit_vectors(vecs: DataFrame, key: str, vec: str) -> DataFrame:
    return vecs.where(V.norm(vec) > 0).select(F.col(key).alias("id"), V.unit(vec).alias("vec"))


def cosine_pairs(vecs: DataFrame, key: str, vec: str, least: float) -> DataFrame:
    """All pairs a < b with cosine at least ``least``, exact. Equal vectors are compared once and expanded at the end."""
    units = unit_vectors(vecs, key, vec)
    reps = units.groupBy("vec").agg(F.min("id").alias("rep"))
    members = units.join(reps, "vec").select("id", "rep")
    reach = float(np.sqrt(max(2 - 2 * least, 0.0))) * (1 + 1e-9) + 1e-9
    kept = cut(near_pairs(cut(reps.select(F.col("rep").alias("id"), "vec")), reach).select("a", "b", F.col("dot").alias("sim")).where(F.col("sim") >= least))
    same = reps.select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(1.0).alias("sim"))
    both = kept.unionByName(kept.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim")).unionByName(same)
    ma = members.select(F.col("rep").alias("a"), F.col("id").alias("ida"))
    mb = members.select(F.col("rep").alias("b"), F.col("id").alias("idb"))
    return both.join(ma, "a").join(mb, "b").where("ida < idb").select(F.col("ida").alias("a"), F.col("idb").alias("b"), "sim")


def average_linkage(vecs: DataFrame, key: str, vec: str, distance: float, steps=(1 / 64, 1.0)) -> DataFrame:
    """Average-linkage cosine clusters cut at ``distance``: (id, cluster), the cluster named by its smallest id.

    With unit vectors the mean distance of two clusters is one minus the product of their mean vectors,
    so a cluster is a size and a mean. Pairs that are each other's nearest can be merged in the same
    round without changing the result of the one-by-one procedure. Rounds run at rising thresholds:
    copies and close neighbours collapse at small reach before wider cells are opened.
    """
    units = unit_vectors(vecs, key, vec)
    reps = units.groupBy("vec").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("size"))
    members = cut(units.join(reps.select("vec", F.col("id").alias("cluster")), "vec").select("id", "cluster"))
    state = cut(reps.select("id", "vec", F.col("size").cast("double").alias("size")))
    for step in steps:
        limit = distance * step
        while True:
            reach = float(np.sqrt(2 * limit)) * (1 + 1e-9) + 1e-9
            d = near_pairs(state.select("id", "vec"), reach).select("a", "b", F.round(1 - F.col("dot"), 12).alias("d"))
            d = cut(d.where(F.col("d") < limit))
            both = d.unionByName(d.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))
            nearest = both.groupBy("a").agg(F.min(F.struct("d", "b")).alias("m")).select("a", F.col("m.b").alias("b"))
            # two clusters are each other's nearest if their ordered pair occurs twice
            ends = nearest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            merges = cut(ends.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("a", "b"))
            if merges.isEmpty():
                break
            dropped = state.join(merges.select(F.col("b").alias("id"), F.col("a").alias("keep")), "id").select(
                F.col("keep").alias("id"), F.col("vec").alias("v2"), F.col("size").alias("s2")
            )
            rest = state.join(merges.select(F.col("b").alias("id")), "id", "left_anti").join(dropped, "id", "left")
            mixed = F.zip_with("vec", "v2", lambda x, y: (x * F.col("size") + y * F.col("s2")) / (F.col("size") + F.col("s2")))
            grown = rest.select("id", F.when(F.col("s2").isNull(), F.col("vec")).otherwise(mixed).alias("vec"), (F.col("size") + F.coalesce("s2", F.lit(0.0))).alias("size"))
            members = cut(
                members.join(merges.select(F.col("b").alias("cluster"), F.col("a").alias("keep")), "cluster", "left").select(
                    "id", F.coalesce("keep", "cluster").alias("cluster")
                )
            )
            state = cut(grown)
    return members


def majority_type(clusters: DataFrame, labeled: DataFrame) -> DataFrame:
    """Most frequent labeled type per cluster, first name on ties; ``labeled(id, semantic_type)``."""
    counts = clusters.join(labeled, "id").groupBy("cluster", "semantic_type").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("cluster").agg(F.max("n").alias("n"))
    return counts.join(best, ["cluster", "n"]).groupBy("cluster").agg(F.min("semantic_type").alias("semantic_type"))


def lf_embedding_cluster(vecs: DataFrame, key: str, vec: str, labeled: DataFrame, distance: float = 0.01) -> DataFrame:
    """Every unlabeled column votes the majority type of the labeled ones in its cluster."""
    clusters = average_linkage(vecs, key, vec, distance)
    types = majority_type(clusters, labeled)
    voted = clusters.join(types, "cluster").join(labeled.select("id"), "id", "left_anti")
    return voted.select(F.col("id").alias("dataset_id"), F.lit("embedding_cluster").alias("lf"), F.col("semantic_type").alias("label"))
