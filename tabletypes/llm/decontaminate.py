"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact weighted-shingle check.

A window can reach the similarity only if it shares a shingle with the item, so windows are laid where a document has a
shingle of some item, aligned with it. Windows and items get 64-bit SimHash fingerprints of their shingle multisets.
Fingerprints within ``RADIUS`` bits agree on one of ``RADIUS + 1`` blocks (pigeonhole), so an equality join on blocks and sizes finds
them all; at the similarity 0.8 a fingerprint differs in 10 bits (deviation 3), so the radius leaves out one pair in about a million.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabletypes.plans.session import cut

from .quality import SPACES

RADIUS = 24
SIZE = 5
BROADCAST_ROWS = 500_000  # item shingles; beyond it the join is left to Spark
_LANES = 0x0001000100010001


def words(text: Column) -> Column:
    """Words between white space, A-Z in lower case."""
    upper = "".join(map(chr, range(65, 91)))
    t = F.translate(F.coalesce(text, F.lit("")), upper + SPACES[1:], upper.lower() + " " * 5)
    return F.array_remove(F.split(t, " "), "")


def shingles(hashed: Column, size: int) -> Column:
    """Hashes of the runs of ``size`` word hashes; empty if there are fewer words."""
    return F.when(F.size(hashed) >= size, F.transform(F.sequence(F.lit(0), F.size(hashed) - size), lambda i: F.xxhash64(*[F.get(hashed, i + j) for j in range(size)]))).otherwise(F.array().cast("array<bigint>"))


def simhash(values: Column) -> Column:
    """Majority of each bit over a multiset of 64-bit hashes, 1 where more than half of them have it; sixteen sums of four lanes."""
    def lane(j: int) -> Column:
        return F.aggregate(values, F.lit(0).cast("long"), lambda a, h: a + F.shiftrightunsigned(h, j).bitwiseAND(F.lit(_LANES)))

    lanes = [lane(j) for j in range(16)]
    bits = [F.when(F.shiftrightunsigned(lanes[j], 16 * k).bitwiseAND(F.lit(0xFFFF)) * 2 > F.size(values), F.shiftleft(F.lit(1).cast("long"), 16 * k + j)).otherwise(F.lit(0).cast("long")) for j in range(16) for k in range(4)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def blocks(fingerprint: Column) -> Column:
    """The fingerprint's RADIUS + 1 blocks of neighbouring bits, each with its number."""
    edges = [64 * i // (RADIUS + 1) for i in range(RADIUS + 2)]
    return F.array(*[F.struct(F.lit(i).alias("b"), F.shiftrightunsigned(fingerprint, x).bitwiseAND(F.lit((1 << (y - x)) - 1)).alias("v")) for i, (x, y) in enumerate(zip(edges, edges[1:], strict=False))])


def matches(docs: DataFrame, benchmark: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item, position, n_words, shared, whole): for each document and item the best window whose shingle multisets share ``percent`` of their union.

    Shingles have five words, those of shorter items all their words. Null or blank texts and items, and rows without an id, match nothing. Rows that share an
    id count as one document. Empty tables give an empty result; other columns are not read.
    """
    items = benchmark.select(F.col(item_col).alias("item"), F.transform(words(F.col(item_text)), lambda x: F.xxhash64(x)).alias("h"))
    items = items.select("item", "h", F.size("h").alias("m"), F.least(F.size("h"), F.lit(SIZE)).alias("k")).where("m > 0 AND item IS NOT NULL")
    items = items.withColumn("s", F.when(F.col("k") == SIZE, shingles(F.col("h"), SIZE)).otherwise(F.array(F.xxhash64("h"))))
    items = cut(items.select("item", "m", "k", "s"))
    sizes = sorted(r.k for r in items.select("k").distinct().collect())  # at most five values
    seeds = items.select("m", "k", F.posexplode("s").alias("at", "token")).groupBy("k", "token", "m", "at").agg(F.lit(1).alias("one")).drop("one")
    if seeds.count() <= BROADCAST_ROWS:
        seeds = F.broadcast(seeds)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL").select("id", F.transform(words(F.col("text")), lambda x: F.xxhash64(x)).alias("h"))

    def of_size(size: int) -> DataFrame:
        array = shingles(F.col("h"), SIZE) if size == SIZE else F.transform(F.sequence(F.lit(0), F.size("h") - size), lambda i: F.xxhash64(F.slice("h", i + 1, size)))
        return rows.where(F.size("h") >= size).select("id", F.lit(size).alias("k"), F.posexplode(array).alias("pos", "token"))

    if not sizes:
        found = rows.limit(0).select("id", F.lit(0).alias("pos"), F.lit(0).alias("m"), F.lit(0).alias("k"))
    else:
        found = of_size(sizes[0])
        for k in sizes[1:]:
            found = found.unionByName(of_size(k))
        found = found.join(seeds, ["k", "token"]).select("id", F.greatest(F.lit(0), F.col("pos") - F.col("at")).alias("pos"), "m", "k")
    spots = cut(found.distinct())
    spots = spots.groupBy("id").agg(F.collect_list(F.struct("pos", "m", "k")).alias("spots"))  # bounded by the document's length and the item sizes
    windows = rows.join(spots.hint("shuffle_hash"), "id").select("id", "h", F.explode("spots").alias("w")).select("id", "w.*", F.slice("h", F.col("w.pos") + 1, F.col("w.m")).alias("h"))
    windows = windows.withColumn("s", F.when(F.col("k") == SIZE, shingles(F.col("h"), SIZE)).otherwise(F.array(F.xxhash64("h"))))
    windows = cut(windows.select("id", "pos", "m", "k", "s").distinct().withColumn("fp", simhash(F.col("s"))))
    index = items.withColumn("fp", simhash(F.col("s"))).select("item", "m", F.col("fp").alias("item_fp"), F.explode(blocks(F.col("fp"))).alias("x")).select("item", "m", "item_fp", "x.*")
    probes = windows.select("id", "pos", "m", "fp", F.explode(blocks(F.col("fp"))).alias("x")).select("id", "pos", "m", "fp", "x.*")
    close = probes.join(index, ["m", "b", "v"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS).select("id", "pos", "item", "m").distinct()
    bag = lambda df, *keys: df.select(*keys, F.size("s").alias("n"), F.explode("s").alias("token")).groupBy(*keys, "n", "token").agg(F.count("*").alias("c"))
    left = bag(windows.join(close.select("id", "pos", "m").distinct(), ["id", "pos", "m"]), "id", "pos", "m")
    right = bag(items, "item", "m").select("item", F.col("m"), F.col("n").alias("item_n"), "token", F.col("c").alias("item_c"))
    both = close.join(left, ["id", "pos", "m"]).join(right, ["item", "m", "token"])
    shared = both.groupBy("id", "item", "pos", "m", "n", "item_n").agg(F.sum(F.least("c", "item_c")).alias("shared"))
    whole = F.col("n") + F.col("item_n") - F.col("shared")
    good = shared.select("id", "item", F.struct((F.col("shared") / whole).alias("share"), (-F.col("pos")).alias("back"), "m", "shared", whole.alias("whole")).alias("x")).where(100 * F.col("x.shared") >= percent * F.col("x.whole"))
    best = good.groupBy("id", "item").agg(F.max("x").alias("x"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), (-F.col("x.back")).cast("long").alias("position"), F.col("x.m").cast("long").alias("n_words"), F.col("x.shared").alias("shared"), F.col("x.whole").alias("whole"))
