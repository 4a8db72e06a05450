"""Two-pass external shuffle into shards of equal row counts.

Pass one scatters records uniformly into buckets of a size that fits a task's memory, by a seeded hash. Pass two shuffles
each bucket in memory (the built-in ``shuffle`` is a seeded Fisher-Yates shuffle) and numbers its records after those of the buckets before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEED = 20_240_607
BUCKET_BYTES = 8 << 20
ROW_BYTES = 64


def sizes(docs: DataFrame, text_col: str = "text") -> tuple:
    """Columns: bytes of the text plus 1, and its unsigned CRC-32; a null text is empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return (F.octet_length(text) + 1).cast("long"), F.crc32(text.cast("binary"))


def shard(records: DataFrame, shards: int = 16, seed: int = SEED, row_bytes: int = ROW_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``records`` with ``shard`` (0 to shards - 1; row counts differ by one at most) and ``slot`` (gapless from 0 in each shard).

    Columns of these names are replaced. ``row_bytes`` is the mean size of a record, which sets the number of buckets.
    Equal rows are counted before they are scattered, each copy by its own number, so any number of repeats spreads evenly.
    Nulls in any column are values like others. An empty table gives an empty result.
    """
    columns = [c for c in records.columns if c not in ("shard", "slot")]
    counted = records.groupBy(F.struct(*columns).alias("record")).count()
    copies = counted.select("record", F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))).alias("copy"))
    n = records.count()
    buckets = max(1, -(-n * row_bytes // bucket_bytes))
    scattered = copies.select(F.pmod(F.xxhash64(F.lit(seed), "record", "copy"), F.lit(buckets)).alias("bucket"), F.struct("record", "copy").alias("x"))
    start = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row for each bucket
    offsets = scattered.groupBy("bucket").agg(F.count("*").alias("rows")).select("bucket", F.coalesce(F.sum("rows").over(start), F.lit(0)).alias("before"))
    lists = scattered.groupBy("bucket").agg(F.sort_array(F.collect_list("x")).alias("xs"))  # bounded: a bucket fits a task
    mixed = lists.select("bucket", F.posexplode(F.shuffle("xs", seed)).alias("at", "x"))
    place = F.col("before") + F.col("at")
    out = mixed.join(offsets, "bucket").select("x.record", place.alias("place"))
    return out.select("record.*", (F.col("place") % shards).cast("int").alias("shard"), F.floor(F.col("place") / shards).cast("long").alias("slot"))


def document_shards(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its size, checksum, law ('rows'), shard and slot; no text is moved."""
    size, crc = sizes(docs, text_col)
    rows = docs.select(F.col(id_col).alias(id_col), size.alias("size"), crc.alias("text_crc32"))
    out = shard(rows, shards)
    return out.select(id_col, "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 16, text_col: str = "text") -> None:
    """Write whole records as one folder per shard, in slot order."""
    size, _ = sizes(docs, text_col)
    mean = docs.agg(F.avg(size)).first()[0] or 0
    out = shard(docs, shards, row_bytes=int(mean) + ROW_BYTES)
    out.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
