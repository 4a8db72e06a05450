"""Session defaults for local runs, and cutting of lineage on any cluster."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench. On a cluster the caller brings the session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tabletypes")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; a session that names none, as in tests, gets one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("name a shared folder in spark.checkpoint.dir")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="tabletypes-"))
    return _own_folder[0]


def cut(df: DataFrame, schema: StructType | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and continue from the written rows, read as ``schema`` if given.

    Shared storage survives the loss of executors. A written table rather than ``checkpoint()``, because
    the optimizer then sees its true size and no constraints inherited from the cut plan, which would
    grow from round to round of an iterative job.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(schema or df.schema).parquet(path)
