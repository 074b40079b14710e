"""Session helpers: table access and checkpointing."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder; a temporary one only in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="fabspark-checkpoint-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: iterative jobs survive the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stream_folder(spark: SparkSession, name: str) -> str:
    """New folder for a stream's output or state, below the checkpoint folder."""
    import uuid

    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"


def one_row(df: DataFrame):
    """Scalar subquery returning the single row of ``df`` as a struct column."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")).scalar()


def spread(df: DataFrame) -> DataFrame:
    """Spreads a table with fewer input splits than cores (a few files) before
    costly work per row; a table with enough splits stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def bounded(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """Partitions of about ``rows`` rows for a fit that keeps whole partitions in
    memory; file splits hold the more rows, the better the files are compressed.
    A table whose splits are small on average stays as it is."""
    parts = -(-df.count() // rows)
    return df.repartition(parts) if df.rdd.getNumPartitions() < parts else df
