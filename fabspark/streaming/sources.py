"""Streaming sources and sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from ..session import stream_folder


def file_stream(spark: SparkSession, folder: str, schema: T.StructType, glob: str = "*.parquet", files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def topic_stream(spark: SparkSession, servers: str, topic: str, schema: str, starting: str = "latest", **options) -> DataFrame:
    """Kafka topic of JSON records (needs the Kafka connector on the class
    path); offsets live in the checkpoint of the query."""
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", starting)
        .options(**options)
        .load()
    )
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("r"), "timestamp").select("r.*", F.col("timestamp").alias("arrived_at"))


def topic_sink(df: DataFrame, servers: str, topic: str, key: str, checkpoint: str):
    out = df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"))
    return (
        out.writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .option("checkpointLocation", checkpoint)
        .start()
    )


def _run(writer: DataStreamWriter, folder: str | None, arrivals: Iterable | None) -> None:
    """Runs a query over what is there now, again after each arrival; batches
    are numbered on, as the checkpoint stays."""
    for _ in arrivals if arrivals is not None else [None]:
        (writer.start(folder) if folder else writer.start()).awaitTermination()


def drain(df: DataFrame, name: str, partition_by: list[str] | None = None, arrivals: Iterable | None = None) -> DataFrame:
    """Runs an append query over what is there now, or what arrives in turn
    (see :class:`Replay` and :func:`closing`), and reads its table back."""
    spark = df.sparkSession
    base = stream_folder(spark, name)
    writer = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{base}/state")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    _run(writer.trigger(availableNow=True), f"{base}/out", arrivals)
    return spark.read.schema(df.schema).parquet(f"{base}/out")


def drain_batches(df: DataFrame, name: str, handle: Callable[[DataFrame, int, str], None], mode: str = "append", arrivals: Iterable | None = None) -> str:
    """Runs ``handle(batch, id, folder)`` per micro-batch; returns the folder.
    Handlers write below a path with the batch id, so a repeated batch
    replaces its own output."""
    spark = df.sparkSession
    base = stream_folder(spark, name)

    def each(batch: DataFrame, batch_id: int) -> None:
        handle(batch, batch_id, f"{base}/out")

    writer = df.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", f"{base}/state")
    _run(writer.trigger(availableNow=True), None, arrivals)
    return f"{base}/out"


class Replay:
    """A table that arrives in steps of event time, one micro-batch a step.

    The table is dealt by range and written once, a folder for each step of
    ``seconds`` that has rows; its micro-batches are the same at every size of
    the table. Iterating lets one step after the other arrive in ``folder``.
    """

    def __init__(self, df: DataFrame, order: str, seconds: int, name: str = "replay"):
        self.spark, self.schema = df.sparkSession, df.schema
        self.staged = stream_folder(self.spark, f"{name}-staged")
        self.folder = stream_folder(self.spark, name)
        step = F.floor(F.unix_micros(F.col(order).cast("timestamp")) / (seconds * 1_000_000)).cast("long")
        df.withColumn("_step", step).repartitionByRange("_step", order).write.partitionBy("_step").parquet(self.staged)
        df.limit(0).write.parquet(self.folder)

    def stream(self) -> DataFrame:
        return file_stream(self.spark, self.folder, self.schema)

    def __iter__(self) -> Iterator[int]:
        rows = self.spark.read.parquet(self.staged)
        steps = [r[0] for r in rows.select("_step").distinct().collect()]  # as many as steps in the time span
        for step in sorted(steps, key=lambda x: (x is not None, x)):
            rows.filter(F.col("_step").eqNullSafe(F.lit(step))).drop("_step").write.mode("append").parquet(self.folder)
            yield step


def closing(stream: DataFrame, ts: str, **values) -> tuple[DataFrame, Iterator[None]]:
    """A stream with a closing mark, and its arrivals: what is there now, then
    one row far in the future (``values`` fill its other columns). The mark moves
    the watermark past every window that holds real rows, so all are written;
    its own windows stay open."""
    spark = stream.sparkSession
    folder = stream_folder(spark, "marks")
    spark.createDataFrame([], stream.schema).write.parquet(folder)

    def arrivals() -> Iterator[None]:
        yield
        mark = {f.name: F.lit(values.get(f.name)).cast(f.dataType) for f in stream.schema} | {ts: F.lit("9000-01-01 00:00:00").cast(stream.schema[ts].dataType)}
        spark.range(1).select(*[c.alias(n) for n, c in mark.items()]).write.mode("append").parquet(folder)
        yield

    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(folder)), arrivals()
