"""Writers: metrics, reports, intervals, models with metadata."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flatten(df: DataFrame, sep: str = "_") -> DataFrame:
    """Struct fields to columns, arrays to comma lists: a CSV-ready frame."""
    cols = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StructType):
            cols += [c[s.name].alias(f"{f.name}{sep}{s.name}") for s in f.dataType]
        elif isinstance(f.dataType, T.ArrayType):
            cols.append(F.array_join(c.cast("array<string>"), ",").alias(f.name))
        else:
            cols.append(c)
    return df.select(*cols)


def write_metrics(df: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite") -> None:
    if fmt == "json":
        df.write.mode(mode).json(path)
    elif fmt == "csv":
        flatten(df).write.mode(mode).option("header", True).csv(path)
    elif fmt == "parquet":
        df.write.mode(mode).parquet(path)
    else:
        raise ValueError(f"unsupported format: {fmt}")


def write_intervals(scored: DataFrame, intervals: DataFrame, path: str, sort: list[str] | None = None) -> None:
    """Intervals as JSON, scored rows as CSV sorted inside each file."""
    intervals.write.mode("overwrite").json(f"{path}/intervals")
    rows = scored.sortWithinPartitions(*sort) if sort else scored
    rows.write.mode("overwrite").option("header", True).csv(f"{path}/scored")


def interval_summary(scored: DataFrame, intervals: DataFrame, flag: str, score: str) -> DataFrame:
    rows = scored.agg(
        F.count(F.lit(1)).alias("total_samples"),
        F.count_if(flag).alias("detected_anomalies"),
        F.avg(F.col(flag).cast("double")).alias("anomaly_rate"),
        F.avg(score).alias("mean_anomaly_score"),
        F.max(score).alias("max_anomaly_score"),
    )
    n = intervals.agg(F.count(F.lit(1)).alias("num_intervals"))
    return rows.withColumn("num_intervals", n.scalar())


def save_model(model, path: str, metadata: dict) -> None:
    """Spark ML model next to a one-row JSON table of metadata."""
    spark = SparkSession.active()
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(json.dumps(metadata, sort_keys=True),)], "metadata string").write.mode("overwrite").json(f"{path}/metadata")


def load_model(path: str):
    from pyspark.ml import PipelineModel

    spark = SparkSession.active()
    row = spark.read.schema("metadata string").json(f"{path}/metadata").first()
    return PipelineModel.load(f"{path}/model"), json.loads(row["metadata"])
