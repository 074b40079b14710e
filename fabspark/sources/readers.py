"""Readers: tables, sensor matrices, wafer grids, JSON records."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import numeric_columns

_FORMATS = {".csv": "csv", ".parquet": "parquet", ".json": "json", ".jsonl": "json", ".orc": "orc"}


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None, fmt: str | None = None, **options) -> DataFrame:
    """CSV, JSON, Parquet or ORC by suffix. CSV needs a schema, so that no
    extra pass infers it, unless ``inferSchema`` is asked for."""
    fmt = fmt or _FORMATS.get(PurePosixPath(path).suffix.lower())
    if fmt is None:
        raise ValueError(f"unsupported file format: {path}")
    reader = spark.read
    if fmt == "csv":
        options = {"header": True, "nanValue": "NaN", **options}
        if schema is None and not options.get("inferSchema"):
            raise ValueError("pass a schema for CSV, or inferSchema=True")
    if schema is not None:
        reader = reader.schema(schema)
    return nan_as_null(reader.options(**options).format(fmt).load(path))


def nan_as_null(df: DataFrame) -> DataFrame:
    """NaN means missing: floating columns get NULL instead."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    if not floats:
        return df
    return df.withColumns({c: F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")) for c in floats})


def split_target(df: DataFrame, target: str | None, key: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """Features and target, both with the row key they are joined by."""
    if not target or target not in df.columns:
        return df, None
    return df.drop(target), df.select(*key, target)


def check_anova_input(df: DataFrame, response: str, factors: list[str]) -> None:
    """Response numeric, every factor with two levels or more."""
    if response not in numeric_columns(df):
        raise ValueError(f"response {response!r} is not numeric")
    row = df.agg(*[(F.min(f) != F.max(f)).alias(f) for f in factors]).first()
    bad = [f for f in factors if not row[f]]
    if bad:
        raise ValueError(f"factors with fewer than two levels: {bad}")


def read_sensor_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Headerless whitespace-separated matrix with NaN tokens: (row_id,
    values ARRAY<DOUBLE>). Lines keep their order within a file by offset."""
    lines = spark.read.text(path).select("value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("row_id"))
    tokens = F.split(F.trim("value"), r"\s+")
    values = F.transform(tokens, _number)
    return lines.filter(F.trim("value") != "").select("file", "row_id", values.alias("values"))


def _number(t):
    v = t.try_cast("double")
    return F.when(~F.isnan(v), v)


def matrix_columns(matrix: DataFrame, width: int, prefix: str = "sensor_", drop_empty: bool = True) -> DataFrame:
    """Wide form sensor_000 ..; columns without any value are dropped."""
    names = [f"{prefix}{i:03d}" for i in range(width)]
    wide = matrix.select("row_id", *[F.get("values", F.lit(i)).alias(n) for i, n in enumerate(names)])
    if not drop_empty:
        return wide
    counts = wide.agg(*[F.count(n).alias(n) for n in names]).first()
    return wide.drop(*[n for n in names if counts[n] == 0])


def recode_labels(df: DataFrame, label: str) -> DataFrame:
    """-1 / 1 to 0 / 1; anything else becomes NULL."""
    c = F.col(label)
    return df.withColumn(label, F.when(c == -1, 0).when(c == 1, 1))


def read_wafer_grid(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Text grids of 0 and 1, one file per wafer, to a map table: (wafer,
    values, height, width). A file is one bounded map, so it is read whole."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("wafer"), "value")
    pattern = r"\s+" if sep.strip() == "" else rf"\s*{sep}\s*"
    rows = F.filter(F.split("value", r"\r?\n"), lambda line: F.trim(line) != "")
    cells = F.transform(rows, lambda line: F.split(F.trim(line), pattern))
    grid = files.withColumn("cells", cells)
    return grid.select(
        "wafer",
        F.transform(F.flatten("cells"), lambda x: x.try_cast("double")).alias("values"),
        F.size("cells").alias("height"),
        F.size(F.get("cells", F.lit(0))).alias("width"),
        F.array_distinct(F.transform("cells", lambda c: F.size(c))).alias("widths"),
    )


def check_wafer_grid(maps: DataFrame) -> DataFrame:
    """Per wafer: rectangular, number of cells that are no 0 or 1."""
    bad = F.size(F.filter("values", lambda v: v.isNull() | ~v.isin(0.0, 1.0)))
    return maps.select("wafer", (F.size("widths") == 1).alias("is_rectangular"), bad.alias("unexpected_values"))


def parse_json_records(df: DataFrame, column: str, schema: str) -> DataFrame:
    """JSON text to columns; unreadable records are kept with their text."""
    parsed = F.from_json(column, f"{schema}, _corrupt STRING", {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"})
    return df.withColumn("_p", parsed).select("*", "_p.*").drop("_p")
