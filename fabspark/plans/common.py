"""Shared inputs of the registered queries, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.capability import Specs
from ..session import table

QUANTITY = Specs(lsl=10.0, usl=40.0, target=25.0)

# Unique order of lineitem within a supplier.
LINE_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"]
LINE_ORDER_SQL = ", ".join(LINE_ORDER)


def lineitem(spark: SparkSession, sf: str, *extra: str) -> DataFrame:
    cols = dict.fromkeys(["l_suppkey", *LINE_ORDER, *extra])
    return table(spark, sf, "lineitem").select(*cols)


def phi_sql(z: str) -> str:
    """Normal CDF as a power series, independent of the Spark expression."""
    z = f"greatest(-12.0, least(12.0, {z}))"
    return (
        f"(0.5 + exp(-({z})*({z})/2)/sqrt(2*pi())*({z})*list_sum(list_transform(range(0, 260), "
        f"lambda n: exp(2*n*ln(greatest(abs({z}), 1e-100)) - ((n+1)*ln(2) + lgamma(n+1.5) - 0.5*ln(pi()))))))"
    )


def good_dies(spark: SparkSession, sf: str) -> DataFrame:
    """Die table of the 8 x 8 maps: (vec_id, label, row, col, value, x)."""
    e = table(spark, sf, "embeddings")
    d = e.select("vec_id", "label", F.posexplode("embedding").alias("p", "x"))
    return d.select(
        "vec_id",
        "label",
        F.floor(F.col("p") / 8).cast("int").alias("row"),
        (F.col("p") % 8).alias("col"),
        (F.col("x") > 0).cast("int").alias("value"),
        F.col("x").cast("double").alias("x"),
    )


DIES_SQL = """dies AS (
  SELECT vec_id, label, CAST(p // 8 AS INTEGER) AS "row", CAST(p % 8 AS INTEGER) AS col,
         CAST(x > 0 AS INTEGER) AS value, CAST(x AS DOUBLE) AS x
  FROM (SELECT vec_id, label, unnest(range(0, 64)) AS p, unnest(embedding) AS x FROM embeddings))"""
