"""Connected components of large graphs whose hubs are spread over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage


def with_group_min(rows: DataFrame, key: str, value: str, out: str, spread_by: str, salts: int = 32) -> DataFrame:
    """``rows`` with the minimum of ``value`` over their ``key``.

    A key meets its minimum in ``salts`` parts, dealt by ``spread_by``: no task
    holds more than such a part, and only one row a part is joined by the key
    alone, so a key with a third of all rows needs no skew handling.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    parts = salted.groupBy(key, "_salt").agg(F.min(value).alias("_low"))
    whole = parts.groupBy(key).agg(F.min("_low").alias(out))
    known = parts.select(key, "_salt").join(whole, key)
    return salted.join(known, [key, "_salt"]).drop("_salt")


def _star(edges: DataFrame, up: bool, salts: int) -> DataFrame:
    """Neighbours of each node (``up``: only the larger ones) and, without
    ``up``, the node point to the smallest of them and the node. A node's
    neighbours are met in parts, and its minimum is sent back to each part: no
    group holds all edges of a hub."""
    parts = edges.groupBy("src", F.pmod(F.xxhash64("dst"), F.lit(salts)).alias("salt")).agg(F.collect_set("dst").alias("near"))
    lows = parts.select("src", "salt", F.least("src", F.array_min("near")).alias("m")).groupBy("src").agg(F.collect_list("salt").alias("all"), F.min("m").alias("m"))
    # Merged, as Spark sizes lists and what is made of them too low and would send either side through the driver.
    met = parts.hint("merge").join(lows.select("src", "m", F.explode("all").alias("salt")).hint("merge"), ["src", "salt"])
    near = F.filter("near", lambda x: x > F.col("src")) if up else F.array_append("near", F.col("src"))
    return met.select(F.explode(near).alias("src"), F.col("m").alias("dst")).filter(F.col("src") != F.col("dst"))


def components(edges: DataFrame, salts: int = 1024) -> DataFrame:
    """(id, component): every node of ``edges`` (src, dst) with the smallest
    node it reaches, by alternating large and small stars.

    Each round is checkpointed. Self edges keep single nodes; an empty table
    gives none.
    """
    nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    e = cut_lineage(edges.filter(F.col("src") != F.col("dst")).select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    last = None
    while True:
        e = cut_lineage(_star(_star(e.union(e.select("dst", "src")), True, salts), False, salts).distinct())
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())
        if now == last:
            break
        last = now
    return nodes.join(e.select(F.col("src").alias("id"), F.col("dst").alias("component")), "id", "left").withColumn("component", F.coalesce("component", "id"))
