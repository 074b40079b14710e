"""All pairs of the rows of a table of groups, block against block.

Groups are dealt to blocks of about ``block`` by a hash, and each pair of blocks
is one row: no task or row holds all groups, and no join condition compares
them one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import attach_stats


def block_pairs(groups: DataFrame, key: str, block: int = 1000) -> DataFrame:
    """(lo, hi, left, right): arrays of the rows of two blocks as structs with
    the key first; ``right`` is empty where a block meets itself."""
    sizes = groups.agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_blocks"))
    row = F.struct(key, *[c for c in groups.columns if c != key])
    rows = attach_stats(groups.select(key, row.alias("_one")), sizes, [])
    rows = rows.withColumn("_own", F.pmod(F.xxhash64(key), F.col("_blocks")).cast("int"))
    met = F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda j: F.struct(F.least("_own", j).alias("lo"), F.greatest("_own", j).alias("hi")))
    rows = rows.select("_own", "_one", F.explode(met).alias("_p")).select("_p.lo", "_p.hi", "_own", "_one")
    side = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("_one"))))
    return rows.groupBy("lo", "hi").agg(side(F.col("_own") == F.col("lo")).alias("left"), side(F.col("_own") != F.col("lo")).alias("right"))


def unordered_pairs(groups: DataFrame, key: str, block: int = 1000) -> DataFrame:
    """(a, b): every two rows once, as structs, a with the smaller key."""
    met = block_pairs(groups, key, block)
    other = lambda a: F.when(F.col("lo") == F.col("hi"), F.filter("left", lambda b: b[key] > a[key])).otherwise(F.col("right"))
    out = met.select("lo", "hi", "left", "right", F.explode("left").alias("x"))
    out = out.select("x", F.explode(other(F.col("x"))).alias("y"))
    ordered = F.col(f"x.{key}") < F.col(f"y.{key}")
    return out.select(F.when(ordered, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(ordered, F.col("y")).otherwise(F.col("x")).alias("b"))


def largest_over_others(groups: DataFrame, key: str, measure, name: str, block: int = 1000) -> DataFrame:
    """(key, name): the largest ``measure(a, b)`` over all other rows b; a task
    keeps one number per row of its blocks. NULL without other rows."""
    met = block_pairs(groups, key, block)

    def best(a: Column, others: Column) -> Column:
        kept = F.filter(others, lambda b: b[key] != a[key])
        return F.array_max(F.transform(kept, lambda b: measure(a, b)))

    within = F.transform("left", lambda a: F.struct(a[key].alias("key"), best(a, F.when(F.col("lo") == F.col("hi"), F.col("left")).otherwise(F.col("right"))).alias("m")))
    back = F.transform("right", lambda a: F.struct(a[key].alias("key"), best(a, F.col("left")).alias("m")))
    each = met.select(F.explode(F.concat(within, back)).alias("r"))
    return each.groupBy(F.col("r.key").alias(key)).agg(F.max("r.m").alias(name))
