"""Preference formatting of chosen and rejected conversations.

All columns are built-in functions. Each side is grouped once by pair; the two
arrays of turns are compared position by position, the common turns are
rendered once as the prompt, and what follows on each side becomes a completion
with the character ranges that are trained on (assistant turns only).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, cut_lineage, fresh


def conversations(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, turns): a conversation's turns in order, as role and text.

    Null roles are ``user``, null texts empty, a null turn comes first; equal
    turn numbers are ordered by role and text; rows without a key belong to no
    conversation. A conversation is one training example and so one row.
    """
    row = F.struct(col(turn).alias("turn"), F.coalesce(col(role), F.lit("user")).alias("role"), F.coalesce(col(text), F.lit("")).alias("text"))
    grouped = turns.filter(col(key).isNotNull()).groupBy(col(key).alias("key")).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    return grouped.select("key", F.transform("rows", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def render(turn: Column) -> Column:
    """One turn in the template's words."""
    return F.concat(F.lit("<|im_start|>"), turn["role"], F.lit("\n"), turn["text"], F.lit("<|im_end|>\n"))


def common_turns(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two arrays of turns."""
    differ = F.array_position(F.zip_with(a, b, lambda x, y: x.isNotNull() & y.isNotNull() & (x["role"] == y["role"]) & (x["text"] == y["text"])), F.lit(False))
    return F.when(differ == 0, F.size(a)).otherwise(differ - 1).cast("int")


def trained(turns: Column) -> Column:
    """start:length character ranges of assistant texts in the rendered turns,
    comma-joined; their end marks are trained on too."""
    step = F.aggregate(
        turns,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans")),
        lambda s, t: F.struct(
            (s["at"] + F.length(render(t))).alias("at"),
            F.when(
                t["role"] == "assistant",
                F.concat(s["spans"], F.array(F.concat((s["at"] + 13 + F.length(t["role"])).cast("string"), F.lit(":"), (F.length(t["text"]) + 10).cast("string")))),
            ).otherwise(s["spans"]).alias("spans"),
        ),
        lambda s: s["spans"],
    )
    return F.array_join(step, ",")


def format_pairs(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Pairs of turn arrays with prompt, completions and their trained ranges.

    A null side is an empty conversation. Equal conversations are all prompt
    with empty completions; without a common turn the prompt is empty. Further
    columns stay, but for those named like a result.
    """
    none = F.array().cast("array<struct<role:string,text:string>>")
    out = ("n_common", "prompt", "chosen", "chosen_mask", "rejected", "rejected_mask")
    left, right, n, more, less = (fresh(pairs, c) for c in ("_left", "_right", "_n", "_more", "_less"))
    rows = pairs.withColumns({left: F.coalesce(col(chosen), none), right: F.coalesce(col(rejected), none)})
    rows = rows.withColumn(n, common_turns(col(left), col(right)))
    rest = lambda side: F.slice(side, col(n) + 1, F.greatest(F.size(side) - col(n), F.lit(0)))
    rows = rows.withColumns({more: rest(col(left)), less: rest(col(right))})
    joined = lambda side: F.array_join(F.transform(side, render), "")
    return rows.select(
        *[col(c) for c in pairs.columns if c not in (chosen, rejected, *out)],
        col(n).alias("n_common"),
        joined(F.slice(col(left), F.lit(1), col(n))).alias("prompt"),
        joined(col(more)).alias("chosen"),
        trained(col(more)).alias("chosen_mask"),
        joined(col(less)).alias("rejected"),
        trained(col(less)).alias("rejected_mask"),
    )


def preference_examples(chosen: DataFrame, rejected: DataFrame, key: str = "pair_id", **names) -> DataFrame:
    """One example per key of either table of turns; see :func:`format_pairs`
    and :func:`conversations` for nulls, ties and missing sides."""
    a = conversations(chosen, key, **names).withColumnRenamed("turns", "chosen")
    b = conversations(rejected, key, **names).withColumnRenamed("turns", "rejected")
    return format_pairs(a.join(b, "key", "full")).withColumnRenamed("key", key)


def with_swapped_reply(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, chosen, rejected): each conversation, and its copy whose last turn
    has the text of the last turn of the next key that there is.

    Keys may be of any ordered type and have gaps; the last one
    has a rejected side without last turn. Null keys, roles and texts, ties and repeated rows are those of :func:`conversations`; an
    empty table gives none. Keys are dealt by range, so no task holds them all.
    """
    all_ = conversations(turns, key)
    replies = all_.select("key", F.element_at("turns", -1)["text"].alias("reply"))
    dealt = cut_lineage(replies.repartitionByRange("key")).withColumn("p", F.spark_partition_id())
    firsts = dealt.groupBy("p").agg(F.min_by("reply", "key").alias("first"))
    # One row per range: the first reply of the next range that has any.
    firsts = firsts.select("p", F.lead("first").over(Window.orderBy("p")).alias("after"))
    inside = Window.partitionBy("p").orderBy("key")
    dealt = dealt.withColumns({"next": F.lead("reply").over(inside), "last": F.lead("key").over(inside).isNull()})
    last = dealt.join(firsts, "p").select("key", F.when(F.col("last"), F.col("after")).otherwise(F.col("next")).alias("reply"))
    swapped = F.struct(F.element_at("turns", -1)["role"].alias("role"), F.col("reply").alias("text"))
    head = F.slice("turns", F.lit(1), F.size("turns") - 1)
    return all_.join(last, "key", "left").select("key", F.col("turns").alias("chosen"), F.when(F.col("reply").isNull(), head).otherwise(F.concat(head, F.array(swapped))).alias("rejected"))
