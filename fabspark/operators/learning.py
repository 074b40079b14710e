"""Learning-record analytics: attempts, sessions, activity, points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import exact_sum, half_even
from .ranks import attach_stats

# Base points and weights by activity.
POINTS = {
    "assessment": 50,
    "model_training": 30,
    "visualization": 15,
    "parameter_tuning": 20,
    "data_quality": 25,
    "notebook_completion": 40,
    "widget_interaction": 10,
}
OTHER_POINTS = 10
WEIGHTS = {
    "assessment": (1.0, "evaluation"),
    "model_training": (0.8, "practical"),
    "visualization": (0.6, "analysis"),
    "parameter_tuning": (0.7, "optimization"),
    "data_quality": (0.5, "foundations"),
}


def user_progress(attempts: DataFrame, user: object) -> DataFrame:
    done = attempts.filter((F.col("user_id") == F.lit(user)) & F.col("completed_at").isNotNull())
    cols = ["module_id", "sub_module", "completed_at", "score", "max_score", "percentage", "time_taken_seconds"]
    return done.select(*cols).orderBy(F.desc("completed_at"))


def user_stats(attempts: DataFrame) -> DataFrame:
    """Completed attempts, mean score, hours, distinct modules per user, with
    half-even rounding. Scores are summed as decimals, so a mean half-way
    between two roundings does not depend on the order of the rows."""
    done = attempts.filter(F.col("completed_at").isNotNull())
    per_module = done.groupBy("user_id", "module_id").agg(
        F.count(F.lit(1)).alias("n"), exact_sum("percentage").alias("p"), F.count("percentage").alias("np"), F.sum("time_taken_seconds").alias("s")
    )
    return per_module.groupBy("user_id").agg(
        F.sum("n").alias("total_completed"),
        half_even(F.coalesce(F.try_divide(exact_sum("p"), F.sum("np")), F.lit(0.0)), 1).alias("avg_score"),
        half_even(F.coalesce(F.sum("s"), F.lit(0)) / 3600, 2).alias("total_hours"),
        F.count("module_id").alias("modules_completed"),
    )


def module_stats(attempts: DataFrame) -> DataFrame:
    done = attempts.filter(F.col("completed_at").isNotNull())
    return done.groupBy("module_id").agg(F.avg("percentage").alias("mean_percentage"), F.count(F.lit(1)).alias("attempts"))


def latest_rows(tables: Sequence[DataFrame], key: Sequence[str], version: str) -> DataFrame:
    """Current state of append-only writes: the newest row per key. An
    aggregate, so a key with endless versions is reduced before the shuffle."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    newest = F.max_by(F.struct(*out.columns), F.col(version)).alias("r")
    return out.groupBy(*[F.col(k).alias(f"_k_{k}") for k in key]).agg(newest).select("r.*")


def session_stats(sessions: DataFrame, modules: Sequence[str]) -> DataFrame:
    """Per student: counts by activity type, scores, finished modules and the
    shortest session. ``sessions`` has student, module_id, start_time,
    end_time, activities ARRAY<STRUCT<type, score>>."""
    acts = sessions.select("student", F.explode("activities").alias("a")).select("student", "a.type", "a.score")
    is_test = F.col("type") == "assessment"
    counts = acts.groupBy("student").agg(
        F.count_if(is_test).alias("assessments_completed"),
        F.count_if(is_test & (F.col("score") >= 100)).alias("perfect_scores"),
        F.avg(F.when(is_test, F.col("score"))).alias("average_score"),
        F.max(F.when(is_test, F.col("score"))).alias("max_score"),
        F.count_if(F.col("type") == "model_training").alias("models_trained"),
        F.count_if(F.col("type") == "parameter_tuning").alias("parameter_experiments"),
        F.count_if(F.col("type") == "visualization").alias("visualizations_created"),
    )
    done = sessions.filter(F.col("end_time").isNotNull())
    hours = (F.unix_micros(F.col("end_time").cast("timestamp")) - F.unix_micros(F.col("start_time").cast("timestamp"))) / 3.6e9
    # Distinct modules are bounded by the catalogue.
    finished = done.groupBy("student").agg(F.array_sort(F.collect_set("module_id")).alias("modules_completed"), F.min(hours).alias("min_completion_time_hours"))
    every = sessions.select("student").distinct()
    out = attach_stats(attach_stats(every, counts, ["student"]), finished, ["student"])
    names = ["assessments_completed", "perfect_scores", "models_trained", "parameter_experiments", "visualizations_created"]
    out = out.na.fill(0, subset=names).na.fill(0.0, subset=["average_score", "max_score"])
    have = F.coalesce(F.col("modules_completed"), F.array().cast("array<string>"))
    return out.withColumns(
        {"modules_completed": have, "all_modules_completed": F.forall(F.array(*[F.lit(m) for m in modules]), lambda m: F.array_contains(have, m))}
    )


def unlocked(stats: DataFrame, student: str, achievements: dict[str, dict[str, object]]) -> DataFrame:
    """(student, achievement) whose conditions hold: numbers are lower bounds,
    lists must be contained, unknown names are skipped. Conditions are a small
    catalogue and become columns; nothing is joined."""
    items = []
    for name, conditions in achievements.items():
        ok = F.lit(True)
        for key, wanted in conditions.items():
            if key not in stats.columns:
                continue
            if isinstance(wanted, bool):
                ok = ok & (F.col(key) == wanted)
            elif isinstance(wanted, (int, float)):
                ok = ok & (F.col(key) >= wanted)
            else:
                ok = ok & F.forall(F.array(*[F.lit(x) for x in wanted]), _contained(key))
        items.append(F.when(ok, F.lit(name)))
    return stats.select(student, F.explode(F.array_compact(F.array(*items))).alias("achievement"))


def _contained(key: str):
    def check(x: Column) -> Column:
        return F.array_contains(F.col(key), x)

    return check


def daily_activity(df: DataFrame, user: str, ts: str) -> DataFrame:
    return df.groupBy(user, F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("activities"))


def learning_velocity(daily: DataFrame, user: str) -> DataFrame:
    """Mean activities over the last 7 active days. The table has one row per
    user and day, so a user's window is bounded by calendar days."""
    w = Window.partitionBy(user).orderBy("day").rowsBetween(-6, 0)
    return daily.withColumn("velocity", F.avg("activities").over(w))


def study_patterns(daily: DataFrame, user: str) -> DataFrame:
    a = F.col("activities")
    return daily.groupBy(user).agg(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.stddev_pop(a) / F.avg(a))).alias("consistency_score"),
        F.count(F.lit(1)).alias("total_active_days"),
        F.avg(a).alias("average_daily_activity"),
        F.max_by("day", F.struct(a, -F.unix_date("day"))).alias("most_active_day"),
    )


def strengths(df: DataFrame, user: str, activity: str, weights: dict = WEIGHTS) -> DataFrame:
    """Weighted activity counts above 5 (strength) or below 2 (weakness)."""
    w = F.create_map(*[x for k, (v, _) in weights.items() for x in (F.lit(k), F.lit(v))])
    kind = F.create_map(*[x for k, (_, t) in weights.items() for x in (F.lit(k), F.lit(t))])
    counts = df.groupBy(user, activity).agg(F.count(F.lit(1)).alias("n"))
    out = counts.withColumn("score", F.col("n") * F.try_element_at(w, F.col(activity)))
    label = F.when(F.col("score") > 5, "strength").when(F.col("score") < 2, "weakness")
    out = out.withColumns({"category": F.try_element_at(kind, F.col(activity)), "assessment": label})
    return out.filter(F.col("assessment").isNotNull()).drop("n")


def activity_points(activity: Column | str, score: Column | str, points: dict = POINTS) -> Column:
    """Base points, half more from a score of 95, a fifth more from 85;
    fractions are cut."""
    a = F.col(activity) if isinstance(activity, str) else activity
    s = F.col(score) if isinstance(score, str) else score
    base = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in points.items() for x in (F.lit(k), F.lit(v))]), a), F.lit(OTHER_POINTS))
    factor = F.when(s >= 95, 1.5).when(s >= 85, 1.2).otherwise(1.0)
    return F.floor(base * factor + F.lit(1e-9)).cast("long")


def level_bounds(limit: int = 2**53) -> list[int]:
    """Points that end each level: 100, then steps of int(100 * 1.2^(n-1))."""
    out, level = [100], 1
    while out[-1] < limit:
        level += 1
        out.append(out[-1] + int(100 * (1.2 ** (level - 1))))
    return out


def level(points: Column | str) -> Column:
    p = F.col(points) if isinstance(points, str) else points
    return F.size(F.filter(F.array(*[F.lit(b) for b in level_bounds()]), lambda b: b <= p)) + 1


def predict_progress(velocity: DataFrame, user: str, modules: int = 10) -> DataFrame:
    """Trend of the last 7 velocities and the time for the remaining modules;
    needs 3 days."""
    w = Window.partitionBy(user).orderBy(F.desc("day"))
    last = velocity.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= 7)
    out = last.groupBy(user).agg(
        F.regr_slope(F.col("velocity"), -F.col("_rn").cast("double")).alias("slope"),
        F.max_by("velocity", -F.col("_rn")).alias("current_velocity"),
        F.count(F.lit(1)).alias("_n"),
    ).filter(F.col("_n") >= 3)
    days = F.when(F.col("current_velocity") > 0, 7 / F.col("current_velocity")).otherwise(14.0)
    s = F.round("slope", 12)
    return out.select(
        user,
        F.when(s > 0, "improving").when(s < 0, "declining").otherwise("stable").alias("trend"),
        "current_velocity",
        days.alias("estimated_days_per_module"),
        (days * modules / 7).alias("predicted_completion_weeks"),
    )


def dashboard(attempts: DataFrame, user: str, order: Sequence[str]) -> DataFrame:
    """Per student: attempts, mean, distinct modules, scores from 90 on and
    the last five attempts."""
    totals = attempts.groupBy(user, "module_id").agg(F.count(F.lit(1)).alias("n"), exact_sum("percentage").alias("p"), F.count("percentage").alias("np"), F.count_if(F.col("percentage") >= 90).alias("b"))
    out = totals.groupBy(user).agg(
        F.sum("n").alias("total_assessments"),
        half_even(F.try_divide(exact_sum("p"), F.sum("np")), 1).alias("average_score"),
        F.count(F.lit(1)).alias("modules_completed"),
        F.sum("b").alias("badges_earned"),
    )
    w = Window.partitionBy(user).orderBy(*[F.desc(o) for o in order])
    last = attempts.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= 5)
    recent = last.groupBy(user).agg(F.transform(F.sort_array(F.collect_list(F.struct(-F.col("_rn"), "percentage"))), lambda x: x["percentage"]).alias("recent_activity"))
    return attach_stats(out, recent, [user])
