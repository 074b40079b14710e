"""Log and text analytics, learning records; logs and attempts are derived
from events by expressions that Spark and SQL share."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..operators import learning, text
from ..operators import joins
from ..session import table
from .registry import query, r

LOG_SQL = """lg AS (SELECT event_id, ts, CASE user_id % 3 WHEN 0 THEN 'etch' WHEN 1 THEN 'deposition' ELSE 'cleaning' END AS process,
    CASE WHEN hour(ts) BETWEEN 6 AND 13 THEN 'day' WHEN hour(ts) BETWEEN 14 AND 21 THEN 'evening' ELSE 'night' END AS shift,
    CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARNING' ELSE 'INFO' END AS severity, 'CH' || (user_id % 8) AS chamber_id,
    200 + value AS temperature, CASE WHEN event_id % 5 <> 0 THEN 1 + value / 50 END AS pressure FROM events)"""
PARAMS = ["temperature", "pressure"]
LONG_SQL = f"""{LOG_SQL}, lo AS (SELECT process, severity, 'temperature' AS parameter, temperature AS v FROM lg UNION ALL SELECT process, severity, 'pressure', pressure FROM lg),
  ps AS (SELECT process, parameter, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS mn, max(v) AS mx, stddev_samp(v) / avg(v) AS stability FROM lo WHERE v IS NOT NULL GROUP BY 1, 2),
  kb AS (SELECT * FROM (VALUES ('temperature', 'etch', 220.0, 10.0), ('temperature', 'deposition', 400.0, 20.0), ('temperature', 'cleaning', 80.0, 5.0),
    ('pressure', 'etch', 2.5, 0.5), ('pressure', 'deposition', 0.1, 0.02), ('pressure', 'cleaning', 2.0, 0.3)) AS t(parameter, process, best, tol)),
  rc AS (SELECT process, parameter, 'off_optimum' AS issue, abs(mean - best) AS measure, CAST(best AS DOUBLE) AS recommended_value, CASE WHEN abs(mean - best) > 2 * tol THEN 'high' ELSE 'medium' END AS priority
      FROM ps JOIN kb USING (process, parameter) WHERE abs(mean - best) > tol
    UNION ALL SELECT process, parameter, 'high_variability', stability, NULL, CASE WHEN stability > 0.25 THEN 'high' ELSE 'medium' END FROM ps WHERE stability > 0.15),
  su AS (SELECT process, count(*) AS total_runs, avg(CAST(severity = 'ERROR' AS DOUBLE)) AS error_rate FROM lg GROUP BY 1)"""


def logs(spark, sf):
    e = table(spark, sf, "events")
    h = F.hour("ts")
    return e.select(
        "event_id",
        "ts",
        F.when(F.col("user_id") % 3 == 0, "etch").when(F.col("user_id") % 3 == 1, "deposition").otherwise("cleaning").alias("process"),
        F.when(h.between(6, 13), "day").when(h.between(14, 21), "evening").otherwise("night").alias("shift"),
        F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "signup", "WARNING").otherwise("INFO").alias("severity"),
        F.concat(F.lit("CH"), (F.col("user_id") % 8).cast("string")).alias("chamber_id"),
        (200 + F.col("value")).alias("temperature"),
        F.when(F.col("event_id") % 5 != 0, 1 + F.col("value") / 50).alias("pressure"),
    )


@query("process_summary", f"WITH {LONG_SQL} SELECT process, total_runs, {r('error_rate')} AS error_rate FROM su")
def process_summary(spark, sf):
    return text.process_summary(logs(spark, sf)).withColumn("error_rate", rounded("error_rate"))


@query(
    "param_stats",
    f"WITH {LONG_SQL} SELECT process, parameter, {r('mean')} AS mean, {r('std')} AS std, {r('mn')} AS min, {r('mx')} AS max, {r('stability')} AS stability FROM ps",
)
def param_stats(spark, sf):
    out = text.parameter_stats(logs(spark, sf), PARAMS)
    return out.withColumns({c: rounded(c) for c in ("mean", "std", "min", "max", "stability")})


@query("param_recommendations", f"WITH {LONG_SQL} SELECT process, parameter, issue, {r('measure')} AS measure, recommended_value, priority FROM rc")
def param_recommendations(spark, sf):
    out = text.parameter_recommendations(text.parameter_stats(logs(spark, sf), PARAMS))
    return out.withColumn("measure", rounded("measure"))


@query(
    "failure_pattern_counts",
    f"""WITH {LOG_SQL}, e AS (SELECT * FROM lg WHERE severity = 'ERROR'),
    c AS (SELECT 'hour' AS kind, CAST(hour(ts) AS VARCHAR) AS key, count(*) AS n FROM e GROUP BY 2 UNION ALL SELECT 'shift', shift, count(*) FROM e GROUP BY 2
      UNION ALL SELECT 'process', process, count(*) FROM e GROUP BY 2 UNION ALL SELECT 'chamber', chamber_id, count(*) FROM e GROUP BY 2)
    SELECT kind, key, n FROM c QUALIFY row_number() OVER (PARTITION BY kind ORDER BY n DESC, key) <= CASE kind WHEN 'hour' THEN 3 WHEN 'chamber' THEN 5 ELSE 1000 END""",
)
def failure_pattern_counts(spark, sf):
    return text.failure_patterns(logs(spark, sf), "ts")


@query(
    "opportunities",
    f"""WITH {LONG_SQL} SELECT 'process_stability' AS type, process, '' AS parameters FROM su WHERE error_rate > 0.1
    UNION ALL SELECT 'parameter_optimization', process, string_agg(parameter, ',' ORDER BY parameter) FROM rc WHERE priority = 'high' GROUP BY process""",
)
def opportunities(spark, sf):
    lg = logs(spark, sf)
    recs = text.parameter_recommendations(text.parameter_stats(lg, PARAMS))
    return text.opportunities(text.process_summary(lg), recs).withColumn("parameters", F.array_join("parameters", ","))


SF_SQL = f"""{LONG_SQL}, sf AS (SELECT process, parameter, avg(v) FILTER (severity = 'INFO') AS sm, avg(v) FILTER (severity = 'ERROR') AS fm,
   stddev_samp(v) FILTER (severity = 'INFO') AS ss, stddev_samp(v) FILTER (severity = 'ERROR') AS fs FROM lo GROUP BY 1, 2)"""


@query(
    "success_vs_failure",
    f"WITH {SF_SQL} SELECT process, parameter, {r('sm')} AS success_mean, {r('fm')} AS failure_mean, {r('ss')} AS success_std, {r('fs')} AS failure_std, {r('abs(sm - fm)')} AS difference FROM sf",
)
def success_vs_failure(spark, sf):
    out = text.success_failure(logs(spark, sf), PARAMS)
    return out.withColumns({c: rounded(c) for c in ("success_mean", "failure_mean", "success_std", "failure_std", "difference")})


@query(
    "process_rules",
    f"""WITH {SF_SQL} SELECT process, parameter, CASE WHEN sm > fm THEN printf('For %s: Maintain %s above %.2f for optimal results', process, parameter, sm)
      ELSE printf('For %s: Keep %s below %.2f to avoid failures', process, parameter, sm) END AS rule FROM sf WHERE abs(sm - fm) > 0.001 * sm""",
)
def process_rules(spark, sf):
    return text.process_rules(text.success_failure(logs(spark, sf), PARAMS), share=0.001)


MESSAGE_SQL = """ms AS (SELECT event_id, event_type, upper(event_type) || '-' || user_id || CASE event_type WHEN 'error' THEN ' critical Failure, alarm and shutdown check of ' WHEN 'click' THEN ' routine Maintenance of '
   WHEN 'view' THEN ' pressure and flow near ' ELSE ' calibration of ' END || 'P-' || (event_id % 200) || ' value ' || CAST(CAST(value AS INTEGER) AS VARCHAR) AS message FROM events)"""


def messages(spark, sf):
    e = table(spark, sf, "events")
    words = (
        F.when(F.col("event_type") == "error", " critical Failure, alarm and shutdown check of ")
        .when(F.col("event_type") == "click", " routine Maintenance of ")
        .when(F.col("event_type") == "view", " pressure and flow near ")
        .otherwise(" calibration of ")
    )
    m = F.concat(
        F.upper("event_type"), F.lit("-"), F.col("user_id").cast("string"), words, F.lit("P-"), (F.col("event_id") % 200).cast("string"),
        F.lit(" value "), F.rint("value").cast("int").cast("string"),
    )
    return e.select("event_id", "event_type", m.alias("message"))


@query("extract_ids", rf"WITH {MESSAGE_SQL} SELECT event_id, array_to_string(regexp_extract_all(message, '[A-Z]+-\d+'), ',') AS ids FROM ms")
def extract_ids(spark, sf):
    return messages(spark, sf).select("event_id", F.array_join(text.equipment_ids("message"), ",").alias("ids"))


KW = "[" + ", ".join(f"'{k}'" for k in text.KEYWORDS) + "]"


@query(
    "keyword_top10",
    f"""WITH {MESSAGE_SQL}, k AS (SELECT unnest(list_filter({KW}, lambda w: contains(lower(message), w))) AS keyword FROM ms)
    SELECT keyword, count(*) AS n FROM k GROUP BY keyword ORDER BY n DESC, keyword LIMIT 10""",
)
def keyword_top10(spark, sf):
    return text.keyword_counts(messages(spark, sf), "message")


WORD_COUNT = r"avg(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')))"


@query(
    "text_stats",
    rf"""SELECT role, count(*) AS texts, {r('avg(length(text))')} AS avg_length, {r(WORD_COUNT)} AS avg_words,
    CAST(min(length(text)) AS INTEGER) AS min_length, CAST(max(length(text)) AS INTEGER) AS max_length FROM conversations GROUP BY role""",
)
def text_stats(spark, sf):
    out = text.text_stats(table(spark, sf, "conversations"), "text", ["role"])
    return out.withColumns({"avg_length": rounded("avg_length"), "avg_words": rounded("avg_words")})


# Function words of English that carry no topic.
STOP_WORDS = (
    "a about above after again all also am an and any are as at be because been before being below between both but by can could did do does doing down during each "
    "few for from further had has have having he her here hers him his how i if in into is it its just me more most my no nor not now of off on once only or other our "
    "out over own same she should so some such than that the their them then there these they this those through to too under until up very was we were what when where "
    "which while who whom why will with would you your"
).split()

_SUMMARY = r"""tk AS (SELECT doc_id, unnest(WORDS(text)) AS term FROM documents),
  ct AS (SELECT term, sum(n) AS total, count(*) AS df FROM (SELECT doc_id, term, count(*) AS n FROM tk GROUP BY 1, 2) GROUP BY term ORDER BY total DESC, term LIMIT TERMS),
  idf AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1 AS idf FROM ct),
  sl AS (SELECT doc_id, list_filter(list_transform(string_split(replace(text, chr(10), ' '), '.'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: length(s) > 10) AS s FROM documents),
  se AS (SELECT doc_id, unnest(s) AS sentence, unnest(range(0, len(s))) AS pos FROM sl),
  st AS (SELECT doc_id, pos, unnest(WORDS(sentence)) AS term FROM se),
  w AS (SELECT doc_id, pos, st.term, count(*) * max(idf) AS w FROM st JOIN idf USING (term) GROUP BY 1, 2, 3),
  sc AS (SELECT doc_id, pos, sum(w) / sqrt(sum(w * w)) AS score FROM w GROUP BY 1, 2),
  rk AS (SELECT se.doc_id, se.pos, sentence, row_number() OVER (PARTITION BY se.doc_id ORDER BY round(coalesce(score, 0), 9) DESC, se.pos DESC) AS rn,
    count(*) OVER (PARTITION BY se.doc_id) AS n FROM se LEFT JOIN sc ON sc.doc_id = se.doc_id AND sc.pos = se.pos),
  bs AS (SELECT doc_id, string_agg(sentence, '. ' ORDER BY pos) || '.' AS line, max(n) AS n FROM rk WHERE rn <= 2 GROUP BY doc_id),
  sm AS (SELECT d.doc_id, d.text, CASE WHEN coalesce(n, 0) <= 2 THEN d.text ELSE line END AS summary FROM documents d LEFT JOIN bs USING (doc_id))"""


def summary_sql(terms: int, stop_words=()) -> str:
    listed = ", ".join(f"'{w}'" for w in stop_words) or "''"

    def words(c: str) -> str:
        return f"list_filter(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: w NOT IN ({listed}))"

    return _SUMMARY.replace("WORDS(text)", words("text")).replace("WORDS(sentence)", words("sentence")).replace("TERMS", str(terms))


SUMMARY_SQL = summary_sql(1000)


@query("extractive_summary", f"WITH {SUMMARY_SQL} SELECT doc_id, summary FROM sm")
def extractive_summary(spark, sf):
    return text.extractive_summary(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", 1000)


@query("extractive_summary_stop_words", f"WITH {summary_sql(500, STOP_WORDS)} SELECT doc_id, summary FROM sm")
def extractive_summary_stop_words(spark, sf):
    """The 500 most frequent terms that are no stop words."""
    return text.extractive_summary(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", 500, stop_words=STOP_WORDS)


@query("extractive_summary_bigrams")
def extractive_summary_bigrams(spark, sf):
    from pyspark.ml.feature import StopWordsRemover

    stop = StopWordsRemover.loadDefaultStopWords("english")
    return text.extractive_summary(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", 1000, ngrams=2, stop_words=stop)


@query(
    "summary_metrics",
    rf"""WITH {SUMMARY_SQL}, q AS (SELECT summary, text, len(list_filter(regexp_split_to_array(summary, '\s+'), lambda x: x <> '')) AS a, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS b,
      list_distinct(list_filter(regexp_split_to_array(lower(summary), '\s+'), lambda x: x <> '')) AS wa, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS wb FROM sm)
    SELECT {r('greatest(0, 1 - avg(abs(a - b)) / avg(b))')} AS length_similarity, {r('avg(CASE WHEN len(wb) = 0 THEN 0 ELSE len(list_intersect(wa, wb)) / len(wb) END)')} AS word_overlap,
      {r('avg(abs(length(summary) - length(text))) * 0.1')} AS estimated_loss FROM q""",
)
def summary_metrics(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    both = joins.align(text.extractive_summary(docs, "doc_id", "text", 1000), docs, ["doc_id"])
    out = text.summary_metrics(both, "text", "summary")
    return out.select(*[rounded(c).alias(c) for c in out.columns])


ATT_SQL = """atm AS (SELECT event_id AS attempt_id, user_id, 'module-' || (event_id % 10 + 1) AS module_id, CASE WHEN event_type <> 'error' THEN ts END AS completed_at,
   round(least(100.0, value), 2) AS percentage, CAST(event_id % 1800 AS BIGINT) AS time_taken_seconds FROM events)"""


def attempts(spark, sf):
    e = table(spark, sf, "events")
    return e.select(
        F.col("event_id").alias("attempt_id"),
        "user_id",
        F.concat(F.lit("module-"), (F.col("event_id") % 10 + 1).cast("string")).alias("module_id"),
        F.col("event_type").alias("sub_module"),
        F.when(F.col("event_type") != "error", F.col("ts")).alias("completed_at"),
        F.round(F.least(F.lit(100.0), F.col("value")), 2).alias("score"),
        F.lit(100).alias("max_score"),
        F.round(F.least(F.lit(100.0), F.col("value")), 2).alias("percentage"),
        (F.col("event_id") % 1800).alias("time_taken_seconds"),
    )


@query(
    "user_progress",
    f"WITH {ATT_SQL} SELECT module_id, CAST(epoch_us(completed_at) AS BIGINT) AS completed_us, percentage FROM atm WHERE user_id = 7 AND completed_at IS NOT NULL",
)
def user_progress(spark, sf):
    from ..functions.columns import micros

    out = learning.user_progress(attempts(spark, sf), 7)
    return out.select("module_id", micros(out, "completed_at").alias("completed_us"), "percentage")


@query(
    "user_stats",
    f"""WITH {ATT_SQL} SELECT user_id, count(*) AS total_completed, round_even(avg(percentage), 1) AS avg_score, round_even(sum(time_taken_seconds) / 3600, 2) AS total_hours,
    count(DISTINCT module_id) AS modules_completed FROM atm WHERE completed_at IS NOT NULL GROUP BY user_id""",
)
def user_stats(spark, sf):
    return learning.user_stats(attempts(spark, sf))


@query(
    "module_stats",
    f"WITH {ATT_SQL} SELECT module_id, {r('avg(percentage)')} AS mean_percentage, count(*) AS attempts FROM atm WHERE completed_at IS NOT NULL GROUP BY module_id",
)
def module_stats(spark, sf):
    return learning.module_stats(attempts(spark, sf)).withColumn("mean_percentage", rounded("mean_percentage"))


@query(
    "latest_rows",
    """SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1""",
)
def latest_rows(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type", "value")
    old, new = e.filter(F.col("event_id") % 2 == 0), e.filter(F.col("event_id") % 2 == 1)
    return learning.latest_rows([old, new], ["user_id", "event_type"], "event_id")


KINDS = {"error": "parameter_tuning", "click": "assessment", "view": "visualization", "purchase": "model_training"}
KIND_SQL = "CASE event_type WHEN 'error' THEN 'parameter_tuning' WHEN 'click' THEN 'assessment' WHEN 'view' THEN 'visualization' WHEN 'purchase' THEN 'model_training' ELSE 'data_quality' END"


def activities(spark, sf):
    e = table(spark, sf, "events")
    kind = F.lit("data_quality")
    for k, v in KINDS.items():
        kind = F.when(F.col("event_type") == k, v).otherwise(kind)
    return e.select("event_id", F.col("user_id").alias("student"), "ts", kind.alias("type"), F.round("value", 2).alias("score"))


def sessions(spark, sf):
    """One session per student and day; sessions of tuning days stay open."""
    a = activities(spark, sf).withColumn("day", F.to_date("ts"))
    return a.groupBy("student", "day").agg(
        F.concat(F.lit("module-"), (F.dayofmonth(F.first("day")) % 10 + 1).cast("string")).alias("module_id"),
        F.min("ts").alias("start_time"),
        F.when(F.count_if(F.col("type") == "parameter_tuning") == 0, F.max("ts")).alias("end_time"),
        F.collect_list(F.struct("type", "score")).alias("activities"),
    )


SESSION_SQL = f"""ac AS (SELECT event_id, user_id AS student, ts, CAST(ts AS DATE) AS day, {KIND_SQL} AS type, round(value, 2) AS score FROM events),
  se AS (SELECT student, day, 'module-' || (day(day) % 10 + 1) AS module_id, min(ts) AS st, CASE WHEN count(*) FILTER (type = 'parameter_tuning') = 0 THEN max(ts) END AS en FROM ac GROUP BY student, day),
  cn AS (SELECT student, count(*) FILTER (type = 'assessment') AS assessments_completed, count(*) FILTER (type = 'assessment' AND score >= 100) AS perfect_scores,
    avg(score) FILTER (type = 'assessment') AS average_score, max(score) FILTER (type = 'assessment') AS max_score, count(*) FILTER (type = 'model_training') AS models_trained,
    count(*) FILTER (type = 'parameter_tuning') AS parameter_experiments, count(*) FILTER (type = 'visualization') AS visualizations_created FROM ac GROUP BY student),
  fi AS (SELECT student, string_agg(DISTINCT module_id, ',' ORDER BY module_id) AS modules_completed, min((epoch_us(en) - epoch_us(st)) / 3.6e9) AS hours, count(DISTINCT module_id) AS nm FROM se WHERE en IS NOT NULL GROUP BY student)"""
MODULES = [f"module-{i}" for i in range(1, 11)]


@query(
    "nested_sessions",
    f"""WITH {SESSION_SQL} SELECT student, assessments_completed, perfect_scores, {r('coalesce(average_score, 0)')} AS average_score, coalesce(max_score, 0) AS max_score, models_trained, parameter_experiments, visualizations_created,
    coalesce(modules_completed, '') AS modules_completed, {r('hours')} AS min_completion_time_hours, coalesce(nm, 0) = 10 AS all_modules_completed FROM cn LEFT JOIN fi USING (student)""",
)
def nested_sessions(spark, sf):
    out = learning.session_stats(sessions(spark, sf), MODULES)
    return out.withColumns(
        {
            "average_score": rounded("average_score"),
            "min_completion_time_hours": rounded("min_completion_time_hours"),
            "modules_completed": F.array_join("modules_completed", ","),
        }
    )


@query(
    "unlocked_achievements",
    f"""WITH {SESSION_SQL}, a AS (SELECT student, list_filter([CASE WHEN assessments_completed >= 15 THEN 'tester' END, CASE WHEN models_trained >= 10 AND visualizations_created >= 10 THEN 'maker' END,
      CASE WHEN contains(coalesce(modules_completed, ''), 'module-2') AND contains(coalesce(modules_completed, ''), 'module-3') THEN 'starter' END], lambda x: x IS NOT NULL) AS l FROM cn LEFT JOIN fi USING (student))
    SELECT student, unnest(l) AS achievement FROM a""",
)
def unlocked_achievements(spark, sf):
    stats = learning.session_stats(sessions(spark, sf), MODULES)
    rules = {
        "tester": {"assessments_completed": 15},
        "maker": {"models_trained": 10, "visualizations_created": 10, "unknown_key": 5},
        "starter": {"modules_completed": ["module-2", "module-3"]},
    }
    return learning.unlocked(stats, "student", rules)


DAILY = "da AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS activities FROM events GROUP BY 1, 2), ve AS (SELECT *, avg(activities) OVER (PARTITION BY user_id ORDER BY day ROWS 6 PRECEDING) AS velocity FROM da)"


@query(
    "daily_velocity",
    f"WITH {DAILY} SELECT user_id, CAST(date_diff('day', DATE '1970-01-01', day) AS INTEGER) AS day_no, activities, {r('velocity')} AS velocity FROM ve",
)
def daily_velocity(spark, sf):
    out = learning.learning_velocity(learning.daily_activity(table(spark, sf, "events"), "user_id", "ts"), "user_id")
    return out.select("user_id", F.unix_date("day").alias("day_no"), "activities", rounded("velocity").alias("velocity"))


@query(
    "study_patterns",
    f"""WITH {DAILY} SELECT user_id, {r('greatest(0, least(1, 1 - stddev_pop(activities) / avg(activities)))')} AS consistency_score, count(*) AS total_active_days, {r('avg(activities)')} AS average_daily_activity,
    CAST(date_diff('day', DATE '1970-01-01', arg_min(day, (-activities, day))) AS INTEGER) AS most_active_day_no FROM da GROUP BY user_id""",
)
def study_patterns(spark, sf):
    out = learning.study_patterns(learning.daily_activity(table(spark, sf, "events"), "user_id", "ts"), "user_id")
    return out.select(
        "user_id", rounded("consistency_score").alias("consistency_score"), "total_active_days",
        rounded("average_daily_activity").alias("average_daily_activity"), F.unix_date("most_active_day").alias("most_active_day_no"),
    )


@query(
    "strengths",
    f"""WITH {SESSION_SQL}, w AS (SELECT * FROM (VALUES ('assessment', 1.0, 'evaluation'), ('model_training', 0.8, 'practical'), ('visualization', 0.6, 'analysis'), ('parameter_tuning', 0.7, 'optimization'), ('data_quality', 0.5, 'foundations')) AS t(type, w, category)),
    c AS (SELECT student, type, count(*) * max(w) AS score, max(category) AS category FROM ac JOIN w USING (type) GROUP BY 1, 2)
    SELECT student, type, {r('CAST(score AS DOUBLE)')} AS score, category, CASE WHEN score > 5 THEN 'strength' ELSE 'weakness' END AS assessment FROM c WHERE score > 5 OR score < 2""",
)
def strengths(spark, sf):
    return learning.strengths(activities(spark, sf), "student", "type").withColumn("score", rounded("score"))


@query(
    "points_levels",
    f"""WITH RECURSIVE {SESSION_SQL}, b AS (SELECT 1 AS level, CAST(100 AS BIGINT) AS need UNION ALL SELECT level + 1, need + CAST(floor(100 * pow(1.2, level)) AS BIGINT) FROM b WHERE level < 60),
    p AS (SELECT student, CAST(sum(floor((CASE type WHEN 'assessment' THEN 50 WHEN 'model_training' THEN 30 WHEN 'visualization' THEN 15 WHEN 'parameter_tuning' THEN 20 ELSE 25 END)
      * (CASE WHEN score >= 95 THEN 1.5 WHEN score >= 85 THEN 1.2 ELSE 1.0 END))) AS BIGINT) AS total_points FROM ac GROUP BY student)
    SELECT student, total_points, CAST((SELECT count(*) FROM b WHERE need <= total_points) + 1 AS INTEGER) AS level FROM p""",
)
def points_levels(spark, sf):
    a = activities(spark, sf).withColumn("points", learning.activity_points("type", "score"))
    total = a.groupBy("student").agg(F.sum("points").alias("total_points"))
    return total.withColumn("level", learning.level("total_points"))


@query(
    "progress_prediction",
    f"""WITH {DAILY}, l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS rn FROM ve),
    g AS (SELECT user_id, regr_slope(velocity, -rn) AS s, arg_min(velocity, rn) AS v, count(*) AS n FROM l WHERE rn <= 7 GROUP BY user_id HAVING count(*) >= 3)
    SELECT user_id, CASE WHEN round(s, 12) > 0 THEN 'improving' WHEN round(s, 12) < 0 THEN 'declining' ELSE 'stable' END AS trend, {r('v')} AS current_velocity, {r('7 / v')} AS estimated_days_per_module, {r('10 / v')} AS predicted_completion_weeks FROM g""",
)
def progress_prediction(spark, sf):
    v = learning.learning_velocity(learning.daily_activity(table(spark, sf, "events"), "user_id", "ts"), "user_id")
    out = learning.predict_progress(v, "user_id")
    return out.select("user_id", "trend", *[rounded(c).alias(c) for c in ("current_velocity", "estimated_days_per_module", "predicted_completion_weeks")])


@query(
    "student_dashboard",
    f"""WITH {ATT_SQL}, l AS (SELECT user_id, percentage, attempt_id, row_number() OVER (PARTITION BY user_id ORDER BY attempt_id DESC) AS rn FROM atm)
    SELECT atm.user_id, count(*) AS total_assessments, round_even(avg(percentage), 1) AS average_score, count(DISTINCT module_id) AS modules_completed, count(*) FILTER (percentage >= 90) AS badges_earned,
      (SELECT array_to_string(list(round(l.percentage, 2)::VARCHAR ORDER BY l.attempt_id), ',') FROM l WHERE l.user_id = atm.user_id AND rn <= 5) AS recent_activity FROM atm GROUP BY atm.user_id""",
)
def student_dashboard(spark, sf):
    out = learning.dashboard(attempts(spark, sf), "user_id", ["attempt_id"])
    return out.withColumn("recent_activity", F.array_join(F.transform("recent_activity", lambda x: x.cast("string")), ","))
