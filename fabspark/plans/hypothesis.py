"""Hypothesis tests on lineitem and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..operators import hypothesis as h
from ..operators.absorbed import absorbed_anova
from ..session import table
from .common import phi_sql
from .registry import query, r


def li(spark, sf):
    return table(spark, sf, "lineitem")


@query(
    "t_one_sample",
    f"""SELECT l_returnflag, count(*) AS n, {r('avg(l_quantity)')} AS mean, {r('stddev_samp(l_quantity)')} AS std,
    {r('(avg(l_quantity) - 25.5) / (stddev_samp(l_quantity) / sqrt(count(*)))')} AS t_stat, {r('(avg(l_quantity) - 25.5) / stddev_samp(l_quantity)')} AS effect_size
    FROM lineitem GROUP BY l_returnflag""",
)
def t_one_sample(spark, sf):
    out = h.one_sample_t(li(spark, sf), ["l_returnflag"], "l_quantity", 25.5)
    return out.select("l_returnflag", "n", *[rounded(c).alias(c) for c in ("mean", "std", "t_stat", "effect_size")])


TWO = """g AS (SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS n1, count(*) FILTER (l_linestatus <> 'F') AS n2,
  avg(l_quantity) FILTER (l_linestatus = 'F') AS m1, avg(l_quantity) FILTER (l_linestatus <> 'F') AS m2,
  var_samp(l_quantity) FILTER (l_linestatus = 'F') AS v1, var_samp(l_quantity) FILTER (l_linestatus <> 'F') AS v2 FROM lineitem GROUP BY l_returnflag)"""


@query(
    "t_two_sample",
    f"""WITH {TWO}, p AS (SELECT *, ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) AS sp FROM g)
    SELECT l_returnflag, n1, n2, {r('(m1 - m2) / sqrt(sp * (1 / n1 + 1 / n2))')} AS t_stat, {r('n1 + n2 - 2')} AS dof, {r('(m1 - m2) / sqrt(sp)')} AS effect_size FROM p""",
)
def t_two_sample(spark, sf):
    out = h.two_sample_t(li(spark, sf), ["l_returnflag"], "l_quantity", F.col("l_linestatus") == "F")
    return out.select("l_returnflag", "n1", "n2", *[rounded(c).alias(c) for c in ("t_stat", "dof", "effect_size")])


@query(
    "t_welch",
    f"""WITH {TWO} SELECT l_returnflag, n1, n2, {r('(m1 - m2) / sqrt(v1 / n1 + v2 / n2)')} AS t_stat,
    {r('pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1))', 3)} AS dof, {r('(m1 - m2) / sqrt((v1 + v2) / 2)')} AS effect_size FROM g""",
)
def t_welch(spark, sf):
    out = h.two_sample_t(li(spark, sf), ["l_returnflag"], "l_quantity", F.col("l_linestatus") == "F", equal_var=False)
    return out.select("l_returnflag", "n1", "n2", rounded("t_stat").alias("t_stat"), rounded("dof", 3).alias("dof"), rounded("effect_size").alias("effect_size"))


@query("t_test_p_values")
def t_test_p_values(spark, sf):
    one = h.one_sample_t(li(spark, sf), ["l_returnflag"], "l_quantity", 25.5).select("l_returnflag", F.lit("one sample").alias("test"), "p_value")
    two = h.two_sample_t(li(spark, sf), ["l_returnflag"], "l_quantity", F.col("l_linestatus") == "F", alternative="greater")
    return one.unionByName(two.select("l_returnflag", F.lit("two samples, greater").alias("test"), "p_value"))


ANOVA = """gs AS (SELECT {f} AS g, count(*) AS n, avg({v}) AS m, var_samp({v}) AS v FROM {t} GROUP BY 1),
  gm AS (SELECT sum(n * m) / sum(n) AS gm FROM gs),
  aa AS (SELECT count(*) AS k, CAST(sum(n) AS BIGINT) AS nn, sum(n * (m - gm) * (m - gm)) AS ssb, sum((n - 1) * v) AS ssw FROM gs, gm)"""


@query(
    "anova_one_way",
    f"""WITH {ANOVA.format(f='l_suppkey', v='l_quantity', t='lineitem')} SELECT k AS n_groups, nn AS total_n, {r('ssb', 3)} AS ss_between, {r('ssw', 3)} AS ss_within,
    {r('(ssb / (k - 1)) / (ssw / (nn - k))')} AS f_stat, {r('ssb / (ssb + ssw)')} AS eta_squared,
    CASE WHEN ssb / (ssb + ssw) < 0.01 THEN 'Negligible' WHEN ssb / (ssb + ssw) < 0.06 THEN 'Small' WHEN ssb / (ssb + ssw) < 0.14 THEN 'Medium' ELSE 'Large' END AS effect_size FROM aa""",
)
def anova_one_way(spark, sf):
    out = h.anova(li(spark, sf), "l_suppkey", "l_quantity")
    return out.select(
        "n_groups", "total_n", rounded("ss_between", 3).alias("ss_between"), rounded("ss_within", 3).alias("ss_within"),
        rounded("f_stat").alias("f_stat"), rounded("eta_squared").alias("eta_squared"), "effect_size",
    )


@query("anova_p_value")
def anova_p_value(spark, sf):
    return h.anova(li(spark, sf), "l_suppkey", "l_quantity")


# Type II sums for a factor a and a two-level factor b: the additive model is the
# one of a, less what b explains inside its levels.
TYPE2_SQL = f"""WITH x AS (SELECT l_returnflag AS a, l_linestatus AS b, CAST(l_linestatus = 'O' AS DOUBLE) AS o, CAST(l_quantity AS DOUBLE) AS y FROM lineitem),
    m AS (SELECT y, o, a, b, avg(y) OVER () AS my, avg(y) OVER (PARTITION BY a) AS ya, avg(o) OVER (PARTITION BY a) AS oa, avg(y) OVER (PARTITION BY b) AS yb, avg(y) OVER (PARTITION BY a, b) AS yc FROM x),
    s AS (SELECT count(*) AS n, sum((y - my) * (y - my)) AS r0, sum((y - ya) * (y - ya)) AS ra, sum((y - yb) * (y - yb)) AS rb, sum((y - yc) * (y - yc)) AS rc,
      sum((y - ya) * (y - ya)) - sum((o - oa) * (y - ya)) * sum((o - oa) * (y - ya)) / sum((o - oa) * (o - oa)) AS rab,
      count(DISTINCT a) AS la, count(DISTINCT b) AS lb, count(DISTINCT a || '/' || b) AS cells FROM m),
    t AS (SELECT 'l_returnflag' AS term, rb - rab AS ss, la - 1 AS d FROM s UNION ALL SELECT 'l_linestatus', ra - rab, lb - 1 FROM s
      UNION ALL SELECT 'l_returnflag:l_linestatus', rab - rc, cells - la - lb + 1 FROM s UNION ALL SELECT 'Residual', rc, n - cells FROM s)
    SELECT term, {r('ss', 3)} AS sum_sq, CAST(d AS INTEGER) AS dof, {r("CASE WHEN term <> 'Residual' THEN ss / nullif(d, 0) / (rc / (n - cells)) END", 5)} AS f_stat,
      {r('ss / sum(ss) OVER ()', 8)} AS eta_squared, {r('1 - rc / r0', 8)} AS r_squared, {r('1 - (rc / r0) * (n - 1) / (n - cells)', 8)} AS adj_r_squared FROM t, s"""


@query("anova_two_way_main", TYPE2_SQL)
def anova_two_way_main(spark, sf):
    out = h.multi_way_anova(li(spark, sf), "l_quantity", ["l_returnflag", "l_linestatus"]).drop("p_value")
    return out.withColumns({"sum_sq": rounded("sum_sq", 3), "f_stat": rounded("f_stat", 5), **{c: rounded(c, 8) for c in ("eta_squared", "r_squared", "adj_r_squared")}})


@query("anova_type2_table")
def anova_type2_table(spark, sf):
    return h.multi_way_anova(li(spark, sf), "l_quantity", ["l_returnflag", "l_linestatus"])


@query(
    "factorial_effects",
    f"""WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, avg(l_quantity) AS m FROM lineitem GROUP BY 1, 2),
    k AS (SELECT max(m) FILTER (a = 'A' AND b = 'F') AS af, max(m) FILTER (a = 'A' AND b = 'O') AS ao, max(m) FILTER (a = 'N' AND b = 'F') AS nf,
      max(m) FILTER (a = 'N' AND b = 'O') AS no, max(m) FILTER (a = 'R' AND b = 'F') AS rf, max(m) FILTER (a = 'R' AND b = 'O') AS ro FROM c)
    SELECT 'l_returnflag[N]' AS effect, {r('nf - af')} AS coefficient FROM k UNION ALL SELECT 'l_returnflag[R]', {r('rf - af')} FROM k
    UNION ALL SELECT 'l_linestatus[O]', {r('ao - af')} FROM k UNION ALL SELECT 'l_returnflag[N]:l_linestatus[O]', {r('no - nf - ao + af')} FROM k
    UNION ALL SELECT 'l_returnflag[R]:l_linestatus[O]', {r('ro - rf - ao + af')} FROM k""",
)
def factorial_effects(spark, sf):
    out = h.factorial_effects(li(spark, sf), "l_quantity", ["l_returnflag", "l_linestatus"])
    return out.select("effect", rounded("coefficient").alias("coefficient"))


@query(
    "levene",
    f"""WITH md AS (SELECT l_returnflag, median(l_extendedprice) AS md FROM lineitem GROUP BY 1),
    dv AS (SELECT l_returnflag, abs(l_extendedprice - md) AS d FROM lineitem JOIN md USING (l_returnflag)),
    {ANOVA.format(f='l_returnflag', v='d', t='dv')} SELECT {r('(ssb / (k - 1)) / (ssw / (nn - k))')} AS w_stat, k - 1 AS df_between, nn - k AS df_within FROM aa""",
)
def levene(spark, sf):
    return h.levene(li(spark, sf), "l_returnflag", "l_extendedprice").select(rounded("w_stat").alias("w_stat"), "df_between", "df_within")


@query(
    "durbin_watson",
    f"""WITH e AS (SELECT user_id, ts, event_id, value - avg(value) OVER (PARTITION BY user_id) AS e FROM events),
    d AS (SELECT user_id, e, e - lag(e) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM e)
    SELECT user_id, count(e) AS n, {r('sum(d * d) / sum(e * e)')} AS dw,
    CASE WHEN sum(d * d) / sum(e * e) > 1.5 AND sum(d * d) / sum(e * e) < 2.5 THEN 'No autocorrelation' ELSE 'Possible autocorrelation' END AS interpretation FROM d GROUP BY user_id""",
)
def durbin_watson(spark, sf):
    from ..operators.ranks import attach_stats

    ev = table(spark, sf, "events").select("user_id", "ts", "event_id", "value")
    ev = attach_stats(ev, ev.groupBy("user_id").agg(F.avg("value").alias("m")), ["user_id"]).withColumn("e", F.col("value") - F.col("m"))
    return h.durbin_watson(ev, ["user_id"], ["ts", "event_id"], "e").withColumn("dw", rounded("dw"))


@query(
    "pairwise_groups",
    f"""WITH g AS (SELECT event_type AS g, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM events GROUP BY 1),
    p AS (SELECT sum((n - 1) * v) / (sum(n) - count(*)) AS mse FROM g)
    SELECT a.g AS group1, b.g AS group2, {r('b.m - a.m')} AS mean_diff,
      {r('(a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) * (1 / a.n + 1 / b.n))')} AS t_stat,
      {r('abs(b.m - a.m) / sqrt(mse / 2 * (1 / a.n + 1 / b.n))')} AS q_stat FROM g a JOIN g b ON a.g < b.g CROSS JOIN p""",
)
def pairwise_groups(spark, sf):
    out = h.pairwise_groups(table(spark, sf, "events"), "event_type", "value")
    return out.select("group1", "group2", *[rounded(c).alias(c) for c in ("mean_diff", "t_stat", "q_stat")])


@query(
    "anova_absorbed",
    f"""WITH e AS (SELECT l_suppkey AS g, l_returnflag AS f, CAST(l_returnflag = 'N' AS DOUBLE) AS a, CAST(l_returnflag = 'R' AS DOUBLE) AS b, CAST(l_quantity AS DOUBLE) AS y FROM lineitem),
    w AS (SELECT a - avg(a) OVER k AS a, b - avg(b) OVER k AS b, y - avg(y) OVER k AS y FROM e WINDOW k AS (PARTITION BY g)),
    s AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS by_, sum(y * y) AS yy, count(*) AS n FROM w),
    r AS (SELECT *, yy - ((ay * bb - by_ * ab) * ay + (by_ * aa - ay * ab) * by_) / (aa * bb - ab * ab) AS rss FROM s),
    q AS (SELECT sum((y - m) * (y - m)) AS rss0 FROM (SELECT y, avg(y) OVER (PARTITION BY f) AS m FROM e)), l AS (SELECT count(DISTINCT g) AS levels FROM e)
    SELECT 'l_returnflag' AS term, {r('yy - rss', 4)} AS sum_sq, 2 AS dof FROM r UNION ALL SELECT 'l_suppkey', {r('rss0 - rss', 4)}, CAST(levels - 1 AS INTEGER) FROM r, q, l
    UNION ALL SELECT 'Residual', {r('rss', 4)}, CAST(n - levels - 2 AS INTEGER) FROM r, l""",
)
def anova_absorbed(spark, sf):
    out = absorbed_anova(li(spark, sf), "l_quantity", ["l_returnflag"], "l_suppkey")
    return out.select("term", rounded("sum_sq", 4).alias("sum_sq"), "dof")


@query("pairwise_p_values")
def pairwise_p_values(spark, sf):
    return h.pairwise_groups(table(spark, sf, "events"), "event_type", "value")


RANKS = "rk AS (SELECT {g} AS g, rank() OVER (ORDER BY {v}) + (count(*) OVER (PARTITION BY {v}) - 1) / 2.0 AS rk FROM {t}), tie AS (SELECT sum(CAST(n AS DOUBLE) * n * n - n) AS ties FROM (SELECT count(*) AS n FROM {t} GROUP BY {v}))"


@query(
    "kruskal",
    f"""WITH {RANKS.format(g='l_returnflag', v='l_quantity', t='lineitem')}, s AS (SELECT g, count(*) AS n, sum(rk) AS rs FROM rk GROUP BY g),
    t AS (SELECT count(*) AS k, CAST(sum(n) AS DOUBLE) AS nn, sum(rs * rs / n) AS s FROM s)
    SELECT k AS n_groups, CAST(nn AS BIGINT) AS total_n, {r('(12 / (nn * (nn + 1)) * s - 3 * (nn + 1)) / (1 - ties / (nn * nn * nn - nn))', 5)} AS h_stat FROM t, tie""",
)
def kruskal(spark, sf):
    return h.kruskal(li(spark, sf), "l_returnflag", "l_quantity").select("n_groups", "total_n", rounded("h_stat", 5).alias("h_stat"))


@query(
    "mann_whitney",
    f"""WITH {RANKS.format(g="l_linestatus = 'F'", v='l_quantity', t='lineitem')},
    s AS (SELECT CAST(count(*) FILTER (g) AS DOUBLE) AS n1, CAST(count(*) FILTER (NOT g) AS DOUBLE) AS n2, sum(rk) FILTER (g) AS r1 FROM rk),
    u AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u, n1 + n2 AS n FROM s)
    SELECT CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, u AS u_stat,
    {r('(greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1))))')} AS z_stat FROM u, tie""",
)
def mann_whitney(spark, sf):
    out = h.mann_whitney(li(spark, sf), "l_linestatus", "F", "l_quantity")
    return out.select("n1", "n2", "u_stat", rounded("z_stat").alias("z_stat"))


@query(
    "chi2_independence",
    f"""WITH o AS (SELECT event_type AS a, user_id AS b, count(*) AS o FROM events GROUP BY 1, 2), n AS (SELECT sum(o) AS n FROM o),
    a AS (SELECT a, sum(o) AS ra FROM o GROUP BY 1), b AS (SELECT b, sum(o) AS rb FROM o GROUP BY 1),
    x AS (SELECT coalesce(o, 0) AS o, ra * rb / n AS e FROM a CROSS JOIN b CROSS JOIN n LEFT JOIN o USING (a, b))
    SELECT (SELECT CAST(n AS BIGINT) FROM n) AS n, ((SELECT count(*) FROM a) - 1) * ((SELECT count(*) FROM b) - 1) AS dof, {r('sum((o - e) * (o - e) / e)', 5)} AS chi2 FROM x""",
)
def chi2_independence(spark, sf):
    return h.chi_square(table(spark, sf, "events"), "event_type", "user_id").select("n", "dof", rounded("chi2", 5).alias("chi2"))


@query(
    "chi2_two_by_two",
    f"""WITH o AS (SELECT quality AS a, toxic AS b, count(*) AS o FROM labels GROUP BY 1, 2), n AS (SELECT sum(o) AS n FROM o),
    a AS (SELECT a, sum(o) AS ra FROM o GROUP BY 1), b AS (SELECT b, sum(o) AS rb FROM o GROUP BY 1),
    x AS (SELECT coalesce(o, 0) AS o, ra * rb / n AS e FROM a CROSS JOIN b CROSS JOIN n LEFT JOIN o USING (a, b))
    SELECT (SELECT CAST(n AS BIGINT) FROM n) AS n, CAST(1 AS BIGINT) AS dof, {r('sum(pow(greatest(0, abs(o - e) - 0.5), 2) / e)')} AS chi2 FROM x""",
)
def chi2_two_by_two(spark, sf):
    return h.chi_square(table(spark, sf, "labels"), "quality", "toxic").select("n", "dof", rounded("chi2").alias("chi2"))


@query(
    "goodness_of_fit",
    f"""WITH c AS (SELECT event_type, count(*) AS o FROM events GROUP BY 1), n AS (SELECT sum(o) AS n FROM c)
    SELECT CAST(max(n) AS BIGINT) AS n, 4 AS dof, {r('sum((o - n * 0.2) * (o - n * 0.2) / (n * 0.2))', 5)} AS chi2 FROM c, n""",
)
def goodness_of_fit(spark, sf):
    shares = {t: 0.2 for t in ("click", "error", "purchase", "signup", "view")}
    return h.goodness_of_fit(table(spark, sf, "events"), "event_type", shares).select("n", "dof", rounded("chi2", 5).alias("chi2"))


NORM = f"""s AS (SELECT avg({{v}}) AS mu, stddev_samp({{v}}) AS sd, count(*) AS nn FROM {{t}}),
  c AS (SELECT {{v}} AS x, count(*) AS n FROM {{t}} GROUP BY 1),
  k AS (SELECT x, n, sum(n) OVER (ORDER BY x) AS up, mu, sd, nn FROM c, s),
  d AS (SELECT *, up - n AS below, {phi_sql('(x - mu) / sd')} AS f, {phi_sql('(mu - x) / sd')} AS g FROM k)"""


@query(
    "ks_normal",
    f"WITH {NORM.format(v='l_quantity', t='lineitem')} SELECT max(nn) AS n, {r('max(greatest(up / nn - f, f - below / nn))', 8)} AS ks_stat FROM d",
)
def ks_normal(spark, sf):
    return h.ks_normal(li(spark, sf), "l_quantity").select("n", rounded("ks_stat", 8).alias("ks_stat"))


@query(
    "anderson_darling",
    f"""WITH {NORM.format(v='l_quantity', t='lineitem')}
    SELECT max(nn) AS n, {r('-max(nn) - sum(ln(f) * (CAST(up AS DOUBLE) * up - CAST(below AS DOUBLE) * below) + ln(g) * (pow(nn - below, 2) - pow(nn - up, 2))) / max(nn)', 4)} AS a2 FROM d""",
)
def anderson_darling(spark, sf):
    return h.anderson_darling(li(spark, sf), "l_quantity").select("n", rounded("a2", 4).alias("a2"))


@query(
    "dagostino",
    f"""WITH m AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(value) AS mu FROM events),
    c AS (SELECT max(n) AS n, avg(pow(value - mu, 3)) / pow(avg(pow(value - mu, 2)), 1.5) AS g, avg(pow(value - mu, 4)) / pow(avg(pow(value - mu, 2)), 2) AS b2 FROM events, m),
    a AS (SELECT *, g * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y, 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS beta FROM c),
    w AS (SELECT *, sqrt(2 * (beta - 1)) - 1 AS w2 FROM a),
    z AS (SELECT *, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) AS z1,
      (b2 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS x,
      6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS sb FROM w),
    k AS (SELECT *, 6 + 8 / sb * (2 / sb + sqrt(1 + 4 / (sb * sb))) AS aa FROM z),
    f AS (SELECT n, z1, (1 - 2 / (9 * aa) - cbrt((1 - 2 / aa) / (1 + x * sqrt(2 / (aa - 4))))) / sqrt(2 / (9 * aa)) AS z2 FROM k)
    SELECT CAST(n AS BIGINT) AS n, {r('z1')} AS z_skew, {r('z2')} AS z_kurtosis, {r('z1 * z1 + z2 * z2', 4)} AS k2 FROM f""",
)
def dagostino(spark, sf):
    out = h.dagostino(table(spark, sf, "events"), "value")
    return out.select("n", rounded("z_skew").alias("z_skew"), rounded("z_kurtosis").alias("z_kurtosis"), rounded("k2", 4).alias("k2"))


@query(
    "fit_rank_aic",
    f"""WITH s AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(l_extendedprice) AS m, var_pop(l_extendedprice) AS v, min(l_extendedprice) AS lo,
      avg(ln(l_extendedprice)) AS lm, var_pop(ln(l_extendedprice)) AS lv FROM lineitem),
    f AS (SELECT 'normal' AS distribution, -n / 2 * (ln(2 * pi()) + ln(v) + 1) AS ll, 2 AS k, n FROM s
      UNION ALL SELECT 'lognormal', -n / 2 * (ln(2 * pi()) + ln(lv) + 1) - n * lm, 3, n FROM s
      UNION ALL SELECT 'exponential', -n * (ln(m - lo) + 1), 2, n FROM s)
    SELECT distribution, {r('ll', 3)} AS log_likelihood, {r('2 * k - 2 * ll', 3)} AS aic, {r('k * ln(n) - 2 * ll', 3)} AS bic FROM f""",
)
def fit_rank_aic(spark, sf):
    out = h.fit_distributions(li(spark, sf), "l_extendedprice")
    return out.select("distribution", *[rounded(c, 3).alias(c) for c in ("log_likelihood", "aic", "bic")])


@query(
    "fit_ks",
    f"""WITH s AS (SELECT count(*) AS n, avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS sd, min(l_extendedprice) AS lo, avg(ln(l_extendedprice)) AS lm, stddev_pop(ln(l_extendedprice)) AS ls FROM lineitem),
    c AS (SELECT l_extendedprice AS x, count(*) AS k FROM lineitem GROUP BY 1), u AS (SELECT x, k, sum(k) OVER (ORDER BY x) AS up FROM c),
    d AS (SELECT up / n AS hi, (up - k) / n AS lo_share, {phi_sql('(x - m) / sd')} AS f1, {phi_sql('(ln(x) - lm) / ls')} AS f2, 1 - exp(-(x - lo) / (m - lo)) AS f3 FROM u, s)
    SELECT 'normal' AS distribution, {r('max(greatest(hi - f1, f1 - lo_share))')} AS ks_stat FROM d UNION ALL SELECT 'lognormal', {r('max(greatest(hi - f2, f2 - lo_share))')} FROM d
    UNION ALL SELECT 'exponential', {r('max(greatest(hi - f3, f3 - lo_share))')} FROM d""",
)
def fit_ks(spark, sf):
    return h.fit_distributions(li(spark, sf), "l_extendedprice").select("distribution", rounded("ks_stat").alias("ks_stat"))


@query("qq_linearity")
def qq_linearity(spark, sf):
    return h.qq_linearity(li(spark, sf), "l_extendedprice")
