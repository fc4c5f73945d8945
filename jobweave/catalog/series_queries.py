"""Registered queries: moving average (H1), statistics (M), time series (N), chart data (O),
named analyses (P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobweave import rules
from jobweave.catalog import layers as L
from jobweave.catalog import oracle as O
from jobweave.catalog.market_queries import SKILL_CAT_SQL, rounded
from jobweave.catalog.registry import query
from jobweave.operators import analyses as A
from jobweave.operators import charts as CH
from jobweave.operators import counts as K
from jobweave.operators import market as M
from jobweave.operators import statistics as ST
from jobweave.operators import timeseries as TS
from jobweave.sources import derived as D


def as_text(df, *cols):
    return df.withColumns({c: F.col(c).cast("string") for c in cols})


_WEEK = "SELECT CAST(CAST(date_trunc('week', posted_date_dt) AS DATE) AS VARCHAR) AS week, count(*) AS n FROM gold WHERE posted_date_dt IS NOT NULL GROUP BY 1"


@query("h1_centred_moving_average", O.gold(f"""
WITH w AS ({_WEEK}) SELECT week, n, round(CASE WHEN count(*) OVER o = 3 THEN avg(n) OVER o END, 6) AS moving_avg
FROM w WINDOW o AS (ORDER BY week ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"""))
def _(spark, d):
    return rounded(as_text(TS.centred_average(TS.weekly_counts(L.gold(spark, d)), "week"), "week"), "moving_avg")


# -- M ---------------------------------------------------------------------------------
_COLS = ["salary", "years", "skills", "level", "remote"]
_CORR_SRC = (f"m AS (SELECT salary_midpoint_usd AS salary, experience_years_parsed AS years, CAST(skill_count AS DOUBLE) AS skills, "
             f"CAST(list_position({O.sql_list(rules.LEVEL_ORDER)}, experience_level_inferred) - 1 AS DOUBLE) AS level, "
             f"CAST(is_remote AS INTEGER) AS remote FROM chart_sal), f AS (SELECT * FROM m WHERE salary IS NOT NULL AND years IS NOT NULL "
             f"AND skills IS NOT NULL AND level IS NOT NULL)")


@query("m1_correlation_matrix", O.over(f"{O.CHART}, {_CORR_SRC}", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM f" for a in _COLS for b in _COLS)))
def _(spark, d):
    df = ST.with_correlation_columns(L.chart_salary(spark, d))
    return rounded(ST.correlation_matrix(df, _COLS), "r")


@query("m1_correlation_lineitem", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem"
    for a in ("l_quantity", "l_extendedprice", "l_discount") for b in ("l_quantity", "l_extendedprice", "l_discount")))
def _(spark, d):
    return rounded(ST.correlation_matrix(L.table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]), "r")


@query("m2_least_squares", O.chart("""
SELECT round(regr_slope(salary_midpoint_usd, experience_years_parsed), 6) AS slope,
  round(regr_intercept(salary_midpoint_usd, experience_years_parsed), 6) AS intercept,
  CAST(regr_count(salary_midpoint_usd, experience_years_parsed) AS BIGINT) AS n FROM chart_sal WHERE experience_years_parsed <= 25"""))
def _(spark, d):
    return rounded(ST.least_squares(L.chart_salary(spark, d), M.SALARY, "experience_years_parsed", 25), "slope", "intercept")


@query("m3_exact_quantiles", """
SELECT o_orderpriority, count(*) AS n, round(quantile_cont(o_totalprice, 0.25), 4) AS q25, round(quantile_cont(o_totalprice, 0.5), 4) AS q50,
  round(quantile_cont(o_totalprice, 0.99), 4) AS q99 FROM orders GROUP BY 1""")
def _(spark, d):
    from jobweave.operators.quantiles import exact_quantiles

    out = exact_quantiles(L.table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice", [0.25, 0.5, 0.99])
    return out.withColumns({c: F.round(c, 4) for c in ("q25", "q50", "q99")})


@query("m4_describe", O.silver("""
SELECT count(salary_min_usd) AS n, round(avg(salary_min_usd), 6) AS mean, round(stddev_samp(salary_min_usd), 6) AS std,
  round(min(salary_min_usd), 6) AS min, round(quantile_cont(salary_min_usd, 0.25), 6) AS p25, round(median(salary_min_usd), 6) AS median,
  round(quantile_cont(salary_min_usd, 0.75), 6) AS p75, round(max(salary_min_usd), 6) AS max FROM silver"""))
def _(spark, d):
    return rounded(ST.describe(L.silver(spark, d), "salary_min_usd"), "mean", "std", "min", "p25", "median", "p75", "max")


# -- N ---------------------------------------------------------------------------------
@query("n1_monthly_counts", O.gold("SELECT month, count(*) AS n FROM gold WHERE month IS NOT NULL GROUP BY 1"))
def _(spark, d):
    return TS.monthly_counts(L.gold(spark, d))


@query("n2_month_kpis", O.gold("""
WITH m AS (SELECT month, count(*) AS n FROM gold WHERE month IS NOT NULL GROUP BY 1)
SELECT count(*) AS months, round((max(n) - avg(n)) / avg(n) * 100, 6) AS peak_change_pct,
  (SELECT month FROM m ORDER BY n DESC, month LIMIT 1) AS peak_month, (SELECT n FROM m ORDER BY n DESC, month LIMIT 1) AS peak_n,
  (SELECT month FROM m ORDER BY n, month LIMIT 1) AS low_month, (SELECT n FROM m ORDER BY n, month LIMIT 1) AS low_n FROM m"""))
def _(spark, d):
    return rounded(TS.month_kpis(L.gold(spark, d)), "peak_change_pct")


_GRID = """SELECT m.month, r.role_category, count(g.job_hash) AS n FROM m CROSS JOIN r
LEFT JOIN k g ON g.month = m.month AND g.role_category = r.role_category GROUP BY 1, 2"""


@query("n3_month_by_role", O.gold(f"""
WITH k0 AS (SELECT * FROM gold WHERE month IS NOT NULL),
r AS (SELECT role_category FROM k0 GROUP BY 1 ORDER BY count(*) DESC, role_category LIMIT 5),
k AS (SELECT * FROM k0 WHERE role_category IN (SELECT role_category FROM r)), m AS (SELECT DISTINCT month FROM k) {_GRID}"""))
def _(spark, d):
    return TS.month_by_key(L.gold(spark, d), "role_category", n=5)


@query("n3_month_by_focus_role", O.chart(f"""
WITH k AS (SELECT *, strftime(posted_date_dt, '%Y-%m') AS month FROM chart WHERE posted_date_dt IS NOT NULL AND role_category IN {O.in_list(rules.TREND_ROLES)}),
r AS (SELECT DISTINCT role_category FROM k), m AS (SELECT DISTINCT month FROM k) {_GRID}"""))
def _(spark, d):
    return TS.month_by_key(L.chart(spark, d), "role_category", values=rules.TREND_ROLES)


@query("n4_weekday_counts", O.gold(f"""
SELECT CAST(isodow(posted_date_dt) - 1 AS INTEGER) AS weekday, ({O.sql_list(rules.WEEKDAY_LABELS)})[isodow(posted_date_dt)] AS label, count(*) AS n
FROM gold WHERE posted_date_dt IS NOT NULL GROUP BY 1, 2"""))
def _(spark, d):
    return TS.weekday_counts(L.gold(spark, d))


@query("n5_weekly_counts", O.gold(_WEEK))
def _(spark, d):
    return as_text(TS.weekly_counts(L.gold(spark, d)), "week")


@query("n5_weekly_events", "SELECT CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR) AS week, count(*) AS n FROM events GROUP BY 1")
def _(spark, d):
    return as_text(TS.weekly_counts(L.table(spark, d, "events"), "ts"), "week")


@query("n6_moving_average_events", """
WITH w AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events GROUP BY 1)
SELECT day, n, round(CASE WHEN count(*) OVER o = 3 THEN avg(n) OVER o END, 6) AS moving_avg
FROM w WINDOW o AS (ORDER BY day ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)""")
def _(spark, d):
    per = L.table(spark, d, "events").groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("n"))
    return rounded(TS.centred_average(per, "day"), "moving_avg")


# -- O ---------------------------------------------------------------------------------
def _hist_sql(src, bins, min_step):
    return f"""WITH e AS (SELECT min(salary_midpoint_usd) AS lo, greatest((max(salary_midpoint_usd) - min(salary_midpoint_usd)) / {bins}, {min_step}) AS step FROM {src}),
c AS (SELECT CAST(least(floor((salary_midpoint_usd - lo) / step), {bins - 1}) AS INTEGER) AS bin, count(*) AS n FROM {src}, e GROUP BY 1)
SELECT CAST(i AS INTEGER) AS bin, round(lo + i * step, 6) AS bin_start, coalesce(n, 0) AS n FROM range(0, {bins}) t(i) CROSS JOIN e LEFT JOIN c ON c.bin = i"""


@query("o1_histogram_12", O.gold(_hist_sql("gold_sal", 12, 1)))
def _(spark, d):
    return rounded(CH.histogram(L.gold_salary(spark, d), M.SALARY, 12, 1.0), "bin_start")


@query("o1_histogram_40", O.chart(_hist_sql("chart_sal", 40, 0)))
def _(spark, d):
    return rounded(CH.histogram(L.chart_salary(spark, d), M.SALARY, 40), "bin_start")


@query("o1_auto_histogram", O.gold("""
WITH e AS (SELECT (max(salary_midpoint_usd) - min(salary_midpoint_usd)) / 35 AS raw FROM gold_sal),
p AS (SELECT raw, pow(10, floor(log10(raw))) AS p FROM e),
w AS (SELECT CASE WHEN raw <= p THEN p WHEN raw <= 2 * p THEN 2 * p WHEN raw <= 5 * p THEN 5 * p ELSE 10 * p END AS w FROM p)
SELECT floor(salary_midpoint_usd / w) * w AS bin_start, count(*) AS n FROM gold_sal, w GROUP BY 1"""))
def _(spark, d):
    return CH.auto_histogram(L.gold_salary(spark, d), M.SALARY)


@query("o2_box_stats", O.gold(f"""
WITH b AS (SELECT experience_level_inferred AS l, count(*) AS n, quantile_cont(salary_midpoint_usd, 0.25) AS q1, median(salary_midpoint_usd) AS median,
  quantile_cont(salary_midpoint_usd, 0.75) AS q3 FROM gold_sal GROUP BY 1),
x AS (SELECT b.*, salary_midpoint_usd AS v, salary_midpoint_usd BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
  FROM gold_sal JOIN b ON l = experience_level_inferred)
SELECT l AS experience_level_inferred, n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, min(v) FILTER (inside) AS whisker_low,
  max(v) FILTER (inside) AS whisker_high, count(*) FILTER (NOT inside) AS outliers,
  CAST(list_position({O.sql_list(rules.LEVEL_ORDER)}, l) AS INTEGER) AS ord FROM x GROUP BY 1, 2, 3, 4, 5"""))
def _(spark, d):
    out = CH.box_stats(L.gold_salary(spark, d), "experience_level_inferred", M.SALARY, order=rules.LEVEL_ORDER)
    return rounded(out, "q1", "median", "q3").withColumn("ord", F.col("ord").cast("int"))


@query("o3_donut_shares", O.gold("SELECT source_website, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM gold), 6) AS share FROM gold GROUP BY 1"))
def _(spark, d):
    return rounded(K.shares(L.gold(spark, d), "source_website", 100.0), "share")


@query("o4_heatmap_matrix", """
SELECT event_type, count(*) FILTER (dow = 0) AS d0, count(*) FILTER (dow = 1) AS d1, count(*) FILTER (dow = 2) AS d2,
  count(*) FILTER (dow = 3) AS d3, count(*) FILTER (dow = 4) AS d4, count(*) FILTER (dow = 5) AS d5, count(*) FILTER (dow = 6) AS d6
FROM (SELECT event_type, isodow(ts) - 1 AS dow FROM events) GROUP BY 1""")
def _(spark, d):
    df = L.table(spark, d, "events").withColumn("dow", F.concat(F.lit("d"), F.weekday("ts")))
    return K.pivot_counts(df, "event_type", "dow", [f"d{i}" for i in range(7)])


@query("o5_tag_weights", O.gold("""
WITH t AS (SELECT s AS skill, count(*) AS n FROM (SELECT unnest(dash_skills) AS s FROM gold) GROUP BY 1 ORDER BY n DESC, skill LIMIT 50),
r AS (SELECT skill, n, (n - min(n) OVER ()) / greatest(max(n) OVER () - min(n) OVER (), 1) AS ratio FROM t)
SELECT skill, n, CAST(round_even(12 + ratio * 14, 0) AS INTEGER) AS size, CAST(round_even(200 + ratio * 60, 0) AS INTEGER) AS hue,
  round(0.5 + ratio * 0.5, 6) AS opacity FROM r"""))
def _(spark, d):
    return rounded(CH.tag_weights(M.skill_counts(L.gold(spark, d), n=50)), "opacity")


@query("o5_cloud_counts", O.chart(f"""
SELECT skill, count(*) AS n FROM (SELECT unnest(chart_skills) AS skill FROM chart) WHERE skill NOT IN {O.in_list(rules.CHART_EXCLUDED_SKILLS)}
AND length(skill) > 1 GROUP BY 1 HAVING count(*) >= 5 ORDER BY n DESC, skill LIMIT 80"""))
def _(spark, d):
    return CH.cloud_counts(M.skill_counts(L.chart(spark, d), "chart_skills", None, rules.CHART_EXCLUDED_SKILLS, 2))


# -- P ---------------------------------------------------------------------------------
def _postings(spark, d):
    return L.chart(spark, d).withColumn("skills", F.col("chart_skills"))


_VC = "SELECT {k}, count(*) AS n FROM silver GROUP BY 1{tail}"


@query("p1_top_job_titles", O.silver(_VC.format(k="job_title", tail=" ORDER BY n DESC, job_title LIMIT 15")))
def _(spark, d):
    return A.top_job_titles(L.silver(spark, d))


@query("p2_jobs_by_city", O.silver(_VC.format(k="location_normalized", tail="")))
def _(spark, d):
    return A.jobs_by_city(L.silver(spark, d))


@query("p3_remote_vs_onsite", O.silver(f"""
SELECT CASE WHEN contains(t, 'hybrid') THEN 'Hybrid' WHEN {O.any_of('t', rules.REMOTE_LOCATION_WORDS)} THEN 'Remote' ELSE 'Onsite' END AS workplace,
  count(*) AS n FROM (SELECT lower(location || ' ' || employment_type) AS t FROM silver) GROUP BY 1"""))
def _(spark, d):
    return A.remote_vs_onsite(L.silver(spark, d))


@query("p4_hiring_trend_by_month", O.silver("SELECT strftime(posted_date_dt, '%Y-%m') AS month, count(*) AS n FROM silver WHERE posted_date_dt IS NOT NULL GROUP BY 1"))
def _(spark, d):
    return A.hiring_trend_by_month(L.silver(spark, d))


@query("p5_top_hiring_companies", O.silver(_VC.format(k="company_name", tail=" ORDER BY n DESC, company_name LIMIT 20")))
def _(spark, d):
    return A.top_hiring_companies(L.silver(spark, d))


@query("p6_jobs_by_experience_level", O.silver(_VC.format(k="experience_level_inferred", tail="")))
def _(spark, d):
    return A.jobs_by_experience_level(L.silver(spark, d))


@query("p7_jobs_by_source", O.silver(_VC.format(k="source_website", tail="")))
def _(spark, d):
    return A.jobs_by_source(L.silver(spark, d))


@query("p8_salary_distribution", O.silver("""
SELECT round(avg(salary_min_usd), 6) AS mean, round(median(salary_min_usd), 6) AS median, round(stddev_samp(salary_min_usd), 6) AS std,
  round(min(salary_min_usd), 6) AS min, round(max(salary_min_usd), 6) AS max FROM silver"""))
def _(spark, d):
    return rounded(A.salary_distribution(L.silver(spark, d)), "mean", "median", "std", "min", "max")


_MED = "SELECT {k}, round(median(salary_min_usd), 6) AS median_salary FROM silver WHERE salary_min_usd IS NOT NULL GROUP BY 1"


@query("p9_salary_by_role", O.silver(_MED.format(k="job_title")))
def _(spark, d):
    return rounded(A.salary_by_role(L.silver(spark, d)), "median_salary")


@query("p10_salary_by_location", O.silver(_MED.format(k="location_normalized")))
def _(spark, d):
    return rounded(A.salary_by_location(L.silver(spark, d)), "median_salary")


@query("p11_salary_by_experience", O.silver(_MED.format(k="experience_level_inferred")))
def _(spark, d):
    return rounded(A.salary_by_experience(L.silver(spark, d)), "median_salary")


@query("p12_salary_currency_split", O.raw(
    "SELECT salary_currency, count(*) AS n, round(count(*) / (SELECT count(*) FROM raw_jobs), 6) AS share FROM raw_jobs GROUP BY 1"))
def _(spark, d):
    return rounded(A.salary_currency_split(L.raw(spark, d)), "share")


@query("p13_negotiable_salary_rate", O.silver("SELECT round(avg(CASE WHEN salary_min_usd IS NULL THEN 1.0 ELSE 0 END), 6) AS rate FROM silver"))
def _(spark, d):
    return rounded(A.negotiable_salary_rate(L.silver(spark, d)), "rate")


@query("p14_top_skills", O.chart("SELECT skill, count(*) AS n FROM (SELECT unnest(chart_skills) AS skill FROM chart) GROUP BY 1 ORDER BY n DESC, skill LIMIT 30"))
def _(spark, d):
    return A.top_skills(_postings(spark, d))


@query("p15_skills_by_category", O.chart(f"""
SELECT {SKILL_CAT_SQL} AS category, CAST(sum(n) AS BIGINT) AS n, count(*) AS skills
FROM (SELECT skill, count(*) AS n FROM (SELECT unnest(chart_skills) AS skill FROM chart) GROUP BY 1) GROUP BY 1"""))
def _(spark, d):
    return A.skills_by_category(_postings(spark, d))


@query("p16_skill_cooccurrence_matrix", O.chart("""
WITH e AS (SELECT DISTINCT job_hash, unnest(chart_skills) AS s FROM chart),
t AS (SELECT s FROM (SELECT unnest(chart_skills) AS s FROM chart) GROUP BY 1 ORDER BY count(*) DESC, s LIMIT 20),
k AS (SELECT * FROM e WHERE s IN (SELECT s FROM t)),
c AS (SELECT a.s AS a, b.s AS b, count(*) AS n FROM k a JOIN k b ON a.job_hash = b.job_hash AND a.s <> b.s GROUP BY 1, 2)
SELECT x.s AS skill_a, y.s AS skill_b, coalesce(c.n, 0) AS n FROM t x CROSS JOIN t y LEFT JOIN c ON c.a = x.s AND c.b = y.s"""))
def _(spark, d):
    return A.skill_cooccurrence_matrix(_postings(spark, d))


@query("p17_skills_by_experience_level", O.chart("""
WITH c AS (SELECT experience_level_inferred, skill, count(*) AS n FROM (SELECT experience_level_inferred, unnest(chart_skills) AS skill FROM chart) GROUP BY 1, 2)
SELECT *, CAST(row_number() OVER (PARTITION BY experience_level_inferred ORDER BY n DESC, skill) AS INTEGER) AS rank FROM c QUALIFY rank <= 10"""))
def _(spark, d):
    return A.skills_by_experience_level(_postings(spark, d))


@query("p18_skills_by_role", O.chart("""
SELECT skill, count(*) AS n FROM (SELECT unnest(chart_skills) AS skill FROM chart WHERE job_title = 'Senior Data Analyst') GROUP BY 1"""))
def _(spark, d):
    return A.skills_by_role(_postings(spark, d), "Senior Data Analyst")


@query("p19_trending_skills", O.chart(f"""
WITH e AS (SELECT unnest(chart_skills) AS skill, posted_date_dt AS p FROM chart), t AS (SELECT DATE '{D.AS_OF}' AS z)
SELECT skill, count(*) FILTER (p > z - INTERVAL 3 MONTH) AS recent, count(*) FILTER (p <= z - INTERVAL 3 MONTH) AS prior,
  count(*) FILTER (p > z - INTERVAL 3 MONTH) - count(*) FILTER (p <= z - INTERVAL 3 MONTH) AS change
FROM e, t WHERE p > z - INTERVAL 6 MONTH AND p <= z GROUP BY 1 ORDER BY change DESC, skill LIMIT 20"""))
def _(spark, d):
    return A.trending_skills(_postings(spark, d), D.AS_OF)
