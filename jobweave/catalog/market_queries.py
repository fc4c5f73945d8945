"""Registered queries: projections and filters (E), joins (F), aggregations (G),
ranks (H), sorts (I), set operations (J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobweave import rules
from jobweave import schema as S
from jobweave.catalog import layers as L
from jobweave.catalog import oracle as O
from jobweave.catalog.registry import query
from jobweave.functions import dates, location, roles, skills
from jobweave.operators import charts as CH
from jobweave.operators import counts as K
from jobweave.operators import gold as G
from jobweave.operators import market as M
from jobweave.operators import quantiles as Q
from jobweave.sources import derived as D

r6 = lambda c, name=None: F.round(c, 6).alias(name or c)


def rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


# -- E ---------------------------------------------------------------------------------
@query("e1_role_category", O.raw(f"SELECT ingest_seq, {O.role('job_title')} AS role_category FROM raw_jobs"))
def _(spark, d):
    return L.raw(spark, d).select("ingest_seq", roles.role_category().alias("role_category"))


@query("e2_chart_role", O.raw(
    f"SELECT ingest_seq, {O.role('job_title', rules.CHART_ROLES, rules.CHART_ROLE_OTHER)} AS role_category FROM raw_jobs"))
def _(spark, d):
    return L.raw(spark, d).select("ingest_seq", roles.chart_role().alias("role_category"))


@query("e3_coarse_role", O.raw(
    f"SELECT ingest_seq, {O.role('job_title', rules.COARSE_ROLES, rules.COARSE_ROLE_OTHER)} AS role_category FROM raw_jobs"))
def _(spark, d):
    return L.raw(spark, d).select("ingest_seq", roles.coarse_role().alias("role_category"))


@query("e4_dashboard_skills", O.gold("SELECT job_hash, array_to_string(dash_skills, '|') AS skills FROM gold"))
def _(spark, d):
    return L.gold(spark, d).select("job_hash", F.array_join("dash_skills", "|").alias("skills"))


@query("e5_chart_skills", O.chart("SELECT job_hash, array_to_string(chart_skills, '|') AS skills FROM chart"))
def _(spark, d):
    return L.chart(spark, d).select("job_hash", F.array_join("chart_skills", "|").alias("skills"))


@query("e6_date_and_month", "SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, strftime(ts, '%Y-%m') AS month FROM events")
def _(spark, d):
    return L.table(spark, d, "events").select("event_id", F.to_date("ts").cast("string").alias("day"),
                                              dates.month_key("ts").alias("month"))


@query("e7_city", O.gold("SELECT job_hash, city FROM gold"))
def _(spark, d):
    return L.gold(spark, d).select("job_hash", "city")


SPEC = G.FilterSpec(cities=["Hanoi", "Ho Chi Minh City", "Da Nang"], roles=["Data Analyst", "Data Engineer", "AI/ML Engineer"],
                    levels=["fresher", "junior", "mid", "senior"], remote=False, salary_range=(500, 3000))


@query("e8_apply_filters", O.gold("""
SELECT job_hash, city, role_category, salary_midpoint_usd FROM gold
WHERE city IN ('Hanoi', 'Ho Chi Minh City', 'Da Nang') AND role_category IN ('Data Analyst', 'Data Engineer', 'AI/ML Engineer')
  AND experience_level_inferred IN ('fresher', 'junior', 'mid', 'senior') AND NOT is_remote
  AND (salary_midpoint_usd IS NULL OR salary_midpoint_usd BETWEEN 500 AND 3000)"""))
def _(spark, d):
    return G.apply_filters(L.gold(spark, d), SPEC).select("job_hash", "city", "role_category", "salary_midpoint_usd")


@query("e9_equality_filters", O.gold("""
SELECT job_hash, job_title FROM gold WHERE city = 'Hanoi' AND role_category = 'Data Engineer'
  AND source_website = 'topcv' AND experience_level_inferred = 'fresher'"""))
def _(spark, d):
    spec = G.FilterSpec(cities=["Hanoi"], roles=["Data Engineer"], sources=["topcv"], levels=["fresher"])
    return G.apply_filters(L.gold(spark, d), spec).select("job_hash", "job_title")


@query("e10_salary_subset", O.gold("SELECT job_hash, salary_midpoint_usd FROM gold_sal"))
def _(spark, d):
    return L.gold_salary(spark, d).select("job_hash", "salary_midpoint_usd")


@query("e11_trimmed_salary_subset", O.chart("SELECT job_hash, salary_midpoint_usd FROM chart_sal"))
def _(spark, d):
    return L.chart_salary(spark, d).select("job_hash", "salary_midpoint_usd")


@query("e12_filter_options", O.gold(f"""
SELECT 'city' AS option, city AS value, 0 AS ord FROM (SELECT city, count(*) AS n FROM gold GROUP BY city ORDER BY n DESC, city LIMIT 20)
UNION ALL SELECT DISTINCT 'role', role_category, 0 FROM gold
UNION ALL SELECT DISTINCT 'level', experience_level_inferred, list_position({O.sql_list(rules.LEVEL_ORDER)}, experience_level_inferred) FROM gold
UNION ALL SELECT DISTINCT 'source', source_website, 0 FROM gold
UNION ALL SELECT 'salary_cap', CAST(CAST(floor(quantile_cont(salary_midpoint_usd, 0.99)) AS INTEGER) AS VARCHAR), 0 FROM gold"""))
def _(spark, d):
    return G.filter_options(L.gold(spark, d))


@query("e13_dated_subset", O.gold("SELECT job_hash, month FROM gold WHERE month IS NOT NULL"))
def _(spark, d):
    return L.gold(spark, d).where("month IS NOT NULL").select("job_hash", "month")


@query("e14_posting_text", O.gold(
    "SELECT job_hash, regexp_replace(job_title || chr(10) || skills_str || chr(10) || job_description, '^\\s+|\\s+$', '', 'g') AS jd FROM gold"))
def _(spark, d):
    return L.gold(spark, d).select("job_hash", G.posting_text().alias("jd"))


@query("e15_display_label", O.gold("SELECT job_hash, job_title || ' · ' || company_name || ' · ' || city AS label FROM gold"))
def _(spark, d):
    return L.gold(spark, d).select("job_hash", G.display_label().alias("label"))


@query("e16_level_number", O.chart(f"""
SELECT job_hash, CAST(list_position({O.sql_list(rules.LEVEL_ORDER)}, experience_level_inferred) - 1 AS INTEGER) AS level_num,
  CAST(is_remote AS INTEGER) AS remote_num FROM chart"""))
def _(spark, d):
    return L.chart(spark, d).select("job_hash", roles.level_number().alias("level_num"),
                                    F.col("is_remote").cast("int").alias("remote_num"))


@query("e17_skill_family", O.chart(
    "SELECT skill, CASE " + " ".join(f"WHEN lower(skill) IN {O.in_list(w)} THEN {O.q(n)}" for n, w in rules.SKILL_FAMILIES.items())
    + " ELSE 'Other' END AS family, count(*) AS n FROM (SELECT unnest(chart_skills) AS skill FROM chart) GROUP BY 1, 2"))
def _(spark, d):
    per = M.skill_counts(L.chart(spark, d), "chart_skills")
    return per.select("skill", skills.skill_family("skill").alias("family"), "n")


@query("e18_salary_bands", O.chart("""
WITH s AS (SELECT role_category, median(salary_midpoint_usd) AS med FROM chart_sal GROUP BY 1),
m AS (SELECT median(salary_midpoint_usd) AS mm FROM chart_sal)
SELECT role_category, round(med, 6) AS med, CASE WHEN med >= 1000 THEN 'high' WHEN med >= 700 THEN 'mid' ELSE 'low' END AS band,
  CASE WHEN med > mm * 1.3 THEN 'premium' WHEN med > mm THEN 'above' ELSE 'at_or_below' END AS against_market FROM s, m"""))
def _(spark, d):
    paid = L.chart_salary(spark, d)
    market = Q.overall_one(paid, M.SALARY)
    per = Q.exact_quantiles(paid, ["role_category"], M.SALARY, [0.5]).withColumnRenamed("q50", "med")
    return per.select("role_category", r6("med"), G.salary_band("med").alias("band"),
                      CH.market_band("med", market).alias("against_market"))


# -- F ---------------------------------------------------------------------------------
@query("f1_left_join_city_salary", """
SELECT n_name, count(*) AS customers, round(max(s.total), 4) AS supplier_balance
FROM nation JOIN customer ON c_nationkey = n_nationkey
LEFT JOIN (SELECT s_nationkey, sum(s_acctbal) AS total FROM supplier GROUP BY 1) s ON s_nationkey = n_nationkey GROUP BY n_name""")
def _(spark, d):
    cust = L.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    sup = L.table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.sum("s_acctbal").alias("b"))
    nation = L.table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    return nation.join(cust, "k").join(sup, "k", "left").select(
        "n_name", "customers", F.round("b", 4).alias("supplier_balance"))


@query("f2_semi_join_top", """
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN
  (SELECT o_custkey FROM orders GROUP BY 1 ORDER BY count(*) DESC, o_custkey LIMIT 8)""")
def _(spark, d):
    return K.semi_top(L.table(spark, d, "orders"), "o_custkey", 8).select("o_orderkey", "o_custkey")


@query("f3_reindex_levels", O.gold(f"""
SELECT CAST(i - 1 AS INTEGER) AS ord, ({O.sql_list(rules.LEVEL_ORDER)})[i] AS experience_level_inferred, coalesce(n, 0) AS n
FROM range(1, 7) t(i) LEFT JOIN (SELECT experience_level_inferred AS l, count(*) AS n FROM gold GROUP BY 1)
  ON l = ({O.sql_list(rules.LEVEL_ORDER)})[i]"""))
def _(spark, d):
    per = K.value_counts(L.gold(spark, d), "experience_level_inferred")
    return K.reindex(per, "experience_level_inferred", rules.LEVEL_ORDER, {"n": 0})


_CAT = {k: v for k, v in skills.category_table().items()}
_SKILL_CAT = {k: _CAT.get(skills.skill_key(c), "other") for k, c in skills.text_alias_table().items()}
SKILL_CAT_SQL = (f"coalesce({O.sql_map({**_CAT, **_SKILL_CAT})}[trim(regexp_replace(regexp_replace("
                 "lower(trim(skill)), '[^a-z0-9+#/ ]+', ' ', 'g'), '\\s+', ' ', 'g'))], 'other')")


@query("f4_skill_category_lookup", O.chart(
    f"SELECT skill, {SKILL_CAT_SQL} AS category, count(*) AS n FROM (SELECT unnest(chart_skills) AS skill FROM chart) GROUP BY 1, 2"))
def _(spark, d):
    per = M.skill_counts(L.chart(spark, d), "chart_skills")
    return per.select("skill", skills.skill_category("skill").alias("category"), "n")


@query("f6_anti_join_new_ids", """
SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def _(spark, d):
    seen = L.table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return L.table(spark, d, "customer").join(seen, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("f7_within_row_pairs", O.gold("""
SELECT job_hash, a || '+' || b AS pair FROM (SELECT job_hash, unnest(list_distinct(dash_skills)) AS a, list_distinct(dash_skills) AS s FROM gold),
  unnest(s) t(b) WHERE a < b"""))
def _(spark, d):
    each = L.gold(spark, d).select("job_hash", F.explode(skills.skill_pairs("dash_skills")).alias("p"))
    return each.select("job_hash", F.concat_ws("+", "p.a", "p.b").alias("pair"))


@query("f9_role_in_subset", O.chart("SELECT job_hash, role_category, salary_midpoint_usd FROM chart_sal"))
def _(spark, d):
    return L.chart_salary(spark, d).select("job_hash", "role_category", "salary_midpoint_usd")


# -- G ---------------------------------------------------------------------------------
_TOP = lambda key, src="gold": f"(SELECT {key} FROM {src} GROUP BY 1 ORDER BY count(*) DESC, {key} LIMIT 1)"


@query("g1_overview_kpis", O.gold(f"""
SELECT count(*) AS jobs, count(DISTINCT company_name) AS companies, count(DISTINCT city) AS cities,
  count(DISTINCT source_website) AS sources, round((SELECT count(*) FROM gold_sal) * 100.0 / count(*), 6) AS salary_coverage,
  round((SELECT median(salary_midpoint_usd) FROM gold_sal), 6) AS median_salary,
  (SELECT s FROM (SELECT unnest(dash_skills) AS s FROM gold) GROUP BY 1 ORDER BY count(*) DESC, s LIMIT 1) AS top_skill,
  {_TOP('company_name')} AS top_company, {_TOP('role_category')} AS top_role, {_TOP('city')} AS top_city FROM gold"""))
def _(spark, d):
    return rounded(M.overview_kpis(L.gold(spark, d)), "salary_coverage", "median_salary")


@query("g2_dataset_summary", O.gold("""
SELECT count(*) AS jobs, count(DISTINCT company_name) AS companies, count(DISTINCT city) AS cities,
  count(DISTINCT source_website) AS sources, round((SELECT count(*) FROM gold_sal) * 100.0 / count(*), 6) AS salary_coverage FROM gold"""))
def _(spark, d):
    return rounded(M.dataset_summary(L.gold(spark, d)), "salary_coverage")


def _value_counts(key, n=None):
    limit = f" ORDER BY n DESC, {key} LIMIT {n}" if n else ""

    @query(f"g3_value_counts_{key}", O.gold(f"SELECT {key}, count(*) AS n FROM gold GROUP BY 1{limit}"))
    def _(spark, d):
        return K.value_counts(L.gold(spark, d), key, n)


for _key, _n in (("role_category", 10), ("source_website", None), ("city", 10), ("company_name", 15),
                 ("experience_level_inferred", None), ("is_remote", None)):
    _value_counts(_key, _n)


@query("g3_value_counts_event_type", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(spark, d):
    return K.value_counts(L.table(spark, d, "events"), "event_type")


@query("g4_top_n_other", O.gold("""
WITH c AS (SELECT city, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, city) AS rn FROM gold GROUP BY 1)
SELECT CASE WHEN rn <= 5 THEN city ELSE 'Other' END AS city, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1"""))
def _(spark, d):
    return K.top_n_other(L.gold(spark, d), "city", 5)


@query("g5_salary_kpis", O.gold("""
SELECT round(median(salary_midpoint_usd), 6) AS median, round(avg(salary_midpoint_usd), 6) AS mean,
  round(quantile_cont(salary_midpoint_usd, 0.95), 6) AS p95, round(count(*) * 100.0 / (SELECT count(*) FROM gold), 6) AS disclosed_pct
FROM gold_sal"""))
def _(spark, d):
    return rounded(M.salary_kpis(L.gold(spark, d)), "median", "mean", "p95", "disclosed_pct")


@query("g6_quartiles", O.chart("""
SELECT round(quantile_cont(salary_midpoint_usd, 0.25), 6) AS p25, round(median(salary_midpoint_usd), 6) AS median,
  round(quantile_cont(salary_midpoint_usd, 0.75), 6) AS p75, round(avg(salary_midpoint_usd), 6) AS mean FROM chart_sal"""))
def _(spark, d):
    return rounded(M.salary_quartiles(L.chart_salary(spark, d)), "p25", "median", "p75", "mean")


@query("g7_median_salary_by_role", O.gold("""
SELECT role_category, round_even(median(salary_midpoint_usd), 0) AS median_salary FROM gold_sal GROUP BY 1
ORDER BY median_salary DESC, role_category LIMIT 10"""))
def _(spark, d):
    return M.median_by_role(L.gold_salary(spark, d))


@query("g8_median_by_top_city", O.gold("""
SELECT city, round(median(salary_midpoint_usd), 6) AS median_salary, count(*) AS n FROM gold_sal WHERE city IN
  (SELECT city FROM gold_sal GROUP BY 1 ORDER BY count(*) DESC, city LIMIT 8) GROUP BY 1"""))
def _(spark, d):
    return rounded(M.median_by_top_city(L.gold_salary(spark, d)), "median_salary")


@query("g9_role_salary_stats", O.chart("""
SELECT role_category, round(median(salary_midpoint_usd), 6) AS median, round(avg(salary_midpoint_usd), 6) AS mean, count(*) AS n
FROM chart_sal GROUP BY 1 HAVING count(*) >= 10"""))
def _(spark, d):
    return rounded(M.role_salary_stats(L.chart_salary(spark, d)), "median", "mean")


_PAYING = """SELECT skill, round(median(s), 6) AS median_salary, count(*) AS n
FROM (SELECT unnest({skills}) AS skill, salary_midpoint_usd AS s FROM {src}) {where} GROUP BY 1 HAVING count(*) >= {m}
ORDER BY median_salary DESC, skill LIMIT {n}"""


@query("g10_high_paying_skills", O.gold(_PAYING.format(skills="dash_skills", src="gold_sal", where="", m=15, n=15)))
def _(spark, d):
    return rounded(M.high_paying_skills(L.gold_salary(spark, d)), "median_salary")


@query("g10_high_paying_skills_chart", O.chart(_PAYING.format(
    skills="chart_skills", src="chart_sal", where=f"WHERE skill NOT IN {O.in_list(rules.CHART_EXCLUDED_SKILLS)}", m=30, n=20)))
def _(spark, d):
    return rounded(M.high_paying_skills(L.chart_salary(spark, d), "chart_skills", 30, 20,
                                        rules.CHART_EXCLUDED_SKILLS), "median_salary")


@query("g10_median_price_by_brand", """
SELECT p_brand, count(*) AS n, round(quantile_cont(l_extendedprice, 0.5), 4) AS q50, round(quantile_cont(l_extendedprice, 0.95), 4) AS q95
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def _(spark, d):
    li = L.table(spark, d, "lineitem").select("l_partkey", "l_extendedprice")
    part = L.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    out = Q.exact_quantiles(li.join(part, "l_partkey"), ["p_brand"], "l_extendedprice", [0.5, 0.95])
    return out.withColumns({c: F.round(c, 4) for c in ("q50", "q95")})


@query("g11_skill_frequency", O.gold("SELECT skill, count(*) AS n FROM (SELECT unnest(dash_skills) AS skill FROM gold) GROUP BY 1"))
def _(spark, d):
    return M.skill_counts(L.gold(spark, d))


@query("g11_skill_frequency_chart", O.chart(f"""
SELECT skill, count(*) AS n FROM (SELECT unnest(chart_skills) AS skill FROM chart)
WHERE skill NOT IN {O.in_list(rules.CHART_EXCLUDED_SKILLS)} AND length(skill) > 1 GROUP BY 1 ORDER BY n DESC, skill LIMIT 30"""))
def _(spark, d):
    return M.skill_counts(L.chart(spark, d), "chart_skills", 30, rules.CHART_EXCLUDED_SKILLS, 2)


@query("g12_skill_kpis", O.gold("""
WITH c AS (SELECT s, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, s) AS rn FROM (SELECT unnest(dash_skills) AS s FROM gold) GROUP BY 1)
SELECT round((SELECT avg(skill_count) FROM gold), 6) AS avg_skills, (SELECT count(*) FROM c) AS distinct_skills,
  (SELECT s FROM c WHERE rn = 1) AS first_skill, (SELECT s FROM c WHERE rn = 2) AS second_skill"""))
def _(spark, d):
    return rounded(M.skill_kpis(L.gold(spark, d)), "avg_skills")


@query("g13_skill_by_role", O.gold("""
WITH e AS (SELECT unnest(dash_skills) AS skill, role_category FROM gold),
s AS (SELECT skill FROM e GROUP BY 1 ORDER BY count(*) DESC, skill LIMIT 12),
r AS (SELECT role_category FROM gold GROUP BY 1 ORDER BY count(*) DESC, role_category LIMIT 6)
SELECT s.skill, r.role_category, count(e.skill) AS n FROM s CROSS JOIN r
LEFT JOIN e ON e.skill = s.skill AND e.role_category = r.role_category GROUP BY 1, 2"""))
def _(spark, d):
    return M.skill_by_role(L.gold(spark, d))


@query("g14_skill_role_percent", O.chart(f"""
WITH t AS (SELECT role_category, count(*) AS jobs FROM chart GROUP BY 1),
e AS (SELECT role_category, unnest(chart_skills) AS skill FROM chart),
c AS (SELECT role_category, skill, count(*) AS n FROM e GROUP BY 1, 2),
g AS (SELECT r AS role_category, s AS skill FROM unnest({O.sql_list(rules.HEATMAP_ROLES)}) a(r) CROSS JOIN unnest({O.sql_list(rules.FOCUS_SKILLS)}) b(s)),
p AS (SELECT g.role_category, g.skill, CASE WHEN t.jobs > 0 THEN {O.half_even('coalesce(c.n, 0) * 100.0 / t.jobs', 1)} END AS pct
  FROM g LEFT JOIN t USING (role_category) LEFT JOIN c ON c.role_category = g.role_category AND c.skill = g.skill)
SELECT role_category, skill, CAST(pct AS DOUBLE) AS pct FROM p"""))
def _(spark, d):
    return M.skill_role_percent(L.chart(spark, d))


@query("g15_company_by_role", O.gold("""
WITH s AS (SELECT company_name FROM gold GROUP BY 1 ORDER BY count(*) DESC, company_name LIMIT 8),
r AS (SELECT role_category FROM gold GROUP BY 1 ORDER BY count(*) DESC, role_category LIMIT 6)
SELECT s.company_name, r.role_category, count(e.job_hash) AS n FROM s CROSS JOIN r
LEFT JOIN gold e ON e.company_name = s.company_name AND e.role_category = r.role_category GROUP BY 1, 2"""))
def _(spark, d):
    return M.company_by_role(L.gold(spark, d))


_ROLE_SUM = "count(*) FILTER (role_category IN " + O.in_list(rules.COMPANY_FOCUS_ROLES) + ")"


@query("g16_company_role_percent", O.chart(
    "SELECT company_name_normalized, " + ", ".join(
        f"round(count(*) FILTER (role_category = {O.q(r)}) * 100.0 / nullif({_ROLE_SUM}, 0), 4) AS \"{r}\"" for r in rules.COMPANY_FOCUS_ROLES)
    + """ FROM chart WHERE company_name_normalized IN (SELECT company_name_normalized FROM chart GROUP BY 1
    ORDER BY count(*) DESC, company_name_normalized LIMIT 12) GROUP BY 1"""))
def _(spark, d):
    return M.company_role_percent(L.chart(spark, d))


_MODE = """(SELECT {g}, {v} AS {name} FROM gold GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY {g} ORDER BY count(*) DESC, {v}) = 1)"""


@query("g17_company_profile", O.gold(f"""
SELECT a.company_name, a.jobs, r.main_role, c.main_city FROM (SELECT company_name, count(job_title) AS jobs FROM gold GROUP BY 1) a
JOIN {_MODE.format(g='company_name', v='role_category', name='main_role')} r USING (company_name)
JOIN {_MODE.format(g='company_name', v='city', name='main_city')} c USING (company_name)"""))
def _(spark, d):
    return M.company_profile(L.gold(spark, d))


@query("g18_city_profile", O.gold(f"""
SELECT a.city, a.jobs, a.companies, r.main_role, s.median_salary
FROM (SELECT city, count(job_title) AS jobs, count(DISTINCT company_name) AS companies FROM gold GROUP BY 1) a
JOIN {_MODE.format(g='city', v='role_category', name='main_role')} r USING (city)
LEFT JOIN (SELECT city, round_even(median(salary_midpoint_usd), 0) AS median_salary FROM gold_sal GROUP BY 1) s USING (city)"""))
def _(spark, d):
    return M.city_profile(L.gold(spark, d))


@query("g19_city_stats", O.chart("""
SELECT a.city, a.jobs, a.avg_skills, round(s.m, 6) AS median_salary
FROM (SELECT city, count(job_title) AS jobs, round(avg(skill_count), 6) AS avg_skills FROM chart GROUP BY 1 ORDER BY jobs DESC, city LIMIT 10) a
LEFT JOIN (SELECT city, median(salary_midpoint_usd) AS m FROM chart_sal GROUP BY 1) s USING (city)"""))
def _(spark, d):
    return rounded(M.city_stats(L.chart(spark, d), L.chart_salary(spark, d)), "avg_skills", "median_salary")


@query("g20_company_kpis", O.gold(f"""
SELECT count(DISTINCT company_name) AS companies, round(count(*) / count(DISTINCT company_name), 6) AS jobs_per_company,
  round(count(*) FILTER (is_remote) * 100.0 / count(*), 6) AS remote_pct, {_TOP('company_name')} AS top_company FROM gold"""))
def _(spark, d):
    return rounded(M.company_kpis(L.gold(spark, d)), "jobs_per_company", "remote_pct")


@query("g21_city_kpis", O.gold(f"""
SELECT count(DISTINCT city) AS cities, count(*) FILTER (city = 'Hanoi') AS hanoi,
  count(*) FILTER (city IN ('Ho Chi Minh City', 'Ho Chi Minh')) AS hcm, {_TOP('city')} AS top_city,
  round((SELECT count(*) FROM gold WHERE city = {_TOP('city')}) * 100.0 / count(*), 6) AS top_city_pct FROM gold"""))
def _(spark, d):
    return rounded(M.city_kpis(L.gold(spark, d)), "top_city_pct")


@query("g22_two_city_roles", O.gold(f"""
WITH t AS (SELECT role_category FROM gold GROUP BY 1 ORDER BY count(*) DESC, role_category LIMIT 7)
SELECT role_category, count(*) FILTER (city IN {O.in_list(rules.HCM_KEYS)}) AS left_jobs,
  count(*) FILTER (city IN {O.in_list(rules.HANOI_KEYS)}) AS right_jobs,
  round(median(salary_midpoint_usd) FILTER (city IN {O.in_list(rules.HCM_KEYS)} AND salary_midpoint_usd > 0 AND salary_midpoint_usd < 10000), 6) AS left_median,
  round(median(salary_midpoint_usd) FILTER (city IN {O.in_list(rules.HANOI_KEYS)} AND salary_midpoint_usd > 0 AND salary_midpoint_usd < 10000), 6) AS right_median
FROM gold WHERE role_category IN (SELECT role_category FROM t) GROUP BY 1"""))
def _(spark, d):
    return rounded(M.two_city_roles(L.gold(spark, d)), "left_median", "right_median")


_TC = "'Ho Chi Minh City', 'Hanoi'"


@query("g23_two_city_metrics", O.chart(f"""
SELECT city, 'job_count' AS metric, CAST(count(*) AS DOUBLE) AS value FROM chart WHERE city IN ({_TC}) GROUP BY 1
UNION ALL SELECT city, 'avg_skills', round(avg(skill_count), 6) FROM chart WHERE city IN ({_TC}) GROUP BY 1
UNION ALL SELECT city, 'senior_lead_pct', round(avg(CASE WHEN experience_level_inferred IN ('senior', 'lead') THEN 1.0 ELSE 0 END) * 100, 6) FROM chart WHERE city IN ({_TC}) GROUP BY 1
UNION ALL SELECT city, 'median_salary', round(median(salary_midpoint_usd), 6) FROM chart_sal WHERE city IN ({_TC}) GROUP BY 1"""))
def _(spark, d):
    return rounded(M.two_city_metrics(L.chart(spark, d), L.chart_salary(spark, d)), "value")


def _pct_sql(checks):
    return ", ".join(f"round(avg(CASE WHEN {c} THEN 1.0 ELSE 0 END) * 100, 1) AS {n}" for n, c in checks.items())


@query("g24_completeness_by_source", O.silver("SELECT source_website, " + _pct_sql({
    "salary": "has_salary", "description": "length(job_description) > 50", "skills": "skill_count > 0",
    "benefits": "length(benefits) > 10", "experience": "experience_years_parsed IS NOT NULL",
    "posted": "posted_date_dt IS NOT NULL", "expiry": "expiry_date_dt IS NOT NULL",
    "location": "location_normalized IS NOT NULL"}) + " FROM silver GROUP BY 1"))
def _(spark, d):
    return K.completeness(L.silver(spark, d), "source_website", M.silver_checks())


@query("g24_completeness_raw", O.raw("SELECT source_website, " + _pct_sql({
    "salary": "salary_min > 0", "description": "length(job_description) > 50", "skills": "trim(skills_required) NOT IN ('', '[]')",
    "benefits": "length(benefits) > 10", "experience": "experience_years IS NOT NULL",
    "posted": "posted_date IS NOT NULL", "expiry": "expiry_date IS NOT NULL"}) + " FROM raw_jobs GROUP BY 1"))
def _(spark, d):
    return K.completeness(L.raw(spark, d), "source_website", M.raw_checks())


_PROFILE = ["ingest_seq", "o_custkey", "job_title", "company_name", "salary", "salary_min", "salary_max", "salary_currency", "location",
            "employment_type", "job_level", "skills_required", "experience_years", "job_description", "benefits", "requirements", "posted_date",
            "expiry_date", "url", "source_website", "industry", "job_type", "crawled_at", "job_id"]


@query("g25_non_null_profile", O.raw(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS non_null, round(count({c}) * 100.0 / count(*), 4) AS pct FROM raw_jobs" for c in _PROFILE)))
def _(spark, d):
    return K.non_null_profile(L.raw(spark, d), _PROFILE)


def _quality_sql():
    nulls = [f"SELECT 'null_pct' AS section, '{c}' AS key, round(avg(CASE WHEN trim(coalesce(CAST({c} AS VARCHAR), '')) IN ('', '[]', 'nan') "
             f"THEN 1.0 ELSE 0 END) * 100, 1) AS value FROM silver" for c in S.QUALITY_FIELDS]
    return " UNION ALL ".join(nulls + [
        "SELECT 'total_records', '', CAST(count(*) AS DOUBLE) FROM silver",
        "SELECT 'salary_coverage_pct', '', round(avg(CASE WHEN has_salary THEN 1.0 ELSE 0 END) * 100, 1) FROM silver",
        "SELECT 'skill_coverage_pct', '', round(avg(CASE WHEN skill_count > 0 THEN 1.0 ELSE 0 END) * 100, 1) FROM silver",
        "SELECT 'remote_count', '', CAST(count(*) FILTER (is_remote) AS DOUBLE) FROM silver",
        "SELECT 'by_source', source_website, CAST(count(*) AS DOUBLE) FROM silver GROUP BY 2",
        "SELECT * FROM (SELECT 'top_locations', location_normalized, CAST(count(*) AS DOUBLE) AS n FROM silver GROUP BY 2 ORDER BY n DESC, 2 LIMIT 10)",
        "SELECT 'levels', experience_level_inferred, CAST(count(*) AS DOUBLE) FROM silver GROUP BY 2"])


@query("g26_validate_dataset", O.silver(_quality_sql()))
def _(spark, d):
    return M.validate_dataset(L.silver(spark, d))


@query("g27_dataset_overview", O.chart("""
SELECT count(*) AS jobs, count(DISTINCT company_name_normalized) AS companies, count(DISTINCT job_title) AS titles,
  count(DISTINCT city) AS cities, count(*) FILTER (has_salary) AS with_salary, count(*) FILTER (skill_count > 0) AS with_skills,
  count(DISTINCT source_website) AS sources, CAST(min(posted_date_dt) AS VARCHAR) AS first_date, CAST(max(posted_date_dt) AS VARCHAR) AS last_date,
  round(count(*) FILTER (has_salary) * 100.0 / count(*), 6) AS with_salary_pct,
  round((SELECT median(salary_midpoint_usd) FROM chart_sal), 6) AS median_salary FROM chart"""))
def _(spark, d):
    return rounded(M.chart_overview(L.chart(spark, d), L.chart_salary(spark, d)), "with_salary_pct", "median_salary")


@query("g28_collection_funnel", O.over(f"{O.RAW}, {O.VALID}, {O.CLEANED}, {O.DEDUP}", """
SELECT 0 AS ord, 'raw' AS stage, CAST(count(*) AS DOUBLE) AS n FROM raw_jobs
UNION ALL SELECT 1, 'merged', count(*) FROM valid UNION ALL SELECT 2, 'processed', count(*) FROM deduped
UNION ALL SELECT 3, 'mean per source', round(count(*) / count(DISTINCT source_website), 6) FROM raw_jobs"""))
def _(spark, d):
    return rounded(M.collection_funnel(L.raw(spark, d), L.stage(spark, d, "valid"), L.stage(spark, d, "dedup")), "n")


@query("g29_export_kpis", O.gold("""
SELECT 'Total Jobs' AS metric, CAST(count(*) AS DOUBLE) AS value FROM gold
UNION ALL SELECT 'Companies', count(DISTINCT company_name) FROM gold UNION ALL SELECT 'Cities', count(DISTINCT city) FROM gold
UNION ALL SELECT 'Sources', count(DISTINCT source_website) FROM gold UNION ALL SELECT 'Avg Salary (USD)', round(avg(salary_midpoint_usd), 4) FROM gold"""))
def _(spark, d):
    return M.export_kpis(L.gold(spark, d))


@query("g30_about_totals", O.gold("""
SELECT count(*) AS jobs, count(DISTINCT company_name) AS companies, count(DISTINCT city) AS cities, count(DISTINCT source_website) AS sources,
  round((SELECT count(*) FROM gold_sal) * 100.0 / count(*), 6) AS salary_coverage, 40 AS columns,
  (SELECT count(DISTINCT s) FROM (SELECT unnest(dash_skills) AS s FROM gold)) AS distinct_skills FROM gold"""))
def _(spark, d):
    return rounded(M.about_totals(L.gold(spark, d)), "salary_coverage")


# -- H ---------------------------------------------------------------------------------
@query("h2_cumulative_share", O.chart("""
WITH c AS (SELECT company_name_normalized, count(*) AS n FROM chart GROUP BY 1 ORDER BY n DESC, company_name_normalized LIMIT 20)
SELECT row_number() OVER w AS rank, company_name_normalized, n, round(n * 100.0 / (SELECT count(*) FROM chart), 6) AS share_pct,
  round(sum(n) OVER (w ROWS UNBOUNDED PRECEDING) * 100.0 / (SELECT count(*) FROM chart), 6) AS cumulative_pct
FROM c WINDOW w AS (ORDER BY n DESC, company_name_normalized)"""))
def _(spark, d):
    return rounded(CH.cumulative_share(L.chart(spark, d), "company_name_normalized"), "share_pct", "cumulative_pct")


@query("h3_concentration", O.chart("""
WITH c AS (SELECT count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, company_name_normalized) AS rn FROM chart GROUP BY company_name_normalized)
SELECT round(sum(n) FILTER (rn <= 5) * 100.0 / sum(n), 6) AS top5_pct, round(sum(n) FILTER (rn <= 20) * 100.0 / sum(n), 6) AS top20_pct FROM c"""))
def _(spark, d):
    return rounded(CH.concentration(L.chart(spark, d), "company_name_normalized"), "top5_pct", "top20_pct")


@query("h3b_skill_concentration", O.gold("""
WITH c AS (SELECT count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, s) AS rn FROM (SELECT unnest(dash_skills) AS s FROM gold) GROUP BY s)
SELECT round(sum(n) FILTER (rn <= 10) * 100.0 / sum(n), 6) AS top10_pct FROM c"""))
def _(spark, d):
    each = M.explode_skills(L.gold(spark, d), "dash_skills")
    return rounded(CH.concentration(each, "skill", [10]), "top10_pct")


@query("h5_mode_per_group", """
SELECT o_custkey, o_orderpriority AS main_priority FROM orders GROUP BY 1, 2
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderpriority) = 1""")
def _(spark, d):
    return K.mode_by(L.table(spark, d, "orders"), "o_custkey", "o_orderpriority", "main_priority")


@query("h6_highlight_top", O.chart("""
WITH c AS (SELECT company_name_normalized, count(*) AS n FROM chart GROUP BY 1 ORDER BY n DESC, company_name_normalized LIMIT 20)
SELECT company_name_normalized, n, n >= (SELECT quantile_cont(n, 0.75) FROM c) AS highlight FROM c"""))
def _(spark, d):
    return CH.highlight_top(L.chart(spark, d), "company_name_normalized")


# -- I ---------------------------------------------------------------------------------
@query("i1_top_k", "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 25")
def _(spark, d):
    return K.value_counts(L.table(spark, d, "lineitem"), "l_partkey", 25)


@query("i2_top_1", "SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 1")
def _(spark, d):
    return K.value_counts(L.table(spark, d, "events"), "user_id", 1)


@query("i3_canonical_order", O.gold(f"""
SELECT experience_level_inferred, count(*) AS n, CAST(coalesce(nullif(list_position({O.sql_list(rules.LEVEL_ORDER)}, experience_level_inferred), 0), 7) AS INTEGER) AS ord
FROM gold GROUP BY 1"""))
def _(spark, d):
    per = K.value_counts(L.gold(spark, d), "experience_level_inferred")
    return per.withColumn("ord", roles.level_rank().cast("int")).orderBy("ord", "experience_level_inferred")


@query("i4_ordered_row_cap", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 120")
def _(spark, d):
    docs = L.table(spark, d, "documents").select("doc_id", "n_chars")
    return K.top_by(docs, "n_chars", "doc_id", 120)


@query("i5_case_insensitive_sort", O.chart(
    "SELECT job_hash, array_to_string(list_transform(list_sort(list_transform(list_distinct(chart_skills), "
    "lambda s: lower(s) || chr(1) || s)), lambda s: string_split(s, chr(1))[2]), '|') AS skills FROM chart"))
def _(spark, d):
    return L.chart(spark, d).select("job_hash", F.array_join(skills.normalize_items("chart_skills"), "|").alias("skills"))


@query("i6_time_axis", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events GROUP BY 1")
def _(spark, d):
    per = L.table(spark, d, "events").groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("n"))
    return per.orderBy("day")


# -- J ---------------------------------------------------------------------------------
@query("j1_labelled_union", O.gold("""
SELECT * FROM (SELECT 'role' AS grp, role_category AS label, count(*) AS value FROM gold GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'city', city, count(*) AS n FROM gold GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'skill', s, count(*) AS n FROM (SELECT unnest(dash_skills) AS s FROM gold) GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10)"""))
def _(spark, d):
    return M.labelled_summary(L.gold(spark, d))


@query("j2_union_differing_columns", """
SELECT 'customer' AS section, c_custkey AS id, c_name AS name, c_mktsegment AS segment, NULL AS size FROM customer
UNION ALL SELECT 'part', p_partkey, p_name, NULL, p_size FROM part""")
def _(spark, d):
    c = L.table(spark, d, "customer").select(F.lit("customer").alias("section"), F.col("c_custkey").alias("id"),
                                             F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    p = L.table(spark, d, "part").select(F.lit("part").alias("section"), F.col("p_partkey").alias("id"),
                                         F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    return c.unionByName(p, allowMissingColumns=True)


_ASK = ["Python", "SQL", "Docker", "Excel"]
_SQL_ASK = O.sql_list(_ASK)
_JOIN = lambda x: f"array_to_string(list_sort({x}), '|')"


@query("j3_array_intersect_except", O.chart(f"""
SELECT job_hash, {_JOIN(f'list_filter(list_distinct(chart_skills), lambda s: list_contains({_SQL_ASK}, s))')} AS both_sides,
  {_JOIN(f'list_filter(list_distinct(chart_skills), lambda s: NOT list_contains({_SQL_ASK}, s))')} AS posting_only,
  {_JOIN(f'list_filter({_SQL_ASK}, lambda s: NOT list_contains(chart_skills, s))')} AS asked_only FROM chart"""))
def _(spark, d):
    ask = F.array(*[F.lit(s) for s in _ASK])
    j = lambda c, n: F.array_join(F.array_sort(c), "|").alias(n)
    return L.chart(spark, d).select("job_hash", j(F.array_intersect("chart_skills", ask), "both_sides"),
                                    j(F.array_except("chart_skills", ask), "posting_only"),
                                    j(F.array_except(ask, F.col("chart_skills")), "asked_only"))


@query("j4_distinct_values", "SELECT DISTINCT source FROM documents WHERE source IS NOT NULL")
def _(spark, d):
    return L.table(spark, d, "documents").select("source").where("source IS NOT NULL").distinct()


@query("j5_jaccard", O.chart(f"""
SELECT job_hash, round(CASE WHEN len(list_distinct(list_concat(chart_skills, {_SQL_ASK}))) = 0 THEN 0.0 ELSE
  len(list_filter(list_distinct(chart_skills), lambda s: list_contains({_SQL_ASK}, s))) / len(list_distinct(list_concat(chart_skills, {_SQL_ASK}))) END, 6) AS jaccard FROM chart"""))
def _(spark, d):
    ask = F.array(*[F.lit(s) for s in _ASK])
    return L.chart(spark, d).select("job_hash", F.round(skills.jaccard("chart_skills", ask), 6).alias("jaccard"))
