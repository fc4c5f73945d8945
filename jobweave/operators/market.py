"""Market reports: KPI blocks, salary, skill, company and city aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave import rules
from jobweave import schema as S
from jobweave.functions.common import explode_each, text
from jobweave.operators import counts as K
from jobweave.operators.gold import salary_subset
from jobweave.operators.quantiles import exact_quantiles, median_by, overall, overall_one, same, with_quantiles
from jobweave.plans.warehouse import written

SALARY = "salary_midpoint_usd"


def is_salary(col: str = SALARY) -> Column:
    return (F.col(col) > 0) & (F.col(col) < rules.SALARY_REPORT_CAP_USD)


def pct(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part * 100.0 / whole)


# -- KPI blocks (one row) ---------------------------------------------------------
def dataset_summary(df: DataFrame) -> DataFrame:
    one = df.agg(F.count("*").alias("jobs"), F.count_distinct("company_name").alias("companies"),
                 F.count_distinct("city").alias("cities"),
                 F.count_distinct("source_website").alias("sources"),
                 F.count_if(is_salary()).alias("_paid"))
    return one.withColumn("salary_coverage", pct(F.col("_paid"), F.col("jobs"))).drop("_paid")


def top1(df: DataFrame, key: str, n: str | None = None) -> Column:
    """Most frequent key as a scalar subquery; ``n`` names the counts of a frame that is counted already."""
    top = K.value_counts(df, key, 1) if n is None else K.top_by(df, n, key, 1)
    return top.select(key).scalar()


def overview_kpis(df: DataFrame) -> DataFrame:
    """Summary, median salary and the most frequent skill, company, role and city.

    All counts come from one pass over the postings; the written counts are read for each of them.
    """
    counts = written(K.key_counts(df, {"company": "company_name", "city": "city", "source": "source_website", "role": "role_category",
                                       "paid": F.coalesce(is_salary(), F.lit(False))}, {"skill": "dash_skills"}), "overview")
    total = lambda rows: F.coalesce(F.sum(F.when(rows, F.col("n"))), F.lit(0))
    distinct = lambda kind: F.count_if((F.col("kind") == kind) & F.col("value").isNotNull())
    first = lambda kind: top1(counts.where(F.col("kind") == kind), "value", "n")
    paid = F.col("kind") == "paid"
    one = counts.agg(total(paid).alias("jobs"), distinct("company").alias("companies"), distinct("city").alias("cities"),
                     distinct("source").alias("sources"), total(paid & (F.col("value") == "true")).alias("_paid"))
    return one.withColumn("salary_coverage", pct(F.col("_paid"), F.col("jobs"))).drop("_paid").withColumns({
        "median_salary": overall_one(salary_subset(df), SALARY),
        "top_skill": first("skill"), "top_company": first("company"), "top_role": first("role"), "top_city": first("city")})


def salary_kpis(df: DataFrame) -> DataFrame:
    paid = F.when(is_salary(), F.col(SALARY))
    one = df.agg(F.avg(paid).alias("mean"), pct(F.count(paid), F.count("*")).alias("disclosed_pct"))
    one = one.withColumn("_q", overall(df.select(paid.alias("_paid")), "_paid", [0.5, 0.95]))
    return one.select(F.col("_q.q50").alias("median"), "mean", F.col("_q.q95").alias("p95"), "disclosed_pct")


def salary_quartiles(paid: DataFrame) -> DataFrame:
    """Quartiles and mean of the salaries, one row."""
    one = paid.agg(F.avg(SALARY).alias("mean")).withColumn("_q", overall(paid, SALARY, [0.25, 0.5, 0.75]))
    return one.select(F.col("_q.q25").alias("p25"), F.col("_q.q50").alias("median"), F.col("_q.q75").alias("p75"), "mean")


def skill_kpis(df: DataFrame, skills: str = "dash_skills") -> DataFrame:
    per = K.value_counts(explode_skills(df, skills), "skill")
    second = per.orderBy(F.desc("n"), "skill").limit(2)
    second = second.orderBy("n", F.desc("skill")).limit(1)
    return df.agg(F.avg("skill_count").alias("avg_skills")).withColumns({
        "distinct_skills": per.agg(F.count("*")).scalar(),
        "first_skill": per.orderBy(F.desc("n"), "skill").limit(1).select("skill").scalar(),
        "second_skill": second.select("skill").scalar(),
    })


def company_kpis(df: DataFrame) -> DataFrame:
    one = df.agg(F.count_distinct("company_name").alias("companies"), F.count("*").alias("_jobs"),
                 F.count_if(F.col("is_remote")).alias("_remote"))
    return one.select("companies", (F.col("_jobs") / F.col("companies")).alias("jobs_per_company"),
                      pct(F.col("_remote"), F.col("_jobs")).alias("remote_pct"),
                      top1(df, "company_name").alias("top_company"))


def city_kpis(df: DataFrame) -> DataFrame:
    top = K.value_counts(df, "city", 1)
    return df.agg(F.count_distinct("city").alias("cities"), F.count("*").alias("_jobs"),
                  F.count_if(F.col("city") == "Hanoi").alias("hanoi"),
                  F.count_if(F.col("city").isin("Ho Chi Minh City", "Ho Chi Minh")).alias("hcm")
                  ).select("cities", "hanoi", "hcm", top.select("city").scalar().alias("top_city"),
                           (top.select("n").scalar() * 100.0 / F.col("_jobs")).alias("top_city_pct"))


def export_kpis(df: DataFrame) -> DataFrame:
    one = df.agg(F.count("*").alias("Total Jobs"), F.count_distinct("company_name").alias("Companies"),
                 F.count_distinct("city").alias("Cities"),
                 F.count_distinct("source_website").alias("Sources"),
                 F.round(F.avg(SALARY), 4).alias("Avg Salary (USD)"))
    return K.unpivot_metrics(one, one.columns)


def about_totals(df: DataFrame, skills: str = "dash_skills") -> DataFrame:
    distinct = explode_skills(df, skills).agg(F.count_distinct("skill")).scalar()
    return dataset_summary(df).withColumns({"columns": F.lit(len(df.columns)),
                                            "distinct_skills": distinct})


def chart_overview(df: DataFrame, trimmed: DataFrame) -> DataFrame:
    """Totals, distinct titles and companies, date range, disclosure, trimmed median."""
    one = df.agg(F.count("*").alias("jobs"),
                 F.count_distinct("company_name_normalized").alias("companies"),
                 F.count_distinct("job_title").alias("titles"), F.count_distinct("city").alias("cities"),
                 F.count_if("has_salary").alias("with_salary"),
                 F.count_if(F.col("skill_count") > 0).alias("with_skills"),
                 F.count_distinct("source_website").alias("sources"),
                 F.min("posted_date_dt").cast("string").alias("first_date"),
                 F.max("posted_date_dt").cast("string").alias("last_date"))
    return one.withColumns({"with_salary_pct": pct(F.col("with_salary"), F.col("jobs")),
                            "median_salary": overall_one(trimmed, SALARY)})


# -- salary -------------------------------------------------------------------------
def median_by_role(paid: DataFrame, n: int = 10) -> DataFrame:
    out = exact_quantiles(paid, ["role_category"], SALARY, [0.5]).select(
        "role_category", F.bround("q50", 0).alias("median_salary"))
    return K.top_by(out, "median_salary", "role_category", n)


def median_by_top_city(paid: DataFrame, n: int = 8) -> DataFrame:
    return median_by(K.semi_top(paid, "city", n), ["city"], SALARY, "median_salary")


def role_salary_stats(paid: DataFrame, min_count: int = 10) -> DataFrame:
    out = paid.groupBy("role_category").agg(F.avg(SALARY).alias("mean"), F.count(SALARY).alias("n"))
    out = with_quantiles(out.where(F.col("n") >= min_count), paid, ["role_category"], SALARY)
    return out.select("role_category", "median", "mean", "n")


def high_paying_skills(paid: DataFrame, skills: str = "dash_skills", min_count: int = 15,
                       n: int = 15, exclude: Sequence[str] = ()) -> DataFrame:
    each = explode_skills(paid, skills, keep=[SALARY])
    if exclude:
        each = each.where(~F.col("skill").isin(*exclude))
    out = median_by(each, ["skill"], SALARY, "median_salary", min_count)
    return K.top_by(out, "median_salary", "skill", n)


# -- skills --------------------------------------------------------------------------
def explode_skills(df: DataFrame, skills: str, keep: Sequence[str] = ()) -> DataFrame:
    return explode_each(df, skills, "skill", keep)


def skill_counts(df: DataFrame, skills: str = "dash_skills", n: int | None = None,
                 exclude: Sequence[str] = (), min_length: int = 0) -> DataFrame:
    each = explode_skills(df, skills)
    if exclude:
        each = each.where(~F.col("skill").isin(*exclude))
    if min_length:
        each = each.where(F.length("skill") >= min_length)
    return K.value_counts(each, "skill", n)


def skill_by_role(df: DataFrame, skills: str = "dash_skills", n_skills: int = 12,
                  n_roles: int = 6) -> DataFrame:
    each = explode_skills(df, skills, keep=["role_category"])
    return K.count_grid(each, "skill", "role_category", K.value_counts(each, "skill", n_skills),
                        K.value_counts(df, "role_category", n_roles))


def skill_role_percent(df: DataFrame, skills: str = "chart_skills", roles=rules.HEATMAP_ROLES,
                       focus=rules.FOCUS_SKILLS, min_jobs: int = 0, min_max: float | None = None) -> DataFrame:
    """% of the postings of a role that name a skill; NULL for a role without postings or with fewer than ``min_jobs``.

    A caller may leave out the skills whose share never passes ``min_max``.
    """
    totals = df.where(F.col("role_category").isin(*roles)).groupBy("role_category").agg(
        F.count("*").alias("jobs"))
    each = explode_skills(df, skills, keep=["role_category"]).where(
        F.col("role_category").isin(*roles) & F.col("skill").isin(*focus))
    counts = each.groupBy("role_category", "skill").agg(F.count("*").alias("n"))
    grid = K.ordered_dim(df, "role_category", roles).select(
        "role_category", F.explode(F.array(*[F.lit(s) for s in focus])).alias("skill"))
    out = grid.join(totals, "role_category", "left").join(counts, ["role_category", "skill"], "left")
    share = F.when(F.col("jobs") >= min_jobs, F.bround(F.coalesce("n", F.lit(0)) * 100.0 / F.col("jobs"), 1))
    out = out.select("role_category", "skill", share.alias("pct"))
    if min_max is None:
        return out
    keep = out.groupBy("skill").agg(F.max("pct").alias("m")).where(F.col("m") > min_max).select("skill")
    return out.join(keep, "skill", "left_semi")


# -- companies and cities --------------------------------------------------------------
def company_by_role(df: DataFrame, n_companies: int = 8, n_roles: int = 6) -> DataFrame:
    return K.count_grid(df, "company_name", "role_category", K.value_counts(df, "company_name", n_companies),
                        K.value_counts(df, "role_category", n_roles))


def company_role_percent(df: DataFrame, company: str = "company_name_normalized", n: int = 12,
                         roles=rules.COMPANY_FOCUS_ROLES) -> DataFrame:
    """Row percentages over the focus roles for the top companies (wide)."""
    wide = K.pivot_counts(K.semi_top(df, company, n), company, "role_category", roles)
    total = sum((F.col(f"`{r}`") for r in roles), F.lit(0))
    return wide.select(company, *[F.round(F.when(total > 0, F.col(f"`{r}`") * 100.0 / total), 4).alias(r)
                                  for r in roles])


def company_profile(df: DataFrame, company: str = "company_name") -> DataFrame:
    return (df.groupBy(company).agg(F.count("job_title").alias("jobs"))
            .join(K.mode_by(df, company, "role_category", "main_role"), company)
            .join(K.mode_by(df, company, "city", "main_city"), company))


def city_profile(df: DataFrame) -> DataFrame:
    paid = exact_quantiles(salary_subset(df), ["city"], SALARY, [0.5]).select("city", F.bround("q50", 0).alias("median_salary"))
    return (df.groupBy("city").agg(F.count("job_title").alias("jobs"),
                                   F.count_distinct("company_name").alias("companies"))
            .join(K.mode_by(df, "city", "role_category", "main_role"), "city")
            .join(paid, "city", "left"))


def city_stats(df: DataFrame, paid: DataFrame, n: int = 10) -> DataFrame:
    """Top cities with mean skill count, left-joined to their median salary."""
    stats = df.groupBy("city").agg(F.count("job_title").alias("jobs"), F.avg("skill_count").alias("avg_skills"))
    medians = exact_quantiles(paid, ["city"], SALARY, [0.5]).select("city", F.col("q50").alias("median_salary"))
    return K.top_by(stats, "jobs", "city", n).join(medians, "city", "left")


def two_city_roles(df: DataFrame, left=rules.HCM_KEYS, right=rules.HANOI_KEYS, n_roles: int = 7,
                   min_jobs: int = 0, min_paid: int = 0) -> DataFrame:
    """Counts and median salaries of two cities over the top roles.

    A caller may ask for no rows unless each city has ``min_jobs`` postings, and for
    NULL medians unless each has ``min_paid`` salaries; by default all is shown.
    """
    side = F.when(F.col("city").isin(*left), "l").when(F.col("city").isin(*right), "r")
    df = df.withColumn("_side", side)
    sal = F.when(is_salary(), F.col(SALARY))
    on = lambda s, v: F.when(F.col("_side") == s, v)
    per = df.groupBy("role_category").agg(
        F.count(on("l", F.lit(1))).alias("left_jobs"), F.count(on("r", F.lit(1))).alias("right_jobs"))
    sides = exact_quantiles(df.where("_side IS NOT NULL").select("role_category", "_side", sal.alias("_sal")),
                            ["role_category", "_side"], "_sal", [0.5])
    sides = sides.groupBy("role_category").agg(F.max(on("l", F.col("q50"))).alias("_lm"), F.max(on("r", F.col("q50"))).alias("_rm"))
    per = same(per, sides, ["role_category"], "left")
    out = K.value_counts(df, "role_category", n_roles).select("role_category").join(per, "role_category")
    size = df.agg(F.count(on("l", F.lit(1))).alias("lj"), F.count(on("r", F.lit(1))).alias("rj"),
                  F.count(on("l", sal)).alias("lp"), F.count(on("r", sal)).alias("rp"))
    enough = size.select((F.col("lj") >= min_jobs) & (F.col("rj") >= min_jobs)).scalar()
    paid = size.select((F.col("lp") >= min_paid) & (F.col("rp") >= min_paid)).scalar()
    return out.where(enough).select("role_category", "left_jobs", "right_jobs",
                                    F.when(paid, F.col("_lm")).alias("left_median"),
                                    F.when(paid, F.col("_rm")).alias("right_median"))


def two_city_metrics(df: DataFrame, paid: DataFrame, cities=("Ho Chi Minh City", "Hanoi")) -> DataFrame:
    """(city, metric, value): median salary, jobs, senior/lead %, mean skills."""
    jobs = df.where(F.col("city").isin(*cities)).groupBy("city").agg(
        F.count("*").cast("double").alias("job_count"),
        (F.avg(F.col("experience_level_inferred").isin("senior", "lead").cast("int")) * 100).alias("senior_lead_pct"),
        F.avg("skill_count").alias("avg_skills"))
    wide = with_quantiles(jobs, paid.where(F.col("city").isin(*cities)), ["city"], SALARY, names=["median_salary"])
    names = ["median_salary", "job_count", "senior_lead_pct", "avg_skills"]
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in names])
    return wide.select("city", F.inline(pairs))


# -- quality ---------------------------------------------------------------------------
def silver_checks() -> dict[str, Column]:
    longer = lambda c, n: F.length(text(c)) > n
    return {"salary": F.col("has_salary"), "description": longer("job_description", 50),
            "skills": F.col("skill_count") > 0, "benefits": longer("benefits", 10),
            "experience": F.col("experience_years_parsed").isNotNull(),
            "posted": F.col("posted_date_dt").isNotNull(), "expiry": F.col("expiry_date_dt").isNotNull(),
            "location": F.col("location_normalized").isNotNull()}


def raw_checks() -> dict[str, Column]:
    longer = lambda c, n: F.length(text(c)) > n
    return {"salary": F.col("salary_min") > 0, "description": longer("job_description", 50),
            "skills": ~F.trim(text("skills_required")).isin("", "[]"), "benefits": longer("benefits", 10),
            "experience": F.col("experience_years").isNotNull(),
            "posted": F.col("posted_date").isNotNull(), "expiry": F.col("expiry_date").isNotNull()}


def validate_dataset(df: DataFrame, fields=S.QUALITY_FIELDS) -> DataFrame:
    """(section, key, value) quality report: one aggregate pass plus three small counts."""
    empty = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))).isin("", "[]", "nan")
    share = lambda cond: F.round(F.avg(cond.cast("int")) * 100, 1)
    names = {f"null_pct:{c}": share(empty(c)) for c in fields if c in df.columns}
    names["total_records:"] = F.count("*")
    names["salary_coverage_pct:"] = share(F.col("has_salary"))
    names["skill_coverage_pct:"] = share(F.col("skill_count") > 0)
    names["remote_count:"] = F.count_if("is_remote")
    one = df.agg(*[c.cast("double").alias(f"m{i}") for i, c in enumerate(names.values())])
    pairs = F.array(*[F.struct(F.lit(n.split(":")[0]).alias("section"), F.lit(n.split(":")[1]).alias("key"),
                               F.col(f"m{i}").alias("value")) for i, n in enumerate(names)])
    out = one.select(F.inline(pairs))
    for section, key, n in (("by_source", "source_website", None),
                            ("top_locations", "location_normalized", 10),
                            ("levels", "experience_level_inferred", None)):
        out = out.unionByName(K.value_counts(df, key, n).select(
            F.lit(section).alias("section"), F.col(key).alias("key"), F.col("n").cast("double").alias("value")))
    return out


def labelled_summary(df: DataFrame, n: int = 10) -> DataFrame:
    """(grp, label, value): top roles, cities and skills in one frame."""
    parts = [("role", "role_category", K.value_counts(df, "role_category", n)),
             ("city", "city", K.value_counts(df, "city", n)),
             ("skill", "skill", skill_counts(df, n=n))]
    out = None
    for grp, key, counts in parts:
        one = counts.select(F.lit(grp).alias("grp"), F.col(key).alias("label"), F.col("n").alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


def collection_funnel(raw: DataFrame, merged: DataFrame, processed: DataFrame) -> DataFrame:
    count = lambda df, i, name: df.agg(F.count("*").alias("n")).select(
        F.lit(i).alias("ord"), F.lit(name).alias("stage"), F.col("n").cast("double").alias("n"))
    mean = raw.agg((F.count("*") / F.count_distinct("source_website")).alias("n")).select(
        F.lit(3).alias("ord"), F.lit("mean per source").alias("stage"), "n")
    return (count(raw, 0, "raw").unionByName(count(merged, 1, "merged"))
            .unionByName(count(processed, 2, "processed")).unionByName(mean))
