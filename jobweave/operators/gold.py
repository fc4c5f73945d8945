"""Gold columns, filters and salary subsets."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave import rules
from jobweave import schema as S
from jobweave.functions import dates, location, roles, skills
from jobweave.functions.common import text
from jobweave.operators.quantiles import overall_one

# default values of missing or NULL columns (fixed values)
TEXT_DEFAULTS = {"job_title": "", "company_name": "Không rõ", "skills_str": "",
                 "source_website": "Không rõ", "experience_level_inferred": "unknown"}
TRUE_WORDS = ["true", "1", "yes", "remote"]


def load_defaults(df: DataFrame, text_defaults=None, number="salary_midpoint_usd",
                  flag="is_remote") -> DataFrame:
    """Fill text defaults, coerce the number, read truthy text as a flag; add missing columns."""
    have = set(df.columns)
    cols = {c: (F.coalesce(F.col(c).cast("string"), F.lit(d)) if c in have else F.lit(d))
            for c, d in (text_defaults or TEXT_DEFAULTS).items()}
    cols[number] = (F.col(number).cast("string").try_cast("double") if number in have
                    else F.lit(None).cast("double"))
    cols[flag] = (F.lower(F.coalesce(F.col(flag).cast("string"), F.lit("false"))).isin(*TRUE_WORDS)
                  if flag in have else F.lit(False))
    return df.withColumns(cols)


def with_gold_columns(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "role_category": roles.role_category(),
        "dash_skills": skills.dashboard_skills("skills_str"),
        "month": dates.month_key("posted_date_dt"),
        "city": location.display_city(),
    })


def with_chart_columns(df: DataFrame) -> DataFrame:
    """Columns of the exploratory charts: 16 roles, city synonyms, skill lists with case kept."""
    return df.withColumns({
        "role_category": roles.chart_role(),
        "city": location.city_synonym("location_normalized"),
        "emp_type": location.employment_synonym("employment_type"),
        "chart_skills": skills.chart_skills("skills_str"),
    })


@dataclass(frozen=True)
class FilterSpec:
    """Optional filters; empty lists and None mean 'all'."""

    cities: list[str] = field(default_factory=list)
    roles: list[str] = field(default_factory=list)
    levels: list[str] = field(default_factory=list)
    sources: list[str] = field(default_factory=list)
    remote: bool | None = None
    salary_range: tuple[float, float] | None = None
    salary_col: str = "salary_midpoint_usd"

    def to_column(self) -> Column:
        """One conjunction, so Catalyst can push it to the scan.

        A salary range keeps rows without a salary.
        """
        out = F.lit(True)
        for name, values in (("city", self.cities), ("role_category", self.roles),
                             ("experience_level_inferred", self.levels),
                             ("source_website", self.sources)):
            if values:
                out = out & F.col(name).isin(*values)
        if self.remote is not None:
            out = out & (F.col("is_remote") == self.remote)
        if self.salary_range is not None:
            sal = F.col(self.salary_col)
            out = out & (sal.isNull() | sal.between(*self.salary_range))
        return out


def apply_filters(df: DataFrame, spec: FilterSpec) -> DataFrame:
    return df.where(spec.to_column())


def salary_subset(df: DataFrame, col: str = "salary_midpoint_usd",
                  cap: float = rules.SALARY_REPORT_CAP_USD) -> DataFrame:
    return df.where((F.col(col) > 0) & (F.col(col) < cap))


def trimmed_salary_subset(df: DataFrame, col: str = "salary_midpoint_usd",
                          q: float = 0.99) -> DataFrame:
    """Disclosed salaries up to the q-quantile of that set (a scalar subquery)."""
    paid = df.where(F.col("has_salary") & (F.col(col) > 0))
    return paid.where(F.col(col) <= overall_one(paid, col, q))


def filter_options(df: DataFrame, n_cities: int = 20) -> DataFrame:
    """(option, value, ord): top cities, roles, present levels in order, sources, salary cap.

    All values are counted in one pass over the postings.
    """
    from jobweave.operators import counts as K
    from jobweave.plans.warehouse import written

    counts = written(K.key_counts(df, {"city": "city", "role": "role_category", "level": "experience_level_inferred",
                                       "source": "source_website"}), "options")
    kind, value = F.col("kind"), F.col("value")
    option = lambda d, ord_: d.select(kind.alias("option"), "value", ord_.alias("ord"))
    cities = K.top_by(counts.where(kind == "city"), "n", "value", n_cities)
    others = counts.where((kind == "role") | ((kind == "source") & value.isNotNull()))
    levels = counts.where((kind == "level") & value.isin(*rules.LEVEL_ORDER))
    cap = df.sparkSession.range(1).select(overall_one(df, "salary_midpoint_usd", 0.99).alias("p")).select(
        F.lit("salary_cap").alias("option"), F.coalesce(F.floor("p"), F.lit(5000)).cast("int").cast("string").alias("value"),
        F.lit(0).alias("ord"))
    return option(cities.unionByName(others), F.lit(0)).unionByName(option(levels, roles.level_rank("value"))).unionByName(cap)


def report_columns(df: DataFrame, columns=S.REPORT_COLUMNS) -> DataFrame:
    return df.select([c for c in columns if c in df.columns])


def posting_text(title="job_title", skills_col="skills_str", description="job_description") -> Column:
    joined = F.concat_ws("\n", text(title), text(skills_col), text(description))
    return F.regexp_replace(joined, r"^\s+|\s+$", "")


def display_label(title="job_title", company="company_name", city="city") -> Column:
    return F.concat_ws(" · ", F.coalesce(title, F.lit("Không rõ")),
                       F.coalesce(company, F.lit("Không rõ")), F.coalesce(city, F.lit("Khác")))


def salary_band(col, high: float = 1000, mid: float = 700) -> Column:
    return F.when(F.col(col) >= high, "high").when(F.col(col) >= mid, "mid").otherwise("low")
