"""Postings out of web pages and API records, as table jobs over many pages at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave import rules
from jobweave.functions import experience, skills
from jobweave.functions import text as tx
from jobweave.functions.common import as_col, contains_any, explode_each, half_even, let, lookup, text
from jobweave.functions.salary import with_ingest_salary

LD_SCRIPT = r"""(?is)<script[^>]*type=["']?application/ld\+json["']?[^>]*>(.*?)</script>"""


def json_ld_posting(html: str | Column) -> Column:
    """First JobPosting of the ld+json scripts of a page, as a variant; NULL when none.

    A script may hold one object, a list or an object with ``@graph``; scripts
    that are not JSON are skipped.  Array expressions inside the row keep the
    page order, so no explode and no shuffle are needed.
    """
    blocks = F.regexp_extract_all(text(html), F.lit(LD_SCRIPT), F.lit(1))
    docs = F.array_compact(F.transform(blocks, lambda b: F.try_parse_json(b)))

    def members(v: Column) -> Column:
        graph = F.try_variant_get(v, '$["@graph"]', "array<variant>")
        return F.coalesce(F.try_variant_get(v, "$", "array<variant>"),
                          F.concat(F.array(v), F.coalesce(graph, F.array().cast("array<variant>"))))

    every = F.flatten(F.transform(docs, members))
    return F.get(F.filter(every, lambda v: F.try_variant_get(v, '$["@type"]', "string") == "JobPosting"), F.lit(0))


def with_json_ld(pages: DataFrame, html: str = "html", name: str = "ld") -> DataFrame:
    """Pages with a posting; the posting is bound as a row of its own, or the filter would parse the page a second time."""
    keep = [F.col(f"`{c}`") for c in pages.columns if c != name]
    return explode_each(pages, F.array(json_ld_posting(html)), name, keep)


def _get(path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.col("ld"), path, kind)


def _str(path: str) -> Column:
    return F.coalesce(_get(path), F.lit(""))


def _list_or_text(path: str) -> Column:
    """A JSON list or a comma string, trimmed, without blanks."""
    items = F.coalesce(_get(path, "array<string>"), tx.comma_list(_get(path)))
    return F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != "")


def _places() -> Column:
    one = F.array(_get("$.jobLocation.address", "struct<addressRegion:string,addressLocality:string>"))
    many = F.transform(_get("$.jobLocation", "array<variant>"), lambda v: F.try_variant_get(
        v, "$.address", "struct<addressRegion:string,addressLocality:string>"))
    return F.coalesce(many, one)


def _month_years() -> Column:
    return half_even(_get("$.experienceRequirements.monthsOfExperience", "double") / 12, 1)


def _range_text(currency: Column) -> Column:
    """'min-max currency' with the numbers as the page writes them."""
    return F.concat_ws(" ", F.concat_ws("-", _get("$.baseSalary.value.minValue"), F.coalesce(_get("$.baseSalary.value.maxValue"), F.lit("0"))), currency)


def _employment_code(default: bool = True) -> Column:
    raw = F.coalesce(F.get(_get("$.employmentType", "array<string>"), F.lit(0)), _get("$.employmentType"))
    code = F.upper(F.regexp_replace(F.coalesce(raw, F.lit("")), r"""^["']+|["']+$""", ""))
    mapped = lookup(code, rules.EMPLOYMENT_CODES, F.lit("Full-time"))
    return mapped if default else F.when(code != "", mapped)


def posting_from_ld_a(df: DataFrame, url: str = "url") -> DataFrame:
    """Source A: all locations joined, employment type in title case, text experience only."""
    part = lambda a: F.coalesce(F.nullif(F.trim(a["addressRegion"]), F.lit("")), F.trim(a["addressLocality"]))
    known = F.filter(F.transform(_places(), part), lambda p: (p != "") & (F.lower(p) != "not available"))
    df = with_ingest_salary(df.withColumn("_sal", _str("$.baseSalary.value.value")), "_sal", "_in_")
    lo, hi = _get("$.baseSalary.value.minValue", "double"), _get("$.baseSalary.value.maxValue", "double")
    raw_type = F.coalesce(F.array_join(_get("$.employmentType", "array<string>"), ", "), _str("$.employmentType"))
    title = clean_title(_str("$.title"))
    level = experience.first_rule(F.lower(title), rules.SOURCE_LEVEL_RULES["itviec"], rules.SOURCE_LEVEL_DEFAULT)
    df = df.withColumn("_body", tx.strip_html(_str("$.description")))
    return df.select(
        url, level.alias("job_level"), clean_title(_str("$.title")).alias("job_title"), _str("$.hiringOrganization.name").alias("company_name"),
        F.col("_sal").alias("salary"), F.coalesce(lo, "_in_min").alias("salary_min"),
        F.when(lo.isNull(), F.col("_in_max")).otherwise(hi).alias("salary_max"),
        F.when(lo.isNull() & (F.col("_sal") != ""), F.col("_in_currency")).otherwise(_str("$.baseSalary.currency"))
         .alias("salary_currency"),
        F.array_join(known, ", ").alias("location"), F.initcap(F.replace(raw_type, F.lit("_"), F.lit(" "))).alias("employment_type"),
        tx.comma_list(F.coalesce(F.array_join(_get("$.skills", "array<string>"), ", "), _str("$.skills"))).alias("skills_required"),
        experience.phrase_years(experience.experience_phrase("_body")).alias("experience_years"),
        F.col("_body").alias("job_description"), tx.strip_html(_str("$.jobBenefits")).alias("benefits"),
        _str("$.datePosted").alias("posted_date"), _str("$.validThrough").alias("expiry_date"),
        F.coalesce(_get("$.industry"), F.lit(rules.DEFAULT_INDUSTRY)).alias("industry"))


def posting_from_ld_b(df: DataFrame, url: str = "url") -> DataFrame:
    """Source B: first location, employment codes, months to years, level by title, defaults.

    A page without a skill list has the taxonomy names of its description.
    """
    first = F.get(_places(), F.lit(0))
    lo, hi = _get("$.baseSalary.value.minValue", "double"), _get("$.baseSalary.value.maxValue", "double")
    paid = F.coalesce((lo != 0) & (hi != 0), F.lit(False))
    currency = F.coalesce(_get("$.baseSalary.currency"), F.lit("VND"))
    phrase = experience.phrase_years(experience.experience_phrase(_get("$.experienceRequirements")))
    benefits = F.coalesce(F.array_join(F.filter(F.transform(_get("$.jobBenefits", "array<string>"), lambda x: F.trim(x)),
                                                lambda x: x != ""), "; "),
                          _str("$.jobBenefits"))
    out = df.select(
        url, F.trim(_str("$.title")).alias("job_title"), F.trim(_str("$.hiringOrganization.name")).alias("company_name"),
        F.trim(F.coalesce(F.nullif(first["addressLocality"], F.lit("")), first["addressRegion"], F.lit(""))).alias("location"),
        tx.strip_html(_str("$.description")).alias("job_description"),
        F.when(paid, _range_text(currency)).otherwise("Thỏa thuận").alias("salary"),
        F.when(paid, lo).alias("salary_min"), F.when(paid, hi).alias("salary_max"),
        F.when(paid, currency).otherwise("VND").alias("salary_currency"),
        F.substring(_str("$.datePosted"), 1, 10).alias("posted_date"), F.substring(_str("$.validThrough"), 1, 10).alias("expiry_date"),
        _employment_code().alias("employment_type"),
        _list_or_text("$.skills").alias("_listed"), benefits.alias("benefits"), F.coalesce(_month_years(), phrase).alias("experience_years"),
        F.trim(F.coalesce(F.nullif(_get("$.industry"), F.lit("")), F.lit(rules.DEFAULT_INDUSTRY))).alias("industry"))
    scanned = skills.taxonomy_scan(F.lit(""), "job_description")
    level = experience.first_rule(F.lower("job_title"), rules.SOURCE_LEVEL_RULES["careerviet"], rules.SOURCE_LEVEL_DEFAULT)
    return out.withColumns({"skills_required": F.when(F.size("_listed") > 0, F.col("_listed")).otherwise(scanned),
                            "job_level": level}).drop("_listed")


def overlay_from_ld_c(df: DataFrame, url: str = "url") -> DataFrame:
    """Source C: detail fields laid over a result card; NULL where the page says nothing."""
    some = lambda c: F.nullif(c, F.lit(""))
    lo = F.coalesce(_get("$.baseSalary.value.minValue", "double"), F.lit(0.0))
    hi = F.coalesce(_get("$.baseSalary.value.maxValue", "double"), F.lit(0.0))
    currency = F.coalesce(_get("$.baseSalary.currency"), F.lit("USD"))
    paid = lo > 0
    return df.select(
        url, some(tx.strip_html(_str("$.description"))).alias("job_description"),
        some(F.substring(_str("$.datePosted"), 1, 10)).alias("posted_date"),
        some(F.substring(_str("$.validThrough"), 1, 10)).alias("expiry_date"),
        _list_or_text("$.skills").alias("skills_required"),
        some(tx.strip_html(_str("$.jobBenefits"))).alias("benefits"),
        F.when(paid, lo).alias("salary_min"), F.when(paid, hi).alias("salary_max"), F.when(paid, currency).alias("salary_currency"),
        F.when(paid, _range_text(currency)).alias("salary"),
        _employment_code(default=False).alias("employment_type"), _month_years().alias("experience_years"))


def posting_from_api(df: DataFrame, record: str = "record", base_url: str = "") -> DataFrame:
    """API records (JSON text) to postings; records that are not JSON or have no title are dropped.

    A field may come under its older name; members of lists are objects or plain strings.
    """
    # a row of its own, or the filter on the title would parse the record a second time
    df = explode_each(df, F.array(F.try_parse_json(record)), "r", [F.col(f"`{c}`") for c in df.columns if c != "r"])
    r = lambda c, kind="string": F.try_variant_get(F.col("r"), f"$.{c}", kind)
    first = lambda *cs: F.coalesce(*[F.nullif(c, F.lit("")) for c in cs], F.lit(""))
    none = F.array().cast("array<variant>")

    def member(v: Column, *names: str) -> Column:
        return first(*[F.try_variant_get(v, f"$.{n}", "string") for n in names])

    def plain(v: Column) -> Column:
        """The string itself, where the member is one."""
        return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))

    def listed(name: str, item) -> Column:
        return F.filter(F.transform(F.coalesce(r(name, "array<variant>"), none), item), lambda x: x != "")

    title = F.trim(first(r("jobTitle"), r("title")))
    built = F.when((first(r("alias")) != "") & (first(r("jobId")) != ""),
                   F.concat(F.lit(base_url + "/"), r("alias"), F.lit("-"), r("jobId"), F.lit("-jv")))
    salary = first(r("prettySalary"), r("prettySalaryVI"), F.lit("Thỏa thuận"))
    df = with_ingest_salary(df.withColumn("_sal", salary), "_sal", "_in_").where(title != "")
    low, high, years = (r(c, "double") for c in ("salaryMin", "salaryMax", "yearsOfExperience"))
    lo, hi = F.when(low > 0, low), F.when(high > 0, high)
    cities = listed("workingLocations", lambda v: member(v, "cityName", "cityNameVI", "address"))
    names = listed("skills", lambda v: F.coalesce(plain(v), member(v, "skillName")))

    def benefit(v: Column) -> Column:
        name, value = member(v, "benefitName", "benefitNameVI"), member(v, "benefitValue")
        return F.coalesce(plain(v), F.when((name != "") & (value != ""), F.concat(name, F.lit(": "), value)).otherwise(name))

    benefits = listed("benefits", benefit)
    sector = lambda v: member(v, "industryV3Name", "industryName", "name")
    industries = F.concat(listed("industriesV3", sector), F.when(F.size(F.coalesce(r("industriesV3", "array<variant>"), none)) == 0,
                                                                 listed("industries", sector)).otherwise(F.array().cast("array<string>")))
    body = F.concat(tx.strip_html(r("jobDescription")), F.lit("\n\n"), tx.strip_html(r("jobRequirement")))
    df = df.withColumn("_body", F.regexp_replace(body, r"^\s+|\s+$", ""))
    kind = lookup(r("typeWorkingId", "int"), rules.WORKING_TYPE_CODES, F.lit("Full-time"))
    level = experience.first_rule(F.lower(F.concat_ws(" ", first(r("jobLevel"), r("jobLevelVI")), title)),
                                  rules.SOURCE_LEVEL_RULES["vietnamworks"], rules.SOURCE_LEVEL_DEFAULT)
    keep = [c for c in df.columns if c not in (record, "r", "_sal", "_in_min", "_in_max", "_in_currency", "_body")]
    return df.select(
        *keep, tx.canonical_url(F.coalesce(F.nullif(first(r("jobUrl"), r("canonical")), F.lit("")), built, F.lit("")), base_url).alias("url"),
        title.alias("job_title"), F.trim(first(r("companyName"), r("company_name"))).alias("company_name"), F.col("_sal").alias("salary"),
        F.coalesce(lo, "_in_min").alias("salary_min"), F.when(lo.isNull(), F.col("_in_max")).otherwise(hi).alias("salary_max"),
        F.when(lo.isNull(), F.col("_in_currency")).otherwise(first(r("salaryCurrency"), F.lit("USD"))).alias("salary_currency"),
        F.when(F.size(F.coalesce(r("workingLocations", "array<variant>"), none)) > 0, F.array_join(cities, ", "))
         .otherwise(F.trim(first(r("address")))).alias("location"),
        kind.alias("employment_type"), level.alias("job_level"), names.alias("skills_required"),
        F.coalesce(F.when(years >= 0, years), experience.phrase_years(experience.experience_phrase("_body"))).alias("experience_years"),
        F.col("_body").alias("job_description"), F.array_join(benefits, "; ").alias("benefits"),
        F.substring(first(r("approvedOn"), r("onlineOn"), r("createdOn")), 1, 10).alias("posted_date"),
        F.substring(first(r("expiredOn")), 1, 10).alias("expiry_date"),
        F.coalesce(F.get(industries, F.lit(0)), F.lit(rules.DEFAULT_INDUSTRY)).alias("industry"))


def clean_title(c: str | Column) -> Column:
    """Drop a leading ``[..]``, a leading place before a comma, a leading job code."""
    t = F.trim(F.regexp_replace(text(c), r"^\[.*?\]\s*", ""))
    place = r"^([A-Za-zÀ-ỹ\s]{2,30}),\s*(.+)$"
    def no_place(t: Column) -> Column:
        prefix, rest = F.trim(F.regexp_extract(t, place, 1)), F.trim(F.regexp_extract(t, place, 2))
        return F.when((rest != "") & ~contains_any(F.lower(prefix), rules.TITLE_JOB_WORDS), rest).otherwise(t)
    return F.trim(F.regexp_replace(let(t, no_place), r"(?i)^(JOB|REQ|POS|ID)[-#\s]\w+[\s:]+", ""))


def section(c: str | Column, start: str, ends: Sequence[str]) -> Column:
    """Text after the start heading up to the nearest following end heading."""
    c = text(c)

    def cut(low: Column) -> Column:
        at = F.locate(start, low)
        begin = at + len(start)
        rest = F.substring(c, begin, F.length(c))
        low_rest = F.substring(low, begin, F.length(c))
        found = [F.coalesce(F.nullif(F.locate(e, low_rest), F.lit(0)), F.length(low_rest) + 1) for e in ends]
        stop = F.least(*found) if len(found) > 1 else found[0]
        return F.when(at > 0, F.trim(F.substring(rest, F.lit(1), stop - 1))).otherwise("")

    return let(F.lower(c), cut)


def trim_benefits(c: str | Column) -> Column:
    """Cut at the 'last updated' marker and at link texts within the last 100 characters."""
    c = text(c)
    at = F.locate(rules.BENEFIT_CUT_MARKER, F.lower(c))
    out = F.when(at > 1, F.trim(F.substring(c, F.lit(1), at - 1))).otherwise(c)
    for marker in rules.BENEFIT_TAIL_MARKERS:
        def cut(t: Column) -> Column:
            back = F.position(F.lit(marker[::-1]), F.reverse(F.lower(t)))
            start = F.length(t) - back - len(marker) + 1          # zero-based start of the last hit
            return F.when((back > 0) & (start > F.length(t) - 100), F.trim(F.substring(t, F.lit(1), start))).otherwise(t)
        out = let(out, cut)
    return out


def deadline(c: str | Column) -> Column:
    """dd/mm/yyyy or ISO date after 'hạn nộp (hồ sơ)'."""
    return F.regexp_extract(text(c), r"(?iu)hạn\s+nộp\s+(?:hồ\s+sơ\s+)?(\d{1,2}/\d{1,2}/\d{4}|\d{4}-\d{2}-\d{2})", 1)


CARD_POSTED = (r"(?iuU)(\d+\s*(?:day|hour|minute|week|month|ngày|giờ|phút|tuần|tháng)s?\s*ago|\bjust\s+now\b|\btoday\b|"
               r"\byesterday\b|\bhôm\s+nay\b|\bhôm\s+qua\b|\bvừa\s+đăng\b)")
PAREN_NOISE = r"(?iu)\d{4}|triệu|upto|năm"


def card_metadata(card: str, title: str, company: str, salary: str) -> dict[str, Column]:
    """Location, employment type, skills and posting phrase of a result-card text.

    Known leading texts (title, company, salary) are removed first, in order.
    """
    rest = text(card)
    for prefix in (text(title), text(company), text(salary), F.lit(rules.CARD_HIDDEN_SALARY)):
        def after(t: Column) -> Column:
            at = F.position(prefix, t)
            return F.when((F.length(prefix) > 0) & (at > 0), F.trim(F.substring(t, at + F.length(prefix), F.length(t)))).otherwise(t)
        rest = let(rest, after)
    low = F.lower(rest)
    place = None
    for name in rules.CARD_LOCATIONS:
        hit = low.contains(name.lower())
        place = F.when(hit, name) if place is None else place.when(hit, name)
    kind = (F.when(low.rlike("fulltime|full.time"), "Full-time").when(low.rlike("parttime|part.time"), "Part-time")
             .when(low.contains("remote"), "Remote").otherwise("Full-time"))
    scan = skills.taxonomy_scan(title, None, skip_pattern=PAREN_NOISE, body=rest)
    return {"location": place.otherwise(""), "employment_type": kind,
            "posted_date": F.trim(F.regexp_extract(text(card), CARD_POSTED, 0)), "skills_required": scan}
