"""SQL text for the checking database: the layers as common table expressions.

Only used to compare results; no operator depends on it.
"""

from __future__ import annotations

from jobweave import rules
from jobweave.sources import derived as D


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def any_of(expr: str, words) -> str:
    return "(" + " OR ".join(f"contains({expr}, {q(w)})" for w in words) + ")"


def case_rules(expr: str, table, default: str) -> str:
    whens = " ".join(f"WHEN {any_of(expr, words)} THEN {q(label)}" for label, words in table)
    return f"CASE {whens} ELSE {default} END"


def sql_map(table) -> str:
    return "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in table.items()) + "}"


def sql_list(items) -> str:
    return "[" + ", ".join(q(x) for x in items) + "]"


def in_list(items) -> str:
    return "(" + ", ".join(q(x) for x in items) + ")"


def half_even(x: str, n: int) -> str:
    p = 10 ** n
    return (f"CASE WHEN abs(({x}) * {p} - floor(({x}) * {p}) - 0.5) < 5e-5 "
            f"THEN (floor(({x}) * {p}) + CAST(floor(({x}) * {p}) AS BIGINT) % 2) / {p}.0 "
            f"ELSE round(({x}), {n}) END")


def clean(x: str) -> str:
    return (f"trim(regexp_replace(regexp_replace(coalesce({x}, ''), '[\\r\\n\\t]+', ' ', 'g'), "
            f"' {{2,}}', ' ', 'g'))")


def strip_html(x: str) -> str:
    out = f"coalesce({x}, '')"
    for pat in (r"(?is)<script\b.*?</script\s*>", r"(?is)<style\b.*?</style\s*>", r"(?s)<!--.*?-->",
                r"(?s)</?[A-Za-z!?][^>]*>"):
        out = f"regexp_replace({out}, {q(pat)}, ' ', 'g')"
    for a, b in [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
                 ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]:
        out = f"replace({out}, {q(a)}, {q(b)})"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


def remove_html(x: str) -> str:
    return f"CASE WHEN contains(coalesce({x}, ''), '<') THEN {strip_html(x)} ELSE {clean(x)} END"


def company(x: str) -> str:
    out = clean(x)
    for p in rules.LEGAL_FORM_PATTERNS:
        out = f"regexp_replace({out}, {q('(?i)' + p)}, '', 'g')"
    return f"trim(regexp_replace({out}, '\\s{{2,}}', ' ', 'g'))"


def negotiable(x: str) -> str:
    s = f"lower(trim(coalesce({x}, '')))"
    return f"({s} = '' OR {any_of(s, rules.NEGOTIABLE_WORDS)})"


def initcap(x: str) -> str:
    return (f"array_to_string(list_transform(string_split(lower({x}), ' '), "
            f"lambda w: upper(w[1]) || w[2:]), ' ')")


def location(x: str) -> str:
    loc = f"trim(coalesce({x}, ''))"
    whens = " ".join(f"WHEN contains(lower({loc}), {q(k)}) THEN {q(v)}"
                     for k, v in rules.LOCATION_MAP.items())
    head = f"trim(regexp_split_to_array({loc}, '[|,;/]')[1])"
    return (f"CASE {whens} WHEN {loc} = '' THEN 'Unknown' "
            f"WHEN len(regexp_split_to_array({loc}, '[|,;/]')) > 1 AND {head} <> '' "
            f"THEN {initcap(head)} || ' + more' ELSE {initcap(loc)} END")


def years_of(x: str) -> str:
    low = f"lower(coalesce({x}, ''))"
    tries = []
    for pat, div in rules.EXPERIENCE_PATTERNS:
        v = f"TRY_CAST(regexp_extract({low}, {q(pat)}, 1) AS DOUBLE)"
        if div != 1:
            v = half_even(f"{v} / {div}", 1)
        tries.append(f"CASE WHEN {v} BETWEEN 0 AND 20 THEN {v} END")
    return (f"CASE WHEN {any_of(low, rules.NO_EXPERIENCE_WORDS)} THEN 0.0 "
            f"ELSE coalesce({', '.join(tries)}) END")


def level(y: str, t: str, lv: str) -> str:
    t, lv = f"lower({t})", f"lower({lv})"
    out = f"CASE WHEN {any_of(t, rules.INTERN_WORDS)} OR {any_of(lv, rules.INTERN_WORDS)} THEN 'intern' "
    out += " ".join(f"WHEN {any_of(t, w)} THEN {q(n)}" for n, w in rules.TITLE_LEVELS)
    out += (f" WHEN {y} = 0 THEN 'fresher' WHEN {y} < 3 THEN 'junior' WHEN {y} < 5 THEN 'mid' "
            f"WHEN {y} < 8 THEN 'senior' WHEN {y} IS NOT NULL THEN 'lead' ")
    out += " ".join(f"WHEN {any_of(lv, w)} THEN {q(n)}" for n, w in rules.FIELD_LEVELS)
    return out + " ELSE 'mid' END"


def abs_date(x: str) -> str:
    t = f"trim(coalesce({x}, ''))"
    shapes = [(r"\d{4}-\d{1,2}-\d{1,2}", "%Y-%m-%d"), (r"\d{1,2}/\d{1,2}/\d{4}", "%d/%m/%Y"),
              (r"\d{1,2}-\d{1,2}-\d{4}", "%d-%m-%Y"), (r"\d{4}/\d{1,2}/\d{1,2}", "%Y/%m/%d"),
              (r"\d{1,2} [A-Za-z]{3} \d{4}", "%d %b %Y"),
              (r"\d{1,2} [A-Za-z]{3,} \d{4}", "%d %B %Y"),
              (r"[A-Za-z]{3} \d{1,2}, \d{4}", "%b %d, %Y"),
              (r"[A-Za-z]{3,} \d{1,2}, \d{4}", "%B %d, %Y")]
    tries = [f"CASE WHEN regexp_full_match({t}, {q(s)}) THEN CAST(try_strptime({t}, {q(f)}) AS DATE) END"
             for s, f in shapes]
    iso = (f"CASE WHEN regexp_full_match({t}, '\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}T\\d{{1,2}}:\\d{{1,2}}:\\d{{1,2}}"
           f"(Z|[+-]\\d{{2}}:?\\d{{2}})?') THEN CAST(try_strptime(string_split({t}, 'T')[1], '%Y-%m-%d') AS DATE) END")
    return f"coalesce({', '.join(tries)}, {iso})"


def rel_date(x: str, ref: str) -> str:
    t = f"lower(coalesce({x}, ''))"
    out = (f"CASE WHEN {any_of(t, rules.TODAY_WORDS)} THEN {ref} "
           f"WHEN {any_of(t, rules.YESTERDAY_WORDS)} THEN {ref} - 1 ")
    for unit, days in [("(?:day|ngày|days)", 1), ("(?:week|tuần|weeks)", 7),
                       ("(?:month|tháng|months)", 30), ("(?:hour|giờ|hours|minute|phút|minutes)", 0)]:
        pat = rf"(\d+)\s*{unit}\s*(?:ago|trước)"
        n = f"TRY_CAST(regexp_extract({t}, {q(pat)}, 1) AS INTEGER)"
        out += f"WHEN {n} IS NOT NULL THEN {ref} - {n} * {days} "
    return out + "END"


def role(x: str, table=rules.DASHBOARD_ROLES, other=rules.DASHBOARD_ROLE_OTHER) -> str:
    return case_rules(f"lower({x})", table.items(), q(other))


def comma_list(x: str) -> str:
    return (f"list_filter(list_transform(string_split({x}, ','), lambda s: trim(s)), "
            f"lambda s: s <> '')")


RAW = f"""raw0 AS ({D.RAW_JOBS_SELECT.format(orders='orders', customer='customer')}),
raw_jobs AS (SELECT *, md5(lower(trim(url)) || '|' || lower(trim(job_title)) || '|' || lower(trim(company_name))) AS job_id FROM raw0)"""

VALID = r"""valid AS (SELECT * FROM raw_jobs WHERE trim(job_title) <> '' AND regexp_matches(url, '(?i)^https?://[^\s]+'))"""

CLEANED = f"""cleaned0 AS (SELECT * REPLACE ({remove_html('job_description')} AS job_description,
  {remove_html('benefits')} AS benefits, {clean('job_title')} AS job_title,
  {clean('company_name')} AS company_name, {clean('location')} AS location, {clean('salary')} AS salary,
  {clean('employment_type')} AS employment_type, {clean('job_level')} AS job_level) FROM valid),
cleaned AS (SELECT *, {company('company_name')} AS company_name_normalized,
  md5(url || job_title || company_name) AS job_hash FROM cleaned0)"""

DEDUP = """by_url AS (SELECT * FROM cleaned QUALIFY row_number() OVER (PARTITION BY url ORDER BY crawled_at, ingest_seq) = 1),
deduped AS (SELECT * FROM by_url QUALIFY row_number() OVER (
  PARTITION BY lower(trim(job_title)), lower(trim(company_name)) ORDER BY crawled_at, ingest_seq) = 1)"""


def parsed_salary(src: str, out: str, salary: str = "salary") -> str:
    """CTEs adding parsed_min/parsed_max to ``src``."""
    s = f"lower(trim({salary}))"
    nums = (f"list_filter(list_transform(regexp_extract_all(replace({s}, ',', ''), "
            f"'\\d+(?:\\.\\d+)?'), lambda v: CAST(v AS DOUBLE)), lambda v: v > 0)")
    up, lo = any_of(s, rules.UPPER_BOUND_WORDS), any_of(s, rules.LOWER_BOUND_WORDS)
    return f"""{out}_v AS (SELECT *, CASE WHEN NOT {negotiable(salary)} THEN {nums} END AS _v0,
  {any_of(s, rules.VND_WORDS)} AS _vnd FROM {src}),
{out}_u AS (SELECT *, CASE WHEN _vnd THEN list_transform(_v0, lambda v: v * (CASE WHEN list_max(_v0) < 1000 THEN 1e6 ELSE 1 END) / 25500)
  ELSE _v0 END AS _v FROM {out}_v),
{out}_r AS (SELECT *, CASE WHEN len(_v) = 1 AND {up} THEN _v[1] * 0.7 WHEN len(_v) = 1 THEN _v[1]
    WHEN len(_v) > 1 THEN least(_v[1], _v[2]) END AS _lo,
  CASE WHEN len(_v) = 1 AND NOT {up} AND {lo} THEN _v[1] * 1.4 WHEN len(_v) = 1 THEN _v[1]
    WHEN len(_v) > 1 THEN greatest(_v[1], _v[2]) END AS _hi FROM {out}_u),
{out} AS (SELECT * EXCLUDE (_v0, _vnd, _v, _lo, _hi),
  CASE WHEN _lo <= 50000 AND _hi >= 50 THEN {half_even('greatest(_lo, 50)', 2)} END AS parsed_min,
  CASE WHEN _lo <= 50000 AND _hi >= 50 THEN {half_even('least(_hi, 50000)', 2)} END AS parsed_max FROM {out}_r)"""


_RATE = "(CASE WHEN upper(salary_currency) = 'VND' THEN 1.0 / 25500 ELSE 1.0 END)"
_TRUST = f"(salary_min > 0 AND salary_max IS NOT NULL AND salary_min * {_RATE} BETWEEN 50 AND 50000)"


def full_salary(src: str, out: str) -> str:
    return f"""{parsed_salary(src, out + '_p')},
{out}_n AS (SELECT * EXCLUDE (parsed_min, parsed_max),
  CASE WHEN {_TRUST} THEN salary_min * {_RATE} ELSE parsed_min END AS salary_min_usd,
  CASE WHEN {_TRUST} THEN salary_max * {_RATE} ELSE parsed_max END AS salary_max_usd FROM {out}_p),
{out} AS (SELECT *, CASE WHEN salary_min_usd IS NOT NULL THEN 'USD' ELSE '' END AS salary_currency_norm,
  {half_even('(salary_min_usd + salary_max_usd) / 2', 2)} AS salary_midpoint_usd,
  salary_min_usd IS NOT NULL AS has_salary, {negotiable('salary')} AS is_negotiable FROM {out}_n)"""


_REMOTE = (f"({any_of('lower(location)', rules.REMOTE_LOCATION_WORDS)} "
           f"OR contains(lower(employment_type), 'remote'))")


def norm_skills(x: str) -> str:
    """Canonical list (before case-insensitive dedup) of a comma text."""
    return (f"list_transform({comma_list(x)}, lambda s: "
            f"coalesce({sql_map(rules.SKILL_LIST_ALIASES)}[lower(s)], s))")


def dedup_ci(x: str) -> str:
    low = f"list_transform({x}, lambda s: lower(s))"
    return f"list_filter({x}, lambda s, i: list_position({low}, lower(s)) = i)"


def title_years(t: str) -> str:
    t = f"lower({t})"
    return ("CASE " + " ".join(f"WHEN {any_of(t, w)} THEN {y}" for w, y in rules.TITLE_YEARS)
            + " END")


YEARS = (f"coalesce(experience_years, CASE WHEN length(job_description) > 10 THEN {years_of('job_description')} END, "
         f"CASE WHEN length(requirements) > 10 THEN {years_of('requirements')} END, "
         f"CASE WHEN length(benefits) > 10 THEN {years_of('benefits')} END, {title_years('job_title')})")

REF = "CAST(substr(crawled_at, 1, 10) AS DATE)"
SILVER = f"""{RAW}, {VALID}, {CLEANED}, {DEDUP},
{full_salary('deduped', 'sal')},
sk0 AS (SELECT *, {location('location')} AS location_normalized, {_REMOTE} AS is_remote,
  {norm_skills('skills_required')} AS _sk FROM sal),
sk AS (SELECT * EXCLUDE (_sk), {dedup_ci('_sk')} AS skills_normalized FROM sk0),
ex AS (SELECT *, array_to_string(skills_normalized, ', ') AS skills_str,
  CAST(len(skills_normalized) AS INTEGER) AS skill_count, {YEARS} AS experience_years_parsed FROM sk),
dt AS (SELECT *, {level('experience_years_parsed', 'job_title', 'job_level')} AS experience_level_inferred,
  coalesce({abs_date('posted_date')}, {rel_date('posted_date', REF)}) AS posted_date_dt,
  {abs_date('expiry_date')} AS expiry_date_dt FROM ex),
silver AS (SELECT *, CAST(greatest(date_diff('day', posted_date_dt, DATE '{D.AS_OF}'), 0) AS INTEGER) AS days_since_posted,
  CASE WHEN job_description <> '' THEN 'full' ELSE 'partial' END AS data_completeness,
  CASE WHEN expiry_date_dt IS NOT NULL THEN expiry_date_dt >= DATE '{D.AS_OF}'
       WHEN posted_date_dt BETWEEN DATE '{D.WINDOW_START}' AND DATE '{D.WINDOW_END}'
       THEN date_diff('day', posted_date_dt, DATE '{D.AS_OF}') <= 90 END AS is_active,
  posted_date_dt BETWEEN DATE '{D.WINDOW_START}' AND DATE '{D.WINDOW_END}' AS in_analysis_period FROM dt)"""

DASH_SKILLS = (
    "list_filter(list_transform(regexp_split_to_array(coalesce(skills_str, ''), '[;,\\n|]'), "
    "lambda s: regexp_replace(trim(lower(s)), '^[\"'']+|[\"'']+$', '', 'g')), "
    f"lambda s: s <> '' AND NOT list_contains({sql_list(rules.SOFT_SKILLS)}, s))")

GOLD = f"""{SILVER},
gold AS (SELECT *, {role('job_title')} AS role_category, {DASH_SKILLS} AS dash_skills,
  strftime(posted_date_dt, '%Y-%m') AS month,
  coalesce(CASE WHEN trim(location_normalized) <> '' THEN location_normalized END,
           CASE WHEN trim(location) <> '' THEN location END, 'Khác') AS city FROM silver),
gold_sal AS (SELECT * FROM gold WHERE salary_midpoint_usd > 0 AND salary_midpoint_usd < 10000)"""

CHART = f"""{SILVER},
chart AS (SELECT *, {role('job_title', rules.CHART_ROLES, rules.CHART_ROLE_OTHER)} AS role_category,
  coalesce({sql_map(rules.CITY_SYNONYMS)}[location_normalized], location_normalized, 'Other') AS city,
  coalesce({sql_map(rules.EMPLOYMENT_SYNONYMS)}[employment_type], employment_type) AS emp_type,
  {comma_list('skills_str')} AS chart_skills FROM silver),
chart_sal0 AS (SELECT * FROM chart WHERE has_salary AND salary_midpoint_usd > 0),
chart_sal AS (SELECT * FROM chart_sal0 WHERE salary_midpoint_usd <= (SELECT quantile_cont(salary_midpoint_usd, 0.99) FROM chart_sal0))"""


def over(ctes: str, select: str) -> str:
    select = select.strip()
    if select.startswith("WITH "):
        return f"WITH {ctes},\n{select[5:]}"
    return f"WITH {ctes}\n{select}"


def raw(select: str) -> str:
    return over(RAW, select)


def silver(select: str) -> str:
    return over(SILVER, select)


def gold(select: str) -> str:
    return over(GOLD, select)


def chart(select: str) -> str:
    return over(CHART, select)
