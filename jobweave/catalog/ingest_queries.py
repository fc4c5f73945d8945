"""Registered queries: sources and sinks (A) and ingest (B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobweave import rules
from jobweave import schema as S
from jobweave.catalog import layers as L
from jobweave.catalog import oracle as O
from jobweave.catalog.registry import query
from jobweave.functions import dates, experience, roles, skills
from jobweave.functions import salary as sal
from jobweave.functions import text as tx
from jobweave.operators import extract as X
from jobweave.operators import gold as G
from jobweave.operators import ingest as I
from jobweave.operators import market as M
from jobweave.plans import silver as plan
from jobweave.plans import warehouse
from jobweave.sources import derived as D
from jobweave.sources import readers, writers
from jobweave.sources.seen import SeenIds, append_unseen

WINDOW = dict(as_of=D.AS_OF, start=D.WINDOW_START, end=D.WINDOW_END)
_J = lambda c, n=None: F.array_join(c, "|").alias(n or c)


def _fresh(spark, d, name):
    """A new folder for a sink query."""
    import uuid

    return f"{warehouse.stage_path(spark, d, name)}-{uuid.uuid4().hex[:8]}"


# -- A ---------------------------------------------------------------------------------
@query("a1_jsonl_round_trip", O.raw("""SELECT ingest_seq, job_title, salary_min, location, skills_required, 'boardX' AS file_source,
  '2001-08-02' AS crawl_date FROM raw_jobs"""))
def _(spark, d):
    from pyspark.sql import types as T

    path = _fresh(spark, d, "boardX_jobs_2001_08_02.jsonl")
    raw = L.raw(spark, d)
    # one unreadable line and one blank line next to the records
    lines = raw.select(F.to_json(F.struct("ingest_seq", *[c for c in S.BRONZE.names if c in raw.columns])).alias("value"))
    bad = spark.range(1).select(F.explode(F.array(F.lit("{not json"), F.lit(""))).alias("value"))
    lines.unionByName(bad).write.text(path)
    schema = T.StructType([T.StructField("ingest_seq", T.LongType()), *S.BRONZE.fields])
    df = readers.read_postings(spark, path, schema)
    named = readers.dated_file_columns(F.regexp_extract(F.input_file_name(), r"([^/]+_jobs_[^/]+)/[^/]*$", 1))
    return df.select("ingest_seq", "job_title", "salary_min", "location", "skills_required",
                     named["file_source"].alias("file_source"), named["crawl_date"].cast("string").alias("crawl_date"))


@query("a2_parquet_or_csv", O.silver("SELECT job_hash, salary_midpoint_usd, skill_count FROM silver"))
def _(spark, d):
    csv = _fresh(spark, d, "silver_csv")
    df = L.silver(spark, d)
    writers.write_csv(df, csv)
    return readers.read_table(spark, csv + "-missing.parquet", csv).select(
        "job_hash", F.col("salary_midpoint_usd").cast("double").alias("salary_midpoint_usd"), F.col("skill_count").cast("int").alias("skill_count"))


@query("a3_csv_round_trip", "SELECT doc_id, text || chr(10) || '\"q\", x' AS body FROM documents")
def _(spark, d):
    path = _fresh(spark, d, "docs_csv")
    docs = L.table(spark, d, "documents").select("doc_id", F.concat("text", F.lit('\n"q", x')).alias("body"))
    writers.write_csv(docs, path)
    return readers.read_csv(spark, path, "doc_id bigint, body string")


@query("a4_load_defaults", """
SELECT event_id, coalesce(CASE WHEN event_type = 'error' THEN NULL ELSE event_type END, '') AS job_title, 'Không rõ' AS company_name, '' AS skills_str,
  'Không rõ' AS source_website, 'unknown' AS experience_level_inferred, TRY_CAST(CASE WHEN event_id % 3 = 0 THEN 'n/a' ELSE CAST(event_id AS VARCHAR) END AS DOUBLE) AS salary_midpoint_usd,
  user_id % 2 = 1 AS is_remote FROM events""")
def _(spark, d):
    ev = L.table(spark, d, "events").select(
        "event_id", F.when(F.col("event_type") != "error", F.col("event_type")).alias("job_title"),
        F.when(F.col("event_id") % 3 == 0, "n/a").otherwise(F.col("event_id").cast("string")).alias("salary_midpoint_usd"),
        F.when(F.col("user_id") % 2 == 1, "Yes").otherwise("no").alias("is_remote"))
    return G.load_defaults(ev)


@query("a5_parquet_sink", O.silver("SELECT source_website, count(*) AS n FROM silver GROUP BY 1"))
def _(spark, d):
    path = _fresh(spark, d, "sink_parquet")
    writers.write_parquet(L.silver(spark, d), path, ["source_website"])
    return spark.read.parquet(path).groupBy("source_website").agg(F.count("*").alias("n"))


@query("a6_csv_sink", O.silver("SELECT job_hash, CAST(posted_date_dt AS VARCHAR) AS posted_date_dt FROM silver"))
def _(spark, d):
    path = _fresh(spark, d, "sink_csv")
    writers.write_csv(L.silver(spark, d).select("job_hash", "posted_date_dt"), path)
    return readers.read_csv(spark, path, "job_hash string, posted_date_dt string")


@query("a7_report_columns", O.gold("""SELECT job_title, company_name, city, role_category, experience_level_inferred, salary_midpoint_usd, skills_str,
  source_website, CAST(posted_date_dt AS VARCHAR) AS posted_date_dt, url FROM gold"""))
def _(spark, d):
    return G.report_columns(L.gold(spark, d)).withColumn("posted_date_dt", F.col("posted_date_dt").cast("string"))


@query("a8_cleaned_subset", O.silver("SELECT job_hash FROM silver WHERE trim(job_title) <> '' AND trim(company_name) <> '' AND url IS NOT NULL"))
def _(spark, d):
    return plan.cleaned_subset(L.silver(spark, d)).select("job_hash")


@query("a9_raw_line_counts", O.raw("SELECT source_website, count(*) AS n FROM raw_jobs GROUP BY 1"))
def _(spark, d):
    path = _fresh(spark, d, "dated")
    raw = L.raw(spark, d)
    dated = raw.select(F.concat("source_website", F.lit("_jobs_2001_08_02.jsonl")).alias("file"), F.to_json(F.struct("ingest_seq", "job_title")).alias("value"))
    dated.write.partitionBy("file").text(path)
    name = F.regexp_extract(F.input_file_name(), r"file=([^/]+)/", 1)
    lines = spark.read.text(path, recursiveFileLookup=True).where(F.trim("value") != "")
    return lines.groupBy(readers.dated_file_columns(name)["file_source"].alias("source_website")).agg(F.count("*").alias("n"))


@query("a10_dated_files", """SELECT event_id, event_type AS file_source, CAST(CAST(ts AS DATE) AS VARCHAR) AS crawl_date,
  CASE WHEN event_type IS NOT NULL AND ts IS NOT NULL THEN concat(event_type, '_jobs_', strftime(ts, '%Y_%m_%d')) END AS file FROM events""")
def _(spark, d):
    path = _fresh(spark, d, "dated_files")
    events = L.table(spark, d, "events").select("event_id", "event_type", F.col("ts").cast("date").alias("day"))
    writers.write_dated(events, path, "event_type", "day")
    return readers.read_dated(spark, path, "event_id bigint, file string").select(
        "event_id", "file_source", F.col("crawl_date").cast("string").alias("crawl_date"), "file")


# documents in four encodings; bytes that are no UTF-8 decide for the code page, byte 81 (no letter there) against it
# documents in four encodings; of the last two the tail is no UTF-8, and byte 81 has no letter in windows-1258
@query("a12_resume_encodings", """SELECT doc_id, CASE
    WHEN doc_id % 4 < 2 OR regexp_matches(text, '[^\\x{0}-\\x{FF}]') THEN text
    WHEN doc_id % 4 = 2 THEN concat(translate(text, 'ÃÌÐÒÕÝÞãìðòõýþ',
        concat('Ă', chr(768), 'Đ', chr(777), 'ƠƯ', chr(771), 'ă', chr(769), 'đ', chr(803), 'ơư₫')), ' năm ', chr(769), ' đơn vi', chr(803), ': 5 €')
    ELSE concat(text, ' caf', chr(129), 'é') END AS body FROM documents""")
def _(spark, d):
    docs = D.documents(spark, d)
    latin = F.when(~F.col("text").rlike(r"[^\x{0}-\x{FF}]"), F.encode("text", "ISO-8859-1"))
    tail = lambda hexa: F.unhex(F.lit(hexa))
    page = F.concat(latin, tail("206EE36D20EC20F0F56E2076"), tail("69F23A20352080"))
    body = F.encode("text", "UTF-8")
    content = (F.when((F.col("doc_id") % 4 == 0) | latin.isNull(), F.concat(tail("EFBBBF"), body))
               .when(F.col("doc_id") % 4 == 1, body)
               .when(F.col("doc_id") % 4 == 2, page).otherwise(F.concat(latin, tail("20636166" + "81" + "E9"))))
    return docs.select("doc_id", tx.decode_text(content).alias("body"))


@query("a11_append_new", "SELECT o_orderkey, o_custkey FROM orders")
def _(spark, d):
    path = _fresh(spark, d, "append")
    orders = L.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    writers.append_new(spark, orders.where("o_orderstatus = 'F'"), path, "o_orderkey")
    writers.append_new(spark, orders, path, "o_orderkey")
    return spark.read.parquet(path).select("o_orderkey", "o_custkey")


@query("f6_anti_join_id_store", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def _(spark, d):
    out = _fresh(spark, d, "unseen")
    store = SeenIds(out + "-ids", "o_orderkey", "bigint", merge_at=1)
    orders = L.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    for number, batch in enumerate([orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus <> 'P'"), orders]):
        append_unseen(batch, out, store, number)
    return spark.read.parquet(out).drop("batch")


@query("a13_overview_summary", O.gold("""
SELECT * FROM (SELECT 'role' AS grp, role_category AS label, count(*) AS value FROM gold GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'city', city, count(*) AS n FROM gold GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'skill', s, count(*) AS n FROM (SELECT unnest(dash_skills) AS s FROM gold) GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10)"""))
def _(spark, d):
    return M.labelled_summary(L.gold(spark, d), 10)


# -- B: pages with JSON-LD made from the postings ----------------------------------------
# one posting object; list, @graph, broken-then-good and single by turns
LD_SELECT = r"""
SELECT ingest_seq, url, job_title, company_name, location, employment_type, skills_required, job_description, benefits, posted_date, salary_min, salary_max,
  concat('{"@context":"https://schema.org","@type":"JobPosting","title":"', job_title, '","hiringOrganization":{"name":"', company_name,
    '"},"jobLocation":', CASE WHEN ingest_seq % 3 = 0 THEN '[' ELSE '' END, '{"address":{"addressRegion":"', location, '","addressLocality":"Quarter"}}',
    CASE WHEN ingest_seq % 3 = 0 THEN ',{"address":{"addressRegion":"","addressLocality":"Second"}}]' ELSE '' END,
    ',"employmentType":', CASE WHEN ingest_seq % 2 = 0 THEN '["PART_TIME"]' ELSE '"FULL_TIME"' END,
    ',"skills":"', skills_required, '","description":"', job_description, '","jobBenefits":"', benefits, '","datePosted":"', posted_date,
    '","validThrough":"2001-09-30T00:00:00","experienceRequirements":', CASE WHEN ingest_seq % 5 = 0 THEN '"3-5 years experience"' ELSE '{"monthsOfExperience":30}' END,
    ',"baseSalary":{"currency":"USD","value":{"minValue":', CAST(CAST(100 + ingest_seq % 900 AS INT) AS VARCHAR(12)), ',"maxValue":',
    CAST(CAST(1000 + ingest_seq % 900 AS INT) AS VARCHAR(12)), '}}}') AS obj
FROM {raw}"""
PAGE_SELECT = """
SELECT *, concat('<html><head><script>var a=1;</script>', CASE WHEN ingest_seq % 4 = 3 THEN '<script type="application/ld+json">{broken</script>' ELSE '' END,
  '<script type="application/ld+json">', CASE ingest_seq % 4 WHEN 1 THEN concat('[{"@type":"Other"},', obj, ']') WHEN 2 THEN concat('{"@graph":[', obj, ']}') ELSE obj END,
  '</script></head><body>x</body></html>') AS html FROM {ld}"""
LD = f"{O.RAW}, ld AS ({LD_SELECT.replace('{raw}', 'raw_jobs')})"


def _braces(sql, name):
    """Only ``{name}`` is a parameter; the JSON braces are text."""
    return sql.replace("{", "{{").replace("}", "}}").replace("{{" + name + "}}", "{" + name + "}")


def ld_pages(spark, d):
    ld = spark.sql(_braces(LD_SELECT, "raw"), raw=L.raw(spark, d))
    return spark.sql(_braces(PAGE_SELECT, "ld"), ld=ld)


def ld(spark, d):
    return X.with_json_ld(ld_pages(spark, d).select("ingest_seq", "html"))


@query("b1_json_ld_extraction", O.over(LD, "SELECT ingest_seq, job_title AS title, company_name AS org FROM ld"))
def _(spark, d):
    get = lambda p: F.try_variant_get(F.col("ld"), p, "string")
    return ld(spark, d).select("ingest_seq", get("$.title").alias("title"), get("$.hiringOrganization.name").alias("org"))


@query("b1_pages_without_json_ld", "SELECT page_id FROM pages WHERE contains(html, 'ld+json')")
def _(spark, d):
    return X.with_json_ld(L.table(spark, d, "pages")).select("page_id")


_ALL = list(dict.fromkeys(s for g in rules.SKILL_TAXONOMY.values() for s in g))
_SCAN = ", ".join(f"CASE WHEN regexp_matches(b, {O.q(chr(92) + 'b' + __import__('re').escape(s.lower()) + chr(92) + 'b')}) THEN {O.q(s)} END" for s in _ALL)
_FOUND = f"list_filter([{_SCAN}], lambda s: s IS NOT NULL)"


def _level(source, x="job_title"):
    return O.case_rules(f"lower({x})", rules.SOURCE_LEVEL_RULES[source], O.q(rules.SOURCE_LEVEL_DEFAULT))


_NUMS = "list_transform(regexp_extract_all(salary, '\\d[\\d,\\.]*'), lambda v: TRY_CAST(replace(v, ',', '') AS DOUBLE))"
_P = "lower(strip_accents(trim(salary)))"
_VAGUE = O.any_of(_P, [sal.strip_plain(w) for w in rules.INGEST_NEGOTIABLE_WORDS])
_USD = f"(contains(salary, '$') OR contains({_P}, 'usd'))"
_SCALE = f"(CASE WHEN {_USD} THEN 1 ELSE 1e6 END)"


_LOC = "trim(location)"
_PAY = "CAST(100 + ingest_seq % 900 AS INT) || '-' || CAST(1000 + ingest_seq % 900 AS INT) || ' USD' AS salary"


@query("b2_posting_source_a", O.over(LD, f"""
SELECT ingest_seq, trim(job_title) AS job_title, {_level('itviec', 'trim(job_title)')} AS job_level, company_name, CAST(100 + ingest_seq % 900 AS DOUBLE) AS salary_min,
  CAST(1000 + ingest_seq % 900 AS DOUBLE) AS salary_max, 'USD' AS salary_currency, '2001-09-30T00:00:00' AS expiry_date,
  CASE WHEN {_LOC} = '' THEN 'Quarter' ELSE {_LOC} END || CASE WHEN ingest_seq % 3 = 0 THEN ', Second' ELSE '' END AS location,
  CASE WHEN ingest_seq % 2 = 0 THEN 'Part Time' ELSE 'Full Time' END AS employment_type, array_to_string({O.comma_list('skills_required')}, '|') AS skills_required,
  {O.strip_html('job_description')} AS job_description, {O.strip_html('benefits')} AS benefits, posted_date, 'IT / Technology' AS industry FROM ld"""))
def _(spark, d):
    return X.posting_from_ld_a(ld(spark, d), "ingest_seq").select(
        "ingest_seq", "job_title", "job_level", "company_name", "salary_min", "salary_max", "salary_currency", "expiry_date", "location",
        "employment_type", _J("skills_required"), "job_description", "benefits", "posted_date", "industry")


@query("b3_posting_source_b", O.over(LD, f"""
SELECT ingest_seq, job_title, {_level('careerviet')} AS job_level, company_name, 'Quarter' AS location, {_PAY}, CAST(100 + ingest_seq % 900 AS DOUBLE) AS salary_min,
  CAST(1000 + ingest_seq % 900 AS DOUBLE) AS salary_max, 'USD' AS salary_currency, CASE WHEN ingest_seq % 2 = 0 THEN 'Part-time' ELSE 'Full-time' END AS employment_type,
  array_to_string(CASE WHEN skills_required = '' THEN {_FOUND} ELSE {O.comma_list('skills_required')} END, '|') AS skills_required,
  CAST(CASE WHEN ingest_seq % 5 = 0 THEN 3.0 ELSE 2.5 END AS DOUBLE) AS experience_years, body AS job_description, benefits,
  substr(posted_date, 1, 10) AS posted_date, '2001-09-30' AS expiry_date, 'IT / Technology' AS industry
FROM (SELECT *, {O.strip_html('job_description')} AS body, lower(body) AS b FROM ld)"""))
def _(spark, d):
    return X.posting_from_ld_b(ld(spark, d), "ingest_seq").select(
        "ingest_seq", "job_title", "job_level", "company_name", "location", "salary", "salary_min", "salary_max", "salary_currency", "employment_type",
        _J("skills_required"), "experience_years", "job_description", "benefits", "posted_date", "expiry_date", "industry")


@query("b4_overlay_source_c", O.over(LD, f"""
SELECT ingest_seq, nullif({O.strip_html('job_description')}, '') AS job_description, nullif({O.strip_html('benefits')}, '') AS benefits, {_PAY},
  CAST(100 + ingest_seq % 900 AS DOUBLE) AS salary_min, CAST(1000 + ingest_seq % 900 AS DOUBLE) AS salary_max, 'USD' AS salary_currency,
  CASE WHEN ingest_seq % 2 = 0 THEN 'Part-time' ELSE 'Full-time' END AS employment_type, array_to_string({O.comma_list('skills_required')}, '|') AS skills_required,
  CAST(CASE WHEN ingest_seq % 5 <> 0 THEN 2.5 END AS DOUBLE) AS experience_years, nullif(substr(posted_date, 1, 10), '') AS posted_date,
  '2001-09-30' AS expiry_date FROM ld"""))
def _(spark, d):
    return X.overlay_from_ld_c(ld(spark, d), "ingest_seq").select(
        "ingest_seq", "job_description", "benefits", "salary", "salary_min", "salary_max", "salary_currency", "employment_type",
        _J("skills_required"), "experience_years", "posted_date", "expiry_date")


# records under the newer names with lists of objects, and (odd numbers) under the older ones with lists of strings
@query("b5_api_records", O.raw(f"""
SELECT ingest_seq, regexp_replace(url, '\\?.*$', '') AS url, trim(job_title) AS job_title, company_name, location, salary,
  CASE WHEN salary_min > 0 THEN salary_min ELSE lo END AS salary_min, CASE WHEN salary_min > 0 THEN salary_max ELSE hi END AS salary_max,
  CASE WHEN salary_min > 0 THEN 'USD' ELSE currency END AS salary_currency,
  coalesce({O.sql_map({str(k): v for k, v in rules.WORKING_TYPE_CODES.items()})}[CAST(ingest_seq % 8 AS VARCHAR)], 'Full-time') AS employment_type,
  array_to_string({O.comma_list('skills_required')}, '|') AS skills_required, CASE WHEN benefits <> '' THEN 'Perk: ' || {O.strip_html('benefits')} || '; Gym' ELSE 'Perk; Gym' END AS benefits,
  {O.strip_html('job_description')} AS job_description, substr(posted_date, 1, 10) AS posted_date, industry, {_level('vietnamworks', "job_level || ' ' || trim(job_title)")} AS job_level
FROM (SELECT *, CASE WHEN {_VAGUE} THEN 'negotiable' WHEN {_USD} THEN 'USD' ELSE 'VND' END AS currency,
    CASE WHEN NOT {_VAGUE} AND len({_NUMS}) > 0 THEN least({_NUMS}[1], {_NUMS}[-1]) * {_SCALE} END AS lo,
    CASE WHEN NOT {_VAGUE} AND len({_NUMS}) > 0 THEN greatest({_NUMS}[1], {_NUMS}[-1]) * {_SCALE} END AS hi
  FROM (SELECT * REPLACE (CASE WHEN salary = '' THEN 'Thỏa thuận' ELSE salary END AS salary) FROM raw_jobs WHERE trim(job_title) <> ''))"""))
def _(spark, d):
    raw = L.raw(spark, d)
    url = F.when(F.col("url") == "n/a", "https://n/a").otherwise(F.concat("url", F.lit("?src=api")))
    listed = skills.parse_skill_list("skills_required")
    perk = tx.strip_html("benefits")
    same = ["salary_min AS salaryMin", "salary_max AS salaryMax", "posted_date AS approvedOn", "CAST(ingest_seq % 8 AS INT) AS typeWorkingId",
            "array(named_struct('cityName', location)) AS workingLocations", "job_description AS jobDescription"]
    same = [F.expr(e) for e in same]
    newer = F.to_json(F.struct(
        F.col("job_title").alias("jobTitle"), F.col("company_name").alias("companyName"), url.alias("jobUrl"), F.col("job_level").alias("jobLevel"),
        F.col("salary").alias("prettySalary"), F.transform(listed, lambda s: F.struct(s.alias("skillName"))).alias("skills"),
        F.array(F.struct(F.lit("Perk").alias("benefitName"), perk.alias("benefitValue")),
                F.struct(F.lit("Gym").alias("benefitName"), F.lit("").alias("benefitValue"))).alias("benefits"),
        F.array(F.struct(F.col("industry").alias("industryV3Name"))).alias("industriesV3"), *same))
    older = F.to_json(F.struct(
        F.col("job_title").alias("title"), F.col("company_name"), url.alias("canonical"), F.col("job_level").alias("jobLevelVI"),
        F.col("salary").alias("prettySalaryVI"), listed.alias("skills"),
        F.array(F.when(perk != "", F.concat(F.lit("Perk: "), perk)).otherwise("Perk"), F.lit("Gym")).alias("benefits"),
        F.array(F.struct(F.col("industry").alias("name"))).alias("industries"), *same))
    rec = F.when(F.col("ingest_seq") % 2 == 1, older).otherwise(newer)
    out = X.posting_from_api(raw.select("ingest_seq", F.col("url").alias("u"), rec.alias("record")))
    return out.select("ingest_seq", F.when(F.col("u") == "n/a", "n/a").otherwise(F.col("url")).alias("url"), "job_title", "company_name", "location",
                      "salary", "salary_min", "salary_max", "salary_currency", "employment_type", _J("skills_required"), "benefits",
                      "job_description", "posted_date", "industry", "job_level")


@query("b6_html_to_text", f"SELECT page_id, {O.strip_html('html')} AS body FROM pages")
def _(spark, d):
    return L.table(spark, d, "pages").select("page_id", tx.strip_html("html").alias("body"))


_MARKED = ["<p>Caf&eacute; &#233; &#xE9; l&agrave;m vi&#7879;c</p> &amp;lt; 1 < ", " &ndash; &nope; &#128512;&#xD800;&nbsp;<br/>&copy;&#39;&quot;"]
_PLAIN = ["Café é é làm việc &lt; 1 < ", " – &nope; 😀\ufffd ©'\""]


@query("b6_html_entities", f"SELECT o_orderkey, {O.q(_PLAIN[0])} || o_orderkey || {O.q(_PLAIN[1])} AS body FROM orders")
def _(spark, d):
    html = F.concat(F.lit(_MARKED[0]), F.col("o_orderkey").cast("string"), F.lit(_MARKED[1]))
    return L.table(spark, d, "orders").select("o_orderkey", tx.strip_html(html).alias("body"))


@query("b7_canonical_url", """SELECT page_id, regexp_replace(url, '\\?.*$', '') AS canonical, regexp_matches(url, '(?i)^https?://[^/?#]+') AS valid,
  'https://x.org' || regexp_replace('/p?id=' || page_id, '\\?.*$', '') AS resolved FROM pages""")
def _(spark, d):
    rel = F.concat(F.lit("/p?id="), F.col("page_id").cast("string"))
    return L.table(spark, d, "pages").select("page_id", tx.canonical_url("url").alias("canonical"), tx.is_valid_url("url").alias("valid"),
                                             tx.canonical_url(rel, "https://x.org").alias("resolved"))


# a title of nothing but a place or a code keeps it
@query("b8_clean_title", O.raw("""SELECT ingest_seq, trim(job_title) AS a, CASE WHEN trim(job_title) = '' THEN 'Dong Da,' ELSE trim(job_title) END AS b,
  CASE WHEN trim(job_title) = '' THEN 'JOB-42' ELSE trim(job_title) END AS c FROM raw_jobs"""))
def _(spark, d):
    df = L.raw(spark, d)
    noisy = lambda p: X.clean_title(F.concat(F.lit(p), F.col("job_title")))
    return df.select("ingest_seq", noisy("[HN] ").alias("a"), noisy("Dong Da, ").alias("b"), noisy("JOB-42 ").alias("c"))


_PHRASES = "coalesce(" + ", ".join(f"nullif(regexp_extract(job_description, {O.q('(?i)' + p)}, 0), '')" for p in rules.EXPERIENCE_PHRASES) + ", '')"


@query("b9_experience_phrase", O.raw(f"SELECT ingest_seq, trim({_PHRASES}) AS phrase FROM raw_jobs"))
def _(spark, d):
    return L.raw(spark, d).select("ingest_seq", experience.experience_phrase("job_description").alias("phrase"))


@query("b10_phrase_years", O.raw(f"""SELECT ingest_seq, TRY_CAST(nullif(regexp_extract(p, '\\d+(?:\\.\\d+)?', 0), '') AS DOUBLE) AS years,
  CAST(NULL AS DOUBLE) AS bare FROM (SELECT ingest_seq, trim({_PHRASES}) AS p FROM raw_jobs)"""))
def _(spark, d):
    return L.raw(spark, d).select("ingest_seq", experience.phrase_years(experience.experience_phrase("job_description")).alias("years"),
                                  experience.phrase_years(F.col("ingest_seq").cast("string")).alias("bare"))


@query("b11_taxonomy_scan", O.raw(f"""
SELECT ingest_seq, array_to_string(list_filter(every, lambda s, i: list_position(every, s) = i), '|') AS found
FROM (SELECT ingest_seq, list_concat({_FOUND}, CASE WHEN contains(job_title, '(') THEN ['Spark', 'Airflow'] ELSE [] END) AS every
  FROM (SELECT ingest_seq, job_title, lower(job_title || ' ' || job_description || ' ' || skills_required || ' ' || {O.q(", ".join(_ALL[::3]))}) AS b FROM raw_jobs))"""))
def _(spark, d):
    # more names than any list of one page
    many = F.concat_ws(" ", "job_description", "skills_required", F.lit(", ".join(_ALL[::3])))
    return L.raw(spark, d).select("ingest_seq", F.array_join(skills.taxonomy_scan("job_title", many), "|").alias("found"))


_BODY = "concat('Mô tả công việc ', job_description, ' Yêu cầu công việc ', skills_required, ' Quyền lợi ', benefits, ' Cập nhật gần nhất x Thông tin chung y')"


def _body(df):
    return df.withColumn("body", F.concat(F.lit("Mô tả công việc "), "job_description", F.lit(" Yêu cầu công việc "), "skills_required",
                                          F.lit(" Quyền lợi "), "benefits", F.lit(" Cập nhật gần nhất x Thông tin chung y")))


@query("b12_section_slice", O.raw("SELECT ingest_seq, trim(job_description) AS description, trim(skills_required) AS requirements FROM raw_jobs"))
def _(spark, d):
    return _body(L.raw(spark, d)).select(
        "ingest_seq", X.section("body", "mô tả công việc", ["yêu cầu công việc", "quyền lợi"]).alias("description"),
        X.section("body", "yêu cầu công việc", ["quyền lợi", "thông tin chung"]).alias("requirements"))


@query("b13_trim_benefits", O.raw("SELECT ingest_seq, trim(benefits) AS cut, trim(benefits) AS tail FROM raw_jobs"))
def _(spark, d):
    df = L.raw(spark, d)
    return df.select("ingest_seq", X.trim_benefits(F.concat("benefits", F.lit(" Cập nhật gần nhất: hôm nay"))).alias("cut"),
                     X.trim_benefits(F.concat("benefits", F.lit(" Xem thêm Nộp hồ sơ"))).alias("tail"))


@query("b14_deadline", O.raw("SELECT ingest_seq, CASE WHEN regexp_matches(expiry_date, '^\\d') THEN expiry_date ELSE '' END AS deadline FROM raw_jobs"))
def _(spark, d):
    return L.raw(spark, d).select("ingest_seq", X.deadline(F.concat(F.lit("Hạn nộp hồ sơ "), "expiry_date", F.lit(" nhé"))).alias("deadline"))


@query("b15_card_metadata", O.raw("""
SELECT ingest_seq, CASE WHEN contains(lower(location), 'hà nội') THEN 'Hà Nội' WHEN contains(lower(location), 'hồ chí minh') THEN 'Hồ Chí Minh'
  WHEN contains(lower(location), 'đà nẵng') THEN 'Đà Nẵng' WHEN contains(lower(location), 'cần thơ') THEN 'Cần Thơ'
  WHEN contains(lower(location || employment_type), 'remote') THEN 'Remote' WHEN contains(lower(location), 'da nang') THEN 'Da Nang' WHEN contains(lower(location), 'hanoi') THEN 'Hanoi'
  WHEN contains(lower(location), 'hcm') THEN 'HCM' ELSE '' END AS location,
  CASE WHEN regexp_matches(lower(employment_type), 'fulltime|full.time') THEN 'Full-time' WHEN regexp_matches(lower(employment_type), 'part.time') THEN 'Part-time'
    WHEN contains(lower(location || employment_type), 'remote') THEN 'Remote' ELSE 'Full-time' END AS employment_type,
  CASE WHEN contains(posted_date, 'days') THEN posted_date ELSE '' END AS posted_date,
  array_to_string(list_filter(every, lambda s, i: list_position(every, s) = i), '|') AS skills_required
FROM (SELECT *, list_concat("""  + _FOUND + """, CASE WHEN contains(job_title, '(') THEN ['Spark', 'Airflow'] ELSE [] END) AS every
  FROM (SELECT *, lower(location || ' ' || employment_type || ' ' || skills_required || ' ' || posted_date) AS b FROM raw_jobs))"""))
def _(spark, d):
    df = L.raw(spark, d).withColumn("card", F.concat_ws(" ", "job_title", "company_name", "salary", "location", "employment_type", "skills_required", "posted_date"))
    m = X.card_metadata("card", "job_title", "company_name", "salary")
    return df.select("ingest_seq", *[m[k].alias(k) for k in ("location", "employment_type", "posted_date")], F.array_join(m["skills_required"], "|").alias("skills_required"))


@query("b16_source_level", O.raw("SELECT ingest_seq, CASE source_website " + " ".join(
    f"WHEN {O.q(src)} THEN {O.case_rules('lower(job_title)', lv, O.q(rules.SOURCE_LEVEL_DEFAULT))}" for src, lv in rules.SOURCE_LEVEL_RULES.items())
    + " ELSE 'Mid-level' END AS job_level FROM raw_jobs"))
def _(spark, d):
    return L.raw(spark, d).select("ingest_seq", experience.source_level().alias("job_level"))


@query("b17_ingest_salary", O.raw(f"""
SELECT ingest_seq, CASE WHEN salary = '' THEN '' WHEN {_VAGUE} THEN 'negotiable' WHEN {_USD} THEN 'USD' ELSE 'VND' END AS ingest_currency,
  CASE WHEN salary <> '' AND NOT {_VAGUE} AND len({_NUMS}) > 0 THEN least({_NUMS}[1], {_NUMS}[-1]) * {_SCALE} END AS ingest_min,
  CASE WHEN salary <> '' AND NOT {_VAGUE} AND len({_NUMS}) > 0 THEN greatest({_NUMS}[1], {_NUMS}[-1]) * {_SCALE} END AS ingest_max FROM raw_jobs"""))
def _(spark, d):
    return sal.with_ingest_salary(L.raw(spark, d)).select("ingest_seq", "ingest_currency", "ingest_min", "ingest_max")


@query("b18_strip_diacritics", O.raw("SELECT ingest_seq, strip_accents(location) AS location, strip_accents(lower(salary)) AS salary FROM raw_jobs"))
def _(spark, d):
    return L.raw(spark, d).select("ingest_seq", tx.strip_diacritics("location").alias("location"), tx.strip_diacritics(F.lower("salary")).alias("salary"))


@query("b19_job_id", O.raw("SELECT ingest_seq, job_id FROM raw_jobs"))
def _(spark, d):
    return L.raw(spark, d).select("ingest_seq", tx.job_id().alias("job_id"))


_REL = (f"({O.any_of('lower(job_title)', [t.lower() for t in rules.VALID_JOB_TITLES])} OR {O.any_of('lower(job_title)', rules.VALID_JOB_KEYWORDS)} "
        f"OR {O.any_of('lower(job_description)', rules.VALID_JOB_KEYWORDS)})")


@query("b20_relevance_filter", O.raw(f"SELECT ingest_seq, job_title FROM raw_jobs WHERE {_REL}"))
def _(spark, d):
    return L.raw(spark, d).where(I.is_relevant()).select("ingest_seq", "job_title")


@query("b21_list_coercion", O.raw(f"SELECT ingest_seq, array_to_string({O.comma_list('skills_required')}, '|') AS items FROM raw_jobs"))
def _(spark, d):
    return L.raw(spark, d).select("ingest_seq", F.array_join(tx.comma_list("skills_required"), "|").alias("items"))


@query("b22_absolute_date", "SELECT o_orderkey, " + ", ".join(
    f"CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS d{i}" for i in range(11)) + " FROM orders")
def _(spark, d):
    formats = ["yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy", "yyyy/MM/dd", "dd MMM yyyy", "dd MMMM yyyy", "MMM dd, yyyy", "MMMM dd, yyyy",
               "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss'+07:00'"]
    return L.table(spark, d, "orders").select("o_orderkey", *[
        dates.parse_absolute_date(F.date_format("o_orderdate", f)).cast("string").alias(f"d{i}") for i, f in enumerate(formats)])


@query("b23_relative_date", "SELECT event_id, " + ", ".join(
    f"CAST(CAST(ts AS DATE) - CAST({n} AS INTEGER) AS VARCHAR) AS {c}" for c, n in (
        ("days", "user_id % 9"), ("weeks", "7 * (user_id % 9)"), ("months", "30 * (user_id % 9)"), ("hours", "0"), ("today", "0"), ("yesterday", "1")))
       + ", CAST(NULL AS VARCHAR) AS nothing FROM events")
def _(spark, d):
    ref, n = F.to_date("ts"), (F.col("user_id") % 9).cast("string")
    p = lambda c, name: dates.parse_relative_date(c, ref).cast("string").alias(name)
    return D.events(spark, d).select(
        "event_id", p(F.concat(n, F.lit(" days ago")), "days"), p(F.concat(n, F.lit(" tuần trước")), "weeks"), p(F.concat(n, F.lit(" months ago")), "months"),
        p(F.concat(n, F.lit(" hours ago")), "hours"), p(F.lit("Hôm nay"), "today"), p(F.lit("yesterday"), "yesterday"), p(F.lit("soon"), "nothing"))


_PD = f"coalesce({O.abs_date('posted_date')}, {O.rel_date('posted_date', O.REF)})"
FLAGS = f"""{O.RAW}, fl0 AS (SELECT *, {O.abs_date('posted_date')} AS ex, {_PD} AS p, {O.abs_date('expiry_date')} AS e FROM raw_jobs),
fl AS (SELECT *, CASE WHEN NOT (p BETWEEN DATE '{D.WINDOW_START}' AND DATE '{D.WINDOW_END}') THEN 'out_of_range' WHEN ex IS NOT NULL THEN 'exact'
    WHEN p IS NOT NULL THEN 'estimated' ELSE 'unknown' END AS posted_date_status,
  CASE WHEN e < DATE '{D.AS_OF}' THEN 'expired' WHEN e IS NOT NULL THEN 'known' ELSE 'unknown' END AS expiry_date_status,
  CASE WHEN e IS NOT NULL THEN e >= DATE '{D.AS_OF}' WHEN p BETWEEN DATE '{D.WINDOW_START}' AND DATE '{D.WINDOW_END}' THEN date_diff('day', p, DATE '{D.AS_OF}') <= 90 END AS is_active,
  p BETWEEN DATE '{D.WINDOW_START}' AND DATE '{D.WINDOW_END}' AS in_analysis_period FROM fl0)"""


def flagged(spark, d):
    return I.with_time_flags(L.raw(spark, d), **WINDOW)


def _flag(name, cols, extra=""):
    @query(name, O.over(FLAGS, f"SELECT ingest_seq, {', '.join(cols)} FROM fl"))
    def _(spark, d):
        return flagged(spark, d).select("ingest_seq", *cols)


_flag("b24_posted_date_status", ["posted_date_status"])
_flag("b25_expiry_date_status", ["expiry_date_status"])
_flag("b26_is_active", ["is_active"])
_flag("b27_in_analysis_period", ["in_analysis_period"])


@query("b28_drop_expired", O.over(FLAGS, "SELECT ingest_seq FROM fl WHERE expiry_date_status <> 'expired'"))
def _(spark, d):
    return I.drop_expired(flagged(spark, d)).select("ingest_seq")


@query("b29_first_seen", O.raw("SELECT job_id, ingest_seq FROM raw_jobs QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY crawled_at, ingest_seq) = 1"))
def _(spark, d):
    return I.first_seen(L.raw(spark, d), order=("crawled_at", "ingest_seq")).select("job_id", "ingest_seq")


@query("b30_detail_overlay", """
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'phone ' || c_custkey WHEN c_custkey % 3 = 1 THEN c_mktsegment ELSE c_mktsegment END AS c_mktsegment, c_name FROM customer""")
def _(spark, d):
    card = L.table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_name")
    detail = card.where("c_custkey % 3 < 2").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("phone "), F.col("c_custkey").cast("string")))
                                                   .alias("c_mktsegment"))
    return I.overlay(card, detail, "c_custkey")


@query("b31_completeness_tag", O.raw("SELECT ingest_seq, CASE WHEN job_description <> '' THEN 'full' ELSE 'partial' END AS tag FROM raw_jobs"))
def _(spark, d):
    return L.raw(spark, d).select("ingest_seq", I.completeness_tag().alias("tag"))


def _listed(spark, d):
    return L.raw(spark, d).select("ingest_seq", "job_id", "experience_years", F.when(F.col("job_level") == "Senior", "Senior").otherwise("").alias("experience_level"),
                                  skills.parse_skill_list("skills_required").alias("skills_required"), "salary", "salary_min", "salary_max", "salary_currency")


@query("b32_enrichment_candidates", O.raw(f"""SELECT ingest_seq FROM raw_jobs WHERE experience_years IS NULL OR job_level <> 'Senior' OR len({O.comma_list('skills_required')}) < 4"""))
def _(spark, d):
    return _listed(spark, d).where(I.needs_enrichment()).select("ingest_seq")


@query("b33_enrichment_merge", O.raw(f"""
SELECT ingest_seq, coalesce(experience_years, CASE WHEN f THEN CAST(ingest_seq % 6 AS DOUBLE) END) AS experience_years,
  CASE WHEN f AND ingest_seq % 2 = 0 THEN 'Mid' WHEN job_level = 'Senior' THEN 'Senior' ELSE '' END AS experience_level,
  CASE WHEN f THEN array_to_string(list_concat(list_distinct_ordered, CASE WHEN list_contains(list_distinct_ordered, 'SQL') THEN [] ELSE ['SQL'] END), '|') ELSE array_to_string(sk, '|') END AS skills_required,
  CASE WHEN f AND salary_min IS NULL AND ingest_seq % 200 >= 100 THEN CAST(ingest_seq % 200 AS DOUBLE) ELSE salary_min END AS salary_min, f AS enriched
FROM (SELECT *, ingest_seq % 3 <> 0 AS f, {O.comma_list('skills_required')} AS sk,
  list_filter({O.comma_list('skills_required')}, lambda s, i: list_position({O.comma_list('skills_required')}, s) = i) AS list_distinct_ordered FROM raw_jobs)"""))
def _(spark, d):
    jobs = _listed(spark, d).withColumn("key", F.col("ingest_seq"))
    extra = jobs.where("ingest_seq % 3 <> 0").select(
        "key", F.lit(True).alias("found"), (F.col("ingest_seq") % 6).cast("double").alias("experience_years_min"), F.lit(None).cast("double").alias("experience_years_max"),
        F.when(F.col("ingest_seq") % 2 == 0, "Mid").otherwise("Chief").alias("experience_level"), F.array(F.lit("SQL")).alias("skills_required"),
        (F.col("ingest_seq") % 200).cast("double").alias("salary_min_usd"), (F.col("ingest_seq") % 200 + 500).cast("double").alias("salary_max_usd"))
    return I.merge_enrichment(jobs, extra, "key").select("ingest_seq", "experience_years", "experience_level", _J("skills_required"), "salary_min", "enriched")


@query("b34_ingest_funnel", O.over(FLAGS, f"""
SELECT source_website, CASE WHEN row_number() OVER (PARTITION BY job_id ORDER BY crawled_at, ingest_seq) > 1 THEN 'duplicate' WHEN NOT {_REL} THEN 'irrelevant'
  WHEN expiry_date_status = 'expired' THEN 'expired' ELSE 'saved' END AS outcome, in_analysis_period AS inside FROM fl""").replace(
      "SELECT source_website, CASE", "SELECT source_website, unnest(list_filter(['fetched', outcome, CASE WHEN outcome = 'saved' AND NOT inside "
      "THEN 'out_of_period' END], lambda k: k IS NOT NULL)) AS outcome, count(*) AS n FROM (SELECT source_website, CASE") + ") GROUP BY 1, 2")
def _(spark, d):
    return I.funnel(I.ingest_outcomes(L.raw(spark, d), order=("crawled_at", "ingest_seq"), **WINDOW))


@query("b35_output_validation", O.over(FLAGS, """
SELECT 'total_records' AS section, '' AS key, CAST(count(*) AS DOUBLE) AS value FROM fl UNION ALL SELECT 'null_title_pct', '', round(avg(CASE WHEN job_title IS NULL THEN 1.0 ELSE 0 END) * 100, 1) FROM fl
UNION ALL SELECT 'null_salary_pct', '', round(avg(CASE WHEN salary_min IS NULL THEN 1.0 ELSE 0 END) * 100, 1) FROM fl UNION ALL SELECT 'missing_field', 'experience_level', 1.0
""" + "".join(f" UNION ALL SELECT '{c}', coalesce(CAST({c} AS VARCHAR), 'unknown'), CAST(count(*) AS DOUBLE) FROM fl GROUP BY 2" for c in
              ("source_website", "posted_date_status", "expiry_date_status", "is_active", "in_analysis_period"))))
def _(spark, d):
    return I.validate_output(flagged(spark, d))


@query("b36_work_mode", O.raw("""SELECT ingest_seq, CASE WHEN contains(t, 'remote') THEN 'Remote' WHEN contains(t, 'hybrid') THEN 'Hybrid'
  WHEN contains(t, 'at office') OR contains(t, 'onsite') THEN 'On-site' ELSE 'Full-time' END AS mode
  FROM (SELECT ingest_seq, lower(concat(location, ' ', employment_type, CASE WHEN ingest_seq % 4 = 0 THEN ' At office' WHEN ingest_seq % 4 = 1 THEN ' Hybrid' ELSE '' END)) AS t FROM raw_jobs)"""))
def _(spark, d):
    tail = F.when(F.col("ingest_seq") % 4 == 0, " At office").when(F.col("ingest_seq") % 4 == 1, " Hybrid").otherwise("")
    return L.raw(spark, d).select("ingest_seq", roles.work_mode(F.concat("location", F.lit(" "), "employment_type", tail)).alias("mode"))
