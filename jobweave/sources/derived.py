"""Postings, résumés and pages derived from the star-schema tables.

The test data has no postings table, so one is computed from orders joined to
customer.  The same SELECT runs on Spark and on the checking database; it only
uses CASE, %, concat, cast and substr.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2001-08-02"
WINDOW_START, WINDOW_END = "1996-01-01", "2001-08-02"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """More tasks for text-heavy work over a table of few files.

    Large tables have more splits than the cluster has cores and pass unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


#: Rows of a task that reads postings or events out of their columns, some seconds of work.
TASK_ROWS = 100_000


def dealt(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``df`` over tasks of some ``TASK_ROWS`` rows of ``table``, at least one a core.

    For work that is heavy beside the bytes it reads: a split of narrow columns, or a
    partition put together by its bytes, holds millions of rows.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-table.count() // TASK_ROWS)), key)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events")
    return dealt(df, df, "event_id")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def _pick(expr: str, values: list[str]) -> str:
    """CASE over ``expr`` = 0, 1, ...; values are SQL expressions."""
    head = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values[:-1]))
    return f"CASE {expr} {head} ELSE {values[-1]} END"


def _q(values: list[str]) -> list[str]:
    return ["'" + v.replace("'", "''") + "'" for v in values]


def _n(expr: str) -> str:
    return f"CAST({expr} AS VARCHAR(20))"


_K = "o_orderkey"
_DAY = "substr(CAST(o_orderdate AS VARCHAR(30)), 1, 10)"
_DMY = (f"concat(substr({_DAY}, 9, 2), '/', substr({_DAY}, 6, 2), '/', substr({_DAY}, 1, 4))")
_PLUS30 = "substr(CAST(CAST(o_orderdate AS DATE) + 30 AS VARCHAR(30)), 1, 10)"

TITLES = ["Senior Data Analyst", "Data Engineer (Spark/Airflow)", "AI Engineer",
          "Junior Business Analyst", "Data Scientist", "MLOps Engineer", "Backend Developer",
          "Tech Lead", "DBA", "Data Intern", "International Sales", ""]
LOCATIONS = ["Hà Nội", "Quận 1, TP.HCM", "Hồ Chí Minh", "Đà Nẵng", "Remote", "Hai Phong, Hue",
             "", "Hanoi | Da Nang", "Cần Thơ", "Binh Duong", "Toàn quốc"]
SKILLS = ["Python, SQL, pandas", "sklearn, Python, python", "K8s, Docker, AWS", "",
          "Excel, Power BI, SQL", "Spark, Kafka, Airflow", "English, Communication",
          "PyTorch, TensorFlow, NLP", "Java, C#, Go, MySQL"]
DESCRIPTIONS = ["<p>Require 3-5 years experience with <b>Python</b> and SQL.</p>",
                "Ít nhất 2 năm kinh nghiệm Power BI", "24 months of Spark and Kafka",
                "10 years building data platforms", "No experience needed, fresher welcome", "",
                "Build C++ and Node.js services"]
BENEFITS = ["<ul><li>Insurance</li><li>Gym</li></ul>", "13th month bonus", "",
            "Laptop and team trips", "Two days remote"]

_RAW_JOBS = f"""
SELECT {_K} AS ingest_seq, o_custkey,
  {_pick(f"{_K} % 12", _q(TITLES))} AS job_title,
  CASE WHEN {_K} % 97 = 0 THEN '' WHEN o_custkey % 3 = 0 THEN concat('CÔNG TY TNHH ', c_name)
       WHEN o_custkey % 3 = 1 THEN concat(c_name, ' JSC') ELSE c_name END AS company_name,
  {_pick(f"({_K} * 5) % 8", [
      "'Thỏa thuận'",
      f"concat({_n(f'8 + {_K} % 20')}, ' - ', {_n(f'15 + {_K} % 30')}, ' triệu')",
      f"concat('Upto ', {_n(f'500 + {_K} % 4000')}, ' USD')",
      f"concat('$', {_n(f'1000 + {_K} % 900')}, ' - $', {_n(f'2000 + {_K} % 2000')})",
      "''", f"concat('from ', {_n(f'700 + {_K} % 2500')}, ' USD')", "'15,000,000 VND'", "'$30'"])} AS salary,
  CASE {_K} % 10 WHEN 0 THEN CAST(600 + {_K} % 3000 AS DOUBLE)
                 WHEN 5 THEN CAST(10000000 + ({_K} % 40) * 1000000 AS DOUBLE) END AS salary_min,
  CASE {_K} % 10 WHEN 0 THEN CAST(900 + {_K} % 3000 AS DOUBLE)
                 WHEN 5 THEN CAST(15000000 + ({_K} % 40) * 1000000 AS DOUBLE) END AS salary_max,
  CASE {_K} % 10 WHEN 0 THEN 'USD' WHEN 5 THEN 'VND' ELSE '' END AS salary_currency,
  {_pick(f"({_K} * 3) % 11", _q(LOCATIONS))} AS location,
  {_pick(f"{_K} % 5", _q(["Full-time", "FULL_TIME", "Full Time", "Remote", "Part-time"]))} AS employment_type,
  {_pick(f"({_K} * 5) % 6", _q(["", "Senior", "Mid-level", "Manager", "", "Fresher"]))} AS job_level,
  {_pick(f"({_K} * 2) % 9", _q(SKILLS))} AS skills_required,
  CASE WHEN {_K} % 13 = 0 THEN CAST({_K} % 7 AS DOUBLE) END AS experience_years,
  {_pick(f"({_K} * 4) % 7", _q(DESCRIPTIONS))} AS job_description,
  {_pick(f"({_K} * 3) % 5", _q(BENEFITS))} AS benefits,
  '' AS requirements,
  {_pick(f"{_K} % 4", [_DAY, _DMY, f"concat({_n(f'1 + {_K} % 9')}, ' days ago')", "''"])} AS posted_date,
  {_pick(f"({_K} * 3) % 5", [_PLUS30, "''", "'2001-09-30'", "'soon'", "'15/08/2001'"])} AS expiry_date,
  CASE WHEN {_K} % 101 = 0 THEN 'n/a'
       ELSE concat('https://jobs.example.com/', {_n(f'{_K} % 14000')}) END AS url,
  {_pick("o_custkey % 6", _q(["careerviet", "topcv", "topdev", "linkedin", "vietnamworks", "itviec"]))} AS source_website,
  CASE WHEN o_custkey % 4 = 0 THEN c_mktsegment ELSE 'IT / Technology' END AS industry,
  'Full-time' AS job_type,
  '2001-08-02T00:00:00' AS crawled_at
"""
_PLACED = "{orders} JOIN {customer} ON o_custkey = c_custkey"
RAW_JOBS_SELECT = f"{_RAW_JOBS}FROM {_PLACED}\n"


def raw_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze postings; ``ingest_seq`` is the position in the ingest order."""
    from jobweave.functions.text import job_id

    orders = table(spark, sf_dir, "orders")
    placed = spark.sql(f"SELECT o_orderkey, o_custkey, o_orderdate, c_name, c_mktsegment FROM {_PLACED}",
                       orders=orders, customer=table(spark, sf_dir, "customer"))
    df = spark.sql(f"{_RAW_JOBS}FROM {{placed}}", placed=dealt(placed, orders, "o_orderkey"))
    return df.withColumn("job_id", job_id())


RESUME_SKILLS = ["Python, SQL, Power BI", "Java, Spring Boot, MySQL", "Docker, K8s and AWS",
                 "PyTorch; TensorFlow; NLP", "Excel, English", "Spark, Kafka, Airflow, Python",
                 "project planning"]
RESUMES_SELECT = f"""
SELECT doc_id AS resume_id,
  concat('Profile', chr(10), text, chr(10), 'Kỹ năng:', chr(10), {_pick('doc_id % 7', _q(RESUME_SKILLS))},
         chr(10), 'Work experience', chr(10),
         {_pick('doc_id % 4', ["'Intern'", f"concat({_n('1 + doc_id % 8')}, '+ years in data teams')",
                               f"concat({_n('1 + doc_id % 5')}, ' năm kinh nghiệm, then 2.5 yrs abroad')",
                               "'Freelance'"])},
         chr(10), 'Education', chr(10), 'University') AS text
FROM {{documents}}
"""


def resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(RESUMES_SELECT, documents=documents(spark, sf_dir))
