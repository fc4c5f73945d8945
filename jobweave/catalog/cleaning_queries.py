"""Registered queries: cleaning, row filters, de-duplication (C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobweave.catalog import layers as L
from jobweave.catalog import oracle as O
from jobweave.catalog.registry import query
from jobweave.functions import text as tx
from jobweave.operators import cleaning as C


@query("c1_remove_html_tags", f"SELECT page_id, {O.remove_html('html')} AS body FROM pages")
def _(spark, d):
    return L.table(spark, d, "pages").select("page_id", tx.remove_html_tags("html").alias("body"))


@query("c1_remove_html_tags_postings", O.raw(
    f"SELECT ingest_seq, {O.remove_html('job_description')} AS job_description, "
    f"{O.remove_html('benefits')} AS benefits FROM raw_jobs"))
def _(spark, d):
    return L.raw(spark, d).select("ingest_seq",
                                  tx.remove_html_tags("job_description").alias("job_description"),
                                  tx.remove_html_tags("benefits").alias("benefits"))


@query("c2_clean_text_field", f"SELECT doc_id, {O.clean('text')} AS body FROM documents")
def _(spark, d):
    return L.table(spark, d, "documents").select("doc_id", tx.clean_text_field("text").alias("body"))


@query("c3_clean_company_name", O.raw(
    f"SELECT ingest_seq, {O.company('company_name')} AS company_name_normalized FROM raw_jobs"))
def _(spark, d):
    return L.raw(spark, d).select("ingest_seq", tx.clean_company_name("company_name")
                                  .alias("company_name_normalized"))


@query("c4_drop_missing_titles", O.raw(
    "SELECT ingest_seq, job_title FROM raw_jobs WHERE job_title IS NOT NULL AND trim(job_title) <> ''"))
def _(spark, d):
    return C.drop_missing_titles(L.raw(spark, d)).select("ingest_seq", "job_title")


@query("c5_drop_invalid_urls", O.raw(
    r"SELECT ingest_seq, url FROM raw_jobs WHERE regexp_matches(url, '(?i)^https?://[^\s]+')"))
def _(spark, d):
    return C.drop_invalid_urls(L.raw(spark, d)).select("ingest_seq", "url")


@query("c6_remove_duplicates", O.over(
    f"{O.RAW}, {O.VALID}, {O.CLEANED}, {O.DEDUP}",
    "SELECT ingest_seq, url, job_title, company_name FROM deduped"))
def _(spark, d):
    return L.stage(spark, d, "dedup").select("ingest_seq", "url", "job_title", "company_name")


@query("c6_keep_first_document",
       "SELECT doc_id, source, lang FROM documents QUALIFY "
       "row_number() OVER (PARTITION BY md5(lower(trim(text))) ORDER BY doc_id) = 1")
def _(spark, d):
    docs = L.table(spark, d, "documents")
    return C.keep_first(docs, [F.md5(F.lower(F.trim("text")))], ["doc_id"]).select(
        "doc_id", "source", "lang")


@query("c7_clean_text_columns", O.over(
    f"{O.RAW}, {O.VALID}, {O.CLEANED}",
    "SELECT ingest_seq, job_title, company_name, company_name_normalized, location, salary, "
    "employment_type, job_level, job_description, benefits FROM cleaned"))
def _(spark, d):
    return C.with_company_group(C.clean_text_columns(L.stage(spark, d, "valid"))).select(
        "ingest_seq", "job_title", "company_name", "company_name_normalized", "location",
        "salary", "employment_type", "job_level", "job_description", "benefits")


@query("c8_compute_job_hash", O.over(f"{O.RAW}, {O.VALID}, {O.CLEANED}",
                                     "SELECT ingest_seq, job_hash FROM cleaned"))
def _(spark, d):
    return L.stage(spark, d, "clean").select("ingest_seq", "job_hash")


@query("c9_step_statistics", O.over(
    f"{O.RAW}, {O.VALID}, {O.CLEANED}, {O.DEDUP}",
    """SELECT 0 AS step_no, 'load' AS step, count(*) AS rows FROM raw_jobs
    UNION ALL SELECT 1, 'valid', count(*) FROM valid
    UNION ALL SELECT 2, 'clean', count(*) FROM cleaned
    UNION ALL SELECT 3, 'dedup', count(*) FROM deduped
    UNION ALL SELECT 4, 'normalize', count(*) FROM deduped"""))
def _(spark, d):
    from jobweave.plans import silver as plan
    from jobweave.plans import warehouse

    return plan.step_statistics(L.raw(spark, d), warehouse.OPTIONS)
