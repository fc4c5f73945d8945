"""Row filters, text cleaning and keep-first de-duplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobweave.functions import text as tx
from jobweave.functions.common import as_col, text

HTML_COLUMNS = ("job_description", "benefits")
KEY_COLUMNS = ("job_title", "company_name")
OTHER_TEXT_COLUMNS = ("location", "salary", "employment_type", "job_level")
TEXT_COLUMNS = KEY_COLUMNS + OTHER_TEXT_COLUMNS
ORDER_CANDIDATES = ("crawled_at", "ingest_seq", "job_id")


def has_title(col: str = "job_title") -> Column:
    """The title has a character other than white space (no-break space included)."""
    return text(col).rlike(r"(?U)\S")


def drop_missing_titles(df: DataFrame, col: str = "job_title") -> DataFrame:
    return df.where(has_title(col))


def drop_invalid_urls(df: DataFrame, col: str = "url") -> DataFrame:
    return df.where(tx.has_http_prefix(col))


def clean_text_columns(df: DataFrame, html=HTML_COLUMNS, plain=TEXT_COLUMNS) -> DataFrame:
    have = set(df.columns)
    return df.withColumns({**{c: tx.remove_html_tags(c) for c in html if c in have},
                           **{c: tx.clean_text_field(c) for c in plain if c in have}})


def with_company_group(df: DataFrame) -> DataFrame:
    """Company name without legal forms, for grouping; the name itself is kept."""
    return df.withColumn("company_name_normalized", tx.clean_company_name("company_name"))


def with_job_hash(df: DataFrame) -> DataFrame:
    return df.withColumn("job_hash", tx.job_hash())


def keep_first(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str] | None = None, unique: str | None = None) -> DataFrame:
    """First row per key in an explicit order.

    ``row_number() = 1`` lets Spark put a group limit before the shuffle: every
    map task sends one row per key, so a key with a third of all rows does not
    pile up in one reducer.  A hash of the row breaks the last ties; where the order
    ends in a column that is ``unique`` there are none, and no column but those used is read.
    """
    order = list(order or [c for c in ORDER_CANDIDATES if c in df.columns])
    last = F.col(unique) if unique else F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    w = Window.partitionBy(*[as_col(k) for k in keys]).orderBy(*order, last)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def remove_duplicates(df: DataFrame, order: Sequence[str] | None = None, unique: str | None = None,
                      elect_by_id: bool = False) -> DataFrame:
    """By url, then by lower-cased title and company among the survivors.

    ``unique`` names a column that differs in every row; it then breaks ties, so that
    only the columns used are read.  With ``elect_by_id`` the survivors are elected on
    the keys, the order and that column alone, and whole rows move once, to meet the
    survivors' ids, in place of twice.  That reads the keys a second time, which pays
    for columnar input with long texts.  Both forms keep the same rows.
    """
    norm = lambda c: F.lower(F.trim(text(c)))
    order = list(order or [c for c in ORDER_CANDIDATES if c in df.columns])
    keys = {"_title": norm("job_title"), "_company": norm("company_name")}
    if not elect_by_id:
        return keep_first(keep_first(df, ["url"], order, unique), list(keys.values()), order, unique)
    if unique is None:
        raise ValueError("elect_by_id needs a unique column")
    narrow = df.select("url", *dict.fromkeys([*order, unique]), *[v.alias(k) for k, v in keys.items()])
    kept = keep_first(keep_first(narrow, ["url"], order, unique), list(keys), order, unique)
    return df.join(kept.select(unique), unique, "left_semi")


def row_counts(df: DataFrame, valid: Column, order: Sequence[str] | None = None, unique: str | None = None) -> DataFrame:
    """(rows, valid, kept): all rows, those that pass ``valid``, those of them that `remove_duplicates` keeps; one row, one scan.

    A url's first row is a minimum, and the rows kept are as many as the first rows have
    titles and companies, so all three numbers come from sums that merge before each
    shuffle: no row and no text but the keys moves, however often a url repeats.
    """
    norm = lambda c: F.lower(F.trim(text(c)))
    order = list(order or [c for c in ORDER_CANDIDATES if c in df.columns])
    last = F.col(unique) if unique else F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    place = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], last.alias("o"),
                     norm("job_title").alias("title"), norm("company_name").alias("company"))
    ok = F.coalesce(valid, F.lit(False))
    rows = df.select(ok.alias("ok"), F.when(ok, F.col("url")).alias("url"), F.when(ok, place).alias("place"))
    urls = rows.groupBy("ok", "url").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    keys = urls.groupBy("ok", "first.title", "first.company").agg(F.sum("n").alias("n"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return keys.agg(total("n").alias("rows"), total(F.when(F.col("ok"), F.col("n"))).alias("valid"), F.count_if("ok").alias("kept"))


def step_counts(steps: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """(step, rows) for a chain of stages, one count per stage."""
    out = None
    for i, (name, df) in enumerate(steps):
        one = df.agg(F.count("*").alias("rows")).select(
            F.lit(i).alias("step_no"), F.lit(name).alias("step"), "rows")
        out = one if out is None else out.unionByName(one)
    return out
