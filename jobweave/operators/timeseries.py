"""Monthly, weekly and weekday series, moving average, trends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobweave import rules
from jobweave.functions import dates
from jobweave.operators import counts as K


def dated(df: DataFrame, col: str = "posted_date_dt") -> DataFrame:
    return df.where(F.col(col).isNotNull())


def monthly_counts(df: DataFrame, date: str = "posted_date_dt") -> DataFrame:
    return dated(df, date).groupBy(dates.month_key(date).alias("month")).agg(F.count("*").alias("n"))


def month_kpis(df: DataFrame, date: str = "posted_date_dt") -> DataFrame:
    """Months, peak, trough, peak against the mean in percent (ties: earliest month)."""
    m = monthly_counts(df, date)
    first = lambda order: m.orderBy(order, "month").limit(1)
    peak, low = first(F.desc("n")), first(F.asc("n"))
    return m.agg(F.count("*").alias("months"),
                 ((F.max("n") - F.avg("n")) / F.avg("n") * 100).alias("peak_change_pct")).withColumns({
                     "peak_month": peak.select("month").scalar(), "peak_n": peak.select("n").scalar(),
                     "low_month": low.select("month").scalar(), "low_n": low.select("n").scalar()})


def month_by_key(df: DataFrame, key: str, date: str = "posted_date_dt", n: int | None = 5,
                 values: Sequence[str] | None = None) -> DataFrame:
    """Zero-filled (month, key, n) for the top keys or a given list."""
    df = dated(df, date).withColumn("month", dates.month_key(date))
    if values is None:
        top = K.value_counts(df, key, n)
        kept = K.semi_top(df, key, n)
    else:
        kept = df.where(F.col(key).isin(*values))
        top = kept.select(key).distinct()
    return K.count_grid(kept, "month", key, kept.select("month").distinct(), top)


def weekday_counts(df: DataFrame, date: str = "posted_date_dt") -> DataFrame:
    """Monday is 0."""
    labels = F.array(*[F.lit(x) for x in rules.WEEKDAY_LABELS])
    per = dated(df, date).groupBy(F.weekday(date).alias("weekday")).agg(F.count("*").alias("n"))
    return per.select("weekday", F.get(labels, F.col("weekday")).alias("label"), "n")


def weekly_counts(df: DataFrame, date: str = "posted_date_dt") -> DataFrame:
    return dated(df, date).groupBy(dates.week_start(date).alias("week")).agg(F.count("*").alias("n"))


def centred_average(series: DataFrame, order: str, value: str = "n", width: int = 3) -> DataFrame:
    """Centred moving average, NULL where the window is not full.

    The series has one row per period, so ordering it in one task is bounded by
    the calendar, not by the data.
    """
    half = width // 2
    w = Window.orderBy(order).rowsBetween(-half, half)
    full = F.count(value).over(w) == width
    return series.withColumn("moving_avg", F.when(full, F.avg(value).over(w)))


def trending(df: DataFrame, key: str, as_of: str, months: int = 3, n: int = 20,
             date: str = "posted_date_dt") -> DataFrame:
    """Keys whose count grew most from the window before to the latest window."""
    end = F.to_date(F.lit(as_of))
    mid, start = F.add_months(end, -months), F.add_months(end, -2 * months)
    d = F.col(date)
    df = df.where((d > start) & (d <= end))
    out = df.groupBy(key).agg(F.count_if(d > mid).alias("recent"), F.count_if(d <= mid).alias("prior"))
    return K.top_by(out.withColumn("change", F.col("recent") - F.col("prior")), "change", key, n)


def period_counts(df: DataFrame, ts: str, key: str, period: str = "7 days") -> DataFrame:
    """Batch twin of the live counts: rows per time window and key."""
    return (df.groupBy(F.window(ts, period).alias("w"), key).agg(F.count("*").alias("n"))
            .select(F.col("w.start").alias("period_start"), key, "n"))
