"""Chart-ready data: histograms, box statistics, shares, concentration, tag weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobweave import rules
from jobweave.functions.roles import level_rank
from jobweave.operators import counts as K
from jobweave.operators.quantiles import exact_quantiles, overall_one, same


def histogram(df: DataFrame, col: str, bins: int = 12, min_step: float = 0.0) -> DataFrame:
    """Equal-width bins from min to max, last bin closed, empty bins kept."""
    vals = df.where(F.col(col).isNotNull())
    edges = vals.agg(F.min(col).alias("lo"), F.greatest((F.max(col) - F.min(col)) / bins,
                                                       F.lit(min_step)).alias("step"))
    lo, step = edges.select("lo").scalar(), edges.select("step").scalar()
    pos = F.when(step == 0, 0).otherwise(F.least(F.floor((F.col(col) - lo) / step), F.lit(bins - 1)))
    counts = vals.groupBy(pos.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    every = edges.where("lo IS NOT NULL").select(
        F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "lo", "step")
    return every.join(counts, "bin", "left").select(
        "bin", (F.col("lo") + F.col("bin") * F.col("step")).alias("bin_start"),
        F.coalesce("n", F.lit(0)).alias("n"))


def auto_histogram(df: DataFrame, col: str, max_bins: int = 35) -> DataFrame:
    """At most ``max_bins`` bins whose width is 1, 2 or 5 times a power of ten."""
    vals = df.where(F.col(col).isNotNull())
    raw = (F.max(col) - F.min(col)) / max_bins
    power = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    step = F.when(raw <= 0, 1.0).when(raw <= power, power).when(raw <= 2 * power, 2 * power).when(
        raw <= 5 * power, 5 * power).otherwise(10 * power)
    width = vals.agg(step).scalar()
    out = vals.groupBy((F.floor(F.col(col) / width) * width).alias("bin_start")).agg(F.count("*").alias("n"))
    return out.select(F.col("bin_start").cast("double").alias("bin_start"), "n")


def box_stats(df: DataFrame, by: str, col: str, min_rows: int = 1, order: Sequence[str] | None = None) -> DataFrame:
    """Quartiles, 1.5 IQR whiskers and outlier count per category.

    Values are counted first, so the second look for the whiskers runs over
    distinct values only.
    """
    vals = df.where(F.col(col).isNotNull()).groupBy(by, F.col(col).alias("_v")).agg(F.count("*").alias("_n"))
    box = exact_quantiles(df, [by], col, [0.25, 0.5, 0.75]).select(
        by, "n", F.col("q25").alias("q1"), F.col("q50").alias("median"), F.col("q75").alias("q3")).where(F.col("n") >= min_rows)
    iqr = F.col("q3") - F.col("q1")
    box = box.withColumns({"_lo": F.col("q1") - 1.5 * iqr, "_hi": F.col("q3") + 1.5 * iqr})
    inside = F.col("_v").between(F.col("_lo"), F.col("_hi"))
    out = same(box, vals, [by]).groupBy(by, "n", "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("_v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("_v"))).alias("whisker_high"),
        F.sum(F.when(inside, 0).otherwise(F.col("_n"))).alias("outliers"))
    return out.withColumn("ord", level_rank(by, order)) if order else out


def cumulative_share(df: DataFrame, key: str, n: int = 20) -> DataFrame:
    """Top n keys with rank, own share and running share of all rows in percent."""
    total = df.agg(F.count("*")).scalar()
    top = K.value_counts(df, key, n)
    rank = Window.orderBy(F.desc("n"), key)                      # at most n rows
    run = rank.rowsBetween(Window.unboundedPreceding, 0)
    return top.select(F.row_number().over(rank).alias("rank"), key, "n",
                      (F.col("n") * 100.0 / total).alias("share_pct"),
                      (F.sum("n").over(run) * 100.0 / total).alias("cumulative_pct"))


def concentration(df: DataFrame, key: str, ks: Sequence[int] = (5, 20)) -> DataFrame:
    """Percent of all rows held by the k most frequent keys, for several k."""
    top = cumulative_share(df, key, max(ks))
    return top.agg(*[F.max(F.when(F.col("rank") <= k, F.col("cumulative_pct"))).alias(f"top{k}_pct")
                     for k in ks])


def highlight_top(df: DataFrame, key: str, n: int = 20, q: float = 0.75) -> DataFrame:
    """Top n with a flag for counts at or above the q-quantile of those n."""
    top = K.value_counts(df, key, n)
    return top.withColumn("highlight", F.col("n") >= overall_one(top, "n", q))


def tag_weights(top: DataFrame, key: str = "skill") -> DataFrame:
    """Font size, hue and opacity from the min-max ratio of a bounded top list."""
    lo, hi = top.agg(F.min("n")).scalar(), top.agg(F.max("n")).scalar()
    ratio = (F.col("n") - lo) / F.greatest(hi - lo, F.lit(1))
    df = top.withColumn("ratio", ratio)
    return df.select(key, "n", F.bround(12 + F.col("ratio") * 14, 0).cast("int").alias("size"),
                     F.bround(200 + F.col("ratio") * 60, 0).cast("int").alias("hue"),
                     (0.5 + F.col("ratio") * 0.5).alias("opacity"))


def cloud_counts(counts: DataFrame, min_count: int = 5, n: int = 80, key: str = "skill") -> DataFrame:
    return K.top_by(counts.where(F.col("n") >= min_count), "n", key, n)


def market_band(col: str, reference: Column) -> Column:
    """'premium' above 1.3 times the reference, 'above' above it, else 'at_or_below'."""
    return (F.when(F.col(col) > reference * 1.3, "premium").when(F.col(col) > reference, "above")
             .otherwise("at_or_below"))
