"""Correlation, least squares, describe."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.functions.roles import level_number
from jobweave.operators.quantiles import overall


def with_correlation_columns(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("salary_midpoint_usd").alias("salary"), F.col("experience_years_parsed").alias("years"),
        F.col("skill_count").cast("double").alias("skills"), level_number().cast("double").alias("level"),
        F.col("is_remote").cast("int").cast("double").alias("remote"))


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, r) for all pairs in one pass; rows with any NULL are left out."""
    full = df.dropna(subset=list(columns))
    pairs = list(product(columns, columns))
    one = full.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r"))
                      for a, b in pairs])
    return one.select(F.inline(cells))


def least_squares(df: DataFrame, y: str, x: str, max_x: float | None = None) -> DataFrame:
    if max_x is not None:
        df = df.where(F.col(x) <= max_x)
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
                  F.regr_count(y, x).alias("n"))


def describe(df: DataFrame, col: str) -> DataFrame:
    one = df.agg(F.count(col).alias("n"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"),
                 F.min(col).alias("min"), F.max(col).alias("max"))
    one = one.withColumn("_q", overall(df, col, [0.25, 0.5, 0.75]))
    return one.select("n", "mean", "std", "min", F.col("_q.q25").alias("p25"), F.col("_q.q50").alias("median"),
                      F.col("_q.q75").alias("p75"), "max")
