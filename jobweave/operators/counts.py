"""Counting operators: value counts, top-k, shares, modes, grids.

Ties are always broken by the key, so results do not depend on row order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobweave.functions.common import as_col, inline_each


def value_counts(df: DataFrame, key: str, n: int | None = None, name: str = "n") -> DataFrame:
    """Rows per key, most frequent first; ``n`` keeps the top (no full sort)."""
    counts = df.groupBy(key).agg(F.count("*").alias(name))
    return counts if n is None else counts.orderBy(F.desc(name), key).limit(n)


def key_counts(df: DataFrame, keys: Mapping[str, str | Column], lists: Mapping[str, str] | None = None) -> DataFrame:
    """(kind, value, n): rows per value of many keys, counted in one pass over the input.

    ``keys`` maps a kind to a column, ``lists`` to an array column whose items count
    each.  NULL is a value of a key, a NULL item or list is none.  Counts merge before
    the shuffle, so a frequent value sends one row per map task.
    """
    entry = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"))
    single = F.array(*[entry(kind, as_col(c)) for kind, c in keys.items()])
    every = lambda kind, c: F.transform(F.array_compact(F.coalesce(F.col(c), F.array())), lambda x: entry(kind, x))
    items = [every(kind, c) for kind, c in (lists or {}).items()]
    each = inline_each(df, F.concat(single, *items) if items else single, "kind")
    return each.groupBy("kind", "value").agg(F.count("*").alias("n"))


def top_by(df: DataFrame, value: str, key: str, n: int, ascending: bool = False) -> DataFrame:
    return df.orderBy(F.asc(value) if ascending else F.desc(value), key).limit(n)


def semi_top(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows whose key is among the ``n`` most frequent; the small side has at most n rows."""
    return df.join(F.broadcast(value_counts(df, key, n).select(key)), key, "left_semi")


def top_n_other(df: DataFrame, key: str, n: int, other: str = "Other") -> DataFrame:
    """Top n keys and one bucket for the rest: total minus the kept counts."""
    top = value_counts(df, key, n)
    kept = top.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("kept"))
    rest = kept.select(F.lit(other).alias(key),
                       (df.agg(F.count("*")).scalar() - F.col("kept")).alias("n"))
    return top.unionByName(rest)


def shares(df: DataFrame, key: str, scale: float = 1.0) -> DataFrame:
    """Counts and their part of the total (total as scalar subquery, no global window)."""
    total = df.agg(F.count("*")).scalar()
    return value_counts(df, key).withColumn("share", F.col("n") * scale / total)


def ordered_dim(df: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """Literal dimension (key, ord) on the session of ``df``."""
    rows = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(v).alias(key)) for i, v in enumerate(values)])
    return df.sparkSession.range(1).select(F.inline(rows))


def reindex(counts: DataFrame, key: str, values: Sequence[str], fill: dict | None = None) -> DataFrame:
    """Align an aggregate to an ordered key list; missing keys are filled."""
    out = ordered_dim(counts, key, values).join(counts, key, "left")
    return out.na.fill(fill) if fill else out


def mode_by(df: DataFrame, group: str, value: str, name: str = "mode") -> DataFrame:
    """Most frequent value per group, ties to the smallest value."""
    counts = df.groupBy(group, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(group).orderBy(F.desc("_n"), value)
    return (counts.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
            .select(group, F.col(value).alias(name)))


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def key_array(top: DataFrame, key: str) -> Column:
    """The keys of a bounded frame as one array value (scalar subquery)."""
    return top.agg(F.sort_array(F.collect_list(key))).scalar()


def count_grid(df: DataFrame, row: str, col: str, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """Zero-filled counts for every (row, col) of two bounded key frames.

    Both frames are top lists or calendar months, so they are broadcast to keep
    only the wanted rows before the count.
    """
    grid = rows.select(row).withColumn(col, F.explode(key_array(cols, col)))
    kept = (df.join(F.broadcast(rows.select(row)), row, "left_semi")
            .join(F.broadcast(cols.select(col)), col, "left_semi"))
    counts = kept.groupBy(row, col).agg(F.count("*").alias("n"))
    return grid.join(counts, [row, col], "left").na.fill({"n": 0})


def pivot_counts(df: DataFrame, row: str, col: str, values: Sequence[str]) -> DataFrame:
    """Wide counts with explicit columns (no extra job to find them), zero-filled."""
    return df.groupBy(row).pivot(col, list(values)).agg(F.count(F.lit(1))).na.fill(0)


def unpivot_metrics(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """One-row metrics frame to (metric, value) rows."""
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value"))
                      for n in names])
    return df.select(F.inline(pairs))


def completeness(df: DataFrame, by: str, checks: dict[str, Column]) -> DataFrame:
    """Percent of rows per group that pass each check."""
    aggs = [F.round(F.avg(F.coalesce(c, F.lit(False)).cast("int")) * 100, 1).alias(n)
            for n, c in checks.items()]
    return df.groupBy(by).agg(*aggs)


def non_null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, non_null, pct) in one pass."""
    columns = list(columns or df.columns)
    one = df.agg(F.count("*").alias("_rows"), *[F.count(F.col(f"`{c}`")).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("non_null"))
                      for c in columns])
    return one.select("_rows", F.inline(pairs)).select(
        "column", "non_null", F.round(F.col("non_null") * 100.0 / F.col("_rows"), 4).alias("pct"))
