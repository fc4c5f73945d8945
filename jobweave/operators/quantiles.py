"""Exact quantiles with linear interpolation, for any number of groups and of distinct values.

Values are counted per group first, which merges before the shuffle.  Then the
wanted ranks of all groups are followed down three levels at once: from coarse
cells of the logarithm of a value to fine ones and to the values of one fine cell.
Every level looks at the cells inside the one that holds a rank, so no task sorts a
whole group: a level has at most 2 ** 20 or so rows for a rank, whether a group has
ten values or all of the table.  The cells only steer the work; results are exact.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells per unit of the natural logarithm, as powers of two: about 2 ** 14 coarse cells a factor of e, 2 ** 20 fine ones each.
COARSE, FINE = 14, 34
#: Above minus the logarithm of the smallest positive double.
_SHIFT = 800.0
_TOP = (1 << 62)


def _cell(value: Column, bits: int) -> Column:
    """A whole number that never falls as the value rises; NaN counts as the largest, as in Spark's order."""
    v = value.cast("double")
    size = F.floor((F.ln(F.abs(v)) + _SHIFT) * float(1 << bits))
    endless = F.abs(v) == float("inf")
    return (F.when(F.isnan(v), F.lit(_TOP)).when(endless, F.when(v > 0, F.lit(_TOP - 1)).otherwise(F.lit(-_TOP)))
            .when(v > 0, size).when(v < 0, -size).otherwise(F.lit(0)).cast("long"))


def same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys where NULL equals NULL; the right side's other columns follow the left's."""
    named = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(named[f"__{k}"]) for k in keys])
    return left.join(named, on, how).drop(*[f"__{k}" for k in keys])


def name_of(q: float) -> str:
    return f"q{int(round(q * 100))}"


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, qs: Sequence[float]) -> DataFrame:
    """(by..., n, q25, ...): all quantiles ``qs`` of every group in one plan that counts the values once.

    NULL values do not count and a group without values has no row; NULL keys are a group.
    """
    by = list(by)
    vals = (df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
            .withColumns({"_c1": _cell(F.col("_v"), COARSE), "_c2": _cell(F.col("_v"), FINE)}))
    ranks = [F.lit(float(q)) * (F.col("_total") - 1) for q in qs]
    before = lambda w, order: F.coalesce(
        F.sum("_n").over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    # cells of a group: a bounded number of rows, so one task may add them up, also for a whole column
    group = Window.partitionBy(*by)
    top = vals.groupBy(*by, "_c1").agg(F.sum("_n").alias("_n"))
    top = top.withColumns({"_total": F.sum("_n").over(group), "_before": before(group, "_c1")})
    wanted = F.array(*[F.struct(F.lit(2 * i + k).alias("_i"), side(r).cast("long").alias("_t"))
                       for i, r in enumerate(ranks) for k, side in enumerate((F.floor, F.ceil))])
    inside = lambda t: (t >= F.col("_before")) & (t < F.col("_before") + F.col("_n"))
    hits = (top.select(*by, "_total", "_c1", "_before", F.inline(F.filter(wanted, lambda x: inside(x["_t"]))))
            .select(*by, "_total", "_i", "_c1", (F.col("_t") - F.col("_before")).alias("_rest")))

    def down(hits: DataFrame, cells: DataFrame, parent: str, child: str) -> DataFrame:
        found = same(hits, cells.select(*by, parent, child, "_n"), [*by, parent])
        found = found.withColumn("_before", before(Window.partitionBy(*by, "_i"), child)).where(inside(F.col("_rest")))
        return found.select(*by, "_total", "_i", child, (F.col("_rest") - F.col("_before")).alias("_rest"))

    fine = vals.groupBy(*by, "_c1", "_c2").agg(F.sum("_n").alias("_n"))
    hits = down(down(hits, fine, "_c1", "_c2"), vals, "_c2", "_v")
    at = lambda i: F.max(F.when(F.col("_i") == i, F.col("_v")))
    picked = hits.groupBy(*by, "_total").agg(*[at(i).alias(f"_x{i}") for i in range(2 * len(qs))])
    low, high = lambda i: F.col(f"_x{2 * i}"), lambda i: F.col(f"_x{2 * i + 1}")
    between = lambda i, r: F.when(low(i) == high(i), low(i).cast("double")).otherwise(
        low(i) + (high(i) - low(i)) * (r - F.floor(r)))
    return picked.select(*by, F.col("_total").alias("n"),
                         *[between(i, r).alias(name_of(q)) for i, (q, r) in enumerate(zip(qs, ranks))])


def overall(df: DataFrame, value: str, qs: Sequence[float] = (0.5,)) -> Column:
    """Exact quantiles of a whole column as one scalar struct (q50, ...), NULL without values."""
    return exact_quantiles(df, [], value, qs).select(F.struct(*map(name_of, qs))).scalar()


def overall_one(df: DataFrame, value: str, q: float = 0.5) -> Column:
    return exact_quantiles(df, [], value, [q]).select(name_of(q)).scalar()


def median_by(df: DataFrame, by: Sequence[str], value: str, name: str = "median", min_count: int = 0) -> DataFrame:
    """(by..., name, n) of every group, also of those without values, where n is 0 and the median NULL."""
    counts = df.groupBy(*by).agg(F.count(value).alias("n"))
    if min_count:
        counts = counts.where(F.col("n") >= min_count)
    found = exact_quantiles(df, by, value, [0.5]).select(*by, F.col("q50").alias(name))
    return same(counts, found, by, "left").select(*by, name, "n")


def with_quantiles(groups: DataFrame, df: DataFrame, by: Sequence[str], value: str, qs: Sequence[float] = (0.5,),
                   names: Sequence[str] = ("median",)) -> DataFrame:
    """Groups with quantiles of ``df`` as further columns, NULL for groups without values."""
    found = exact_quantiles(df, by, value, qs).select(*by, *[F.col(name_of(q)).alias(n) for q, n in zip(qs, names)])
    return same(groups, found, by, "left")
