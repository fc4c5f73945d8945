"""Salary parsing: free text and numeric fields to monthly USD."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave import rules
from jobweave.functions.common import contains_any, half_even, text
from jobweave.functions.text import strip_diacritics


def is_negotiable(c: str | Column = "salary") -> Column:
    """Blank, or holds one of the 'salary not disclosed' phrases."""
    s = F.lower(F.trim(text(c)))
    return (s == "") | contains_any(s, rules.NEGOTIABLE_WORDS)


def _numbers(c: Column, pattern: str) -> Column:
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    return F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double"))


def with_parsed_salary(df: DataFrame, salary: str = "salary", prefix: str = "parsed_") -> DataFrame:
    """Add ``{prefix}min`` and ``{prefix}max`` (USD) read from the salary text.

    The steps are separate projections so that the number list is computed once.
    """
    s = F.lower(F.trim(text(salary)))
    numbers = F.filter(_numbers(F.replace(s, F.lit(","), F.lit("")), r"\d+(?:\.\d+)?"),
                       lambda v: v > 0)
    df = df.withColumns({
        "_s": s,
        "_v": F.when(~is_negotiable(salary), numbers),
        "_vnd": contains_any(s, rules.VND_WORDS),
    })
    usd = lambda v: v * F.when(F.array_max("_v") < 1000, 1e6).otherwise(1.0) / rules.VND_PER_USD
    df = df.withColumn("_v", F.when(F.col("_vnd"), F.transform("_v", usd)).otherwise(F.col("_v")))
    one, two = F.get("_v", F.lit(0)), F.slice("_v", 1, 2)
    single = F.size("_v") == 1
    upper = contains_any(F.col("_s"), rules.UPPER_BOUND_WORDS)
    lower = ~upper & contains_any(F.col("_s"), rules.LOWER_BOUND_WORDS)
    df = df.withColumns({
        "_lo": F.when(single & upper, one * rules.UPPER_BOUND_FACTOR)
                .when(single, one).otherwise(F.array_min(two)),
        "_hi": F.when(single & lower, one * rules.LOWER_BOUND_FACTOR)
                .when(single, one).otherwise(F.array_max(two)),
    })
    floor, ceil = float(rules.SALARY_FLOOR_USD), float(rules.SALARY_CEIL_USD)
    sane = (F.col("_lo") <= ceil) & (F.col("_hi") >= floor)
    return df.withColumns({
        f"{prefix}min": F.when(sane, half_even(F.greatest("_lo", F.lit(floor)), 2)),
        f"{prefix}max": F.when(sane, half_even(F.least("_hi", F.lit(ceil)), 2)),
    }).drop("_s", "_v", "_vnd", "_lo", "_hi")


def normalize_salary(df: DataFrame) -> DataFrame:
    """Salary range in USD: trusted numeric fields first, the salary text otherwise."""
    df = with_parsed_salary(df)
    rate = F.when(F.upper(text("salary_currency")) == "VND", 1.0 / rules.VND_PER_USD).otherwise(1.0)
    df = df.withColumns({"_nmin": F.col("salary_min") * rate, "_nmax": F.col("salary_max") * rate})
    trusted = F.coalesce(
        (F.col("salary_min") > 0) & F.col("_nmax").isNotNull()
        & F.col("_nmin").between(rules.SALARY_FLOOR_USD, rules.SALARY_CEIL_USD), F.lit(False))
    df = df.withColumns({
        "salary_min_usd": F.when(trusted, F.col("_nmin")).otherwise(F.col("parsed_min")),
        "salary_max_usd": F.when(trusted, F.col("_nmax")).otherwise(F.col("parsed_max")),
    })
    return df.withColumns({
        "salary_currency_norm": F.when(F.col("salary_min_usd").isNotNull(), "USD").otherwise(""),
        "salary_midpoint_usd": half_even((F.col("salary_min_usd") + F.col("salary_max_usd")) / 2, 2),
        "has_salary": F.col("salary_min_usd").isNotNull(),
        "is_negotiable": is_negotiable("salary"),
    }).drop("_nmin", "_nmax", "parsed_min", "parsed_max")


def with_ingest_salary(df: DataFrame, salary: str = "salary", prefix: str = "ingest_") -> DataFrame:
    """Ingest-time reading: ``{prefix}min``, ``{prefix}max``, ``{prefix}currency``.

    Amounts stay in the stated currency.  Thousands and millions of VND are
    scaled, an upper bound alone starts at 0.
    """
    plain = lambda words: [strip_plain(w) for w in words]
    df = df.withColumn("_p", strip_diacritics(F.lower(F.trim(text(salary)))))
    p = F.col("_p")
    vague = contains_any(p, plain(rules.INGEST_NEGOTIABLE_WORDS))
    usd = text(salary).contains("$") | p.contains("usd")
    million = contains_any(p, plain(rules.INGEST_MILLION_WORDS))
    thousand = ~million & contains_any(p, plain(rules.INGEST_THOUSAND_WORDS))
    scale = F.when(usd, 1.0).when(thousand, 1e3).otherwise(1e6)
    df = df.withColumns({
        "_n": F.when((p != "") & ~vague, F.filter(_numbers(text(salary), r"\d[\d,\.]*"),
                                                  lambda v: v.isNotNull())),
        f"{prefix}currency": F.when(text(salary) == "", "").when(vague, "negotiable")
                              .when(usd, "USD").otherwise("VND"),
        "_f": scale,
    })
    first, last = F.get("_n", F.lit(0)), F.try_element_at("_n", F.lit(-1))
    capped = (F.size("_n") == 1) & p.contains("up to")
    lo = F.when(capped, 0.0).otherwise(first)
    return df.withColumns({
        f"{prefix}min": half_even(F.least(lo, last) * F.col("_f"), 2),
        f"{prefix}max": half_even(F.greatest(lo, last) * F.col("_f"), 2),
    }).drop("_p", "_n", "_f")


def strip_plain(word: str) -> str:
    """Driver-side twin of strip_diacritics for literal words."""
    import unicodedata

    return "".join(ch for ch in unicodedata.normalize("NFD", word)
                   if unicodedata.category(ch) != "Mn")
