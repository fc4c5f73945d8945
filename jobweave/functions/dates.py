"""Posted and expiry dates: absolute and relative forms, status and activity flags.

``as_of`` is always a parameter; nothing depends on the wall clock.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobweave import rules
from jobweave.functions.common import as_col, alternation, contains_any, let, text

# shape of the text -> date format.  The shape test keeps the parser from
# throwing and catching an exception for every format that does not fit.
DATE_SHAPES = [
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
    (r"^\d{1,2} [A-Za-z]{3,} \d{4}$", "d MMMM yyyy"),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^[A-Za-z]{3,} \d{1,2}, \d{4}$", "MMMM d, yyyy"),
]
ISO_DATETIME = (r"^(\d{4}-\d{1,2}-\d{1,2})T([01]?\d|2[0-3]):[0-5]?\d:[0-5]?\d"
                r"(?:Z|[+-]\d{2}:?\d{2})?$")


# every shape has a year of four digits: other texts are asked for that alone
YEAR = r"\d{4}"


def parse_absolute_date(c: str | Column) -> Column:
    def parsed(t: Column) -> Column:
        tries = [F.when(t.rlike(shape), F.try_to_date(t, fmt)) for shape, fmt in DATE_SHAPES]
        iso = F.when(t.rlike(ISO_DATETIME), F.try_to_date(F.regexp_extract(t, ISO_DATETIME, 1), "yyyy-M-d"))
        return F.when(t.rlike(YEAR), F.coalesce(*tries, iso))

    return let(F.trim(text(c)), parsed)


DAYS_OF_ERA = 719_000
# the word that ends the phrase of each rule
RELATIVE_ENDS = sorted({re.search(r"\w+$", pattern)[0] for pattern, _ in rules.RELATIVE_DATE_RULES})


def parse_relative_date(c: str | Column, reference: Column) -> Column:
    """'3 days ago', 'hôm qua', '2 tuần trước' relative to ``reference``.

    Patterns are sought only in texts that hold one of their words; a pattern without
    regard to case takes 'ſ' for 's', so the words are sought that way too.
    """
    word = lambda words: rf"(?iuU)\b(?:{alternation(words)})\b"

    def back(t: Column, pattern: str, days: int) -> Column:
        n = F.regexp_extract(t, pattern, 1).try_cast("int")
        # no date lies before year 1
        return let(n, lambda n: F.when(n <= DAYS_OF_ERA // max(days, 1), F.date_sub(reference, n * days)))

    def parsed(t: Column) -> Column:
        said = lambda low, words: contains_any(low, words) & t.rlike(word(words))
        counted = F.coalesce(*[back(t, pattern, days) for pattern, days in rules.RELATIVE_DATE_RULES])
        return let(F.replace(F.lower(t), F.lit("ſ"), F.lit("s")), lambda low: (
            F.when(said(low, rules.TODAY_WORDS), reference)
             .when(said(low, rules.YESTERDAY_WORDS), F.date_sub(reference, 1))
             .when(contains_any(low, RELATIVE_ENDS), counted)))

    return let(text(c), parsed)


def posted_date(c: str | Column, reference: Column) -> tuple[Column, Column]:
    """(date, status): 'exact', 'estimated' or 'unknown'."""
    exact = parse_absolute_date(c)
    estimated = parse_relative_date(c, reference)
    status = (F.when(exact.isNotNull(), "exact").when(estimated.isNotNull(), "estimated")
               .otherwise("unknown"))
    return F.coalesce(exact, estimated), status


def time_flags(posted="posted_date", expiry="expiry_date", crawled_at="crawled_at", *,
               as_of: str, start: str = rules.ANALYSIS_START, end: str = rules.ANALYSIS_END,
               active_days: int = rules.ASSUMED_ACTIVE_DAYS) -> list[dict[str, Column]]:
    """Two stages of columns for ``withColumns``: parsed dates, then the flags.

    ``is_active`` and ``in_analysis_period`` are three-valued; NULL is unknown.
    """
    reference = F.coalesce(as_col(crawled_at).try_cast("date"), F.to_date(F.lit(as_of)))
    date, status = posted_date(posted, reference)
    today = F.to_date(F.lit(as_of))
    first = {
        "posted_date_parsed": date,
        "_posted_status": status,
        "expiry_date_parsed": parse_absolute_date(expiry),
    }
    p, e = F.col("posted_date_parsed"), F.col("expiry_date_parsed")
    inside = p.between(F.to_date(F.lit(start)), F.to_date(F.lit(end)))
    second = {
        "posted_date_status": F.when(~inside, "out_of_range").otherwise(F.col("_posted_status")),
        "expiry_date_status": F.when(e < today, "expired").when(e.isNotNull(), "known")
                               .otherwise("unknown"),
        "is_active": F.when(e.isNotNull(), e >= today)
                      .when(inside, F.datediff(today, p) <= active_days),
        "in_analysis_period": inside,
    }
    return [first, second]


def days_since(c: str | Column, reference: str = rules.REFERENCE_DATE) -> Column:
    return F.greatest(F.datediff(F.to_date(F.lit(reference)), as_col(c)), F.lit(0))


def month_key(c: str | Column) -> Column:
    return F.date_format(as_col(c), "yyyy-MM")


def week_start(c: str | Column) -> Column:
    return F.to_date(F.date_trunc("WEEK", as_col(c)))
