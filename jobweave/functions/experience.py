"""Years of experience and experience level."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobweave import rules
from jobweave.functions.common import as_col, contains_any, first_rule, half_even, let, text


def parse_experience_years(c: str | Column) -> Column:
    """Lowest stated years in a text; NULL when nothing usable is stated."""
    def years(low: Column) -> Column:
        candidates = []
        for pattern, divisor in rules.EXPERIENCE_PATTERNS:
            value = F.regexp_extract(low, pattern, 1).try_cast("double")
            if divisor != 1:
                value = half_even(value / divisor, 1)
            candidates.append(let(value, lambda v: F.when(v.between(0, rules.EXPERIENCE_MAX_YEARS), v)))
        return (F.when(contains_any(low, rules.NO_EXPERIENCE_WORDS), F.lit(0.0))
                 .when(low.rlike(r"\d"), F.coalesce(*candidates)))

    return let(F.lower(text(c)), years)


def experience_years(number="experience_years",
                     texts=("job_description", "requirements", "benefits"),
                     title="job_title") -> Column:
    """Numeric field first, then the texts in order (over 10 characters), then title words."""
    from_text = [F.when(F.length(text(c)) > 10, parse_experience_years(c)) for c in texts]
    low, from_title = F.lower(text(title)), None
    for words, years in rules.TITLE_YEARS:
        hit = contains_any(low, words)
        from_title = F.when(hit, years) if from_title is None else from_title.when(hit, years)
    return F.coalesce(as_col(number).try_cast("double"), *from_text, from_title)


def experience_level(years="experience_years_parsed", title="job_title", job_level="job_level",
                     nan_as_lead: bool = False) -> Column:
    """intern, fresher, junior, mid, senior or lead.

    With ``nan_as_lead`` unknown years give 'lead' (older data sets were built
    that way); by default they fall through to the job-level words and 'mid'.
    """
    t, l, y = F.lower(text(title)), F.lower(text(job_level)), as_col(years)
    out = F.when(contains_any(t, rules.INTERN_WORDS) | contains_any(l, rules.INTERN_WORDS), "intern")
    for label, words in rules.TITLE_LEVELS:
        out = out.when(contains_any(t, words), label)
    out = out.when(y == 0, "fresher")
    for bound, label in rules.LEVEL_BANDS:
        out = out.when(y < bound, label)
    out = out.when(y.isNotNull(), "lead")
    if nan_as_lead:
        return out.otherwise("lead")
    for label, words in rules.FIELD_LEVELS:
        out = out.when(contains_any(l, words), label)
    return out.otherwise("mid")


def source_level(title="job_title", source="source_website", table=None) -> Column:
    """Job level from title words, with the rules of each source."""
    out = None
    for name, levels in (table or rules.SOURCE_LEVEL_RULES).items():
        expr = first_rule(F.lower(text(title)), levels, rules.SOURCE_LEVEL_DEFAULT)
        hit = as_col(source) == name
        out = F.when(hit, expr) if out is None else out.when(hit, expr)
    return out.otherwise(rules.SOURCE_LEVEL_DEFAULT)


def experience_phrase(c: str | Column) -> Column:
    """First phrase that mentions years of experience."""
    def found(t: Column) -> Column:
        hits = [F.nullif(F.regexp_extract(t, "(?iuU)" + p, 0), F.lit("")) for p in rules.EXPERIENCE_PHRASES]
        return F.trim(F.coalesce(*hits, F.lit("")))
    return let(text(c), found)


def phrase_years(c: str | Column) -> Column:
    """First number of a phrase; a bare integer has no unit and gives NULL."""
    return let(F.trim(text(c)), lambda t: F.when(
        ~t.rlike(r"^\d+$"), F.regexp_extract(t, r"\d+(?:\.\d+)?", 0).try_cast("double")))


def _all_years(c: str | Column) -> Column:
    low = F.lower(text(c))
    found = F.concat(*[F.regexp_extract_all(low, F.lit(p), F.lit(1)) for p in rules.YEARS_PATTERNS])
    return F.transform(found, lambda x: x.try_cast("double"))


def candidate_years(c: str | Column) -> Column:
    return F.array_max(_all_years(c))


def required_years(c: str | Column) -> Column:
    return F.array_min(_all_years(c))


def experience_alignment(candidate: str | Column, required: str | Column) -> Column:
    """1 when nothing is asked or enough is offered, 0.4 when unknown, else the ratio."""
    c, r = as_col(candidate), as_col(required)
    ratio = c / F.greatest(r, F.lit(0.5))
    return (F.when(r.isNull(), 1.0).when(c.isNull(), 0.4).when(c >= r, 1.0)
             .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio))))
