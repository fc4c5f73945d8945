"""Location and remote-work expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobweave import rules
from jobweave.functions.common import contains_any, lookup, text


def normalize_location(c: str | Column = "location", location_map=None) -> Column:
    """Canonical city: ordered substring map, else the first listed place in title case."""
    loc = F.trim(text(c))
    out = None
    for word, city in (location_map or rules.LOCATION_MAP).items():
        hit = F.lower(loc).contains(word)
        out = F.when(hit, city) if out is None else out.when(hit, city)
    parts = F.split(loc, r"[|,;/]")
    head = F.trim(F.get(parts, F.lit(0)))
    several = (F.size(parts) > 1) & (head != "")
    return (out.when(loc == "", "Unknown")
               .when(several, F.concat(F.initcap(head), F.lit(" + more")))
               .otherwise(F.initcap(loc)))


def is_remote(location="location", employment_type="employment_type") -> Column:
    return (contains_any(F.lower(text(location)), rules.REMOTE_LOCATION_WORDS)
            | F.lower(text(employment_type)).contains("remote"))


def display_city(normalized="location_normalized", raw="location", other="Khác") -> Column:
    """City shown on reports: normalised value, else the raw one, else ``other``."""
    blank = lambda c: F.when(F.trim(text(c)) != "", text(c))
    return F.coalesce(blank(normalized), blank(raw), F.lit(other))


def city_synonym(c: str | Column = "location_normalized", other="Other") -> Column:
    return F.coalesce(lookup(text(c), rules.CITY_SYNONYMS, F.col(c) if isinstance(c, str) else c),
                      F.lit(other))


def employment_synonym(c: str | Column = "employment_type") -> Column:
    return lookup(text(c), rules.EMPLOYMENT_SYNONYMS, text(c))


def workplace(location="location", employment_type="employment_type") -> Column:
    """Hybrid, Remote or Onsite from location and employment type."""
    both = F.lower(F.concat_ws(" ", text(location), text(employment_type)))
    return (F.when(both.contains("hybrid"), "Hybrid")
             .when(contains_any(both, rules.REMOTE_LOCATION_WORDS), "Remote")
             .otherwise("Onsite"))
