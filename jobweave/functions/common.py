"""Small Column helpers shared by all function modules."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: str | Column) -> Column:
    """NULL text becomes the empty string."""
    return F.coalesce(as_col(c), F.lit(""))


def contains_any(c: Column, words: Iterable[str]) -> Column:
    """True when ``c`` holds any of the words as a substring (stays in codegen)."""
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def first_rule(c: Column, rules: Iterable[tuple[str, Iterable[str]]], default) -> Column:
    """Ordered substring rules: the label of the first rule with a hit."""
    out = None
    for label, words in rules:
        hit = contains_any(c, words)
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out.otherwise(F.lit(default))


def lookup(c: Column, mapping: Mapping, default: Column) -> Column:
    """Dictionary lookup with default through a literal map."""
    items = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*items), c), default)


def half_even(c: Column, n: int) -> Column:
    """Round half-even to ``n`` decimals, ignoring noise far behind the last one."""
    return F.bround(F.bround(c, n + 4), n)


def alternation(words: Sequence[str]) -> str:
    """Regex alternation of literal words, longest first."""
    return "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w)))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once.

    A Column reused in Python is an expression repeated in the plan; binding it
    as a lambda variable keeps costly text steps from running once per use.
    """
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def run_lengths(arr: Column) -> Column:
    """(term, tf) for the distinct items of an array, by sorting inside the row."""
    def counted(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(s)),
                          lambda i: (i == 1) | (F.get(s, i - 1) != F.get(s, i - 2)))
        return let(starts, lambda st: F.transform(st, lambda i, p: F.struct(
            F.get(s, i - 1).alias("term"),
            (F.coalesce(F.get(st, p + 1), F.size(s) + 1) - i).alias("tf"))))

    empty = F.array().cast("array<struct<term:string,tf:int>>")
    return F.when(F.size(arr) == 0, empty).otherwise(let(F.sort_array(arr), counted))


def explode_each(df, arr, name: str, keep=()):
    """One row per array item.

    The outer form plus a filter on the result: the plain form makes the
    optimizer add a size test that repeats the whole array expression.
    """
    out = df.select(*keep, F.explode_outer(arr).alias(name))
    return out.where(F.col(name).isNotNull())


def inline_each(df, arr, first: str, keep=()):
    """One row per struct of an array; ``first`` is a field that is never NULL."""
    return df.select(*keep, F.inline_outer(arr)).where(F.col(first).isNotNull())


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def ordered_distinct_ci(arr: Column) -> Column:
    """Case-insensitive distinct of an array, first spelling and order kept."""
    low = F.transform(arr, lambda x: F.lower(x))
    return F.filter(arr, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def sort_ci(arr: Column) -> Column:
    """Sort an array of strings by lower case, ties by the raw value."""
    keyed = F.sort_array(F.transform(arr, lambda x: F.struct(F.lower(x).alias("k"), x.alias("v"))))
    return F.transform(keyed, lambda s: s["v"])
