"""Skill lists: parsing, canonical names, extraction from free text."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobweave import rules
from jobweave.functions.common import as_col, let, lookup, ordered_distinct_ci, sort_ci, text
from jobweave.functions.text import comma_list


# -- skill lists of postings ---------------------------------------------------
def parse_skill_list(c: str | Column = "skills_required") -> Column:
    """JSON array text or comma text to a list."""
    c = text(c)
    as_json = F.when(c.startswith("["), F.from_json(c, "array<string>"))
    return F.coalesce(as_json, comma_list(c))


def normalize_skill(c: Column, aliases: Mapping[str, str] | None = None) -> Column:
    trimmed = F.trim(c)
    return lookup(F.lower(trimmed), aliases or rules.SKILL_LIST_ALIASES, trimmed)


def normalize_skills(arr: str | Column, aliases=None, cap: int | None = None) -> Column:
    """Canonical names, distinct without regard to case, order kept (the first ``cap``, if given)."""
    named = F.filter(F.transform(as_col(arr), lambda x: normalize_skill(x, aliases)),
                     lambda x: x.isNotNull() & (x != ""))
    named = ordered_distinct_ci(named)
    return named if cap is None else F.slice(named, 1, cap)


def dashboard_skills(c: str | Column = "skills_str", shortest: int = 1, longest: int | None = None) -> Column:
    """Lower-case items that are not soft skills, of ``shortest`` to ``longest`` characters if given."""
    strip = lambda x: F.regexp_replace(F.trim(F.lower(x)), r"""^["']+|["']+$""", "")
    items = F.transform(F.split(text(c), r"[;,\n|]"), strip)
    soft = [F.lit(w) for w in rules.SOFT_SKILLS]
    fits = lambda x: F.length(x) >= shortest if longest is None else F.length(x).between(shortest, longest)
    return F.filter(items, lambda x: fits(x) & ~x.isin(*soft))


def chart_skills(c: str | Column = "skills_str") -> Column:
    """Items of a list literal or comma text, case kept."""
    c = text(c)
    literal = F.from_json(c, "array<string>", {"allowSingleQuotes": "true"})
    listed = F.when(c.startswith("["), literal)
    listed = F.filter(F.transform(listed, lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(listed, comma_list(c))


def skill_family(c: str | Column = "skill", families=None, other="Other") -> Column:
    low, out = F.lower(as_col(c)), None
    for label, words in (families or rules.SKILL_FAMILIES).items():
        hit = low.isin(*words)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(other)


# -- skills in free text ---------------------------------------------------------
def skill_key(name: str) -> str:
    """Driver-side normal form of a skill name (used to build the alias table)."""
    name = re.sub(r"[^a-z0-9+#/ ]+", " ", name.strip().lower().replace(".", " ").replace("-", " "))
    return re.sub(r"\s+", " ", name).strip()


def skill_key_col(c: str | Column) -> Column:
    c = F.regexp_replace(F.lower(F.trim(text(c))), r"[^a-z0-9+#/ ]+", " ")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalize_text_col(c: str | Column) -> Column:
    c = F.replace(F.lower(text(c)), F.lit("."), F.lit(" "))
    c = F.regexp_replace(c, r"[^a-z0-9+#/À-ỹ ]+", " ")
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(" "))


def text_alias_table(extra: Sequence[str] = (), taxonomy=None, aliases=None,
                     extra_skills=None) -> dict[str, str]:
    """alias key -> canonical skill; explicit aliases override taxonomy names."""
    taxonomy = rules.SKILL_TAXONOMY if taxonomy is None else taxonomy
    extra_skills = rules.EXTRA_SKILLS if extra_skills is None else extra_skills
    aliases = rules.SKILL_TEXT_ALIASES if aliases is None else aliases
    names = [s for group in taxonomy.values() for s in group] + list(extra_skills) + list(extra)
    table = {skill_key(s): s for s in names}
    table.update({skill_key(a): canonical for a, canonical in aliases.items()})
    return table


def category_table(taxonomy=None, aliases=None, extra_skills=None) -> dict[str, str]:
    """skill key -> category; a later category overwrites an earlier one."""
    taxonomy = rules.SKILL_TAXONOMY if taxonomy is None else taxonomy
    table = {skill_key(s): cat for cat, skills in taxonomy.items() for s in skills}
    for alias, canonical in (rules.SKILL_TEXT_ALIASES if aliases is None else aliases).items():
        table[skill_key(alias)] = table.get(skill_key(canonical), "technical")
    for s in rules.EXTRA_SKILLS if extra_skills is None else extra_skills:
        table.setdefault(skill_key(s), "technical")
    return table


def skill_category(c: str | Column, other="other") -> Column:
    """Category of a skill name (alias aware) as a literal-map lookup."""
    alias_to_category = {}
    categories = category_table()
    for key, canonical in text_alias_table().items():
        alias_to_category[key] = categories.get(skill_key(canonical), other)
    for key, cat in categories.items():
        alias_to_category.setdefault(key, cat)
    return lookup(skill_key_col(c), alias_to_category, F.lit(other))


def extract_skills(c: str | Column, table: Mapping[str, str] | None = None) -> Column:
    """Canonical skills named in a text, distinct, sorted without regard to case.

    A skill counts when it stands between characters outside ``[a-z0-9+#/]``.
    Instead of one regular expression per alias the text is cut into tokens of
    exactly those characters, one space between them.  One-word aliases are a
    hash intersection with the token list, longer ones a plain substring test
    where their first word is a token: one projection, no join and no shuffle.  Accented letters separate tokens,
    so a run of them is a token that no alias contains.
    """
    table = table or text_alias_table()
    keys = [k for k in table if re.fullmatch(r"[a-z0-9+#/]+( [a-z0-9+#/]+)*", k)]
    single = [k for k in keys if " " not in k]
    several = [k for k in keys if " " in k]
    cut = F.regexp_extract_all(F.lower(text(c)), F.lit(r"[a-z0-9+#/]+|[À-ỹ]+"), F.lit(0))
    literal = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])

    def hits(words: Column) -> Column:
        one = F.array_intersect(words, F.array(*[F.lit(k) for k in single]).cast("array<string>"))
        if not several:
            return one
        found = lambda heads, m: F.array_compact(F.array(*[
            F.when(F.array_contains(heads, k.split(" ")[0]) & m.contains(f" {k} "), F.lit(k)) for k in several]))
        joined = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
        first = F.array(*[F.lit(w) for w in dict.fromkeys(k.split(" ")[0] for k in several)])
        runs = let(F.array_intersect(words, first), lambda heads: F.when(
            F.size(heads) > 0, let(joined, lambda m: found(heads, m))).otherwise(F.array().cast("array<string>")))
        return F.concat(one, runs)

    names = F.transform(let(cut, hits), lambda h: F.element_at(literal, h))
    return let(F.array_distinct(names), sort_ci)


def phrases(tokens: Column, n: int) -> Column:
    """All runs of ``n`` neighbouring tokens joined by a space."""
    zipped = F.arrays_zip(*[F.slice(tokens, i + 1, F.greatest(F.size(tokens) - n + 1, F.lit(0)))
                            .alias(f"t{i}") for i in range(n)])
    return F.transform(zipped, lambda z: F.concat_ws(" ", *[z[f"t{i}"] for i in range(n)]))


def extract_skills_regex(c: str | Column, table: Mapping[str, str] | None = None) -> Column:
    """One look-around pattern per alias: the slow exact form, kept for comparison."""
    table = table or text_alias_table()
    body = normalize_text_col(c)
    hits = [F.when(body.rlike(rf"(?<![a-z0-9+#/]){re.escape(k)}(?![a-z0-9+#/])"), F.lit(v))
            for k, v in table.items()]
    return sort_ci(F.array_distinct(F.array_compact(F.array(*hits))))


def named_in(body: Column, names: Iterable[str]) -> Column:
    """Those of the names that stand in the text between word boundaries, without regard to case, in the order given.

    The text is cut once into its words, and names of one word are one hash intersection
    with them.  Names of several words or with other characters are sought as
    substrings, and only where one is found a pattern looks at its boundaries.
    """
    spellings: dict[str, list[str]] = {}
    for name in names:
        spellings.setdefault(name.lower(), []).append(name)
    words = [k for k in spellings if re.fullmatch(r"\w+", k)]
    others = [k for k in spellings if k not in set(words)]
    array = lambda items: F.array(*[F.lit(x) for x in items]).cast("array<string>")

    def hits(low: Column) -> Column:
        one = F.array_intersect(array(words), F.regexp_extract_all(low, F.lit(r"(?U)\w+"), F.lit(0)))
        runs = [F.when(low.contains(k) & low.rlike(r"(?U)\b" + re.escape(k) + r"\b"), F.lit(k)) for k in others]
        return F.concat(one, F.array_compact(F.array(*runs))) if runs else one

    keys = F.array_intersect(array(spellings), let(F.lower(body), hits))
    literal = F.create_map(*[x for k, v in spellings.items() for x in (F.lit(k), array(v))]).cast("map<string,array<string>>")
    return F.flatten(F.transform(keys, lambda k: F.element_at(literal, k)))


def named_in_regex(body: Column, names: Iterable[str]) -> Column:
    """One pattern a name: the slow exact form, kept for comparison."""
    return let(F.lower(body), lambda b: F.array_compact(F.array(*[
        F.when(b.rlike(r"(?U)\b" + re.escape(s.lower()) + r"\b"), F.lit(s)) for s in names])))


def taxonomy_scan(title: str | Column, description: str | Column | None = None, cap: int | None = None,
                  skip_pattern: str | None = None, taxonomy=None, body: Column | None = None, min_length: int = 1) -> Column:
    """Taxonomy names with word boundaries, then parts of ``(a/b, c)`` in the title.

    Names are sought in ``body``, or else in title and description.  ``cap`` keeps the first ones
    only, ``min_length=2`` leaves out names of one letter ("R").
    """
    if body is None:
        body = text(title) if description is None else F.concat_ws(" ", text(title), text(description))
    found = named_in(body, dict.fromkeys(s for g in (taxonomy or rules.SKILL_TAXONOMY).values() for s in g))
    groups = F.regexp_extract_all(text(title), F.lit(r"\(([^)]+)\)"), F.lit(1))
    parts = F.transform(F.flatten(F.transform(groups, lambda g: F.split(g, r"[/,;]"))), lambda x: F.trim(x))
    if skip_pattern:
        parts = F.filter(parts, lambda x: ~x.rlike(skip_pattern))
    every = F.array_distinct(F.filter(F.concat(found, parts), lambda x: F.length(x) >= min_length))
    return every if cap is None else F.slice(every, 1, cap)


def normalize_items(arr: str | Column) -> Column:
    """Trimmed, non-empty, distinct, sorted without regard to case."""
    trimmed = F.filter(F.transform(as_col(arr), lambda x: F.trim(x)), lambda x: x != "")
    return sort_ci(F.array_distinct(trimmed))


def jaccard(a: str | Column, b: str | Column) -> Column:
    """Overlap of two sets, 0 when both are empty."""
    union = F.size(F.array_union(as_col(a), as_col(b)))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(as_col(a), as_col(b))) / union)


def skill_pairs(arr: str | Column) -> Column:
    """Unordered pairs (a < b) of the distinct items of one row."""
    s = F.sort_array(F.array_distinct(as_col(arr)))
    left = F.transform(s, lambda a, i: F.transform(
        F.slice(s, i + 2, F.size(s)), lambda b: F.struct(a.alias("a"), b.alias("b"))))
    return F.flatten(left)
