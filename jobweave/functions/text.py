"""Text cleaning, HTML stripping, hashes and URLs as Column expressions."""

from __future__ import annotations

import functools
import unicodedata
import zlib
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobweave import rules
from jobweave.functions.common import as_col, let, text


def clean_text_field(c: str | Column) -> Column:
    """Line breaks and tabs to a space, runs of spaces to one, trimmed, NULL to ''."""
    one_line = F.regexp_replace(text(c), r"[\r\n\t]+", " ")
    return F.trim(F.regexp_replace(one_line, r" {2,}", " "))


def _code_page(name: str) -> tuple[str, str, str]:
    """(bytes with another letter than in Latin-1, those letters, bytes without a letter), each byte as its Latin-1 letter."""
    letters = {chr(b): bytes([b]).decode(name, "ignore") for b in range(256)}
    other = {k: v for k, v in letters.items() if v and v != k}
    return "".join(other), "".join(other.values()), "".join(k for k, v in letters.items() if not v)


def decode_text(content: str | Column, code_page: str = "cp1258") -> Column:
    """Binary text by the first that fits: UTF-8 (a leading BOM goes), a single-byte code page, Latin-1.

    Spark's `decode` knows few code pages; a single-byte one is Latin-1 with some
    letters replaced, so `translate` does it inside the JVM.  Bytes the page has no
    letter for (nine in windows-1258) leave Latin-1.  Vietnamese tone marks stay
    marks of their own, as the page has them.  NULL stays NULL.
    """
    content = as_col(content)
    given, letters, none = _code_page(code_page)
    no_letter = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in none) + "]" if none else "(?!)"
    latin = F.decode(content, "ISO-8859-1")
    single = let(latin, lambda c: F.when(c.rlike(no_letter), c).otherwise(F.translate(c, given, letters)))
    return F.coalesce(F.regexp_replace(F.try_validate_utf8(content.cast("string")), "^\ufeff", ""), single)


# every named reference of HTML that ends in ';'; a no-break space becomes a space
NAMED_ENTITIES = {f"&{name}": " " if char == "\xa0" else char for name, char in html5.items() if name.endswith(";")}
#: The names are dealt into short lists by their crc32, as Spark would read one map of all from its start.
_ENTITY_LISTS = 512
_ITEM, _VALUE, _LIST = "\x01", "\x02", "\x03"
ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"


@functools.cache
def _entity_lists() -> str:
    lists = [_ITEM] * _ENTITY_LISTS
    for name, char in NAMED_ENTITIES.items():
        lists[zlib.crc32(name.encode()) % _ENTITY_LISTS] += f"{name}{_VALUE}{char}{_ITEM}"
    return _LIST.join(lists)


def _named(t: Column) -> Column:
    """The character of a named reference, NULL for an unknown name."""
    # one literal that is split while the plan is made, in place of thousands that are planned one by one
    own = F.get(F.split(F.lit(_entity_lists()), _LIST), (F.crc32(t.cast("binary")) % _ENTITY_LISTS).cast("int"))
    key = F.concat(F.lit(_ITEM), t, F.lit(_VALUE))
    found = F.substring_index(F.call_function("substring_index", own, key, F.lit(-1)), _ITEM, 1)
    return F.when(F.contains(own, key), found)


def decode_entities(c: str | Column) -> Column:
    """Named and numeric character references decoded in one pass from left to right.

    Unknown names stay as they are; numbers that name no character become U+FFFD.
    """
    def number(t: Column) -> Column:
        digits = F.regexp_extract(t, r"&#[xX]?([0-9a-fA-F]+);", 1)
        code = F.when(F.lower(F.substring(t, 3, 1)) == "x", F.conv(digits, 16, 10)).otherwise(digits).try_cast("int")
        good = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(good, code)), 8, "0")), "UTF-32")
        return F.when(code == 160, " ").otherwise(F.coalesce(char, F.lit("\ufffd")))

    def decoded(t: Column) -> Column:
        return F.when(~t.startswith("&"), t).when(t.startswith("&#") & t.endswith(";"), number(t)).otherwise(
            F.coalesce(_named(t), t))

    def every(t: Column) -> Column:
        parts = F.regexp_extract_all(t, F.lit(f"(?s){ENTITY}|[^&]+|&"), F.lit(0))
        return F.when(t.contains("&") & t.rlike(ENTITY), F.array_join(F.transform(parts, decoded), "")).otherwise(t)

    return let(text(c), every)


def strip_html(c: str | Column) -> Column:
    """Visible text of an HTML fragment: scripts, styles, comments and tags removed."""
    def untagged(t: Column) -> Column:
        out = F.regexp_replace(t, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
        return F.when(t.contains("<"), F.regexp_replace(out, r"(?s)</?[A-Za-z!?][^>]*>", " ")).otherwise(t)

    return F.trim(F.regexp_replace(decode_entities(let(text(c), untagged)), r"\s+", " "))


def remove_html_tags(c: str | Column) -> Column:
    """Text without '<' is only whitespace-cleaned; markup is stripped first."""
    c = text(c)
    return F.when(c.contains("<"), strip_html(c)).otherwise(clean_text_field(c))


def clean_company_name(c: str | Column, patterns=None) -> Column:
    """Drop legal forms, in order, so that spellings of one company group together."""
    out = clean_text_field(c)
    for p in rules.LEGAL_FORM_PATTERNS if patterns is None else patterns:
        out = F.regexp_replace(out, "(?iuU)" + p, "")
    return F.trim(F.regexp_replace(out, r"\s{2,}", " "))


def job_hash(url="url", title="job_title", company="company_name") -> Column:
    """md5 of url, title and company put together without a separator."""
    return F.md5(F.concat(text(url), text(title), text(company)))


def job_id(url="url", title="job_title", company="company_name") -> Column:
    """md5 of the lower-cased, trimmed url|title|company."""
    return F.md5(F.concat_ws("|", *[F.lower(F.trim(text(c))) for c in (url, title, company)]))


def _accent_table() -> tuple[str, str]:
    """Composed Latin letters and their base letter, then combining marks (deleted).

    Built from Unicode decomposition, so letters without one (such as 'đ') stay.
    """
    src, dst = [], []
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        parts = unicodedata.normalize("NFD", chr(cp))
        base = "".join(ch for ch in parts if unicodedata.category(ch) != "Mn")
        if len(parts) > 1 and len(base) == 1:
            src.append(chr(cp))
            dst.append(base)
    marks = [chr(cp) for cp in range(0x300, 0x370)]
    return "".join(src + marks), "".join(dst)


ACCENTED, PLAIN = _accent_table()


def strip_diacritics(c: str | Column) -> Column:
    return F.translate(as_col(c), ACCENTED, PLAIN)


def canonical_url(c: str | Column, base: str | None = None) -> Column:
    """Query string dropped; a relative link is put behind ``base``."""
    c = F.regexp_replace(text(c), r"\?.*$", "")
    if base is None:
        return c
    return F.when((c != "") & ~c.startswith("http"), F.concat(F.lit(base), c)).otherwise(c)


def is_valid_url(c: str | Column) -> Column:
    """Scheme is http(s) and a host is present."""
    return text(c).rlike(r"(?i)^https?://[^/?#]+")


def has_http_prefix(c: str | Column) -> Column:
    """Row filter form: http(s):// followed by at least one non-space character."""
    return F.coalesce(as_col(c).rlike(r"(?i)^https?://[^\s]+"), F.lit(False))


def comma_list(c: str | Column) -> Column:
    """Comma string to a list of trimmed, non-empty items."""
    return F.filter(F.transform(F.split(text(c), ","), lambda x: F.trim(x)), lambda x: x != "")


def slugify(c: str | Column) -> Column:
    """Stable ASCII file-name part."""
    s = F.trim(F.regexp_replace(F.lower(text(c)), r"[^a-z0-9]+", " "))
    s = F.regexp_replace(s, " ", "_")
    return F.when(s == "", F.lit("export")).otherwise(s)
