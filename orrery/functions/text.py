"""Text functions as column expressions.

Names that Spark already has with the same meaning are passed through, so a model
can take every function from one place.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

concat = F.concat
concat_ws = F.concat_ws
strlen = F.length
upper = F.upper
lower = F.lower
initcap = F.initcap
trim = F.trim
ltrim = F.ltrim
rtrim = F.rtrim
lpad = F.lpad
rpad = F.rpad
reverse = F.reverse
repeat = F.repeat
ascii = F.ascii
contains = F.contains
starts_with = F.startswith
ends_with = F.endswith
regexp_count = F.regexp_count


def substr(s: Column, start: int, length: int) -> Column:
    """`length` characters from the zero-based position `start`."""
    return F.substring(s, start + 1, length)


def left(s: Column, n: int) -> Column:
    return F.left(s, F.lit(n))


def right(s: Column, n: int) -> Column:
    return F.right(s, F.lit(n))


def strpos(s: Column, needle: str) -> Column:
    """One-based position of the first occurrence, 0 if there is none."""
    return F.instr(s, needle)


def _occurrences(s: Column, needle: str) -> Column:
    cut = F.length(s) - F.length(F.replace(s, F.lit(needle), F.lit("")))
    return (cut / F.lit(len(needle))).cast("int")


def find_nth(s: Column, needle: str, n: int) -> Column:
    """One-based position of the nth occurrence (not overlapping), 0 if there are fewer."""
    return F.when(
        _occurrences(s, needle) >= n, F.length(F.substring_index(s, needle, n)) + 1
    ).when(s.isNotNull(), 0)


def replace(s: Column, old: str, new: str) -> Column:
    return F.replace(s, F.lit(old), F.lit(new))


def split_part(s: Column, delimiter: str, n: int) -> Column:
    """The nth token, counted from 1, or from the end if `n` is negative."""
    return F.split_part(s, F.lit(delimiter), F.lit(n))


subfield = split_part


def text_between(s: Column, opening: str, closing: str, n: int = 1) -> Column:
    """Text after the nth `opening` up to the next `closing`; NULL if either is absent."""
    at = find_nth(s, opening, n)
    rest = F.substr(s, at + len(opening))
    return F.when((at > 0) & (F.instr(rest, closing) > 0), F.substring_index(rest, closing, 1))


def regexp_like(s: Column, pattern: str) -> Column:
    return s.rlike(pattern)


def regexp_extract(s: Column, pattern: str, group: int = 0) -> Column:
    """The group of the first match, '' if there is no match."""
    return F.regexp_extract(s, pattern, group)


def regexp_replace(s: Column, pattern: str, new: str) -> Column:
    return F.regexp_replace(s, pattern, new)


def regexp_extract_nth(s: Column, pattern: str, n: int, group: int = 0) -> Column:
    """The group of the nth match, NULL if there are fewer."""
    return F.get(F.regexp_extract_all(s, F.lit(pattern), F.lit(group)), n - 1)


def chr(n: Column) -> Column:
    return F.chr(n)


def purge_chars(s: Column, chars: str) -> Column:
    """Drop every listed character."""
    return F.translate(s, chars, "")


def keep_chars(s: Column, chars: str) -> Column:
    """Keep only the listed characters."""
    listed = re.sub(r"([\\\]\[^\-&])", r"\\\1", chars)
    return F.regexp_replace(s, f"[^{listed}]", "")


def map_substring(s: Column, mapping: Mapping[str, str]) -> Column:
    """Replace each key by its value, in the order of the mapping."""
    for old, new in mapping.items():
        s = F.replace(s, F.lit(old), F.lit(new))
    return s


def hash128(s: Column) -> Column:
    return F.md5(s)


def hash256(s: Column) -> Column:
    return F.sha2(s, 256)


def json_path(s: Column, path: str) -> Column:
    """Scalar at a JSON path such as `$.a.b`, as text; NULL where the path is absent."""
    return F.get_json_object(s, path)


def format_number_text(x: Column, digits: int) -> Column:
    """Thousands separators and a fixed number of decimals."""
    return F.format_number(x, digits)


def wild_match(s: Column, *patterns: str) -> Column:
    """True if `s` fits any pattern, where `*` is any text and `?` one character."""
    hit = F.lit(False)
    for p in patterns:
        escaped = p.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
        hit = hit | s.like(escaped.replace("*", "%").replace("?", "_"))
    return hit


def in_list_nocase(s: Column, values: Sequence[str]) -> Column:
    """Membership without regard to case."""
    return F.lower(s).isin([v.lower() for v in values])
