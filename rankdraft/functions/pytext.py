"""String helpers whose results equal Python's ``str`` and ``re`` behaviour.

Spark's ``trim`` knows only U+0020 and Java's ``\\s`` is ASCII, so both are spelled
out here.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters for which Python's str.isspace() is true.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same as a class; it needs the (?U) flag in front of the pattern.
SPACE = r"[\s\x1c-\x1f]"
WORD = r"[\p{L}\p{N}_]"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE_CHARS))


def word_count(c: Column) -> Column:
    words = F.split(c, f"(?U){SPACE}+")
    return F.size(F.filter(words, lambda w: w != ""))


def replace(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def replace_first(c: Column, pattern: str, new: str, count: int) -> Column:
    """Replace only the first ``count`` matches of a regex by a plain string."""
    return F.array_join(F.split(c, pattern, count + 1), new)


def contains_any(c: Column, parts: Iterable[str]) -> Column:
    found = F.lit(False)
    for part in parts:
        found = found | c.contains(part)
    return found


def any_phrase(c: Column, phrases: Iterable[str]) -> Column:
    """``contains_any`` for short values and many plain phrases, in one search."""
    return F.rlike(c, F.lit("|".join(re.escape(p) for p in phrases)))


def match_start(c: Column, regex: str) -> Column:
    """True where a case-insensitive regex matches at the start of the value."""
    return F.rlike(c, F.lit(rf"\A(?iuUd:{regex})"))


def find_between(c: Column, start: str, end: str) -> Column:
    """Stripped text after the first ``start`` up to ``end``; null without ``start``.

    A second ``start`` also ends the text, and without ``end`` it runs on.
    """
    at = F.locate(start, c)
    rest = F.substr(c, at + len(start))
    value = F.substring_index(F.substring_index(rest, start, 1), end, 1)
    return F.when(at > 0, strip(value))


def first_reason(*checks: tuple[Column, Column | str]) -> Column:
    """Text of the first check that holds, null when none does."""
    texts = [
        F.when(cond, text if isinstance(text, Column) else F.lit(text))
        for cond, text in checks
    ]
    return F.coalesce(*texts, F.lit(None).cast("string"))


def percent(part: Column, whole: Column) -> Column:
    """``round(100 * part / whole, 2)`` with Python's rounding; null when whole is 0.

    ``format_number`` rounds the exact binary value half-even, as Python does.
    ``round`` and ``bround`` work on the shortest decimal form and differ.
    """
    value = (part * 100).cast("double") / whole.cast("double")
    return F.when(whole > 0, F.format_number(value, 2).cast("double"))
