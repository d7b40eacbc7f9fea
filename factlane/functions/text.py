"""String and array Column helpers (JVM-side, inside whole-stage codegen).

All helpers return a ``Column``; none of them touches Python per row.
"""

from __future__ import annotations

import re
from functools import reduce
from typing import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's ``str.isspace`` accepts, written as one regex class
# that Java regex and RE2 read the same way.
SPACE_CLASS = r"[\x09-\x0D\x1C-\x1F\x85\p{Z}]"
_STRIP_RE = rf"\A{SPACE_CLASS}+|{SPACE_CLASS}+\z"


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ustrip(c) -> Column:
    """Strip leading and trailing white space the way Python's ``str.strip`` does
    (tabs, newlines, NBSP, ...); ``trim`` only removes the blank."""
    return F.regexp_replace(col_of(c), _STRIP_RE, "")


def lower_text(c) -> Column:
    return F.lower(col_of(c))


def contains_any(c, needles: Iterable[str]) -> Column:
    """True when any needle is a substring; folded into one OR chain."""
    c = col_of(c)
    needles = list(needles)
    if not needles:
        return F.lit(False)
    return reduce(lambda a, b: a | b, [c.contains(n) for n in needles])


def word_pattern(words: Iterable[str]) -> str:
    """Regex matching any word as a whole word. Word characters are Unicode
    letters, digits and ``_``, spelled out because the meaning of Java's
    ``\\b`` depends on its release."""
    return r"(?<![\p{L}\p{N}_])(" + "|".join(re.escape(w) for w in words) + r")(?![\p{L}\p{N}_])"


def contains_word(c, words: Iterable[str]) -> Column:
    return col_of(c).rlike(word_pattern(words))


def starts_with(c, prefix: str) -> Column:
    return col_of(c).startswith(prefix)


def truncate(c, n: int) -> Column:
    return F.substring(col_of(c), 1, n)


def capitalize(c) -> Column:
    """Python's ``str.capitalize``: first character upper, the rest lower."""
    c = col_of(c)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 2147483647)))


def py_str(c, null_as: str = "None") -> Column:
    """Text of a value as an f-string prints it; null prints as ``None``."""
    return F.coalesce(col_of(c).cast("string"), F.lit(null_as))


def first_line_matching(text, prefix: str, needles: list[str]) -> Column:
    """First line that, stripped and lower-cased, starts with ``prefix`` and holds
    any needle; null when none does. Returns the normalised line."""
    lines = F.transform(F.split(col_of(text), "\n"), lambda x: F.lower(ustrip(x)))
    hits = F.filter(lines, lambda x: x.startswith(prefix) & contains_any(x, needles))
    return F.try_element_at(hits, F.lit(1))


def array_argmax(c) -> Column:
    """0-based position of the first maximum of an array."""
    c = col_of(c)
    return (F.array_position(c, F.array_max(c)) - 1).cast("int")


def timestamp_tag() -> Column:
    """``yyyyMMdd_HHmmss`` stamp used in output names."""
    return F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss")
