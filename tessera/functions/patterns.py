"""Regular expression functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _flagged(pattern: str, flags: str) -> str:
    own = "".join(c for c in flags if c in "imsx")
    return f"(?{own})" * bool(own) + pattern


def _shifted(text: str, mark: str, by: int) -> str:
    """Numbers of groups, written as a backslash and a digit, moved by so many; mark is written before them."""
    return re.sub(r"(\\\\)|\\([1-9])", lambda m: m[1] or f"{mark}{int(m[2]) + by}", text)


def regexp_replace(s: Column, pattern: str, new: str, flags: str = "") -> Column:
    """The first match only, unless flags have g. Groups are \\1 to \\9."""
    if "g" in flags:
        return F.regexp_replace(s, _flagged(pattern, flags), _shifted(new, "$", 0))
    # what comes before the first match is a group of its own, so that the pattern sees the whole text around it
    return F.regexp_replace(s, _flagged(rf"\A([\s\S]*?)(?:{_shifted(pattern, chr(92), 1)})", flags), "$1" + _shifted(new, "$", 1))


def regexp_match(s: Column, pattern: str, flags: str = "") -> Column:
    """Groups of the first match, or the match if there are none; NULL without one."""
    p = _flagged(pattern, flags)
    n = re.compile(pattern).groups
    return F.when(s.rlike(p), F.array(*[F.regexp_extract(s, p, i) for i in (range(1, n + 1) if n else [0])]))


def regexp_split_to_array(s: Column, pattern: str) -> Column:
    return F.split(s, pattern, -1)


def regexp_count(s: Column, pattern: str, start: int = 1, flags: str = "") -> Column:
    return F.regexp_count(F.substring(s, F.lit(start), F.length(s)), F.lit(_flagged(pattern, flags)))


def regexp_substr(s: Column, pattern: str, start: int = 1, nth: int = 1, flags: str = "") -> Column:
    return F.get(F.regexp_extract_all(F.substring(s, F.lit(start), F.length(s)), F.lit(_flagged(pattern, flags)), F.lit(0)), F.lit(nth - 1))
