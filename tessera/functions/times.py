"""Date and time functions with PostgreSQL's meaning."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def extract(field: str, t: Column) -> Column:
    """Fields of a timestamp; dow counts from Sunday 0, isodow from Monday 1."""
    year = F.year(t)
    up = lambda n: F.floor((year + n - 1) / n)  # noqa: E731  years from 1 on
    of = {
        "year": lambda: year, "month": lambda: F.month(t), "day": lambda: F.dayofmonth(t), "hour": lambda: F.hour(t), "minute": lambda: F.minute(t), "second": lambda: F.second(t),
        "quarter": lambda: F.quarter(t), "doy": lambda: F.dayofyear(t), "dow": lambda: F.dayofweek(t) - 1, "isodow": lambda: F.weekday(t) + 1, "week": lambda: F.weekofyear(t),
        "decade": lambda: F.floor(year / 10), "century": lambda: up(100), "millennium": lambda: up(1000), "epoch": lambda: F.unix_timestamp(t),
    }
    if field not in of:
        raise ValueError(f"no field {field}")
    return of[field]().cast("long")


date_part = extract


def now() -> Column:
    """The time at which the query began, which Spark fixes for all rows; also that of the transaction and the statement, as each query is its own."""
    return F.current_timestamp()


transaction_timestamp = statement_timestamp = clock_timestamp = current_timestamp = now


def current_date() -> Column:
    return F.current_date()


def localtimestamp() -> Column:
    return F.localtimestamp()


def current_time() -> Column:
    return F.date_format(now(), "HH:mm:ss")


localtime = current_time


def make_date(y: Column, m: Column, d: Column) -> Column:
    """NULL for a day that the month lacks."""
    return F.format_string("%04d-%02d-%02d", y, m, d).try_cast("date")


def make_time(h: Column, m: Column, s: Column) -> Column:
    return F.format_string("%02d:%02d:%02d", h, m, s)


def make_timestamp(y: Column, mo: Column, d: Column, h: Column, mi: Column, s: Column) -> Column:
    return F.format_string("%04d-%02d-%02d %02d:%02d:%02d", y, mo, d, h, mi, s).try_cast("timestamp")


def timezone(zone: str, t: Column) -> Column:
    """Wall clock of a fixed offset (UTC+h[:mm]) or named zone."""
    return F.from_utc_timestamp(t, re.sub(r"^UTC(?=[+-])", "GMT", zone))


_UNITS = {"year": "years", "month": "months", "mon": "months", "week": "weeks", "day": "days", "hour": "hours", "min": "mins", "minute": "mins", "sec": "secs", "second": "secs"}


def interval_parts(text: str) -> dict[str, float]:
    """years, months, weeks, days, hours, mins and secs of '2 years 3 days', '1-2', '04:05:06', with 'ago' turning signs."""
    out: dict[str, float] = {}

    def add(unit: str, n: float) -> None:
        out[unit] = out.get(unit, 0) + n

    ago = -1 if re.search(r"\bago\s*$", text) else 1
    rest = re.sub(r"\bago\s*$", "", text.strip())
    for m in re.finditer(r"(?P<s>[+-]?)(?P<h>\d+):(?P<m>\d+)(?::(?P<x>\d+(?:\.\d+)?))?|(?P<y>[+-]?\d+)-(?P<mo>\d+)|(?P<n>[+-]?\d+(?:\.\d+)?)\s*(?P<u>[a-z]+)", rest, re.I):
        if m["h"]:
            sign = -1 if m["s"] == "-" else 1
            add("hours", sign * int(m["h"])), add("mins", sign * int(m["m"])), add("secs", sign * float(m["x"] or 0))
        elif m["y"]:
            add("years", int(m["y"])), add("months", int(m["mo"]) * (-1 if m["y"][0] == "-" else 1))
        else:
            u = m["u"].lower()
            unit = _UNITS.get(u) or _UNITS.get(u.rstrip("s"))
            if not unit:
                raise ValueError(f"no unit {m['u']}")
            add(unit, float(m["n"]))
    if not out:
        raise ValueError(f"no interval: {text}")
    return {k: ago * v for k, v in out.items()}


def interval(text: str, times: int = 1) -> Column:
    p = {k: v * times for k, v in interval_parts(text).items()}
    whole = lambda k: F.lit(int(p.get(k, 0)))
    return F.make_interval(whole("years"), whole("months"), whole("weeks"), whole("days"), whole("hours"), whole("mins"), F.lit(p.get("secs", 0.0)).cast("decimal(18,6)"))


def scaled(text: str, times: Column) -> Column:
    """An interval times a number of each row."""
    return interval(text) * times


def plus(t: Column, text: str, times: int = 1) -> Column:
    """A timestamp moved by an interval: months and days by the calendar, a day that the month lacks becoming its last."""
    return t + interval(text, times)


#: Tokens of date patterns, longest first, and what they stand for in Spark's patterns.
TOKENS = {"HH24": "HH", "HH12": "hh", "YYYY": "yyyy", "MONTH": "MMMM", "MON": "MMM", "DDD": "DDD", "DAY": "EEEE", "YYY": None, "YY": "yy", "DY": "EEE", "MM": "MM", "DD": "dd", "HH": "hh", "MI": "mm", "SS": "ss", "AM": "a", "PM": "a", "WW": None, "Q": "q", "D": None, "Y": None}


def to_char(t: Column, pattern: str) -> Column:
    """A date by a pattern of tokens; text in double quotes and other characters stand for themselves. Names are upper-case, padded to nine letters where full."""
    out: list[Column] = []
    i = 0
    while i < len(pattern):
        if pattern[i] == '"':
            end = pattern.find('"', i + 1)
            end = len(pattern) if end < 0 else end
            out.append(F.lit(pattern[i + 1 : end]))
            i = end + 1
            continue
        token = next((k for k in TOKENS if pattern.startswith(k, i)), None)
        if token is None:
            out.append(F.lit(pattern[i]))
            i += 1
            continue
        i += len(token)
        own = {
            "MONTH": lambda: F.rpad(F.upper(F.date_format(t, "MMMM")), 9, " "), "MON": lambda: F.upper(F.date_format(t, "MMM")), "DAY": lambda: F.rpad(F.upper(F.date_format(t, "EEEE")), 9, " "),
            "DY": lambda: F.upper(F.date_format(t, "EEE")), "YYY": lambda: F.right(F.date_format(t, "yyyy"), F.lit(3)), "Y": lambda: F.right(F.date_format(t, "yyyy"), F.lit(1)),
            "WW": lambda: F.lpad((F.floor((F.dayofyear(t) - 1) / 7) + 1).cast("string"), 2, "0"), "D": lambda: F.dayofweek(t).cast("string"), "DDD": lambda: F.lpad(F.dayofyear(t).cast("string"), 3, "0"), "Q": lambda: F.quarter(t).cast("string"),
        }
        out.append(own[token]() if token in own else F.date_format(t, TOKENS[token]))
    return F.concat(*out) if out else F.lit("")


def number_to_char(x: Column, pattern: str) -> Column:
    """Digits by 9 (blank for a leading zero), 0 and a point; FM takes the blanks away. Too wide a number becomes #."""
    fill = pattern.startswith("FM")
    body = pattern.removeprefix("FM")
    head, _, tail = body.partition(".")
    if set(head + tail) - {"9", "0"}:
        raise ValueError(f"no numeric pattern: {pattern}")
    r = F.round(F.abs(x), len(tail))
    least = len(head) - head.index("0") if "0" in head else (0 if tail else 1)
    whole = F.floor(r).cast("string")
    digits = F.when((F.floor(r) == 0) & (F.lit(least) == 0), F.lit("")).otherwise(F.when(F.length(whole) < least, F.lpad(whole, least, "0")).otherwise(whole))
    text = F.concat(F.when(x < 0, "-").otherwise("" if fill else " "), digits)
    text = text if fill else F.lpad(text, len(head) + 1, " ")
    if tail:
        text = F.concat(text, F.lit("."), F.lpad(F.round((r - F.floor(r)) * 10 ** len(tail)).cast("long").cast("string"), len(tail), "0"))
    return F.when(F.length(whole) > len(head), F.lit("#" * len(body))).otherwise(text)
