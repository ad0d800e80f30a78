"""Column helpers: durations, epoch conversions, safe casts, array access."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UNITS = {"s": "seconds", "second": "seconds", "m": "minutes", "minute": "minutes", "h": "hours", "hour": "hours", "d": "days", "day": "days"}
EPOCH = "timestamp_ntz'1970-01-01'"


def duration(text: str) -> str:
    """``5s``, ``1m``, ``1 HOURS`` … as a Spark interval string."""
    m = re.fullmatch(r"\s*(\d+)\s*([A-Za-z]+)\s*", text)
    unit = m and (_UNITS.get(m[2].lower()) or _UNITS.get(m[2].lower().rstrip("s")))
    if not unit or int(m[1]) == 0:
        raise ValueError(f"not a duration: {text!r}")
    return f"{int(m[1])} {unit}"


def duration_micros(text: str) -> int:
    n, unit = duration(text).split()
    return int(n) * {"seconds": 1, "minutes": 60, "hours": 3600, "days": 86400}[unit] * 1_000_000


def epoch_micros(ts: Column) -> Column:
    """Exact microseconds since 1970 of a zone-free timestamp."""
    return F.timestamp_diff("MICROSECOND", F.expr(EPOCH), ts)


def epoch_seconds(ts: Column) -> Column:
    return epoch_micros(ts) / F.lit(1e6)


def from_micros(micros: Column) -> Column:
    return F.timestamp_add("MICROSECOND", micros, F.expr(EPOCH))


def from_seconds(seconds: Column) -> Column:
    """Float seconds since 1970 as a zone-free timestamp, to the microsecond."""
    return from_micros(F.round(seconds * 1e6).cast("long"))


def latency_seconds(ts: Column, now: Column) -> Column:
    return (epoch_micros(now) - epoch_micros(ts)) / F.lit(1e6)


def floor_to(ts: Column, every: str) -> Column:
    step = duration_micros(every)
    return from_micros(F.floor(epoch_micros(ts) / step).cast("long") * step)


def number(text: Column) -> Column:
    """A double, or null where the text is not a number."""
    return text.try_cast("double")


def base_currency(symbol: Column) -> Column:
    return F.try_element_at(F.split(symbol, "-"), F.lit(1))


def quote_currency(symbol: Column) -> Column:
    return F.try_element_at(F.split(symbol, "-"), F.lit(2))


def row_of(matrix: Column, i: int) -> Column:
    """The i-th row (from 1) of a 2-D array; null when it is absent."""
    return F.try_element_at(matrix, F.lit(i))


def first_of(matrix: Column, i: int, level: int = 1) -> Column:
    """Value at ``level`` (from 1) of row i; null when either is absent."""
    return F.try_element_at(row_of(matrix, i), F.lit(level))


def millionths(x: Column) -> Column:
    """x in whole millionths, so that sums are exact."""
    return F.floor(x * 1e6 + 0.5).cast("long")


def free(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like ``wanted`` that ``df`` does not have, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
