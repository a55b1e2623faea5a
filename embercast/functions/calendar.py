"""Calendar expressions (F1-F6, F13, F14). All built-in, codegen-friendly."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_dry_season(month: str | Column, months=None) -> Column:
    """1 when the month is in the dry season, else 0."""
    return _c(month).isin(months or fixed.DRY_SEASON_MONTHS).cast("int")


def cyclic(value: str | Column, period: float) -> tuple[Column, Column]:
    """(sin, cos) of 2*pi*value/period. Day 366 overshoots by design."""
    angle = F.lit(2 * math.pi) * _c(value) / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def season(month: str | Column, seasons=None) -> Column:
    """southern-hemisphere season text."""
    m = _c(month)
    out = None
    for name, months in (seasons or fixed.SEASONS):
        out = F.when(m.isin(months), F.lit(name)) if out is None else out.when(m.isin(months), F.lit(name))
    return out


def weekday_mon0(date: str | Column) -> Column:
    """weekday with Monday = 0."""
    return F.weekday(_c(date))


def yesterday() -> Column:
    """default run date."""
    return F.date_sub(F.current_date(), 1)


def elapsed_micros(ts: str | Column, first: str | Column) -> Column:
    """Exact microseconds since the first reading."""
    return F.unix_micros(_c(ts).cast("timestamp")) - F.unix_micros(_c(first).cast("timestamp"))


def elapsed_minutes(ts: str | Column, first: str | Column) -> Column:
    """minutes since the first reading."""
    return elapsed_micros(ts, first) / 6e7
