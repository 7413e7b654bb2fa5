"""Dates in captured values."""

from __future__ import annotations

import datetime
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

YMD = r"(\d{4})[-/年](\d{1,2})[-/月](\d{1,2})日?"
MDY = r"(\d{1,2})[-/](\d{1,2})[-/](\d{4})"


def _made(c: Column, pattern: str, year: int, month: int, day: int) -> Column:
    part = lambda i: F.regexp_extract(c, pattern, i)
    return F.when(c.rlike(pattern), F.to_date(F.try_make_timestamp(part(year).try_cast("int"), part(month).try_cast("int"), part(day).try_cast("int"), F.lit(0), F.lit(0), F.lit(0))))


def parsed(c: Column) -> Column:
    """Year-month-day, else month-day-year; null for days that don't exist."""
    return F.coalesce(_made(c, YMD, 1, 2, 3), _made(c, MDY, 3, 1, 2))


def plausible(day: Column, as_of: datetime.date) -> Column:
    """From ten years before to five years after a stated day."""
    return day.between(F.lit(as_of - datetime.timedelta(days=3650)), F.lit(as_of + datetime.timedelta(days=1825)))


_YMD, _MDY = re.compile(YMD, re.A), re.compile(MDY, re.A)


def day_of(value: str) -> datetime.date | None:
    """``parsed`` of one text."""
    for m, order in ((_YMD.search(value), (1, 2, 3)), (_MDY.search(value), (3, 1, 2))):
        try:
            if m:
                return datetime.date(*(int(m[i]) for i in order))
        except ValueError:
            pass
    return None
