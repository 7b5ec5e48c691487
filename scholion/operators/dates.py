"""Dates of variable precision and closed windows.

A date text is ``YYYY``, ``YYYY-MM`` or ``YYYY-MM-D[D]``; it stands for the days from its first to its last. Texts
that are empty or cannot be read have no range and pass every window.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholion.functions.text import _c, text


@dataclass(frozen=True)
class Window:
    """A closed range of days."""

    start: date
    end: date

    @property
    def days(self) -> int:
        return (self.end - self.start).days + 1


def parse_day(value: str | date | None, default: date | None = None) -> date:
    if isinstance(value, datetime):
        return value.date()
    if isinstance(value, date):
        return value
    if not value or not str(value).strip():
        if default is None:
            raise ValueError("no date given")
        return default
    return datetime.strptime(str(value).strip(), "%Y-%m-%d").date()


def window(end: str | date, days: int = 1) -> Window:
    if days < 1:
        raise ValueError("a window has at least one day")
    last = parse_day(end)
    return Window(last - timedelta(days=days - 1), last)


def window_between(start: str | date, end: str | date) -> Window:
    got = Window(parse_day(start), parse_day(end))
    if got.start > got.end:
        raise ValueError("the window ends before it starts")
    return got


def months(of: Window) -> list[Window]:
    """The window cut at the ends of months."""
    out, first = [], of.start
    while first <= of.end:
        after = (first.replace(day=1) + timedelta(days=32)).replace(day=1)
        out.append(Window(first, min(of.end, after - timedelta(days=1))))
        first = after
    return out


def day_range(x: Column | str) -> tuple[Column, Column]:
    """First and last day that a date text stands for; nulls where it cannot be read."""
    parts = F.split(F.trim(text(_c(x))), "-")
    # One figure or more and nothing else; "2025-Summer" has no range at all.
    number = lambda i: F.try_element_at(parts, F.lit(i))
    y, m, d = (number(i) for i in (1, 2, 3))
    bad = F.lit(False)
    for p in (y, m, d):
        bad = bad | (p.isNotNull() & ~p.rlike(r"^\s*\d+\s*$"))
    ny, nm, nd = (F.when(~bad, F.coalesce(p.try_cast("int"), F.lit(0))) for p in (y, m, d))
    year = F.when((ny > 0) & (ny <= 9999), ny)
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    day = F.try_to_date(F.concat_ws("-", pad(year, 4), pad(nm, 2), pad(nd, 2)), "yyyy-MM-dd")
    month = F.try_to_date(F.concat_ws("-", pad(year, 4), pad(nm, 2), F.lit("01")), "yyyy-MM-dd")
    jan, dec = (F.try_to_date(F.concat_ws("-", pad(year, 4), F.lit(s)), "yyyy-MM-dd") for s in ("01-01", "12-31"))
    two, three = nm > 0, (nm > 0) & (nd > 0)
    lo = F.when(year.isNotNull(), F.when(three, F.when((nm <= 12) & (nd <= 31), day)).when(two, F.when(nm <= 12, month)).otherwise(jan))
    hi = F.when(year.isNotNull(), F.when(three, F.when((nm <= 12) & (nd <= 31), day)).when(two, F.when(nm <= 12, F.last_day(month))).otherwise(dec))
    return lo, hi


def overlaps(x: Column | str, of: Window) -> Column:
    lo, hi = day_range(x)
    return F.coalesce((lo <= F.lit(of.end)) & (hi >= F.lit(of.start)), F.lit(True))


def in_window(rows: DataFrame, of: Window, date_col: str = "date", first_col: str = "date_for_window") -> DataFrame:
    """Rows whose date for windows, else date, touches the window; the date used becomes the date. Undated rows pass."""
    own = F.trim(F.when(text(first_col) != "", text(first_col)).otherwise(text(date_col)))
    return rows.withColumn("__d", own).where((F.col("__d") == "") | overlaps("__d", of)).withColumn(date_col, F.when(F.col("__d") == "", F.col(date_col)).otherwise(F.col("__d"))).drop("__d")
