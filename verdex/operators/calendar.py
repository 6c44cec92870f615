"""Business days and business hours as closed forms: no row is expanded into days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _weekdays_to(day: Column) -> Column:
    """Weekdays from Monday, 5 January 1970, up to and with a day."""
    n = F.datediff(day, F.lit("1970-01-05").cast("date"))
    return 5 * F.floor(n / 7) + F.least(F.pmod(n, F.lit(7)) + 1, F.lit(5))


def business_days(a: Column, b: Column) -> Column:
    """RUL-03: Monday to Friday days after a up to b; before a, those from b to the day before a, negative."""
    before = lambda d: _weekdays_to(F.date_sub(d, 1))
    return F.when(b >= a, _weekdays_to(b) - _weekdays_to(a)).otherwise(before(b) - before(a)).cast("bigint")


def business_index(day: Column) -> Column:
    """A number of the business day, the same for a weekend as for the Friday before it; neighbours differ by one."""
    return _weekdays_to(day).cast("bigint")


def add_business_days(start: Column, n: Column, holidays: Column) -> Column:
    """TMP-01, FIN-09: the n-th day after start that is neither on a weekend nor among the holidays (an array of dates)."""
    last = F.date_add(start, (7 * F.ceil((n + F.size(F.coalesce(holidays, F.array().cast("array<date>")))) / 5) + 7).cast("int"))
    days = F.filter(F.sequence(F.date_add(start, 1), last), lambda d: (F.weekday(d) < 5) & ~F.coalesce(F.array_contains(holidays, d), F.lit(False)))
    return F.get(days, (n - 1).cast("int"))


def sla_deadline(opened: Column, hours: Column, first: int = 9, last: int = 17) -> Column:
    """TMP-02: when the clock, which runs Monday to Friday from first to last, has run for some hours (over 0) since opened.

    A clock that is full at the end of a day stops there, not on the next morning. Seconds are dropped.
    """
    day, minute = F.to_date(opened), F.hour(opened) * 60 + F.minute(opened)
    late = (minute >= last * 60) | (F.weekday(day) >= 5)
    begin = F.when(late, F.date_add(day, F.when(F.weekday(day) == 4, 3).when(F.weekday(day) == 5, 2).otherwise(1))).otherwise(day)
    total = F.when(late, 0).otherwise(F.greatest(minute - first * 60, F.lit(0))) + hours * 60
    length = (last - first) * 60
    days = F.floor((total - 1) / length).cast("int")
    due = F.date_add(begin, (days + 2 * F.floor((F.weekday(begin) + days) / 5)).cast("int"))
    return F.timestamp_add("MINUTE", (first * 60 + total - length * days).cast("int"), due.cast("timestamp_ntz"))


def thirty_360(a: Column, b: Column) -> Column:
    """TRD-06: days between two dates in months of 30 days; a 31st counts as a 30th."""
    return (F.year(b) - F.year(a)) * 360 + (F.month(b) - F.month(a)) * 30 + F.least(F.day(b), F.lit(30)) - F.least(F.day(a), F.lit(30))
