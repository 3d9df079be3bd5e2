"""Trading, weekday and calendar-day generators, gaps between them and the stored dates.

Holidays are a predicate on the date column, so the calendar needs no lookup table
and no join: rules are evaluated inside the generated code that explodes the date
span, with the only movable feast computed from its year. A span holds one row per day, a few tens of thousands at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from barwright.functions.series import by_date, dealt

# Single-day closures outside the yearly rules, since 1963.
SPECIAL_CLOSURES = [
    "1963-11-25", "1968-04-09", "1969-02-10", "1969-03-31", "1969-07-21",
    "1972-11-07", "1972-12-28", "1973-01-25", "1976-11-02", "1977-07-14",
    "1980-11-04", "1985-09-27",
    "1994-04-27",
    "2001-09-11", "2001-09-12", "2001-09-13", "2001-09-14",
    "2004-06-11",
    "2007-01-02",
    "2012-10-29", "2012-10-30",
    "2018-12-05",
    "2025-01-09",
]


def good_friday(year: Column) -> Column:
    """Friday before Easter Sunday of any Gregorian year, as an expression.

    Steps are bound to names by one-element arrays: written out, they would repeat each
    other until the generated method is too long to be compiled.
    """

    def bound(value: Column, use: Callable[[Column], Column]) -> Column:
        return F.get(F.transform(F.array(value), use), F.lit(0))

    golden, century = year % 19, _div(year, 100)
    h = (century - _div(century, 4) - _div(8 * century + 13, 25) + 19 * golden + 15) % 30
    moon = lambda h: h - F.when((h == 29) | ((h == 28) & (golden > 10)), 1).otherwise(0)
    week = lambda i: i - (year + _div(year, 4) + i + 2 - century + _div(century, 4)) % 7
    # Days from the 28th of March to Easter Sunday, then two back.
    days = bound(h, lambda h: bound(moon(h), week))
    return F.date_add(F.make_date(year, F.lit(3), F.lit(28)), (days - 2).cast("int"))


def _div(a: Column, b: int) -> Column:
    return F.floor(a / b).cast("int")


def _dates(name: str, values: list[str]) -> Column:
    return F.expr(f"{name} IN ({', '.join(f"DATE '{v}'" for v in values)})")


def is_holiday(name: str = "date") -> Column:
    day = F.col(name)
    y, m, d, w = F.year(day), F.month(day), F.dayofmonth(day), F.weekday(day)

    def observed(month, dom, before=True):
        hit = (d == dom) | ((d == dom + 1) & (w == 0))
        if before:
            hit = hit | ((d == dom - 1) & (w == 4))
        return (m == month) & hit

    rules = [
        observed(1, 1, before=False),
        (y >= 1998) & (m == 1) & (w == 0) & d.between(15, 21),
        # Mondays since 1971, fixed days before.
        (y >= 1971) & (m == 2) & (w == 0) & d.between(15, 21),
        (y < 1971) & observed(2, 22),
        m.isin(3, 4) & (w == 4) & (day == good_friday(y)),
        (y >= 1971) & (m == 5) & (w == 0) & (d >= 25),
        (y < 1971) & observed(5, 30),
        (y >= 2022) & observed(6, 19),
        observed(7, 4),
        (m == 9) & (w == 0) & (d <= 7),
        (m == 11) & (w == 3) & d.between(22, 28),
        observed(12, 25),
        _dates(name, SPECIAL_CLOSURES),
    ]
    out = rules[0]
    for rule in rules[1:]:
        out = out | rule
    return out


def is_weekday(name: str = "date") -> Column:
    return F.weekday(name) < 5


def is_trading_day(name: str = "date") -> Column:
    return is_weekday(name) & ~is_holiday(name)


def span_of(df: DataFrame, *keys: str, date: str = "date") -> DataFrame:
    """First and last date, for the whole table or for each key."""
    return df.groupBy(*keys).agg(F.min(date).alias("first_date"), F.max(date).alias("last_date"))


def days(spans: DataFrame, kind: str = "calendar", start: str = "first_date", end: str = "last_date") -> DataFrame:
    """Every ``calendar``, ``weekday`` or ``trading`` day of each span."""
    out = spans.filter(F.col(start) <= F.col(end)).withColumn(
        "date", F.explode(F.sequence(F.col(start), F.col(end)))
    )
    if kind == "weekday":
        out = out.filter(is_weekday())
    elif kind == "trading":
        out = out.filter(is_trading_day())
    elif kind != "calendar":
        raise ValueError(f"unknown calendar {kind}")
    return out.drop(start, end)


def missing_days(bars: DataFrame, spans: DataFrame, kind: str = "trading", tasks: int | None = None) -> DataFrame:
    """Expected (symbol, date) pairs that are not stored. Needs ``bars`` keyed on both.

    ``tasks`` is how many the days are dealt to, for a panel of which too many would meet in one.
    """
    return dealt(days(spans, kind), tasks, "symbol", "date").join(bars.select("symbol", "date"), ["symbol", "date"], "left_anti")


def ranges(missing: DataFrame, max_step: int = 3) -> DataFrame:
    """Merge missing dates into ranges; a step of more than ``max_step`` days starts a new one."""
    step = F.datediff("date", F.lag("date").over(by_date()))
    marked = missing.withColumn("island", F.sum(F.when(step > max_step, 1).otherwise(0)).over(by_date()))
    return marked.groupBy("symbol", "island").agg(
        F.min("date").alias("range_start"), F.max("date").alias("range_end"), F.count("*").alias("days")
    ).drop("island")


def chunks(spans: DataFrame, size: int = 1000, start: str = "first_date", end: str = "last_date") -> DataFrame:
    """Split each span into consecutive pieces of at most ``size`` days."""
    step = F.expr(f"INTERVAL {size} DAYS")
    piece = F.explode(F.sequence(F.col(start), F.col(end), step)).alias("chunk_start")
    keys = [c for c in spans.columns if c not in (start, end)]
    return spans.select(*keys, end, piece).select(
        *keys, "chunk_start", F.least(F.date_add("chunk_start", size - 1), F.col(end)).alias("chunk_end")
    )
