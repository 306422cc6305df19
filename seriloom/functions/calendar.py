"""Week arithmetic. Weeks run Monday to Sunday and are labelled by their Sunday."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def week_end(day: Column) -> Column:
    """Sunday that closes the week of ``day`` (a Sunday maps to itself)."""
    return F.next_day(F.date_sub(day, 1), "SUN")


def week_start(day: Column) -> Column:
    """Monday that opens the week of ``day``."""
    return F.date_sub(F.next_day(day, "MON"), 7)


def season_angle(week_number: Column) -> Column:
    return week_number * F.lit(2 * math.pi) / F.lit(52.0)


def iso_monday(year: Column, week: Column) -> Column:
    """Monday of an ISO week: the Monday of 4 January's week plus whole weeks."""
    fourth = F.make_date(year, F.lit(1), F.lit(4))
    return F.date_add(week_start(fourth), ((week - 1) * 7).cast("int"))


def wrap_week(week: Column) -> Column:
    """1..52 wrap-around used for future weeks (53-week years are ignored)."""
    return ((week - 1) % 52) + 1


def add_weeks_iso(year: Column, week: Column, h: Column) -> tuple[Column, Column]:
    """(year, week) moved forward by ``h`` ISO weeks, so years of 53 weeks have their last one."""
    monday = F.date_add(iso_monday(year, week), (h * 7).cast("int"))
    return F.extract(F.lit("YEAROFWEEK"), monday).cast("int"), F.weekofyear(monday)


def add_weeks_52(year: Column, week: Column, h: Column) -> tuple[Column, Column]:
    """(year, week) moved forward by ``h`` weeks in a 52-week calendar."""
    total = week + h
    over = total > 52
    return (
        F.when(over, year + 1).otherwise(year),
        F.when(over, total - 52).otherwise(total),
    )
