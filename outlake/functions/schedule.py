"""Send windows and follow-up cadences as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hours of a window that can't be read, and its days (Monday is 0).
START, END, DAYS = 8, 17, (0, 1, 2, 3, 4)
MOST_STEPS, LEAST_GAP, MOST_GAP = 4, 1, 90
LOOKAHEAD_HOURS = 24 * 15


def count_of(value: Column) -> Column:
    """A stored count; null, blank and junk are 0."""
    return F.coalesce(value.try_cast("int"), F.lit(0))


def normal_window(enabled: Column, zone: Column, days: Column, start: Column, end: Column, zones: list[str]) -> Column:
    """A window that can be acted on: hours within the day, days sorted once each; a window without length or days
    falls back to the usual one; zones that aren't among ``zones`` are local time ('')."""
    hour = lambda x, d: F.greatest(F.lit(0), F.least(F.lit(23), F.coalesce(x, F.lit(d))))
    usual = F.array(*[F.lit(d) for d in DAYS])
    good = F.array_sort(F.array_distinct(F.filter(F.coalesce(days, usual), lambda d: d.between(0, 6))))
    s, e = hour(start, START), hour(end, END)
    bad = e <= s
    return F.struct(
        F.coalesce(enabled, F.lit(False)).alias("enabled"),
        F.when(F.trim(zone).isin(*zones), F.trim(zone)).otherwise("").alias("zone"),
        F.when(F.size(good) > 0, good).otherwise(usual).alias("days"),
        F.when(bad, START).otherwise(s).alias("start_hour"),
        F.when(bad, END).otherwise(e).alias("end_hour"),
    )


def _local(moment: Column, zone: Column) -> Column:
    return F.from_utc_timestamp(moment, F.when(zone != "", zone).otherwise("UTC"))


def _within(window: Column, local: Column) -> Column:
    hour = F.hour(local)
    return F.array_contains(window["days"], F.weekday(local)) & (window["start_hour"] <= hour) & (hour < window["end_hour"])


def is_open(window: Column, moment: Column) -> Column:
    """Whether a normal window is open at a moment (UTC timestamp); a disabled one never is."""
    return window["enabled"] & _within(window, _local(moment, window["zone"]))


def next_opening(window: Column, moment: Column) -> Column:
    """The moment itself while the window is open, else the first full local hour within 15 days that is in the window;
    null for a disabled window.  Hours are stepped in UTC, so that hours that clocks skip aren't promised."""
    zone = window["zone"]
    local = _local(moment, zone)
    into = F.expr("make_dt_interval(0, 1, 0, 0)")
    # the local hour's beginning, as an instant
    first = moment - F.make_dt_interval(F.lit(0), F.lit(0), F.minute(local), F.date_part(F.lit("SECOND"), local).cast("decimal(18,6)"))
    hours = F.transform(F.sequence(F.lit(1), F.lit(LOOKAHEAD_HOURS)), lambda i: first + into * i)
    found = F.array_min(F.filter(hours, lambda h: _within(window, _local(h, zone))))
    return F.when(window["enabled"], F.when(_within(window, local), moment).otherwise(found))


def normal_cadence(enabled: Column, steps: Column) -> Column:
    """A cadence from stored gaps (strings): the first four are read, non-integers skipped, the rest clamped; without a
    usable gap it is off."""
    first = F.slice(F.coalesce(steps, F.array().cast("array<string>")), 1, MOST_STEPS)
    whole = F.filter(F.transform(first, lambda x: x.try_cast("int")), lambda x: x.isNotNull())
    gaps = F.transform(whole, lambda x: F.greatest(F.lit(LEAST_GAP), F.least(F.lit(MOST_GAP), x)))
    return F.struct((F.coalesce(enabled, F.lit(True)) & (F.size(gaps) > 0)).alias("enabled"), gaps.alias("steps"))
