"""Punch facts: neighbours, shifts, breaks, meal credits.

Steps take and return a ``Timeline`` keyed by employee and ordered by punch, so the same text runs
as plain windows and as chunks. Within the plain form every window partitions by the employee key
plus at most one sub-group: one exchange serves all of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from shiftledger.config.rules import Rules
from shiftledger.functions import predicates as p
from shiftledger.functions.semantics import (
    denan,
    ge,
    gt,
    hours,
    is_true,
    lt,
    minutes,
    rnd,
    us_between,
)
from shiftledger.functions.timeline import KeyProfile, Timeline, over_lanes
from shiftledger.operators.lookups import lookup_register, lookup_waivers

# The employee comes first: it varies most, which suits the sorter's prefix comparison.
KEYS = ["id", "client_id", "pay_date"]
ORDER = ["in_punch", "out_punch", "seq"]


def punch_length(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "work_date": F.col("in_punch").cast("date"),
            "raw_us": us_between("in_punch", "out_punch"),
        }
    ).withColumn("raw_hours", hours("raw_us"))


def neighbour_punches(t: Timeline) -> Timeline:
    t = t.neighbours(
        prev_in=("in_punch", -1),
        prev_out=("out_punch", -1),
        next_in=("in_punch", 1),
        next_out=("out_punch", 1),
        prev_date=("work_date", -1),
        next_date=("work_date", 1),
        prev_us=("raw_us", -1),
        next_us=("raw_us", 1),
        prev_seq=("seq", -1),
    )
    return t.add(
        prev_hours=hours("prev_us"),
        next_hours=hours("next_us"),
        break_min=minutes(us_between("prev_out", "in_punch")),
        next_break_min=minutes(us_between("out_punch", "next_in")),
        # Rows of one date are adjacent in punch order, so a date change marks its first row.
        first_of_day=F.col("prev_seq").isNull()
        | ~F.col("work_date").eqNullSafe(F.col("prev_date")),
    )


def shifts(t: Timeline, rules: Rules) -> Timeline:
    """A gap of at least the location's threshold, or no gap at all, starts a shift."""
    t = t.lookup(
        lambda df: rules.resolve(
            df, shift_gap="time_gap_for_new_shift", client_wide={"client_min_wage": "min_wage"}
        )
    )
    t = t.add(new_shift=ge("break_min", "shift_gap") | F.col("break_min").isNull())
    t = t.add(is_new_punch=F.col("new_shift") | gt("break_min", F.lit(0)))
    # One pass gives shift numbers, stretch numbers and worked time so far.
    return t.running(
        shift_no=("sum", F.col("new_shift").cast("long")),
        stretch=("sum", F.col("is_new_punch").cast("long")),
        worked_us=("sum", F.coalesce("raw_us", F.lit(0))),
    )


def shift_totals(t: Timeline) -> Timeline:
    """Shift hours, start, breaks; the first row of a shift is the one that started it."""
    t = t.add(
        first_of_shift=F.col("new_shift"),
        is_break=gt("break_min", F.lit(0)) & ~F.col("new_shift"),
    )
    t = t.totals(["shift_no", "stretch"], stretch_us=("sum", F.col("raw_us")))
    t = t.totals(
        ["shift_no"],
        shift_us=("sum", F.col("raw_us")),
        shift_start=("min", F.col("in_punch")),
        break_count=("sum", F.col("is_break").cast("long")),
        first_stretch=("min", F.col("stretch")),
        worked_before=(
            "max",
            F.when(F.col("new_shift"), F.col("worked_us") - F.coalesce("raw_us", F.lit(0))),
        ),
    )
    return t.add(
        shift_hours=rnd(hours(F.coalesce("shift_us", F.lit(0))), 4),
        punch_hours=rnd(hours(F.coalesce("stretch_us", F.lit(0))), 4),
        punch_no=F.col("stretch") - F.col("first_stretch") + 1,
    )


def second_break(t: Timeline) -> Timeline:
    """Breaks ranked by Out Punch; the first ranked row ends when the second break begins."""
    t = t.rank(
        "break_order",
        ["shift_no"],
        ["out_punch", "in_punch", "seq"],
        is_true(F.col("is_break")) & F.col("out_punch").isNotNull(),
    )
    first = (F.col("break_order") == 1) & (F.col("break_count") >= 2)
    t = t.totals(
        ["shift_no"],
        second_break_start=("max", F.when(first, F.col("out_punch"))),
        second_break_us=("max", F.when(first, F.col("worked_us") - F.col("worked_before"))),
    )
    return t.add(hours_to_second_break=hours("second_break_us"))


def twelve_hour_credit(t: Timeline) -> Timeline:
    """Twelve hours or more with fewer than two breaks, or the second one after ten hours."""
    late = ge("break_count", F.lit(2)) & gt("hours_to_second_break", F.lit(10))
    due = ge("shift_hours", F.lit(12)) & (lt("break_count", F.lit(2)) | late)
    return t.add(twelve_hour_credit=due)


_SCRATCH = [
    "raw_us",
    "prev_us",
    "next_us",
    "prev_seq",
    "shift_gap",
    "stretch",
    "worked_us",
    "stretch_us",
    "shift_us",
    "first_stretch",
    "worked_before",
    "second_break_us",
    "client_min_wage",
]


def punch_windows(
    punches: DataFrame,
    rules: Rules,
    profile: KeyProfile | None = None,
    finish: Callable[[DataFrame, DataFrame | None], DataFrame] = lambda d, hot: d,
) -> DataFrame:
    """All window-derived punch columns, before any payroll or waiver lookup but ``finish``."""

    def steps(t: Timeline) -> Timeline:
        t = shifts(neighbour_punches(t), rules)
        return twelve_hour_credit(second_break(shift_totals(t)))

    return over_lanes(punches, KEYS, ORDER, steps, profile, prepare=punch_length, finish=finish)


def split_shift_dollars(df: DataFrame, rules: Rules) -> DataFrame:
    """Pay of this and the previous punch against minimum wage plus one hour (client-wide rate)."""
    if "client_min_wage" not in df.columns:
        df = rules.with_globals(df, client_min_wage="min_wage")
    both = hours(F.col("raw_us") + F.col("prev_us"))
    df = df.withColumns(
        {
            "split_paid": denan(F.col("rate_paid") * both),
            "split_at_min": F.col("client_min_wage") * (F.lit(1) + both),
        }
    )
    return df.withColumn("split_due", F.col("split_at_min") - F.col("split_paid"))


def punch_flags(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "short_shift": p.short_shift(),
            "short_break": p.short_break().cast("int"),
            "did_not_break": p.did_not_break().cast("int"),
            "first_meal_break": p.first_meal_break().cast("int"),
            "over_twelve": p.over_twelve().cast("int"),
        }
    )


def punch_facts(
    punches: DataFrame,
    rules: Rules,
    register: DataFrame | None = None,
    waivers: DataFrame | None = None,
    profile: KeyProfile | None = None,
) -> DataFrame:
    """Every punch with its derived columns.

    Lookups follow the windows in each lane: ordinary rows are already hashed and sorted by employee
    there, crowded employees stay in their chunks.
    """
    cols = {
        "paid_break_hours": "Break Credit Hours",
        "hire_date": "Hire Date",
        "rate_paid": "Regular Rate Paid",
    }

    def looked_up(df: DataFrame, hot: DataFrame | None) -> DataFrame:
        return lookup_waivers(lookup_register(df, register, cols, hot), waivers, hot)

    df = punch_windows(punches, rules, profile, looked_up)
    df = split_shift_dollars(df, rules)
    return punch_flags(df).drop(*_SCRATCH)
