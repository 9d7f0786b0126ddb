"""Named conditions of the audit as never-NULL boolean columns (internal column names)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from shiftledger.config.fixed_values import CENT
from shiftledger.functions.semantics import eq, ge, gt, is_true, le, lt, ne


def _flag(name: str) -> Column:
    return is_true(F.col(name))


# Punch rows


def same_date_as_prev() -> Column:
    return eq("work_date", "prev_date")


def short_break() -> Column:
    """A break under 30 minutes in a shift of five hours or more."""
    return lt("break_min", F.lit(30)) & ge("shift_hours", F.lit(5)) & _flag("is_break")


def first_meal_break() -> Column:
    """The first stretch of a shift over six hours lasts more than five."""
    return gt("shift_hours", F.lit(6)) & _flag("new_shift") & gt("punch_hours", F.lit(5))


def waiver_on_file() -> Column:
    return is_true(F.col("has_waiver").cast("string").isin("Yes", "true"))


def did_not_break_any_length() -> Column:
    """More than five hours without a break, unless a shift up to six hours is waived."""
    waived = le("shift_hours", F.lit(6)) & waiver_on_file()
    return _flag("new_shift") & _flag("is_new_punch") & gt("punch_hours", F.lit(5)) & ~waived


def did_not_break() -> Column:
    """As above, only for shifts between five and six hours."""
    return did_not_break_any_length() & gt("shift_hours", F.lit(5)) & le("shift_hours", F.lit(6))


def short_shift() -> Column:
    return gt("shift_hours", F.lit(0)) & lt("shift_hours", F.lit(4))


def split_shift() -> Column:
    """A same-day gap of 60 to 800 minutes that was paid below minimum wage plus one hour."""
    return (
        gt("break_min", F.lit(60))
        & lt("break_min", F.lit(800))
        & lt("split_paid", "split_at_min")
        & same_date_as_prev()
    )


def over_twelve() -> Column:
    """A twelve-hour credit, looked at on the first punch row of each employee and date."""
    return _flag("first_of_day") & _flag("twelve_hour_credit")


# Break credit summary


def variance_not_zero() -> Column:
    """A missing variance counts as not zero."""
    return ne("variance", F.lit(0))


# Daily rows


def no_overtime_at_all() -> Column:
    zero = F.lit(0)
    return (
        eq("ot_period", zero) & eq("ot_paid", zero) & eq("dt_period", zero) & eq("dt_paid", zero)
    )


def consecutive_day() -> Column:
    return gt("consec_ot", F.lit(0))


def ot_variance() -> Column:
    return ge(F.abs("ot_variance"), F.lit(CENT))


def dt_variance() -> Column:
    return ge(F.abs("dt_variance"), F.lit(CENT))


# Register rows (report column names)


def pay_variance(name: str) -> Column:
    return gt(F.abs(F.col(f"`{name}`")), F.lit(CENT))


def exempt_below_rate() -> Column:
    return eq("FLSA Check", F.lit("CHECK"))


def below_min_wage() -> Column:
    return eq("Minimum Wage", F.lit("CHECK")) & gt("Regular Hours", F.lit(0))


def paid_while_inactive() -> Column:
    return eq(F.col("`Non-Active`"), F.lit("CHECK"))
