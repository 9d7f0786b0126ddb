"""Daily hours per employee, location and workday, with the daily overtime split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shiftledger.config.rules import Rules
from shiftledger.functions.semantics import US_PER_DAY, day_us, hours_to_us

DAY_KEYS = ["id", "client_id", "pay_date", "employee", "location", "workday"]


def midnight_pieces(punches: DataFrame) -> DataFrame:
    """One row per punch and day: a punch over midnight is cut at the midnight before it ends.

    A punch that ends at 00:00 leaves a piece of zero hours on the new day. A missing Out Punch
    leaves an empty piece on the In date.
    """
    in_day, out_day = F.col("in_punch").cast("date"), F.col("out_punch").cast("date")
    within = F.coalesce(in_day == out_day, F.lit(False))
    to_midnight = F.datediff(out_day, in_day) * F.lit(US_PER_DAY) - day_us("in_punch")
    whole = F.struct(
        in_day.alias("workday"), (day_us("out_punch") - day_us("in_punch")).alias("piece_us")
    )
    head = F.struct(in_day.alias("workday"), to_midnight.alias("piece_us"))
    tail = F.struct(out_day.alias("workday"), day_us("out_punch").alias("piece_us"))
    pieces = F.when(within, F.array(whole)).otherwise(F.array(head, tail))
    cols = [c for c in DAY_KEYS if c != "workday"]
    return punches.select(*cols, F.inline(pieces))


def daily_hours(punches: DataFrame) -> DataFrame:
    """Microseconds per day. Rows without a full key are left out, missing pieces count as zero."""
    pieces = midnight_pieces(punches)
    for key in ("employee", "id", "location", "workday"):
        pieces = pieces.where(F.col(key).isNotNull())
    return pieces.groupBy(*DAY_KEYS).agg(
        F.coalesce(F.sum("piece_us"), F.lit(0)).alias("hours_us")
    )


def day_rules(daily: DataFrame, rules: Rules) -> DataFrame:
    """Every rule the daily steps use, looked up once.

    Daily limits need the location as written; weekly rules look it up trimmed and are prefixed
    ``own_`` because the employee's first row decides them.
    """
    return rules.resolve(
        daily,
        trim=True,
        exact={"ot_max": "ot_day_max", "dt_max": "dt_day_max"},
        client_wide={
            "week_start": "workweek_start",
            "length": "pay_period_length",
            "gap": "days_bet_payroll_end_and_pay_date",
            "anchor": "anchor_pay_date",
        },
        own_rolling="cba_consec_anyweek",
        own_streak_limit="number_of_consec_days_before_ot",
        own_week_max="ot_week_max",
    )


def daily_overtime(daily: DataFrame) -> DataFrame:
    """Regular up to the daily limit, overtime up to the double-time limit, double time above."""
    ot, dt, worked = hours_to_us("ot_max"), hours_to_us("dt_max"), F.col("hours_us")
    zero = F.lit(0).cast("long")
    return daily.withColumns(
        {
            "regular_us": F.least(worked, ot),
            "ot_us": F.greatest(zero, F.least(worked - ot, dt - ot)),
            "dt_us": F.greatest(zero, worked - dt),
        }
    ).drop("ot_max", "dt_max")


def fiscal_pay_date(workday: Column, anchor: Column, length: Column, gap: Column) -> Column:
    """Pay date of the period a workday falls in, counted in whole periods from the anchor."""
    first = F.date_sub(anchor, gap + length - 1)
    periods = F.floor(F.datediff(workday, first) / length).cast("int")
    return F.date_add(anchor, periods * length)
