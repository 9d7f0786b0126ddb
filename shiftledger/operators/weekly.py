"""Weekly rules over daily rows: streaks, consecutive-day premium, weekly overtime spillover."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shiftledger.config.fixed_values import PREMIUM_DAY_HOURS
from shiftledger.config.rules import Rules, weekday_number
from shiftledger.functions.semantics import US_PER_HOUR, gt, hours, hours_to_us, rnd
from shiftledger.functions.timeline import KeyProfile, Timeline, over_lanes
from shiftledger.operators.daily import daily_hours, daily_overtime, day_rules, fiscal_pay_date
from shiftledger.operators.punches import KEYS

# Workweeks follow the workday, so leading with them changes no order and lets the windows of the
# employee and of the employee's week use the same sort.
ORDER = ["workweek", "workday", "employee", "location"]

def workweeks(df: DataFrame) -> DataFrame:
    """``workweek``: the start date of the client's workweek."""
    df = df.withColumn("start_dow", weekday_number(F.col("week_start")))
    back = F.pmod(F.weekday("workday") - F.col("start_dow"), F.lit(7))
    return df.withColumn("workweek", F.date_sub("workday", back))


def streaks(t: Timeline, carryover: DataFrame | None = None) -> Timeline:
    """``days_worked``: position in a run of worked days.

    A run breaks on a missing day and, unless the employee's first location rolls over workweeks,
    where a new workweek starts. Rolling employees may continue the run of the prior period.
    Two rows of one day both count.
    """
    t = t.firsts(rolling="own_rolling", streak_limit="own_streak_limit")
    t = t.neighbours(prev_day=("workday", -1)).running(row_no=("count", F.lit(1)))
    new_week = (F.weekday("prev_day") != F.col("start_dow")) & (
        F.weekday("workday") == F.col("start_dow")
    )
    breaks = (
        F.col("prev_day").isNull()
        | (F.datediff("workday", "prev_day") > 1)
        | (~F.coalesce("rolling", F.lit(False)) & new_week)
    )
    t = t.add(run_starts=breaks)
    t = t.running(
        run_row=("max", F.when(F.col("run_starts"), F.col("row_no"))),
        streak_start=("max", F.when(F.col("run_starts"), F.col("workday"))),
    )
    t = t.add(days_worked=F.col("row_no") - F.col("run_row") + 1)
    if carryover is not None:
        t = t.lookup(
            lambda df: df.join(
                carryover.select(*KEYS, F.col("carryover").alias("__carried")), KEYS, "left"
            )
        )
        # The run of the first row began on the first day of the frame.
        t = t.add(
            days_worked=F.col("days_worked")
            + F.when(
                F.col("rolling")
                & (F.col("run_row") == 1)
                & gt("__carried", F.lit(0))
                & (
                    F.datediff(
                        "streak_start",
                        F.date_sub("pay_date", F.col("gap") + F.col("length")),
                    )
                    == 1
                ),
                F.col("__carried"),
            ).otherwise(F.lit(0))
        )
        t = t.drop("__carried")
    return t


def consecutive_premium(df: DataFrame) -> DataFrame:
    """Past the limit no hour is regular: eight are overtime, the rest double time."""
    day = F.lit(PREMIUM_DAY_HOURS * US_PER_HOUR)
    due = gt("days_worked", "streak_limit")
    zero = F.lit(0).cast("long")
    return df.withColumns(
        {
            "consecutive_rule": due,
            "regular_us": F.when(due, zero).otherwise(F.col("regular_us")),
            "ot_us": F.when(due, F.least(F.col("hours_us"), day)).otherwise(F.col("ot_us")),
            "dt_us": F.when(due, F.greatest(F.col("hours_us") - day, zero)).otherwise(
                F.col("dt_us")
            ),
        }
    )


def weekly_spillover(t: Timeline) -> Timeline:
    """Regular time beyond the weekly limit becomes overtime.

    The running total is capped at the limit after each row. A capped total equals the plain total
    less the largest excess reached so far, which two running windows express.
    """
    t = t.firsts(["workweek"], week_max="own_week_max")
    t = t.running(["workweek"], reg_so_far=("sum", F.col("regular_us")))
    t = t.add(week_max_us=hours_to_us("week_max"))
    excess_before = F.col("reg_so_far") - F.col("regular_us") - F.col("week_max_us")
    t = t.running(["workweek"], spilt_before=("max", excess_before))
    zero = F.lit(0).cast("long")
    t = t.add(cum_us=F.col("reg_so_far") - F.greatest(zero, F.col("spilt_before")))
    t = t.add(spill_us=F.greatest(zero, F.col("cum_us") - F.col("week_max_us")))
    return t.add(
        regular_us=F.col("regular_us") - F.col("spill_us"), ot_us=F.col("ot_us") + F.col("spill_us")
    )


def to_hours(df: DataFrame) -> DataFrame:
    """Hour columns rounded to four digits."""
    cols = {
        "hours_worked": "hours_us",
        "regular_hours": "regular_us",
        "ot_hours": "ot_us",
        "dt_hours": "dt_us",
        "cum_regular_hours": "cum_us",
        "weekly_spillover": "spill_us",
    }
    return df.withColumns({n: rnd(hours(c), 4) for n, c in cols.items() if c in df.columns})


def period_totals(t: Timeline) -> Timeline:
    """Overtime and double time of the employee's pay period on each row.

    The sums run over ten-thousandths as longs, since the rounded hours are what is summed.
    """
    t = t.add(
        fiscal_pay_date=fiscal_pay_date(
            F.col("workday"), F.col("anchor"), F.col("length"), F.col("gap")
        )
    )

    def tenths(c):
        return F.rint(F.col(c) * F.lit(1e4)).cast("long")

    t = t.totals(
        ["employee", "fiscal_pay_date"],
        __ot_sum=("sum", tenths("ot_hours")),
        __dt_sum=("sum", tenths("dt_hours")),
    )
    t = t.add(ot_period=F.col("__ot_sum") / F.lit(1e4), dt_period=F.col("__dt_sum") / F.lit(1e4))
    return t.drop("__ot_sum", "__dt_sum")


def streak_report_columns(t: Timeline) -> Timeline:
    """Premium hours and the first day shown for a streak.

    The first day is the earliest one of the employee's workweek within the audited period, so a
    streak from the week before is shown shortened; ``streak_start`` has its true first day.
    """
    day = F.lit(float(PREMIUM_DAY_HOURS))
    flagged, worked = F.col("consecutive_rule"), F.col("hours_worked")
    t = t.totals(["employee", "workweek"], __week_first=("min", F.col("workday")))
    t = t.add(
        first_day_of_streak=F.when(flagged, F.col("__week_first")),
        consec_ot=F.when(flagged, rnd(F.least(worked, day), 4)).otherwise(F.lit(0.0)),
        consec_dt=F.when(flagged, rnd(F.greatest(worked - day, F.lit(0.0)), 4)).otherwise(
            F.lit(0.0)
        ),
    )
    return t.drop("__week_first")


def first_rows(t: Timeline) -> Timeline:
    """``first_of_id``: the employee's first daily row of the period."""
    t = t.running(__row=("count", F.lit(1)))
    return t.add(first_of_id=F.col("__row") == 1).drop("__row")


OUTPUT = [
    "client_id",
    "pay_date",
    "employee",
    "id",
    "location",
    "workday",
    "hours_worked",
    "regular_hours",
    "ot_hours",
    "dt_hours",
    "workweek",
    "days_worked",
    "consecutive_rule",
    "cum_regular_hours",
    "weekly_spillover",
    "fiscal_pay_date",
    "ot_period",
    "dt_period",
    "first_day_of_streak",
    "streak_start",
    "consec_ot",
    "consec_dt",
    "first_of_id",
]


def daily_windows(
    punches: DataFrame,
    rules: Rules,
    carryover: DataFrame | None = None,
    profile: KeyProfile | None = None,
    in_period: bool = True,
) -> DataFrame:
    """Daily rows after all rules.

    Rows outside the period feed streaks and workweek totals first and are filtered afterwards.
    Ordinary rows are hashed by employee before the roll-up: roll-up and windows then share that
    exchange. Rows of hot keys are rolled up map-side and windowed in chunks.
    """

    def prepare(df: DataFrame) -> DataFrame:
        return workweeks(daily_overtime(day_rules(daily_hours(df), rules)))

    def steps(t: Timeline) -> Timeline:
        t = streaks(t, carryover).apply(consecutive_premium)
        t = period_totals(weekly_spillover(t).apply(to_hours))
        if in_period:
            t = t.apply(lambda df: df.where("fiscal_pay_date = pay_date"))
        # Daily limits saw the location as written; it is stored trimmed, as the weekly rules look it up.
        trimmed = first_rows(streak_report_columns(t)).apply(
            lambda df: df.withColumn("location", F.trim("location"))
        )
        return trimmed.select(*OUTPUT)

    cols = [*KEYS, "employee", "location", "in_punch", "out_punch"]
    return over_lanes(
        punches.select(*cols), KEYS, ORDER, steps, profile, prepare=prepare, cluster_first=True
    )


def pay_variances(daily: DataFrame, register: DataFrame | None) -> DataFrame:
    """Overtime and double time on the time card less what the register paid."""
    from shiftledger.operators.lookups import lookup_register

    daily = lookup_register(
        daily, register, {"ot_paid": "Overtime Hours", "dt_paid": "Double Time Hours"}
    )
    return daily.withColumns(
        {
            "ot_variance": rnd(F.col("ot_period") - F.col("ot_paid"), 4),
            "dt_variance": rnd(F.col("dt_period") - F.col("dt_paid"), 4),
        }
    )


def daily_facts(
    punches: DataFrame,
    rules: Rules,
    register: DataFrame | None = None,
    carryover: DataFrame | None = None,
    profile: KeyProfile | None = None,
    in_period: bool = True,
) -> DataFrame:
    return pay_variances(daily_windows(punches, rules, carryover, profile, in_period), register)
