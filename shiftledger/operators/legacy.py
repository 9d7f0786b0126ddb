"""Earlier overtime calculations on punch rows, kept as library operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shiftledger.config.rules import Rules, period_bounds
from shiftledger.functions.semantics import hours, hours_to_us, rnd, us_between
from shiftledger.functions.timeline import KeyProfile, Timeline, over_lanes
from shiftledger.operators.punches import KEYS, ORDER


def _prepare(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {"work_date": F.col("in_punch").cast("date"), "raw_us": us_between("in_punch", "out_punch")}
    )


def punch_overtime(
    punches: DataFrame, rules: Rules, profile: KeyProfile | None = None
) -> DataFrame:
    """Day, week and period overtime on each punch.

    Weekly overtime is net of daily overtime and double time. Weeks count from the first day of the
    pay period. A week counts for the period total if the shift of its first row starts within the
    period. Needs ``shift_start`` per row.
    """

    def prepare(df: DataFrame) -> DataFrame:
        df = rules.with_globals(
            _prepare(df), length="pay_period_length", gap="days_bet_payroll_end_and_pay_date"
        )
        first, last = period_bounds(F.col("pay_date"), F.col("gap"), F.col("length"))
        df = rules.resolve(
            df, __day="ot_day_max", __week="ot_week_max", __double="dt_day_max"
        )
        return df.withColumns(
            {
                "first_day": first,
                "last_day": last,
                "work_week": F.floor(F.datediff("work_date", first) / 7) + 1,
                "day_max": hours_to_us("__day"),
                "week_max": hours_to_us("__week"),
                "double_max": hours_to_us("__double"),
            }
        )

    zero = F.lit(0).cast("long")

    def steps(t: Timeline) -> Timeline:
        t = t.neighbours(prev_date=("work_date", -1), prev_week=("work_week", -1))
        t = t.add(
            first_of_day=~F.col("work_date").eqNullSafe(F.col("prev_date")),
            first_of_week=~F.col("work_week").eqNullSafe(F.col("prev_week")),
        )
        t = t.totals(["work_week", "work_date"], day_us=("sum", F.col("raw_us")))
        t = t.add(day_us=F.coalesce("day_us", zero))
        t = t.add(
            day_ot=F.greatest(F.least("day_us", "double_max") - F.col("day_max"), zero),
            day_dt=F.greatest(F.col("day_us") - F.col("double_max"), zero),
        )
        t = t.totals(
            ["work_week"],
            week_us=("sum", F.col("raw_us")),
            sum_ot=("sum", F.when(F.col("first_of_day"), F.col("day_ot"))),
            sum_dt=("sum", F.when(F.col("first_of_day"), F.col("day_dt"))),
        )
        gross = F.greatest(zero, F.coalesce("week_us", zero) - F.col("week_max"))
        t = t.add(gross=gross)
        t = t.add(net=F.greatest(zero, F.col("gross") - F.col("sum_ot") - F.col("sum_dt")))
        started = F.col("shift_start").cast("date")
        inside = F.coalesce(started.between(F.col("first_day"), F.col("last_day")), F.lit(False))
        t = t.add(
            adj_ot=F.when(inside, F.col("sum_ot") + F.col("net")).otherwise(zero),
            adj_dt=F.when(inside, F.col("sum_dt")).otherwise(zero),
        )
        return t.totals(
            [],
            total_us=("sum", F.col("raw_us")),
            period_ot=("sum", F.when(F.col("first_of_week"), F.col("adj_ot"))),
            period_dt=("sum", F.when(F.col("first_of_week"), F.col("adj_dt"))),
        )

    cols = [*KEYS, *ORDER, "location", "shift_start"]
    df = over_lanes(punches.select(*cols), KEYS, ORDER, steps, profile, prepare=prepare)
    return df.select(
        *KEYS,
        "seq",
        "work_date",
        "work_week",
        rnd(hours("day_us"), 6).alias("workday_hours"),
        rnd(hours(F.coalesce("week_us", zero)), 6).alias("week_hours"),
        rnd(hours(F.coalesce("total_us", zero)), 6).alias("total_hours_period"),
        rnd(hours("day_ot"), 6).alias("workday_ot_hours"),
        rnd(hours("day_dt"), 6).alias("workday_dt_hours"),
        rnd(hours("gross"), 6).alias("week_ot_gross"),
        rnd(hours("net"), 6).alias("week_ot_net"),
        rnd(hours(F.col("sum_ot") + F.col("net")), 6).alias("total_ot_week"),
        rnd(hours("sum_dt"), 6).alias("total_dt_week"),
        rnd(hours("adj_ot"), 6).alias("adjusted_ot_week"),
        rnd(hours("adj_dt"), 6).alias("adjusted_dt_week"),
        rnd(hours("period_ot"), 4).alias("total_ot_period"),
        rnd(hours("period_dt"), 4).alias("total_dt_period"),
    )


def consecutive_day_hours(
    punches: DataFrame, rules: Rules, profile: KeyProfile | None = None
) -> DataFrame:
    """Hours of the last N punch rows where the rows form a run of N consecutive dates.

    N is one more than the streak limit of the employee's first location. A second punch on a date
    starts a new run. The shown first day is always six days earlier.
    """
    sizes = [limit + 1 for limit in rules.consecutive_limits]

    def steps(t: Timeline) -> Timeline:
        t = t.firsts(first_location="location").neighbours(prev_date=("work_date", -1))
        t = t.lookup(
            lambda df: rules.resolve(
                df, "first_location", __limit="number_of_consec_days_before_ot"
            )
        )
        t = t.add(
            need=F.col("__limit") + 1,
            starts=F.coalesce(F.datediff("work_date", "prev_date") != 1, F.lit(True)),
        )
        t = t.running(
            row_no=("count", F.lit(1)),
            so_far=("sum", F.coalesce("raw_us", F.lit(0))),
            known=("count", F.col("raw_us")),
        )
        t = t.running(run_row=("max", F.when(F.col("starts"), F.col("row_no"))))
        t = t.add(pair=F.struct("so_far", "known"))
        t = t.back("earlier", "pair", F.col("need"), sizes)
        streak = F.col("row_no") - F.col("run_row") + 1
        rolled = F.col("so_far") - F.coalesce(F.col("earlier.so_far"), F.lit(0))
        complete = F.col("known") - F.coalesce(F.col("earlier.known"), F.lit(0)) == F.col("need")
        due = (streak >= F.col("need")) & complete
        return t.add(
            consecutive_hours=F.when(due, rnd(hours(rolled), 4)).otherwise(F.lit(0.0)),
            streak_shown_from=F.date_sub("work_date", 6),
        ).drop("pair", "earlier")

    cols = [*KEYS, *ORDER, "location"]
    df = over_lanes(punches.select(*cols), KEYS, ORDER, steps, profile, prepare=_prepare)
    return df.select(*KEYS, "seq", "work_date", "consecutive_hours", "streak_shown_from")
