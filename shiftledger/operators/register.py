"""Payroll register checks: regular rate of pay and what it makes due.

Everything is row-wise on one register row per employee; no step shuffles. Checks are decided
while the plan is built, from the columns the export has.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from shiftledger.config import fixed_values as fv
from shiftledger.config.rules import Rules
from shiftledger.functions.semantics import denan, eq, fdiv, ge, gt, lt, rnd


def c(name: str) -> Column:
    return F.col(f"`{name}`")


def check_availability(columns) -> tuple[list[str], dict[str, str]]:
    """Checks that can run and, for the others, which columns are missing."""
    have = set(columns)
    runnable, skipped = [], {}
    for check, needed in fv.CHECK_INPUTS.items():
        absent = [n for n in needed if n not in have]
        if absent:
            skipped[check] = "Missing " + ", ".join(absent)
        else:
            runnable.append(check)
    return runnable, skipped


def skipped_checks(df: DataFrame) -> DataFrame:
    """The skipped checks as rows (check, reason)."""
    skipped = check_availability(df.columns)[1]
    return df.sparkSession.createDataFrame(list(skipped.items()), "check string, reason string")


def regular_rate(df: DataFrame) -> DataFrame:
    """Base rate, non-discretionary earnings and the regular rate of pay."""
    service = [
        "Bellman Service Charge Earnings",
        "Restricted Service Charge Earnings",
        "Auto Gratuity Earnings",
        "Commission Earnings",
        "Bonus Earnings",
    ]
    extra = reduce(lambda a, b: a + b, [c(n) for n in service])
    worked = c("Regular Hours") + c("Overtime Hours") + c("Double Time Hours")
    df = df.withColumns(
        {
            "Base Rate": rnd(fdiv(c("Regular Earnings Total"), c("Regular Hours")), 4),
            "Non-Disc Earnings": F.when(gt(extra, F.lit(0)), "YES").otherwise(""),
            "Total Non Discretionary Wage": reduce(
                lambda a, b: a + b, [c(n) for n in ["Misc FLSA Earnings", *service]]
            ),
        }
    )
    df = df.withColumn(
        "Regular Rate of Pay for Non Discretionary Wages",
        fdiv(c("Total Non Discretionary Wage"), worked),
    )
    per_hour = c("Regular Rate of Pay for Non Discretionary Wages")
    return df.withColumns(
        {
            "OT for Non Discretionary Income": per_hour * 0.5,
            "RROP": denan(c("Base Rate") + per_hour),
        }
    )


def _due_and_variance(df: DataFrame, due: str, amount: Column, paid: str, source: str, variance: str):
    df = df.withColumns({due: rnd(amount, 2), paid: c(source)})
    return df.withColumn(variance, rnd(c(paid) - c(due), 2))


def overtime(df: DataFrame) -> DataFrame:
    df = df.withColumn("1.5x OT rate based on straight hourly rate", c("Base Rate") * 1.5)
    df = df.withColumns(
        {
            "1.5x OT Rate": denan(
                c("1.5x OT rate based on straight hourly rate")
                + c("OT for Non Discretionary Income")
            ),
            "1.5 OT Worked": c("Overtime Hours"),
        }
    )
    amount = c("1.5x OT Rate") * c("1.5 OT Worked")
    return _due_and_variance(
        df, "1.5 OT Earnings Due", amount, "Actual Pay Check", "Overtime Earnings", "Variance"
    )


def double_time(df: DataFrame) -> DataFrame:
    df = df.withColumn(
        "Double Time Rate", denan(c("Base Rate") + c("OT for Non Discretionary Income")) * 2
    )
    return _due_and_variance(
        df,
        "Double Time Due",
        c("Double Time Hours") * c("Double Time Rate"),
        "Actual Pay Check Dble",
        "Double Time Earnings",
        "Variance Dble",
    )


def _credit(df: DataFrame, kind: str, short: str) -> DataFrame:
    due, worked = f"{kind} Credit Due", f"{kind} Credit Hours"
    df = _due_and_variance(
        df,
        due,
        c("RROP") * c(worked),
        f"Actual Pay {short}",
        f"{kind} Credit Earnings",
        f"Variance {short}",
    )
    return df.withColumn(f"{due} / {worked}", rnd(fdiv(c(due), c(worked)), 2))


def break_credit(df: DataFrame) -> DataFrame:
    return _credit(df, "Break", "BrkCrd")


def rest_credit(df: DataFrame) -> DataFrame:
    return _credit(df, "Rest", "RestCrd")


def sick_credit(df: DataFrame) -> DataFrame:
    """Exempt employees are due an hour of a ten-day, eight-hour period's pay."""
    exempt = eq("FLSA Status", F.lit("E"))
    df = df.withColumns(
        {
            "Sick Credit Hours": c("Sick Pay Hours"),
            "RROP Sick": F.when(exempt, c("Regular Rate Paid") / 80).otherwise(c("RROP")),
        }
    )
    df = _due_and_variance(
        df,
        "Sick Credit Due",
        c("Sick Credit Hours") * c("RROP Sick"),
        "Sick Paid",
        "Sick Pay Earnings",
        "Variance Sick",
    )
    ratio = rnd(fdiv(c("Sick Credit Due"), c("Sick Credit Hours")), 2)
    return df.withColumn("Sick Credit Due / Sick Credit Hours", ratio)


def base_rate_if_absent(df: DataFrame) -> DataFrame:
    inputs = ["Regular Earnings Total", "Regular Hours"]
    if "Base Rate" in df.columns or any(n not in df.columns for n in inputs):
        return df
    return df.withColumn("Base Rate", rnd(fdiv(c(inputs[0]), c(inputs[1])), 4))


def flsa_check(df: DataFrame) -> DataFrame:
    low = lt("Regular Rate Paid", F.lit(fv.EXEMPT_MIN_RATE)) & eq("FLSA Status", F.lit("E"))
    return df.withColumn("FLSA Check", F.when(low, "CHECK").otherwise(""))


def min_wage_check(df: DataFrame, rules: Rules) -> DataFrame:
    """Leave passes; hourly staff compare the base rate, exempt staff the pay of a period."""
    df = rules.resolve(
        df,
        "Location",
        **{
            "Min Wage": "min_wage",
            "Cal Min Wage": "state_min_wage",
            "Pay Periods per Year": "pay_periods_per_year",
        },
    )
    df = df.withColumn(
        "Min Wage 40", fdiv(c("Cal Min Wage") * 40 * 52 * 2, c("Pay Periods per Year"))
    )
    period_pay = c("Regular Rate Paid") + c("Sick Pay Earnings") + c("Vacation Earnings")
    passes = (
        eq("Position Status", F.lit("Leave"))
        | (eq("FLSA Status", F.lit("N")) & ge(rnd(c("Base Rate"), 2), c("Min Wage")))
        | (eq("FLSA Status", F.lit("E")) & ge(period_pay, c("Min Wage 40")))
    )
    return df.withColumn("Minimum Wage", F.when(passes, "").otherwise("CHECK"))


def non_active_check(df: DataFrame) -> DataFrame:
    away = c("Position Status").isin("Terminated", "Leave")
    flagged = gt("Regular Hours", F.lit(0)) & F.coalesce(away, F.lit(False))
    return df.withColumn("Non-Active", F.when(flagged, "CHECK").otherwise(""))


def register_facts(register: DataFrame, rules: Rules) -> DataFrame:
    """All checks the register's columns allow."""
    runnable, _ = check_availability(register.columns)
    df = register
    if all(n in df.columns for n in fv.RATE_INPUTS):
        df = regular_rate(df)
    for check, step in (
        ("overtime_checks_variances", overtime),
        ("doubletime_checks_variances", double_time),
        ("break_credit_variances", break_credit),
        ("rest_credit_variances", rest_credit),
        ("sick_credit_variances", sick_credit),
    ):
        if check in runnable:
            df = step(df)
    if "min_wage_check" in runnable or "flsa_check" in runnable:
        df = base_rate_if_absent(df)
    if "min_wage_check" in runnable:
        df = min_wage_check(df, rules)
    if "flsa_check" in runnable:
        df = flsa_check(df)
    if "non_active_check" in runnable:
        df = non_active_check(df)
    return df
