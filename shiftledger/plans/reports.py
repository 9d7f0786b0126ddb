"""The sixteen audit reports: filter, sort, cap, columns.

A report is capped per client and pay date. The cap is a ``row_number`` filter, which Spark turns
into a per-task limit before the shuffle, so one large client costs at most ``limit`` rows per task.
Ties are broken to a total order. ``limit=None`` gives all rows without sorting.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from shiftledger.config import fixed_values as fv
from shiftledger.functions import predicates as p

TENANT = ["client_id", "pay_date"]


def labelled(df: DataFrame, labels: Mapping[str, str], keep: Sequence[str] = TENANT) -> DataFrame:
    """Report names for internal names; columns without a label are left out."""
    return df.select(
        *[c for c in keep if c in df.columns],
        *[F.col(c).alias(n) for c, n in labels.items() if c in df.columns],
    )


def json_safe(df: DataFrame) -> DataFrame:
    """Timestamps as ISO text, dates as text, infinities and NaN as NULL."""

    def safe(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if kind.startswith("timestamp"):
            return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias(name)
        if kind == "date":
            return c.cast("string").alias(name)
        if kind in ("double", "float"):
            finite = ~F.isnan(c) & (F.abs(c) != float("inf"))
            return F.when(finite, c).alias(name)
        return c.alias(name)

    return df.select(*[safe(n, k) for n, k in df.dtypes])


def json_rows(df: DataFrame, keep: Sequence[str] = TENANT) -> DataFrame:
    """One JSON document per row, missing values written as null."""
    body = [F.col(f"`{c}`") for c in df.columns if c not in keep]
    doc = F.to_json(F.struct(*body), {"ignoreNullFields": "false"})
    return json_safe(df).select(*[c for c in keep if c in df.columns], doc.alias("row"))


def top_rows(df: DataFrame, order: Sequence[Column], limit: int | None) -> DataFrame:
    if limit is None:
        return df
    w = Window.partitionBy(*TENANT).orderBy(*order)
    ranked = df.withColumn("__n", F.row_number().over(w))
    return ranked.where(F.col("__n") <= limit).drop("__n")


def _asc(*names: str) -> list[Column]:
    return [F.col(f"`{n}`").asc_nulls_last() for n in names]


_REGISTER_FILTERS = {
    "overtime_checks_variances": lambda: p.pay_variance("Variance"),
    "doubletime_checks_variances": lambda: p.pay_variance("Variance Dble"),
    "break_credit_variances": lambda: p.pay_variance("Variance BrkCrd"),
    "rest_credit_variances": lambda: p.pay_variance("Variance RestCrd"),
    "sick_credit_variances": lambda: p.pay_variance("Variance Sick"),
    "flsa_check": p.exempt_below_rate,
    "min_wage_check": p.below_min_wage,
    "non_active_check": p.paid_while_inactive,
}

_PUNCH_TIES = ("employee", "id", "in_punch", "out_punch", "seq")
_DAILY_TIES = ("employee", "id", "workday", "location")
# name: (source frame, filter, labels, order)
_TIME_CARD = {
    "break_credit_summary": (
        "summary",
        p.variance_not_zero,
        fv.ANOMALY_LABELS,
        lambda: [F.col("paid_break_hours").desc_nulls_last(), *_asc("id")],
    ),
    "short_break_earned_credits": (
        "punches",
        p.short_break,
        fv.PUNCH_LABELS,
        lambda: _asc(*_PUNCH_TIES),
    ),
    "did_not_break_meal_waiver_check": (
        "punches",
        p.did_not_break,
        fv.PUNCH_LABELS,
        lambda: _asc(*_PUNCH_TIES),
    ),
    "seven_consecutive": (
        "daily",
        p.consecutive_day,
        fv.DAILY_LABELS,
        lambda: _asc(*_DAILY_TIES),
    ),
    "ot_vs_wfn": (
        "daily",
        lambda: F.col("first_of_id") & ~p.no_overtime_at_all() & p.ot_variance(),
        fv.DAILY_LABELS,
        lambda: _asc(*_DAILY_TIES),
    ),
    "dt_vs_wfn": (
        "daily",
        lambda: F.col("first_of_id") & ~p.no_overtime_at_all() & p.dt_variance(),
        fv.DAILY_LABELS,
        lambda: _asc(*_DAILY_TIES),
    ),
    "split_shift": ("punches", p.split_shift, fv.PUNCH_LABELS, lambda: _asc(*_PUNCH_TIES)),
    "short_shift": (
        "punches",
        lambda: F.col("short_shift"),
        fv.PUNCH_LABELS,
        lambda: _asc(*_PUNCH_TIES),
    ),
}

REGISTER_REPORTS = tuple(fv.REGISTER_REPORTS)
TIME_CARD_REPORTS = tuple(fv.TIME_CARD_REPORTS)


def report_columns(name: str) -> list[str]:
    columns, renames = {**fv.REGISTER_REPORTS, **fv.TIME_CARD_REPORTS}[name]
    return [renames.get(c, c) for c in columns]


def register_report(name: str, facts: DataFrame, limit: int | None = None) -> DataFrame:
    """One register report. It is empty when the export lacked the columns of the check."""
    columns, renames = fv.REGISTER_REPORTS[name]
    if all(n in facts.columns for n in fv.CHECK_INPUTS[name]):
        rows = facts.where(_REGISTER_FILTERS[name]())
    else:
        absent = [c for c in columns if c not in facts.columns]
        rows = facts.where(F.lit(False)).withColumns({c: F.lit(None).cast("string") for c in absent})
    ties = ["Payroll Name", "IDX"] + (["seq"] if "seq" in rows.columns else [])
    return top_rows(rows, _asc(*ties), limit).select(
        *TENANT, *[F.col(f"`{c}`").alias(renames.get(c, c)) for c in columns]
    )


def time_card_report(
    name: str,
    punches: DataFrame | None = None,
    daily: DataFrame | None = None,
    summary: DataFrame | None = None,
    limit: int | None = None,
) -> DataFrame:
    source, condition, labels, order = _TIME_CARD[name]
    frame = {"punches": punches, "daily": daily, "summary": summary}[source]
    columns, renames = fv.TIME_CARD_REPORTS[name]
    internal = {label: n for n, label in labels.items()}
    # Filter, then keep only what the report shows or sorts by: the sort carries few columns.
    rows = top_rows(frame.where(condition()), order(), limit)
    return rows.select(
        *TENANT, *[F.col(internal[c]).alias(renames.get(c, c)) for c in columns]
    )


def all_reports(
    register: DataFrame,
    punches: DataFrame,
    daily: DataFrame,
    summary: DataFrame,
    limit: int | None = None,
) -> dict[str, DataFrame]:
    out = {n: register_report(n, register, limit) for n in REGISTER_REPORTS}
    out.update(
        {n: time_card_report(n, punches, daily, summary, limit) for n in TIME_CARD_REPORTS}
    )
    return out
