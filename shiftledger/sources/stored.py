"""Queries over stored audit tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from shiftledger.config import fixed_values as fv
from shiftledger.config.rules import Rules
from shiftledger.operators.lookups import carryover_streaks
from shiftledger.plans.reports import report_columns
from shiftledger.sinks.store import AuditStore, NotFound, _of_period

_BASE = ["ID", "In Punch", "Out Punch", "Employee"]


def _between(column: str, start, end, kind: str) -> Column:
    """From ``start`` through the whole day ``end``."""
    c = F.col(f"`{column}`")
    return (c >= F.lit(str(start)).cast(kind)) & (
        c < F.date_add(F.lit(str(end)).cast("date"), 1).cast(kind)
    )


def query_punches(
    punches: DataFrame,
    client_id: str | None = None,
    employee_id: str | None = None,
    start=None,
    end=None,
    columns: Sequence[str] = (),
    limit: int | None = None,
) -> DataFrame:
    """Stored punches in time order: base columns plus ``columns``.

    Filters reach the scan and the sort is a top-k. The dates apply only when both are given.
    """
    if client_id is not None:
        punches = punches.where(F.col("client_id") == client_id)
    if employee_id:
        punches = punches.where(F.col("ID") == employee_id)
    if start and end:
        punches = punches.where(_between("In Punch", start, end, "timestamp_ntz"))
    names = [*_BASE, *[c for c in columns if c not in _BASE]]
    rows = punches.select(*[F.col(f"`{c}`") for c in names])
    if limit is None:
        return rows
    return rows.orderBy("In Punch", "ID", "Out Punch").limit(limit)


def query_daily(
    daily: DataFrame | None,
    client_id: str | None = None,
    employee_id: str | None = None,
    start=None,
    end=None,
) -> DataFrame | None:
    """All stored daily columns in date order, uncapped; None where no table exists yet."""
    if daily is None:
        return None
    if client_id is not None:
        daily = daily.where(F.col("client_id") == client_id)
    if employee_id:
        daily = daily.where(F.col("ID") == employee_id)
    if start and end:
        daily = daily.where(_between("Attributed_Workday", start, end, "date"))
    return daily.orderBy("Attributed_Workday", "ID", "Location")


def load_results(store: AuditStore, client_id: str, pay_date) -> dict[str, DataFrame]:
    """The stored reports of a period, without partition columns; a report may be empty."""
    runs = store.read("runs")
    if runs is None or not _of_period(runs, client_id, pay_date).limit(1).count():
        raise NotFound(f"no processed data for {client_id} {pay_date}")
    out = {"run": _of_period(runs, client_id, pay_date)}
    places = store.locate(client_id, pay_date)
    for name in (*fv.REGISTER_REPORTS, *fv.TIME_CARD_REPORTS):
        path = places.get(f"reports/{name}")
        if path:
            out[name] = store.spark.read.json(path)
        else:
            fields = [T.StructField(c, T.StringType()) for c in report_columns(name)]
            out[name] = store.spark.createDataFrame([], T.StructType(fields))
    return out


def list_periods(store: AuditStore, client_id: str) -> DataFrame | None:
    """Audited pay periods of a client, newest first."""
    runs = store.read("runs")
    if runs is None:
        return None
    mine = runs.where(F.col("client_id") == client_id)
    return mine.select("pay_date", "first_date", "last_date", "processed_at").orderBy(
        F.desc("pay_date")
    )


def stored_carryover(store: AuditStore, runs: DataFrame, rules: Rules) -> DataFrame | None:
    """Carried streaks for ``runs`` from the stored daily table, or None without one."""
    daily = store.read("daily")
    if daily is None:
        return None
    internal = {label: n for n, label in fv.DAILY_LABELS.items()}
    facts = daily.select(
        "client_id", *[F.col(f"`{c}`").alias(internal[c]) for c in daily.columns if c in internal]
    )
    return carryover_streaks(facts, runs, rules)


def changed_streaks(store: AuditStore, rules: Rules, clients: DataFrame | None = None) -> DataFrame | None:
    """Streaks that stored periods were audited with and that the stored rows before them no longer give.

    client_id, pay_date, id, recorded and current; either is NULL where there is none. ``clients`` (client_id)
    bounds the search. None where nothing is stored.
    """
    runs, recorded = store.read("runs"), store.read("carried")
    if runs is None or recorded is None:
        return None
    if clients is not None:
        runs = runs.join(clients, "client_id", "left_semi")
        recorded = recorded.join(clients, "client_id", "left_semi")
    periods = runs.select("client_id", "pay_date")
    current = stored_carryover(store, periods, rules)
    key = ["client_id", "pay_date", "id"]
    recorded = recorded.join(periods, key[:2], "left_semi").select(*key, F.col("carryover").alias("recorded"))
    if current is None:
        return recorded.withColumn("current", F.lit(None).cast("long"))
    current = current.select(*key, F.col("carryover").cast("long").alias("current"))
    both = recorded.join(current, key, "full_outer")
    return both.where(~F.col("recorded").eqNullSafe(F.col("current")))
