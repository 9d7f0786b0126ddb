"""Equi-joins that bring payroll, waiver and prior-period values to time-card rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F, types as T

from shiftledger.config.rules import Rules, period_end

_REGISTER_KEYS = ["id", "client_id", "pay_date"]


class DuplicateKeys(ValueError):
    """A lookup or stored table has more than one row for a key."""


def unique_by(df: DataFrame, keys: list[str], on_duplicate: str = "fail") -> DataFrame:
    """Check that ``keys`` identify rows ("fail"), keep the first by ``seq`` ("first"), or trust.

    A bare left join on repeated keys would multiply rows without notice.
    """
    if on_duplicate == "trust":
        return df
    if on_duplicate == "first":
        rest = [c for c in df.columns if c not in keys]
        row = F.min_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.col("seq"))
        return df.groupBy(*keys).agg(row.alias("__row")).select(*keys, "__row.*")
    repeated = df.groupBy(*keys).count().where("count > 1").limit(5).collect()
    if repeated:
        raise DuplicateKeys(f"repeated {keys}: {[tuple(r) for r in repeated]}")
    return df


def add_column(
    home: DataFrame,
    lookup: DataFrame | None,
    home_key: str,
    lookup_key: str,
    value: str,
    new_name: str,
    kind: T.DataType | str = "double",
    on_duplicate: str = "fail",
) -> DataFrame:
    """Left lookup of one column; all NULL when the table or column is absent."""
    if lookup is None or value not in lookup.columns:
        return home.withColumn(new_name, F.lit(None).cast(kind))
    side = unique_by(lookup, [lookup_key], on_duplicate).select(
        F.col(f"`{lookup_key}`").alias("__key"), F.col(f"`{value}`").alias(new_name)
    )
    return home.join(side, home[home_key] == F.col("__key"), "left").drop("__key")


def _cut_to(side: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of hot keys, broadcast: at most one per hot key, of which there are at most rows/limit.

    The punches of a hot key then stay in their chunks. ``side`` is unique by ``keys``.
    """
    return F.broadcast(side.join(F.broadcast(hot.select(*keys).distinct()), keys, "left_semi"))


def lookup_register(
    df: DataFrame,
    register: DataFrame | None,
    cols: Mapping[str, str],
    hot: DataFrame | None = None,
) -> DataFrame:
    """Bring several register columns in one join on employee, client and pay date.

    No broadcast hint: the register grows with the payroll. Both sides hash on the same key, so
    rows that were windowed by employee are not shuffled again. ``hot`` are the keys of ``df`` where
    it holds crowded keys only.
    """
    kinds = {"Hire Date": "timestamp_ntz"}
    present = {n: c for n, c in cols.items() if register is not None and c in register.columns}
    absent = {n: F.lit(None).cast(kinds.get(c, "double")) for n, c in cols.items() if n not in present}
    if present:
        side = register.select(
            F.col("IDX").alias("id"),
            "client_id",
            "pay_date",
            *[F.col(f"`{c}`").alias(n) for n, c in present.items()],
        )
        if hot is not None:
            side = _cut_to(side, hot, _REGISTER_KEYS)
        df = df.join(side, _REGISTER_KEYS, "left")
    return df.withColumns(absent) if absent else df


def waivers_for_runs(waivers: DataFrame, runs: DataFrame) -> DataFrame:
    """The waivers of each audited (client_id, pay_date).

    Those filed with a pay date hold for that period; a list without pay dates is repeated for each.
    Waivers then carry the whole employee key, and joining them does not shuffle the punches again.
    """
    keys = [c for c in ("client_id", "pay_date") if c in waivers.columns]
    return waivers.join(runs.select("client_id", "pay_date").distinct(), keys)


def lookup_waivers(
    df: DataFrame, waivers: DataFrame | None, hot: DataFrame | None = None
) -> DataFrame:
    """``has_waiver`` per punch; false where nothing is on file. ``hot`` as in ``lookup_register``."""
    if waivers is None:
        return df.withColumn("has_waiver", F.lit(False))
    keys = [k for k in _REGISTER_KEYS if k in waivers.columns]
    side = waivers.select(*keys, "has_waiver")
    if hot is not None:
        side = _cut_to(side, hot, keys)
    df = df.join(side, keys, "left")
    return df.withColumn("has_waiver", F.coalesce("has_waiver", F.lit(False)))


def carryover_streaks(daily_facts: DataFrame, runs: DataFrame, rules: Rules) -> DataFrame:
    """Streaks standing on the last day before each run's period, for rolling-rule locations.

    ``runs`` is (client_id, pay_date), the periods being audited. ``daily_facts`` carries the stored
    ``workday``, ``days_worked``, ``id`` and ``location``. One row per (client_id, pay_date, id);
    with two locations the later name decides.
    """
    runs = rules.with_globals(
        runs, __length="pay_period_length", __gap="days_bet_payroll_end_and_pay_date"
    )
    runs = runs.select(
        "client_id",
        F.col("pay_date"),
        F.date_sub(period_end(F.col("pay_date"), F.col("__gap")), F.col("__length")).alias("workday"),
    )
    stored = daily_facts.select("client_id", "id", "location", "workday", "days_worked")
    last = stored.join(runs, ["client_id", "workday"])
    last = rules.resolve(last, rolling="cba_consec_anyweek").where("rolling")
    return last.groupBy("client_id", "pay_date", "id").agg(
        F.max_by("days_worked", F.struct("location", "days_worked")).alias("carryover")
    )


def outer_merge_fill(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """Full outer merge on ``key``: target values first, source fills gaps, numeric gaps become 0."""
    new = [c for c in source.columns if c not in target.columns]
    shared = [c for c in source.columns if c in target.columns and c != key]
    right = source.select(
        F.col(key), *[F.col(c).alias(f"__s_{c}") for c in shared], *[F.col(c) for c in new]
    )
    merged = target.join(right, key, "full_outer")
    merged = merged.withColumns({c: F.coalesce(F.col(c), F.col(f"__s_{c}")) for c in shared})
    merged = merged.select(*target.columns, *new)
    numeric = [
        f.name
        for f in merged.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name != key
    ]
    return merged.na.fill(0, numeric)


def file_neighbours(punches: DataFrame) -> DataFrame:
    """Previous and next ID in file order, over the whole file.

    A whole file is one group, so this always runs in chunks.
    """
    from shiftledger.functions.timeline import ChunkedTimeline

    t = ChunkedTimeline(punches, ["client_id", "pay_date"], ["seq"])
    return t.neighbours(prev_id=("id", -1), next_id=("id", 1)).result()
