"""The whole audit: from normalised inputs to stored facts and reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from shiftledger.config.rules import Rules
from shiftledger.functions.timeline import KeyProfile, profile_keys
from shiftledger.operators.anomalies import break_credit_summary
from shiftledger.operators.lookups import unique_by, waivers_for_runs
from shiftledger.operators.normalize import prepare_waivers
from shiftledger.operators.punches import KEYS, punch_facts
from shiftledger.operators.register import check_availability, register_facts
from shiftledger.operators.validate import (
    HARD_ERROR,
    IntakeError,
    NONE,
    check_pay_dates,
    register_date_mismatches,
    require_inputs,
)
from shiftledger.operators.weekly import daily_facts
from shiftledger.plans.reports import TENANT, all_reports
from shiftledger.sinks.store import AuditStore
from shiftledger.sources.stored import changed_streaks, stored_carryover


@dataclass(frozen=True)
class Audit:
    punches: DataFrame
    daily: DataFrame
    summary: DataFrame
    register: DataFrame
    skipped: dict[str, str]

    def reports(self, limit: int | None = None) -> dict[str, DataFrame]:
        return all_reports(self.register, self.punches, self.daily, self.summary, limit)


def audit(
    punches: DataFrame,
    register: DataFrame,
    rules: Rules,
    waivers: DataFrame | None = None,
    carryover: DataFrame | None = None,
    profile: KeyProfile | None = None,
) -> Audit:
    """Lazy frames of every fact table. Many clients and pay periods go through together.

    ``punches`` and ``register`` are normalised, ``waivers`` prepared. Rows without an ID are
    stored as punches but take part in no calculation.
    """
    require_inputs(punches, register)
    profile = profile or profile_keys(punches, KEYS)
    facts = punch_facts(punches, rules, register, waivers, profile)
    loose = punches.where("id is null").withColumns(
        {"new_shift": F.lit(True), "has_waiver": F.lit(False), "short_shift": F.lit(False)}
    )
    facts = facts.unionByName(loose, allowMissingColumns=True)
    return Audit(
        facts,
        daily_facts(punches, rules, register, carryover, profile),
        break_credit_summary(facts),
        register_facts(register, rules),
        check_availability(register.columns)[1],
    )


def rejected_periods(
    punches: DataFrame, register: DataFrame, rules: Rules, ignore_warnings: bool = False
) -> DataFrame:
    """Pay periods that cannot be audited: (client_id, pay_date, error_type, message).

    A period needs punches and a register, punches of its own dates and one pay date on file.
    """
    checks = check_pay_dates(punches, rules, ignore_warnings).where(F.col("error_type") != NONE)
    checks = checks.select(*TENANT, "error_type", "message")
    on_file = F.transform("samples", lambda x: F.concat_ws(" ", x["IDX"], x["on_file"]))
    wrong = register_date_mismatches(register).select(
        *TENANT,
        F.lit(HARD_ERROR).alias("error_type"),
        F.concat(F.lit("register pay dates differ: "), F.array_join(on_file, ", ")).alias("message"),
    )
    timed, paid = punches.select(*TENANT).distinct(), register.select(*TENANT).distinct()

    def alone(these: DataFrame, others: DataFrame, lacks: str) -> DataFrame:
        return these.join(others, TENANT, "left_anti").select(
            *TENANT, F.lit(HARD_ERROR).alias("error_type"), F.lit(lacks).alias("message")
        )

    bad = wrong.union(checks).union(alone(paid, timed, "no punches for this register"))
    bad = bad.union(alone(timed, paid, "no register for these punches"))
    # One row a period, the gravest finding; the messages in a fixed order.
    return bad.groupBy(*TENANT).agg(
        F.min("error_type").alias("error_type"),
        F.array_join(F.sort_array(F.collect_set("message")), "; ").alias("message"),
    )


def validate(
    punches: DataFrame, register: DataFrame, rules: Rules, ignore_warnings: bool = False
) -> None:
    """Stop before any audit work if a file belongs to another pay period."""
    bad = rejected_periods(punches, register, rules, ignore_warnings)
    shown = bad.orderBy("error_type", *TENANT).limit(5).collect()
    if shown:
        raise IntakeError(
            "; ".join(
                f"{r['client_id']} {r['pay_date']} {r['error_type']}: {r['message']}" for r in shown
            )
        )


def run(
    store: AuditStore,
    punches: DataFrame,
    register: DataFrame,
    rules: Rules,
    waiver_rows: DataFrame | None = None,
    ignore_warnings: bool = False,
    on_duplicate: str = "fail",
    on_invalid: str = "fail",
    on_stale: str = "refresh",
) -> dict[str, DataFrame]:
    """Validate, audit, store facts and reports in one commit, and return the stored reports.

    An invalid period stops the batch ("fail"), or is left out and stored with its reason in the
    table ``rejected`` while all other periods are audited ("skip").

    Later stored periods of the batch's clients whose carried streaks have changed by it are audited again from
    their raw copies ("refresh"), or left as they are and named by ``changed_streaks`` ("keep").
    """
    require_inputs(punches, register)
    rejected = None
    with store.scratch() as written:
        if on_invalid == "skip":
            rejected = written(rejected_periods(punches, register, rules, ignore_warnings))
            punches = punches.join(rejected, TENANT, "left_anti").select(punches.columns)
            register = register.join(rejected, TENANT, "left_anti").select(register.columns)
        else:
            validate(punches, register, rules, ignore_warnings)
        register = unique_by(register, ["IDX", *TENANT], on_duplicate)
        periods = written(punches.select(*TENANT).distinct())
        names = _save(store, punches, register, rules, waiver_rows, periods, rejected)
        if on_stale == "refresh":
            refresh_streaks(store, rules, periods.select("client_id").distinct())
    return {n: store.read("reports", n) for n in names}


def _save(
    store: AuditStore,
    punches: DataFrame,
    register: DataFrame,
    rules: Rules,
    waiver_rows: DataFrame | None,
    periods: DataFrame,
    rejected: DataFrame | None = None,
) -> list[str]:
    """Audit valid periods and store everything about them in one commit; the names of the reports.

    Punch, register and daily facts are written once; summary, reports and saves read those files.
    """
    waivers = None
    if waiver_rows is not None:
        waivers = waivers_for_runs(prepare_waivers(waiver_rows), periods)
    with store.scratch() as written:
        carryover = stored_carryover(store, periods, rules)
        carryover = None if carryover is None else written(carryover)
        lazy = audit(punches, register, rules, waivers, carryover)
        facts, daily = written(lazy.punches), written(lazy.daily)
        summary = written(break_credit_summary(facts))
        done = Audit(facts, daily, summary, written(lazy.register), lazy.skipped)
        reports = done.reports()
        counts = {
            "ta_rows": facts,
            "anomalies_rows": summary,
            "wfn_rows": register,
            "waiver_rows": waivers,
        }
        with store.commit():
            store.save_punches(facts)
            store.save_daily(daily)
            store.save_carried(carryover, periods)
            store.save_raw(punches, "punches")
            store.save_raw(register, "register")
            if waiver_rows is not None:
                store.save_raw(waiver_rows, "waivers")
            store.save_reports(reports, periods)
            if rejected is not None:
                store.save_rejected(rejected, periods)
            store.save_runs(counts, rules, lazy.skipped)
    return list(reports)


def refresh_streaks(store: AuditStore, rules: Rules, clients: DataFrame | None = None) -> int:
    """Audit again, from their raw copies, stored periods whose carried streaks have changed.

    The earliest such period of a client is right after one round, as the period before it does not change any
    more; so the rounds end, with the periods audited again in all. ``clients`` (client_id) bounds the search.
    """
    done = 0
    while True:
        with store.scratch() as written:
            changed = changed_streaks(store, rules, clients)
            if changed is None:
                return done
            stale = written(changed.select(*TENANT).distinct())
            n = stale.count()
            if not n:
                return done
            punches, register = (store.read("raw", k).join(stale, TENANT, "left_semi") for k in ("punches", "register"))
            _save(store, punches, register, rules, _filed_waivers(store, stale), stale)
            done += n


def _filed_waivers(store: AuditStore, periods: DataFrame) -> DataFrame | None:
    """The waiver lists that hold for stored periods: those filed with them, else the client's."""
    own, general = store.read("raw", "waivers"), store.read("raw", "waivers_of_client")
    if own is not None:
        own = own.join(periods, TENANT, "left_semi")
    if general is not None:
        general = general.join(periods, "client_id")
        if own is not None:
            general = general.join(own.select(*TENANT).distinct(), TENANT, "left_anti")
            return own.unionByName(general, allowMissingColumns=True)
    return own if own is not None else general
