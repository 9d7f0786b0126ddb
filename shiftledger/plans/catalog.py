"""Registered queries over the sample tables, one per operator or report."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shiftledger.config import fixed_values as fv
from shiftledger.config.rules import Rules
from shiftledger.config.systems import ADP, BLANK, PUNCH_SYSTEMS, REGISTER_SYSTEMS, Slice
from shiftledger.functions import predicates as p
from shiftledger.functions.semantics import hours, rnd
from shiftledger.functions.timeline import CHUNK_ROWS_CONF, HOT_ROWS_CONF, shared_folder
from shiftledger.operators import legacy, lookups, normalize, validate, weekly
from shiftledger.operators.anomalies import break_credit_summary
from shiftledger.operators.daily import daily_hours, daily_overtime, day_rules, fiscal_pay_date
from shiftledger.operators.punches import punch_facts
from shiftledger.operators.register import register_facts, skipped_checks
from shiftledger.plans.audit import rejected_periods
from shiftledger.plans.reports import (
    REGISTER_REPORTS,
    TENANT,
    TIME_CARD_REPORTS,
    json_rows,
    json_safe,
    labelled,
    register_report,
    time_card_report,
)
from shiftledger.sinks import files
from shiftledger.sinks.store import AuditStore
from shiftledger.sources import exports
from shiftledger.sources.records import ROW_BITS
from shiftledger.sources.sample_tables import CLIENT, PAY_DATE, PRIOR_PAY_DATE, SampleTables
from shiftledger.sources.stored import (
    changed_streaks,
    list_periods,
    load_results,
    query_daily,
    query_punches,
    stored_carryover,
)

PERIOD_START, PERIOD_END = dt.date(2024, 1, 7), dt.date(2024, 1, 20)
NEXT_PAY_DATE = dt.date(2024, 2, 9)


class Inputs:
    """Lazily built frames for one session and folder. Frames are plans: nothing is kept in memory."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.tables = SampleTables(spark, folder)

    @cached_property
    def facts(self) -> DataFrame:
        t = self.tables
        return punch_facts(t.punches, t.rules, t.register, t.waivers, t.profile)

    @cached_property
    def daily(self) -> DataFrame:
        t = self.tables
        return weekly.daily_facts(t.punches, t.rules, t.register, None, t.profile)

    @cached_property
    def daily_all(self) -> DataFrame:
        t = self.tables
        return weekly.daily_windows(t.punches, t.rules, None, t.profile, in_period=False)

    @cached_property
    def summary(self) -> DataFrame:
        return break_credit_summary(self.facts)

    @cached_property
    def register(self) -> DataFrame:
        return register_facts(self.tables.register, self.tables.rules)


_inputs: dict = {}


def inputs(spark: SparkSession, folder: str) -> Inputs:
    """Queries of one session over unchanged files share their plans."""
    stamps = files.listing(spark, folder)
    conf = tuple(spark.conf.get(c, "") for c in (HOT_ROWS_CONF, CHUNK_ROWS_CONF))
    key = (spark.sparkContext.applicationId, id(spark), folder, stamps, conf)
    if key not in _inputs:
        _inputs[key] = Inputs(spark, folder)
    return _inputs[key]


def _of(columns: dict[str, str] | list[str], frame: str) -> Callable[[Inputs], DataFrame]:
    """Columns of a frame, given as a list or as {name: source column}."""
    names = columns if isinstance(columns, dict) else {c: c for c in columns}

    def query(i: Inputs) -> DataFrame:
        return getattr(i, frame).select(*[F.col(f"`{s}`").alias(n) for n, s in names.items()])

    return query


_PUNCH_COLUMNS = {
    "punch_helpers": [
        "prev_in",
        "prev_out",
        "next_in",
        "next_out",
        "prev_date",
        "next_date",
        "raw_hours",
        "prev_hours",
        "next_hours",
        "break_min",
        "next_break_min",
    ],
    "shift_sessions": ["new_shift", "shift_no", "shift_hours"],
    "shift_breaks": ["shift_start", "first_of_shift", "is_break", "break_count", "break_order"],
    "second_break": ["second_break_start", "hours_to_second_break"],
    "twelve_hour_credit": ["shift_hours", "break_count", "twelve_hour_credit"],
    "stapled_punches": ["is_new_punch", "punch_no", "punch_hours"],
    "split_shift_dollars": ["rate_paid", "split_paid", "split_at_min", "split_due"],
    "waiver_lookup": ["has_waiver"],
    "register_lookup": ["paid_break_hours", "hire_date"],
}
_DAILY_ALL = {
    "workweek_id": ["location", "workday", "workweek"],
    "consecutive_streaks": ["location", "workday", "days_worked", "streak_start"],
    "weekly_spillover": [
        "location",
        "workday",
        "hours_worked",
        "regular_hours",
        "ot_hours",
        "dt_hours",
        "cum_regular_hours",
        "weekly_spillover",
    ],
    "pay_period_totals": ["location", "workday", "fiscal_pay_date", "ot_period", "dt_period"],
}
_DAILY = {
    "consecutive_premium": [
        "location",
        "workday",
        "consecutive_rule",
        "first_day_of_streak",
        "consec_ot",
        "consec_dt",
    ],
    "ta_vs_register": [
        "location",
        "workday",
        "ot_period",
        "ot_paid",
        "ot_variance",
        "dt_period",
        "dt_paid",
        "dt_variance",
    ],
}
_REGISTER = {
    "rrop": {
        "base_rate": "Base Rate",
        "non_disc": "Non-Disc Earnings",
        "total_nd": "Total Non Discretionary Wage",
        "per_hour": "Regular Rate of Pay for Non Discretionary Wages",
        "half": "OT for Non Discretionary Income",
        "rrop": "RROP",
    },
    "due_overtime": {
        "due": "1.5 OT Earnings Due",
        "paid": "Actual Pay Check",
        "variance": "Variance",
    },
    "due_doubletime": {
        "due": "Double Time Due",
        "paid": "Actual Pay Check Dble",
        "variance": "Variance Dble",
    },
    "due_break": {
        "due": "Break Credit Due",
        "paid": "Actual Pay BrkCrd",
        "variance": "Variance BrkCrd",
        "ratio": "Break Credit Due / Break Credit Hours",
    },
    "due_rest": {
        "due": "Rest Credit Due",
        "paid": "Actual Pay RestCrd",
        "variance": "Variance RestCrd",
        "ratio": "Rest Credit Due / Rest Credit Hours",
    },
    "due_sick": {
        "due": "Sick Credit Due",
        "paid": "Sick Paid",
        "variance": "Variance Sick",
        "ratio": "Sick Credit Due / Sick Credit Hours",
    },
    "min_wage": {
        "min_wage": "Min Wage",
        "min_40": "Min Wage 40",
        "min_check": "Minimum Wage",
    },
    "flsa": {"rate_paid": "Regular Rate Paid", "flsa_check": "FLSA Check"},
    "non_active": {"position": "Position Status", "non_active": "Non-Active"},
}


def _anomaly_rollup(i: Inputs) -> DataFrame:
    return i.summary.drop(*TENANT)


def _punch_flags(i: Inputs) -> DataFrame:
    flags = {
        "short_break": p.short_break(),
        "first_meal_break": p.first_meal_break(),
        "waiver_on_file": p.waiver_on_file(),
        "split_shift": p.split_shift(),
        "did_not_break": p.did_not_break(),
        "did_not_break_any": p.did_not_break_any_length(),
        "short_shift": p.short_shift(),
        "same_date": p.same_date_as_prev(),
        "over_twelve": p.over_twelve(),
        "first_of_day": F.col("first_of_day"),
    }
    facts = i.facts
    return facts.select("id", "seq", *[c.alias(f"is_{n}") for n, c in flags.items()])


def _daily_flags(i: Inputs) -> DataFrame:
    return i.daily.select(
        "id",
        "location",
        "workday",
        F.col("first_of_id").alias("is_first"),
        p.no_overtime_at_all().alias("is_zero"),
        p.ot_variance().alias("is_ot_variance"),
        p.dt_variance().alias("is_dt_variance"),
        p.consecutive_day().alias("is_consecutive"),
    )


def _register_flags(i: Inputs) -> DataFrame:
    names = ["Variance", "Variance Dble", "Variance BrkCrd", "Variance RestCrd", "Variance Sick"]
    return i.register.select(
        F.col("IDX").alias("id"),
        *[p.pay_variance(n).alias("is_" + n.lower().replace(" ", "_")) for n in names],
        p.exempt_below_rate().alias("is_flsa"),
        p.below_min_wage().alias("is_min_wage"),
        p.paid_while_inactive().alias("is_non_active"),
    )


def _daily_midnight_split(i: Inputs) -> DataFrame:
    days = daily_hours(i.tables.punches)
    return days.select(
        "id", "employee", "location", "workday", rnd(hours("hours_us"), 4).alias("hours_worked")
    )


def _daily_ot_dt(i: Inputs) -> DataFrame:
    days = weekly.to_hours(daily_overtime(day_rules(daily_hours(i.tables.punches), i.tables.rules)))
    return days.select("id", "location", "workday", "regular_hours", "ot_hours", "dt_hours")


def _fiscal_pay_date(i: Inputs) -> DataFrame:
    df = i.tables.rules.with_globals(
        i.tables.punches.withColumn("workday", F.col("in_punch").cast("date")),
        anchor="anchor_pay_date",
        length="pay_period_length",
        gap="days_bet_payroll_end_and_pay_date",
    )
    paid = fiscal_pay_date(F.col("workday"), F.col("anchor"), F.col("length"), F.col("gap"))
    return df.withColumn("fiscal_pay_date", paid).groupBy("workday", "fiscal_pay_date").agg(
        F.count(F.lit(1)).alias("punches")
    )


def _carryover(i: Inputs) -> DataFrame:
    """Streaks of the period alone, continuing the runs left by the period before it."""
    t = i.tables
    day = F.col("in_punch").cast("date")
    before = t.punches.where(day < F.lit(PERIOD_START)).withColumn(
        "pay_date", F.when(F.col("id").isNotNull(), F.lit(PRIOR_PAY_DATE))
    )
    prior_profile = t.profile_for(PRIOR_PAY_DATE)
    prior = weekly.daily_windows(before, t.rules, None, prior_profile)
    runs = t.punches.select(*TENANT).distinct()
    carried = lookups.carryover_streaks(prior, runs, t.rules)
    within = t.punches.where(day.between(F.lit(PERIOD_START), F.lit(PERIOD_END)))
    df = weekly.daily_windows(within, t.rules, carried, t.profile)
    return df.select("id", "workday", "days_worked", "regular_hours", "ot_hours", "dt_hours")


def _register_with_strays(i: Inputs) -> DataFrame:
    """The register with some pay dates of another period or missing."""
    stray = (
        F.when(F.col("seq") % 97 == 5, F.lit(PRIOR_PAY_DATE).cast("timestamp_ntz"))
        .when(F.col("seq") % 101 == 7, F.lit(None))
        .otherwise(F.col("`Pay Date`"))
    )
    return i.tables.register.withColumn("Pay Date", stray)


def _register_date_mismatch(i: Inputs) -> DataFrame:
    found = validate.register_date_mismatches(_register_with_strays(i))
    shown = F.transform("samples", lambda s: F.concat_ws(":", s["IDX"], s["on_file"]))
    return found.select("employees", F.array_join(shown, ", ").alias("samples"))


def _intake_outliers(i: Inputs) -> DataFrame:
    found = validate.punch_outliers(i.tables.punches, i.tables.rules)
    return found.select("punch_day", "punches")


def _intake_check(i: Inputs) -> DataFrame:
    found = validate.check_pay_dates(i.tables.punches, i.tables.rules)
    days = F.array_join(F.transform("days", lambda d: d.cast("string")), ", ")
    shown = F.transform("samples", lambda s: F.concat_ws(":", s["seq"].cast("string"), s["id"]))
    return found.select(
        "error_type",
        "first_day",
        "last_day",
        "file_first",
        "file_last",
        "outliers",
        days.alias("days"),
        F.array_join(shown, ", ").alias("samples"),
    )


def _duplicate_keys(i: Inputs) -> DataFrame:
    return validate.duplicate_keys(i.tables.waiver_rows, ["client_id", "ID"]).select(
        F.col("ID").alias("id"), "rows"
    )


def _duplicate_punches(i: Inputs) -> DataFrame:
    """Punches keyed by employee and the hour they start in, which does repeat."""
    hour = F.col("in_punch") - F.make_dt_interval(
        F.lit(0), F.lit(0), F.minute("in_punch"), F.extract(F.lit("SECOND"), F.col("in_punch"))
    )
    keyed = i.tables.punches.withColumn("in_punch", hour)
    return validate.duplicate_keys(keyed, ["client_id", "id", "in_punch"]).drop("client_id")


def _map_concat_substring(i: Inputs) -> DataFrame:
    """Customers in the shape of a payroll export, mapped to standard columns."""
    k = F.col("c_custkey")
    export = i.tables.table("customer").select(
        F.element_at(F.array(F.lit("AAA"), F.lit("BBB"), F.lit("CCC")), (k % 3 + 1).cast("int")).alias(
            "CO."
        ),
        k.cast("string").alias("FILE#"),
        F.col("c_acctbal").alias("REG"),
        F.col("c_mktsegment").alias(" Job Title Description "),
    )
    export = normalize.strip_headers(export)
    mapped = normalize.apply_mappings(
        export,
        [
            *ADP.mappings,
            Slice("head", "IDX", 0, 3),
            Slice("tail", "IDX", -4, None),
            Slice("inner", "IDX", 2, -2),
        ],
    )
    return mapped.select(
        F.col("IDX").alias("id"),
        F.col("Location").alias("location"),
        F.col("Regular Hours").alias("reg"),
        F.col("Job Description").alias("job"),
        "head",
        "tail",
        "inner",
    )


def _drop_rows(i: Inputs) -> DataFrame:
    events = i.tables.table("events").select(
        "event_id",
        F.when(F.col("value") > 5, F.col("event_type")).otherwise("  ").alias("In Punch"),
        F.col("event_type").alias("Apply To"),
        F.col("user_id").cast("string").alias("ID"),
    )
    rules = {"In Punch": BLANK, "Apply To": ["view", "error"], "ID": "7", "Unknown": ["x"]}
    return normalize.drop_rows(events, rules).select("event_id")


def _location_override(i: Inputs) -> DataFrame:
    df = i.tables.punches.groupBy("client_id", "location").agg(F.count(F.lit(1)).alias("punches"))
    df = i.tables.rules.resolve(
        df,
        min_wage="min_wage",
        ot_day_max="ot_day_max",
        gap="time_gap_for_new_shift",
        rolling="cba_consec_anyweek",
        state_min_wage="state_min_wage",
    )
    return df.drop("client_id")


def _punch_query(i: Inputs) -> DataFrame:
    stored = labelled(i.facts, fv.PUNCH_LABELS)
    return query_punches(
        stored,
        CLIENT,
        start=PERIOD_START,
        end=PERIOD_END,
        columns=["Shift Number", "Is Break?", "ID"],
    )


def _daily_query(i: Inputs) -> DataFrame:
    stored = labelled(i.daily, fv.DAILY_LABELS)
    df = query_daily(stored, CLIENT, start="2024-01-08", end="2024-01-14")
    return df.select(
        "ID", "Location", "Attributed_Workday", "Hours_Worked", "Regular_Hrs", "OT_Hrs", "DT_Hrs"
    )


def _upsert_result(i: Inputs) -> DataFrame:
    """Two saves: later work first under this pay date, then amended under the next one."""
    store = _store(i, "upsert")
    rows = i.tables.punches.where("id is not null").select(
        *TENANT,
        F.col("id").alias("ID"),
        F.col("in_punch").alias("In Punch"),
        F.col("status").alias("Status"),
    )
    key = ["client_id", "ID", "In Punch"]
    store.replace_periods(rows, "punches", key)
    late = rows.where(F.col("In Punch").cast("date") > F.lit(PERIOD_END)).withColumns(
        {"pay_date": F.lit(NEXT_PAY_DATE), "Status": F.lit("Amended")}
    )
    store.replace_periods(late, "punches", key)
    return store.read("punches").select("ID", "In Punch", "Status", "pay_date")


def _outer_merge(i: Inputs) -> DataFrame:
    """Open orders per customer merged into the punch totals of the same key."""
    events = i.tables.table("events").where("user_id is not null")
    target = events.groupBy(F.col("user_id").alias("key")).agg(
        F.count(F.lit(1)).alias("punches"), F.max(F.lit(None).cast("string")).alias("name")
    )
    source = i.tables.table("customer").select(
        F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")
    )
    return lookups.outer_merge_fill(target, source, "key")


def _file_neighbours(i: Inputs) -> DataFrame:
    punches = i.tables.punches.where("id is not null").select(*TENANT, "seq", "id")
    return lookups.file_neighbours(punches).select("seq", "id", "prev_id", "next_id")


# Lines that one written file holds on average, at most, and bits for the number of a task's range of lines.
FILE_LINES = 250_000
RANGE_BITS = 20


def _export_lines(kind: str, head: list[str], line: str, source: DataFrame) -> DataFrame:
    """Numbered lines of exports: title lines, a header and a line per row.

    ``source`` carries ``part``, the file, and ``row``; ``line`` is the expression of its text.
    """
    rows = source.select("part", (F.col("row") + len(head)).alias("line"), F.expr(line).alias("value"))
    top = F.posexplode(F.array(*[F.lit(h) for h in head])).alias("line", "value")
    heads = source.select("part").distinct().select("part", top)
    return rows.unionByName(heads).select(
        F.lit(CLIENT).alias("client_id"),
        F.lit(PAY_DATE).alias("pay_date"),
        F.concat(F.lit(f"{kind}-"), F.col("part").cast("string")).alias("file"),
        F.col("line").cast("long").alias("line"),
        "value",
    )


def _exported(kind: str, head: list[str], line: str, source: DataFrame) -> DataFrame:
    """The lines of ``_export_lines`` as ``read_lines`` gives them: a task's range of a file is a split of it."""
    lines = _export_lines(kind, head, line, source)
    lines = lines.repartitionByRange("file", "line").sortWithinPartitions("file", "line")
    # Ranges are numbered in the order of lines. Whatever a line's number, its lower bits fit a row.
    block = F.shiftright("line", ROW_BITS) * F.lit(1 << RANGE_BITS) + F.spark_partition_id()
    row = F.col("line").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    lines = lines.select("client_id", "pay_date", "file", block.alias("block"), row.alias("row"), "value")
    seq = (F.col("block").cast("decimal(20,0)") * F.lit(1 << ROW_BITS) + F.col("row")).cast("decimal(38,0)")
    return lines.select("client_id", "pay_date", "file", "block", seq.alias("seq"), "value")


def _line_number() -> Column:
    """The number of a line of ``_exported`` in its file, from ``seq``."""
    row = F.expr(f"pmod(seq, {1 << ROW_BITS})")
    block = F.expr(f"(seq - pmod(seq, {1 << ROW_BITS})) div {1 << ROW_BITS}")
    return F.shiftright(block, RANGE_BITS) * F.lit(1 << ROW_BITS) + row.cast("long")


def _intake_punches(i: Inputs) -> DataFrame:
    """Time cards of two systems, written from the events and read by the intake."""
    events = i.tables.table("events").where("user_id is not null and event_id is not null").selectExpr(
        "user_id % 4 as part",
        "event_id as row",
        "user_id",
        "event_id",
        "date_trunc('minute', ts) as tin",
        "date_trunc('minute', ts) + make_dt_interval(0, 0, cast(30 + event_id % 571 as int)) as tout",
    )
    times = """date_format(tin, 'yyyy-MM-dd HH:mm:ss'), ',',
      if(event_id % 50 = 3, '', date_format(tout, 'yyyy-MM-dd HH:mm:ss')), ',ok,,'"""
    titles = [f"title {n}" for n in range(7)]
    own = _exported(
        "time",
        [*titles, "ID,Employee,In Punch,Out Punch, Status ,Status Date,In Punch Comment"],
        f"""concat(' AAA', lpad(cast(user_id as string), 7, '0'), ' ,"Doe, ', user_id, '",', {times})""",
        events.where("user_id % 2 = 0"),
    )
    other = _exported(
        "manager",
        [
            *titles[:5],
            "Employee,Pay Group,Payroll File Number,In Punch,Out Punch,Status,Status Date,Apply To,Home Labor Category",
        ],
        f"""concat(if(user_id % 10 = 1, 'testee', concat('W', user_id)), ',BBB,',
          lpad(cast(user_id as string), 6, '0'), ',', {times}, if(event_id % 20 = 7, 'Vacation', ''), ',x')""",
        events.where("user_id % 2 = 1"),
    )
    intake = exports.parse_exports(own.unionByName(other), PUNCH_SYSTEMS)
    return exports.normalized(intake, PUNCH_SYSTEMS, normalize.normalize_punches).select(
        "id", "location", "employee", "in_punch", "out_punch", "status"
    )


def _intake_register(i: Inputs) -> DataFrame:
    """A payroll export written from the customers and read by the intake."""
    people = i.tables.table("customer").where("c_custkey is not null").selectExpr(
        "0 as part", "c_custkey as row", "c_custkey", "c_name", "c_acctbal"
    )
    lines = _exported(
        "pay",
        [*[f"title {n}" for n in range(5)], "CO.,FILE#,Payroll Name,PAY DATE,REG,OT"],
        """concat('AAA,', c_custkey, ',"', c_name, ', X",', if(c_custkey % 9 = 4, 'bad', '2024-01-26'), ',',
          c_custkey % 80, ',', if(c_custkey % 3 = 0, '', cast(c_custkey % 7 as string)))""",
        people,
    )
    intake = exports.parse_exports(lines, REGISTER_SYSTEMS)
    register = exports.normalized(intake, REGISTER_SYSTEMS, normalize.normalize_register)
    return register.select(
        F.col("IDX").alias("id"),
        F.col("Payroll Name").alias("name"),
        F.col("Pay Date").alias("paid_on"),
        F.col("Regular Hours").alias("hours"),
        F.col("Overtime Hours").alias("ot"),
        F.col("Location").alias("location"),
    )


def _intake_waivers(i: Inputs) -> DataFrame:
    """A waiver list written from the customers, with repeated IDs; its first row decides."""
    people = i.tables.table("customer").where("c_custkey is not null").selectExpr(
        "0 as part", "c_custkey as row", "c_custkey"
    )
    lines = _exported(
        "waivers",
        ["ID,Check"],
        "concat(c_custkey div 2, ',', if(c_custkey % 3 = 0, ' X ', if(c_custkey % 3 = 1, '', 'no')))",
        people,
    )
    rows = exports.parse_exports(lines, [exports.WAIVER_LIST]).frames[exports.WAIVER_LIST.name]
    return normalize.prepare_waivers(rows).select("id", "has_waiver")


def _intake_rejected(i: Inputs) -> DataFrame:
    """Lines of a waiver list that are no records: open quotes and cells beyond the header."""
    people = i.tables.table("customer").where("c_custkey is not null").selectExpr(
        "0 as part", "c_custkey as row", "c_custkey"
    )
    line = '''concat(c_custkey, ',', if(c_custkey % 7 = 2, '"X', '"X, ""y"""'), if(c_custkey % 7 = 3, ',more', ', '))'''
    intake = exports.parse_exports(
        _exported("waivers", ["ID,Check"], line, people), [exports.WAIVER_LIST]
    )
    kept = intake.frames[exports.WAIVER_LIST.name].select("seq", F.lit("kept").alias("fate"))
    return kept.union(intake.rejected.select("seq", "reason")).select(
        _line_number().alias("line"), "fate"
    )


def _exported_files(i: Inputs, kind: str, head: list[str], line: str, source: DataFrame) -> str:
    """The same lines in real files, one for each part; the folder of the intake."""
    root = f"{shared_folder(i.spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    folder = [*TENANT, "file"]
    lines = _export_lines(kind, head, line, source).repartition("file")
    lines = lines.sortWithinPartitions(*folder, "line").select(*folder, "value")
    lines.write.partitionBy(*folder).text(root)
    return root


def _intake_multiline(i: Inputs) -> DataFrame:
    """Payroll exports in real files, with names over several lines and names whose quote never closes."""
    people = i.tables.table("customer").where("c_custkey is not null")
    # A file is written by one task, so their number grows with the table.
    files_ = max(4, people.count() // FILE_LINES)
    people = people.selectExpr(f"c_custkey % {files_} as part", "c_custkey as row", "c_custkey", "c_name")
    root = _exported_files(
        i,
        "payroll",
        [*[f"title {n}" for n in range(4)], '"title\nof two lines"', "CO.,FILE#,Payroll Name,PAY DATE,REG,OT"],
        """concat('AAA,', c_custkey, ',"', c_name, case when c_custkey % 13 = 7 then ','
            when c_custkey % 5 = 0 then '\n\nsays ""no"", twice",' when c_custkey % 5 = 1 then ',\n"","" ",'
            else '",' end, '2024-01-26,', c_custkey % 80, ',1')""",
        people,
    )
    register, intake = exports.read_register(i.spark, root, on_rejected="keep")
    kept = register.select(
        F.col("IDX").alias("id"), F.col("Payroll Name").alias("name"), F.col("Regular Hours").alias("hours")
    )
    bad = intake.rejected.select(
        F.regexp_extract("value", "^AAA,([0-9]+),", 1).alias("id"),
        F.col("reason").alias("name"),
        F.lit(None).cast("double").alias("hours"),
    )
    return kept.unionByName(bad.where("id <> ''"))


def _rejected_periods(i: Inputs) -> DataFrame:
    """Periods of several clients: stragglers, off the cycle, unknown client, no register."""
    which = F.pmod("seq", F.lit(4))
    punches = i.tables.punches.where("id is not null").withColumns(
        {
            "client_id": F.when(which == 2, "other").otherwise(CLIENT),
            "pay_date": F.when(which == 1, F.lit(dt.date(2024, 1, 25)))
            .when(which == 3, F.lit(PRIOR_PAY_DATE))
            .otherwise(F.lit(PAY_DATE)),
        }
    )
    found = rejected_periods(punches, i.tables.register, i.tables.rules)
    return found.select("client_id", "pay_date", "error_type")


def _store(i: Inputs, name: str) -> AuditStore:
    return AuditStore(i.spark, f"{shared_folder(i.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")


def _save_punches(i: Inputs) -> DataFrame:
    store = _store(i, "punches")
    store.save_punches(i.facts)
    return store.read("punches").select(
        "ID", "In Punch", "Out Punch", "Employee", "Shift Number", "Is Break?", "pay_date"
    )


def _save_daily(i: Inputs) -> DataFrame:
    store = _store(i, "daily")
    store.save_daily(i.daily)
    return store.read("daily").select(
        "ID", "Location", "Attributed_Workday", "Hours_Worked", "Regular_Hrs", "OT_Hrs", "DT_Hrs", "pay_date"
    )


def _delete_period(i: Inputs) -> DataFrame:
    """Punches of two periods are stored, the later period is deleted."""
    store = _store(i, "deleted")
    late = F.col("in_punch").cast("date") > F.lit(PERIOD_END)
    rows = i.tables.punches.where("id is not null").select(
        "client_id",
        F.when(late, F.lit(NEXT_PAY_DATE)).otherwise(F.col("pay_date")).alias("pay_date"),
        F.col("id").alias("ID"),
        F.col("in_punch").alias("In Punch"),
    )
    store.replace_periods(rows, "punches", ["client_id", "ID", "In Punch"])
    store.delete_period(CLIENT, NEXT_PAY_DATE)
    return store.read("punches").select("ID", "In Punch", "pay_date")


def _raw_copy(i: Inputs) -> DataFrame:
    """The register as kept in the raw copy, read back as text."""
    store = _store(i, "raw")
    store.save_raw(i.tables.register.where("client_id is not null"), "register")
    raw = store.read("raw", "register")
    return raw.select(
        F.col("IDX").alias("id"),
        F.col("Payroll Name").alias("name"),
        F.col("Location").alias("location"),
        F.col("Regular Hours").cast("double").alias("hours"),
    )


def _raw_waivers(i: Inputs) -> DataFrame:
    """Waiver lists of two pay dates and one of the client, read back from the CSV and the JSON copies."""
    store = _store(i, "raw-waivers")
    filed = i.tables.table("customer").where("c_custkey is not null").select(
        F.lit(CLIENT).alias("client_id"),
        F.when(F.col("c_custkey") % 2 == 0, F.lit(PAY_DATE)).otherwise(F.lit(NEXT_PAY_DATE)).alias("pay_date"),
        F.col("c_custkey").cast("string").alias("ID"),
        F.expr("if(c_custkey % 3 = 0, 'x', concat('no, \"', c_name, '\"\n'))").alias("Check"),
    )
    store.save_raw(filed, "waivers")
    store.save_raw(filed.where("ID % 5 = 0").drop("pay_date"), "waivers")
    out = None
    for copy in ("waivers", "waivers_json", "waivers_of_client", "waivers_of_client_json"):
        df = store.read("raw", copy)
        paid = F.col("pay_date") if "pay_date" in df.columns else F.lit(None).cast("date")
        df = df.select(F.lit(copy).alias("copy"), "ID", "Check", paid.alias("filed"))
        out = df if out is None else out.unionByName(df)
    return out


EMPLOYEE = "AAA0000003"


def _employee_punches(i: Inputs) -> DataFrame:
    """One employee's punches of some days from the stored table, whose files are clustered by ID."""
    store = _store(i, "lookup")
    store.save_punches(i.facts)
    found = query_punches(store.read("punches"), CLIENT, EMPLOYEE, "2024-01-07", "2024-01-20", ["Shift Number"])
    return found.select("ID", "In Punch", "Out Punch", "Shift Number")


def _employee_daily(i: Inputs) -> DataFrame:
    """The same for daily rows."""
    store = _store(i, "lookup")
    store.save_daily(i.daily)
    found = query_daily(store.read("daily"), CLIENT, EMPLOYEE)
    return found.select("ID", "Attributed_Workday", "Hours_Worked", "Regular_Hrs", "OT_Hrs")


def _changed_streaks(i: Inputs) -> DataFrame:
    """Streaks that a stored period carries on from, after part of the period before was saved again without
    its last two days."""
    t, store = i.tables, _store(i, "streaks")
    day = F.col("in_punch").cast("date")
    before = t.punches.where(day < F.lit(PERIOD_START)).withColumn(
        "pay_date", F.when(F.col("id").isNotNull(), F.lit(PRIOR_PAY_DATE))
    )
    prior = weekly.daily_windows(before, t.rules, None, t.profile_for(PRIOR_PAY_DATE))
    rows = prior.select(
        *TENANT,
        F.col("id").alias("ID"),
        F.col("location").alias("Location"),
        F.col("workday").alias("Attributed_Workday"),
        F.col("days_worked").alias("Days_Worked_In_Week"),
    )
    key = ["client_id", "ID", "Location", "Attributed_Workday"]
    store.replace_periods(rows, "daily", key)
    periods = t.punches.where("client_id is not null").select(*TENANT).distinct()
    with store.commit():
        store.save_runs({"ta_rows": periods}, t.rules, {})
        store.save_carried(stored_carryover(store, periods, t.rules), periods)
    cut = (F.substring("ID", -1, 1).cast("int") % 2 == 0) & (F.col("Attributed_Workday") > "2024-01-04")
    store.replace_periods(rows.where(~cut), "daily", key)
    return changed_streaks(store, t.rules).select("id", "pay_date", "recorded", "current")


def _stored_run(i: Inputs) -> AuditStore:
    store = _store(i, "results")
    names = ["overtime_checks_variances"]
    known = i.register.where("client_id is not null")
    store.save_reports({n: register_report(n, known) for n in names}, known.select(*TENANT).distinct())
    tables = {"ta_rows": i.tables.punches, "wfn_rows": i.tables.register, "waiver_rows": None}
    counts = {n: d if d is None else d.where("client_id is not null") for n, d in tables.items()}
    store.save_runs(counts, i.tables.rules, {})
    return store


def _stored_report(i: Inputs) -> DataFrame:
    return load_results(_stored_run(i), CLIENT, PAY_DATE)["overtime_checks_variances"]


def _run_metadata(i: Inputs) -> DataFrame:
    store = _stored_run(i)
    listed = list_periods(store, CLIENT).select("pay_date", "first_date", "last_date")
    return listed.join(store.read("runs").select("pay_date", "ta_rows", "wfn_rows", "waiver_rows"), "pay_date")


def _rules_documents(i: Inputs) -> DataFrame:
    """Settings documents, one per nation, written and read back, and their values for every customer."""
    nations = i.tables.table("nation")
    client = F.concat(F.lit("n"), F.col("n_nationkey"))
    text = F.expr(
        """concat('{"global": {"workweek_start": "Monday", "ot_day_max": ', 8 + n_nationkey % 3,
        ', "ot_week_max": 40, "dt_day_max": 12, "number_of_consec_days_before_ot": 6',
        if(n_nationkey % 2 = 1, ', "min_wage": 18.5', ''),
        '}, "locations": {"X": {"time_gap_for_new_shift": ', 30 + n_nationkey, '}}}')"""
    )
    root = f"{shared_folder(i.spark).rstrip('/')}/settings-{uuid.uuid4().hex}"
    nations.select(client.alias("client_id"), text.alias("value")).write.partitionBy("client_id").text(root)
    anchors = nations.select(client.alias("client_id"), F.lit(PAY_DATE).alias("anchor_pay_date"))
    rules = Rules.read(i.spark, root, anchors)
    people = i.tables.table("customer").select(
        F.col("c_custkey").alias("id"),
        F.concat(F.lit("n"), F.col("c_nationkey")).alias("client_id"),
        F.when(F.col("c_custkey") % 2 == 0, "X").otherwise("Y").alias("location"),
    )
    named = {"gap": "time_gap_for_new_shift", "wage": "min_wage", "ot_day": "ot_day_max", "length": "pay_period_length"}
    return rules.resolve(people, **named).select("id", *named)


def _skipped_checks(i: Inputs) -> DataFrame:
    """A register without two columns: its checks that run, and the reasons of the others."""
    partial = i.tables.register.drop("Sick Pay Hours", "Hire Date")
    reasons = F.array_join(
        F.sort_array(F.collect_list(F.concat_ws(": ", "check", "reason"))), "; "
    )
    skipped = skipped_checks(partial).agg(reasons.alias("skipped"))
    facts = register_facts(partial, i.tables.rules)
    gone = [c for c in ("Variance Sick", "Non-Active") if c in facts.columns]
    rows = facts.select(F.col("IDX").alias("id"), F.col("Variance").alias("variance"), F.lit(len(gone)).alias("computed"))
    # The one row of reasons: as many as there are checks.
    return rows.withColumn("skipped", F.lit(skipped.first()["skipped"]))


def _absent_lookup(i: Inputs) -> DataFrame:
    """A lookup column that the register has, and one that it lacks."""
    register = i.tables.register
    df = i.tables.punches.where("id is not null").select("id", "seq")
    df = lookups.add_column(df, register, "id", "IDX", "Break Credit Hours", "paid")
    return lookups.add_column(df, register, "id", "IDX", "Uniform Credit Hours", "absent")


def _report_top_rows(i: Inputs) -> DataFrame:
    """The first 200 rows of a report per pay period: the limit is the feature."""
    top = time_card_report("short_shift", punches=i.facts, limit=200)
    return json_safe(top).drop(*TENANT)


def _legacy_weekly_ot(i: Inputs) -> DataFrame:
    df = legacy.punch_overtime(i.facts, i.tables.rules, i.tables.profile)
    return df.drop(*TENANT)


def _legacy_rolling_days(i: Inputs) -> DataFrame:
    df = legacy.consecutive_day_hours(i.tables.punches, i.tables.rules, i.tables.profile)
    return df.drop(*TENANT)


def _run_counts(i: Inputs) -> DataFrame:
    """Rows per table of the run."""
    frames = {
        "ta_rows": i.tables.punches,
        "wfn_rows": i.tables.register,
        "waiver_rows": i.tables.waivers,
        "anomalies_rows": i.summary,
    }
    out = None
    for name, df in frames.items():
        n = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = n if out is None else out.union(n)
    return out


def _json_report(i: Inputs) -> DataFrame:
    report = time_card_report("seven_consecutive", daily=i.daily)
    return json_rows(report, keep=[*TENANT, "ID", "Trigger Date"]).select("ID", "Trigger Date", "row")


def _tidy(df: DataFrame) -> DataFrame:
    """Dates and timestamps as ISO text, as in the published results."""

    def text(name: str, kind: str):
        c = F.col(f"`{name}`")
        if kind.startswith("timestamp"):
            return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias(name)
        return c.cast("string").alias(name) if kind == "date" else c

    return df.select(*[text(n, k) for n, k in df.dtypes])


def _report(name: str) -> Callable[[Inputs], DataFrame]:
    if name in REGISTER_REPORTS:
        return lambda i: json_safe(register_report(name, i.register)).drop(*TENANT)
    source = "daily" if name in ("seven_consecutive", "ot_vs_wfn", "dt_vs_wfn") else "punches"
    if name == "break_credit_summary":
        return lambda i: json_safe(time_card_report(name, summary=i.summary)).drop(*TENANT)
    if source == "daily":
        return lambda i: json_safe(time_card_report(name, daily=i.daily)).drop(*TENANT)
    return lambda i: json_safe(time_card_report(name, punches=i.facts)).drop(*TENANT)


def _catalog() -> dict[str, Callable[[Inputs], DataFrame]]:
    out: dict[str, Callable[[Inputs], DataFrame]] = {}
    for name, cols in _PUNCH_COLUMNS.items():
        out[name] = _of(["id", "seq", *cols], "facts")
    out["punch_flags"] = _punch_flags
    out["anomaly_rollup"] = _anomaly_rollup
    out["daily_midnight_split"] = _daily_midnight_split
    out["daily_ot_dt"] = _daily_ot_dt
    out["fiscal_pay_date"] = _fiscal_pay_date
    for name, cols in _DAILY_ALL.items():
        out[name] = _of(["id", *cols], "daily_all")
    for name, cols in _DAILY.items():
        out[name] = _of(["id", *cols], "daily")
    out["daily_flags"] = _daily_flags
    out["carryover_streaks"] = _carryover
    for name, cols in _REGISTER.items():
        out[name] = _of({"id": "IDX", **cols}, "register")
    out["register_flags"] = _register_flags
    for name in (*REGISTER_REPORTS, *TIME_CARD_REPORTS):
        out[f"report_{name}"] = _report(name)
    out.update(
        {
            "intake_outliers": _intake_outliers,
            "intake_check": _intake_check,
            "register_date_mismatch": _register_date_mismatch,
            "duplicate_keys": _duplicate_keys,
            "duplicate_punches": _duplicate_punches,
            "map_concat_substring": _map_concat_substring,
            "drop_rows": _drop_rows,
            "location_override": _location_override,
            "punch_query": _punch_query,
            "daily_query": _daily_query,
            "upsert_result": _upsert_result,
            "outer_merge_fill": _outer_merge,
            "file_neighbours": _file_neighbours,
            "intake_punches": _intake_punches,
            "intake_register": _intake_register,
            "intake_waivers": _intake_waivers,
            "intake_rejected": _intake_rejected,
            "intake_multiline": _intake_multiline,
            "rejected_periods": _rejected_periods,
            "save_punches": _save_punches,
            "save_daily": _save_daily,
            "delete_period": _delete_period,
            "raw_copy": _raw_copy,
            "raw_waivers": _raw_waivers,
            "employee_punches": _employee_punches,
            "employee_daily": _employee_daily,
            "changed_streaks": _changed_streaks,
            "stored_report": _stored_report,
            "run_metadata": _run_metadata,
            "rules_documents": _rules_documents,
            "skipped_checks": _skipped_checks,
            "absent_lookup": _absent_lookup,
            "report_top_rows": _report_top_rows,
            "legacy_weekly_ot": _legacy_weekly_ot,
            "legacy_rolling_days": _legacy_rolling_days,
            "run_counts": _run_counts,
            "json_report": _json_report,
        }
    )
    return out


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn):
        return lambda spark, folder: _tidy(fn(inputs(spark, folder)))

    return {name: bind(fn) for name, fn in _catalog().items()}
