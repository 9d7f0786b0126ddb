"""Hand-computed cases."""

import datetime as dt

import pytest
from helpers import PAY_DATE, punches, rules

from shiftledger.config.rules import Rules
from shiftledger.operators.anomalies import break_credit_summary
from shiftledger.operators.daily import daily_hours
from shiftledger.operators.lookups import DuplicateKeys, add_column, unique_by
from shiftledger.operators.normalize import MissingColumns, drop_rows, prepare_waivers, require_columns
from shiftledger.operators.punches import punch_facts
from shiftledger.operators.register import check_availability, register_facts
from shiftledger.operators.weekly import daily_facts
from shiftledger.config import fixed_values as fv
from shiftledger.plans.reports import register_report
from shiftledger.sources.sample_tables import SETTINGS


def facts(spark, rows, **kw):
    return punch_facts(punches(spark, rows), rules(spark), **kw)


@pytest.mark.parametrize(
    "rows,due",
    [
        ([("1", "A", "08 06:00", "08 18:00")], True),  # no break
        ([("1", "A", "08 06:00", "08 17:59")], False),  # under twelve hours
        ([("1", "A", "08 06:00", "08 12:00"), ("1", "A", "08 12:30", "08 18:30")], True),  # one break
        (  # second break exactly after ten hours of work
            [
                ("1", "A", "08 06:00", "08 11:00"),
                ("1", "A", "08 11:30", "08 16:30"),
                ("1", "A", "08 17:00", "08 19:00"),
            ],
            False,
        ),
        (  # second break one minute later
            [
                ("1", "A", "08 06:00", "08 11:00"),
                ("1", "A", "08 11:30", "08 16:31"),
                ("1", "A", "08 17:00", "08 19:00"),
            ],
            True,
        ),
    ],
)
def test_twelve_hours(spark, rows, due):
    got = facts(spark, rows).select("twelve_hour_credit").distinct().collect()
    assert [r[0] for r in got] == [due]


def test_stapled_punch_counts_as_one(spark):
    rows = [("1", "A", "08 20:00", "09 00:00"), ("1", "A", "09 00:00", "09 02:00")]
    got = facts(spark, rows).orderBy("seq").select(
        "punch_hours", "is_break", "punch_no", "shift_no", "first_meal_break", "did_not_break"
    )
    assert [tuple(r) for r in got.collect()] == [(6.0, False, 1, 1, 0, 1), (6.0, False, 1, 1, 0, 0)]


def test_overlap_is_not_a_break(spark):
    rows = [("1", "A", "08 08:00", "08 12:00"), ("1", "A", "08 11:00", "08 15:00")]
    got = facts(spark, rows).orderBy("seq").collect()
    assert got[1]["break_min"] == -60 and not got[1]["is_break"] and got[1]["shift_hours"] == 8.0


def test_gap_of_the_threshold_starts_a_shift(spark):
    rows = lambda gap_end: [("1", "BBB", "08 08:00", "08 10:00"), ("1", "BBB", f"08 {gap_end}", "08 14:00")]
    assert facts(spark, rows("11:29")).agg({"shift_no": "max"}).first()[0] == 1
    assert facts(spark, rows("11:30")).agg({"shift_no": "max"}).first()[0] == 2


@pytest.mark.parametrize("check,due", [("x", 0), (" X ", 0), ("", 1), (None, 1)])
def test_waiver_lifts_a_short_shift(spark, check, due):
    rows = [("1", "A", "08 08:00", "08 13:30")]
    filed = spark.createDataFrame(
        [("demo", "1", 1, check), ("demo", "1", 2, "x")], "client_id string, ID string, seq long, Check string"
    )
    df = facts(spark, rows, waivers=prepare_waivers(filed))
    assert df.first()["did_not_break"] == due


def test_missing_out_punch(spark):
    rows = [("1", "A", "08 08:00", None), ("1", "A", "08 12:00", "08 13:00")]
    df = facts(spark, rows).orderBy("seq").collect()
    assert df[0]["raw_hours"] is None and df[1]["break_min"] is None and df[1]["new_shift"]
    days = daily_hours(punches(spark, rows)).collect()
    assert [(r["workday"], r["hours_us"]) for r in days] == [(dt.date(2024, 1, 8), 3_600_000_000)]


def test_midnight_pieces(spark):
    rows = [
        ("1", "A", "08 20:00", "09 00:00"),  # ends at midnight: zero hours on the 9th
        ("2", "A", "08 20:00", "10 02:00"),  # over a day: all but the last piece on the 8th
    ]
    days = daily_hours(punches(spark, rows)).orderBy("id", "workday").collect()
    got = [(r["id"], r["workday"].day, r["hours_us"] / 3.6e9) for r in days]
    assert got == [("1", 8, 4.0), ("1", 9, 0.0), ("2", 8, 28.0), ("2", 10, 2.0)]


def test_unknown_paid_credit_keeps_the_employee(spark):
    rows = [("1", "A", "08 08:00", "08 12:00")]
    row = break_credit_summary(facts(spark, rows)).first()
    assert (row["due_break_hours"], row["paid_break_hours"], row["variance"]) == (0, None, None)


def test_week_of_exactly_forty_hours(spark):
    rows = [("1", "A", f"{d:02d} 08:00", f"{d:02d} 16:00") for d in range(8, 13)]
    got = daily_facts(punches(spark, rows), rules(spark)).agg({"weekly_spillover": "sum", "cum_regular_hours": "max"}).first()
    assert got["sum(weekly_spillover)"] == 0 and got["max(cum_regular_hours)"] == 40


def test_seventh_day(spark):
    rows = [("1", "A", f"{d:02d} 08:00", f"{d:02d} 17:00") for d in range(7, 14)]
    df = daily_facts(punches(spark, rows), rules(spark)).orderBy("workday").collect()
    assert [r["days_worked"] for r in df] == [1, 2, 3, 4, 5, 6, 7]
    assert [r["consecutive_rule"] for r in df] == [False] * 6 + [True]
    last = df[-1]
    assert (last["regular_hours"], last["ot_hours"], last["dt_hours"]) == (0.0, 8.0, 1.0)
    assert last["first_day_of_streak"] == dt.date(2024, 1, 7)
    # Six days of eight regular hours: eight spill over on the sixth day.
    assert df[5]["weekly_spillover"] == 8.0 and df[5]["regular_hours"] == 0.0


def test_carryover_continues_only_from_the_day_before(spark):
    carried = spark.createDataFrame(
        [("demo", PAY_DATE, "1", 6), ("demo", PAY_DATE, "2", 6)],
        "client_id string, pay_date date, id string, carryover int",
    )
    rows = [("1", "CCC", "07 08:00", "07 16:00"), ("2", "CCC", "08 08:00", "08 16:00"), ("3", "AAA", "07 08:00", "07 16:00")]
    df = daily_facts(punches(spark, rows), rules(spark), carryover=carried).orderBy("id").collect()
    assert [(r["id"], r["days_worked"], r["consecutive_rule"]) for r in df] == [
        ("1", 7, True),
        ("2", 1, False),
        ("3", 1, False),
    ]


def test_fiscal_pay_date_counts_back_and_forward(spark):
    rows = [("1", "A", f"{d:02d} 08:00", f"{d:02d} 09:00") for d in (1, 6, 7, 20, 21)]
    df = daily_facts(punches(spark, rows), rules(spark), in_period=False).orderBy("workday")
    assert [r["fiscal_pay_date"].isoformat() for r in df.collect()] == [
        "2024-01-12",
        "2024-01-12",
        "2024-01-26",
        "2024-01-26",
        "2024-02-09",
    ]


@pytest.mark.parametrize(
    "columns,enabled",
    [
        ([], []),
        (["FLSA Status", "Position Status", "Regular Rate Paid"], ["flsa_check"]),
        (fv.CHECK_INPUTS["non_active_check"], ["non_active_check"]),
        (fv.RATE_INPUTS, ["overtime_checks_variances"]),
        (fv.RATE_INPUTS + ["Double Time Earnings"], ["overtime_checks_variances", "doubletime_checks_variances"]),
        (fv.REGISTER_COLUMNS, list(fv.CHECK_INPUTS)),
    ],
)
def test_partial_registers(columns, enabled):
    runnable, skipped = check_availability(fv.REGISTER_CORE_COLUMNS + columns)
    assert runnable == enabled
    assert set(skipped) == set(fv.CHECK_INPUTS) - set(enabled)
    assert all(reason.startswith("Missing ") for reason in skipped.values())


def test_disabled_check_gives_an_empty_report(spark):
    df = spark.createDataFrame(
        [("demo", PAY_DATE, 1, "1", "AAA", "n", "E", 50.0, "Active")],
        "client_id string, pay_date date, seq long, IDX string, Location string, `Payroll Name` string,"
        " `FLSA Status` string, `Regular Rate Paid` double, `Position Status` string",
    )
    done = register_facts(df, rules(spark))
    assert register_report("flsa_check", done).count() == 1
    empty = register_report("overtime_checks_variances", done)
    assert empty.count() == 0 and "Variance ($)" in empty.columns


def test_infinite_rate(spark):
    """Earnings without hours: infinite rate, dues that stay unknown, no exception."""
    row = {c: 0.0 for c in fv.REGISTER_COLUMNS if c not in fv.REGISTER_TEXT_COLUMNS + fv.REGISTER_DATE_COLUMNS}
    row.update({"Regular Earnings Total": 10.0, "Break Credit Hours": 1.0})
    names = list(row)
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"`{n}` double" for n in names))
    df = df.selectExpr("*", "'demo' client_id", "'AAA' Location", "'1' IDX", "'E' `FLSA Status`", "'Active' `Position Status`")
    got = register_facts(df, rules(spark)).first()
    assert got["Base Rate"] == float("inf") and got["RROP"] is None
    assert got["1.5 OT Earnings Due"] is None and got["Variance"] is None


def test_tenants_together_equal_tenants_alone(spark):
    both = Rules.from_settings(
        spark, {"a": {**SETTINGS["demo"]}, "b": {**SETTINGS["demo"], "global": {**SETTINGS["demo"]["global"], "ot_day_max": 6}}}
    )
    rows = [("1", "BBB", f"{d:02d} 08:00", f"{d:02d} 18:00") for d in range(7, 15)] + [
        ("1", "AAA", "16 08:00", "16 18:00")
    ]
    a, b = punches(spark, rows, "a"), punches(spark, rows, "b")
    together = daily_facts(a.unionByName(b), both)
    alone = daily_facts(a, both).unionByName(daily_facts(b, both))
    assert together.exceptAll(alone).count() == 0 and alone.count() == together.count() == 18


def test_lookup_policies(spark):
    home = spark.createDataFrame([("1",), ("2",)], "ID string")
    twice = spark.createDataFrame([("1", 5.0, 2), ("1", 7.0, 1)], "IDX string, v double, seq long")
    with pytest.raises(DuplicateKeys):
        unique_by(twice, ["IDX"])
    got = add_column(home, twice, "ID", "IDX", "v", "w", on_duplicate="first").orderBy("ID").collect()
    assert [r["w"] for r in got] == [7.0, None]
    assert add_column(home, None, "ID", "IDX", "v", "w").first()["w"] is None


def test_columns_and_rows_dropped(spark):
    df = spark.createDataFrame([("a", "x"), (" ", "y"), (None, "z"), ("b", "x")], "p string, q string")
    with pytest.raises(MissingColumns):
        require_columns(df, ["p", "r"])
    assert drop_rows(df, {"p": "Blank"}).count() == 2
    assert drop_rows(df, {"p": "Blank", "q": ["x", "w"], "nope": "Blank"}).count() == 0
    assert drop_rows(df, {"q": "x"}).count() == 2 and drop_rows(df, {}).count() == 4
