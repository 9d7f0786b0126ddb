"""Delimited exports: detection, line order, mapping, quarantine; pay-date checks."""

import datetime as dt

import pytest
from helpers import PAY_DATE, punches, rules
from pyspark.sql import functions as F

from shiftledger.plans import catalog
from shiftledger.operators.lookups import DuplicateKeys, waivers_for_runs
from shiftledger.operators.normalize import prepare_waivers
from shiftledger.operators.validate import (
    IntakeError,
    check_pay_dates,
    duplicate_keys,
    register_date_mismatches,
    require_inputs,
)
from shiftledger.plans.audit import run
from shiftledger.sinks.store import AuditStore
from shiftledger.config.systems import PUNCH_SYSTEMS
from shiftledger.sources.exports import (
    RejectedLines,
    UnrecognizedSystem,
    line_fault,
    read_exports,
    read_lines,
    read_punches,
    read_register,
    read_waivers,
)
from shiftledger.operators.weekly import daily_facts
from shiftledger.sources.stored import list_periods, load_results, query_daily, query_punches, stored_carryover
from shiftledger.sinks.store import NotFound

TIME_HEADER = "ID,Employee,In Punch,Out Punch, Status ,Status Date,In Punch Comment"
WFM_HEADER = 'Employee,Pay Group,Payroll File Number,In Punch,Out Punch,Status,Status Date,Apply To,"Home Labor Category"'
ADP_HEADER = "CO.,FILE#,Payroll Name,PAY DATE,REG,OT,DBLTIME HRS,Regular Earnings Total,Overtime Earnings Total"


def write(root, client, pay_date, name, lines):
    folder = root / f"client_id={client}" / f"pay_date={pay_date}"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n")


def time_file(rows, header=TIME_HEADER):
    return [f"title {i}" for i in range(7)] + [header] + rows


@pytest.fixture
def exports(tmp_path):
    rows = [
        'AAA0000001,"Doe, Ann",2024-01-08 08:00:00,2024-01-08 12:00:00,ok,2024-01-09 00:00:00,',
        " AAA0000001 ,\"Doe, Ann\",2024-01-08 12:30:00,2024-01-08 16:30:00,ok,,late",
        "AAA0000001,\"Doe, Ann\",,2024-01-08 16:30:00,ok,,",
        "",
    ]
    write(tmp_path, "c1", PAY_DATE, "time.csv", time_file(rows))
    wfm = [f"title {i}" for i in range(5)] + [
        WFM_HEADER,
        "Bob,BBB,000123,2024-01-09 08:00:00,2024-01-09 12:00:00,ok,,,x",
        "Bob,BBB,000123,2024-01-10 08:00:00,2024-01-10 12:00:00,ok,,Vacation,x",
        "testee,BBB,000124,2024-01-10 08:00:00,2024-01-10 12:00:00,ok,,,x",
    ]
    write(tmp_path, "c2", PAY_DATE, "wfm.csv", wfm)
    return tmp_path


def test_mixed_systems(spark, exports):
    df, intake = read_punches(spark, str(exports))
    got = [tuple(r) for r in df.orderBy("client_id", "seq").select("client_id", "id", "location", "employee", "in_punch").collect()]
    assert got == [
        ("c1", "AAA0000001", "AAA", "Doe, Ann", dt.datetime(2024, 1, 8, 8)),
        ("c1", "AAA0000001", " AA", "Doe, Ann", dt.datetime(2024, 1, 8, 12, 30)),
        ("c2", "BBB0000123", "BBB", "Bob", dt.datetime(2024, 1, 9, 8)),
    ]
    assert set(intake.frames) == {"Time and Attendance", "Workforce Manager"}
    assert intake.unrecognized.count() == 0
    assert dict(df.dtypes)["in_punch"] == "timestamp_ntz" and dict(df.dtypes)["pay_date"] == "date"


def test_unrecognised_files(spark, exports):
    write(exports, "c3", PAY_DATE, "odd.csv", ["a,b", "1,2"])
    with pytest.raises(UnrecognizedSystem) as e:
        read_punches(spark, str(exports))
    assert e.value.code == "TA_SYSTEM_UNRECOGNIZED" and "odd.csv" in str(e.value)
    df, intake = read_punches(spark, str(exports), on_unrecognized="quarantine")
    assert df.count() == 3 and intake.unrecognized.count() == 1
    with pytest.raises(ValueError):
        read_exports(spark, str(exports), [])


def test_line_order_survives_splitting(spark, tmp_path):
    """A file cut into many splits keeps its line order in ``seq``, without repeats."""
    rows = [f"AAA{n:07d},e,2024-01-08 08:00:00,2024-01-08 09:00:00,ok,," for n in range(20000)]
    write(tmp_path, "c1", PAY_DATE, "time.csv", time_file(rows))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "131072")
    try:
        assert read_lines(spark, str(tmp_path)).rdd.getNumPartitions() > 4
        df, _ = read_punches(spark, str(tmp_path))
        ids = [r["id"] for r in df.orderBy("seq").select("id").collect()]
        assert ids == [f"AAA{n:07d}" for n in range(20000)]
        assert df.select("seq").distinct().count() == 20000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("split, opening", [("700", "4194304"), ("20k", "4194304"), ("1m", "1")])
def test_tiny_splits_lose_no_line(spark, tmp_path, split, opening):
    rows = [f"AAA{n:07d},e,2024-01-08 08:00:00,2024-01-08 09:00:00,ok,," for n in range(600)]
    write(tmp_path, "c1", PAY_DATE, "time.csv", time_file(rows))
    write(tmp_path, "c2", PAY_DATE, "short.csv", time_file(rows[:3]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", opening)
    try:
        df, _ = read_punches(spark, str(tmp_path))
        got = df.orderBy("client_id", "seq").select("client_id", "id", "seq").collect()
        wanted = [("c1", f"AAA{n:07d}") for n in range(600)] + [("c2", f"AAA{n:07d}") for n in range(3)]
        assert [(r["client_id"], r["id"]) for r in got] == wanted
        assert len({(r["client_id"], r["seq"]) for r in got}) == 603
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_waivers_hold_for_their_pay_date(spark):
    schema = "client_id string, pay_date date, file string, seq long, ID string, Check string"
    filed = [
        ("demo", PRIOR, "a", 1, "1", "x"),
        ("demo", PAY_DATE, "b", 2, "1", "x"),
        ("demo", PAY_DATE, "a", 9, "1", ""),
    ]
    runs = spark.createDataFrame([("demo", d) for d in (PRIOR, PAY_DATE)], "client_id string, pay_date date")
    df = waivers_for_runs(prepare_waivers(spark.createDataFrame(filed, schema)), runs)
    assert {r["pay_date"]: r["has_waiver"] for r in df.collect()} == {PRIOR: True, PAY_DATE: False}
    whole = prepare_waivers(spark.createDataFrame(filed[:1], schema).drop("pay_date", "file"))
    assert {r["pay_date"]: r["has_waiver"] for r in waivers_for_runs(whole, runs).collect()} == {PRIOR: True, PAY_DATE: True}


def test_daily_rows_store_the_trimmed_location(spark):
    rows = [("1", " CCC ", "08 08:00", "08 12:00")]
    df = daily_facts(punches(spark, rows), rules(spark), register_for(spark, ["1"]))
    assert [r["location"] for r in df.collect()] == ["CCC"]


def test_payroll_export(spark, tmp_path):
    rows = ["AAA,1,Doe,2024-01-26,40,0,0,800,0", "AAA,1234567,Roe,bad,10,,0,200,0"]
    write(tmp_path, "c1", PAY_DATE, "pay.csv", [f"t{i}" for i in range(5)] + [ADP_HEADER] + rows)
    df, _ = read_register(spark, str(tmp_path))
    got = df.orderBy("seq").collect()
    assert [r["IDX"] for r in got] == ["AAA0000001", "AAA01234567"]
    assert got[0]["Regular Hours"] == 40.0 and got[1]["Overtime Hours"] is None
    assert got[1]["Pay Date"] is None and got[0]["Location"] == "AAA"
    wrong = register_date_mismatches(df).collect()
    assert [(r["employees"], r["samples"][0]["on_file"]) for r in wrong] == [(1, "missing")]


def test_waiver_list(spark, tmp_path):
    write(tmp_path, "c1", PAY_DATE, "w.csv", ["ID,Check", "1,x", "2,", "1,"])
    df = read_waivers(spark, str(tmp_path))
    assert [tuple(r) for r in df.orderBy("seq").select("ID", "Check").collect()] == [("1", "x"), ("2", None), ("1", None)]


def status(spark, rows, **kw):
    pay_date = kw.pop("pay_date", PAY_DATE)
    df = check_pay_dates(punches(spark, rows, pay_date=pay_date), rules(spark), **kw)
    return df.first()


def test_pay_date_checks(spark):
    inside = [("1", "A", "08 08:00", "08 12:00")]
    assert status(spark, inside)["ok"]
    off = status(spark, inside, pay_date=dt.date(2024, 1, 25))
    assert off["error_type"] == "HARD_ERROR" and "2024-01-12" in off["message"] and "2024-01-26" in off["message"]
    late = [("1", "A", "25 08:00", "25 12:00")]
    assert status(spark, late)["error_type"] == "HARD_ERROR"
    unreadable = status(spark, [("1", "A", None, "08 12:00")])
    assert unreadable["error_type"] == "HARD_ERROR" and "In Punch" in unreadable["message"]
    mixed = inside + [("1", "A", f"{d} 08:00", f"{d} 12:00") for d in range(21, 28)]
    row = status(spark, mixed)
    assert row["error_type"] == "STRAGGLER_WARNING" and row["outliers"] == 7
    assert row["message"].endswith(", ...") and len(row["days"]) == 5 and len(row["samples"]) == 4
    assert status(spark, mixed, ignore_warnings=True)["ok"]


def test_pay_date_that_is_no_date(spark):
    df = punches(spark, [("1", "A", "08 08:00", "08 12:00")]).selectExpr("* except (pay_date)", "'soon' pay_date")
    row = check_pay_dates(df, rules(spark)).first()
    assert row["error_type"] == "HARD_ERROR" and "soon" in row["message"]


def test_inputs_required():
    with pytest.raises(IntakeError):
        require_inputs(None, object())


# Stored tables


def register_for(spark, ids, pay_date=PAY_DATE):
    rows = [("demo", pay_date, n, i, "AAA", f"p{i}", dt.datetime.combine(pay_date, dt.time()), 5.0, 0.0) for n, i in enumerate(ids)]
    return spark.createDataFrame(
        rows,
        "client_id string, pay_date date, seq long, IDX string, Location string, `Payroll Name` string,"
        " `Pay Date` timestamp_ntz, `Overtime Hours` double, `Double Time Hours` double",
    )


PRIOR = dt.date(2024, 1, 12)


def test_two_periods(spark, tmp_path):
    store = AuditStore(spark, str(tmp_path / "store"))
    r = rules(spark)
    first = punches(spark, [("1", "CCC", f"{d:02d} 08:00", f"{d:02d} 16:00") for d in range(1, 7)], pay_date=PRIOR)
    reports = run(store, first, register_for(spark, ["1"], PRIOR), r)
    assert set(reports) >= {"short_shift", "ot_vs_wfn"}
    second = punches(spark, [("1", "CCC", f"{d:02d} 08:00", f"{d:02d} 16:00") for d in (7, 8)])
    waivers = spark.createDataFrame([("demo", "1", 1, "x")], "client_id string, ID string, seq long, Check string")
    run(store, second, register_for(spark, ["1"]), r, waivers)
    daily = store.read("daily")
    # The streak of the first six days goes on in the next period.
    streaks = {x["Attributed_Workday"].day: x["Days_Worked_In_Week"] for x in daily.collect()}
    assert streaks == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8}
    # Saving the period again changes nothing, and the other period stays.
    before = sorted(map(str, daily.drop("Last_Updated").collect()))
    again = daily_facts(second, r, register_for(spark, ["1"]), stored_carryover(store, second.select("client_id", "pay_date").distinct(), r))
    store.save_daily(again)
    assert sorted(map(str, store.read("daily").drop("Last_Updated").collect())) == before
    assert store.read("punches").count() == 8

    periods = [x["pay_date"] for x in list_periods(store, "demo").collect()]
    assert periods == [PAY_DATE, PRIOR]
    results = load_results(store, "demo", PAY_DATE)
    assert results["seven_consecutive"].select("`Trigger Date`").count() == 2
    meta = results["run"].first()
    assert (meta["ta_rows"], meta["wfn_rows"], meta["waiver_rows"]) == (2, 1, 1)
    assert meta["skipped_checks"]["flsa_check"].startswith("Missing")
    assert (meta["first_date"], meta["last_date"]) == (dt.date(2024, 1, 7), dt.date(2024, 1, 20))

    asked = query_punches(store.read("punches"), "demo", "1", "2024-01-06", "2024-01-07", ["Shift Number"])
    assert [x["In Punch"].day for x in asked.collect()] == [6, 7]
    assert asked.columns == ["ID", "In Punch", "Out Punch", "Employee", "Shift Number"]
    daily = store.read("daily")
    assert query_daily(daily, "demo", "1", "2024-01-06", "2024-01-07").count() == 2
    assert query_daily(daily, "demo", "1", "2024-01-06").count() == 8 and query_daily(None) is None

    assert store.delete_period("demo", PAY_DATE) == {"punches": 2, "daily": 2}
    assert store.delete_period("demo", PAY_DATE) == {"punches": 0, "daily": 0}
    assert store.read("punches").count() == 6
    with pytest.raises(NotFound):
        load_results(store, "demo", PAY_DATE)


def test_upsert_moves_keys_and_adds_columns(spark, tmp_path):
    store = AuditStore(spark, str(tmp_path))
    key = ["client_id", "ID"]
    old = spark.createDataFrame([("a", PRIOR, "1", 1), ("a", PRIOR, "2", 1), ("b", PRIOR, "1", 1)], "client_id string, pay_date date, ID string, v int")
    store.replace_periods(old, "t", key)
    new = spark.createDataFrame([("a", PAY_DATE, "1", 2, "n")], "client_id string, pay_date date, ID string, v int, w string")
    store.replace_periods(new, "t", key)
    got = sorted((r["client_id"], r["pay_date"], r["ID"], r["v"], r["w"]) for r in store.read("t").collect())
    assert got == [("a", PRIOR, "2", 1, None), ("a", PAY_DATE, "1", 2, "n"), ("b", PRIOR, "1", 1, None)]
    # A partition that loses its last row goes away.
    last = spark.createDataFrame([("a", PAY_DATE, "2", 3)], "client_id string, pay_date date, ID string, v int")
    store.replace_periods(last.unionByName(new.drop("w")), "t", key)
    assert sorted((r["client_id"], r["pay_date"], r["ID"]) for r in store.read("t").collect()) == [
        ("a", PAY_DATE, "1"),
        ("a", PAY_DATE, "2"),
        ("b", PRIOR, "1"),
    ]
    assert store.replace_periods(new.limit(0), "t", key) == 0


def test_repeated_punches_are_refused(spark, tmp_path):
    twice = punches(spark, [("1", "A", "08 08:00", "08 12:00"), ("1", "A", "08 08:00", "08 13:00")])
    assert duplicate_keys(twice, ["id", "in_punch"]).first()["rows"] == 2
    with pytest.raises(DuplicateKeys, match="name 1"):
        AuditStore(spark, str(tmp_path)).save_punches(twice)


def test_rows_without_id_are_kept(spark, tmp_path):
    store = AuditStore(spark, str(tmp_path))
    df = punches(spark, [("1", "A", "08 08:00", "08 12:00"), (None, "A", "08 08:00", "08 12:00")])
    run(store, df, register_for(spark, ["1"]), rules(spark))
    assert store.read("punches").count() == 2 and store.read("daily").count() == 1


def test_wrong_files_stop_the_run(spark, tmp_path):
    store = AuditStore(spark, str(tmp_path))
    df = punches(spark, [("1", "A", "08 08:00", "08 12:00"), ("1", "A", "28 08:00", "28 12:00")])
    with pytest.raises(IntakeError, match="STRAGGLER"):
        run(store, df, register_for(spark, ["1"]), rules(spark))
    with pytest.raises(IntakeError, match="pay dates differ"):
        wrong = register_for(spark, ["1"]).selectExpr("* except (`Pay Date`)", "timestamp_ntz'2024-01-12' `Pay Date`")
        run(store, df, wrong, rules(spark), ignore_warnings=True)


def test_one_bad_period_leaves_the_others(spark, tmp_path):
    store = AuditStore(spark, str(tmp_path))
    good = punches(spark, [("1", "A", "08 08:00", "08 12:00")])
    late = punches(spark, [("1", "A", "28 08:00", "28 12:00")], pay_date=PRIOR)
    unknown = punches(spark, [("1", "A", "08 08:00", "08 12:00")], client="new")
    pays = register_for(spark, ["1"]).unionByName(register_for(spark, ["1"], PRIOR))
    batch = good.unionByName(late).unionByName(unknown)
    with pytest.raises(IntakeError):
        run(store, batch, pays, rules(spark))
    reports = run(store, batch, pays, rules(spark), on_invalid="skip")
    assert store.read("punches").count() == 1 and store.read("daily").count() == 1
    bad = {(r["client_id"], r["pay_date"]): r for r in store.read("rejected").collect()}
    assert set(bad) == {("demo", PRIOR), ("new", PAY_DATE)}
    assert {r["error_type"] for r in bad.values()} == {"HARD_ERROR"}
    assert "no register" in bad["new", PAY_DATE]["message"]
    assert [r["pay_date"] for r in reports["ot_vs_wfn"].select("pay_date").distinct().collect()] in ([], [str(PAY_DATE)])
    # Once the period is right it is audited and its entry goes.
    fixed = punches(spark, [("1", "A", "03 08:00", "03 12:00")], pay_date=PRIOR)
    run(store, fixed, register_for(spark, ["1"], PRIOR), rules(spark), on_invalid="skip")
    assert store.read("punches").count() == 2
    assert [r["client_id"] for r in store.read("rejected").collect()] == ["new"]


@pytest.mark.parametrize(
    "line, fault",
    [
        ("1,2", None),
        ("1,2,,  ,", None),
        ('"1,5",2', None),
        ('1,"say ""hi"", then go"', None),
        ('"",""', None),
        ('5" pipe,2', None),
        ('1,"2', "open quote"),
        ('"1,2', "open quote"),
        ("1,2,3", "surplus cells"),
        ('1,2,"3"', "surplus cells"),
        ("1", None),
    ],
)
def test_line_faults(spark, line, fault):
    df = spark.createDataFrame([(line,)], "value string")
    assert df.select(line_fault(F.col("value"), F.lit(2))).first()[0] == fault


def test_rejected_lines_stop_or_are_kept_apart(spark, tmp_path):
    folder = tmp_path / "client_id=a" / "pay_date=2024-01-26"
    folder.mkdir(parents=True)
    titles = "title\n" * 7
    row = "1,x,2024-01-08 08:00:00,2024-01-08 12:00:00,ok,,\n"
    broken = '2,"y,2024-01-08 08:00:00,2024-01-08 12:00:00,ok,,\n'
    head = "ID,Employee,In Punch,Out Punch,Status,Status Date,In Punch Comment\n"
    (folder / "t.csv").write_text(titles + head + row + broken)
    with pytest.raises(RejectedLines, match="open quote"):
        read_punches(spark, str(tmp_path))
    df, intake = read_punches(spark, str(tmp_path), on_rejected="keep")
    assert [r["id"] for r in df.collect()] == ["1"]
    assert [r["reason"] for r in intake.rejected.collect()] == ["open quote"]


def test_one_written_file_is_dealt_over_tasks(spark):
    """Line numbers may be negative or large; the order and the numbers stay."""
    source = spark.range(1000).selectExpr("0 as part", "id * id * 1000003 - 5 as row", "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        lines = catalog._exported("x", ["ID,Check"], "concat(id, ',x')", source)
        rows = lines.withColumn("line", catalog._line_number()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({r["block"] for r in rows}) > 2
    assert sorted(r["line"] for r in rows) == sorted([0, *[n * n * 1000003 - 4 for n in range(1000)]])
    rows.sort(key=lambda r: r["seq"])
    assert [r["line"] for r in rows] == sorted(r["line"] for r in rows)


def test_a_line_is_parsed_once(spark):
    """Filters on cells must not bring the parsing with them."""
    frame = catalog.registered()["intake_punches"](spark, "/root/testdata/sf0.001")
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("from_csv") <= 2
