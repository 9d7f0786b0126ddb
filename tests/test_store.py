"""Stored tables: a job may die at any step, saves become visible together, lookups read little."""

import datetime as dt
import json
import time

import pytest
from helpers import PAY_DATE, punches, rules
from pyspark.sql import functions as F

from shiftledger.plans.audit import refresh_streaks, run
from shiftledger.sinks import files, manifest
from shiftledger.sinks.manifest import Change, Conflict, Manifest
from shiftledger.sinks.store import AuditStore
from shiftledger.sources.stored import changed_streaks, list_periods, load_results, query_daily, query_punches

PRIOR = dt.date(2024, 1, 12)
KEY = ["client_id", "ID"]
SCHEMA = "client_id string, pay_date date, ID string, v int"


class Died(BaseException):
    """Ends the job: nothing may catch it."""


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(store, table="t"):
    df = store.read(table)
    return None if df is None else sorted((r["client_id"], str(r["pay_date"]), r["ID"], r["v"]) for r in df.collect())


OLD = [("a", PRIOR, "1", 1), ("a", PRIOR, "2", 1), ("a", PAY_DATE, "3", 1), ("b", PRIOR, "1", 1)]
# Moves 1 out of the prior period, empties b's prior period and brings a new client.
NEW = [("a", PAY_DATE, "1", 2), ("a", PAY_DATE, "4", 2), ("b", PAY_DATE, "1", 2), ("c", PAY_DATE, "1", 2)]
AFTER = sorted(
    [("a", str(PRIOR), "2", 1), ("a", str(PAY_DATE), "1", 2), ("a", str(PAY_DATE), "4", 2)]
    + [("b", str(PAY_DATE), "1", 2), ("c", str(PAY_DATE), "1", 2)]
)


def steps(monkeypatch, die_before):
    """Counts the calls that touch storage; the job dies before the one with the given number."""
    seen = []

    def watch(owner, name):
        real = getattr(owner, name)

        def call(*args, **kwargs):
            seen.append(name)
            if len(seen) - 1 == die_before:
                raise Died(name)
            return real(*args, **kwargs)

        monkeypatch.setattr(owner, name, call)

    from pyspark.sql import DataFrameWriter

    watch(DataFrameWriter, "parquet")
    watch(DataFrameWriter, "save")
    watch(files, "create_new")
    watch(files, "remove")
    return seen


def test_a_save_that_dies_leaves_the_old_state_or_the_new_one(spark, tmp_path, monkeypatch):
    old = sorted((c, str(d), i, v) for c, d, i, v in OLD)
    with monkeypatch.context() as m:
        seen = steps(m, -1)
        store = AuditStore(spark, str(tmp_path / "whole"))
        store.replace_periods(frame(spark, OLD), "t", KEY)
        first = len(seen)
        store.replace_periods(frame(spark, NEW), "t", KEY)
        names = seen[first:]
    assert rows_of(store) == AFTER and names.count("create_new") == 1
    published = names.index("create_new")
    for at in range(len(names)):
        store = AuditStore(spark, str(tmp_path / f"dies-{at}"))
        store.replace_periods(frame(spark, OLD), "t", KEY)
        with monkeypatch.context() as m, pytest.raises(Died):
            steps(m, at)
            store.replace_periods(frame(spark, NEW), "t", KEY)
        fresh = AuditStore(spark, store.root)
        assert rows_of(fresh) == (old if at <= published else AFTER), names[at]
        # The save is simply repeated.
        fresh.replace_periods(frame(spark, NEW), "t", KEY)
        assert rows_of(fresh) == AFTER


def test_a_commit_file_that_is_cut_short_is_not_there(spark, tmp_path):
    store = AuditStore(spark, str(tmp_path))
    store.replace_periods(frame(spark, OLD), "t", KEY)
    before = rows_of(store)
    number = store.manifest.state().number
    for content in ("", '{"manifest": "x"', '{"manifest": "ab'):
        (tmp_path / "_manifest" / f"commit-{number + 1:020d}.json").write_text(content)
        assert rows_of(AuditStore(spark, str(tmp_path))) == before
    # Also where the file system keeps a checksum that the content does not have.
    sums = tmp_path / "_manifest" / f".commit-{number + 1:020d}.json.crc"
    sums.write_bytes((tmp_path / "_manifest" / f".commit-{number:020d}.json.crc").read_bytes())
    assert rows_of(AuditStore(spark, str(tmp_path))) == before
    # The next writer passes over it.
    store.replace_periods(frame(spark, NEW), "t", KEY)
    assert rows_of(store) == AFTER and store.manifest.state().number == number + 2


def test_writers_that_race_lose_nothing(spark, tmp_path, monkeypatch):
    store = AuditStore(spark, str(tmp_path))
    store.replace_periods(frame(spark, OLD[:1]), "t", KEY)
    real, raced = Manifest.entries, []

    def entries(self, state=None):
        out = real(self, state)
        if not raced and state is not None and inside:
            raced.append(1)
            AuditStore(spark, str(tmp_path)).replace_periods(frame(spark, [("z", PRIOR, "9", 9)]), "t", KEY)
        return out

    inside = []
    with monkeypatch.context() as m:
        m.setattr(Manifest, "entries", entries)
        with store.commit():
            store._write(frame(spark, NEW[2:3]), "t")
            inside.append(1)
    assert raced and [r[0] for r in rows_of(store)] == ["a", "b", "z"]

    with monkeypatch.context() as m:
        m.setattr(files, "create_new", lambda *a: False)
        m.setattr(Manifest, "_read", lambda self, n: manifest.State(n, "x", {}) if n > 99 else Manifest.state(self))
        m.setattr(Manifest, "state", lambda self: manifest.State())
        m.setattr(manifest.time, "sleep", lambda s: None)
        with pytest.raises(Conflict):
            store.manifest.publish([Change("t")])


def test_a_run_is_visible_as_a_whole(spark, tmp_path, monkeypatch):
    store = AuditStore(spark, str(tmp_path))
    r = rules(spark)
    first = punches(spark, [("1", "CCC", "08 08:00", "08 16:00")])
    run(store, first, register_of(spark, ["1"]), r)
    state = store.manifest.state().number
    second = punches(spark, [("1", "CCC", "08 08:00", "08 21:00"), ("2", "CCC", "09 08:00", "09 12:00")])
    with monkeypatch.context() as m, pytest.raises(Died):
        m.setattr(AuditStore, "save_runs", lambda *a: (_ for _ in ()).throw(Died()))
        run(store, second, register_of(spark, ["1", "2"]), r)
    assert store.manifest.state().number == state
    assert store.read("punches").count() == 1 and store.read("daily").first()["Hours_Worked"] == 8
    run(store, second, register_of(spark, ["1", "2"]), r)
    # One commit for facts, raw copies, reports and metadata.
    assert store.manifest.state().number == state + 1
    assert store.read("punches").count() == 2 and store.read("raw", "punches").count() == 2
    assert list_periods(store, "demo").count() == 1
    assert load_results(store, "demo", PAY_DATE)["short_shift"].count() >= 0


def register_of(spark, ids, pay_date=PAY_DATE):
    rows = [("demo", pay_date, n, i, "AAA", f"p{i}", dt.datetime.combine(pay_date, dt.time()), 5.0, 0.0) for n, i in enumerate(ids)]
    return spark.createDataFrame(
        rows,
        "client_id string, pay_date date, seq long, IDX string, Location string, `Payroll Name` string,"
        " `Pay Date` timestamp_ntz, `Overtime Hours` double, `Double Time Hours` double",
    )


def test_retiring_a_period_writes_metadata_only(spark, tmp_path, monkeypatch):
    store = AuditStore(spark, str(tmp_path))
    store.replace_periods(frame(spark, OLD), "t", KEY)
    store.replace_periods(frame(spark, OLD), "punches", KEY)
    calls = []
    real = files.remove
    monkeypatch.setattr(files, "remove", lambda s, p: calls.append(p) or real(s, p))
    assert store.delete_period("a", PRIOR) == {"punches": 2, "daily": 0}
    assert [r[:3] for r in rows_of(store)] == [("a", str(PAY_DATE), "3"), ("b", str(PRIOR), "1")]
    assert rows_of(store, "punches") == rows_of(store) and not calls


def test_periods_without_names_and_odd_clients(spark, tmp_path):
    store = AuditStore(spark, str(tmp_path))
    odd = [(None, PRIOR, "1", 1), ("a/b c+%=é", PRIOR, "1", 1), ("007", PRIOR, "1", 1)]
    store.replace_periods(frame(spark, odd), "t", KEY)
    assert {r["client_id"] for r in store.read("t").collect()} == {None, "a/b c+%=é", "007"}
    store.replace_periods(frame(spark, [("a/b c+%=é", PRIOR, "1", 5)]), "t", KEY)
    assert {(r["client_id"], r["v"]) for r in store.read("t").collect()} == {(None, 1), ("a/b c+%=é", 5), ("007", 1)}
    assert store.read("absent") is None


def test_vacuum_removes_only_what_no_period_needs(spark, tmp_path):
    store = AuditStore(spark, str(tmp_path))
    for v in (1, 2, 3):
        store.replace_periods(frame(spark, [("a", PRIOR, "1", v)]), "t", KEY)
    store.replace_periods(frame(spark, [("b", PRIOR, "1", 9)]), "t", KEY)
    (tmp_path / "_staging").mkdir(exist_ok=True)
    (tmp_path / "_staging" / "left").mkdir()
    assert store.vacuum() == []
    time.sleep(0.05)
    assert len(store.vacuum(0)) == 3
    assert rows_of(store) == [("a", str(PRIOR), "1", 3), ("b", str(PRIOR), "1", 9)]
    assert len(list((tmp_path / "t").glob("store_version=*"))) == 2


def test_old_commits_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(manifest, "KEPT_COMMITS", 2)
    store = AuditStore(spark, str(tmp_path))
    for v in range(5):
        store.replace_periods(frame(spark, [("a", PRIOR, "1", v)]), "t", KEY)
    names = sorted(p.name for p in (tmp_path / "_manifest").iterdir() if not p.name.startswith("."))
    assert len([n for n in names if n.startswith("commit-")]) == 2 and len(names) == 4
    assert rows_of(store) == [("a", str(PRIOR), "1", 4)]


def test_a_table_is_saved_once_in_a_commit(spark, tmp_path):
    store = AuditStore(spark, str(tmp_path))
    with pytest.raises(ValueError, match="twice"), store.commit():
        for _ in range(2):
            store.replace_periods(frame(spark, OLD), "t", KEY)
    assert store.read("t") is None


# Lookups of one employee


def scanned(df):
    """Rows that the file scans of a plan that has run have given."""
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.executedPlan()
    text, total, stack = [], 0, [plan]
    while stack:
        node = stack.pop()
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            stack.append(node.plan())
            continue
        if node.nodeName().startswith("Scan parquet"):
            text.append(node.toString())
            if "In Punch" in node.toString() or "Attributed_Workday" in node.toString():
                total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        stack += [children.apply(i) for i in range(children.size())]
    return total, " ".join(text)


def test_one_employee_is_read_from_few_row_groups(spark, tmp_path):
    store = AuditStore(spark, str(tmp_path))
    rows = spark.range(40_000).selectExpr(
        "'demo' as client_id",
        "date'2024-01-26' as pay_date",
        "concat('E', lpad(cast(id % 2000 as string), 6, '0')) as ID",
        "timestamp_ntz'2024-01-08 00:00:00' + make_dt_interval(0, 0, cast(id div 2000 as int)) as `In Punch`",
        "timestamp_ntz'2024-01-08 12:00:00' as `Out Punch`",
        "'n' as Employee",
    )
    hadoop = spark._jsc.hadoopConfiguration()
    hadoop.set("parquet.block.size", "65536")
    try:
        store.replace_periods(rows, "punches", ["client_id", "ID", "In Punch"])
    finally:
        hadoop.unset("parquet.block.size")
    df = query_punches(store.read("punches"), "demo", "E000777")
    got = sorted(r["In Punch"] for r in df.collect())
    want = sorted(r["In Punch"] for r in rows.where("ID = 'E000777'").collect())
    assert got == want and len(got) == 20
    total, text = scanned(df)
    assert 0 < total < 20_000, total
    assert "EqualTo(ID,E000777)" in text and "PartitionFilters" in text
    # An ID that lies between others but does not occur is told by the filter of the file.
    none = query_punches(store.read("punches"), "demo", "E000777x")
    assert none.count() == 0 and query_daily(store.read("daily"), "demo", "E000777") is None


def test_files_carry_filters_and_ranges(spark, tmp_path):
    import pyarrow.parquet as pq

    store = AuditStore(spark, str(tmp_path))
    rows = spark.range(3000).selectExpr(
        "'demo' as client_id", "date'2024-01-26' as pay_date", "cast(uuid() as string) as ID",
        "timestamp_ntz'2024-01-08 00:00:00' as `In Punch`",
    )
    store.replace_periods(rows, "punches", ["client_id", "ID", "In Punch"])
    edges, sizes = [], 0
    for f in sorted(tmp_path.glob("punches/store_version=*/client_id=demo/pay_date=*/*.parquet")):
        ids = pq.read_table(f, columns=["ID"]).column("ID").to_pylist()
        assert ids == sorted(ids)
        edges.append((ids[0], ids[-1]))
        sizes += f.stat().st_size
    edges.sort()
    assert all(a[1] <= b[0] for a, b in zip(edges, edges[1:]))


def test_states_are_readable(spark, tmp_path):
    store = AuditStore(spark, str(tmp_path))
    store.replace_periods(frame(spark, OLD), "t", KEY)
    newest = sorted((tmp_path / "_manifest").glob("commit-*.json"))[-1]
    assert set(json.loads(newest.read_text())["schemas"]) == {"t"}
    live = store.manifest.entries().select("table", "client_id", "pay_date").distinct()
    assert live.where(F.col("table") == "t").count() == 3


# Streaks that the next period carries on from


def test_streaks_follow_when_the_prior_period_is_saved_again(spark, tmp_path):
    store, r = AuditStore(spark, str(tmp_path)), rules(spark)
    whole = [("1", "CCC", f"{d:02d} 08:00", f"{d:02d} 16:00") for d in range(1, 7)]
    pays = register_of(spark, ["1"], PRIOR)
    waivers = spark.createDataFrame([("demo", "1", 1, "x")], "client_id string, ID string, seq long, Check string")

    def prior(rows, **how):
        run(store, punches(spark, rows, pay_date=PRIOR), pays, r, **how)

    def streaks():
        daily = store.read("daily").where(F.col("pay_date") == F.lit(PAY_DATE))
        return {x["Attributed_Workday"].day: x["Days_Worked_In_Week"] for x in daily.collect()}

    prior(whole)
    later = punches(spark, [("1", "CCC", f"{d:02d} 08:00", f"{d:02d} 16:00") for d in (7, 8)])
    run(store, later, register_of(spark, ["1"]), r, waivers)
    assert streaks() == {7: 7, 8: 8} and changed_streaks(store, r).count() == 0
    # ``run`` would refresh by itself; here the two steps are seen one by one.
    prior(whole[:4], on_stale="keep")
    named = [tuple(x) for x in changed_streaks(store, r).select("pay_date", "id", "recorded", "current").collect()]
    assert named == [(PAY_DATE, "1", 6, None)] and streaks() == {7: 7, 8: 8}
    assert refresh_streaks(store, r) == 1
    assert streaks() == {7: 1, 8: 2} and changed_streaks(store, r).count() == 0
    assert load_results(store, "demo", PAY_DATE)["seven_consecutive"].count() == 0
    # The waiver list of the client still holds.
    later_rows = store.read("punches").where("pay_date = '2024-01-26'")
    assert later_rows.count() == 2 and later_rows.where("`Waiver on File?`").count() == 2
