"""Physical plans: exchanges, pushed filters, per-task limits, bounded broadcasts."""

import re

import pytest
from conftest import SMALL
from helpers import rules

from shiftledger.config import fixed_values as fv
from shiftledger.config.rules import Rules
from shiftledger.config.systems import PUNCH_SYSTEMS
from shiftledger.operators.punches import punch_windows
from shiftledger.operators.weekly import daily_windows
from shiftledger.plans.catalog import inputs
from shiftledger.plans.reports import time_card_report
from shiftledger.sources.exports import detect_systems, header_depth, read_lines
from shiftledger.sources.records import Records
from shiftledger.sources.stored import query_punches


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Sample punches as a partitioned table, the shape a deployment reads."""
    path = str(tmp_path_factory.mktemp("punches"))
    inputs(spark, SMALL).tables.punches.write.partitionBy("client_id", "pay_date").mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def exchanges(text):
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", text)


def test_punch_windows_share_one_exchange(spark, stored):
    text = plan(punch_windows(stored, rules(spark)))
    assert len(exchanges(text)) == 1 and text.count("Sort [") == 3


def test_daily_roll_up_and_windows_share_one_exchange(spark, stored):
    text = plan(daily_windows(stored, rules(spark)))
    assert len(exchanges(text)) == 1
    assert text.count("BroadcastExchange") == 2
    columns = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert "status" not in columns and "seq" not in columns


def test_no_python_in_plans(spark):
    i = inputs(spark, SMALL)
    for df in (i.facts, i.daily, i.summary, i.register):
        assert "Python" not in plan(df) and "CartesianProduct" not in plan(df)


def test_unused_windows_are_pruned(spark, stored):
    df = punch_windows(stored, rules(spark)).select("id", "seq", "shift_hours")
    assert plan(df).count("+- Window [") == 3
    assert "row_number" not in plan(df)


def test_crowded_employees_stay_in_chunks_through_lookups_and_summary(spark, crowded):
    """With broadcasts off by size, each lookup shuffles punches by employee in the ordinary lane only."""
    i = inputs(spark, SMALL)
    assert i.tables.profile.hot
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(i.facts.select("id", "paid_break_hours", "has_waiver"))
        # Two lookups in two lanes: sorted merges for ordinary keys, broadcasts for crowded ones.
        assert len(re.findall(r"BroadcastHashJoin \[id#[^\]]*client_id#", text)) >= 2
        assert "partial_sum" in plan(i.summary)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_reports_limit_before_the_shuffle(spark):
    i = inputs(spark, SMALL)
    text = plan(time_card_report("short_shift", punches=i.facts, limit=200))
    assert "WindowGroupLimit" in text and "Partial" in text
    assert "WindowGroupLimit" not in plan(time_card_report("short_shift", punches=i.facts))


def test_punch_query_prunes_and_pushes(spark, stored):
    df = stored.withColumnsRenamed({"id": "ID", "in_punch": "In Punch", "out_punch": "Out Punch", "employee": "Employee"})
    text = plan(query_punches(df, "demo", "AAA0000003", "2024-01-08", "2024-01-09", limit=300))
    assert "TakeOrderedAndProject" in text
    assert re.search(r"PartitionFilters: \[[^\]]*client_id", text)
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(id,AAA0000003\)[^\]]*in_punch", text)


def test_rule_tables_are_not_broadcast_by_hint(spark, stored):
    assert "BroadcastExchange" in plan(rules(spark).resolve(stored, gap="time_gap_for_new_shift"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastExchange" not in plan(rules(spark).resolve(stored, gap="time_gap_for_new_shift"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rules_from_documents(spark, tmp_path):
    folder = tmp_path / "client_id=acme"
    folder.mkdir()
    (folder / "config.json").write_text(
        '{"global": {"workweek_start": "Monday", "ot_day_max": 8, "ot_week_max": 40, "dt_day_max": 12,'
        ' "number_of_consec_days_before_ot": 6}, "locations": {"X": {"min_wage": 19.5, "cba_consec_anyweek": true}}}'
    )
    anchors = spark.sql("select 'acme' client_id, date'2026-01-16' anchor_pay_date")
    r = Rules.read(spark, str(tmp_path), anchors)
    df = spark.sql("select 'acme' client_id, l location from values ('X'), (' X '), ('Y'), (null) t(l)")
    names = dict(wage="min_wage", rolling="cba_consec_anyweek", length="pay_period_length")
    got = {x["location"]: (x["wage"], x["rolling"], x["length"]) for x in r.resolve(df, **names).collect()}
    default = (fv.RULE_DEFAULTS["min_wage"], False, 14)
    assert got == {"X": (19.5, True, 14), " X ": default, "Y": default, None: default}
    trimmed = r.resolve(df, trim=True, wage="min_wage", exact={"own": "min_wage"}).where("location = ' X '").first()
    assert (trimmed["wage"], trimmed["own"]) == (19.5, 17.25)
    assert r.consecutive_limits == (6,)
    with pytest.raises(ValueError, match="missing global rules"):
        Rules.from_settings(spark, {"acme": {"global": {"ot_day_max": 8}}})


def test_header_search_drops_lines_before_the_shuffle(spark, tmp_path):
    folder = tmp_path / "client_id=a" / "pay_date=2024-01-26"
    folder.mkdir(parents=True)
    (folder / "f.csv").write_text("x\n" * 100)
    early = Records(read_lines(spark, str(tmp_path)), header_depth(PUNCH_SYSTEMS)).early
    text = plan(detect_systems(early, PUNCH_SYSTEMS))
    assert "WindowGroupLimit" in text and "Partial" in text
