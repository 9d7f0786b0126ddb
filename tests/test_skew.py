"""A crowded key gives the same results in chunks as in plain windows."""

import shutil
from pathlib import Path

import duckdb
import pytest
from compare import connect, duck_bag, spark_bag
from conftest import SMALL
from pyspark.sql import functions as F

from oracles.statements import all_statements
from shiftledger.functions.timeline import ChunkedTimeline, WindowTimeline, profile_keys
from shiftledger.plans.catalog import registered

QUERIES, STATEMENTS = registered(), all_statements()


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    """The sample tables with a third of all events on one user and some events without a user."""
    folder = tmp_path_factory.mktemp("skewed")
    for f in Path(SMALL).glob("*.parquet"):
        if f.stem != "events":
            shutil.copy(f, folder / f.name)
    duckdb.execute(
        f"""copy (select event_id, ts, case when event_id % 3 = 0 then 4 when event_id % 50 = 1 then null
              else user_id end as user_id, event_type, value, props
            from read_parquet('{SMALL}/events.parquet')) to '{folder}/events.parquet' (format parquet)"""
    )
    return str(folder)


@pytest.mark.parametrize(
    "name",
    [
        "punch_helpers",
        "shift_breaks",
        "second_break",
        "stapled_punches",
        "punch_flags",
        "anomaly_rollup",
        "weekly_spillover",
        "pay_period_totals",
        "consecutive_premium",
        "carryover_streaks",
        "legacy_weekly_ot",
        "legacy_rolling_days",
        "report_ot_vs_wfn",
        "duplicate_punches",
        "waiver_lookup",
        "register_lookup",
        "split_shift_dollars",
        "report_break_credit_summary",
        "report_did_not_break_meal_waiver_check",
    ],
)
def test_hot_user(spark, crowded, skewed, name):
    columns, got = spark_bag(QUERIES[name](spark, skewed))
    expected, want = duck_bag(connect(skewed), STATEMENTS[name])
    assert columns == expected
    assert got == want


def test_profile_finds_hot_and_missing_keys(spark, crowded, skewed):
    profile = profile_keys(spark.read.parquet(f"{skewed}/events.parquet"), ["user_id"])
    assert (4,) in profile.hot and profile.missing
    assert profile.hot_rows >= 300


def test_copies_of_one_row_are_split(spark, crowded):
    """Rows equal in every order column but the last still land in several chunks."""
    rows = spark.range(300).select(
        F.lit("a").alias("k"), F.lit(1).alias("o"), F.col("id").alias("seq"), F.col("id").alias("v")
    )
    def steps(t):
        t = t.neighbours(before=("v", -1), after=("v", 1))
        t = t.running(total=("sum", F.col("v")), top=("max", F.col("v")))
        t = t.totals([], all=("sum", F.col("v"))).firsts(first="v")
        return t.back("back3", "v", F.lit(3), [3])

    plain = steps(WindowTimeline(rows, ["k"], ["o", "seq"])).result()
    chunked = ChunkedTimeline(rows, ["k"], ["o", "seq"])
    sizes = chunked.df.groupBy("__chunk").count().agg(F.max("count"), F.count("*")).first()
    assert sizes[1] > 5 and sizes[0] < 100
    cols = plain.columns
    assert sorted(map(tuple, steps(chunked).result().select(cols).collect()), key=str) == sorted(
        map(tuple, plain.collect()), key=str
    )


def test_sub_group_without_value_keeps_its_rows(spark, crowded):
    rows = spark.range(120).select(
        F.lit("a").alias("k"),
        F.col("id").alias("seq"),
        F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"),
    )
    totals = lambda t: t.totals(["g"], n=("count", F.lit(1))).running(["g"], r=("count", F.lit(1)))
    plain = totals(WindowTimeline(rows, ["k"], ["seq"])).result()
    chunked = totals(ChunkedTimeline(rows, ["k"], ["seq"])).result().select(plain.columns)
    assert plain.exceptAll(chunked).count() == 0 and chunked.count() == 120
