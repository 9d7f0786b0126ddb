import math

import pytest
from pyspark.sql import functions as F

from shiftledger.functions import semantics as s


def one(spark, **values):
    schema = ", ".join(f"{k} {'double' if not isinstance(v, str) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema)


@pytest.mark.parametrize(
    "n,d,want",
    [
        (1.0, 0.0, math.inf),
        (-1.0, 0.0, -math.inf),
        (0.0, 0.0, None),
        (None, 0.0, None),
        (1.0, None, None),
        (1.0, 3.0, 1 / 3),
        (0.0, 5.0, 0.0),
    ],
)
def test_division(spark, n, d, want):
    df = spark.createDataFrame([(n, d)], "n double, d double")
    assert df.select(s.fdiv("n", "d")).first()[0] == want


@pytest.mark.parametrize(
    "x,digits,want",
    [(1.015, 2, 1.01), (0.125, 2, 0.12), (0.375, 2, 0.38), (2.5, 0, 2.0), (-0.001, 2, 0.0), (None, 2, None)],
)
def test_rounding(spark, x, digits, want):
    got = spark.createDataFrame([(x,)], "x double").select(s.rnd("x", digits)).first()[0]
    assert got == want
    if got == 0:
        assert math.copysign(1, got) == 1


def test_nan_never_reaches_a_comparison(spark):
    df = one(spark, x=float("nan"))
    assert df.select(s.rnd("x", 2)).first()[0] is None
    assert df.select(s.gt(s.denan("x"), F.lit(1))).first()[0] is False


def test_missing_values_in_comparisons(spark):
    df = spark.createDataFrame([(None, 1.0)], "a double, b double")
    row = df.select(s.lt("a", "b"), s.ge("a", "b"), s.eq("a", "b"), s.ne("a", "b")).first()
    assert tuple(row) == (False, False, False, True)


def test_wall_clock_ignores_daylight_saving(spark):
    """The test session runs in Los Angeles: the night of 2024-03-10 still has its clock hours."""
    df = spark.sql(
        "select timestamp_ntz'2024-03-10 01:00:00' a, timestamp_ntz'2024-03-10 02:30:00' b,"
        " timestamp_ntz'2024-03-11 04:00:00.5' c"
    )
    row = df.select(s.us_between("a", "b"), s.us_between("a", "c"), s.us_between("c", "a")).first()
    assert row[0] == 90 * s.US_PER_MINUTE
    assert row[1] == 27 * s.US_PER_HOUR + 500_000 and row[2] == -row[1]


@pytest.mark.parametrize(
    "text,start,end", [("ABCDEF", 0, 3), ("ABCDEF", -4, None), ("ABCDEF", 2, -2), ("AB", 0, 3), ("", 0, 3), ("ABC", 3, 1)]
)
def test_slices(spark, text, start, end):
    df = one(spark, x=text)
    assert df.select(s.slice_text("x", start, end)).first()[0] == text[start:end]


def test_zero_fill_keeps_long_text(spark):
    df = spark.createDataFrame([("7",), ("1234567",), (None,)], "x string")
    assert [r[0] for r in df.select(s.zfill("x", 6)).collect()] == ["000007", "1234567", None]
