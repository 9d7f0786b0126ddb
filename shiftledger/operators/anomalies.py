"""Break credit summary: credits due per employee against credits paid."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shiftledger.functions.semantics import ne

_COUNTED = ["short_break", "did_not_break", "first_meal_break", "over_twelve"]


def break_credit_summary(facts: DataFrame) -> DataFrame:
    """Employees with any credit due or paid. An unknown paid value keeps the employee.

    Ordinary rows are already hashed by employee. Crowded employees come in chunks: each is summed where
    it lies, and only one partial row per chunk is shuffled.
    """
    order = F.struct("in_punch", "out_punch", "seq")
    known = facts.where(F.col("id").isNotNull())
    summary = known.groupBy("id", "client_id", "pay_date").agg(
        F.min_by("employee", F.when(F.col("employee").isNotNull(), order)).alias("employee"),
        # One register row per employee: the value is the same on all of its punches.
        F.max("paid_break_hours").alias("paid_break_hours"),
        *[F.sum(c).alias(c) for c in _COUNTED],
    )
    summary = summary.withColumn("due_break_hours", sum(F.col(c) for c in _COUNTED[1:]) + F.col(_COUNTED[0]))
    kept = summary.where(
        (F.col("short_break") != 0)
        | (F.col("did_not_break") != 0)
        | (F.col("first_meal_break") != 0)
        | (F.col("over_twelve") != 0)
        | ne("paid_break_hours", F.lit(0))
    )
    return kept.withColumn("variance", F.col("due_break_hours") - F.col("paid_break_hours"))
