"""Data-quality operators. Each returns a report frame for all clients and periods at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shiftledger.config.rules import Rules, period_bounds
from shiftledger.functions.semantics import is_true

TENANT = ["client_id", "pay_date"]
NONE, HARD_ERROR, STRAGGLERS = "NONE", "HARD_ERROR", "STRAGGLER_WARNING"


class IntakeError(ValueError):
    """An intake that cannot be audited."""


def require_inputs(punches, register) -> None:
    """Punches and register are needed; waivers are optional."""
    if punches is None or register is None:
        raise IntakeError("punch and register inputs are both required")


def _first_rows(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows per group. Spark cuts each task to ``n`` rows before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def _with_window(punches: DataFrame, rules: Rules) -> DataFrame:
    df = rules.with_globals(
        punches,
        anchor="anchor_pay_date",
        length="pay_period_length",
        gap="days_bet_payroll_end_and_pay_date",
    )
    target = F.col("pay_date").cast("string").try_cast("date")
    first, last = period_bounds(F.col("target"), F.col("gap"), F.col("length"))
    df = df.withColumn("target", target).withColumns({"first_day": first, "last_day": last})
    punched = F.col("in_punch").cast("string").try_cast("timestamp_ntz").cast("date")
    df = df.withColumn("punch_day", punched)
    outside = is_true(F.col("punch_day") < F.col("first_day")) | is_true(
        F.col("punch_day") > F.col("last_day")
    )
    return df.withColumn("outside", outside)


def punch_outliers(punches: DataFrame, rules: Rules) -> DataFrame:
    """Punches outside the period their pay date covers, counted per day."""
    df = _with_window(punches, rules).where("outside")
    return df.groupBy(*TENANT, "punch_day").agg(F.count(F.lit(1)).alias("punches"))


def check_pay_dates(
    punches: DataFrame, rules: Rules, ignore_warnings: bool = False
) -> DataFrame:
    """One row per client and pay date: error type, message and the figures behind it.

    ``pay_date`` may be text. ``in_punch`` may be text; unreadable values are missing.
    """
    df = _with_window(punches, rules)
    strays = df.where("outside")
    constants = ["target", "anchor", "length", "first_day", "last_day"]
    # Days are few: everything but the samples follows from one roll-up of the file by day.
    by_day = df.groupBy(*TENANT, *constants, "punch_day", "outside").agg(
        F.count(F.lit(1)).alias("n")
    )
    per_run = by_day.groupBy(*TENANT, *constants).agg(
        F.min("punch_day").alias("file_first"),
        F.max("punch_day").alias("file_last"),
        F.sum(F.when(F.col("outside"), F.col("n")).otherwise(0)).alias("outliers"),
    )
    # Six days tell whether there are more than the five that are shown.
    days = _first_rows(by_day.where("outside"), TENANT, ["punch_day"], 6).groupBy(*TENANT).agg(
        F.sort_array(F.collect_list("punch_day")).alias("days")
    )
    sample = F.struct(
        "seq",
        F.col("employee"),
        F.col("id"),
        F.col("in_punch").cast("string").alias("in_punch"),
        F.coalesce(F.col("out_punch").cast("string"), F.lit("missing")).alias("out_punch"),
    )
    samples = _first_rows(strays, TENANT, ["seq"], 4).groupBy(*TENANT).agg(
        F.sort_array(F.collect_list(sample)).alias("samples")
    )
    out = per_run.join(days, TENANT, "left").join(samples, TENANT, "left")
    off = F.pmod(F.datediff("target", "anchor"), F.col("length"))
    bad_text, misaligned = F.col("target").isNull(), is_true(off != 0)
    # Without an anchor, a length or a gap nothing can be checked or computed for the client.
    unruled = F.col("anchor").isNull() | F.col("length").isNull() | F.col("first_day").isNull()
    unreadable = F.col("file_first").isNull()
    elsewhere = is_true(F.col("last_day") < F.col("file_first")) | is_true(
        F.col("first_day") > F.col("file_last")
    )
    stragglers = (F.col("outliers") > 0) & F.lit(not ignore_warnings)

    def text(pattern: str, *cols) -> Column:
        return F.format_string(pattern, *[F.col(c).cast("string") if isinstance(c, str) else c for c in cols])

    shown = F.concat(
        F.array_join(F.transform(F.slice("days", 1, 5), lambda d: d.cast("string")), ", "),
        F.when(F.size("days") > 5, ", ...").otherwise(""),
    )
    before = F.date_sub("target", off).cast("string")
    after = F.date_add("target", F.col("length") - off).cast("string")
    message = (
        F.when(bad_text, text("%s is not a date", "pay_date"))
        .when(unruled, text("no complete pay period rules for client %s", "client_id"))
        .when(
            misaligned,
            text("pay date %s is off the %s-day cycle; nearest: %s, %s", "target", "length", before, after),
        )
        .when(unreadable, F.lit("no readable In Punch"))
        .when(
            elsewhere,
            text(
                "expected work from %s to %s, file holds %s to %s",
                "first_day",
                "last_day",
                "file_first",
                "file_last",
            ),
        )
        .when(
            stragglers,
            text("%s punches outside %s to %s, on: %s", "outliers", "first_day", "last_day", shown),
        )
        .otherwise("")
    )
    error = (
        F.when(bad_text | unruled | misaligned | unreadable | elsewhere, HARD_ERROR)
        .when(stragglers, STRAGGLERS)
        .otherwise(NONE)
    )
    return out.select(
        *TENANT,
        (error == NONE).alias("ok"),
        error.alias("error_type"),
        message.alias("message"),
        "first_day",
        "last_day",
        "file_first",
        "file_last",
        "outliers",
        F.slice("days", 1, 5).alias("days"),
        "samples",
    )


def register_date_mismatches(register: DataFrame) -> DataFrame:
    """Per client and pay date: employees whose Pay Date is missing or differs, five of them shown."""
    on_file = F.col("`Pay Date`").cast("string").try_cast("timestamp_ntz").cast("date")
    target = F.col("pay_date").cast("string").try_cast("date")
    wrong = register.withColumn("on_file", on_file).where(
        on_file.isNull() | F.coalesce(on_file != target, F.lit(True))
    )
    per_id = wrong.groupBy(*TENANT, "IDX").agg(
        F.min("seq").alias("seq"), F.min_by("on_file", "seq").alias("on_file")
    )
    totals = per_id.groupBy(*TENANT).agg(F.count(F.lit(1)).alias("employees"))
    shown = F.struct(
        "seq", "IDX", F.coalesce(F.col("on_file").cast("string"), F.lit("missing")).alias("on_file")
    )
    samples = _first_rows(per_id, TENANT, ["seq"], 5).groupBy(*TENANT).agg(
        F.sort_array(F.collect_list(shown)).alias("samples")
    )
    return totals.join(samples, TENANT, "left")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with the number of rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def duplicate_samples(df: DataFrame, keys: list[str], show: list[str], n: int = 5) -> DataFrame:
    """A few of the rows that share a key, in key order."""
    repeated = duplicate_keys(df, keys).select(*keys)
    return df.join(repeated, keys, "left_semi").select(*show).orderBy(*keys).limit(n)


def rows_without_key(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.where(" or ".join(f"`{k}` is null" for k in keys))
