"""From export columns to the standard schema: mapping, row drops, casts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from shiftledger.config import fixed_values as fv
from shiftledger.config.systems import BLANK, Concat, Rename, Slice, SourceSystem
from shiftledger.functions.semantics import is_true, slice_text, zfill

TENANT = ["client_id", "pay_date"]


class MissingColumns(ValueError):
    """The export lacks columns that cannot be derived."""


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def strip_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def _concat_column(df: DataFrame, rule: Concat) -> Column:
    parts = []
    for name in rule.sources:
        text = F.coalesce(quoted(name).cast("string"), F.lit("")) if name in df.columns else F.lit("")
        if name in rule.whole:
            # Numbers exported as 12.0 are whole; anything else that is not a number is an error.
            text = F.trim(text).cast("double").cast("long").cast("string")
        if name in rule.widths:
            text = zfill(text, rule.widths[name])
        parts.append(text)
    return F.concat_ws(rule.delimiter, *parts)


def apply_mappings(df: DataFrame, mappings: Sequence) -> DataFrame:
    """Renames, concatenations and slices in order; a later rule sees earlier renames."""
    for rule in mappings:
        if isinstance(rule, Rename):
            if rule.source in df.columns and rule.source != rule.target:
                if rule.target in df.columns:
                    df = df.drop(rule.target)
                df = df.withColumnRenamed(rule.source, rule.target)
        elif isinstance(rule, Concat):
            df = df.withColumn(rule.target, _concat_column(df, rule))
        elif isinstance(rule, Slice) and rule.source in df.columns:
            text = quoted(rule.source).cast("string")
            df = df.withColumn(rule.target, slice_text(text, rule.start, rule.end))
    return df


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    absent = [n for n in names if n not in df.columns]
    if absent:
        raise MissingColumns(f"missing required columns: {absent}")
    return df


def drop_condition(df: DataFrame, rules: dict) -> Column:
    """True where any rule matches. Rules on unknown columns are ignored."""
    hits = [F.lit(False)]
    for name, value in rules.items():
        if name not in df.columns:
            continue
        c = quoted(name)
        if value == BLANK:
            hits.append(c.isNull() | (F.trim(c.cast("string")) == ""))
        elif isinstance(value, (list, tuple)):
            hits.append(c.isin(list(value)))
        else:
            hits.append(c == F.lit(value))
    return reduce(lambda a, b: a | b, [is_true(h) for h in hits])


def drop_rows(df: DataFrame, rules: dict) -> DataFrame:
    return df.where(~drop_condition(df, rules)) if rules else df


def keep_target(df: DataFrame, target: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    require_columns(df, target)
    return df.select(*[c for c in extra if c in df.columns], *[quoted(c) for c in target])


def keep_available(df: DataFrame, target: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    return df.select(
        *[c for c in extra if c in df.columns], *[quoted(c) for c in target if c in df.columns]
    )


def to_timestamps(df: DataFrame, *names: str) -> DataFrame:
    """Strict: text that is not a timestamp fails the job. Blank text is missing."""
    return df.withColumns({n: _blank_to_null(df, n).cast("timestamp_ntz") for n in names})


def _blank_to_null(df: DataFrame, name: str) -> Column:
    c = quoted(name)
    if dict(df.dtypes)[name] == "string":
        c = F.when(F.trim(c) != "", F.trim(c))
    return c


def normalize_punches(df: DataFrame, system: SourceSystem) -> DataFrame:
    """Standard punch frame with internal names, tenant columns and ``seq``.

    ID and Employee are trimmed once here, so punch and daily steps share one employee key.
    """
    df = apply_mappings(df, system.mappings)
    require_columns(df, fv.PUNCH_COLUMNS)
    df = drop_rows(df, system.drop_rows)
    df = keep_target(df, fv.PUNCH_COLUMNS, [*TENANT, "seq"])
    df = to_timestamps(df, "In Punch", "Out Punch", "Status Date")
    return df.select(
        *TENANT,
        "seq",
        F.trim("ID").alias("id"),
        F.col("Location").alias("location"),
        F.trim("Employee").alias("employee"),
        F.col("In Punch").alias("in_punch"),
        F.col("Out Punch").alias("out_punch"),
        F.col("Status").alias("status"),
        F.col("Status Date").alias("status_date"),
    )


def normalize_register(df: DataFrame, system: SourceSystem) -> DataFrame:
    """Standard register frame: core columns plus whatever optional columns the export has."""
    df = apply_mappings(df, system.mappings)
    require_columns(df, fv.REGISTER_CORE_COLUMNS)
    df = drop_rows(df, system.drop_rows)
    df = keep_available(df, fv.REGISTER_COLUMNS, [*TENANT, "seq"])
    typed = {}
    for name in df.columns:
        if name in (*TENANT, "seq"):
            continue
        if name in fv.REGISTER_TEXT_COLUMNS:
            typed[name] = F.trim(quoted(name).cast("string"))
        elif name == "Pay Date":
            # Unreadable pay dates are reported by the pay-date check, not by a failed cast.
            typed[name] = quoted(name).try_cast("timestamp_ntz")
        elif name in fv.REGISTER_DATE_COLUMNS:
            typed[name] = _blank_to_null(df, name).cast("timestamp_ntz")
        else:
            typed[name] = _blank_to_null(df, name).cast("double")
    return df.withColumns(typed)


def prepare_waivers(df: DataFrame) -> DataFrame:
    """One row per employee: the first row of the file decides whether there is a waiver.

    A list that carries pay dates is decided for each of them; files are taken by name.
    ``min_by`` combines map-side, so repeated IDs are never gathered as rows.
    """
    keys = [c for c in TENANT if c in df.columns]
    order = F.struct(*[c for c in ("file", "seq") if c in df.columns])
    first = df.groupBy(*keys, F.col("ID").alias("id")).agg(F.min_by("Check", order).alias("check"))
    return first.select(*keys, "id", is_true(F.lower(F.trim("check")) == "x").alias("has_waiver"))
