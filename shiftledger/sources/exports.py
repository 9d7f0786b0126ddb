"""Intake of delimited exports whose header row and system differ per file.

Files are read line by line, so one huge export is split over many tasks; ``records`` joins the lines of
records whose quoted cells hold line breaks. Files are read once: headers are found among the first
records of each file, which are marked on the way; the system that matches first wins. Line order is
kept in ``seq`` without a shuffle.

Expected layout: ``root/client_id=<client>/pay_date=<yyyy-mm-dd>/<file>``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from shiftledger.config import fixed_values as fv
from shiftledger.config.systems import PUNCH_SYSTEMS, REGISTER_SYSTEMS, SourceSystem
from shiftledger.functions.timeline import materialise
from shiftledger.operators.normalize import normalize_punches, normalize_register
from shiftledger.sources.records import (
    OPEN_QUOTE,
    ROW_BITS,
    Records,
    opens_cell,
    without_escapes,
    without_quoted_cells,
)

LINE_SCHEMA = "value string, client_id string, pay_date date"

WAIVER_LIST = SourceSystem("Waiver list", 0, ("ID", "Check"))
WAIVERS_UNRECOGNIZED = "WAIVER_LIST_UNRECOGNIZED"


class UnrecognizedSystem(ValueError):
    def __init__(self, code: str, files: Sequence[str]):
        super().__init__(f"{code}: no configured system matches {list(files)}")
        self.code = code


class RejectedLines(ValueError):
    """Lines below a recognised header that cannot be read as records."""


@dataclass(frozen=True)
class Intake:
    """Rows per recognised system, the files no system recognises, and the lines that do not parse.

    ``rejected`` has client_id, pay_date, file, seq, value and reason; its lines are in no frame.
    """

    frames: dict[str, DataFrame]
    unrecognized: DataFrame
    rejected: DataFrame


def read_lines(spark: SparkSession, root: str) -> DataFrame:
    """Lines with their file, where their split starts, and ``seq``: (split start, row) in one number.

    A decimal holds both whole, so the order is right for splits and files of any size.
    """
    lines = spark.read.schema(LINE_SCHEMA).text(root)
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    block = F.col("_metadata.file_block_start")
    return lines.select(
        "client_id",
        "pay_date",
        F.col("_metadata.file_path").alias("file"),
        block.alias("block"),
        (block.cast("decimal(20,0)") * F.lit(1 << ROW_BITS) + row).cast("decimal(38,0)").alias("seq"),
        # A byte-order mark or a carriage return is not part of the text.
        F.regexp_replace("value", "^﻿|\r$", "").alias("value"),
    )


def _header_cells(line):
    """Cells of a header line: commas inside quotes do not split, outer quotes go."""
    cells = F.split(line, r',(?=(?:[^"]*"[^"]*")*[^"]*$)')
    return F.transform(
        cells, lambda c: F.trim(F.regexp_replace(F.trim(c), '^"|"$', ""))
    )


def line_fault(line: Column, width: Column) -> Column:
    """Why a line is no record of ``width`` cells: an open quote, or surplus cells that are not blank."""
    # Lines without quotes or surplus commas are told apart without patterns.
    commas = F.length(line) - F.length(F.replace(line, F.lit(","), F.lit("")))
    suspect = F.contains(line, F.lit('"')) | (commas >= width)
    plain = without_quoted_cells(without_escapes(line))
    filled = F.regexp_replace(plain, "[, ]+$", "")
    commas = F.length(filled) - F.length(F.replace(filled, F.lit(","), F.lit("")))
    return F.when(suspect, F.when(opens_cell(plain), OPEN_QUOTE).when(commas >= width, "surplus cells"))


def header_depth(systems: Sequence[SourceSystem]) -> int:
    return max(s.header_row for s in systems) + 1


def detect_systems(records: DataFrame, systems: Sequence[SourceSystem]) -> DataFrame:
    """(file, system, header_seq, header) per file; system is NULL where nothing matches.

    ``records`` must hold the first ones of every file, as many as the deepest header row needs.
    """
    w = Window.partitionBy("file").orderBy("seq")
    # A plain bound on the row number lets every task drop later lines before the shuffle.
    heads = records.withColumn("line", F.row_number().over(w)).where(F.col("line") <= header_depth(systems))
    heads = heads.withColumns({"row": F.col("line") - 1, "header": _header_cells("value")})
    matches = None
    for rank, s in enumerate(systems):
        complete = F.size(F.array_except(F.array(*[F.lit(c) for c in s.detect]), "header")) == 0
        hit = (F.col("row") == s.header_row) & complete
        found = F.struct(
            F.lit(rank).alias("rank"),
            F.lit(s.name).alias("system"),
            F.col("seq").alias("header_seq"),
            "header",
        )
        matches = F.when(hit, found) if matches is None else matches.when(hit, found)
    # Systems that share a header row are tried in their order by the CASE; across rows the
    # smaller rank wins.
    best = heads.groupBy("file").agg(F.min_by(matches, matches["rank"]).alias("m"))
    return best.select("file", "m.system", "m.header_seq", "m.header")


def read_exports(spark: SparkSession, root: str, systems: Sequence[SourceSystem]) -> Intake:
    """All columns as text, plus client_id, pay_date, file and seq."""
    return parse_exports(read_lines(spark, root), systems)


def parse_exports(lines: DataFrame, systems: Sequence[SourceSystem]) -> Intake:
    """As ``read_exports``, from lines as ``read_lines`` gives them."""
    if not systems:
        raise ValueError("no source systems configured")
    return parse_records(Records(lines, header_depth(systems)), systems)


def parse_records(records: Records, systems: Sequence[SourceSystem]) -> Intake:
    """As ``read_exports``, from records that are read already."""
    # Written, so that Spark knows how few they are and does not shuffle the records by file.
    found = materialise(detect_systems(records.early, systems))
    known = found.where("system is not null")
    # Distinct header names per system: as many as the exports have columns.
    names = known.select("system", F.size("header").alias("n"), F.explode("header").alias("name"))
    layout = names.groupBy("system").agg(
        F.max("n").alias("width"), F.collect_set("name").alias("names")
    )
    shapes = {r["system"]: (r["width"], r["names"]) for r in layout.collect()}
    # Records below the header of a recognised file, each with its fault, if any.
    below = records.whole.where(F.trim("value") != "").join(known, "file").where("seq > header_seq")
    below = below.withColumn("reason", line_fault(F.col("value"), F.size("header")))
    rejected = below.where("reason is not null").unionByName(
        records.rejected.join(known, "file").where("seq > header_seq")
    )
    rejected = rejected.select("client_id", "pay_date", "file", "seq", "value", "reason")
    frames = {}
    for s in systems:
        if s.name not in shapes:
            continue
        width, header_names = shapes[s.name]
        rows = below.where((F.col("system") == s.name) & F.col("reason").isNull())
        shape = F.lit(", ".join(f"c{i} string" for i in range(width)))
        # Quotes inside cells are doubled; files that put a backslash before them are taken as well.
        cells = F.from_csv(F.replace("value", F.lit('\\"'), F.lit('""')), shape, {"escape": '"'})
        # A generator, so that filters on cells do not bring the parsing with them, once for each use.
        rows = rows.select("client_id", "pay_date", "file", "seq", "header", F.inline(F.array(cells)))
        rows = rows.withColumn("cells", F.array(*[F.col(f"c{i}") for i in range(width)]))

        def cell(name):
            at = F.array_position("header", name)
            return F.when(at > 0, F.try_element_at("cells", at.cast("int"))).alias(name)

        frames[s.name] = rows.select(
            "client_id", "pay_date", "file", "seq", *[cell(n) for n in sorted(header_names) if n]
        )
    return Intake(frames, found.where("system is null").select("file"), rejected)


def _complete(intake: Intake, code: str, on_unrecognized: str, on_rejected: str) -> None:
    """Raise where something would be left out, unless the caller takes it from the intake."""
    if on_rejected == "fail":
        bad = intake.rejected.select("file", "reason", "value").limit(5).collect()
        if bad:
            raise RejectedLines("; ".join(f"{r['file']}: {r['reason']} in {r['value'][:80]!r}" for r in bad))
    if on_unrecognized == "fail":
        files = [r["file"] for r in intake.unrecognized.limit(5).collect()]
        if files:
            raise UnrecognizedSystem(code, files)


def normalized(
    intake: Intake, systems: Sequence[SourceSystem], one: Callable[[DataFrame, SourceSystem], DataFrame]
) -> DataFrame | None:
    """The rows of all recognised systems in the standard schema; None if there are none."""
    out = None
    for s in systems:
        if s.name in intake.frames:
            df = one(intake.frames[s.name], s)
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def read_punches(
    spark: SparkSession,
    root: str,
    systems: Sequence[SourceSystem] = PUNCH_SYSTEMS,
    on_unrecognized: str = "fail",
    on_rejected: str = "fail",
) -> tuple[DataFrame | None, Intake]:
    intake = read_exports(spark, root, systems)
    _complete(intake, fv.PUNCH_SYSTEM_UNRECOGNIZED, on_unrecognized, on_rejected)
    return normalized(intake, systems, normalize_punches), intake


def read_register(
    spark: SparkSession,
    root: str,
    systems: Sequence[SourceSystem] = REGISTER_SYSTEMS,
    on_unrecognized: str = "fail",
    on_rejected: str = "fail",
) -> tuple[DataFrame | None, Intake]:
    intake = read_exports(spark, root, systems)
    _complete(intake, fv.REGISTER_SYSTEM_UNRECOGNIZED, on_unrecognized, on_rejected)
    return normalized(intake, systems, normalize_register), intake


def read_waiver_lists(
    spark: SparkSession, root: str, on_unrecognized: str = "fail", on_rejected: str = "fail"
) -> tuple[DataFrame | None, Intake]:
    """The waiver lists as filed, with ``seq``, and their intake; see ``prepare_waivers``."""
    intake = read_exports(spark, root, [WAIVER_LIST])
    _complete(intake, WAIVERS_UNRECOGNIZED, on_unrecognized, on_rejected)
    return intake.frames.get(WAIVER_LIST.name), intake


def read_waivers(spark: SparkSession, root: str) -> DataFrame | None:
    """The rows of ``read_waiver_lists``; what it would refuse is left out."""
    return read_waiver_lists(spark, root, "quarantine", "keep")[0]
