"""Records of delimited text whose quoted cells may hold line breaks, from files cut at any line.

Whether a line starts inside a quoted cell depends on all lines before it, which may lie in other splits. Each
split is therefore walked once under both assumptions, that it starts outside and inside a cell, in
the order in which its task reads it. What a split does to that state is one of four things: it sets
it (two ways), keeps it or flips it. The state at each split's start is a prefix computation over one small
row per split: the last split that sets the state, and the parity of the flips since. Then each line
takes the reading that holds, and only lines of records that span lines are shuffled, to be joined.

The walked lines are written once under the shared folder, so the files themselves are read once. Lines that
may hold a header are marked while walking; finding headers reads no others.

A quoted cell that is still open at a line's end goes on to the next quote. If that quote is followed by a cell
end, the lines are one record. If not, if the file ends first, or if the record would be longer than
``RECORD_CHARACTERS``, lines with quotes are rejected as open quotes and those without stand for themselves.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from shiftledger.functions.timeline import materialise, shared_folder

# The walk travels with its tasks: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Rows of one task are numbered below this by Spark.
ROW_BITS = 33
RECORD_CHARACTERS = 1 << 18
OPEN_QUOTE = "open quote"

# What a line does from inside a cell: nothing, end it, end it and open another, or break off.
_STAYS, _ENDS, _REOPENS, _BREAKS = range(4)
# The parts of a record over several lines.
_OWN, _HEAD, _TEXT, _AGAIN, _END = range(5)
_BEFORE, _NONE = -1, -2
_LINE, _EARLY, _SUMMARY = range(3)

_WALKED = (
    "client_id string, pay_date date, file string, block long, row long, value string, tag byte, "
    "kind0 byte, head0 long, kind1 byte, head1 long"
)


def without_escapes(line: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(line, '""', ""), r"\\.", "")


def without_quoted_cells(plain: Column) -> Column:
    return F.regexp_replace(plain, '(^|,)[ ]*"[^"]*"', "$1q")


def opens_cell(reduced: Column) -> Column:
    return reduced.rlike('(^|,)[ ]*"')


def quote_marks(line: Column) -> Column:
    """1 if a line that starts outside of cells leaves one open, plus twice what it does from inside one."""
    plain = without_escapes(line)
    rest = F.regexp_replace(plain, '^[^"]*"', "")
    inside = (
        F.when(~F.contains(plain, F.lit('"')), _STAYS)
        .when(~rest.rlike("^[ ]*(,|$)"), _BREAKS)
        .when(opens_cell(without_quoted_cells(F.concat(F.lit("q"), rest))), _REOPENS)
        .otherwise(_ENDS)
    )
    outside = opens_cell(without_quoted_cells(plain)).cast("int")
    return F.when(F.contains(line, F.lit('"')), outside + 2 * inside).otherwise(0).cast("int")


def _advance(mark: np.ndarray, row: np.ndarray, state: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Part of a record and first row of it for each line; and the state after them.

    The state is the row in which an open cell's record starts, ``_BEFORE`` if that is in an earlier split,
    ``_NONE`` outside of cells. One step per record that spans lines; other lines cost nothing.
    """
    n = len(mark)
    kind, head = np.zeros(n, np.int8), np.full(n, _NONE, np.int64)
    opening, quoted = np.flatnonzero(mark & 1), np.flatnonzero(mark >> 1)
    i = 0
    while i < n:
        if state == _NONE:
            at = np.searchsorted(opening, i)
            if at == len(opening):
                break
            j = opening[at]
            kind[j], head[j] = _HEAD, row[j]
            state, i = int(row[j]), j + 1
            continue
        at = np.searchsorted(quoted, i)
        j = quoted[at] if at < len(quoted) else n
        kind[i:j], head[i:j] = _TEXT, state
        i = j
        if j < n:
            does = mark[j] >> 1
            if does == _BREAKS:
                # Read again as a line of its own.
                state = _NONE
                continue
            kind[j], head[j] = _AGAIN if does == _REOPENS else _END, state
            state, i = (state if does == _REOPENS else _NONE), j + 1
    return kind, head, state


def _walk(depth: int):
    """Both readings of every line of a task's splits, and a row on the state after each split.

    A line may belong to the first ``depth`` records of a file while its split has had fewer, counting lines that
    stand for themselves, and fewer characters of other lines than so many records may have.
    """
    limit = RECORD_CHARACTERS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, last, states, own, spent = None, None, [_NONE, _BEFORE], [0, 0], [0, 0]

        def summary():
            return pa.RecordBatch.from_pydict(
                {
                    **{c: last.column(c) for c in ("client_id", "pay_date", "file", "block", "row")},
                    "value": pa.array([None], pa.string()),
                    "tag": pa.array([_SUMMARY], pa.int8()),
                    **{
                        f"{name}{h}": pa.array([value], kind)
                        for h in (0, 1)
                        for name, value, kind in (
                            ("kind", int(states[h] != _NONE), pa.int8()),
                            ("head", states[h], pa.int64()),
                        )
                    },
                }
            )

        for b in batches:
            if not b.num_rows:
                continue
            names = b.column("split").to_numpy()
            cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1), len(names)]
            for start, end in zip(cuts[:-1], cuts[1:]):
                part = b.slice(start, end - start)
                if split is not None and names[start] != split:
                    yield summary()
                if names[start] != split:
                    split, states, own, spent = names[start], [_NONE, _BEFORE], [0, 0], [0, 0]
                mark = part.column("mark").to_numpy()
                row = part.column("row").to_numpy()
                size = np.minimum(part.column("size").to_numpy(), limit)
                early = np.zeros(len(row), bool)
                columns = {}
                for h in (0, 1):
                    kind, head, states[h] = _advance(mark, row, states[h])
                    alone = kind == _OWN
                    had, used = own[h] + np.cumsum(alone), spent[h] + np.cumsum(np.where(alone, 0, size))
                    early |= (had - alone < depth) & (used - np.where(alone, 0, size) <= depth * limit)
                    own[h], spent[h] = int(had[-1]), int(used[-1])
                    columns |= {f"kind{h}": pa.array(kind), f"head{h}": pa.array(head)}
                last = part.slice(part.num_rows - 1, 1)
                yield pa.RecordBatch.from_pydict(
                    {
                        **{c: part.column(c) for c in ("client_id", "pay_date", "file", "block", "row", "value")},
                        "tag": pa.array(np.where(early, _EARLY, _LINE).astype(np.int8)),
                        **columns,
                    }
                )
        if last is not None:
            yield summary()

    return run


def _place(block: Column, row: Column) -> Column:
    """Where a line stands in its file. A decimal holds split start and row whole, whatever their size."""
    return (block.cast("decimal(20,0)") * F.lit(1 << ROW_BITS) + row).cast("decimal(38,0)")


class Records:
    """Records of a set of files: ``whole`` ones, lines in ``rejected``, and ``early`` ones for headers.

    All have client_id, pay_date, file, seq and value; ``rejected`` has the reason as well. ``seq`` of a record is
    that of its first line. Line breaks inside cells are ``\\n``, however the file writes them.
    """

    def __init__(self, lines: DataFrame, depth: int):
        """``lines``: client_id, pay_date, file, block, seq and value, the lines of a split in order and in
        one task. ``depth``: how many records from the top of a file may hold its header."""
        spark = lines.sparkSession
        path = f"{shared_folder(spark).rstrip('/')}/lines-{uuid.uuid4().hex}"
        source = lines.select(
            "client_id",
            "pay_date",
            "file",
            "block",
            (F.col("seq") - F.col("block").cast("decimal(20,0)") * F.lit(1 << ROW_BITS)).cast("long").alias("row"),
            "value",
            quote_marks(F.col("value")).alias("mark"),
            F.char_length("value").cast("long").alias("size"),
            F.xxhash64("file", "block").alias("split"),
        )
        source.mapInArrow(_walk(depth), _WALKED).write.parquet(path)
        self._walked = spark.read.schema(_WALKED).parquet(path)
        # Written, so that Spark knows how few they are and does not shuffle the lines to meet them.
        self._starts = materialise(self._states())
        self.whole, self.rejected = self._resolved(F.col("tag") < _SUMMARY)
        self.early = self._resolved(F.col("tag") == _EARLY)[0]

    def _states(self) -> DataFrame:
        """For each split whether it starts inside a cell, and where the record of that cell starts."""
        w = Window.partitionBy("file").orderBy("block")
        earlier = w.rowsBetween(Window.unboundedPreceding, -1)
        splits = self._walked.where(F.col("tag") == _SUMMARY).select("file", "block", "kind0", "head0", "kind1", "head1")
        flips = ((F.col("kind0") == 1) & (F.col("kind1") == 0)).cast("int")
        splits = splits.withColumn("flips", F.sum(flips).over(w)).withColumn("before", F.col("flips") - flips)
        sets = F.when(F.col("kind0") == F.col("kind1"), F.struct(F.col("kind0").alias("state"), "flips"))
        splits = splits.withColumn("set", F.last(sets, ignorenulls=True).over(earlier))
        since = F.col("before") - F.coalesce("set.flips", F.lit(0))
        state = F.pmod(F.coalesce(F.col("set.state").cast("int"), F.lit(0)) + since, F.lit(2))
        splits = splits.withColumn("inside", state == 1)
        left, head = (F.when(F.col("inside"), F.col(f"{c}1")).otherwise(F.col(f"{c}0")) for c in ("kind", "head"))
        own = F.when((left == 1) & (head >= 0), _place(F.col("block"), head))
        return splits.select("file", "block", "inside", F.last(own, ignorenulls=True).over(earlier).alias("carried"))

    def _resolved(self, which: Column) -> tuple[DataFrame, DataFrame]:
        """The records of some of the lines, and the lines that are none."""
        lines = self._walked.where(which).join(self._starts, ["file", "block"])
        kind, head = (F.when(F.col("inside"), F.col(f"{c}1")).otherwise(F.col(f"{c}0")) for c in ("kind", "head"))
        lines = lines.select(
            "client_id",
            "pay_date",
            "file",
            _place(F.col("block"), F.col("row")).alias("seq"),
            "value",
            kind.alias("kind"),
            F.when(head >= 0, _place(F.col("block"), head)).otherwise(F.col("carried")).alias("run"),
        )
        plain = ["client_id", "pay_date", "file", "seq", "value"]
        own = lines.where(F.col("kind") == _OWN).select(*plain)
        spread = lines.where(F.col("kind") != _OWN)
        # Sizes first: what is too long or never ends is not gathered.
        sizes = spread.groupBy("file", "run").agg(
            F.max(F.col("kind") == _END).alias("ends"), F.sum(F.char_length("value") + 1).alias("size")
        )
        good = F.col("ends") & (F.col("size") <= RECORD_CHARACTERS)
        spread = spread.join(sizes.select("file", "run", good.alias("good")), ["file", "run"])
        lines_of = F.array_sort(F.collect_list(F.struct("seq", "value")))
        joined = (
            spread.where("good")
            .groupBy("client_id", "pay_date", "file", "run")
            .agg(F.array_join(F.transform(lines_of, lambda x: x["value"]), "\n").alias("value"))
            .select("client_id", "pay_date", "file", F.col("run").alias("seq"), "value")
        )
        broken = spread.where("not good")
        alone = broken.where(F.col("kind") == _TEXT).select(*plain)
        rejected = broken.where(F.col("kind") != _TEXT).select(*plain, F.lit(OPEN_QUOTE).alias("reason"))
        return own.unionByName(joined).unionByName(alone), rejected
