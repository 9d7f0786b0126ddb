"""Ordered per-group calculations with two physical forms.

Almost every audit step looks at one employee's punches in order: neighbours, running totals and
totals of a sub-group. ``WindowTimeline`` writes them as plain windows. All windows share one hash
exchange on the group key, which is the right plan while a group fits in a task.

A key that holds a large share of all rows would put that share into one task. Such keys take
``ChunkedTimeline``: rows are range-partitioned by (key, order), each range becomes a chunk, windows
run inside (key, chunk), and one small summary row per chunk carries totals and edge rows across
chunk borders. No task sees more of a key than one chunk.

``over_lanes`` runs the same function on both forms and unions the results.
"""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

HOT_ROWS_CONF = "spark.shiftledger.hotKeyRows"
CHUNK_ROWS_CONF = "spark.shiftledger.chunkRows"
HOT_ROWS_DEFAULT = 2_000_000
CHUNK_ROWS_DEFAULT = 500_000

_CHUNK = "__chunk"
_ROW = "__rid"
_QUERY_LOGGERS = ("DataFrameQueryContextLogger", "SQLQueryContextLogger")

# How the summaries of two chunks combine.
_MERGE = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
_LOCAL = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}


def _conf_int(spark: SparkSession, name: str, default: int) -> int:
    return int(spark.conf.get(name, str(default)))


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only for an unconfigured local session."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    import tempfile

    folder = tempfile.mkdtemp(prefix="shiftledger-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` under the shared folder and read it back.

    Chunk numbers must not change when a lost executor's stage is run again, and only the columns
    a later step needs are read.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/timeline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def local_frame(spark: SparkSession, rows: Sequence[tuple], schema: T.StructType) -> DataFrame:
    """A frame of driver-side rows that Spark knows the size of (no RDD scan behind it)."""
    if not rows:
        return spark.createDataFrame([], schema)
    columns = [pa.array(values, to_arrow_type(f.dataType)) for values, f in zip(zip(*rows), schema)]
    return spark.createDataFrame(pa.table(columns, names=schema.fieldNames()))


@dataclass(frozen=True)
class KeyProfile:
    """Which group keys are too large for one task. ``hot`` holds at most rows/limit keys."""

    keys: tuple[str, ...]
    hot: tuple[tuple, ...] = ()
    hot_rows: int = 0
    missing: bool = False
    schema: object = field(default=None, compare=False)

    def frame(self, spark: SparkSession) -> DataFrame:
        return local_frame(spark, self.hot, self.schema)


def profile_keys(df: DataFrame, keys: Sequence[str]) -> KeyProfile:
    """Count rows per key once and keep the keys above the limit.

    Only key columns are read and the counts are pre-aggregated before the shuffle. The outcome only
    chooses the physical form: rows without a full key are left out whatever it says.
    """
    spark = df.sparkSession
    keys = tuple(keys)
    limit = _conf_int(spark, HOT_ROWS_CONF, HOT_ROWS_DEFAULT)
    picked = df.select(*keys)
    absent = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    counts = picked.groupBy(*keys).count()
    row = counts.agg(
        F.collect_list(
            F.when(~absent & (F.col("count") > limit), F.struct(*keys, "count"))
        ).alias("hot"),
        F.coalesce(F.max(absent), F.lit(False)).alias("missing"),
    ).first()
    hot = tuple(tuple(h[k] for k in keys) for h in row["hot"])
    return KeyProfile(
        keys, hot, sum(h["count"] for h in row["hot"]), row["missing"], picked.schema
    )


def null_safe_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], nullable: Sequence[str]
) -> DataFrame:
    """Left join on ``on`` plus ``nullable`` columns, in which NULL matches NULL."""
    keys = [*on, *nullable]
    r = right.select(*[F.col(c).alias(f"__r_{c}" if c in keys else c) for c in right.columns])
    same = [left[c] == r[f"__r_{c}"] for c in on]
    same += [left[c].eqNullSafe(r[f"__r_{c}"]) for c in nullable]
    return left.join(r, reduce(lambda a, b: a & b, same), "left").drop(*[f"__r_{c}" for c in keys])


def _adjacent(cols: dict[str, tuple[str, int]]) -> None:
    """Both forms look one row away; other offsets are refused rather than answered wrongly."""
    if any(abs(offset) != 1 for _, offset in cols.values()):
        raise ValueError("neighbours are one row away: the offset is 1 or -1")


class Timeline:
    """A frame of ordered groups. Methods return a new timeline with added columns."""

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str]):
        self.df, self.keys, self.order = df, tuple(keys), tuple(order)

    def _with(self, df: DataFrame) -> "Timeline":
        out = object.__new__(type(self))
        out.__dict__.update(self.__dict__)
        out.df = df
        return out

    def add(self, **cols: Column) -> "Timeline":
        """Row-wise columns, added together."""
        return self._with(self.df.withColumns(cols))

    def lookup(self, fn: Callable[[DataFrame], DataFrame]) -> "Timeline":
        """A join that only adds columns."""
        return self._with(fn(self.df))

    def apply(self, fn: Callable[[DataFrame], DataFrame]) -> "Timeline":
        """Any row-wise step, including filters and changed columns."""
        return self._with(fn(self.df))

    def select(self, *cols: str) -> "Timeline":
        """Keep the named columns and the timeline's own."""
        own = [c for c in (_CHUNK, _ROW) if c in self.df.columns]
        return self._with(self.df.select(*cols, *own))

    def drop(self, *cols: str) -> "Timeline":
        return self._with(self.df.drop(*cols))

    def result(self) -> DataFrame:
        return self.df.drop(_CHUNK, _ROW)


class WindowTimeline(Timeline):
    """One task per group key range; plain windows."""

    def _ordered(self, by: Sequence[str] = ()):
        # A sub-group column is constant in its window; leaving it out of the order lets windows
        # with and without the sub-group share one sort.
        return Window.partitionBy(*self.keys, *by).orderBy(*[o for o in self.order if o not in by])

    def neighbours(self, **cols: tuple[str, int]) -> "Timeline":
        """name=(column, offset): the value ``offset`` rows away, negative meaning earlier."""
        _adjacent(cols)
        w = self._ordered()
        return self.add(
            **{
                name: (F.lag(c, -off) if off < 0 else F.lead(c, off)).over(w)
                for name, (c, off) in cols.items()
            }
        )

    def running(self, by: Sequence[str] = (), **cols: tuple[str, Column]) -> "Timeline":
        """name=(kind, expression): the total up to and including the row."""
        w = self._ordered(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return self.add(**{n: _LOCAL[kind](e).over(w) for n, (kind, e) in cols.items()})

    def totals(self, by: Sequence[str] = (), **cols: tuple[str, Column]) -> "Timeline":
        """name=(kind, expression): the total of the whole sub-group on each of its rows."""
        w = Window.partitionBy(*self.keys, *by)
        return self.add(**{n: _LOCAL[kind](e).over(w) for n, (kind, e) in cols.items()})

    def firsts(self, by: Sequence[str] = (), **cols: str) -> "Timeline":
        """name=column: the value on the first row of the sub-group."""
        w = self._ordered(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return self.add(**{n: F.first(c).over(w) for n, c in cols.items()})

    def rank(self, name: str, by: Sequence[str], order: Sequence[str], where: Column) -> "Timeline":
        """Position among the rows of the sub-group that satisfy ``where``, by another order."""
        flagged = self.add(__ranked=F.coalesce(where, F.lit(False)))
        w = Window.partitionBy(*self.keys, *by, "__ranked").orderBy(*order)
        df = flagged.df.withColumn(name, F.when(F.col("__ranked"), F.row_number().over(w)))
        return self._with(df.drop("__ranked"))

    def back(self, name: str, column: str, offset: Column, choices: Sequence[int]) -> "Timeline":
        """The value of ``column`` as many rows back as ``offset`` says."""
        w = self._ordered()
        value = reduce(
            lambda acc, n: acc.when(offset == n, F.lag(column, n).over(w)),
            choices,
            F.when(F.lit(False), F.col(column)),
        )
        return self.add(**{name: value})


class ChunkedTimeline(Timeline):
    """A key may span many tasks; each task holds whole chunks of it.

    ``df`` is the full plan. ``base`` is the same rows from the last written table, with the columns
    that need no join. A step summarises ``base`` per chunk and joins the summary to ``df``. When a
    step needs a column that only ``df`` has, ``df`` is written and becomes the new base: plans stay
    linear in the number of steps, and a lost executor repeats one step at most.
    """

    def __init__(self, df, keys, order):
        super().__init__(df, keys, order)
        per_chunk = _conf_int(df.sparkSession, CHUNK_ROWS_CONF, CHUNK_ROWS_DEFAULT)
        rows = materialise(df)
        parts = max(1, -(-rows.count() // per_chunk))
        ranged = rows.repartitionByRange(parts, *self.keys, *self.order)
        self.df = self.base = materialise(
            ranged.withColumn(_CHUNK, F.spark_partition_id()).withColumn(
                _ROW, F.monotonically_increasing_id()
            )
        )

    def _on_base(self, fn: Callable[[DataFrame], DataFrame], instead: DataFrame | None):
        if self.base is None:
            return None
        # A missing column is an expected answer here, not something to log.
        loggers = [logging.getLogger(n) for n in _QUERY_LOGGERS]
        before = [log.disabled for log in loggers]
        for log in loggers:
            log.disabled = True
        try:
            return fn(self.base)
        except AnalysisException:
            return instead
        finally:
            for log, state in zip(loggers, before):
                log.disabled = state

    def add(self, **cols):
        out = self._with(self.df.withColumns(cols))
        # A column that base cannot compute must not be found there under its old meaning.
        for name, expr in cols.items():
            old = None if self.base is None else self.base.drop(name)
            out.base = self._on_base(lambda b: b.withColumn(name, expr), old)
            self = out
        return out

    def lookup(self, fn):
        out = self._with(fn(self.df))
        out.base = self._on_base(fn, self.base)
        return out

    def apply(self, fn):
        out = self._with(fn(self.df))
        out.base = self._on_base(fn, None)
        return out

    def select(self, *cols):
        out = super().select(*cols)
        own = [c for c in (*cols, _CHUNK, _ROW) if self.base is not None and c in self.base.columns]
        out.base = None if self.base is None else self.base.select(*own)
        return out

    def _settle(self):
        self.df = self.base = materialise(self.df)

    def _summarise(self, fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``fn`` over base, settling first if base lacks something."""
        out = self._on_base(fn, None)
        if out is None:
            self._settle()
            out = fn(self.base)
        return out

    def _joined(self, sums: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        """Rows with their chunk's summary. Only sub-group columns can be NULL."""
        on = [*self.keys, _CHUNK]
        if not by:
            return self.df.join(sums, on, "left")
        return null_safe_join(self.df, sums, on, by)

    def _with_new(self, df: DataFrame, names) -> "Timeline":
        out = self._with(df)
        if out.base is not None:
            out.base = out.base.drop(*names)
        return out

    def _group(self, by=()):
        return [*self.keys, *by, _CHUNK]

    def _local(self, by=()):
        return Window.partitionBy(*self._group(by)).orderBy(*self.order)

    def _carry(self, by=()):
        return Window.partitionBy(*self.keys, *by).orderBy(_CHUNK)

    def neighbours(self, **cols):
        _adjacent(cols)
        names = sorted({c for c, _ in cols.values()})
        edge = F.struct(*self.order, _ROW)
        values = F.struct(*[F.col(c).alias(f"v{i}") for i, c in enumerate(names)])
        edges = self._summarise(
            lambda b: b.groupBy(*self._group()).agg(
                F.min_by(values, edge).alias("__head"), F.max_by(values, edge).alias("__tail")
            )
        )
        w = self._carry()
        edges = edges.select(
            *self._group(),
            F.lag("__tail", 1).over(w).alias("__before"),
            F.lead("__head", 1).over(w).alias("__after"),
        )
        lw = self._local()
        added = {
            "__first": F.row_number().over(lw) == 1,
            "__last": F.lead(F.lit(1), 1).over(lw).isNull(),
        }
        for n, (c, off) in cols.items():
            added[f"__near_{n}"] = (F.lag(c, 1) if off < 0 else F.lead(c, 1)).over(lw)
        df = self._joined(edges).withColumns(added)
        df = df.withColumns(
            {
                n: F.when(
                    F.col("__first" if off < 0 else "__last"),
                    F.col("__before" if off < 0 else "__after")[f"v{names.index(c)}"],
                ).otherwise(F.col(f"__near_{n}"))
                for n, (c, off) in cols.items()
            }
        )
        return self._with_new(df.drop("__before", "__after", *added), cols)

    def running(self, by=(), **cols):
        group = self._group(by)
        sums = self._summarise(
            lambda b: b.groupBy(*group).agg(
                *[_LOCAL[kind](e).alias(f"__c_{n}") for n, (kind, e) in cols.items()]
            )
        )
        prior = self._carry(by).rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.select(
            *group,
            *[_MERGE[kind](f"__c_{n}").over(prior).alias(f"__p_{n}") for n, (kind, _) in cols.items()],
        )
        w = self._local(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        df = self._joined(sums, by).withColumns(
            {f"__l_{n}": _LOCAL[k](e).over(w) for n, (k, e) in cols.items()}
        )

        def merged(n, kind):
            here, before = F.col(f"__l_{n}"), F.col(f"__p_{n}")
            if kind in ("sum", "count"):
                return F.coalesce(here + before, here, before)
            return (F.least if kind == "min" else F.greatest)(here, before)

        df = df.withColumns({n: merged(n, kind) for n, (kind, _) in cols.items()})
        scratch = [f"__{x}_{n}" for n in cols for x in "lp"]
        return self._with_new(df.drop(*scratch), cols)

    def totals(self, by=(), **cols):
        group = self._group(by)
        sums = self._summarise(
            lambda b: b.groupBy(*group).agg(
                *[_LOCAL[kind](e).alias(f"__c_{n}") for n, (kind, e) in cols.items()]
            )
        )
        w = Window.partitionBy(*self.keys, *by)
        sums = sums.select(
            *group, *[_MERGE[kind](f"__c_{n}").over(w).alias(f"__t_{n}") for n, (kind, _) in cols.items()]
        )
        df = self._joined(sums, by).withColumns({n: F.col(f"__t_{n}") for n in cols})
        return self._with_new(df.drop(*[f"__t_{n}" for n in cols]), cols)

    def firsts(self, by=(), **cols):
        group = self._group(by)
        edge = F.struct(*self.order, _ROW)
        values = F.struct(*[F.col(c).alias(n) for n, c in cols.items()])
        heads = self._summarise(
            lambda b: b.groupBy(*group).agg(F.min_by(values, edge).alias("__head"))
        )
        w = self._carry(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        heads = heads.select(*group, F.first("__head").over(w).alias("__head"))
        df = self._joined(heads, by).withColumns({n: F.col("__head")[n] for n in cols})
        return self._with_new(df.drop("__head"), cols)

    def rank(self, name, by, order, where):
        picked = self._summarise(
            lambda b: b.where(where).select(*self.keys, *by, *order, F.col(_ROW).alias("__key"))
        )
        ranked = ChunkedTimeline(picked, [*self.keys, *by], order).running(
            **{name: ("count", F.lit(1))}
        )
        right = ranked.df.select(F.col("__key").alias(_ROW), F.col(name).cast("int").alias(name))
        return self._with_new(self.df.join(right, _ROW, "left"), [name])

    def back(self, name, column, offset, choices):
        counted = self.running(__n=("count", F.lit(1)))
        counted._settle()
        left = counted.df.withColumn("__at", F.col("__n") - offset)
        right = counted.df.select(*self.keys, F.col("__n").alias("__at"), F.col(column).alias(name))
        df = left.join(right, [*self.keys, "__at"], "left").drop("__n", "__at")
        return counted._with_new(df, [name])


def is_hot(df: DataFrame, profile: KeyProfile, how: str) -> DataFrame:
    """Keep ("left_semi") or leave out ("left_anti") the rows of hot keys.

    The hot list is a local relation of at most rows/limit keys, so Spark knows its exact size when
    it picks the join.
    """
    return df.join(profile.frame(df.sparkSession), list(profile.keys), how)


def over_lanes(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    steps: Callable[[Timeline], Timeline],
    profile: KeyProfile | None = None,
    prepare: Callable[[DataFrame], DataFrame] = lambda d: d,
    cluster_first: bool = False,
    finish: Callable[[DataFrame, DataFrame | None], DataFrame] = lambda d, hot: d,
) -> DataFrame:
    """Run ``steps`` per group: windows for ordinary keys, chunks for hot keys.

    ``prepare`` runs before the timeline is built (for example a roll-up). With ``cluster_first``
    ordinary rows are hashed by key before it, so the roll-up and all windows share one exchange.
    ``finish`` is applied to the result of each lane, with the frame of hot keys in the hot one: lookups by
    key belong there, since after the union one key would be one task again.
    Rows without a full key are left to the caller.
    """
    if profile is None:
        profile = profile_keys(df, keys)
    usual = df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    if profile.hot:
        usual = is_hot(usual, profile, "left_anti")
    if cluster_first:
        usual = usual.repartition(*keys)
    out = finish(steps(WindowTimeline(prepare(usual), keys, order)).result(), None)
    if profile.hot:
        crowded = prepare(is_hot(df, profile, "left_semi"))
        done = steps(ChunkedTimeline(crowded, keys, order)).result()
        out = out.unionByName(finish(done, profile.frame(df.sparkSession)))
    return out
