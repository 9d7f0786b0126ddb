"""Stored audit tables, partitioned by (client_id, pay_date).

A save wipes the pay dates it brings and then upserts by key: a key stored under another pay date
moves to the new one. Every save writes its partitions into a version folder of its own and becomes visible
by one manifest swap (see ``manifest``); several saves inside ``commit()`` become visible together. Nothing that
readers see is ever overwritten or removed, so a job may die at any step: the old state stays whole.
Deleting a period is a manifest swap too. ``vacuum`` removes folders that no period refers to any more.

Inside a period, files are sorted by employee, each file holds a range of employees, and files carry Bloom
filters on the ID: a lookup of one employee reads the row groups that may hold it.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from shiftledger.config import fixed_values as fv
from shiftledger.config.rules import Rules, period_bounds
from shiftledger.functions.timeline import local_frame
from shiftledger.operators.lookups import DuplicateKeys
from shiftledger.operators.validate import duplicate_keys, duplicate_samples
from shiftledger.plans.reports import json_safe, labelled
from shiftledger.sinks import files
from shiftledger.sinks.manifest import VERSION, Change, Manifest

TENANT = ["client_id", "pay_date"]
PUNCH_KEY = ["client_id", "ID", "In Punch"]
DAILY_KEY = ["client_id", "ID", "Location", "Attributed_Workday"]
# How rows lie within a period, for tables in which single employees are looked up.
CLUSTERED = {"punches": ["ID", "In Punch"], "daily": ["ID", "Attributed_Workday"]}


class NotFound(LookupError):
    """Nothing is stored for the client and pay date."""


def table_format(table: str) -> str:
    """Reports are kept as JSON rows, raw copies as CSV, all else as Parquet."""
    if table.startswith("reports/") or table.endswith("_json"):
        return "json"
    return "csv" if table.startswith("raw/") else "parquet"


class AuditStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.manifest = Manifest(spark, self.root)
        self._open: list[Change] | None = None
        self._scratch: list[str] = []

    def path(self, *parts: str) -> str:
        return "/".join([self.root, *parts])

    def staging(self) -> str:
        return self.path("_staging", uuid.uuid4().hex)

    @contextmanager
    def commit(self) -> Iterator[None]:
        """All saves inside become visible in one step when it ends, or none if it fails.

        Reads inside it see the state before. A table can be saved once in it.
        """
        if self._open is not None:
            yield
            return
        self._open = []
        try:
            yield
            if self._open:
                self.manifest.publish(self._open)
        finally:
            self._open = None
            for path in self._scratch:
                files.remove(self.spark, path)
            self._scratch = []

    @contextmanager
    def scratch(self) -> Iterator[Callable[[DataFrame], DataFrame]]:
        """Gives what writes a frame to a folder and reads it back; the folders go at the end."""
        paths = []

        def written(df: DataFrame) -> DataFrame:
            paths.append(self.staging())
            df.write.parquet(paths[-1])
            return self.spark.read.schema(df.schema).parquet(paths[-1])

        try:
            yield written
        finally:
            for path in paths:
                files.remove(self.spark, path)

    def _change(self, change: Change) -> None:
        with self.commit():
            if any(c.table == change.table for c in self._open):
                raise ValueError(f"{change.table} is saved twice in one commit")
            self._open.append(change)

    def read(self, *parts: str) -> DataFrame | None:
        """The live rows of a table, or None where it does not exist.

        Columns added by later saves read as NULL in older files, without opening every file's footer to
        merge schemas. Versions are a partition column: the join with the small manifest prunes dead ones.
        """
        table, state = "/".join(parts), self.manifest.state()
        schema = state.schemas.get(table)
        if schema is None:
            return None
        schema = T.StructType.fromJson(json.loads(schema)).add(VERSION, T.StringType())
        # Cells of raw copies may hold line breaks.
        multiline = table_format(table) == "csv"
        reader = self.spark.read.schema(schema).option("header", "true").option("multiLine", str(multiline).lower())
        rows = reader.format(table_format(table)).load(self.path(table))
        live = self.manifest.entries(state).where(F.col("table") == table)
        by = [c for c in TENANT if c in schema.names]
        live = live.select(F.col("version").alias("__v"), *[F.col(c).alias(f"__{c}") for c in by])
        same = F.col(VERSION) == F.col("__v")
        for c in by:
            same &= F.col(c).cast("string").eqNullSafe(F.col(f"__{c}"))
        return rows.join(live, same, "left_semi").drop(VERSION)

    def _merged_schema(self, new: T.StructType, table: str, by: Sequence[str]) -> str:
        """The table's schema with the columns of ``new``; those of earlier saves stay, a changed type is refused."""
        known = self.manifest.state().schemas.get(table)
        fields = {f.name: f.dataType for f in (T.StructType.fromJson(json.loads(known)) if known else [])}
        for f in new:
            if fields.setdefault(f.name, f.dataType) != f.dataType:
                raise TypeError(f"{table}: column {f.name} changed its type")
        data = [c for c in fields if c not in by] + list(by)
        return T.StructType([T.StructField(c, fields[c]) for c in data]).json()

    def _write(self, df: DataFrame, table: str, gone: DataFrame | None = None, by: Sequence[str] = TENANT) -> None:
        """Write ``df`` as a new version that replaces the periods it holds, and those in ``gone``."""
        schema = self._merged_schema(df.schema, table, by)
        version = uuid.uuid4().hex
        if table in CLUSTERED and set(CLUSTERED[table]) <= set(df.columns):
            # Ranges: a period's employees lie apart in its files, and a crowded one spans several.
            order = [*by, *[F.col(f"`{c}`") for c in CLUSTERED[table]]]
            df = df.repartitionByRange(*order).sortWithinPartitions(*order)
        else:
            # Rebalancing gathers a table partition in few tasks, so files stay few and large, and
            # AQE splits the tasks of a client that outgrows one.
            df = df.hint("rebalance", *by)
        writer = df.write.partitionBy(*by).format(table_format(table))
        writer = writer.option("header", "true").option("ignoreNullFields", "false")
        # Copies keep white space at the ends of cells.
        writer = writer.option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false")
        if table in CLUSTERED:
            writer = writer.option("parquet.bloom.filter.enabled#ID", "true")
            writer = writer.option("parquet.bloom.filter.adaptive.enabled", "true")
        writer.save(self.path(table, f"{VERSION}={version}"))
        self._change(Change(table, version, schema, gone))

    def _stage(self, df: DataFrame) -> DataFrame:
        """``df``, written to a folder that goes when the commit ends."""
        path = self.staging()
        self._scratch.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def replace_periods(self, new: DataFrame, table: str, key: Sequence[str]) -> int:
        """Wipe the pay dates of ``new`` and upsert it by ``key``. Returns the rows written."""
        # How many rows, and from when to when their keys reach, is gathered while they are staged.
        last = new.schema[key[-1]]
        edge = F.col(f"`{last.name}`")
        seen = Observation()
        staged = self._stage(
            new.observe(
                seen,
                F.count(F.lit(1)).alias("rows"),
                F.min(edge).cast("string").alias("low"),
                F.max(edge).cast("string").alias("high"),
            )
        )
        rows, low, high = (seen.get[c] for c in ("rows", "low", "high"))
        old = self.read(table)
        with self.commit():
            if not rows:
                return 0
            if old is None:
                self._write(staged, table)
                return rows
            # Small written tables: Spark broadcasts them and prunes the stored partitions by them.
            periods = self._stage(staged.select(*TENANT).distinct())
            clients = periods.where("client_id >= ''").select("client_id").distinct()
            # Only the batch's clients can share keys with it.
            old = old.join(clients, "client_id", "left_semi")
            near = old
            if low is not None and isinstance(last.dataType, (T.DateType, T.TimestampNTZType)):
                near = old.where(edge.between(*[F.lit(x).cast(last.dataType) for x in (low, high)]))
            keys = staged.select(*[F.col(f"`{k}`") for k in key], F.col("pay_date").alias("__to"))
            hits = near.select(*[F.col(f"`{k}`") for k in key], "pay_date").join(keys, list(key))
            touched = hits.where("pay_date <> __to").select(*TENANT).distinct()
            touched = self._stage(touched.join(periods, TENANT, "left_anti"))
            rest = old.join(touched.where("client_id >= ''"), TENANT, "left_semi")
            rest = rest.join(keys.drop("__to"), list(key), "left_anti")
            # Periods that lose their last row have no files in the new version.
            gone = touched.select(*[F.col(c).cast("string").alias(c) for c in TENANT])
            self._write(staged.unionByName(rest, allowMissingColumns=True), table, gone)
        return rows

    def locate(self, client_id: str, pay_date) -> dict[str, str]:
        """Where each table keeps a period; tables that hold nothing of it are not listed."""
        mine = self.manifest.entries().where(
            F.col("client_id").eqNullSafe(F.lit(client_id)) & (F.col("pay_date") == str(pay_date))
        )
        return {
            r["table"]: files.partition_path(
                self.spark, self.path(r["table"], f"{VERSION}={r['version']}"), client_id, pay_date
            )
            for r in mine.collect()
        }

    def save_punches(self, facts: DataFrame) -> int:
        """Store punches by (ID, In Punch). Repeated keys in the batch are refused."""
        key = ["client_id", "id", "in_punch"]
        # Shown rows are few by construction: two levels of limit.
        repeated = duplicate_keys(facts, key).limit(1).count()
        if repeated:
            rows = duplicate_samples(facts, key, [*key, "employee", "location"]).collect()
            shown = "; ".join(f"{r['employee']} ({r['id']}) In {r['in_punch']}" for r in rows)
            raise DuplicateKeys(f"punches share ID and In Punch: {shown}")
        stored = labelled(facts, fv.PUNCH_LABELS).withColumns(
            {
                "Last Updated": F.current_timestamp(),
                "Pay Date": F.col("pay_date").cast("timestamp_ntz"),
            }
        )
        stored = stored.select(*TENANT, *[F.col(f"`{c}`") for c in fv.STORED_PUNCH_COLUMNS])
        return self.replace_periods(stored, "punches", PUNCH_KEY)

    def save_daily(self, facts: DataFrame) -> int:
        """Store daily totals by (ID, Location, workday); an empty frame changes nothing."""
        stored = labelled(facts, fv.DAILY_LABELS).withColumn("Last_Updated", F.current_timestamp())
        return self.replace_periods(stored, "daily", DAILY_KEY)

    def delete_period(self, client_id: str, pay_date) -> dict[str, int]:
        """Remove a pay period everywhere in one step; rows removed from each fact table."""
        removed = {}
        for table in ("punches", "daily"):
            df = self.read(table)
            removed[table] = 0 if df is None else _of_period(df, client_id, pay_date).count()
        row = [(client_id, str(pay_date))]
        gone = local_frame(self.spark, row, T.StructType([T.StructField(c, T.StringType()) for c in TENANT]))
        with self.commit():
            for table in self.manifest.state().schemas:
                self._change(Change(table, gone=gone))
        return removed

    def save_carried(self, carried: DataFrame | None, periods: DataFrame) -> None:
        """Keep the streaks that periods were audited with: what they depend on of the period before."""
        if carried is None:
            carried = self.spark.createDataFrame([], "client_id string, pay_date date, id string, carryover long")
        carried = carried.select(*TENANT, "id", F.col("carryover").cast("long").alias("carryover"))
        self._write(carried, "carried", _as_text(periods))

    def save_raw(self, df: DataFrame, kind: str) -> None:
        """Keep the normalised intake as CSV, per pay date. Waivers are kept as JSON too.

        A waiver list without pay dates is kept per client, in tables of its own.
        """
        by = [c for c in TENANT if c in df.columns]
        if "pay_date" not in by:
            kind += "_of_client"
        with self.commit():
            if kind.startswith("waivers"):
                self._write(df, f"raw/{kind}_json", by=by)
            self._write(df, f"raw/{kind}", by=by)

    def save_rejected(self, rejected: DataFrame, audited: DataFrame) -> None:
        """Why periods were left out. A period that is audited now loses its old entry."""
        self._write(rejected, "rejected", _as_text(audited))

    def save_reports(self, reports: Mapping[str, DataFrame], runs: DataFrame) -> None:
        """Write every report as JSON rows. A report that is empty now must not keep old rows.

        ``runs``: client_id and pay_date of the periods that the reports are about.
        """
        gone = _as_text(runs)

        def write(item: tuple[str, DataFrame]) -> None:
            name, df = item
            self._write(json_safe(df), f"reports/{name}", gone)

        # The reports are independent small jobs; several at a time keep the cluster busy.
        with self.commit(), ThreadPoolExecutor(max_workers=4) as pool:
            list(pool.map(write, reports.items()))

    def save_runs(
        self, counts: Mapping[str, DataFrame | None], rules: Rules, skipped: Mapping[str, str]
    ) -> None:
        """One row per audited period: dates, row counts per table, skipped checks."""
        out = None
        for name, df in counts.items():
            if df is None:
                continue
            n = df.groupBy(*TENANT).agg(F.count(F.lit(1)).alias(name))
            out = n if out is None else out.join(n, TENANT, "full_outer")
        zeros = {n: F.coalesce(n, F.lit(0)) if counts[n] is not None else F.lit(0).cast("long") for n in counts}
        out = out.withColumns(zeros)
        out = rules.with_globals(
            out, __length="pay_period_length", __gap="days_bet_payroll_end_and_pay_date"
        )
        first, last = period_bounds(F.col("pay_date"), F.col("__gap"), F.col("__length"))
        notes = F.create_map(*[F.lit(x) for kv in skipped.items() for x in kv])
        out = out.withColumns(
            {
                "first_date": first,
                "last_date": last,
                "processed_at": F.current_timestamp(),
                "skipped_checks": notes.cast("map<string,string>"),
            }
        ).drop("__length", "__gap")
        self._write(out, "runs")


    def vacuum(self, older_than_hours: float = 24.0) -> list[str]:
        """Remove version folders that no period refers to and staging folders, if they are old enough.

        Readers that started earlier may still be reading them, and a writer may not have published yet.
        """
        live = {tuple(r) for r in self.manifest.entries().select("table", "version").distinct().collect()}
        limit = (time.time() - older_than_hours * 3600) * 1000
        removed = []
        for table in [*self.manifest.state().schemas, "_staging"]:
            path = self.path(table)
            if not files.exists(self.spark, path):
                continue
            for name, changed in files.listing(self.spark, path):
                used = (table, name.removeprefix(f"{VERSION}=")) in live
                if not used and not name.startswith("_SUCCESS") and changed <= limit:
                    files.remove(self.spark, f"{path}/{name}")
                    removed.append(f"{table}/{name}")
        return removed


def _of_period(df: DataFrame, client_id: str, pay_date) -> DataFrame:
    return df.where(
        (F.col("client_id") == client_id) & (F.col("pay_date") == F.lit(str(pay_date)).cast("date"))
    )


def _as_text(periods: DataFrame) -> DataFrame:
    return periods.select(*[F.col(c).cast("string").alias(c) for c in TENANT])
