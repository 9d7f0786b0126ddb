"""The rules dimension: pay-period and overtime settings per client, with location overrides.

Two frames: ``globals`` (one row per client) and ``overrides`` (one row per client and location, a
NULL where the location follows the client). ``Rules.resolve`` adds resolved columns to a frame.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from shiftledger.config import fixed_values as fv
from shiftledger.functions.timeline import local_frame

_TYPES = {
    "pay_period_length": T.IntegerType(),
    "days_bet_payroll_end_and_pay_date": T.IntegerType(),
    "workweek_start": T.StringType(),
    "pay_periods_per_year": T.IntegerType(),
    "min_wage": T.DoubleType(),
    "state_min_wage": T.DoubleType(),
    "ot_day_max": T.DoubleType(),
    "ot_week_max": T.DoubleType(),
    "dt_day_max": T.DoubleType(),
    "time_gap_for_new_shift": T.DoubleType(),
    "number_of_consec_days_before_ot": T.IntegerType(),
    "cba_consec_anyweek": T.BooleanType(),
}
NAMES = tuple(_TYPES)

GLOBAL_SCHEMA = T.StructType(
    [T.StructField("client_id", T.StringType()), T.StructField("anchor_pay_date", T.DateType())]
    + [T.StructField(n, t) for n, t in _TYPES.items()]
)
OVERRIDE_SCHEMA = T.StructType(
    [T.StructField("client_id", T.StringType()), T.StructField("location", T.StringType())]
    + [T.StructField(n, t) for n, t in _TYPES.items()]
)
# A client's settings document.
DOCUMENT_SCHEMA = T.StructType(
    [
        T.StructField("global", T.StructType([T.StructField(n, t) for n, t in _TYPES.items()])),
        T.StructField(
            "locations",
            T.MapType(
                T.StringType(), T.StructType([T.StructField(n, t) for n, t in _TYPES.items()])
            ),
        ),
    ]
)


def _typed(name: str, value):
    if value is None:
        return None
    kind = _TYPES[name]
    if isinstance(kind, T.DoubleType):
        return float(value)
    if isinstance(kind, T.IntegerType):
        return int(value)
    return bool(value) if isinstance(kind, T.BooleanType) else str(value)


@dataclass(frozen=True)
class Rules:
    globals: DataFrame
    overrides: DataFrame
    consecutive_limits: tuple[int, ...] = ()

    @staticmethod
    def from_settings(spark: SparkSession, clients: Mapping[str, Mapping]) -> "Rules":
        """Rules given in code: {client: {"anchor_pay_date", "global", "locations"}}."""
        glob, over, limits = [], [], set()
        for client, doc in clients.items():
            g = doc["global"]
            absent = [n for n in fv.REQUIRED_RULES if g.get(n) is None]
            if absent:
                raise ValueError(f"client {client}: missing global rules {absent}")
            merged = {**fv.RULE_DEFAULTS, "cba_consec_anyweek": False, **g}
            anchor = doc.get("anchor_pay_date")
            if isinstance(anchor, str):
                anchor = dt.date.fromisoformat(anchor)
            glob.append((client, anchor, *[_typed(n, merged.get(n)) for n in NAMES]))
            limits.add(int(g["number_of_consec_days_before_ot"]))
            for loc, own in doc.get("locations", {}).items():
                over.append((client, loc, *[_typed(n, own.get(n)) for n in NAMES]))
                if own.get("number_of_consec_days_before_ot") is not None:
                    limits.add(int(own["number_of_consec_days_before_ot"]))
        return Rules(
            local_frame(spark, glob, GLOBAL_SCHEMA),
            local_frame(spark, over, OVERRIDE_SCHEMA),
            tuple(sorted(limits)),
        )

    @staticmethod
    def read(spark: SparkSession, root: str, anchors: DataFrame) -> "Rules":
        """Read ``root/client_id=<client>/*.json`` settings; ``anchors`` is (client_id, anchor_pay_date)."""
        schema = T.StructType(
            DOCUMENT_SCHEMA.fields + [T.StructField("client_id", T.StringType())]
        )
        docs = spark.read.schema(schema).json(root, multiLine=True)
        defaults = {**fv.RULE_DEFAULTS, "cba_consec_anyweek": False}
        glob = docs.select(
            "client_id",
            *[
                F.coalesce(F.col(f"global.{n}"), F.lit(defaults.get(n)).cast(t)).alias(n)
                for n, t in _TYPES.items()
            ],
        )
        glob = glob.join(anchors, "client_id", "left").select(*GLOBAL_SCHEMA.fieldNames())
        over = docs.select("client_id", F.explode("locations").alias("location", "own")).select(
            "client_id", "location", "own.*"
        )
        unruled = " or ".join(f"{n} is null" for n in fv.REQUIRED_RULES)
        shown = [r["client_id"] for r in glob.where(unruled).select("client_id").limit(5).collect()]
        if shown:
            raise ValueError(f"clients without all required global rules: {sorted(shown)}")
        # Distinct day counts: a handful, whatever the number of clients.
        name = "number_of_consec_days_before_ot"
        used = glob.select(name).union(over.select(name)).where(F.col(name).isNotNull()).distinct()
        return Rules(glob, over, tuple(sorted(r[0] for r in used.collect())))

    def with_globals(self, df: DataFrame, **cols: str) -> DataFrame:
        """Add name=rule columns from the client's global settings."""
        side = self.globals.select("client_id", *[F.col(r).alias(n) for n, r in cols.items()])
        return df.join(side, "client_id", "left")

    def resolve(
        self,
        df: DataFrame,
        location: str = "location",
        trim: bool = False,
        exact: Mapping[str, str] | None = None,
        client_wide: Mapping[str, str] | None = None,
        **cols: str,
    ) -> DataFrame:
        """Add name=rule columns: the location's own value, else the client's.

        ``trim`` looks the location up without surrounding blanks; rules named in ``exact`` then
        still need the location as written. ``client_wide`` rules ignore locations. All of them
        come with one pass over each side of the dimension.
        """
        exact, client_wide = exact or {}, client_wide or {}
        by_place = {**cols, **exact}
        place = F.trim(location) if trim else F.col(location)
        own = self.overrides.select(
            "client_id",
            F.col("location").alias("__place"),
            *[F.col(r).alias(f"__o_{n}") for n, r in by_place.items()],
        )
        glob = self.globals.select(
            "client_id",
            *[F.col(r).alias(f"__g_{n}") for n, r in by_place.items()],
            *[F.col(r).alias(n) for n, r in client_wide.items()],
        )
        df = df.withColumn("__place", place)
        df = df.join(own, ["client_id", "__place"], "left").join(glob, "client_id", "left")
        as_written = F.col(location) == F.col("__place")

        def value(name: str) -> Column:
            o = F.col(f"__o_{name}")
            return F.coalesce(F.when(as_written, o) if name in exact else o, f"__g_{name}")

        df = df.withColumns({n: value(n) for n in by_place})
        drop = ["__place"] + [f"__{side}_{n}" for n in by_place for side in "og"]
        return df.drop(*drop)


def period_end(pay_date, days_to_pay) -> Column:
    return F.date_sub(pay_date, days_to_pay)


def period_bounds(pay_date: Column, days_to_pay: Column, length: Column) -> tuple[Column, Column]:
    """First and last work date paid on ``pay_date``."""
    return F.date_sub(pay_date, days_to_pay + length - 1), F.date_sub(pay_date, days_to_pay)


def weekday_number(name: Column) -> Column:
    """Monday = 0 ... Sunday = 6 from an English day name."""
    names = F.create_map(*[F.lit(x) for pair in fv.WEEKDAYS.items() for x in pair])
    return F.element_at(names, F.lower(F.trim(name)))
