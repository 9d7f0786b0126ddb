"""Audit inputs derived from the bundled star-schema tables.

Events become punches, customers with their orders become the payroll register. Tenant columns are
data, not literals: in stored tables they come from partitions, and plans should look the same.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from shiftledger.config.rules import Rules
from shiftledger.functions.semantics import us_between
from shiftledger.functions.timeline import KeyProfile, over_lanes, profile_keys
from shiftledger.operators.normalize import prepare_waivers

CLIENT = "demo"
PAY_DATE = dt.date(2024, 1, 26)
PRIOR_PAY_DATE = dt.date(2024, 1, 12)

SETTINGS = {
    CLIENT: {
        "anchor_pay_date": "2024-01-26",
        "global": {
            "pay_period_length": 14,
            "days_bet_payroll_end_and_pay_date": 6,
            "workweek_start": "Sunday",
            "pay_periods_per_year": 26,
            "min_wage": 17.25,
            "state_min_wage": 16.50,
            "ot_day_max": 8,
            "ot_week_max": 40,
            "dt_day_max": 12,
            "number_of_consec_days_before_ot": 6,
            "time_gap_for_new_shift": 60,
            "cba_consec_anyweek": False,
        },
        "locations": {
            "BBB": {"ot_day_max": 7.5, "time_gap_for_new_shift": 90},
            "CCC": {"cba_consec_anyweek": True, "min_wage": 18.00},
        },
    }
}

_KEY_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("client_id", T.StringType()),
        T.StructField("pay_date", T.DateType()),
    ]
)


_LOCATION = "case c_custkey % 3 when 0 then 'AAA' when 1 then 'BBB' else 'CCC' end"


def _location(key: Column) -> Column:
    return F.when(key % 3 == 0, "AAA").when(key % 3 == 1, "BBB").otherwise("CCC")


def _employee_id(key: Column) -> Column:
    return F.concat(_location(key), F.lit("0"), F.lpad(key.cast("string"), 6, "0"))


def _employee_name(key: Column) -> Column:
    return F.concat(F.lit("W"), F.lpad(((key * 7919) % 100003).cast("string"), 6, "0"))


def _tenant(key: Column, pay_date: dt.date = PAY_DATE) -> dict[str, Column]:
    known = key.isNotNull()
    return {
        "client_id": F.when(known, F.lit(CLIENT)),
        "pay_date": F.when(known, F.lit(pay_date)),
    }


class SampleTables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def rules(self) -> Rules:
        return Rules.from_settings(self.spark, SETTINGS)

    @cached_property
    def user_profile(self) -> KeyProfile:
        return profile_keys(self.table("events"), ["user_id"])

    @property
    def profile(self) -> KeyProfile:
        return self.profile_for(PAY_DATE)

    def profile_for(self, pay_date: dt.date) -> KeyProfile:
        """The profile of the punch key follows from the users: one user is one employee."""
        users = self.user_profile
        hot = tuple((f"{'ABC'[u % 3] * 3}0{u:06d}", CLIENT, pay_date) for (u,) in users.hot)
        keys = ("id", "client_id", "pay_date")
        return KeyProfile(keys, hot, users.hot_rows, users.missing, _KEY_SCHEMA)

    @cached_property
    def punches(self) -> DataFrame:
        """Each event is an In Punch; the length is cut so that it never overlaps the next one."""
        ts = F.col("ts")
        seconds = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.extract(F.lit("SECOND"), ts))
        events = self.table("events").select(
            "user_id", "event_id", "ts", (ts - seconds).cast("timestamp_ntz").alias("in_punch")
        )
        df = over_lanes(
            events,
            ["user_id"],
            ["ts", "event_id"],
            lambda t: t.neighbours(next_in=("in_punch", 1)),
            self.user_profile,
        )
        gap = (us_between("in_punch", "next_in") / 60_000_000).cast("int")
        length = (30 + (F.col("event_id") * 37) % 571).cast("int")
        df = df.withColumns({"gap": gap, "length": length}).where("gap is null or gap > 0")
        rest = (F.col("gap") - 10 * (F.col("event_id") % 4)).cast("int")
        worked = (
            F.when(F.col("gap").isNull() | (F.col("length") <= F.col("gap")), F.col("length"))
            .when(rest >= 1, rest)
            .otherwise(F.col("gap"))
        )
        user = F.col("user_id")
        out = F.col("in_punch") + F.make_dt_interval(F.lit(0), F.lit(0), worked)
        return df.select(
            *[c.alias(n) for n, c in _tenant(user).items()],
            F.col("event_id").alias("seq"),
            _employee_id(user).alias("id"),
            _location(user).alias("location"),
            _employee_name(user).alias("employee"),
            "in_punch",
            out.alias("out_punch"),
            F.lit("Approved").alias("status"),
            out.cast("date").cast("timestamp_ntz").alias("status_date"),
        )

    @cached_property
    def register(self) -> DataFrame:
        """Hours are quantities summed per customer, pay follows from the customer key.

        Lines are summed per order and orders per customer before they meet the customers, so a
        customer with very many orders is combined map-side.
        """
        # Sum per order before the join: fewer rows meet the orders, and copies are combined early.
        lines = self.table("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
            *[F.expr(f"sum(l_quantity) filter (where l_returnflag = '{f}') as h_{f}") for f in "NRA"]
        )
        orders = self.table("orders").select("o_orderkey", "o_custkey")
        worked = orders.join(lines, "o_orderkey").groupBy(F.col("o_custkey").alias("c_custkey"))
        worked = worked.agg(*[F.sum(f"h_{f}").alias(f"h_{f}") for f in "NRA"])
        people = self.table("customer").select("c_custkey", "c_name", "c_mktsegment")
        k, rate, exempt = "c_custkey", "cast(15 + c_custkey % 40 as double)", "c_custkey % 11 = 0"
        reg, ot, dbl = (f"coalesce(sum(h_{f}), 0D)" for f in "NRA")

        def every(n: int, value: str) -> str:
            return f"cast(if(c_custkey % {n} = 0, {value}, 0D) as double)"

        columns = {
            "client_id": f"if({k} is not null, '{CLIENT}', null)",
            "pay_date": f"if({k} is not null, date'{PAY_DATE}', null)",
            "seq": k,
            "IDX": f"concat({_LOCATION}, '0', lpad(cast({k} as string), 6, '0'))",
            "Location": _LOCATION,
            "Payroll Name": "c_name",
            "Pay Date": f"timestamp_ntz'{PAY_DATE} 00:00:00'",
            "FLSA Status": f"if({exempt}, 'E', 'N')",
            "Position Status": f"case {k} % 13 when 0 then 'Terminated' when 1 then 'Leave' else 'Active' end",
            "Hire Date": f"cast(date_add(date'2015-01-01', cast({k} % 3000 as int)) as timestamp_ntz)",
            "Job Description": "c_mktsegment",
            "Termination Date": f"if({k} % 13 = 0, timestamp_ntz'2024-01-10 00:00:00', null)",
            "Regular Rate Paid": f"if({exempt} and {k} % 2 = 1, {rate} * 80, {rate})",
            "Regular Hours": reg,
            "Overtime Hours": ot,
            "Double Time Hours": dbl,
            "Regular Earnings Total": f"{rate} * {reg}",
            "Overtime Earnings": f"{rate} * 1.5D * {ot} + {every(7, '1.25D')}",
            "Misc FLSA Earnings": every(6, "12.5D"),
            "Bonus Earnings": every(9, f"100 + {k} % 50"),
            "Commission Earnings": every(10, "55D"),
            "Auto Gratuity Earnings": every(12, "20.25D"),
            "Restricted Service Charge Earnings": every(15, "7.5D"),
            "Bellman Service Charge Earnings": every(20, "3.75D"),
            "Double Time Earnings": f"{rate} * 2 * {dbl} + {every(5, '1.25D')}",
            "Break Credit Hours": f"cast({k} % 4 as double)",
            "Break Credit Earnings": f"{rate} * ({k} % 4) + {every(3, '0.5D')}",
            "Rest Credit Hours": f"cast({k} % 3 as double)",
            "Rest Credit Earnings": f"{rate} * ({k} % 3)",
            "Sick Pay Hours": every(8, "8D"),
            "Sick Pay Earnings": f"{every(8, '8D')} * {rate}",
            "Vacation Hours": every(16, "16D"),
            "Vacation Earnings": f"{every(16, '16D')} * {rate}",
        }
        # The columns are made in an aggregation over the joined rows, which are already hashed by
        # customer: later filters then see plain columns instead of these expressions inlined.
        df = people.join(worked, "c_custkey", "left").groupBy(*people.columns)
        return df.agg(*[F.expr(e).alias(n) for n, e in columns.items()]).drop(*people.columns)

    @cached_property
    def waiver_rows(self) -> DataFrame:
        """The waiver list as filed: a few employees appear twice."""
        k = F.col("c_custkey")
        base = self.table("customer").where(k % 4 == 0)
        check = F.when(k % 3 == 0, "x").when(k % 3 == 1, " X ").otherwise("")
        first = F.struct((k * 2).alias("seq"), check.alias("Check"))
        again = F.struct((k * 2 + 1).alias("seq"), F.lit("x").alias("Check"))
        rows = F.when(k % 8 == 0, F.array(first, again)).otherwise(F.array(first))
        return base.select(
            *[c.alias(n) for n, c in _tenant(k).items()],
            _employee_id(k).alias("ID"),
            F.inline(rows),
        )

    @cached_property
    def waivers(self) -> DataFrame:
        prepared = prepare_waivers(self.waiver_rows)
        return prepared.withColumn(
            "pay_date", F.when(F.col("id").isNotNull(), F.lit(PAY_DATE))
        )
