"""Small hand-made inputs."""

import datetime as dt

from shiftledger.config.rules import Rules
from shiftledger.sources.sample_tables import SETTINGS

PUNCH_SCHEMA = (
    "client_id string, pay_date date, seq long, id string, location string, employee string,"
    " in_punch timestamp_ntz, out_punch timestamp_ntz, status string, status_date timestamp_ntz"
)
PAY_DATE = dt.date(2024, 1, 26)


def at(text):
    return dt.datetime.fromisoformat(f"2024-01-{text}") if text else None


def punches(spark, rows, client="demo", pay_date=PAY_DATE):
    """rows: (id, location, in, out) with times as 'dd hh:mm' of January 2024."""
    data = [
        (client, pay_date, n, id, loc, f"name {id}", at(i), at(o), "ok", None)
        for n, (id, loc, i, o) in enumerate(rows)
    ]
    return spark.createDataFrame(data, PUNCH_SCHEMA)


def rules(spark, **changes):
    doc = {**SETTINGS["demo"], "global": {**SETTINGS["demo"]["global"], **changes}}
    return Rules.from_settings(spark, {"demo": doc})
