"""Streaks and weekly spillover against plain loops on random days, in both physical forms."""

import datetime as dt
import random

import pytest
from helpers import PAY_DATE, rules

from shiftledger.operators.weekly import daily_windows

START = dt.date(2024, 1, 1)


def random_punches(spark, seed):
    rng, rows, seq = random.Random(seed), [], 0
    for e in range(12):
        place = rng.choice(["AAA", "CCC"])
        for d in range(30):
            if rng.random() < 0.25:
                continue
            # A second location on the same day gives a second daily row.
            for loc in [place] + (["ZZZ"] if rng.random() < 0.15 else []):
                start = dt.datetime.combine(START + dt.timedelta(days=d), dt.time(5)) + dt.timedelta(minutes=seq % 7)
                out = start + dt.timedelta(minutes=rng.randint(30, 1000))
                rows.append(("demo", PAY_DATE, seq, f"E{e}", loc, f"n{e}", start, out, "", None))
                seq += 1
    from helpers import PUNCH_SCHEMA

    return spark.createDataFrame(rows, PUNCH_SCHEMA)


def expected(rows):
    """rows: (id, location, day, minutes) -> {(id, location, day): (streak, regular, ot, dt, cum, spill)}"""
    out, by_id = {}, {}
    for r in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        by_id.setdefault(r[0], []).append(r)
    for days in by_id.values():
        rolling, prev, streak, weeks = days[0][1] == "CCC", None, 0, {}
        for _id, loc, day, m in days:
            if prev is None or (day - prev).days > 1:
                streak = 1
            elif not rolling and prev.weekday() != 6 and day.weekday() == 6:
                streak = 1
            else:
                streak += 1
            prev = day
            reg, ot, double = min(m, 480), max(0, min(m - 480, 240)), max(0, m - 720)
            if streak > 6:
                reg, ot, double = 0, min(m, 480), max(0, m - 480)
            week = day - dt.timedelta(days=(day.weekday() + 1) % 7)
            cum = weeks.get(week, 0) + reg
            spill = max(0, cum - 2400)
            weeks[week] = min(cum, 2400)
            hours = [round(x / 60, 4) for x in (reg - spill, ot + spill, double, cum, spill)]
            out[(_id, loc, day)] = (streak, *hours)
    return out


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("form", ["windows", "chunks"])
def test_against_loops(spark, seed, form, request):
    if form == "chunks":
        request.getfixturevalue("crowded")
        spark.conf.set("spark.shiftledger.hotKeyRows", "20")
    df = random_punches(spark, seed)
    got = daily_windows(df, rules(spark), in_period=False).collect()
    rows = [
        (r["id"], r["location"], r["in_punch"].date(), int((r["out_punch"] - r["in_punch"]).total_seconds() / 60))
        for r in df.collect()
    ]
    want = expected(rows)
    cols = ["days_worked", "regular_hours", "ot_hours", "dt_hours", "cum_regular_hours", "weekly_spillover"]
    have = {(r["id"], r["location"], r["workday"]): tuple(r[c] for c in cols) for r in got}
    assert have.keys() == want.keys()
    for key, values in want.items():
        assert have[key] == pytest.approx(values, abs=1e-9), key
