"""Value rules shared by every operator.

Missing values are NULL. Comparisons with a missing side are false (``ne`` is true), divisions
follow IEEE signs but give NULL for 0/0, and rounding is ``rint(x * 10^d) / 10^d``.

Durations are whole microseconds (LongType) until the last step. Sums of longs do not depend on
the order in which partitions arrive, so totals are the same however Spark splits the work.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

US_PER_MINUTE = 60_000_000
US_PER_HOUR = 60 * US_PER_MINUTE
US_PER_DAY = 24 * US_PER_HOUR


def _col(x) -> Column:
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(x)


def is_true(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False))


def lt(a, b) -> Column:
    return is_true(_col(a) < _col(b))


def le(a, b) -> Column:
    return is_true(_col(a) <= _col(b))


def gt(a, b) -> Column:
    return is_true(_col(a) > _col(b))


def ge(a, b) -> Column:
    return is_true(_col(a) >= _col(b))


def eq(a, b) -> Column:
    return is_true(_col(a) == _col(b))


def ne(a, b) -> Column:
    """Unequal, counting a missing side as unequal."""
    return F.coalesce(_col(a) != _col(b), F.lit(True))


def denan(x) -> Column:
    """NaN becomes NULL. The argument appears once, so nested uses do not multiply."""
    return F.nanvl(_col(x), F.lit(None).cast("double"))


def fdiv(n, d) -> Column:
    """Double division: x/0 is signed infinity, 0/0 is NULL."""
    n, d = _col(n).cast("double"), _col(d).cast("double")
    return F.coalesce(F.try_divide(n, d), denan(n * F.when(d == 0, F.lit(float("inf")))))


def rnd(x, digits: int) -> Column:
    """Half-even rounding on the scaled double. Adding 0.0 turns -0.0 into 0.0."""
    scale = float(10**digits)
    x = denan(_col(x).cast("double"))
    return F.rint(x * F.lit(scale)) / F.lit(scale) + F.lit(0.0)


def day_us(ts: str) -> Column:
    """Microseconds since midnight of a naive timestamp column, whatever the session zone is."""
    return F.expr(_day_us(ts))


def _day_us(ts: str) -> str:
    return (
        f"hour({ts}) * {US_PER_HOUR}L + minute({ts}) * {US_PER_MINUTE}L"
        f" + cast(extract(second from {ts}) * 1000000 as bigint)"
    )


def us_between(start: str, end: str) -> Column:
    """Wall-clock microseconds between two timestamp columns."""
    days = f"datediff(cast({end} as date), cast({start} as date)) * {US_PER_DAY}L"
    return F.expr(f"{days} + ({_day_us(end)}) - ({_day_us(start)})")


def midnight(ts) -> Column:
    return _col(ts).cast("date").cast("timestamp_ntz")


def hours(us) -> Column:
    return _col(us) / F.lit(float(US_PER_HOUR))


def minutes(us) -> Column:
    return _col(us) / F.lit(float(US_PER_MINUTE))


def hours_to_us(h) -> Column:
    return F.rint(_col(h).cast("double") * F.lit(float(US_PER_HOUR))).cast("long")


def zfill(x, width: int) -> Column:
    """Left-pad with zeros; longer text is kept whole."""
    x = _col(x)
    return F.when(F.length(x) < width, F.lpad(x, width, "0")).otherwise(x)


def slice_text(x, start: int | None, end: int | None) -> Column:
    """Text from position ``start`` up to ``end``, negative positions counting from the right."""
    x = _col(x)
    size = F.length(x)

    def bound(pos, default):
        if pos is None:
            return default
        if pos < 0:
            return F.greatest(size + pos, F.lit(0))
        return F.least(F.lit(pos), size)

    lo, hi = bound(start, F.lit(0)), bound(end, size)
    return F.when(x.isNotNull(), F.substring(x, lo + 1, F.greatest(hi - lo, F.lit(0))))
