"""Sharding along a Hilbert curve.

Several metadata dimensions are quantised by their own quantiles, each row gets its place on the
Hilbert curve through the quantised cube, rows are sorted by that place, and the sorted table is cut
into runs whose row counts differ by at most one. Rows of a shard then span a small box in every
dimension, and readers that know the boxes skip files. DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from shiftledger.llm.common import stored, tasks

BITS = 5
LAW = "rows"


def ordinal(column: str, kind: T.DataType) -> Column:
    """A number that orders like the column; of a text, its first seven bytes."""
    c = F.col(column)
    if isinstance(kind, (T.StringType, T.BinaryType)):
        lead = F.substring(c.cast("binary"), 1, 7)
        return F.conv(F.rpad(F.hex(lead), 14, "0"), 16, 10).cast("double")
    return c.cast("double")


def curve_index(axes: list[Column], bits: int) -> Column:
    """Place on the Hilbert curve of a point with ``bits`` bits per axis, as a long.

    The point is rotated and reflected level by level from the top, axis by axis; the Gray code of
    what results, read bit by bit across the axes, is the place.
    """
    n = len(axes)
    if n * bits > 62:
        raise ValueError("the curve index must fit in a long")
    levels = [1 << b for b in range(bits - 1, 0, -1)]
    # The point is one long, ``bits`` bits an axis from the lowest on: a step then makes no arrays.
    copies = sum(1 << (i * bits) for i in range(n))
    steps = [F.struct(F.lit(q).alias("q"), F.lit(i * bits).alias("at")) for q in levels for i in range(n)]
    point = reduce(
        lambda a, b: a.bitwiseOR(b), [F.shiftleft(a.cast("long"), i * bits) for i, a in enumerate(axes)]
    )

    def turn(x: Column, s: Column) -> Column:
        low = s["q"] - 1
        own = F.call_function("shiftright", x, s["at"])
        swap = x.bitwiseXOR(own).bitwiseAND(low)
        reflect = own.bitwiseAND(s["q"]) != 0
        # The first axis itself: both sides of the swap are the same bits, which stay.
        both = swap.bitwiseXOR(F.call_function("shiftleft", swap, s["at"]))
        return x.bitwiseXOR(F.when(reflect, low.cast("long")).otherwise(both))

    if steps:
        point = F.aggregate(F.array(*steps), point, turn)

    def gray(x: Column) -> Column:
        """Gray code along the axes: each xor all before it."""
        parts = [F.shiftleft(x, i * bits) for i in range(n)]
        return reduce(lambda a, b: a.bitwiseXOR(b), parts).bitwiseAND(F.lit((1 << (n * bits)) - 1))

    def finish(x: Column) -> Column:
        last = F.shiftright(x, (n - 1) * bits)
        flip = reduce(
            lambda t, q: t.bitwiseXOR(
                F.when(last.bitwiseAND(F.lit(q)) != 0, F.lit(q - 1)).otherwise(F.lit(0))
            ),
            levels,
            F.lit(0).cast("long"),
        )
        return x.bitwiseXOR(flip * copies)

    def interleave(x: Column) -> Column:
        out = F.lit(0).cast("long")
        for b in range(bits - 1, -1, -1):
            for i in range(n):
                bit = F.shiftright(x, i * bits + b).bitwiseAND(F.lit(1).cast("long"))
                out = out * 2 + bit
        return out

    for step in (gray, finish, interleave):
        point = F.element_at(F.transform(F.array(point), step), 1)
    return point


def cell(value: Column, bounds: list[float]) -> Column:
    """How many distinct bounds are at or below ``value``, by halving; 0 for NULL. NaN is above all numbers."""
    rising = sorted(set(bounds), key=lambda b: (b != b, b))

    def among(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value >= F.lit(rising[middle]), among(middle + 1, high)).otherwise(among(low, middle))

    return among(0, len(rising))


def hilbert_shards(
    rows: DataFrame,
    dimensions: list[str],
    shards: int = 8,
    bits: int = BITS,
    ties: tuple[str, ...] = (),
) -> DataFrame:
    """``rows`` with ``curve`` (long), ``shard`` (int) and ``slot`` (long, from 0 in each shard).

    A NULL dimension takes cell 0, below all values. Rows at one place of the curve are ordered by
    ``ties`` and then by where they were read, so copies of one row spread over as many partitions
    as they need and a hot value never meets in one task. Column names that start with two
    underscores are used inside; an empty table gives an empty table. With fewer rows than shards
    the last shards stay empty.
    """
    spark = rows.sparkSession
    kinds = {f.name: f.dataType for f in rows.schema}
    cells = 1 << bits
    cuts = F.array(*[F.lit(i / cells) for i in range(1, cells)])
    marks = rows.select(
        *[
            F.percentile_approx(ordinal(d, kinds[d]), cuts, F.lit(10_000)).alias(f"__{i}")
            for i, d in enumerate(dimensions)
        ]
    ).first()
    axes = []
    for i, d in enumerate(dimensions):
        axes.append(cell(ordinal(d, kinds[d]), marks[i] or []))
    placed = rows.withColumns(
        {"curve": curve_index(axes, bits), "__read": F.monotonically_increasing_id()}
    )
    order = ["curve", *ties, "__read"]
    sorted_rows = stored(
        placed.repartitionByRange(tasks(spark), *order)
        .sortWithinPartitions(*order)
        .withColumn("__at", F.monotonically_increasing_id())
        .drop("__read"),
        "hilbert",
    )
    part = F.shiftright("__at", 33)
    # One row per partition from here on.
    counts = sorted_rows.groupBy(part.alias("__part")).count()
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "__part",
        F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"),
        F.sum("count").over(Window.partitionBy()).alias("__n"),
    )
    rank = F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        sorted_rows.withColumn("__part", part)
        .join(F.broadcast(starts), "__part")
        .withColumn("__rank", rank)
        .withColumn("shard", F.expr(f"cast(__rank * {shards} div __n as int)"))
        .withColumn("slot", F.expr(f"__rank - (shard * __n + {shards - 1}) div {shards}"))
        .drop("__part", "__start", "__n", "__rank", "__at")
    )


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and the place on the curve.

    Dimensions are language, source and size; equal texts at one place of the curve stand together.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    # Written once without the texts, as quantiles, ranges and sorting each read the rows anew.
    rows = stored(
        docs.select(
            "doc_id",
            "lang",
            "source",
            size.alias("size"),
            F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        ),
        "sizes",
    )
    placed = hilbert_shards(rows, ["lang", "source", "size"], shards, ties=("text_crc32", "doc_id"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit(LAW).alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "curve",
    )
