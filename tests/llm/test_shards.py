"""Sharding along the curve: how often texts are read, and cells of odd values."""

import math

from pyspark.sql import functions as F

from shiftledger.llm import hilbert_shards


def test_texts_are_read_once(spark):
    """Quantiles, ranges and sorting go over rows without texts, which are written once."""
    read = spark.sparkContext.accumulator(0)

    def counted(i):
        read.add(1)
        return (i, f"text {i % 7}" * (i % 5), "en" if i % 2 else None, "s")

    docs = spark.createDataFrame(
        spark.sparkContext.range(60, numSlices=3).map(counted),
        "doc_id long, text string, lang string, source string",
    )
    rows = hilbert_shards.shard_documents(docs).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(60))
    assert read.value == 60


def test_cells_count_the_bounds_below(spark):
    values = [None, float("-inf"), -1.0, 0.0, 0.5, 1.0, 7.0, float("inf"), math.nan]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for bounds in ([], [0.5], [-1.0, 0.0, 1.0, 1.0], [math.nan, 7.0, float("-inf")]):
        plain = sum([(F.col("v") >= F.lit(b)).cast("int") for b in set(bounds)], F.lit(0))
        found = df.select(
            hilbert_shards.cell(F.col("v"), bounds).alias("cell"), F.coalesce(plain, F.lit(0)).alias("plain")
        )
        assert [r["cell"] for r in found.collect()] == [r["plain"] for r in found.collect()]
