"""What several operators share: the tables, the shared folder and hashing of byte arrays."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

CHECKPOINTS = "spark.checkpoint.dir"
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names; a local session without one gets its own."""
    folder = spark.conf.get(CHECKPOINTS, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINTS} to a folder that all executors can reach")
    folder = tempfile.mkdtemp(prefix="shared-")
    spark.conf.set(CHECKPOINTS, folder)
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared folder and read it back: the plan is cut there, a lost executor
    loses nothing, and Spark knows the size of what it reads."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python workers: 1,000 rows at once unless the session says otherwise."""
    if spark.conf.get(ARROW_ROWS) == "10000":
        spark.conf.set(ARROW_ROWS, "1000")


def tasks(spark: SparkSession) -> int:
    """Shuffle partitions of the session, which its owner sizes to the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_of_id(column: str = "doc_id") -> Column:
    """crc32 of the id as text; NULL for a missing id."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sliding(x: np.ndarray, width: int, least) -> np.ndarray:
    """Least or greatest of every ``width`` neighbours, by doubling."""
    n, y = 1, x
    while n * 2 <= width:
        y = least(y[:-n], y[n:])
        n *= 2
    return least(y[: -(width - n)], y[width - n :]) if width > n else y


class Rolling:
    """64-bit polynomial hashes of any slices of a byte array, from one running sum.

    The hash of [i, j) is (sum of (byte + 1) * B**p over it) / B**i; B is odd, so it has an inverse
    modulo 2**64 and equal slices have equal hashes wherever they stand.
    """

    BASE = 0x9E3779B97F4A7C15
    _powers = np.ones(1, np.uint64)
    _inverse = np.ones(1, np.uint64)

    @classmethod
    def _grow(cls, n: int) -> None:
        if len(cls._powers) > n:
            return
        size = 1 << max(12, int(n).bit_length() + 1)
        for name, base in (("_powers", cls.BASE), ("_inverse", pow(cls.BASE, -1, 1 << 64))):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            setattr(cls, name, np.cumprod(factors, dtype=np.uint64))

    def __init__(self, data: np.ndarray):
        n = len(data)
        self._grow(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self._powers[:n], out=self.sums[1:])

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self._inverse[start])

    def all_of_length(self, k: int) -> np.ndarray:
        """The hash at every start, in order."""
        m = len(self.sums) - k
        if m <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[k:] - self.sums[:-k]) * self._inverse[:m])
