"""Packed arrays that Spark shuffles: one row per batch and bucket instead of one per value.

Chunks and buckets are sized so that a worker holds little at a time. A map task turns a batch of documents into numpy arrays, deals their rows over hash buckets and emits
one binary row per bucket. Spark shuffles these rows by bucket; a reduce task joins the arrays of its
buckets again. There are two buckets for each of the session's shuffle partitions, so a bucket is half
as large as any shuffle partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shiftledger.llm.common import small_batches

CHUNK_BYTES = 4 << 20
DEALT = "bucket int, payload binary"
BUCKETS_PER_TASK = 2
NO_ID = np.iinfo(np.int64).max


def keyed(docs: DataFrame, groups: int) -> DataFrame:
    """doc_id, text, rk and t: ``rk`` stands for equal (id, text) rows, ``t`` is its group."""
    small_batches(docs.sparkSession)
    rk = F.xxhash64("doc_id", "text")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        rk.alias("rk"),
        F.pmod(rk, F.lit(groups)).cast("int").alias("t"),
    )


def data_of(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[list[dict]]:
    """Lists of rows with a ``text`` of about ``limit`` bytes together."""
    held, size = [], 0
    for batch in batches:
        names = batch.schema.names
        for at in range(0, batch.num_rows, 256):
            columns = batch.slice(at, 256).to_pydict()
            for values in zip(*columns.values()):
                row = dict(zip(names, values))
                held.append(row)
                size += len(row["text"] or "") + 64
                if size >= limit:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def pack(arrays: list[np.ndarray]) -> bytes:
    head = np.array([len(a) for a in arrays], np.int64)
    return head.tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def unpack(payload: bytes, kinds: list) -> list[np.ndarray]:
    counts = np.frombuffer(payload, np.int64, len(kinds))
    out, at = [], 8 * len(kinds)
    for kind, n in zip(kinds, counts):
        out.append(np.frombuffer(payload, kind, n, at))
        at += int(n) * np.dtype(kind).itemsize
    return out


def deal(buckets: np.ndarray, arrays: list[np.ndarray], name: str = "bucket") -> pa.RecordBatch:
    """One row per bucket that has any of the rows; rows keep their order."""
    order = np.argsort(buckets, kind="stable")
    which, starts = np.unique(buckets[order], return_index=True)
    ends = np.append(starts[1:], len(order))
    payloads = [pack([a[order[s:e]] for a in arrays]) for s, e in zip(starts, ends)]
    return pa.RecordBatch.from_pydict(
        {name: pa.array(which, pa.int32()), "payload": pa.array(payloads, pa.binary())}
    )


def gather(batches: Iterator[pa.RecordBatch], kinds: list) -> list[np.ndarray]:
    """All payloads of a task joined, array by array."""
    parts = [
        unpack(p.as_buffer(), kinds) for b in batches for p in b.column("payload")
    ]
    if not parts:
        return [np.zeros(0, k) for k in kinds]
    return [np.concatenate([p[i] for p in parts]) for i in range(len(kinds))]


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def run_starts(*columns: np.ndarray) -> np.ndarray:
    """True where a sorted row differs from the one before it in any column."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def union_length(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merged intervals of overlapping or touching ones."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    first = np.flatnonzero(new)
    return start[first], end[np.append(first[1:], len(start)) - 1]
