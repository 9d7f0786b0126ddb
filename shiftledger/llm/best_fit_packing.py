"""Conflict-constrained best-fit packing.

Documents go into bins of fixed capacity. A bin takes at most one document of a source and one of a
cluster of copies; it carries a bitmap of each. Bins are kept in order of what room is left. For an
item the search starts at the bin whose room is just enough and goes on to the successor until it
meets the tightest bin without a conflict; if there is none, a new bin opens.

Items are dealt over packing groups of about ``group_items`` rows by a hash, each packed by itself, so
work and memory of a task do not depend on the size of the corpus, of a source or of a cluster.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from shiftledger.llm.common import tasks

CAPACITY = 16_384
GROUP_ITEMS = 1_000


class Bins:
    """Open bins in order of room left, with source and cluster bitmaps.

    ``room`` is sorted; ``number`` and the bitmap rows move along with it.
    """

    def __init__(self, items: int, sources: int, clusters: int):
        self.room = np.zeros(items, np.int64)
        self.number = np.zeros(items, np.int64)
        self.sources = np.zeros((items, (sources + 7) // 8), np.uint8)
        self.clusters = np.zeros((items, (clusters + 7) // 8), np.uint8)
        self.n = 0

    def tightest(self, size: int, source: int, cluster: int) -> int:
        """Position of the tightest bin with room and no conflict, or -1."""
        at = int(np.searchsorted(self.room[: self.n], size))
        step = 16
        while at < self.n:
            end = min(at + step, self.n)
            free = (self.sources[at:end, source >> 3] >> (source & 7)) & 1
            free |= (self.clusters[at:end, cluster >> 3] >> (cluster & 7)) & 1
            hit = np.flatnonzero(free == 0)
            if len(hit):
                return at + int(hit[0])
            at, step = end, step * 2
        return -1

    def _move(self, old: int, new: int) -> None:
        """Shift the row at ``old`` down to ``new`` (new <= old), keeping the order of the rest."""
        for rows in (self.room, self.number, self.sources, self.clusters):
            moved = rows[old].copy()
            rows[new + 1 : old + 1] = rows[new:old].copy()
            rows[new] = moved

    def put(self, at: int, size: int, source: int, cluster: int, capacity: int) -> int:
        """Add an item to the bin at ``at`` (-1: a new one) and return the bin's number."""
        if at < 0:
            at = self.n
            self.room[at], self.number[at] = capacity, self.n
            self.n += 1
        self.room[at] -= size
        self.sources[at, source >> 3] |= np.uint8(1 << (source & 7))
        self.clusters[at, cluster >> 3] |= np.uint8(1 << (cluster & 7))
        number = int(self.number[at])
        self._move(at, int(np.searchsorted(self.room[:at], self.room[at])))
        return number


def pack_group(sizes, sources, clusters, capacity: int) -> np.ndarray:
    """Bin number of every item; larger items first, equal ones in the order given."""
    s = np.unique(sources, return_inverse=True)[1]
    c = np.unique(clusters, return_inverse=True)[1]
    bins = Bins(len(sizes), int(s.max(initial=-1)) + 1, int(c.max(initial=-1)) + 1)
    out = np.zeros(len(sizes), np.int64)
    for i in np.argsort(-np.asarray(sizes), kind="stable"):
        size, source, cluster = int(sizes[i]), int(s[i]), int(c[i])
        at = bins.tightest(size, source, cluster)
        out[i] = bins.put(at, size, source, cluster, capacity)
    return out


def pack(
    docs: DataFrame,
    capacity: int = CAPACITY,
    group_items: int = GROUP_ITEMS,
    cluster: str | None = None,
) -> DataFrame:
    """doc_id, piece, start, size, group, bin: where each piece of each document goes.

    Size is UTF-8 bytes plus 1. A document over the capacity is cut: its full pieces fill a bin each
    (group and bin of their own, numbered by ``piece``), what is left over is packed like any other
    document. A missing text counts as empty. A missing source conflicts with nothing, and neither
    does an empty text as a copy. Copies are rows with equal ``cluster`` values, by default equal
    texts. Repeated rows are separate items. Empty tables give no rows.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    copies = F.col(cluster).cast("string") if cluster else F.md5(F.col("text").cast("binary"))
    items = docs.select(
        F.col("doc_id"),
        F.col("source").cast("string").alias("source"),
        size.alias("whole"),
        F.when(size > 1, F.xxhash64(copies)).alias("copies"),
        F.monotonically_increasing_id().alias("read"),
    ).withColumns(
        {
            "pieces": F.expr(f"(whole - 1) div {capacity}"),
            "rest": F.expr(f"whole - ((whole - 1) div {capacity}) * {capacity}"),
        }
    )
    n = docs.count()
    groups = max(1, math.ceil(n / group_items))
    items = items.withColumn(
        "group", F.pmod(F.xxhash64("doc_id", "copies", "read"), F.lit(groups)).cast("long")
    )

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["read"], kind="stable").reset_index(drop=True)
        own = np.arange(len(pdf)).astype(str)
        source = np.where(pdf["source"].isna(), "\0" + own, "s" + pdf["source"].fillna(""))
        known = pdf["copies"].notna().to_numpy()
        cluster_of = np.where(known, pdf["copies"].astype("string").fillna(""), "\0" + own)
        pdf["bin"] = pack_group(pdf["rest"].to_numpy(), source, cluster_of, capacity)
        return pdf[["doc_id", "piece", "start", "size", "group", "bin"]]

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, size long, group long, bin long"
    tails = items.withColumns(
        {
            "piece": F.col("pieces").cast("int"),
            "start": F.col("pieces") * capacity,
            "size": F.col("rest"),
        }
    )
    packed = (
        tails.repartition(tasks(spark), "group").groupBy("group").applyInPandas(place, schema)
    )
    full = items.where(F.col("pieces") > 0).select(
        "doc_id",
        F.explode(F.sequence(F.lit(0), F.col("pieces").cast("int") - 1)).alias("piece"),
        "read",
    )
    full = full.select(
        "doc_id",
        "piece",
        (F.col("piece").cast("long") * capacity).alias("start"),
        F.lit(capacity).cast("long").alias("size"),
        (-1 - F.col("read")).alias("group"),
        F.col("piece").cast("long").alias("bin"),
    )
    return packed.unionByName(full)
