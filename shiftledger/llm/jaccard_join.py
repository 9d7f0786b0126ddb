"""Similarity join of documents on word shingles by parity sketches.

A document's set is the hashes of its distinct 5-word shingles. Documents link when
100 * intersection >= 75 * union; the result says which documents hang together by links.

Sketch. In the band of a size, shingles are dealt over blocks by their hash and each block keeps the
XOR of its shingles. Adding or taking away a shingle changes one block, so the number of differing
blocks is at most the symmetric difference. A pair that links differs in at most a third of the
smaller set and two sevenths of the larger one.

A rare shingle has a block of its own; only the very common ones share blocks.

Join. Blocks are put in one order for all documents (those of common shingles last, then by hash). If at most D blocks of a document differ, its first D + 1 blocks and those of the other share
one: that is the pigeonhole. A document takes part in the band of its own size (powers of two) and in
the one below if a partner can be there; a pair always meets in the band of its smaller set. In sets
under 64 shingles common ones have blocks of their own too. Two linked sets that share no rare shingle
have rare ones in at most a seventh of both together, so one of them in at most a seventh of its own:
sets that meet in a common block are only compared with such sets. What counts as common only decides
what work is done, never the result.

Verify. Each node also keeps parity bits: one bit per slot, flipped by every shingle of the slot. Their
Hamming distance is at most the symmetric difference, which refutes nearly all wrong pairs before any set
is read. What is left is decided by the sets themselves. Documents with equal sets are one node. Of the
nodes that share a block, each is compared with the one that is in most groups; after that only nodes of different
components are compared, by their bits in pairs of bounded chunks, and only pairs that the bits leave open
are emitted. So no group emits all its pairs, and no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from shiftledger.llm.common import Rolling, mix, small_batches, stored, tasks
from shiftledger.llm.dealing import (
    BUCKETS_PER_TASK,
    DEALT,
    bucket_of,
    chunks,
    data_of,
    deal,
    gather,
    run_starts,
)

WORDS = 5
PERCENT = 75
SMALL = 64
BLOCKS_PER_SIZE = 4
CHUNK = 1_024
# Very common shingles: at least so often in a chunk of documents; at most so many are kept.
COMMON_IN_CHUNK = 2
COMMON = 262_144

_GAP = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MULTIPLIERS = [
    np.uint64(m)
    for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 1)
]


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of bytes that are not white space."""
    edge = np.diff(np.concatenate([[True], _GAP[data], [True]]).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the text's 5-word shingles; of all its words if there are fewer."""
    data = _LOWER[data_of(text)]
    start, end = word_bounds(data)
    if not len(start):
        return np.zeros(0, np.uint64)
    words = Rolling(data).slices(start, end)
    n = max(1, len(words) - WORDS + 1)
    total = np.full(n, min(len(words), WORDS), np.uint64)
    for i in range(min(len(words), WORDS)):
        total += words[i : i + n] * _MULTIPLIERS[i]
    return np.unique(mix(total))


def node_of(hashes: np.ndarray) -> int:
    """A 64-bit name of the set."""
    with np.errstate(over="ignore"):
        both = np.array(
            [hashes.sum(dtype=np.uint64), mix(hashes).sum(dtype=np.uint64)], np.uint64
        )
        both = mix(both + np.uint64(len(hashes)))
        return int((both[0] ^ (both[1] * _MULTIPLIERS[1])).astype(np.int64))


def sketch(hashes: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first blocks in each band that the set takes part in: hashes of (band, block, XOR), and the
    role: 0 a rare shingle's block, 1 a block of common ones in a set with few rare ones, 2 another."""
    size = len(hashes)
    if not size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int8)
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        frequent = common[at] == hashes
    else:
        frequent = np.zeros(size, bool)
    rare, often = hashes[~frequent], hashes[frequent]
    # Without a shared rare shingle all rare ones differ, and one of two linked sets has so few.
    role = 1 if 7 * len(rare) <= size else 2
    band = size.bit_length() - 1
    bands = [(band, size // 3)]
    if 3 * size <= 4 * ((1 << band) - 1):
        bands.append((band - 1, 2 * size // 7))
    values, roles = [], []
    for b, differing in bands:
        own = np.sort(mix(rare ^ np.uint64(b + 1)))[: differing + 1]
        left = differing + 1 - len(own)
        values.append(own)
        roles.append(np.zeros(len(own), np.int8))
        if left > 0 and len(often):
            block = mix(often ^ _MULTIPLIERS[3])
            if (1 << b) >= SMALL:
                block = block % np.uint64(BLOCKS_PER_SIZE << b)
            order = np.argsort(block, kind="stable")
            block = block[order]
            first = np.flatnonzero(run_starts(block))
            xor = np.bitwise_xor.reduceat(often[order], first)
            shared = np.sort(mix(xor ^ mix(block[first] * _MULTIPLIERS[1] + np.uint64(b + 1))))
            values.append(shared[:left])
            roles.append(np.full(len(shared[:left]), role, np.int8))
    return np.concatenate(values), np.concatenate(roles)


def parity(hashes: np.ndarray) -> bytes:
    """Parity bits of the set, twice as many as the power of two below its size, 64 at least."""
    bits = max(64, 2 << (len(hashes).bit_length() - 1)) if len(hashes) else 64
    slots = mix(hashes ^ _MULTIPLIERS[2]) % np.uint64(bits)
    odd = np.bincount(slots.astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def distance(a: bytes, b: bytes) -> int:
    """Hamming distance of parity bits; the longer ones are folded, which keeps them parities."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document, and with the last of each chunk its frequent shingles."""
    for rows in chunks(batches):
        sets = [shingles(r["text"]) for r in rows]
        common, counts = np.unique(np.concatenate(sets), return_counts=True)
        often = counts >= COMMON_IN_CHUNK
        none = [None] * (len(rows) - 1)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r["doc_id"] for r in rows], pa.int64()),
                pa.array([r["tkey"] for r in rows], pa.int64()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()),
                pa.array([parity(s) for s in sets], pa.binary()),
                pa.array([*none, common[often].view(np.int64)], pa.list_(pa.int64())),
                pa.array([*none, counts[often]], pa.list_(pa.int64())),
            ],
            names=["doc_id", "tkey", "n_shingles", "node", "parity", "common", "times"],
        )


def _sketches(common: np.ndarray, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in chunks(batches):
            by_node = {}
            for r in rows:
                s = shingles(r["text"])
                if len(s):
                    by_node.setdefault(node_of(s), s)
            if not by_node:
                continue
            found = [sketch(s, common) for s in by_node.values()]
            values, roles = (np.concatenate([f[i] for f in found]) for i in (0, 1))
            nodes = np.repeat(np.array(list(by_node), np.int64), [len(f[0]) for f in found])
            yield deal(bucket_of(values, buckets), [values, nodes, roles])

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Block values that several nodes share: group, place of the node in it, first node, node, and how
    many nodes, the first ones, are to be compared with the others."""
    values, nodes, roles = gather(batches, [np.uint64, np.int64, np.int8])
    order = np.lexsort((nodes, roles, values))
    values, nodes, roles = values[order], nodes[order], roles[order]
    first = np.flatnonzero(run_starts(values))
    length = np.diff(np.append(first, len(values)))
    if len(first):
        hubs = np.add.reduceat((roles < 2).astype(np.int64), first)
        keep = (hubs > 0) & (length > 1)
        first, length, hubs = first[keep], length[keep], hubs[keep]
    # Groups of the same nodes need to be seen once.
    if not len(first):
        return
    sums = np.concatenate([[0], np.cumsum(mix(nodes.view(np.uint64)))]).astype(np.uint64)
    name = mix(sums[first + length] - sums[first] + mix(hubs.astype(np.uint64)))
    _, pick = np.unique(name, return_index=True)
    rows = np.repeat(first[pick], length[pick])
    rank = np.arange(len(rows)) - np.repeat(np.cumsum(length[pick]) - length[pick], length[pick])
    for at in range(0, len(rows), 1 << 18):
        part = slice(at, at + (1 << 18))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(name[pick], length[pick])[part].view(np.int64)),
                pa.array(rank[part].astype(np.int32)),
                pa.array(nodes[rows[part]]),
                pa.array(nodes[rows[part] + rank[part]]),
                pa.array(np.repeat(hubs[pick], length[pick])[part]),
                pa.array(np.repeat(length[pick], length[pick])[part]),
            ],
            names=["gid", "rank", "hub", "node", "hubs", "size"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The set of every node; copies that stand in one task are read once."""
    done = set()
    for rows in chunks(batches):
        rows = [r for r in {r["node"]: r for r in rows}.values() if r["node"] not in done]
        done.update(r["node"] for r in rows)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r["node"] for r in rows], pa.int64()),
                pa.array([shingles(r["text"]).tobytes() for r in rows], pa.binary()),
            ],
            names=["node", "shingles"],
        )


@F.pandas_udf(T.BooleanType())
def _near(a: pd.Series, b: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    """Whether sizes and parity bits leave it open that the sets link."""
    out = []
    for x, y, p, q in zip(a, b, n, m):
        small, large = min(p, q), max(p, q)
        # intersection >= t * union means difference <= (1 - t) / (1 + t) * (sum of sizes)
        most = (100 - PERCENT) * (p + q)
        out.append(
            100 * small >= PERCENT * large and (100 + PERCENT) * distance(x, y) <= most
        )
    return pd.Series(out, dtype=bool)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of different components in a group that sizes and parity bits leave open.

    A group comes in pairs of chunks (i, j); the nodes of chunk i that are to be compared meet all later
    ones of chunk j.
    """
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    rows = pa.Table.from_batches(held)
    gid, i, j, rank, node, hubs, root, n = (
        rows.column(c).to_numpy() for c in ("gid", "i", "j", "rank", "node", "hubs", "root", "n")
    )
    bits = rows.column("parity").to_pylist()
    order = np.lexsort((rank, j, i, gid))
    first = np.flatnonzero(run_starts(gid[order], i[order], j[order]))
    # Bits of a node at a width, unpacked once for all its groups.
    known: dict = {}

    def words_of(row: int, width: int) -> np.ndarray:
        key = (node[row], width)
        if key not in known:
            x = np.frombuffer(bits[row], np.uint8)
            while len(x) > width:
                x = x[: len(x) // 2] ^ x[len(x) // 2 :]
            known[key] = x.view(np.uint64)
        return known[key]

    kept, found, pending = np.zeros((2, 0), np.int64), [], 0
    for part in np.split(order, first[1:]):
        width = min(len(bits[r]) for r in part)
        words = np.stack([words_of(r, width) for r in part])
        sizes, places, names, of = n[part], rank[part], node[part], root[part]
        lead = np.flatnonzero((places < hubs[part]) & (places // CHUNK == i[part[0]]))
        rest = np.flatnonzero(places // CHUNK == j[part[0]])
        step = max(1, (1 << 20) // (len(rest) * words.shape[1] + 1))
        for at in range(0, len(lead), step):
            a = lead[at : at + step, None]
            p, q = sizes[a], sizes[rest][None, :]
            ok = (places[rest][None, :] > places[a]) & (of[rest][None, :] != of[a])
            ok &= 100 * np.minimum(p, q) >= PERCENT * np.maximum(p, q)
            if not ok.any():
                continue
            apart = np.bitwise_count(words[a[:, 0], None] ^ words[None, rest]).sum(2, dtype=np.int64)
            ok &= (100 + PERCENT) * apart <= (100 - PERCENT) * (p + q)
            x, y = np.nonzero(ok)
            if len(x):
                found.append(np.stack([names[a[x, 0]], names[rest[y]]]))
                pending += len(x)
        if pending > 1 << 17:
            kept, found, pending = _distinct([kept, *found]), [], 0
    kept = _distinct([kept, *found])
    for at in range(0, kept.shape[1], 1 << 18):
        a, b = kept[:, at : at + (1 << 18)]
        yield pa.RecordBatch.from_pydict({"a": pa.array(a), "b": pa.array(b)})


def _distinct(pairs: list[np.ndarray]) -> np.ndarray:
    a, b = np.sort(np.concatenate(pairs, 1), 0)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = run_starts(a, b)
    return np.stack([a[new], b[new]])


@F.pandas_udf(T.BooleanType())
def _linked(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a, b):
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        small, large = min(len(x), len(y)), max(len(x), len(y))
        if 100 * small < PERCENT * large:
            out.append(False)
            continue
        both = len(np.intersect1d(x, y, assume_unique=True))
        out.append(100 * both >= PERCENT * (small + large - both))
    return pd.Series(out, dtype=bool)


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of each connected component, for nodes with an edge.

    Large-star and small-star steps by turns: neighbours move to the smallest node in reach until
    every component is a star. Every step is written to the shared folder.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            e = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        least = least.select("a", F.least("a", "m").alias("m"))
        joined = e.join(least, "a")
        moved = joined.where(F.col("b") > F.col("a") if large else F.col("b") != F.col("m"))
        moved = moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
        if not large:
            moved = moved.unionByName(least.select("a", F.col("m").alias("b")))
        return moved.where("a > b").distinct()

    def state(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    # From the larger node to the smaller one.
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = stored(e.where("a > b"), "edges")
    before = state(e)
    while True:
        e = stored(star(star(e, large=True), large=False), "edges")
        now = state(e)
        if now == before:
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def common_shingles(seen: DataFrame) -> np.ndarray:
    """Sorted hashes of the shingles that occur most often, at most ``COMMON``.

    A histogram of counts by steps of a sixteenth of a doubling gives the count from which on there are no
    more than that. Only those hashes come to the driver, 8 bytes each, and they go to the tasks with the
    closure.
    """
    step = F.floor(F.log2("times") * 16).alias("step")
    counted = stored(
        seen.where(F.size("common") > 0)
        .select(F.explode(F.arrays_zip("common", "times")).alias("c"))
        .groupBy(F.col("c.common").alias("h"))
        .agg(F.sum("c.times").alias("times"))
        .select("h", step),
        "common",
    )
    least, total = None, 0
    for r in sorted(counted.groupBy("step").count().collect(), reverse=True):
        total += r["count"]
        if total > COMMON:
            break
        least = r["step"]
    if least is None:
        return np.zeros(0, np.uint64)
    found = counted.where(F.col("step") >= least).select("h").toArrow().column("h")
    return np.sort(found.to_numpy().view(np.uint64))


def linked_documents(docs: DataFrame) -> DataFrame:
    """doc_id, tkey, n_shingles, component_id and ``node`` for every row of ``docs``.

    ``node`` names the set, ``tkey`` the text. component_id is the smallest doc_id that is reachable,
    missing ids aside. Texts that are missing or have no word have an empty set and link with nothing.
    Repeated rows are rows of one node. An empty table gives an empty table; other columns are left.
    """
    spark = docs.sparkSession
    small_batches(spark)
    buckets = BUCKETS_PER_TASK * tasks(spark)
    source = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.xxhash64("text").alias("tkey"),
    )
    seen = stored(
        source.mapInArrow(
            _nodes,
            "doc_id long, tkey long, n_shingles long, node long, parity binary, "
            "common array<long>, times array<long>",
        ),
        "nodes",
    )
    rows = seen.select("doc_id", "tkey", "n_shingles", "node", "parity")
    common = common_shingles(seen)
    groups = stored(
        source.select("text")
        .mapInArrow(_sketches(common, buckets), DEALT)
        .repartition(buckets, "bucket")
        .mapInArrow(_groups, "gid long, rank int, hub long, node long, hubs long, size long"),
        "groups",
    )
    bits = stored(
        rows.where("node is not null")
        .groupBy("node")
        .agg(
            F.min("tkey").alias("tkey"),
            F.first("n_shingles").alias("n"),
            F.first("parity").alias("parity"),
        )
        .join(groups.select("node").distinct(), "node", "left_semi"),
        "bits",
    )

    def verified(near: DataFrame) -> DataFrame:
        """The linked ones among the pairs."""
        near = stored(near, "near")
        ends = near.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        chosen = bits.select("node", "tkey").join(ends, "node", "left_semi")
        # One text for every node that is left; rows with equal texts meet in a task.
        sets = stored(
            source.select("tkey", "text")
            .join(chosen, "tkey")
            .mapInArrow(_sets, "node long, shingles binary"),
            "sets",
        )
        left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
        right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
        both = near.join(right, "b").join(left, "a")
        return stored(both.where(_linked("x", "y")).select("a", "b"), "links")

    # Compared with all of a larger group: of its nodes the one that is in most groups.
    larger = groups.where("size > 2").select("gid", "node", "rank", "hubs")
    often = larger.groupBy("node").count()
    central = stored(
        larger.where("rank < hubs")
        .join(often, "node")
        .groupBy("gid")
        .agg(F.max_by("node", F.struct("count", "node")).alias("central")),
        "central",
    )
    pairs = groups.where("size = 2 and rank > 0").select("hub", "node").unionByName(
        larger.join(central, "gid").where("central <> node").select(
            F.col("central").alias("hub"), "node"
        )
    )
    first = pairs.select(
        F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")
    )
    left = bits.select(F.col("node").alias("a"), F.col("parity").alias("x"), F.col("n").alias("p"))
    right = bits.select(F.col("node").alias("b"), F.col("parity").alias("y"), F.col("n").alias("q"))
    judged = first.distinct().join(right, "b").join(left, "a")
    links = verified(judged.where(_near("x", "y", "p", "q")).select("a", "b"))

    # Groups that still hold more than one component.
    named = groups.join(components(links), "node", "left").select(
        "gid", "rank", "node", "hubs", F.coalesce("root", "node").alias("root")
    )
    named = stored(named, "named")
    split = (
        named.groupBy("gid")
        .agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("rank").alias("last"))
        .where("lo <> hi")
        .select("gid", "last")
    )
    chunk, last, last_hub = (f"{c} div {CHUNK}" for c in ("rank", "last", "(hubs - 1)"))
    open_rows = (
        named.join(split, "gid")
        .join(central, "gid", "left")
        .join(bits.select("node", "n", "parity"), "node")
        .selectExpr(
            "coalesce(central, gid) as family",
            "gid",
            "rank",
            "node",
            "hubs",
            "root",
            "n",
            "parity",
            f"""explode(concat(
              if({chunk} <= {last_hub},
                transform(sequence({chunk}, {last}), j -> struct({chunk} as i, j as j)),
                array()),
              if({chunk} > 0,
                transform(sequence(0L, least({chunk} - 1, {last_hub})), i -> struct(i as i, {chunk} as j)),
                array()))) as at""",
        )
        .selectExpr("*", "at.i as i", "at.j as j")
        .drop("at")
    )
    near = (
        # Groups of one family come together, as they hold the same pairs; a large family in parts.
        open_rows.repartition(buckets, "family", F.pmod("gid", F.lit(4)), "i", "j")
        .mapInArrow(_across, "a long, b long").distinct()
    )
    links = links.unionByName(verified(near))
    roots = components(links)

    least = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    least = least.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    by_root = least.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = least.join(by_root, "root").select("node", "component_id")
    return rows.join(ids, "node", "left").select(
        "doc_id",
        "tkey",
        "n_shingles",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias(
            "component_id"
        ),
        "node",
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of linked documents: that of the smallest id.

    Rows without an id come after all others; of equal ids the smaller text key counts, of repeated
    rows one stays. Documents without words are in no group and all stay. Columns are kept; names that
    start with two underscores are used inside.
    """
    rows = linked_documents(docs).where("node is not null")
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "tkey")
    least = rows.groupBy("node").agg(F.min(rank).alias("r"), F.min("component_id").alias("c"))
    # A group whose rows all lack an id is one node without a component id.
    group = F.coalesce(F.col("c").cast("string"), F.concat(F.lit("n"), "node"))
    first = least.groupBy(group.alias("g")).agg(F.min("r").alias("r"))
    first = stored(
        first.select(F.col("r.doc_id").alias("__id"), F.col("r.tkey").alias("__key")), "first"
    )
    keyed = docs.withColumns({"__k": F.xxhash64("text"), "__d": F.col("doc_id").cast("long")})
    empty = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    same = (F.col("__k") == F.col("__key")) & F.col("__d").eqNullSafe(F.col("__id"))
    once = F.row_number().over(Window.partitionBy("__k", "__d").orderBy("__k"))
    kept = keyed.where(~empty).join(first, same).withColumn("__n", once).where("__n = 1")
    return kept.select(*docs.columns).unionByName(docs.where(empty))


def jaccard_table(docs: DataFrame) -> DataFrame:
    return linked_documents(docs).select("doc_id", "n_shingles", "component_id")
