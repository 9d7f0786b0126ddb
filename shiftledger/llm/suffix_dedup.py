"""Exact removal of repeated byte strings by a sparse suffix array.

A byte goes if a string of ``LENGTH`` bytes covers it that also starts in a document with a smaller id.

Anchors. Of the ``LENGTH - TOKEN + 1`` leading tokens (``TOKEN`` bytes from each start) of a string the
one with the smallest hash is its anchor. Equal strings have their anchors at the same place, so only
suffixes that begin at anchors are sorted, about one in sixteen. An anchor's context is the
stretch that all its strings lie in, ``LENGTH - TOKEN`` bytes before it and ``LENGTH`` from it on.

Settling. Anchors are dealt by token. A token in one document alone cannot repeat. Of anchors with equal
contexts all but those of the smallest document are covered whole. What is left open are anchors of the
smallest document of each context, where a token has several contexts: the edges of repeats.

Suffix array. Open suffixes are range-partitioned by their leading tokens with sampled splitters. Each
bucket holds whole tokens and is sorted by multikey quicksort (eight bytes at a time, only runs of equal suffixes go on to the
next eight); strings at the same offset from equal tokens are compared in it. A token with
many open contexts, such as one that a third of all documents share, is split over as many parts as it
needs: its strings are compared across boundaries, by one row per bucket and string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from shiftledger.llm.common import Rolling, mix, sliding, stored, tasks
from shiftledger.llm.dealing import (
    BUCKETS_PER_TASK,
    bucket_of,
    chunks,
    data_of,
    deal,
    keyed,
    run_starts,
    union_length,
    unpack,
)

LENGTH = 50
TOKEN = 20
BEFORE = LENGTH - TOKEN
GROUPS_PER_TASK = 1
WHOLE = -1
# A token with more open contexts than this is split over several parts of the suffix array.
CROWDED = 50_000

_MARK = [np.int64, np.int32, np.int32]  # row key, anchor, offsets as bits or WHOLE


def anchors(data: np.ndarray):
    """Places of the anchors, hashes of their tokens and of their contexts."""
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    rolling = Rolling(data)
    token = rolling.all_of_length(TOKEN)
    least = sliding(token, BEFORE + 1, np.minimum)
    pad = np.zeros(BEFORE, np.uint64)
    # The greatest minimum of the strings that hold a token is the token's hash iff it is an anchor.
    top = sliding(np.concatenate([pad, least, pad]), BEFORE + 1, np.maximum)
    at = np.flatnonzero(top == token)
    low, high = np.maximum(at - BEFORE, 0), np.minimum(at + LENGTH, n)
    shape = (at - low).astype(np.uint64) * np.uint64(64) + (high - at).astype(np.uint64)
    return at, token[at], mix(rolling.slices(low, high) + shape)


def _kind(kind: int, batch: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(batch.num_rows, kind), pa.int32()), *batch.columns],
        names=["kind", "bucket", "payload"],
    )


def _deal_anchors(buckets: int, groups: int):
    """Anchors by token, the smallest document of each context only; the others are settled here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in chunks(batches):
            rows = [r for r in rows if r["doc_id"] is not None]
            found = [anchors(data_of(r["text"])) for r in rows]
            if not sum(len(f[0]) for f in found):
                continue
            count = [len(f[0]) for f in found]
            at, token, context = (np.concatenate([f[i] for f in found]) for i in range(3))
            number = np.repeat(np.arange(len(rows)), count)
            ids = np.array([r["doc_id"] for r in rows], np.int64)
            keys = np.array([r["rk"] for r in rows], np.int64)
            own = ids[number]
            order = np.lexsort((own, context))
            new = np.flatnonzero(run_starts(context[order], token[order]))
            first = np.empty(len(at), np.int64)
            first[order] = np.repeat(own[order][new], np.diff(np.append(new, len(order))))
            later = own > first
            if later.any():
                yield _settled(keys[number[later]], at[later], groups)
            keep = np.flatnonzero(~later)
            yield _anchor_rows(buckets, token[keep], context[keep], ids, keys, number[keep], at[keep])

    return run


def _settled(keys, at, groups) -> pa.RecordBatch:
    """Anchors whose whole context is covered, by group of documents."""
    return _kind(
        1,
        deal(
            keys % groups,
            [keys, at.astype(np.int32), np.full(len(at), WHOLE, np.int32)],
        ),
    )


def _anchor_rows(buckets, token, context, ids, keys, number, at) -> pa.RecordBatch:
    """A payload per bucket: context (64 bits), token (32 bits, the bucket has more), row, place, and
    the ids and keys of the rows."""
    where = bucket_of(token, buckets)
    order = np.argsort(where, kind="stable")
    which, starts = np.unique(where[order], return_index=True)
    payloads = []
    for part in np.split(order, starts[1:]):
        used, row = np.unique(number[part], return_inverse=True)
        arrays = [
            context[part],
            token[part].astype(np.uint32),
            row.astype(np.uint32),
            at[part].astype(np.int32),
            ids[used],
            keys[used],
        ]
        payloads.append(
            np.array([len(part), len(used)], np.int64).tobytes()
            + b"".join(a.tobytes() for a in arrays)
        )
    batch = pa.RecordBatch.from_pydict(
        {"bucket": pa.array(which, pa.int32()), "payload": pa.array(payloads, pa.binary())}
    )
    return _kind(0, batch)


def _read_anchors(batches: Iterator[pa.RecordBatch]):
    parts = [[] for _ in range(6)]
    for b in batches:
        for bucket, p in zip(b.column("bucket").to_pylist(), b.column("payload")):
            raw = p.as_buffer()
            n, m = np.frombuffer(raw, np.int64, 2)
            context = np.frombuffer(raw, np.uint64, n, 16)
            token, row = (np.frombuffer(raw, np.uint32, n, 16 + 8 * n + 4 * n * i) for i in range(2))
            at = np.frombuffer(raw, np.int32, n, 16 + 16 * n)
            ids, keys = (np.frombuffer(raw, np.int64, m, 16 + 20 * n + 8 * m * i) for i in range(2))
            named = (np.uint64(bucket) << np.uint64(32)) + token.astype(np.uint64)
            for held, x in zip(parts, (named, context, ids[row], keys[row], at)):
                held.append(x)
    return [np.concatenate(p) if p else None for p in parts[:5]]


def _settle(groups: int, crowded: int):
    """Kind 1: anchors covered whole, those that come settled too. Kind 2: open anchors, those of each context's first document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for b in batches:
            settled = pc.equal(b.column("kind"), 1)
            yield b.filter(settled)
            held.append(b.filter(pc.invert(settled)))
        token, context, ids, keys, at = _read_anchors(held)
        del held
        if token is None:
            return
        order = np.lexsort((ids, context, token))
        token, context, ids = token[order], context[order], ids[order]
        new_token = np.flatnonzero(run_starts(token))
        new_context = np.flatnonzero(run_starts(token, context))
        spread = lambda first, values: np.repeat(values, np.diff(np.append(first, len(ids))))
        least = np.minimum.reduceat(ids, new_token)
        most = np.maximum.reduceat(ids, new_token)
        contexts = np.diff(np.append(np.searchsorted(new_context, new_token), len(new_context)))
        open_token = spread(new_token, (contexts > 1) & (least != most))
        later = ids > spread(new_context, ids[new_context])
        if later.any():
            o = order[later]
            yield _settled(keys[o], at[o], groups)
        left = open_token & ~later
        if left.any():
            o = order[left]
            split = spread(new_token, contexts // crowded + 1)[left].astype(np.int32)
            yield _kind(2, deal(keys[o] % groups, [keys[o], at[o], split]))

    return run


def _contexts(docs: pa.Table, marks: pa.Table) -> pa.Table:
    """The suffixes at the open anchors of a group of documents, with what stands before them."""
    parts = [unpack(p.as_buffer(), [np.int64, np.int32, np.int32]) for p in marks.column("payload")]
    out = {n: [] for n in ("doc_id", "rk", "at", "left", "right", "split", "suffix")}
    if parts:
        keys, at, split = (np.concatenate([p[i] for p in parts]) for i in range(3))
        order = np.lexsort((at, keys))
        # Copies of a row bring the same anchors.
        order = order[run_starts(keys[order], at[order])]
        keys, at, split = keys[order], at[order], split[order]
        done = set()
        columns = (docs.column(c).to_pylist() for c in ("doc_id", "text", "rk"))
        for doc_id, text, rk in zip(*columns):
            lo, hi = np.searchsorted(keys, rk), np.searchsorted(keys, rk, side="right")
            if hi == lo or rk in done:
                continue
            done.add(rk)
            data = data_of(text)
            n = len(data)
            padded = np.concatenate([np.zeros(BEFORE, np.uint8), data, np.zeros(LENGTH, np.uint8)])
            a = at[lo:hi].astype(np.int64)
            whole = padded[a[:, None] + np.arange(BEFORE + LENGTH)[None, :]]
            # The suffix first, then what stands before it, from near to far.
            turned = np.concatenate([whole[:, BEFORE:], whole[:, :BEFORE][:, ::-1]], 1)
            out["suffix"] += [row.tobytes() for row in turned]
            out["doc_id"] += [doc_id] * len(a)
            out["rk"] += [rk] * len(a)
            out["at"] += a.tolist()
            out["split"] += split[lo:hi].tolist()
            out["left"] += np.minimum(a, BEFORE).tolist()
            out["right"] += np.minimum(n - a, LENGTH).tolist()
    kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.binary()]
    return pa.table({n: pa.array(v, k) for (n, v), k in zip(out.items(), kinds)})


def multikey_order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of byte rows, and for each sorted row whether it differs from the one before.

    Rows are split by their next eight bytes; only runs of rows that are still equal are split again.
    """
    n, width = rows.shape
    fill = np.zeros((n, -width % 8), np.uint8)
    keys = np.concatenate([rows, fill], 1).view(">u8").astype(np.uint64)
    order, new = np.arange(n), np.zeros(n, bool)
    new[:1] = True
    for j in range(keys.shape[1]):
        run = np.cumsum(new)
        alone = new & np.append(new[1:], True)
        tied = np.flatnonzero(~alone)
        if not len(tied):
            break
        k, r = keys[order[tied], j], run[tied]
        step = np.lexsort((k, r))
        order[tied] = order[tied][step]
        new[tied] |= run_starts(r[step], k[step])
    return order, new


def _compare(groups: int):
    """Strings of one bucket of the suffix array.

    kind 0: offsets at which an anchor's strings are in a smaller document of the bucket. kind 1: strings
    of split tokens, of their smallest document here, still to compare elsewhere.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        column = lambda c: rows.column(c).to_numpy()
        ids, keys, at = column("doc_id"), column("rk"), column("at")
        left, right = column("left"), column("right")
        text = np.frombuffer(b"".join(rows.column("suffix").to_pylist()), np.uint8)
        text = text.reshape(len(ids), LENGTH + BEFORE)
        # The suffix array of the bucket, equal suffixes by what stands before them, then by document.
        by_id = np.argsort(ids, kind="stable")
        order, _ = multikey_order(text[by_id])
        order = by_id[order]
        text, ids, keys, at = text[order], ids[order], keys[order], at[order]
        left, right = left[order], right[order]
        # Parts of a crowded token are compared across boundaries.
        edge = column("split")[order] > 1
        name = np.zeros(len(ids), np.uint64)
        for i in range(TOKEN):
            name = mix(name + text[:, i] + np.uint64(1))
        # Hashes of the bytes before a suffix and after its token, of every length.
        before, after = np.zeros((2, BEFORE + 1, len(ids)), np.uint64)
        for i in range(BEFORE):
            before[i + 1] = mix(before[i] + text[:, LENGTH + i] + np.uint64(1))
            after[i + 1] = mix(after[i] + text[:, TOKEN + i] + np.uint64(257))
        bits = np.zeros(len(ids), np.int64)
        for o in range(BEFORE + 1):
            can = np.flatnonzero((left >= o) & (right >= LENGTH - o))
            if not len(can):
                continue
            string = mix(name[can] + mix(before[o][can] + np.uint64(o)) * np.uint64(3))
            string = mix(string + after[BEFORE - o][can])
            step = np.lexsort((ids[can], string))
            can, string = can[step], string[step]
            new = np.flatnonzero(run_starts(string))
            least = np.repeat(ids[can][new], np.diff(np.append(new, len(can))))
            later = ids[can] > least
            bits[can[later]] |= 1 << o
            open_ = ~later & edge[can]
            if open_.any():
                c = can[open_]
                yield _strings(keys[c], at[c], o, string[open_], ids[c], groups)
        some = np.flatnonzero(bits)
        if len(some):
            c = keys[some]
            batch = deal(c % groups, [c, at[some].astype(np.int32), bits[some].astype(np.int32)])
            m = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.zeros(m), pa.int32()),
                    *batch.columns,
                    *[pa.nulls(m, k) for k in (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())],
                ],
                names=list(_FOUND),
            )

    return run


_FOUND = {
    "kind": "int",
    "t": "int",
    "payload": "binary",
    "rk": "long",
    "at": "int",
    "bits": "int",
    "string": "long",
    "doc_id": "long",
}


def _strings(keys, at, offset, string, ids, groups) -> pa.RecordBatch:
    n = len(keys)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.ones(n), pa.int32()),
            pa.array(keys % groups, pa.int32()),
            pa.nulls(n, pa.binary()),
            pa.array(keys),
            pa.array(at.astype(np.int32)),
            pa.array(np.full(n, 1 << offset), pa.int32()),
            pa.array(string.view(np.int64)),
            pa.array(ids),
        ],
        names=list(_FOUND),
    )


_KEPT = {
    "doc_id": "long",
    "kept": "binary",
    "n_bytes": "long",
    "n_removed": "long",
    "n_spans": "long",
    "kept_sha256": "string",
}


def _cut(docs: pa.Table, marks: pa.Table) -> pa.Table:
    """Documents of one group without the bytes that its marks cover."""
    parts = [
        unpack(p.as_buffer(), _MARK) for p in marks.column("payload") if p.is_valid
    ]
    single = marks.filter(pc.is_valid(marks.column("rk")))
    parts.append([single.column(c).to_numpy() for c in ("rk", "at", "bits")])
    keys, at, bits = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.argsort(keys, kind="stable")
    keys, at, bits = keys[order], at[order].astype(np.int64), bits[order]
    out = {n: [] for n in _KEPT}
    for doc_id, text, rk in zip(*(docs.column(c).to_pylist() for c in ("doc_id", "text", "rk"))):
        data = data_of(text)
        n = len(data)
        lo, hi = np.searchsorted(keys, rk), np.searchsorted(keys, rk, side="right")
        a, b = at[lo:hi], bits[lo:hi]
        whole = a[b == WHOLE]
        start, end = [np.maximum(whole - BEFORE, 0)], [np.minimum(whole + LENGTH, n)]
        a, b = a[b != WHOLE], b[b != WHOLE]
        for o in range(BEFORE + 1):
            hit = a[(b >> o) & 1 == 1] - o
            start.append(hit)
            end.append(hit + LENGTH)
        start, end = union_length(np.concatenate(start), np.concatenate(end))
        gone = np.zeros(n + 1, np.int8)
        gone[start] += 1
        gone[end] -= 1
        kept = data[np.cumsum(gone[:n]) == 0].tobytes()
        values = (doc_id, kept, n, n - len(kept), len(start), hashlib.sha256(kept).hexdigest())
        for name, v in zip(out, values):
            out[name].append(v)
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    return pa.table({n: pa.array(v, kinds[_KEPT[n]]) for n, v in out.items()})


def drop_repeated_bytes(docs: DataFrame) -> DataFrame:
    """doc_id, kept (bytes), n_bytes, n_removed, n_spans, kept_sha256 for every row of ``docs``.

    Strings are judged on the input and may overlap. A missing text counts as empty. A missing id is
    neither smaller nor larger than another, so such rows neither lose bytes nor cost others any; rows
    with equal ids do not cost each other any either. Other columns are left aside.
    """
    n = tasks(docs.sparkSession)
    groups, buckets = GROUPS_PER_TASK * n, BUCKETS_PER_TASK * n
    source = keyed(docs, groups)
    moved = "kind int, bucket int, payload binary"
    settled = stored(
        source.select("doc_id", "text", "rk")
        .mapInArrow(_deal_anchors(buckets, groups), moved)
        .repartition(buckets, "kind", "bucket")
        .mapInArrow(_settle(groups, CROWDED), moved),
        "settled",
    )
    whole = settled.where("kind = 1").selectExpr("bucket as t", "payload")
    open_ = settled.where("kind = 2").selectExpr("bucket as t", "payload")
    suffixes = (
        source.groupBy("t")
        .cogroup(open_.groupBy("t"))
        .applyInArrow(
            _contexts, "doc_id long, rk long, at int, left int, right int, split int, suffix binary"
        )
        .repartitionByRange(n, F.substring("suffix", 1, TOKEN), F.pmod("rk", "split"))
    )
    found = suffixes.mapInArrow(_compare(groups), ", ".join(f"{c} {t}" for c, t in _FOUND.items()))
    # One row per bucket and string: compare what continues in another bucket.
    across = (
        found.where("kind = 1")
        .withColumn("least", F.min("doc_id").over(Window.partitionBy("string", "bits")))
        .where("doc_id > least")
    )
    columns = ["t", "payload", "rk", "at", "bits"]
    whole_marks = whole.unionByName(found.where("kind = 0").select("t", "payload"))
    marks = whole_marks.selectExpr(
        "t", "payload", "cast(null as long) as rk", "cast(null as int) as at", "cast(null as int) as bits"
    ).unionByName(across.select(*columns))
    schema = ", ".join(f"{c} {t}" for c, t in _KEPT.items())
    return source.groupBy("t").cogroup(marks.groupBy("t")).applyInArrow(_cut, schema)


def suffix_table(docs: DataFrame) -> DataFrame:
    return drop_repeated_bytes(docs).drop("kept")
