"""Deduplication of repeated runs of sentences and of repeated passages.

A text is cut into sentences at line ends, after sentence marks that white space follows and after the
marks of scripts without spaces. Words are what white space separates; in scripts without spaces every
character is a word, and two count as one in the length of sentences. There are two kinds of spans:

* Runs of whole sentences. From every sentence the shortest run that reaches ``WORDS`` words, be it one
  sentence, and up to every sentence the shortest run that does. A shared run of sentences of that length
  is thereby covered to its last sentence.
* Passages of ``PASSAGE - EVERY + 1`` words wherever they start. Of every ``EVERY`` starts in a row the one
  with the least hash is taken, so every ``PASSAGE`` words that two texts share hold a span that both take.
  Of a shared passage less than ``EVERY`` words stay at either end.

Spans are hashed by their words and joined over all documents; whatever a span covers whose first
occurrence is elsewhere is removed. First is the smallest doc_id, then the earliest place.

Each map task settles repeats among its own documents and deals only first occurrences, so a passage
that a third of all documents share reaches its bucket once per task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from shiftledger.llm.common import Rolling, mix, sliding, tasks
from shiftledger.llm.dealing import (
    BUCKETS_PER_TASK,
    NO_ID,
    bucket_of,
    chunks,
    data_of,
    deal,
    gather,
    keyed,
    run_starts,
    unpack,
)

WORDS = 15
PASSAGE = 50
EVERY = 8
GROUPS_PER_TASK = 1

_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_MARK = np.isin(np.arange(256), [ord(c) for c in ".!?"])
# Armenian, Arabic, Urdu, Devanagari and Ethiopic marks, ellipsis and doubled marks.
_MARKS_BEFORE_SPACE = [*map(ord, "\u0589\u061f\u06d4\u0964\u0965\u1362\u1367\u2026\u203c\u2047\u2048\u2049")]
# Tibetan, Myanmar, Khmer, Chinese and Japanese marks, in full and half width.
_MARKS_ALONE = [*map(ord, "\u0f0d\u0f0e\u104b\u17d4\u17d5\u3002\uff01\uff1f\uff61")]
# First and past the last character of scripts that are written without spaces: Thai, Lao and Tibetan;
# Myanmar; Khmer; kana and Chinese characters.
_UNSPACED = np.array(
    [0x0E00, 0x1000, 0x1000, 0x10A0, 0x1780, 0x1800, 0x2E80, 0x3130, 0x31A0, 0xA000]
    + [0xF900, 0xFB00, 0xFF00, 0xFFF0, 0x20000, 0x40000]
)
_MOVED = "kind int, bucket int, payload binary"


def _beyond_ascii(data: np.ndarray):
    """Of the characters beyond ASCII: first byte, byte past the last, code point."""
    at = np.flatnonzero(data >= 0xC2)
    first = data[at]
    size = 2 + (first >= 0xE0).astype(np.int64) + (first >= 0xF0)
    padded = np.append(data, np.zeros(3, np.uint8))
    code = (first & (0x7F >> size).astype(np.uint8)).astype(np.int64)
    for i in range(1, 4):
        code = np.where(size > i, code << 6 | padded[at + i] & 0x3F, code)
    return at, at + size, code


def sentence_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every sentence; together they cover the text."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = np.append(_SPACE[data], True)
    after = [np.flatnonzero((_MARK[data] & space[1:]) | (data == 10)) + 1]
    at, past, code = _beyond_ascii(data)
    if len(at):
        spaced = past[np.isin(code, _MARKS_BEFORE_SPACE)]
        after.append(spaced[space[spaced]])
        alone = np.isin(code, _MARKS_ALONE)
        # Of several marks in a row the last one ends the sentence.
        after.append(np.setdiff1d(past[alone], at[alone]))
    after = np.concatenate(after)
    # White space between sentences belongs to the one before.
    solid = np.flatnonzero(~space[:n])
    next_ = np.searchsorted(solid, after)
    cut = np.unique(solid[next_[next_ < len(solid)]])
    cut = cut[cut > 0]
    start = np.concatenate([[0], cut])
    return start, np.append(start[1:], n)


def _words(data: np.ndarray):
    """Start of every word, the end of the text after them, and which are characters without spaces."""
    space = _SPACE[data]
    starts = ~space & np.concatenate([[True], space[:-1]])
    at, past, code = _beyond_ascii(data)
    unspaced = np.searchsorted(_UNSPACED, code, side="right") % 2 == 1
    single = np.zeros(len(data) + 1, bool)
    single[at[unspaced]] = True
    starts |= single[:-1]
    behind = past[unspaced]
    behind = behind[behind < len(data)]
    starts[behind[~space[behind]]] = True
    found = np.flatnonzero(starts)
    return np.append(found, len(data)), single[found]


def _sentence_runs(start, end, words, single):
    """First and end word of the shortest runs from and up to every sentence that are long enough."""
    length = np.concatenate([[0], np.cumsum(2 - single)])
    first, past = (np.searchsorted(words[:-1], x) for x in (start, end))
    # White space at the very start of a text is a sentence without words.
    some = past > first
    first, past = first[some], past[some]
    begin, upto = length[first], length[past]
    last = np.searchsorted(upto, begin + 2 * WORDS)
    ahead = np.flatnonzero(last < len(upto))
    from_ = np.searchsorted(begin, upto - 2 * WORDS, side="right") - 1
    back = np.flatnonzero(from_ >= 0)
    runs = np.stack(
        [
            np.concatenate([first[ahead], first[from_[back]]]),
            np.concatenate([past[last[ahead]], past[back]]),
        ],
        1,
    )
    return np.unique(runs, axis=0).T if len(runs) else np.zeros((2, 0), np.int64)


def spans(data: np.ndarray):
    """Hash, first byte and end of every span, in order of place among equal ones, and the sentence bounds.

    The white space after the last word goes with a span and is not hashed.
    """
    start, end = sentence_bounds(data)
    none = np.zeros(0, np.int64)
    if not len(data):
        return np.zeros(0, np.uint64), none, none, start, end
    words, single = _words(data)
    n = len(words) - 1
    if n < WORDS:
        return np.zeros(0, np.uint64), none, none, start, end
    solid = np.maximum.accumulate(np.where(_SPACE[data], 0, np.arange(1, len(data) + 1)))
    rolling = Rolling(Rolling(data).slices(words[:-1], solid[words[1:] - 1]))
    a, b = _sentence_runs(start, end, words, single)
    hashes = rolling.slices(a, b)
    if n >= PASSAGE:
        length = PASSAGE - EVERY + 1
        every = rolling.all_of_length(length)
        least = sliding(every, EVERY, np.minimum)
        pad = np.zeros(EVERY - 1, np.uint64)
        at = np.flatnonzero(sliding(np.concatenate([pad, least, pad]), EVERY, np.maximum) == every)
        a, b = np.concatenate([a, at]), np.concatenate([b, at + length])
        # A run of sentences and a passage are never one span.
        hashes = np.concatenate([hashes, mix(every[at] + np.uint64(1))])
    return hashes, words[a], words[b], start, end


def _split_repeats(hashes, ids, keys, at):
    """Order by (hash, id, key, place) and which rows there are first occurrences."""
    order = np.lexsort((at, keys, ids, hashes))
    return order, run_starts(hashes[order])


def _deal_spans(buckets: int, groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in chunks(batches):
            found = [spans(data_of(r["text"]))[:2] for r in rows]
            count = [len(f[0]) for f in found]
            hashes = np.concatenate([f[0] for f in found])
            at = np.concatenate([np.arange(n, dtype=np.int32) for n in count])
            ids = [NO_ID if r["doc_id"] is None else r["doc_id"] for r in rows]
            ids = np.repeat(np.array(ids, np.int64), count)
            keys = np.repeat(np.array([r["rk"] for r in rows], np.int64), count)
            if not len(hashes):
                continue
            order, first = _split_repeats(hashes, ids, keys, at)
            hashes, ids, keys, at = hashes[order], ids[order], keys[order], at[order]
            # The same row of the table read twice is one occurrence.
            same = ~run_starts(hashes, ids, keys, at)
            yield _kind(0, deal(bucket_of(hashes[first], buckets), [
                hashes[first], ids[first], keys[first], at[first]
            ]))
            rest = ~first & ~same
            if rest.any():
                yield _kind(1, deal(keys[rest] % groups, [keys[rest], at[rest]]))

    return run


def _kind(kind: int, batch: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(batch.num_rows, kind), pa.int32()), *batch.columns],
        names=["kind", "bucket", "payload"],
    )


def _settle(groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for b in batches:
            settled = pc.equal(b.column("kind"), 1)
            b = b.select(["bucket", "payload"])
            yield b.filter(settled).rename_columns(["t", "payload"])
            held.append(b.filter(pc.invert(settled)))
        hashes, ids, keys, at = gather(held, [np.uint64, np.int64, np.int64, np.int32])
        if not len(hashes):
            return
        order, first = _split_repeats(hashes, ids, keys, at)
        same = ~run_starts(hashes[order], ids[order], keys[order], at[order])
        # A copy of the first occurrence itself stays; so must copies of any other one be settled once.
        rest = order[~first & ~same]
        if len(rest):
            yield deal(keys[rest] % groups, [keys[rest], at[rest]], "t")

    return run


def _cut(docs: pa.Table, marks: pa.Table) -> pa.Table:
    """Documents of one group without what its marks cover."""
    parts = [unpack(p.as_buffer(), [np.int64, np.int32]) for p in marks.column("payload")]
    keys = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
    at = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int32)
    order = np.argsort(keys, kind="stable")
    keys, at = keys[order], at[order]
    rows = []
    for doc_id, text, rk in zip(*(docs.column(c).to_pylist() for c in ("doc_id", "text", "rk"))):
        data = data_of(text)
        _, first, last, start, end = spans(data)
        lo, hi = np.searchsorted(keys, rk), np.searchsorted(keys, rk, side="right")
        gone = np.zeros(len(data) + 1, np.int64)
        if hi > lo:
            picked = np.unique(at[lo:hi])
            np.add.at(gone, first[picked], 1)
            np.add.at(gone, last[picked], -1)
        gone = np.cumsum(gone)[: len(data)] > 0
        kept = data[~gone].tobytes()
        left = np.concatenate([[0], np.cumsum(~gone)])
        rows.append(
            {
                "doc_id": doc_id,
                "text": None if text is None else kept.decode("utf-8", "surrogatepass"),
                "n_sentences": len(start),
                "n_removed": int((left[start] == left[end]).sum()),
                "n_bytes": len(data),
                "removed_bytes": int(gone.sum()),
                "kept_sha256": hashlib.sha256(kept).hexdigest(),
            }
        )
    names = list(_CUT)
    return pa.table(
        {n: pa.array([r[n] for r in rows], pa.string() if _CUT[n] == "string" else pa.int64()) for n in names}
    )


_CUT = {
    "doc_id": "long",
    "text": "string",
    "n_sentences": "long",
    "n_removed": "long",
    "n_bytes": "long",
    "removed_bytes": "long",
    "kept_sha256": "string",
}


def drop_repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text (what is kept), n_sentences, n_removed, n_bytes, removed_bytes, kept_sha256.

    A missing text stays missing and counts as empty. Rows without an id come after all others; repeats
    inside one document count too. Rows that agree in id and text are one occurrence and are cut
    alike. Texts of fewer than fifteen words have no span and are kept whole. n_removed counts the
    sentences of which nothing is kept.
    """
    n = tasks(docs.sparkSession)
    groups, buckets = GROUPS_PER_TASK * n, BUCKETS_PER_TASK * n
    source = keyed(docs, groups)
    marks = (
        source.select("doc_id", "text", "rk")
        .mapInArrow(_deal_spans(buckets, groups), _MOVED)
        .repartition(buckets, "kind", "bucket")
        .mapInArrow(_settle(groups), "t int, payload binary")
    )
    schema = ", ".join(f"{c} {t}" for c, t in _CUT.items())
    return source.groupBy("t").cogroup(marks.groupBy("t")).applyInArrow(_cut, schema)


def span_table(docs: DataFrame) -> DataFrame:
    return drop_repeated_spans(docs).drop("text")
