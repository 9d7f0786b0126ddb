"""Ranked lexical search over an index whose documents are stratified by length.

Index. A task turns a few megabytes of documents into a segment: one row per term with its postings, sorted by
document length and then by term frequency, and one row with the segment's documents. Nothing is shuffled. The
index holds every term of every document and is written to the shared folder.

Search. Document frequencies of the terms asked for and the totals N and L come from the index rows. Segments
are dealt over parts of bounded size, where each part meets the items in blocks. In a part, documents with the
same normaliser m form a stratum, the postings of a term in a stratum stand by tf, and the impact of a (m, tf)
is computed once for all postings that share it. An item's bound in a stratum is the sum over its terms of weight
times the impact of the stratum's largest tf. Strata are visited by falling bound, a batch twice as large as
the last one at a time, until the next bound is under the item's k-th score: no later stratum can enter its list.
The lists of all parts are merged by Spark.

Everything but the term weights is whole-number arithmetic.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from shiftledger.llm.common import small_batches, stored, tasks
from shiftledger.llm.dealing import NO_ID, chunks, pack, run_starts, unpack

K = 10
SEGMENT_BYTES = 8 << 20
# Postings that a part should hold, and terms of items that meet it at once.
PART_POSTINGS = 1 << 22
BLOCK_TERMS = 1 << 17
FIRST_VISIT = 4096

INDEX = "segment long, term binary, df long, words long, payload binary"

# All that is no digit, ASCII letter or non-ASCII character parts terms; only A-Z is lower-cased.
_TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def terms(data: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return data.translate(_TERM_BYTES).split()


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per segment a row for each term, and one without a term for its documents."""
    task = TaskContext.get().partitionId()
    for count, rows in enumerate(chunks(batches, SEGMENT_BYTES)):
        ids, sizes, held, number, tfs = [], [], [], [], []
        vocabulary: dict[bytes, int] = {}
        for r in rows:
            found = terms((r["text"] or "").encode("utf-8", "surrogatepass"))
            if not found:
                continue
            each = Counter(found)
            held.extend([len(ids)] * len(each))
            number.extend([vocabulary.setdefault(t, len(vocabulary)) for t in each])
            tfs.extend(each.values())
            ids.append(NO_ID if r["doc_id"] is None else r["doc_id"])
            sizes.append(len(found))
        if not ids:
            continue
        doc, term, tf = np.array(held, np.int32), np.array(number, np.int32), np.array(tfs, np.int32)
        n = np.array(sizes, np.int64)
        order = np.lexsort((doc, tf, n[doc], term))
        doc, term, tf = doc[order], term[order], tf[order]
        first = np.append(np.flatnonzero(run_starts(term)), len(term))
        payloads = [pack([doc[a:b], tf[a:b]]) for a, b in zip(first[:-1], first[1:])]
        names = list(vocabulary)
        size = len(names) + 1
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(size, (task << 32) + count, np.int64)),
                pa.array([None, *names], pa.binary()),
                pa.array(np.concatenate([[len(ids)], np.diff(first)]), pa.int64()),
                pa.array([int(n.sum()), *[None] * len(names)], pa.int64()),
                pa.array([pack([np.array(ids, np.int64), n]), *payloads], pa.binary()),
            ],
            names=["segment", "term", "df", "words", "payload"],
        )


def index_documents(docs: DataFrame) -> DataFrame:
    """The index of all rows of ``docs`` with ``doc_id`` and ``text``, written to the shared folder.

    Rows with a missing text or one without terms are in no segment and count nowhere. Repeated rows and
    repeated ids are documents of their own; a missing id is kept. Other columns are left aside.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(source.mapInArrow(_segments, INDEX), "lexical")


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, item, term, times: the terms of each item. ``item`` names the pair of id and text."""
    small_batches(items.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            item, term, times = [], [], []
            for name, text in zip(b.column("item").to_pylist(), b.column("text").to_pylist()):
                for t, n in Counter(terms((text or "").encode("utf-8", "surrogatepass"))).items():
                    item.append(name)
                    term.append(t)
                    times.append(n)
            yield pa.RecordBatch.from_pydict(
                {"item": pa.array(item, pa.int64()), "term": pa.array(term, pa.binary()), "times": pa.array(times, pa.int64())}
            )

    return items.select("item", "text").mapInArrow(counted, "item long, term binary, times long")


class Part:
    """Postings of some documents, stratified: a group is the postings of a term in a stratum."""

    def __init__(self, doc_ids, sizes, doc, term, tf, n_docs: int, n_words: int):
        """``doc_ids`` and ``sizes`` of the documents; ``doc``, ``term`` (number) and ``tf`` of the postings."""
        m = normaliser(sizes, n_docs, n_words)
        self.doc_ids = doc_ids
        self.strata, stratum_of = np.unique(m, return_inverse=True)
        stratum = stratum_of[doc]
        order = np.lexsort((doc, tf, stratum, term))
        self.doc, term, stratum, tf = doc[order], term[order], stratum[order], tf[order]
        # Postings that share stratum and tf share an impact.
        pair = stratum * (int(tf.max(initial=0)) + 1) + tf
        pairs, first, at = np.unique(pair, return_index=True, return_inverse=True)
        self.impact = impact(tf[first], self.strata[stratum[first]])[at]
        start = np.flatnonzero(run_starts(term, stratum))
        self.start, self.end = start, np.append(start[1:], len(term))
        self.group_stratum = stratum[start]
        # tf rises within a group, and the impact with it.
        self.group_most = self.impact[self.end - 1] if len(start) else np.zeros(0, np.int64)
        # Terms come in order: the groups of a term stand together.
        self.term_groups = np.searchsorted(term[start], np.arange(int(term.max(initial=-1)) + 2))
        self.scores = np.zeros(len(doc_ids), np.int64)
        self.visited = 0

    def best(self, term: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of an item's k best documents here, equal scores by id; only scores above 0."""
        term, weight = term[term + 1 < len(self.term_groups)], weight[term + 1 < len(self.term_groups)]
        a, b = self.term_groups[term], self.term_groups[term + 1]
        groups = _ranges(a, b)
        weight = np.repeat(weight, b - a)
        groups, weight = groups[weight > 0], weight[weight > 0]
        bound = np.zeros(len(self.strata), np.int64)
        load = np.zeros(len(self.strata), np.int64)
        np.add.at(bound, self.group_stratum[groups], weight * self.group_most[groups])
        np.add.at(load, self.group_stratum[groups], self.end[groups] - self.start[groups])
        visit = np.argsort(-bound, kind="stable")
        visit = visit[bound[visit] > 0]
        rank = np.full(len(self.strata), len(visit))
        rank[visit] = np.arange(len(visit))
        order = np.argsort(rank[self.group_stratum[groups]], kind="stable")
        groups, weight = groups[order], weight[order]
        group_rank = rank[self.group_stratum[groups]]
        work = np.cumsum(load[visit])
        best_ids, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, batch = 0, FIRST_VISIT
        while at < len(visit):
            if len(best) == k and bound[visit[at]] < best[-1]:
                break
            done = work[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(work, done + batch, side="right")))
            mine = slice(*np.searchsorted(group_rank, [at, to]))
            g = groups[mine]
            length = self.end[g] - self.start[g]
            rows = _ranges(self.start[g], self.end[g])
            np.add.at(self.scores, self.doc[rows], np.repeat(weight[mine], length) * self.impact[rows])
            self.visited += len(rows)
            touched = np.unique(self.doc[rows])
            score = self.scores[touched]
            self.scores[touched] = 0
            if len(best) == k:
                some = score >= best[-1]
                touched, score = touched[some], score[some]
            best_ids = np.concatenate([best_ids, self.doc_ids[touched]])
            best = np.concatenate([best, score])
            first = np.lexsort((best_ids, -best))[:k]
            best_ids, best = best_ids[first], best[first]
            at, batch = to, 2 * batch
        keep = best > 0
        return best_ids[keep], best[keep]


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All whole numbers of the half-open ranges, one after the other."""
    length = end - start
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(length) - length
    return np.arange(total) + np.repeat(start - before, length)


def normaliser(sizes: np.ndarray, n_docs: int, n_words: int) -> np.ndarray:
    """m of documents of so many terms; whole numbers of any size."""
    if n_docs * int(sizes.max(initial=0)) * 75 < 1 << 63:
        return 25 + (75 * sizes * n_docs) // n_words
    return np.array([25 + (75 * int(s) * n_docs) // n_words for s in sizes], np.int64)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def _search_part(n_docs: int, n_words: int, k: int):
    def run(key, index: pa.Table, asked: pa.Table) -> pa.Table:
        out = {"item": [], "doc_id": [], "score": []}
        if index.num_rows and asked.num_rows:
            numbers: dict[bytes, int] = {}
            asked_term = np.array([numbers.setdefault(t, len(numbers)) for t in asked.column("term").to_pylist()], np.int64)
            segment = index.column("segment").to_numpy()
            names, payloads = index.column("term").to_pylist(), index.column("payload")
            base, ids, sizes = {}, [], []
            for i in np.flatnonzero([t is None for t in names]):
                one, n = unpack(payloads[int(i)].as_buffer(), [np.int64, np.int64])
                base[segment[i]] = sum(map(len, ids))
                ids.append(one)
                sizes.append(n)
            doc, term, tf = [], [], []
            for i, t in enumerate(names):
                if t is not None and t in numbers:
                    d, f = unpack(payloads[i].as_buffer(), [np.int32, np.int32])
                    doc.append(d + np.int64(base[segment[i]]))
                    term.append(np.full(len(d), numbers[t], np.int64))
                    tf.append(f)
            if doc:
                join = lambda x: np.concatenate(x).astype(np.int64)
                part = Part(join(ids), join(sizes), join(doc), join(term), join(tf), n_docs, n_words)
                item, weight = asked.column("item").to_numpy(), asked.column("weight").to_numpy()
                order = np.argsort(item, kind="stable")
                first = np.flatnonzero(run_starts(item[order]))
                for rows in np.split(order, first[1:]):
                    found, scores = part.best(asked_term[rows], weight[rows], k)
                    out["item"].extend([item[rows[0]]] * len(found))
                    out["doc_id"].extend(found)
                    out["score"].extend(scores)
        return pa.table({n: pa.array(v, pa.int64()) for n, v in out.items()})

    return run


def search(index: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents with the highest scores above 0 for each item.

    Equal scores go to the smaller doc_id, a missing one comes last. An item is a distinct pair of item_id and
    text: repeated rows are one item, different texts of one id are ranked each by itself. Items without
    terms, a search without items and an empty index give no rows. Other columns are left aside.
    """
    spark = index.sparkSession
    named = items.select("item_id", F.col("text").cast("string").alias("text")).distinct()
    named = stored(named.withColumn("item", F.monotonically_increasing_id()), "items")
    asked = stored(item_terms(named), "asked")
    totals = index.where("term is null").agg(F.sum("df").alias("n"), F.sum("words").alias("l")).first()
    n_docs, n_words = totals["n"] or 0, totals["l"] or 0
    wanted = asked.select("term").distinct()
    # Only rows of terms that are asked for leave the index. Spark broadcasts the terms if they are few.
    used = index.where("term is not null").join(wanted, "term", "left_semi")
    frequency = stored(used.groupBy("term").agg(F.sum("df").alias("df")), "frequency")
    w = F.floor(F.lit(1000) * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1)))
    weighted = stored(
        asked.join(frequency, "term").select("item", "term", (w * F.col("times")).cast("long").alias("weight")),
        "weighted",
    )
    postings = frequency.agg(F.sum("df")).first()[0] or 0
    parts = max(1, min(tasks(spark), index.select("segment").distinct().count()), math.ceil(postings / PART_POSTINGS))
    blocks = max(1, math.ceil(weighted.count() / BLOCK_TERMS))

    part_of = F.pmod(F.xxhash64("segment"), F.lit(parts)).cast("int").alias("part")
    each_part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    each_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    block_of = F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int").alias("block")
    heads = index.where("term is null").select("segment", "term", "payload", part_of, each_block)
    needed = weighted.select("term", block_of).distinct()
    rows = index.where("term is not null").join(needed, "term").select("segment", "term", "payload", part_of, "block")
    left = heads.unionByName(rows)
    right = weighted.select("item", "term", "weight", each_part, block_of)
    found = (
        left.groupBy("part", "block")
        .cogroup(right.groupBy("part", "block"))
        .applyInArrow(_search_part(n_docs, n_words, k), "item long, doc_id long, score long")
    )
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), "doc_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(named.select("item", "item_id"), "item").select(
        "item_id",
        "rank",
        F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"),
        "score",
    )


def search_table(docs: DataFrame, items: DataFrame) -> DataFrame:
    return search(index_documents(docs), items)
