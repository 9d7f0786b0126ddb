"""Quality scores by nearest-neighbour voting in a latent space.

Texts become counts of hashed byte pairs plus a few marks of form, damped, weighted by rarity and
scaled to length 1. The leading singular vectors of a bounded labelled sample span the latent space. The
sample's vectors are broadcast (their number is a parameter); every document's cosine with each of
them is computed in blocks, and the labels of the nearest ones vote, weighted by similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from shiftledger.llm.common import Rolling, crc_of_id, small_batches

TERMS = 2048
FORM = 8
LATENT = 32
# The labelled sample holds at most so many documents of each label.
SAMPLE_PER_LABEL = 1500
NEIGHBOURS = 25
SHARPNESS = 8
THRESHOLD = 0.3
BLOCK = 1024

_PAIR = ((np.arange(65536, dtype=np.uint64) * np.uint64(2654435761)) >> np.uint64(7)).astype(
    np.int64
) % TERMS
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _forms(data: np.ndarray) -> np.ndarray:
    """Marks of form: repeated stretches, letter case, spaces, signs, digits, length."""
    n = len(data)
    grams = Rolling(data).all_of_length(8)
    distinct = len(np.unique(grams)) / max(len(grams), 1)
    share = lambda mask: np.count_nonzero(mask) / max(n, 1)
    upper = share((data >= 65) & (data <= 90))
    lower = share((data >= 97) & (data <= 122))
    space = share(_SPACE[data])
    digit = share((data >= 48) & (data <= 57))
    sign = max(0.0, share(data < 128) - upper - lower - space - digit)
    return np.array(
        [1 - distinct, upper, space, digit, sign, min(1.0, n / 100), min(1.0, n / 2000), 0.2]
    )


def terms(texts: list[str | None]) -> np.ndarray:
    """Damped counts of the whole of each text, a row per text."""
    out = np.zeros((len(texts), TERMS + FORM), np.float32)
    for i, text in enumerate(texts):
        data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
        if len(data) > 1:
            pairs = data[:-1].astype(np.int64) << 8
            pairs |= data[1:]
            counts = np.bincount(_PAIR[pairs], minlength=TERMS)
            out[i, :TERMS] = np.sqrt(counts / (len(data) - 1))
        if len(data):
            out[i, TERMS:] = _forms(data)
    return out


class LatentVotes:
    """Labelled vectors in the latent space and the vote over them."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, totals: tuple[int, int]):
        """``totals``: how many documents of label 0 and 1 the sample stands for."""
        present = (x[:, :TERMS] > 0).sum(0)
        self.weight = np.ones(x.shape[1], np.float32)
        self.weight[:TERMS] = np.log((1 + len(x)) / (1 + present)) + 0.1
        self.weight[TERMS:] = 2.0
        self.basis = np.zeros((x.shape[1], 0), np.float32)
        self.labels = labels.astype(np.float64)
        n = np.bincount(labels, minlength=2) if len(labels) else np.zeros(2)
        each = [totals[c] / n[c] if n[c] else 0.0 for c in (0, 1)]
        self.votes = np.where(self.labels == 1, each[1], each[0])
        all_ = sum(totals)
        self.prior = totals[1] / all_ if all_ else 0.5
        if len(x):
            scaled = self._scaled(x)
            values, vectors = np.linalg.eigh((scaled.T @ scaled).astype(np.float64))
            keep = vectors[:, ::-1][:, :LATENT][:, values[::-1][:LATENT] > 1e-9]
            self.basis = keep.astype(np.float32)
        self.vectors = self.latent(x)

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        y = x * self.weight
        return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-9)

    def latent(self, x: np.ndarray) -> np.ndarray:
        y = self._scaled(x) @ self.basis
        return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-9)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Share of label 1 among the votes; the sample's share where there is nothing to compare."""
        out = np.full(len(x), self.prior)
        if not len(self.vectors) or not self.basis.shape[1]:
            return out
        k = min(NEIGHBOURS, len(self.vectors))
        for at in range(0, len(x), BLOCK):
            part = self.latent(x[at : at + BLOCK])
            cosine = part @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            w = np.clip(np.take_along_axis(cosine, near, 1).astype(np.float64), 0, 1) ** SHARPNESS
            w *= self.votes[near]
            total = w.sum(1)
            voted = (w * self.labels[near]).sum(1) / np.maximum(total, 1e-300)
            some = (total > 0) & (np.abs(part).sum(1) > 0)
            out[at : at + BLOCK][some] = voted[some]
        return np.clip(out, 0.0, 1.0)


def learned_from() -> "F.Column":
    return F.pmod(crc_of_id(), F.lit(5)) != 0


def fit(docs: DataFrame, labels: DataFrame) -> LatentVotes:
    """Learns from labelled rows whose id's crc32 leaves a remainder by 5.

    The sample is the rows with the smallest hashes of each label, up to the bound. An id with more
    than one label counts as 1 if any of them is 1. Texts are read and counted on the executors; the
    driver receives the bounded sample's counts.
    """
    marks = (
        labels.where(F.col("quality").isin(0, 1) & learned_from())
        .groupBy("doc_id")
        .agg(F.max("quality").cast("int").alias("quality"))
    )
    totals = {r["quality"]: r["count"] for r in marks.groupBy("quality").count().collect()}
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    picked = None
    for label in (0, 1):
        bound = min(1 << 30, int(1.2 * SAMPLE_PER_LABEL * (1 << 30) / max(totals.get(label, 0), 1)))
        part = marks.where((F.col("quality") == label) & (draw <= bound))
        part = part.select("doc_id", "quality").orderBy(draw, "doc_id").limit(SAMPLE_PER_LABEL)
        picked = part if picked is None else picked.unionByName(part)
    # At most two bounded samples of ids.
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")

    def counted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            x = terms(pdf["text"].tolist())
            yield pd.DataFrame(
                {
                    "doc_id": pdf["doc_id"],
                    "quality": pdf["quality"],
                    "x": [row.tobytes() for row in x],
                }
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = (
        rows.mapInPandas(counted, f"doc_id {kind}, quality int, x binary")
        .orderBy("doc_id", "x")
        .limit(2 * SAMPLE_PER_LABEL)
        .collect()
    )
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in found), np.float32)
    y = np.array([r["quality"] for r in found], np.int64)
    return LatentVotes(
        x.reshape(len(found), TERMS + FORM), y, (totals.get(0, 0), totals.get(1, 0))
    )


def score(docs: DataFrame, model: LatentVotes) -> DataFrame:
    """``docs`` with ``score``; the text alone decides. Missing texts count as empty."""
    small_batches(docs.sparkSession)
    # Plain arrays: a broadcast is read without this package.
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    @F.pandas_udf("double")
    def votes(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = object.__new__(LatentVotes)
        m.__dict__.update(shared.value)
        for texts in parts:
            values = texts.tolist()
            found = [m.score(terms(values[a : a + BLOCK])) for a in range(0, len(values), BLOCK)]
            yield pd.Series(np.concatenate(found) if found else np.zeros(0))

    return docs.withColumn("score", votes(F.coalesce("text", F.lit(""))))


def quality_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted. A missing id is neither held out nor learned from."""
    model = fit(docs, labels)
    held = F.coalesce(F.pmod(crc_of_id(), F.lit(5)) == 0, F.lit(False))
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id",
        held.alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
