"""Language identification by a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are cut into windows of ``WINDOW`` bytes. Two gated recurrent layers read each
window, one forwards and one backwards; at every byte a softmax over both states labels the position.
A document's probabilities are the mean over all its positions. The network is trained here, in numpy,
by backpropagation through time on a bounded sample of labelled windows; each position's target is its
document's language. Scoring runs in Arrow batches over whole texts with the small weights alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from shiftledger.llm.common import crc_of_id, small_batches

WINDOW = 64
BATCH_WINDOWS = 2048
# The training sample: so many documents of each language, one slice of each.
SAMPLE_DOCS = 500
SAMPLE_CHARS = 256
# A small sample is gone through more often, so that training takes so many steps.
LEAST_STEPS = 160
UNKNOWN = "und"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.multiply(x, 0.5, out=x)
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


@dataclass
class Direction:
    """One gated recurrent layer: ``inputs`` has the input part of all gates for each byte."""

    inputs: np.ndarray  # 256 x 3H: update gate, reset gate, candidate
    states: np.ndarray  # H x 3H

    def run(self, bytes_: np.ndarray, keep: bool = False):
        """States after each step, (steps, windows, H), and what the backward pass needs."""
        steps, n = bytes_.shape
        size = self.states.shape[0]
        h = np.zeros((n, size), np.float32)
        out = np.empty((steps, n, size), np.float32)
        tape = []
        for t in range(steps):
            x = self.inputs[bytes_[t]]
            u = h @ self.states
            gates = _sigmoid(x[:, : 2 * size] + u[:, : 2 * size])
            z, r = gates[:, :size], gates[:, size:]
            c = r * u[:, 2 * size :]
            c += x[:, 2 * size :]
            np.tanh(c, out=c)
            if keep:
                tape.append((h, z, r, c, u[:, 2 * size :]))
            h = c + z * (h - c)
            out[t] = h
        return out, tape

    def learn(self, bytes_: np.ndarray, tape: list, d_out: np.ndarray):
        """Gradients of both weight tables by backpropagation through time."""
        steps, n = bytes_.shape
        size = self.states.shape[0]
        d_states = np.zeros_like(self.states)
        d_x = np.empty((steps, n, 3 * size), np.float32)
        d_h = np.zeros((n, size), np.float32)
        for t in range(steps - 1, -1, -1):
            before, z, r, c, u = tape[t]
            d = d_h + d_out[t]
            d_c = d * (1 - z) * (1 - c * c)
            d_z = d * (before - c) * z * (1 - z)
            d_r = d_c * u * r * (1 - r)
            d_x[t] = np.concatenate([d_z, d_r, d_c], 1)
            d_u = np.concatenate([d_z, d_r, d_c * r], 1)
            d_states += before.T @ d_u
            d_h = d * z + d_u @ self.states.T
        seen = np.eye(256, dtype=np.float32)[bytes_.ravel()]
        return seen.T @ d_x.reshape(steps * n, -1), d_states


class ByteNetwork:
    """Both directions and the softmax over their states."""

    def __init__(self, languages: list[str], size: int = 10, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        draw = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
        self.ways = [
            Direction(draw(256, 3 * size, by=0.3), draw(size, 3 * size, by=size**-0.5))
            for _ in range(2)
        ]
        self.out = draw(2 * size, len(languages), by=0.3)
        self.bias = np.zeros(len(languages), np.float32)

    def weights(self) -> list[np.ndarray]:
        return [w for d in self.ways for w in (d.inputs, d.states)] + [self.out, self.bias]

    def positions(self, windows: np.ndarray) -> np.ndarray:
        """Language probabilities of every position, (windows, steps, languages)."""
        return self._forward(np.ascontiguousarray(windows.T))[0].transpose(1, 0, 2)

    def _forward(self, steps: np.ndarray, keep: bool = False):
        ahead, tape_a = self.ways[0].run(steps, keep)
        back, tape_b = self.ways[1].run(steps[::-1], keep)
        back = back[::-1]
        size = ahead.shape[2]
        y = ahead.reshape(-1, size) @ self.out[:size]
        y += back.reshape(-1, size) @ self.out[size:]
        y += self.bias
        y -= y.max(1, keepdims=True)
        np.exp(y, out=y)
        y /= y.sum(1, keepdims=True)
        return y.reshape(*steps.shape, -1), (ahead, back, tape_a, tape_b)

    def gradients(self, windows: np.ndarray, lengths: np.ndarray, labels: np.ndarray):
        """Mean cross-entropy over the positions in use, and its gradient in each weight table."""
        steps = np.ascontiguousarray(windows.T)
        y, (ahead, back, tape_a, tape_b) = self._forward(steps, keep=True)
        used = np.arange(steps.shape[0])[:, None] < lengths[None, :]
        total = max(int(used.sum()), 1)
        which = np.arange(len(labels))
        loss = -np.log(np.maximum(y[:, which, labels], 1e-12))[used].sum() / total
        d = y.copy()
        d[:, which, labels] -= 1
        d *= used[:, :, None] / np.float32(total)
        size = ahead.shape[2]
        flat = d.reshape(-1, d.shape[2])
        d_out = np.concatenate(
            [ahead.reshape(-1, size).T @ flat, back.reshape(-1, size).T @ flat]
        )
        d_ahead = (flat @ self.out[:size].T).reshape(ahead.shape)
        d_back = (flat @ self.out[size:].T).reshape(back.shape)
        grads = [*self.ways[0].learn(steps, tape_a, d_ahead)]
        grads += self.ways[1].learn(steps[::-1], tape_b, d_back[::-1])
        return loss, [*grads, d_out, flat.sum(0)]

    def fit(self, windows, lengths, labels, epochs: int = 8, batch: int = 256, rate: float = 0.02):
        """Adam over shuffled batches with a falling rate; the same input gives the same weights."""
        rng = np.random.default_rng(11)
        weights = self.weights()
        first, second = ([np.zeros_like(w) for w in weights] for _ in range(2))
        each = max(1, -(-len(windows) // batch))
        epochs = max(epochs, -(-LEAST_STEPS // each))
        step, steps = 0, epochs * each
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for at in range(0, len(order), batch):
                pick = order[at : at + batch]
                _, grads = self.gradients(windows[pick], lengths[pick], labels[pick])
                norm = float(np.sqrt(sum((g * g).sum() for g in grads)))
                step += 1
                lr = rate * (1 - step / (steps + 1))
                for w, g, a, b in zip(weights, grads, first, second):
                    g = g * min(1.0, 1.0 / max(norm, 1e-9))
                    a += 0.1 * (g - a)
                    b += 0.01 * (g * g - b)
                    w -= lr * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
        return self

    def documents(self, texts: list[str | None]) -> np.ndarray:
        """Mean of the position probabilities over the whole of each text; zeros for empty ones.

        Windows of many texts are scored together and what is in memory at once is bounded.
        """
        out = np.zeros((len(texts), len(self.languages)))
        held: list[tuple[int, np.ndarray]] = []
        count = 0

        def flush():
            if not held:
                return
            windows = np.zeros((count, WINDOW), np.uint8)
            lengths, owner, at = np.empty(count, np.int64), np.empty(count, np.int64), 0
            for doc, data in held:
                k = -(-len(data) // WINDOW)
                windows[at : at + k].reshape(-1)[: len(data)] = data
                lengths[at : at + k] = WINDOW
                lengths[at + k - 1] = len(data) - (k - 1) * WINDOW
                owner[at : at + k] = doc
                at += k
            for a in range(0, count, BATCH_WINDOWS):
                part = slice(a, a + BATCH_WINDOWS)
                y = self._forward(np.ascontiguousarray(windows[part].T))[0]
                y *= (np.arange(WINDOW)[:, None] < lengths[part][None, :])[:, :, None]
                np.add.at(out, owner[part], y.sum(0))
            held.clear()

        sizes = np.zeros(len(texts))
        for i, text in enumerate(texts):
            if not text:
                continue
            data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
            sizes[i] = len(data)
            for at in range(0, len(data), 1 << 22):
                piece = data[at : at + (1 << 22)]
                held.append((i, piece))
                count += -(-len(piece) // WINDOW)
                if count >= 8 * BATCH_WINDOWS:
                    flush()
                    count = 0
        flush()
        return out / np.maximum(sizes, 1)[:, None]


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def training_windows(docs: DataFrame):
    """Sample of labelled slices, bounded for each language: byte windows, lengths, label numbers and languages.

    Learns from rows with a language, a letter and an id whose crc32 leaves no remainder 1 by 3.
    """
    labelled = docs.where(
        F.col("lang").isNotNull() & (F.pmod(crc_of_id(), F.lit(3)) != 1) & has_letter(F.col("text"))
    )
    counts = (
        docs.where(F.col("lang").isNotNull() & (F.pmod(crc_of_id(), F.lit(3)) != 1))
        .groupBy("lang")
        .count()
        .orderBy("lang")
        .collect()
    )
    empty = (np.zeros((0, WINDOW), np.uint8), np.zeros(0, int), np.zeros(0, int), [])
    if not counts:
        return empty
    share = F.create_map(
        *[x for r in counts for x in (F.lit(r["lang"]), F.lit(2.0 * SAMPLE_DOCS / r["count"]))]
    )
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / F.lit(1 << 30)
    room = F.greatest(F.char_length("text") - SAMPLE_CHARS, F.lit(0)) + 1
    start = F.pmod(F.xxhash64("text"), room).cast("int") + 1
    rows = (
        labelled.where(draw < F.element_at(share, F.col("lang")))
        .select(
            "lang", F.substring("text", start, F.lit(SAMPLE_CHARS)).alias("slice"), draw.alias("d")
        )
        .withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("d", "slice")))
        .where(F.col("n") <= SAMPLE_DOCS)
        .orderBy("d", "slice", "lang")
        .collect()
    )
    languages = sorted({r["lang"] for r in rows})
    number = {lang: i for i, lang in enumerate(languages)}
    windows, lengths, labels = [], [], []
    for r in rows:
        data = np.frombuffer(r["slice"].encode("utf-8", "surrogatepass"), np.uint8)
        for at in range(0, len(data), WINDOW):
            piece = data[at : at + WINDOW]
            windows.append(np.pad(piece, (0, WINDOW - len(piece))))
            lengths.append(len(piece))
            labels.append(number[r["lang"]])
    if not windows:
        return empty
    return np.array(windows, np.uint8), np.array(lengths), np.array(labels), languages


def train(docs: DataFrame) -> ByteNetwork:
    windows, lengths, labels, languages = training_windows(docs)
    network = ByteNetwork(languages)
    if len(languages) > 1:
        network.fit(windows, lengths, labels)
    return network


def identify(docs: DataFrame, network: ByteNetwork | None = None) -> DataFrame:
    """``docs`` with ``language`` (struct of lang_pred, score) from the text alone.

    A text that is missing or has no letter is ``und`` with score 0, and so is every text when nothing
    could be learned. Ties between languages go to the first in order of name. Other columns stay.
    """
    small_batches(docs.sparkSession)
    network = network or train(docs)
    known = network.languages

    @F.pandas_udf("struct<lang_pred string, score double>")
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            y = network.documents(texts.tolist())
            best = y.argmax(1)
            yield pd.DataFrame(
                {
                    "lang_pred": [known[b] for b in best],
                    "score": np.clip(y[np.arange(len(best)), best], 0.0, 1.0),
                }
            )

    nothing = F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    if not known:
        return docs.withColumn("language", nothing)
    found = predict(F.col("text"))
    letters = docs.withColumn("language", found)
    return letters.withColumn(
        "language", F.when(has_letter(F.col("text")), F.col("language")).otherwise(nothing)
    )


def language_table(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score. A missing id is neither held out nor learned from."""
    held = F.coalesce(F.pmod(crc_of_id(), F.lit(3)) == 1, F.lit(False))
    network = train(docs)
    return identify(docs.select("doc_id", "text"), network).select(
        "doc_id",
        held.alias("held_out"),
        F.col("language.lang_pred").alias("lang_pred"),
        F.col("language.score").alias("score"),
    )
