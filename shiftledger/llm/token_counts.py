"""Token counts by heap-and-linked-list byte-pair merging.

A text is cut at the vocabulary's added tokens, each of which is one token, and what lies between into
pieces by the byte-level pattern. The bytes of a piece are its first symbols, in a linked list; a heap holds
the rank and place of every adjacent pair that the vocabulary merges. The lowest rank is popped, leftmost
first, until no pair is left. Every merge takes one symbol away, so the count is the number of bytes less
the number of merges: no identifier is ever emitted.

Each piece takes n log n steps, a text of one piece as well. Counts of short pieces are remembered within a
task. The merges are broadcast; their number is that of the vocabulary file.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, functions as F

from shiftledger.llm.common import small_batches

LIMIT = 1024
# Counts of pieces up to so many characters are remembered, at most so many of them.
REMEMBERED_LENGTH = 64
REMEMBERED = 1 << 19

PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# Characters that the vocabulary's library takes as neither letter nor number, although later
# editions of Unicode than its own do.
LATER_THAN_LIBRARY = (
    r"\u0558\u058B\u058C\u088F\u0C5C\u0CDC\u208F\u209D-\u209F\uA7CE\uA7CF\uA7D2\uA7D4\uA7DD\uA7E2\uA7F1"
    r"\uAB6C\uAB6D\U000107BB-\U000107BF\U00010940-\U00010959\U00010EC5-\U00010EC7\U00010ED9-\U00010EEE"
    r"\U00011B0A\U00011DB0-\U00011DDB\U00011DE0-\U00011DE9\U00011DF1\U0001246F\U00012475-\U0001247F"
    r"\U00012550-\U00012686\U00016EA0-\U00016EB8\U00016EBB-\U00016ED3\U00016FF2-\U00016FF6"
    r"\U000187F8-\U000187FF\U00018CD6-\U00018CDA\U00018D09-\U00018D20\U00018D80-\U00018DF2"
    r"\U00018E00-\U00019191\U000191A0-\U000191D2\U0001B123-\U0001B128\U0001B168\U0001D6A6"
    r"\U0001DF1F-\U0001DF24\U0001DF2B-\U0001DF81\U0001DF90-\U0001DF96\U0001DFCD-\U0001DFFF"
    r"\U0001E6C0-\U0001E6DE\U0001E6E0-\U0001E6E2\U0001E6E4\U0001E6E5\U0001E6E7-\U0001E6ED"
    r"\U0001E6F0-\U0001E6F4\U0001E6FE\U0001E6FF\U0002B73A-\U0002B73F\U0002B81E\U0002CEA2-\U0002CEAD"
    r"\U000323B0-\U00033479\U0003D000-\U0003FC3F"
)


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it prints, else
    the next free one from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, free = {}, 256
    for b in range(256):
        if b in prints:
            out[chr(b)] = b
        else:
            out[chr(free)] = b
            free += 1
    return out


def read_vocabulary(path: str) -> dict:
    """Left, right and merged symbol of every merge, symbols numbered, bytes first, and the added tokens.

    Only plain byte-level vocabularies are read: anything that would change the count is an error.
    """
    with open(path, encoding="utf-8") as f:
        source = json.load(f)
    model, cut = source["model"], source["pre_tokenizer"] or {}
    plain = (
        model["type"] == "BPE"
        and source["normalizer"] is None
        and cut.get("type") == "ByteLevel"
        and cut.get("use_regex", True)
        and not cut.get("add_prefix_space")
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    )
    added = source["added_tokens"]
    if not plain or any(a[k] for a in added for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError(f"{path}: no plain byte-level vocabulary")
    number = byte_characters()
    merges = []
    for pair in model["merges"]:
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        merged = number.setdefault(left + right, len(number))
        merges.append((number[left], number[right], merged))
    return {
        "merges": merges,
        "added": sorted((a["content"] for a in added), key=len, reverse=True),
    }


class Merges:
    """The merges in the form that counting asks for them."""

    def __init__(self, merges: list[tuple[int, int, int]]):
        """``merges``: left, right and merged symbol, by rank."""
        none: dict[int, int] = {}
        by_left: dict[int, dict[int, int]] = {}
        for rank, (left, right, _) in enumerate(merges):
            by_left.setdefault(left, {}).setdefault(right, rank)
        symbols = 1 + max(255, *(m for _, _, m in merges)) if merges else 256
        # What gives, for a left symbol, the rank with a right one.
        self.rank_with = [by_left.get(s, none).get for s in range(symbols)]
        self.lefts, self.rights, self.results = (
            [m[i] for m in merges] for i in range(3)
        )

    def count(self, data: bytes) -> int:
        """How many symbols are left of ``data`` when no adjacent pair can be merged any more."""
        n = len(data)
        if n < 2:
            return n
        rank_with, lefts, rights, results = self.rank_with, self.lefts, self.rights, self.results
        symbols = list(data)
        heap = []
        for i in range(n - 1):
            rank = rank_with[symbols[i]](symbols[i + 1])
            if rank is not None:
                heap.append((rank, i))
        if not heap:
            return n
        heapify(heap)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        symbols.append(-1)
        left = n
        while heap:
            rank, i = heappop(heap)
            j = after[i]
            # An entry is stale if either symbol has been merged since.
            if symbols[i] != lefts[rank] or symbols[j] != rights[rank]:
                continue
            merged = symbols[i] = results[rank]
            symbols[j] = -1
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                rank = rank_with[merged](symbols[k])
                if rank is not None:
                    heappush(heap, (rank, i))
            h = before[i]
            if h >= 0:
                rank = rank_with[symbols[h]](merged)
                if rank is not None:
                    heappush(heap, (rank, h))
        return left


class TokenCounter:
    """Counts the tokens of texts; remembers short pieces."""

    def __init__(self, vocabulary: dict):
        self.merges = Merges(vocabulary["merges"])
        added = "|".join(regex.escape(a) for a in vocabulary["added"])
        self.added = regex.compile(added) if added else None
        self.pieces = regex.compile(PIECES.replace("{L}", r"\p{L}").replace("{N}", r"\p{N}"))
        older = lambda kind: rf"[\p{{{kind}}}--[{LATER_THAN_LIBRARY}]]"
        strict = PIECES.replace("{L}", older("L")).replace("{N}", older("N"))
        strict = strict.replace(r"[^\s\p{L}\p{N}]", rf"(?:[^\s\p{{L}}\p{{N}}]|[{LATER_THAN_LIBRARY}])")
        self.strict_pieces = regex.compile(strict, regex.V1)
        self.later = regex.compile(f"[{LATER_THAN_LIBRARY}]")
        self.high = re.compile("[\u0558-\U0010FFFF]")
        self.known: dict[str, int] = {}

    def of_piece(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            n = self.merges.count(piece.encode("utf-8", "surrogatepass"))
            if len(piece) <= REMEMBERED_LENGTH:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[piece] = n
        return n

    def of_text(self, text: str | None) -> int:
        if not text:
            return 0
        parts = self.added.split(text) if self.added else [text]
        total = len(parts) - 1
        for part in parts:
            plain = part.isascii() or not self.high.search(part) or not self.later.search(part)
            pattern = self.pieces if plain else self.strict_pieces
            for piece, times in Counter(pattern.findall(part)).items():
                total += times * self.of_piece(piece)
        return total


def token_count(df: DataFrame, text: Column, vocabulary_path: str) -> Column:
    """The number of tokens of a text column of ``df``; 0 for a missing text."""
    spark = df.sparkSession
    small_batches(spark)
    # Plain tuples: a broadcast is read without this package.
    shared = spark.sparkContext.broadcast(read_vocabulary(vocabulary_path))

    @F.pandas_udf("long")
    def counted(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = TokenCounter(shared.value)
        for texts in parts:
            yield texts.map(counter.of_text, na_action=None).astype("int64")

    return counted(F.coalesce(text.cast("string"), F.lit("")))


def count_tokens(docs: DataFrame, vocabulary_path: str, limit: int = LIMIT) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit (more than ``limit`` tokens).

    A missing text counts as empty: no bytes, no tokens. Every row is counted by itself, so repeated rows and
    ids are rows of the result; an empty table gives an empty table. Columns of ``docs`` that have one of the
    three names are replaced, all others stay.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    n_tokens = token_count(docs, F.col("text"), vocabulary_path)
    return docs.withColumns(
        {"n_bytes": F.octet_length(text).cast("long"), "n_tokens": n_tokens}
    ).withColumn("over_limit", F.col("n_tokens") > limit)


def token_table(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit."""
    rows = docs.select("doc_id", "text")
    return count_tokens(rows, vocabulary_path).select("doc_id", "n_bytes", "n_tokens", "over_limit")
