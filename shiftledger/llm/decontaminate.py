"""Benchmark decontamination by winnowing, with DataFrame functions only.

Words are runs of digits, letters a to z and non-ASCII characters after A-Z is lower-cased. Of every
``SPAN - K + 1`` neighbouring hashes of K words the smallest is a fingerprint (the last of equal ones).
A shared span of SPAN words holds one such neighbourhood on either side, so both sides pick the same
fingerprint from it: no shared span is missed. Fingerprints of documents and benchmark are joined, hits
are extended to the windows of SPAN words around them, and those are compared word by word.

Items of fewer than SPAN words are one window each; documents offer all their runs of those lengths,
and only lengths that occur are looked at.

Work is done once per distinct text. Hits are keyed by text, so a text that many rows share is counted
before it is shuffled.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from shiftledger.llm.common import stored

SPAN = 10
K = 6
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    """A-Z in lower case and nothing else changed."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def words(text: Column) -> Column:
    """The words of a text; an empty array for a missing one."""
    parts = F.split(lowered(F.coalesce(text, F.lit(""))), GAPS)
    return F.filter(parts, lambda w: w != "")


def _starts(count: Column, length: int) -> Column:
    """0 .. count - length; empty if there are not so many words."""
    return F.when(count >= length, F.sequence(F.lit(0), count - length)).otherwise(
        F.array().cast("array<int>")
    )


def fingerprints(hashes: Column, count: Column) -> Column:
    """(hash, position) of the winnowed K-grams, given the hashes of the words."""
    grams = F.transform(
        _starts(count, K), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(K)])
    )
    reach = SPAN - K + 1

    def pick(g: Column) -> Column:
        def at(i: Column) -> Column:
            least = F.least(*[F.get(g, i + j) for j in range(reach)])
            choice = F
            for j in range(reach - 1, -1, -1):
                choice = choice.when(F.get(g, i + j) == least, i + j)
            return choice

        places = F.array_distinct(
            F.transform(_starts(F.size(g), reach), at)
        )
        return F.transform(places, lambda p: F.struct(F.get(g, p).alias("h"), p.alias("p")))

    return F.element_at(F.transform(F.array(grams), pick), 1)


def with_neighbours(marks: Column, column: str) -> Column:
    """Fingerprints with the words around them in which every window of SPAN words over them lies."""
    before = lambda m: F.greatest(m["p"] - (SPAN - K), F.lit(0))
    return F.transform(
        marks,
        lambda m: F.struct(
            m["h"].alias("h"),
            before(m).alias("s"),
            F.array_join(F.slice(F.col(column), before(m) + 1, m["p"] + SPAN - before(m)), " ").alias("ws"),
        ),
    )


def windows(column: str, starts: Column, length: int) -> Column:
    """(start, words of the window as one text) at the given starts."""
    return F.transform(
        starts,
        lambda i: F.struct(
            i.alias("s"), F.array_join(F.slice(F.col(column), i + 1, length), " ").alias("w")
        ),
    )


def covered(spans: Column) -> Column:
    """How many words sorted, distinct (start, end) spans cover together."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    return F.aggregate(
        spans,
        zero,
        lambda acc, x: F.struct(
            (acc["n"] + F.greatest(x["e"] - F.greatest(x["s"], acc["to"]), F.lit(0))).alias("n"),
            F.greatest(acc["to"], x["e"]).alias("to"),
        ),
        lambda acc: acc["n"],
    )


def text_key(text: Column) -> Column:
    """Names a text; NULL for a missing one."""
    return F.md5(text.cast("binary"))


def contaminated_texts(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """key, n_hit, n_items, items: one row per distinct text that shares a window with an item."""
    items = stored(        benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("ws"))
        .withColumn("n", F.size("ws"))
        .where("n > 0"),
        "items",
    )
    text = docs.select(text_key(F.col("text")).alias("key"), words(F.col("text")).alias("ws"))

    hashed = lambda df: df.withColumns(
        {"hs": F.transform("ws", lambda w: F.xxhash64(w)), "n": F.size("ws")}
    )
    marks = lambda df: F.explode(fingerprints(F.col("hs"), F.col("n")))

    # Written small tables: Spark knows their size and chooses the join.
    long_items = items.where(F.col("n") >= SPAN)
    known = stored(
        hashed(long_items).select(marks(None).alias("m")).select(F.col("m.h").alias("h")).distinct(),
        "known",
    )
    lengths = [r["n"] for r in items.where(F.col("n") < SPAN).select("n").distinct().collect()]
    window_of = stored(
        long_items.select(
            "item", F.explode(windows("ws", _starts(F.col("n"), SPAN), SPAN)).alias("x")
        )
        .select("item", F.col("x.w").alias("w"))
        .unionByName(
            items.where(F.col("n") < SPAN).select("item", F.array_join("ws", " ").alias("w"))
        )
        .distinct(),
        "windows",
    )
    texts_of_windows = window_of.select("w").distinct()

    # One scan of the texts. Fingerprints carry the words around them, so that those which the
    # benchmark has too are extended without reading the texts again.
    near = (
        hashed(text)
        .select(
            "key",
            F.explode(with_neighbours(fingerprints(F.col("hs"), F.col("n")), "ws")).alias("m"),
        )
        .select("key", F.col("m.h").alias("h"), F.col("m.s").alias("first"), F.col("m.ws").alias("near"))
        .join(known, "h")
        .select("key", "first", F.split("near", " ").alias("ws"))
    )
    found = near.select(
        "key",
        "first",
        F.explode(windows("ws", _starts(F.size("ws"), SPAN), SPAN)).alias("x"),
        F.lit(SPAN).alias("length"),
    ).select(
        "key",
        F.struct((F.col("first") + F.col("x.s")).alias("s"), F.col("x.w").alias("w")).alias("x"),
        "length",
    )
    for length in sorted(lengths):
        found = found.unionByName(
            text.select(
                "key",
                F.explode(windows("ws", _starts(F.size("ws"), length), length)).alias("x"),
                F.lit(length).alias("length"),
            )
        )
    hits = stored(
        found.select("key", F.col("x.s").alias("s"), F.col("x.w").alias("w"), "length")
        .join(texts_of_windows, "w")
        .distinct(),
        "hits",
    )
    spans = hits.groupBy("key").agg(
        F.array_sort(
            F.collect_set(F.struct("s", (F.col("s") + F.col("length")).alias("e")))
        ).alias("spans")
    )
    named = (
        hits.select("key", "w")
        .distinct()
        .join(window_of, "w")
        .where("item is not null")
        .groupBy("key")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    return stored(
        spans.join(named, "key", "left").select(
            "key",
            covered(F.col("spans")).cast("long").alias("n_hit"),
            F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
            F.coalesce(F.array_join("items", ","), F.lit("")).alias("items"),
        ),
        "summary",
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, key, n_words, n_hit, n_items, items_sha256, contaminated, one row per row of ``docs``.

    ``key`` names the text. A missing text has no words, so no hit; the hash of no items is that of
    the empty string. Items without words match nothing; repeated items count once, repeated item
    ids of different texts each match by their own text and are listed once. Items without an id
    match, and are left out of counts and lists of items. Empty tables on either side give no hits.
    Other columns are left aside.
    """
    summary = contaminated_texts(docs, benchmark)
    text = docs.select(
        "doc_id",
        text_key(F.col("text")).alias("key"),
        F.size(words(F.col("text"))).cast("long").alias("n_words"),
    )
    return text.join(summary, "key", "left").select(
        "doc_id",
        "key",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")).cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def contamination_table(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return decontaminate(docs, benchmark).drop("key")
