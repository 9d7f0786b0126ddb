"""From raw documents to packed training bins, each stage by one operator.

Every stage takes (spark, docs, folder of the tables) and returns the documents that it keeps, as it
leaves them; ``run`` writes each result under the shared folder and rereads it. The last stage returns
the places of the documents in their bins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from shiftledger.llm.best_fit_packing import pack
from shiftledger.llm.common import stored, table
from shiftledger.llm.decontaminate import contaminated_texts, text_key
from shiftledger.llm.jaccard_join import one_of_each
from shiftledger.llm.language_id import UNKNOWN, identify
from shiftledger.llm.pii_boosting import find, redacted

LEAST_LANGUAGE_SCORE = 0.5


def shielded(docs: DataFrame, names: list[str], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``stage`` of ``docs``, which adds columns of these names: those of ``docs`` are out of its way meanwhile and
    are the only ones in the end."""
    taken = {name: f"__own_{name}" for name in names if name in docs.columns}
    back = {own: name for name, own in taken.items()}
    out = stage(docs.withColumnsRenamed(taken)).drop(*names)
    return out.withColumnsRenamed(back).select(*docs.columns)


def known_language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents whose language is told with a score of at least one half."""

    def known(df: DataFrame) -> DataFrame:
        good = F.col("language.score") >= LEAST_LANGUAGE_SCORE
        return identify(df).where((F.col("language.lang_pred") != UNKNOWN) & good)

    return shielded(docs, ["language"], known)


def distinct_documents(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies."""
    return one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that share no window of words with a benchmark item."""
    found = contaminated_texts(docs, table(spark, folder, "benchmark")).select(F.col("key").alias("__found"))
    return docs.join(found, text_key(F.col("text")) == F.col("__found"), "left_anti")


def without_personal_data(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars follows the text."""

    def clean(df: DataFrame) -> DataFrame:
        seen = find(df).withColumn("text", redacted(F.col("text"), F.col("spans")))
        if "n_chars" in df.columns:
            length = F.when(F.size("spans") > 0, F.char_length("text").cast(df.schema["n_chars"].dataType))
            seen = seen.withColumn("n_chars", F.coalesce(length, F.col("n_chars")))
        return seen

    return shielded(docs, ["base", "spans", "proposed"], clean)


def packed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The place of every piece of every document."""
    return pack(docs)


STAGES = [
    ("language_id", known_language),
    ("jaccard_join", distinct_documents),
    ("decontaminate", without_benchmark),
    ("pii_boosting", without_personal_data),
    ("best_fit_packing", packed),
]

# Trained models and packing have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
