"""Token counts, whitening and ranked search against the library, dense algebra and brute force."""

import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from compare import connect, duck_bag, spark_bag
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shiftledger.llm import common, embedding_whitening, lexical_search, token_counts
from shiftledger.llm.queries import QUERIES, STATEMENTS

SMALL = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, n_bytes string, n_tokens string, item long, term string, score string, part int"


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# Token counts


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


@pytest.fixture(scope="module")
def counter():
    return token_counts.TokenCounter(token_counts.read_vocabulary(VOCABULARY))


def count_of(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


def test_counts_are_the_librarys_on_the_table(spark, library):
    docs = common.table(spark, SMALL, "documents")
    got = {r["doc_id"]: r for r in QUERIES["op11_token_counts"](spark, SMALL).collect()}
    assert len(got) == docs.count()
    for r in docs.collect():
        n = count_of(library, r["text"] or "")
        mine = got[r["doc_id"]]
        assert (mine["n_tokens"], mine["n_bytes"], mine["over_limit"]) == (n, len((r["text"] or "").encode()), n > 1024)


def test_counts_are_the_librarys_on_mixed_pieces(library, counter):
    draw = random.Random(5)
    parts = ["a", "b", "the ", " ", "\n", "\t", "'s", "'", "12", "é", "ß", "中", "\xa0", "\x85", "\x1c", "<|endoftext|>",
             "<|endof", "!!", " ", "😀", "՘", "\U00018E00", "٣", "²", "\x00", "​", "x" * 30, "\r\n"]
    for _ in range(3000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 14)))
        assert counter.of_text(text) == count_of(library, text), repr(text)


def test_every_character_is_classed_as_the_library_does(library, counter):
    characters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(characters), 4096):
        text = "".join(f"a{c}a 1{c}1 !{c}! " for c in characters[at : at + 4096])
        assert counter.of_text(text) == count_of(library, text), hex(at)


def test_long_pieces_and_little_memory(library, counter, monkeypatch):
    long = "ab" * 40_000
    assert counter.of_text(long) == count_of(library, long)
    monkeypatch.setattr(token_counts, "REMEMBERED", 3)
    text = "one two three four five one two three four five " * 5
    fresh = token_counts.TokenCounter(token_counts.read_vocabulary(VOCABULARY))
    assert fresh.of_text(text) == count_of(library, text)
    assert len(fresh.known) <= 3


def test_token_table_of_odd_rows(spark):
    rows = [(1, None), (1, None), (None, ""), (2, "two words"), (2, "two words"), (3, "y" * 300_000)]
    odd = spark.createDataFrame([(i, t, "x", "y", 1, "z", "s", 0) for i, t in rows], DOCS)
    out = token_counts.count_tokens(odd, VOCABULARY, limit=1)
    assert out.columns == odd.columns + ["over_limit"]
    got = rows_of(out.where("length(text) < 100 or text is null"), "doc_id", "n_bytes", "n_tokens", "over_limit")
    two = (2, 9, 2, True)
    assert got == sorted([(1, 0, 0, False)] * 2 + [(None, 0, 0, False), two, two], key=repr)
    assert token_counts.token_table(odd.limit(0), VOCABULARY).count() == 0


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        token_counts.read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))


# Whitening


def dense(matrix):
    """n, deviation and components of whole-number rows, by dense algebra."""
    fit = np.unique(matrix, axis=0)
    n, sums = len(fit), fit.sum(0)
    y = (n * fit - sums) / n
    values, axes = np.linalg.eigh(y.T @ y / n)
    return n, ((n * matrix - sums) ** 2).sum(1), values[::-1], axes[:, ::-1], (n * matrix - sums) / n


def test_whitening_against_dense_algebra(spark):
    pdf = common.table(spark, SMALL, "embeddings").toPandas().sort_values("vec_id")
    x = np.floor(64 * np.stack(pdf["embedding"]).astype(float)).astype(np.int64) + 1_000_000
    n, deviation, values, axes, centred = dense(x)
    out = QUERIES["op12_embedding_whitening"](spark, SMALL).toPandas().sort_values(["vec_id", "component"])
    assert len(out) == 16 * len(pdf) and set(out["n"]) == {n}
    assert (out["deviation"].to_numpy().reshape(-1, 16) == deviation[:, None]).all()
    got = out["whitened"].to_numpy().reshape(-1, 16)
    want = centred @ axes[:, :16] / np.sqrt(values[:16])
    assert np.abs(got * np.sign((got * want).sum(0)) - want).max() < 1e-9
    assert np.allclose(out["explained"].to_numpy()[:16], values[:16] / values.sum(), rtol=1e-10)
    assert out["identity_error"].iloc[0] < 1e-10


@pytest.mark.parametrize("width, decay", [(1, 1.0), (2, 0.5), (30, 0.9), (200, 1.0), (400, 0.98)])
def test_pairs_reach_double_precision(width, decay):
    y = np.random.default_rng(width).standard_normal((3 * width + 5, width)) * decay ** np.arange(width)
    y -= y.mean(0)
    matrix = y.T @ y / len(y)
    values, axes, _ = embedding_whitening.leading_pairs(lambda b: matrix @ b, width, 16)
    want = np.linalg.eigvalsh(matrix)[::-1][:16]
    assert np.abs(values - want).max() < 1e-13 * want[0]
    assert np.abs(matrix @ axes - axes * values).max() < 1e-13 * want[0]
    assert np.abs(axes.T @ axes - np.eye(len(values))).max() < 1e-12


def test_inner_solver_ends_exact_for_small_systems():
    rng = np.random.default_rng(3)
    square = rng.standard_normal((6, 6))
    matrix = square + square.T
    right = rng.standard_normal((6, 2))
    x = embedding_whitening.minres(lambda v: matrix @ v, right, 6)
    assert np.abs(matrix @ x - right).max() < 1e-9
    assert not embedding_whitening.minres(lambda v: matrix @ v, np.zeros((6, 2)), 3).any()


def test_repeated_values_and_missing_directions(spark):
    schema = "vec_id long, embedding array<float>, x string, z string, n string, component string"
    unit = [(i, [float(i == j) for j in range(5)], "", "", "", "") for i in range(5)]
    odd = [
        (9, None, "", "", "", ""),
        (10, [1.0, None, 0.0, 0.0, 0.0], "", "", "", ""),
        (11, [float("nan")] * 5, "", "", "", ""),
        (12, [float("inf")] * 5, "", "", "", ""),
        (4, unit[4][1], "", "", "", ""),
        (None, [1.0], "", "", "", ""),
    ]
    out = embedding_whitening.whiten(spark.createDataFrame(unit + odd, schema)).toPandas()
    # Five corners around their mean: four directions of equal variance, and the fifth has none.
    assert set(out["component"]) == {1, 2, 3, 4} and set(out["n"]) == {5}
    assert len(out) == 4 * 7
    assert np.allclose(out["explained"], 0.25) and out["identity_error"].max() < 1e-10
    assert set(out["vec_id"].dropna().astype(int)) == {0, 1, 2, 3, 4}
    same = spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert embedding_whitening.whiten(same).count() == 0
    assert embedding_whitening.whiten(same.limit(0)).count() == 0


def test_deviation_beyond_64_bits_is_missing():
    y = np.array([[3 * 10**9, 3 * 10**9], [1, 2]], np.int64)
    assert embedding_whitening.squared_length(y) == [None, 5]


# Ranked search


def brute_search(docs, items, k=10):
    texts = [(i, lexical_search.terms((t or "").encode())) for i, t in docs]
    texts = [(i, t) for i, t in texts if t]
    n_docs, n_words = len(texts), sum(len(t) for _, t in texts)
    df = Counter(w for _, t in texts for w in set(t))
    out = []
    for item, text in sorted(set(items), key=repr):
        asked = Counter(lexical_search.terms((text or "").encode()))
        scored = []
        for i, t in texts:
            tf, m = Counter(t), 25 + (75 * len(t) * n_docs) // n_words
            score = 0
            for w, times in asked.items():
                if df[w]:
                    weight = int(np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df[w] + 1))))
                    score += times * weight * ((10**9 * tf[w]) // (1000 * tf[w] + 8 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        for rank, (score, _, _, i) in enumerate(sorted(scored)[:k], 1):
            out.append((item, rank, i, -score))
    return sorted(out, key=repr)


def test_terms():
    assert lexical_search.terms("Don't STOP_É1 ß,x\x00y\x7f中文".encode()) == [
        b"don", b"t", b"stop", "É1".encode(), "ß".encode(), b"x", b"y", "中文".encode()
    ]


def test_search_against_sql_and_brute_force(spark, monkeypatch):
    columns, got = spark_bag(QUERIES["op13_lexical_search"](spark, SMALL))
    assert (columns, got) == duck_bag(connect(SMALL), STATEMENTS["op13_lexical_search"])
    docs, items = (common.table(spark, SMALL, n) for n in ("documents", "benchmark"))
    # Many segments, parts and blocks, and small visits.
    monkeypatch.setattr(lexical_search, "SEGMENT_BYTES", 20_000)
    monkeypatch.setattr(lexical_search, "PART_POSTINGS", 500)
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", 100)
    monkeypatch.setattr(lexical_search, "FIRST_VISIT", 8)
    out = lexical_search.search_table(docs, items)
    want = brute_search(
        [(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()]
    )
    assert rows_of(out, "item_id", "rank", "doc_id", "score") == want


def test_search_of_odd_rows(spark):
    rows = [(i, "alpha beta") for i in range(15)] + [
        (20, None), (21, ""), (22, " ,;"), (None, "gamma gamma"), (23, "gamma " * 50_000), (15, "alpha"), (15, "alpha"), (24, "GAMMA delta É")
    ]
    odd = spark.createDataFrame([(i, t, "a", "b", 1, "t", "s", 3) for i, t in rows], DOCS).repartition(3)
    asked = [(1, "Alpha"), (1, "Alpha"), (1, "gamma delta"), (2, None), (3, "..."), (None, "é É beta"), (4, "absent")]
    items = spark.createDataFrame([(i, t, 5, "x") for i, t in asked], "item_id long, text string, item long, term string")
    out = lexical_search.search_table(odd, items)
    assert rows_of(out, "item_id", "rank", "doc_id", "score") == brute_search(rows, asked)
    for a, b in ((odd.limit(0), items), (odd, items.limit(0))):
        assert lexical_search.search_table(a, b).count() == 0


def test_strata_under_the_bound_are_not_visited():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 500, 4000)
    doc = np.arange(4000)
    part = lexical_search.Part(
        doc * 3, sizes, doc, np.zeros(4000, np.int64), np.minimum(rng.integers(1, 4, 4000), sizes), 4000, int(sizes.sum())
    )
    monkey, lexical_search.FIRST_VISIT = lexical_search.FIRST_VISIT, 16
    ids, scores = part.best(np.array([0]), np.array([1000]), 10)
    lexical_search.FIRST_VISIT = monkey
    assert part.visited < 1000 and len(ids) == 10 and (np.diff(scores) <= 0).all()


def test_a_term_in_every_document_has_weight_and_keeps_order(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("same words here").alias("text"))
    items = spark.createDataFrame([(7, "same")], "item_id long, text string")
    got = rows_of(lexical_search.search_table(docs, items), "item_id", "rank", "doc_id", "score")
    assert got == brute_search([(i, "same words here") for i in range(300)], [(7, "same")])
