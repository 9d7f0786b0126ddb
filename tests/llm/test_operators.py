"""Every operator on small tables: brute force, and nulls, empty texts, ties, copies and empty tables."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from compare import connect, duck_bag, spark_bag

from shiftledger.llm import (
    best_fit_packing,
    common,
    decontaminate,
    hilbert_shards,
    jaccard_join,
    language_id,
    pii_boosting,
    quality_neighbours,
    sentence_spans,
    suffix_dedup,
    topk_search,
)
from shiftledger.llm.queries import QUERIES, STATEMENTS

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, key string"
PASSAGE = " ".join(f"word{i}" for i in range(60))
ROWS = [
    (1, f"One two. Three four! {PASSAGE}. End of it.", "en", "a", 1, "x", "y"),
    (2, f"Other start here. {PASSAGE}. Nothing.", "en", "a", 1, None, None),
    (2, f"Other start here. {PASSAGE}. Nothing.", "en", "a", 1, None, None),
    (3, None, None, None, None, None, None),
    (4, "", "en", "b", 0, None, None),
    (5, " \n\t ", None, "b", 3, None, None),
    (None, f"{PASSAGE}", "de", None, 5, None, None),
    (6, "+1 (269) 555-3296 or joe.doe@mail.example.com at 10.0.0.255", "en", "b", 5, None, None),
    (7, "z" * 20_000, "fr", "c", 5, None, None),
    (8, "é ü 4111 1111 1111 1111 ñ " + "long text " * 3000, "fr", "c", 5, None, None),
    (9, " ".join(f"word{i}" for i in range(2, 60)), "en", "a", 5, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def table(spark, name):
    return common.table(spark, SMALL, name)


def test_registered_queries_have_the_operators_numbers():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_against_sql(spark, name):
    columns, got = spark_bag(QUERIES[name](spark, SMALL))
    assert (columns, got) == duck_bag(connect(SMALL), STATEMENTS[name])


# Language identification


def test_gradients_are_right():
    net = language_id.ByteNetwork(["a", "b"], size=3)
    for d in net.ways:
        d.inputs, d.states = d.inputs.astype(np.float64), d.states.astype(np.float64)
    x = np.random.default_rng(1).integers(0, 256, (4, 6)).astype(np.uint8)
    args = (x, np.array([6, 5, 3, 6]), np.array([0, 1, 0, 1]))
    _, grads = net.gradients(*args)
    for w, g in zip(net.weights(), grads):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = w[at]
        w[at] = old + 1e-2
        up = net.gradients(*args)[0]
        w[at] = old - 1e-2
        down = net.gradients(*args)[0]
        w[at] = old
        assert abs((up - down) / 2e-2 - g[at]) < 0.05 * abs(g[at]) + 1e-3


def test_language_of_held_out_documents(spark, odd, empty):
    docs = table(spark, "documents")
    rows = language_id.language_table(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.9 * len(held)
    got = language_id.language_table(odd).collect()
    assert len(got) == len(ROWS)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (3, 4, 5)} == {"und"}
    assert language_id.language_table(empty).count() == 0


def test_every_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE_DOCS", 3)
    rows = [(i, f"text number {i}", f"l{i % 80:02}") for i in range(1600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    windows, lengths, labels, languages = language_id.training_windows(docs)
    assert languages == [f"l{i:02}" for i in range(80)]
    assert set(labels) == set(range(80)) and max(Counter(labels.tolist()).values()) <= 3


# Sharding


def test_curve_visits_neighbours(spark):
    cells = spark.range(512).selectExpr("id div 64 x", "(id div 8) % 8 y", "id % 8 z")
    at = hilbert_shards.curve_index([cells["x"], cells["y"], cells["z"]], 3)
    rows = sorted((r["c"], r["x"], r["y"], r["z"]) for r in cells.withColumn("c", at).collect())
    assert [r[0] for r in rows] == list(range(512))
    assert all(sum(abs(p - q) for p, q in zip(a[1:], b[1:])) == 1 for a, b in zip(rows, rows[1:]))


def test_shards_are_even_and_gapless(spark, odd, empty):
    for docs in (table(spark, "documents"), odd):
        rows = hilbert_shards.shard_documents(docs).collect()
        assert len(rows) == docs.count()
        sizes = Counter(r["shard"] for r in rows)
        counts = [sizes[s] for s in range(8)]
        assert max(counts) - min(counts) <= 1
        for s, n in sizes.items():
            assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n))
    assert hilbert_shards.shard_documents(empty).count() == 0


# Personal data

_BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _holds(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        twice = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
        return 14 <= len(digits) <= 19 and sum(t - 9 * (t > 9) for t in twice) % 10 == 0
    return kind != "phone" or 10 <= len(digits) <= 15


def _spans(text):
    found = [
        (m.start(), i, m.end(), k)
        for i, (k, p) in enumerate(_BASE.items())
        for m in re.finditer(p, text or "")
        if _holds(k, m.group())
    ]
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(found))


def test_base_spans(spark, odd, empty):
    hard = [
        "a@b.c_d@e.f x@y a@b@c.d",
        "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0255",
        "4111 1111 1111 1111 4111-1111-1111-1111  4111111111111111x5",
        "+1 (269) 555-3296 4524132264652876 and +44 20 7946 0958.",
        "1 " * 3000,
        "a" * 5000 + "@",
        "1-2-3" * 800,
    ]
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(hard)], "doc_id long, text string")
    docs = odd.select("doc_id", "text").unionByName(more)
    want = Counter(
        (r["doc_id"], hashlib.sha256(_spans(r["text"]).encode()).hexdigest()) for r in docs.collect()
    )
    got = pii_boosting.pii_table(docs).collect()
    assert Counter((r["doc_id"], r["base_sha256"]) for r in got) == want
    assert pii_boosting.pii_table(empty).count() == 0


def test_redaction(spark):
    docs = spark.createDataFrame([("mail a@b.cd, ip 1.2.3.4!",), (None,), ("clean",)], "text string")
    seen = pii_boosting.find(docs, pii_boosting.Boosted({}, {}))
    text = pii_boosting.redacted(seen["text"], seen["spans"])
    got = {r[0] for r in seen.select(text).collect()}
    assert got == {"mail [EMAIL], ip [IP]!", None, "clean"}


# Repeated spans and strings


def _brute_bytes(rows):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - 49 if i is not None else 0):
            k = b[s : s + 50]
            first[k] = min(first.get(k, i), i)
    out = Counter()
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 49 if i is not None else 0):
            if first[b[s : s + 50]] < i:
                gone[s : s + 50] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out[(i, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())] += 1
    return out


@pytest.mark.parametrize("crowded", [50_000, 2])
def test_repeated_bytes(spark, odd, empty, crowded, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CROWDED", crowded)
    for docs in (odd, table(spark, "documents").limit(120)):
        rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = suffix_dedup.suffix_table(docs).collect()
        assert Counter(tuple(r) for r in got) == _brute_bytes(rows)
    assert suffix_dedup.suffix_table(empty).count() == 0


def test_contexts_that_agree_in_32_bits_are_told_apart():
    token = np.full(3, 9 << 40, np.uint64)
    context = np.array([5, 5 + (1 << 32), 5], np.uint64)
    ids, keys = np.array([1, 2, 3]), np.array([10, 20, 30])
    batch = suffix_dedup._anchor_rows(4, token, context, ids, keys, np.arange(3), np.array([40, 41, 42]))
    found = {1: [], 2: []}
    for b in suffix_dedup._settle(1, 50_000)(iter([batch])):
        for kind, p in zip(b.column("kind").to_pylist(), b.column("payload").to_pylist()):
            rk, at, _ = suffix_dedup.unpack(p, suffix_dedup._MARK)
            found[kind] += zip(rk.tolist(), at.tolist())
    assert found[1] == [(30, 42)]
    assert sorted(found[2]) == [(10, 40), (20, 41)]


def test_sentence_spans(spark, odd, empty):
    body = " ".join(f"Sentence number {i} has some words in it." for i in range(8))
    rows = [(1, f"Start one. {body}"), (2, f"Begin two! {body} End."), (3, "Alone it stands."), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in sentence_spans.drop_repeated_spans(docs).collect()}
    assert got[1]["n_removed"] == 0 and got[1]["text"] == rows[0][1]
    assert got[2]["n_removed"] == 8 and got[2]["text"] == "Begin two! End."
    assert got[3]["text"] == rows[2][1] and got[4]["text"] is None
    assert sentence_spans.span_table(odd).count() == len(ROWS)
    assert sentence_spans.span_table(empty).count() == 0


def _words(name, n):
    return " ".join(f"{name}{i}" for i in range(n))


def _kept_of_second(spark, passage, head="Start here. ", tail=" End here."):
    rows = [(1, f"Alpha one. {passage} Omega one."), (2, f"{head}{passage}{tail}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in sentence_spans.drop_repeated_spans(docs).collect()}
    assert got[1]["text"] == rows[0][1] and got[1]["removed_bytes"] == 0
    assert got[2]["removed_bytes"] == len(rows[1][1].encode()) - len(got[2]["text"].encode())
    return got[2]["text"]


@pytest.mark.parametrize("lengths", [(52,), (26, 26), (18, 17, 17), (10, 3, 3, 2), (2, 20, 2)])
def test_repeats_of_few_sentences_go_to_the_last_word(spark, lengths):
    passage = " ".join(_words(f"s{i}w", n) + "." for i, n in enumerate(lengths))
    assert _kept_of_second(spark, passage) == "Start here. End here."


def test_repeat_that_starts_and_ends_within_sentences(spark):
    for passage in (_words("a", 27) + ". " + _words("b", 27), _words("c", 52)):
        words = passage.split()
        left = _kept_of_second(spark, passage, "Some other start ", " and other end.").split()
        assert left[:3] == ["Some", "other", "start"] and left[-3:] == ["and", "other", "end."]
        assert len(left) - 6 < 2 * sentence_spans.EVERY
        assert set(left[3:-3]) <= {*words[: sentence_spans.EVERY], *words[-sentence_spans.EVERY :]}


def test_short_repeats_stay(spark):
    passage = _words("a", 14) + "."
    assert _kept_of_second(spark, passage) == f"Start here. {passage} End here."
    passage = _words("b", sentence_spans.PASSAGE - sentence_spans.EVERY)
    whole = f"Some other start {passage} and other end."
    assert _kept_of_second(spark, passage, "Some other start ", " and other end.") == whole


def test_sentence_marks_beyond_ascii(spark):
    chinese = "".join(chr(0x4E00 + 7 * i) for i in range(34)) + "\u3002"
    assert _kept_of_second(spark, chinese, "\u6211\u4eec\u3002", "\u4f60\u4eec\u3002") == (
        "\u6211\u4eec\u3002\u4f60\u4eec\u3002"
    )
    for mark in "\u0964\u061f\u06d4":
        passage = _words("x", 16) + mark
        assert _kept_of_second(spark, passage, f"Start{mark} ", f" End{mark}") == f"Start{mark} End{mark}"


# Quality, search, packing


def test_quality(spark, odd, empty):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    rows = quality_neighbours.quality_table(docs, labels).join(labels, "doc_id").collect()
    good = [r["score"] for r in rows if r["quality"] == 1]
    bad = [r["score"] for r in rows if r["quality"] == 0]
    assert np.mean(good) > np.mean(bad) + 0.3
    got = quality_neighbours.quality_table(odd, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    assert quality_neighbours.quality_table(empty, labels).count() == 0
    alone = quality_neighbours.quality_table(odd, labels.limit(0)).collect()
    assert {r["score"] for r in alone} == {0.5}


def test_search_with_odd_vectors(spark):
    rows = [(i * 25, [float(i % 3), 1.0]) for i in range(9)]
    rows += [(1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (None, [9.0, 9.0]), (4, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    v = topk_search.whole_vectors(frame)
    got = topk_search.top_k(v, v.where("vec_id % 50 = 0")).collect()
    whole = {i * 25: [256 * (i % 3), 256] for i in range(9)} | {4: [0, 0]}
    for q in [x for x in whole if x % 50 == 0]:
        scores = sorted((-sum(a * b for a, b in zip(whole[q], w)), i) for i, w in whole.items() if i != q)
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert mine == [(n + 1, i, -s) for n, (s, i) in enumerate(scores[:5])]
    assert topk_search.top_k(v.limit(0), v.limit(0)).count() == 0


def test_packing(spark, odd, empty):
    rows = best_fit_packing.pack(odd, capacity=500, group_items=4).collect()
    whole = odd.collect()
    size = Counter()
    for r in rows:
        size[r["doc_id"]] += r["size"]
    want = Counter()
    for r in whole:
        want[r["doc_id"]] += len((r["text"] or "").encode()) + 1
    assert size == want
    bins = Counter()
    for r in rows:
        bins[(r["group"], r["bin"])] += r["size"]
    assert max(bins.values()) <= 500
    assert best_fit_packing.pack(empty).count() == 0


def test_bins_are_the_tightest_without_conflict():
    rng = np.random.default_rng(5)
    sizes, sources = rng.integers(1, 60, 200), rng.integers(0, 5, 200)
    clusters = rng.integers(0, 90, 200)
    got = best_fit_packing.pack_group(sizes, sources, clusters, 100)
    bins: list = []
    for i in np.argsort(-sizes, kind="stable"):
        fits = [
            (room, n)
            for n, (room, s, c) in enumerate(bins)
            if room >= sizes[i] and sources[i] not in s and clusters[i] not in c
        ]
        least = min(fits)[0] if fits else None
        n = int(got[i])
        if least is None:
            assert n == len(bins)
            bins.append([100, set(), set()])
        assert least is None or bins[n][0] == least
        bins[n][0] -= sizes[i]
        bins[n][1].add(sources[i])
        bins[n][2].add(clusters[i])


# Near copies and benchmark passages


def _components(rows):
    sets = []
    for _, t in rows:
        low = re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min([x for x in (least.get(find(i)), d) if x is not None], default=None)
    return Counter((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def test_near_copies(spark, odd, empty):
    rng = np.random.default_rng(2)
    base = [f"w{rng.integers(0, 400)}" for _ in range(150)]
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    for i in range(40):
        w = list(base[: rng.integers(100, 150)])
        for at in rng.integers(0, len(w), rng.integers(0, 6)):
            w[at] = f"x{i}"
        rows.append((200 - i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert Counter(tuple(r) for r in jaccard_join.jaccard_table(docs).collect()) == _components(rows)
    assert jaccard_join.jaccard_table(empty).count() == 0
    kept = jaccard_join.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4, 5, 6, 7, 8]
    assert jaccard_join.one_of_each(empty).count() == 0


def test_short_items_and_odd_texts(spark, odd, empty):
    items = spark.createDataFrame(
        [("i1", "word3 WORD4"), ("i2", None), ("i3", ".."), (None, "word5"), ("i4", PASSAGE), ("i1", "z9")],
        "item_id string, text string",
    )
    got = {r["doc_id"]: r for r in decontaminate.contamination_table(odd, items).collect()}
    assert got[1]["n_hit"] == 60 and got[1]["n_items"] == 2
    assert got[9]["n_hit"] == 58 and got[3]["n_words"] == 0 and not got[8]["contaminated"]
    assert decontaminate.contamination_table(empty, items).count() == 0
    assert decontaminate.contamination_table(odd, items.limit(0)).where("contaminated").count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = common.table(spark, SMALL, "documents")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.stored(stage(spark, docs, SMALL), name)
        assert docs.columns == names
        assert docs.count() > 100
    bins = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert {r[0] for r in bins.select("doc_id").distinct().collect()} == {
        r[0] for r in docs.select("doc_id").collect()
    }
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SMALL).count() == 0
