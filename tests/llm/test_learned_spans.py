"""Learned personal data, columns that clash with those of pipeline stages, and vectors that share an id."""

import time

import pytest
from pyspark.sql import functions as F

from shiftledger.llm import common, pii_boosting, topk_search

SMALL = "/root/testdata/sf0.001"
FORMS = {
    "write to jo.doe (at) mail (dot) example (dot) com now": "write to [EMAIL] now",
    "jo.doe[at]mail[dot]com": "[EMAIL]",
    "ask jo @ mail . com first": "ask [EMAIL] first",
    "host 10[.]2[.]33[.]4 is up": "host [IP] is up",
    "pay 4111.1111.1111.1111 soon": "pay [CARD] soon",
    "pay 4111_1111_1111_1111 soon": "pay [CARD] soon",
    "phone 1 (269) 555-3296 today": "phone [PHONE] today",
    "call: (269) 555-3296.": "call: [PHONE].",
    "tel. 12695553296": "tel. [PHONE]",
}
CLEAN = [
    "order 2695553296 of 2023", "id 4111.1111.1111.1112", "sum 12.50 at 3 o'clock", "v 1.2.3", "we are (at) home (dot)",
    "rooms 101-109, 12 to 15 people", "1 2 3 4 5 6 7 8 9 10 11 12", "on 2024-01-26 10:15:00 it was 21.5", "500.600.700.800",
]


def luhn(digits):
    total = sum(d - 9 * (d > 9) for d in (int(c) * (2 - i % 2) for i, c in enumerate(reversed(digits))))
    return digits + str(-total % 10)


@pytest.fixture(scope="module")
def model(spark):
    """Learned from plain spans and clean text only: no disguised form is in the documents."""
    rows = []
    for i in range(120):
        card = luhn(f"4{i * 7919 % 10**14:014d}")
        rows += [
            f"mail a{i}.b@host{i % 7}.example.com about it", f"seen from 10.{i}.{i % 9}.{255 - i} twice",
            f"paid by {card[:4]} {card[4:8]} {card[8:12]} {card[12:]} then", f"at +1 (2{i % 90 + 10}) 555-{1000 + i} daily",
            f"{CLEAN[i % len(CLEAN)]} and {i * 104729} more", f"order {2695550000 + i} of {i}", f"id {luhn(card[:-1] + '3')[:-1]}9.{i}",
        ]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    return pii_boosting.fit(docs)


def test_disguised_forms_are_found_and_clean_text_is_left_alone(spark, model):
    assert set(model.thresholds) == {0, 1, 2, 3}
    docs = spark.createDataFrame([(t,) for t in (*FORMS, *CLEAN)], "text string")
    seen = pii_boosting.find(docs, model)
    clean = pii_boosting.redacted(F.col("text"), F.col("spans"))
    got = {r["text"]: r["clean"] for r in seen.select("text", clean.alias("clean")).collect()}
    assert got == FORMS | {t: t for t in CLEAN}


def test_added_spans_touch_no_base_span_and_no_other(spark, model):
    text = "a@b.cd +1 269 555 3296 4111 1111 1111 1111 10[.]1[.]1[.]1 10.1.1.1 jo[at]x[dot]org,jo(at)x.org " * 30
    row = pii_boosting.find(spark.createDataFrame([(text,)], "text string"), model).first()
    base, spans = {tuple(x) for x in row["base"]}, [tuple(x) for x in row["spans"]]
    added = [x for x in spans if x not in base]
    assert base <= set(spans) and len(added) >= 60
    for s, _, e in added:
        assert not any(b[0] < e and b[2] > s for b in base)
    assert all(a[2] <= b[0] for a, b in zip(added, added[1:]))


def test_a_text_of_many_matches_takes_time_in_proportion(spark, model):
    def seconds(n):
        text = " ".join(f"10.0.{i % 256}.{i % 251} x 10[.]0[.]{i % 256}[.]7" for i in range(n))
        df = pii_boosting.find(spark.createDataFrame([(text,)], "text string"), model)
        df = df.select("base", "spans", pii_boosting.redacted(F.col("text"), F.col("spans")).alias("text"))
        start = time.time()
        row = df.first()
        assert len(row["base"]) == n and len(row["spans"]) == 2 * n
        assert row["text"] == " ".join(["[IP] x [IP]"] * n)
        return time.time() - start

    seconds(10)
    few, many = seconds(3_000), seconds(24_000)
    assert many < 24 * max(few, 1.0)


def test_small_steps(spark):
    p = pii_boosting
    df = spark.createDataFrame(
        [([3, 1, 2] * 400, "ab😀c" * 400), ([], ""), ([5], "x")], "v array<int>, t string"
    )
    rows = df.select(
        "v",
        "t",
        p.running(F.col("v"), lambda a, x: a + x).alias("sums"),
        p.running(F.col("v"), lambda a, x: F.greatest(a, x)).alias("most"),
        p.count_below(p.running(F.col("v"), lambda a, x: a + x), F.lit(7)).alias("below"),
        *[p.between(p.pieces(F.col("t")), F.lit(a), F.lit(b)).alias(f"t{a}_{b}") for a, b in ((0, 3), (510, 515), (100, 1400), (7, 7))],
        p.replaced(F.col("t"), F.array(*[F.struct(F.lit(s).alias("s"), F.lit(0).alias("k"), F.lit(e).alias("e"))
                   for s, e in ((1, 3), (2, 600), (601, 602))]), lambda x, m: F.concat(F.lit("<"), F.length(m).cast("string"), F.lit(">"))).alias("r"),
    ).collect()
    for r in rows:
        sums = [sum(r["v"][:i]) for i in range(len(r["v"]))]
        assert r["sums"] == sums and r["most"] == [max(r["v"][:i], default=0) for i in range(len(r["v"]))]
        assert r["below"] == sum(x < 7 for x in sums)
        for a, b in ((0, 3), (510, 515), (100, 1400), (7, 7)):
            assert r[f"t{a}_{b}"] == r["t"][a:b]
    t = rows[0]["t"]
    assert rows[0]["r"] == t[0] + "<2>" + t[600] + "<1>" + t[602:]


def test_a_table_without_any_span_adds_nothing(spark):
    docs = spark.createDataFrame([(1, "plain words"), (2, None), (None, "")], "doc_id long, text string")
    assert pii_boosting.fit(docs).thresholds == {}
    assert pii_boosting.find(docs).where("size(spans) > 0").count() == 0


def test_forms_in_few_of_many_documents_are_learned(spark):
    """What is learned comes from all documents: 20 of 400,000 hold mail addresses, all in disguise."""
    text = F.when(
        F.col("id") % 20_000 == 6_880, F.concat(F.lit("to jo"), "id", F.lit(" (at) mail (dot) org"))
    ).otherwise("plain words")
    model = pii_boosting.fit(spark.range(400_000).select(F.col("id").alias("doc_id"), text.alias("text")))
    assert set(model.thresholds) == {0}
    docs = spark.createDataFrame([("ask ann (at) mail (dot) org now",)], "text string")
    assert [tuple(x) for x in pii_boosting.find(docs, model).first()["spans"]] == [(4, 0, 27)]


def test_examples_equal_a_base_span_or_touch_none(spark):
    p = pii_boosting
    texts = ["a@b.cd x jo (at) c (dot) de", "10.1.1.1 +1 269 555 3296 4111 1111 1111 1111 " * 20, "1.2.3.4.5 12 34 56 78 9", ""]
    seen = p.with_candidates(spark.createDataFrame([(t,) for t in texts], "text string"))
    for r in seen.withColumn("x", p.examples(F.col("proposed"), F.col("base"))).collect():
        want = []
        for c in r["proposed"]:
            same = [b["k"] for b in r["base"] if (b["s"], b["e"]) == (c["s"], c["e"])]
            if same or not any(b["s"] < c["e"] and b["e"] > c["s"] for b in r["base"]):
                want.append((c["s"], c["f"], same[0] if same else c["y"]))
        assert [tuple(x) for x in r["x"]] == want


def test_stages_keep_columns_that_clash_with_their_own(spark):
    import corpus_pipeline

    names = ["language", "key", "base", "spans", "proposed", "node", "bucket"]
    docs = common.table(spark, SMALL, "documents").limit(40)
    docs = docs.withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names})
    docs = common.stored(docs, "docs")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = common.stored(stage(spark, docs, SMALL), "out")
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in names)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() >= 40


def test_vectors_that_share_an_id_all_count(spark):
    rows = [(50, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [3.0, 0.0]), (2, [1.0, 5.0]), (2, [1.0, 5.0])]
    v = topk_search.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = topk_search.top_k(v, v.where("vec_id % 50 = 0")).orderBy("rank").collect()
    one = 256 * 256
    assert [(r["rank"], r["vec_id"], r["score"]) for r in got] == [(1, 1, 3 * one), (2, 1, 2 * one), (3, 2, one), (4, 2, one)]
