"""Personal data by candidates and boosted trees, with DataFrame functions only.

Base spans come from fixed patterns and their checks. Besides, generous generators propose spans that may
overlap: digits in any grouping, addresses spelt with "(at)" and "[dot]". A candidate's label is the kind of the base
span that it equals, else the kind whose check it passes once its spelling is undone, else none. Boosted
trees of depth two, one set per kind, learn from whole-number features of its format and of what stands around
it which candidates are of a kind; a threshold per kind is calibrated on candidates that were held out.
Candidates above it that touch no base span are added; those that overlap become one span.

The trees learn from the candidates of all documents. Since disguised forms may be rare, documents with
base spans are also learned from in copies in which these are spelt in disguise.

Training groups candidates by their features, so each step of boosting is one small aggregation. The
trees become column expressions, and scoring is one pass over the texts without a shuffle. All steps within
a text take time in proportion to it (places by sums over blocks, neighbours by binary search).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from shiftledger.llm.common import stored

KINDS = ("email", "ip", "card", "phone")
# The patterns of the base spans. Possessive and guarded forms match what the plain ones do, in linear
# time and without recursion: a run is only tried from its first character.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
BASE = dict(zip(KINDS, (EMAIL, IP, CARD, PHONE)))
GENERATORS = (
    r"\+?[0-9(](?:[ ().-]{0,2}[0-9]){6,24}",
    r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])",
    r"(?<![0-9A-Za-z])[0-9]{4}[ ._/-]?[0-9]{4}[ ._/-]?[0-9]{4}[ ._/-]?[0-9]{2,7}(?![0-9A-Za-z])",
    r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:(?:\.|\[\.\])[0-9]{1,3}){3}(?![0-9A-Za-z])",
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]++"
    r"(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]++)++",
)
PHONE_CUES = r"(?i)(tel|phone|call|fax|mobile|cell|contact)[a-z]*\W{0,3}$"
CUES = r"(?i)(tel|phone|call|fax|mail|card|visa|pay|ip|host|addr|contact)[a-z]*\W{0,3}$"
ROUNDS = 8
RATE = 0.5
PRECISION = 0.9
# Gradients are summed as whole multiples of one part in so many, so the order of summation does not matter.
UNIT = 1 << 24
# Code points around a candidate that its features see, and in the pieces that texts are cut into.
CONTEXT = 16
PIECE = 512
BLOCK = 256
_NONE = "array<struct<s:int,e:int,m:string>>"
_SPANS = "array<struct<s:int,k:int,e:int>>"


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def places(array: Column) -> Column:
    """0 .. size - 1; no element for an empty array."""
    none = F.array().cast("array<int>")
    return F.when(F.size(array) > 0, F.sequence(F.lit(0), F.size(array) - 1)).otherwise(none)


def running(values: Column, combine) -> Column:
    """For each whole number what ``combine`` makes of 0 and all before it.

    Block by block, as an array that grows by one element a step is copied every time.
    """
    none = F.array().cast("array<int>")

    def within(block: Column, start: Column) -> Column:
        zero = F.struct(start.alias("t"), none.alias("out"))
        return F.aggregate(
            block,
            zero,
            lambda acc, x: F.struct(
                combine(acc["t"], x).alias("t"), F.concat(acc["out"], F.array(acc["t"])).alias("out")
            ),
            lambda acc: acc["out"],
        )

    count = F.size(values)
    starts = F.when(count > 0, F.sequence(F.lit(1), count, F.lit(BLOCK))).otherwise(none)
    blocks = F.transform(starts, lambda at: F.slice(values, at, BLOCK))
    whole = lambda block: F.aggregate(block, F.lit(0), combine)
    return let(
        blocks,
        lambda bs: F.flatten(F.zip_with(bs, within(F.transform(bs, whole), F.lit(0)), within)),
    )


def count_below(values: Column, bound: Column) -> Column:
    """How many elements of a rising array are below ``bound``, by binary search."""

    def step(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        open_, less = acc["lo"] < acc["hi"], F.get(values, middle) < bound
        return F.struct(
            F.when(open_ & less, middle + 1).otherwise(acc["lo"]).alias("lo"),
            F.when(open_ & ~less, middle).otherwise(acc["hi"]).alias("hi"),
        )

    # As many halvings as the size has binary digits.
    steps = F.sequence(F.lit(0), F.length(F.bin(F.size(values))))
    zero = F.struct(F.lit(0).alias("lo"), F.size(values).alias("hi"))
    return F.aggregate(steps, zero, step, lambda acc: acc["lo"])


def located(text: Column, pattern: str) -> Column:
    """(s, e, m) of every match: code points, end exclusive. The gaps between matches give the places."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def spans(found: Column, gaps: Column) -> Column:
        sizes = F.transform(places(found), lambda i: F.char_length(F.get(gaps, i)) + F.char_length(F.get(found, i)))

        def span(i: Column, before: Column) -> Column:
            start = F.get(before, i) + F.char_length(F.get(gaps, i))
            m = F.get(found, i)
            return F.struct(start.alias("s"), (start + F.char_length(m)).alias("e"), m.alias("m"))

        ends = running(sizes, lambda a, x: a + x)
        return let(ends, lambda before: F.transform(places(found), lambda i: span(i, before)))

    return let(
        matches,
        lambda found: F.when(
            F.size(found) > 0, let(F.split(text, pattern, -1), lambda gaps: spans(found, gaps))
        ).otherwise(F.array().cast(_NONE)),
    )


def pieces(text: Column) -> Column:
    """The text in pieces of ``PIECE`` code points, so that a place in it is found without counting from its start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def between(cut: Column, start: Column, end: Column) -> Column:
    """The code points from ``start`` to ``end`` of a text in pieces."""
    first, last = F.floor(start / PIECE).cast("int"), F.floor(end / PIECE).cast("int")
    at = lambda i: F.coalesce(F.get(cut, i), F.lit(""))
    low, high = start - first * PIECE, end - last * PIECE
    middle = F.array_join(F.slice(cut, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    return (
        F.when(end <= start, "")
        .when(first == last, F.substring(at(first), low + 1, end - start))
        .otherwise(F.concat(F.substring(at(first), low + 1, F.lit(PIECE)), middle, F.substring(at(last), F.lit(1), high)))
    )


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    """Whether the digits of a text pass Luhn's check; false without digits."""

    def total(digits: Column, size: Column) -> Column:
        def add(sum_: Column, i: Column) -> Column:
            d = digits.substr(size - i, F.lit(1)).cast("int")
            twice = d * 2 - F.when(d > 4, 9).otherwise(0)
            return sum_ + F.when(i % 2 == 1, twice).otherwise(d)

        at = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
        return (size > 0) & (F.aggregate(at, F.lit(0), add) % 10 == 0)

    return let(_digits(m), lambda digits: let(F.char_length(digits), lambda size: total(digits, size)))


_HOLDS = {
    "email": lambda x: F.lit(True),
    "ip": lambda x: x["m"].rlike(rf"^{PART}(?:\.{PART}){{3}}$"),
    "card": lambda x: _luhn(x["m"]),
    "phone": lambda x: F.char_length(_digits(x["m"])).between(10, 15),
}


def _of_kind(k: int):
    return lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"))


def _is_kind(k: int):
    return lambda x: x["k"] == k


def base_spans(text: Column) -> Column:
    """(s, k, e) of all base spans, ordered by start and kind."""
    hint = {"email": "@", "ip": ".", "card": "", "phone": "+"}
    parts = []
    for k, kind in enumerate(KINDS):
        spans = F.when(text.contains(hint[kind]), located(text, BASE[kind])).otherwise(
            F.array().cast(_NONE)
        )
        parts.append(F.transform(F.filter(spans, _HOLDS[kind]), _of_kind(k)))
    return F.array_sort(F.concat(*parts))


def undisguised(x: Column) -> Column:
    """The kind whose check a candidate (m, pre) passes once its spelling is undone; -1 if none."""
    m = x["m"]
    mail = F.regexp_replace(m, r" ?(?:\(at\)|\[at\]|@) ?", "@")
    mail = F.regexp_replace(mail, r" ?(?:\(dot\)|\[dot\]|\.) ?", ".")
    digits = _digits(m)
    size = F.char_length(digits)
    return (
        F.when(mail.rlike(r"^[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}$"), 0)
        .when(F.replace(m, F.lit("[.]"), F.lit(".")).rlike(rf"^{PART}(?:\.{PART}){{3}}$"), 1)
        .when(size.between(14, 19) & m.rlike("^[0-9]+(?:[ ._/-]?[0-9]+)*$") & _luhn(m), 2)
        .when(size.between(10, 15) & m.rlike("^[+(0-9]") & (m.startswith("+") | x["pre"].rlike(PHONE_CUES)), 3)
        .otherwise(-1)
    )


def _count(m: Column, chars: str, most: int) -> Column:
    return F.least(F.char_length(F.regexp_replace(m, f"[^{chars}]", "")), F.lit(most))


def _edge(c: Column) -> Column:
    return (
        F.when(c.rlike(r"^\s?$"), 0).when(c.rlike("[0-9]"), 1).when(c.rlike(r"\p{L}"), 2).otherwise(3)
    )


def features(x: Column) -> Column:
    """Format and context of a candidate (m, pre, post) as whole numbers."""
    m = x["m"]
    groups = F.filter(F.split(m, "[^0-9]+"), lambda g: g != "")
    lengths = F.transform(groups, lambda g: F.least(F.char_length(g), F.lit(20)))
    flag = lambda c: F.when(c, 1).otherwise(0)

    def listed(sizes: Column) -> Column:
        digits = F.aggregate(sizes, F.lit(0), lambda a, n: a + n)
        return F.array(
            F.least(digits, F.lit(24)),
            F.least(F.size(sizes), F.lit(9)),
            F.coalesce(F.array_max(sizes), F.lit(0)),
            F.coalesce(F.array_min(sizes), F.lit(0)),
            flag(m.startswith("+")),
            flag(m.contains("(")),
            _count(m, ".", 6),
            _count(m, " -", 9),
            F.when(m.contains("@"), 2).when(m.rlike("[(\\[]at[)\\]]"), 1).otherwise(0),
            _count(m, "A-Za-z", 20),
            _edge(F.substring(x["pre"], -1, 1)),
            _edge(x["post"]),
            flag(m.rlike("[A-Za-z]{2,}$")),
            flag(x["pre"].rlike(CUES)),
            F.least(F.char_length(m), F.lit(40)),
            flag(x["pre"].rlike(PHONE_CUES)),
            _count(m, "_/", 6),
            flag(m.contains("[.]")),
            flag(digits.between(14, 19) & _luhn(m)),
            flag(m.rlike(rf"^{PART}(?:(?:\.|\[\.\]){PART}){{3}}$")),
        )

    return let(lengths, listed)


def candidates(text: Column) -> Column:
    """(s, e, f, y) of what the generators propose, each place once; ``y`` is the kind as of ``undisguised``."""
    spans = F.array_sort(F.concat(*[located(text, g) for g in GENERATORS]))

    def first(all_: Column):
        def is_new(x: Column, i: Column) -> Column:
            before = F.get(all_, i - 1)
            return (i == 0) | (before["s"] != x["s"]) | (before["e"] != x["e"])

        return F.filter(all_, is_new)

    def seen(x: Column, cut: Column) -> Column:
        return F.struct(
            x["s"].alias("s"),
            x["e"].alias("e"),
            x["m"].alias("m"),
            between(cut, F.greatest(x["s"] - CONTEXT, F.lit(0)), x["s"]).alias("pre"),
            between(cut, x["e"], x["e"] + 1).alias("post"),
        )

    def described(x: Column) -> Column:
        return F.struct(
            x["s"].alias("s"), x["e"].alias("e"), features(x).alias("f"), undisguised(x).cast("int").alias("y")
        )

    return let(
        pieces(text),
        lambda cut: F.transform(
            F.transform(let(spans, first), lambda x: seen(x, cut)), described
        ),
    )


def with_candidates(docs: DataFrame) -> DataFrame:
    """``docs`` with arrays ``base`` and ``proposed``; empty where no digit and no @ stands."""
    text = F.col("__text")
    some = text.rlike("[0-9@]")
    seen = docs.withColumn("__text", F.coalesce(F.col("text"), F.lit("")))
    return seen.withColumns(
        {
            "base": F.when(some, base_spans(text)).otherwise(F.array().cast(_SPANS)),
            "proposed": F.when(
                text.rlike("[0-9@]|[(\\[]at[)\\]]"), candidates(text)
            ).otherwise(F.array().cast("array<struct<s:int,e:int,f:array<int>,y:int>>")),
        }
    ).drop("__text")


@dataclass
class Split:
    """A node of depth two at most: rows with feature <= at go left."""

    feature: int
    at: int
    left: "Split | float"
    right: "Split | float"


@dataclass
class Boosted:
    """Trees and threshold per kind; a kind without threshold adds nothing."""

    trees: dict[int, list[Split | float]]
    thresholds: dict[int, float]


def _value(tree: "Split | float", f: Column) -> Column:
    if not isinstance(tree, Split):
        return F.lit(float(tree))
    return F.when(F.get(f, F.lit(tree.feature)) <= tree.at, _value(tree.left, f)).otherwise(
        _value(tree.right, f)
    )


def margin(trees: list, f: Column) -> Column:
    return reduce(lambda a, t: a + _value(t, f), trees, F.lit(0.0))


def _best(stats: dict, g: float, h: float):
    """Best split of one node from sums per (feature, value); None if nothing is gained."""
    top, choice = 1e-6, None
    score = lambda a, b: a * a / (b + 1.0)
    for feature, cells in stats.items():
        lg = lh = 0.0
        values = sorted(cells)
        for v in values[:-1]:
            lg, lh = lg + cells[v][0], lh + cells[v][1]
            gain = score(lg, lh) + score(g - lg, h - lh) - score(g, h)
            if gain > top + 1e-9:
                top, choice = gain, (feature, v)
    return choice


def _sums(cells: DataFrame, trees: dict, paths: dict) -> dict:
    """Per kind and open leaf: {feature: {value: (gradient, curvature)}}, by one aggregation."""
    rows = []
    for k, nodes in paths.items():
        p = 1.0 / (1.0 + F.exp(-margin(trees[k], F.col("f"))))
        y = (F.col("label") == k).cast("double")
        leaf = F.lit(0) if nodes is None else F.when(
            F.get("f", F.lit(nodes[0])) <= nodes[1], 0
        ).otherwise(1)
        rows.append(
            F.struct(
                F.lit(k).alias("k"),
                leaf.alias("leaf"),
                (F.col("weight") * F.round((y - p) * UNIT).cast("long")).alias("g"),
                (F.col("weight") * F.round(p * (1.0 - p) * UNIT).cast("long")).alias("h"),
            )
        )
    long = cells.select("f", F.explode(F.array(*rows)).alias("r")).select(
        "r.*", F.posexplode("f").alias("feature", "value")
    )
    grouped = long.groupBy("k", "leaf", "feature", "value").agg(
        (F.sum("g") / UNIT).alias("g"), (F.sum("h") / UNIT).alias("h")
    )
    out: dict = {}
    for r in grouped.collect():
        out.setdefault((r["k"], r["leaf"]), {}).setdefault(r["feature"], {})[r["value"]] = (
            r["g"],
            r["h"],
        )
    return out


def boost(cells: DataFrame, kinds: list[int]) -> dict[int, list]:
    """Trees per kind, each grown level by level from sums over ``cells`` (f, label, weight)."""
    trees: dict[int, list] = {k: [] for k in kinds}

    def totals(stats):
        first = next(iter(stats.values()))
        return sum(c[0] for c in first.values()), sum(c[1] for c in first.values())

    def leaf(g, h):
        return RATE * g / (h + 1.0)

    for _ in range(ROUNDS):
        if not kinds:
            break
        roots = _sums(cells, trees, dict.fromkeys(kinds))
        chosen, sums = {}, {}
        for k in kinds:
            stats = roots.get((k, 0))
            if stats:
                sums[k] = totals(stats)
                chosen[k] = _best(stats, *sums[k])
        below = _sums(cells, trees, {k: c for k, c in chosen.items() if c}) if any(
            chosen.values()
        ) else {}
        for k in kinds:
            if k not in sums:
                continue
            if not chosen[k]:
                trees[k].append(leaf(*sums[k]))
                continue
            sides = []
            for side in (0, 1):
                stats = below.get((k, side))
                if not stats:
                    sides.append(0.0)
                    continue
                g, h = totals(stats)
                cut = _best(stats, g, h)
                if not cut:
                    sides.append(leaf(g, h))
                    continue
                low = [c for v, c in stats[cut[0]].items() if v <= cut[1]]
                lg, lh = sum(c[0] for c in low), sum(c[1] for c in low)
                sides.append(Split(*cut, leaf(lg, lh), leaf(g - lg, h - lh)))
            trees[k].append(Split(*chosen[k], *sides))
    return trees


def disguised(text: Column, base: Column) -> Column:
    """The text with its base spans spelt in disguise, the way drawn by their text."""

    def spell(x: Column, m: Column) -> Column:
        return let(F.pmod(F.xxhash64(m), F.lit(3)), lambda w: spelt(x, m, w))

    def spelt(x: Column, m: Column, way: Column) -> Column:
        dots = F.replace(m, F.lit("."), F.when(way == 0, " (dot) ").when(way == 1, "[dot]").otherwise("."))
        at = F.when(way == 0, " (at) ").when(way == 1, "[at]").otherwise(" @ ")
        digits = _digits(m)
        mark = F.when(way == 0, ".").when(way == 1, "_").otherwise("/")
        groups = F.regexp_replace(digits, "([0-9]{4})(?=[0-9])", F.concat(F.lit("$1"), mark))
        bare = F.replace(m, F.lit("+"), F.lit(""))
        dialled = (
            F.when(way == 0, F.concat(F.lit("phone "), bare))
            .when(way == 1, F.concat(F.lit("call: "), F.regexp_replace(bare, r"^[0-9]{1,3}[ .-]+", "")))
            .otherwise(F.concat(F.lit("tel. "), digits))
        )
        return (
            F.when(x["k"] == 0, F.replace(dots, F.lit("@"), at))
            .when(x["k"] == 1, F.replace(m, F.lit("."), F.lit("[.]")))
            .when(x["k"] == 2, groups)
            .otherwise(dialled)
        )

    return replaced(text, base, spell)


def reaches(base: Column) -> Column:
    """Reach of the first n base spans, for n from 0 on."""
    return running(F.concat(F.transform(base, lambda b: b["e"]), F.array(F.lit(0))), lambda a, x: F.greatest(a, x))


def examples(proposed: Column, base: Column) -> Column:
    """(s, f, label) of the candidates to learn from: those that equal a base span or touch none."""

    def labels(starts: Column, reach: Column) -> Column:
        def labelled(c: Column) -> Column:
            # One base span of each kind at most starts at a place.
            near = F.slice(base, count_below(starts, c["s"]) + 1, len(KINDS))
            same = F.filter(near, lambda b: (b["s"] == c["s"]) & (b["e"] == c["e"]))
            free = F.get(reach, count_below(starts, c["e"])) <= c["s"]
            label = F.coalesce(F.get(same, F.lit(0))["k"], F.when(free, c["y"]))
            return F.struct(c["s"].alias("s"), c["f"].alias("f"), label.alias("label"))

        return F.filter(F.transform(proposed, labelled), lambda c: c["label"].isNotNull())

    return let(F.transform(base, lambda b: b["s"]), lambda s: let(reaches(base), lambda r: labels(s, r)))


def fit(docs: DataFrame) -> Boosted:
    """Learn from the candidates of all documents, and of copies with their base spans in disguise."""
    docs = docs.select("text")
    based = docs.select("text", base_spans(F.coalesce("text", F.lit(""))).alias("base")).where(F.size("base") > 0)
    # Written, so that what follows does not spell them anew for every use.
    copies = stored(based.select(disguised(F.col("text"), F.col("base")).alias("text")), "copies")
    both = with_candidates(docs.unionByName(copies))
    seen = both.select(
        F.xxhash64("text").alias("d"), F.explode(examples(F.col("proposed"), F.col("base"))).alias("c")
    )
    held = F.pmod(F.xxhash64("d", "c.s"), F.lit(4)) == 0
    cells = stored(
        seen.groupBy("c.f", "c.label", held.alias("held")).agg(F.count(F.lit(1)).alias("weight")), "cells"
    )
    learn = cells.where(~F.col("held"))
    present = {r["label"] for r in cells.select("label").distinct().collect()}
    kinds = [k for k in range(len(KINDS)) if k in present]
    trees = boost(learn, kinds)
    thresholds = {}
    for k in kinds:
        # Rounding makes the cut independent of the order of summation.
        steps = (
            cells.where("held")
            .groupBy(F.round(margin(trees[k], F.col("f")), 6).alias("m"))
            .agg(
                F.sum(F.when(F.col("label") == k, F.col("weight")).otherwise(0)).alias("good"),
                F.sum("weight").alias("all"),
            )
            .orderBy(F.desc("m"))
            .collect()
        )
        good = every = 0
        for r in steps:
            good, every = good + r["good"], every + r["all"]
            if r["m"] > 0 and good > 0 and good / every >= PRECISION:
                thresholds[k] = r["m"] - 1e-5
    return Boosted(trees, thresholds)


def added(model: Boosted, proposed: Column, base: Column) -> Column:
    """(s, k, e) of candidates above their threshold that touch no base span, by start.

    Overlapping ones become one span, of the kind of the surest.
    """
    none = F.array().cast(_SPANS)
    if not model.thresholds:
        return none
    highest = lambda a, x: F.greatest(a, x)

    def judged(c: Column) -> Column:
        margins = [
            F.struct((margin(model.trees[k], c["f"]) - F.lit(t)).alias("sure"), F.lit(-k).alias("k"))
            for k, t in model.thresholds.items()
        ]
        return F.struct(c["s"].alias("s"), c["e"].alias("e"), F.array_max(F.array(*margins)).alias("j"))

    sure = F.filter(F.transform(proposed, judged), lambda c: c["j"]["sure"] >= 0)
    starts = F.transform(base, lambda b: b["s"])
    free = let(
        starts,
        lambda s: let(reaches(base), lambda r: F.filter(sure, lambda c: F.get(r, count_below(s, c["e"])) <= c["s"])),
    )

    def merged(some: Column) -> Column:
        def groups(past: Column) -> Column:
            heads = F.filter(places(some), lambda i: F.get(some, i)["s"] >= F.get(past, i))

            def span(heads_: Column, j: Column) -> Column:
                first = F.get(heads_, j)
                last = F.coalesce(F.get(heads_, j + 1), F.size(some))
                group = F.slice(some, first + 1, last - first)
                top = F.array_max(F.transform(group, lambda c: c["j"]))
                end = F.array_max(F.transform(group, lambda c: c["e"]))
                return F.struct(F.get(some, first)["s"].alias("s"), (-top["k"]).alias("k"), end.alias("e"))

            return let(heads, lambda h: F.transform(places(h), lambda j: span(h, j)))

        return let(running(F.transform(some, lambda c: c["e"]), highest), groups)

    # Candidates come by start.
    return F.coalesce(let(free, merged), none)


def find(docs: DataFrame, model: Boosted | None = None) -> DataFrame:
    """``docs`` with ``base`` and ``spans``: (s, k, e), ordered by start and kind.

    A missing text counts as empty. Repeated rows get equal spans. Columns named base, spans and
    proposed are replaced; others stay.
    """
    model = model or fit(docs)
    seen = with_candidates(docs.drop("base", "spans", "proposed"))
    more = added(model, F.col("proposed"), F.col("base"))
    return seen.withColumn("spans", F.array_sort(F.concat("base", more))).drop("proposed")


def replaced(text: Column, spans: Column, by) -> Column:
    """The text with every span, in order of start, replaced by ``by(span, its text)``.

    A span that starts within an earlier one adds nothing but its end.
    """

    def parts(cut: Column, all_: Column, past: Column) -> Column:
        def part(x: Column, i: Column) -> Column:
            at = F.get(past, i)
            fresh = F.when(x["s"] >= at, by(x, between(cut, x["s"], x["e"]))).otherwise("")
            return F.concat(between(cut, at, x["s"]), fresh)

        end = F.array_max(F.transform(all_, lambda x: x["e"]))
        return F.concat(F.array_join(F.transform(all_, part), ""), between(cut, end, F.char_length(text)))

    done = let(
        pieces(text),
        lambda cut: let(
            spans,
            lambda all_: let(
                running(F.transform(all_, lambda x: x["e"]), lambda a, x: F.greatest(a, x)),
                lambda past: parts(cut, all_, past),
            ),
        ),
    )
    return F.when(F.size(spans) > 0, done).otherwise(text)


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; overlapping ones become one."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    return replaced(text, spans, lambda x, _: F.get(names, x["k"]))


def pii_table(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256 and spans as text."""
    found = find(docs.select("doc_id", "text"))
    names = F.array(*[F.lit(k) for k in KINDS])
    listed = lambda c: F.array_join(
        F.transform(
            c, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))
        ),
        ",",
    )
    return found.select(
        "doc_id",
        *[
            F.size(F.filter("base", _is_kind(i))).cast("long").alias(f"n_{k}")
            for i, k in enumerate(KINDS)
        ],
        F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"),
        listed("spans").alias("spans"),
    )
