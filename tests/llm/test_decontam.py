"""Planted passages of benchmark items at every alignment."""

from __future__ import annotations

import time

import regex

from palimpsest.llm.decontam import UNITS, contaminated


def test_short_runs_at_every_alignment(spark):
    """Runs of 7 and 8 words are enough by the rule; no item has under nine words."""
    items = [[f"{c}{c}{chr(97 + k)}x" for k in range(n)] for c, n in zip("pqr", (10, 12, 17))]
    parts = [items[0][2:9], items[1][1:9], [*items[2][:7], "new", "other", "words", *items[2][10:]]]
    want, docs = {}, []
    for item, part in enumerate(parts):
        for pad in range(10):
            want[len(docs)] = item
            docs.append((len(docs), " ".join([f"filler{chr(97 + k)}" for k in range(pad)] + part + ["tail"] * 6)))
    docs.append((len(docs), " ".join(items[0][2:8] + ["tail"] * 6)))  # 6 words: 2 of 6 windows
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).toPandas()
    assert dict(zip(got.doc_id, got.item_id)) == want
    assert sorted(set(zip(got.item_id, got.n_matched, got.n_windows))) == [(0, 3, 6), (1, 4, 8), (2, 6, 13)]


PLACE = "\ue000\ue001\ue002"


def valued(text: str) -> list[str]:
    """A document's words, slots as placeholder and value."""
    low = [u.lower() for u in UNITS.split()]
    words, number = [], None
    for m in regex.finditer(r"[0-9]+(?:[.,][0-9]+)*|[\p{L}\p{N}]+", text):
        w, before = m[0], text[: m.start()]
        fresh = not regex.search(r"[\p{L}\p{N}]\Z", before)
        if w[0].isdigit() and fresh:
            words.append(PLACE[0] + w)
        elif w.lower() in low and number is not None and regex.fullmatch(r"\s?", text[number : m.start()]):
            words.append(PLACE[1] + w.lower())
        elif regex.match(r"\p{Lu}\p{L}+", w) and fresh:
            words.append(PLACE[2] + w.lower())
        else:
            words.append(w.lower())
        number = m.end() if words[-1][0] == PLACE[0] else None
    return words


def leaks(doc: str, item: str) -> bool:
    """The rule, window by window."""
    kind = lambda w: w[0] if w[0] in PLACE else w
    d, i = valued(doc), valued(item)
    told = [k for k in range(len(i) - 4) if sum(w[0] not in PLACE for w in i[k : k + 5]) >= 2]
    matched = set()
    for shift in range(-len(i), len(d)):
        at = [k for k in told if 0 <= k + shift <= len(d) - 5 and list(map(kind, d[k + shift : k + shift + 5])) == list(map(kind, i[k : k + 5]))]
        swaps = {}
        for k in at:
            for x, y in zip(i[k : k + 5], d[k + shift : k + shift + 5]):
                if x[0] in PLACE:
                    swaps.setdefault(x, set()).add(y)
        if all(len(v) == 1 for v in swaps.values()):
            matched |= set(at)
    return bool(told) and 100 * len(matched) >= 40 * len(told) and len(matched) >= min(3, len(told))


ITEMS = [
    "Tom has 3 apples. Ann has 5 pears. How many fruits do Tom and Ann have together?",
    "A train goes 120 km in 2 hours. What is its speed in km per hour, says Maria to Tom?",
    "what is the boiling point of water at sea level in degrees",
    "ONE TWO Three Four Five Six 7 8",
    "short item",
]
DOCS = [
    "Bob has 4 apples. Eve has 7 pears. How many fruits do Bob and Eve have together?",
    "Bob has 4 apples. Eve has 7 pears. How many fruits do Eve and Zed have together? Bob has 9 apples.",
    "intro words: a train goes 90 miles in 3 hours. What is its speed in miles per hour, says Eva to Jim? tail",
    "(\"Tom has 3 apples.\nAnn has 5 pears\")",
    "Nothing here is alike 5 km but What is the boiling point",
    "before What is the boiling point of water at sea level in degrees after",
    "Alpha Beta Gamma Delta Epsilon Zeta 1 2 3 4 5 Alpha Beta Gamma",
    "", "   ", None,
]


def test_rule_by_brute_force(spark):
    bench = spark.createDataFrame([*enumerate(ITEMS), (None, "x y z v w u"), (9, None)], "item_id long, text string")
    docs = spark.createDataFrame([(k, t, k, "w") for k, t in enumerate(DOCS)] + [(0, DOCS[0], 1, "w"), (None, DOCS[0], 1, "w")], "doc_id long, text string, item_id int, window string")
    got = contaminated(docs, bench).toPandas()
    assert set(zip(got.doc_id, got.item_id)) == {(d, i) for d, x in enumerate(DOCS) for i, y in enumerate(ITEMS) if x and leaks(x, y)}
    assert {(0, 0), (2, 1), (5, 2)} <= set(zip(got.doc_id, got.item_id)) and not set(got.doc_id) & {4, 6}
    assert got[got.doc_id == 0].reparameterised.all() and not got[got.doc_id == 5].reparameterised.any()
    none = spark.createDataFrame([], "doc_id long, text string")
    assert contaminated(none, bench).count() == 0 and contaminated(docs, bench.limit(0)).count() == 0


def test_long_words(spark):
    long = ["x" * 1_000_000, "1," * 200_000, "-" * 500_000, "Ab" * 300_000, "7" * 500_000, ("y" * 200_000 + " ") * 3]
    docs = spark.createDataFrame([(k, f"{t} {ITEMS[2]}") for k, t in enumerate(long)], "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(ITEMS)), "item_id long, text string")
    began = time.time()
    assert set(contaminated(docs, bench).toPandas().doc_id) == set(range(len(long)))
    assert time.time() - began < 60
