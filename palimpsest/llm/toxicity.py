"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Texts are folded first: lower case, look-alike letters of other scripts, digits and signs
that stand for letters inside words.  The lexicon holds whole words and word beginnings
with log-odds weights, learned from labelled documents; a word counts once, with its
heaviest entry, unless it lies in an exception phrase.  The weight of a text, plain and by
its length, gives a score from 0 to 1 through a logistic curve.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from palimpsest.llm.shared import freed, frugal, written

# Look-alike letters, and digits or signs used for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m",
    "н": "h", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "υ": "u", "ν": "v", "ѡ": "w", "х": "x", "у": "y",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ο": "o", "ρ": "p", "τ": "t", "χ": "x", "γ": "y", "ı": "i",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}
#: Harmless phrases that hold a word of abuse.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "pathetic fallacy", "idiot proof", "stupid simple", "pond scum", "sore loser", "class clown")

_FULLWIDTH = {0xFF01 + k: 0x21 + k for k in range(94)}
_LOOKS = _FULLWIDTH | {ord(a): b for a, b in HOMOGLYPHS.items()} | {0x200B: None, 0x200C: None, 0x200D: None, 0xAD: None, 0xFEFF: None}
_FOREIGN = re.compile("[Ͱ-ԯı​-‍­﻿！-～]")
_DISGUISED = re.compile(r"\S*(?:[^\W\d_][0-9@$]|[0-9@$][^\W\d_])\S*")
_EDGE = re.compile(r"^[^\w]+|[^\w]+$")
_DIGITS = str.maketrans(DIGITS)
_GAPS = re.compile(r"[\W_]+")
LENGTHS = range(3, 9)


def fold(text: str) -> str:
    """`` word word ... `` of the folded text: one space between words and at both ends."""
    text = text.lower()
    if _FOREIGN.search(text):
        text = text.translate(_LOOKS).lower()
    if any(d in text for d in DIGITS):
        text = _DISGUISED.sub(lambda m: _EDGE.sub(" ", m[0]).translate(_DIGITS), text)
    return " " + _GAPS.sub(" ", text).strip() + " "


@dataclass
class Lexicon:
    """weights: entry -> weight; an entry " abc" is a word beginning, " abc " a whole word."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, float, float] = (1.0, 1.0, -4.0)
    _automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {"weights": self.weights, "exceptions": self.exceptions, "curve": self.curve, "_automaton": None}

    def automaton(self):
        if self._automaton is None:
            a = ahocorasick.Automaton()
            for entry, weight in self.weights.items():
                a.add_word(entry, (len(entry), weight))
            for phrase in self.exceptions:
                a.add_word(f" {phrase} ", (len(phrase) + 2, None))
            if len(a):
                a.make_automaton()
            self._automaton = a
        return self._automaton

    def measure(self, text: str) -> tuple[float, float]:
        """(log weight, log weight by length) of a text; (0, 0) where nothing matches."""
        a = self.automaton()
        if not text or not len(a):
            return 0.0, 0.0
        folded = fold(text)
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (size, weight) in a.iter(folded):
            begin = end - size + 1
            if weight is None:
                spared.append((begin, end))
            elif weight > best.get(begin, 0.0):
                best[begin] = weight
        if spared:
            begins, stops = zip(*sorted(spared), strict=True)
            reach = list(accumulate(stops, max))
            best = {b: w for b, w in best.items() if not ((k := bisect_right(begins, b)) and b < reach[k - 1])}
        if not best:
            return 0.0, 0.0
        total = sum(best.values())
        return float(np.log1p(total)), float(np.log1p(100.0 * total / folded.count(" ")))

    def score(self, text: str) -> float:
        x, y = self.measure(text)
        p, q, r = self.curve
        return float(1.0 / (1.0 + np.exp(-np.clip(p * x + q * y + r, -30, 30))))


def _entries(text: str) -> set[str]:
    out: set[str] = set()
    for word in set(fold(text).split(" ")):
        if len(word) >= LENGTHS[0]:
            out.add(f" {word} ")
            out.update(f" {word[:k]}" for k in LENGTHS if k <= len(word))
    return out


def _count_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic, half) -> (entry, counts by toxic and half), summed within the batch."""
    for batch in batches:
        counts: list[Counter[str]] = [Counter() for _ in range(4)]
        for text, toxic, half in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            counts[2 * toxic + half].update(_entries(text))
        names = list(set().union(*counts))
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), *(pa.array([c[n] for n in names], pa.int64()) for c in counts)], names=["entry", "c0", "c1", "t0", "t1"]
        )


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Ridge logistic regression by Newton steps; the last coefficient is the intercept."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    penalty = np.diag([ridge] * x.shape[1] + [1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + penalty, a.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(v) for v in w)


def _weigh(rows: pd.DataFrame, toxic: int, clean: int, t: str, c: str, least: int, floor: float) -> dict[str, float]:
    weight = np.log((rows[t] + 0.5) / (toxic + 1)) - np.log((rows[c] + 0.5) / (clean + 1))
    keep = (rows[t] >= least) & (weight >= floor)
    return dict(zip(rows["entry"][keep], weight[keep].astype(float), strict=True))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def learn_lexicon(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000, least: int = 3, floor: float = 2.0) -> Lexicon:
    """A lexicon from labelled documents (labels: doc_id, toxic) that are not held out.

    Bounded sample: about ``max_rows`` labelled rows, chosen by a hash of doc_id, so the
    ids broadcast to find their texts, the lexicon (all of the sample's entries that count)
    and the points of the curve do not grow with the input.  The curve is fitted on scores of each half of the
    sample under the lexicon of the other half.  Labels that are null are left out; of
    several labels of a doc_id the highest counts.  Without both labels the lexicon is empty.
    """
    spark = docs.sparkSession
    marked = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    marked = marked.where(~held_out())
    total = marked.count()
    share = min(1.0, max_rows / max(total, 1))
    spot = F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(1_000_000))
    ids = marked.where(spot < int(1_000_000 * share)).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2)).cast("int"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sample = written(texts.join(F.broadcast(ids), "doc_id").select("text", F.expr("int(toxic > 0)").alias("toxic"), "half"), "labelled")
    sizes = {(r.toxic, r.half): r.n for r in sample.groupBy("toxic", "half").agg(F.count("*").alias("n")).collect()}
    t0, t1, c0, c1 = (sizes.get(k, 0) for k in ((1, 0), (1, 1), (0, 0), (0, 1)))
    if not t0 + t1 or not c0 + c1:
        return Lexicon({})
    counts = sample.mapInArrow(frugal(_count_entries), "entry string, c0 long, c1 long, t0 long, t1 long").groupBy("entry").agg(*(F.sum(x).alias(x) for x in ("c0", "c1", "t0", "t1")))
    counts = counts.withColumns({"t": F.col("t0") + F.col("t1"), "c": F.col("c0") + F.col("c1")})
    odds = F.log((F.col("t") + 0.5) / (t0 + t1 + 1)) - F.log((F.col("c") + 0.5) / (c0 + c1 + 1))
    found = counts.where((F.col("t") >= least) & (odds >= floor)).toPandas()
    halves = [Lexicon(_weigh(found, t1, c1, "t1", "c1", 2, floor)), Lexicon(_weigh(found, t0, c0, "t0", "c0", 2, floor))]

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, toxic, half = (batch.column(k).to_pylist() for k in range(3))
            xy = np.array([halves[h].measure(t) for t, h in zip(text, half, strict=True)]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(xy[:, 0]), pa.array(xy[:, 1]), pa.array(toxic, pa.int32())], names=["x", "y", "toxic"])

    seen = sample.mapInArrow(frugal(points), "x double, y double, toxic int").toPandas()
    curve = _logistic(seen[["x", "y"]].to_numpy(), seen["toxic"].to_numpy(float))
    return Lexicon(_weigh(found, t0 + t1, c0 + c1, "t", "c", least, floor), curve=curve)


def toxicity(lexicon: Lexicon, text: str = "text") -> Column:
    """The score of a text column, 0 to 1; null and empty texts have the score of no match."""

    @pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in freed(parts):
            yield pd.Series([lexicon.score(t or "") for t in texts], dtype="float64")

    return score(F.col(text).cast("string"))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text.

    Only texts enter a score.  Null and repeated doc_ids are ordinary rows (a null one is not
    held out); other columns are ignored; an empty table gives an empty result.
    """
    lexicon = learn_lexicon(docs, labels)
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = thin.select("doc_id", held_out().alias("held_out"), toxicity(lexicon).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
