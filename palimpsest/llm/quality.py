"""Quality rules by robust multivariate outliers: minimum covariance determinant per language and source.

Each document has a vector of transformed statistics.  For every (language, source) group
the centre and scatter of the most concentrated share of its rows are found by C-steps
from three deterministic starts: medians and MADs, and these with two robust
correlations.  After a few steps the start whose scatter has the smallest determinant goes
on alone.  A C-step is two aggregations over all rows: the distance quantile of each group
(partial quantile sketches), then the moments of the rows within it; so a group that holds
a third of all rows is summed in pieces like any other, and no group meets in one task.
Rows far from their group's estimate by Mahalanobis distance are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.shared import fresh_name, written
from palimpsest.llm.wordhash import BYTE_BASE, mix64, text_slices, window_starts, windows, words

SYMBOLS = b"#*$%&|<>"
STATS = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
FEATURES = ["f_words", "f_length", "f_symbols", "f_lines", "f_repeat"]
#: Smallest standard deviation of each feature: statistics that are nearly always 0 have no scatter of their own.
FLOORS = [0.25, 0.05, 0.15, 0.3, 0.08]
#: Chi-square quantiles for five degrees of freedom: the median and the share 1 - 1e-6.
CHI2_MEDIAN, CHI2_CUT = 4.3515, 35.8882
PARAMS = "group string, start int, center array<double>, inverse array<double>, log_det double"
PARAM_NAMES = [c.split()[0] for c in PARAMS.split(", ")]
#: C-steps of every start before the one of the smallest determinant goes on alone.
START_STEPS = 2
#: Groups whose estimates are broadcast: about 1 KB for each, so 16 MB.
BROADCAST_GROUPS = 16_000
SALTS = 64
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True


def _line_duplicates(data: np.ndarray, doc_ends: np.ndarray, word_starts: np.ndarray) -> np.ndarray:
    """Per text: lines with a word that equal an earlier line of the text."""
    if not len(data):
        return np.zeros(len(doc_ends), np.int64)
    cuts = np.unique(np.concatenate([[0], np.flatnonzero(data == 0x0A) + 1, doc_ends]))
    starts = cuts[cuts < len(data)]
    lengths = np.diff(np.append(starts, len(data)))
    place = np.arange(len(data)) - np.repeat(starts, lengths)
    powers = np.cumprod(np.full(int(lengths.max()), BYTE_BASE, np.uint64))
    # a final line end is not part of the line
    value = mix64(data.astype(np.uint64) + np.uint64(1)) * powers[place]
    value[data == 0x0A] = 0
    line = mix64(np.add.reduceat(value, starts))
    with_word = np.zeros(len(starts), bool)
    with_word[np.searchsorted(starts, word_starts, side="right") - 1] = True
    doc = np.searchsorted(doc_ends, starts, side="right")
    line, doc = line[with_word], doc[with_word]
    order = np.lexsort((line, doc))
    again = np.zeros(len(line), bool)
    again[1:] = (line[order][1:] == line[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    return np.bincount(doc[order][again], minlength=len(doc_ends))


def _repeated_words(hashes: np.ndarray, bounds: np.ndarray, width: int) -> np.ndarray:
    """Per text: words inside ``width``-word windows that occur twice or more in the text."""
    at = np.flatnonzero(window_starts(bounds, width, len(hashes)))
    if not len(at):
        return np.zeros(len(bounds) - 1, np.int64)
    h = mix64(windows(hashes, width)[at])
    doc = np.searchsorted(bounds, at, side="right") - 1
    order = np.lexsort((h, doc))
    h, doc, at = h[order], doc[order], at[order]
    equal = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    again = np.append(equal, False) | np.append(False, equal)
    edge = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edge, at[again], 1)
    np.add.at(edge, at[again] + width, -1)
    covered = np.append(0, np.cumsum(np.cumsum(edge)[:-1] > 0))
    return covered[bounds[1:]] - covered[bounds[:-1]]


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, piece in text_slices(batch.column(3)):
            w = words(piece)
            offsets = np.frombuffer(piece.buffers()[1], np.int64)[piece.offset : piece.offset + len(piece) + 1]
            ends = offsets[1:] - offsets[0]
            counts = np.diff(w.bounds)
            letters = np.append(0, np.cumsum((w.data & 0xC0) != 0x80))
            chars = np.append(0, np.cumsum(letters[w.ends] - letters[w.starts]))
            marks = np.append(0, np.cumsum(_IS_SYMBOL[w.data]))
            symbols = np.diff(np.append(0, marks[ends]))
            lines = _line_duplicates(w.data, ends, w.starts)
            repeats = _repeated_words(w.hashes, w.bounds, 8)
            own = [batch.column(k).slice(first, len(piece)) for k in range(3)]
            made = [counts, chars[w.bounds[1:]] - chars[w.bounds[:-1]], symbols, lines, repeats]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(x.astype(np.int64)) for x in made)], names=[c.split()[0] for c in STATS.split(", ")])


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of whole texts."""
    thin = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")),
    )
    return thin.mapInArrow(_statistics, STATS)


def _features(stats: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return stats.withColumns(
        {
            "f_words": F.log1p("n_words"),
            "f_length": F.log((F.col("word_chars") + 1) / n),
            "f_symbols": F.log1p(4.0 * F.col("n_symbols") / n),
            "f_lines": F.log1p("n_dup_lines"),
            "f_repeat": F.col("n_repeat_words") / n,
        }
    )


def _distance() -> Column:
    """Squared Mahalanobis distance of the features from (center, inverse)."""
    gap = [F.col(f) - F.col("center")[i] for i, f in enumerate(FEATURES)]
    p = len(FEATURES)
    terms = [F.col("inverse")[i * p + j] * gap[i] * gap[j] * (1.0 if i == j else 2.0) for i in range(p) for j in range(i, p)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def _pieces(row: list[float], p: int) -> np.ndarray:
    """A symmetric matrix from its upper triangle."""
    upper = np.zeros((p, p))
    upper[np.triu_indices(p)] = row
    return upper + np.triu(upper, 1).T


def _parameters(center: np.ndarray, scatter: np.ndarray) -> tuple[list, list, float]:
    """Centre, inverse and log determinant of a scatter to which the floors are added."""
    scatter = scatter + np.diag(np.square(FLOORS))
    return center.tolist(), np.linalg.inv(scatter).ravel().tolist(), float(np.linalg.slogdet(scatter)[1])


def _starts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each group's START_KINDS first estimates, all centred at its medians and scaled by its MADs."""
    p = len(FEATURES)
    for batch in batches:
        out = []
        for row in batch.itertuples(index=False):
            scale = 1.4826 * np.array(row.spreads, float)
            for start, moments in enumerate((None, row.curbed, row.signs)):
                alike = np.eye(p)
                if moments is not None:
                    second = _pieces(moments, p)
                    size = np.sqrt(np.maximum(np.diag(second), 1e-12))
                    alike = second / np.outer(size, size)
                    np.fill_diagonal(alike, 1.0)
                out.append((row.group, start, *_parameters(np.array(row.middles, float), np.outer(scale, scale) * alike)))
        yield pd.DataFrame(out, columns=PARAM_NAMES)


def _estimates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row a group and start: moments -> centre, inverse and log determinant of the (floored) scatter."""
    for batch in batches:
        out = []
        for row in batch.itertuples(index=False):
            m = np.array(row.sums, float) / row.n
            scatter = _pieces(np.array(row.products, float) / row.n, len(FEATURES)) - np.outer(m, m)
            out.append((row.group, row.start, *_parameters(m, scatter)))
        yield pd.DataFrame(out, columns=PARAM_NAMES)


def _attach(rows: DataFrame, values: DataFrame, keys: list[str], few: bool, how: str = "inner") -> DataFrame:
    """rows with the values of their group.

    ``few``: the groups were counted, and are at most BROADCAST_GROUPS; their values are
    broadcast.  Otherwise each group's rows are dealt over SALTS parts, so that no task
    gets a whole large group.
    """
    if few:
        return rows.join(F.broadcast(values), keys, how)
    salt = fresh_name()
    dealt = rows.withColumn(salt, F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)))
    copies = values.withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return dealt.join(copies, [*keys, salt], how).drop(salt)


def _c_step(rows: DataFrame, params: DataFrame, share: float, few: bool) -> DataFrame:
    """New params from the ``share`` of each group's rows that lie nearest to each of its estimates."""
    near = _attach(rows, params, ["group"], few).withColumn("d2", _distance())
    cut = near.groupBy("group", "start").agg(F.percentile_approx("d2", F.lit(share), F.lit(2000)).alias("cut"))
    chosen = _attach(near, cut, ["group", "start"], few).where("d2 <= cut")
    products = [F.sum(F.col(a) * F.col(b)) for i, a in enumerate(FEATURES) for b in FEATURES[i:]]
    moments = chosen.groupBy("group", "start").agg(
        F.count("*").alias("n"), F.array(*(F.sum(f) for f in FEATURES)).alias("sums"), F.array(*products).alias("products")
    )
    return moments.mapInPandas(_estimates, PARAMS)


def _first_estimates(fit: DataFrame, few: bool) -> DataFrame:
    """params of all starts: medians and MADs alone, with the correlation of curbed (tanh) values, with that of spatial signs."""
    middles = F.array(*(F.percentile_approx(f, F.lit(0.5), F.lit(2000)).cast("double") for f in FEATURES))
    start = written(fit.groupBy("group").agg(middles.alias("middles")), "medians")
    gaps = [F.abs(F.col(f) - F.col("middles")[i]) for i, f in enumerate(FEATURES)]
    spreads = F.array(*(F.percentile_approx(g, F.lit(0.5), F.lit(2000)).cast("double") for g in gaps))
    start = written(_attach(fit, start, ["group"], few).groupBy("group").agg(F.first("middles").alias("middles"), spreads.alias("spreads")), "spreads")
    scaled = [
        ((F.col(f) - F.col("middles")[i]) / F.sqrt(F.pow(1.4826 * F.col("spreads")[i], 2) + FLOORS[i] ** 2)).alias(f"z{i}")
        for i, f in enumerate(FEATURES)
    ]
    z = [F.col(f"z{i}") for i in range(len(FEATURES))]
    pairs = [(i, j) for i in range(len(z)) for j in range(i, len(z))]
    length = sum((x * x for x in z[1:]), z[0] * z[0])
    rows = _attach(fit, start, ["group"], few).select("group", *scaled).withColumn("length", F.greatest(length, F.lit(1e-12)))
    sums = rows.groupBy("group").agg(
        F.array(*(F.sum(F.tanh(z[i]) * F.tanh(z[j])) for i, j in pairs)).alias("curbed"),
        F.array(*(F.sum(z[i] * z[j] / F.col("length")) for i, j in pairs)).alias("signs"),
    )
    return start.join(sums, "group").mapInPandas(_starts, PARAMS)


def robust_outliers(
    docs: DataFrame, share: float = 0.75, steps: int = 3, min_group: int = 50, cut: float = CHI2_CUT, min_words: int = 20, max_repeat_percent: int = 30
) -> DataFrame:
    """doc_id, the five base statistics, base_failed, kept, distance.

    base_failed: fewer than ``min_words`` words, or more than ``max_repeat_percent`` % of
    the words in repeated 8-word windows.  Of the others, those are kept whose squared
    distance, scaled so that the group's median is that of a chi-square variable, is at
    most ``cut``.  Estimates use all rows that pass the base rule.  A (lang, source) group
    with fewer than ``min_group`` such rows is pooled with the other small groups of its
    language; if that pool is small too, its rows are kept with a null distance.  Null lang
    or source count as empty strings, a null text as an empty one; null or repeated doc_ids
    are ordinary rows; other columns are ignored; an empty table gives an empty result.
    """
    rows = _features(statistics(docs)).withColumn(
        "base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    )
    rows = written(rows, "statistics")
    fit = rows.where("not base_failed")
    whole = F.concat_ws("\x1f", "lang", "source")
    pooled = F.concat_ws("\x1f", "lang", F.lit("\x1e"))
    sizes = fit.groupBy("lang", "source").agg(F.count("*").alias("size"))
    groups = sizes.select("lang", "source", F.when(F.col("size") >= min_group, whole).otherwise(pooled).alias("group"), "size")
    enough = groups.groupBy("group").agg(F.sum("size").alias("total")).where(F.col("total") >= min_group).select("group")
    groups = written(groups.join(enough, "group", "left_semi").select("lang", "source", "group"), "groups")
    few = groups.count() <= BROADCAST_GROUPS
    rows = _attach(rows, groups, ["lang", "source"], few, "left")
    fit = rows.where("not base_failed and group is not null")
    params = written(_first_estimates(fit, few), "estimates")
    for _ in range(START_STEPS):
        params = written(_c_step(fit, params, share, few), "estimates")
    best = F.min_by(F.struct("start", "center", "inverse", "log_det"), F.struct("log_det", "start"))
    params = written(params.groupBy("group").agg(best.alias("best")).select("group", "best.*"), "estimates")
    for _ in range(steps):
        params = written(_c_step(fit, params, share, few), "estimates")
    near = _attach(fit, params, ["group"], few).withColumn("d2", _distance())
    scale = near.groupBy("group").agg(F.greatest(F.percentile_approx("d2", F.lit(0.5), F.lit(2000)) / CHI2_MEDIAN, F.lit(1.0)).alias("scale"))
    params = written(params.join(scale, "group"), "estimates")
    scored = _attach(rows, params, ["group"], few, "left").withColumn("distance", _distance() / F.col("scale"))
    return scored.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cut)).alias("kept"), "distance",
    )
