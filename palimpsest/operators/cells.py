"""Exact joins of similar vectors over cells with centre and radius.

Vectors are dealt to the nearest of a bounded number of centres.  On the sphere, a vector
at the angle t from a cell's centre is at least t - radius away from its members, so it
visits only the cells where that leaves the asked similarity possible; no pair is lost.
Each pair meets in one cell: the vector of the lower cell visits that of the higher one.
Large cells are cut into blocks.  A block's members are held by a task as one matrix and
its visitors are streamed past them, so memory is bounded whatever the cells' sizes.

A key (the vectors of one user, say) of at most BLOCK rows is a cell of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.shared import stored

#: Rows of a block; bytes of the centres that all tasks hold.
BLOCK = 2048
CENTRE_BYTES = 8 << 20
#: Rows whose visits are made at a time.
VISITS = 128
#: Angles and cosines are compared with this margin, far above rounding.
MARGIN = 1e-7


def units(lists: pa.Array, size: int) -> np.ndarray:
    """Rows of a list column of equal length as unit rows; zeros stay zeros."""
    m = lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _angles(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ centres.T, -1, 1))


def _place(centres: dict[int, np.ndarray]):
    """(id, key, size, small, vector, more) -> the same with cell and angle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).to_numpy()
            for size in np.unique(sizes):
                rows = batch.take(pa.array(np.flatnonzero(sizes == size)))
                x = units(rows.column(4), int(size))
                angle = _angles(x, centres[int(size)])
                cell = angle.argmin(axis=1)
                near = angle[np.arange(len(x)), cell]
                alone = rows.column(3).to_numpy(zero_copy_only=False)
                cell[alone], near[alone] = 0, 0.0
                columns = [*(rows.column(i) for i in range(6)), pa.array(cell.astype(np.int32)), pa.array(near)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "key", "size", "small", "vector", "more", "cell", "angle"])

    return run


def _visits(centres: dict[int, np.ndarray], radii: dict[tuple[int, int], float], limit: float):
    """Placed rows of large keys -> a row for each higher cell that may hold a similar vector (to, reach: angle to its centre)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).to_numpy()
            for size in np.unique(sizes):
                radius = np.array([radii.get((int(size), c), -np.inf) for c in range(len(centres[int(size)]))])
                every = np.flatnonzero(sizes == size)
                for first in range(0, len(every), VISITS):  # a row may visit many cells
                    rows = batch.take(pa.array(every[first : first + VISITS]))
                    own = rows.column(5).to_numpy()
                    angle = _angles(units(rows.column(3), int(size)), centres[int(size)])
                    row, to = np.nonzero((angle - radius <= limit) & (np.arange(len(radius)) > own[:, None]))
                    picked = rows.take(pa.array(row))
                    columns = [*(picked.column(i) for i in range(5)), pa.array(to.astype(np.int32)), pa.array(angle[row, to])]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "key", "size", "vector", "more", "to", "reach"])

    return run


def _compare(least: float, most: int | None, bonus: float):
    """Members, then visitors, of sorted blocks -> pairs (a, b, score); with ``most``, each block's best ones."""

    def pairs(ids, more, x, other_ids, other_more, y, same: bool):
        cosine = x @ y.T
        i, j = np.nonzero(cosine >= least - MARGIN)
        if same:
            i, j = i[i < j], j[i < j]
        score = cosine[i, j]
        keep = np.round(score, 9) >= least
        i, j, score = i[keep], j[keep], score[keep]
        if bonus:
            score = score + bonus * sum((more[k][i] != other_more[k][j]).astype(float) for k in range(2))
        a, b = ids[i], other_ids[j]
        return np.where(a < b, a, b), np.where(a < b, b, a), score

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, x, best = None, [], None, []

        def out(found: list[tuple]) -> pa.RecordBatch:
            a, b, s = (np.concatenate(c) for c in zip(*found, strict=True))
            if most and len(s) > most:
                at = np.lexsort((b, a, -np.round(s, 9)))[:most]
                a, b, s = a[at], b[at], s[at]
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(s)], names=["a", "b", "score"])

        def joined():
            return np.concatenate([h[0] for h in held]), [np.concatenate([h[1][k] for h in held]) for k in range(2)], np.concatenate([h[2] for h in held])

        def inner():
            nonlocal x
            if x is None and held:
                x = joined()
                return [pairs(*x, *x, True)]
            return []

        for batch in batches:
            marks = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            cuts = np.flatnonzero(np.any([m[1:] != m[:-1] for m in marks], axis=0)) + 1
            cuts = np.union1d(cuts, np.arange(BLOCK, batch.num_rows, BLOCK)).astype(int)
            for begin, end in zip(np.append(0, cuts), np.append(cuts, batch.num_rows)):
                mark, visitor = tuple(m[begin] for m in marks[:4]), marks[4][begin]
                piece = batch.slice(begin, end - begin)
                more = piece.column(7)
                own = (
                    piece.column(5).to_numpy(zero_copy_only=False),
                    [more.field(k).to_numpy(zero_copy_only=False) for k in range(2)],
                    units(piece.column(6), int(marks[1][begin])),
                )
                if mark != block:
                    best += inner()
                    block, held, x = mark, [], None
                if not visitor:
                    held.append(own)
                elif held:
                    best += inner()
                    best.append(pairs(*x, *own, False))
            if best and sum(len(s) for *_, s in best):
                made = out(best)
                best = [] if most is None else [tuple(made.column(i).to_numpy(zero_copy_only=False) for i in range(3))]
                if most is None:
                    yield made
        best += inner()
        if best and sum(len(s) for *_, s in best):
            yield out(best)

    return run


def cells_a_block(least: float) -> int:
    """Cells for each block that suit a threshold."""
    return 4 if least >= 0.7 else 1


class Cells:
    """Vectors (id, vector and optionally ``by`` and two columns to compare) dealt to cells; null and zero vectors are left out.

    per_block: cells for each block of rows.  More cells prune more where the asked
    similarity is high; where nothing can be pruned, a row visits them all.
    """

    def __init__(self, rows: DataFrame, by: str | None = None, more: tuple[str, str] | None = None, block: int = BLOCK, per_block: int = 1):
        self.block = block
        self.id_type = rows.schema["id"].dataType.simpleString()
        labels = F.struct(*(F.coalesce(F.to_json(F.struct(F.col(c))), F.lit("")).alias(n) for c, n in zip(more, ("x", "y")))) if more else F.struct(F.lit("").alias("x"), F.lit("").alias("y"))
        key = F.coalesce(F.to_json(F.struct(F.col(by).alias("k"))), F.lit("")) if by else F.lit("")
        # single precision stays so in shuffles; all arithmetic is double
        kind = "array<float>" if rows.schema["vector"].dataType.simpleString() == "array<float>" else "array<double>"
        thin = rows.where("vector is not null").select("id", key.alias("key"), F.size("vector").alias("size"), F.col("vector").cast(kind).alias("vector"), labels.alias("more"))
        thin = thin.where(F.exists("vector", lambda v: v != 0) & ~F.exists("vector", lambda v: v.isNull() | F.isnan(v)))
        keys = thin.groupBy("key", "size").agg(F.count("*").alias("n"))
        keys = stored(keys, "keys")
        large = keys.where(F.col("n") > block)
        total = keys.agg(F.sum("n")).first()[0] or 0
        sizes = [r.size for r in keys.select("size").distinct().collect()]
        count = {s: max(1, min(math.ceil(math.sqrt(total)), per_block * math.ceil(total / block), CENTRE_BYTES // (8 * max(s, 1) * len(sizes)))) for s in sizes}
        # bounded: CENTRE_BYTES in all
        self.centres: dict[int, np.ndarray] = {}
        for s in sizes:
            chosen = thin.where(F.col("size") == s).orderBy(F.xxhash64("id"), "id").limit(count[s]).select("vector").toArrow()
            self.centres[s] = units(chosen["vector"].combine_chunks(), s)
        shape = f"id {self.id_type}, key string, size int, small boolean, vector {kind}, more struct<x: string, y: string>, cell int, angle double"
        flagged = thin.join(large.select("key", "size", F.lit(False).alias("small")), ["key", "size"], "left")
        flagged = flagged.select("id", "key", "size", F.coalesce("small", F.lit(True)).alias("small"), "vector", "more")
        self.placed = stored(flagged.mapInArrow(_place(self.centres), shape), "placed")
        stats = self.placed.groupBy("key", "size", "small", "cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n"))
        self.stats = stored(stats.withColumn("blocks", F.ceil(F.col("n") / block).cast("int")), "cells")
        self.radii = {(r.size, r.cell): r.radius for r in self.stats.where("not small").groupBy("size", "cell").agg(F.max("radius").alias("radius")).collect()}
        self.kind = kind

    def dealt(self, least: float) -> DataFrame:
        """Rows by block: members, and the visitors that may be similar by ``least``."""
        limit = math.acos(max(-1.0, min(1.0, least))) + MARGIN
        salt = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
        # equal ids of different rows would fall together; their blocks only grow
        here = self.placed.join(self.stats.select("key", "size", "small", "cell", "blocks"), ["key", "size", "small", "cell"]).withColumn("salt", salt)
        members = here.select("key", "size", "cell", "salt", F.lit(False).alias("visitor"), "id", "vector", "more")
        inside = here.where("blocks > salt + 1").withColumn("to", F.explode(F.sequence(F.col("salt") + 1, F.col("blocks") - 1)))
        inside = inside.select("key", "size", "cell", F.col("to").alias("salt"), F.lit(True).alias("visitor"), "id", "vector", "more")
        large = self.placed.where("not small").select("id", "key", "size", "vector", "more", "cell")
        shape = f"id {self.id_type}, key string, size int, vector {self.kind}, more struct<x: string, y: string>, to int, reach double"
        away = large.mapInArrow(_visits(self.centres, self.radii, limit), shape)
        cells = self.stats.where("not small").select("key", "size", F.col("cell").alias("to"), "radius", "blocks")
        away = away.join(cells, ["key", "size", "to"]).where(F.col("reach") - F.col("radius") <= limit)
        away = away.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        away = away.select("key", "size", F.col("to").alias("cell"), "salt", F.lit(True).alias("visitor"), "id", "vector", "more")
        return members.unionByName(inside).unionByName(away)

    def pairs(self, least: float, most: int | None = None, bonus: float = 0.0) -> DataFrame:
        """(a, b, score), a < b, of every pair of one key with cosine (to nine places) >= least; with ``most``, the best of each task.

        ``bonus`` is added for each of the two compared columns that differs.
        """
        mark = ["key", "size", "cell", "salt"]
        rows = self.dealt(least).repartition(*mark).sortWithinPartitions(*mark, "visitor").select(*mark, "visitor", "id", "vector", "more")
        return rows.mapInArrow(_compare(least, most, bonus), f"a {self.id_type}, b {self.id_type}, score double")

    def share_compared(self, least: float) -> float:
        """Compared pairs over all pairs of the same key and length."""
        blocks = self.dealt(least).groupBy("key", "size", "cell", "salt").agg(F.sum((~F.col("visitor")).cast("double")).alias("m"), F.sum(F.col("visitor").cast("double")).alias("v"))
        done = blocks.agg(F.sum(F.col("m") * (F.col("m") - 1) / 2 + F.col("m") * F.col("v"))).first()[0] or 0.0
        whole = self.placed.groupBy("key", "size").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2.0)).first()[0] or 0.0
        return done / max(whole, 1.0)
