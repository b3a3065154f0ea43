"""Vectors of several modalities in one space."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.vector import cosine, fit_length
from palimpsest.operators.retrieval import reciprocal_rank_fusion, vector_matches


def projections(dims: dict[str, int], target: int, seed: int = 42) -> dict[str, np.ndarray]:
    """An orthonormal matrix (input, target) for each modality, drawn in the order of ``dims`` from one seed; the same in every task.

    A modality of fewer dimensions than the target fills as many as it has.
    """
    rng, out = np.random.default_rng(seed), {}
    for modality, size in dims.items():
        q, _ = np.linalg.qr(rng.standard_normal((size, target)))
        out[modality] = np.pad(q, ((0, 0), (0, target - q.shape[1])))
    return out


def align(rows: DataFrame, dims: dict[str, int], target: int, seed: int = 42) -> DataFrame:
    """Rows (modality, vector, ...) with ``vector`` in the unified space of ``target`` dimensions.

    A modality of ``dims`` is projected; a vector of another length, or of another modality,
    is cut or padded with zeros.  Null vectors stay null.
    """
    matrices = projections(dims, target, seed)
    names = rows.columns
    known = rows.select(*(c for c in names if c != "vector"), F.col("vector").cast("array<double>").alias("vector"))
    shape = known.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, kinds = batch.column("vector"), np.array(batch.column("modality").to_pylist(), object)
            sizes = np.array([-1 if n is None else n for n in lists.value_lengths().to_pylist()])
            out: list = lists.to_pylist()
            for modality, matrix in matrices.items():
                at = np.flatnonzero((kinds == modality) & (sizes == len(matrix)))
                if len(at):
                    x = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1)
                    for k, v in zip(at, x @ matrix):
                        out[k] = v
            columns = [pa.array(out, lists.type) if c == "vector" else batch.column(c) for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    projected = known.mapInArrow(run, shape)
    return projected.select(*(fit_length("vector", target).alias("vector") if c == "vector" else F.col(f"`{c}`") for c in names))


def unified_search(queries: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, modality, id, score, rank) of the best k aligned items (id, modality, vector) for aligned queries (query_id, vector)."""
    found = vector_matches(queries.select("query_id", "vector"), items.select("id", "vector"), k)
    return found.join(items.select("id", "modality"), "id").select("query_id", "modality", "id", "score", "rank")


def fuse(ranked: DataFrame, k: int = 60, metadata: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score, modality_scores, metadata) of ranked (query_id, modality, id, score) by reciprocal ranks.

    modality_scores maps each modality to the item's own score.  metadata: (id, modality,
    metadata map); entries of later modalities (by name) replace those of earlier ones.
    """
    scores = reciprocal_rank_fusion(ranked.select("query_id", F.col("modality").alias("method"), "id", "score"), k).select("query_id", "id", "score")
    own = ranked.groupBy("query_id", "id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("modality", "score")))).alias("modality_scores"))
    out = scores.join(own, ["query_id", "id"])
    if metadata is None:
        return out
    seen = ranked.select("query_id", "id", "modality").join(metadata, ["id", "modality"])
    entries = seen.select("query_id", "id", "modality", F.explode("metadata").alias("k", "v"))
    last = entries.groupBy("query_id", "id", "k").agg(F.max_by("v", "modality").alias("v"))
    merged = last.groupBy("query_id", "id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("metadata"))
    return out.join(merged, ["query_id", "id"], "left")


def cross_modal_search(queries: DataFrame, items: DataFrame, k: int = 10, modalities: list[str] | None = None, rrf_k: int = 60) -> DataFrame:
    """The best k of all items, those of the asked modalities ranked in each and fused: (query_id, id, score, modality_scores)."""
    found = unified_search(queries, items, k)
    return fuse(found if modalities is None else found.where(F.col("modality").isin(modalities)), rrf_k)


def alignment_quality(pairs: DataFrame) -> DataFrame:
    """Mean, least and largest cosine of aligned pairs (vector_a, vector_b); 0 without pairs."""
    score = cosine("vector_a", "vector_b")
    names = ("mean_similarity", "min_similarity", "max_similarity")
    return pairs.select(score.alias("s")).agg(*(F.coalesce(f("s"), F.lit(0.0)).alias(n) for f, n in zip((F.avg, F.min, F.max), names)))
