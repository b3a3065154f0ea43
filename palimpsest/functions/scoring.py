"""Decay, importance and confidence formulas (D01-D11, V10, V16, V28).  Times are days unless said."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: weight of each memory type.
TYPE_WEIGHTS = {"semantic": 1.0, "procedural": 0.95, "episodic": 0.7, "working": 0.3}


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def days_between(later: Column, earlier: Column) -> Column:
    """Fractional days, at least 0."""
    seconds = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return F.greatest(F.lit(0.0), seconds / F.lit(86_400e6))


def retention(days: Column, importance: Column, access_count: Column) -> Column:
    """exp(-t / S) with S = importance * 10 * 1.5 ** access_count; 0 where S is not positive."""
    strength = importance * 10.0 * F.pow(F.lit(1.5), access_count)
    return F.when(strength > 0, F.exp(-days / strength)).otherwise(F.lit(0.0))


def importance_score(importance: Column, access_count: Column, entities: Column, days: Column, memory_type: Column) -> Column:
    """Weighted base, access, entity, recency and type factors, scaled by the base."""
    access = F.least(F.lit(1.0), F.log1p(F.greatest(access_count, F.lit(0))) / 5.0)
    linked = F.least(F.lit(1.0), F.greatest(entities, F.lit(0)) / 5.0)
    kind = F.lit(0.7)
    for name, weight in TYPE_WEIGHTS.items():
        kind = F.when(memory_type == name, weight).otherwise(kind)
    total = 0.35 * importance + 0.20 * access + 0.15 * linked + 0.20 * F.exp(-days / 30.0) + 0.10 * kind
    return clamp(total * (0.8 + 0.2 * importance))


def half_life(confidence: Column, age: Column, life: Column | float) -> Column:
    """Confidence * 0.5 ** (age / life)."""
    return confidence * F.pow(F.lit(0.5), age / life)


def usage_score(age: Column, recent_accesses: Column, importance: Column) -> Column:
    """(2 ** (-age / 30) + min(0.15 * accesses of 7 days, 0.5)) * (0.5 + importance), clamped."""
    return clamp((F.pow(F.lit(2.0), -age / 30.0) + F.least(0.15 * recent_accesses, F.lit(0.5))) * (0.5 + importance))


def temporal_score(semantic: Column, days: Column, weight: float) -> Column:
    """Semantic * (1 - w) + w * max(0, 1 - days / 365)."""
    return semantic * (1.0 - weight) + weight * F.greatest(F.lit(0.0), 1.0 - days / 365.0)


def sigmoid(x: Column) -> Column:
    """V10."""
    return 1.0 / (1.0 + F.exp(-x))


def result_confidence(initial: Column, importance: Column, hours: Column, entities: Column) -> Column:
    """Confidence of a reasoning result."""
    bonus = F.when(initial, 0.15).otherwise(0.0) + 0.1 * importance + 0.15 * F.pow(F.lit(2.0), -hours / 720.0)
    return clamp(0.5 + bonus + F.least(F.lit(0.1), 0.02 * entities))


def fresh_boost(score: Column, age_hours: Column) -> Column:
    """Score + 0.1 * 2 ** (-age / 168 h), at most 1."""
    return F.least(F.lit(1.0), score + 0.1 * F.pow(F.lit(2.0), -age_hours / 168.0))
