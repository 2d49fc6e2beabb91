"""Scoring expressions. Constants are the shipped defaults; every function takes its own."""

from __future__ import annotations

import math
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
RRF_K = 20
PIVOT_MIN, PIVOT_MAX = 100.0, 20000.0
DEPENDENTS_PIVOT = 1000.0
RECENCY_FLOOR = 0.25
HALF_LIFE_DAYS = 365.0
DEMOTE_ARCHIVED, DEMOTE_FORK = 0.5, 0.8
EXACT_SCORE, PREFIX_SCORE = 1.0, 0.7


@dataclass(frozen=True)
class LaneWeights:
    full_text: float = 1.0
    semantic: float = 1.0
    name: float = 0.5
    rrf_k: int = RRF_K


@dataclass(frozen=True)
class ScoringWeights:
    similarity: float = 1.0
    stars: float = 0.3
    recency: float = 0.2
    criticality: float = 0.0
    half_life_days: float = HALF_LIFE_DAYS


def rrf(fts: Column, dense: Column, name: Column, lanes: LaneWeights = LaneWeights()) -> Column:
    """Weighted reciprocal ranks, added in this order; a missing lane adds 0."""

    def term(weight: float, rank: Column) -> Column:
        return F.lit(float(weight)) * F.coalesce(F.lit(1.0) / (F.lit(float(lanes.rrf_k)) + rank), F.lit(0.0))

    return term(lanes.full_text, fts) + term(lanes.semantic, dense) + term(lanes.name, name)


def minmax(value: Column, low: Column, high: Column) -> Column:
    return F.when(high > low, (value - low) / (high - low)).otherwise(1.0)


def star_pivot(mean_log: Column, low: float = PIVOT_MIN, high: float = PIVOT_MAX) -> Column:
    """Clamped geometric mean, from the mean of ln(max(stars, 1))."""
    return F.least(F.lit(high), F.greatest(F.lit(low), F.exp(mean_log)))


def saturate(value: Column, pivot: Column) -> Column:
    value = F.coalesce(value, F.lit(0)).cast("double")
    return value / (value + pivot)


def recency(pushed_at: Column, now: datetime, half_life_days: float = HALF_LIFE_DAYS, floor: float = RECENCY_FLOOR) -> Column:
    """Floored half-life decay; null scores 0, the future counts as now."""
    now = now if now.tzinfo else now.replace(tzinfo=UTC)
    micros = F.lit(round(now.timestamp() * 1e6))
    age = F.greatest(F.lit(0.0), (micros - F.unix_micros(pushed_at.cast("timestamp"))) / F.lit(86_400e6))
    decay = F.lit(floor) + F.lit(1.0 - floor) * F.exp(-age * F.lit(math.log(2)) / F.lit(float(half_life_days)))
    return F.when(pushed_at.isNull(), 0.0).otherwise(decay)


def demotion(archived: Column, fork: Column) -> Column:
    return F.when(archived, DEMOTE_ARCHIVED).when(fork, DEMOTE_FORK).otherwise(1.0)


def bar_share(contribution: Column, total: Column) -> Column:
    """A contribution's part of the whole, for display."""
    return F.when(total > 1e-4, contribution / total).otherwise(0.0)


def short_count(n: Column) -> Column:
    """1234 as ``1.2k``."""
    return F.when(n >= 1000, F.concat(F.format_string("%.1f", F.floor(n / 100) / 10.0), F.lit("k"))).otherwise(n.cast("string"))


def updated_ago(pushed_at: Column, now: datetime) -> Column:
    days = F.datediff(F.lit(now.date()), pushed_at.cast("date"))
    return (
        F.when(pushed_at.isNull(), None)
        .when(days <= 0, "updated today")
        .when(days == 1, "updated yesterday")
        .when(days < 30, F.concat(F.lit("updated "), days.cast("string"), F.lit(" days ago")))
        .when(days < 365, F.concat(F.lit("updated "), F.floor(days / 30).cast("string"), F.lit(" months ago")))
        .otherwise(F.concat(F.lit("updated "), F.floor(days / 365).cast("string"), F.lit(" years ago")))
    )
