"""The trend score and its parts, as columns. Numbers here are fixed values."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

BURST_CAP, BURST_WEIGHT, DIVERSITY_FULL = 5.0, 0.8, 20
LEAST_MENTIONS, LEAST_ORIGINS = 3, 2
SCALE_FALLBACK, SCALE_FLOOR = 12.0, 0.1


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def decay(age: Column, half_life: float) -> Column:
    """Weight of a mention by its age in hours."""
    return F.exp(F.lit(-math.log(2.0)) * age / F.lit(half_life))


def diversity(n: Column) -> Column:
    return F.when(n <= 0, 0.0).otherwise(F.least(F.log1p(n.cast("double")) / F.lit(math.log1p(DIVERSITY_FULL)), F.lit(1.0)))


def burst(n: Column, baseline: Column) -> Column:
    return clamp((n - baseline) / F.sqrt(F.greatest(baseline, F.lit(0.0)) + 1.0), 0.0, BURST_CAP)


def raw_score(volume: Column, n: Column, importance: Column, baseline: Column) -> Column:
    return volume * (1.0 + diversity(n)) * importance + BURST_WEIGHT * burst(n, baseline)


def normalized(raw: Column, scale: Column) -> Column:
    return clamp(100.0 * raw / scale, 0.0, 100.0)


def eligible(mentions: Column, origins: Column) -> Column:
    return (mentions >= LEAST_MENTIONS) & (origins >= LEAST_ORIGINS)


def p95_scale() -> Column:
    """Aggregate over ``raw``: 95th percentile (nearest rank) of positive scores; the fallback below two of them."""
    positive = F.when(F.col("raw") > 0, F.col("raw"))
    exact = F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY CASE WHEN raw > 0 THEN raw END)")
    return F.when(F.count(positive) < 2, F.lit(SCALE_FALLBACK)).otherwise(F.greatest(exact, F.lit(SCALE_FALLBACK * SCALE_FLOOR)))
