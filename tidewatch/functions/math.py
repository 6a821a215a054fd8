"""Scores and statistics as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, places: int = 0) -> Column:
    """Rounded with halves going up."""
    scale = float(10**places)
    return F.floor(x * scale + 0.5) / F.lit(scale)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(F.nanvl(x.cast("double"), F.lit(float(low))), F.lit(float(low))), F.lit(float(high)))


def saturate(n: Column, threshold: float, full: float) -> Column:
    """0 up to threshold, 1 from full on, linear between."""
    if full <= threshold:
        return F.when(n <= threshold, 0.0).otherwise(1.0)
    return clamp((n - threshold) / F.lit(float(full - threshold)), 0, 1)


def decay(value: Column, elapsed_ms: Column, half_life_ms: float) -> Column:
    if half_life_ms <= 0:
        return value
    return F.when(elapsed_ms <= 0, value).otherwise(value * F.pow(F.lit(0.5), elapsed_ms / F.lit(float(half_life_ms))))


def noisy_or(confidence: Column) -> Column:
    """Aggregate: 1 - product of (1 - c), four places."""
    return half_up(1 - F.product(1 - clamp(confidence, 0, 1)), 4)


def noisy_or_array(confidences: Column) -> Column:
    return half_up(1 - F.aggregate(confidences, F.lit(1.0), lambda a, c: a * (1 - clamp(c, 0, 1))), 4)


def coefficient_of_variation(x: Column) -> Column:
    """Aggregate: sample deviation over mean; 0 for fewer than two values or mean 0."""
    return F.when((F.count(x) < 2) | (F.avg(x) == 0), 0.0).otherwise(F.stddev_samp(x) / F.avg(x))


def array_mean(x: Column) -> Column:
    total = F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double"))
    return F.when(F.size(x) > 0, total / F.size(x)).otherwise(0.0)


def array_cv(x: Column) -> Column:
    """Sample deviation over mean in one pass: mean and squared deviations from it are carried along."""
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def add(a: Column, v: Column) -> Column:
        d = v.cast("double") - a["mean"]
        return F.struct((a["n"] + 1).alias("n"), (a["mean"] + d / (a["n"] + 1)).alias("mean"), (a["m2"] + d * d * a["n"] / (a["n"] + 1)).alias("m2"))

    return F.aggregate(x, start, add, lambda a: F.when((a["n"] < 2) | (a["mean"] == 0), 0.0).otherwise(F.sqrt(a["m2"] / (a["n"] - 1)) / a["mean"]))


def deltas(times: Column) -> Column:
    """Differences of neighbours of a sorted array."""
    return F.when(F.size(times) > 1, F.zip_with(F.slice(times, 2, F.size(times) - 1), F.slice(times, 1, F.size(times) - 1), lambda b, a: b - a)).otherwise(F.array().cast("array<bigint>"))
