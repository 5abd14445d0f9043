"""Distances between distributions, on profiles: counts of categories and quantile sketches."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from dqengine.metrics import BucketDistribution, BucketValue


@dataclass(frozen=True)
class LInfinityMethod:
    """Largest difference; alpha is the level of the correction for small samples."""

    alpha: float | None = None


@dataclass(frozen=True)
class ChisquareMethod:
    """Small expected counts are pooled: below 5 in more than a fifth of many categories, below 10 in any of two."""

    abs_threshold_yates: int = 5
    perc_threshold_yates: float = 0.2
    abs_threshold_cochran: int = 10


#: Factor of the correction for small samples if no level is given.
C_ALPHA = 1.8


def _corrected(d: float, n: float, m: float, raw: bool, alpha: float | None) -> float:
    if raw:
        return d
    c = C_ALPHA if alpha is None else math.sqrt(-math.log(alpha / 2) / 2)
    return max(0.0, d - c * math.sqrt((n + m) / (n * m)))


def categorical_distance(sample: Mapping[str, int], expected: Mapping[str, int], correct_for_low_number_of_samples: bool = False, method: LInfinityMethod | ChisquareMethod = LInfinityMethod()) -> float:
    """With the flag: the plain distance, or the chi-square statistic; without: less what small samples explain, or the p-value."""
    if isinstance(method, ChisquareMethod):
        return _chi_square(sample, expected, correct_for_low_number_of_samples, method)
    n, m = sum(sample.values()), sum(expected.values())
    d = max((abs(sample.get(k, 0) / n - expected.get(k, 0) / m) for k in sample.keys() | expected.keys()), default=0.0)
    return _corrected(d, n, m, correct_for_low_number_of_samples, method.alpha)


def _pooled(seen: dict[str, float], wanted: dict[str, float], method: ChisquareMethod) -> None:
    """Adds the smallest category to the next smallest, in place, until the thresholds hold or one is left."""
    while len(wanted) >= 2:
        several = len(wanted) > 2
        least = method.abs_threshold_yates if several else method.abs_threshold_cochran
        allowed = int(method.perc_threshold_yates * len(wanted)) if several else 0
        if sum(v < least for v in wanted.values()) <= allowed:
            return
        small = min(wanted, key=wanted.__getitem__)
        rest, lost = wanted.pop(small), seen.pop(small, 0.0)
        if wanted:
            into = min(wanted, key=wanted.__getitem__)
            wanted[into] += rest
            seen[into] = seen.get(into, 0.0) + lost


def _chi_square(sample: Mapping[str, int], expected: Mapping[str, int], statistic: bool, method: ChisquareMethod) -> float:
    total, n = sum(expected.values()), sum(v for k, v in sample.items() if k in expected)
    seen = {k: float(v) for k, v in sample.items()}
    wanted = {k: v / total * n for k, v in expected.items()}
    _pooled(seen, wanted, method)
    if len(wanted) < 2:
        return math.nan
    observed = sum(seen.get(k, 0.0) for k in wanted)
    under = sum(wanted.values())
    x = sum((seen.get(k, 0.0) - e) ** 2 / e for k, v in wanted.items() if (e := v * observed / under) > 0)
    return x if statistic else chi_square_tail(x, len(wanted) - 1)


def chi_square_tail(x: float, degrees: int) -> float:
    """Probability of more than x: the upper regularised incomplete gamma function, by series or continued fraction."""
    a, x = degrees / 2, x / 2
    if x <= 0:
        return 1.0
    head = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - head * total)
    b = x + 1 - a
    c, d = 1e308, 1 / b
    h = d
    for i in range(1, 10_000):
        step = -i * (i - a)
        b += 2
        d = step * d + b
        d = 1 / (d if d else 1e-300)
        c = b + step / c
        c = c if c else 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return head * h


def _cdf(d: BucketDistribution) -> tuple[list[float], list[float], int]:
    n = sum(b.count for b in d.buckets)
    seen, at = 0, []
    for b in d.buckets:
        seen += b.count
        at.append(seen / n)
    return [b.high for b in d.buckets], at, n


def numerical_distance(a: BucketDistribution, b: BucketDistribution, correct_for_low_number_of_samples: bool = False, alpha: float | None = None) -> float:
    """Largest difference of the two distribution functions, at the buckets' ends of both; read from the sketches where there are."""
    xs, ys = _cdf(a), _cdf(b)
    points = sorted({*xs[0], *ys[0]})
    fa, fb = _at(a, xs, points), _at(b, ys, points)
    d = max((abs(p - q) for p, q in zip(fa, fb, strict=True)), default=0.0)
    return _corrected(d, xs[2], ys[2], correct_for_low_number_of_samples, alpha)


def _at(d: BucketDistribution, cdf: tuple[list[float], list[float], int], points: list[float]) -> list[float]:
    if d.sketch:
        from pyspark.sql import SparkSession
        from pyspark.sql import functions as F

        frame = SparkSession.getActiveSession().createDataFrame([(bytearray(d.sketch),)], "s binary")
        return list(frame.select(*(F.kll_sketch_get_rank_double("s", F.lit(float(p))).alias(f"r{i}") for i, p in enumerate(points))).first())
    low = d.buckets[0].low
    out = []
    for p in points:
        left, below = low, 0.0
        value = 1.0
        for high, at in zip(cdf[0], cdf[1], strict=True):
            if p < high:
                value = below + (at - below) * (0.0 if high == left else max(0.0, (p - left) / (high - left)))
                break
            left, below = high, at
        out.append(value)
    return out


def population_stability_index(actual: Sequence[BucketValue], expected: Sequence[BucketValue]) -> float:
    """Sum of (actual - expected) * ln(actual / expected) over the shares of the buckets; infinite where only one is empty."""
    if len(actual) != len(expected):
        raise ValueError("the numbers of buckets have to be the same")
    n, m = sum(b.count for b in actual), sum(b.count for b in expected)
    total = 0.0
    for a, e in zip(actual, expected, strict=True):
        p, q = a.count / n, e.count / m
        if p == q:
            continue
        total += math.inf if not p or not q else (p - q) * math.log(p / q)
    return total
