"""Scalars of the hazard and calibration operators, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    """Stable on both sides."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


def round_half_up(x: Column, digits: int = 6) -> Column:
    """Halves go up, also below zero."""
    scale = F.lit(float(10**digits))
    return F.floor(x * scale + 0.5) / scale


def dot(values: Column, weights: Sequence[float]) -> Column:
    pairs = F.zip_with(values, F.array(*[F.lit(float(w)) for w in weights]), lambda x, w: x * w)
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def quadratic_form(values: Column, matrix: Sequence[Sequence[float]]) -> Column:
    rows = [F.element_at(values, i + 1) * dot(values, row) for i, row in enumerate(matrix)]
    return sum(rows[1:], rows[0])


def winsorised(x: Column, mean: Column | float, scale: Column | float, clip: float = 3.0) -> Column:
    return clamp((x - mean) / scale, -clip, clip)


def exposure_hazard(h: Column, share: Column) -> Column:
    """Hazard of a part of a slot: 1 - (1 - h) ** share."""
    return F.when(h >= 1, F.lit(1.0)).otherwise(-F.expm1(share * F.log1p(-h)))


def fourier(position: Column, period: float, orders: Sequence[int]) -> list[Column]:
    angle = 2 * F.pi() * position / F.lit(float(period))
    return [f(angle * k) for k in orders for f in (F.sin, F.cos)]


def post_outcome_weight(lineage_consumed: Column, available: Column, outcome_end: Column) -> Column:
    """0 where an outcome already used the evidence, a half where it precedes the outcome's end, else 1."""
    return F.when(lineage_consumed, 0.0).when(available < outcome_end, 0.5).otherwise(1.0)


def logit(p: Column, edge: float = 1e-6) -> Column:
    q = clamp(p, edge, 1 - edge)
    return F.log(q / (1 - q))


def piecewise_linear(x: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """Interpolation between knots; the end values hold outside."""
    out = F.when(x <= knots[0][0], F.lit(float(knots[0][1])))
    for (x0, y0), (x1, y1) in zip(knots, knots[1:], strict=False):
        out = out.when(x <= x1, F.lit(float(y0)) + (x - x0) * F.lit((y1 - y0) / (x1 - x0)))
    return out.otherwise(F.lit(float(knots[-1][1])))


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Score interval; null without observations, exact ends at no and at all hits."""
    k, m = hits.cast("double"), n.cast("double")
    p, z2 = k / m, z * z
    centre = (p + z2 / (2 * m)) / (1 + z2 / m)
    half = z * F.sqrt(p * (1 - p) / m + z2 / (4 * m * m)) / (1 + z2 / m)
    some = n > 0
    low = F.when(some & (hits == 0), 0.0).when(some, F.greatest(F.lit(0.0), centre - half))
    high = F.when(some & (hits == n), 1.0).when(some, F.least(F.lit(1.0), centre + half))
    return low, high
