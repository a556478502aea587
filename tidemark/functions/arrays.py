"""Arrays, maps and JSON inside columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_flag(text: Column, path: str = "$.ok") -> Column:
    """1 for a true flag, 0 for a false, missing or unreadable one."""
    return F.when(F.try_variant_get(F.try_parse_json(text), path, "boolean"), 1).otherwise(0)


def json_number(text: Column, path: str) -> Column:
    return F.try_variant_get(F.try_parse_json(text), path, "double")


def threshold_grid(steps: int = 100) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: i / F.lit(float(steps)))


def at_horizons(curve: Column, horizons: Sequence[int]) -> Column:
    """(horizon, probability) for each wanted horizon (from 1) of a dense curve; null beyond its end."""
    return F.array(*[F.struct(F.lit(h).alias("horizon"), F.get(curve, F.lit(h - 1)).alias("probability")) for h in horizons])


def is_monotone(curve: Column) -> Column:
    pairs = F.zip_with(F.slice(curve, 1, F.greatest(F.size(curve) - 1, F.lit(0))), F.slice(curve, 2, F.greatest(F.size(curve) - 1, F.lit(0))), lambda a, b: a <= b)
    return F.when(F.size(curve) < 2, True).otherwise(F.forall(pairs, lambda x: x))


def scope_products(product: Column, products: Column) -> Column:
    """Sorted distinct products of a scope that names one or several."""
    return F.array_sort(F.array_distinct(F.coalesce(products, F.array(product))))


def merged(base: Mapping[str, Any], over: Mapping[str, Any]) -> dict[str, Any]:
    """Settings: objects merge, everything else replaces."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out
