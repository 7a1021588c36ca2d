"""Smoothing of lateral offsets along a line."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Smoothing kernel.
KERNEL = (1, 2, 3, 2, 1)


def smooth_offsets(values: Column) -> Column:
    """Kernel mean with edge padding; series shorter than three stay as they are."""
    n = F.size(values)

    def at(i: Column) -> Column:
        return F.element_at(values, F.greatest(F.lit(1), F.least(n, i)))

    def smooth(_x: Column, i: Column) -> Column:
        return sum(w * at(i + 1 + k - 2) for k, w in enumerate(KERNEL)) / F.lit(float(sum(KERNEL)))

    return F.when(n >= 3, F.transform(values, smooth)).otherwise(values)


def clamp_to_envelope(values: Column, low: Column, high: Column) -> Column:
    """Keep every offset between its lower and upper limit."""
    capped = F.zip_with(values, high, lambda x, h: F.least(x, h))
    return F.zip_with(capped, low, lambda x, lo: F.greatest(x, lo))


def limit_slope(values: Column, max_step: float) -> Column:
    """One forward pass that keeps neighbouring offsets within ``max_step`` of each other."""
    empty = F.array().cast("array<double>")

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        held = F.greatest(last - max_step, F.least(last + max_step, x))
        return F.concat(acc, F.array(F.coalesce(held, x)))

    return F.aggregate(values, empty, step)
