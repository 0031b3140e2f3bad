"""Sample arithmetic as column expressions: conversion, normalising, stretching, statistics of arrays.

Samples are doubles in flight. NaN sorts above every number in Spark, so each
expression tests for it before it compares.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Greatest value of each integer sample format.
MAXIMA = {"UInt8": 255, "UInt16": 65535, "UInt32": 4294967295, "UInt64": 18446744073709551615}


def _range(lower: float, upper: float) -> tuple[float, float]:
    return (lower, upper) if upper > lower else (0.0, 1.0)


def convert(v: Column, source: str, target: str, lower: float = 0.0, upper: float = 1.0) -> Column:
    """A sample of format ``source`` in format ``target``; integers come back as whole doubles.

    Integers of another width are scaled and rounded half up; to floats they go
    as parts of their greatest value; floats go to integers from [lower, upper],
    NaN and what lies below as 0, what lies above as the greatest value.
    """
    v = v.cast("double")
    if source in MAXIMA and target in MAXIMA:
        if source == target:
            return v
        top = float(MAXIMA[target])
        return F.least(F.lit(top), F.floor(v * (top / MAXIMA[source]) + 0.5).cast("double"))
    if source in MAXIMA:
        out = v * (1.0 / MAXIMA[source])
        return out.cast("float").cast("double") if target == "Float32" else out
    if target in MAXIMA:
        lo, hi = _range(lower, upper)
        t, top = (v - lo) / (hi - lo), float(MAXIMA[target])
        return F.when(F.isnan(t) | (t <= 0), 0.0).when(t > 1, top).otherwise(F.floor(t * top + 0.5).cast("double"))
    return v.cast("float").cast("double") if target == "Float32" else v


def normalise(v: Column, lower: float, upper: float) -> Column:
    """From [lower, upper] to [0, 1], unclipped; an empty range changes nothing."""
    if upper <= lower or (lower, upper) == (0.0, 1.0):
        return v
    return (v - lower) * (1.0 / (upper - lower))


def mtf(m: Column, x: Column) -> Column:
    """The midtones transfer function: m goes to a half, 0 and 1 stay."""
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(m == 0.5, x).otherwise((m - 1) * x / ((2 * m - 1) * x - m))


def stretch(v: Column, shadows: Column, midtones: Column, highlights: Column, low: Column, high: Column) -> Column:
    """Clips to [shadows, highlights], applies the midtones, then spreads [low, high] over [0, 1]."""
    x = F.when(F.isnan(v) | (v <= 0), 0.0).when(v > 1, 1.0).otherwise(v)
    x = F.when(highlights <= shadows, F.when(x < highlights, 0.0).otherwise(1.0)).otherwise((x - shadows) / (highlights - shadows))
    y = (mtf(midtones, x) - low) / (high - low)
    return F.when(y <= 0, 0.0).when(y > 1, 1.0).otherwise(y)


def array_median(values: Column) -> Column:
    """Median of an array of numbers, the mean of the two middles where even; 0 for an empty one. No shuffle."""
    s, n = F.sort_array(values), F.size(values)
    half = F.floor(n / 2).cast("int")
    return F.when(n == 0, 0.0).when(n % 2 == 1, F.get(s, half)).otherwise((F.get(s, half - 1) + F.get(s, half)) / 2)


def stretch_params(m: Column, d: Column) -> tuple[Column, Column, Column]:
    """(shadows, midtones, highlights) of the automatic stretch from a median and a normalised deviation."""
    dark, quarter = m <= 0.5, F.lit(0.25)
    s = F.when(~dark | (d == 0), 0.0).otherwise(F.greatest(F.lit(0.0), m - 2.8 * d))
    h = F.when(dark | (d == 0), 1.0).otherwise(F.least(F.lit(1.0), m + 2.8 * d))
    mid = F.when(dark, F.when(m > s, mtf(quarter, m - s)).otherwise(0.5)).otherwise(1 - mtf(quarter, h - m))
    return s, mid, h


def smaller_size(n: int, bin_: int = 1, scale: float = 1.0, fit: int | None = None) -> int:
    """Length of an axis made smaller: binned first, then scaled, then fitted; never enlarged, never 0."""
    out = max(1, n // bin_)
    out = min(out, max(1, int(out * min(scale, 1.0) + 0.5)))
    return min(out, fit) if fit else out
