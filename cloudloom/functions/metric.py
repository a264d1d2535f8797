"""Metrics in single precision, one rounding per operation, in a fixed order of coordinates."""

from __future__ import annotations

import math
import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOAT_MAX_KEY = 1e38


def f32(value: float) -> float:
    """The float32 nearest to a Python number, as a Python number."""
    if math.isinf(value) or math.isnan(value):
        return value
    try:
        return struct.unpack("f", struct.pack("f", value))[0]
    except OverflowError:
        return math.copysign(math.inf, value)


def flit(value: float) -> Column:
    return F.lit(value).cast("float")


def _terms(a: Column, b: Column, dim: int, term) -> Column:
    total = term(b[0] - a[0])
    for i in range(1, dim):
        total = total + term(b[i] - a[i])
    return total


def d2(a: Column, b: Column, dim: int) -> Column:
    """Squared distance of two ARRAY<FLOAT>: ((d0*d0 + d1*d1) + d2*d2) + ..."""
    return _terms(a, b, dim, lambda d: d * d)


def l1(a: Column, b: Column, dim: int) -> Column:
    return _terms(a, b, dim, F.abs)


def root(d: Column) -> Column:
    return F.sqrt(d).cast("float")


def finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < float("inf"))


def all_finite(pos: Column) -> Column:
    return F.forall(pos, finite)


def dense_threshold(radius: float) -> float:
    """float32(r) squared in float32."""
    r = f32(radius)
    return f32(r * r)


def flat_threshold(radius: float) -> float:
    """r squared in double precision, rounded once."""
    return f32(radius * radius)


def check_radius(radius: float, k: int) -> None:
    if isinstance(k, bool) or not isinstance(k, int) or k < 0:
        raise ValueError("K must be a non-negative integer")
    if isinstance(radius, bool) or not math.isfinite(radius) or radius < 0 or math.isinf(f32(radius)):
        raise ValueError("radius must be finite, non-negative and representable in single precision")
    if radius and f32(radius) < 2.0**-112:
        raise ValueError("a positive radius must be at least 2**-112")


def check_count(k: int, name: str = "k") -> None:
    if isinstance(k, bool) or not isinstance(k, int) or k < 0:
        raise ValueError(f"{name} must be a non-negative integer")
