"""Numeric helpers: percentiles, correlation by Fourier transform, ring measures, hashes."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from terrane.functions.geo import EARTH_RADIUS, Ring


def percentile(value: Column, p: float) -> Column:
    """Exact, linear between the two nearest ranks; one value is its own percentile."""
    return F.percentile(value, p)


def correlation(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Circular cross-correlation of two series of equal length by Fourier transform."""
    return np.fft.irfft(np.fft.rfft(a) * np.conj(np.fft.rfft(b)), len(a))


def spectrum(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Magnitudes and phases."""
    z = np.fft.rfft(a)
    return np.abs(z), np.angle(z)


def bit_reverse(value: int, bits: int) -> int:
    return int(format(value, f"0{bits}b")[::-1], 2)


def identity_hash(*columns: Column) -> Column:
    """64 bits of a row's values; only equality has a meaning."""
    return F.xxhash64(*columns)


def winding(ring: Ring) -> int:
    """1 for counter-clockwise, -1 for clockwise."""
    from terrane.functions.geo import signed_area

    return 1 if signed_area(ring) >= 0 else -1


def centroid(ring: Ring) -> tuple[float, float]:
    pts = list(ring[:-1]) if ring[0] == ring[-1] else list(ring)
    cross = [a[0] * b[1] - b[0] * a[1] for a, b in zip(pts, [*pts[1:], pts[0]], strict=True)]
    area = sum(cross) / 2
    if area == 0:
        return sum(p[0] for p in pts) / len(pts), sum(p[1] for p in pts) / len(pts)
    sums = [sum((a[k] + b[k]) * c for a, b, c in zip(pts, [*pts[1:], pts[0]], cross, strict=True)) for k in (0, 1)]
    return sums[0] / (6 * area), sums[1] / (6 * area)


def sphere_area(ring: Ring) -> float:
    """Square metres of a ring of degrees on the sphere."""
    pts = [(math.radians(x), math.radians(y)) for x, y in ring]
    total = sum((b[0] - a[0]) * (2 + math.sin(a[1]) + math.sin(b[1])) for a, b in zip(pts, [*pts[1:], pts[0]], strict=True))
    return abs(total) * EARTH_RADIUS**2 / 2
