"""The valley after the first mode of edge lengths, as a seed cutoff."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from geoloom.operators.edges import log_length_histogram

# fixed values of the method
SIGMA, RADIUS = 1.25, 5
HEIGHT, PROMINENCE, DEPTH, APART, LEAST = 0.20, 0.35, 0.60, 3, 40


def bin_count(n: int) -> int:
    return int(min(96, max(32, int(2 * n**0.5))))


def smoothed(counts: np.ndarray) -> np.ndarray:
    """Gaussian smoothing with reflected edges."""
    x = np.arange(-RADIUS, RADIUS + 1)
    kernel = np.exp(-0.5 * (x / SIGMA) ** 2)
    return np.convolve(np.pad(counts.astype(float), RADIUS, mode="symmetric"), kernel / kernel.sum(), "valid")


def peaks(y: np.ndarray, height: float, prominence: float) -> list[int]:
    """Local maxima (the middle of a plateau) of at least that height and prominence."""
    out, i = [], 1
    while i < len(y) - 1:
        j = i
        while j < len(y) - 1 and y[j + 1] == y[i]:
            j += 1
        if y[i] > y[i - 1] and j < len(y) - 1 and y[j + 1] < y[i]:
            k = (i + j) // 2
            left = next((a for a in range(k, -1, -1) if y[a] > y[k]), -1)
            right = next((a for a in range(k, len(y)) if y[a] > y[k]), len(y))
            base = max(y[left + 1 : k + 1].min(), y[k:right].min())
            if y[k] >= height and y[k] - base >= prominence:
                out.append(k)
        i = j + 1
    return out


def valley(counts: np.ndarray) -> int | None:
    """Bin of the valley between the first two peaks that are apart enough, if it is deep enough."""
    y = smoothed(counts)
    floor = max(2.0, HEIGHT * y.max())
    found = peaks(y, floor, PROMINENCE * floor)
    for a, b in zip(found[:1], found[1:2]):
        if b - a >= APART:
            low = a + int(y[a : b + 1].argmin())
            if y[low] <= DEPTH * min(y[a], y[b]):
                return low
    return None


def first_mode_cutoff(edges: DataFrame, column: str = "len_o") -> float | None:
    """The length at the valley after the first mode; None with fewer than 40 positive lengths or without a clear valley.

    Spark makes the histogram; its 96 bins at most are read here.
    """
    good = edges.where((F.col(column) > 0) & ~F.isnan(column))
    n, low, high = good.agg(F.count("*"), F.min(F.ln(column)), F.max(F.ln(column))).first()
    if n < LEAST or not high > low:
        return None
    bins = bin_count(n)
    counts = np.zeros(bins, int)
    for r in log_length_histogram(good, bins, column).collect():
        counts[r["bin"]] = r["n"]
    at = valley(counts)
    return None if at is None else float(np.exp(low + (at + 0.5) / bins * (high - low)))


def first_mode_seed(edges: DataFrame, fallback: str = "is_seed", column: str = "len_o") -> DataFrame:
    """``edges`` with ``is_seed``: within the cutoff, or the fallback column where there is none."""
    cutoff = first_mode_cutoff(edges, column)
    return edges.withColumn("is_seed", F.col(fallback) if cutoff is None else F.col(column) <= cutoff)
