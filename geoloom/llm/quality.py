"""Quality scores: random Fourier features, ridge regression, isotonic calibration.

Statistics of each document approximate what a Gaussian kernel would compare:
random Fourier features turn its inner products into plain ones, so that kernel
ridge regression becomes the normal equations of a linear model. Every partition
adds up its part of these equations; the sums have a fixed size. Isotonic
regression maps the ridge scores of labelled documents to probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from geoloom.llm.corpus import fold, labelled_sample, table, texts
from geoloom.llm.text import run_hashes, slices, utf8, whole, word_hashes, words
from geoloom.sources.shared import materialise

FEATURES = 192

_CLASSES = np.zeros(256, np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 line end, 6 sentence mark, 7 further ASCII sign
_CLASSES[33:127] = 7
_CLASSES[[ord(c) for c in " \t\r\x0b\x0c"]] = 4
_CLASSES[10] = 5
_CLASSES[[ord(c) for c in ".,;:?'\"()-"]] = 6
_CLASSES[ord("0") : ord("9") + 1] = 3
_CLASSES[ord("A") : ord("Z") + 1] = 2
_CLASSES[ord("a") : ord("z") + 1] = 1
_CLASSES[128:] = 1


def _distinct_share(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Share of distinct values among each row's."""
    total = np.bincount(rows, minlength=n)
    key = np.unique(values ^ (rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
    return np.bincount(rows[key], minlength=n) / np.maximum(total, 1)


def statistics(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of numbers per document, from its whole text; zeros for an empty one."""
    n = len(at) - 1
    size = np.diff(at)
    of = np.repeat(np.arange(n), size)
    kinds = np.bincount(of * 8 + _CLASSES[data], minlength=8 * n).reshape(n, 8)
    share = kinds / np.maximum(size, 1)[:, None]
    starts, ends, firsts = words(data, at)
    count = np.diff(firsts)
    row = np.repeat(np.arange(n), count)
    length = ends - starts
    hashes = word_hashes(data, starts, ends)
    mean = np.bincount(row, length, n) / np.maximum(count, 1)
    spread = np.sqrt(np.maximum(np.bincount(row, length.astype(float) ** 2, n) / np.maximum(count, 1) - mean**2, 0))
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    single = np.bincount(row[length == 1], minlength=n) / np.maximum(count, 1)
    signs = np.bincount(row[_CLASSES[data[ends - 1]] == 7] if len(ends) else row, minlength=n) / np.maximum(count, 1)
    pairs = run_hashes(hashes, 2)
    inside = whole(firsts, 2)[: len(pairs)]
    lines = kinds[:, 5] + 1
    return np.nan_to_num(np.c_[
        share[:, 1:], np.log1p(size), np.log1p(count), mean, spread, single, signs,
        np.bincount(row[same], minlength=n) / np.maximum(count, 1),
        _distinct_share(hashes, row, n), _distinct_share(pairs[inside], row[: len(pairs)][inside], n),
        np.log1p(size / lines), np.log1p(lines),
    ])


@dataclass
class KernelModel:
    """Standardisation, Fourier frequencies, ridge weights and an isotonic step map."""

    mean: np.ndarray
    scale: np.ndarray
    frequency: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.c_[np.sqrt(2 / len(self.phase)) * np.cos(z @ self.frequency + self.phase), np.ones(len(x))]

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not len(self.knots):
            return np.full(len(x), float(self.values[0]))
        return np.clip(np.interp(self.raw(x), self.knots, self.values), 0, 1)


def isotonic(x: np.ndarray, ones: np.ndarray, mass: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators of ascending x; each pool's mean x and share of ones."""
    pools: list[list[float]] = []
    for c, a, b in zip(x, ones, mass):
        pools.append([c * b, a, b])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def _sums(rows: DataFrame, part, width: int) -> np.ndarray:
    """Adds up what ``part(statistics, labels)`` gives for each slice, per partition and then by a sum of each place."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in slices(batches):
            total += part(statistics(*utf8(batch.column(0))), batch.column(1).to_numpy(zero_copy_only=False).astype(float))
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(total)], ["place", "v"])

    # the sums of `width` places, whatever the rows: each partition sends one number for a place
    got = rows.select("text", "y").mapInArrow(scan, "place long, v double").groupBy("place").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros(width)
    out[got["place"].to_numpy(int)] = got["v"].to_numpy(float)
    return out


def fit(docs: DataFrame, labels: DataFrame, most: int = 8_000, most_bytes: int = 256 << 20, ridge: float = 1e-3, gamma: float = 0.02, seed: int = 11) -> KernelModel:
    """Fit on at most ``most`` labelled documents of each class outside the held-out fold (crc32 of the id mod 3 is 1), ``most_bytes`` of text in all.

    Classes are weighted to the shares that all labels show. With labels of one
    class only, every score is that class; without labels it is 0.5.
    """
    rows = labelled_sample(docs, labels, "quality", fold(3) != 1, {0: most, 1: most}, most_bytes)
    known = labels.where((fold(3) != 1) & F.col("quality").isin(0, 1)).agg(F.avg(F.col("quality").cast("double"))).first()[0]
    rows = materialise(rows, "quality_sample")
    d = statistics(np.zeros(0, np.uint8), np.zeros(2, np.int64)).shape[1]
    moments = _sums(rows, lambda x, y: np.r_[len(x), x.sum(0), (x**2).sum(0), y.sum()], 2 * d + 2)
    n, positive = moments[0], moments[-1]
    empty = np.zeros(0)
    if n == 0 or positive in (0, n):
        return KernelModel(empty, empty, empty, empty, empty, empty, np.array([0.5 if n == 0 else positive / n]))
    mean = moments[1 : d + 1] / n
    scale = np.sqrt(np.maximum(moments[d + 1 : 2 * d + 1] / n - mean**2, 0)) + 1e-6
    rng = np.random.default_rng(seed)
    model = KernelModel(mean, scale, rng.normal(size=(d, FEATURES)) * np.sqrt(2 * gamma), rng.uniform(0, 2 * np.pi, FEATURES), empty, empty, empty)
    weight = lambda y: np.where(y == 1, known / (positive / n), (1 - known) / (1 - positive / n))

    def equations(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z, w = model.features(x), weight(y)
        return np.r_[((z * w[:, None]).T @ z).ravel(), z.T @ (w * y)]

    m = FEATURES + 1
    sums = _sums(rows, equations, m * m + m)
    model.weights = np.linalg.solve(sums[: m * m].reshape(m, m) + ridge * n * np.diag(np.r_[np.ones(FEATURES), 0]), sums[m * m :])
    # a histogram of ridge scores by class is enough for the isotonic map
    edges = np.linspace(-0.5, 1.5, 401)

    def histogram(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        bins = np.clip(np.searchsorted(edges, model.raw(x)), 0, 401)
        return np.r_[np.bincount(bins, weight(y) * (y == 0), 402), np.bincount(bins, weight(y) * (y == 1), 402)]

    zero, one = _sums(rows, histogram, 804).reshape(2, 402)
    some = np.flatnonzero(zero + one > 0)
    centre = np.r_[edges[0], (edges[:-1] + edges[1:]) / 2, edges[-1]]
    model.knots, model.values = isotonic(centre[some], one[some], zero[some] + one[some])
    return model


def quality_scores(docs: DataFrame, model: KernelModel) -> DataFrame:
    """``doc_id, score, raw`` of every whole text.

    A null or empty text is scored as one without characters. Repeated rows and
    texts of equal statistics get equal scores. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES * 20 numbers

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches):
            x = statistics(*utf8(batch.column(1)))
            raw = model.raw(x) if len(model.weights) else np.zeros(len(x))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x)), pa.array(raw)], ["doc_id", "score", "raw"])

    return texts(docs).mapInArrow(score, "doc_id long, score double, raw double")


def op3_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return quality_scores(docs, model).select(
        "doc_id", F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "raw"
    )
