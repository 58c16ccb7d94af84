"""Whitening of vectors by the leading components of their covariance, found by FEAST contour integration.

Sums, products and projections are made where the vectors are; only sums by
dimension and the covariance of d x d numbers come to the driver. The components
are taken from eigenvalue intervals. For each interval, which is one task, complex
shifted systems at the nodes of a circle around it are solved for a block of
vectors; their weighted sum is that block's projection onto the interval's
eigenvectors, and a Rayleigh-Ritz step in the projected space gives the next block,
until residuals are at rounding. The inertia of shifted matrices says how many
eigenvalues each interval holds, before as the size of the block and afterwards as
the proof that none was missed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from geoloom.llm.corpus import table
from geoloom.llm.topk_search import whole_numbers

NODES = 12  # quadrature nodes on the upper half of a circle
SLICE = 16  # eigenvalues of one interval, unless more are equal
ROUNDS = 400
LARGEST = float(1 << 50)  # of an entry before scaling
WORDS = np.iinfo(np.int64).max


def inertia(a: np.ndarray, shift: float) -> int:
    """How many eigenvalues of the symmetric matrix lie below the shift: negative pivots of a pivoted LDL factorisation."""
    a = a - shift * np.eye(len(a))
    below = 0
    while len(a):
        diagonal, off = np.abs(np.diag(a)), np.abs(a - np.diag(np.diag(a)))
        i = int(np.argmax(diagonal))
        p, q = np.unravel_index(int(np.argmax(off)), off.shape)
        if max(diagonal[i], off[p, q]) == 0:
            break
        pivot = [i] if diagonal[i] >= 0.6403882032022076 * off[p, q] else [p, q]  # (1 + sqrt(17)) / 8 keeps growth bounded
        rest = np.setdiff1d(np.arange(len(a)), pivot)
        below += int(a[i, i] < 0) if len(pivot) == 1 else 1
        block = a[np.ix_(rest, pivot)]
        a = a[np.ix_(rest, rest)] - block @ np.linalg.solve(a[np.ix_(pivot, pivot)], block.T)
        a = (a + a.T) / 2
    return below


def _around(v: np.ndarray, number: int, high: float) -> tuple[float, float]:
    """Shifts just below and just above the eigenvalue of that number, counted from the largest."""
    a, b = -high, high
    for _ in range(60):
        m = (a + b) / 2
        a, b = (m, b) if len(v) - inertia(v, m) >= number else (a, m)
        if b - a <= 1e-10 * max(abs(a), abs(b)):
            break
    return a, b


def feast(v: np.ndarray, low: float, high: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenvalues of the symmetric matrix in (low, high), ascending, and their unit eigenvectors as columns."""
    d, norm = len(v), max(float(np.abs(v).sum(1).max()), 1e-300)
    width = min(d, 2 * count + 4)
    x, w = np.polynomial.legendre.leggauss(NODES)
    turn = np.exp(1j * np.pi * (x + 1) / 2)
    centre, radius = (low + high) / 2, (high - low) / 2
    block = np.random.default_rng(1).standard_normal((d, width))
    for attempt in range(ROUNDS):  # a few, unless eigenvalues crowd at an end
        projected = np.zeros((d, width))
        for t, weight in zip(turn, w):
            shifted = (centre + radius * t) * np.eye(d) - v
            projected += weight * (radius * t * np.linalg.solve(shifted, block)).real
        q, _ = np.linalg.qr(projected)
        values, inner = np.linalg.eigh(q.T @ v @ q)
        block = q @ inner
        inside = np.flatnonzero((values > low) & (values < high))
        if len(inside) == count:
            found = block[:, inside]
            left = np.abs(v @ found - found * values[inside]).max()
            if left <= 2e-16 * d * norm or attempt == ROUNDS - 1 and left <= 1e-12 * norm:
                return values[inside], found
    raise ArithmeticError(f"{count} eigenvalues lie between {low} and {high}; {len(inside)} were found, or not to double precision")


def intervals(v: np.ndarray, components: int) -> list[tuple[float, float, int]]:
    """Intervals that hold the ``components`` largest positive eigenvalues, with their counts, from above.

    Their ends lie in gaps, equal eigenvalues stay together, and within one the
    largest is at most four times the smallest.
    """
    d = len(v)
    norm = float(np.abs(v).sum(1).max()) if d else 0.0
    floor = norm * d * 4e-16  # what rounding leaves of a zero
    goal = min(components, d - inertia(v, floor)) if norm else 0
    out, high, done = [], 2 * norm, 0
    while done < goal:
        largest = _around(v, done + 1, 2 * norm)[1]
        wanted = max(done + 1, min(done + SLICE, goal, d - inertia(v, largest / 4)))
        count = d - inertia(v, _around(v, wanted, 2 * norm)[0])  # with all equals of the last
        under = max(0.0, _around(v, count + 1, 2 * norm)[1]) if count < d else 0.0
        low = (_around(v, count, 2 * norm)[0] + under) / 2
        out.append((low, min(high, 1.25 * largest), count - done))
        high, done = low, count
    return out


def principal(spark: SparkSession, v: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest positive eigenvalues of a covariance, falling, and unit eigenvectors as columns; one task an interval."""
    cuts = intervals(v, components)
    if not cuts:
        return np.zeros(0), np.zeros((len(v), 0))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, count in zip(*(c.to_pylist() for c in batch.columns)):
                values, vectors = feast(v, low, high, count)
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(list(vectors.T))], ["e", "u"])

    rows = spark.createDataFrame(cuts, "low double, high double, count int").repartition(len(cuts)).mapInArrow(solve, "e double, u array<double>").collect()
    q, _ = np.linalg.qr(np.array([r.u for r in sorted(rows, key=lambda r: -r.e)]).T)
    values, inner = np.linalg.eigh(q.T @ v @ q)  # across intervals
    last = np.argsort(-values)[:components]
    return values[last], (q @ inner)[:, last]


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.int64).reshape(len(column), -1)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exactly: 64-bit where it fits, else Python's integers."""
    most = max(int(np.abs(x).max(initial=0)) * n, max(map(abs, sums), default=0))
    return x * n - np.array(sums, np.int64) if most < WORDS // 2 else x.astype(object) * n - np.array(sums, object)


def _summed(vectors: DataFrame, of: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Sums of ``size`` doubles that each batch of vectors gives, over all batches: a partition's first, then all partitions'."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros(size), False
        for batch in batches:
            if batch.num_rows:
                total, some = total + of(_matrix(batch.column(0))).ravel(), True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], ["at", "value"])

    out = np.zeros(size)
    for at, value in vectors.select("x").mapInArrow(scan, "at long, value double").groupBy("at").agg(F.sum("value")).collect():
        out[at] = value
    return out


def whiten(vectors: DataFrame, components: int = 8) -> DataFrame:
    """Every vector's whitened coordinates, a row for each of the leading ``components``.

    ``vectors`` has ``vec_id`` and ``x``, whole numbers; rows with a null ``x`` take no
    part, nor do vectors of other lengths than the commonest (of equally common
    ones the longest). Returns ``vec_id, component`` (from 1, by falling eigenvalue)
    ``, n, deviation`` (sum of (n * x - S)^2, exact; null if over 64 bits) ``,
    whitened, explained, identity_error``. Directions without variance have no
    rows, so equal vectors, a single one or none give none. Repeated rows count as
    often as they stand; a null id stays. Other columns are ignored.
    """
    spark = vectors.sparkSession
    vectors = vectors.where("x is not null").select("vec_id", "x")

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition's counts and sums, by length and dimension, as text of any size."""
        held: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            sizes = batch.column(0).value_lengths().to_numpy()
            for d in np.unique(sizes).tolist():
                x = _matrix(batch.column(0).filter(pa.array(sizes == d)))
                fits = int(np.abs(x).max(initial=0)) * len(x) < WORDS
                n, s = held.get(d, (0, np.zeros(d, object)))
                held[d] = (n + len(x), s + (x.sum(0).astype(object) if fits else x.astype(object).sum(0)))
        for d, (n, s) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array([str(v) for v in s])], ["d", "at", "n", "s"])

    by = vectors.select("x").mapInArrow(totals, "d int, at int, n long, s string").groupBy("d", "at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    lengths = by.where("at = 0").groupBy("d").agg(F.max("n").alias("n"))
    best = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double"
    if best is None:
        return spark.createDataFrame([], schema).withColumn("identity_error", F.lit(0.0))
    d, n = best.d, best.n
    sums = [int(r.s) for r in by.where(F.col("d") == d).orderBy("at").collect()]
    vectors = vectors.where(F.size("x") == d)

    def products(x: np.ndarray) -> np.ndarray:
        z = _centred(x, n, sums).astype(np.float64) / n
        return z.T @ z

    v = _summed(vectors, products, d * d).reshape(d, d) / n
    v = (v + v.T) / 2
    values, axes = principal(spark, v, components)
    m, trace = len(values), float(np.trace(v))
    scaled = axes / np.sqrt(values)

    def coordinates(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = _centred(x, n, sums)
        return z, (z.astype(np.float64) / n) @ scaled

    def moments(x: np.ndarray) -> np.ndarray:
        _, w = coordinates(x)
        return np.r_[w.sum(0), (w.T @ w).ravel()]

    sums_of = _summed(vectors, moments, m + m * m) / n
    mean = sums_of[:m]
    error = float(np.abs(sums_of[m:].reshape(m, m) - np.outer(mean, mean) - np.eye(m)).max()) if m else 0.0
    explained = values / trace if trace else values

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not m:
                continue
            z, w = coordinates(_matrix(batch.column(1)))
            if z.dtype != object and float(np.abs(z).max(initial=0)) ** 2 * d < 2.0**62:
                deviation = pa.array((z * z).sum(1))
            else:
                exact = (z.astype(object) ** 2).sum(1)
                deviation = pa.array([int(e) if e <= WORDS else None for e in exact], pa.int64())
            rows = np.repeat(np.arange(len(w)), m)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()).take(pa.array(rows)), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(w))), pa.array(np.full(len(rows), n, np.int64)),
                    deviation.take(pa.array(rows)), pa.array(w.ravel()), pa.array(np.tile(explained, len(w))),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained"],
            )

    return vectors.select("vec_id", "x").mapInArrow(project, schema).withColumn("identity_error", F.lit(error))


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    """Entries of 2**50 or more in size count as non-finite: they have no place in 64 bits."""
    entries = F.col("embedding")
    fits = ~F.coalesce(F.exists(entries, lambda c: F.abs(c.cast("double")) >= LARGEST), F.lit(False))
    x = F.transform(whole_numbers(F.when(fits, entries)), lambda c: c + F.lit(100_000).cast("long"))
    return whiten(table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")), 8)
