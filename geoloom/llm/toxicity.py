"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary labelled
text, both by zstandard's own trainer and on windows of text as they are. A window
of a document is compressed against the ordinary dictionary alone and against the
toxic one in front of it; the bytes that the toxic dictionary saves are the
window's evidence.

A toxic document is mostly ordinary text, so its label says little about a single
window. The windows that the toxic dictionary is trained on are therefore chosen by
compression itself, in rounds: the toxic documents are halved, each half's dictionary
measures the windows of the other, and those that it shortens, at the saving that is
rarest among ordinary windows, train the next one. Ordinary windows that it shortens
by mistake go to the ordinary dictionary, so that both sides know them.

A document's evidence is its best window and how many of its windows save so many
bytes; a logistic map, fitted on labelled documents, turns it into a probability.
Each half of the toxic documents is measured by the dictionary of the other there,
and ordinary ones that no dictionary was trained on are used.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import exp, log1p, sqrt
from random import Random
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, functions as F

from geoloom.llm.corpus import fold, labelled_sample, table, texts
from geoloom.llm.text import slices

WINDOW, STRIDE = 96, 72  # characters of a window that is scored
SHORT, STEP = 32, 20  # of a window that is trained on
BASE, HARD = 30_000, 80_000  # bytes of ordinary content: of any windows, and of those that looked toxic
ROUNDS = 3
POOL = 30_000  # ordinary windows that a round measures
SAVINGS = (2, 3, 4, 5, 6, 8)  # bytes; a document's evidence is how many of its windows save as much
_CONTROL = {i: " " for i in range(32)}
_WORDS = re.compile(r"[^\W\d_]+")
_PARAMETERS = zstd.ZstdCompressionParameters(strategy=zstd.STRATEGY_GREEDY, min_match=4, window_log=18, hash_log=17, chain_log=17, search_log=5, target_length=16, write_content_size=False, write_checksum=False, write_dict_id=False)

Size = Callable[[bytes], bytes]


def windows(text: str, size: int = WINDOW, step: int = STRIDE) -> list[bytes]:
    """The whole text in overlapping windows, lower case, on one line."""
    low = text.lower().translate(_CONTROL)
    return [low[i : i + size].encode() for i in range(0, max(len(low) - (size - step), 1), step)]


def compressor(content: bytes) -> Size:
    d = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=_PARAMETERS)
    return zstd.ZstdCompressor(compression_params=_PARAMETERS, dict_data=d).compress


def savings(ordinary: Size, toxic: Size, some: list[bytes]) -> np.ndarray:
    return np.array([len(ordinary(w)) - len(toxic(w)) for w in some], int)


def _evidence(saved: np.ndarray) -> list[float]:
    """Best saving, log numbers of windows that pass each of SAVINGS, and roots of their shares."""
    n = [int((saved >= s).sum()) for s in SAVINGS]
    return [max(0, min(12, int(saved.max()))), *map(log1p, n), *(sqrt(x / len(saved)) for x in n)]


@dataclass
class CompressionModel:
    """Two trained dictionaries and a logistic map from a document's savings to a probability."""

    toxic: bytes
    ordinary: bytes
    weights: np.ndarray  # the last is the intercept

    def compressors(self) -> tuple[Size, Size]:
        return compressor(self.ordinary), compressor(self.toxic + self.ordinary)

    def score(self, text: str, by: tuple[Size, Size]) -> tuple[float, int, int]:
        """Score, best saving and number of windows that save at least SAVINGS[2]."""
        if len(self.weights) == 1:
            return 1 / (1 + exp(-float(self.weights[0]))), 0, 0
        saved = savings(*by, windows(text))
        z = float(np.dot(self.weights[:-1], _evidence(saved)) + self.weights[-1])
        return 1 / (1 + exp(-max(-60.0, min(60.0, z)))), int(max(0, saved.max())), int((saved >= SAVINGS[2]).sum())


def _content(samples: list[bytes], size: int, k: int) -> bytes:
    """The content that zstandard's trainer picks from samples; all of them where they are too few to train on."""
    try:
        packed = zstd.train_dictionary(size, samples, k=k, d=6).as_bytes()
    except zstd.ZstdError:
        return b"".join(samples)[:size]
    # entropy tables and control bytes come first, the picked segments last
    start = len(packed)
    while start and packed[start - 1] >= 32:
        start -= 1
    return packed[start:]


def distinct_texts(sample: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """The sample without exact and near copies: a text goes if two of its three long words of least checksum were seen."""
    seen: set[tuple[int, int]] = set()
    out = []
    for text, y in sample:
        low = sorted({crc32(w.encode()) for w in _WORDS.findall(text.lower()) if len(w) > 6})[:3]
        marks = {*zip(low, low[1:]), *zip(low, low[2:])}
        if not marks & seen:
            out.append((text, y))
        seen |= marks
    return out


def _logistic(x: np.ndarray, y: np.ndarray, share: float, ridge: float = 0.02, rounds: int = 40) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last weight is the intercept.

    Classes are weighted so that ``share`` of the weight is class 1's.
    """
    each = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    mean, std = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mean) / std, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        penalty = np.r_[np.full(len(w) - 1, ridge), 1e-6]
        step = np.linalg.solve((z * (each * p * (1 - p))[:, None]).T @ z / len(x) + np.diag(penalty), z.T @ (each * (p - y)) / len(x) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return np.r_[w[:-1] / std, w[-1] - (w[:-1] * mean / std).sum()]


def _loss(weights: np.ndarray, x: np.ndarray, y: np.ndarray, share: float) -> float:
    p = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))
    return float(-share * np.log(p[y == 1]).mean() - (1 - share) * np.log(1 - p[y == 0]).mean())


def _cut(toxic: np.ndarray, ordinary: np.ndarray, least: float) -> int:
    """The saving that is the most over-represented among toxic documents' windows and that ``least`` of them reach."""
    cuts = [c for c in range(1, 40) if (toxic >= c).sum() >= least] or [1]
    return max(cuts, key=lambda c: ((toxic >= c).mean() + 1e-9) / ((ordinary >= c).mean() + 1e-4))


def _fit_size(halves: list[list[str]], pool: list[bytes], check: list[str], base: bytes, size: int, share: float) -> tuple[float, CompressionModel]:
    """Rounds of choosing windows and training, for one size of the toxic dictionary, and the loss of its calibration."""
    cut_up = [[windows(t, SHORT, STEP) for t in half] for half in halves]
    chosen = [[w for doc in half for w in doc] for half in cut_up]
    ordinary, hard, turn = base, [], 0

    def next_pool() -> list[bytes]:
        nonlocal turn
        turn += 1
        start = (turn - 1) * POOL % max(1, len(pool))
        return pool[start : start + POOL]

    def learn(dictionaries: list[bytes]) -> None:
        """Ordinary windows that a toxic dictionary shortens train the ordinary one."""
        nonlocal ordinary
        plain, known = compressor(ordinary), set(hard)
        some = next_pool()
        saved = np.max([savings(plain, compressor(d + ordinary), some) for d in dictionaries], 0)
        hard.extend(w for w, s in zip(some, saved) if s >= 2 and w not in known)
        ordinary = (_content(hard, HARD, 32) if hard else b"") + base

    for turn_of in range(ROUNDS):
        dictionaries = [_content(c, size, 16) for c in chosen]
        learn(dictionaries)
        learn(dictionaries)
        if turn_of < ROUNDS - 1:
            plain, some, again = compressor(ordinary), next_pool(), []
            for h in (0, 1):
                other = compressor(dictionaries[1 - h] + ordinary)
                saved = savings(plain, other, [w for doc in cut_up[h] for w in doc])
                least = _cut(saved, savings(plain, other, some), 1.5 * len(halves[h]))
                again.append([w for w, s in zip((w for doc in cut_up[h] for w in doc), saved) if s >= least])
            chosen = again
    final = _content(chosen[0] + chosen[1], size, 16)
    learn([final])
    learn([final])
    plain, crossed = compressor(ordinary), [compressor(d + ordinary) for d in dictionaries]
    x = [_evidence(savings(plain, crossed[1 - h], windows(t))) for h in (0, 1) for t in halves[h]]
    x += [_evidence(savings(plain, crossed[i % 2], windows(t))) for i, t in enumerate(check)]
    x, y = np.array(x), np.r_[np.ones(len(x) - len(check)), np.zeros(len(check))]
    weights = _logistic(x, y, share)
    return _loss(weights, x, y, share), CompressionModel(final, ordinary, weights)


def train(sample: list[tuple[str, int]], share: float | None = None, sizes: tuple[int, ...] = (8_000,), seed: int = 3) -> CompressionModel:
    """Fit on labelled texts, of which a bounded number is given; of the toxic dictionary's ``sizes`` the one that calibrates best stays.

    ``share`` is class 1's share of all labels, where the sample doesn't show it.
    Without two distinct toxic or two ordinary samples every score is nearly 1 or
    0, as the labels have it (0 where there is no sample at all).
    """
    sample = distinct_texts(sample)
    rng = Random(seed)
    rng.shuffle(sample)
    toxic = [t for t, y in sample if y == 1]
    ordinary = [t for t, y in sample if y == 0]
    if len(toxic) < 2 or len(ordinary) < 2:
        return CompressionModel(b"", b"", np.array([9.0 if len(toxic) > len(ordinary) else -9.0]))
    learned = ordinary[len(ordinary) // 3 :]

    def some_windows(size: int, step: int, most: int) -> list[bytes]:
        """Windows of all the ordinary texts, about ``most`` by chance, in random order."""
        share = most / max(1, sum(max(1, len(t) // step) for t in learned))
        out = [w for t in learned for w in windows(t, size, step) if share >= 1 or rng.random() < share]
        rng.shuffle(out)
        return out

    base = _content(some_windows(WINDOW, WINDOW, 60_000), BASE, 32)
    pool = some_windows(SHORT, STEP, 10 * POOL)
    fits = [_fit_size([toxic[::2], toxic[1::2]], pool, ordinary[: len(ordinary) // 3], base, size, share or len(toxic) / len(sample)) for size in sizes]
    return min(fits, key=lambda f: f[0])[1]


def toxicity_scores(docs: DataFrame, model: CompressionModel) -> DataFrame:
    """``doc_id, score, best_saving, toxic_windows`` of every whole text.

    Null and empty texts are one empty window and get the score of a text without
    toxic windows. Repeated rows are each scored, with equal results. A long text
    is as many windows as it takes. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of under 120 KB

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        by = model.compressors()
        for batch in slices(batches):
            rows = [model.score(t, by) for t in batch.column(1).to_pylist()]
            out = pd.DataFrame(rows, columns=["score", "best", "n"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out["score"], pa.float64()), pa.array(out["best"], pa.int32()), pa.array(out["n"], pa.int32())], ["doc_id", "score", "best_saving", "toxic_windows"])

    return texts(docs).mapInArrow(score, "doc_id long, score double, best_saving int, toxic_windows int")


def without_toxic(docs: DataFrame, model: CompressionModel, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        by = model.compressors()
        for batch in slices(batches):
            text = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array([model.score(t or "", by)[0] < threshold for t in text], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def fit(docs: DataFrame, labels: DataFrame, most: int = 800, ordinary: int = 3, most_bytes: int = 32 << 20) -> CompressionModel:
    """Train outside the held-out fold (crc32 of the id mod 4 is 2).

    The sample is at most ``most`` toxic documents and ``ordinary`` times as many
    others, ``most_bytes`` of text in all.
    """
    rows = labelled_sample(docs, labels, "toxic", fold(4) != 2, {0: ordinary * most, 1: most}, most_bytes).collect()
    known = labels.where((fold(4) != 2) & F.col("toxic").isin(0, 1)).agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    return train(sorted((r["text"], r["y"]) for r in rows), known)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return toxicity_scores(docs, model).select(
        "doc_id",
        F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
        "best_saving",
        "toxic_windows",
    )
