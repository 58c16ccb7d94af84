"""Language identification by a byte convolutional network.

Bytes are embedded, filters of several widths slide over a window, the largest
response of each filter is kept, and a softmax layer names the language. The
network is trained with numpy on windows of labelled documents and applied to all
windows of every text, in batches of fixed length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from geoloom.llm.corpus import fold, table, texts
from geoloom.llm.text import slices, utf8

LENGTH = 256  # bytes of a window
WIDTHS = (2, 3, 4)
EMBED, FILTERS = 8, 12  # dimensions of a byte, filters of each width
REACH = max(WIDTHS)
STRIDE = LENGTH - REACH + 1  # every run of REACH bytes stands in one window

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def windows(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of every window and the row that it belongs to; an empty row has one empty window."""
    size = np.diff(at)
    n = np.maximum(1, -(-(size - REACH + 1) // STRIDE))
    row = np.repeat(np.arange(len(size)), n)
    return at[:-1][row] + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * STRIDE, row


def window_bytes(data: np.ndarray, at: np.ndarray, starts: np.ndarray, row: np.ndarray) -> np.ndarray:
    places = starts[:, None] + np.arange(LENGTH)
    inside = places < at[1:][row][:, None]
    if not len(data):
        return np.zeros(places.shape, np.uint8)
    return np.where(inside, _FOLD[data[np.minimum(places, len(data) - 1)]], 0).astype(np.uint8)


@dataclass
class ByteNetwork:
    languages: list[str]
    embed: np.ndarray  # (256, EMBED), byte 0 is padding
    filters: np.ndarray  # (REACH * EMBED, filters); narrower filters end in zeros
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def _patches(self, x: np.ndarray) -> np.ndarray:
        e = np.ascontiguousarray(self.embed[x])
        step = EMBED * e.itemsize
        return np.lib.stride_tricks.as_strided(e, (len(x), LENGTH - REACH + 1, REACH * EMBED), (LENGTH * step, step, e.itemsize))

    def responses(self, x: np.ndarray) -> np.ndarray:
        p = self._patches(x)
        return (p.reshape(-1, REACH * EMBED) @ self.filters).reshape(len(x), -1, self.filters.shape[1])

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.languages)), np.float32)
        for i in range(0, len(x), 128):
            pooled = np.maximum(self.responses(x[i : i + 128]).max(1) + self.bias, 0)
            z = pooled @ self.out + self.out_bias
            z = np.exp(z - z.max(1, keepdims=True))
            out[i : i + 128] = z / z.sum(1, keepdims=True)
        return out


def train(x: np.ndarray, y: np.ndarray, languages: list[str], rounds: int = 6, seed: int = 5) -> ByteNetwork:
    """Adam on the cross-entropy of windows; the gradient goes through each filter's largest response."""
    rng = np.random.default_rng(seed)
    mask = np.concatenate([np.tile((np.arange(REACH * EMBED) < w * EMBED)[:, None], FILTERS) for w in WIDTHS], axis=1).astype(np.float32)
    n = mask.shape[1]
    net = ByteNetwork(
        languages, rng.normal(0, 0.5, (256, EMBED)).astype(np.float32), rng.normal(0, 0.25, mask.shape).astype(np.float32) * mask,
        np.zeros(n, np.float32), rng.normal(0, 0.1, (n, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32),
    )
    net.embed[0] = 0
    names = ("embed", "filters", "bias", "out", "out_bias")
    first = {k: np.zeros_like(getattr(net, k)) for k in names}
    second = {k: np.zeros_like(getattr(net, k)) for k in names}
    step = 0
    for _ in range(rounds):
        for some in np.array_split(rng.permutation(len(x)), max(1, len(x) // 64)):
            xb, yb, b = x[some], y[some], len(some)
            r = net.responses(xb)
            top = r.argmax(1)
            best = np.take_along_axis(r, top[:, None], 1)[:, 0] + net.bias
            pooled = np.maximum(best, 0)
            z = pooled @ net.out + net.out_bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(b), yb] -= 1
            p /= b
            back = (p @ net.out.T) * (best > 0)
            patch = net._patches(xb)[np.arange(b)[:, None], top]  # (b, filters, REACH * EMBED)
            grad = {"out": pooled.T @ p, "out_bias": p.sum(0), "bias": back.sum(0), "filters": np.einsum("bfk,bf->kf", patch, back) * mask}
            spread = (back[:, :, None] * net.filters.T[None]).reshape(b, n, REACH, EMBED)
            bytes_at = xb[np.arange(b)[:, None, None], top[:, :, None] + np.arange(REACH)]
            grad["embed"] = np.zeros_like(net.embed)
            np.add.at(grad["embed"], bytes_at.ravel(), spread.reshape(-1, EMBED))
            grad["embed"][0] = 0
            step += 1
            for k in names:
                first[k] = 0.9 * first[k] + 0.1 * grad[k]
                second[k] = 0.999 * second[k] + 0.001 * grad[k] ** 2
                getattr(net, k)[...] -= 0.01 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return net


def training_windows(docs: DataFrame, learnable: Column, most: int, each: int = 4, most_languages: int = 10_000) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows of about ``most`` documents of each language, ``each`` at most from one, evenly spread.

    Documents are chosen by a hash of the id; equal windows count once. ``most``, ``each``
    and ``most_languages`` (the most frequent labels, more than there are language codes)
    bound the sample that a model is fitted on.
    """
    known = docs.where(learnable & F.col("lang").isNotNull())
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages)
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(float(1 << 20)) * F.lit(most) / F.col("n")
    some = texts(known, "lang").join(F.broadcast(counts), "lang").where(share).select("text", "lang")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, at = utf8(batch.column(0))
            starts, row = windows(data, at)
            first = np.searchsorted(row, np.arange(batch.num_rows + 1))
            pick = np.concatenate([np.unique(np.linspace(i, j - 1, each).astype(int)) for i, j in zip(first[:-1], first[1:])])
            x = window_bytes(data, at, starts[pick], row[pick])
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), batch.column(1).take(pa.array(row[pick]))], ["x", "lang"])

    rows = sorted((r["lang"], bytes(r["x"])) for r in some.mapInArrow(cut, "x binary, lang string").distinct().collect())
    languages = sorted({lang for lang, _ in rows})
    x = np.array([np.frombuffer(b, np.uint8) for _, b in rows]).reshape(-1, LENGTH)
    return x, np.array([languages.index(lang) for lang, _ in rows], int), languages


def languages_of(docs: DataFrame, net: ByteNetwork | None) -> DataFrame:
    """``doc_id, lang_pred, score`` of every whole text.

    A document's distribution is the mean over its windows. A text without a
    letter (null and empty ones too) is ``und`` with score 1; without a network all others are ``und`` with score 0.
    Of languages that tie the one first in the alphabet is named. Repeated rows get equal results, long
    texts are read whole, an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)  # about 5,000 numbers

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in slices(batches, size=1 << 20):
            data, at = utf8(batch.column(1))
            n = batch.num_rows
            has = np.bincount(np.repeat(np.arange(n), np.diff(at))[_LETTER[data]], minlength=n) > 0
            for i in np.flatnonzero(~has):
                has[i] = any(c.isalpha() for c in bytes(data[at[i] : at[i + 1]]).decode())
            lang, score = np.full(n, "und", object), np.where(has, 0.0, 1.0)
            if net is not None:
                starts, row = windows(data, at)
                p = np.zeros((n, len(net.languages)))
                for i in range(0, len(starts), 1024):
                    part = slice(i, i + 1024)
                    q = net.probabilities(window_bytes(data, at, starts[part], row[part]))
                    for c in range(q.shape[1]):
                        p[:, c] += np.bincount(row[part], q[:, c], n)
                p /= np.bincount(row, minlength=n)[:, None]
                lang[has] = np.array(net.languages, object)[p.argmax(1)][has]
                score[has] = p.max(1)[has]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(np.clip(score, 0, 1))], ["doc_id", "lang_pred", "score"])

    return texts(docs).mapInArrow(name, "doc_id long, lang_pred string, score double")


def fit(docs: DataFrame, most: int = 400) -> ByteNetwork | None:
    """Train outside the held-out fold (crc32 of the id mod 5 is 0); None without labels."""
    x, y, languages = training_windows(docs, fold(5) != 0, most)
    return train(x, y, languages) if languages else None


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return languages_of(docs, fit(docs)).select("doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
