"""Secrets in text: fixed patterns, and Markov models for strings that no pattern names.

Two character models of order one, one of random strings and one of ordinary
identifiers, give every token of 16 or more characters a log-likelihood ratio per
character; a token whose ratio passes the threshold is reported as kind ``markov``.
Both models are trained on labelled samples, and samples that they weren't trained
on set the threshold.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from geoloom.llm.corpus import table, texts
from geoloom.llm.text import slices
from geoloom.sources.shared import materialise

# fixed values: the base patterns, in the order of kinds
KINDS = ("assign", "access", "hex")
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"

_ASSIGN = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(ACCESS)
_HEX = re.compile(r"[0-9a-f]{32,}")  # as greedy runs of HEX that are long enough
TOKEN = 16  # characters of a token that the models are asked about
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_WORD = re.compile(r"[A-Za-z0-9+/_=-]{4,}")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, sorted; a match of another pattern's place stays."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


@dataclass(frozen=True)
class MarkovPair:
    """Log transition probabilities over byte values of random and of ordinary strings."""

    ratio: np.ndarray  # (256, 256): log P(random) - log P(ordinary); row 0 stands for the start
    threshold: float

    def scores(self, tokens: list[str]) -> np.ndarray:
        """Mean log-likelihood ratio of each (non-empty) token."""
        flat, at = joined(tokens)
        return np.add.reduceat(self.ratio[flat[:-1], flat[1:]] * (flat[1:] != 0), at).astype(float) / np.diff(np.r_[at, len(flat) - 1] - np.arange(len(at) + 1)) if len(tokens) else np.zeros(0)


def joined(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the tokens with a zero before and after each, and the place of each one's leading zero."""
    flat = np.frombuffer(("\0" + "\0".join(tokens) + "\0").encode("ascii", "replace"), np.uint8)
    return flat, np.flatnonzero(flat == 0)[:-1]


def pair_counts(samples: DataFrame) -> DataFrame:
    """``label, pair, n``: how often a pair of neighbouring characters (256 * first + second) stands in the labelled strings.

    ``samples`` has ``value string, label int`` (1: random). Each partition sends
    its sums, 65,536 rows a label at most. Null and empty values count nothing.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 65536), np.int64)
        for batch in batches:
            labels = np.array(batch.column(1).to_pylist(), object)
            for label in (0, 1):
                some = [v for v in batch.column(0).filter(pa.array(labels == label)).to_pylist() if v]
                if some:
                    flat = joined(some)[0].astype(np.int64)
                    total[label] += np.bincount(flat[:-1] * 256 + flat[1:], minlength=65536)
        total[:, ::256] = 0  # the end of a string tells nothing
        label, pair = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(label.astype(np.int32)), pa.array(pair.astype(np.int32)), pa.array(total[label, pair])], ["label", "pair", "n"])

    return samples.select("value", "label").mapInArrow(count, "label int, pair int, n long").groupBy("label", "pair").agg(F.sum("n").alias("n"))


#: Characters of random strings in general; samples of them complete what the corpus shows.
ALPHABETS = (
    "0123456789abcdef",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
)


def train(samples: DataFrame, held_out: DataFrame | None = None, false_share: float = 0.0005) -> MarkovPair:
    """Fit both models with add-half smoothing on labelled strings, and the threshold on others.

    The threshold is the least at which no more than ``false_share`` of the ordinary
    strings of ``held_out`` (``value, label``, collected: pass a bounded sample; only
    strings of TOKEN characters and more count) would be reported, or where their mean
    and that of the random ones meet half-way, if that is higher. Without samples of
    a label its model is uniform over printable characters.
    """
    counts = np.zeros((2, 256 * 256))
    got = pair_counts(samples).toPandas()  # 2 * 65,536 rows at most
    counts[got["label"].to_numpy(int), got["pair"].to_numpy(int)] = got["n"].to_numpy(float)
    counts = counts.reshape(2, 256, 256)
    letters = np.zeros(256)
    letters[33:127] = 0.5
    logs = np.log((counts + letters) / (counts + letters).sum(2, keepdims=True).clip(1e-9) + 1e-12)
    ratio = (logs[1] - logs[0]).clip(-8, 8).astype(np.float32)
    model = MarkovPair(ratio, 0.35)
    rows = [] if held_out is None else [r for r in held_out.collect() if r["value"] and len(r["value"]) >= TOKEN]
    ordinary, random = (model.scores(sorted(r["value"] for r in rows if r["label"] == label)) for label in (0, 1))
    if len(ordinary) and len(random):
        model = MarkovPair(ratio, float(max(np.quantile(ordinary, 1 - false_share), (ordinary.mean() + random.mean()) / 2)))
    return model


def drawn_samples(words: list[str], n: int, seed: int) -> list[tuple[str, int]]:
    """``n`` random strings (label 1) and as many identifiers that are built from words, counters, dates, rules of one sign and ids of digits (label 0)."""
    rng = np.random.default_rng(seed)
    words = words or ["name", "value", "index", "section", "introduction", "result"]
    random = ["".join(rng.choice(list(ALPHABETS[i % len(ALPHABETS)]), int(rng.integers(TOKEN, 65)))) for i in range(n)]

    def digits(least: int, most: int) -> str:
        """A counter: few digits that tell, after zeros."""
        size = int(rng.integers(least, most + 1))
        return str(rng.integers(0, 10 ** min(size, int(rng.integers(1, 8))))).zfill(size)

    def word() -> str:
        return words[int(rng.integers(len(words)))]

    def one(kind: int) -> str:
        sep = "_-/="[int(rng.integers(4))]
        day = f"{rng.integers(1970, 2040)}{sep}{rng.integers(1, 13):02d}{sep}{rng.integers(1, 29):02d}"
        return (
            sep.join(word() for _ in range(int(rng.integers(2, 6)))), f"{word()}{sep}{word()}{sep}{digits(1, 12)}", f"{word()}{digits(1, 4)}{sep}{word()}{digits(1, 4)}",
            f"{word()}{sep}{day}{sep}{digits(2, 6)}", "".join(word().capitalize() for _ in range(int(rng.integers(2, 6)))), f"{word().upper()}{sep}{word().upper()}{sep}{digits(1, 6)}",
            digits(TOKEN, 24) if rng.random() < 0.7 else "-=_/+"[int(rng.integers(5))] * int(rng.integers(TOKEN, 80)), "-".join(str(rng.integers(0, 10**min(x, 18))).zfill(x) for x in (8, 4, 4, 4, 12)),
        )[kind]

    return [(x, 1) for x in random] + [(one(i % 8), 0) for i in range(n)]


def corpus_samples(docs: DataFrame, most: int = 20_000) -> DataFrame:
    """The corpus's own identifiers for :func:`train`.

    ``value, label`` (0), once for each value, of the tokens of four and more characters outside base
    matches in about ``most`` documents, picked by a hash of the id; tokens of
    TOKEN and more characters that hold a digit are left out, since secrets are among
    them; :func:`drawn_samples` stands for such.
    """
    every = max(1, -(-docs.count() // most))
    some = texts(docs).where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(every)) == 0)

    def ordinary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for text in batch.column(0).to_pylist():
                spans, last = base_spans(text), 0
                for start, _, end in [*spans, (len(text), 0, len(text))]:
                    out += [w for w in _WORD.findall(text[last:start]) if len(w) < TOKEN or not any(map(str.isdigit, w))]
                    last = max(last, end)
            out = sorted(set(out))
            yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.string()), "label": pa.array([0] * len(out), pa.int32())})

    return some.select("text").mapInArrow(ordinary, "value string, label int").distinct()


def fit(docs: DataFrame, most: int = 20_000, drawn: int = 4_000, held_out: int = 8_000) -> MarkovPair:
    """Both models from the corpus's identifiers and drawn strings; the threshold from ``held_out`` long strings of either kind."""
    spark = docs.sparkSession
    found = materialise(corpus_samples(docs, most), "identifiers")
    plain = found.where(F.length("value").between(4, 12) & F.col("value").rlike("^[A-Za-z]+$")).select(F.lower("value").alias("w")).distinct()
    words = sorted(r["w"] for r in plain.orderBy(F.xxhash64("w"), "w").limit(500).collect())
    last = F.pmod(F.xxhash64("value", F.lit(1)), F.lit(5)) == 0  # never trained on
    made = lambda n, seed: spark.createDataFrame(drawn_samples(words, n, seed), "value string, label int")
    learned = found.where(~last).select("value", "label").union(made(drawn, 7))
    check = found.where(last & (F.length("value") >= TOKEN)).orderBy(F.xxhash64("value"), "value").limit(held_out).select("value", "label").union(made(held_out // 4, 8))
    return train(learned, check)


def find_secrets(docs: DataFrame, model: MarkovPair) -> DataFrame:
    """Every span of every text.

    Returns ``doc_id`` and ``found``, an array of (start, kind, end) in code
    points, sorted by start, then kind. Kinds 0 to 2 are the base patterns; kind
    3 is a token of TOKEN or more characters that overlaps no base match and whose
    ratio passes the model's threshold. Null and empty texts give an empty array;
    rows that repeat are each reported, with equal results; a long text is read
    whole. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 0.3 MB

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches):
            spans, tokens = [], []  # tokens: (row, start, end)
            for row, text in enumerate(batch.column(1).to_pylist()):
                own = base_spans(text)
                spans.append(own)
                tokens += [(row, m.start(), m.end(), m[0]) for m in _TOKEN.finditer(text) if not any(s < m.end() and m.start() < e for s, _, e in own)]
            for (row, start, end, _), score in zip(tokens, model.scores([t[3] for t in tokens])):
                if score >= model.threshold:
                    spans[row].append((start, 3, end))
            out = [[{"start": s, "kind": k, "end": e} for s, k, e in sorted(own)] for own in spans]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["doc_id", "found"])

    return texts(docs).mapInArrow(scan, "doc_id long, found array<struct<start: long, kind: int, end: long>>")


def op1_secrets(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = find_secrets(docs, fit(docs))
    name = lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, (*KINDS, "markov"))), x["kind"] + 1), x["start"], x["end"])
    base = F.filter("found", lambda x: x["kind"] < 3)
    n = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *(n(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)),
        F.sha2(F.concat_ws(",", F.transform(base, name)), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform("found", name)).alias("spans"),
        n(3).alias("n_markov"),
    )
