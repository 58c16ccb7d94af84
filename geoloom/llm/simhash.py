"""Near duplicates by SimHash fingerprints, found with the anchors of a covering code.

A fingerprint's bits are cut into blocks of 23, 23, 15 and 3, and each block has a
perfect code: two binary Golay codes (radius 3), a Hamming code (radius 1) and
triple repetition (radius 1). Every block of bits lies within its radius of exactly
one code word, so the products of code words cover all fingerprints: they are the
anchors. The first one, two, three or four blocks are used, as the number of
fingerprints asks for.

A fingerprint's home is the anchor within the radius in every block. One that
differs from it in d bits lies, summed over the blocks, within the radii plus d of
that home. So each fingerprint is sent to all anchors within radius plus threshold,
and two that link meet at the home of either, where all bits are compared. An
anchor that is too full is replaced by anchors with one more block, for its
fingerprints only. Equal fingerprints are one throughout. An anchor returns as many
pairs at most as it has fingerprints, enough to join what it has found linked.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from geoloom.llm.corpus import looked_up, table, texts
from geoloom.llm.text import slices, utf8, words
from geoloom.operators.components import connected_components
from geoloom.sources.shared import materialise

#: Length, generator polynomial (binary) and covering radius of each block's cyclic code.
BLOCKS = ((23, 0b110001110101, 3), (23, 0b110001110101, 3), (15, 0b10011, 1), (3, 0b111, 1))
SEED = 42
SHINGLES = 1 << 16  # whose bits are counted at once
PER_HOME = 256  # fingerprints that an anchor is home to on average before another block is used
FULL = 1 << 29  # comparisons of one anchor before it is split
CELLS = 1 << 22  # comparisons in memory at once
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _row_fingerprint(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, k: int) -> int:
    """Fingerprint of one row; ``text`` has its words with one space between them."""
    if not len(starts):
        return 0
    if len(starts) < k:
        firsts, lasts = starts[:1], ends[-1:]
    else:
        firsts, lasts = starts[: len(starts) - k + 1], ends[k - 1 :]
    data, digest, ones = text.tobytes(), xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, len(firsts), SHINGLES):
        cut = zip(firsts[i : i + SHINGLES].tolist(), lasts[i : i + SHINGLES].tolist())
        h = np.array([digest(data[a:b], SEED) for a, b in cut], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(sum(1 << int(b) for b in np.flatnonzero(2 * ones > len(firsts))))


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """``doc_id, fingerprint`` (64 bits as a long) of every row.

    Words are lowered in A-Z only. A bit is 1 if more than half of the hashes of all
    k-word shingles, repeats included, have it. A text of fewer words is one shingle;
    one without words, or null, has fingerprint 0. Texts are read whole.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, at = utf8(batch.column(batch.schema.get_field_index("text")))
            starts, ends, first = words(data, at)
            # every word with one space behind it
            size = ends - starts
            new_start = np.cumsum(size + 1) - (size + 1)
            joined = np.full(int((size + 1).sum()), 0x20, np.uint8)
            place = np.repeat(new_start - starts, size) if len(size) else np.zeros(0, np.int64)
            taken = np.zeros(len(data) + 1, np.int8)
            np.add.at(taken, starts, 1)
            np.add.at(taken, ends, -1)
            taken = np.flatnonzero(np.cumsum(taken[:-1]))
            joined[taken + place] = _LOWER[data[taken]]
            new_end = new_start + size
            out = np.zeros(batch.num_rows, np.uint64)
            for r, (i, j) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
                if j > i:
                    a = new_start[i]
                    out[r] = _row_fingerprint(joined[a : new_end[j - 1]], new_start[i:j] - a, new_end[i:j] - a, k)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(out.view(np.int64))], ["doc_id", "fingerprint"])

    return texts(docs).mapInArrow(scan, "doc_id long, fingerprint long")


@cache
def _errors(block: int, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Error patterns up to radius + threshold, by syndrome: patterns, excess over the radius, each syndrome's start, each word part's syndrome table."""
    n, g, radius = BLOCKS[block]
    check = g.bit_length() - 1
    unit = []
    for i in range(n):
        x = 1 << i
        while x.bit_length() > check:
            x ^= g << (x.bit_length() - 1 - check)
        unit.append(x)
    pattern, syndrome, weight = [], [], []
    for w in range(min(n, radius + threshold) + 1):
        for bits in combinations(range(n), w):
            e = s = 0
            for b in bits:
                e |= 1 << b
                s ^= unit[b]
            pattern.append(e)
            syndrome.append(s)
            weight.append(max(0, w - radius))
    order = np.lexsort((pattern, weight, syndrome))
    syndrome = np.array(syndrome)[order]
    starts = np.searchsorted(syndrome, np.arange((1 << check) + 1))
    return np.array(pattern, np.uint64)[order], np.array(weight)[order], starts, np.array(unit, np.int64)


def anchors_of(prints: np.ndarray, left: np.ndarray, block: int, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code words of one block that prints may meet at: row numbers, code words in place, and what is left of each one's threshold."""
    n = BLOCKS[block][0]
    shift = np.uint64(sum(b[0] for b in BLOCKS[:block]))
    part = (prints >> shift) & np.uint64((1 << n) - 1)
    pattern, excess, starts, unit = _errors(block, threshold)
    syndrome = np.zeros(len(prints), np.int64)
    for i in range(n):
        syndrome ^= ((part >> np.uint64(i)) & np.uint64(1)).astype(np.int64) * unit[i]
    many = starts[syndrome + 1] - starts[syndrome]
    rows = np.repeat(np.arange(len(prints)), many)
    which = np.arange(len(rows)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(starts[syndrome], many)
    keep = excess[which] <= left[rows]
    rows, which = rows[keep], which[keep]
    return rows, (part[rows] ^ pattern[which]) << shift, left[rows] - excess[which]


def _sent(entries: DataFrame, block: int, threshold: int) -> DataFrame:
    """Entries ``anchor, left, fingerprint`` at anchors of one more block."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                anchor, left, prints = (batch.column(c)[i : i + 4096].to_numpy(zero_copy_only=False) for c in range(3))
                rows, word, rest = anchors_of(prints.view(np.uint64), left, block, threshold)
                to = anchor.view(np.uint64)[rows] | word
                yield pa.RecordBatch.from_arrays([pa.array(to.view(np.int64)), pa.array(rest.astype(np.int32)), pa.array(prints[rows])], ["anchor", "left", "fingerprint"])

    return entries.select("anchor", "left", "fingerprint").mapInArrow(scan, "anchor long, left int, fingerprint long")


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each of n nodes' components under pairs a, b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _met(homes: np.ndarray, guests: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of fingerprints that join everything linked between residents of an anchor, or a resident and a guest."""
    every = np.r_[homes, guests]
    root = np.arange(len(every))
    width = max(1, CELLS // len(every))
    for i in range(0, len(homes), width):
        near = np.bitwise_count(homes[i : i + width, None] ^ every[None, :]) <= threshold
        a, b = np.nonzero(near)
        a += i
        other = a != b
        if other.any():
            root = _roots(len(every), np.r_[np.arange(len(every)), a[other]], np.r_[root, b[other]])
    moved = np.flatnonzero(root != np.arange(len(every)))
    return every[moved], every[root[moved]]


def links(prints: DataFrame, threshold: int = 2, blocks: int | None = None, full: int = FULL) -> DataFrame:
    """Pairs ``a, b`` of the distinct ``fingerprint`` values that join all that differ in ``threshold`` bits or fewer.

    Not every linked pair is a row, but the pairs' components are those of all
    links. ``blocks`` of the code are used at once, by default as many as leave an
    anchor home to a few hundred fingerprints; at an anchor with over ``full``
    comparisons the next block is used as well.
    """
    if not 0 <= threshold <= 3:
        raise ValueError("anchors are sent to for a threshold from 0 to 3")
    words_of = [n - (g.bit_length() - 1) for n, g, _ in BLOCKS]
    if blocks is None:
        n, blocks = prints.count(), 1
        while blocks < len(BLOCKS) and n > PER_HOME << sum(words_of[:blocks]):
            blocks += 1
    entries = prints.select(F.lit(0).cast("long").alias("anchor"), F.lit(threshold).alias("left"), "fingerprint")
    for block in range(blocks):
        entries = _sent(entries, block, threshold)
    out = None
    while True:
        entries = materialise(entries, "anchor_entries")
        if blocks == len(BLOCKS):
            now, over = entries, None
        else:
            home = F.sum((F.col("left") == threshold).cast("long"))
            over = materialise(entries.groupBy("anchor").agg((home * F.count("*")).alias("pairs")).where(F.col("pairs") > full).select("anchor"), "full_anchors")
            now = entries.join(over, "anchor", "left_anti")
        found = now.groupBy("anchor").applyInArrow(_at_anchor(threshold), "a long, b long")
        out = found if out is None else out.unionByName(found)
        if over is None or not over.limit(1).count():
            return out
        entries = _sent(entries.join(over, "anchor", "left_semi"), blocks, threshold)
        blocks += 1


def _at_anchor(threshold: int):
    def meet(t: pa.Table) -> pa.Table:
        prints, left = t.column("fingerprint").to_numpy().view(np.uint64), t.column("left").to_numpy()
        a, b = _met(prints[left == threshold], prints[left < threshold], threshold) if (left == threshold).any() and len(left) > 1 else (prints[:0], prints[:0])
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    return meet


def near_duplicates(docs: DataFrame, k: int = 3, threshold: int = 2, blocks: int | None = None, full: int = FULL) -> DataFrame:
    """Every row of ``docs`` as ``doc_id, fingerprint`` (long) ``, component_id``: the smallest doc_id that links of fingerprints reach.

    Fingerprints link at ``threshold`` or fewer differing bits. Texts without words
    have fingerprint 0 and link like any other. Repeated rows share a class; a null
    id never names a class that has another id. Other columns are ignored. An empty
    table gives no rows.
    """
    own = materialise(fingerprints(docs, k), "fingerprints")
    prints = materialise(own.groupBy("fingerprint").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct_fingerprints")
    total = prints.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    joined = connected_components(links(prints, threshold, blocks, full), "a", "b").select(F.col("node").alias("fingerprint"), "component")
    classed = materialise(prints.join(joined, "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint")), "classes")
    first = classed.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("m"))
    distinct = classed.count()
    known = materialise(looked_up(classed.select("component", "fingerprint", "n"), first, "component", "m", distinct).select("fingerprint", "component_id", "n"), "known")
    return looked_up(own, known, "fingerprint", "n", total).select("doc_id", "fingerprint", "component_id")


def op13_simhash(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"), k=3, threshold=2)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
