"""Benchmark items inside documents: MinHash containment search in size partitions.

Items are partitioned by their number of shingles. For a partition with sizes up
to ``u``, a document is read in windows of ``1.5 * u`` shingles every ``u / 2``, so
that a passage of an item's length lies whole in one window and is a fixed part
of it; MinHash then sees a similarity that doesn't sink with the document's
length. Signatures are one-permutation MinHashes: ``BINS`` bins under each of
``HASHES`` hash functions, a collision in any bin makes a candidate. A passage that
holds a whole item of several shingles escapes with a probability under 1e-7, one
of a single shingle with about 5e-6.

Candidates are verified on whole sets of shingles. A window's signature is only
worked out in bins where one of its shingles is an item's minimum: elsewhere it
can't collide.

Documents are read where they lie, nothing is shuffled. Items are sent to the
tasks in blocks of about ``BLOCK`` shingles, one after another: the driver and the
tasks hold one block at a time. More items mean more blocks and a scan for each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from geoloom.llm.corpus import table, texts
from geoloom.llm.text import mix, run_hashes, shingle_sets, slices, utf8, whole, word_hashes, words
from geoloom.sources.shared import materialise

BINS, HASHES, GROWTH, SMALLEST = 32, 4, 1.5, 8
BLOCK = 2_000_000  # shingles of items that are sent to the tasks at once
_SALTS = [np.uint64(x) for x in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89)]


@dataclass
class ItemIndex:
    """Shingle sets of items and, by hash function, their bin minima with size partition and item."""

    ids: list
    sets: list[np.ndarray]
    width: np.ndarray  # the partition's upper size, by item
    minima: list[tuple[np.ndarray, np.ndarray]]  # sorted minima and their items
    short: dict[int, dict[int, list[int]]]  # items of fewer than k words: by length, hash of the whole
    likely: list[np.ndarray]  # 2**16 flags by the minima's leading bits


def _upper(size: int) -> int:
    u = SMALLEST
    while u < size:
        u = int(u * GROWTH) + 1
    return u


def index_items(items: list[tuple[int, str]], k: int) -> ItemIndex:
    index = ItemIndex([], [], np.zeros(0, int), [], {}, [])
    widths = []
    for item, text in items:
        data, at = utf8(pa.array([text], pa.string()))
        starts, ends, firsts = words(data, at)
        if not len(starts):
            continue
        index.ids.append(item)
        if len(starts) < k:
            whole_run = int(run_hashes(word_hashes(data, starts, ends, lower=True), len(starts))[0])
            index.short.setdefault(len(starts), {}).setdefault(whole_run, []).append(len(index.ids) - 1)
            index.sets.append(np.zeros(0, np.uint64))
        else:
            index.sets.append(shingle_sets(data, at, k)[0])
        widths.append(_upper(len(index.sets[-1])))
    index.width = np.array(widths, int)
    for salt in _SALTS[:HASHES]:
        values, owner = [], []
        for i, s in enumerate(index.sets):
            h = np.sort(mix(s ^ salt))
            keep = np.r_[True, (h[1:] >> np.uint64(59)) != (h[:-1] >> np.uint64(59))] if len(h) else np.zeros(0, bool)
            values.append(h[keep])
            owner.append(np.full(int(keep.sum()), i))
        v, o = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (values, owner))
        order = np.argsort(v, kind="stable")
        index.minima.append((v[order], o[order].astype(int)))
        flags = np.zeros(1 << 16, bool)
        flags[(v >> np.uint64(48)).astype(int)] = True
        index.likely.append(flags)
    return index


def _collides(hashes: np.ndarray, place: int, width: int) -> bool:
    """Is this shingle the least of its bin in a window of its document that holds it."""
    stride, size = max(1, width // 2), width + max(1, width // 2)
    b = hashes[place] >> np.uint64(59)
    for start in range((place // stride) * stride, max(-1, place - size), -stride):
        some = hashes[start : start + size]
        if start + size > place and not ((some < hashes[place]) & (some >> np.uint64(59) == b)).any():
            return True
    return False


def search(batch: pa.RecordBatch, index: ItemIndex, k: int, percent: int) -> list[tuple[int, int, int, int]]:
    """(row, item, common shingles, item's shingles) of every contained item."""
    data, at = utf8(batch.column(batch.schema.get_field_index("text")))
    starts, ends, firsts = words(data, at)
    hashes = word_hashes(data, starts, ends, lower=True)
    runs = run_hashes(hashes, k)
    inside = whole(firsts, k)[: len(runs)]
    candidates: set[tuple[int, int]] = set()
    for salt, (minima, owner), likely in zip(_SALTS, index.minima, index.likely):
        if not len(minima) or not len(runs):
            continue
        h = mix(runs ^ salt)
        some = np.flatnonzero(likely[(h >> np.uint64(48)).astype(np.int64)] & inside)
        left = np.searchsorted(minima, h[some])
        hit = minima[np.minimum(left, len(minima) - 1)] == h[some]
        some, left = some[hit], left[hit]
        rows = np.searchsorted(firsts, some, "right") - 1
        for p, j, r in zip(some.tolist(), left.tolist(), rows.tolist()):
            while j < len(minima) and minima[j] == h[p]:
                i = int(owner[j])
                if (r, i) not in candidates and _collides(h[firsts[r] : max(firsts[r], firsts[r + 1] - k + 1)], p - int(firsts[r]), int(index.width[i])):
                    candidates.add((r, i))
                j += 1
    out, own, last = [], None, -1
    for r, i in sorted(candidates):
        if r != last:
            own, last = np.unique(runs[firsts[r] : firsts[r + 1] - k + 1]), r
        s = index.sets[i]
        common = int((own[np.minimum(np.searchsorted(own, s), len(own) - 1)] == s).sum())
        if 100 * common >= percent * len(s):
            out.append((r, i, common, len(s)))
    for n, known in index.short.items():
        short = run_hashes(hashes, n)
        places = np.flatnonzero(np.isin(short, np.array(list(known), np.uint64)) & whole(firsts, n)[: len(short)])
        found = {(int(r), i) for p, r in zip(places.tolist(), np.searchsorted(firsts, places, "right") - 1) for i in known[int(short[p])]}
        out += [(r, i, 1, 1) for r, i in found]
    return sorted(out)


def _blocks(items: DataFrame, k: int) -> Iterator[tuple[ItemIndex, bool]]:
    """Indexes over all items, one at a time, and whether there are several. Items are read from the driver a block at a time."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("item_id is not null").distinct()
    total = rows.agg(F.sum(F.length("text") / 4 + 1)).first()[0] or 0
    n = max(1, int(-(-total // BLOCK)))
    # dealt once, so that a block doesn't read all items again
    dealt = materialise(rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n))).repartition("block").sortWithinPartitions("block"), "items") if n > 1 else rows.withColumn("block", F.lit(0))
    for b in range(n):
        yield index_items(sorted((r["item_id"], r["text"]) for r in dealt.where(F.col("block") == b).collect()), k), n > 1


def contained_items(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Benchmark items whose k-word shingles (ASCII letters lowered) stand to ``percent`` percent in a document.

    Returns ``doc_id, item_id, n_common, n_item``. An item of fewer than k words
    counts as one shingle, its word sequence; one without words or without an id is
    never found. Null and empty texts hold nothing. Repeated documents are each
    reported, repeated items once. Long texts are read whole, an empty table gives no rows.
    """
    spark = docs.sparkSession
    parts = []
    for index, several in _blocks(items, k):
        shared = spark.sparkContext.broadcast(index)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in slices(batches):
                found = search(batch, index, k, percent)
                doc = batch.column(0).take(pa.array([x[0] for x in found], pa.int64()))
                yield pa.RecordBatch.from_arrays([doc, *(pa.array(x, pa.int64()) for x in ([index.ids[y[1]] for y in found], [y[2] for y in found], [y[3] for y in found]))], ["doc_id", "item_id", "n_common", "n_item"])

        found = texts(docs).mapInArrow(scan, "doc_id long, item_id long, n_common long, n_item long")
        parts.append(materialise(found, "contained") if several else found)
        if several:
            shared.unpersist()
    return reduce(DataFrame.union, parts)


def without_contaminated(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no item as :func:`contained_items` has it."""
    for index, several in _blocks(items, k):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                keep = np.ones(batch.num_rows, bool)
                keep[[x[0] for x in search(batch, shared.value, k, percent)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(scan, docs.schema)
        if several:
            docs = materialise(docs, "clean")
            shared.unpersist()
    return docs


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP8_SQL = r"""
WITH t AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark
), w AS (
  SELECT kind, id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM t
), p AS (
  SELECT kind, id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5
), s AS (
  SELECT DISTINCT kind, id, array_to_string(ws[i : i + 4], ' ') AS g FROM p
), n AS (
  SELECT id, count(*) AS n_item FROM s WHERE kind = 'i' GROUP BY id
), c AS (
  SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_common
  FROM s i JOIN s d ON i.g = d.g AND i.kind = 'i' AND d.kind = 'd' GROUP BY d.id, i.id
)
SELECT doc_id, item_id, n_common, n_item FROM c JOIN n ON n.id = item_id WHERE 100 * n_common >= 80 * n_item
"""
