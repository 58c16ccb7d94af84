"""Repeated passages, by suffix trees that are split by variable-length prefixes.

Suffixes are word suffixes. Of every window the suffix that starts at the smallest
three-word prefix (by a hash, the first of equal ones) is its anchor, so equal
windows have equal anchors at equal distance. Windows in a row with one anchor
form a segment, and a segment goes to the group of its anchor's prefix: one word,
or two or three where a group would get too heavy; lighter neighbours share a
group, and a prefix that is too heavy at three words is split by whole windows.
Sending segments in place of every suffix's own words costs about three words a
word instead of ``window``.

A group builds the suffix tree of its segments, cut at their ends: suffixes are
sorted by doubled ranks, internal nodes come from the common lengths of
neighbours. A node of depth ``window`` or more that an earlier document takes
part in is a repeat in the later ones; of each suffix the deepest such node
counts. Repeats that go on in the next segment are joined in each document.

Words are compared by 64-bit hashes.

Scale: a task deals with slices of a few MB. Within a slice, equal windows (by
64-bit fingerprints) leave as one, so a passage that every document shares costs
a group one entry a slice. Groups hold about ``group_size`` words. Texts move
once, to be joined with what is removed from them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from geoloom.llm.corpus import texts
from geoloom.llm.text import run_hashes, slices, utf8, whole, word_hashes, words

SYMBOLS = 64
PREFIX = 3  # words of the longest prefix
SLICE = (4 << 20) - 8  # bytes of text in which equal windows leave as one
LAST = np.iinfo(np.int64).max  # a null id comes after all others
_SENT = "kind int, grp int, slice string, a binary, b binary, c binary, d binary"


def _smallest(x: np.ndarray, n: int) -> np.ndarray:
    """Place of the smallest of the n values from each place on, the first of equal ones."""
    best, at, have = x, np.arange(len(x)), 1
    while have < n:
        step = min(have, n - have)
        left, right = best[:-step], best[step:]
        take = right < left
        best, at, have = np.where(take, right, left), np.where(take, at[step:], at[:-step]), have + step
    return at


def _cells(hashes: np.ndarray, size: int) -> np.ndarray:
    """The prefix of ``size`` words from each word on, as one number."""
    s = (hashes >> np.uint64(17)).astype(np.int64) & (SYMBOLS - 1)
    n = max(0, len(s) - size + 1)
    return sum((s[j : j + n] * SYMBOLS ** (PREFIX - 1 - j) for j in range(size)), np.zeros(n, np.int64))


class _Windows:
    """The whole windows of a batch: their places (as word numbers), paths, anchors and the anchors' prefixes."""

    def __init__(self, batch: pa.RecordBatch, window: int):
        self.data, at = utf8(batch.column(batch.schema.get_field_index("text")))
        self.starts, self.ends, self.firsts = words(self.data, at)
        hashes = word_hashes(self.data, self.starts, self.ends)
        size = min(PREFIX, window)
        self.paths = run_hashes(hashes, window)
        self.places = np.flatnonzero(whole(self.firsts, window)[: len(self.paths)])
        self.paths = self.paths[self.places]
        if len(self.places):
            self.anchors = _smallest(run_hashes(hashes, size), window - size + 1)[self.places]
            self.cells = _cells(hashes, size)[self.anchors]
        else:
            self.anchors = self.cells = np.zeros(0, np.int64)

    def segments(self, some: np.ndarray, apart: np.ndarray) -> np.ndarray:
        """Where segments start among the windows ``some``: at a new anchor, after a gap, or at a window set apart."""
        place, anchor = self.places[some], self.anchors[some]
        new = np.ones(len(some), bool)
        new[1:] = (np.diff(place) != 1) | (np.diff(anchor) != 0) | apart[1:] | apart[:-1]
        return np.flatnonzero(new)


def prefix_counts(docs: DataFrame, window: int) -> np.ndarray:
    """How many words of segments each three-word prefix gets, over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**PREFIX, np.int64)
        for batch in slices(batches):
            w = _Windows(batch, window)
            if len(w.places):
                heads = w.segments(np.arange(len(w.places)), np.zeros(len(w.places), bool))
                sizes = np.diff(np.r_[heads, len(w.places)]) + window - 1
                total += np.bincount(w.cells[heads], sizes, minlength=len(total)).astype(np.int64)
        for first, row in enumerate(total.reshape(SYMBOLS, -1)):
            if row.any():
                yield pa.RecordBatch.from_pydict({"first": pa.array([first], pa.int32()), "n": pa.array([row.tobytes()], pa.binary())})

    def add(key, table):
        total = sum(np.frombuffer(x.as_py(), np.int64) for x in table.column("n"))
        return pa.table({"first": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([total.tobytes()], pa.binary())})

    schema = "first int, n binary"
    rows = docs.select("text").mapInArrow(count, schema).groupBy("first").applyInArrow(add, schema).collect()  # SYMBOLS rows at most
    counts = np.zeros((SYMBOLS, SYMBOLS**2), np.int64)
    for row in rows:
        counts[row["first"]] = np.frombuffer(row["n"], np.int64)
    return counts.ravel()


def prefix_groups(counts: np.ndarray, group_size: int, least: int, window: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Group of each three-word prefix, in how many parts its windows are split, and the number of groups.

    Prefixes of one word stay whole where they fit, else they are split into
    those of two words, and these into those of three; neighbours are packed.
    """
    budget = max(1, min(group_size, -(-int(counts.sum()) // least)))
    one, two = counts.reshape(SYMBOLS, -1).sum(1), counts.reshape(SYMBOLS**2, -1).sum(1)
    leaves = []  # (first cell, cells, words)
    for a in range(SYMBOLS):
        if one[a] <= budget:
            leaves.append((a * SYMBOLS**2, SYMBOLS**2, one[a]))
            continue
        for b in range(a * SYMBOLS, (a + 1) * SYMBOLS):
            if two[b] <= budget:
                leaves.append((b * SYMBOLS, SYMBOLS, two[b]))
            else:
                leaves += [(c, 1, counts[c]) for c in range(b * SYMBOLS, (b + 1) * SYMBOLS)]
    group, parts = np.zeros(len(counts), np.int32), np.ones(len(counts), np.int32)
    now, filled = 0, 0
    for cell, n, size in leaves:
        if filled and filled + size > budget:
            now, filled = now + 1, 0
        group[cell : cell + n] = now
        filled += size
        if size > budget:  # windows leave one by one: a segment of s words has s - window + 1 of them
            parts[cell] = min(-(-int(size) * window // (2 * budget)), 1 << 20)
            now, filled = now + int(parts[cell]), 0
    return group, parts, now + 1


def _ints(x: np.ndarray) -> bytes:
    """Ascending numbers as differences of two bytes where they fit, else of four."""
    d = np.diff(x, prepend=0)
    return b"2" + d.astype(np.uint16).tobytes() if not len(d) or d.max() < 65536 else b"4" + d.astype(np.uint32).tobytes()


def _ints_back(x: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(x, np.uint16 if x[:1] == b"2" else np.uint32, offset=1).astype(np.int64))


def _pieces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, mark: int) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of ``data``, each followed by ``mark``, and where they start."""
    sizes = ends - starts + 1
    at = np.r_[0, np.cumsum(sizes)]
    kind = np.int32 if max(at[-1], len(data)) < 1 << 30 else np.int64
    place = np.repeat((starts - at[:-1]).astype(kind), sizes)
    place += np.arange(at[-1], dtype=kind)
    out = np.take(data, place, mode="clip")
    out[at[1:] - 1] = mark
    return out, at


def _sender(window: int, group: np.ndarray, parts: np.ndarray):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, serial, pack = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(level=1)
        for batch in slices(batches, size=SLICE):
            ids = batch.column(batch.schema.get_field_index("doc_id")).fill_null(LAST).to_numpy(zero_copy_only=False)
            batch = batch.take(pa.array(np.argsort(ids, kind="stable")))  # places ascend with ids
            ids = np.sort(ids)
            keys = batch.column(batch.schema.get_field_index("row_key")).to_numpy(zero_copy_only=False)
            w = _Windows(batch, window)
            if not len(w.places):
                continue
            name, serial = f"{task}-{serial}", serial + 1
            owner = np.searchsorted(w.firsts, w.places, "right") - 1
            own = np.cumsum(np.r_[0, np.diff(ids) != 0])[owner]  # rows of one id count as one document
            order = np.argsort(w.paths)
            runs = np.flatnonzero(np.r_[True, w.paths[order][1:] != w.paths[order][:-1]])
            least = np.repeat(np.minimum.reduceat(own[order], runs), np.diff(np.r_[runs, len(order)]))
            later = np.zeros(len(order), bool)
            later[order] = own[order] > least  # an earlier document of this slice has it
            has = np.flatnonzero(np.diff(w.firsts) >= window)
            out = [(0, 0, name, ids[has].tobytes(), keys[has].tobytes(), _ints(w.firsts[:-1][has]), _ints(w.places[later]))]
            go = np.flatnonzero(~later)
            apart = parts[w.cells[go]] > 1
            heads = w.segments(go, apart)
            tails = np.r_[heads[1:], len(go)] - 1
            some = go[heads]
            to = group[w.cells[some]] + (w.paths[some] % parts[w.cells[some]].astype(np.uint64)).astype(np.int32)
            order = np.argsort(to, kind="stable")
            some, to, last = some[order], to[order], w.places[go[tails[order]]] + window - 1
            spaced, at = _pieces(w.data, w.starts, w.ends, 0x20)
            begin, end = at[w.places[some]], at[last + 1] - 1
            cuts = np.flatnonzero(np.r_[True, to[1:] != to[:-1], True])
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                doc = ids[owner[some[i:j]]]
                heads = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
                wide = doc[-1] - doc[0] < 0 or doc[-1] - doc[0] >= 1 << 31  # differences of ids beyond four bytes
                c = b"8" + doc[heads].tobytes() if wide else _ints(doc[heads] - doc[0])
                out.append((1, int(to[i]), name, pack.compress(_pieces(spaced, begin[i:j], end[i:j], 0x0A)[0].tobytes()), _ints(w.places[some[i:j]]), c, doc[:1].tobytes() + _ints(heads)))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.string(), *[pa.binary()] * 4))], ["kind", "grp", "slice", "a", "b", "c", "d"])

    return send


def _docs_back(n: int, c: bytes, d: bytes) -> np.ndarray:
    ids = np.frombuffer(c, np.int64, offset=1) if c[:1] == b"8" else _ints_back(c) + np.frombuffer(d[:8], np.int64)[0]
    return np.repeat(ids, np.diff(np.r_[_ints_back(d[8:]), n]))


def _ranks(x: np.ndarray) -> np.ndarray:
    """1, 2, ... in the order of the values, equal for equal ones."""
    return np.unique(x, return_inverse=True)[1].astype(np.int64) + 1


class SuffixTree:
    """The part deeper than ``depth`` words of the suffix tree of some word sequences.

    ``symbols`` are the words' hashes, ``firsts`` the first word of each sequence
    (with the total last). Suffixes end with their sequence. ``leaves`` holds the
    suffixes that share ``depth`` words with another, in the tree's order, and
    ``common`` how many words each shares with the leaf before it (0 where these
    are fewer than ``depth``).
    """

    def __init__(self, symbols: np.ndarray, firsts: np.ndarray, depth: int):
        n = len(symbols)
        self.depth, self.end = depth, np.repeat(firsts[1:], np.diff(firsts))
        rank = {1: _ranks(symbols)}
        span = 1
        while span * 2 <= depth:  # rank[s]: the first s words, fewer at a sequence's end
            rank[span * 2] = _ranks(rank[span] * (n + 2) + self._from(rank[span], np.arange(n) + span, self.end))
            span *= 2
        leaves = np.flatnonzero(np.arange(n) + depth <= self.end)
        top = rank[span][leaves] if span == depth else _ranks(rank[span][leaves] * (n + 2) + rank[span][leaves + depth - span])
        shared = np.bincount(top, minlength=1)[top] > 1
        leaves, top = leaves[shared], top[shared]
        keys, at = [], depth
        longest = int((self.end[leaves] - leaves).max()) if len(leaves) else 0
        while at < longest:
            keys.append(self._from(rank[span], leaves + at, self.end[leaves]))
            at += span
        order = np.lexsort((leaves, *keys[::-1], top))
        self.leaves, top = leaves[order], top[order]
        self.common = np.zeros(len(leaves), np.int64)
        same = np.flatnonzero(top[1:] == top[:-1]) + 1
        size = depth
        while len(same):
            self.common[same] = size
            i, j = self.leaves[same] + size, self.leaves[same - 1] + size
            inside = (i < self.end[self.leaves[same]]) & (j < self.end[self.leaves[same - 1]])
            same, i, j = same[inside], i[inside], j[inside]
            same, size = same[symbols[i] == symbols[j]], size + 1

    @staticmethod
    def _from(rank: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Rank of the words from ``at`` on; 0 beyond the sequence."""
        return np.where(at < end, rank[np.minimum(at, len(rank) - 1)], 0)

    def nodes(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each depth, the internal nodes of that depth or, between two nodes, the point on the edge: first leaf and leaf after the last."""
        size, deep = self.depth, np.flatnonzero(self.common >= self.depth)
        while len(deep):
            yield size, deep[np.r_[True, np.diff(deep) > 1]] - 1, deep[np.r_[np.diff(deep) > 1, True]] + 1
            size += 1
            deep = deep[self.common[deep] >= size]

    def maximal_repeats(self, before: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """Length and places of each repeat that can't be extended: an internal node whose leaves differ in the word before (``before``, negative at a start)."""
        out = []
        for size, begin, end in self.nodes():
            for i, j in zip(begin.tolist(), end.tolist()):
                left = before[self.leaves[i:j]]
                if self.common[i + 1 : j].min() == size and ((left != left[0]).any() or (left < 0).any()):
                    out.append((size, self.leaves[i:j]))
        return out

    def earlier(self, owner: np.ndarray) -> np.ndarray:
        """For each leaf, the depth of its deepest node that a sequence of a smaller owner takes part in, or 0."""
        out, docs = np.zeros(len(self.leaves), np.int64), owner[self.leaves]
        for size, begin, end in self.nodes():
            least = np.minimum.reduceat(docs, np.c_[begin, end].ravel()[: 2 * len(begin) - (end[-1] == len(docs))])[::2]
            inside = np.repeat(begin - np.r_[0, np.cumsum(end - begin)[:-1]], end - begin) + np.arange((end - begin).sum())
            late = docs[inside] > np.repeat(least, end - begin)
            if not late.any():
                break
            out[inside[late]] = size
        return out


def _subtree(window: int):
    def build(table: pa.Table) -> pa.Table:
        """Build a group's subtree; of each deep node that several documents share, reply to all but the first document."""
        unpack, lines, places, docs, of = zstandard.ZstdDecompressor(), [], [], [], []
        for i, (a, b, c, d) in enumerate(zip(*(table.column(x).to_pylist() for x in "abcd"))):
            lines.append(unpack.decompress(a))
            places.append(_ints_back(b))
            docs.append(_docs_back(len(places[-1]), c, d))
            of.append(np.full(len(places[-1]), i, np.int32))
        data = np.frombuffer(b"".join(lines), np.uint8)
        del lines
        places, docs, of = map(np.concatenate, (places, docs, of))
        starts, ends, firsts = words(data, np.r_[0, np.flatnonzero(data == 0x0A) + 1])
        tree = SuffixTree(word_hashes(data, starts, ends), firsts, window)
        row = np.repeat(np.arange(len(docs)), np.diff(firsts))
        size = tree.earlier(docs[row])
        at = tree.leaves[size > 0]
        order = np.argsort(at)
        at, size = at[order], size[size > 0][order]
        # a repeat that starts within the one before it in its segment and ends with it adds nothing
        adds = np.ones(len(at), bool)
        adds[1:] = (row[at[1:]] != row[at[:-1]]) | (at[1:] != at[:-1] + 1) | (size[1:] != size[:-1] - 1)
        at, size = at[adds], size[adds]
        of, places = of[row[at]], places[row[at]] + at - firsts[row[at]]
        order = np.lexsort((places, of))
        of, places, size = of[order], places[order], size[order]
        names, cuts = table.column("slice").to_pylist(), np.searchsorted(of, np.arange(table.num_rows + 1))
        back = [(names[i], _ints(places[x:y]), size[x:y].astype(np.uint32).tobytes()) for i, (x, y) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())) if x < y]
        n, null = len(back), [None] * len(back)
        return pa.table({"kind": pa.array([2] * n, pa.int32()), "grp": pa.array([0] * n, pa.int32()), "slice": pa.array([x[0] for x in back], pa.string()), "a": pa.array(null, pa.binary()), "b": pa.array(null, pa.binary()), "c": pa.array([x[2] for x in back], pa.binary()), "d": pa.array([x[1] for x in back], pa.binary())})

    return build


def _returned(window: int):
    def gather(key, table):
        """The repeated words of one slice's documents, as runs of word positions."""
        rows = table.to_pylist()
        own = next(x for x in rows if x["kind"] == 0)
        ids, keys, firsts = np.frombuffer(own["a"], np.int64), np.frombuffer(own["b"], np.int64), _ints_back(own["c"])
        begin = np.concatenate([_ints_back(x["d"]) for x in rows])
        end = begin + np.concatenate([np.frombuffer(x["c"], np.uint32).astype(np.int64) if x["kind"] == 2 else np.full(len(_ints_back(x["d"])), window) for x in rows])
        order = np.argsort(begin, kind="stable")
        begin, end = begin[order], np.maximum.accumulate(end[order]) if len(order) else end
        at = np.searchsorted(firsts, begin, "right") - 1
        new = np.flatnonzero(np.r_[True, (begin[1:] > end[:-1]) | (at[1:] != at[:-1])][: len(begin)])
        at, begin, end = at[new], begin[new], end[np.r_[new[1:], len(end)] - 1] if len(new) else end
        out = {"doc_id": [], "row_key": [], "runs": []}
        cuts = np.searchsorted(at, np.arange(len(ids) + 1))
        for i in np.flatnonzero(np.diff(cuts)).tolist():
            some = slice(cuts[i], cuts[i + 1])
            out["doc_id"].append(None if ids[i] == LAST else int(ids[i]))
            out["row_key"].append(int(keys[i]))
            out["runs"].append((np.c_[begin[some], end[some]] - firsts[i]).astype(np.int32).tobytes())
        return pa.table({"doc_id": pa.array(out["doc_id"], pa.int64()), "row_key": pa.array(out["row_key"], pa.int64()), "runs": pa.array(out["runs"], pa.binary())})

    return gather


def repeated_runs(docs: DataFrame, window: int = 13, group_size: int = 1_000_000, least_groups: int = 96) -> DataFrame:
    """Word runs of each document that earlier documents hold too.

    ``docs`` has ``doc_id, text``. Returns ``doc_id, row_key, runs``: for each
    document with a run of ``window`` or more words that also stands in a
    document of smaller id, its maximal such runs as pairs of int32 (first word,
    word after the last). ``row_key`` is xxhash64 of the text.

    Null text has no words. A null id comes after all ids. Rows of equal id
    count as one document, so they never repeat each other. The slices of a
    partition must come out the same when a lost task is run again, as those of
    a file scan or of a written table do.
    """
    docs = texts(docs).withColumn("row_key", F.xxhash64("text"))
    group, parts, _ = prefix_groups(prefix_counts(docs, window), group_size, least_groups, window)
    shared = docs.sparkSession.sparkContext.broadcast((group, parts))  # 2 MB, whatever the input

    def send(batches):
        return _sender(window, *shared.value)(batches)

    sent = docs.mapInArrow(send, _SENT)

    build = _subtree(window)

    def reply(key, table):
        return build(table) if table.column("kind")[0].as_py() else table

    # slices keep their own rows under negative groups, so that one shuffle carries both
    sent = sent.withColumn("to", F.when(F.col("kind") == 0, F.concat(F.lit("s"), "slice")).otherwise(F.col("grp").cast("string")))
    replies = sent.groupBy("to").applyInArrow(lambda key, t: reply(key, t.drop_columns(["to"])), _SENT)
    return replies.groupBy("slice").applyInArrow(_returned(window), "doc_id long, row_key long, runs binary")


def without_repeats(docs: DataFrame, window: int = 13, **how) -> DataFrame:
    """The texts without what :func:`repeated_runs` finds.

    Returns ``doc_id, n_words, n_removed, kept``: ``kept`` has the words that
    stay, joined by one space. An empty table gives none; an empty or null text
    gives 0, 0 and an empty string.
    """
    docs = texts(docs).withColumn("row_key", F.xxhash64("text"))
    # rows of equal id and text have equal runs
    runs = repeated_runs(docs, window, **how).groupBy(F.col("doc_id").alias("id"), F.col("row_key").alias("key")).agg(F.first("runs").alias("runs"))
    both = docs.join(runs.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("row_key") == F.col("key")), "left")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for text, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                own = text.encode().split()
                n = len(own)
                for begin, end in np.frombuffer(runs or b"", np.int32).reshape(-1, 2)[::-1].tolist():
                    del own[begin:end]
                out.append((n, n - len(own), b" ".join(own).decode()))
            n, gone, kept = zip(*out)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return both.select("doc_id", "text", "runs").mapInArrow(keep, "doc_id long, n_words long, n_removed long, kept string")


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    from geoloom.llm.corpus import table

    out = without_repeats(table(spark, sf_dir, "documents"), window=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), p AS (
  SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i, ws FROM w WHERE len(ws) >= 13
), s AS (
  SELECT doc_id, i, array_to_string(ws[i : i + 12], ' ') AS path FROM p
), m AS (
  SELECT doc_id, i, min(doc_id) OVER (PARTITION BY path) AS least FROM s
), gone AS (
  SELECT DISTINCT doc_id, i + unnest(range(0, 13)) AS i FROM m WHERE least < doc_id
), every AS (
  SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w
), kept AS (
  SELECT e.doc_id, count(g.i) AS n_removed, coalesce(string_agg(CASE WHEN g.i IS NULL THEN e.word END, ' ' ORDER BY e.i), '') AS kept
  FROM every e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY e.doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
