"""Exact top-k by inner product: a KD-tree in every shard.

Shards are cells of space: medians of the widest dimension, fitted on a bounded
sample, deal every vector to a cell, and a cell of more than SHARD vectors is split
further by a hash of the id. A shard's vectors are split at medians in the same way
until leaves are small; every node keeps its tight bounding box. A shard's tree is
built once and kept as a table. For a query, a box bounds all inner products in it
from above. Nodes are taken best first, and a node whose bound is below the query's
k-th score so far is left with all below it.

The k-th score is propagated: a query visits cells in the order of their bounds, in
turns, first one, then FOLLOW times as many in each later turn, and carries the k-th
score of all cells so far into the next turn. It isn't sent to a cell whose box can't
reach that score.

Scores are integers of 64 bits. Where sizes show that a product's partial sums stay
below 2**52, they are worked out in double precision, else in integers; bounds are
widened by what double precision may lose.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from geoloom.llm.corpus import table
from geoloom.sources.shared import materialise

LEAF = 128
SHARD = 8_192  # vectors of one tree
BLOCK = 1_024  # queries that meet a shard at once
FOLLOW = 4  # how many times as many cells each turn visits
SAMPLE = 20_000  # vectors that the cells are fitted on, at most
NUMBERS = 4_000_000  # numbers in that sample and in the boxes of all cells, at most (256 vectors in any case)


def upper_bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Upper bounds of q · x over every box, for each query, no lower than the true ones."""
    low, high = low.T.astype(float), high.T.astype(float)
    up, down = np.maximum(q, 0).astype(float), np.minimum(q, 0).astype(float)
    lost = (np.abs(q).astype(float) @ np.maximum(np.abs(low), np.abs(high))) * 1e-12
    return up @ high + down @ low + lost + 0.5


@dataclass
class Cells:
    """Median splits of all of space: a full binary tree of dimensions and cuts, level by level."""

    dims: np.ndarray
    cuts: np.ndarray

    @staticmethod
    def fit(x: np.ndarray, wanted: int) -> Cells:
        """About ``wanted`` cells of equal shares of the sample ``x``; one where it has under two vectors a cell or no spread."""
        depth = max(0, min(wanted, len(x) // 2) - 1).bit_length() if x.shape[1] else 0
        dims, cuts = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.iinfo(np.int64).max)
        held = [np.arange(len(x))]
        for node in range(2**depth - 1):
            own = x[held[node]]
            left = right = np.zeros(0, np.int64)
            if len(own):
                dims[node] = wide = int(np.argmax(own.max(0).astype(float) - own.min(0)))
                cuts[node] = np.partition(own[:, wide], (len(own) - 1) // 2)[(len(own) - 1) // 2]
                above = own[:, wide] > cuts[node]
                left, right = held[node][~above], held[node][above]
            held += [left, right]
        return Cells(dims, cuts)

    def cell(self, x: np.ndarray) -> np.ndarray:
        node, inner = np.zeros(len(x), np.int64), len(self.dims)
        for _ in range(inner.bit_length()):
            node = 2 * node + 1 + (x[np.arange(len(x)), self.dims[node]] > self.cuts[node])
        return node - inner


@dataclass
class Boxes:
    """Cells of one vector length with their tight boxes and how many shards each has."""

    cell: np.ndarray
    low: np.ndarray
    high: np.ndarray
    shards: np.ndarray


def rows_of(v: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    """Vectors of ``d`` numbers as a matrix."""
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    return np.asarray(v.flatten().to_numpy(zero_copy_only=False), np.int64).reshape(len(v), d)


@dataclass
class KDTree:
    """Median splits with tight bounding boxes over integer vectors, a node's vectors side by side."""

    ids: np.ndarray
    x: np.ndarray  # in the order of the leaves
    low: np.ndarray
    high: np.ndarray
    span: np.ndarray  # first vector and the one after the last, by node
    children: np.ndarray  # of a node; 0, 0 for a leaf

    @staticmethod
    def build(ids: np.ndarray, x: np.ndarray) -> KDTree:
        places = np.argsort(ids, kind="stable")
        low, high, children, span = [], [], [], []

        def split(i: int, j: int) -> int:
            node = len(span)
            own = x[places[i:j]]
            low.append(own.min(0))
            high.append(own.max(0))
            span.append((i, j))
            children.append((0, 0))
            wide = int(np.argmax(np.r_[high[node].astype(float) - low[node], -1.0]))  # the last place stands for vectors without components
            if j - i > LEAF and wide < x.shape[1] and high[node][wide] > low[node][wide]:
                half = (j - i) // 2
                places[i:j] = places[i:j][np.argpartition(own[:, wide], half, kind="introselect")]
                children[node] = (split(i, i + half), split(i + half, j))
            return node

        split(0, len(ids))
        return KDTree(ids[places], x[places], np.array(low), np.array(high), np.array(span), np.array(children))

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        small = np.int32 if not self.x.size or np.abs(self.x.astype(float)).max() < 2**31 - 1 else np.int64
        np.savez(out, ids=self.ids, x=self.x.astype(small), low=self.low.astype(small), high=self.high.astype(small), span=self.span, children=self.children)
        return out.getvalue()

    @staticmethod
    def from_bytes(data: bytes) -> KDTree:
        with np.load(io.BytesIO(data)) as z:
            return KDTree(*(z[c] for c in ("ids", "x", "low", "high", "span", "children")))

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Upper bounds over every node's box, for each query."""
        return upper_bounds(q, self.low, self.high)

    def search(self, own: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """For each query the k best (score, id) that reach its floor; ties go to smaller ids."""
        bounds = self.bounds(q)
        most = np.abs(np.r_[self.low[0], self.high[0]].astype(float)).max(initial=0.0)
        for n in range(len(q)):
            best: list[tuple[int, int]] = []  # (score, -id), the worst first
            heap = [(-bounds[n, 0], 0)]
            kind = np.float64 if np.abs(q[n].astype(float)).sum() * most < 2.0**52 else np.int64
            vector = q[n].astype(kind)
            while heap:
                bound, node = heapq.heappop(heap)
                least = max(int(floor[n]), best[0][0]) if len(best) == k else int(floor[n])
                if -bound < least:
                    break
                if self.children[node][1]:
                    for child in self.children[node]:
                        if bounds[n, child] >= least:
                            heapq.heappush(heap, (-bounds[n, child], int(child)))
                    continue
                i, j = self.span[node]
                scores = (self.x[i:j].astype(kind) @ vector).astype(np.int64)
                ids = self.ids[i:j]
                fit = np.flatnonzero((scores >= least) & (ids != own[n]))
                if len(fit) > k:  # all that reach the k-th best of this leaf, ties included
                    fit = fit[scores[fit] >= np.partition(scores[fit], -k)[-k]]
                for s, c in zip(scores[fit].tolist(), ids[fit].tolist()):
                    if len(best) < k:
                        heapq.heappush(best, (s, -c))
                    elif (s, -c) > best[0]:
                        heapq.heapreplace(best, (s, -c))
            yield n, [(s, -c) for s, c in best]


def whole_numbers(embedding: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of every component; null for a vector that is null or holds a null or non-finite number."""
    x = F.transform(embedding, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(embedding.isNotNull() & ~F.coalesce(bad, F.lit(True)), F.transform(x, lambda v: F.floor(v * scale)))


def top_k(vectors: DataFrame, queries: Column, k: int = 10) -> DataFrame:
    """The k best candidates of every query, exactly.

    ``vectors`` has ``vec_id, v`` (whole numbers); rows where either is null take no
    part. ``queries`` is a condition on ``vec_id``. Rows with the query's own id are not
    its candidates; repeated candidate rows each count. Vectors of different
    lengths never meet. Returns ``query_id, rank, vec_id, score``.

    Cells are fitted on SAMPLE vectors at most; their boxes, of NUMBERS numbers at most and
    one for every length, go through the driver to all tasks. Queries go to cells in blocks,
    and each meeting of a block with a shard gives k rows a query at most. Scores have to fit into
    64 bits. Vectors without components score 0 with each other. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    vectors = vectors.where("vec_id is not null and v is not null").select("vec_id", "v", F.size("v").alias("d"))
    trees, boxes = plant(vectors)
    asked = vectors.where(queries).count()
    shards, blocks, cores = max(1, sum(int(b.shards.sum()) for b in boxes.values())), max(1, -(-asked // BLOCK)), spark.sparkContext.defaultParallelism
    copies = max(1, min(-(-cores // shards), asked // 16 + 1))  # of a few shards, so that all cores have some
    blocks = max(blocks, copies)
    trees = trees.select("d", "cell", "shard", "tree").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    lowest = np.iinfo(np.int64).min

    def block_up(key, t):
        """A block of queries and the k-th scores that they have, the lowest number where they have none."""
        cell, d, block = (x.as_py() for x in key)
        ids, floor = (t.column(c).fill_null(lowest).to_numpy().astype(np.int64).tobytes() for c in ("vec_id", "least"))
        values = [cell, d, block % copies, t.column("shards")[0].as_py(), ids, rows_of(t.column("v"), d).tobytes(), floor]
        return pa.table({f.name: pa.array([v], f.type) for f, v in zip(sides_schema, values)})

    sides_schema = pa.schema([("cell", pa.int64()), ("d", pa.int32()), ("copy", pa.int32()), ("shards", pa.int64()), ("q_ids", pa.binary()), ("q", pa.binary()), ("floor", pa.binary())])
    # repeated query rows ask once
    asking = materialise(vectors.where(queries).dropDuplicates(["vec_id", "v"]).withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(blocks))), "queries")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, tree = None, None
        for batch in batches:
            for data, q_ids, q, floor in zip(*(batch.column(c).to_pylist() for c in ("tree", "q_ids", "q", "floor"))):
                if data is not last and data != last:
                    last, tree = data, KDTree.from_bytes(data)
                own = np.frombuffer(q_ids, np.int64)
                found = tree.search(own, np.frombuffer(q, np.int64).reshape(len(own), -1), k, np.frombuffer(floor, np.int64))
                rows = [(int(own[i]), c, s) for i, best in found for s, c in best]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 3, ["query_id", "vec_id", "score"])

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best, first, many = None, 0, 1
    while first < max((len(b.cell) for b in boxes.values()), default=0):
        known = asking.withColumn("least", F.lit(None).cast("long"))
        if best is not None:
            kth = best.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("least"))
            known = asking.join(kth, "vec_id", "left")
        turn = visits(known, boxes, first, first + many)
        if first and not turn.limit(1).count():
            break  # later cells have lower bounds still
        sides = turn.groupBy("cell", "d", "block").applyInArrow(block_up, "cell long, d int, copy int, shards long, q_ids binary, q binary, floor binary")
        sides = sides.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))
        both = trees.join(sides.hint("merge"), ["d", "cell", "shard", "copy"]).select("tree", "q_ids", "q", "floor")
        found = both.mapInArrow(answer, "query_id long, vec_id long, score long")
        found = found if best is None else found.union(best.select("query_id", "vec_id", "score"))
        best = materialise(found.withColumn("rank", rank).where(F.col("rank") <= k), "best")
        first, many = first + many, many * FOLLOW
    return (best if best is not None else asking.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).limit(0)).select("query_id", "rank", "vec_id", "score")


def plant(vectors: DataFrame) -> tuple[DataFrame, dict[int, Boxes]]:
    """The shards' trees (``d, cell, shard, tree``, written) of ``vec_id, v, d``, and the boxes of the cells by length."""
    n, longest = vectors.agg(F.count("*"), F.coalesce(F.max("d"), F.lit(0))).first()
    cells: dict[int, Cells] = {}
    if n > SHARD:
        most = max(256, min(SAMPLE, NUMBERS // max(1, longest)))
        sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).select("d", "v").toArrow()
        sizes = sample.column("d").to_numpy()
        for d in np.unique(sizes).tolist():
            x = rows_of(sample.filter(pa.array(sizes == d)).column("v"), d)
            cells[d] = Cells.fit(x, min(-(-n * len(x) // (len(sizes) * SHARD)), len(x) // 16))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, out = batch.column("d").to_numpy(), np.zeros(batch.num_rows, np.int64)
            for d in np.unique(sizes).tolist():
                if d in cells:
                    own = np.flatnonzero(sizes == d)
                    out[own] = cells[d].cell(rows_of(batch.column("v").take(pa.array(own)), d))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], ["vec_id", "v", "d", "cell"])

    dealt = vectors.mapInArrow(deal, "vec_id long, v array<long>, d int, cell long") if cells else vectors.withColumn("cell", F.lit(0).cast("long"))
    # one row a cell and length; the optimizer picks the join by its size
    shards = dealt.groupBy("d", "cell").agg(F.ceil(F.count("*") / F.lit(SHARD)).alias("shards"))
    dealt = dealt.join(shards, ["d", "cell"]).withColumn("shard", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("shards")))

    def grow(key, t):
        d, cell, shard = (x.as_py() for x in key)
        tree = KDTree.build(t.column("vec_id").to_numpy().astype(np.int64), rows_of(t.column("v"), d))
        values = [d, cell, shard, t.column("shards")[0].as_py(), tree.low[0].tolist(), tree.high[0].tolist(), tree.to_bytes()]
        return pa.table({f.name: pa.array([v], f.type) for f, v in zip(schema, values)})

    schema = pa.schema([("d", pa.int32()), ("cell", pa.int64()), ("shard", pa.int64()), ("shards", pa.int64()), ("low", pa.list_(pa.int64())), ("high", pa.list_(pa.int64())), ("tree", pa.binary())])
    trees = materialise(dealt.groupBy("d", "cell", "shard").applyInArrow(grow, "d int, cell long, shard long, shards long, low array<long>, high array<long>, tree binary"), "shards")
    sides = trees.select("d", "cell", "shards", F.posexplode_outer(F.arrays_zip("low", "high")).alias("at", "side"))
    sides = sides.groupBy("d", "cell", "at").agg(F.max("shards").alias("shards"), F.min("side.low").alias("low"), F.max("side.high").alias("high"))
    found = sides.groupBy("d", "cell").agg(F.max("shards").alias("shards"), F.sort_array(F.collect_list(F.struct("at", "low", "high"))).alias("sides")).orderBy("d", "cell").collect()
    boxes = {}
    for d in {r.d for r in found}:
        own = [r for r in found if r.d == d]
        low, high = (np.array([[s[c] for s in r.sides[:d]] for r in own], np.int64).reshape(len(own), d) for c in ("low", "high"))
        boxes[d] = Boxes(np.array([r.cell for r in own]), low, high, np.array([r.shards for r in own]))
    return trees, boxes


def visits(known: DataFrame, boxes: dict[int, Boxes], first: int, last: int) -> DataFrame:
    """``vec_id, v, d, block, least, cell, shards``: for every query the cells from place ``first`` to before ``last`` in the order of their
    bounds, without those whose bound is below the query's k-th score ``least``."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("d").to_numpy()
            least = batch.column("least").fill_null(np.iinfo(np.int64).min).to_numpy().astype(float)
            for d in np.unique(sizes).tolist():
                box, own = boxes[d], np.flatnonzero(sizes == d)
                bounds = upper_bounds(rows_of(batch.column("v").take(pa.array(own)), d), box.low, box.high)
                order = np.argsort(-bounds, axis=1, kind="stable")[:, first:last]
                row, at = np.nonzero(np.take_along_axis(bounds, order, 1) >= least[own][:, None])
                cell = order[row, at]
                some = batch.select(["vec_id", "v", "d", "block", "least"]).take(pa.array(own[row]))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(box.cell[cell]), pa.array(box.shards[cell])], ["vec_id", "v", "d", "block", "least", "cell", "shards"])

    return known.select("vec_id", "v", "d", "block", "least").mapInArrow(places, "vec_id long, v array<long>, d int, block long, least long, cell long, shards long")


def op6_topk(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), whole_numbers(F.col("embedding")).alias("v"))
    return top_k(vectors, F.col("vec_id") % 100 == 0, 10)


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
