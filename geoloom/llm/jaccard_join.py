"""Documents whose word-shingle sets have a Jaccard similarity of at least a threshold, exactly.

An inverted index holds the prefix of every distinct set: its rarest shingles, as
many as any similar set must share one of. Each entry carries the set's size, the
shingle's position in the set's order and a parity signature of the set.

Two relations between sets save most comparisons:

* Index lists are sorted by position and skipped in blocks: two sets whose first
  common shingle is this one differ by at least the sum of their positions, so from
  the first position that is too late the rest of the list is skipped. Size and
  signature bound the difference in the same way.
* Answers follow from those of a similar set. The set that stands first in a list
  (the one with the fewest rarer shingles) is its pivot. All others are verified
  with the pivot first; sets that are found similar take over its answers, and
  only pairs that are still in different components are compared afterwards
  (where only classes are asked for; the number of links needs every pair). An entry
  whose bounds allow no partner but the pivot leaves the list before that.

Candidates that wide signatures don't rule out (four bits or more for every shingle that
similar sets may differ in, so they grow with the sets) are verified on whole sets. A
list that has given all its pairs isn't sent again in later rounds. Equal sets are one set throughout, so
copies cost nothing; shingles that many sets hold come last in the order, and
their lists, where they are needed, are dealt to tasks as pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from geoloom.llm.corpus import table, texts, unused
from geoloom.llm.text import mix, shingle_sets, slices, utf8
from geoloom.operators.components import connected_components, with_links
from geoloom.sources.shared import materialise

HOT_MOST = 20_000  # shingles that are known to be frequent; the order of the rest is by hash
HOT_LOCAL = 3  # sets of one slice that must share a shingle for it to be counted
HOT_BLOCK = 4_000  # entries of one block of a frequent shingle's list
PAIRWISE = 4  # lists up to this size are compared in full at once
SIGNATURE = 256  # bits
HUB_PAIRS = 100  # pairs of one set that one copy of it serves
BLOOM_WORDS = 1 << 16
FIRST_ASKED = 4  # partners that a set asks for in the first round over open lists; eight times as many in each later one


def _sets(batch: pa.RecordBatch, k: int):
    """Shingles and offsets of every row, and its set id (0 for an empty set)."""
    tokens, at = shingle_sets(*utf8(batch.column(batch.schema.get_field_index("text"))), k)
    n = np.diff(at)
    ids = np.zeros(len(n), np.uint64)
    has = np.flatnonzero(n)
    if len(has):
        ids[has] = mix(np.add.reduceat(mix(tokens), at[:-1][has]) + n[has].astype(np.uint64)) | np.uint64(1)
    return tokens, at, n, ids


def _distinct(ids: np.ndarray) -> np.ndarray:
    return np.sort(np.unique(ids, return_index=True)[1][np.unique(ids) != 0]) if len(ids) else np.zeros(0, int)


def _rows_of(tokens: np.ndarray, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return np.concatenate([tokens[at[r] : at[r + 1]] for r in rows]) if len(rows) else tokens[:0]


def members(docs: DataFrame, k: int) -> DataFrame:
    """One row per document, with xxhash64 of its text as ``row_key``, and per slice one with the shingles that several of its sets share."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            tokens, at, n, ids = _sets(batch, k)
            values, counts = np.unique(_rows_of(tokens, at, _distinct(ids)), return_counts=True)
            some = counts >= HOT_LOCAL
            doc, key = (pa.concat_arrays([batch.column(i).cast(pa.int64()), pa.array([None], pa.int64())]) for i in (0, 2))
            yield pa.RecordBatch.from_arrays(
                [
                    doc,
                    key,
                    pa.array(np.r_[n, 0], pa.int64()),
                    pa.array(np.r_[ids, np.uint64(0)].view(np.int64)),
                    pa.array([None] * len(n) + [values[some].tobytes()], pa.binary()),
                    pa.array([None] * len(n) + [counts[some].astype(np.int64).tobytes()], pa.binary()),
                ],
                ["doc_id", "row_key", "n_shingles", "set_id", "tokens", "counts"],
            )

    return texts(docs).withColumn("row_key", F.xxhash64("text")).mapInArrow(scan, "doc_id long, row_key long, n_shingles long, set_id long, tokens binary, counts binary")


def frequent_shingles(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles, sorted, and in how many slice-wise distinct sets they were seen; HOT_MOST at most."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(t, np.int64)), pa.array(np.frombuffer(c, np.int64))], ["token", "n"])

    top = (
        rows.where("tokens is not null").select("tokens", "counts").mapInArrow(unpack, "token long, n long")
        .groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(HOT_MOST).toPandas()
    )
    tokens, n = top["token"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    order = np.argsort(tokens)
    return tokens[order], n[order]


def _signatures(tokens: np.ndarray, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Parity of each bit over a set's shingles: differing bits bound the symmetric difference from below."""
    n = (at[rows + 1] - at[rows]).astype(int)
    bit = (_rows_of(tokens, at, rows) >> np.uint64(23)).astype(np.int64) % SIGNATURE
    counts = np.bincount(np.repeat(np.arange(len(rows)), n) * SIGNATURE + bit, minlength=len(rows) * SIGNATURE)
    return np.packbits((counts & 1).astype(np.uint8).reshape(len(rows), SIGNATURE), axis=1).view(np.uint64)


ENTRY = np.dtype([("token", "u8"), ("set", "i8"), ("n", "i4"), ("pos", "i4"), ("sig", "u8", (SIGNATURE // 64,))])


def _entries(batch: pa.RecordBatch, k: int, percent: int, hot: np.ndarray, counts: np.ndarray) -> np.ndarray:
    tokens, at, n, ids = _sets(batch, k)
    rows = _distinct(ids)
    rows = rows[(100 * n[rows] // percent > n[rows]) | (-(-percent * n[rows] // 100) < n[rows])]  # the others are similar to equal sets only
    if not len(rows):
        return np.zeros(0, ENTRY)
    signature = _signatures(tokens, at, rows)
    length = n[rows] - (-(-percent * n[rows] // 100)) + 1
    rank = np.empty(len(hot), np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(hot))
    # the order within a set: by hash, the shingles that are known to be frequent last, by their frequency
    of = np.repeat(np.arange(len(rows)), n[rows])
    own = _rows_of(tokens, at, rows)
    late = np.full(len(own), -1)
    if len(hot):
        where = np.minimum(np.searchsorted(hot, own), len(hot) - 1)
        late = np.where(hot[where] == own, rank[where], -1)
    order = np.lexsort((late, of)) if (late >= 0).any() else np.arange(len(own))
    place = np.arange(len(own)) - np.repeat(np.cumsum(n[rows]) - n[rows], n[rows])
    take = place < length[of]
    out = np.zeros(int(take.sum()), ENTRY)
    of = of[take]
    out["token"], out["set"], out["n"], out["pos"], out["sig"] = own[order][take], ids[rows].view(np.int64)[of], n[rows][of], place[take], signature[of]
    return out


def _blocked(entries: np.ndarray, hot: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Entries of long lists once for each pair of blocks that their own block is in, under a token of that pair."""
    long = hot[counts > HOT_BLOCK]
    if not len(long) or not len(entries):
        return entries
    blocks = -(-counts[counts > HOT_BLOCK] // HOT_BLOCK)
    where = np.minimum(np.searchsorted(long, entries["token"]), len(long) - 1)
    known = long[where] == entries["token"]
    own = entries[known]
    b = blocks[where[known]]
    mine = (mix(own["set"].astype(np.int64).view(np.uint64)) % b.astype(np.uint64)).astype(np.int64)
    of = np.repeat(np.arange(len(own)), b)
    other = np.arange(len(of)) - np.repeat(np.cumsum(b) - b, b)
    cell = (np.minimum(mine[of], other) * b[of] + np.maximum(mine[of], other)).astype(np.uint64)
    copies = own[of]
    copies["token"] = mix(copies["token"] + cell * np.uint64(0x9E3779B97F4A7C15))
    return np.concatenate([entries[~known], copies])


def _needed(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """The largest symmetric difference at which sets of these sizes are similar; negative if their sizes rule it out."""
    room = n + m - 2 * (-(-percent * (n + m) // (100 + percent)))
    return np.where(100 * np.minimum(n, m) >= percent * np.maximum(n, m), room, -1)


def _most_room(n: np.ndarray, percent: int) -> np.ndarray:
    """The largest symmetric difference to any set that is similar to one of this size."""
    return n.astype(np.int64) * (100 - percent) // percent


def _passes(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    room = _needed(a["n"].astype(np.int64), b["n"].astype(np.int64), percent)
    ok = (a["pos"] + b["pos"] <= room) & (a["set"] != b["set"])
    some = np.flatnonzero(ok)
    ok[some] = np.bitwise_count(a["sig"][some] ^ b["sig"][some]).sum(1) <= room[some]
    return ok


def _sorted_lists(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    e = np.concatenate([np.frombuffer(x.as_py(), ENTRY) for x in table.column("entries")])
    e = e[np.lexsort((e["set"], e["n"], e["pos"], e["token"]))]
    new = np.r_[True, (e["token"][1:] != e["token"][:-1]) | (e["set"][1:] != e["set"][:-1])]
    e = e[new]
    return e, np.flatnonzero(np.r_[True, e["token"][1:] != e["token"][:-1], True])


def _pair_table(a: np.ndarray, b: np.ndarray, more: list[bytes]) -> pa.Table:
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    if len(lo):
        both = np.unique(np.c_[lo, hi], axis=0)
        lo, hi = both[:, 0], both[:, 1]
    return pa.table({
        "a": pa.array(np.r_[lo, np.zeros(len(more), np.int64)]), "b": pa.array(np.r_[hi, np.zeros(len(more), np.int64)]),
        "entries": pa.array([None] * len(lo) + more, pa.binary()),
    })


def _has_partner(own: np.ndarray, percent: int) -> np.ndarray:
    """Which entries of a list, in the order of positions, have one after the first that position, size and signature allow.

    The bounds are those of :func:`_passes`, so what is left out is similar to nothing here but perhaps the first.
    """
    pos = own["pos"].astype(np.int64)
    stops = np.searchsorted(pos, _most_room(own["n"], percent) - pos, "right")
    out, first = np.zeros(len(own), bool), 1
    while first < len(own) - 1:
        last = min(len(own) - 1, first + max(1, 1_000_000 // len(own)))  # rows of one block of comparisons
        x, y = np.arange(first, last), np.arange(first + 1, max(int(stops[first:last].max()), first + 1))
        row, col = np.nonzero((y > x[:, None]) & (y < stops[x][:, None]))
        x, y, first = x[row], y[col], last
        ok = _passes(own[x], own[y], percent)
        out[x[ok]] = out[y[ok]] = True
    return out


def _first_pairs(percent: int):
    def pairs(key, table):
        """Pairs of short lists and pivot pairs of long ones; what long lists may still hold goes on."""
        e, cuts = _sorted_lists(table)
        sizes = np.diff(cuts)
        a, b, more = [e["set"][:0]], [e["set"][:0]], []
        short = np.flatnonzero((sizes > 1) & (sizes <= PAIRWISE))
        for d in range(1, PAIRWISE):
            for skip in range(PAIRWISE - d):
                at = cuts[short[sizes[short] > skip + d]] + skip
                ok = _passes(e[at], e[at + d], percent)
                a.append(e["set"][at[ok]])
                b.append(e["set"][at[ok] + d])
        for i in np.flatnonzero(sizes > PAIRWISE):
            own = e[cuts[i] : cuts[i + 1]]
            # a set that comes too late for the earliest position has no partner here: skip the rest
            own = own[own["pos"].astype(np.int64) + own["pos"][0] <= _most_room(own["n"], percent)]
            if len(own) < 2:
                continue
            ok = np.flatnonzero(_passes(np.broadcast_to(own[0], len(own) - 1), own[1:], percent)) + 1
            a.append(np.full(len(ok), own["set"][0]))
            b.append(own["set"][ok])
            own = own[_has_partner(own, percent)]
            if len(own) > 1:
                more.append(own.tobytes())
        return _pair_table(np.concatenate(a), np.concatenate(b), more)

    return pairs


def _wide_passes(wide: list[bytes], x: np.ndarray, y: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Which pairs of sets differ in no more bits than they have room for; the larger signature is folded to the smaller one's size."""
    ok = np.zeros(len(x), bool)
    used, at = np.unique(np.r_[x, y], return_inverse=True)
    x, y = at[: len(x)], at[len(x) :]
    level = np.log2([len(wide[i]) for i in used]).astype(int)
    both = np.minimum(level[x], level[y])
    rows, own = None, np.zeros(0, int)
    for one in range(int(level.max()), int(level.min()) - 1, -1):
        if rows is not None:
            rows = rows[:, : 1 << one] ^ rows[:, 1 << one :]
        new = np.flatnonzero(level == one)
        fresh = np.frombuffer(b"".join(wide[used[i]] for i in new), np.uint8).reshape(len(new), 1 << one)
        rows = fresh if rows is None else np.concatenate([rows, fresh])
        own = np.r_[own, new]
        place = np.empty(len(used), int)
        place[own] = np.arange(len(own))
        some = np.flatnonzero(both == one)
        for part in np.array_split(some, max(1, (len(some) << one) >> 22)):
            differ = (rows[place[x[part]]] ^ rows[place[y[part]]]).view(np.uint64)
            ok[part] = np.bitwise_count(differ).sum(1) <= room[part]
    return ok


def _open_pairs(percent: int, quota: int | None):
    def pairs(key, table):
        """Pairs of different components in long lists, ``quota`` of each set at most; then, without ``a``, the tokens of lists in which a set had more."""
        sets, comps = table.column("set").to_numpy(), table.column("comp").to_numpy()
        lists = [np.frombuffer(b"".join(x), ENTRY) for x in table.column("entries").to_pylist()]
        wide = table.column("wide").to_pylist()
        e = np.concatenate(lists)
        of = np.repeat(np.arange(len(sets)), [len(x) for x in lists])
        order = np.lexsort((e["set"], e["n"], e["pos"], e["token"]))
        e, of = e[order], of[order]
        cuts = np.flatnonzero(np.r_[True, e["token"][1:] != e["token"][:-1], True])
        a, b, more = [sets[:0]], [sets[:0]], []
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            own, c, back = e[i:j], comps[of[i:j]], of[i:j]
            if (c == c[0]).all():
                continue
            pos, n, sig = own["pos"].astype(np.int64), own["n"].astype(np.int64), own["sig"]
            stops = np.searchsorted(pos, _most_room(n, percent) - pos, "right")  # the list ascends by position
            first, over = 0, False
            while first < len(own) - 1:
                last = min(len(own) - 1, first + max(1, 1_000_000 // len(own)))  # rows of one block of comparisons
                stop = int(stops[first:last].max())
                x, y = np.arange(first, last), np.arange(first + 1, max(stop, first + 1))
                row, col = np.nonzero((y > x[:, None]) & (y < stops[x][:, None]) & (c[y] != c[x][:, None]))
                x, y, first = x[row], y[col], last
                room = _needed(n[x], n[y], percent)
                keep = pos[x] + pos[y] <= room
                x, y, room = x[keep], y[keep], room[keep]
                keep = np.bitwise_count(sig[x] ^ sig[y]).sum(1) <= room
                x, y, room = x[keep], y[keep], room[keep]
                if not len(x):
                    continue
                keep = _wide_passes(wide, back[x], back[y], room)
                x, y = x[keep], y[keep]
                if quota is not None and len(x):
                    nth = np.arange(len(x)) - np.searchsorted(x, x)
                    over |= bool((nth >= quota).any())
                    x, y = x[nth < quota], y[nth < quota]
                a.append(own["set"][x])
                b.append(own["set"][y])
            if over:
                more.append(int(own["token"][:1].view(np.int64)[0]))
        out = _pair_table(np.concatenate(a), np.concatenate(b), []).drop_columns(["entries"])
        return pa.concat_tables([out, pa.table({"a": pa.array([None] * len(more), pa.int64()), "b": pa.array(more, pa.int64())})])

    return pairs


def _wide_signature(own: np.ndarray, percent: int) -> bytes:
    """Parity of bits, a power of two of them and at least four times the set's room: sets with nothing in common differ in half of them."""
    bits = max(64, 1 << (4 * int(_most_room(np.array(len(own)), percent))).bit_length())
    return np.packbits((np.bincount((own >> np.uint64(11)).astype(np.int64) & (bits - 1), minlength=bits) & 1).astype(np.uint8)).tobytes()


def _sets_of(docs: DataFrame, ids: DataFrame, k: int, wide: int | None = None) -> DataFrame:
    """``s, n`` and the whole set (``tokens``), or its wide signature for a threshold of ``wide`` percent, of the set ids ``s`` in ``ids``.

    Sets are made again from the texts, in one pass; a Bloom filter of bounded size
    keeps back nearly all that aren't asked for, and a join the rest.
    """
    bits = np.uint64(BLOOM_WORDS * 64)

    def places(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = mix(ids.view(np.uint64))
        return h % bits, mix(h) % bits

    def masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = np.zeros(BLOOM_WORDS, np.uint64)
        for batch in batches:
            for place in places(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)):
                np.bitwise_or.at(bloom, (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
        some = np.flatnonzero(bloom)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(bloom[some].view(np.int64))], ["word", "mask"])

    sent = ids.select("s").mapInArrow(masks, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toPandas()  # BLOOM_WORDS rows at most
    bloom = np.zeros(BLOOM_WORDS, np.uint64)
    bloom[sent["word"].to_numpy(np.int64)] = sent["mask"].to_numpy(np.int64).view(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(bloom)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = shared.value
        for batch in slices(batches):
            tokens, at, n, ids = _sets(batch, k)
            rows = _distinct(ids)
            seen = [(bloom[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1 for place in places(ids[rows])]
            rows = rows[seen[0] & seen[1]]
            own = [tokens[at[r] : at[r + 1]] for r in rows]
            value = [x.tobytes() if wide is None else _wide_signature(x, wide) for x in own]
            yield pa.RecordBatch.from_arrays([pa.array(ids[rows].view(np.int64)), pa.array(n[rows].astype(np.int64)), pa.array(value, pa.binary())], ["s", "n", "tokens"])

    sets = texts(docs).mapInArrow(scan, "s long, n long, tokens binary")
    asked = sets.join(ids.hint("merge"), "s", "left_semi")
    return materialise(asked.groupBy("s").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens")), "asked_sets")


def _both_sides(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs with both sides' sets, sides in any order.

    A set in more than HUB_PAIRS pairs, such as a pivot of many, is copied and its
    pairs are dealt to the copies, so that no task gets all of them. The others
    are joined where they are. Without such sets their joins, seven of nine, are left
    out: each exchange is a thread of the driver for a minute.
    """
    often = pairs.select(F.explode(F.array("a", "b")).alias("s")).groupBy("s").agg(F.ceil(F.count("*") / HUB_PAIRS).cast("int").alias("parts")).where("parts > 1")
    often = materialise(often, "hubs")
    hub = lambda c: often.select(F.col("s").alias(c), F.col("parts").alias(f"p{c}"))
    side = lambda df, c, *more: df.select(F.col("s").alias(c), *(F.col(m).alias(f"{m}{c}") for m in more), F.col("n").alias(f"n{c}"), F.col("tokens").alias(f"t{c}"))
    columns = "a", "b", "na", "nb", "ta", "tb"
    plain = lambda some: some.select("a", "b").join(side(sets, "a"), "a").join(side(sets, "b"), "b").select(*columns)
    if not often.limit(1).count():
        return plain(pairs)
    known = materialise(pairs.join(hub("a"), "a", "left").join(hub("b"), "b", "left").select("a", "b", "pa", "pb"), "pair_hubs")
    copies = sets.join(often, "s").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    part = lambda other, parts: F.pmod(F.xxhash64(other), F.col(parts).cast("long")).cast("int")
    none = plain(known.where("pa is null and pb is null"))
    # the hub is called a
    one = known.where("(pa is null) <> (pb is null)").select(
        F.when(F.col("pa").isNotNull(), F.col("a")).otherwise(F.col("b")).alias("a"), F.when(F.col("pa").isNotNull(), F.col("b")).otherwise(F.col("a")).alias("b"), F.coalesce("pa", "pb").alias("p")
    )
    one = one.withColumn("parta", part("b", "p")).join(side(sets, "b"), "b").join(side(copies, "a", "part"), ["a", "parta"]).select(*columns)
    both = known.where("pa is not null and pb is not null").select("a", "b", part("b", "pa").alias("parta"), part("a", "pb").alias("partb"))
    both = both.join(side(copies, "a", "part"), ["a", "parta"]).join(side(copies, "b", "part"), ["b", "partb"]).select(*columns)
    return none.union(one).union(both)


def _near(pairs: DataFrame, wide: DataFrame, percent: int) -> DataFrame:
    """The pairs of set ids that their wide signatures don't rule out, so that whole sets are sent for few others than similar ones."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = max(1, batch.num_rows * (16 << 20) // max(1, batch.nbytes))  # of 16 MB
            for part in (batch.slice(i, rows) for i in range(0, batch.num_rows, rows)):
                a, b, n, m = (part.column(i).to_numpy() for i in range(4))
                at = np.arange(len(a))
                ok = _wide_passes(part.column(4).to_pylist() + part.column(5).to_pylist(), at, at + len(a), _needed(n, m, percent))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[ok]), pa.array(np.maximum(a, b)[ok])], ["a", "b"])

    return _both_sides(pairs, wide).mapInArrow(keep, "a long, b long")


def _verified(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs of set ids whose whole sets are similar enough."""
    sets = _sets_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("s")).distinct(), k)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(4), batch.column(5))):
                x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                both = np.sort(np.r_[x, y])
                common = int((both[1:] == both[:-1]).sum())
                ok[i] = 100 * common >= percent * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok)) for c in batch.columns[:2]], ["a", "b"])

    return _both_sides(pairs, sets).mapInArrow(keep, "a long, b long")


def similar_sets(docs: DataFrame, k: int, percent: int, full: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members, links and the components of the links.

    Members: ``doc_id, row_key, n_shingles, set_id`` for every document (set id 0: no
    shingle). Links: pairs ``a, b`` of set ids that are similar; with ``full`` all of
    them, so as many as the square of a family of near copies. Else, between sets
    of one component they are enough to connect it.
    Components: ``node, component`` of every set id that has a link. They are kept
    through the rounds, which only add links.
    """
    rows = materialise(members(docs, k), "members")
    hot, counts = frequent_shingles(rows)
    own = rows.where("tokens is null").select("doc_id", "row_key", "n_shingles", "set_id")
    expected = own.groupBy("set_id").agg(F.max("n_shingles").alias("n")).agg(F.sum(F.col("n") * (100 - percent) / 100 + 1)).first()[0] or 0
    groups = int(min(20_000, max(48, expected // 300_000)))
    shared = docs.sparkSession.sparkContext.broadcast((hot, counts))  # HOT_MOST pairs of numbers

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            e = _blocked(_entries(batch, k, percent, *shared.value), *shared.value)
            grp = (mix(e["token"]) % np.uint64(groups)).astype(np.int32)
            order = np.argsort(grp, kind="stable")
            e, grp = e[order], grp[order]
            cuts = np.flatnonzero(np.r_[True, grp[1:] != grp[:-1], True]) if len(e) else [0]
            yield pa.RecordBatch.from_arrays([pa.array([int(grp[i]) for i in cuts[:-1]], pa.int32()), pa.array([e[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:])], pa.binary())], ["grp", "entries"])

    index = texts(docs).mapInArrow(send, "grp int, entries binary")
    found = materialise(index.groupBy("grp").applyInArrow(_first_pairs(percent), "a long, b long, entries binary"), "first_pairs")
    first = found.where("entries is null").select("a", "b").distinct()

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A list's entries; a longer list than was counted on as pairs of blocks."""
        for batch in batches:
            for x in batch.column(0).to_pylist():
                e = np.frombuffer(x, ENTRY)
                if len(e) > 3 * HOT_BLOCK:  # a pair of blocks has twice HOT_BLOCK
                    e = _blocked(e, e["token"][:1], np.array([len(e)]))
                for part in (e[i : i + 50_000] for i in range(0, len(e), 50_000)):
                    yield pa.RecordBatch.from_arrays([pa.array(part["token"].astype(np.uint64).view(np.int64)), pa.array(part["set"].astype(np.int64)), pa.array([r.tobytes() for r in part], pa.binary())], ["token", "set", "entry"])

    lists = materialise(found.where("entries is not null").select("entries").mapInArrow(unpack, "token long, set long, entry binary"), "open_lists")
    ids = first.select(F.explode(F.array("a", "b")).alias("s")).union(lists.select(F.col("set").alias("s"))).distinct()
    wide = _sets_of(docs, materialise(ids, "asked_ids"), k, percent)
    tried = materialise(_near(first, wide, percent), "near_pairs")
    links = materialise(_verified(docs, tried, k, percent), "links")
    labels = connected_components(links, "a", "b")
    quota = None if full else FIRST_ASKED
    while True:
        if full:
            open_now = lists.withColumn("comp", F.col("set"))
        else:
            # a list without a second component has no more to tell
            labelled = lists.join(labels.withColumnRenamed("node", "set").hint("merge"), "set", "left").withColumn("comp", F.coalesce("component", "set")).drop("component")
            several = labelled.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("token")
            open_now = labelled.join(several.hint("merge"), "token", "left_semi")
        by_set = open_now.groupBy(F.pmod(F.xxhash64("token"), F.lit(groups)).alias("grp"), "set").agg(F.first("comp").alias("comp"), F.collect_list("entry").alias("entries"))
        given = by_set.join(wide.select(F.col("s").alias("set"), F.col("tokens").alias("wide")).hint("merge"), "set")
        asked = materialise(given.groupBy("grp").applyInArrow(_open_pairs(percent, quota), "a long, b long"), "open_pairs")
        fresh = materialise(asked.where("a is not null").distinct().join(tried.hint("merge"), ["a", "b"], "left_anti"), "fresh_pairs")
        if fresh.limit(1).count():
            more = materialise(_verified(docs, fresh, k, percent), "more_links")
            links, labels = links.union(more), with_links(labels, more)
        over = asked.where("a is null").select(F.col("b").alias("token"))
        if quota is None or not over.limit(1).count():
            return own, links, labels
        lists = materialise(lists.join(over.hint("merge"), "token", "left_semi"), "open_lists")  # the others have given all their pairs
        tried, quota = materialise(tried.union(fresh), "tried_pairs"), quota * 8


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, count_links: bool = True) -> DataFrame:
    """Every document with the class of its near duplicates.

    Two documents are linked when their sets of k-word shingles (ASCII letters
    lowered; a shorter text is one shingle) have 100 * intersection >= percent *
    union. Returns ``doc_id, n_shingles, component_id, n_links, set_id``: the smallest doc_id
    that links reach and the number of other sets that the document's set is
    linked to. A text without words (null, empty) has no set and is its
    own class. Rows that repeat share a class. A null id never names a class that
    has another id. Without ``count_links`` there is no ``n_links``, and pairs
    that don't change a class aren't compared.
    """
    own, links, labels = similar_sets(docs, k, percent, count_links)
    degree = links.select(F.explode(F.array("a", "b")).alias("set_id")).groupBy("set_id").agg(F.count("*").alias("n_links"))
    labels = labels.withColumnRenamed("node", "set_id")
    least = own.where("set_id <> 0").groupBy("set_id").agg(F.min("doc_id").alias("least"))
    sets = least.join(labels, "set_id", "left").join(degree, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    first = sets.groupBy("component").agg(F.min("least").alias("component_id"))
    sets = sets.join(first, "component").select("set_id", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = own.join(sets, "set_id", "left").select(
        "doc_id", "n_shingles", F.when(F.col("set_id") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "set_id",
    )
    return out if count_links else out.drop("n_links")


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, that stay when one document of each class of near duplicates does.

    The one of the smallest ``doc_id`` stays (null ids last, then by a hash of the
    text). Texts without words are no duplicates of each other and all stay.
    Rows of equal id and text count as one row, and one stays. Long texts are read
    whole, other columns stay whatever their names, an empty table gives no rows.
    """
    own, _, labels = similar_sets(docs, k, percent)
    labels = labels.withColumnRenamed("node", "set_id")
    place = F.struct(F.col("doc_id").isNull().alias("late"), F.col("doc_id").alias("id"), F.col("row_key").alias("key"))
    best = own.where("set_id <> 0").groupBy("set_id").agg(F.min(place).alias("best"))
    best = best.join(labels, "set_id", "left").groupBy(F.coalesce("component", "set_id").alias("class")).agg(F.min("best").alias("best"))
    stay = best.select("best.id", "best.key").union(own.where("set_id = 0").select("doc_id", "row_key")).distinct()
    doc, text, id_, key = unused(docs, "_own", "_text", "_id", "_key")
    stay = materialise(stay.select(F.col("id").alias(id_), F.col("key").alias(key)), "stay")
    left = docs.withColumn(doc, F.col("doc_id").cast("long")).withColumn(text, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    on = F.col(doc).eqNullSafe(F.col(id_)) & (F.col(text) == F.col(key))
    return left.join(stay.hint("shuffle_hash"), on, "left_semi").dropDuplicates([doc, text]).drop(doc, text)


def op5_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=90, count_links=False).select("doc_id", "n_shingles", "component_id")


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), p AS (
  SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM w WHERE len(ws) > 0
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 2], ' ') AS g FROM p
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), c AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), e AS (
  SELECT u, v FROM c JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 90 * (x.n + y.n - c)
), h AS (
  SELECT u, v FROM e UNION SELECT v, u FROM e
), r AS (
  SELECT doc_id AS id, doc_id AS reached FROM documents UNION SELECT r.id, h.v FROM r JOIN h ON h.u = r.reached
), l AS (
  SELECT id, min(reached) AS component_id FROM r GROUP BY id
)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, l.component_id
FROM w JOIN l ON l.id = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""
