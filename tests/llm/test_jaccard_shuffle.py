"""What the similarity join sends: whole sets only where wide signatures leave a pair open, and only lists that have more to give."""

import random

import numpy as np
import pyarrow as pa

from geoloom.llm import jaccard_join


def test_whole_sets_only_for_pairs_that_wide_signatures_leave(spark, monkeypatch):
    """Long texts that share a passage with the next one pass the index's 256 bits; only the near copy is similar."""
    asked, sets_of = [], jaccard_join._sets_of
    monkeypatch.setattr(jaccard_join, "_sets_of", lambda docs, ids, k, wide=None: asked.append((bool(wide), ids.count())) or sets_of(docs, ids, k, wide))
    words = [[f"w{i}x{j}" for j in range(1600)] for i in range(12)]
    for a, b in zip(words[:-1], words[1:]):
        b[:120] = a[-120:]
    words.append([*words[5][:-1], "other"])
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(words)], "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in jaccard_join.near_duplicates(docs, 3, 90, count_links=False).collect()}
    assert got == {i: 5 if i == 12 else i for i in range(13)}
    assert sum(n for wide, n in asked if not wide) == 2
    assert sum(n for wide, n in asked if wide) >= 12  # they were candidates


def test_wide_signatures_rule_out_no_similar_pair():
    r = np.random.default_rng(3)
    for percent in (60, 80, 90, 99):
        sets = []
        for n in (1, 2, 9, 10, 63, 64, 65, 700, 5000, 20_000):
            own = r.integers(0, 1 << 63, n, dtype=np.uint64)
            gone = n * (100 - percent) // 100
            sets += [own, own[gone:], np.r_[own, r.integers(0, 1 << 63, n * (100 - percent) // percent, dtype=np.uint64)]]
        x, y = (i.ravel() for i in np.indices((len(sets), len(sets))))
        n = np.array([len(s) for s in sets])
        common = np.array([len(np.intersect1d(sets[i], sets[j])) for i, j in zip(x, y)])
        similar = 100 * common >= percent * (n[x] + n[y] - common)
        passes = jaccard_join._wide_passes([jaccard_join._wide_signature(s, percent) for s in sets], x, y, jaccard_join._needed(n[x], n[y], percent))
        assert similar.sum() > len(sets) and passes[similar].all()


def test_lists_that_gave_all_their_pairs_are_done():
    """Of two lists only the one where a set has more partners than were asked for stays."""
    e = np.zeros(6, jaccard_join.ENTRY)
    e["token"] = [1 << 63, 1 << 63, 1 << 63, 1 << 63, 5, 5]
    e["set"], e["n"] = [1, 2, 3, 4, 5, 6], 1000
    table = pa.table({"set": e["set"], "comp": e["set"], "entries": pa.array([[x.tobytes()] for x in e]), "wide": pa.array([bytes(8)] * 6, pa.binary())})
    out = jaccard_join._open_pairs(90, 1)(None, table).to_pylist()
    assert [(x["a"], x["b"]) for x in out] == [(1, 2), (2, 3), (3, 4), (5, 6), (None, -(1 << 63))]
    out = jaccard_join._open_pairs(90, 3)(None, table).to_pylist()
    assert len(out) == 7 and all(x["a"] is not None for x in out)


def test_components_are_kept_through_the_rounds(spark, monkeypatch):
    """Components are made from all links once, and neither the rounds nor the result make them again."""
    calls, labelled = [], jaccard_join.connected_components
    monkeypatch.setattr(jaccard_join, "connected_components", lambda *a: calls.append(a) or labelled(*a))
    # a window slides over one text: a document is similar to the next one only
    words = [f"w{i}" for i in range(160)]
    texts = [" ".join(words[i : i + 62]) for i in range(0, 80, 2)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {x.component_id for x in jaccard_join.near_duplicates(docs, 3, 90, count_links=False).collect()} == {0}
    assert [x.doc_id for x in jaccard_join.one_of_each(docs, 3, 90).collect()] == [0]
    assert len(calls) == 2  # one for each of the two queries


def test_pairs_meet_their_sets_with_and_without_hubs(spark, monkeypatch):
    """Every pair gets both sides' sets, whichever side is a hub; without hubs two joins are enough."""
    monkeypatch.setattr(jaccard_join, "HUB_PAIRS", 5)
    sets = spark.createDataFrame([(i, i + 1, bytes([i])) for i in range(40)], "s long, n long, tokens binary")
    star = [(0, i) for i in range(1, 30)] + [(i, 39) for i in range(1, 12)] + [(0, 39)]
    few = [(i, i + 1) for i in range(10)]
    frame, joins = type(sets), []
    join = frame.join
    for edges in (star, few, []):
        joins.clear()
        with monkeypatch.context() as m:
            m.setattr(frame, "join", lambda self, *a, **k: joins.append(1) or join(self, *a, **k))
            got = jaccard_join._both_sides(spark.createDataFrame(edges, "a long, b long"), sets).collect()
        assert sorted((*sorted((x.a, x.b)), *sorted((x.na - 1, x.nb - 1)), *sorted((x.ta[0], x.tb[0]))) for x in got) == sorted(e * 3 for e in edges)
        assert all((x.na, x.nb, x.ta[0], x.tb[0]) == (x.a + 1, x.b + 1, x.a, x.b) for x in got)
        assert edges == star or len(joins) == 2
