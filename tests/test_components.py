"""Components: labels by rounds of aggregates, and labels kept when edges are added."""

import random

from geoloom.operators.components import connected_components, with_links


def brute(edges):
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    return label


def of(spark, edges):
    return spark.createDataFrame(edges, "a long, b long")


def test_few_joins_a_round(spark):
    """A chain, a star, a loop and negative ids; each round is two joins, as each costs the driver jobs."""
    edges = [(i, i + 1) for i in range(-30, 10)] + [(100, x) for x in range(101, 140)] + [(200, 200)]
    joins, frame = [], type(spark.range(0))
    join = frame.join
    try:
        frame.join = lambda self, *a, **k: joins.append(1) or join(self, *a, **k)
        got = {x.node: x.component for x in connected_components(of(spark, edges), "a", "b").collect()}
    finally:
        frame.join = join
    assert got == brute(edges)
    assert len(joins) <= 2 * 8  # twice as many before


def test_links_added_to_known_components(spark):
    """Links inside a component, between components, to new nodes, among new nodes; chains of all of them."""
    r = random.Random(5)
    for n, more in ((30, 12), (60, 1), (40, 40), (10, 0)):
        old = [(r.randrange(-50, 50), r.randrange(-50, 50)) for _ in range(n)]
        new = [(r.randrange(-90, 90), r.randrange(-90, 90)) for _ in range(more)]
        new = [(a, b) for a, b in new if a != b]
        labels = connected_components(of(spark, old), "a", "b")
        got = [(x.node, x.component) for x in with_links(labels, of(spark, new)).collect()]
        assert len(got) == len(dict(got)) and dict(got) == brute(old + new)
    none = connected_components(of(spark, []), "a", "b")
    assert {x.node: x.component for x in with_links(none, of(spark, [(7, 3), (3, 9)])).collect()} == {3: 3, 7: 3, 9: 3}
