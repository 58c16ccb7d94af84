"""Connected components as rounds of DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from geoloom.sources.shared import materialise


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Label every node of an undirected edge table with the smallest node of its component.

    Each round hooks a node's label to the smallest label among its neighbours
    (a partially aggregated ``min``, so a hub of any degree is summed map-side)
    and then shortcuts labels through labels. Rounds grow with the logarithm of
    the diameter rather than with the diameter. Own labels and those seen meet in one
    aggregate instead of a join, since every join is a job or two for the driver.

    Returns ``node, component``. Self loops give a component of their own;
    edges with a null end are ignored; no edges give no rows.
    """
    e = edges.select(F.col(u).alias("a"), F.col(v).alias("b")).where("a is not null and b is not null")
    half = materialise(e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "half_edges")
    labels = materialise(half.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("lab")), "labels")
    while True:
        near = half.join(labels.select(F.col("node").alias("b"), "lab"), "b").select(F.col("a").alias("node"), F.lit(None).alias("old"), "lab")
        hooked = labels.select("node", F.col("lab").alias("old"), "lab").union(near).groupBy("node").agg(F.max("old").alias("old"), F.min("lab").alias("lab"))
        # the labelled node adopts the smallest label that any of its followers has seen
        best = hooked.select(F.col("old").alias("node"), F.lit(None).alias("old"), "lab")
        hooked = hooked.union(best).groupBy("node").agg(F.max("old").alias("old"), F.min("lab").alias("lab"))
        hooked = materialise(hooked, "hooked")
        jumped = hooked.alias("x").join(
            hooked.select(F.col("node").alias("lab"), F.col("lab").alias("far")), "lab", "left"
        ).select("node", "old", F.least("lab", F.coalesce("far", "lab")).alias("lab"))
        done = materialise(jumped, "labels")
        moved = done.where("lab <> old").limit(1).count()
        labels = done.select("node", "lab")
        if not moved:
            return labels.select("node", F.col("lab").alias("component"))


def with_links(labels: DataFrame, links: DataFrame) -> DataFrame:
    """What :func:`connected_components` of a graph returns (``labels``) once the edges ``links`` (``a, b``, no nulls) are added to it.

    Only components that the new edges join go through rounds. Nodes that had no
    edge yet are added; without new edges the labels stay as they are.
    """
    known = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    between = links.select("a", "b").join(known("a"), "a", "left").join(known("b"), "b", "left")
    between = materialise(between.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b").distinct(), "between")
    joined = connected_components(between, "a", "b").select(F.col("node").alias("component"), F.col("component").alias("to"))
    # the first node of a joined component is one of its nodes; nodes without an edge so far are their own
    fresh = joined.select(F.col("component").alias("node")).join(labels.select("node"), "node", "left_anti").select("node", F.col("node").alias("component"))
    every = labels.select("node", "component").union(fresh)
    return materialise(every.join(joined, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "components")
