"""Connected components of a graph given by its edges, as a loop of Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialise, release


def _roots(links: DataFrame) -> DataFrame:
    """node, root: every node points to its smallest neighbour; pointers followed to the end."""
    both = links.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(
        links.select(F.col("b").alias("node"), F.col("a").alias("near"))
    )
    parents = materialise(
        both.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("root")), "parents"
    )
    while True:
        up = parents.select(F.col("node").alias("root"), F.col("root").alias("above"))
        jumped = materialise(
            parents.join(up, "root").select("node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")),
            "parents",
        )
        release(parents)
        parents = jumped
        if not parents.where("moved").limit(1).count():
            return parents


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of ``edges`` (a, b).

    Each round every node points to its smallest neighbour, pointers are followed to
    their roots, and the graph is contracted to the roots. At least half of the nodes that
    have an edge vanish each round, so rounds grow with the logarithm of the largest
    component. A hub's edges meet only in a minimum, which is aggregated before the shuffle.
    Self-links and nulls are ignored; repeated links count once.
    """
    links = materialise(
        edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links"
    )
    roots = _roots(links)
    labels = roots.select("node", F.col("root").alias("component"))
    labels._scratch_path = roots._scratch_path  # for the caller to release
    while True:
        a, b = (roots.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root")) for x in "ab")
        shorter = links.join(a, "a").join(b, "b").where("a_root <> b_root")
        contracted = materialise(
            shorter.select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct(), "links"
        )
        release(links)
        links = contracted
        if not links.limit(1).count():
            release(links)
            return labels
        merged = _roots(links)
        if roots._scratch_path != labels._scratch_path:
            release(roots)
        roots = merged
        moved = roots.select(F.col("node").alias("component"), "root")
        relabelled = materialise(
            labels.join(moved, "component", "left").select("node", F.coalesce("root", "component").alias("component")), "labels"
        )
        release(labels)
        labels = relabelled
