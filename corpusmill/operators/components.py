"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpusmill.session import materialise, release


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """``(node, component)`` of every node that occurs in ``edges``.

    ``component`` is the smallest node of the component. Each round points
    every node to its smallest neighbour, follows the pointers to their roots
    and contracts the edges to roots, so the edge table at least halves in
    nodes per round; aggregation is by ``min`` and combines on the map side, so
    a hub with a third of all edges is never gathered. Nulls and self-loops
    form no edge; repeated edges change nothing; an empty table gives none.
    """
    kind = edges.schema[src].dataType
    live = (
        edges.select(F.col(src).cast(kind).alias("a"), F.col(dst).cast(kind).alias("b"))
        .where("a is not null and b is not null and a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    live = materialise(live, "cc-edges")
    label: DataFrame | None = None
    while not live.isEmpty():
        both = live.union(live.select("b", "a"))
        parent = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
        parent = parent.select("node", F.least("node", "m").alias("component"))
        parent = materialise(parent, "cc-parent")
        while True:
            up = parent.select(
                F.col("node").alias("component"), F.col("component").alias("upper")
            )
            jumped = materialise(
                parent.join(up, "component", "left").select(
                    "node",
                    F.coalesce("upper", "component").alias("component"),
                    (F.coalesce("upper", "component") != F.col("component")).alias("moved"),
                ),
                "cc-jump",
            )
            moved = not jumped.where("moved").isEmpty()
            release(parent)
            parent = jumped.drop("moved")
            parent._corpusmill_path = jumped._corpusmill_path
            if not moved:
                break
        if label is None:
            new_label = parent
        else:
            up = parent.select(
                F.col("node").alias("component"), F.col("component").alias("upper")
            )
            new_label = materialise(
                label.join(up, "component", "left").select(
                    "node", F.coalesce("upper", "component").alias("component")
                ),
                "cc-label",
            )
        pa = parent.select(F.col("node").alias("a"), F.col("component").alias("ca"))
        pb = parent.select(F.col("node").alias("b"), F.col("component").alias("cb"))
        contracted = (
            live.join(pa, "a")
            .join(pb, "b")
            .where("ca <> cb")
            .select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"))
            .distinct()
        )
        contracted = materialise(contracted, "cc-edges")
        release(live)
        if label is not None:
            release(label, parent)
        live, label = contracted, new_label
    if label is None:
        return live.select(F.col("a").alias("node"), F.col("a").alias("component"))
    return label
