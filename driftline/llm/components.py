"""Connected components of a distributed edge list."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import discard, map_batches, materialize

#: Edges that one task may join up by itself: 16 MB of ids.
LOCAL_EDGES = 1 << 20


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the edges of one partition: (a, smallest id joined)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    ids = list(parent)
    for i in range(0, len(ids), 1 << 16):
        part = ids[i : i + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], names=["id", "component"])


def connected_components(edges: DataFrame, max_rounds: int = 200, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """Smallest reachable id for every end of ``edges`` (a, b: long).

    Returns (id, component). Each round hooks every root onto the smallest root
    of its neighbours and then halves the paths to the roots; rounds grow with
    the logarithm of the longest chain. Labels and edges stay distributed: the
    driver sees one flag a round. Every round is a written table, so a lost
    executor costs no more than the round. Up to ``local_edges`` edges, a
    checked bound, are joined up by one executor task instead. Self-loops and
    repeated edges are allowed; nulls are ignored; no edges give no rows.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select(
        F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")
    )
    edges = materialize(edges.distinct(), "cc-edges")
    if edges.count() <= local_edges:
        label = materialize(map_batches(edges.coalesce(1), _forest, "id long, component long"), "cc-label")
        discard(edges)
        return label
    # Star by star: the smallest neighbour of each vertex is its first parent.
    both = edges.select(F.col("a").alias("id"), F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("id"), F.col("a").alias("to")))
    label = materialize(
        both.groupBy("id").agg(F.min("to").alias("to")).select("id", F.least("id", "to").alias("component")), "cc-label"
    )
    live = edges
    for _ in range(max_rounds):
        # Halve paths: component of the component.
        up = label.select(F.col("id").alias("component"), F.col("component").alias("up"))
        label_next = label.join(up, "component").select("id", F.least("component", "up").alias("component"))
        label_next = materialize(label_next, "cc-label")
        # Edges between roots that still differ hook the larger root onto the smaller.
        la = label_next.select(F.col("id").alias("a"), F.col("component").alias("ca"))
        lb = label_next.select(F.col("id").alias("b"), F.col("component").alias("cb"))
        cross = live.join(la, "a").join(lb, "b").where("ca <> cb")
        cross = materialize(cross.select(F.greatest("ca", "cb").alias("a"), F.least("ca", "cb").alias("b")).distinct(), "cc-cross")
        hooks = cross.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("hook"))
        hooked = label_next.join(hooks, "id", "left").select("id", F.least("component", "hook").alias("component"))
        hooked = materialize(hooked, "cc-label")
        moved = label.select("id", F.col("component").alias("was")).join(hooked, "id").where("was <> component")
        done = cross.isEmpty() and moved.isEmpty()
        discard(label), discard(label_next)
        if live is not edges:
            discard(live)
        label, live = hooked, cross
        if done:
            discard(edges), discard(live)
            return label
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
