"""Connected components: by alternating stars in DataFrame joins, or in one task where the edges are few."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import arrow_schema, ship, stash, unstash, with_arrow

#: Far beyond what doubling distances need; a bound against an endless loop. Reaching it is an error.
MOST_ROUNDS = 64


#: Distinct edges between numbered nodes up to which one task does the work in memory, some 100 MB at most.
LOCAL_EDGES = 1_000_000


def labelled(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges, an array of two rows, and the least node that each reaches."""
    nodes, places = np.unique(ends, return_inverse=True)
    root = list(range(len(nodes)))  # a root is the least of its class, so its place is too
    for a, b in places.reshape(2, -1).T.tolist():
        while root[a] != a:
            root[a] = a = root[root[a]]
        while root[b] != b:
            root[b] = b = root[root[b]]
        root[max(a, b)] = min(a, b)
    for i, r in enumerate(root):
        root[i] = root[r]  # smaller places are settled first
    return nodes, nodes[np.array(root, dtype=np.int64)]


def _in_one_task(edges: DataFrame) -> DataFrame:
    """node and label of few edges (a, b), without a shuffle."""
    ship(edges.sparkSession)
    schema = arrow_schema("node long, label long")

    def run(batches):
        ends = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches if b.num_rows]
        if not ends:
            return
        nodes, labels = labelled(np.concatenate(ends, axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(labels)], schema=schema)

    return with_arrow(edges.coalesce(1), run, "node long, label long")


def connected_components(edges: DataFrame) -> DataFrame:
    """The least node that each node reaches, for the nodes of ``edges`` (a, b of one orderable type).

    Returns node and label. Loops and repeated edges do no harm; rows with a null end are ignored; no edges give no
    rows. A hub's edges are never gathered in one task: minima are combined on the map side and joins can be split.
    Each round is written to the shared folder.
    """
    spark = edges.sparkSession
    links = edges.select("a", "b").filter("a is not null and b is not null")
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    proper = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    (now, path), (nodes, _) = stash(proper), stash(nodes)
    if now.schema["a"].dataType.typeName() == "long" and now.count() <= LOCAL_EDGES:
        found = _in_one_task(now)
        return nodes.join(found, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
    before = None
    for _ in range(MOST_ROUNDS):
        # Large star: every larger neighbour of a node points to the least of the node and its neighbours.
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(now.groupBy("a").agg(F.min("b").alias("b"))).filter("a <> b").distinct()
        (large, between) = stash(large)
        # Small star: a node and its smaller neighbours point to the least of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()
        (now, following) = stash(small)
        unstash(spark, path, between)
        path = following
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before or state[0] == 0:
            break
        before = state
    else:
        raise RuntimeError(f"components have not settled after {MOST_ROUNDS} rounds")
    return nodes.join(now.select(F.col("a").alias("node"), F.col("b").alias("label")), "node", "left").select("node", F.coalesce("label", "node").alias("label"))
