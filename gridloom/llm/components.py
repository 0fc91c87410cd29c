"""Connected components of a links table, by alternating stars.

Every round replaces links by links to the smallest neighbour, first for the
larger neighbours (large star), then for the smaller ones (small star), until
nothing changes: O(log n) rounds in practice. Each round's links are written
to the shared folder, so nothing is gathered on the driver and a lost executor
costs only the tasks it ran. Links that are few, by a count, are settled in one
task instead, which holds no more than these.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .scratch import Scratch
from .workers import task

#: Links that one task settles.
FEW = 200_000


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links (a, b) -> links to the smallest neighbour of each node."""
    if large:
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = both.join(low, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def _stars_only(links: DataFrame) -> bool:
    """Whether every node has one link, to a node that has none itself."""
    twice = links.groupBy("a").agg(F.count("*").alias("n")).where("n > 1")
    inner = links.join(links.select(F.col("a").alias("b")), "b", "left_semi")
    return inner.isEmpty() and twice.isEmpty()


def _settled(links: DataFrame) -> DataFrame:
    """(node, component) of links that fit in one task."""

    def run(batches):
        parent: dict = {}
        kind = None

        def plain(x):
            return tuple(x.values()) if isinstance(x, dict) else x

        def root(x):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        for batch in batches:
            kind = batch.schema.field(0).type
            for a, b in zip(*(map(plain, c.to_pylist()) for c in batch.columns)):
                a, b = root(parent.setdefault(a, a)), root(parent.setdefault(b, b))
                parent[max(a, b)] = min(a, b)
        names = [f.name for f in kind] if kind is not None and pa.types.is_struct(kind) else None
        out = [(x, root(x)) for x in parent]
        for i in range(0, len(out), 10_000):
            columns = ([dict(zip(names, v)) if names else v for v in c] for c in zip(*out[i : i + 10_000]))
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c in columns], names=["node", "component"])

    node = links.schema["a"].dataType.simpleString()
    return links.select("a", "b").coalesce(1).mapInArrow(task("components", run), f"node {node}, component {node}")


def connected_components(links: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """links: two columns of one ordered type. Returns (node, component), only
    for nodes with a link to another node; component is the smallest node
    reachable. Self links, repeated links and links with a null are ignored."""
    a, b = links.columns
    now = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    now = scratch.keep(now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    if now.count() <= FEW:
        return _settled(now)
    for k in range(most_rounds):
        new = scratch.keep(_star(_star(now, True), False), "stars")
        scratch.drop(now)
        now = new
        if _stars_only(now):
            break
    else:
        raise RuntimeError("the components did not settle")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
