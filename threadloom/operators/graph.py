"""Connected components by alternating large-star and small-star (Kiveris et al., 2014)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.storage import by_merge, discard, distilled, materialise


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """Adds ``m``: the least of u and its neighbours v. An aggregate and a join rather than a
    window, so that the many edges of a hub are combined map-side; the aggregate is written, so
    that the join has plain shuffles on both sides and AQE can split a hub's."""
    least = edges.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("m"))
    return edges.join(by_merge(materialise(least, "least-neighbours")), "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least_neighbour(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    starred = _least_neighbour(down)
    moved = starred.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(starred.select("u", F.col("m").alias("v"))).distinct()


def _in_one_task(edges: DataFrame) -> DataFrame:
    """(u, v) of each node and the least of its component, by union-find over few edges."""

    def run(batches):
        up: dict = {}

        def root(x):
            while up.setdefault(x, x) != x:
                up[x] = x = up[up[x]]
            return x

        kind = None
        for batch in batches:
            kind = batch.schema
            for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
                x, y = (root(tuple(z.items()) if isinstance(z, dict) else z) for z in (u, v))
                if x != y:
                    up[max(x, y)] = min(x, y)
        if kind is not None:
            plain = lambda z: dict(z) if isinstance(z, tuple) else z
            yield pa.RecordBatch.from_pylist([{"u": plain(z), "v": plain(root(z))} for z in up], schema=kind)

    return edges.coalesce(1).mapInArrow(run, edges.schema)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, few: int = 100_000) -> DataFrame:
    """(node, component) for every node that an edge names; the component is its least node.

    Nodes may be of any ordered type. Edges with a null end are ignored, loops only name their
    node. Each round is written to the shared folder, so lineage stays short and a lost
    executor costs one round at most; rounds grow with the logarithm of the largest diameter.
    As soon as a round leaves no more than ``few`` edges, one task finishes them; the result is
    the same. Nodes are numbers, text, or structures of them without nulls.
    """
    named = materialise(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).dropna(), "edges")  # read twice
    nodes = named.select("u").unionAll(named.select("v")).distinct()
    now = materialise(named.filter("u <> v").distinct(), "components")
    before = None
    for _ in range(max_rounds):
        if (before[0] if before else now.count()) <= few:
            after = materialise(_in_one_task(now), "components")
            discard(now)
            now = after
            break
        after = distilled(edges.sparkSession, "components", lambda now=now: _small_star(_large_star(now)))
        discard(now)
        now = after
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    labels = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.select(F.col("u").alias("node")).join(by_merge(labels), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
