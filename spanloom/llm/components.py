"""Connected components of an edge table, by rounds of large-star and small-star joins."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import save
from spanloom.sources.scratch import drop

#: Neighbours of a node that stay together at least (a thousandth of all edges, if that is more), parts of a node's neighbours where it has
#: more, and nodes that a task's forest holds before it is handed on.
SHARE, SPLIT, NODES = 100_000, 64, 200_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges as spanning forests, of ``NODES`` nodes or a batch more each: each node with the least node of its tree."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while up.get(top, top) != top:
            top = up[top]
        while up.get(x, x) != top:
            up[x], x = top, up[x]
        return top

    def grown() -> Iterator[pa.RecordBatch]:
        nodes = [x for x in up if up[x] != x]
        for i in range(0, len(nodes), 10_000):
            own = nodes[i : i + 10_000]
            yield pa.record_batch([pa.array(own, pa.int64()), pa.array([root(x) for x in own], pa.int64())], names=["u", "v"])
        up.clear()

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
        if len(up) > NODES:
            yield from grown()
    yield from grown()


def with_least(pairs: DataFrame, share: int, total: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (x, y), ``total`` at most, with ``m``, the least of x's ys and x itself, and (x, m) of every x.

    An x with more than ``share`` pairs, of which there are at most as many as all pairs hold shares, has them dealt in ``SPLIT`` parts: no
    task joins more than a share, or than that part, of one x. Where all pairs are no more than a share, there is nothing to part.
    """
    if total <= share:
        least = pairs.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        return pairs.join(least, "x").select("x", "y", "m"), least
    least = pairs.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"), F.count("*").alias("n"))
    hubs = F.broadcast(least.where(F.col("n") > share).select(F.col("x").alias("hub")))
    part = F.when(F.col("hub").isNotNull(), F.pmod(F.xxhash64("y"), F.lit(SPLIT))).otherwise(0).cast("int")
    parted = pairs.join(hubs, F.col("x") == F.col("hub"), "left").select("x", "y", part.alias("part"))
    parts = F.when(F.col("n") > share, F.sequence(F.lit(0), F.lit(SPLIT - 1))).otherwise(F.array(F.lit(0)))
    back = least.select("x", "m", F.explode(parts).alias("part"))
    return parted.join(back, ["x", "part"]).select("x", "y", "m"), least.select("x", "m")


def components(edges: DataFrame, a: str = "a", b: str = "b", name: str = "components") -> DataFrame:
    """node, component (least node reachable) for every node with an edge to another; ids are longs.

    Rounds go on until one changes nothing, and each halves paths; every intermediate table goes to the shared folder. A node with many
    neighbours is dealt in parts (see ``with_least``).
    """
    e = save(edges.select(a, b).mapInArrow(_forest, "u long, v long").distinct(), f"{name}_0")
    mark, total = None, 2 * e.count()
    share = max(SHARE, total // 1000)
    for i in count(1):
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        # Large star: every larger neighbour of a node goes to the node's least one. Small star: so does every smaller one.
        large = with_least(both, share, total)[0].where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y"))
        near, least = with_least(large, share, total)
        small = near.where("y <> m").select(F.col("y").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("x").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()
        was, e = e, save(small, f"{name}_{i}")
        drop(was)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == mark:
            break
        mark = now
    tops = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops.select("node", F.col("node").alias("component")))
