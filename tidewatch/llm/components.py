"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import stored


#: Nodes a task's union-find holds at a time.
_MOST_EDGES = 500_000


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("low"))


def large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than a node is tied to the node's smallest neighbour."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _least(both).select("u", F.least("u", "low").alias("low"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _least(down)
    others = down.join(low, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return others.unionByName(low.select("u", F.col("low").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: for every node of ``src, dst`` the smallest node of its component.

    Steps repeat until nothing changes, about log(diameter) times; each is written
    to the shared folder, so a lost executor costs one step. A node with very many
    neighbours is spread: its smallest neighbour is found by partial aggregates, and
    the join that hands it out may be split on the neighbours' side.
    """
    now = stored(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).where("u <> v"), "edges")
    before = None
    while True:
        now = stored(small_star(large_star(now)), "stars")
        state = now.agg(
            F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = state


def is_star_forest(edges: DataFrame) -> bool:
    """Whether each ``u`` has one ``v`` and no ``v`` is a ``u``; edges that are repeated count twice."""
    up = F.struct(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    down = F.struct(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    ends = edges.select(F.explode(F.array(up, down)).alias("e")).groupBy("e.n").agg(F.sum("e.up").alias("up"), F.sum("e.down").alias("down"))
    return ends.where("up > 1 OR (up = 1 AND down > 0)").isEmpty()


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars in place of the edges of a task, by union-find over ``_MOST_EDGES`` of them at a time."""

    def stars(up: dict[int, int]) -> pa.RecordBatch:
        for x in sorted(up):  # a node's way leads to smaller nodes, whose own is short by then
            up[x] = up.get(up[x], up[x])
        return pa.RecordBatch.from_pydict({"u": pa.array(up.keys(), pa.int64()), "v": pa.array(up.values(), pa.int64())})

    up: dict[int, int] = {}
    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            while (x := up.get(u, u)) != u:
                up[u] = up.get(x, x)
                u = x
            while (x := up.get(v, v)) != v:
                up[v] = up.get(x, x)
                v = x
            if u != v:
                up[max(u, v)] = min(u, v)
        if len(up) >= _MOST_EDGES:
            yield stars(up)
            up = {}
    yield stars(up)


def rooted(edges: DataFrame) -> DataFrame:
    """``node, root``: for every node of ``src, dst`` but the roots, the smallest node of its component.

    Edges are first made stars inside each task, which is all where they fit one; then
    the same steps as in ``components`` follow until only stars are left.
    """
    pairs = "u long, v long"
    now = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v")
    now = stored(now.hint("rebalance", "v").mapInArrow(_contracted, pairs), "stars")
    while not is_star_forest(now):
        now = stored(small_star(large_star(now)).mapInArrow(_contracted, pairs), "stars")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
