"""Connected components of a distributed edge list."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsquorum.llm.common import Cuts


#: Edges that a task joins up at once; as many stay joined up in one task, which then has all of them.
CHUNK = 100_000


def _joined_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) that connect the same nodes, in stars around the smallest node, by union-find over ``CHUNK`` edges at a time."""
    above: dict[int, int] = {}
    n = 0

    def root(x: int) -> int:
        while (y := above.setdefault(x, x)) != x:
            above[x] = x = above[y]
        return x

    def stars() -> pa.RecordBatch:
        pairs = [(x, r) for x in above if (r := root(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([r for _, r in pairs], pa.int64())], ["u", "v"])

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(u), root(v)
            above[max(a, b)] = min(a, b)
        n += batch.num_rows
        if n >= CHUNK:
            yield stars()
            above.clear()
            n = 0
    yield stars()


def components(edges: DataFrame, cuts: Cuts, name: str = "components") -> DataFrame:
    """(node, component): for each node but the smallest of its component, the smallest node it reaches.

    ``edges`` has columns a and b. Every round joins up the edges that lie in one partition, then hands each node's
    larger neighbours, then its smaller ones, to the smallest node it sees, till nothing changes. Nodes stay spread:
    a node with many neighbours is split by the adaptive join. Once no more than ``CHUNK`` edges are left, one task joins them up
    to the end. Each round is written to the shared folder.
    Self-loops, repeated edges and null ends are ignored; no edges, no rows. Nodes must be integers.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    state, seen = cuts.cut(pairs.mapInArrow(_joined_up, "u bigint, v bigint"), name), None
    while True:
        mark = state.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.hash("u", "v"))).first()
        if 0 < mark[0] <= CHUNK:
            state, seen = cuts.cut(state.coalesce(1).mapInArrow(_joined_up, "u bigint, v bigint"), name), mark
            cuts.drop(name, keep_last=True)
        if mark == seen or mark[0] == 0:
            return state.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = mark
        both = state.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(state.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        joined = small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct()
        state = cuts.cut(joined.mapInArrow(_joined_up, "u bigint, v bigint").distinct(), name)
        cuts.drop(name, keep_last=True)
