"""Connected components of an undirected graph given as edges, by contraction.

Each round maps every node to the least of itself and its neighbours, in an order of nodes that is drawn anew each
round (by hash), and rewrites the edges to the images, until no edge joins different nodes; then the rounds' maps are
composed.  An edge (a, image of a) becomes (image of a, its image), so nothing falls apart; the new order makes paths
shrink by a constant part each round, however their ids are sorted.  Before a round each task replaces every CHUNK edges of
its own by a forest that joins the same nodes, so edges that lie together cost no round.  Only minima are aggregated, never lists of
neighbours, and each round is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


#: Edges that a task looks at together.
CHUNK = 200_000


def forest(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Edges (node, root) that join what the edges (a, b) join."""
    root: dict[int, int] = {}
    for x, y in zip(a, b):
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        while root.setdefault(y, y) != y:
            root[y] = y = root[root[y]]
        if x != y:
            root[max(x, y)] = min(x, y)
    nodes, roots = [], []
    for x in root:
        y = x
        while root[y] != y:
            y = root[y]
        if x != y:
            nodes.append(x)
            roots.append(y)
    return nodes, roots


def thinned(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[int] = []
        b: list[int] = []
        for batch in batches:
            a += batch.column(0).to_pylist()
            b += batch.column(1).to_pylist()
            if len(a) >= CHUNK:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in forest(a, b)], names=["a", "b"])
                a, b = [], []
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in forest(a, b)], names=["a", "b"])

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, name: str = "components", thin: bool = True) -> DataFrame:
    """(node, root) for every node that has an edge; edges has a and b (equal ends are allowed and say nothing).

    thin = False leaves out the first thinning, where edges come from a Python stage that has done it already.
    """
    edges = edges.filter(F.col("a") != F.col("b")).select("a", "b")
    edges = materialize(thinned(edges) if thin else edges, f"{name}-edges")
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        placed = lambda c, k=len(maps): F.struct(F.xxhash64(F.col(c), F.lit(k)).alias("h"), F.col(c).alias("id"))
        ends = F.explode(F.array(F.struct(F.col("a").alias("node"), placed("b").alias("other")), F.struct(F.col("b").alias("node"), placed("a").alias("other")))).alias("e")
        image = edges.select(ends).groupBy("e.node").agg(F.min("e.other").alias("other"))
        image = materialize(image.select("node", F.least(placed("node"), F.col("other"))["id"].alias("root")), f"{name}-map")
        maps.append(image)
        left = image.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = image.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = edges.join(left, "a").join(right, "b").filter(F.col("ra") != F.col("rb"))
        before, edges = edges, materialize(thinned(moved.select(F.col("ra").alias("a"), F.col("rb").alias("b"))), f"{name}-edges")
        discard(before)
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    whole, steps = maps[-1], maps[:-1]
    for step in reversed(steps):
        later = whole.select(F.col("node").alias("root"), F.col("root").alias("end"))
        whole = step.join(later, "root", "left").select("node", F.coalesce("end", "root").alias("root"))
    whole = materialize(whole, f"{name}-roots")
    discard(edges, *maps)
    return whole
