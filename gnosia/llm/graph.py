"""Connected components of an edge table, by shuffles only: no link or label ever meets the others on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gnosia.llm.common import dropped, written

#: Nodes that a task holds at once; edges that it takes, about, when partitions are put together.
MOST = 1 << 20


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the edges of one partition by stars with the same components, at most MOST nodes at once."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (p := parent.setdefault(top, top)) != top:
            top = p
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    def stars() -> Iterator[pa.RecordBatch]:
        pairs = [(x, r) for x in list(parent) if (r := root(x)) != x]
        for i in range(0, len(pairs), 65536):
            yield pa.RecordBatch.from_arrays([pa.array([p[j] for p in pairs[i : i + 65536]], pa.int64()) for j in (0, 1)], names=["u", "v"])
        parent.clear()

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > MOST:
            yield from stars()
    yield from stars()


def _with_least(edges: DataFrame) -> DataFrame:
    """Each edge (u, v) with m, the least of u and all its neighbours; a join, so that a hub can be split."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def _state(e: DataFrame) -> tuple:
    """The number of edges and a sum over them, equal for equal tables."""
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _merged(e: DataFrame, most: int) -> tuple[DataFrame, tuple]:
    """(edges, their state): stars of partitions put together, as long as that halves the edges; no shuffle, no link is lost.

    A link known to many partitions is an edge in each of their stars, though with another root: a group of which every
    partition has seen a part would enter the first join once for each partition.
    """
    seen = _state(e)
    while seen[0]:
        parts = -(-seen[0] // most)
        old, e = e, written(e.coalesce(parts).mapInArrow(_contract, "u long, v long"))
        dropped(old)
        before, seen = seen, _state(e)
        if parts == 1 or 2 * seen[0] > before[0]:
            break
    return e, seen


def components(edges: DataFrame, most_rounds: int = 60, most: int = MOST) -> DataFrame:
    """(node, root) for every node of an edge: root is the least node of its component.

    edges: columns u, v (long); loops and repeated edges do no harm; an empty table gives an empty one. Partitions of
    edges are replaced by stars, then groups of partitions of about `most` edges. Large-star and small-star steps
    alternate until the edges stay the same; each round ends in a written table. The rounds needed grow with the
    logarithm of the longest path; after most_rounds it raises, and never returns a partial result.
    """
    e = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u <> v")
    e, seen = _merged(written(e.mapInArrow(_contract, "u long, v long")), most)
    for _ in range(most_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        small = _with_least(down)
        old, e = e, written(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).distinct())
        dropped(old)
        now = _state(e)
        if now == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = now
    raise RuntimeError("the components did not settle")
