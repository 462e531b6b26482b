"""Transitive closure of binary predicates, from every term or from given seeds.

A closure is a table (lo, hi, dist) with the least number of steps. Two ways give the same rows:

* up to SMALL distinct edges, the adjacency is broadcast and each seed is searched breadth first where it lies: one job,
  no shuffle for each level, any depth. Terms that no edge leads to are never met on the way, so their edges travel with
  them as seeds and do not count;
* beyond, rounds that end in a checkpoint each. From every term each round doubles the number of steps: pairs of exactly
  as many steps as the last round knew are joined with all known pairs. From seeds semi-naive rounds join the newest pairs
  with the edges; where the graph turns out deep (or with `doubling`) all pairs are made by doubling and the seeds' picked.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gnosia.operators.tables import few, ship
from gnosia.operators.tables import written as checkpointed

#: Distinct edges up to which the adjacency is broadcast.
SMALL = 200_000
#: Semi-naive rounds from seeds after which all pairs are made by doubling.
DEEP = 16
SCHEMA = "lo string, hi string, dist int"


def _search(adjacency, seeds: DataFrame) -> DataFrame:
    """Breadth-first search from every seed (column lo), over a broadcast map of successors; a second column holds the seed's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_of = adjacency.value
        for batch in batches:
            lo, hi, dist = [], [], []

            def flush(lo=lo, hi=hi, dist=dist) -> pa.RecordBatch:
                got = pa.RecordBatch.from_arrays([pa.array(lo, pa.string()), pa.array(hi, pa.string()), pa.array(dist, pa.int32())], names=["lo", "hi", "dist"])
                for x in (lo, hi, dist):
                    x.clear()
                return got

            seeds = batch.column(0).to_pylist()
            for seed, own in zip(seeds, batch.column(1).to_pylist() if batch.num_columns > 1 else [None] * len(seeds), strict=True):
                seen, level, d = {seed}, [seed], 0
                looped = False
                while level:
                    d += 1
                    reached = []
                    for n in level:
                        for m in out_of.get(n, ()) if own is None or d > 1 else own:
                            if m == seed and not looped:  # a cycle back to the seed
                                looped = True
                                lo.append(seed)
                                hi.append(seed)
                                dist.append(d)
                            if m not in seen:
                                seen.add(m)
                                reached.append(m)
                    lo += [seed] * len(reached)
                    hi += reached
                    dist += [d] * len(reached)
                    level = reached
                if len(lo) > 50_000:
                    yield flush()
            if lo:
                yield flush()

    return seeds.mapInArrow(run, SCHEMA)


def reach(edges: DataFrame, seeds: DataFrame | None = None, small: int = SMALL, doubling: bool = False, most_rounds: int | None = None) -> DataFrame:
    """All pairs (lo, hi, dist >= 1) joined by a path over edges (lo, hi), from the seeds (column lo) or from every term.

    A pair (x, x) is in it only if x lies on a cycle. Null ends are ignored, repeated edges count once. With most_rounds
    it raises where they do not suffice.
    """
    spark = edges.sparkSession
    pairs = edges.select("lo", "hi").where("lo is not null and hi is not null").distinct()
    start = pairs.select("lo").distinct() if seeds is None else seeds.select("lo").where("lo is not null").distinct()
    rows = few(pairs, small) if small else None
    if rows is not None:
        ship(spark)
        out_of = _adjacency(rows)
        if seeds is None:  # the terms are at hand
            start = spark.createDataFrame([(a,) for a in out_of], "lo string").repartition(max(1, min(len(out_of) // 2000, 4 * spark.sparkContext.defaultParallelism)))
        return _search(spark.sparkContext.broadcast(out_of), start)

    pairs = checkpointed(pairs)
    rows = few(pairs.join(pairs.select(F.col("hi").alias("lo")).distinct(), "lo", "left_semi"), small) if small else None
    if rows is not None:
        ship(spark)
        first = pairs if seeds is None else pairs.join(start, "lo", "left_semi")
        first = first.groupBy("lo").agg(F.sort_array(F.collect_set("hi")).alias("own"))
        return _search(spark.sparkContext.broadcast(_adjacency(rows)), first.repartition(max(1, min(pairs.count() // 2000, 4 * spark.sparkContext.defaultParallelism))))
    if seeds is None or doubling:
        every = _doubled(pairs, most_rounds)
        return every if seeds is None else every.join(start, "lo", "left_semi")

    step = pairs.select(F.col("lo").alias("a"), F.col("hi").alias("b"))
    delta = known = checkpointed(pairs.join(start, "lo", "left_semi").select("lo", "hi", F.lit(1).alias("dist")))
    if 2 * delta.count() > pairs.count():  # most edges start at a seed
        return _doubled(pairs, most_rounds).join(start, "lo", "left_semi")
    rounds = 0
    while not delta.isEmpty():
        if most_rounds is not None and rounds == most_rounds:
            raise RuntimeError("the closure is deeper than most_rounds")
        if rounds == DEEP:
            return _doubled(pairs, most_rounds).join(start, "lo", "left_semi")
        rounds += 1
        found = delta.join(step, delta.hi == step.a).select("lo", F.col("b").alias("hi"), (F.col("dist") + 1).alias("dist")).distinct()
        delta = checkpointed(found.join(known.select("lo", "hi"), ["lo", "hi"], "left_anti"))
        known = known.union(delta)
    return known


def _adjacency(rows: list) -> dict[str, list[str]]:
    out_of: dict[str, list[str]] = {}
    for a, b in rows:
        out_of.setdefault(a, []).append(b)
    for x in out_of.values():
        x.sort()
    return out_of


def _doubled(pairs: DataFrame, most_rounds: int | None) -> DataFrame:
    """All pairs from every term: as many rounds as the depth has binary digits.

    A shortest path of more than n and at most 2n steps begins with a shortest one of n steps and ends with a known one.
    """
    known = level = checkpointed(pairs.select("lo", "hi", F.lit(1).alias("dist")))
    n = 1
    while True:
        rest = known.select(F.col("lo").alias("a"), F.col("hi").alias("b"), F.col("dist").alias("more"))
        # these tables compress so well that a broadcast by their size on disk would be many times as large at the driver
        found = level.join(rest.hint("merge"), level.hi == rest.a).groupBy("lo", F.col("b").alias("hi")).agg((F.min("more") + F.lit(n)).alias("dist"))
        new = checkpointed(found.join(known.select("lo", "hi").hint("merge"), ["lo", "hi"], "left_anti").select("lo", "hi", "dist"))
        if new.isEmpty():
            return known
        if most_rounds is not None and not new.where(F.col("dist") > most_rounds).isEmpty():
            raise RuntimeError("the closure is deeper than most_rounds")
        n *= 2
        known, level = known.union(new), new.where(F.col("dist") == n)


def reflexive(closure: DataFrame, terms: DataFrame) -> DataFrame:
    """Add (x, x, 0) for the given terms (column term), whatever cycles there are."""
    own = terms.select(F.col("term").alias("lo"), F.col("term").alias("hi"), F.lit(0).alias("dist")).where("lo is not null").distinct()
    return closure.where("lo <> hi").unionByName(own)


def cycles(closure: DataFrame) -> DataFrame:
    """Terms on a cycle and the least term of their strongly connected component: (term, component, length)."""
    back = closure.select(F.col("lo").alias("__hi"), F.col("hi").alias("__lo"))
    mutual = closure.join(back, (closure.lo == F.col("__lo")) & (closure.hi == F.col("__hi")), "left_semi")
    own = closure.where("lo = hi").select(F.col("lo").alias("term"), F.col("dist").alias("length"))
    return own.join(mutual.groupBy(F.col("lo").alias("term")).agg(F.min(F.least("lo", "hi")).alias("component")), "term").select("term", "component", "length")


def minimal(members: DataFrame, closure: DataFrame, group: list[str]) -> DataFrame:
    """Within each group, drop members (column term) that are a proper ancestor of another member."""
    return _extreme(members, closure, group, "hi")


def maximal(members: DataFrame, closure: DataFrame, group: list[str]) -> DataFrame:
    """Within each group, drop members that are a proper descendant of another member."""
    return _extreme(members, closure, group, "lo")


def _extreme(members: DataFrame, closure: DataFrame, group: list[str], drop: str) -> DataFrame:
    """Members always look upwards: a term has few terms above it, while nearly all terms lie below a root."""
    strict = closure.where("lo <> hi").select(F.col("lo").alias("term"), F.col("hi").alias("__above"))
    seen = members.join(strict, "term").select(*group, "term", "__above")
    if drop == "lo":
        others = members.select(*[F.col(g).alias(f"__{g}") for g in group], F.col("term").alias("__other")).distinct()
        seen = seen.join(others, [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in group] + [F.col("__above") == F.col("__other")], "left_semi")
    lost = seen.select(*group, F.col("term" if drop == "lo" else "__above").alias("term")).distinct()
    return members.join(lost, [*group, "term"], "left_anti")


def path_justifications(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(lo, hi, path): one shortest chain of terms from lo to hi for each pair; of equally short ones the least.

    Paths are carried forward from the pairs' own starts only, level by level.
    """
    goal = pairs.select("lo", "hi").distinct()
    step = checkpointed(edges.select(F.col("lo").alias("a"), F.col("hi").alias("b")).where("a is not null and b is not null").distinct())
    front = checkpointed(goal.select("lo").distinct().select("lo", F.col("lo").alias("at"), F.array("lo").alias("path")))
    known, out = front, front.join(goal, (front.lo == goal.lo) & (front["at"] == goal.hi), "left_semi").where("false")
    while True:
        grown = front.join(step, front["at"] == step.a).select("lo", F.col("b").alias("at"), F.concat("path", F.array("b")).alias("path"))
        grown = grown.groupBy("lo", "at").agg(F.min("path").alias("path"))
        front = checkpointed(grown.join(known.select("lo", "at"), ["lo", "at"], "left_anti"))
        if front.isEmpty():
            break
        known = known.union(front)
        out = out.union(front.join(goal, (front.lo == goal.lo) & (front["at"] == goal.hi), "left_semi"))
    return out.select("lo", F.col("at").alias("hi"), "path")


def extend(closure: DataFrame, edges: DataFrame, new: DataFrame) -> DataFrame:
    """Closure after adding edges (lo, hi): only pairs that a new edge can carry are computed.

    closure: (lo, hi, dist) of `edges`, without reflexive pairs.
    """
    ends = new.select("lo", "hi").distinct()
    below = closure.select("lo", F.col("hi").alias("x")).union(ends.select("lo", F.col("lo").alias("x"))).distinct()
    touched = below.join(ends.select(F.col("lo").alias("x")), "x", "left_semi").select("lo").distinct()
    again = reach(edges.select("lo", "hi").union(ends), touched)
    return closure.join(touched, "lo", "left_anti").unionByName(again)


def retract(closure: DataFrame, edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Closure after removing edges: the terms below a removed edge are searched again, all others keep their pairs."""
    ends = gone.select("lo", "hi").distinct()
    left = edges.select("lo", "hi").join(ends, ["lo", "hi"], "left_anti")
    below = closure.select("lo", F.col("hi").alias("x")).union(ends.select("lo", F.col("lo").alias("x"))).distinct()
    touched = below.join(ends.select(F.col("lo").alias("x")), "x", "left_semi").select("lo").distinct()
    return closure.join(touched, "lo", "left_anti").unionByName(reach(left, touched))


def depths(parents: DataFrame, root: str = "Thing", rewrites: DataFrame | None = None) -> DataFrame:
    """(term, depth): root 0, no parents 1, else one more than the deepest parent.

    parents: (term, parent). Cycles are collapsed first: their members share one depth. rewrites: (old, new) terms that
    copy the depth of another term.
    """
    edges = parents.select(F.col("term").alias("lo"), F.col("parent").alias("hi")).where("lo is not null and hi is not null and lo <> hi").distinct()
    # what stays after peeling terms without parents, round by round, is below or on cycles; only that is searched for them
    rest = edges = checkpointed(edges)
    while True:
        inner = checkpointed(rest.join(rest.select(F.col("lo").alias("hi")).distinct(), "hi", "left_semi").join(rest.select(F.col("hi").alias("lo")).distinct(), "lo", "left_semi"))
        before, rest = rest, inner
        if rest.isEmpty() or rest.count() == before.count():
            break
    loops = checkpointed(cycles(reach(rest)).select("term", "component"))
    a, b = loops.select(F.col("term").alias("lo"), F.col("component").alias("lo_c")), loops.select(F.col("term").alias("hi"), F.col("component").alias("hi_c"))
    dag = edges.join(a, "lo", "left").join(b, "hi", "left").select(F.coalesce("lo_c", "lo").alias("lo"), F.coalesce("hi_c", "hi").alias("hi")).where("lo <> hi").distinct()
    dag = checkpointed(dag.where(F.col("lo") != root))
    # terms that nothing stands below take no part in the rounds; most terms are such
    parent = dag.select(F.col("hi").alias("lo")).distinct()
    inner, outer = checkpointed(dag.join(parent, "lo", "left_semi")), dag.join(parent, "lo", "left_anti")
    terms = parent.select(F.col("lo").alias("term")).union(edges.where((F.col("lo") == root) | (F.col("hi") == root)).select(F.lit(root).alias("term"))).distinct()
    depth = checkpointed(terms.select("term", F.when(F.col("term") == root, 0).otherwise(1).alias("depth")))
    while True:
        up = depth.select(F.col("term").alias("hi"), F.col("depth").alias("parent"))
        grown = inner.join(up, "hi").groupBy(F.col("lo").alias("term")).agg((F.max("parent") + 1).alias("more"))
        nxt = checkpointed(depth.join(grown, "term", "left").select("term", F.greatest("depth", F.coalesce("more", F.lit(0))).alias("depth"), (F.coalesce("more", F.lit(0)) > F.col("depth")).alias("__grew")))
        depth = nxt.drop("__grew")
        if nxt.where("__grew").isEmpty():
            break
    last = outer.join(depth.select(F.col("term").alias("hi"), F.col("depth").alias("parent")), "hi").groupBy(F.col("lo").alias("term")).agg((F.max("parent") + 1).alias("depth"))
    depth = checkpointed(depth.union(last))
    out = depth.join(loops.where("term <> component").select(F.col("term").alias("__t"), F.col("component").alias("term")), "term").select(F.col("__t").alias("term"), "depth").union(depth)
    if rewrites is not None:
        copies = rewrites.select("old", "new").join(out.withColumnRenamed("term", "new"), "new").select(F.col("old").alias("term"), "depth")
        out = out.join(copies.select("term"), "term", "left_anti").union(copies)
    return out
