import pytest
from pyspark.sql import functions as F

from gnosia.operators import closure as C

TAX = [("Dog", "Thing"), ("Dog", "Canis"), ("Dog", "Pet"), ("Cat", "Pet"), ("Pet", "Thing"), ("Canis", "Mammal"), ("Plant", "Thing"), ("Cat", "Fluffy"), ("Mammal", "Thing"), ("Cat", "Mammal")]


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "lo string, hi string")


def as_set(df):
    return {tuple(r) for r in df.collect()}


@pytest.mark.parametrize("how", [{}, {"small": 0}, {"small": 0, "doubling": True}])
def test_taxonomy(spark, how):
    got = C.reach(frame(spark, TAX), **how)
    up = lambda t: {r.hi for r in got.where(F.col("lo") == t).collect()}
    assert up("Dog") == {"Canis", "Mammal", "Pet", "Thing"}
    assert {r.lo for r in got.where("hi = 'Mammal'").collect()} == {"Canis", "Dog", "Cat"}
    assert got.where("lo = 'Dog' and hi = 'Thing'").first().dist == 1
    assert got.where("lo = 'Canis' and hi = 'Thing'").first().dist == 2


@pytest.mark.parametrize("how", [{}, {"small": 0}, {"small": 0, "doubling": True}])
def test_cycle_and_ties(spark, how):
    got = C.reach(frame(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d"), ("a", "b"), (None, "x"), ("x", None)]), **how)
    assert ("a", "a", 3) in as_set(got) and ("d", "d", 1) in as_set(got)
    assert len(as_set(got)) == got.count()
    assert {(r.term, r.component) for r in C.cycles(got).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d")}


def test_empty(spark):
    assert C.reach(frame(spark, [])).count() == 0
    assert C.reach(frame(spark, []), small=0).count() == 0


def test_long_chain(spark):
    n = 1000
    got = C.reach(frame(spark, [(f"b{i:04}", f"b{i + 1:04}") for i in range(n)] + [("a", f"b{i:04}") for i in range(n)]), spark.createDataFrame([("a",)], "lo string"))
    assert got.count() == n + 1


def test_extend_and_retract(spark):
    edges = frame(spark, TAX)
    base = C.reach(edges)
    more = frame(spark, [("Canis", "Fluffy")])
    assert as_set(C.extend(base, edges, more)) == as_set(C.reach(edges.union(more)))
    gone = frame(spark, [("Dog", "Canis")])
    assert as_set(C.retract(base, edges, gone)) == as_set(C.reach(frame(spark, [p for p in TAX if p != ("Dog", "Canis")])))


def test_minimal_and_maximal(spark):
    strict = C.reach(frame(spark, TAX))
    members = spark.createDataFrame([(1, "Dog"), (1, "Canis"), (1, "Pet"), (2, "Thing"), (2, "Mammal")], "g int, term string")
    assert as_set(C.minimal(members, strict, ["g"])) == {(1, "Dog"), (2, "Mammal")}
    assert as_set(C.maximal(members, strict, ["g"])) == {(1, "Canis"), (1, "Pet"), (2, "Thing")}


def test_depths(spark):
    parents = spark.createDataFrame(TAX + [("x", "y"), ("y", "x"), ("x", "Thing"), ("Alone", "Root")], "term string, parent string")
    got = {r.term: r.depth for r in C.depths(parents).collect()}
    assert (got["Thing"], got["Pet"], got["Mammal"], got["Canis"], got["Dog"], got["Cat"]) == (0, 1, 1, 2, 3, 2)
    assert got["x"] == got["y"] == 1 and (got["Root"], got["Alone"], got["Fluffy"]) == (1, 2, 1)


def test_paths(spark):
    got = C.path_justifications(frame(spark, TAX), frame(spark, [("Dog", "Mammal"), ("Cat", "Thing"), ("Plant", "Pet")]))
    assert {(r.lo, r.hi, tuple(r.path)) for r in got.collect()} == {("Dog", "Mammal", ("Dog", "Canis", "Mammal")), ("Cat", "Thing", ("Cat", "Mammal", "Thing"))}


def test_chain_beyond_the_broadcast(spark):
    n = 40
    chain = [(f"b{i:04}", f"b{i + 1:04}") for i in range(n)] + [(f"leaf{i}", "b0000") for i in range(3)] + [("b0010", "b0020")]
    want = as_set(C.reach(frame(spark, chain)))
    rounds = []
    written = C.checkpointed
    C.checkpointed = lambda df: rounds.append(1) or written(df)
    try:
        assert as_set(C.reach(frame(spark, chain), small=0)) == want
    finally:
        C.checkpointed = written
    assert len(rounds) <= 9  # one for each level before
    seeds = spark.createDataFrame([("b0002",), ("leaf1",), ("nowhere",)], "lo string")
    assert as_set(C.reach(frame(spark, chain), seeds, small=0)) == {r for r in want if r[0] in ("b0002", "leaf1")}
    # 44 edges, 41 of them from terms that others lead to
    assert as_set(C.reach(frame(spark, chain), small=41)) == want
    assert as_set(C.reach(frame(spark, chain), seeds, small=41)) == {r for r in want if r[0] in ("b0002", "leaf1")}


def test_extremes_look_upwards(spark):
    """The join is with what is above the members, not with all that is below a root."""
    below = spark.createDataFrame([(f"x{i}", "Thing", 1) for i in range(1000)] + [("Dog", "Thing", 2), ("Canis", "Thing", 1), ("Dog", "Canis", 1)], "lo string, hi string, dist int")
    members = spark.createDataFrame([(g, t) for g in range(50) for t in ("Thing", "Canis", "Dog")], "g int, term string")
    for extreme, want in ((C.minimal, "Dog"), (C.maximal, "Thing")):
        out = extreme(members, below, ["g"])
        assert max(_rows_of_joins(out)) <= 50 * 3
        assert as_set(out) == {(g, want) for g in range(50)}


def _rows_of_joins(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()

    def walk(p):
        if "Join" in p.nodeName():
            yield p.metrics().apply("numOutputRows").value()
        for i in range(p.children().size()):
            yield from walk(p.children().apply(i))

    return list(walk(plan))
