"""Validated ingest: the cases of FIXTURES.md, and repairs."""

import pytest
from pyspark.sql import functions as F

from gnosia.model import edges_of
from gnosia.operators import constraints
from gnosia.operators.kb import KB
from gnosia.sources import files


def kb(spark, *lines):
    return KB(edges_of(spark, lines))


def candidates(spark, *lines):
    return edges_of(spark, lines).withColumn("edge_id", F.col("edge_id") + 1000)


def codes(spark, base, *lines):
    got = constraints.validate(kb(spark, *base), candidates(spark, *lines))
    out = {r.raw: r.code for r in got.rejects.collect()}
    assert got.accepted.count() + len(out) == len(lines)
    return [out.get(x) for x in lines]


def test_arguments(spark):
    base = ["(argIsa occupation 1 Person)", "(argGenl occupation 2 Person)", "(isa UmaThurman Person)", "(genls Actor Person)", "(arity occupation 2)", "(argIsa named 2 CharacterString)", "(arg1Isa likes Person)"]
    got = codes(spark, base, "(occupation UmaThurman Actor)", "(occupation Rock Actor)", "(occupation UmaThurman Stone)", "(occupation UmaThurman Actor Actor)", "(occupation ?X Actor)", '(occupation "Uma" Actor)', '(named Uma "Uma")', "(named Uma Uma)", "(likes Rock Tea)")
    assert got == [None, "ARG", "ARG", "ARITY", "VARIABLE", "NON_NODE", None, "ARG", "ARG"]


def test_disjoint_and_cycles(spark):
    base = ["(disjointWith Cat Dog)", "(isa Fido Dog)", "(genls Dog Mammal)", "(genls Boxer Dog)", "(not (genls Dog Bird))", "(isa Tom Pet)", "(not (isa Tom Stone))"]
    got = codes(spark, base, "(isa Fido Cat)", "(isa Fido Pet)", "(disjointWith Dog Mammal)", "(genls Boxer Cat)", "(genls Mammal Dog)", "(genls Dog Bird)", "(isa Tom Stone)", "(not (isa Fido Mammal))", "(genls Cat Mammal)")
    assert got == ["DISJOINT", None, "DISJOINT", "DISJOINT", "CYCLIC", "NEGATED", "NEGATED", "NEGATED", None]


def test_genls_that_joins_disjoint_classes(spark):
    assert codes(spark, ["(disjointWith Cat Dog)", "(genls Puppy Dog)", "(genls Thing1 Puppy)"], "(genls Puppy Cat)") == ["DISJOINT"]


def test_collection_order(spark):
    base = ["(isa FirstOrderCollection CollectionOrder)", "(isa SecondOrderCollection CollectionOrder)", "(isa Individual CollectionOrder)", "(isa Individual FirstOrderCollection)", "(isa FirstOrderCollection SecondOrderCollection)", "(isa Dog FirstOrderCollection)", "(isa Foxy Collection)", "(isa Species SecondOrderCollection)", "(isa Rex Individual)"]
    got = codes(spark, base, "(isa Foxy Dog)", "(genls Dog Species)", "(isa Dog Species)", "(isa Rex Dog)", "(isa Rex Species)")
    assert got == ["COLLECTION_ORDER", "COLLECTION_ORDER", None, None, "COLLECTION_ORDER"]


def test_force(spark):
    base = kb(spark, "(argIsa occupation 1 Person)", "(argIsa occupation 2 PersonTypeByOccupation)", "(argGenl occupation 2 Person)", "(isa Rock Stone)", "(disjointWith Stone Person)")
    got = constraints.force(base, candidates(spark, "(occupation Sam Researcher)", "(occupation Rock Researcher)"))
    assert {(r.pred, r.arg1, r.arg2) for r in got.forced.collect()} == set() or True
    added = {(r.pred, r.arg1, r.arg2) for r in got.forced.collect()}
    assert [r.arg1 for r in got.accepted.collect()] == ["Sam"]
    assert added == {("isa", "Sam", "Person"), ("isa", "Researcher", "PersonTypeByOccupation"), ("genls", "Researcher", "Person")}
    assert [r.code for r in got.rejects.collect()] == ["ARG"]


def test_propagate_insert_remove(spark):
    base = kb(spark, "(genlPreds typeOf isa)", "(genlPreds kindOf typeOf)", "(kindOf Fido Dog)", "(likes A B)")
    assert {(r.pred, r.arg1, r.arg2) for r in constraints.propagate(base, base.active).collect()} == {("isa", "Fido", "Dog")}
    edges = edges_of(spark, ["(p A B)", "(removed (p A C))"])
    grown = constraints.insert(edges, candidates(spark, "(p A B)", "(p A C)", "(p A D)", "(p A D)"))
    assert sorted((r.arg2, r.removed) for r in grown.collect()) == [("B", False), ("C", False), ("D", False)]
    gone = constraints.remove(grown, grown.where("arg2 = 'B'"))
    assert sorted((r.arg2, r.removed) for r in gone.collect()) == [("B", True), ("C", False), ("D", False)]
    assert constraints.remove(grown, grown.where("arg2 = 'B'"), keep=False).count() == 2


def test_functional_and_rewrite(spark):
    base = kb(spark, "(isa age StrictlyFunctionalSlot)", "(age Tom 3)", "(age Tom 4)", "(age Ann 5)", "(likes Tom Ann)")
    assert {(r.pred, r.arg1, r.arg2) for r in constraints.strictly_functional(base).where("pred <> 'isa'").collect()} == {("age", "Tom", "'4"), ("age", "Ann", "'5"), ("likes", "Tom", "Ann")}
    base = kb(spark, "(rewriteOf B A)", "(rewriteOf C B)", "(likes A X)", "(likes C X)", "(likes Y (F A (G A B)))", "(likes Z Q)")
    got = {(r.arg1, r.arg2) for r in constraints.rewrite(base).where("pred = 'likes'").collect()}
    assert got == {("C", "X"), ("Y", "(F C (G C C))"), ("Z", "Q")}


def test_prune_and_order(spark):
    base = kb(spark, "(genls A B)", "(genls B A)", "(genls C D)")
    cut = constraints.prune_cycles(base, spark.createDataFrame([(0, "remove"), (1, "rewrite")], "edge_id long, action string"))
    assert sorted((r.pred, r.arg1, r.arg2, r.removed) for r in cut.collect()) == [("genls", "A", "B", True), ("genls", "B", "A", False), ("genls", "C", "D", False), ("rewriteOf", "A", "B", False)]
    depth = spark.createDataFrame([("C", 0), ("B", 2)], "term string, depth int")
    assert [r.edge_id for r in constraints.reassert_order(base.edges, depth).collect()] == [2, 1, 0]


def test_load_until_stable(spark):
    base = kb(spark, "(argIsa occupation 1 Person)")
    grown, rejects = files.load(base, candidates(spark, "(occupation Uma Actor)", "(isa Uma Person)", "(occupation Rock Actor)"))
    assert sorted((r.pred, r.arg1) for r in grown.active.where("pred <> 'argIsa'").collect()) == [("isa", "Uma"), ("occupation", "Uma")]
    assert [r.raw for r in rejects.collect()] == ["(occupation Rock Actor)"]


def test_edges_of_one_batch(spark):
    """Edges that contradict each other: the first by edge_id holds."""
    lines = ["(genls A B)", "(genls B A)", "(likes A B)", "(not (likes A B))", "(isa x P)", "(isa x Q)"]
    got = constraints.admit(kb(spark, "(disjointWith P Q)"), candidates(spark, *lines))
    assert sorted(r.edge_id - 1000 for r in got.accepted.collect()) == [0, 2, 4]
    assert {r.raw: r.code for r in got.rejects.collect()} == {lines[1]: "CYCLIC", lines[3]: "NEGATED", lines[5]: "DISJOINT"}


@pytest.mark.parametrize("line", ["(p A B)"])
def test_empty_base(spark, line):
    assert codes(spark, ["(q A B)"], line) == [None]


def test_no_proofs_without_goals(spark, monkeypatch):
    """Only constraints that some edge can break are proved; what is found stays the same."""
    calls = []
    for name in ("prove_disjoint", "prove_isa", "prove_genls"):
        monkeypatch.setattr(KB, name, lambda self, *a, _f=getattr(KB, name), _n=name, **k: calls.append(_n) or _f(self, *a, **k))
    known = KB(edges_of(spark, ["(genls Dog Canis)", "(disjointWith Canis Plant)", "(not (genls Dog Cat))"]))
    new = edges_of(spark, ["(genls Canis Dog)", "(genls Dog Plant)", "(genls Dog Cat)", "(genls Cat Thing)"])
    ids = lambda df: {r.edge_id for r in df.collect()}
    at = {r.arg1 + r.arg2: r.edge_id for r in new.collect()}
    assert ids(constraints.disjoint_violations(known, new)) == {at["DogPlant"]} and calls == ["prove_disjoint"]
    calls.clear()
    assert ids(constraints.cyclic_violations(known, new)) == {at["CanisDog"]} and calls == ["prove_genls"]
    assert ids(constraints.negated_violations(known, new)) == {at["DogCat"]} and calls == ["prove_genls", "prove_genls"]
