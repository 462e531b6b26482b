"""The micro-ontologies of FIXTURES.md: states, rows and justifications."""

import pytest

from gnosia.model import edges_of
from gnosia.operators.kb import KB
from gnosia.plans.engine import Engine, QueryFault


def engine(spark, *lines, **options):
    return Engine(KB(edges_of(spark, lines), **options))


def rows(answer):
    return {tuple(r) if len(r) > 1 else r[0] for r in answer.rows.collect()}


AND = ["(genls Dog Canis)", "(genls Wolf Canis)"]


@pytest.fixture(scope="module")
def and_kb(spark):
    return engine(spark, *AND, "(isa Dog BiologicalSpecies)", "(isa Fido Dog)")


@pytest.mark.parametrize(("query", "want"), [
    ("(and (genls Dog ?X) (genls Dog ?X))", {"Dog", "Canis"}),
    ("(and (genls ?X Dog) (genls ?X Wolf))", set()),
    ("(and (genls Dog ?X) (genls Wolf ?Y))", {("Dog", "Wolf"), ("Dog", "Canis"), ("Canis", "Wolf"), ("Canis", "Canis")}),
    ("(and (genls Dog ?X) (genls Wolf ?Y) (different ?X ?Y))", {("Dog", "Wolf"), ("Dog", "Canis"), ("Canis", "Wolf")}),
    ("(and (genls Dog ?X) (genls Wolf ?Y) (equals ?X ?Y))", {("Canis", "Canis")}),
    ("(and (genls Dog ?X) (genls Wolf Canis))", {"Dog", "Canis"}),
    ("(and (isa Fido ?X) (genls Wolf ?X))", {"Canis"}),
    ("(and (isa ?X Dog) (isa ?Y Canis) (different ?X ?Y))", set()),
    ("(genls ?Y ?X)", set()),
    ("(or (genls Dog ?X) (genls Wolf ?X))", {"Dog", "Canis", "Wolf"}),
    ("(and (genls Dog ?X) (genls Wolf ??Y))", {"Dog", "Canis"}),
])
def test_and(and_kb, query, want):
    got = and_kb.query(query)
    assert rows(got) == want
    assert got.state == ("TRUE" if want else "NIL")


def test_only_comparisons_are_refused(and_kb):
    with pytest.raises(QueryFault):
        and_kb.query("(different ?X ?Y)")


def test_genls(spark):
    e = engine(spark, "(genls Dog Canis)", "(genls Canis Mammal)", "(genls Wolf Canis)", "(genls Mammal Animal)")
    assert e.query("(genls Canis Canis)").state == "TRUE"
    refuted = e.query("(genls Canis Dog)")
    assert (refuted.state, refuted.reason) == ("FALSE", "CYCLIC")
    assert e.query("(genls Canis Dog)", prove_false=False).state == "NIL"
    assert e.justify("(genls Wolf Animal)") == [(0, "genls", ("Wolf", "Canis"), 1), (0, "genls", ("Canis", "Mammal"), 1), (0, "genls", ("Mammal", "Animal"), 1)]
    assert e.query("(not (genls Wolf Animal))").state == "FALSE"
    assert e.text("(genls Nothing ?X)") == "0|NIL"
    assert e.text("(genls Dog ?X)") == "4|?X/Animal|?X/Canis|?X/Dog|?X/Mammal|"


def test_isa(spark):
    e = engine(spark, "(isa Fido Dog)", "(genls Dog Canis)", "(isa Canis BiologicalSpecies)", "(genls BiologicalSpecies Thing)", "(genls Wolf Canis)", "(isa Growls Wolf)")
    assert rows(e.query("(isa Fido ?X)")) == {"Dog", "Canis"}
    assert rows(e.query("(isa ?X Canis)")) == {"Fido", "Growls"}
    assert rows(e.query("(isa Canis ?X)")) == {"BiologicalSpecies", "Thing"}
    assert e.query("(isa Fido BiologicalSpecies)", prove_false=False).state == "NIL"
    assert e.query("(isa Dog Fido)").state == "FALSE"
    assert rows(e.query("(isa ?X Nothing)")) == set()


DISJ = [
    "(isa disjointWith SymmetricBinaryPredicate)", "(disjointWith Cat Dog)", "(isa Fido Dog)", "(genls Boxer Dog)", "(genls Dog Mammal)", "(genls Cat Mammal)", "(genls Dog Canis)", "(genls Canis Mammal)",
    "(genls Cat Fluffy)", "(isa Fido Fluffy)", "(genls Tomcat Cat)", "(genls Mammal Living)", "(genls Book NonLiving)", "(disjointWith Living NonLiving)",
]


@pytest.mark.parametrize(("query", "state"), [
    ("(disjointWith Dog Cat)", "TRUE"), ("(disjointWith Cat Dog)", "TRUE"), ("(genls Dog Cat)", "FALSE"), ("(isa Fido Cat)", "FALSE"), ("(disjointWith Boxer Cat)", "TRUE"),
    ("(disjointWith Dog Boxer)", "FALSE"), ("(disjointWith Canis Cat)", "NIL"), ("(disjointWith Mammal Fluffy)", "FALSE"), ("(disjointWith Tomcat Boxer)", "TRUE"), ("(disjointWith Tomcat Book)", "TRUE"),
])
def test_disjoint(disjoint_kb, query, state):
    assert disjoint_kb.query(query, prove_false=not query.startswith("(disjointWith")).state == state


@pytest.fixture(scope="module")
def disjoint_kb(spark):
    return engine(spark, *DISJ)


def test_disjoint_partners_and_proof(disjoint_kb):
    assert rows(disjoint_kb.query("(disjointWith Tomcat ?X)")) == {"Dog", "NonLiving"}
    assert disjoint_kb.justify("(disjointWith Tomcat Boxer)") == [(0, "genls", ("Tomcat", "Cat"), 1), (0, "disjointWith", ("Cat", "Dog"), 1), (0, "genls", ("Boxer", "Dog"), 1)]


def test_siblings(spark):
    base = ["(isa Dog S)", "(isa Cat S)", "(isa S DisjointCollectionType)", "(genls DisjointCollectionType SiblingDisjointCollectionType)", "(genls Boxer Dog)"]
    e = engine(spark, *base)
    assert e.query("(disjointWith Cat Dog)").state == "TRUE"
    assert e.query("(disjointWith Boxer Cat)", prove_false=False).state == "NIL"
    e = engine(spark, *base, "(siblingDisjointExceptions Cat Dog)")
    assert e.query("(disjointWith Dog Cat)").state == "FALSE"


def test_negation(spark):
    e = engine(spark, "(genls Boxer Dog)", "(not (genls Dog Cat))", "(genls Dog Canis)", "(genls Canis Mammal)", "(isa Fido Dog)", "(not (genls Canis Bird))", "(genls Bird Flying)")
    assert e.query("(genls Dog Cat)").state == e.query("(genls Boxer Cat)").state == "FALSE"
    assert rows(e.query("(genls Boxer ?X)")) == {"Boxer", "Dog", "Canis", "Mammal"}
    assert e.query("(isa Fido Mammal)").state == "TRUE"
    assert e.query("(isa Fido Flying)", prove_false=False).state == "NIL"
    assert e.query("(isa Fido Bird)").state == "FALSE"
    assert e.justify("(isa Fido Bird)") == [(0, "isa", ("Fido", "Dog"), 1), (0, "genls", ("Dog", "Canis"), 1), (0, "genls", ("Canis", "Bird"), -1)]
    assert e.query("(not (genls Boxer Cat))").state == "TRUE"


def test_functions(spark):
    e = engine(spark, "(resultGenl FruitFn Fruit)", "(genls Fruit Plant)", "(resultIsa FatherFn Person)", "(genls Person Thing)", "(isa SamsApple (FruitFn AppleTree))", "(resultIsaArg TheFn 1)", "(likes (TheFn Dog) Fido)")
    assert rows(e.query("(genls (FruitFn AppleTree) ?X)")) == {"Fruit", "Plant"}
    assert e.query("(isa (FatherFn Sam) Thing)").state == "TRUE"
    assert rows(e.query("(isa SamsApple ?X)")) == {"(FruitFn AppleTree)", "Fruit", "Plant"}
    assert rows(e.query("(isa (TheFn Dog) ?X)")) == {"Dog"}


def test_predicates(spark):
    e = engine(spark, "(genlPreds owns has)", "(owns Sam Fido)", "(has Sam Car)", "(not (has Sam Boat))", "(isa near SymmetricBinaryPredicate)", "(near A B)", "(likes A A)", "(removed (has Sam Bike))", "(between A B C)")
    assert rows(e.query("(has Sam ?X)")) == {"Fido", "Car"}
    assert rows(e.query("(assertedSentence (has Sam ?X))")) == {"Car"}
    assert e.query("(has Sam Boat)").state == "FALSE"
    assert e.query("(has Sam Bike)", prove_false=False).state == "NIL"
    assert rows(e.query("(near B ?X)")) == {"A"}
    assert rows(e.query("(likes ?X ?X)")) == {"A"}
    assert rows(e.query("(between A ?X ?Y)")) == {("B", "C")}
    assert e.justify("(has Sam Fido)") == [(0, "owns", ("Sam", "Fido"), 1)]


@pytest.mark.parametrize(("query", "state"), [
    ("(laterThan (YearFn 2000) (YearFn 1999))", "TRUE"), ("(laterThan (YearFn 2000) (YearFn 2000))", "FALSE"),
    ("(laterThan (MonthFn April (YearFn 2000)) (MonthFn March (YearFn 2000)))", "TRUE"), ("(laterThan (DayFn 4 (MonthFn April (YearFn 2000))) (MonthFn April (YearFn 2000)))", "FALSE"),
    ("(laterThan (MonthFn April (YearFn 2000)) (DayFn 4 (MonthFn April (YearFn 2000))))", "FALSE"), ("(laterThan Tomorrow-Indexical Today-Indexical)", "TRUE"), ("(laterThan Rock (YearFn 1999))", "FALSE"),
    ("(lessThan 3 5)", "TRUE"), ("(lessThanOrEqualTo 5 5)", "TRUE"), ("(greaterThan 3 5)", "FALSE"), ("(greaterThanOrEqualTo 5.5 5)", "TRUE"), ("(lessThan A 5)", "NIL"),
    ("(equals A A)", "TRUE"), ("(numericallyEquals 5 5.0)", "FALSE"), ("(different A B A)", "FALSE"), ("(different A B C)", "TRUE"),
])
def test_evaluatable(and_kb, query, state):
    assert and_kb.query(query).state == state


def test_options(spark):
    e = engine(spark, "(not (p A B))", strict_or=True, numeric_equals=True, now="2020-05-05T10:00:00")
    assert e.query("(or (p A B) (p A B))").state == "FALSE"
    assert e.query("(numericallyEquals 5 5.0)").state == "TRUE"
    assert e.query("(laterThan (YearFn 2021) TheYear-Indexical)").state == "TRUE"
    assert engine(spark, "(not (p A B))").query("(or (p A B) (p A B))").state == "NIL"


def test_registered_predicate(spark):
    e = engine(spark, "(p A B)")
    e.register("longer", evaluate=lambda a, kb: __import__("pyspark.sql.functions", fromlist=["length"]).length(a[0]) > __import__("pyspark.sql.functions", fromlist=["length"]).length(a[1]))
    assert e.query("(longer Abc B)").state == "TRUE"


def test_rows_are_computed_once(spark):
    """The state is asked of the rows only when somebody asks for it; edges asserted twice bind once."""
    kb = KB(edges_of(spark, ["(bought a x)", "(bought a x)", "(has x p)", "(has x p)", "(has x q)"]))
    got = Engine(kb).query("(and (bought ?A ?X) (has ?X ?P))")
    assert got._state is None
    assert sorted(map(tuple, got.rows.collect())) == [("a", "x", "p"), ("a", "x", "q")]
    assert got.state == "TRUE" and Engine(kb).query("(has y ?P)").state == "NIL"
