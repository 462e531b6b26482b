import pytest
from hypothesis import given
from hypothesis import strategies as st

from gnosia.plans import sexpr


def test_parse_and_text():
    got = sexpr.parse('(isa  #$Fido (FruitFn AppleTree) 5 "a (b) \\" c" ?X)')
    assert got == ("isa", "Fido", ("FruitFn", "AppleTree"), "'5", '"a (b) \\" c"', "?X")
    assert sexpr.text(got) == '(isa Fido (FruitFn AppleTree) \'5 "a (b) \\" c" ?X)'
    assert sexpr.variables(got) == ["?X"]


@pytest.mark.parametrize("bad", ["", "(", ")", "(a))", "(a) b", "()", '("a)'])
def test_faults(bad):
    with pytest.raises(sexpr.SyntaxFault):
        sexpr.parse(bad)


def test_unwrap_and_paths():
    assert sexpr.unwrap(sexpr.parse("(not (removed (isa A B)))")) == (("isa", "A", "B"), -1, True)
    assert sexpr.paths(sexpr.parse("(isa A (F B (G C)))")) == [("1", 0, "isa"), ("2", 0, "A"), ("3", 0, "(F B (G C))"), ("3F1", 1, "F"), ("3F2", 1, "B"), ("3F3", 1, "(G C)"), ("3F3F1", 2, "G"), ("3F3F2", 2, "C")]


def test_substitute():
    e = sexpr.parse("(and (isa ?X Dog) (isa ?X (F ?Y)))")
    assert sexpr.text(sexpr.substitute(e, {"?X": "Fido", "?Y": "A"})) == "(and (isa Fido Dog) (isa Fido (F A)))"
    assert sexpr.invert({"?X": "?Y"}) == {"?Y": "?X"}


names = st.from_regex(r"[A-Za-z][A-Za-z0-9_:-]{0,6}", fullmatch=True)


@given(st.recursive(names, lambda x: st.lists(x, min_size=1, max_size=4).map(tuple), max_leaves=12))
def test_round_trip(expr):
    assert sexpr.parse(sexpr.text(expr)) == expr
