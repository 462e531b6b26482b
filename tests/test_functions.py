import pytest
from pyspark.sql import functions as F

from gnosia.functions import dates, text


@pytest.mark.parametrize(("given", "want"), [
    ("1987", ["(YearFn '1987)"]), ("2", ["(YearFn '2)", "(MonthFn February TheYear-Indexical)"]), ("02", ["(YearFn '2)", "(MonthFn February TheYear-Indexical)"]),
    ("February", ["(MonthFn February TheYear-Indexical)"]), ("Feb", ["(MonthFn February TheYear-Indexical)"]), ("Feb 2013", ["(MonthFn February (YearFn '2013))"]),
    ("2-2013", ["(MonthFn February (YearFn '2013))"]), ("2/2013", ["(MonthFn February (YearFn '2013))"]), ("1 February, 1479", ["(DayFn '1 (MonthFn February (YearFn '1479)))"]),
    ("Monday, 1 February, 1479", ["(DayFn '1 (MonthFn February (YearFn '1479)))"]), ("Tuesday, 1 February, 1479", []), ("31 February 2000", []), ("29 February 2000", ["(DayFn '29 (MonthFn February (YearFn '2000)))"]),
    ("", []), (None, []), ("no date", []),
])
def test_parse_date(given, want):
    assert dates.parse_date(given) == want


def test_ambiguous_date():
    assert set(dates.parse_date("1-2-1479")) == set(dates.parse_date("01-02-1479")) == {"(DayFn '1 (MonthFn February (YearFn '1479)))", "(DayFn '2 (MonthFn January (YearFn '1479)))"}


def test_intervals(spark):
    terms = ["(YearFn '2000)", "(MonthFn February (YearFn '2000))", "(DayFn '29 (MonthFn February (YearFn '2000)))", "(HourFn '5 (DayFn '1 (MonthFn May (YearFn '2001))))", "(DayFn '30 (MonthFn February (YearFn '2000)))", "Dog", "Now", "(MonthFn February TheYear-Indexical)", None]
    df = spark.createDataFrame([(t,) for t in terms], "t string").select(dates.interval(F.col("t"), "2020-01-01T00:00:00").alias("i"))
    got = [None if r.i is None else (str(r.i.start), str(r.i.end)) for r in df.collect()]
    assert got[0] == ("2000-01-01 00:00:00", "2000-12-31 23:59:59.999000") and got[1][1] == "2000-02-29 23:59:59.999000"
    assert got[2] == ("2000-02-29 00:00:00", "2000-02-29 23:59:59.999000") and got[3] == ("2001-05-01 05:00:00", "2001-05-01 05:59:59.999000")
    assert got[4:6] == [None, None] and got[6] == ("2020-01-01 00:00:00", "2020-01-01 00:00:00.001000") and got[7:] == [None, None]


NAMES = [("SamuelLJackson", "Samuel L Jackson"), ("AppleTree", "Apple Tree"), ("Dog", "Dog"), ("Sam_Jackson-Actor", "Sam Jackson (Actor)"), ("UFO", "UFO"), ("World2Day", "World 2 Day"), ("isa2", "isa 2"), ("prettyString-Canonical", "pretty String (Canonical)"), ("A-", "A-"), ("NBATeam", "NBA Team")]


def test_names(spark):
    df = spark.createDataFrame(NAMES, "t string, want string").select("t", "want", text.concept_to_text(F.col("t")).alias("got"))
    for r in df.collect():
        assert r.got == r.want == text.plain(r.t)


def test_negation(spark):
    given = ["$1 /1(is)/(are)/ big", "$1 /1(has)/(have)/ it", "$1 is big", "$1 runs"]
    want = ["$1 /1(is)/(are)/ not big", "$1 /1(does not have)/(do not have)/ it", "$1 is not big", "$1 runs is not true"]
    got = [r.n for r in spark.createDataFrame([(g,) for g in given], "t string").select(text.negate(F.col("t")).alias("n")).collect()]
    assert got == want == [text.Writer._negated(g) for g in given]


def test_writer():
    w = text.Writer({"fn": "x"}, {"isa": "$1 /1(is)/(are)/ an instance of $2", "broaderTerm": "$2 is broader than $1"})
    say = lambda e, **k: w.sentence(__import__("gnosia.plans.sexpr", fromlist=["parse"]).parse(e), **k)
    assert say("(isa2 SamuelLJackson Actor)") == "Samuel L Jackson has 'isa2' relation to Actor"
    assert say("(isa SamuelLJackson Actor)") == "Samuel L Jackson is an instance of Actor"
    assert say("(not (broaderTerm SamuelLJackson Actor))") == "Actor is not broader than Samuel L Jackson"
    assert say("(removed (isa SamuelLJackson Actor))") == "Removed: Samuel L Jackson is an instance of Actor"
    assert say("(isa ?X Actor)", query=True) == "what things are an instance of Actor?"
    assert say("(isa2 ?X Actor)", query=True) == "what things have 'isa2' relation to Actor?"
    assert say("(isa SamuelLJackson Actor)", query=True) == "is Samuel L Jackson an instance of Actor?"
    assert say("(not (isa ?X Actor))", query=True) == "what things are not an instance of Actor?"
    assert say("(and (isa ?X Actor) (isa ?X Person))", query=True) == "what things ?X are an instance of Actor AND what things ?X are an instance of Person?"
    assert w.term(("FruitFn", "AppleTree")) == "Apple Tree (Fruit)"
    assert w.term(("FruitFn", ("FermentedFn", "AppleTree"))) == "Apple Tree (Fermented, Fruit)"
    named = text.Writer({"FruitFn": "fruit of the ______"})
    assert named.term(("FruitFn", "AppleTree")) == "fruit of the Apple Tree"
    assert w.term('"Test node"') == '"Test node"' and w.term("'2") == "2" and w.term("AppleTree", markup=True) == "[[AppleTree|Apple Tree]]"
    assert w.markup("Nothing [[AppleTree|x]] here", markup=False) == "Nothing Apple Tree here"


@pytest.mark.parametrize(("given", "want"), [("Dog", "Dog"), ("A.B.C.", "ABC"), ("Cain & Abel", "CainAndAbel"), ("Schrodinger's cat", "SchrodingersCat"), ("André Benoît", "AndreBenoit"), ("!!", "ExclmExclm"), ("(what) ever", "What-Ever")])
def test_text_to_concept(given, want):
    assert text.text_to_concept(given) == want


def test_concept_column(spark):
    df = spark.createDataFrame([("Cain & Abel",), (None,)], "t string").select(text.concept_name("t").alias("c"))
    assert [r.c for r in df.collect()] == ["CainAndAbel", None]
