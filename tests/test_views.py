"""Views kept by batches, and the repairs, draws and files that go with the analytics."""

from pyspark.sql import functions as F

from gnosia.model import edges_of
from gnosia.operators import analytics, predict
from gnosia.operators.kb import KB
from gnosia.sources import files
from gnosia.streaming.incremental import Maintainer
from gnosia.streaming.views import VIEWS, chosen, register


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_views_equal_their_rebuild(spark, tmp_path):
    register("n_edges", lambda kb: kb.active.groupBy("pred").agg(F.count(F.lit(1)).alias("n")))
    try:
        assert list(chosen(["disjoint_map", "%depths"])) == ["disjoint_map"]
        m = Maintainer(spark, str(tmp_path), check=False, views=["disjoint_map", "n_edges", "%depths"])
    finally:
        VIEWS.pop("n_edges")
    m.start(edges_of(spark, ["(genls Dog Canis)", "(genls Puppy Dog)", "(genls Canis Animal)", "(disjointWith Dog Cat)", "(resultGenl CubFn Animal)", "(owns Sam (CubFn Wolf))", "(disjointWith Animal Stone)"]))
    batches = [
        ["(genls Wolf Canis)", "(genls Kitten Cat)", "(owns Ann (CubFn Dog))", "(not (disjointWith Puppy Wolf))"],
        ["(removed (genls Canis Animal))", "(removed (disjointWith Dog Cat))"],
        ["(resultGenl CubFn Young)", "(disjointWith Young Cat)"],
    ]
    for i, lines in enumerate(batches):
        m.apply(edges_of(spark, lines).withColumn("edge_id", F.col("edge_id") + 100 * (i + 1)), i)
        kb = KB(m.edges())
        assert rows(m.view("disjoint_map").select("term", "axiom_term", "sign")) == rows(kb.disjoint_map().select("term", "axiom_term", "sign"))
        assert rows(m.view("n_edges")) == rows(kb.active.groupBy("pred").count())


def test_overlap_needs_one_term_of_each_kind(spark):
    lines = [f"(isa X{i} {c})" for i in range(6) for c in (("A", "B") if i % 2 else ("B",))] + ["(isa Y C)", "(genls D C)", "(genls D E)"]
    pairs = spark.createDataFrame([("A", "B"), ("A", "C"), ("C", "E"), ("B", "E"), ("Nowhere", "A")], "a string, b string")
    assert rows(KB(edges_of(spark, lines)).overlapping(pairs)) == {("A", "B"), ("C", "E")}


def test_siblings(spark):
    lines = ["(isa Kinds SiblingDisjointCollectionType)", "(isa Red Kinds)", "(isa Blue Kinds)", "(isa Pink Kinds)", "(siblingDisjointExceptions Red Pink)"]
    kb = KB(edges_of(spark, lines))
    pairs = spark.createDataFrame([("Red", "Blue"), ("Red", "Pink"), ("Red", "Red"), ("Red", "Other")], "a string, b string")
    assert rows(kb.prove_disjoint(pairs)) == {("Red", "Blue", "TRUE"), ("Red", "Pink", "FALSE"), ("Red", "Red", "FALSE"), ("Red", "Other", "NIL")}
    assert rows(kb.disjoint_partners(spark.createDataFrame([("Red",)], "term string"))) == {("Red", "Blue")}


def test_impose_with_coercion(spark):
    lines = ["(isa X Film)", "(isa Z Song)", "(isa Rock Stone)", "(disjointWith Stone Film)", "(saw A X)", "(saw B Z)", "(saw C Rock)", "(ate D Rock)"]
    refined = spark.createDataFrame([("saw", 2, "Film"), ("ate", 2, "Film")], "pred string, pos int, type string")
    left = analytics.impose(KB(edges_of(spark, lines)), refined, coerce=True)
    got = {(r.pred, *r.args) for r in left.collect()}
    assert {t for t in got if t[0] in ("saw", "ate")} == {("saw", "A", "X"), ("saw", "B", "Z")}
    assert ("isa", "Z", "Film") in got and {t[1] for t in got if t[0] == "argIsa"} == {"saw"}


def test_draws_and_classes(spark):
    kb = KB(edges_of(spark, ["(genls A Top)", "(genls B Top)", "(disjointWith A B)", "(isa x A)", "(isa x Top)", "(isa y B)"]))
    drawn = analytics.base_rate(kb, n=3, draws=5).collect()
    assert {r.draw for r in drawn} <= set(range(5)) and all(r.n <= 3 for r in drawn) and drawn
    pairs = spark.createDataFrame([("r", "x", "y"), ("r", "x", "B"), ("r", "x", "A"), ("r", "nobody", "A")], "relation string, disamb1 string, disamb2 string")
    assert rows(files.to_classes(kb, pairs)) == {("r", "A", "B")}


def test_feature_file_and_score(spark, tmp_path):
    data = [("it's, a r", "a", "b", 0.5, None, "disjoint"), ("q", "x", "y", None, 2.0, "unknown")]
    df = spark.createDataFrame(data, "relation string, disamb1 string, disamb2 string, semantic_similarity double, depth_1 double, class string")
    for n, t in files.ATTRIBUTES:
        if n not in df.columns:
            df = df.withColumn(n, F.lit(None).cast("string" if t == "string" else "double"))
    text = files.arff_header() + "% note\n" + "\n".join(r.value for r in files.arff_lines(df).collect()) + "\n"
    (tmp_path / "f.arff").write_text(text)
    got = files.read_arff(spark, str(tmp_path / "f.arff"))
    assert got.columns == [n for n, _ in files.ATTRIBUTES]
    assert rows(got.select("relation", "disamb1", "disamb2", "semantic_similarity", "depth_1", "class")) == {("it's, a r", "a", "b", 0.5, None, "disjoint"), ("q", "x", "y", None, 2.0, None)}
    known = [("r", f"a{i}", "b", 0.9 if i % 2 else 0.1, "conjoint" if i % 2 else "disjoint") for i in range(20)]
    train = spark.createDataFrame(known, "relation string, disamb1 string, disamb2 string, semantic_similarity double, class string")
    for c in predict.NUMERIC:
        if c not in train.columns:
            train = train.withColumn(c, F.lit(None).cast("double"))
    path = str(tmp_path / "model")
    predict.save(predict.train(train), path)
    asked = spark.createDataFrame([("a0", "b"), ("a1", "b"), ("no", "where")], "disamb1 string, disamb2 string")
    scores = {r.disamb1: (r.score, r.state) for r in predict.classify(predict.load(path), train, pairs=asked).collect()}
    assert scores == {"a0": (1.0, "TRUE"), "a1": (0.0, "NIL"), "no": (-1.0, "NIL")}
