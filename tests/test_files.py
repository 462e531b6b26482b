from pyspark.sql import functions as F

from gnosia import model
from gnosia.model import edges_of
from gnosia.operators import analytics, predict, scan
from gnosia.operators.kb import KB
from gnosia.sources import files
from gnosia.streaming.incremental import Maintainer


def test_read_and_write(spark, tmp_path):
    lines = ["(isa #$Fido #$Dog)\tBaseMt", "(not (isa Fido Cat))", '(comment Dog "a (b) dog")', "(likes (MotherFn Fido) 5)", "(isa A B)\tx\ty", "(NIL A B)", "(broken", "(isa Fido Dog)", "(age Tom 3.5)"]
    (tmp_path / "in.txt").write_text("\n".join(lines))
    edges, rejects = files.read_assertions(spark, str(tmp_path / "in.txt"))
    assert {(r.pred, tuple(r.args), r.sign, r.mt) for r in edges.collect()} - {("isa", ("Fido", "Dog"), 1, None), ("isa", ("Fido", "Dog"), 1, "BaseMt")} == {
        ("isa", ("Fido", "Cat"), -1, None), ("comment", ("Dog", '"a (b) dog"'), 1, None), ("likes", ("(MotherFn Fido)", "'5"), 1, None), ("age", ("Tom", "'3.5"), 1, None),
    }
    assert edges.count() == 5
    assert sorted(r.code.split(":")[0] for r in rejects.collect()) == ["FIELDS", "NIL", "SYNTAX"]
    files.write_assertions(edges, str(tmp_path / "out"))
    again, none = files.read_assertions(spark, str(tmp_path / "out"))
    key = lambda df: {(r.pred, tuple(r.args), r.sign, r.mt) for r in df.collect()}
    assert key(again) == key(edges) and none.count() == 0


def test_csv(spark, tmp_path):
    edges = edges_of(spark, ["(isa A (F (G B)))", "(isa C (F (G B)))", "(likes A B)", "(not (isa A B))", "(genls B C)"])
    rows, functions = files.csv_tables(edges)
    names = {r.term: r.name for r in functions.collect()}
    assert set(names) == {"(F (G B))", "(G B)"} and sorted(names.values()) == ["FUNCTION_1", "FUNCTION_2"]
    assert sorted((r.pred, r.arg1, r.arg2) for r in rows.collect()) == sorted([("isa", "A", names["(F (G B))"]), ("isa", "C", names["(F (G B))"]), ("genls", "B", "C")])
    files.write_csv(edges, str(tmp_path / "csv"), all_predicates=True)
    assert spark.read.csv(str(tmp_path / "csv" / "edges")).count() == 4


def test_comments(spark):
    edges = edges_of(spark, ['(comment Dog "A #$Dog is a #$Mammals, see (#$isa #$Fido #$Dog). #$Unknowns"', "(isa Dog X)"][0:0] or ['(comment Dog "A #$Dog is a #$Mammals, see (#$isa #$Fido #$Dog). #$Unknowns")', "(isa Dog X)"])
    known = spark.createDataFrame([("Dog",), ("Mammal",)], "term string")
    got = files.clean_comment(edges, known).where("pred = 'comment'").first()
    assert got.arg2 == '"A [[Dog]] is a [[Mammal]], see <code>(isa Fido Dog)</code>. [[Unknowns]]"' and got.args[1] == got.arg2


def test_concept_dumps(spark, tmp_path):
    raw = ["/a/[/r/IsA/,/c/en/dog/,/c/en/pet/]\t/r/IsA\t/c/en/dog/n/x\t/c/en/pet\t/ctx/all\t1.0\tsource", "nonsense", "/a/[x]\t/r/AtLocation\t/c/en/cat\t/c/en/house\t/ctx/all\t2.5\ts"]
    (tmp_path / "dump.tsv").write_text("\n".join(raw))
    triples = files.read_concept_dump(spark, str(tmp_path / "dump.tsv"))
    assert {tuple(r) for r in triples.collect()} == {("IsA", "dog", "pet"), ("AtLocation", "cat", "house")}
    files.write_parsed(triples, str(tmp_path / "parsed"))
    assert (tmp_path / "parsed" / "relation=IsA").exists()
    (tmp_path / "t.tsv").write_text("IsA\tdog\tpet\n")
    assert [tuple(r) for r in files.read_parsed(spark, str(tmp_path / "t.tsv")).collect()] == [("IsA", "dog", "pet")]
    (tmp_path / "n.tsv").write_text("Entity\tRelation\tValue\tAction\na\tr\tb\t+\nc\tr\td\t-\n")
    assert [tuple(r) for r in files.read_header_tsv(spark, str(tmp_path / "n.tsv")).collect()] == [("r", "a", "b")]
    y = spark.createDataFrame([("<New_York_(city)>\t<isIn>\t<USA,_North> .",), ("# x",)], "value string")
    assert [tuple(r) for r in files.bracket_triples(y).collect()] == [("isIn", "New York", "USA")]


def test_aliases_and_senses(spark):
    kb = KB(edges_of(spark, ['(termStrings Dog "hound")', '(not (termStrings Dog "cat"))', "(isa Fido Dog)", "(genls HouseCat Pet)"]))
    texts = spark.createDataFrame([("HOUND",), ("house cat",), ("cat",), ("1-2-1479",)], "text string")
    got = {(r.text, r.term) for r in files.find_nodes(kb, texts).collect()}
    assert got == {("HOUND", "Dog"), ("house cat", "HouseCat"), ("1-2-1479", "(DayFn '1 (MonthFn February (YearFn '1479)))"), ("1-2-1479", "(DayFn '2 (MonthFn January (YearFn '1479)))")}
    triples = spark.createDataFrame([("likes", "puppy", "house_cat"), ("IsA", "puppy", "hound"), ("likes", "hound", "hound")], "relation string, first string, second string")
    assert {(r.relation, r.disamb1, r.disamb2) for r in files.sense_pairs(kb, triples).collect()} == {("likes", "Dog", "HouseCat")}


def test_positional_scan(spark):
    edges = edges_of(spark, ["(isa Dog Species)", "(genls Dog Canis)", "(likes Fido (MotherFn Dog 3))", "(not (genls Dog Cat))", "(near A B)"])
    count = lambda *c: scan.find(edges, list(c)).count()
    assert count(("Dog", None)) == 4 and count(("Dog", "2")) == 3 and count(("Dog", "F")) == 1 and count(("Dog", "-F")) == 3
    assert count(("Dog", None), ("isa", "-1"), ("likes", "-1")) == 2
    assert count(("Dog", "!3")) == 3 and count(("Dog", "3F2")) == 1 and count(("'3", "3F3")) == 1 and count(("'4", "3F3")) == 0
    assert scan.find_text(edges, "Dog (2) isa (-1)").count() == 2
    index = model.positions(edges)
    assert scan.functional_terms(index, "MotherFn").first().term == "(MotherFn Dog '3)"
    assert scan.inside_functions(index, "Dog").count() == 1 and scan.inside_functions(index, "Dog", only=False).count() == 3
    assert files.random_edges(edges, 2, seed=1, functions=False).count() == 2
    kinds = {r.term: r.kind for r in model.nodes(edges).collect()}
    assert kinds["Dog"] == "constant" and kinds["(MotherFn Dog '3)"] == "function" and kinds["'3"] == "num"


def test_incremental_equals_batch(spark, tmp_path):
    first = edges_of(spark, ["(genls Dog Canis)", "(genls Canis Mammal)", "(genls Cat Mammal)", "(disjointWith Cat Dog)"])
    m = Maintainer(spark, str(tmp_path / "kb"))
    m.start(first)
    src = tmp_path / "in"
    edges_of(spark, ["(genls Mammal Animal)", "(genls Puppy Dog)", "(genls Animal Dog)"]).withColumn("edge_id", F.col("edge_id") + 100).coalesce(1).write.parquet(str(src / "a"))
    m.stream(str(src / "*"), str(tmp_path / "cp")).awaitTermination(120)
    edges_of(spark, ["(removed (genls Canis Mammal))", "(isa Fido Puppy)"]).withColumn("edge_id", F.col("edge_id") + 200).coalesce(1).write.parquet(str(src / "b"))
    m.stream(str(src / "*"), str(tmp_path / "cp")).awaitTermination(120)
    assert m.version == 2
    kb = KB(m.edges())
    want = {(r.lo, r.hi, r.dist) for r in kb.strict("genls", up=False).collect()}
    assert {tuple(r) for r in m.closure().collect()} == want
    assert ("Puppy", "Canis", 2) in want and ("Canis", "Mammal", 1) not in want and ("Cat", "Animal", 2) in want


def test_predictor(spark):
    rows = [("r", f"a{i}", f"b{i}", 0.9 if i % 2 else 0.1, "conjoint" if i % 2 else "disjoint") for i in range(20)] + [("q", "x", "y", 0.05, "unknown")]
    df = spark.createDataFrame(rows, "relation string, disamb1 string, disamb2 string, semantic_similarity double, class string")
    for c in predict.NUMERIC:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("double"))
    fitted = predict.train(df)
    got = {(r.disamb1, r.disamb2): r.state for r in predict.classify(fitted, df).collect()}
    assert got["a0", "b0"] == "TRUE" and got["a1", "b1"] == "NIL" and got["x", "y"] == "TRUE"
    assert files.arff_header().count("@ATTRIBUTE") == 24
    for n, t in files.ATTRIBUTES:
        if n not in df.columns:
            df = df.withColumn(n, F.lit(None).cast("string" if t == "string" else "double"))
    assert files.arff_lines(df.where("class = 'unknown'")).first().value.endswith(",?")


def test_analytics_small(spark):
    kb = KB(edges_of(spark, ["(genls Dog Canis)", "(genls Wolf Canis)", "(genls Cat Felid)", "(isa Fido Dog)", "(disjointWith Dog Cat)", '(comment Dog "x")', '(termStrings Dog "hound")', '(prettyString-Canonical Wolf "grey wolf")', "(owns Sam (KennelFn Fido))", "(isa lonely Nothing)"]))
    c = {r.term: r for r in analytics.collections(kb).collect()}
    assert (c["Canis"].n_sub, c["Canis"].n_instances, c["Dog"].n_super, c["Dog"].has_comment, c["Dog"].has_alias, c["Wolf"].has_alias) == (2, 1, 1, True, True, True)
    pairs = spark.createDataFrame([("Dog", "Wolf"), ("Dog", "Dog"), ("Nowhere", "Neither"), ("Dog", "Cat")], "a string, b string")
    sim = {(r.a, r.b): r.similarity for r in analytics.similarity_of(kb, pairs).collect()}
    assert sim["Dog", "Wolf"] == 1 / 3 and sim["Dog", "Dog"] == 1 and sim["Nowhere", "Neither"] != sim["Nowhere", "Neither"] and sim["Dog", "Cat"] == 0
    names = {r.term: r.name for r in analytics.names(kb).collect()}
    assert names["Dog"] == "hound" and names["Wolf"] == "grey wolf" and names["Felid"] == "Felid"
    slots = spark.createDataFrame([(1, 0, "Dog"), (1, 0, "Wolf"), (1, 1, "Cat"), (1, 1, "Felid")], "request int, slot int, term string")
    groups = {}
    for r in analytics.disambiguate(kb, slots).collect():
        groups.setdefault(r.group, set()).add(r.term)
    assert {frozenset(g) for g in groups.values()} == {frozenset({"Dog", "Felid"}), frozenset({"Wolf", "Cat"}), frozenset({"Cat", "Wolf"}), frozenset({"Felid", "Dog"})}
    by = {r.pred: r.n for r in analytics.edges_by_predicate(kb, "Dog", "O").collect()}
    assert by == {"genls": 1, "isa": 1, "disjointWith": 1, "comment": 1, "termStrings": 1}
    parents = {(r.a, r.b, r.parent) for r in analytics.common_parents(kb, pairs.limit(1)).collect()}
    assert parents == {("Dog", "Wolf", "Canis")}


def test_refinement_and_resolution(spark):
    lines = ["(isa A Person)", "(isa B Person)", "(isa C Person)", "(genls Person Animal)", "(isa X Film)", "(isa Y Film)", "(isa Z Song)", "(saw A X)", "(saw B Y)", "(saw C Z)", "(genlPreds heard saw)", "(argIsa heard 2 Song)", "(argIsa saw 1 Person)"]
    kb = KB(edges_of(spark, lines))
    preds = spark.createDataFrame([("saw",)], "pred string")
    assert {(r.pos, r.type) for r in analytics.refine(kb, preds, 0.9).collect()} == {(1, "Person")}
    assert {(r.pos, r.type) for r in analytics.refine(kb, preds, 0.6).collect()} == {(1, "Person"), (2, "Film")}
    left = analytics.impose(kb, spark.createDataFrame([("saw", 2, "Film")], "pred string, pos int, type string"))
    assert sorted(r.arg2 for r in left.where("pred = 'saw'").collect()) == ["X", "Y"]
    scores = {r.pred: r.score for r in analytics.resolve_predicate(kb, "saw", ["A", "Z"]).collect()}
    assert scores["saw"] > scores["heard"] > 0 and abs(sum(scores.values()) - 1) < 1e-9


def test_bubble_up(spark):
    lines = [f"(genls S{i} Top)" for i in range(12)] + [f"(disjointWith S{i} Target)" for i in range(6)]
    got = analytics.bubble_up(KB(edges_of(spark, lines))).collect()
    assert [(r.parent, r.target, r.n, r.n_disjoint) for r in got] == [("Top", "Target", 12, 6)]


def test_seed(spark):
    from gnosia.plans.engine import Engine
    from gnosia.sources.seed import assertions, seed

    edges = seed(spark)
    assert edges.count() == len(assertions()) == edges.select("edge_id").distinct().count()
    e = Engine(KB(edges))
    assert e.query("(isa isa Relation)", prove_false=False).state == "TRUE"
    assert e.query("(isa (YearFn 1987) Date)", prove_false=False).state == "TRUE"
    assert e.query("(laterThan Rock 5)").state == "NIL"


def test_evidence_counts_kinds_not_types(spark, monkeypatch):
    """Edges meet the kinds of their terms, one for each, and never all types of their terms."""
    lines = [f"(genls C{i} C{i + 1})" for i in range(10)] + [f"(isa a{i} C0)" for i in range(12)] + ["(isa b0 C3)", "(isa b0 Odd)"] + [f"(rel a{i} b0)" for i in range(12)] + ["(rel untyped b0)", "(rel a0 untyped)"]
    edges = edges_of(spark, lines)
    # three edges of one source are one piece, whose first arguments have one type at least
    shared = edges_of(spark, ["(rel a0 b0)", "(rel a1 b0)", "(rel untyped b0)"]).withColumn("edge_id", F.col("edge_id") + 100).withColumn("props", F.create_map(F.lit("source"), F.lit("s")))
    kb = KB(edges.unionByName(shared))
    kb.strict("genls")
    written, rows = analytics.checkpointed, []
    monkeypatch.setattr(analytics, "checkpointed", lambda df: (out := written(df), rows.append(out.count()))[0])
    got = {(r.pos, r.type): (r.n, r.evidence) for r in analytics.refinement_evidence(kb, spark.createDataFrame([("rel",)], "pred string")).collect()}
    assert got == {(1, f"C{i}"): (14, 14) for i in range(11)} | {(2, f"C{i}"): (13, 13) for i in range(3, 11)} | {(2, "Odd"): (13, 13)}
    assert max(rows) <= 13


def test_scans_parse_only_edges_that_hold_the_term(spark, monkeypatch):
    lines = [f"(isa x{i} (F y{i}))" for i in range(50)] + ['(isa z (F (G y7) 5 "a b"))', "(likes y7 z)", "(likes z y70)"]
    edges = edges_of(spark, lines)
    indexed = []
    monkeypatch.setattr(scan, "positions", lambda e: indexed.append(e.count()) or model.positions(e))
    found = lambda *c: {(r.pred, r.arg1) for r in scan.find(edges, list(c)).collect()}
    assert found(("y7", "F")) == {("isa", "x7"), ("isa", "z")}
    assert found(("y7", None), ("isa", "-1")) == {("likes", "y7")}
    assert found(("y7", "-F")) == {("likes", "y7")}
    assert found(("(G y7)", "3F2")) == found(("'5", "F")) == found(('"a b"', "F")) == {("isa", "z")}
    assert max(indexed) <= 6
    assert found(("isa", "-1")) == {("likes", "y7"), ("likes", "z")} and indexed[-1] == 53


def test_partitions_follow_the_input(spark):
    from gnosia.operators import tables

    first, read = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    try:
        tables.sized(spark, 1000 * tables.START)
        assert spark.conf.get(first) == "1000" and int(spark.conf.get(read)) == tables.READ
        tables.sized(spark, 1)
        assert spark.conf.get(first) == "1"
        spark.conf.set(first, "77")
        spark.conf.set(read, "8m")
        tables.sized(spark, 1000 * tables.START)
        assert (spark.conf.get(first), spark.conf.get(read)) == ("77", "8m")
    finally:
        spark.conf.unset(first)
        spark.conf.unset(read)
    with tables.unsorted(spark):
        rows = spark.range(100).selectExpr("id % 3 as k", "id").write
        assert int(spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")) >= 32
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0" and rows is not None
