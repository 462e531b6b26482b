"""Readers and writers of assertion text, CSV, feature files and public concept dumps."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gnosia import model
from gnosia.functions import dates
from gnosia.operators.closure import minimal
from gnosia.operators.constraints import admit, as_text, insert, propagate, strictly_functional
from gnosia.operators.kb import KB
from gnosia.operators.tables import few, ship
from gnosia.operators.tables import written as checkpointed
from gnosia.plans import sexpr

_ROW = T.StructType([
    T.StructField("pred", T.StringType()), T.StructField("args", T.ArrayType(T.StringType())), T.StructField("sign", T.IntegerType()), T.StructField("removed", T.BooleanType()), T.StructField("fault", T.StringType()),
])


@F.udf(_ROW, useArrow=True)
def _parsed(text: str | None):
    try:
        edge, sign, removed = sexpr.unwrap(sexpr.parse(text or ""))
        if not isinstance(edge, tuple) or len(edge) < 2:
            return None, None, None, None, "NOT_AN_ASSERTION"
        if edge[0] == "NIL":
            return None, None, None, None, "NIL"
        return sexpr.text(edge[0]), [sexpr.text(x) for x in edge[1:]], sign, removed, None
    except sexpr.SyntaxFault as e:
        return None, None, None, None, f"SYNTAX: {e}"


def read_assertions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(edges, rejects) of a text file: one assertion a line, `assertion<TAB>microtheory`; more fields are rejected.

    Flat positive assertions of constants and numbers are split by Spark's own functions; strings, nested and wrapped
    ones go through the parser.
    """
    ship(spark)
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0).select("value", F.split("value", "\t").alias("f"))
    bad = lines.where(F.size("f") > 2).select(F.col("value").alias("raw"), F.lit("FIELDS").alias("code"))
    fine = lines.where(F.size("f") <= 2).select("value", F.replace(F.col("f")[0], F.lit("#$"), F.lit("")).alias("text"), F.nullif(F.replace(F.try_element_at("f", F.lit(2)), F.lit("#$"), F.lit("")), F.lit("")).alias("mt"))
    simple = F.col("text").rlike(r'^\s*\((?!not |removed |NIL )[^()"\s]+(?:\s+[^()"\s]+)+\s*\)\s*$')
    words = F.transform(F.split(F.trim(F.regexp_replace("text", "[()]", " ")), r"\s+"), lambda x: F.when(x.rlike(r"^-?\d+(\.\d+)?([eE]-?\d+)?$"), F.concat(F.lit("'"), x)).otherwise(x))
    flat = fine.where(simple).select("value", "mt", words.alias("w")).select("value", "mt", F.col("w")[0].alias("pred"), F.slice("w", F.lit(2), F.size("w") - 1).alias("args"), F.lit(1).alias("sign"), F.lit(False).alias("removed"), F.lit(None).cast("string").alias("fault"))
    deep = fine.where(~simple).select("value", "mt", _parsed("text").alias("p")).select("value", "mt", "p.*")
    rows = flat.unionByName(deep)
    rejects = bad.unionByName(rows.where("fault is not null").select(F.col("value").alias("raw"), F.col("fault").alias("code")))
    ok = rows.where("fault is null")
    edges = ok.select(
        F.xxhash64("pred", F.array_join("args", "\u0001"), "sign").alias("edge_id"), "pred", "args", F.col("args")[0].alias("arg1"), F.try_element_at("args", F.lit(2)).alias("arg2"), F.size("args").alias("arity"), "sign", "removed", "mt",
        F.lit("import").alias("creator"), F.lit(False).alias("ephemeral"), F.create_map().cast("map<string,string>").alias("props"),
    )
    return edges.dropDuplicates(["pred", "args", "sign"]), rejects.withColumn("detail", F.create_map().cast("map<string,string>"))


def load(kb: KB, candidates: DataFrame) -> tuple[KB, DataFrame]:
    """Validated load: accept what holds, in order of edge_id, and try the rejects again until a round accepts nothing; (grown kb, rejects)."""
    waiting, edges, left = checkpointed(candidates), kb.edges, None
    while True:
        now = KB(edges, kb.isa_neg_via_genls, kb.strict_or, kb.numeric_equals, kb.now, kb.small)
        got = admit(now, waiting)
        accepted = checkpointed(got.accepted)
        n = accepted.count()
        rejects = checkpointed(got.rejects)
        if not n:
            left = rejects
            break
        edges = checkpointed(insert(edges, accepted.unionByName(propagate(now, accepted))))
        waiting = checkpointed(waiting.join(accepted.select("edge_id"), "edge_id", "left_anti"))
        left = rejects
        if waiting.isEmpty():
            break
    return KB(edges, kb.isa_neg_via_genls, kb.strict_or, kb.numeric_equals, kb.now, kb.small), left


def clean_comment(edges: DataFrame, known: DataFrame) -> DataFrame:
    """Comments marked up: other expressions in <code>, `#$Name` as [[Name]], in the singular where only that is known.

    known: (term). `#$` inside code is dropped.
    """
    text = F.col("arg2")
    comments = edges.where((F.col("pred") == "comment") & model.is_string(text))
    coded = F.regexp_replace(text, r"(?<![>\w])(\(#\$[^()]*(?:\([^()]*\)[^()]*)*\))(?![\w<])", "<code>$1</code>")
    parts = comments.select("edge_id", coded.alias("t")).select("edge_id", F.posexplode(F.regexp_extract_all("t", F.lit(r"(?s)(<code>.*?</code>|#\$[A-Za-z0-9_-]+|(?:(?!<code>|#\$[A-Za-z0-9]).)+)"), F.lit(1))).alias("i", "p"))
    name = F.when(F.col("p").startswith("#$"), F.substr("p", F.lit(3)))
    parts = parts.withColumn("name", name).withColumn("single", F.expr("substr(name, 1, length(name) - 1)"))
    k = known.select("term").distinct()
    parts = parts.join(k.select(F.col("term").alias("name"), F.lit(True).alias("k1")), "name", "left").join(k.select(F.col("term").alias("single"), F.lit(True).alias("k2")), "single", "left")
    done = F.when(F.col("name").isNotNull(), F.concat(F.lit("[["), F.when(F.col("k1").isNull() & F.col("k2"), F.col("single")).otherwise(F.col("name")), F.lit("]]"))).when(F.col("p").startswith("<code>"), F.replace("p", F.lit("#$"), F.lit(""))).otherwise(F.col("p"))
    joined = parts.select("edge_id", "i", done.alias("d")).groupBy("edge_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "d"))), lambda x: x["d"]), "").alias("fixed"))
    out = edges.join(joined, "edge_id", "left").withColumn("arg2", F.coalesce("fixed", "arg2")).withColumn("args", F.when(F.col("fixed").isNotNull(), F.array("arg1", "fixed")).otherwise(F.col("args")))
    return out.select(*edges.columns)


# ---- sinks


def assertion_lines(edges: DataFrame) -> DataFrame:
    """(value): text that read_assertions() reads again."""
    return edges.select(F.concat_ws("\t", as_text(), "mt").alias("value"))


def write_assertions(edges: DataFrame, path: str) -> None:
    assertion_lines(edges).write.text(path)


def csv_tables(edges: DataFrame, all_predicates: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, functions): edges with functional terms as FUNCTION_n, and what each n stands for."""
    e = edges.where(~F.col("removed") & (F.col("sign") == 1))
    if not all_predicates:
        e = e.where(F.col("pred").isin("isa", "genls", "genlPreds", "genlMt"))
    terms = model.positions(e).where(model.is_function(F.col("term"))).select("term").distinct()
    # numbers by (hash bucket, order): consecutive without a single-task sort
    from pyspark.sql import Window

    b = terms.withColumn("b", F.pmod(F.xxhash64("term"), F.lit(256)))
    start = b.groupBy("b").agg(F.count(F.lit(1)).alias("n")).withColumn("start", F.coalesce(F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("b", "start")
    named = b.withColumn("k", F.row_number().over(Window.partitionBy("b").orderBy("term"))).join(F.broadcast(start), "b").select("term", F.concat(F.lit("FUNCTION_"), (F.col("start") + F.col("k")).cast("string")).alias("name"))
    flat = e.select("edge_id", "pred", F.posexplode("args").alias("i", "term")).join(named, "term", "left").select("edge_id", "pred", "i", F.coalesce("name", "term").alias("t"))
    rows = flat.groupBy("edge_id", "pred").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "t"))), lambda x: x["t"]).alias("a"))
    return rows.select("pred", F.col("a")[0].alias("arg1"), F.try_element_at("a", F.lit(2)).alias("arg2"), F.array_join("a", ",").alias("args")), named


def write_csv(edges: DataFrame, path: str, all_predicates: bool = False) -> None:
    rows, functions = csv_tables(edges, all_predicates)
    rows.select("pred", "args").write.csv(f"{path}/edges")
    functions.write.csv(f"{path}/functions")


#: Attributes of a pair-feature file and their types (fixed values).
ATTRIBUTES = [
    *((n, "string") for n in ("relation", "arg1", "arg2", "disamb1", "disamb2")),
    *((n, "numeric") for n in ("semantic_similarity", "depth_1", "depth_2", "av_depth", "impact_a", "impact_b", "impact_ab")), ("common_parent", "string"),
    *((n, "numeric") for n in ("parent_depth", "semantic_distance", "relation_reliability", "relation_disjoint", "relation_conjoint", "relation_unknown", "intra_relation_reliability", "intra_relation_disjoint", "intra_relation_conjoint", "intra_relation_unknown")),
    ("class", "{disjoint,conjoint}"),
]


def arff_header(name: str = "disjoint") -> str:
    return f"@RELATION {name}\n\n" + "".join(f"@ATTRIBUTE {n} {t}\n" for n, t in ATTRIBUTES) + "\n@DATA\n"


def arff_lines(features: DataFrame) -> DataFrame:
    """(value): one data line for each feature row; missing values are `?`, as is the class of unknown pairs."""
    cols = []
    for n, t in ATTRIBUTES:
        c = F.col(n).cast("string")
        if t == "string":
            c = F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("\\'")), F.lit("'"))
        if n == "class":
            c = F.when(c.isin("disjoint", "conjoint"), c)
        cols.append(F.coalesce(c, F.lit("?")))
    return features.select(F.concat_ws(",", *cols).alias("value"))


#: Attribute lines that a header may have.
MOST_ATTRIBUTES = 10_000


def read_arff(spark: SparkSession, path: str) -> DataFrame:
    """The data lines of an ARFF file under the names and types of its header; `?` is null, comments and blank lines are left out.

    Numbers are doubles, all else strings. The header's lines are read on the driver and are at most MOST_ATTRIBUTES.
    """
    lines = spark.read.text(path)
    head = few(lines.where(F.col("value").rlike(r"(?i)^\s*@attribute\s")), MOST_ATTRIBUTES)
    if not head:
        raise ValueError("no attributes, or too many of them")
    found = [re.match(r"(?i)\s*@attribute\s+('[^']*'|\"[^\"]*\"|\S+)\s+(.*\S)", r.value) for r in head]
    fields = [T.StructField(m[1].strip("'\""), T.DoubleType() if m[2].lower() in ("numeric", "real", "integer") else T.StringType()) for m in found]
    data = lines.where(~F.col("value").rlike(r"^\s*([@%]|$)"))
    row = F.from_csv("value", T.StructType(fields).simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), {"quote": "'", "escape": "\\", "nullValue": "?"})
    return data.select(row.alias("r")).select("r.*")


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.csv(path, sep="\t", header=True)


# ---- public concept dumps

#: Lines of a raw concept dump (a fixed pattern: assertion, relation, two concepts of any language, context, weight).
RAW = r"^/a/\[.+?\]\t/r/(\S+)\t/c/[a-z]+/([^ \t/]+)\S*\t/c/[a-z]+/([^ \t/]+)\t\S+\t[\d.]+.+?$"


def concept_triples(lines: DataFrame) -> DataFrame:
    """(relation, first, second) of raw lines (column value) that match; others are skipped."""
    m = lines.where(F.col("value").rlike(RAW))
    return m.select(*[F.regexp_extract("value", RAW, i).alias(n) for i, n in ((1, "relation"), (2, "first"), (3, "second"))])


def read_concept_dump(spark: SparkSession, path: str) -> DataFrame:
    return concept_triples(spark.read.text(path))


def write_parsed(triples: DataFrame, path: str) -> None:
    """One folder for each relation."""
    triples.write.partitionBy("relation").csv(path, sep="\t")


def read_parsed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="relation string, first string, second string")


def read_header_tsv(spark: SparkSession, path: str, relation: str = "Relation", first: str = "Entity", second: str = "Value", action: str = "Action") -> DataFrame:
    """Triples of a TSV with a header; rows whose action is `-` are dropped."""
    df = spark.read.csv(path, sep="\t", header=True)
    if action in df.columns:
        df = df.where(F.coalesce(F.col(action), F.lit("")) != "-")
    return df.select(F.col(relation).alias("relation"), F.col(first).alias("first"), F.col(second).alias("second"))


def bracket_triples(lines: DataFrame) -> DataFrame:
    """(relation, first, second) of `<a>\\t<r>\\t<b> .` lines: brackets, underscores and parenthetical or comma suffixes go."""
    t = lines.where(F.col("value").startswith("<")).select(F.split(F.regexp_replace(F.replace(F.replace("value", F.lit("_"), F.lit(" ")), F.lit(" ."), F.lit("")), "[<>]", ""), "\t").alias("p")).where(F.size("p") >= 3)
    bare = lambda i: F.regexp_replace(F.regexp_replace(F.col("p")[i], ", .*", ""), r" \(.*\)", "")
    return t.select(F.col("p")[1].alias("relation"), bare(0).alias("first"), bare(2).alias("second"))


def aliases(kb: KB) -> DataFrame:
    """(alias, term): lower-case strings of each term, of edges that are neither negated nor removed, and its own name."""
    strings = kb.active.where((F.col("sign") == 1) & F.col("pred").isin("termStrings", "prettyString", "prettyString-Canonical") & model.is_string(F.col("arg2")))
    own = kb.active.select(F.explode("args").alias("term")).where(model.is_node(F.col("term"))).distinct()
    from gnosia.functions.text import concept_to_text

    return strings.select(F.lower(F.expr("substr(arg2, 2, length(arg2) - 2)")).alias("alias"), F.col("arg1").alias("term")).union(own.select(F.lower("term"), "term")).union(own.select(F.lower(concept_to_text(F.col("term"))), "term")).distinct()


def find_nodes(kb: KB, texts: DataFrame) -> DataFrame:
    """(text, term): terms with that alias, without regard to case, and the dates that a text can mean."""
    t = texts.select("text").distinct()
    named = t.join(aliases(kb), F.lower("text") == F.col("alias")).select("text", "term")
    return named.union(t.select("text", F.explode(dates.date_terms("text")).alias("term"))).distinct()


def sense_pairs(kb: KB, triples: DataFrame) -> DataFrame:
    """(relation, arg1, arg2, disamb1, disamb2): senses of both texts, each unordered pair once.

    A text without a sense is replaced by those it is said to be (`IsA` triples).
    """
    alias = aliases(kb)
    norm = lambda c: F.lower(F.replace(c, F.lit("_"), F.lit(" ")))
    texts = triples.select(F.col("first").alias("x")).union(triples.select(F.col("second").alias("x"))).distinct()
    direct = texts.join(alias, norm(F.col("x")) == F.col("alias")).select("x", "term")
    is_a = triples.where(F.col("relation") == "IsA").select(F.col("first").alias("x"), F.col("second").alias("y"))
    via = texts.join(direct.select("x").distinct(), "x", "left_anti").join(is_a, "x").join(alias, norm(F.col("y")) == F.col("alias")).select("x", "term")
    senses = checkpointed(direct.union(via).distinct())
    a, b = senses.select(F.col("x").alias("first"), F.col("term").alias("t1")), senses.select(F.col("x").alias("second"), F.col("term").alias("t2"))
    got = triples.distinct().join(a, "first").join(b, "second").where("t1 <> t2")
    swap = F.col("t1") > F.col("t2")
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    return got.select("relation", pick("first", "second").alias("arg1"), pick("second", "first").alias("arg2"), F.least("t1", "t2").alias("disamb1"), F.greatest("t1", "t2").alias("disamb2")).dropDuplicates(["relation", "disamb1", "disamb2"])


def tangible_only(kb: KB, pairs: DataFrame, kind: str = "PartiallyTangible", material: str | None = None) -> DataFrame:
    """Pairs (a, b) both below a class, neither below the material class."""
    both = kb.instances(kb.spark.createDataFrame([(kind,)], "hi string")).select("a").union(kb.downward(kb.spark.createDataFrame([(kind,)], "hi string")).select(F.col("lo").alias("a"))).distinct()
    out = pairs.join(both, "a", "left_semi").join(both.withColumnRenamed("a", "b"), "b", "left_semi")
    if material:
        m = kb.downward(kb.spark.createDataFrame([(material,)], "hi string")).select(F.col("lo").alias("a"))
        out = out.join(m, "a", "left_anti").join(m.withColumnRenamed("a", "b"), "b", "left_anti")
    return out.select("a", "b")


def to_classes(kb: KB, pairs: DataFrame, names: tuple[str, str] = ("disamb1", "disamb2")) -> DataFrame:
    """Pairs with each individual replaced by its least types; an individual without a type goes, as do pairs of one class."""
    terms = reduce(DataFrame.union, [pairs.select(F.col(n).alias("term")) for n in names]).distinct()
    classes = kb.occurring("genls")
    direct = kb.types(terms.join(classes, "term", "left_anti")).where("dist = 0").select("a", F.col("b").alias("term"))
    least = minimal(direct, kb.upward(direct.select(F.col("term").alias("lo"))), ["a"]).select(F.col("a").alias("from"), F.col("term").alias("to"))
    known = terms.join(classes, "term", "left_semi").select(F.col("term").alias("from"), F.col("term").alias("to"))
    swap = checkpointed(known.union(least).distinct())
    out = pairs
    for n in names:
        out = out.join(swap.withColumnRenamed("from", n), n).drop(n).withColumnRenamed("to", n)
    return out.where(F.col(names[0]) != F.col(names[1])).select(*pairs.columns).distinct()


def functional(kb: KB) -> DataFrame:
    return strictly_functional(kb)


def write_rejects(rejects: DataFrame, path: str) -> None:
    """The reject log: raw text and code, by code."""
    rejects.select("raw", "code").write.mode("append").partitionBy("code").csv(path, sep="\t")


def write_log(df: DataFrame, path: str) -> None:
    """Rows of new pairs, counts or decisions, appended as CSV."""
    df.write.mode("append").csv(path)


def node_table(edges: DataFrame) -> DataFrame:
    """(name, term, kind): every term of the edges under the name that csv_tables() gives it."""
    _, named = csv_tables(edges, all_predicates=True)
    n = model.nodes(edges).select("term", "kind")
    return n.join(named, "term", "left").select(F.coalesce("name", "term").alias("name"), "term", "kind")


def random_nodes(edges: DataFrame, n: int = 1, seed: int = 0) -> DataFrame:
    """n terms drawn by a seeded hash."""
    terms = edges.select(F.explode("args").alias("term")).where(model.is_node(F.col("term"))).distinct()
    return terms.orderBy(F.xxhash64("term", F.lit(seed)), "term").limit(n)


def random_edges(edges: DataFrame, n: int = 1, seed: int = 0, functions: bool = True) -> DataFrame:
    """n edges drawn by a seeded hash; without functional terms if so asked."""
    e = edges if functions else edges.where(~F.exists("args", lambda a: a.startswith("(")))
    return e.orderBy(F.xxhash64("edge_id", F.lit(seed))).limit(n)
