"""Schemas of the edge table and its derived tables, and column tests of terms."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gnosia.plans import sexpr

EDGES = (
    "edge_id long, pred string, args array<string>, arg1 string, arg2 string, arity int, sign int, removed boolean, "
    "mt string, creator string, ephemeral boolean, props map<string,string>"
)
NODES = "term string, kind string, reified boolean, str_val string, num_val double, bool_val boolean, creator string, ephemeral boolean, props map<string,string>"
EDGE_POS = "edge_id long, path string, depth int, term string"
CLOSURE = "lo string, hi string, dist int"
REJECTS = "raw string, code string, detail map<string,string>"


def row(expr, edge_id: int, mt: str | None = None, creator: str | None = None, ephemeral: bool = False, props: dict[str, str] | None = None) -> tuple:
    """An edge row of a parsed assertion."""
    edge, sign, removed = sexpr.unwrap(expr)
    if not isinstance(edge, tuple) or len(edge) < 2:
        raise sexpr.SyntaxFault("an assertion has a predicate and arguments")
    args = [sexpr.text(x) for x in edge[1:]]
    return (edge_id, sexpr.text(edge[0]), args, args[0], args[1] if len(args) > 1 else None, len(args), sign, removed, mt, creator, ephemeral, props or {})


def edges_of(spark: SparkSession, assertions: Iterable[str]) -> DataFrame:
    """An edge table of assertion texts; `text<TAB>microtheory` is allowed."""
    rows = []
    for i, line in enumerate(assertions):
        body, _, mt = line.partition("\t")
        rows.append(row(sexpr.parse(body), i, mt or None))
    return spark.createDataFrame(rows, EDGES)


def edges_from_pairs(pairs: DataFrame) -> DataFrame:
    """An edge table of binary edges (pred, arg1, arg2, sign); edge_id is a hash of the edge, so it needs no shuffle."""
    return pairs.select(
        F.xxhash64("pred", "arg1", "arg2", "sign").alias("edge_id"), "pred", F.array("arg1", "arg2").alias("args"), "arg1", "arg2",
        F.lit(2).alias("arity"), F.col("sign").cast("int").alias("sign"), F.lit(False).alias("removed"),
        F.lit(None).cast("string").alias("mt"), F.lit(None).cast("string").alias("creator"), F.lit(False).alias("ephemeral"), F.create_map().cast("map<string,string>").alias("props"),
    )


def is_function(term: Column) -> Column:
    return term.startswith("(")


def is_string(term: Column) -> Column:
    return term.startswith('"')


def is_primitive(term: Column) -> Column:
    return term.startswith("'")


def is_node(term: Column) -> Column:
    """A constant or functional term, not a literal."""
    return term.isNotNull() & ~is_string(term) & ~is_primitive(term)


def number(term: Column) -> Column:
    """Value of a primitive number, else null."""
    return F.when(is_primitive(term), F.substr(term, F.lit(2)).try_cast("double"))


def function_name(term: Column) -> Column:
    """Name of a functional term's function, else null."""
    return F.nullif(F.regexp_extract(term, r"^\(([^\s()]+)", 1), F.lit(""))


def literal_type(term: Column) -> Column:
    """The type term that stands for a literal; the term itself if it is none. Fractions count by their whole part."""
    n = number(term)
    whole = F.substr(term, F.lit(2)).rlike(r"^-?\d+$")
    return (
        F.when(is_string(term), "(TheFn CharacterString)")
        .when(is_primitive(term) & n.isNotNull() & (n.cast("long") == 0), "Zero")
        .when(is_primitive(term) & n.isNotNull(), F.concat(F.lit("(TheFn "), F.when(n > 0, "Positive").otherwise("Negative"), F.when(whole, "Integer").otherwise("Number"), F.lit(")")))
        .when(is_primitive(term) & F.substr(term, F.lit(2)).isin("true", "True"), "True")
        .when(is_primitive(term) & F.substr(term, F.lit(2)).isin("false", "False"), "False")
        .when(is_primitive(term), "(TheFn CharacterString)")
        .otherwise(term)
    )


@F.udf(T.ArrayType(T.StringType()), useArrow=True)
def term_parts(term: str | None) -> list[str] | None:
    """Top-level parts of a functional term (only functional terms should reach it)."""
    return None if term is None else sexpr.split_terms(term)


def nodes(edges: DataFrame) -> DataFrame:
    """The node table: every term that occurs in an edge, with its kind and literal value."""
    terms = positions(edges).select("term").distinct()
    kind = F.when(is_string(F.col("term")), "string").when(number(F.col("term")).isNotNull(), "num").when(is_primitive(F.col("term")), "bool").when(is_function(F.col("term")), "function").otherwise("constant")
    val = F.substr(F.col("term"), F.lit(2))
    return terms.select(
        "term", kind.alias("kind"), F.lit(True).alias("reified"), F.when(is_string(F.col("term")), F.expr("substr(term, 2, length(term) - 2)")).alias("str_val"),
        number(F.col("term")).alias("num_val"), F.when(F.lower(val).isin("true", "false"), F.lower(val) == "true").alias("bool_val"),
        F.lit(None).cast("string").alias("creator"), F.lit(False).alias("ephemeral"), F.create_map().cast("map<string,string>").alias("props"),
    )


@F.udf(T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("depth", T.IntegerType()), T.StructField("term", T.StringType())])), useArrow=True)
def _paths(pred: str, args: list[str]) -> list[tuple[str, int, str]]:
    return sexpr.paths((sexpr.parse(pred), *(sexpr.parse(a) for a in args)))


def positions(edges: DataFrame) -> DataFrame:
    """The positional index: every term of every edge with its path; only edges with nested terms pass through Python."""
    nested = F.exists("args", lambda a: a.startswith("(")) | F.col("pred").startswith("(")
    flat = edges.where(~nested).select("edge_id", F.posexplode(F.concat(F.array("pred"), "args")).alias("i", "term"))
    deep = edges.where(nested).select("edge_id", F.explode(_paths("pred", "args")).alias("p"))
    return flat.select("edge_id", (F.col("i") + 1).cast("string").alias("path"), F.lit(0).alias("depth"), "term").unionByName(deep.select("edge_id", "p.path", "p.depth", "p.term"))
