"""Named queries over one knowledge base, for single terms.

Each has one or two given terms and one output column `X`. The bulk forms over all terms are in analytics and kb.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gnosia import model
from gnosia.operators import closure as C
from gnosia.operators.kb import KB

#: name -> (query template, whether asserted edges only); ?0 and ?1 are the given terms (fixed values).
TEMPLATES: dict[str, tuple[str, bool]] = {
    "ALIAS": ("(termStrings ?0 ?X)", False),
    "ALLGENLS": ("(genls ?0 ?X)", False),
    "ALLISA": ("(isa ?0 ?X)", False),
    "ARGNGENL": ("(argGenl ?0 ?1 ?X)", False),
    "ARGNISA": ("(argIsa ?0 ?1 ?X)", False),
    "COMMENT": ("(comment ?0 ?X)", False),
    "COMMONGENLS": ("(and (genls ?0 ?X) (genls ?1 ?X))", False),
    "COMMONINSTANCES": ("(and (isa ?X ?0) (isa ?X ?1))", False),
    "COMMONISA": ("(and (isa ?0 ?X) (isa ?1 ?X))", False),
    "COMMONSPECS": ("(and (genls ?X ?0) (genls ?X ?1))", False),
    "DIRECTGENLS": ("(genls ?0 ?X)", True),
    "DIRECTINSTANCE": ("(isa ?X ?0)", True),
    "DIRECTISA": ("(isa ?0 ?X)", True),
    "DIRECTSPECS": ("(genls ?X ?0)", True),
    "GENLPREDS": ("(genlPreds ?0 ?X)", False),
    "GENLSIBLINGS": ("(genls ?0 ?X)", True),
    "INSTANCES": ("(isa ?X ?0)", False),
    "ISASIBLINGS": ("(isa ?0 ?X)", True),
    "MAXCOMMONINSTANCES": ("(and (isa ?X ?0) (isa ?X ?1))", False),
    "MAXCOMMONSPECS": ("(and (genls ?X ?0) (genls ?X ?1))", False),
    "MAXINSTANCES": ("(isa ?X ?0)", False),
    "MAXSPECS": ("(genls ?X ?0)", True),
    "MINARGNGENL": ("(argGenl ?0 ?1 ?X)", False),
    "MINARGNISA": ("(argIsa ?0 ?1 ?X)", False),
    "MINCOMMONGENLS": ("(and (genls ?0 ?X) (genls ?1 ?X))", False),
    "MINCOMMONISA": ("(and (isa ?0 ?X) (isa ?1 ?X))", False),
    "MINGENLS": ("(genls ?0 ?X)", True),
    "MINISA": ("(isa ?0 ?X)", True),
    "SPECPREDS": ("(genlPreds ?X ?0)", False),
    "SPECS": ("(genls ?X ?0)", False),
}


def run(kb: KB, name: str, *given: str) -> DataFrame:
    """Rows (X) of a named query; the plan is built once for each knowledge base and argument list."""
    from gnosia.plans.engine import Engine

    template, asserted = TEMPLATES[name]
    text = template
    for i, g in enumerate(given):
        text = text.replace(f"?{i}", g)
    if asserted:
        text = f"(assertedSentence {text})"
    rows = Engine(kb).query(text).rows.select(F.col("X"))
    return _AFTER.get(name, lambda kb, rows, given: rows)(kb, rows, given).distinct()


def _with_numbered(kind: str, least: bool) -> Callable:
    """Also the constraints of the predicate with the position in its name."""

    def fn(kb: KB, rows: DataFrame, given: tuple[str, ...]) -> DataFrame:
        pos = given[1].lstrip("'")
        more = kb.asserted(f"arg{pos}{kind}").where(F.col("a") == given[0]).select(F.col("b").alias("X"))
        rows = rows.union(more)
        return _least(kb, rows, given) if least else rows

    return fn


def _results(kind: str) -> Callable:
    def fn(kb: KB, rows: DataFrame, given: tuple[str, ...]) -> DataFrame:
        term = kb.spark.createDataFrame([(given[0],)], "term string")
        return rows.union(kb.function_results(kind, term).select(F.col("b").alias("X")))

    return fn


def _least(kb: KB, rows: DataFrame, given: tuple[str, ...], drop_self: bool = False) -> DataFrame:
    members = rows.select(F.lit(1).alias("g"), F.col("X").alias("term"))
    if drop_self:
        members = members.where(F.col("term") != given[0])
    return C.minimal(members, kb.upward(members.select(F.col("term").alias("lo"))), ["g"]).select(F.col("term").alias("X"))


def _greatest(kb: KB, rows: DataFrame, given: tuple[str, ...], drop_self: bool = False) -> DataFrame:
    members = rows.select(F.lit(1).alias("g"), F.col("X").alias("term"))
    if drop_self:
        members = members.where(F.col("term") != given[0])
    return C.maximal(members, kb.upward(members.select(F.col("term").alias("lo"))), ["g"]).select(F.col("term").alias("X"))


def _max_instances(kb: KB, rows: DataFrame, given: tuple[str, ...]) -> DataFrame:
    """Instances of a first-order collection are individuals: nothing to filter."""
    term = kb.spark.createDataFrame([(given[0],)], "term string")
    first = not kb.types(term).where(F.col("b") == "FirstOrderCollection").isEmpty()
    return rows if first else _greatest(kb, rows, given)


def _genl_siblings(kb: KB, rows: DataFrame, given: tuple[str, ...]) -> DataFrame:
    parents = _least(kb, rows, given, drop_self=True)
    return kb.downward(parents.select(F.col("X").alias("hi"))).select(F.col("lo").alias("X")).where(F.col("X") != given[0])


def _isa_siblings(kb: KB, rows: DataFrame, given: tuple[str, ...]) -> DataFrame:
    return kb.instances(_least(kb, rows, given).select(F.col("X").alias("hi"))).select(F.col("a").alias("X")).where(F.col("X") != given[0])


_AFTER: dict[str, Callable] = {
    "ARGNGENL": _with_numbered("Genl", False), "ARGNISA": _with_numbered("Isa", False), "MINARGNGENL": _with_numbered("Genl", True), "MINARGNISA": _with_numbered("Isa", True),
    "DIRECTGENLS": _results("resultGenl"), "DIRECTISA": _results("resultIsa"), "GENLSIBLINGS": _genl_siblings, "ISASIBLINGS": _isa_siblings,
    "MAXINSTANCES": _max_instances, "MAXSPECS": lambda kb, r, g: _greatest(kb, r, g, True), "MINCOMMONGENLS": _least, "MINCOMMONISA": _least,
    "MINGENLS": lambda kb, r, g: _least(kb, r, g, True), "MINISA": _least,
}


def siblings_ranked(kb: KB, term: str, similarity: DataFrame | None = None) -> DataFrame:
    """(X, similarity): the term's siblings by classes and types, the most similar first."""
    from gnosia.operators.analytics import similarity_of

    found = run(kb, "GENLSIBLINGS", term).union(run(kb, "ISASIBLINGS", term)).distinct().where(model.is_node(F.col("X")))
    pairs = found.select(F.lit(term).alias("a"), F.col("X").alias("b"))
    scored = similarity_of(kb, pairs) if similarity is None else pairs.join(similarity, ["a", "b"])
    return scored.select(F.col("b").alias("X"), "similarity").orderBy(F.col("similarity").desc(), "X")
