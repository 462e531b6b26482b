"""Tables kept beside the edges: a registry of views, each built from a knowledge base and brought up to date by a batch.

A list of names chooses views; a name after `%` is left out. register() adds one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gnosia import model
from gnosia.operators import closure as C
from gnosia.operators.kb import KB
from gnosia.operators.tables import written as checkpointed


@dataclass(frozen=True)
class View:
    """build(kb): the whole table. change(known, before, after, batch): the table after the edges of a batch came or went; without it the view is built again."""

    build: Callable[[KB], DataFrame]
    change: Callable[[DataFrame, KB, KB, DataFrame], DataFrame] | None = None

    def changed(self, known: DataFrame, before: KB, after: KB, batch: DataFrame) -> DataFrame:
        return self.build(after) if self.change is None else self.change(known, before, after, batch)


VIEWS: dict[str, View] = {}


def register(name: str, build: Callable[[KB], DataFrame], change: Callable | None = None) -> None:
    VIEWS[name] = View(build, change)


def chosen(names: Iterable[str]) -> dict[str, View]:
    """The views of a list, in its order."""
    return {n: VIEWS[n] for n in names if not n.startswith("%")}


def _below(kb: KB, terms: DataFrame) -> DataFrame:
    """(term, end): each term (column term) and all that leads up to it, functional terms by their result types too."""
    seeds = terms.select(F.col("term").alias("lo")).distinct()
    back = kb.step("genls").select(F.col("hi").alias("lo"), F.col("lo").alias("hi"))
    found = C.reach(back, seeds, small=kb.small).select(F.col("hi").alias("term"), F.col("lo").alias("end"))
    return found.union(seeds.select(F.col("lo").alias("term"), F.col("lo").alias("end"))).distinct()


def _disjoint_map(known: DataFrame, before: KB, after: KB, batch: DataFrame) -> DataFrame:
    """Rows of terms below a changed genls edge, of new functional terms and of changed axiom ends are made again; all others stay."""
    if not batch.where(F.col("pred").isin("resultGenl", "resultGenlArg")).isEmpty():
        return after.disjoint_map()
    low = batch.where("pred = 'genls'").select(F.col("arg1").alias("term"))
    fresh = batch.select(F.explode("args").alias("term")).where(model.is_function(F.col("term")))
    touched = checkpointed(_below(before, low).union(_below(after, low)).select("term").union(fresh).distinct())
    axioms = batch.where("pred = 'disjointWith'")
    ends = checkpointed(axioms.select(F.col("arg1").alias("term")).union(axioms.select(F.col("arg2").alias("term"))).distinct())
    axiom = checkpointed(after.axioms().select(F.col("x").alias("axiom_term"), "sign").distinct())
    kept = known.join(touched, "term", "left_anti").join(ends.withColumnRenamed("term", "axiom_term"), "axiom_term", "left_anti")
    up = after.upward(touched.select(F.col("term").alias("lo"))).select(F.col("lo").alias("term"), F.col("hi").alias("axiom_term"))
    again = up.union(_below(after, ends).select("term", F.col("end").alias("axiom_term"))).join(axiom, "axiom_term")
    names = ["term", "axiom_term", "sign"]
    return kept.select(*names).union(again.select(*names)).distinct()


register("disjoint_map", lambda kb: kb.disjoint_map(), _disjoint_map)
register("depths", lambda kb: kb.depths())
