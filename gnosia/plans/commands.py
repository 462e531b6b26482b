"""Named commands over one engine: each takes the engine and texts and gives protocol text or a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gnosia.functions.text import Writer
from gnosia.operators import analytics, common, constraints
from gnosia.plans import sexpr
from gnosia.plans.engine import TRUE, Engine

COMMANDS: dict[str, Callable] = {}


def command(name: str) -> Callable[[Callable], Callable]:
    """Register a command; a later one of the same name replaces it."""

    def register(fn: Callable) -> Callable:
        COMMANDS[name] = fn
        return fn

    return register


def run(engine: Engine, name: str, *args):
    return COMMANDS[name](engine, *args)


@command("query")
def query(engine: Engine, text: str) -> str:
    """`T (...)` or `(...)`; `F (...)` does not try to prove falsity."""
    prove = not text.startswith("F ")
    return engine.text(text[2:] if text[:2] in ("T ", "F ") else text, prove)


@command("extract")
def extract(engine: Engine, text: str, variable: str = "?X") -> DataFrame:
    """(value): the bindings of one variable alone."""
    return engine.query(text).rows.select(F.col(variable.lstrip("?")).alias("value")).distinct()


@command("remove")
def remove(engine: Engine, text: str, other: str) -> DataFrame:
    """Rows of the first query that the second, of the same variables, does not give."""
    a, b = engine.query(text).rows, engine.query(other).rows
    return a.join(b.select(*a.columns), a.columns, "left_anti")


@command("find")
def find(engine: Engine, texts: DataFrame, keep: str | None = None) -> DataFrame:
    """(text, term): terms by alias or date; keep: a query of ?X that a term has to fulfil."""
    from gnosia.sources.files import find_nodes

    got = find_nodes(engine.kb, texts)
    return got if keep is None else got.join(engine.query(keep).rows.select(F.col("X").alias("term")), "term", "left_semi").select("text", "term")


@command("justify")
def justify(engine: Engine, text: str) -> DataFrame:
    """(step, branch, pred, args, sign) of one proof."""
    steps = [(i, b, p, " ".join(a), s) for i, (b, p, a, s) in enumerate(engine.justify(text))]
    return engine.spark.createDataFrame(steps, "step int, branch int, pred string, args string, sign int")


@command("validArg")
def valid_argument(engine: Engine, pred: str, pos: int, term: str) -> bool:
    return constraints.valid_argument(engine.kb, pred, pos, term)


@command("validEdge")
def valid_edge(engine: Engine, text: str) -> str:
    return constraints.valid_edge(engine.kb, text) or "1"


@command("common")
def named(engine: Engine, which: str, *given: str) -> DataFrame:
    return common.run(engine.kb, which, *given)


def writer(engine: Engine, terms: set[str]) -> Writer:
    """A text writer that knows the names of the given terms and all templates."""
    names = analytics.names(engine.kb)
    looked = {r["term"]: r["name"] for r in names.where(F.col("term").isin(*terms)).collect()} if terms else {}
    e = engine.kb.active.where((F.col("pred") == "nlpPredicateString") & (F.col("sign") == 1))
    return Writer(looked, {r[0]: r[1].strip('"') for r in e.select("arg1", "arg2").collect()})


def _atoms(expr) -> set[str]:
    return {expr} if isinstance(expr, str) else {a for x in expr for a in _atoms(x)}


@command("nl")
def natural(engine: Engine, mode: str, text: str) -> str:
    """N a term, E an assertion, Q a query, M marked-up text."""
    if mode == "M":
        return writer(engine, set()).markup(text)
    expr = sexpr.parse(text)
    w = writer(engine, {a for a in _atoms(expr) if a[0] not in "?'\""})
    return w.term(expr) if mode == "N" else w.sentence(expr, query=mode == "Q")


@command("prove")
def prove(engine: Engine, text: str) -> bool:
    return engine.query(text).state == TRUE
