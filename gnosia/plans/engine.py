"""Compiler of S-expression queries to DataFrames, in three-valued logic.

A query with variables has rows (one column for each variable) and is TRUE if there are any, else NIL. A ground query
has only a state. Conjunctions are natural joins whose order is fixed when they are planned (fewest unbound variables,
then most bound arguments; evaluatable predicates as soon as they are bound), so that the first refuted part makes the
whole FALSE and the first empty part NIL, whatever the data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gnosia import model
from gnosia.functions import dates
from gnosia.operators import closure as C
from gnosia.operators.kb import FALSE, KB, NIL, TRUE, pair
from gnosia.plans import sexpr


class QueryFault(ValueError):
    """A query that has no meaning, such as a comparison of unbound variables only."""


class Answer:
    """State of a query; rows if it has variables; the reason of a refutation by a constraint.

    A state that depends on whether there are rows is found when it is asked for, so that rows alone are computed once.
    """

    def __init__(self, state: str | None, rows: DataFrame | None = None, reason: str | None = None, variables: list[str] | None = None) -> None:
        self._state, self.rows, self.reason, self.variables = state, rows, reason, variables or []

    @property
    def state(self) -> str:
        if self._state is None:
            self._state = NIL if self.rows.isEmpty() else TRUE
        return self._state


def column(variable: str) -> str:
    return variable.lstrip("?") or "X"


def _joined(a: DataFrame | None, b: DataFrame) -> DataFrame:
    if a is None:
        return b
    shared = [c for c in a.columns if c in b.columns]
    return a.join(b, shared) if shared else a.crossJoin(b)


# ---- evaluatable predicates: name -> arguments as columns, now -> truth (null: not comparable)


def _numbers(op: Callable[[Column, Column], Column]):
    def fn(args: list[Column], kb: KB) -> Column:
        if len(args) != 2:
            return F.lit(None).cast("boolean")
        return op(model.number(args[0]), model.number(args[1]))

    return fn


def _equals(args: list[Column], kb: KB) -> Column:
    out = F.lit(True)
    for a, b in zip(args, args[1:], strict=False):
        out = out & (a == b)
    return out


def _numeric(args: list[Column], kb: KB) -> Column:
    """Term equality, as the name does not say; by value with numeric_equals."""
    if not kb.numeric_equals:
        return _equals(args, kb)
    out = F.lit(True)
    for a, b in zip(args, args[1:], strict=False):
        out = out & (model.number(a) == model.number(b))
    return out


def _different(args: list[Column], kb: KB) -> Column:
    return F.size(F.array_distinct(F.array(*args))) == len(args)


def _later(args: list[Column], kb: KB) -> Column:
    a, b = args[:2]
    return F.when(model.is_node(a) & model.is_node(b), dates.later(a, b, kb.now))


EVALUATABLE: dict[str, Callable[[list[Column], KB], Column]] = {
    "different": _different, "equals": _equals, "numericallyEquals": _numeric, "laterThan": _later,
    "lessThan": _numbers(lambda a, b: a < b), "lessThanOrEqualTo": _numbers(lambda a, b: a <= b),
    "greaterThan": _numbers(lambda a, b: a > b), "greaterThanOrEqualTo": _numbers(lambda a, b: a >= b),
}


class Engine:
    """Queries over one knowledge base. register() adds a predicate of one's own."""

    def __init__(self, kb: KB) -> None:
        self.kb, self.spark = kb, kb.spark
        self.relations: dict[str, Callable] = {
            "genls": self._transitive, "genlPreds": self._transitive, "isa": self._isa, "resultIsa": self._isa, "resultGenl": self._isa,
            "disjointWith": self._disjoint, "assertedSentence": self._asserted,
        }
        self.provers: dict[str, Callable[[DataFrame], DataFrame]] = {
            "genls": kb.prove_genls, "genlPreds": lambda p: kb.prove_genls(p, "genlPreds"), "isa": kb.prove_isa, "disjointWith": kb.prove_disjoint,
        }
        self.evaluatable = dict(EVALUATABLE)

    def register(self, name: str, relation: Callable | None = None, evaluate: Callable | None = None, prove: Callable | None = None) -> None:
        """relation(engine, expr, bound) -> rows of the variables; evaluate(columns, kb) -> truth; prove(pairs) -> states."""
        if relation:
            self.relations[name] = lambda expr, bound: relation(self, expr, bound)
        if evaluate:
            self.evaluatable[name] = evaluate
        if prove:
            self.provers[name] = prove

    # ---- entry points

    def query(self, text: str | tuple, prove_false: bool = True) -> Answer:
        """Answer of a query text. prove_false: try the integrity constraints when a ground query is unknown."""
        expr = sexpr.parse(text) if isinstance(text, str) else text
        if not isinstance(expr, tuple):
            raise QueryFault("a query is a list")
        flip = 1
        while expr[0] == "not" and len(expr) == 2 and isinstance(expr[1], tuple):
            flip, expr = -flip, expr[1]
        names = sexpr.variables(expr)
        if names:
            if flip < 0:  # a refutation binds nothing
                return Answer(NIL, self._empty(names), variables=names)
            state, rows = self._rows(expr, frozenset())
            keep = [column(v) for v in names if not v.startswith("??")]
            rows = rows.select(*keep).distinct() if keep else rows.select(F.lit(True).alias("any")).distinct()
            return Answer(state, rows, variables=names)
        state, reason = self._state(expr), None
        if state == NIL and prove_false and expr[0] not in ("and", "or", "assertedSentence", *self.evaluatable):
            reason = self._violation(expr)
            state = FALSE if reason else NIL
        if flip < 0:
            state = {TRUE: FALSE, FALSE: TRUE}.get(state, NIL)
        return Answer(state, None, reason)

    def text(self, query: str, prove_false: bool = True, offset: int = 0, limit: int | None = None) -> str:
        """The protocol form: `n|?X/val|...|`, `0|NIL`, `0|F|reason`, `1|T`."""
        got = self.query(query, prove_false)
        if got.rows is None:
            return "1|T" if got.state == TRUE else f"0|F|{got.reason or ''}" if got.state == FALSE else "0|NIL"
        rows = got.rows.orderBy(*got.rows.columns).offset(offset)
        rows = (rows if limit is None else rows.limit(limit)).collect()
        if not rows:
            return "0|NIL"
        return f"{len(rows)}|" + "|".join(",".join(f"?{c}/{r[c]}" for c in got.rows.columns) for r in rows) + "|"

    def _empty(self, names: list[str]) -> DataFrame:
        return self.spark.createDataFrame([], ", ".join(f"`{column(v)}` string" for v in names))

    # ---- states of ground queries

    def _state(self, expr: tuple) -> str:
        name = expr[0]
        if name == "not" and len(expr) == 2:
            return {TRUE: FALSE, FALSE: TRUE}.get(self._state(expr[1]), NIL)
        if name == "and":
            for part in self._order(expr[1:]):
                if (state := self._state(part)) != TRUE:
                    return state
            return TRUE
        if name == "or":
            states = [self._state(x) for x in expr[1:]]
            return TRUE if TRUE in states else FALSE if self.kb.strict_or and states and set(states) == {FALSE} else NIL
        if name in self.evaluatable:
            got = self.spark.range(1).select(self.evaluatable[name]([F.lit(sexpr.text(x)) for x in expr[1:]], self.kb)).first()[0]
            return NIL if got is None else TRUE if got else FALSE
        if name == "assertedSentence":
            return self._edge_state(self._asserted_edges(expr[1]), expr[1])
        if name in self.provers and len(expr) == 3:
            return self.provers[name](pair(self.spark, sexpr.text(expr[1]), sexpr.text(expr[2]))).first()["state"]
        if name in ("resultIsa", "resultGenl"):
            rows = self._isa((name, expr[1], "?X"), frozenset())
            return NIL if rows.where(F.col("X") == sexpr.text(expr[2])).isEmpty() else TRUE
        return self._edge_state(self._default_edges(expr), expr)

    def _edge_state(self, edges: DataFrame, expr: tuple) -> str:
        signs = {r[0] for r in self._matching(edges, expr).select("sign").distinct().collect()}
        return TRUE if 1 in signs else FALSE if -1 in signs else NIL

    def _violation(self, expr: tuple) -> str | None:
        from gnosia.operators import constraints

        return constraints.first_violation(self.kb, expr)

    # ---- rows of queries with variables

    def _rows(self, expr: tuple, bound: frozenset[str]) -> tuple[str | None, DataFrame]:
        """(state if it is already known, rows of all variables)."""
        name = expr[0]
        if name == "and":
            return self._and(expr[1:], bound)
        if name == "or":
            parts = [self._rows(x, bound)[1] for x in expr[1:] if sexpr.variables(x)]
            names = [column(v) for v in sexpr.variables(expr)]
            out = None
            for p in parts:
                p = p.select(*[F.col(c) if c in p.columns else F.lit(None).cast("string").alias(c) for c in names])
                out = p if out is None else out.union(p)
            return None, (out if out is not None else self._empty(names)).distinct()
        if name == "not":
            return NIL, self._empty(sexpr.variables(expr))
        if name in self.evaluatable:
            raise QueryFault(f"{name} needs its variables bound by another part")
        return None, self.relations.get(name, self._default)(expr, bound)

    def _order(self, parts: tuple, bound: frozenset[str] = frozenset()) -> list[tuple]:
        """The static order of a conjunction's parts."""
        left, out, have = list(parts), [], set(bound)
        while left:
            ready = [x for x in left if x[0] in self.evaluatable and have.issuperset(sexpr.variables(x))]
            if ready:
                best = ready[0]
            else:
                others = [x for x in left if x[0] not in self.evaluatable]
                if not others:
                    raise QueryFault("the variables of a comparison are not bound by any other part")

                def rank(x: tuple) -> tuple[int, int, int]:
                    args = sexpr.variables(x)
                    free = sum(v not in have for v in args)
                    return free, -(sum(not sexpr.is_variable(a) for a in x[1:]) + len(args) - free), parts.index(x)

                best = min(others, key=rank)
            left.remove(best)
            out.append(best)
            have |= set(sexpr.variables(best))
        return out

    def _and(self, parts: tuple, bound: frozenset[str]) -> tuple[str | None, DataFrame]:
        names = [v for v in dict.fromkeys(v for x in parts for v in sexpr.variables(x))]
        rows: DataFrame | None = None
        have = set(bound)
        for part in self._order(parts, bound):
            mine = sexpr.variables(part)
            if not mine:
                if (state := self._state(part)) != TRUE:
                    return state, self._empty(names)
                continue
            if part[0] in self.evaluatable:
                args = [F.col(column(a)) if sexpr.is_variable(a) else F.lit(sexpr.text(a)) for a in part[1:]]
                rows = rows.where(F.coalesce(self.evaluatable[part[0]](args, self.kb), F.lit(False)))
                continue
            got = self._rows(part, frozenset(have))[1]
            # repeated edges go after each join, where there are fewer rows than in a whole relation
            rows = got if rows is None else _joined(rows, got).distinct()
            have |= set(mine)
        return None, rows

    # ---- relations

    def _select(self, df: DataFrame, expr: tuple, columns: list[str]) -> DataFrame:
        """Filter on constants and repeated variables, name the columns of the variables."""
        first: dict[str, str] = {}
        for x, c in zip(expr[1:], columns, strict=True):
            if not sexpr.is_variable(x):
                if isinstance(x, tuple) and sexpr.variables(x):
                    raise QueryFault("a variable inside a functional term is not supported")
                df = df.where(F.col(c) == sexpr.text(x))
            elif x in first:
                df = df.where(F.col(c) == F.col(first[x]))
            else:
                first[x] = c
        return df.select(*[F.col(c).alias(column(v)) for v, c in first.items()])

    def _one(self, name: str, value) -> DataFrame:
        return self.spark.createDataFrame([(sexpr.text(value),)], f"{name} string")

    def _transitive(self, expr: tuple, bound: frozenset[str]) -> DataFrame:
        kb, (pred, a, b) = self.kb, expr
        if sexpr.is_variable(a) and sexpr.is_variable(b):
            if a == b or not {a, b} & bound:
                return self._empty(sexpr.variables(expr))
            return self._select(kb.closure(pred), expr, ["lo", "hi"])
        if sexpr.is_variable(b):
            up = kb.upward(self._one("lo", a).select(model.literal_type(F.col("lo")).alias("lo")), pred)
            own = kb.occurring(pred).select(F.col("term").alias("hi"))
            up = up.where("dist > 0").select("hi").union(up.where("dist = 0").select("hi").join(own, "hi", "left_semi"))
            return up.select(F.col("hi").alias(column(b))).distinct()
        down = kb.downward(self._one("hi", b), pred)
        own = kb.occurring(pred).select(F.col("term").alias("lo"))
        down = down.where("dist > 0").select("lo").union(down.where("dist = 0").select("lo").join(own, "lo", "left_semi"))
        return down.select(F.col("lo").alias(column(a))).distinct()

    def _isa(self, expr: tuple, bound: frozenset[str]) -> DataFrame:
        kb, (pred, a, b) = self.kb, expr
        if sexpr.is_variable(a) and sexpr.is_variable(b):
            if a == b or not {a, b} & bound:
                return self._empty(sexpr.variables(expr))
            return self._select(kb.types(pred=pred), expr, ["a", "b"])
        if sexpr.is_variable(b):
            term = self._one("term", a).select(model.literal_type(F.col("term")).alias("term"))
            return kb.types(term, pred).select(F.col("b").alias(column(b))).distinct()
        return kb.instances(self._one("hi", b), pred).select(F.col("a").alias(column(a))).distinct()

    def _disjoint(self, expr: tuple, bound: frozenset[str]) -> DataFrame:
        kb, (_, a, b) = self.kb, expr
        if sexpr.is_variable(a) and sexpr.is_variable(b):
            if a == b or not {a, b} & bound:
                return self._empty(sexpr.variables(expr))
            return self._select(kb.disjoint_partners(kb.occurring("genls").union(kb.occurring("disjointWith"))), expr, ["a", "b"])
        const, var = (b, a) if sexpr.is_variable(a) else (a, b)
        return kb.disjoint_partners(self._one("term", const)).select(F.col("b").alias(column(var))).distinct()

    def _asserted_edges(self, inner: tuple) -> DataFrame:
        return self._with_swapped(self.kb.active.where(F.col("pred") == sexpr.text(inner[0])), inner)

    def _with_swapped(self, edges: DataFrame, inner: tuple) -> DataFrame:
        edges = edges.select("arg1", "arg2", "args", "arity", "sign")
        if len(inner) == 3 and self.kb.is_symmetric(sexpr.text(inner[0])):
            edges = edges.union(edges.select(F.col("arg2"), F.col("arg1"), "args", "arity", "sign"))
        return edges

    def _default_edges(self, expr: tuple) -> DataFrame:
        subs = self.kb.sub_predicates(sexpr.text(expr[0]))
        return self._with_swapped(self.kb.active.join(F.broadcast(subs), "pred", "left_semi"), expr)

    def _matching(self, edges: DataFrame, expr: tuple) -> DataFrame:
        n = len(expr) - 1
        place = lambda i: F.col(f"arg{i + 1}") if i < 2 else F.element_at("args", i + 1)
        out = edges.where(F.col("arity") == n).select("sign", *[place(i).alias(f"a{i}") for i in range(n)])
        for i, x in enumerate(expr[1:]):
            if not sexpr.is_variable(x):
                out = out.where(F.col(f"a{i}") == sexpr.text(x))
        return out

    def _asserted(self, expr: tuple, bound: frozenset[str]) -> DataFrame:
        inner = expr[1]
        rows = self._matching(self._asserted_edges(inner), inner).where("sign = 1")
        return self._select(rows, inner, [f"a{i}" for i in range(len(inner) - 1)])

    def _default(self, expr: tuple, bound: frozenset[str]) -> DataFrame:
        rows = self._matching(self._default_edges(expr), expr).where("sign = 1")
        return self._select(rows, expr, [f"a{i}" for i in range(len(expr) - 1)])

    # ---- justification

    def justify(self, text: str | tuple, bindings: dict[str, str] | None = None) -> list[tuple]:
        """Edges (branch, pred, args, sign) that prove or refute a ground query; empty if it is unknown.

        bindings: values of the query's variables. Branches separate the parts of a conjunction or of a sibling proof.
        """
        expr = sexpr.parse(text) if isinstance(text, str) else text
        expr = sexpr.substitute(expr, bindings or {})
        if sexpr.variables(expr):
            raise QueryFault("justify needs all variables bound")
        while expr[0] == "not" and len(expr) == 2:
            expr = expr[1]
        if expr[0] in ("and", "or"):
            out: list[tuple] = []
            for part in self._order(expr[1:]) if expr[0] == "and" else expr[1:]:
                found = self.justify(part)
                if not found and expr[0] == "and":
                    return []
                branch = max((e[0] for e in out), default=-1) + 1
                out += [(e[0] + branch, *e[1:]) for e in found]
                if found and expr[0] == "or":
                    break
            return out
        if expr[0] in self.evaluatable:
            return [(0, expr[0], tuple(map(sexpr.text, expr[1:])), 1)] if self._state(expr) != NIL else []
        if expr[0] in ("genls", "genlPreds"):
            return self._chain(expr[0], sexpr.text(expr[1]), sexpr.text(expr[2]))
        if expr[0] == "isa":
            return self._type_proof(sexpr.text(expr[1]), sexpr.text(expr[2]))
        if expr[0] == "disjointWith":
            return self._disjoint_proof(sexpr.text(expr[1]), sexpr.text(expr[2]))
        inner = expr[1] if expr[0] == "assertedSentence" else expr
        edges = self.kb.active.where(F.col("pred") == sexpr.text(inner[0])) if expr[0] == "assertedSentence" else self.kb.active.join(self.kb.sub_predicates(sexpr.text(inner[0])), "pred", "left_semi")
        args = [sexpr.text(x) for x in inner[1:]]
        hit = edges.where(F.col("args") == F.array(*map(F.lit, args)))
        if len(args) == 2 and self.kb.is_symmetric(sexpr.text(inner[0])):
            hit = hit.union(edges.where(F.col("args") == F.array(*map(F.lit, args[::-1]))))
        row = hit.orderBy(F.col("sign").desc(), "edge_id").select("pred", "args", "sign").first()
        return [] if row is None else [(0, row[0], tuple(row[1]), row[2])]

    def _path(self, pred: str, a: str, b: str) -> list[str] | None:
        if a == b:
            return [a]
        row = C.path_justifications(self.kb.step(pred), self.spark.createDataFrame([(a, b)], "lo string, hi string")).first()
        return None if row is None else list(row["path"])

    def _steps(self, pred: str, path: list[str]) -> list[tuple]:
        return [(0, pred, (x, y), 1) for x, y in zip(path, path[1:], strict=False)]

    def _chain(self, pred: str, a: str, b: str) -> list[tuple]:
        state = self._state((pred, a, b))
        if state == TRUE:
            path = self._path(pred, a, b) or [a]
            return self._steps(pred, path) or [(0, pred, (a, b), 1)]
        if state == FALSE:
            up = self.kb.upward(self._one("lo", a), pred)
            no = self.kb.asserted(pred, -1).where(F.col("b") == b)
            row = up.join(no, up.hi == no.a).orderBy("dist", "hi").select("hi").first()
            if row:
                return [*self._steps(pred, self._path(pred, a, row[0]) or [a]), (0, pred, (row[0], b), -1)]
        return []

    def _type_proof(self, a: str, b: str) -> list[tuple]:
        kb = self.kb
        term = self._one("term", a).select(model.literal_type(F.col("term")).alias("term"))
        state = self._state(("isa", a, b))
        no = kb.active.where((F.col("pred") == "isa") & (F.col("sign") == -1) & (F.col("arg1") == a) & (F.col("arg2") == b))
        if state == FALSE and not no.isEmpty():
            return [(0, "isa", (a, b), -1)]
        direct = kb.asserted("isa").join(term.select(F.col("term").alias("a")), "a", "left_semi").union(kb.function_results("resultIsa", term)).distinct()
        if state == TRUE:
            up = kb.upward(direct.select(F.col("b").alias("lo"))).where(F.col("hi") == b)
            row = up.orderBy("dist", "lo").first()
            return [] if row is None else [(0, "isa", (a, row["lo"]), 1), *self._steps("genls", self._path("genls", row["lo"], b) or [b])]
        if state == FALSE:
            up = kb.upward(direct.select(F.col("b").alias("lo")))
            against = kb.asserted("genls", -1).where(F.col("b") == b)
            row = up.join(against, up.hi == against.a).orderBy("dist", "lo").select("lo", "hi").first()
            if row:
                return [(0, "isa", (a, row[0]), 1), *self._steps("genls", self._path("genls", row[0], row[1]) or [row[0]]), (0, "genls", (row[1], b), -1)]
        return []

    def _disjoint_proof(self, a: str, b: str) -> list[tuple]:
        kb = self.kb
        state = self._state(("disjointWith", a, b))
        if state == NIL:
            return []
        for x, y in ((a, b), (b, a)):
            if state == FALSE and self._state(("genls", x, y)) == TRUE:
                return self._chain("genls", x, y)
        ua, ub = kb.upward(self._one("lo", a)).select(F.col("hi").alias("x"), F.col("dist").alias("da")), kb.upward(self._one("lo", b)).select(F.col("hi").alias("y"), F.col("dist").alias("db"))
        only_a, only_b = ua.join(ub.select(F.col("y").alias("x")), "x", "left_anti"), ub.join(ua.select(F.col("x").alias("y")), "y", "left_anti")
        met = only_a.join(kb.axioms(), "x").join(only_b, "y").where(F.col("sign") == (1 if state == TRUE else -1))
        row = met.orderBy(F.col("da") + F.col("db"), "x", "y").first()
        if row:
            there = not kb.active.where((F.col("pred") == "disjointWith") & (F.col("arg1") == row["x"]) & (F.col("arg2") == row["y"])).isEmpty()
            axiom = (row["x"], row["y"]) if there else (row["y"], row["x"])
            back = self._steps("genls", self._path("genls", b, row["y"]) or [b])[::-1]
            return [*self._steps("genls", self._path("genls", a, row["x"]) or [a]), (0, "disjointWith", axiom, row["sign"]), *back]
        ends = self.spark.createDataFrame([(a,), (b,)], "hi string")
        below = kb.downward(ends).select("lo", "hi").union(kb.instances(ends).select(F.col("a").alias("lo"), F.col("b").alias("hi"))).distinct()
        common = below.groupBy("lo").agg(F.countDistinct("hi").alias("n")).where("n = 2").orderBy("lo").first()
        if state == FALSE and common:
            z = common[0]
            left = self._chain("genls", z, a) or self._type_proof(z, a)
            right = self._chain("genls", z, b) or self._type_proof(z, b)
            return [*left, *right[::-1]]
        member = kb.sibling_members()
        row = member.where(F.col("a") == a).join(member.where((F.col("a") == b) & F.lit(a != b)), "t", "left_semi").orderBy("t").first()
        if row:
            parts = [self._type_proof(a, row["t"]), self._type_proof(b, row["t"]), self._type_proof(row["t"], "SiblingDisjointCollectionType")]
            out = [(i, *e[1:]) for i, p in enumerate(parts) for e in p]
            return out + ([(3, "siblingDisjointExceptions", (a, b), 1)] if state == FALSE else [])
        return []
