"""Validated ingest: integrity constraints over a batch of candidate edges.

Each constraint is one set-based violation query; the first that an edge breaks gives its code. validate() checks a whole
batch against the knowledge base as it is; admit() also checks the edges of the batch against each other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gnosia import model
from gnosia.operators import closure as C
from gnosia.operators.kb import FALSE, KB, TRUE
from gnosia.operators.tables import written as checkpointed
from gnosia.plans import sexpr

#: Error codes in the order of their checks, and whether an edge may pass in a later attempt.
CODES = {
    "VARIABLE": False, "NON_NODE": False, "ARITY": False, "ARG": True, "DISJOINT": True, "COLLECTION_ORDER": True, "CYCLIC": False, "NEGATED": True,
}
#: Predicates to which edges of sub-predicates are propagated, in this order.
PROPAGATED = ("isa", "genls", "disjointWith", "genlMt", "genlInverse")


@dataclass
class Checked:
    accepted: DataFrame
    rejects: DataFrame
    forced: DataFrame | None = None


def argument_constraints(kb: KB, kind: str) -> DataFrame:
    """(pred, pos, type) by argIsa or argGenl, in the general form and in that with the position in the name; Thing binds nothing."""
    general = kb.active.where((F.col("pred") == f"arg{kind}") & (F.col("sign") == 1) & (F.col("arity") == 3))
    general = general.select(F.col("arg1").alias("pred"), model.number(F.col("arg2")).cast("int").alias("pos"), F.element_at("args", 3).alias("type"))
    numbered = kb.active.where(F.col("pred").rlike(f"^arg[0-9]+{kind}$") & (F.col("sign") == 1))
    numbered = numbered.select(F.col("arg1").alias("pred"), F.regexp_extract("pred", "^arg([0-9]+)", 1).try_cast("int").alias("pos"), F.col("arg2").alias("type"))
    return general.union(numbered).where(F.col("type") != "Thing").distinct()


def argument_violations(kb: KB, edges: DataFrame) -> DataFrame:
    """(edge_id, pos, term, kind, type): arguments that are no instance (argIsa) or no kind (argGenl) of what is asked."""
    args = edges.select("edge_id", "pred", F.posexplode("args").alias("i", "term")).select("edge_id", "pred", (F.col("i") + 1).alias("pos"), "term")
    need_isa = checkpointed(args.join(argument_constraints(kb, "Isa"), ["pred", "pos"]).select("edge_id", "pos", "term", "type"))
    need_genl = checkpointed(args.join(argument_constraints(kb, "Genl"), ["pred", "pos"]).select("edge_id", "pos", "term", "type"))
    literal = model.literal_type(F.col("term"))
    types = kb.types(need_isa.select(literal.alias("term"))).select(F.col("a").alias("t"), F.col("b").alias("type"))
    strings = kb.spark.createDataFrame([("CharacterString",)], "lo string")
    text_types = kb.upward(strings).select(F.col("hi").alias("type")).union(kb.downward(strings.select(F.col("lo").alias("hi"))).select(F.col("lo").alias("type"))).distinct()
    bad = need_isa.withColumn("t", literal).join(types, ["t", "type"], "left_anti").drop("t")
    is_text = model.is_string(F.col("term"))
    bad = bad.where(~is_text).unionByName(bad.where(is_text).join(text_types, "type", "left_anti").select("edge_id", "pos", "term", "type"))
    proofs = kb.prove_genls(need_genl.select(F.col("term").alias("a"), F.col("type").alias("b"))).where(F.col("state") == TRUE).select(F.col("a").alias("term"), F.col("b").alias("type"))
    bad_genl = need_genl.join(proofs, ["term", "type"], "left_anti")
    return bad.withColumn("kind", F.lit("Isa")).unionByName(bad_genl.withColumn("kind", F.lit("Genl")))


def _members(kb: KB, cls: str) -> DataFrame:
    """(term): all instances of one class, found from the class downwards."""
    return kb.instances(kb.spark.createDataFrame([(cls,)], "hi string")).select(F.col("a").alias("term")).distinct()


def orders(kb: KB, terms: DataFrame) -> DataFrame:
    """(term, order): the collection orders that a term is an instance of."""
    order = checkpointed(_members(kb, "CollectionOrder"))
    below = kb.instances(order.select(F.col("term").alias("hi")))
    return below.join(terms.select(F.col("term").alias("a")).distinct(), "a", "left_semi").select(F.col("a").alias("term"), F.col("b").alias("order"))


def order_violations(kb: KB, edges: DataFrame) -> DataFrame:
    """edge_id of genls edges between different orders, and of isa edges that do not step up exactly one order."""
    both = edges.where(F.col("pred").isin("isa", "genls") & (F.col("arity") == 2)).select("edge_id", "pred", "arg1", "arg2")
    known = checkpointed(orders(kb, both.select(F.col("arg1").alias("term")).union(both.select(F.col("arg2").alias("term")))))
    a, b = known.select(F.col("term").alias("arg1"), F.col("order").alias("x")), known.select(F.col("term").alias("arg2"), F.col("order").alias("y"))
    met = both.join(a, "arg1").join(b, "arg2")
    genls = met.where((F.col("pred") == "genls") & (F.col("x") != F.col("y"))).select("edge_id")
    steps = kb.types(known.select(F.col("order").alias("term"))).select(F.col("a").alias("x"), F.col("b").alias("y"), F.lit(True).alias("up")).distinct()
    isa = met.where(F.col("pred") == "isa").join(steps, ["x", "y"], "left").groupBy("edge_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.coalesce("up", F.lit(False))).alias("ok"))
    isa = isa.where((F.col("n") != 1) | ~F.col("ok")).select("edge_id")
    collections, first_order = _members(kb, "Collection").withColumnRenamed("term", "arg1"), _members(kb, "FirstOrderCollection").withColumnRenamed("term", "arg2")
    into = both.where(F.col("pred") == "isa").join(collections, "arg1", "left_semi").join(first_order, "arg2", "left_semi").select("edge_id")
    return genls.union(isa).union(into).distinct()


def _named(edges: DataFrame, *names: str) -> set[str]:
    """Which of these predicates occur: a proof without goals is planned at length and finds nothing."""
    return {r.pred for r in edges.where(F.col("pred").isin(*names)).select("pred").distinct().collect()}


def disjoint_violations(kb: KB, edges: DataFrame) -> DataFrame:
    """edge_id of isa and genls edges that join disjoint classes, and of axioms between classes that overlap."""
    e = edges.where((F.col("arity") == 2) & (F.col("sign") == 1)).select("edge_id", "pred", "arg1", "arg2")
    isa = e.where(F.col("pred") == "isa").join(kb.asserted("isa").select(F.col("a").alias("arg1"), F.col("b").alias("t")), "arg1").where(F.col("t") != F.col("arg2")).select("edge_id", F.col("t").alias("a"), F.col("arg2").alias("b"))
    genls = e.where(F.col("pred") == "genls").select("edge_id", F.col("arg1").alias("a"), F.col("arg2").alias("b"))
    # classes that the lower end's instances and specs stand under already
    below = kb.downward(genls.select(F.col("a").alias("hi"))).where("dist > 0").select(F.col("hi").alias("a"), F.col("lo").alias("spec"))
    genls = genls.union(genls.join(below, "a").select("edge_id", F.col("spec").alias("a"), "b"))
    axioms = e.where(F.col("pred") == "disjointWith").select("edge_id", F.col("arg1").alias("a"), F.col("arg2").alias("b"))
    apart = checkpointed(isa.union(genls).distinct())
    bad, clash = apart.limit(0), axioms.limit(0)
    if not apart.isEmpty():
        bad = apart.join(kb.prove_disjoint(apart, want_false=False).where(F.col("state") == TRUE).select("a", "b"), ["a", "b"], "left_semi")
    if not axioms.isEmpty():
        clash = axioms.join(kb.prove_disjoint(axioms).where(F.col("state") == FALSE).select("a", "b"), ["a", "b"], "left_semi")
    return bad.select("edge_id").union(clash.select("edge_id")).distinct()


def _monotonic(kb: KB) -> DataFrame:
    mono = _members(kb, "DefaultMonotonicPredicate").withColumnRenamed("term", "pred").union(kb.spark.createDataFrame([("isa",), ("genls",)], "pred string"))
    return mono.distinct().join(_members(kb, "SymmetricBinaryPredicate").withColumnRenamed("term", "pred"), "pred", "left_anti")


def cyclic_violations(kb: KB, edges: DataFrame) -> DataFrame:
    """edge_id of binary edges of monotonic predicates whose inverse holds already."""
    e = edges.where((F.col("arity") == 2) & (F.col("sign") == 1) & (F.col("arg1") != F.col("arg2")))
    there = _named(e, "genls", "genlPreds", "isa")
    e = e.join(_monotonic(kb), "pred", "left_semi").select("edge_id", "pred", F.col("arg2").alias("a"), F.col("arg1").alias("b"))
    out = e.select("edge_id").limit(0)
    for name, prove in (("genls", kb.prove_genls), ("genlPreds", lambda p: kb.prove_genls(p, "genlPreds")), ("isa", kb.prove_isa)):
        if name in there:
            mine = e.where(F.col("pred") == name)
            out = out.union(mine.join(prove(mine.select("a", "b")).where(F.col("state") == TRUE).select("a", "b"), ["a", "b"], "left_semi").select("edge_id"))
    others = e.where(~F.col("pred").isin("genls", "genlPreds", "isa"))
    direct = kb.active.where(F.col("sign") == 1).select("pred", F.col("arg1").alias("a"), F.col("arg2").alias("b"))
    return out.union(others.join(direct, ["pred", "a", "b"], "left_semi").select("edge_id")).distinct()


def negated_violations(kb: KB, edges: DataFrame) -> DataFrame:
    """edge_id of edges whose opposite holds already."""
    e = edges.where(F.col("arity") == 2).select("edge_id", "pred", "sign", F.col("arg1").alias("a"), F.col("arg2").alias("b"))
    there, out = _named(e, "genls", "isa"), e.select("edge_id").limit(0)
    for name, prove in (("genls", kb.prove_genls), ("isa", kb.prove_isa)):
        if name in there:
            mine = e.where(F.col("pred") == name)
            state = prove(mine.select("a", "b")).select("a", "b", "state")
            out = out.union(mine.join(state, ["a", "b"]).where(((F.col("sign") == 1) & (F.col("state") == FALSE)) | ((F.col("sign") == -1) & (F.col("state") == TRUE))).select("edge_id"))
    others = edges.where(~F.col("pred").isin("genls", "isa")).select("edge_id", "pred", "args", "sign")
    known = kb.active.select("pred", "args", (-F.col("sign")).alias("sign"))
    return out.union(others.join(known, ["pred", "args", "sign"], "left_semi").select("edge_id")).distinct()


def validate(kb: KB, edges: DataFrame, semantic: bool = True) -> Checked:
    """Split candidate edges into accepted ones and rejects (raw, code, detail). Removed edges are not checked."""
    e = checkpointed(edges)
    live = e.where(~F.col("removed"))

    def flag(ids: DataFrame, code: str) -> DataFrame:
        return ids.select("edge_id").withColumn("code", F.lit(code))

    found = [
        flag(live.where(F.exists("args", lambda a: a.rlike(r"(^|[\s(])\?")) | F.col("pred").startswith("?")), "VARIABLE"),
        flag(live.where(~model.is_node(F.col("arg1"))), "NON_NODE"),
    ]
    if semantic:
        kb.strict("genls"), kb.strict("genls", up=False)  # once for all constraints
        arity = kb.asserted("arity").select(F.col("a").alias("pred"), model.number(F.col("b")).cast("int").alias("asked"))
        found.append(flag(live.join(arity, "pred").where(F.col("asked") != F.col("arity")), "ARITY"))
        found.append(flag(argument_violations(kb, live.where("sign = 1")), "ARG"))
        found.append(flag(disjoint_violations(kb, live), "DISJOINT"))
        found.append(flag(order_violations(kb, live.where("sign = 1")), "COLLECTION_ORDER"))
        found.append(flag(cyclic_violations(kb, live), "CYCLIC"))
        found.append(flag(negated_violations(kb, live), "NEGATED"))
    all_ = found[0]
    for f in found[1:]:
        all_ = all_.union(f)
    rank = F.create_map(*[F.lit(x) for i, c in enumerate(CODES) for x in (c, i)])
    worst = checkpointed(all_.groupBy("edge_id").agg(F.min_by("code", rank[F.col("code")]).alias("code")))
    rejects = e.join(worst, "edge_id").select(as_text().alias("raw"), "code", F.create_map(F.lit("retryable"), F.col("code").isin([c for c, again in CODES.items() if again]).cast("string")).alias("detail"))
    return Checked(e.join(worst, "edge_id", "left_anti"), rejects)


def _grown(kb: KB, more: DataFrame) -> KB:
    return KB(kb.edges.unionByName(more.select(*kb.edges.columns)), kb.isa_neg_via_genls, kb.strict_or, kb.numeric_equals, kb.now, kb.small)


def _conflicts(kb: KB, edges: DataFrame) -> DataFrame:
    """edge_id of edges that break a constraint in a knowledge base which has them all, and of direct opposites among them."""
    key = ["pred", "args", "sign"]
    opposite = edges.select("edge_id", *key).join(edges.select("pred", "args", (-F.col("sign")).alias("sign")), key, "left_semi").select("edge_id")
    return checkpointed(opposite.union(disjoint_violations(kb, edges)).union(cyclic_violations(kb, edges)).union(negated_violations(kb, edges)).distinct())


def admit(kb: KB, edges: DataFrame) -> Checked:
    """As if the edges came one by one in order of edge_id: of edges that contradict each other the first is accepted.

    All edges that hold together with the whole batch are accepted at once. Of the others each round accepts those that
    come first at their subject, or both their classes (only the very first if these contradict each other too), and
    checks the rest again.
    """
    got = validate(kb, edges)
    rejects, accepted = got.rejects, []
    ok = checkpointed(got.accepted)
    removed = ok.where("removed")
    ok = ok.where(~F.col("removed"))
    while not ok.isEmpty():
        if ok.limit(2).count() == 1:  # nothing to contradict
            accepted.append(ok)
            break
        flagged = _conflicts(_grown(kb, ok), ok)
        clear = checkpointed(ok.join(flagged, "edge_id", "left_anti"))
        accepted.append(clear)
        kb = _grown(kb, clear)
        held = checkpointed(ok.join(flagged, "edge_id", "left_semi"))
        if held.isEmpty():
            break
        # classes meet at both ends, other edges at what they are about; the check of `first` finds what this misses
        at = held.select("edge_id", F.explode(F.when(F.col("pred").isin("genls", "genlPreds", "disjointWith"), F.col("args")).otherwise(F.array("arg1"))).alias("term"))
        late = at.join(at.groupBy("term").agg(F.min("edge_id").alias("least")), "term").where("edge_id > least").select("edge_id").distinct()
        first = checkpointed(held.join(late, "edge_id", "left_anti"))
        # one edge alone is the very first already
        if first.limit(2).count() > 1 and not _conflicts(_grown(kb, first), first).isEmpty():
            first = checkpointed(held.orderBy("edge_id").limit(1))
        accepted.append(first)
        kb = _grown(kb, first)
        got = validate(kb, held.join(first.select("edge_id"), "edge_id", "left_anti"))
        rejects = rejects.unionByName(checkpointed(got.rejects))
        ok = checkpointed(got.accepted)
    out = removed
    for x in accepted:
        out = out.unionByName(x)
    return Checked(out, rejects)


def valid_argument(kb: KB, pred: str, pos: int, term: str) -> bool:
    """Whether a term may stand at a place of a predicate; nothing is written."""
    one = kb.spark.createDataFrame([(0, pred, [None] * (pos - 1) + [term])], "edge_id long, pred string, args array<string>")
    return argument_violations(kb, one).where(F.col("pos") == pos).isEmpty()


def valid_edge(kb: KB, text: str) -> str | None:
    """Code of the first constraint that an assertion breaks; null if it holds."""
    one = model.edges_of(kb.spark, [text])
    row = validate(kb, one).rejects.select("code").first()
    return None if row is None else row[0]


def first_violation(kb: KB, expr: tuple) -> str | None:
    """Code of the constraint that refutes one ground sentence, if any (not the negation, which is the query itself)."""
    row = model.row(expr, 0)
    one = kb.spark.createDataFrame([row], model.EDGES)
    if row[5] != 2:
        return None
    rejects = validate(kb, one).rejects.select("code").first()
    return None if rejects is None else rejects[0]


def as_text() -> Column:
    """The text of an edge row, with its wrappers."""
    body = F.concat(F.lit("("), F.col("pred"), F.lit(" "), F.array_join("args", " "), F.lit(")"))
    body = F.when(F.col("sign") < 0, F.concat(F.lit("(not "), body, F.lit(")"))).otherwise(body)
    return F.when(F.col("removed"), F.concat(F.lit("(removed "), body, F.lit(")"))).otherwise(body)


def force(kb: KB, edges: DataFrame) -> Checked:
    """Validate, adding the isa and genls edges that arguments lack; an edge whose additions are refused is rejected."""
    bad = argument_violations(kb, edges)
    new = bad.select(F.when(F.col("kind") == "Isa", "isa").otherwise("genls").alias("pred"), F.col("term").alias("arg1"), F.col("type").alias("arg2"), F.lit(1).alias("sign")).where(model.is_node(F.col("arg1"))).distinct()
    additions = checkpointed(model.edges_from_pairs(new))
    ok = validate(kb, additions).accepted
    grown = KB(kb.edges.unionByName(ok), kb.isa_neg_via_genls, kb.strict_or, kb.numeric_equals, kb.now, kb.small)
    out = validate(grown, edges)
    used = argument_violations(kb, out.accepted).select(F.col("term").alias("arg1"), F.col("type").alias("arg2")).distinct()
    out.forced = ok.join(used, ["arg1", "arg2"], "left_semi").select(*ok.columns)
    return out


def propagate(kb: KB, edges: DataFrame) -> DataFrame:
    """The general edges that edges of sub-predicates imply; of several general predicates the first in PROPAGATED."""
    up = kb.strict("genlPreds").where(F.col("hi").isin(*PROPAGATED) & (F.col("lo") != F.col("hi")))
    order = F.create_map(*[F.lit(x) for i, p in enumerate(PROPAGATED) for x in (p, i)])
    best = up.groupBy(F.col("lo").alias("pred")).agg(F.min_by("hi", order[F.col("hi")]).alias("general"))
    out = edges.where(F.col("arity") == 2).join(best, "pred").select(F.col("general").alias("pred"), "arg1", "arg2", "sign").distinct()
    return model.edges_from_pairs(out)


def remove(edges: DataFrame, gone: DataFrame, keep: bool = True) -> DataFrame:
    """Edges without those whose edge_id is in gone; keep: mark them as removed instead of dropping them."""
    ids = gone.select("edge_id").distinct()
    if not keep:
        return edges.join(ids, "edge_id", "left_anti")
    return edges.join(ids.withColumn("__gone", F.lit(True)), "edge_id", "left").withColumn("removed", F.col("removed") | F.coalesce("__gone", F.lit(False))).select(*edges.columns)


def insert(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Set semantics: an edge that is there stays; a removed one that is asserted again lives again."""
    key = ["pred", "args", "sign"]
    back = new.where(~F.col("removed")).select(*key).distinct().withColumn("__back", F.lit(True))
    old = edges.join(back, key, "left").withColumn("removed", F.col("removed") & F.col("__back").isNull()).select(*edges.columns)
    fresh = new.dropDuplicates(key).join(edges.select(*key), key, "left_anti").select(*edges.columns)
    return old.unionByName(fresh)


def strictly_functional(kb: KB) -> DataFrame:
    """Edges of strictly functional predicates, the newest for each first argument alone; other edges as they are."""
    # a join by predicate would bring all edges of a predicate to one task
    slots = F.broadcast(kb.asserted("isa").where(F.col("b") == "StrictlyFunctionalSlot").select(F.col("a").alias("pred")))
    w = Window.partitionBy("pred", "arg1").orderBy(F.col("edge_id").desc())
    ours = kb.active.join(slots, "pred", "left_semi").withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return ours.unionByName(kb.active.join(slots, "pred", "left_anti"))


def rewrite_map(kb: KB) -> DataFrame:
    """(old, new) of rewriteOf edges (rewriteOf new old), chains followed to their end; the least end on a tie."""
    e = kb.asserted("rewriteOf").select(F.col("b").alias("lo"), F.col("a").alias("hi"))
    all_ = C.reach(e, small=kb.small).where("lo <> hi")
    ends = all_.join(e.select(F.col("lo").alias("hi")).distinct(), "hi", "left_anti")
    return ends.groupBy(F.col("lo").alias("old")).agg(F.min("hi").alias("new"))


def rewrite(kb: KB, edges: DataFrame | None = None) -> DataFrame:
    """Edges with every old term replaced, inside functional terms too; edges that become alike are one."""
    src = kb.active if edges is None else edges
    table = rewrite_map(kb)
    flat = src.where(F.col("pred") != "rewriteOf").select("*", F.posexplode("args").alias("__i", "__term"))
    swapped = flat.join(table, F.col("__term") == F.col("old"), "left").withColumn("__term", F.coalesce("new", "__term")).drop("old", "new")
    nested = swapped.where(model.is_function(F.col("__term")))
    tokens = nested.select("edge_id", "__i", F.posexplode(F.split(F.regexp_replace("__term", r"([()])", " $1 "), r"\s+")).alias("__k", "token")).where("token <> ''")
    done = tokens.join(table, F.col("token") == F.col("old"), "left").select("edge_id", "__i", "__k", F.coalesce("new", "token").alias("token"))
    text = done.groupBy("edge_id", "__i").agg(F.array_sort(F.collect_list(F.struct("__k", "token"))).alias("t")).select("edge_id", "__i", F.regexp_replace(F.regexp_replace(F.array_join(F.transform("t", lambda x: x["token"]), " "), r"\( ", "("), r" \)", ")").alias("__fixed"))
    fixed = swapped.join(text, ["edge_id", "__i"], "left").withColumn("__term", F.coalesce("__fixed", "__term"))
    args = fixed.groupBy("edge_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", "__term"))), lambda x: x["__term"]).alias("args"))
    out = src.where(F.col("pred") != "rewriteOf").drop("args", "arg1", "arg2").join(args, "edge_id")
    out = out.withColumns({"arg1": F.col("args")[0], "arg2": F.try_element_at("args", F.lit(2))}).select(*src.columns)
    return out.dropDuplicates(["pred", "args", "sign"]).unionByName(src.where(F.col("pred") == "rewriteOf"))


def prune_cycles(kb: KB, decisions: DataFrame, pred: str = "genls") -> DataFrame:
    """Edges after decisions (edge_id, action) on cycles: `remove` drops the edge, `rewrite` adds (rewriteOf arg2 arg1)."""
    gone = decisions.where(F.col("action") == "remove")
    merged = kb.edges.join(decisions.where(F.col("action") == "rewrite").select("edge_id"), "edge_id", "left_semi")
    extra = model.edges_from_pairs(merged.select(F.lit("rewriteOf").alias("pred"), F.col("arg2").alias("arg1"), F.col("arg1").alias("arg2"), F.lit(1).alias("sign")))
    return remove(kb.edges, gone).unionByName(extra)


def reassert_order(edges: DataFrame, depth: DataFrame | None = None) -> DataFrame:
    """Edges by the depth of their first argument (unknown last), then by id."""
    if depth is None:
        return edges.orderBy(F.col("props")["depth"].cast("int").asc_nulls_last(), "edge_id")
    return edges.join(depth.select(F.col("term").alias("arg1"), "depth"), "arg1", "left").orderBy(F.col("depth").asc_nulls_last(), "edge_id").select(*edges.columns)


def reify(edges: DataFrame, known: DataFrame) -> DataFrame:
    """Functional terms of edges, nested ones included, that the node table does not have: (term)."""
    terms = model.positions(edges).where(model.is_function(F.col("term"))).select("term").distinct()
    return terms.join(known.select("term"), "term", "left_anti")


def has_variables(text: str) -> bool:
    return bool(sexpr.variables(sexpr.parse(text)))
