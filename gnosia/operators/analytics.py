"""Batch analytics over one knowledge base: every term at once, as grouped aggregation over closures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gnosia import model
from gnosia.functions.text import concept_to_text, shortest
from gnosia.operators import closure as C
from gnosia.operators.kb import FALSE, KB, TRUE
from gnosia.operators.tables import written as checkpointed

NEG_INF = float("-inf")


def ln(n: Column) -> Column:
    """Natural logarithm with -Infinity at zero (Spark has null)."""
    return F.when(n == 0, F.lit(NEG_INF)).otherwise(F.ln(n.cast("double")))


def _count(df: DataFrame, key: str, what: str, name: str) -> DataFrame:
    return df.groupBy(F.col(key).alias("term")).agg(F.countDistinct(what).alias(name))


def _left(base: DataFrame, *parts: DataFrame) -> DataFrame:
    for p in parts:
        base = base.join(p, "term", "left")
    return base.fillna(0, [c for c, t in base.dtypes if t in ("bigint", "int")])


def _exists(kb: KB, preds: list[str]) -> DataFrame:
    return kb.active.where(F.col("pred").isin(*preds) & (F.col("sign") == 1)).select(F.col("arg1").alias("term")).distinct()


def _flag(base: DataFrame, kb: KB, preds: list[str], name: str) -> DataFrame:
    has = _exists(kb, preds).withColumn(name, F.lit(True))
    return base.join(has, "term", "left").withColumn(name, F.coalesce(name, F.lit(False)))


def collections(kb: KB) -> DataFrame:
    """(term, n_instances, n_super, n_sub, n_min_super, n_max_sub, has_alias, has_comment) of every term in genls edges."""
    strict = kb.strict("genls", up=False).where("lo <> hi")
    terms = kb.occurring("genls")
    types = kb.types()
    direct = kb.asserted("genls").where("a <> b")
    least = C.minimal(direct.select("a", F.col("b").alias("term")), strict, ["a"])
    greatest = C.maximal(direct.select("b", F.col("a").alias("term")), strict, ["b"])
    out = _left(
        terms, _count(types, "b", "a", "n_instances"), _count(strict, "lo", "hi", "n_super"), _count(strict, "hi", "lo", "n_sub"),
        _count(least, "a", "term", "n_min_super"), _count(greatest, "b", "term", "n_max_sub"),
    )
    return _flag(_flag(out, kb, ["termStrings", "prettyString", "prettyString-Canonical"], "has_alias"), kb, ["comment"], "has_comment")


def predicates(kb: KB) -> DataFrame:
    """(term, n_uses, n_super, n_sub, arity, n_arg_constraints, ...) of every predicate that is used or declared."""
    uses = kb.active.groupBy(F.col("pred").alias("term")).agg(F.count(F.lit(1)).alias("n_uses"), F.max("arity").alias("used_arity"))
    strict = kb.strict("genlPreds").where("lo <> hi")
    declared = kb.asserted("arity").groupBy(F.col("a").alias("term")).agg(F.min(model.number(F.col("b")).cast("int")).alias("arity"))
    from gnosia.operators.constraints import argument_constraints

    limits = argument_constraints(kb, "Isa").union(argument_constraints(kb, "Genl")).groupBy(F.col("pred").alias("term")).agg(F.count(F.lit(1)).alias("n_arg_constraints"))
    base = uses.select("term").union(kb.occurring("genlPreds").select("term")).distinct().join(uses, "term", "left")
    out = base.join(declared, "term", "left").withColumn("arity", F.coalesce("arity", "used_arity")).drop("used_arity")
    out = out.join(_count(strict, "lo", "hi", "n_super"), "term", "left").join(_count(strict, "hi", "lo", "n_sub"), "term", "left").join(limits, "term", "left")
    out = out.fillna(0, ["n_uses", "n_super", "n_sub", "n_arg_constraints"])
    symmetric = kb.asserted("isa").where(F.col("b") == "SymmetricBinaryPredicate").select(F.col("a").alias("term"), F.lit(True).alias("symmetric")).distinct()
    return _flag(out.join(symmetric, "term", "left").withColumn("symmetric", F.coalesce("symmetric", F.lit(False))), kb, ["comment"], "has_comment")


def functions(kb: KB) -> DataFrame:
    """(term, extent, arity, n_result_isa, n_result_genl, reifiable, has_comment) of every function in use or typed."""
    used = kb.functions().groupBy(F.col("func").alias("term")).agg(F.countDistinct("term").alias("extent"), F.max(F.size(model.term_parts("term")) - 1).alias("arity"))
    isa = _count(kb.asserted("resultIsa").union(kb.asserted("resultIsaArg")), "a", "b", "n_result_isa")
    genl = _count(kb.asserted("resultGenl").union(kb.asserted("resultGenlArg")), "a", "b", "n_result_genl")
    base = used.select("term").union(isa.select("term")).union(genl.select("term")).distinct()
    out = _left(base, used, isa, genl)
    closed = kb.asserted("isa").where(F.col("b") == "UnreifiableFunction").select(F.col("a").alias("term"), F.lit(False).alias("reifiable")).distinct()
    return _flag(out.join(closed, "term", "left").withColumn("reifiable", F.coalesce("reifiable", F.lit(True))), kb, ["comment"], "has_comment")


def individuals(kb: KB) -> DataFrame:
    """(term, n_isa, n_min_isa, has_alias, has_comment) of every term with a type that is no class itself."""
    direct = kb.asserted("isa")
    direct = direct.join(kb.occurring("genls").select(F.col("term").alias("a")), "a", "left_anti")
    least = C.minimal(direct.select("a", F.col("b").alias("term")), kb.strict("genls"), ["a"])
    out = _left(direct.select(F.col("a").alias("term")).distinct(), _count(direct, "a", "b", "n_isa"), _count(least, "a", "term", "n_min_isa"))
    return _flag(_flag(out, kb, ["termStrings", "prettyString", "prettyString-Canonical"], "has_alias"), kb, ["comment"], "has_comment")


def impact(kb: KB) -> DataFrame:
    """(term, ln_specs, ln_instances, ln_total): logarithms of the counts below each class, itself included."""
    down = kb.closure("genls", up=False)
    out = _left(kb.occurring("genls"), _count(down, "hi", "lo", "specs"), _count(kb.types(), "b", "a", "instances"))
    return out.select("term", ln(F.col("specs")).alias("ln_specs"), ln(F.col("instances")).alias("ln_instances"), ln(F.col("specs") + F.col("instances")).alias("ln_total"))


def features(kb: KB, terms: DataFrame | None = None) -> DataFrame:
    """(term, feature): types and classes above each term; what similarity compares."""
    if terms is None:
        return kb.types().select(F.col("a").alias("term"), F.col("b").alias("feature")).union(kb.closure("genls").select("lo", "hi")).distinct()
    seeds = terms.select("term").distinct()
    up = kb.upward(seeds.select(F.col("term").alias("lo")))
    own = kb.occurring("genls").select(F.col("term").alias("lo"))
    up = up.where("dist > 0").select("lo", "hi").union(up.where("dist = 0").join(own, "lo", "left_semi").select("lo", "hi"))
    return kb.types(seeds).select(F.col("a").alias("term"), F.col("b").alias("feature")).union(up).distinct()


def similarity_of(kb: KB, pairs: DataFrame) -> DataFrame:
    """(a, b, similarity): shared features over all features of both; 1 for a term with itself, NaN if neither has any.

    Feature sets meet in a join on the feature, counted before it is grouped; no set is collected.
    """
    goal = checkpointed(pairs.select("a", "b").distinct())
    feat = checkpointed(features(kb, goal.select(F.col("a").alias("term")).union(goal.select(F.col("b").alias("term")))))
    sizes = feat.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    fa, fb = feat.select(F.col("term").alias("a"), "feature"), feat.select(F.col("term").alias("b"), "feature")
    both = goal.join(fa, "a").join(fb, ["b", "feature"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("both"))
    out = goal.join(sizes.select(F.col("term").alias("a"), F.col("n").alias("na")), "a", "left").join(sizes.select(F.col("term").alias("b"), F.col("n").alias("nb")), "b", "left")
    out = out.join(both, ["a", "b"], "left").fillna(0, ["na", "nb", "both"])
    union = F.col("na") + F.col("nb") - F.col("both")
    value = F.when(F.col("a") == F.col("b"), 1.0).when(union == 0, F.lit(float("nan"))).otherwise(F.col("both") / F.nullif(union, F.lit(0)))
    return out.select("a", "b", value.alias("similarity"))


def predicates_for(kb: KB, terms: DataFrame) -> DataFrame:
    """(term, pred): predicates of positive edges in which the term is an argument."""
    e = kb.active.where("sign = 1").select("pred", F.explode("args").alias("term"))
    return e.join(terms.select("term").distinct(), "term", "left_semi").select("term", "pred").distinct()


def edges_by_predicate(kb: KB, term: str, mode: str = "T") -> DataFrame:
    """(pred, n, edges) around a term. Modes: T types and classes, TU upward ones, TD downward ones, N the rest, O all."""
    e = kb.active.where(F.exists("args", lambda a: a == term))
    taxonomic = F.col("pred").isin("isa", "genls")
    keep = {"T": taxonomic, "TU": taxonomic & (F.col("arg1") == term), "TD": taxonomic & (F.col("arg2") == term), "N": ~taxonomic, "O": F.lit(True)}[mode]
    from gnosia.operators.constraints import as_text

    return e.where(keep).groupBy("pred").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(as_text())).alias("edges"))


def extent(kb: KB, func: str) -> DataFrame:
    """(term): functional terms built with a function."""
    return kb.functions().where(F.col("func") == func).select("term").distinct()


def sort_key(term: Column, case: bool = False) -> Column:
    """Alphabetical order ignores opening parentheses and markup; without case unless asked for."""
    bare = F.regexp_replace(F.regexp_replace(term, r"\[\[([^\[\]|]+)(?:\|[^\[\]]*)?\]\]", "$1"), r"^[\s(]+", "")
    return bare if case else F.lower(bare)


def page(df: DataFrame, order: list, start: int, end: int) -> DataFrame:
    """Rows start (included) to end (excluded) of an order."""
    return df.orderBy(*order).offset(start).limit(max(0, end - start))


def names(kb: KB) -> DataFrame:
    """(term, name): canonical string, a string of one of its sub-predicates, a term string, or the name in plain words."""
    first = kb.active.where((F.col("pred") == "prettyString-Canonical") & (F.col("sign") == 1)).select(F.col("arg1").alias("term"), F.lit(0).alias("r"), F.col("arg2").alias("s"))
    subs = kb.strict("genlPreds").where("lo <> hi")

    def below(pred: str, rank: int) -> DataFrame:
        p = subs.where(F.col("hi") == pred).select(F.col("lo").alias("pred")).union(kb.spark.createDataFrame([(pred,)], "pred string"))
        return kb.active.where("sign = 1").join(p, "pred", "left_semi").select(F.col("arg1").alias("term"), F.lit(rank).alias("r"), F.col("arg2").alias("s"))

    strings = first.union(below("prettyString-Canonical", 1)).union(below("termStrings", 2)).where(model.is_string(F.col("s"))).withColumn("s", F.expr("substr(s, 2, length(s) - 2)"))
    best = strings.groupBy("term", "r").agg(shortest(F.col("s")).alias("name")).groupBy("term").agg(F.min_by("name", "r").alias("name"))
    terms = kb.active.select(F.explode("args").alias("term")).where(model.is_node(F.col("term")) & ~model.is_function(F.col("term"))).distinct()
    return terms.join(best, "term", "left").select("term", F.coalesce("name", concept_to_text(F.col("term"))).alias("name"))


# ---- disjointness by evidence


def common_parents(kb: KB, pairs: DataFrame) -> DataFrame:
    """(a, b, parent): the minimal common classes and types of each pair."""
    goal = checkpointed(pairs.select("a", "b").distinct())
    feat = checkpointed(features(kb, goal.select(F.col("a").alias("term")).union(goal.select(F.col("b").alias("term")))))
    fa, fb = feat.select(F.col("term").alias("a"), F.col("feature").alias("term")), feat.select(F.col("term").alias("b"), F.col("feature").alias("term"))
    shared = goal.join(fa, "a").join(fb, ["b", "term"]).select("a", "b", "term")
    return C.minimal(shared, kb.strict("genls"), ["a", "b"]).select("a", "b", F.col("term").alias("parent"))


def classify_pairs(kb: KB, pairs: DataFrame) -> DataFrame:
    """(a, b, class): disjoint, conjoint or unknown."""
    state = F.col("state")
    return kb.prove_disjoint(pairs).select("a", "b", F.when(state == TRUE, "disjoint").when(state == FALSE, "conjoint").otherwise("unknown").alias("class"))


def relation_counts(kb: KB, triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts of disjoint, conjoint and unknown pairs by relation, and by relation and minimal common parent.

    triples: (relation, a, b); each unordered pair counts once for a relation.
    """
    once = checkpointed(triples.select("relation", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    classes = checkpointed(classify_pairs(kb, once))
    rows = once.join(classes, ["a", "b"])
    kinds = ["disjoint", "conjoint", "unknown"]

    def count(df: DataFrame, by: list[str]) -> DataFrame:
        return df.groupBy(*by).agg(*[F.count(F.when(F.col("class") == k, 1)).alias(k) for k in kinds])

    return count(rows, ["relation"]), count(rows.join(common_parents(kb, once), ["a", "b"]), ["relation", "parent"])


def reliability(disjoint: Column, conjoint: Column) -> Column:
    """Laplace's estimate that a pair of the relation is disjoint."""
    return (disjoint + 1) / (disjoint + conjoint + 2)


def pair_features(kb: KB, triples: DataFrame, depths: DataFrame) -> DataFrame:
    """One row for each pair and minimal common parent, with 24 columns.

    triples: (relation, arg1, arg2, disamb1, disamb2); depths: (term, depth). DEPTH_2 is that of the second concept.
    """
    t = checkpointed(triples.distinct())
    pairs = t.select(F.col("disamb1").alias("a"), F.col("disamb2").alias("b")).distinct()
    by_rel, by_parent = relation_counts(kb, t.select("relation", F.col("disamb1").alias("a"), F.col("disamb2").alias("b")))
    imp = impact(kb).select("term", "ln_total")
    d1, d2, dp = (depths.select(F.col("term").alias(k), F.col("depth").cast("double").alias(v)) for k, v in (("disamb1", "depth_1"), ("disamb2", "depth_2"), ("common_parent", "parent_depth")))
    ia, ib = (imp.select(F.col("term").alias(k), F.col("ln_total").alias(v)) for k, v in (("disamb1", "impact_a"), ("disamb2", "impact_b")))
    sim = similarity_of(kb, pairs).select(F.col("a").alias("disamb1"), F.col("b").alias("disamb2"), F.col("similarity").alias("semantic_similarity"))
    par = common_parents(kb, pairs).select(F.col("a").alias("disamb1"), F.col("b").alias("disamb2"), F.col("parent").alias("common_parent"))
    cls = classify_pairs(kb, pairs).select(F.col("a").alias("disamb1"), F.col("b").alias("disamb2"), "class")
    out = t.join(par, ["disamb1", "disamb2"], "left").join(sim, ["disamb1", "disamb2"]).join(cls, ["disamb1", "disamb2"]).join(d1, "disamb1", "left").join(d2, "disamb2", "left")
    out = out.join(dp, "common_parent", "left").join(ia, "disamb1", "left").join(ib, "disamb2", "left").join(by_rel, "relation")
    inner = by_parent.select("relation", F.col("parent").alias("common_parent"), *[F.col(k).alias(f"intra_{k}") for k in ("disjoint", "conjoint", "unknown")])
    out = out.join(inner, ["relation", "common_parent"], "left")
    num = lambda c: F.col(c).cast("double")
    return out.select(
        "relation", "arg1", "arg2", "disamb1", "disamb2", "semantic_similarity", "depth_1", "depth_2", ((F.col("depth_1") + F.col("depth_2")) / 2).alias("av_depth"),
        "impact_a", "impact_b", ((F.col("impact_a") + F.col("impact_b")) / 2).alias("impact_ab"), "common_parent", "parent_depth",
        (F.abs(F.col("depth_1") - F.col("parent_depth")) + F.abs(F.col("depth_2") - F.col("parent_depth"))).alias("semantic_distance"),
        reliability(F.col("disjoint"), F.col("conjoint")).alias("relation_reliability"), num("disjoint").alias("relation_disjoint"), num("conjoint").alias("relation_conjoint"), num("unknown").alias("relation_unknown"),
        reliability(F.coalesce("intra_disjoint", F.lit(0)), F.coalesce("intra_conjoint", F.lit(0))).alias("intra_relation_reliability"),
        num("intra_disjoint").alias("intra_relation_disjoint"), num("intra_conjoint").alias("intra_relation_conjoint"), num("intra_unknown").alias("intra_relation_unknown"), "class",
    )


def new_disjoint_pairs(kb: KB, triples: DataFrame, least: float = 0.95, support: int = 30, parent_least: float = 0.9) -> DataFrame:
    """(relation, a, b): unknown pairs of a relation whose pairs are disjoint nearly always, overall and below every minimal common parent."""
    once = checkpointed(triples.select("relation", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    by_rel, by_parent = relation_counts(kb, once)
    d, c = F.col("disjoint"), F.col("conjoint")
    good = by_rel.where((d + c >= support) & (d >= least * (d + c))).select("relation")
    unknown = once.join(classify_pairs(kb, once).where(F.col("class") == "unknown"), ["a", "b"]).join(good, "relation", "left_semi")
    score = by_parent.where(d + c > 0).select("relation", "parent", (d / (d + c)).alias("score"))
    found = unknown.join(common_parents(kb, unknown), ["a", "b"]).join(score, ["relation", "parent"], "left")
    return found.groupBy("relation", "a", "b").agg(F.min(F.coalesce("score", F.lit(0.0))).alias("s")).where(F.col("s") >= parent_least).select("relation", "a", "b")


def base_rate(kb: KB, n: int = 1000, seed: int = 0, draws: int = 5) -> DataFrame:
    """(draw, class, n) of n random pairs of classes in each of some draws: a Monte-Carlo estimate of how often classes are disjoint."""
    terms = checkpointed(kb.occurring("genls"))

    def side(name: str, s: int) -> DataFrame:
        # the n least hashes of each draw, numbered; n rows reach one task
        one = [terms.select(F.lit(d).alias("draw"), F.col("term").alias(name), F.xxhash64("term", F.lit(s + 2 * d)).alias("h")).orderBy("h").limit(n) for d in range(draws)]
        every = reduce(DataFrame.union, one)
        return every.withColumn("i", F.row_number().over(Window.partitionBy("draw").orderBy("h", name))).drop("h")

    pairs = checkpointed(side("a", seed).join(side("b", seed + 1), ["draw", "i"]).where("a <> b"))
    return pairs.join(classify_pairs(kb, pairs.select("a", "b")), ["a", "b"]).groupBy("draw", "class").agg(F.count(F.lit(1)).alias("n"))


def bubble_up(kb: KB, share: float = 0.4, least: int = 10) -> DataFrame:
    """(parent, target, n, n_disjoint): parents of which more than a share of over `least` direct specs is disjoint with a target."""
    strict = kb.strict("genls", up=False).where("lo <> hi")
    specs = C.maximal(kb.asserted("genls").where("a <> b").select("b", F.col("a").alias("term")), strict, ["b"]).select(F.col("b").alias("parent"), F.col("term").alias("spec"))
    sizes = specs.groupBy("parent").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least)
    partners = kb.disjoint_partners(specs.select(F.col("spec").alias("term"))).select(F.col("a").alias("spec"), F.col("b").alias("target"))
    hits = specs.join(partners, "spec").groupBy("parent", "target").agg(F.countDistinct("spec").alias("n_disjoint"))
    return hits.join(sizes, "parent").where(F.col("n_disjoint") > share * F.col("n")).select("parent", "target", "n", "n_disjoint")


# ---- predicate refinement and resolution


def refinement_evidence(kb: KB, preds: DataFrame) -> DataFrame:
    """(pred, pos, type, n, evidence): how many pieces of evidence have each type at each position.

    Edges with one `source` property are one piece, any other edge is one by its edge_id. If the first argument of a
    piece has no type, its later ones do not count. Terms with the same direct types are counted together, so that
    edges never meet the types themselves.
    """
    e = kb.active.where("sign = 1").join(F.broadcast(preds.select("pred").distinct()), "pred", "left_semi").select("pred", F.col("props")["source"].alias("source"), "edge_id", "args")
    terms = e.select(F.explode("args").alias("term")).select(model.literal_type(F.col("term")).alias("term"))
    direct = kb.asserted("isa").union(kb.function_results("resultIsa", terms))
    kinds = checkpointed(direct.groupBy("a").agg(F.sort_array(F.collect_set("b")).alias("kind")))
    each = kinds.select("kind").distinct().select("kind", F.explode("kind").alias("t"))
    up = kb.strict("genls").where("lo <> hi").select(F.col("lo").alias("t"), F.col("hi").alias("type"))
    types = each.select("kind", F.col("t").alias("type")).union(each.join(up, "t").select("kind", "type")).distinct()

    key = ["pred", "pos"]
    single = e.where("source is null").select("pred", "edge_id", "args", model.literal_type(F.col("args")[0]).alias("a"))
    single = single.join(kinds, "a").select("a", "pred", "edge_id", "args", "kind").distinct()
    later = single.select("pred", F.posexplode(F.slice("args", F.lit(2), F.greatest(F.size("args") - 1, F.lit(0)))).alias("i", "term"))
    later = later.groupBy("pred", (F.col("i") + 2).alias("pos"), model.literal_type(F.col("term")).alias("a")).agg(F.count(F.lit(1)).alias("n"))
    count = single.groupBy("pred", F.lit(1).alias("pos"), "kind").agg(F.count(F.lit(1)).alias("n"))
    count = checkpointed(count.union(later.join(kinds, "a").groupBy(*key, "kind").agg(F.sum("n").alias("n"))))
    evidence = count.groupBy(*key).agg(F.sum("n").alias("evidence"))
    n = count.join(types, "kind").groupBy(*key, "type").agg(F.sum("n").alias("n"))

    shared = e.where("source is not null")
    if not shared.isEmpty():
        args = shared.select("pred", "source", F.posexplode("args").alias("i", "term")).select("pred", "source", (F.col("i") + 1).alias("pos"), model.literal_type(F.col("term")).alias("a"))
        typed = checkpointed(args.join(kinds, "a").select("pred", "source", "pos", "kind").distinct())
        typed = typed.join(typed.where("pos = 1").select("pred", "source").distinct(), ["pred", "source"], "left_semi")
        evidence = evidence.union(typed.groupBy(*key).agg(F.countDistinct("source").alias("evidence"))).groupBy(*key).agg(F.sum("evidence").alias("evidence"))
        more = typed.join(types, "kind").select(*key, "source", "type").distinct().groupBy(*key, "type").agg(F.count(F.lit(1)).alias("n"))
        n = n.union(more).groupBy(*key, "type").agg(F.sum("n").alias("n"))
    return n.join(evidence, key)


def refine(kb: KB, preds: DataFrame, threshold: float = 0.9, ignore: DataFrame | None = None) -> DataFrame:
    """(pred, pos, type): minimal types that at least ceil(threshold * evidence) pieces share; none if two are disjoint."""
    got = refinement_evidence(kb, preds).where(F.col("n") >= F.ceil(F.lit(threshold) * F.col("evidence")))
    if ignore is not None:
        got = got.join(ignore.select("type"), "type", "left_anti")
    least = checkpointed(C.minimal(got.select("pred", "pos", F.col("type").alias("term")), kb.strict("genls"), ["pred", "pos"]))
    other = least.select("pred", "pos", F.col("term").alias("b"))
    pairs = least.withColumnRenamed("term", "a").join(other, ["pred", "pos"]).where("a < b")
    clash = pairs.join(kb.prove_disjoint(pairs.select("a", "b"), want_false=False).where(F.col("state") == TRUE), ["a", "b"], "left_semi").select("pred", "pos").distinct()
    return least.join(clash, ["pred", "pos"], "left_anti").select("pred", "pos", F.col("term").alias("type"))


def global_types(kb: KB, threshold: float = 0.9) -> DataFrame:
    """(type): types that hold at the first edge of nearly every predicate, so that they say nothing."""
    first = kb.active.where("sign = 1").groupBy("pred").agg(F.min("edge_id").alias("edge_id"))
    sample = kb.active.join(first, ["pred", "edge_id"], "left_semi").withColumn("pred", F.lit("*"))
    one = KB(kb.edges.unionByName(sample.select(*kb.edges.columns)), kb.isa_neg_via_genls, kb.strict_or, kb.numeric_equals, kb.now, kb.small)
    return refine(one, kb.spark.createDataFrame([("*",)], "pred string"), threshold).select("type").distinct()


def impose(kb: KB, refined: DataFrame, coerce: bool = False) -> DataFrame:
    """Edges after writing the refined constraints as argIsa and dropping the edges that break them.

    coerce: such edges are asserted again first, with the isa and genls edges that their arguments lack, and go only if
    those are refused; a refined predicate without an edge left goes with all that is said about it.
    """
    from gnosia.operators import constraints

    rows = refined.select(F.xxhash64("pred", "pos", "type").alias("edge_id"), F.lit("argIsa").alias("pred"), F.array("pred", F.concat(F.lit("'"), F.col("pos").cast("string")), "type").alias("args"))
    rows = rows.select(
        "edge_id", "pred", "args", F.col("args")[0].alias("arg1"), F.col("args")[1].alias("arg2"), F.lit(3).alias("arity"), F.lit(1).alias("sign"), F.lit(False).alias("removed"),
        F.lit(None).cast("string").alias("mt"), F.lit(None).cast("string").alias("creator"), F.lit(False).alias("ephemeral"), F.create_map().cast("map<string,string>").alias("props"),
    )
    both = kb.edges.unionByName(rows)
    grown = KB(both, kb.isa_neg_via_genls, kb.strict_or, kb.numeric_equals, kb.now, kb.small)
    ours = grown.active.where("sign = 1").join(refined.select("pred").distinct(), "pred", "left_semi")
    bad = constraints.argument_violations(grown, ours).select("edge_id").distinct()
    if not coerce:
        return both.join(bad, "edge_id", "left_anti")
    bad = checkpointed(ours.join(bad, "edge_id", "left_semi"))
    left = both.join(bad.select("edge_id"), "edge_id", "left_anti")
    if not bad.isEmpty():
        again = constraints.force(KB(checkpointed(left), kb.isa_neg_via_genls, kb.strict_or, kb.numeric_equals, kb.now, kb.small), bad)
        left = checkpointed(left.unionByName(again.accepted.select(*left.columns)).unionByName(again.forced.select(*left.columns)))
    used = left.where("sign = 1 and not removed").select("pred").distinct()
    unused = refined.select("pred").distinct().join(used, "pred", "left_anti")
    gone = left.select("edge_id", F.explode("args").alias("pred")).join(unused, "pred", "left_semi").select("edge_id").distinct()
    return left.join(unused, "pred", "left_anti").select(*left.columns).join(gone, "edge_id", "left_anti")


def resolve_predicate(kb: KB, pred: str, args: list[str]) -> DataFrame:
    """(pred, score): the predicate and its sub-predicates by how well the arguments fit their constraints; scores add up to one."""
    from gnosia.operators import constraints

    subs = checkpointed(kb.sub_predicates(pred))
    given = kb.spark.createDataFrame([(i + 1, a) for i, a in enumerate(args)], "pos int, term string")
    limits = constraints.argument_constraints(kb, "Isa").union(constraints.argument_constraints(kb, "Genl"))
    slots = subs.crossJoin(given).join(limits, ["pred", "pos"], "left")
    sims = similarity_of(kb, slots.where("type is not null").select(F.col("term").alias("a"), F.col("type").alias("b")))
    scored = slots.join(sims.select(F.col("a").alias("term"), F.col("b").alias("type"), "similarity"), ["term", "type"], "left")
    per = scored.groupBy("pred", "pos").agg(F.avg(F.coalesce(F.nanvl("similarity", F.lit(0.0)), F.lit(1e-5))).alias("s")).groupBy("pred").agg(F.avg("s").alias("score"))
    tries = checkpointed(subs.withColumn("edge_id", F.xxhash64("pred")).select("edge_id", "pred", F.array(*map(F.lit, args)).alias("args")))
    bad = constraints.argument_violations(kb, tries).join(tries.select("edge_id", "pred"), "edge_id").select("pred").distinct().withColumn("bad", F.lit(True))
    out = per.join(bad, "pred", "left").withColumn("score", F.when(F.col("bad"), 0.0).otherwise(F.col("score")))
    total = out.agg(F.sum("score")).first()[0] or 1.0
    return out.select("pred", (F.col("score") / F.lit(total)).alias("score"))


def disambiguate(kb: KB, slots: DataFrame) -> DataFrame:
    """(request, group, slot, term): consistent choices of one candidate for each slot.

    slots: (request, slot, term). Every candidate seeds a group, to which each other slot adds its first candidate (by
    name) that no member of the group is disjoint with. Larger groups come first, then by text.
    """
    s = checkpointed(slots.select("request", "slot", "term").distinct())
    o = s.select("request", F.col("slot").alias("slot2"), F.col("term").alias("term2"))
    pairs = checkpointed(s.join(o, "request").where("slot <> slot2").select("request", F.col("term").alias("a"), F.col("term2").alias("b")).distinct())
    apart = pairs.join(kb.prove_disjoint(pairs.select("a", "b"), want_false=False).where(F.col("state") == TRUE).select("a", "b"), ["a", "b"], "left_semi")
    import pandas as pd

    def group(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        against = {*zip(right["a"], right["b"], strict=True)}
        by_slot = {k: sorted(v["term"]) for k, v in left.groupby("slot")}
        found = set()
        for slot, terms in by_slot.items():
            for t in terms:
                chosen = {slot: t}
                for other in sorted(by_slot):
                    if other != slot:
                        pick = next((c for c in by_slot[other] if all((c, x) not in against and (x, c) not in against for x in chosen.values())), None)
                        if pick is not None:
                            chosen[other] = pick
                found.add(tuple(sorted(chosen.items())))
        request = left["request"].iloc[0] if len(left) else None
        ranked = sorted(found, key=lambda g: (-len(g), str(g)))
        return pd.DataFrame([(request, i, k, t) for i, g in enumerate(ranked) for k, t in g], columns=["request", "group", "slot", "term"])

    kinds = dict(s.dtypes)
    left = s.select(F.col("request").alias("request"), "slot", "term")
    right = checkpointed(apart.select(F.col("request").alias("request"), "a", "b"))
    return left.groupBy("request").cogroup(right.groupBy("request")).applyInPandas(group, f"request {kinds['request']}, group int, slot {kinds['slot']}, term string")


def subgraph(kb: KB, terms: DataFrame, distance: int = 0) -> DataFrame:
    """Edges among the given terms, all above them, their function parts and argument constraints; with a distance also specs and instances."""
    seeds = terms.select("term").distinct()
    keep = features(kb, seeds).select(F.col("feature").alias("term")).union(seeds)
    if distance > 0:
        keep = keep.union(kb.downward(seeds.select(F.col("term").alias("hi"))).select("lo")).union(kb.instances(seeds.select(F.col("term").alias("hi"))).select("a"))
    keep = checkpointed(keep.distinct())
    while True:
        inner = keep.where(model.is_function(F.col("term"))).select(F.explode(model.term_parts("term")).alias("term")).where(model.is_node(F.col("term")))
        limits = kb.active.where(F.col("pred").isin("argIsa", "argGenl", "resultIsa", "resultGenl")).select(F.col("arg1").alias("p"), F.element_at("args", F.size("args")).alias("term"))
        more = limits.join(keep.select(F.col("term").alias("p")), "p", "left_semi").select("term").union(inner).distinct().join(keep, "term", "left_anti")
        more = checkpointed(more)
        if more.isEmpty():
            break
        keep = checkpointed(keep.union(more))
    outside = kb.active.select("edge_id", F.explode("args").alias("term")).where(model.is_node(F.col("term"))).join(keep, "term", "left_anti").select("edge_id").distinct()
    return kb.active.join(outside, "edge_id", "left_anti")
