"""A knowledge base: an edge table, its derived relations, and proofs of many pairs at once."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gnosia import model
from gnosia.operators import closure as C
from gnosia.operators.tables import ship
from gnosia.operators.tables import written as checkpointed

TRUE, FALSE, NIL = "TRUE", "FALSE", "NIL"


class KB:
    """Derived relations of one edge table, each computed once on first use.

    isa_neg_via_genls: an instance of a class with a negated genls edge is refuted for the other class.
    strict_or: a disjunction of refuted parts is FALSE; otherwise NIL.
    now: ISO time that indexical dates refer to.
    """

    def __init__(self, edges: DataFrame, isa_neg_via_genls: bool = True, strict_or: bool = False, numeric_equals: bool = False, now: str | None = None, small: int = C.SMALL) -> None:
        ship(edges.sparkSession)
        self.spark, self.edges, self.small = edges.sparkSession, edges, small
        self.isa_neg_via_genls, self.strict_or, self.numeric_equals, self.now = isa_neg_via_genls, strict_or, numeric_equals, now
        self._cache: dict[tuple, DataFrame] = {}
        self._symmetric: dict[str, bool] = {}

    # ---- scans

    @cached_property
    def active(self) -> DataFrame:
        return self.edges.where(~F.col("removed"))

    def signed(self, pred: str) -> DataFrame:
        """(a, b, sign) of the binary edges of a predicate that are not removed."""
        return self.active.where(F.col("pred") == pred).select(F.col("arg1").alias("a"), F.col("arg2").alias("b"), "sign").distinct()

    def asserted(self, pred: str, sign: int = 1) -> DataFrame:
        return self.active.where((F.col("pred") == pred) & (F.col("sign") == sign)).select(F.col("arg1").alias("a"), F.col("arg2").alias("b")).distinct()

    def occurring(self, pred: str) -> DataFrame:
        """Terms in any edge of the predicate, whatever its sign, removed ones included."""
        e = self.edges.where(F.col("pred") == pred)
        return e.select(F.explode(F.array("arg1", "arg2")).alias("term")).where("term is not null").distinct()

    def is_symmetric(self, pred: str) -> bool:
        if pred not in self._symmetric:
            self._symmetric[pred] = self._asserted_symmetric(pred)
        return self._symmetric[pred]

    def _asserted_symmetric(self, pred: str) -> bool:
        e = self.active.where((F.col("pred") == "isa") & (F.col("sign") == 1) & (F.col("arg1") == pred) & (F.col("arg2") == "SymmetricBinaryPredicate"))
        return not e.isEmpty()

    # ---- functional terms

    def functions(self) -> DataFrame:
        """(term, func) of the functional terms among the arguments of active edges."""
        one = self.active.where(model.is_function(F.col("arg1"))).select(F.col("arg1").alias("term")).union(self.active.where(model.is_function(F.col("arg2"))).select(F.col("arg2").alias("term")))
        more = self.active.where("arity > 2").select(F.explode(F.slice("args", F.lit(3), F.size("args"))).alias("term")).where(model.is_function(F.col("term")))
        return self._once(("functions",), lambda: one.union(more).distinct().withColumn("func", model.function_name(F.col("term"))))

    def function_results(self, kind: str, terms: DataFrame | None = None) -> DataFrame:
        """(a, b): functional term a has the type b by kind (`resultIsa` or `resultGenl`), constant or by argument."""
        if terms is None and ("results", kind) in self._cache:
            return self._cache["results", kind]
        everything = terms is None
        terms = self.functions() if terms is None else terms.where(model.is_function(F.col("term"))).select("term", model.function_name(F.col("term")).alias("func")).distinct()
        fixed = self.asserted(kind).select(F.col("a").alias("func"), "b")
        by_arg = self.asserted(f"{kind}Arg").select(F.col("a").alias("func"), model.number(F.col("b")).cast("int").alias("k")).where("k is not null")
        out = terms.join(fixed, "func").select(F.col("term").alias("a"), "b")
        picked = terms.join(by_arg, "func").select(F.col("term").alias("a"), F.try_element_at(model.term_parts("term"), F.col("k") + 1).alias("b"))
        out = out.union(picked.where("b is not null")).distinct()
        return self._once(("results", kind), lambda: out) if everything else out

    # ---- closure

    def _once(self, key: tuple, make) -> DataFrame:
        if key not in self._cache:
            self._cache[key] = checkpointed(make())
        return self._cache[key]

    def step(self, pred: str, up: bool = True) -> DataFrame:
        """Positive edges (lo, hi); upward for genls also from functional terms to their result types."""
        e = self.asserted(pred)
        if up and pred == "genls":
            e = e.union(self.function_results("resultGenl"))
        return e.select(F.col("a").alias("lo"), F.col("b").alias("hi"))

    def strict(self, pred: str = "genls", up: bool = True) -> DataFrame:
        """Closure (lo, hi, dist) without the reflexive pairs that no cycle makes."""
        return self._once(("closure", pred, up), lambda: C.reach(self.step(pred, up), small=self.small))

    def closure(self, pred: str = "genls", up: bool = True) -> DataFrame:
        """Closure with (x, x, 0) for each term that takes part in the predicate."""
        return C.reflexive(self.strict(pred, up), self.occurring(pred))

    def upward(self, seeds: DataFrame, pred: str = "genls") -> DataFrame:
        """(lo, hi, dist) from each seed (column lo) upwards, the seed itself at distance zero always."""
        own = seeds.select("lo", F.col("lo").alias("hi"), F.lit(0).alias("dist")).distinct()
        key = ("closure", pred, True)
        up = self._cache[key] if key in self._cache else C.reach(self.step(pred), seeds, small=self.small)
        return own.union(up.where("lo <> hi").join(seeds.select("lo").distinct(), "lo", "left_semi").select("lo", "hi", "dist"))

    def downward(self, seeds: DataFrame, pred: str = "genls") -> DataFrame:
        """(lo, hi, dist) from each seed (column hi) downwards, the seed itself at distance zero always."""
        own = seeds.select(F.col("hi").alias("lo"), "hi", F.lit(0).alias("dist")).distinct()
        key = ("closure", pred, False)
        if key in self._cache:
            found = self._cache[key].where("lo <> hi").join(seeds.select("hi").distinct(), "hi", "left_semi").select("lo", "hi", "dist")
        else:
            back = self.step(pred, False).select(F.col("hi").alias("lo"), F.col("lo").alias("hi"))
            found = C.reach(back, seeds.select(F.col("hi").alias("lo")), small=self.small).where("lo <> hi").select(F.col("hi").alias("lo"), F.col("lo").alias("hi"), "dist")
        return own.union(found)

    def types(self, terms: DataFrame | None = None, pred: str = "isa") -> DataFrame:
        """(a, b, dist): b is a type of a; direct types, result types of functional terms, and all above them."""
        if terms is None and ("types", pred) in self._cache:
            return self._cache["types", pred]
        direct = self.asserted(pred)
        if terms is not None:
            direct = direct.join(terms.select(F.col("term").alias("a")).distinct(), "a", "left_semi")
        if pred == "isa":
            direct = direct.union(self.function_results("resultIsa", terms))
        direct = direct.distinct()
        if terms is None:
            up = self.strict("genls").where("lo <> hi")
        else:
            up = self.upward(direct.select(F.col("b").alias("lo"))).where("dist > 0")
        above = direct.join(up, direct.b == up.lo).select("a", F.col("hi").alias("b"), F.col("dist"))
        out = direct.select("a", "b", F.lit(0).alias("dist")).union(above).groupBy("a", "b").agg(F.min("dist").alias("dist"))
        return self._once(("types", pred), lambda: out) if terms is None else out

    def instances(self, seeds: DataFrame, pred: str = "isa") -> DataFrame:
        """(a, b): a is an instance of the seed b (column hi) or of a class below it."""
        down = self.downward(seeds).select(F.col("lo").alias("t"), F.col("hi").alias("b"))
        return self.asserted(pred).select("a", F.col("b").alias("t")).join(down, "t").select("a", "b").distinct()

    def depths(self) -> DataFrame:
        """(term, depth) over genls, isa, genlPreds and genlMt edges and the result types of functional terms."""
        e = self.active.where(F.col("pred").isin("genls", "isa", "genlPreds", "genlMt") & (F.col("sign") == 1)).select(F.col("arg1").alias("term"), F.col("arg2").alias("parent"))
        more = self.function_results("resultGenl").union(self.function_results("resultIsa")).select(F.col("a").alias("term"), F.col("b").alias("parent"))
        return C.depths(checkpointed(e.union(more)))

    def sub_predicates(self, pred: str) -> DataFrame:
        """The predicate and all below it (column pred)."""
        seed = self.spark.createDataFrame([(pred,)], "hi string")
        return self.downward(seed, "genlPreds").select(F.col("lo").alias("pred")).distinct()

    # ---- proofs of many pairs: (a, b) -> (a, b, state)

    def prove_genls(self, pairs: DataFrame, pred: str = "genls") -> DataFrame:
        """The walk up from a decides at the first level with an edge to b: TRUE before FALSE on the same level."""
        goal = pairs.select("a", "b").distinct()
        up = self.upward(goal.select(F.col("a").alias("lo")), pred)
        hits = goal.join(up, goal.a == up.lo).select("a", "b", F.col("hi").alias("n"), "dist")
        edges = self.signed(pred)
        if pred == "genls":
            edges = edges.union(self.function_results("resultGenl").withColumn("sign", F.lit(1)))
        edges = edges.select(F.col("a").alias("n"), F.col("b").alias("__b"), "sign")
        met = hits.join(edges, (hits.n == edges.n) & (hits.b == edges["__b"])).groupBy("a", "b").agg(F.min(F.when(F.col("sign") == 1, F.col("dist"))).alias("t"), F.min(F.when(F.col("sign") == -1, F.col("dist"))).alias("f"))
        own = self.occurring(pred).select(F.col("term").alias("a"), F.col("term").alias("b"), F.lit(True).alias("own"))
        out = goal.join(met, ["a", "b"], "left").join(own, ["a", "b"], "left")
        state = F.when(F.col("own"), TRUE).when(F.col("t").isNotNull() & (F.col("f").isNull() | (F.col("t") <= F.col("f"))), TRUE).when(F.col("f").isNotNull(), FALSE).otherwise(NIL)
        return out.select("a", "b", state.alias("state"))

    def prove_isa(self, pairs: DataFrame) -> DataFrame:
        """TRUE by a type; FALSE by a negated edge, or by a negated genls edge above a type; else NIL."""
        goal = pairs.select("a", "b").distinct().withColumn("x", model.literal_type(F.col("a")))
        types = self.types(goal.select(F.col("x").alias("term")))
        yes = goal.join(types.select(F.col("a").alias("x"), "b"), ["x", "b"], "left_semi").select("a", "b", F.lit(True).alias("yes"))
        no = self.asserted("isa", -1).select(F.col("a").alias("x"), "b")
        if self.isa_neg_via_genls:
            against = self.asserted("genls", -1).select(F.col("a").alias("t"), F.col("b").alias("__b"))
            no = no.union(types.select(F.col("a").alias("x"), F.col("b").alias("t")).join(against, "t").select("x", F.col("__b").alias("b"))).distinct()
        no = goal.join(no, ["x", "b"], "left_semi").select("a", "b", F.lit(True).alias("no"))
        direct = goal.join(self.asserted("isa", -1).select(F.col("a").alias("x"), "b"), ["x", "b"], "left_semi").select("a", "b", F.lit(True).alias("direct_no"))
        out = goal.join(yes, ["a", "b"], "left").join(no, ["a", "b"], "left").join(direct, ["a", "b"], "left")
        state = F.when(F.col("direct_no"), FALSE).when(F.col("yes"), TRUE).when(F.col("no"), FALSE).otherwise(NIL)
        return out.select("a", "b", state.alias("state"))

    def sibling_members(self) -> DataFrame:
        """(a, t): the instances of each sibling-disjoint collection type t. Pairs of them are made from what is asked only."""

        def make() -> DataFrame:
            seed = self.spark.createDataFrame([("SiblingDisjointCollectionType",)], "hi string")
            return self.instances(self.instances(seed).select(F.col("a").alias("hi"))).select("a", F.col("b").alias("t"))

        return self._once(("siblings",), make)

    def overlapping(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) with a common spec or instance.

        Terms that stand under the same ends of pairs say the same: one of them is enough, so that a class with many
        instances costs as many rows as there are different sets of ends above them. Sets are told apart by 192 bits.
        """
        ends = pairs.select(F.col("a").alias("hi")).union(pairs.select(F.col("b").alias("hi"))).distinct()
        inst = self.instances(ends).select(F.col("a").alias("z"), F.col("b").alias("end"))
        below = checkpointed(self.downward(ends).select(F.col("lo").alias("z"), F.col("hi").alias("end")).union(inst).distinct())
        kinds = below.groupBy("z").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.xxhash64(F.lit(s), "end").cast("decimal(38,0)")).alias(f"h{s}") for s in (1, 2, 3)])
        one = kinds.groupBy("n", "h1", "h2", "h3").agg(F.min("z").alias("z")).select("z")
        few = checkpointed(below.join(one, "z"))
        x, y = few.select("z", F.col("end").alias("a")), few.select(F.col("z").alias("__z"), F.col("end").alias("__b"))
        return pairs.join(x, "a").join(y, (F.col("z") == F.col("__z")) & (F.col("b") == F.col("__b")), "left_semi").select("a", "b").distinct()

    def exceptions(self) -> DataFrame:
        e = self.asserted("siblingDisjointExceptions")
        return e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()

    def axioms(self) -> DataFrame:
        """(x, y, sign) of disjointWith in both orders."""
        e = self._once(("signed", "disjointWith"), lambda: self.signed("disjointWith"))
        return e.select(F.col("a").alias("x"), F.col("b").alias("y"), "sign").union(e.select(F.col("b").alias("x"), F.col("a").alias("y"), "sign")).distinct()

    def prove_disjoint(self, pairs: DataFrame, want_false: bool = True) -> DataFrame:
        """In this order: one above the other: FALSE; an axiom between what is above either but not both; a common spec or
        instance: FALSE (if wanted); siblings of a sibling-disjoint type: TRUE, as exceptions FALSE; else NIL."""
        goal = checkpointed(pairs.select("a", "b").distinct())
        ends = checkpointed(goal.select(F.col("a").alias("lo")).union(goal.select(F.col("b").alias("lo"))).distinct())
        up = checkpointed(self.upward(ends).select("lo", "hi", "dist"))
        ua, ub = up.select(F.col("lo").alias("a"), F.col("hi").alias("n"), F.col("dist").alias("da")), up.select(F.col("lo").alias("b"), F.col("hi").alias("m"), F.col("dist").alias("db"))
        proper = up.where("dist > 0")
        above = goal.join(proper, (goal.a == proper.lo) & (goal.b == proper.hi), "left_semi").union(goal.join(proper, (goal.b == proper.lo) & (goal.a == proper.hi), "left_semi"))
        occ = self.occurring("genls").select(F.col("term").alias("a"))
        above = above.union(goal.where("a = b").join(occ, "a", "left_semi").select("a", "b")).distinct().withColumn("above", F.lit(True))
        # from the few axioms to pairs: axiom ends that are above a, then those above b
        axiom = self.axioms()
        left = goal.join(ua, "a").join(axiom, F.col("n") == F.col("x")).select("a", "b", "n", "y", "sign", "da")
        met = left.join(ub.withColumnRenamed("b", "__b"), (F.col("y") == F.col("m")) & (F.col("b") == F.col("__b"))).select("a", "b", "n", "y", "sign")
        both_n = up.select(F.col("lo").alias("__p"), F.col("hi").alias("__q"))
        met = met.join(both_n, (F.col("b") == F.col("__p")) & (F.col("n") == F.col("__q")), "left_anti").join(both_n, (F.col("a") == F.col("__p")) & (F.col("y") == F.col("__q")), "left_anti")
        met = met.groupBy("a", "b").agg(F.max("sign").alias("axiom"))
        out = goal.join(above, ["a", "b"], "left").join(met, ["a", "b"], "left")
        if want_false:
            out = out.join(self.overlapping(goal).withColumn("common", F.lit(True)), ["a", "b"], "left")
        else:
            out = out.withColumn("common", F.lit(None).cast("boolean"))
        member = self.sibling_members()
        siblings = goal.where("a <> b").join(member, "a").join(member.withColumnRenamed("a", "b"), ["b", "t"], "left_semi").select("a", "b").distinct().withColumn("sibling", F.lit(True))
        out = out.join(siblings, ["a", "b"], "left").join(self.exceptions().withColumn("exception", F.lit(True)), ["a", "b"], "left")
        state = (
            F.when(F.col("above"), FALSE).when(F.col("axiom") == 1, TRUE).when(F.col("axiom") == -1, FALSE).when(F.col("common"), FALSE)
            .when(F.col("sibling") & F.col("exception"), FALSE).when(F.col("sibling"), TRUE).otherwise(NIL)
        )
        return out.select("a", "b", state.alias("state"))

    def disjoint_partners(self, terms: DataFrame) -> DataFrame:
        """(a, b) for each given term a (column term): axiom partners of all above it, and sibling classes that are no exceptions."""
        seeds = terms.select(F.col("term").alias("lo")).distinct()
        up = self.upward(seeds)
        axiom = self.axioms().where("sign = 1")
        found = up.join(axiom, up.hi == axiom.x).select(F.col("lo").alias("a"), F.col("y").alias("b"))
        back = up.select(F.col("lo").alias("a"), F.col("hi").alias("b"))
        found = found.join(back, ["a", "b"], "left_anti")
        member = self.sibling_members()
        mine = member.join(seeds.select(F.col("lo").alias("a")), "a", "left_semi")
        siblings = mine.join(member.withColumnRenamed("a", "b"), "t").where("a <> b").select("a", "b").join(self.exceptions(), ["a", "b"], "left_anti")
        return found.union(siblings).distinct()

    def disjoint_map(self) -> DataFrame:
        """(term, axiom_term, sign): the axiom ends at or above each term that takes part in genls or in an axiom."""
        axiom = self.axioms().select(F.col("x").alias("axiom_term"), "sign").distinct()
        up = self.strict("genls").where("lo <> hi").select(F.col("lo").alias("term"), F.col("hi").alias("axiom_term"))
        return up.join(axiom, "axiom_term").select("term", "axiom_term", "sign").union(axiom.select(F.col("axiom_term").alias("term"), "axiom_term", "sign")).distinct()


    def disjoint_map_changed(self, known: DataFrame, added: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
        """disjoint_map() after axioms (x, y), in either order, came or went: only rows of their ends are touched."""
        out, axiom = known, self.axioms()
        if removed is not None:
            gone = removed.select("x", "y").union(removed.select(F.col("y").alias("x"), F.col("x").alias("y")))
            left = axiom.join(gone, ["x", "y"], "left_anti").select(F.col("x").alias("axiom_term"), "sign").distinct()
            ends = gone.select(F.col("x").alias("axiom_term")).distinct()
            out = out.join(ends, "axiom_term", "left_anti").select(*known.columns).union(out.join(ends, "axiom_term", "left_semi").join(left, ["axiom_term", "sign"], "left_semi").select(*known.columns))
        if added is not None:
            ends = added.select(F.col("x").alias("hi")).union(added.select(F.col("y").alias("hi"))).distinct()
            up = self.strict("genls").where("lo <> hi").join(ends, "hi", "left_semi").select("lo", "hi").union(ends.select(F.col("hi").alias("lo"), "hi"))
            out = out.union(up.select(F.col("lo").alias("term"), F.col("hi").alias("axiom_term"), F.lit(1).alias("sign")))
        return out.distinct()


def pair(spark, a: str, b: str) -> DataFrame:
    return spark.createDataFrame([(a, b)], "a string, b string")
