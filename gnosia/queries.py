"""Queries of the ontology engine over the tables of a folder, and the DuckDB SQL that checks them.

The ontology is the one that sources.project derives from the relational tables. Nothing is limited or sampled unless
the query is a report of the first rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gnosia import model
from gnosia.functions import dates, text
from gnosia.operators import analytics as A
from gnosia.operators import closure as C
from gnosia.operators import common, constraints, scan
from gnosia.operators.kb import KB
from gnosia.operators.tables import ship
from gnosia.operators.tables import written as checkpointed
from gnosia.plans.engine import Engine
from gnosia.sources import files
from gnosia.sources.project import EDGE_SQL, ontology, stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Common part of the oracles: edges, strict genls closure with distances, types, functional terms.
_WITH = f"""WITH RECURSIVE e AS MATERIALIZED ({EDGE_SQL}),
gen(lo, hi) AS MATERIALIZED (SELECT DISTINCT arg1, arg2 FROM e WHERE pred = 'genls' AND sign = 1),
walk(lo, hi, d) AS (SELECT lo, hi, 1 FROM gen UNION SELECT w.lo, g.hi, w.d + 1 FROM walk w JOIN gen g ON w.hi = g.lo),
cl AS MATERIALIZED (SELECT lo, hi, min(d) AS dist FROM walk GROUP BY ALL),
occ AS MATERIALIZED (SELECT arg1 AS term FROM e WHERE pred = 'genls' UNION SELECT arg2 FROM e WHERE pred = 'genls'),
fun AS MATERIALIZED (SELECT DISTINCT t AS term, regexp_extract(t, '^\\(([^ ()]+)', 1) AS func FROM (SELECT arg1 AS t FROM e UNION SELECT arg2 FROM e) WHERE starts_with(t, '(')),
fgen AS MATERIALIZED (SELECT DISTINCT term AS lo, arg2 AS hi FROM fun JOIN e ON e.pred = 'resultGenl' AND e.arg1 = func AND sign = 1),
up AS MATERIALIZED (SELECT lo, hi FROM cl UNION SELECT lo, hi FROM fgen UNION SELECT f.lo, c.hi FROM fgen f JOIN cl c ON f.hi = c.lo),
isa AS MATERIALIZED (SELECT DISTINCT arg1 AS a, arg2 AS b FROM e WHERE pred = 'isa' AND sign = 1),
types AS MATERIALIZED (SELECT a, b FROM isa UNION SELECT i.a, u.hi FROM isa i JOIN up u ON i.b = u.lo)
"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql if sql.lstrip().upper().startswith(("WITH", "SELECT *")) else _WITH + sql
        return fn

    return register


def kb_of(spark: SparkSession, sf_dir: str) -> KB:
    """The knowledge base of a folder; a query reads only the predicates that it needs."""
    return KB(stored(spark, sf_dir))


def _ask(spark: SparkSession, sf_dir: str, text_: str) -> DataFrame:
    return Engine(kb_of(spark, sf_dir)).query(text_).rows


def ask(name: str, s_expression: str, sql: str) -> None:
    """Register an S-expression query."""
    QUERIES[name] = partial(_asked, s_expression)
    ORACLES[name] = _WITH + sql


def _asked(s_expression: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ask(spark, sf_dir, s_expression)


def named(name: str, which: str, given: tuple[str, ...], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: common.run(kb_of(spark, sf_dir), which, *given)
    ORACLES[name] = _WITH + sql


# ---- edges, scans, expression queries

ask("q_flagship_and", "(and (isa ?X nation:NATION_2) (custSegment ?X BUILDING))", "SELECT DISTINCT t.a AS X FROM types t JOIN e ON e.pred = 'custSegment' AND e.arg1 = t.a AND e.arg2 = 'BUILDING' AND e.sign = 1 WHERE t.b = 'nation:NATION_2'")
ask("q_asserted", "(assertedSentence (custSegment ?X BUILDING))", "SELECT DISTINCT arg1 AS X FROM e WHERE pred = 'custSegment' AND arg2 = 'BUILDING' AND sign = 1")
ask("q_default_subpredicates", "(relatedTo ?X ?Y)", "SELECT DISTINCT arg1 AS X, arg2 AS Y FROM e WHERE pred IN ('placedOrder', 'containsPart', 'relatedTo') AND sign = 1")
ask("q_or_union", "(or (isa ?X nation:NATION_1) (isa ?X nation:NATION_2))", "SELECT DISTINCT a AS X FROM types WHERE b IN ('nation:NATION_1', 'nation:NATION_2')")
ask("q_theta_different", "(and (genls ?X region:ASIA) (genls ?Y region:ASIA) (different ?X ?Y))", "SELECT x.lo AS X, y.lo AS Y FROM (SELECT lo FROM cl WHERE hi = 'region:ASIA' UNION SELECT 'region:ASIA') x, (SELECT lo FROM cl WHERE hi = 'region:ASIA' UNION SELECT 'region:ASIA') y WHERE x.lo <> y.lo")
ask("q_and_bound_variables", "(and (custSegment ?X MACHINERY) (isa ?X ?Y) (genls ?Y Place))", "SELECT DISTINCT e.arg1 AS X, t.b AS Y FROM e JOIN types t ON t.a = e.arg1 JOIN (SELECT lo FROM cl WHERE hi = 'Place' UNION SELECT 'Place') p ON p.lo = t.b WHERE e.pred = 'custSegment' AND e.arg2 = 'MACHINERY'")
ask("q_isa_instances", "(isa ?X region:EUROPE)", "SELECT a AS X FROM types WHERE b = 'region:EUROPE'")
ask("q_isa_function_types", "(isa ?X OrderEvent)", "SELECT DISTINCT a AS X FROM isa WHERE b = 'OrderEvent' OR b IN (SELECT lo FROM cl WHERE hi = 'OrderEvent')")
ask("q_genls_up", "(genls kind:STANDARD/Brand#1 ?X)", "SELECT hi AS X FROM cl WHERE lo = 'kind:STANDARD/Brand#1' UNION SELECT term FROM occ WHERE term = 'kind:STANDARD/Brand#1'")
ask("q_genls_down", "(genls ?X Product)", "SELECT lo AS X FROM cl WHERE hi = 'Product' UNION SELECT 'Product'")
ask("q_disjoint_partners", "(disjointWith nation:NATION_3 ?X)", "SELECT 'Product' AS X")
ask("q_order_parts_join", "(and (placedOrder ?C ?O) (containsPart ?O ?P) (isa ?C nation:NATION_4))", "SELECT DISTINCT a.arg1 AS C, a.arg2 AS O, b.arg2 AS P FROM e a JOIN e b ON b.pred = 'containsPart' AND b.arg1 = a.arg2 JOIN types t ON t.a = a.arg1 AND t.b = 'nation:NATION_4' WHERE a.pred = 'placedOrder'")


@query("edges_projection", "SELECT pred, arg1, arg2, sign FROM e")
def edges_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ontology(spark, sf_dir).select("pred", "arg1", "arg2", "sign")


@query("edge_positions", """, pos AS (SELECT '1' AS path, 0 AS depth, pred AS term FROM e UNION ALL SELECT '2', 0, arg1 FROM e UNION ALL SELECT '3', 0, arg2 FROM e
 UNION ALL SELECT '3F1', 1, regexp_extract(arg2, '^\\(([^ ()]+) ([^ ()]+)\\)', 1) FROM e WHERE starts_with(arg2, '(') UNION ALL SELECT '3F2', 1, regexp_extract(arg2, '^\\(([^ ()]+) ([^ ()]+)\\)', 2) FROM e WHERE starts_with(arg2, '('))
SELECT term, path, depth, count(*) AS n FROM pos GROUP BY ALL""")
def edge_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return model.positions(ontology(spark, sf_dir)).groupBy("term", "path", "depth").agg(F.count(F.lit(1)).alias("n"))


@query("scan_positional", "SELECT pred, arg1, arg2, sign FROM e WHERE pred <> 'placedOrder' AND (arg2 = '(OrderByFn cust:7)' OR arg1 = 'cust:7')")
def scan_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that hold cust:7 anywhere, in functional terms too, but are no orders."""
    ship(spark)
    edges = stored(spark, sf_dir)
    return scan.find(edges, [("cust:7", None), ("placedOrder", "-1")]).select("pred", "arg1", "arg2", "sign")


@query("nodes_by_kind", """, t AS (SELECT DISTINCT unnest([pred, arg1, arg2]) AS term FROM e), f AS (SELECT term FROM t UNION SELECT 'OrderByFn' UNION SELECT regexp_extract(term, '^\\([^ ()]+ ([^ ()]+)\\)', 1) FROM t WHERE starts_with(term, '('))
SELECT CASE WHEN starts_with(term, '(') THEN 'function' ELSE 'constant' END AS kind, count(*) AS n FROM f GROUP BY ALL""")
def nodes_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return model.nodes(ontology(spark, sf_dir)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


# ---- closure


@query("closure_genls", "SELECT lo, hi, dist FROM cl")
def closure_genls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kb_of(spark, sf_dir).strict("genls", up=False)


@query("closure_reflexive", "SELECT lo, hi FROM up UNION SELECT term, term FROM occ")
def closure_reflexive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kb_of(spark, sf_dir).closure("genls").select("lo", "hi")


@query("closure_shuffled", "SELECT lo, hi, dist FROM cl")
def closure_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The semi-naive rounds that closures beyond the broadcast bound take."""
    return C.reach(KB(ontology(spark, sf_dir)).step("genls", up=False), small=0)


@query("types_all", "SELECT a, b FROM types")
def types_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kb_of(spark, sf_dir).types().select("a", "b")


@query("depths", """, par AS (SELECT DISTINCT arg1 AS c, arg2 AS p FROM e WHERE pred IN ('genls', 'isa', 'genlPreds') AND sign = 1 UNION SELECT lo, hi FROM fgen),
long(term, d) AS (SELECT 'Thing', 0 UNION SELECT p, 1 FROM par WHERE p <> 'Thing' AND p NOT IN (SELECT c FROM par) UNION SELECT par.c, long.d + 1 FROM long JOIN par ON par.p = long.term)
SELECT term, max(d) AS depth FROM long GROUP BY ALL""")
def depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return depth_table(kb_of(spark, sf_dir))


def depth_table(kb: KB) -> DataFrame:
    return kb.depths()


@query("cycles_none", "SELECT lo AS term, lo AS component, dist AS length FROM cl WHERE lo = hi")
def cycles_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.cycles(kb_of(spark, sf_dir).strict("genls"))


# ---- named queries

named("c_allgenls", "ALLGENLS", ("nation:NATION_1",), "SELECT hi AS X FROM cl WHERE lo = 'nation:NATION_1' UNION SELECT 'nation:NATION_1'")
named("c_allisa", "ALLISA", ("cust:5",), "SELECT b AS X FROM types WHERE a = 'cust:5'")
named("c_commongenls", "COMMONGENLS", ("kind:STANDARD/Brand#1", "kind:PROMO/Brand#1"), "SELECT x.hi AS X FROM (SELECT lo, hi FROM cl UNION SELECT term, term FROM occ) x JOIN (SELECT lo, hi FROM cl UNION SELECT term, term FROM occ) y ON x.hi = y.hi WHERE x.lo = 'kind:STANDARD/Brand#1' AND y.lo = 'kind:PROMO/Brand#1'")
named("c_mincommongenls", "MINCOMMONGENLS", ("kind:STANDARD/Brand#1", "kind:PROMO/Brand#1"), """, c AS (SELECT x.hi AS t FROM (SELECT lo, hi FROM cl UNION SELECT term, term FROM occ) x JOIN (SELECT lo, hi FROM cl UNION SELECT term, term FROM occ) y ON x.hi = y.hi WHERE x.lo = 'kind:STANDARD/Brand#1' AND y.lo = 'kind:PROMO/Brand#1')
SELECT t AS X FROM c WHERE t NOT IN (SELECT cl.hi FROM cl JOIN c ON c.t = cl.lo)""")
named("c_commoninstances", "COMMONINSTANCES", ("GoodStanding", "nation:NATION_1"), "SELECT x.a AS X FROM types x JOIN types y USING (a) WHERE x.b = 'GoodStanding' AND y.b = 'nation:NATION_1'")
named("c_commonisa", "COMMONISA", ("cust:1", "cust:2"), "SELECT x.b AS X FROM types x JOIN types y USING (b) WHERE x.a = 'cust:1' AND y.a = 'cust:2'")
named("c_commonspecs", "COMMONSPECS", ("ptype:STANDARD", "brand:Brand#1"), "SELECT x.lo AS X FROM (SELECT lo, hi FROM cl UNION SELECT term, term FROM occ) x JOIN (SELECT lo, hi FROM cl UNION SELECT term, term FROM occ) y USING (lo) WHERE x.hi = 'ptype:STANDARD' AND y.hi = 'brand:Brand#1'")
named("c_directgenls", "DIRECTGENLS", ("kind:STANDARD/Brand#1",), "SELECT hi AS X FROM gen WHERE lo = 'kind:STANDARD/Brand#1'")
named("c_directinstance", "DIRECTINSTANCE", ("nation:NATION_5",), "SELECT a AS X FROM isa WHERE b = 'nation:NATION_5'")
named("c_directisa", "DIRECTISA", ("cust:5",), "SELECT b AS X FROM isa WHERE a = 'cust:5'")
named("c_directspecs", "DIRECTSPECS", ("Product",), "SELECT lo AS X FROM gen WHERE hi = 'Product'")
named("c_genlpreds", "GENLPREDS", ("placedOrder",), "SELECT 'placedOrder' AS X UNION SELECT 'relatedTo'")
named("c_specpreds", "SPECPREDS", ("relatedTo",), "SELECT 'placedOrder' AS X UNION SELECT 'relatedTo' UNION SELECT 'containsPart'")
named("c_genlsiblings", "GENLSIBLINGS", ("nation:NATION_1",), "SELECT DISTINCT s.lo AS X FROM gen g JOIN (SELECT lo, hi FROM cl UNION SELECT hi, hi FROM gen) s ON s.hi = g.hi WHERE g.lo = 'nation:NATION_1' AND s.lo <> 'nation:NATION_1'")
named("c_isasiblings", "ISASIBLINGS", ("region:ASIA",), "SELECT a AS X FROM types WHERE b = 'RegionType' AND a <> 'region:ASIA'")
named("c_instances", "INSTANCES", ("Place",), "SELECT a AS X FROM types WHERE b = 'Place'")
named("c_maxspecs", "MAXSPECS", ("Thing",), "SELECT lo AS X FROM gen WHERE hi = 'Thing'")
named("c_mingenls", "MINGENLS", ("kind:STANDARD/Brand#1",), "SELECT hi AS X FROM gen WHERE lo = 'kind:STANDARD/Brand#1'")
named("c_minisa", "MINISA", ("part:5",), "SELECT b AS X FROM isa WHERE a = 'part:5'")
named("c_specs", "SPECS", ("Place",), "SELECT lo AS X FROM cl WHERE hi = 'Place' UNION SELECT 'Place'")


_SIBLINGS = "SELECT DISTINCT x.lo AS a, y.lo AS b FROM gen x JOIN gen y ON x.hi = y.hi WHERE x.lo < y.lo"


def _siblings(kb: KB) -> DataFrame:
    """(a, b): all classes with a direct superclass in common."""
    e = kb.asserted("genls")
    return e.select(F.col("b").alias("p"), "a").join(e.select(F.col("b").alias("p"), F.col("a").alias("b")), "p").where("a < b").select("a", "b").distinct()


@query("min_common_genls_bulk", f""", r AS (SELECT lo, hi FROM cl UNION SELECT term, term FROM occ), s AS ({_SIBLINGS}),
c AS MATERIALIZED (SELECT s.a, s.b, x.hi AS t FROM s JOIN r x ON x.lo = s.a JOIN r y ON y.lo = s.b AND y.hi = x.hi)
SELECT c.a, c.b, c.t AS parent FROM c ANTI JOIN (SELECT DISTINCT d.a, d.b, cl.hi AS t FROM c d JOIN cl ON cl.lo = d.t) o ON o.a = c.a AND o.b = c.b AND o.t = c.t""")
def min_common_genls_bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lowest common ancestors of all sibling classes."""
    kb = kb_of(spark, sf_dir)
    pairs = checkpointed(_siblings(kb))
    kb.strict("genls")
    up = checkpointed(kb.upward(pairs.select(F.col("a").alias("lo")).union(pairs.select(F.col("b").alias("lo"))).distinct()).select("lo", "hi"))
    shared = pairs.join(up.select(F.col("lo").alias("a"), F.col("hi").alias("term")), "a").join(up.select(F.col("lo").alias("b"), F.col("hi").alias("term")), ["b", "term"], "left_semi")
    return C.minimal(shared.select("a", "b", "term"), kb.strict("genls"), ["a", "b"]).select("a", "b", F.col("term").alias("parent"))


# ---- proofs and disjointness


@query("disjoint_pairs", f""", p AS MATERIALIZED (SELECT a, b FROM ({_SIBLINGS}) UNION SELECT least(lo, hi), greatest(lo, hi) FROM gen),
r AS MATERIALIZED (SELECT lo, hi FROM cl UNION SELECT term, term FROM occ),
ax AS (SELECT a.lo AS a, b.lo AS b FROM r a JOIN r b ON (a.hi = 'Place' AND b.hi = 'Product') OR (a.hi = 'Product' AND b.hi = 'Place')),
below AS MATERIALIZED (SELECT hi AS c, lo AS z FROM r UNION SELECT b, a FROM types),
ov AS (SELECT DISTINCT p.a, p.b FROM p JOIN below x ON x.c = p.a JOIN below y ON y.c = p.b AND y.z = x.z)
SELECT p.a, p.b, CASE WHEN EXISTS (SELECT 1 FROM cl WHERE (lo = p.a AND hi = p.b) OR (lo = p.b AND hi = p.a)) THEN 'FALSE' WHEN (p.a, p.b) IN (SELECT (a, b) FROM ax) THEN 'TRUE'
 WHEN (p.a, p.b) IN (SELECT (a, b) FROM ov) THEN 'FALSE' WHEN starts_with(p.a, 'region:') AND starts_with(p.b, 'region:') THEN 'TRUE' ELSE 'NIL' END AS state FROM p""")
def disjoint_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sibling classes, and all classes with their superclasses."""
    kb = kb_of(spark, sf_dir)
    return kb.prove_disjoint(_siblings(kb).union(kb.asserted("genls").select(F.least("a", "b"), F.greatest("a", "b"))))


@query("prove_isa_bulk", "SELECT c.a, n.b, CASE WHEN (c.a, n.b) IN (SELECT (arg1, arg2) FROM e WHERE pred = 'isa' AND sign = -1) THEN 'FALSE' WHEN (c.a, n.b) IN (SELECT (a, b) FROM types) THEN 'TRUE' ELSE 'NIL' END AS state FROM (SELECT DISTINCT arg1 AS a FROM e WHERE pred = 'custSegment') c, (VALUES ('GoodStanding'), ('Place'), ('nation:NATION_1'), ('Product')) n(b)")
def prove_isa_bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer against four classes."""
    kb = kb_of(spark, sf_dir)
    customers = kb.asserted("custSegment").select("a").distinct()
    return kb.prove_isa(customers.withColumn("b", F.explode(F.array(*map(F.lit, ["GoodStanding", "Place", "nation:NATION_1", "Product"])))))


@query("prove_genls_bulk", f", s AS ({_SIBLINGS}), p AS (SELECT s.a, g.hi AS b FROM s JOIN gen g ON g.lo = s.b UNION SELECT g.hi, s.a FROM s JOIN gen g ON g.lo = s.b) SELECT p.a, p.b, CASE WHEN EXISTS (SELECT 1 FROM cl WHERE lo = p.a AND hi = p.b) THEN 'TRUE' ELSE 'NIL' END AS state FROM p")
def prove_genls_bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every class against the superclasses of its siblings, both ways."""
    kb = kb_of(spark, sf_dir)
    above = _siblings(kb).join(kb.asserted("genls").select(F.col("a").alias("b"), F.col("b").alias("c")), "b")
    return kb.prove_genls(above.select("a", F.col("c").alias("b")).union(above.select("c", "a")))


@query("disjoint_map", "SELECT lo AS term, hi AS axiom_term, 1 AS sign FROM (SELECT lo, hi FROM up UNION SELECT hi, hi FROM up) WHERE hi IN ('Place', 'Product')")
def disjoint_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kb_of(spark, sf_dir).disjoint_map()


# ---- analytics


@query("a1_collections", """, least AS (SELECT lo, hi FROM gen g WHERE lo <> hi AND NOT EXISTS (SELECT 1 FROM gen h JOIN cl ON cl.lo = h.hi AND cl.hi = g.hi WHERE h.lo = g.lo)),
greatest AS (SELECT lo, hi FROM gen g WHERE lo <> hi AND NOT EXISTS (SELECT 1 FROM gen h JOIN cl ON cl.hi = h.lo AND cl.lo = g.lo WHERE h.hi = g.hi))
SELECT term, coalesce(i.n, 0) AS n_instances, coalesce(s.n, 0) AS n_super, coalesce(d.n, 0) AS n_sub, coalesce(l.n, 0) AS n_min_super, coalesce(g.n, 0) AS n_max_sub, false AS has_alias, false AS has_comment FROM occ
LEFT JOIN (SELECT b, count(DISTINCT a) AS n FROM types GROUP BY 1) i ON i.b = term LEFT JOIN (SELECT lo, count(*) AS n FROM cl GROUP BY 1) s ON s.lo = term LEFT JOIN (SELECT hi, count(*) AS n FROM cl GROUP BY 1) d ON d.hi = term
LEFT JOIN (SELECT lo, count(*) AS n FROM least GROUP BY 1) l ON l.lo = term LEFT JOIN (SELECT hi, count(*) AS n FROM greatest GROUP BY 1) g ON g.hi = term""")
def a1_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.collections(kb_of(spark, sf_dir))


@query("a2_predicates", """SELECT pred AS term, count(*) AS n_uses, 2 AS arity, CASE WHEN pred IN ('placedOrder', 'containsPart') THEN 1 ELSE 0 END AS n_super, 0 AS n_sub, 0 AS n_arg_constraints, pred = 'disjointWith' AS symmetric, false AS has_comment FROM e GROUP BY 1
UNION ALL SELECT 'relatedTo', 0, NULL, 0, 2, 0, false, false""")
def a2_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.predicates(kb_of(spark, sf_dir))


@query("a3_functions", "SELECT func AS term, count(DISTINCT term) AS extent, 1 AS arity, 0 AS n_result_isa, 1 AS n_result_genl, true AS reifiable, false AS has_comment FROM fun GROUP BY 1")
def a3_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.functions(kb_of(spark, sf_dir))


@query("a4_individuals", """, d AS (SELECT a, b FROM isa WHERE a NOT IN (SELECT term FROM occ)), m AS (SELECT a, b FROM d WHERE NOT EXISTS (SELECT 1 FROM d x JOIN up ON up.lo = x.b AND up.hi = d.b WHERE x.a = d.a))
SELECT d.a AS term, count(DISTINCT d.b) AS n_isa, count(DISTINCT m.b) AS n_min_isa, false AS has_alias, false AS has_comment FROM d LEFT JOIN m USING (a) GROUP BY 1""")
def a4_individuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.individuals(kb_of(spark, sf_dir))


@query("a5_impact", """, s AS (SELECT hi AS term, count(DISTINCT lo) AS n FROM (SELECT lo, hi FROM cl UNION SELECT term, term FROM occ) GROUP BY 1), i AS (SELECT b AS term, count(DISTINCT a) AS n FROM types GROUP BY 1)
SELECT term, round(ln(s.n), 9) AS ln_specs, CASE WHEN coalesce(i.n, 0) = 0 THEN '-Infinity'::DOUBLE ELSE round(ln(i.n), 9) END AS ln_instances, round(ln(s.n + coalesce(i.n, 0)), 9) AS ln_total FROM s LEFT JOIN i USING (term)""")
def a5_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.impact(kb_of(spark, sf_dir))
    rounded = lambda c: F.when(F.col(c) == A.NEG_INF, F.col(c)).otherwise(F.round(c, 9)).alias(c)
    return out.select("term", *[rounded(c) for c in ("ln_specs", "ln_instances", "ln_total")])


@query("a6_similarity", f""", f AS MATERIALIZED (SELECT a AS t, b AS f FROM types UNION SELECT lo, hi FROM up UNION SELECT term, term FROM occ), p AS MATERIALIZED ({_SIBLINGS}),
k AS (SELECT a AS t FROM p UNION SELECT b FROM p), g AS MATERIALIZED (SELECT t, f FROM f SEMI JOIN k USING (t)), n AS (SELECT t, count(*) AS n FROM g GROUP BY 1),
b AS (SELECT p.a, p.b, count(*) AS c FROM p JOIN g x ON x.t = p.a JOIN g y ON y.t = p.b AND y.f = x.f GROUP BY ALL)
SELECT b.a, b.b, round(c::DOUBLE / (x.n + y.n - c), 9) AS similarity FROM b JOIN n x ON x.t = b.a JOIN n y ON y.t = b.b""")
def a6_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sibling classes, which share a superclass at least."""
    return A.similarity_of(kb_of(spark, sf_dir), _siblings(kb_of(spark, sf_dir))).select("a", "b", F.round("similarity", 9).alias("similarity"))


@query("a8_relation_counts", """, t AS (SELECT DISTINCT 'R' || (p_size % 3) AS relation, 'kind:' || p_type || '/' || p_brand AS k, 'nation:' || n_name AS n, 'ptype:' || p_type AS pt FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)
SELECT relation, count(DISTINCT (k, n)) AS disjoint, count(DISTINCT (k, pt)) AS conjoint, 0 AS unknown, round((count(DISTINCT (k, n)) + 1) / (count(DISTINCT (k, n)) + count(DISTINCT (k, pt)) + 2)::DOUBLE, 9) AS reliability FROM t GROUP BY 1""")
def a8_relation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of part against the nations that supply them (disjoint) and against their types (conjoint), by part size."""
    kb = kb_of(spark, sf_dir)
    by_rel, _ = A.relation_counts(kb, _triples(spark, sf_dir))
    return by_rel.withColumn("reliability", F.round(A.reliability(F.col("disjoint"), F.col("conjoint")), 9))


def _triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("lineitem", "part", "supplier", "nation")}
    part = t["part"].select("p_partkey", F.concat(F.lit("R"), (F.col("p_size") % 3).cast("string")).alias("relation"), F.concat(F.lit("kind:"), "p_type", F.lit("/"), "p_brand").alias("k"), F.concat(F.lit("ptype:"), "p_type").alias("pt"))
    sold = t["lineitem"].select("l_partkey", "l_suppkey").distinct().join(part, F.col("l_partkey") == F.col("p_partkey")).join(t["supplier"], F.col("l_suppkey") == F.col("s_suppkey")).join(t["nation"], F.col("s_nationkey") == F.col("n_nationkey"))
    sold = sold.select("relation", "k", F.concat(F.lit("nation:"), "n_name").alias("n"), "pt").distinct()
    return sold.select("relation", F.col("k").alias("a"), F.col("n").alias("b")).union(sold.select("relation", "k", "pt")).distinct()


@query("a7_pair_features")
def a7_pair_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 columns for each pair of a8 and minimal common parent."""
    kb = kb_of(spark, sf_dir)
    t = _triples(spark, sf_dir).select("relation", F.col("a").alias("arg1"), F.col("b").alias("arg2"), F.col("a").alias("disamb1"), F.col("b").alias("disamb2"))
    return A.pair_features(kb, t, depth_table(kb))


@query("a21_function_extent", "SELECT DISTINCT term FROM fun WHERE func = 'OrderByFn'")
def a21_function_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.extent(kb_of(spark, sf_dir), "OrderByFn")


@query("a22_predicates_for", "SELECT DISTINCT t AS term, pred FROM (SELECT pred, arg1 AS t, sign FROM e UNION SELECT pred, arg2, sign FROM e) WHERE sign = 1 AND starts_with(t, 'cust:')")
def a22_predicates_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    kb = kb_of(spark, sf_dir)
    return A.predicates_for(kb, kb.asserted("custSegment").select(F.col("a").alias("term")))


@query("a20_semantic_siblings", """, s AS (SELECT DISTINCT x.lo AS t FROM gen g JOIN (SELECT lo, hi FROM cl UNION SELECT hi, hi FROM gen) x ON x.hi = g.hi WHERE g.lo = 'nation:NATION_1' AND x.lo <> 'nation:NATION_1'),
f AS (SELECT a AS t, b AS f FROM types UNION SELECT lo, hi FROM up UNION SELECT term, term FROM occ), m AS (SELECT f FROM f WHERE t = 'nation:NATION_1'),
c AS (SELECT s.t, count(*) AS n, count(m.f) AS c FROM s JOIN f USING (t) LEFT JOIN m ON m.f = f.f GROUP BY 1)
SELECT t AS X, round(c::DOUBLE / (n + (SELECT count(*) FROM m) - c), 9) AS similarity FROM c""")
def a20_semantic_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common.siblings_ranked(kb_of(spark, sf_dir), "nation:NATION_1").select("X", F.round("similarity", 9).alias("similarity"))


@query("a15_refinement", """SELECT 'placedOrder' AS pred, 1 AS pos, 'Place' AS type UNION ALL SELECT 'placedOrder', 2, 'OrderEvent' UNION ALL SELECT 'containsPart', 1, 'OrderEvent' UNION ALL SELECT 'containsPart', 2, 'Product'""")
def a15_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Argument types that 95 in 100 edges of two predicates share, without those that say nothing."""
    kb = kb_of(spark, sf_dir)
    preds = spark.createDataFrame([("placedOrder",), ("containsPart",)], "pred string")
    return A.refine(kb, preds, 0.95)


@query("a26_page", "SELECT term FROM occ ORDER BY lower(term), term OFFSET 10 LIMIT 20")
def a26_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 10 to 30 of the classes in alphabetical order."""
    return A.page(kb_of(spark, sf_dir).occurring("genls"), [A.sort_key(F.col("term")), "term"], 10, 30)


@query("subgraph", """, keep AS (SELECT hi AS term FROM cl WHERE lo = 'nation:NATION_1' UNION SELECT 'nation:NATION_1' UNION SELECT b FROM types WHERE a = 'nation:NATION_1')
SELECT pred, arg1, arg2, sign FROM e WHERE arg1 IN (SELECT term FROM keep) AND arg2 IN (SELECT term FROM keep)""")
def subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    kb = kb_of(spark, sf_dir)
    return A.subgraph(kb, spark.createDataFrame([("nation:NATION_1",)], "term string")).select("pred", "arg1", "arg2", "sign")


# ---- constraints


def _candidates(kb: KB) -> DataFrame:
    """What the orders and customers might claim: some of it false."""
    customers = kb.asserted("custSegment").select("a").distinct()
    wrong = customers.select(F.lit("isa").alias("pred"), F.col("a").alias("arg1"), F.lit("Product").alias("arg2"), F.lit(1).alias("sign"))
    good = customers.select(F.lit("isa"), "a", F.lit("GoodStanding"), F.lit(1))
    upside = kb.asserted("genls").where(F.col("a").startswith("nation:")).select(F.lit("genls"), "b", "a", F.lit(1))
    fresh = kb.asserted("placedOrder").select(F.lit("placedOrder"), "a", "b", F.lit(1))
    return model.edges_from_pairs(wrong.union(good).union(upside).union(fresh))


@query("v_validate", """, neg AS (SELECT DISTINCT arg1 AS a FROM e WHERE pred = 'isa' AND arg2 = 'GoodStanding' AND sign = -1), c AS (SELECT DISTINCT arg1 AS a FROM e WHERE pred = 'custSegment')
SELECT '(isa ' || a || ' Product)' AS raw, 'DISJOINT' AS code FROM c UNION ALL SELECT '(isa ' || a || ' GoodStanding)', 'NEGATED' FROM neg UNION ALL SELECT '(genls ' || hi || ' ' || lo || ')', 'CYCLIC' FROM gen WHERE starts_with(lo, 'nation:')""")
def v_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    kb = kb_of(spark, sf_dir)
    return constraints.validate(kb, _candidates(kb)).rejects.select("raw", "code")


@query("v_accepted", """, neg AS (SELECT DISTINCT arg1 AS a FROM e WHERE pred = 'isa' AND arg2 = 'GoodStanding' AND sign = -1), c AS (SELECT DISTINCT arg1 AS a FROM e WHERE pred = 'custSegment')
SELECT 'isa' AS pred, a AS arg1, 'GoodStanding' AS arg2 FROM c WHERE a NOT IN (SELECT a FROM neg) UNION ALL SELECT DISTINCT pred, arg1, arg2 FROM e WHERE pred = 'placedOrder'""")
def v_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    kb = kb_of(spark, sf_dir)
    return constraints.validate(kb, _candidates(kb)).accepted.select("pred", "arg1", "arg2")


@query("v_propagate", "SELECT DISTINCT 'isa' AS pred, arg1, arg2, sign FROM e WHERE pred = 'custSegment'")
def v_propagate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of a predicate below isa also hold as isa."""
    edges = ontology(spark, sf_dir)
    kb = KB(edges.unionByName(model.edges_of(spark, ["(genlPreds custSegment isa)"])))
    return constraints.propagate(kb, kb.active).select("pred", "arg1", "arg2", "sign")


@query("v_strictly_functional", "SELECT arg1, max(arg2) AS arg2 FROM e WHERE pred = 'placedOrder' GROUP BY 1")
def v_strictly_functional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's newest order; edge ids grow with the order's name."""
    e = stored(spark, sf_dir).where("pred = 'placedOrder'")
    name = F.rpad(F.col("arg2"), 12, " ")
    code = lambda a, n: F.conv(F.hex(F.encode(F.substr(name, F.lit(a), F.lit(n)), "utf-8")), 16, 10).cast("long")
    e = e.withColumn("edge_id", code(5, 7))
    kb = KB(e.unionByName(model.edges_of(spark, ["(isa placedOrder StrictlyFunctionalSlot)"])))
    return constraints.strictly_functional(kb).where("pred = 'placedOrder'").select("arg1", "arg2")


@query("v_rewrite", "SELECT DISTINCT CASE WHEN arg2 = 'region:ASIA' THEN 'region:Asia' WHEN arg2 = '(OrderByFn cust:1)' THEN '(OrderByFn client:1)' ELSE arg2 END AS arg2, CASE WHEN arg1 = 'cust:1' THEN 'client:1' WHEN arg1 = 'region:ASIA' THEN 'region:Asia' ELSE arg1 END AS arg1, pred, sign FROM e WHERE pred IN ('isa', 'genls')")
def v_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = ontology(spark, sf_dir).where(F.col("pred").isin("isa", "genls"))
    kb = KB(checkpointed(edges.unionByName(model.edges_of(spark, ["(rewriteOf client:1 client1)", "(rewriteOf client1 cust:1)", "(rewriteOf region:Asia region:ASIA)"]).withColumn("edge_id", F.col("edge_id") - 10))))
    return constraints.rewrite(kb).where("pred <> 'rewriteOf'").select("pred", "arg1", "arg2", "sign")


@query("v_remove", "SELECT pred, count(*) AS n, count(*) FILTER (pred = 'custSegment' AND arg2 = 'BUILDING') AS removed FROM e GROUP BY 1")
def v_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ontology(spark, sf_dir)
    out = constraints.remove(e, e.where("pred = 'custSegment' and arg2 = 'BUILDING'"))
    return out.groupBy("pred").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("removed"), 1)).alias("removed"))


# ---- functions and sinks


@query("x1_assertion_lines", "SELECT CASE WHEN sign < 0 THEN '(not (' || pred || ' ' || arg1 || ' ' || arg2 || '))' ELSE '(' || pred || ' ' || arg1 || ' ' || arg2 || ')' END AS value FROM e")
def x1_assertion_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.assertion_lines(ontology(spark, sf_dir))


@query("x2_csv_rows", "SELECT pred, CASE WHEN starts_with(arg2, '(') THEN 'FUNCTION' ELSE arg2 END AS arg2, count(*) AS n FROM e WHERE pred IN ('isa', 'genls', 'genlPreds', 'genlMt') AND sign = 1 GROUP BY ALL")
def x2_csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    rows, _ = files.csv_tables(ontology(spark, sf_dir))
    return rows.withColumn("arg2", F.when(F.col("arg2").rlike("^FUNCTION_[0-9]+$"), "FUNCTION").otherwise(F.col("arg2"))).groupBy("pred", "arg2").agg(F.count(F.lit(1)).alias("n"))


@query("f1_names", """, t AS (SELECT DISTINCT unnest([arg1, arg2]) AS term FROM e)
SELECT term, regexp_replace(regexp_replace(replace(term, '_', ' '), '([a-zà-ÿ])([A-Z0-9])', '\\1 \\2', 'g'), '([^ (])([A-Z][a-z])', '\\1 \\2', 'g') AS name FROM t WHERE NOT starts_with(term, '(') AND NOT regexp_matches(term, '-')""")
def f1_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = ontology(spark, sf_dir).select(F.explode("args").alias("term")).where(~model.is_function(F.col("term")) & ~F.col("term").contains("-")).distinct()
    return terms.select("term", text.concept_to_text(F.col("term")).alias("name"))


_DAY = "'(DayFn ''' || day(o_orderdate) || ' (MonthFn ' || monthname(o_orderdate) || ' (YearFn ''' || year(o_orderdate) || ')))'"


@query("f9_date_intervals", f"""WITH d AS (SELECT o_orderkey, {_DAY} AS term, date_trunc('day', o_orderdate) AS s FROM orders)
SELECT o_orderkey, term, epoch_ms(s) AS start_ms, epoch_ms(s + INTERVAL 1 DAY) - 1 AS end_ms, s >= TIMESTAMP '1995-12-31 23:59:59.999' AS after_1995 FROM d""")
def f9_date_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    term = F.concat(F.lit("(DayFn '"), F.day(d).cast("string"), F.lit(" (MonthFn "), F.date_format(d, "MMMM"), F.lit(" (YearFn '"), F.year(d).cast("string"), F.lit(")))"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", term.alias("term"))
    span = dates.interval(F.col("term"))
    after = dates.later(F.col("term"), F.lit("(YearFn '1995)"))
    return orders.select("o_orderkey", "term", F.unix_millis(span["start"]).alias("start_ms"), F.unix_millis(span["end"]).alias("end_ms"), after.alias("after_1995"))


@query("f8_date_texts", """WITH t AS (SELECT DISTINCT day(o_orderdate) AS d, month(o_orderdate) AS m, year(o_orderdate) AS y FROM orders)
SELECT d || '/' || m || '/' || y AS text, CASE WHEN d <= 12 AND d <> m THEN 2 ELSE 1 END AS n FROM t""")
def f8_date_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many dates `day/month/year` can mean."""
    ship(spark)
    d = F.col("o_orderdate")
    t = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat_ws("/", F.day(d), F.month(d), F.year(d)).alias("text")).distinct()
    return t.select("text", F.size(dates.date_terms("text")).alias("n"))
