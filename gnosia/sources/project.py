"""An ontology derived from the relational tables; one statement that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gnosia.model import EDGES, edges_from_pairs
from gnosia.operators.tables import sized, temporary, unsorted

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "conversations")
#: What the derived ontology asserts beside the rows of the tables.
FACTS = [
    ("genls", "Place", "Thing", 1), ("genls", "Product", "Thing", 1), ("disjointWith", "Place", "Product", 1), ("isa", "disjointWith", "SymmetricBinaryPredicate", 1),
    ("isa", "RegionType", "SiblingDisjointCollectionType", 1), ("genlPreds", "placedOrder", "relatedTo", 1), ("genlPreds", "containsPart", "relatedTo", 1),
    ("resultGenl", "OrderByFn", "OrderEvent", 1), ("genls", "OrderEvent", "Thing", 1),
]
EDGE_SQL = f"""
SELECT 'genls' AS pred, concat('nation:', n_name) AS arg1, concat('region:', r_name) AS arg2, 1 AS sign FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'genls', concat('region:', r_name), 'Place', 1 FROM region
UNION ALL SELECT 'isa', concat('region:', r_name), 'RegionType', 1 FROM region
UNION ALL SELECT 'isa', concat('cust:', c_custkey), concat('nation:', n_name), 1 FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 'isa', concat('supp:', s_suppkey), concat('nation:', n_name), 1 FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT DISTINCT 'genls', concat('kind:', p_type, '/', p_brand), concat('ptype:', p_type), 1 FROM part
UNION ALL SELECT DISTINCT 'genls', concat('kind:', p_type, '/', p_brand), concat('brand:', p_brand), 1 FROM part
UNION ALL SELECT DISTINCT 'genls', concat('ptype:', p_type), 'Product', 1 FROM part
UNION ALL SELECT DISTINCT 'genls', concat('brand:', p_brand), 'Product', 1 FROM part
UNION ALL SELECT 'isa', concat('part:', p_partkey), concat('kind:', p_type, '/', p_brand), 1 FROM part
UNION ALL SELECT 'custSegment', concat('cust:', c_custkey), c_mktsegment, 1 FROM customer
UNION ALL SELECT 'isa', concat('cust:', c_custkey), 'GoodStanding', CASE WHEN c_acctbal < 0 THEN -1 ELSE 1 END FROM customer
UNION ALL SELECT 'placedOrder', concat('cust:', o_custkey), concat('ord:', o_orderkey), 1 FROM orders
UNION ALL SELECT 'isa', concat('ord:', o_orderkey), concat('(OrderByFn cust:', o_custkey, ')'), 1 FROM orders
UNION ALL SELECT DISTINCT 'containsPart', concat('ord:', l_orderkey), concat('part:', l_partkey), 1 FROM lineitem
UNION ALL SELECT 'genls', concat('turn:', conv_id, '.', turn), concat('turn:', conv_id, '.', turn - 1), 1 FROM conversations WHERE turn > 0
UNION ALL SELECT * FROM (VALUES {", ".join(map(str, FACTS))}) AS v(pred, arg1, arg2, sign)
"""


def over_tables(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A statement over the relational tables of a folder, lazily: filters prune whole branches of a union."""
    size = 0
    for name in TABLES:
        view = f"gnosia_{name}_{abs(hash(sf_dir)) % 10**8}"
        t = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        size += int(t._jdf.queryExecution().analyzed().stats().sizeInBytes())
        t.createOrReplaceTempView(view)
        sql = sql.replace(f"FROM {name} ", f"FROM {view} AS {name} ").replace(f"FROM {name}\n", f"FROM {view} AS {name}\n").replace(f"JOIN {name} ", f"JOIN {view} AS {name} ")
    sized(spark, size)
    return spark.sql(sql)


def ontology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edge table of the relational tables in a folder."""
    return edges_from_pairs(over_tables(spark, sf_dir, EDGE_SQL))


_stored: dict[tuple[str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same edges, loaded once for each application and folder: Parquet partitioned by predicate in the shared folder.

    Queries then read the partitions of their predicates only, and their plans hold one scan instead of the union.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stored:
        path = temporary(spark, "edges")
        with unsorted(spark):
            ontology(spark, sf_dir).write.partitionBy("pred").parquet(path)
        _stored[key] = path
    names = [c.strip().split(" ")[0] for c in EDGES.replace("map<string,string>", "map").split(",")]
    return spark.read.schema(EDGES).parquet(_stored[key]).select(*names)
