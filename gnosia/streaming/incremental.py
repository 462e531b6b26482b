"""Incremental maintenance: a stream of edge files keeps edges and the genls closure up to date.

Each micro-batch is validated, inserted with set semantics and added to the closure; the closure is computed again only
for the terms below a new edge. Both tables are written as new versions, so a batch that is run again after a failure
gives the same version.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gnosia import model
from gnosia.operators import closure as C
from gnosia.operators.constraints import admit, insert
from gnosia.operators.kb import KB
from gnosia.operators.tables import written as checkpointed
from gnosia.streaming.views import chosen


class Maintainer:
    """Versions of the edge table and its genls closure in a folder: edges/v=n, closure/v=n, rejects/v=n; and of views, by name."""

    def __init__(self, spark: SparkSession, folder: str, check: bool = True, views: Sequence[str] = ()) -> None:
        self.spark, self.folder, self.check, self.version, self.views = spark, folder.rstrip("/"), check, -1, chosen(views)

    def start(self, edges: DataFrame) -> None:
        """Version 0 from a first edge table."""
        pairs = edges.where("pred = 'genls' and sign = 1 and not removed").select(F.col("arg1").alias("lo"), F.col("arg2").alias("hi"))
        edges.write.mode("overwrite").parquet(self._path("edges", 0))
        C.reach(pairs).write.mode("overwrite").parquet(self._path("closure", 0))
        self.version = 0
        for name, view in self.views.items():
            view.build(KB(self.edges())).write.mode("overwrite").parquet(self._path(name, 0))

    def _path(self, table: str, version: int) -> str:
        return f"{self.folder}/{table}/v={version}"

    def edges(self) -> DataFrame:
        return self.spark.read.schema(model.EDGES).parquet(self._path("edges", self.version))

    def closure(self) -> DataFrame:
        return self.spark.read.schema(C.SCHEMA).parquet(self._path("closure", self.version))

    def view(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self._path(name, self.version))

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch; batch ids count from 0, version n + 1 holds batches up to n."""
        if self.version < 0:
            raise RuntimeError("start() first")
        self.version = batch_id
        old, closure = self.edges(), self.closure()
        new = checkpointed(batch.dropDuplicates(["pred", "args", "sign", "removed"]))
        if self.check:
            got = admit(KB(old), new)
            got.rejects.write.mode("overwrite").parquet(self._path("rejects", batch_id + 1))
            new = checkpointed(got.accepted)
        key = ["pred", "args", "sign"]
        gone = new.where("removed").select(*key)
        grown = insert(old, new.where("not removed"))
        grown = grown.join(gone.distinct().withColumn("__g", F.lit(True)), key, "left").withColumn("removed", F.col("removed") | F.coalesce("__g", F.lit(False))).select(*old.columns)
        genls = lambda df: df.where("pred = 'genls' and sign = 1").select(F.col("arg1").alias("lo"), F.col("arg2").alias("hi"))
        before = genls(old.where("not removed"))
        lost, added = checkpointed(genls(new.where("removed"))), checkpointed(genls(new.where("not removed")))
        if not lost.isEmpty():
            closure = C.retract(closure, before, lost)
            before = before.join(lost, ["lo", "hi"], "left_anti")
        if not added.isEmpty():
            closure = C.extend(closure, before, added)
        grown.write.mode("overwrite").parquet(self._path("edges", batch_id + 1))
        closure.write.mode("overwrite").parquet(self._path("closure", batch_id + 1))
        known = {name: self.view(name) for name in self.views}
        self.version = batch_id + 1
        after = KB(self.edges())
        for name, view in self.views.items():
            view.changed(known[name], KB(old), after, new).write.mode("overwrite").parquet(self._path(name, self.version))

    def stream(self, source: str, checkpoint: str):
        """Follow a folder of edge Parquet files; each file arrives once."""
        reader = self.spark.readStream.schema(model.EDGES).parquet(source)
        return reader.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
