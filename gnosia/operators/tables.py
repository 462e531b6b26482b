"""Written tables and size checks that iterative operators need."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where none is set and one machine does everything."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        sc = spark.sparkContext
        if sc.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        if getattr(sc, "_gnosia_folder", None) is None:
            sc._gnosia_folder = tempfile.mkdtemp(prefix="gnosia-shared-")
        folder = sc._gnosia_folder
    return folder.rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def temporary(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    fs, p = _hadoop(spark, path)
    fs.deleteOnExit(p)
    return path


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table in the shared folder: computed once, read by all, its size known to the optimizer.

    A checkpoint keeps the estimates of the plan before it, which square with each join of a loop.
    """
    path = temporary(df.sparkSession, "gnosia")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._gnosia_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete a table of written() that nothing will read again."""
    fs, p = _hadoop(df.sparkSession, df._gnosia_path)
    fs.delete(p, True)


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each SparkContext."""
    sc = spark.sparkContext
    if getattr(sc, "_gnosia_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if os.path.isdir(top):
        path = os.path.join(tempfile.mkdtemp(prefix="gnosia-"), "gnosia.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(top):
                for n in names:
                    if n.endswith(".py"):
                        full = os.path.join(folder, n)
                        z.write(full, os.path.relpath(full, os.path.dirname(top)))
        sc.addPyFile(path)
    sc._gnosia_shipped = True


#: Shuffled bytes for one task to read, and bytes of input for each partition that a shuffle starts with.
READ, START = 16 << 20, 8 << 20


def sized(spark: SparkSession, size: int) -> None:
    """Let shuffles start with as many partitions as the input asks for, and tasks read the same amount at any size.

    AQE puts small partitions together, so small inputs keep their tasks. What the session sets itself stays.
    """
    own = dict(spark.conf.getAll)
    first, read = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    if own.get(first) in (None, *_given):
        _given.add(n := str(max(int(own.get("spark.sql.shuffle.partitions", 200)), min(-(-size // START), 8000))))
        spark.conf.set(first, n)
    if read not in own:
        spark.conf.set(read, str(READ))


#: Numbers of first partitions that were set here.
_given: set[str] = set()


@contextlib.contextmanager
def unsorted(spark: SparkSession) -> Iterator[None]:
    """Write tables by a partition column without sorting each task's rows first."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name, "0")
    spark.conf.set(name, max(int(before), 32))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def few(df: DataFrame, most: int) -> list | None:
    """The rows, if there are at most so many; else null. Never collects more than most + 1 rows."""
    rows = df.limit(most + 1).collect()
    return rows if len(rows) <= most else None
