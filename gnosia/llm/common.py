"""Shared plumbing of the text operators: Arrow batches in bounded slices, table access."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gnosia.operators.tables import dropped, ship, temporary, written

__all__ = ["BATCH_ROWS", "SLICE_BYTES", "as_text", "cut", "dropped", "hit", "map_texts", "marks", "release", "ship", "table", "temporary", "without", "written"]

#: UTF-8 bytes of text handled at once in a Python worker; one longer text is handled alone.
SLICE_BYTES = 1 << 19
#: Rows of one Arrow batch sent to a Python worker.
BATCH_ROWS = 512
#: Bits of the map that marks rows; 4 MB for any table.
MARKS = 1 << 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """df without the columns that a result would clash with; names compare without case, as in Spark."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def as_text(column: pa.Array) -> pa.Array:
    """A string column without nulls (a null counts as an empty text)."""
    column = column.cast(pa.string()) if not pa.types.is_string(column.type) else column
    return column.fill_null("")


def cut(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(start, length) of consecutive slices of at most `limit` bytes, or of one longer text."""
    offs = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1 + texts.offset)[texts.offset :].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        yield at, to - at
        at = to


def release(fn: object = None) -> None:
    """Give memory back at the end of a task: the worker stays for later stages. fn.close() drops what fn remembers."""
    if (close := getattr(fn, "close", None)) is not None:
        close()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library is glibc
        ctypes.CDLL(None).malloc_trim(0)


def map_texts(df: DataFrame, fields: Sequence[T.StructField], make: Callable[[], Callable[[pa.Array], dict]], text: str = "text", keep: Sequence[str] | None = None, beside: str | None = None) -> DataFrame:
    """Add `fields`, computed from whole texts by make()(texts); columns of these names are replaced.

    keep: the columns of df that stay (all by default). beside: a column that make() gets too, as strings: make()(texts, strings). No shuffle; memory is bounded by SLICE_BYTES or the longest text.
    """
    rest = [c for c in (df.columns if keep is None else keep) if c.lower() not in {f.name.lower() for f in fields}]
    src = df.select(F.col(f"`{text}`").cast("string").alias("__text"), *[F.col(f"`{c}`") for c in rest], *([F.col(f"`{beside}`").cast("string").alias("__beside")] if beside else []))
    schema = T.StructType([*src.schema.fields[1 : 1 + len(rest)], *fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        try:
            for batch in batches:
                whole = as_text(batch.column(0))
                for at, n in cut(whole):
                    got = fn(whole.slice(at, n)) if beside is None else fn(whole.slice(at, n), batch.column(len(rest) + 1).slice(at, n))
                    cols = [batch.column(i + 1).slice(at, n).cast(arrow.field(i).type) for i in range(len(rest))]
                    cols += [got[f.name] if isinstance(got[f.name], pa.Array) else pa.array(got[f.name], arrow.field(f.name).type) for f in fields]
                    yield pa.RecordBatch.from_arrays(cols, names=arrow.names)
        finally:
            release(fn)

    return src.mapInArrow(run, schema)


def marks(wanted: DataFrame) -> np.ndarray:
    """A map of MARKS bits with those of wanted's column `mark` (long) set; its parts are built where the rows are."""
    at = wanted.select(F.pmod("mark", F.lit(MARKS)).alias("at"))
    parts = at.groupBy(F.shiftright("at", 15).alias("part")).agg(F.bitmap_construct_agg(F.pmod("at", F.lit(1 << 15))).alias("bits"))
    bits = np.zeros((MARKS >> 15, 1 << 12), np.uint8)
    for r in parts.collect():  # at most MARKS / 2^15 rows of 4 KB
        bits[r.part] = np.frombuffer(r.bits, np.uint8)
    return bits.ravel()


def hit(bits: np.ndarray, mark: Column) -> Column:
    """Whether a mark may be one of those of marks(): true for all that are, and for others that share a bit with one.

    It keeps rows that a join would not meet out of the join's exchange, and nothing else: what it lets pass is joined
    exactly. Beyond a few hundred million marks no bit is clear and every row passes.
    """

    @F.arrow_udf(T.BooleanType())
    def fn(mark: pa.Array) -> pa.Array:
        at = mark.to_numpy(zero_copy_only=False) & (MARKS - 1)
        return pa.array((bits[at >> 3] >> (at & 7)) & 1 > 0)

    return fn(mark)
