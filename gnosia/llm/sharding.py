"""Operator 9: shards of near-equal bytes by histogram sort.

Rows are ordered by (hash of the text, doc_id), so equal texts stand together. Candidate boundaries (probes) are laid
into the open interval of each splitter; one pass counts the exact bytes below every probe, each partition summing its
own first, and the intervals shrink until every splitter is within tolerance. A splitter falls between two texts where
that meets the tolerance; a group of copies is parted (by doc_id) only where it is larger than that. Then the rows are
exchanged once, into cells finer than shards, whose exact row counts give each row its slot.

Rows that agree in text and doc_id have no order; where they fill more than a cell they are dealt to salted parts, whose
counts give each row its place, so that a splitter may fall among them too.

Results: a null text has size `overhead` and sorts as the empty text; null doc_ids come first in their group; with more
shards than rows some stay empty; an empty table gives an empty table; columns named like a result, whatever their case,
are replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gnosia.llm.common import without, written

SHARDS, OVERHEAD = 40, 16
#: Most bytes that a splitter may be off, as a share of a shard.
TOLERANCE = 0.01
#: Probes laid into an open interval in one round.
PROBES = 31
#: Rows of one cell of the exchange, at most (fewer where there are few rows, so that no group of copies stands out).
CELL_ROWS, LEAST_ROWS = 20_000, 256
#: Tasks whose counts the driver adds up itself (some kB each), and the tasks that do so for more of them.
DIRECT, MERGERS = 512, 64
LOW = -(1 << 63)
TOP = (1 << 63) - 1


def cells(h: np.ndarray, ident: np.ndarray, bound_h: np.ndarray, bound_id: np.ndarray) -> np.ndarray:
    """How many of the sorted boundaries (hash, id) are at or below each (h, ident)."""
    lo, hi = np.searchsorted(bound_h, h, "left"), np.searchsorted(bound_h, h, "right")
    for b in np.unique(lo[lo < hi]).tolist():
        mine = np.flatnonzero((lo == b) & (hi > b))
        end = int(hi[mine[0]])
        lo[mine] += np.searchsorted(bound_id[b:end], ident[mine], "right")
    return lo


def _counted(keys: DataFrame, bounds: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Bytes and rows below each boundary, exactly; keys has the columns h, id, size.

    Each task packs its cells into one row. The driver adds these up; above DIRECT tasks, MERGERS tasks do it first.
    """
    bh, bi = (np.array([b[k] for b in bounds], np.int64) for k in (0, 1))
    width = len(bounds) + 1

    def packed(total: np.ndarray) -> pa.RecordBatch:
        some = np.flatnonzero(total[1])
        blob = np.concatenate([some, total[0][some], total[1][some]]).tobytes()
        return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % MERGERS]), pa.array([blob], pa.binary())], names=["part", "cells"])

    def add(total: np.ndarray, blob: bytes) -> None:
        cell, size, rows = np.frombuffer(blob, np.int64).reshape(3, -1)
        total[0][cell] += size
        total[1][cell] += rows

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, width), np.int64)
        for batch in batches:
            h, ident, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            c = cells(h, ident, bh, bi)
            np.add.at(total[0], c, n)
            total[1] += np.bincount(c, minlength=width)
        yield packed(total)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, width), np.int64)
        for batch in batches:
            for blob in batch.column(1).to_pylist():
                add(total, blob)
        if total[1].any():
            yield packed(total)

    schema = "part long, cells binary"
    total = np.zeros((2, width), np.int64)
    rows = keys.select("h", "id", "size").mapInArrow(count, schema)
    if keys.rdd.getNumPartitions() > DIRECT:
        rows = rows.repartition(MERGERS, "part").mapInArrow(merge, schema)
    for r in rows.collect():
        add(total, bytes(r["cells"]))
    return np.cumsum(total[0]).tolist(), np.cumsum(total[1]).tolist()


def _between(lo: tuple[int, int], hi: tuple[int, int], ids: tuple[int, int], n: int) -> list[tuple[int, int]]:
    """Up to n keys strictly between two: by hash while there are hashes between, then by id within one hash."""
    if hi[0] - lo[0] > 1:
        return sorted({(x, LOW) for k in range(1, n + 1) if lo[0] < (x := lo[0] + (hi[0] - lo[0]) * k // (n + 1)) < hi[0]} | {(lo[0] + 1, LOW)})
    if hi[0] > lo[0] and lo[1] > ids[1]:
        return []
    a = max(lo[1], ids[0])
    b = hi[1] if hi[0] == lo[0] else ids[1] + 1
    return sorted({(lo[0], x) for k in range(1, n + 1) if a < (x := a + (b - a) * k // (n + 1)) < b and (lo[0], x) > lo} | ({(lo[0], a + 1)} if lo < (lo[0], a + 1) < hi else set()))


def splitters(keys: DataFrame, shards: int, tolerance: float = TOLERANCE, probes: int = PROBES) -> list[tuple[int, int]]:
    """Boundaries (hash, id) of the shards, each within tolerance * bytes / shards of its mark where rows allow it."""
    total, low, high = keys.agg(F.sum("size"), F.min("id"), F.max("id")).first()
    if not total:
        return [(TOP, TOP)] * (shards - 1)
    ids = (int(low), int(high))
    marks = [total * i // shards for i in range(1, shards)]
    slack = tolerance * total / shards
    known = {(LOW, LOW): 0, (TOP, TOP): int(total)}
    first = [(LOW + (1 << 64) * k // (shards * probes), LOW) for k in range(1, shards * probes)]
    while first:
        got, _ = _counted(keys, first)
        known.update(zip(first, got, strict=False))
        order = sorted(known)
        size = [known[k] for k in order]
        first = []
        for m in marks:
            at = int(np.searchsorted(size, m, "left"))
            near = min((k for k in (at - 1, at) if 0 <= k < len(order)), key=lambda k: abs(size[k] - m))
            if abs(size[near] - m) > slack and 0 < at < len(order):
                first += _between(order[at - 1], order[at], ids, probes)
        first = sorted({k for k in first if k not in known})
    out = []
    for m in marks:
        at = int(np.searchsorted(size, m, "left"))
        out.append(order[min((k for k in (at - 1, at) if 0 <= k < len(order)), key=lambda k: abs(size[k] - m))])
    return sorted(out)


def _cell_column(bounds: list[tuple[int, int]]) -> Column:
    bh, bi = (np.array([b[k] for b in bounds], np.int64) for k in (0, 1))

    @F.pandas_udf("long")
    def cell(h: pd.Series, ident: pd.Series) -> pd.Series:
        return pd.Series(cells(h.to_numpy(), ident.to_numpy(), bh, bi).astype(np.int64))

    return cell(F.col("__h"), F.col("__id"))


def _dealt(rows: DataFrame, most: int, count: int) -> DataFrame:
    """Rows of crowded cells with their number inside the cell (__own, from 1): each salt takes the numbers after those of the salts before it."""
    salts = max(1, -(-count // most))
    held = written(rows.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts))))
    part = held.groupBy("__cell", "__salt").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("__cell").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = part.select("__cell", "__salt", before.alias("__before"))
    own = F.row_number().over(Window.partitionBy("__cell", "__salt").orderBy("__h"))
    out = held.withColumn("__own", own).join(start, ["__cell", "__salt"])
    return out.withColumn("__own", (F.col("__own") + F.col("__before")).cast("long")).drop("__before", "__salt")


def shard(df: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text", overhead: int = OVERHEAD, tolerance: float = TOLERANCE) -> DataFrame:
    """Add size, text_crc32, law, shard and slot to every row of df, all whose columns stay.

    The keys alone (24 bytes a row) are kept for the counting rounds; whole rows are exchanged once, by cell.
    """
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    size = (F.when(F.col(f"`{text}`").isNull(), 0).otherwise(F.octet_length(body)) + overhead).cast("long")
    h, ident = F.xxhash64(body), F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(LOW))
    keys = written(df.select(h.alias("h"), ident.alias("id"), size.alias("size")))
    cut = splitters(keys, shards, tolerance)
    # finer boundaries, for cells of bounded size: evenly by hash, and by id within a hash that is still too large
    rows = keys.count()
    most = min(CELL_ROWS, max(LEAST_ROWS, rows // (4 * shards)))
    fine = max(4 * shards, -(-2 * rows // CELL_ROWS))
    bounds = sorted({*cut, *((LOW + (1 << 64) * k // fine, LOW) for k in range(1, fine))})
    weight, below = _counted(keys, bounds)
    low, high = keys.agg(F.min("id"), F.max("id")).first()
    while rows:
        ends = [(LOW, LOW), *bounds, (TOP, TOP)]
        more = [k for i, n in enumerate(np.diff([0, *below]).tolist()) if n > most for k in _between(ends[i], ends[i + 1], (low, high), min(63, 2 * n // most + 1))]
        more = sorted({*more} - {*bounds})
        if not more:
            break
        bounds = sorted({*bounds, *more})
        weight, below = _counted(keys, bounds)
    # rows and bytes before each cell; what is still crowded holds rows that agree in text and doc_id
    first, ahead = ([0, *below[:-1]], [0, *weight[:-1]]) if rows else ([0] * (len(bounds) + 1),) * 2
    count = np.diff([*first, rows])
    crowded = [i for i, n in enumerate(count.tolist()) if n > most]
    starts = [first[bounds.index(c) + 1] for c in cut]
    total = weight[-1] if rows else 0
    for k in range(len(starts)):
        mark = total * (k + 1) // shards
        i = int(np.searchsorted(ahead, mark, "right")) - 1
        if i in crowded and abs(ahead[bounds.index(cut[k]) + 1] - mark) > tolerance * total / shards:
            each = (weight[i] - ahead[i]) / count[i]
            starts[k] = first[i] + round((mark - ahead[i]) / each)
    starts = np.array(sorted(starts), np.int64)
    spark = df.sparkSession
    place = np.searchsorted(starts, first, "right")
    origin = np.concatenate([[0], starts])
    base = without(df, ["size", "text_crc32", "law", "shard", "slot"])
    src = base.select(F.struct(F.lit(0).alias("__"), *[F.col(f"`{c}`") for c in base.columns]).alias("__row"), size.alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"), h.alias("__h"), ident.alias("__id"))
    src = src.withColumn("__cell", _cell_column(bounds))
    columns = [*[F.col("__row").getField(c).alias(c) for c in base.columns], "size", "text_crc32", "law"]
    usual = src.where(~F.col("__cell").isin(crowded)) if crowded else src
    own = F.row_number().over(Window.partitionBy("__cell").orderBy("__h", "__id", "text_crc32", "size"))
    table = spark.createDataFrame(pd.DataFrame({"__c": range(len(first)), "shard": place.astype(np.int32), "__start": np.array(first, np.int64) - origin[place]}))
    # one row for each cell: bounded by rows / CELL_ROWS
    near = F.broadcast(table) if len(first) <= 100_000 else table
    out = usual.withColumn("__own", own).join(near, F.col("__cell") == F.col("__c")).select(*columns, "shard", (F.col("__start") + F.col("__own") - 1).alias("slot"))
    if not crowded:
        return out
    begin = dict(zip(crowded, (int(first[i]) for i in crowded), strict=True))
    at = F.try_element_at(F.create_map(*[F.lit(x) for kv in begin.items() for x in kv]), F.col("__cell").cast("int")) + F.col("__own") - 1

    @F.pandas_udf("int")
    def shard_of(g: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(starts, g.to_numpy(), "right").astype(np.int32))

    many = _dealt(src.where(F.col("__cell").isin(crowded)), most, int(max(count[i] for i in crowded))).withColumn("__at", at.cast("long")).withColumn("shard", shard_of("__at"))
    return out.unionByName(many.select(*columns, "shard", (F.col("__at") - F.element_at(F.array(*[F.lit(int(x)) for x in origin]), F.col("shard") + 1)).alias("slot")))
