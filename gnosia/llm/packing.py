"""Operator 10: best-fit packing by large-item matching.

Lengths are whole numbers up to the capacity, so the packing is planned on the histogram of lengths (at most `capacity`
numbers, whatever the number of documents) and then carried out by ranks:

1. Pieces longer than a third of the capacity fit at most twice into a sequence. Greedy matching gives each length, from
   the largest, the largest remaining partner that still fits, many equal pairs at a time.
2. Shorter pieces go, from the largest, into the smallest gap that takes them (best fit); a new sequence is opened only
   when no gap does.

The plan is a list of runs (length, first rank, count, first sequence, pieces per sequence, offset), bounded by the
capacity alone. The rank of a piece among those of its length comes from counts by (length, salt), so that no length
meets in one task.

Results: a null text is the empty text (its end token alone is packed); every piece is placed exactly once; repeated
rows are packed each for itself; an empty table gives an empty table.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gnosia.llm.bpe import broadcast
from gnosia.llm.common import map_texts, written

CAPACITY = 4096
END_TOKEN = 1
#: Pieces of one length in one task, about.
RANKED = 50_000


def pieces(df: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_token: int = END_TOKEN, with_ids: bool = False) -> DataFrame:
    """One row for each piece of each document: doc_id, piece, start, length, ids_crc32 (and ids, if asked for).

    A document is its ids and the end token; only longer ones are cut. ids: little-endian unsigned 32-bit integers.
    """
    shared = broadcast(df, tokenizer)

    def make():
        bpe = shared.value

        def fn(texts: pa.Array) -> dict:
            ids, ends = bpe.encode(texts)
            n, crcs, parts = [], [], []
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                mem = np.append(ids[a:b], end_token).astype("<u4").tobytes()
                cut = [mem[i : i + 4 * capacity] for i in range(0, len(mem), 4 * capacity)]
                n.append(len(mem) // 4)
                crcs.append([zlib.crc32(x) for x in cut])
                parts.append(cut)
            out = {"__n": n, "__crcs": crcs}
            return out | {"__ids": parts} if with_ids else out

        return fn

    fields = [T.StructField("__n", T.LongType()), T.StructField("__crcs", T.ArrayType(T.LongType()))] + [T.StructField("__ids", T.ArrayType(T.BinaryType()))] * with_ids
    src = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    rows = map_texts(src, fields, make, keep=["doc_id"])
    rows = rows.select("*", F.posexplode("__crcs").alias("piece", "ids_crc32"))
    out = rows.select(
        "doc_id", "piece", (F.col("piece").cast("long") * capacity).alias("start"),
        F.least(F.lit(capacity), F.col("__n") - F.col("piece").cast("long") * capacity).cast("long").alias("length"), "ids_crc32",
        *([F.element_at("__ids", F.col("piece") + 1).alias("ids")] if with_ids else []),
    )
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, rank, count, sequence, per, offset): pieces rank .. rank + count - 1 of this length go to
    sequence + i // per, at offset + i % per * length. Work and size depend on the capacity only."""
    left = {n: c for n, c in counts.items() if c > 0}
    used = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> ranges (first sequence, count)
    order: list[int] = []  # the gaps there are
    sequences = 0

    def place(n: int, count: int, first: int, per: int, offset: int) -> None:
        runs.append((n, used[n], count, first, per, offset))
        used[n] += count
        left[n] -= count

    def leave(gap: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in gaps:
                bisect.insort(order, gap)
                gaps[gap] = []
            gaps[gap].append((first, count))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        at = bisect.bisect_right(large, capacity - n) - 1  # the largest partner that fits
        if at < 0:
            count = left[n]
            place(n, count, sequences, 1, 0)
            leave(capacity - n, sequences, count)
            large.pop()
        elif large[at] == n:
            count = left[n]
            place(n, count, sequences, 2, 0)
            leave(capacity - 2 * n, sequences, count // 2)
            leave(capacity - n, sequences + count // 2, count % 2)
            count = (count + 1) // 2
            large.pop()
        else:
            m = large[at]
            count = min(left[n], left[m])
            place(n, count, sequences, 1, 0)
            place(m, count, sequences, 1, n)
            leave(capacity - n - m, sequences, count)
            if not left[n]:
                large.pop()
            if not left[m]:
                del large[at]
        sequences += count
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            at = bisect.bisect_left(order, n)
            if at == len(order):
                per = capacity // n
                count = -(-left[n] // per)
                leave(capacity, sequences, count)
                sequences += count
                continue
            gap = order[at]
            first, count = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], order[at]
            per = gap // n
            full = min(count, left[n] // per)
            offset = capacity - gap
            if full:
                place(n, full * per, first, per, offset)
                leave(gap - per * n, first, full)
            rest = left[n] if full < count else 0
            if rest:  # fewer than per
                place(n, rest, first + full, per, offset)
                leave(gap - rest * n, first + full, 1)
                full += 1
            leave(gap, first + full, count - full)
    return runs


def pack(items: DataFrame, key: list[str], capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset (both long) to items with a column `length` of 1 to capacity.

    key: columns that tell items apart, for ranks that a lost task computes again alike. items are read twice;
    checkpoint them first if they are costly.
    """
    total = items.count()
    salts = max(8, -(-total // RANKED))
    salted = items.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in key]), F.lit(salts)))
    part = written(salted.groupBy("length", "__salt").agg(F.count(F.lit(1)).alias("__n")))
    counts = {int(r[0]): int(r[1]) for r in part.groupBy("length").agg(F.sum("__n")).collect()}
    runs = plan(counts, capacity)
    table = np.array(sorted(runs), np.int64).reshape(-1, 6)
    # ranks of one length follow those of the shorter ones, so that one search finds the run
    sizes = sorted(counts)
    base = dict(zip(sizes, np.cumsum([0, *(counts[n] for n in sizes)]).tolist(), strict=False))
    begin = np.array([base[n] for n in table[:, 0].tolist()], np.int64) + table[:, 1] if len(table) else np.zeros(0, np.int64)
    shared = items.sparkSession.sparkContext.broadcast((begin, table))
    bases = F.create_map(*[F.lit(x) for n in sizes for x in (n, base[n])]) if sizes else None
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = part.select(F.col("length").alias("__l"), F.col("__salt").alias("__s"), before.alias("__before"))
    offsets = offsets.withColumn("__before", F.col("__before") + (F.try_element_at(bases, F.col("__l").cast("int")) if sizes else F.lit(0)))
    own = F.row_number().over(Window.partitionBy("length", "__salt").orderBy(*[F.col(f"`{k}`").asc_nulls_first() for k in key]))
    ranked = salted.withColumn("__own", own).join(offsets, (F.col("length") == F.col("__l")) & (F.col("__salt") == F.col("__s")))
    src = ranked.select(*[F.col(f"`{c}`") for c in items.columns], (F.col("__before") + F.col("__own") - 1).alias("__rank"))
    rest = [c for c in src.columns if c not in ("__rank", "sequence_id", "offset")]
    src = src.select(*[F.col(f"`{c}`") for c in rest], "__rank")
    schema = T.StructType([*src.schema.fields[:-1], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin, table = shared.value
        for batch in batches:
            rank = batch.column(len(rest)).to_numpy(zero_copy_only=False)
            at = np.searchsorted(begin, rank, "right") - 1
            n, _, _, first, per, offset = table[at].T
            i = rank - begin[at]
            cols = [*batch.columns[:-1], pa.array(first + i // per), pa.array(offset + i % per * n)]
            yield pa.RecordBatch.from_arrays(cols, names=[*rest, "sequence_id", "offset"])

    return src.mapInArrow(run, schema)


def pack_documents(df: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_token: int = END_TOKEN) -> DataFrame:
    """Cut and pack all documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    items = written(pieces(df, tokenizer, doc_id, text, capacity, end_token))
    return pack(items, ["doc_id", "piece", "start", "length", "ids_crc32"], capacity)
