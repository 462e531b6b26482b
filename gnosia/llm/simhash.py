"""Operator 4: SimHash near-duplicates through fuzzy hashing with the binary Golay code.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits. In the perfect [23, 12, 7] Golay code each
23-bit word lies within three bits of exactly one codeword, so a segment and its one-bit changes decode to at most six
codewords, and two segments that differ in two bits or fewer share one of them (the word halfway between decodes to
it). Two fingerprints within two bits agree in at least one segment (pigeonhole) and differ by at most two bits in the
next one; so they share a key (which segment, its bits, a codeword number of the next segment). Keys are joined, pairs
are verified by their bits.

Distinct fingerprints are compared, not documents. A bucket of more than BUCKET fingerprints is split by the codewords
of the third segment; what is still larger goes through keys with two bits masked out, of which four fingerprints at
most can share one: exact, and linear in the number of fingerprints.

Results: null and blank texts have fingerprint zero, which links like any other; a null doc_id is never a
representative unless its whole component has none; rows that repeat a doc_id are told apart by their texts; an empty
table gives an empty one. representatives() keeps all columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gnosia.llm.common import hit, map_texts, marks, written
from gnosia.llm.graph import components
from gnosia.llm.textvec import LOWER, U, gather, joined, raw, words, xxh64

#: Generator polynomial of the binary Golay code (a fixed value): x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY = 0b110001110101
#: Bits of the three segments, from the lowest.
SEGMENTS = (22, 21, 21)
#: Fingerprints of one bucket that are compared in one task.
BUCKET = 1024
#: Differing bits up to which fingerprints link; the keys are complete for two.
BITS = 2


def majority(h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The bits set in over half the hashes of each document; count: how many each has, one after the other."""
    # four 16-bit counters in a word: no document part may have more than 65,535 shingles
    ends = np.cumsum(count)
    begin = ends - count
    parts = np.maximum(1, -(-count // 65535))
    doc = np.repeat(np.arange(count.size), parts)
    lo = np.minimum(np.repeat(begin, parts) + 65535 * gather(np.zeros(count.size, np.int64), parts), np.repeat(ends, parts))
    hi = np.minimum(lo + 65535, np.repeat(ends, parts))
    out = np.zeros(count.size, np.uint64)
    total = np.zeros(h.size + 1, np.uint64)
    ones = U(0x0001000100010001)
    for plane in range(16):
        np.cumsum((h >> U(plane)) & ones, out=total[1:])
        packed = total[hi] - total[lo]
        for lane in range(4):
            c = np.zeros(count.size, np.int64)
            np.add.at(c, doc, ((packed >> U(16 * lane)) & U(0xFFFF)).astype(np.int64))
            out |= np.where(2 * c > count, U(1) << U(16 * lane + plane), U(0))
    return out


def simhash(texts: pa.Array, shingle: int = 3) -> np.ndarray:
    """Fingerprints as unsigned 64-bit numbers; see fingerprints()."""
    buf, offs = raw(texts)
    buf = LOWER[buf]
    starts, lens, ptr = words(buf, offs)
    buf, at = joined(buf, starts, lens)
    n = np.diff(ptr)
    count = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
    first = gather(ptr[:-1], count)
    last = first + np.repeat(np.minimum(n, shingle), count) - 1
    h = xxh64(buf, at[first], at[last] + lens[last] - at[first])
    return majority(h, count)


def fingerprints(df: DataFrame, text: str = "text", into: str = "fp", shingle: int = 3, keep: list[str] | None = None) -> DataFrame:
    """Add the SimHash of each whole text (a signed long with the same 64 bits).

    A-Z are lower-cased, words are `[^\\x20\\x09-\\x0D]+`, shingles are of three words, repeats included; fewer words
    are one shingle; without a word the fingerprint is zero. A bit is set if it is in over half of the XXH64 values.
    """
    return map_texts(df, [T.StructField(into, T.LongType())], lambda: lambda texts: {into: simhash(texts, shingle).view(np.int64)}, text, keep)


class Golay:
    """Numbers of the codewords that a segment and its one-bit changes decode to."""

    def __init__(self) -> None:
        def remainder(v: int) -> int:
            for bit in range(22, 10, -1):
                if v >> bit & 1:
                    v ^= GOLAY << (bit - 11)
            return v

        self.part = [np.array([remainder(x << s) for x in range(1 << w)], np.int64) for s, w in ((0, 8), (8, 8), (16, 7))]
        self.error = np.zeros(2048, np.int64)
        for weight in range(4):
            for bits in combinations(range(23), weight):
                e = sum(1 << b for b in bits)
                self.error[remainder(e)] = e

    def number(self, v: np.ndarray) -> np.ndarray:
        a, b, c = self.part
        return (v ^ self.error[a[v & 255] ^ b[v >> 8 & 255] ^ c[v >> 16]]) >> 11

    def numbers(self, v: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, number): the distinct numbers of each value."""
        each = np.sort(self.number(v[:, None] ^ np.array([0, *(1 << b for b in range(bits))], np.int64)), axis=1)
        new = np.ones(each.shape, bool)
        new[:, 1:] = each[:, 1:] != each[:, :-1]
        row, col = np.nonzero(new)
        return row, each[row, col]


def _segments(fp: np.ndarray) -> list[np.ndarray]:
    out, at = [], 0
    for bits in SEGMENTS:
        out.append((fp.view(np.uint64) >> U(at) & U((1 << bits) - 1)).astype(np.int64))
        at += bits
    return out


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    golay = Golay()
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False)
        segs, key, of = _segments(fp), [], []
        for t in range(3):
            row, number = golay.numbers(segs[(t + 1) % 3], SEGMENTS[(t + 1) % 3])
            key.append(t << 34 | segs[t][row] << 12 | number)
            of.append(fp[row])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(key)), pa.array(np.concatenate(of))], names=["key", "fp"])


def _subkeys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the codewords of the third segment to the keys."""
    golay = Golay()
    for batch in batches:
        key, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        segs = _segments(fp)
        for t in range(3):
            mine = np.flatnonzero(key >> 34 == t)
            row, number = golay.numbers(segs[(t + 2) % 3][mine], SEGMENTS[(t + 2) % 3])
            yield pa.RecordBatch.from_arrays([pa.array(key[mine][row] << 12 | number), pa.array(fp[mine][row])], names=["key", "fp"])


def _link(fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges with the components of these few fingerprints."""
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= BITS
    free = np.ones(fps.size, bool)
    for seed in range(fps.size):
        if free[seed]:
            free[seed] = False
            edge = near[seed] & free
            while edge.any():
                ends = np.flatnonzero(edge)
                free[ends] = False
                yield fps[ends], np.full(ends.size, fps[seed])
                edge = near[ends].any(axis=0) & free


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; a bucket may reach over batches."""
    old_key, old_fp = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def run(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        cuts = np.flatnonzero(np.diff(key)) + 1
        us, vs = [], []
        for part in np.split(fp, cuts) if key.size else []:
            if part.size > 1:
                for u, v in _link(part.view(np.uint64)):
                    us.append(u.view(np.int64))
                    vs.append(v.view(np.int64))
        if us:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])

    for batch in batches:
        key = np.concatenate([old_key, batch.column(0).to_numpy(zero_copy_only=False)])
        fp = np.concatenate([old_fp, batch.column(1).to_numpy(zero_copy_only=False)])
        last = int(np.searchsorted(key, key[-1])) if key.size else 0
        yield from run(key[:last], fp[:last])
        old_key, old_fp = key[last:], fp[last:]
    yield from run(old_key, old_fp)


def _masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pairs = list(combinations(range(64), 2))
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for k, (i, j) in enumerate(pairs):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(fp.size, k, np.int32)), pa.array((fp & ~U(1 << i | 1 << j)).view(np.int64)), pa.array(fp.view(np.int64))], names=["mask", "rest", "fp"])


def links(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges (u, v) among distinct fingerprints (column fp) whose components are those of all pairs within two bits."""
    keyed = distinct.select("fp").mapInArrow(_keys, "key long, fp long")
    edges = []
    for refine in (_subkeys, None):
        count = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")).where("n > 1"))
        edges.append(count.where(F.col("n") == 2).where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= BITS).select("u", "v"))
        few = keyed.join(count.where(F.col("n").between(3, bucket)).select("key"), "key", "left_semi").select("key", "fp")
        edges.append(few.repartition("key").sortWithinPartitions("key").mapInArrow(_buckets, "u long, v long"))
        large = count.where(F.col("n") > bucket).select("key")
        if large.isEmpty():
            break
        many = keyed.join(large, "key", "left_semi").select("key", "fp")
        if refine is not None:
            keyed = written(many.mapInArrow(refine, "key long, fp long"))
            continue
        few = many.select("fp").distinct().mapInArrow(_masked, "mask int, rest long, fp long").groupBy("mask", "rest").agg(F.collect_set("fp").alias("all"))
        edges.append(few.where(F.size("all") > 1).select(F.explode("all").alias("u"), F.array_min("all").alias("v")))
    out = edges[0]
    for e in edges[1:]:
        out = out.union(e)
    return out


def grouped(df: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket: int = BUCKET) -> DataFrame:
    """(doc_id, text_hash, fp, component, component_id) for every row; component is a number of the linked texts alone.

    Documents with one fingerprint meet only as a count and a least doc_id; a hot fingerprint is summed before the
    shuffle, and the final join can be split.
    """
    src = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    docs = written(fingerprints(src).select("doc_id", "text_hash", "fp"))
    groups = written(docs.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    parts = written(components(links(groups, bucket)))
    linked = parts.join(groups, parts.node == groups.fp).select("fp", "root", "least")
    top = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    merged = linked.join(top, "root").select("fp", "root", "component_id")
    copies = groups.where("n > 1").join(merged, "fp", "left_anti").select("fp", F.col("fp").alias("root"), F.col("least").alias("component_id"))
    out = docs.join(merged.union(copies), "fp", "left")
    return out.select("doc_id", "text_hash", "fp", F.coalesce("root", "fp").alias("component"), F.coalesce("component_id", "doc_id").alias("component_id"))


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fp, component_id) for every row: component_id is the least doc_id reachable over links."""
    return grouped(df, doc_id, text, bucket).select("doc_id", "fp", "component_id")


def hexadecimal(fp: str) -> F.Column:
    """The 16 lower-case hex digits of a signed long."""
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")


def representatives(df: DataFrame, doc_id: str = "doc_id", text: str = "text", find: Callable[..., DataFrame] = grouped) -> DataFrame:
    """df with one row of each component, all its columns as they were: the least doc_id, nulls last, then the least hash of the text.

    A row is told from others by its doc_id and its text: of rows that share a doc_id but no component each component
    keeps its own. Of rows alike in both the one with the least hash of all columns stays. find: gives (doc_id,
    text_hash, component) for every row, text_hash being XXH64 of the text.
    """
    found = written(find(df, doc_id, text).select("doc_id", "text_hash", "component"))
    own = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    first = found.groupBy("component").agg(F.min(own).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("component", "first")
    many = written(found.join(first, "component").select("doc_id", "text_hash", (own == F.col("first")).alias("stays")).groupBy("doc_id", "text_hash", "stays").agg(F.count(F.lit(1)).alias("n")))
    marked = df.withColumn("__text", F.xxhash64(F.col(f"`{text}`").cast("string")))
    touched = hit(marks(many.where("not stays or n > 1").select(F.xxhash64("doc_id", "text_hash").alias("mark"))), F.xxhash64(F.col(f"`{doc_id}`"), F.col("__text")))
    alone = marked.where(~touched).drop("__text")
    same = [F.col(f"`{doc_id}`").eqNullSafe(F.col("__id")), F.col("__text") == F.col("__hash")]
    gone = many.where("not stays").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    kept = marked.where(touched).join(gone.hint("merge"), same, "left_anti")
    again = many.where("stays and n > 1").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    if again.isEmpty():
        return alone.unionByName(kept.drop("__text"))
    row = F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) for c in df.columns])
    ours = kept.join(again.hint("merge"), same, "left_semi").withColumn("__row", row)
    once = ours.groupBy(F.col(f"`{doc_id}`").alias("__id"), F.col("__text").alias("__hash")).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), "__row").alias("__first"))
    return alone.unionByName(kept.join(again.hint("merge"), same, "left_anti").drop("__text")).unionByName(once.select("__first.*"))
