"""Operator 2: document fingerprints as bottom-k sketches of shingle hashes.

A sketch holds the K least distinct hashes of a document's shingles of five words (fewer words: one shingle; none: no
hashes). The sketch of a union is the K least of two sketches, so parts can be sketched apart and merged. From the
K least hashes of the union of two sketches follow resemblance, containment and the number of distinct shingles.

Results: a null text is the empty text; two sketches without hashes have likeness one, one of them alone zero; equal
texts have equal sketches; repeated rows are ordered by their text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gnosia.llm.common import SLICE_BYTES, map_texts
from gnosia.llm.textvec import U, gather, mix, raw, words, xxh64

SHINGLE, K = 5, 128
LOW = -(1 << 63)


def sketches(texts: pa.Array, shingle: int = SHINGLE, k: int = K) -> list[np.ndarray]:
    """Sorted arrays of at most k unsigned 64-bit hashes."""
    buf, offs = raw(texts)
    starts, lens, ptr = words(buf, offs)
    n = np.diff(ptr)
    w = xxh64(buf, starts, lens)
    count = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(n.size), count)
    first = gather(ptr[:-1], count)
    size = np.minimum(n, shingle)[doc]
    h = np.zeros(first.size, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(shingle):
            if (size > i).all():
                h = mix(h + w[first + i]) * U(0x9E3779B97F4A7C15)
            else:
                ok = size > i
                h[ok] = mix(h[ok] + w[first[ok] + i]) * U(0x9E3779B97F4A7C15)
        h = mix(h)
    # hashes are uniform: those above a bound that holds the k least for sure need no sorting
    ends = np.cumsum(count)
    share = np.minimum(1.0, (2.0 * k + 60) / np.maximum(count, 1))
    low = h <= (share * float(2**64 - 2**12)).astype(np.uint64)[doc]
    out: list[np.ndarray] = []
    order = np.flatnonzero(low)
    order = order[np.lexsort((h[order], doc[order]))]
    v, d = h[order], doc[order]
    new = np.ones(v.size, bool)
    new[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
    v, d = v[new], d[new]
    cut = np.searchsorted(d, np.arange(n.size + 1))
    for i in range(n.size):
        mine = v[cut[i] : cut[i + 1]][:k]
        if mine.size < k and share[i] < 1:  # many repeats: look at all hashes of this document
            mine = np.unique(h[ends[i] - count[i] : ends[i]])[:k]
        out.append(mine)
    return out


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """Sketch of the union of two documents or parts."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of common shingles among all of both; exact while the union has at most k."""
    if not a.size and not b.size:
        return 1.0
    both = np.concatenate([a, b])
    both.sort()
    again = both[1:] == both[:-1]
    distinct = both.size - int(again.sum())
    if distinct <= k:
        return float(again.sum()) / distinct
    rank = np.cumsum(np.concatenate([[True], ~again]))
    last = int(np.searchsorted(rank, k, "right"))
    return float(again[: last - 1].sum()) / k


def distinct_count(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(a.size) if a.size < k else (k - 1) / (float(a[-1]) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has too."""
    if not a.size:
        return 1.0
    r = resemblance(a, b, k)
    common = r / (1 + r) * (distinct_count(a, k) + distinct_count(b, k))
    return min(1.0, common / distinct_count(a, k))


def as_string(sketch: np.ndarray) -> str:
    """Base64 of the hashes as big-endian 64-bit numbers, in order."""
    return base64.b64encode(sketch.astype(">u8").tobytes()).decode()


def from_string(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), ">u8").astype(np.uint64)


def fingerprint(df: DataFrame, text: str = "text", shingle: int = SHINGLE, k: int = K) -> DataFrame:
    """Add fingerprint and n_shingles (estimated) to every row. No shuffle."""

    def fn(texts: pa.Array) -> dict:
        s = sketches(texts, shingle, k)
        return {"fingerprint": [as_string(x) for x in s], "n_shingles": [distinct_count(x, k) for x in s]}

    return map_texts(df, [T.StructField("fingerprint", T.StringType()), T.StructField("n_shingles", T.DoubleType())], lambda: fn, text)


def _compare(rows: list[tuple[int | None, str]], after: str, shingle: int, k: int) -> list[tuple]:
    """Results of consecutive rows (doc_id, text); `after` is the text after the last."""
    texts = [t for _, t in rows]
    nxt = [*texts[1:], after]
    edited = [t[: len(t) - len(t) // 3] + n[: len(t) // 3] for t, n in zip(texts, nxt, strict=True)]
    own = sketches(pa.array([*texts, after], pa.string()), shingle, k)
    new = sketches(pa.array(edited, pa.string()), shingle, k)
    return [
        (i, len(t), hashlib.sha256(e.encode()).hexdigest(), as_string(own[j]), as_string(new[j]), resemblance(own[j], new[j], k), resemblance(own[j], own[j + 1], k))
        for j, ((i, t), e) in enumerate(zip(rows, edited, strict=True))
    ]


def compare_with_next(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, k: int = K, parts: int | None = None) -> DataFrame:
    """Fingerprint each text, its edited text and the next document, in descending doc_id (after the last: the first).

    The edited text has its last third (of code points, rounded down) replaced by the first as many of the next text.
    Texts are exchanged once: into ranges of doc_id, bounds of which come from the ids alone; the first row of each
    range is also sent to the range before it. Each task streams over its sorted rows.
    """
    spark = df.sparkSession
    src = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    parts = parts or 3 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    ids = src.select(F.coalesce("doc_id", F.lit(LOW)).alias("id"))
    marks = ids.agg(F.percentile_approx("id", [i / parts for i in range(1, parts)], 20 * parts)).first()[0] if parts > 1 else []
    bounds = np.array(sorted({*(marks or [])}), np.int64)

    @F.pandas_udf("int")
    def part(ident: pd.Series) -> pd.Series:
        return pd.Series((len(bounds) - np.searchsorted(bounds, ident.to_numpy(), "left")).astype(np.int32))

    # one row for each range: the greatest id comes first
    firsts = {r[0]: r[1] for r in ids.groupBy(part("id").alias("p")).agg(F.max("id")).collect()}
    if not firsts:
        return spark.createDataFrame([], schema)
    order = sorted(firsts)
    before = {firsts[p]: order[i - 1] for i, p in enumerate(order)}  # the range whose last row this id follows
    heads = F.create_map(*[F.lit(x) for kv in before.items() for x in (int(kv[0]), int(kv[1]))])
    ident = F.coalesce(F.col("doc_id"), F.lit(LOW))
    rows = src.withColumn("__p", part(ident)).withColumn("__to", F.try_element_at(heads, ident))
    rows = rows.select("doc_id", "text", "__p", F.explode(F.when(F.col("__to").isNull(), F.array("__p")).otherwise(F.array(F.col("__p"), F.lit(-1) - F.col("__to")))).alias("__q"))
    rows = rows.select((F.when(F.col("__q") < 0, F.lit(-1) - F.col("__q")).otherwise(F.col("__q"))).alias("__p"), (F.col("__q") < 0).alias("__ahead"), "doc_id", "text")
    rows = rows.repartition("__p").sortWithinPartitions("__p", "__ahead", F.col("doc_id").desc_nulls_last(), F.col("text").desc())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, str]] = []
        size, now, got_ahead = 0, None, False

        def result(done: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*done, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        for batch in batches:
            for p, ahead, i, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != now:
                    now, got_ahead = p, False
                if got_ahead:  # rows that repeat the next range's first id
                    continue
                if ahead:
                    if held:
                        yield result(_compare(held, t, shingle, k))
                    held, size, got_ahead = [], 0, True
                    continue
                if size > SLICE_BYTES:
                    yield result(_compare(held, t, shingle, k))
                    held, size = [], 0
                held.append((i, t))
                size += len(t)

    return rows.mapInArrow(run, schema)

