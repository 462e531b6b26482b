"""Operator 8: URL filters over a sorted array of 64-bit digests.

A rule list becomes three arrays: sorted XXH64 keys of the rules, their offsets, and the rule strings. They are written
to a file that each Python worker maps into memory; candidates of a whole batch (each parent host of a URL joined with
each path prefix whose length some rule has) are probed by one vectorised binary search, and every hit is confirmed
against the stored string, so a colliding digest decides nothing.

Results: a null URL or one without `://` has an empty host and path, and no rule; the longest fitting rule wins, of two
equally long ones the one with the longer host; a rule listed twice counts with its last verdict; without a rule the
verdict is `allow`.
"""

from __future__ import annotations

import mmap
import os
import struct
import tempfile
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gnosia.llm.textvec import gather, xxh64

#: Bytes of the array that a broadcast carries; a larger one is sent as a file to each executor.
BROADCAST_BYTES = 64 << 20
_HEAD = struct.Struct("<4q")


def build(rules: Iterable[tuple[str, str]]) -> bytes:
    """The array of (host + path, verdict) rules: a head, keys, offsets, verdicts, path lengths, strings."""
    table = {r.encode(): v for r, v in rules}
    names = list(table)
    lens = np.fromiter(map(len, names), np.int64, len(names))
    text = b"".join(names)
    keys = xxh64(np.frombuffer(text, np.uint8), np.cumsum(lens) - lens, lens)
    order = np.argsort(keys, kind="stable")
    offsets = np.concatenate([[0], np.cumsum(lens[order])]).astype("<i8")
    verdicts = np.array([table[names[i]] == "allow" for i in order], np.uint8)
    paths = np.unique([len(n) - n.index(b"/") for n in names]).astype("<i8") if names else np.zeros(0, "<i8")
    body = [keys[order].astype("<u8").tobytes(), offsets.tobytes(), paths.tobytes(), verdicts.tobytes(), b"".join(names[i] for i in order)]
    return _HEAD.pack(len(names), len(paths), len(text), 0) + b"".join(body)


class Digests:
    """The mapped array; probe() is a binary search over all candidates at once."""

    def __init__(self, memory: mmap.mmap | bytes) -> None:
        n, p, size, _ = _HEAD.unpack_from(memory)
        at = _HEAD.size
        self.keys = np.frombuffer(memory, "<u8", n, at)
        self.offsets = np.frombuffer(memory, "<i8", n + 1, at + 8 * n)
        self.paths = np.frombuffer(memory, "<i8", p, at := at + 16 * n + 8)
        self.allow = np.frombuffer(memory, np.uint8, n, at := at + 8 * p)
        self.text = np.frombuffer(memory, np.uint8, size, at + n)

    def probe(self, buf: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Number of the rule equal to each span, or -1."""
        out = np.full(starts.size, -1, np.int64)
        if not self.keys.size or not starts.size:
            return out
        key = xxh64(buf, starts, lens)
        lo, hi = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
        live = np.flatnonzero(lo < hi)
        while live.size:  # more than one round only where digests of rules collide
            rule = lo[live]
            same = self.offsets[rule + 1] - self.offsets[rule] == lens[live]
            at = np.flatnonzero(same)
            size = lens[live[at]]
            equal = buf[gather(starts[live[at]], size)] == self.text[gather(self.offsets[rule[at]], size)]
            same[at] = np.add.reduceat(np.concatenate([equal, [True]]).astype(np.int64), np.cumsum(size) - size)[: at.size] >= size if at.size else same[at]
            out[live[same]] = rule[same]
            lo[live] += 1
            live = live[~same & (lo[live] < hi[live])]
        return out


@lru_cache(4)
def _mapped(path: str) -> Digests:
    with open(path, "rb") as f:
        return Digests(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))


@lru_cache(4)
def _mapped_copy(digest: bytes, number: int) -> Digests:
    """Write the broadcast array to a file of this worker, map it and take its name away again."""
    fd, path = tempfile.mkstemp(prefix="digests-")
    try:
        os.write(fd, digest)
        return Digests(mmap.mmap(fd, 0, access=mmap.ACCESS_READ))
    finally:
        os.close(fd)
        os.unlink(path)


def url_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Add host (after the first `://`, A-Z lower-cased) and path (up to `?`, `#` or the end)."""
    text = F.coalesce(F.col(f"`{url}`").cast("string"), F.lit(""))
    at = F.locate("://", text)
    rest = F.when(at > 0, F.substr(text, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    base = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in ("host", "path")])
    return base.withColumns({"host": F.translate(host, upper, lower), "path": F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)})


def match(digests: Digests, hosts: Sequence[str], paths: Sequence[str]) -> np.ndarray:
    """Number of the rule that decides each (host, path), or -1."""
    host = [h.encode() for h in hosts]
    path = [p.encode() for p in paths]
    mem = b"".join(x for pair in zip(host, path, strict=True) for x in pair)
    buf = np.frombuffer(mem, np.uint8)
    hl, pl = (np.fromiter(map(len, x), np.int64, len(x)) for x in (host, path))
    begin = np.cumsum(hl + pl) - hl - pl
    # a parent host begins at the host's start or after a dot
    inner = np.repeat(np.arange(len(host)), hl)
    pos = gather(begin, hl)
    dot = buf[pos] == 0x2E if pos.size else np.zeros(0, bool)
    # longest host first, for each URL
    start = np.concatenate([begin[hl > 0], pos[dot] + 1])
    of = np.concatenate([np.flatnonzero(hl > 0), inner[dot]])
    best, size = np.full(len(host), -1, np.int64), np.zeros(len(host), np.int64)
    best_host = np.zeros(len(host), np.int64)
    for length in digests.paths.tolist():
        ok = pl[of] >= length
        row, at = of[ok], start[ok]
        span = begin[row] + hl[row] - at + length
        hit = digests.probe(buf, at, span)
        for k in np.flatnonzero(hit >= 0).tolist():
            r, n, h = int(row[k]), int(span[k]), int(span[k]) - length
            if (n, h) > (int(size[r]), int(best_host[r])):
                best[r], size[r], best_host[r] = hit[k], n, h
    return best


def filter_urls(df: DataFrame, rules: Iterable[tuple[str, str]] | None = None, array: str | None = None, url: str = "url") -> DataFrame:
    """Add host, path, rule and verdict to every row.

    rules: (host + path, `allow` or `block`) pairs; or array: path of a file with build()'s bytes, sent to each executor
    by Spark. No shuffle.
    """
    spark = df.sparkSession
    src = url_parts(df, url)
    rest = [c for c in src.columns if c.lower() not in ("rule", "verdict")]
    fields = [T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())]
    small = name = None
    if array is None:
        blob = build(rules or [])
        if len(blob) <= BROADCAST_BYTES:
            small = spark.sparkContext.broadcast(blob)
        else:
            with tempfile.NamedTemporaryFile(prefix="rules-", suffix=".digests", delete=False) as f:  # on the driver; addFile serves it
                f.write(blob)
            array = f.name
    if array is not None:
        spark.sparkContext.addFile(array)
        name = os.path.basename(array)
    hi, pi = rest.index("host"), rest.index("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = _mapped(SparkFiles.get(name)) if small is None else _mapped_copy(small.value, 0)
        for batch in batches:
            found = match(digests, batch.column(hi).to_pylist(), batch.column(pi).to_pylist())
            text = [digests.text[digests.offsets[r] : digests.offsets[r + 1]].tobytes().decode() if r >= 0 else None for r in found.tolist()]
            verdict = ["allow" if r < 0 or digests.allow[r] else "block" for r in found.tolist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string()), pa.array(verdict, pa.string())], names=[*batch.schema.names, "rule", "verdict"])

    out = src.select(*[F.col(f"`{c}`") for c in rest])
    return out.mapInArrow(run, T.StructType([*out.schema.fields, *fields]))
