"""Near-duplicates by SimHash and Golay keys, verified by the exact likeness of word shingles: the pipeline's stage of operator 4.

A document is the set of its shingles of five words (A-Z lower-cased; fewer words are one shingle; none: the empty set).
Two documents link if their sets have a Jaccard likeness of LIKENESS or more; equal sets are one node.

Operator 4's keys are complete for two bits of 64, which only near-identical texts keep. Here each set has a SimHash of
256 bits, of which sets of a likeness of 0.8 differ in 39 on average. It is cut into SEGMENTS words of the Golay code;
keys are a segment's number and a codeword that the segment or a one-bit change of it decodes to. Two such segments
share a codeword in 0.60 of cases, so all but 4 in 100,000 pairs of just 0.8 share a key (of texts of under ten words,
whose votes are often tied, all but 1 in 1,000), of more alike ones fewer are missed. The fingerprints of a key are
compared, and those within BITS link. There is no cut on the size of a key; as there are 45,056 keys, the comparisons grow
with the square of the nodes: each node meets 8 in 100 of the others, at about a nanosecond each.

Components of these links are what the exact check takes: within one, all nodes are compared on their whole sets, so
nothing links by chance, and a link between texts of one component is found whether or not they share a key. First every
node is compared with a pivot: the node nearest to the majority of the component's bits, which is the original of many
copies. What is then in one component is not compared again. The others are compared in pairs where they are few; where
they are many, the nodes of each pivot are dealt to blocks of about BLOCK, and pairs of blocks are compared in one task
each, so that no pair of nodes is ever a row.

Results: null and blank texts have the empty set and are alike; rows without a doc_id take part by their texts; rows
that repeat a doc_id are told apart by their texts; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gnosia.llm.common import hit, map_texts, marks, written
from gnosia.llm.graph import components
from gnosia.llm.simhash import Golay, majority
from gnosia.llm.textvec import LOWER, U, gather, mix, raw, words, xxh64

#: Words of a shingle; least likeness of a link, in per cent.
SHINGLE, LIKENESS = 5, 80
#: 64-bit words of a fingerprint, its 23-bit segments; the columns of the words.
WORDS, SEGMENTS = 4, 11
FP = [f"f{k}" for k in range(WORDS)]
#: Differing bits up to which fingerprints link, and of their first words (a pair of 0.8 passes either but for 5 in a million).
BITS, FIRST = 68, 24
#: Fingerprints compared at once with how many others of their key; links of one from which its component is searched on its own.
STEP, WIDE, DENSE = 256, 8192, 64
#: Nodes of one key that are compared in pairs; nodes of a block, about.
BUCKET, BLOCK = 64, 1024
_GOLDEN = U(0x9E3779B97F4A7C15)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct 64-bit hashes of the shingles of each document, the first of each and the end)."""
    buf, offs = raw(texts)
    buf = LOWER[buf]
    starts, lens, ptr = words(buf, offs)
    n = np.diff(ptr)
    w = xxh64(buf, starts, lens)
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(n.size), count)
    first = gather(ptr[:-1], count)
    size = np.minimum(n, SHINGLE)[doc]
    h = np.zeros(first.size, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(SHINGLE):
            ok = size > i
            h[ok] = mix(h[ok] + w[first[ok] + i]) * _GOLDEN
    h = mix(h)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(h.size, bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.searchsorted(doc[new], np.arange(n.size + 1))


def digests(h: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """A number of each set: equal sets have equal ones, the empty set has zero."""
    out = np.zeros(ptr.size - 1, np.uint64)
    some = np.flatnonzero(np.diff(ptr))
    if some.size:
        with np.errstate(over="ignore"):
            out[some] = mix(np.add.reduceat(mix(h ^ _GOLDEN), ptr[some]))
    return out.view(np.int64)


def fingerprints(h: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """The SimHash of each set: WORDS rows of unsigned 64-bit numbers, the lowest bits first."""
    return np.array([majority(mix(h ^ mix(np.array([k + 1], np.uint64))), np.diff(ptr)) for k in range(WORDS)])


def segment(fp: np.ndarray, t: int) -> np.ndarray:
    """Bits 23 t to 23 t + 22 of each fingerprint."""
    word, at = divmod(23 * t, 64)
    low = fp[word] >> U(at)
    if at > 41:
        low = low | fp[word + 1] << U(64 - at)
    return (low & U((1 << 23) - 1)).astype(np.int64)


def _signatures(df: DataFrame) -> DataFrame:
    """(doc_id, text_hash, node, the words of the fingerprint)."""

    def fn(texts: pa.Array) -> dict:
        h, ptr = shingles(texts)
        return {"node": digests(h, ptr)} | dict(zip(FP, fingerprints(h, ptr).view(np.int64)))

    return map_texts(df, [T.StructField(c, T.LongType()) for c in ["node", *FP]], lambda: fn, "text", ["doc_id", "text_hash"])


def _words(batch: pa.RecordBatch, first: int) -> np.ndarray:
    return np.array([batch.column(first + k).to_numpy(zero_copy_only=False) for k in range(WORDS)]).view(np.uint64)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, fingerprint): one row for each key of each."""
    golay = Golay()
    for batch in batches:
        fp = _words(batch, 1)
        for t in range(SEGMENTS):
            row, number = golay.numbers(segment(fp, t), 23)
            yield pa.RecordBatch.from_arrays([pa.array((t << 12 | number).astype(np.int32)), *(c.take(pa.array(row)) for c in batch.columns)], names=["key", "node", *FP])


def _within(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): the pairs of a fingerprint of a and one of b that link."""
    out = []
    for at in range(0, b.shape[1], WIDE):
        part = b[:, at : at + WIDE]
        i, j = np.nonzero(np.bitwise_count(a[0][:, None] ^ part[0]) <= FIRST)
        near = np.bitwise_count(a[:, i] ^ part[:, j]).sum(axis=0, dtype=np.int64) <= BITS
        out.append((i[near], j[near] + at))
    return np.concatenate([i for i, _ in out] or [np.zeros(0, np.int64)]), np.concatenate([j for _, j in out] or [np.zeros(0, np.int64)])


def _reached(fp: np.ndarray, seed: int, pool: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges that span the component of `seed` in `pool`; each of its other members is once the second end."""
    pool, front = pool[pool != seed], np.array([seed])
    while front.size:
        found = []
        for at in range(0, front.size, STEP):
            part = front[at : at + STEP]
            i, j = _within(fp[:, part], fp[:, pool])
            j, first = np.unique(j, return_index=True)
            if j.size:
                yield part[i[first]], pool[j]
                found.append(pool[j])
                pool = np.delete(pool, j)
        front = np.concatenate(found) if found else np.zeros(0, np.int64)


def linked(fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges (positions) whose components are those of all pairs of these fingerprints that link."""
    free, at = np.arange(fp.shape[1]), 0
    while at < free.size:
        rows, rest = free[at : at + STEP], free[at:]
        i, j = _within(fp[:, rows], fp[:, rest])
        i, j = i[i < j], j[i < j]
        each = np.bincount(i, minlength=1)
        if each.max() <= DENSE:
            if i.size:
                yield rows[i], rest[j]
            at += STEP
            continue
        gone = [np.array([rows[each.argmax()]])]
        for u, v in _reached(fp, int(gone[0][0]), free):
            gone.append(v)
            yield u, v
        stays = ~np.isin(free, np.concatenate(gone))
        at, free = int(np.count_nonzero(stays[:at])), free[stays]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(key, nodes, fingerprints) of each key; rows (key, node, fingerprint) come sorted by key."""
    now, held = None, []
    whole = lambda: (now, np.concatenate([n for n, _ in held]), np.concatenate([f for _, f in held], axis=1))
    for batch in batches:
        key, node = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        fp = _words(batch, 2)
        cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), key.size]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if held and key[a] != now:
                yield whole()
                held = []
            now = int(key[a])
            held.append((node[a:b], fp[:, a:b]))
    if held:
        yield whole()


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the fingerprints of each key."""
    for _, node, fp in _runs(batches):
        for u, v in linked(fp):
            yield pa.RecordBatch.from_arrays([pa.array(node[u]), pa.array(node[v])], names=["u", "v"])


def _centres(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The majority of the bits of each key's fingerprints."""
    for key, _, fp in _runs(batches):
        n = np.array([fp.shape[1]])
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), *(pa.array(majority(f, n).view(np.int64)) for f in fp)], names=["key", *FP])


def candidates(groups: DataFrame) -> DataFrame:
    """(key, node, rank) of every node whose fingerprint links to another's: key is its component's number, rank is greatest for the pivot.

    groups: (node, the words of the fingerprint), distinct.
    """
    keyed = groups.where("node <> 0").select("node", *FP).mapInArrow(_keys, ", ".join(["key int", "node long", *(f"{c} long" for c in FP)]))
    near = keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_near, "u long, v long")
    members = written(components(near).withColumnRenamed("root", "key").join(groups.select("node", *FP).hint("merge"), "node").select("key", "node", *FP))
    centres = members.repartition("key").sortWithinPartitions("key").mapInArrow(_centres, ", ".join(["key long", *(f"{c} long" for c in FP)]))
    apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"c_{c}"))) for c in FP), F.lit(0))
    return written(members.join(centres.select("key", *(F.col(c).alias(f"c_{c}") for c in FP)).hint("merge"), "key").select("key", "node", (-apart).alias("rank")))


def _sets(df: DataFrame) -> DataFrame:
    """(node, hashes as bytes), one row for each node."""

    def fn(texts: pa.Array) -> dict:
        h, ptr = shingles(texts)
        return {"node": digests(h, ptr), "hashes": pa.array([h[a:b].tobytes() for a, b in zip(ptr, ptr[1:])], pa.binary())}

    return map_texts(df, [T.StructField("node", T.LongType()), T.StructField("hashes", T.BinaryType())], lambda: fn, "text", []).dropDuplicates(["node"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        common, every = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
        for i, (a, b) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
            a, b = (np.frombuffer(x.as_buffer(), np.uint64) for x in (a, b))
            both = np.concatenate([a, b])
            both.sort(kind="stable")
            common[i] = np.count_nonzero(both[1:] == both[:-1])
            every[i] = both.size - common[i]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(common), pa.array(every)], names=["u", "v", "common", "every"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) of nodes that link."""
    a = sets.select(F.col("node").alias("u"), F.col("hashes").alias("a"))
    b = sets.select(F.col("node").alias("v"), F.col("hashes").alias("b"))
    scored = pairs.join(a.hint("merge"), "u").join(b.hint("merge"), "v").select("u", "v", "a", "b").mapInArrow(_compared, "u long, v long, common long, every long")
    return written(scored.where(100 * F.col("common") >= LIKENESS * F.col("every")).select("u", "v"))


class _Block:
    """Nodes of one block, by shingle."""

    def __init__(self, rows: list[tuple[int, int, np.ndarray]]) -> None:
        self.node, self.root = (np.array([r[k] for r in rows], np.int64) for k in (0, 1))
        self.size = np.array([r[2].size for r in rows], np.int64)
        flat = np.concatenate([r[2] for r in rows])
        order = np.argsort(flat, kind="stable")
        self.hashes, self.owner = flat[order], np.repeat(np.arange(len(rows)), self.size)[order]

    def alike(self, root: int, hashes: np.ndarray, most: int) -> np.ndarray:
        """Of the first `most` nodes one of each other component that links to this set."""
        lo, hi = np.searchsorted(self.hashes, hashes, "left"), np.searchsorted(self.hashes, hashes, "right")
        common = np.bincount(self.owner[gather(lo, hi - lo)], minlength=self.node.size)[:most]
        hit = np.flatnonzero((100 * common >= LIKENESS * (self.size[:most] + hashes.size - common)) & (self.root[:most] != root))
        return self.node[hit[np.unique(self.root[hit], return_index=True)[1]]]


def _compare_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (x, y, side, node, root, hashes) in order of x, y, side: the links between block x and block y, of which x = y has one side."""
    now, rows, block = None, [], None

    def links_of(found: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        u = np.repeat(np.array([f[0] for f in found], np.int64), [f[1].size for f in found])
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(np.concatenate([f[1] for f in found]))], names=["u", "v"])

    def inner() -> list[tuple[int, np.ndarray]]:
        whole = _Block(rows) if rows else None
        return [(n, whole.alike(root, h, i)) for i, (n, root, h) in enumerate(rows) if i]

    for batch in batches:
        found = []
        x, y, side, node, root = (batch.column(i).to_pylist() for i in range(5))
        for i, blob in enumerate(batch.column(5)):
            if (x[i], y[i]) != now:
                if now is not None and now[0] == now[1]:
                    found += inner()
                now, rows, block = (x[i], y[i]), [], None
            h = np.frombuffer(blob.as_buffer(), np.uint64)
            if side[i] == 0:
                rows.append((node[i], root[i], h))
            elif rows:
                block = block or _Block(rows)
                found.append((node[i], block.alike(root[i], h, block.node.size)))
        if found:
            yield links_of(found)
    if now is not None and now[0] == now[1] and (found := inner()):
        yield links_of(found)


def _in_blocks(many: DataFrame, sets: DataFrame, size: int) -> DataFrame:
    """Links between all nodes of each key, with different roots. many: (key, node, root, n, pivot)."""
    own = written(many.groupBy("node").agg(F.max(F.struct("n", "pivot"))["pivot"].alias("pivot"), F.first("root").alias("root")))
    counts = own.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"))
    own = written(own.join(counts.hint("merge"), "pivot").select("node", "root", F.xxhash64("pivot", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / size))).alias("block")))
    touched = written(many.join(own.select("node", "block").hint("merge"), "node").select("key", "block").distinct())
    both = touched.select("key", F.col("block").alias("x")).join(touched.select("key", F.col("block").alias("y")), "key").where("x <= y").select("x", "y").distinct()
    sides = both.select("x", "y", F.lit(0).alias("side"), F.col("x").alias("block")).union(both.where("x < y").select("x", "y", F.lit(1), "y"))
    members = own.join(sets.hint("merge"), "node").select("block", "node", "root", "hashes")
    rows = sides.join(members.hint("merge"), "block").select("x", "y", "side", "node", "root", "hashes")
    return written(rows.repartition("x", "y").sortWithinPartitions("x", "y", "side").mapInArrow(_compare_blocks, "u long, v long"))


def links(keyed: DataFrame, sets: DataFrame, bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """Edges (u, v) whose components are those of all pairs that share a key and are alike.

    keyed: (key, node, rank), each node once; sets: (node, hashes).
    """
    pivots = written(keyed.groupBy("key").agg(F.max_by("node", F.struct("rank", "node")).alias("pivot")))
    met = keyed.select("key", "node").join(pivots.hint("merge"), "key").where("node <> pivot")
    edges = _verified(met.select(F.least("node", "pivot").alias("u"), F.greatest("node", "pivot").alias("v")), sets)
    roots = components(edges)
    left = keyed.select("key", "node").join(pivots.select("key", F.col("pivot").alias("node")).hint("merge"), ["key", "node"], "left_anti")
    left = written(left.join(roots.hint("merge"), "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")))
    apart = left.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count(F.lit(1)).alias("n")).where("a < b").select("key", "n")
    left = written(left.join(apart.hint("merge"), "key"))
    few = left.where(F.col("n") <= bucket)
    pairs = few.select("key", F.col("node").alias("u"), F.col("root").alias("ru")).join(few.select("key", F.col("node").alias("v"), F.col("root").alias("rv")), "key").where("u < v and ru <> rv").select("u", "v").distinct()
    edges = edges.union(_verified(pairs, sets))
    many = left.where(F.col("n") > bucket).join(pivots.hint("merge"), "key")
    return edges if many.isEmpty() else edges.union(_in_blocks(many, sets, block))


def grouped(df: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """(doc_id, text_hash, component, component_id) for every row; component is a number of the linked texts alone."""
    src = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    docs = written(_signatures(src))
    # first: one row of each node, whose text gives the node's set
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("first")
    groups = written(docs.groupBy("node").agg(F.min("doc_id").alias("least"), first, F.count(F.lit(1)).alias("n"), *(F.any_value(c).alias(c) for c in FP)))
    keyed = candidates(groups)
    nodes = keyed.select("node").join(groups.hint("merge"), "node")
    wanted = written(nodes.select(F.col("first.doc_id").alias("__id"), F.col("first.text_hash").alias("__hash")))
    near = src.where(hit(marks(wanted.select(F.xxhash64("__id", "__hash").alias("mark"))), F.xxhash64("doc_id", "text_hash")))
    sets = written(_sets(near.join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash")), "left_semi")))
    parts = written(components(links(keyed, sets, bucket, block)))
    linked = parts.join(groups.hint("merge"), "node").select("node", "root", "least")
    top = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    merged = linked.join(top.hint("merge"), "root").select("node", "root", "component_id")
    copies = groups.where("n > 1").join(merged, "node", "left_anti").select("node", F.col("node").alias("root"), F.col("least").alias("component_id"))
    out = docs.join(merged.union(copies).hint("merge"), "node", "left")
    return out.select("doc_id", "text_hash", F.coalesce("root", "node").alias("component"), F.coalesce("component_id", "doc_id").alias("component_id"))


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """(doc_id, component_id) for every row: component_id is the least doc_id reachable over links."""
    return grouped(df, doc_id, text, bucket, block).select("doc_id", "component_id")
