"""Operator 5: quality rules by a hashed n-gram log-likelihood ratio.

Byte n-grams of every document are hashed into BUCKETS buckets. Two multinomials are counted: the trusted target (a
bounded, deterministic sample of labelled good documents, see trusted()) and the raw corpus (all documents). The score of
a document is the mean over its n-grams of log(target / raw); a document is kept if the score reaches a fixed
documents. Weights are whole numbers (millionths of a nat), so sums do not depend on order.

With a column of languages both multinomials are those of the document's own language, so a language that is labelled
less often than others loses nothing by that. The target is then smoothed by the raw corpus of the language: the fewer
trusted documents, the nearer all scores are to zero; in a language without any only the base rules decide. The score is that of the language or of all languages together,
whichever is greater, so that a document with a wrong language is not lost.

Results: null and blank texts have no words and fail the base rules; a text shorter than an n-gram scores zero; without
trusted documents all weights are zero, and only the base rules decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gnosia.llm.common import as_text, cut, map_texts, release, written
from gnosia.llm.textvec import U, mix, raw, sums, words, xxh64

#: Hash buckets of the multinomials, bytes of an n-gram.
BITS, GRAM = 15, 4
BUCKETS = 1 << BITS
#: Labelled documents that the target is counted on, at most.
TRUSTED = 20_000
#: Languages that a task counts at once; more are passed on in parts.
MOST_COUNTED = 64
#: Stands for all languages together.
POOLED = "\0"
#: Mean log-likelihood ratio, in nats for each n-gram, that a kept document reaches.
THRESHOLD = -0.3
#: The base rules: least words, and most words (per cent) in three-word windows that occur again.
MIN_WORDS, MAX_REPEAT = 50, 50
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"[#*$%&|<>]"[1:-1])] = True


def grams(buf: np.ndarray, offs: np.ndarray, size: int = GRAM, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each n-gram inside a document, the first n-gram of each document and the end). size: up to 4 bytes."""
    data = np.concatenate([buf, np.zeros(4, np.uint8)])
    lane = np.ndarray((buf.size,), "<u4", data, strides=(1,)) & np.uint32((1 << 8 * size) - 1)
    n = np.maximum(np.diff(offs) - size + 1, 0)
    inside = np.ones(buf.size, bool)
    for k in range(1, size):
        back = offs[1:] - k
        inside[back[back >= offs[:-1]]] = False
    with np.errstate(over="ignore"):
        bucket = (lane[inside] * np.uint32(2654435761)) >> np.uint32(32 - bits)
    return bucket.astype(np.int64), np.concatenate([[0], np.cumsum(n)])


def repeated(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray, ptr: np.ndarray, window: int = 3) -> np.ndarray:
    """Words of each document in windows of words that occur twice or more in it."""
    n = np.diff(ptr)
    doc = np.repeat(np.arange(n.size), n)
    covered = np.zeros(starts.size, bool)
    if starts.size >= window:
        w = xxh64(buf, starts, lens)
        with np.errstate(over="ignore"):
            key = mix(doc.astype(np.uint64) + U(1))[: starts.size - window + 1]
            for k in range(window):
                key = mix(key * U(31) + w[k : starts.size - window + 1 + k])
        at = np.flatnonzero(doc[window - 1 :] == doc[: starts.size - window + 1])
        order = at[np.argsort(key[at], kind="stable")]
        same = key[order[1:]] == key[order[:-1]]
        again = np.zeros(order.size, bool)
        again[1:] |= same
        again[:-1] |= same
        for k in range(window):
            covered[order[again] + k] = True
    return sums(covered, ptr)


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def trusted(labels: DataFrame, most: int = TRUSTED) -> list[int]:
    """Ids of at most `most` documents labelled good and not toxic: those with the least hashes."""
    good = labels.where("quality = 1 and toxic = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"))
    return sorted({r[0] for r in good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()})


def weights(df: DataFrame, good: list[int], doc_id: str = "doc_id", text: str = "text") -> np.ndarray:
    """Millionths of a nat by bucket. One pass over all texts; each task sums its own part before the shuffle."""
    ids = np.array(good, np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            texts, ident = as_text(batch.column(1)), batch.column(0)
            hit = np.isin(ident.fill_null(0).to_numpy(zero_copy_only=False), ids) & ident.is_valid().to_numpy(zero_copy_only=False)
            for at, n in cut(texts):
                bucket, ptr = grams(*raw(texts.slice(at, n)))
                total += np.bincount(bucket, minlength=BUCKETS)
                mine = np.repeat(hit[at : at + n], np.diff(ptr))
                if mine.any():
                    target += np.bincount(bucket[mine], minlength=BUCKETS)
        some = np.flatnonzero(total)
        release()
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some]), pa.array(target[some])], names=["bucket", "n", "good"])

    src = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    rows = src.mapInArrow(count, "bucket long, n long, good long").groupBy("bucket").agg(F.sum("n"), F.sum("good")).collect()
    total, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for b, n, g in rows:
        total[b], target[b] = n, g
    if not target.any():
        return np.zeros(BUCKETS, np.int64)
    ratio = np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((total + 1) / (total.sum() + BUCKETS))
    return np.round(ratio * 1e6).astype(np.int64)


def weights_by_language(df: DataFrame, good: list[int], lang: str, doc_id: str = "doc_id", text: str = "text") -> dict[str | None, tuple[int, np.ndarray, np.ndarray]]:
    """By language with trusted documents: the weight of buckets without trusted n-grams, the others, their weights.

    The null language is one too, and POOLED is all of them together. Buckets kept: at most one for each n-gram of the trusted documents.
    """
    ids = np.array(good, np.int64)
    src = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"))
    mine = df.sparkSession.createDataFrame([(i,) for i in good], "doc_id long")
    langs = {r[0] for r in src.select("doc_id", "lang").join(F.broadcast(mine), "doc_id").select("lang").distinct().collect()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str | None, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for name, (n, k) in totals.items():
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([name] * some.size, pa.string()), pa.array(some), pa.array(n[some]), pa.array(k[some])], names=["lang", "bucket", "n", "good"])
            totals.clear()

        for batch in batches:
            texts, ident, of = as_text(batch.column(1)), batch.column(0), np.array(batch.column(2).to_pylist(), object)
            hit = np.isin(ident.fill_null(0).to_numpy(zero_copy_only=False), ids) & ident.is_valid().to_numpy(zero_copy_only=False)
            for at, m in cut(texts):
                bucket, ptr = grams(*raw(texts.slice(at, m)))
                for name in {*of[at : at + m]} & langs:
                    if name not in totals and len(totals) == MOST_COUNTED:
                        yield from flush()
                    total = totals.setdefault(name, np.zeros((2, BUCKETS), np.int64))
                    for row, docs in ((0, of[at : at + m] == name), (1, (of[at : at + m] == name) & hit[at : at + m])):
                        if docs.any():
                            total[row] += np.bincount(bucket[np.repeat(docs, np.diff(ptr))], minlength=BUCKETS)
        yield from flush()
        release()

    rows = written(src.mapInArrow(count, "lang string, bucket long, n long, good long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"), F.sum("good").alias("good")))
    sizes = {r[0]: (r[1], r[2]) for r in rows.groupBy("lang").agg(F.sum("n"), F.sum("good")).collect() if r[2]}
    if not sizes:
        return {}
    got = rows.where("good > 0").toPandas()
    parts = {name if isinstance(name, str) else None: mine for name, mine in got.groupby("lang", dropna=False)}
    parts[POOLED] = rows.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).where("good > 0").toPandas()
    sizes[POOLED] = tuple(sum(x) for x in zip(*rows.groupBy("lang").agg(F.sum("n"), F.sum("good")).select("sum(n)", "sum(good)").collect(), strict=True))
    out = {}
    for name, mine in parts.items():
        share, k = mine["n"].to_numpy() / sizes[name][0], sizes[name][1]
        ratio = np.log((mine["good"].to_numpy() + BUCKETS * share) / (k + BUCKETS)) - np.log(share)
        out[name] = (round(float(np.log(BUCKETS / (k + BUCKETS))) * 1e6), mine["bucket"].to_numpy(), np.round(ratio * 1e6).astype(np.int64))
    return out


FIELDS = [
    *(T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr_sum", "n_grams")),
    T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()),
]


def judge(df: DataFrame, weight: np.ndarray | dict, text: str = "text", threshold: float = THRESHOLD, keep: list[str] | None = None, lang: str | None = None) -> DataFrame:
    """Add the base counts, llr_sum (millionths of a nat) over n_grams, base_failed and kept. No shuffle.

    weight: by bucket; with lang, the result of weights_by_language().
    """
    least = round(threshold * 1e6)
    table = df.sparkSession.sparkContext.broadcast(weight)

    def make():
        def scores(bucket: np.ndarray, gptr: np.ndarray, langs: pa.Array | None) -> np.ndarray:
            if langs is None:
                return sums(table.value[bucket], gptr)
            of, out = np.array(langs.to_pylist(), object), np.zeros(gptr.size - 1, np.int64)

            def weight_of(name: str | None) -> np.ndarray:
                other, some, value = table.value[name]
                own = np.full(BUCKETS, other, np.int64)
                own[some] = value
                return own

            names = {*of} & table.value.keys()
            pooled = sums(weight_of(POOLED)[bucket], gptr) if names else out
            for name in names:
                docs = of == name
                inside = np.repeat(docs, np.diff(gptr))
                own = sums(weight_of(name)[bucket[inside]], np.concatenate([[0], np.cumsum(np.diff(gptr)[docs])]))
                out[docs] = np.maximum(own, pooled[docs])
            return out

        def fn(texts: pa.Array, langs: pa.Array | None = None) -> dict:
            buf, offs = raw(texts)
            starts, lens, ptr = words(buf, offs)
            n = np.diff(ptr)
            of_word = np.zeros(buf.size + 1, np.int64)
            of_word[starts] += 1
            of_word[starts + lens] -= 1
            letter = (np.cumsum(of_word[:-1]) > 0) & ((buf & 0xC0) != 0x80)
            again = repeated(buf, starts, lens, ptr)
            bucket, gptr = grams(buf, offs)
            score, m = scores(bucket, gptr, langs), np.diff(gptr)
            failed = (n < MIN_WORDS) | (100 * again > MAX_REPEAT * n)
            return {
                "n_words": n, "word_chars": sums(letter, offs), "n_symbols": sums(SYMBOLS[buf], offs),
                "n_dup_lines": np.fromiter(map(duplicate_lines, texts.to_pylist()), np.int64, len(texts)),
                "n_repeat_words": again, "llr_sum": score, "n_grams": m, "base_failed": failed, "kept": ~failed & (score >= least * m),
            }

        return fn

    return map_texts(df, FIELDS, make, text, keep, lang)


def rules(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, keep: list[str] | None = None, lang: str | None = None) -> DataFrame:
    """Count both multinomials over df (lang: a column; those of each language) and judge every row of it."""
    good = trusted(labels)
    return judge(df, weights(df, good, doc_id, text) if lang is None else weights_by_language(df, good, lang, doc_id, text), text, threshold, keep, lang)


def oracle() -> str:
    """DuckDB SQL of rules() over `documents` and `labels`, without the texts, while there are at most TRUSTED good labels."""
    word, digit = r"[^\x20\x09-\x0D]+", "instr('0123456789ABCDEF', x[{}]) - 1"
    return rf"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{word}') AS w, hex(encode(coalesce(text, ''))) AS h FROM documents),
byte AS (SELECT doc_id, i, (16 * ({digit.format(1)}) + {digit.format(2)})::HUGEINT AS v FROM (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, regexp_extract_all(h, '..') AS l FROM d))),
g AS MATERIALIZED (SELECT doc_id, ((v * 2654435761) % 4294967296) // {1 << (32 - BITS)} AS b FROM (SELECT doc_id, v + 256 * lead(v) OVER o + 65536 * lead(v, 2) OVER o + 16777216 * lead(v, 3) OVER o AS v FROM byte WINDOW o AS (PARTITION BY doc_id ORDER BY i)) WHERE v IS NOT NULL),
good AS (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0),
c AS (SELECT b, count(*) AS n, count(*) FILTER (doc_id IN (SELECT doc_id FROM good)) AS k FROM g GROUP BY b),
s AS (SELECT sum(n) AS n, sum(k) AS k FROM c),
weight AS MATERIALIZED (SELECT b, CASE WHEN s.k = 0 THEN 0 ELSE round((ln((c.k + 1)::DOUBLE / (s.k + {BUCKETS})) - ln((c.n + 1)::DOUBLE / (s.n + {BUCKETS}))) * 1e6) END::BIGINT AS v FROM c, s),
score AS (SELECT doc_id, sum(v)::BIGINT AS llr_sum, count(*) AS n_grams FROM g JOIN weight USING (b) GROUP BY doc_id),
tri AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
again AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM tri WHERE n > 1) GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}')) AS l FROM d),
base AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
 (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(again.n, 0)::BIGINT AS n_repeat_words, coalesce(llr_sum, 0) AS llr_sum, coalesce(n_grams, 0) AS n_grams
 FROM d JOIN lines USING (doc_id) LEFT JOIN again USING (doc_id) LEFT JOIN score USING (doc_id))
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed, NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words) AND llr_sum >= {round(THRESHOLD * 1e6)} * n_grams AS kept FROM base"""
