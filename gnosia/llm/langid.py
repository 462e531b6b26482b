"""Operator 6: language identification by Bayesian evidence fusion.

posterior(l)  ~  prior(l | host) * P(text | l) * P(declared | l) * P(suffix | l)

P(text | l) is a multinomial over hashed byte trigrams, counted over all labelled documents by grouped aggregation; its
logarithm is divided by three, as each byte stands in three trigrams. The declared markup language and the language of
the address suffix are right with given reliabilities. Host priors are smoothed hierarchically: the counts of text
votes of a host are pulled towards those of its domain, these towards all; a row's own vote is left out. One more
class, `und`, has the uniform multinomial: text unlike every language falls to it.

Results: null or empty texts have no text evidence, so that the other evidence decides; unknown declarations, suffixes
and hosts are neutral; a declaration counts up to its first `-` or `_`; ties go to the first language in alphabetical
order; repeated rows stay, each with its own vote left out; an empty table gives an empty one; columns named like a
result, whatever their case, are replaced by it, all others stay.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gnosia.llm.common import as_text, cut, map_texts, release, written
from gnosia.llm.quality import grams
from gnosia.llm.textvec import gather, raw, sums

BITS, GRAM = 14, 3
#: Every language with a labelled n-gram is modelled; from this many buckets on by a row of all of them.
DENSE = 1 << BITS - 3
#: Languages that a task counts at once (more are passed on in parts), entries of sparse languages looked up at once.
MOST_COUNTED, MOST_ENTRIES = 256, 1 << 21
#: Weight of the parent level in a prior, in votes.
STRENGTH = 10.0
#: How often declared markup and address suffix are right.
MARKUP, SUFFIX = 0.9, 0.8
#: Prior of `und`.
UNKNOWN = 0.001
#: Least posterior of an accepted document.
CONFIDENT = 0.5
#: Hosts, and bytes of their votes, up to which priors are broadcast; beyond, they are joined by a shuffle.
BROADCAST_HOSTS, BROADCAST_BYTES = 20_000, 16 << 20
#: Two-letter codes of three-letter ones, languages of country suffixes (fixed values).
THREE = {"eng": "en", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "ita": "it", "por": "pt", "nld": "nl", "dut": "nl", "pol": "pl"}
COUNTRY = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en", "it": "it", "pt": "pt", "nl": "nl", "pl": "pl"}


class Model:
    """Languages, and log P(trigram | language) in thousandths of a nat: whole numbers, so sums do not depend on order.

    A language seen in DENSE buckets or more has a row of all of them. Any other has a constant, added to the row of all
    languages together, and the differences in the buckets it was seen in: it backs off to the trigrams of all languages,
    and its memory goes with its own n-grams.
    """

    def __init__(self, languages: list[str], row: np.ndarray, bucket: np.ndarray, n: np.ndarray) -> None:
        size = 1 << BITS
        self.languages = languages
        total = np.bincount(row, weights=n, minlength=len(languages))
        seen = np.bincount(row, minlength=len(languages))
        self.dense, self.sparse = np.flatnonzero(seen >= DENSE), np.flatnonzero(seen < DENSE)
        self.unlike = round(-1000 * math.log(size))
        milli = lambda p: np.round(1000 * np.log(p)).astype(np.int32)
        self.rows = np.zeros((self.dense.size, size), np.int32)
        order = np.lexsort((bucket, row))
        row, bucket, n = row[order], bucket[order], n[order]
        for at, lang in enumerate(self.dense):
            lo, hi = np.searchsorted(row, [lang, lang + 1])
            counts = np.zeros(size)
            counts[bucket[lo:hi]] = n[lo:hi]
            self.rows[at] = milli((counts + 0.5) / (total[lang] + 0.5 * size))
        every = (np.bincount(bucket, weights=n, minlength=size) + 0.5) / (total.sum() + 0.5 * size)
        self.every, back = milli(every), 0.5 * size
        self.constant = milli(back / (total[self.sparse] + back)).astype(np.int64)
        few = np.zeros(len(languages), bool)
        few[self.sparse] = True
        mine = np.flatnonzero(few[row])
        mine = mine[np.argsort(bucket[mine], kind="stable")]
        self.ptr = np.searchsorted(bucket[mine], np.arange(size + 1))
        place = np.cumsum(few) - 1
        self.of = place[row[mine]].astype(np.int32)
        p = (n[mine] + back * every[bucket[mine]]) / (total[row[mine]] + back)
        self.more = (milli(p) - self.every[bucket[mine]] - self.constant[self.of]).astype(np.int32)

    def evidence(self, texts: pa.Array) -> np.ndarray:
        """log P(text | l) of each text, one column for each language and `und`."""
        bucket, ptr = grams(*raw(texts), GRAM, BITS)
        length = np.diff(ptr)
        out = np.zeros((length.size, len(self.languages) + 1), np.int64)
        out[:, -1] = self.unlike * length
        for lang, weight in zip(self.dense, self.rows, strict=True):
            out[:, lang] = sums(weight[bucket], ptr)
        if self.sparse.size:
            width = self.sparse.size
            part = np.zeros(length.size * width)
            lens = (self.ptr[1:] - self.ptr[:-1])[bucket]
            doc, ends = np.repeat(np.arange(length.size), length), np.cumsum(lens)
            at = 0
            while at < bucket.size:  # bounded parts, however many languages share a bucket
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + MOST_ENTRIES, "right")))
                entry = gather(self.ptr[bucket[at:to]], lens[at:to])
                np.add.at(part, np.repeat(doc[at:to], lens[at:to]) * width + self.of[entry], self.more[entry])
                at = to
            out[:, self.sparse] = sums(self.every[bucket], ptr)[:, None] + length[:, None] * self.constant + part.reshape(-1, width).astype(np.int64)
        return out / (1000.0 * GRAM)


def train(df: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Count all documents of each language; the driver gets at most one number for each language and bucket."""
    src = df.select(F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang")).where("lang is not null and lang <> 'und'")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for name, total in totals.items():
                some = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array([name] * some.size, pa.string()), pa.array(some), pa.array(total[some])], names=["lang", "bucket", "n"])
            totals.clear()

        for batch in batches:
            texts, of = as_text(batch.column(0)), np.array(batch.column(1).to_pylist(), object)
            for at, m in cut(texts):
                bucket, ptr = grams(*raw(texts.slice(at, m)), GRAM, BITS)
                names, code = np.unique(of[at : at + m].astype(str), return_inverse=True)
                code = np.repeat(code, np.diff(ptr))
                order = np.argsort(code, kind="stable") if names.size > 1 else np.arange(code.size)
                cuts = np.searchsorted(code[order], np.arange(names.size + 1))
                for k, name in enumerate(names.tolist()):
                    if name not in totals and len(totals) == MOST_COUNTED:
                        yield from flush()
                    total = totals.setdefault(name, np.zeros(1 << BITS, np.int64))
                    total += np.bincount(bucket[order[cuts[k] : cuts[k + 1]]], minlength=total.size)
        yield from flush()
        release()

    got = src.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = got.column("lang").to_pylist()
    languages = sorted({*names})
    number = {x: i for i, x in enumerate(languages)}
    return Model(languages, np.array([number[x] for x in names], np.int64), got.column("bucket").to_numpy().astype(np.int64), got.column("n").to_numpy().astype(np.int64))


def domain(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def suffix_language(host: Column, path: Column) -> Column:
    """Language of the country suffix, or else of a first path segment of two letters; null if neither tells."""
    pairs = F.create_map(*[F.lit(x) for kv in COUNTRY.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, F.substring_index(host, ".", -1)), F.nullif(F.regexp_extract(path, "^/([a-z]{2})(?:/|$)", 1), F.lit("")))


def _priors(df: DataFrame, width: int) -> tuple[DataFrame, np.ndarray]:
    """(host, votes: those of the host, those of its domain, each as language, count, language, count ...), and the counts of all; from rows (host, vote)."""
    each = written(df.groupBy("host", "vote").agg(F.count(F.lit(1)).alias("n")).withColumn("domain", domain(F.col("host"))))
    up = each.where("vote is not null").groupBy("domain", "vote").agg(F.sum("n").alias("n"))
    flat = lambda name: F.flatten(F.collect_list(F.when(F.col("vote").isNotNull(), F.array(F.col("vote").cast("long"), F.col("n"))))).alias(name)
    all_ = np.zeros(width)
    for vote, n in up.groupBy("vote").agg(F.sum("n")).collect():
        all_[vote] = n
    hosts, domains = each.groupBy("host", "domain").agg(flat("h")), up.groupBy("domain").agg(flat("d"))
    out = hosts.join(domains, hosts.domain.eqNullSafe(domains.domain), "left")
    return out.select("host", F.array("h", F.coalesce("d", F.array().cast("array<long>"))).alias("votes")), all_


def identify(df: DataFrame, model: Model, text: str = "text", declared: str | None = None, suffix: str | None = None, host: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Add language, posterior (of it) and text_language (the text's own vote) to every row.

    declared, suffix, host: columns with the declared language, the suffix's language and the host, where there are any.
    Two passes over the texts: votes by host, then posteriors. Texts move only if there are more than BROADCAST_HOSTS
    hosts.
    """
    shared, width = df.sparkSession.sparkContext.broadcast(model), len(model.languages)

    def vote():
        def fn(texts: pa.Array) -> dict:
            best = shared.value.evidence(texts).argmax(axis=1)
            known = (best < width) & (pa.compute.binary_length(texts).to_numpy(zero_copy_only=False) > 0)
            return {"vote": pa.array(best.astype(np.int32), mask=~known)}

        return fn

    rest = [c for c in (df.columns if keep is None else keep) if c.lower() not in ("language", "posterior", "text_language")]
    col = lambda c: F.col(f"`{c}`").cast("string") if c else F.lit(None).cast("string")
    row = F.struct(F.lit(0).alias("__"), *[F.col(f"`{c}`") for c in rest]).alias("row")
    src = df.select(row, col(text).alias("body"), col(declared).alias("declared"), col(suffix).alias("suffix"), col(host).alias("host"))
    if host and width:
        votes = map_texts(src.select("body", "host").where("host is not null"), [T.StructField("vote", T.IntegerType())], vote, "body", ["host"])
        priors, all_ = _priors(votes, width)
        priors = priors.withColumnRenamed("host", "of")
        src = src.join(F.broadcast(priors) if _small(priors) else priors, F.col("host") == F.col("of"), "left").drop("of")
    else:
        src, all_ = src.withColumn("votes", F.lit(None).cast("array<array<long>>")), np.zeros(width)

    fields = [T.StructField("language", T.StringType()), T.StructField("posterior", T.DoubleType()), T.StructField("text_language", T.StringType())]
    packed = src.select(*[F.col("row").getField(c).alias(c) for c in rest], F.struct("body", "declared", "suffix", "votes"))
    schema = T.StructType([*packed.schema.fields[:-1], *fields])
    return _score(packed, schema, len(rest), shared, width, all_)


def _small(priors: DataFrame) -> bool:
    """Whether the priors may be broadcast: few hosts, and few bytes of votes (16 for each language seen at a host)."""
    n, size = priors.limit(BROADCAST_HOSTS + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(F.flatten("votes")) * 8), F.lit(0))).first()
    return n <= BROADCAST_HOSTS and size <= BROADCAST_BYTES


def primary(code: str | None, number: dict[str, int]) -> int:
    """Number of the language that a code names, -1 if it is unknown."""
    main = re.split("[-_]", code.strip().lower(), maxsplit=1)[0] if code else ""
    return number.get(main, number.get(THREE.get(main, ""), -1))


def _score(packed: DataFrame, schema: T.StructType, rest: int, shared, width: int, all_: np.ndarray) -> DataFrame:
    """packed: `rest` columns that stay, then the evidence as one struct."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        names = [*model.languages, "und"]
        number = {x: i for i, x in enumerate(model.languages)}
        for batch in batches:
            given = batch.column(rest)
            body, said, ends, votes = (given.field(i) for i in range(4))
            texts = as_text(body)
            for at, n in cut(texts):
                ev = model.evidence(texts.slice(at, n))
                own = ev.argmax(axis=1)
                filled = np.array([len(x) > 0 for x in texts.slice(at, n).to_pylist()], bool)
                post = ev.copy()
                own_vote = np.where(filled, own, width)
                prior = np.full((n, width + 1), math.log(UNKNOWN))
                if width:
                    prior[:, :width] = math.log((1 - UNKNOWN) / width)
                for i, v in enumerate(votes.slice(at, n).to_pylist()):
                    if v is not None and width:
                        c = np.zeros((3, width))
                        for level in (0, 1):
                            c[level, v[level][::2]] = v[level][1::2]
                        c[2] = all_
                        if own_vote[i] < width:
                            c[:, own_vote[i]] = np.maximum(c[:, own_vote[i]] - 1, 0)
                        p = np.full(width, 1 / width)
                        for level in (2, 1, 0):
                            p = (c[level] + STRENGTH * p) / (c[level].sum() + STRENGTH)
                        prior[i, :width] = np.log(p * (1 - UNKNOWN))
                post += prior
                for column, right in ((said, MARKUP), (ends, SUFFIX)):
                    for i, x in enumerate(column.slice(at, n).to_pylist()):
                        j = primary(x, number)
                        if j >= 0:
                            like = np.full(width + 1, math.log((1 - right) / max(1, width - 1)))
                            like[j], like[width] = math.log(right), math.log(1 / width)
                            post[i] += like
                best = post.argmax(axis=1)
                sure = 1 / np.exp(post - post.max(axis=1, keepdims=True)).sum(axis=1)
                cols = [batch.column(i).slice(at, n).cast(arrow.field(i).type) for i in range(rest)]
                cols += [pa.array([names[j] for j in best], pa.string()), pa.array(sure), pa.array([names[j] if f else None for j, f in zip(own, filled, strict=True)], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=arrow.names)
        release()

    return packed.mapInArrow(run, schema)


def visible(html: Column) -> Column:
    """Text of a page: without scripts, styles, comments, tags and character references."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"&(?:#?\w+);", " ")


def markup_language(html: Column) -> Column:
    """The lang attribute of the html element (null: none)."""
    return F.nullif(F.lower(F.regexp_extract(html, r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,8})""", 1)), F.lit(""))
