"""Corpus pipeline: quality rules, language identification, near-duplicate removal, best-fit packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame that is written
as Parquet and read again by the next. All but the last return the columns of documents. run() applies them in turn to
the documents table, with the tables between them in the shared checkpoint folder.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gnosia.llm import langid, likeness, packing, quality, simhash
from gnosia.llm.common import ship, table
from gnosia.llm.queries import vocabulary


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5, by language. Documents that fail the base rules or the likelihood-ratio threshold go."""
    ship(spark)
    out = quality.rules(docs, table(spark, sf_dir, "labels"), lang="lang")
    return out.where("kept").select(*[F.col(f"`{c}`") for c in docs.columns])


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6. Documents without a language, or with an uncertain one, go; `lang` becomes the one identified."""
    ship(spark)
    out = langid.identify(docs, langid.train(docs), "text", declared="lang", host="source")
    out = out.where((F.col("language") != "und") & (F.col("posterior") >= langid.CONFIDENT))
    return out.select(*[F.col("language").alias(c) if c == "lang" else F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4, on five-word shingles: of each component of documents with a likeness of 0.8 or more the one with the least doc_id stays."""
    ship(spark)
    return simhash.representatives(docs, find=likeness.grouped)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10. All documents in sequences of at most 4,096 tokens."""
    ship(spark)
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("quality", keep_quality), ("language", keep_language), ("near_duplicates", drop_near_duplicates), ("packing", pack)]
#: SQL can express neither the packing nor the trained stages; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    folder = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="gnosia-pipeline-")
    for name, stage in STAGES[:-1]:
        path = f"{folder.rstrip('/')}/pipeline-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
