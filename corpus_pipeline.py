"""A training corpus from ``documents``: quality rules, line dedup, near-dedup, mixing, and BPE encoding.

Each stage takes (spark, docs, sf_dir) and, if it is to keep its tables apart, where; all but the last return the
columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborql.llm import bpe, line_dedup, minhash, mixing, quality
from arborql.tables import Tables
from arborql.llm.queries import default_vocab


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str, tables: Tables | None = None) -> DataFrame:
    """Documents that the base rules or the adaptive limits reject go. Rows with one doc_id and text are one
    document."""
    return quality.keep(docs, tables or Tables(spark))


def unique_lines(spark: SparkSession, docs: DataFrame, sf_dir: str, tables: Tables | None = None) -> DataFrame:
    """Texts lose the lines that three or more documents hold, except in the largest doc_id; n_chars follows. A
    document stays even if no line does."""
    out = line_dedup.dedup(docs, tables or Tables(spark), count=False)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str, tables: Tables | None = None) -> DataFrame:
    """One document of each group that shares 0.8 or more of its five-word shingles stays."""
    return minhash.dedup(docs, tables or Tables(spark), size=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str, tables: Tables | None = None) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once, or twice."""
    return mixing.repeats(docs, tables or Tables(spark))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str, tables: Tables | None = None) -> DataFrame:
    """Token counts and digests of ids and decoded text, a row per document row."""
    return bpe.digests(docs, default_vocab())


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", unique_lines),
    ("MinHash near-dedup", near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: Near-duplicate classes, mixing by hashes, and BPE are not for SQL; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written and read again; a stage's own tables and its predecessor's rows go
    once its rows are written. The last stage's rows are not written here, so what it reads stays."""
    kept = Tables(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        own = Tables(spark)
        out = stage(spark, docs, sf_dir, own)
        if k == len(STAGES) - 1:
            return out
        out = kept.write(out)
        own.clear()
        if k:
            kept.drop(docs)
        docs = out
    return docs
