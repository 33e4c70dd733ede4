"""The thin queries opN_<name> over whole tables, and their DuckDB SQL where SQL can express the operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborql.llm import bpe, byte_bpe, centroids, chat, embedding_dedup, filter_audit, html_extract, line_dedup, minhash, mixing, quality, secrets, url_filter
from arborql.tables import Tables
from arborql.llm.oracles import ORACLE_SQL  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def default_vocab() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_vocab() -> tuple[str, str]:
    """The rank file and the pattern of its pre-tokens."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@query
def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), Tables(spark))


@query
def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@query
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_vocab())


@query
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality.judge(docs, Tables(spark)).select(quality.RESULT)


@query
def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return html_extract.extract(pages, keep=["page_id", "url"]).withColumn("n_chars", F.char_length("text").cast("long"))


@query
def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = minhash.classes(spark.read.parquet(f"{sf_dir}/documents.parquet"), Tables(spark), size=4, percent=80)
    return c.select("doc_id", "n_shingles", "component_id", "kept")


@query
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), Tables(spark))
    return m.select("doc_id", "size", "source_size", "target", "taken")


@query
def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.recover(spark.read.parquet(f"{sf_dir}/conversations.parquet"), Tables(spark))


@query
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), Tables(spark))


@query
def url_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9's operator where there are links to follow: four pages in five name the next one, others an address that is no
    page, and what stands in comments names nothing."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    n = p.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("next"))
    i = F.col("page_id")
    canonical = lambda u: F.concat(F.lit('<link rel="canonical" href="'), u, F.lit('">'))
    commented = F.concat(F.lit("<!-- "), canonical(F.lit("http://a.org/es/commented")), F.lit(" -->"))
    gone = F.concat(F.lit("http://gone."), F.when(i % 20 == 0, "org/es/").otherwise("net/de/"), i.cast("string"))
    tag = F.when(i % 10 == 0, F.concat(commented, canonical(gone))).when(i % 5 == 0, commented).when(i % 2 == 0, canonical(F.col("next"))).otherwise(F.concat(F.lit('<meta http-equiv="refresh" content="0; url='), "next", F.lit('">')))
    return url_filter.judge(p.join(n, "page_id", "left").withColumn("html", tag), Tables(spark))


@query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), Tables(spark))


@query
def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), *byte_vocab())


@query
def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.digests(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), Tables(spark), k=40, dims=64, scale=256, rounds=5, seed=2)


@query
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
