"""Queries over the synthetic tables, one for each operator, with DuckDB SQL where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import jaccard_join, language_id, license_scan, line_dedup, packing, progressive_jpeg, sentencepiece_lattice, topk, toxicity, url_filter


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_read(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs))


def op3_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no images: every embedding is made a progressive JPEG file first, then that column is decoded."""
    return progressive_jpeg.decode_column(progressive_jpeg.media_of_vectors(_read(spark, sf_dir, "embeddings")))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_read(spark, sf_dir, "documents"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with a link: its group and the number of documents that reach the threshold with it; pairs within a group aren't listed."""
    return jaccard_join.groups(_read(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _read(spark, sf_dir, "labels")))


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are all documents whose id is divisible by 20, against all documents."""
    docs = _read(spark, sf_dir, "documents")
    return topk.search(docs, docs.where("doc_id % 20 = 0"), query_id="doc_id")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    cascade, buckets = url_filter.build(pages)
    return url_filter.apply_filter(pages, cascade, buckets)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_lattice.encode(_read(spark, sf_dir, "documents"), decoded=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_language_id": op2_language_id,
    "op3_progressive_jpeg": op3_progressive_jpeg,
    "op4_license_scan": op4_license_scan,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_toxicity": op6_toxicity,
    "op7_topk_search": op7_topk_search,
    "op8_url_filter": op8_url_filter,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_sentencepiece": op10_sentencepiece,
}
ORACLE_SQL: dict[str, str] = {"op7_topk_search": topk.ORACLE, "op8_url_filter": url_filter.ORACLE}
