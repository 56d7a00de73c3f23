"""Corpus pipeline: toxicity, language ID, line dedup, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns the table of documents for the next one, which reads it from Parquet;
the last returns bins.  The toxicity machine is fitted on the labelled documents of the source tables; the language
model on the stage's own input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrel.llm import jaccard_join, language_id, line_dedup, packing, toxicity
from quadrel.llm.common import col, free_name, written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the machine holds for toxic go; null, empty and letterless texts stay.  Repeated rows fare alike; null ids and other columns play no part."""
    source, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity.drop_toxic(docs, toxicity.fit(source, labels))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no known language go, null, empty and letterless texts too (they have none); `lang` becomes the language found.  Repeated rows fare
    alike; a tie goes to the language that sorts first; other columns pass through whatever their names."""
    return language_id.keep_identified(docs, language_id.fit(docs))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks that an earlier document has go; a document of which nothing is left goes; n_chars follows the text.  Rows whose id or text is null
    stay as they are.  Repeated rows of one id and text are one document; of one id the text of the smaller hash is the earlier; columns of any name pass through."""
    removed = free_name(docs, "_removed")
    left = line_dedup.dedup_lines(docs, count_col=removed)
    kept = left.where((F.col(removed) == 0) | F.col("text").rlike(r"\S"))
    return kept.select(*[F.when(F.col(removed) > 0, F.length("text").cast("long")).otherwise(F.col(c)).alias(c) if c == "n_chars" else col(c) for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest id (then text hash) stays, of its repeated rows one.  Null ids, null texts and
    texts without words are in no group and stay; columns of any name pass through."""
    return jaccard_join.keep_one(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of whole documents and pieces of those that are longer than a bin.  Null and blank texts are in no bin; null ids and repeated rows are packed
    like others; equal sizes go in order of id and text hash; other columns aren't read."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("language_id", language_stage),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard", near_duplicate_stage),
    ("best_fit_packing", packing_stage),
]

#: The first stage is a trained machine, which SQL can't express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
