"""From N-Quads text to quads: parsing, checks, filters, rejects and counters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.quads import as_quads, parse_nodes, read_quads
from . import filters
from .model import MAX_RELATION, MAX_RELATIONS


@dataclass
class Ingested:
    """quads: what is kept; rejects: (value, reason) of lines that are no quads; counters: (counter, n)."""

    quads: DataFrame
    rejects: DataFrame
    counters: DataFrame


def _once(df: DataFrame, name: str) -> DataFrame:
    """df whose column `name` is computed once for each row: a condition on it isn't moved below, where its patterns would run for every mention."""
    return df.select(*[c for c in df.columns if c != name], F.explode(F.array(F.struct(name))).alias("_x")).select(*[c for c in df.columns if c != name], F.col(f"_x.{name}").alias(name))


def ingest(lines: DataFrame, kept_by: list | None = None, contexts: bool = True) -> Ingested:
    """lines: (value).  A line is rejected for the first check that it fails; then the filters in `kept_by` see its quad in turn."""
    nodes = _once(parse_nodes(lines.where("value is not null and length(trim(value)) > 0")), "nodes")
    judged = _once(nodes.withColumn("reason", filters.reject_reason(nodes)), "reason")
    good = as_quads(judged.where("reason is null").drop("reason"), contexts)
    kept = filters.apply_filters(good, kept_by or [])
    rejects = judged.where("reason is not null").select("value", "reason")
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("counter"), "n")
    counters = judged.groupBy(F.coalesce(F.concat(F.lit("reject: "), "reason"), F.lit("good lines")).alias("counter")).agg(F.count(F.lit(1)).alias("n"))
    counters = counters.unionByName(one(kept, "quads kept")).unionByName(one(kept.where(F.length("relation_n3") > MAX_RELATION), "long relations"))
    return Ingested(kept.drop("value"), rejects, counters)


def ingest_path(spark: SparkSession, path: str, kept_by: list | None = None, contexts: bool = True) -> Ingested:
    """The same from a file, plain or compressed, or a folder of part files."""
    return ingest(read_quads(spark, path), kept_by, contexts)


def model_counters(quads: DataFrame, cap: int = MAX_RELATIONS) -> DataFrame:
    """(counter, n): subjects, their relations, repeats that are dropped, relations beyond the cap, subjects with such."""
    each = quads.where(F.length("relation_n3") <= MAX_RELATION).groupBy("s", "relation_n3").count().groupBy("s").agg(F.sum("count").alias("all"), F.count(F.lit(1)).alias("n"))
    total = each.agg(
        F.count(F.lit(1)).alias("subjects"), F.coalesce(F.sum(F.least("n", F.lit(cap))), F.lit(0)).alias("relations"), F.coalesce(F.sum(F.col("all") - F.col("n")), F.lit(0)).alias("repeats"),
        F.coalesce(F.sum(F.greatest(F.col("n") - cap, F.lit(0))), F.lit(0)).alias("beyond the cap"), F.count_if(F.col("n") > cap).alias("subjects cut"),
    )
    return total.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in total.columns]), F.array(*[F.col(f"`{c}`") for c in total.columns]))).alias("counter", "n"))
