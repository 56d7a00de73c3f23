"""From quads to a resource dictionary and one document for each subject."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.store import written

#: A document keeps this many relations.
MAX_RELATIONS = 10_001
MAX_ELEMENT, MAX_RELATION = 5_000, 10_000


def role_records(quads: DataFrame, contexts: bool = True) -> DataFrame:
    """(resource, role): what each quad says of the resources in it, but for its subject."""
    roles = [
        F.struct(F.col("p").alias("resource"), F.lit("PREDICATE").alias("role")),
        F.when(F.col("o_type").isin("RESOURCE", "BNODE"), F.struct(F.col("o").alias("resource"), F.lit("OBJECT").alias("role"))),
    ]
    if contexts:
        roles.append(F.when(F.col("c_type") == "RESOURCE", F.struct(F.col("c").alias("resource"), F.lit("CONTEXT").alias("role"))))
    return quads.select(F.explode(F.array(*roles)).alias("x")).where("x is not null").select("x.*")


def role_counts(quads: DataFrame, extra: DataFrame | None = None, contexts: bool = True) -> DataFrame:
    """(text, n_relations, n_predicate, n_object, n_context) of every resource; extra: (iri) of further ones, such as ontology classes.
    Relations are counted without repeats."""
    named = role_records(quads, contexts).groupBy("resource", "role").agg(F.count(F.lit(1)).alias("n"))
    relations_ = quads.where(F.length("relation_n3") <= MAX_RELATION).select(F.col("s").alias("resource"), "relation_n3").distinct()
    related = relations_.groupBy("resource").agg(F.count(F.lit(1)).alias("n")).withColumn("role", F.lit("RELATION"))
    rows = named.unionByName(related)
    if extra is not None:
        rows = rows.unionByName(extra.select(F.col("iri").alias("resource"), F.lit("EXTRA").alias("role"), F.lit(0).cast("long").alias("n")).distinct())
    total = lambda role: F.coalesce(F.sum(F.when(F.col("role") == role, F.col("n"))), F.lit(0)).alias("n_" + role.lower())
    return rows.groupBy(F.col("resource").alias("text")).agg(total("RELATION").alias("n_relations"), total("PREDICATE"), total("OBJECT"), total("CONTEXT"))


def dense_ids(df: DataFrame, col: str = "text", part_rows: int = 1_000_000) -> DataFrame:
    """df with `id`, the rank of `col` (distinct values) in byte order, from 0.  The table is stored once, cut into sorted ranges of about
    `part_rows` rows; a row's place in its range is added to the sizes of the ranges before it.  No task sees more than a range."""
    base = written(df, "ranked")
    parts = max(1, -(-base.count() // part_rows))
    placed = written(base.repartitionByRange(parts, col).sortWithinPartitions(col).withColumn("_m", F.monotonically_increasing_id()), "placed")
    part, place = F.shiftrightunsigned("_m", 33), F.col("_m").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("_p")).count()  # a row for each range
    before = sizes.select(F.col("_p"), F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return placed.withColumns({"_p": part, "_place": place}).join(F.broadcast(before), "_p").withColumn("id", F.col("_before") + F.col("_place")).select(*df.columns, "id")


def dictionary(quads: DataFrame, extra: DataFrame | None = None, contexts: bool = True) -> DataFrame:
    """(id, text, n_relations, n_predicate, n_object, n_context)."""
    return dense_ids(role_counts(quads, extra, contexts)).select("id", "text", "n_relations", "n_predicate", "n_object", "n_context")


def top_predicates(resources: DataFrame, n: int = 200) -> DataFrame:
    """(predicate, uses) of the n most used."""
    return resources.where("n_predicate > 0").orderBy(F.desc("n_predicate"), "text").limit(n).select(F.col("text").alias("predicate"), F.col("n_predicate").alias("uses"))


def _relation() -> Column:
    return F.struct("relation_n3", "p", "o_type", "o", "c")


def relations(quads: DataFrame, cap: int = MAX_RELATIONS) -> DataFrame:
    """(s, ord, p, o_type, o, c, relation_n3): a subject's distinct relations in byte order, the first `cap` of them."""
    r = quads.where(F.length("relation_n3") <= MAX_RELATION).select("s", "p", "o_type", "o", "c", "relation_n3").dropDuplicates(["s", "relation_n3"])
    w = Window.partitionBy("s").orderBy("relation_n3")
    return r.withColumn("ord", F.row_number().over(w) - 1).where(F.col("ord") < cap).select("s", "ord", "p", "o_type", "o", "c", "relation_n3")


def long_relations(quads: DataFrame) -> DataFrame:
    return quads.where(F.length("relation_n3") > MAX_RELATION)


def subject_ids(rels: DataFrame, resources: DataFrame) -> DataFrame:
    """(id, previous_id, subject): subjects in order of id; the one before, -1 for the first.  Ranges of ids keep the window apart."""
    ids = rels.select(F.col("s").alias("text")).distinct().join(resources.select("id", "text"), "text").select("id", F.col("text").alias("subject"))
    return with_previous(ids)


def with_previous(ids: DataFrame, span: int = 1_000_000) -> DataFrame:
    """ids with previous_id: within ranges of `span` ids by lag; the first of a range follows the last of the ranges before."""
    b = ids.withColumn("_b", F.floor(F.col("id") / span))
    lag = b.withColumn("previous_id", F.lag("id").over(Window.partitionBy("_b").orderBy("id")))
    last = b.groupBy("_b").agg(F.max("id").alias("_last")).withColumn("_before", F.max("_last").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)))  # one row for a million ids
    return lag.join(F.broadcast(last.select("_b", "_before")), "_b", "left").withColumn("previous_id", F.coalesce("previous_id", "_before", F.lit(-1))).drop("_b", "_before")


def documents(rels: DataFrame, resources: DataFrame) -> DataFrame:
    """(id, previous_id, subject, relations)."""
    packed = rels.groupBy("s").agg(F.sort_array(F.collect_list(F.struct("ord", F.col("p").alias("predicate"), "o_type", F.col("o").alias("object"), F.col("c").alias("context"), F.col("relation_n3").alias("n3")))).alias("relations"))
    return subject_ids(rels, resources).join(packed.withColumnRenamed("s", "subject"), "subject").select("id", "previous_id", "subject", "relations")


def has_content(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """The ids that are subjects."""
    return ids.join(docs.select("id"), "id", "left_semi")


def resource_of(ids: DataFrame, resources: DataFrame) -> DataFrame:
    return ids.join(resources.select("id", "text"), "id")
