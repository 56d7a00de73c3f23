"""Result pages: documents with labels, links, truncated objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.analyze import remove_version

DEFAULT_CONTEXT, LIMIT, SLACK = "default:", 300, 20


def truncated(relations: Column, limit: int = LIMIT) -> Column:
    """Relations (in order) with `shown`: each predicate's objects are cut once their lengths reach the limit and a slack; later relations of such a
    predicate go, its first never does.  A fold, since each step depends on the cuts before."""
    start = F.struct(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>")).alias("acc"), F.array().cast("array<struct<predicate:string,shown:string,object:string,o_type:string,context:string>>").alias("out"))

    def step(a, r):
        used = F.try_element_at(a["acc"], r["predicate"])
        before = F.coalesce(used, F.lit(0))
        skip = used.isNotNull() & (before >= limit)
        cut = before + F.length(r["object"]) > limit + SLACK
        shown = F.when(cut, F.concat(F.substring(r["object"], F.lit(1), limit - before), F.lit("..."))).otherwise(r["object"])
        acc = F.map_concat(F.map_filter(a["acc"], lambda k, _: k != r["predicate"]), F.create_map(r["predicate"], (before + F.length(shown)).cast("int")))
        row = F.struct(r["predicate"].alias("predicate"), shown.alias("shown"), r["object"].alias("object"), r["o_type"].alias("o_type"), r["context"].alias("context"))
        return F.when(skip, a).otherwise(F.struct(acc.alias("acc"), F.concat(a["out"], F.array(row)).alias("out")))

    return F.aggregate(relations, start, step, lambda a: a["out"])


def label(relations: Column) -> Column:
    """The object of the last relation whose predicate ends in label or name."""
    named = F.filter(relations, lambda r: r["predicate"].endswith("label") | r["predicate"].endswith("name"))
    return F.get(named, F.size(named) - 1)["object"]


def labels(docs: DataFrame) -> DataFrame:
    """(subject, subject_id, label)."""
    return docs.select("subject", F.col("id").alias("subject_id"), label(F.col("relations")).alias("label"))


def items(page: DataFrame, docs: DataFrame, fields: DataFrame | None = None, limit: int | None = LIMIT, deref: bool = True) -> DataFrame:
    """(subject_id, subject, score, label, relations) of a page (doc_id, score): relations with context, the linked subject's id and label,
    and whether the predicate is a field.  Only the page's documents and what they link to are read; links are looked up by the whole object."""
    d = docs.join(page.select(F.col("doc_id").alias("id"), "score"), "id")
    rel = F.transform("relations", lambda r: F.struct(r["predicate"].alias("predicate"), r["object"].alias("shown"), r["object"].alias("object"), r["o_type"].alias("o_type"), r["context"].alias("context"))) if limit is None else truncated(F.col("relations"), limit)
    d = d.select(F.col("id").alias("subject_id"), "subject", "score", label(F.col("relations")).alias("label"), rel.alias("r"))
    x = d.select("*", F.posexplode_outer("r").alias("k", "x")).drop("r")
    link = F.when(F.col("x.o_type").isin("RESOURCE", "BNODE"), F.concat(F.lit("l"), F.col("x.object")))
    # rows without a link, most of them, meet nothing; a key of their own each spreads them
    x = x.withColumn("_link", F.coalesce(link, F.col("subject_id").cast("string")))
    to = labels(docs).select(F.concat(F.lit("l"), "subject").alias("_link"), F.col("subject_id").alias("link_id"), F.col("label").alias("link_label"))
    x = x.join(to, "_link", "left")
    indexed = F.lit(False)
    if fields is not None:
        x = x.join(F.broadcast(fields.select(F.col("predicate").alias("_p"), F.lit(True).alias("_i"))), F.col("x.predicate") == F.col("_p"), "left")
        indexed = F.coalesce("_i", F.lit(False))
    told = F.nullif(F.col("link_label"), F.col("x.shown")) if deref else F.lit(None).cast("string")
    row = F.struct(F.col("k"), F.col("x.predicate").alias("predicate"), F.col("x.shown").alias("object"), F.col("link_id").alias("subject_id_of_object"), F.coalesce("x.context", F.lit(DEFAULT_CONTEXT)).alias("context"), indexed.alias("indexed"), told.alias("label"))
    return x.groupBy("subject_id", "subject", "score", "label").agg(F.sort_array(F.collect_list(F.when(F.col("k").isNotNull(), row))).alias("relations"))


def by_field_order(items_: DataFrame, fields: list[str]) -> DataFrame:
    """items with each row's relations in the order of the fields' list; predicates that aren't in it come first, equals keep their order."""
    place = F.map_from_arrays(F.array(*[F.lit(f) for f in fields]).cast("array<string>"), F.array(*[F.lit(k) for k in range(len(fields))]).cast("array<int>"))
    keyed = F.transform("relations", lambda r: F.struct(F.coalesce(F.try_element_at(place, r["predicate"]), F.lit(-1)).alias("at"), r["k"].alias("k"), r.alias("r")))
    return items_.withColumn("relations", F.transform(F.array_sort(keyed, lambda a, b: F.when(a["at"] != b["at"], a["at"] - b["at"]).otherwise(a["k"] - b["k"])), lambda x: x["r"]))


def grouped_relations(items_: DataFrame) -> DataFrame:
    """(subject_id, predicate, objects): relations by predicate, objects in their order."""
    x = items_.select("subject_id", F.explode("relations").alias("r"))
    g = x.groupBy("subject_id", F.col("r.predicate").alias("predicate")).agg(F.sort_array(F.collect_list(F.struct("r.k", "r.object"))).alias("o"))
    return g.select("subject_id", "predicate", F.transform("o", lambda y: y["object"]).alias("objects"))


def distinct_types(items_: DataFrame, type_predicate: str, counts: DataFrame | None = None) -> DataFrame:
    """(subject_id, types): each subject's types without versions, each once; the rarest first by counts (name, count), then by name."""
    x = items_.select("subject_id", F.explode("relations").alias("r")).where(F.col("r.predicate") == type_predicate).select("subject_id", remove_version(F.col("r.object")).alias("name")).distinct()
    x = x.withColumn("count", F.lit(0).cast("long")) if counts is None else x.join(counts.select("name", "count"), "name", "left")
    g = x.groupBy("subject_id").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "name"))).alias("t"))
    return g.select("subject_id", F.transform("t", lambda y: y["name"]).alias("types"))
