"""Classes, their closure and statistics.  Ontologies are small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.analyze import encode_field, local_name, remove_version

MAX_DEPTH = 100


def closure(subclass: DataFrame) -> DataFrame:
    """(class, ancestor) of all proper super-classes, also through cycles."""
    spark = subclass.sparkSession
    up: dict[str, set[str]] = {}
    for r in subclass.select("child", "parent").distinct().collect():
        up.setdefault(r["child"], set()).add(r["parent"])
    rows = []
    for c in sorted(up):
        seen, todo = set(), list(up[c])
        while todo:
            p = todo.pop()
            if p not in seen:
                seen.add(p)
                todo += up.get(p, ())
        rows += [(c, a) for a in sorted(seen - {c})]
    return spark.createDataFrame(rows, "class string, ancestor string")


def closure_sql(subclass: DataFrame) -> DataFrame:
    """The same as a recursive query, for acyclic ontologies that are too large for the driver."""
    subclass.createOrReplaceTempView("_subclass")
    return subclass.sparkSession.sql("WITH RECURSIVE c(class, ancestor) AS (SELECT child, parent FROM _subclass UNION ALL SELECT c.class, s.parent FROM c JOIN _subclass s ON s.child = c.ancestor) SELECT DISTINCT class, ancestor FROM c WHERE class <> ancestor")


def ancestor_ids(closed: DataFrame, resources: DataFrame) -> DataFrame:
    """(id, ancestor_id) of classes that the dictionary knows, by name or by name without version."""
    r = resources.select("id", "text")
    plain = r.join(closed.select(F.col("class").alias("text"), "ancestor"), "text")
    bare = r.withColumn("bare", remove_version(F.col("text"))).where("bare != text").join(closed.select(F.col("class").alias("bare"), "ancestor"), "bare").join(closed.select(F.col("class").alias("text")), "text", "left_anti")
    named = plain.select("id", "ancestor").unionByName(bare.select("id", "ancestor"))
    return named.join(resources.select(F.col("text").alias("ancestor"), F.col("id").alias("ancestor_id")), "ancestor").select("id", "ancestor_id")


def class_counts(type_counts: DataFrame, classes: DataFrame, closed: DataFrame) -> DataFrame:
    """(class, count, label): the classes met and all their ancestors, these with 0 where they aren't met themselves.  type_counts: (name, count);
    names are also tried without their version, and add up."""
    known = classes.select(F.col("iri").alias("class"), "label")
    bare = remove_version(F.col("name"))
    raw = type_counts.join(known.select(F.col("class").alias("name"), F.lit(1).alias("exact")), "name", "left").select(F.when(F.col("exact") == 1, F.col("name")).otherwise(bare).alias("class"), "count")
    met = raw.groupBy("class").agg(F.sum("count").alias("count")).join(known.select("class"), "class", "left_semi")
    up = closed.join(met.select("class"), "class", "left_semi").select(F.col("ancestor").alias("class")).distinct().withColumn("count", F.lit(0).cast("long"))
    return met.unionByName(up).groupBy("class").agg(F.sum("count").alias("count")).join(known, "class", "left").select("class", "count", F.coalesce("label", F.lit("")).alias("label"))


def roots(counted: DataFrame, subclass: DataFrame) -> DataFrame:
    """Classes without a super-class."""
    return counted.join(subclass.select(F.col("child").alias("class")), "class", "left_anti").select("class", "count")


def children(counted: DataFrame, subclass: DataFrame) -> DataFrame:
    """(class, child) among the classes counted."""
    c = counted.select("class")
    return subclass.select(F.col("parent").alias("class"), "child").join(c, "class", "left_semi").join(c.withColumnRenamed("class", "child"), "child", "left_semi").distinct()


def properties(domains: DataFrame, kind: str | None = None) -> DataFrame:
    """(class, property, name), of one kind if named, in order of local name."""
    d = domains if kind is None else domains.where(F.col("kind") == kind)
    return d.select("class", "property", local_name(F.col("property")).alias("name")).distinct().orderBy("class", "name", "property")


def inherited_properties(counted: DataFrame, domains: DataFrame, closed: DataFrame, kind: str | None = "data") -> DataFrame:
    """(class, property): each class's own and those of all its ancestors."""
    own = properties(domains, kind).select("class", "property")
    near = counted.select("class").join(own, "class")
    far = counted.select("class").join(closed, "class").join(own.select(F.col("class").alias("ancestor"), "property"), "ancestor").select("class", "property")
    return near.unionByName(far).distinct()


def property_counts(domains: DataFrame, predicate_counts: DataFrame) -> DataFrame:
    """(property, count) of data properties, matched on encoded names without versions."""
    key = lambda c: encode_field(remove_version(F.col(c)))
    p = domains.where("kind = 'data'").select("property").distinct().withColumn("key", key("property"))
    n = predicate_counts.withColumn("key", key("name")).groupBy("key").agg(F.sum("count").alias("count"))
    return p.join(n, "key").select("property", "count")


def class_stats(counted: DataFrame, subclass: DataFrame, domains: DataFrame, closed: DataFrame) -> DataFrame:
    """(class, local_name, count, label, properties, children)."""
    props = inherited_properties(counted, domains, closed).groupBy("class").agg(F.sort_array(F.collect_set("property")).alias("properties"))
    kids = children(counted, subclass).groupBy("class").agg(F.sort_array(F.collect_set("child")).alias("children"))
    none = F.array().cast("array<string>")
    out = counted.join(props, "class", "left").join(kids, "class", "left")
    return out.select("class", local_name(F.col("class")).alias("local_name"), "count", "label", F.coalesce("properties", none).alias("properties"), F.coalesce("children", none).alias("children"))


def in_order(counted: DataFrame, by: str = "count") -> DataFrame:
    """counted with `place`, from 1: by count, the largest first, or by local name; equals by IRI.  An ontology's classes are a small table."""
    key = [F.desc("count"), F.col("class")] if by == "count" else [local_name(F.col("class")), F.col("class")]
    return counted.withColumn("place", F.row_number().over(Window.orderBy(*key)).cast("long"))


def tree(stats: DataFrame) -> str:
    """The classes as an indented text, for people; statistics of an ontology are a small table."""
    rows = {r["class"]: r for r in stats.collect()}
    kids = {c for r in rows.values() for c in r["children"]}
    out: list[str] = []

    def walk(c: str, depth: int) -> None:
        if c in rows and depth < MAX_DEPTH:
            out.append("  " * depth + f"{rows[c]['local_name']}:{rows[c]['count']}")
            for k in rows[c]["children"]:
                walk(k, depth + 1)

    for c in sorted(set(rows) - kids):
        walk(c, 0)
    return "\n".join(out)
