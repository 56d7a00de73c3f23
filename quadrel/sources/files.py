"""Small files, by-subject records, ontologies, indexes on disk, sorted text and rendered results."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.store import folders

OWL, RDF, RDFS = "{http://www.w3.org/2002/07/owl#}", "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}", "{http://www.w3.org/2000/01/rdf-schema#}"
MAX_RECORD = 1 << 20


def read_words(spark: SparkSession, path: str) -> list[str]:
    """Words of a file, one a line (stop words, black lists)."""
    return [r[0] for r in spark.read.text(path).select(F.trim("value").alias("w")).where("length(w) > 0").distinct().orderBy("w").collect()]


def read_phrases(spark: SparkSession, path: str) -> list[str]:
    """Phrases of a file, one a line."""
    return [re.sub(r"\s+", " ", w) for w in read_words(spark, path)]


def read_predicates(spark: SparkSession, path: str) -> DataFrame:
    """The first column of each line, split at white space."""
    return spark.read.text(path).select(F.split(F.trim("value"), r"\s+")[0].alias("predicate")).where("length(predicate) > 0")


def read_prior_rules(spark: SparkSession, path: str) -> DataFrame:
    """(rule, category) of lines rule=number; others and comments are skipped."""
    parts = spark.read.text(path).select(F.trim("value").alias("v")).where("v != '' and v not like '#%'").select(F.split("v", "=", 2).alias("x")).where(F.size("x") == 2)
    return parts.select(F.trim(F.col("x")[0]).alias("rule"), F.expr("try_cast(trim(x[1]) as int)").alias("category")).where("category is not null")


def parse_records(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """By-subject records (id, previous id, subject, relations, between tabs): the good ones, and rejects with a reason."""
    x = F.split("value", "\t")
    d = lines.select("value", F.expr("try_cast(split(value, '\t')[0] as bigint)").alias("id"), F.expr("try_cast(get(split(value, '\t'), 1) as bigint)").alias("previous_id"), F.get(x, 2).alias("subject"), F.filter(F.slice(x, 4, F.greatest(F.size(x), F.lit(1))), lambda r: F.length(F.trim(r)) > 0).alias("relations"))
    reason = (
        F.when(F.length("value") > MAX_RECORD, "too long").when(F.col("id").isNull() | F.col("previous_id").isNull(), "not a number").when(F.col("subject").isNull(), "no subject")
        .when(F.col("id") < 0, "negative id").when(F.col("previous_id") < -1, "bad previous id").when(F.col("id") <= F.col("previous_id"), "order")
    )
    d = d.withColumn("reason", reason)
    return d.where("reason is null").drop("value", "reason"), d.where("reason is not null").select("value", "reason")


def read_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The records of a file or folder, and rejects."""
    return parse_records(spark.read.text(path))


def record_line(id_: Column, previous: Column, subject: Column, relations: Column) -> Column:
    """One by-subject record as text."""
    return F.concat(F.concat_ws("\t", id_.cast("string"), previous.cast("string"), subject, F.array_join(relations, "\t")), F.when(F.size(relations) > 0, "\t").otherwise(""))


def read_ontology(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(iri, label), (child, parent), (property, kind, class) of an OWL/XML file; the file is small and read by the driver."""
    with open(path, encoding="utf-8") as f:
        return ontology_frames(spark, f.read())


def ontology_frames(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    root = ET.fromstring(text)
    classes, edges, domains = {}, set(), set()
    for c in root.findall(OWL + "Class"):
        iri = c.get(RDF + "about") or c.get(RDF + "ID")
        if not iri:
            continue
        classes[iri] = ([""] + [x.text or "" for x in c.findall(RDFS + "label")])[-1]
        for s in c.findall(RDFS + "subClassOf"):
            if parent := s.get(RDF + "resource"):
                edges.add((iri, parent))
    for tag, kind in (("DatatypeProperty", "data"), ("ObjectProperty", "object")):
        for p in root.findall(OWL + tag):
            for d in p.findall(RDFS + "domain"):
                found = [d.get(RDF + "resource")] if d.get(RDF + "resource") else [x.get(RDF + "about") for x in d.iter() if x.tag.endswith(("Class", "Description"))]
                domains |= {(p.get(RDF + "about"), kind, x) for x in found if x and p.get(RDF + "about")}
    return (
        spark.createDataFrame(sorted(classes.items()), "iri string, label string"),
        spark.createDataFrame(sorted(edges), "child string, parent string"),
        spark.createDataFrame(sorted(domains), "property string, kind string, class string"),
    )


def discover(spark: SparkSession, root: str, prefix: str = "index-") -> dict[str, str]:
    """Data sets below root, on any file system: directories named by the prefix and word characters; an error if there are none."""
    found = {m[1]: f"{root.rstrip('/')}/{name}" for name in folders(spark, root) if (m := re.fullmatch(re.escape(prefix) + r"(\w+)", name))}
    if not found:
        raise FileNotFoundError(f"no index below {root}")
    return dict(sorted(found.items()))


def merge_sorted(parts: list[DataFrame], col: str = "line") -> DataFrame:
    """All lines in byte order; a line that occurs twice is an error when the result runs (the parts are sets)."""
    whole = parts[0].select(col)
    for p in parts[1:]:
        whole = whole.unionByName(p.select(col))
    n = whole.groupBy(col).count()
    checked = n.select(F.when(F.col("count") > 1, F.raise_error(F.concat(F.lit("line occurs twice: "), F.col(col)))).otherwise(F.col(col)).alias(col))
    return checked.orderBy(col)


def store_lines(df: DataFrame, path: str, col: str = "line", compression: str = "none") -> None:
    """Writes lines as text."""
    df.select(F.col(col).alias("value")).write.option("compression", compression).text(path)


def write_lines(df: DataFrame, path: str, col: str = "line", compression: str = "none") -> int:
    """Writes lines as text and returns how many there are."""
    store_lines(df, path, col, compression)
    return df.sparkSession.read.text(path).count()


def as_json(df: DataFrame, callback: str | None = None) -> DataFrame:
    """(value): each row as JSON, wrapped for a script if a callback is named."""
    j = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    return df.select((F.concat(F.lit(callback + "("), j, F.lit(");")) if callback else j).alias("value"))


def as_text(df: DataFrame, subject: bool = True) -> DataFrame:
    """(value): a line for the subject and one for each relation."""
    lines = F.transform("relations", lambda r: F.concat_ws("\t", r["predicate"], r["object"], r["context"]))
    return df.select(F.concat_ws("\n", *([F.col("subject")] if subject else []), F.array_join(lines, "\n")).alias("value"))


def as_xml(df: DataFrame) -> DataFrame:
    return df.select(F.to_xml(F.struct("*")).alias("value"))


FORMATS = {"js": as_json, "txt": as_text, "doc": lambda df: as_text(df, False), "xml": as_xml}


def render(df: DataFrame, form: str = "js", **options) -> DataFrame:
    return FORMATS[form](df, **options)
