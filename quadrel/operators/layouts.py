"""Fields of documents: the fixed five over every relation, and one for each frequent predicate; postings and statistics over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.analyze import REF, STOP_WORDS, encode_field, subject_text, terms
from ..sources.quads import RDF_TYPE
from .filters import BLACKLIST

HORIZONTAL = ("subject", "subjectText", "predicate", "object", "context")


def with_ids(rels: DataFrame, resources: DataFrame) -> DataFrame:
    """rels with doc_id, pid, cid and oid; relations with a resource that the dictionary lacks are dropped.  Predicates and contexts are
    few and joined by hash; objects and subjects by their own keys."""
    r = resources.select("id", "text")
    out = rels.join(r.select(F.col("text").alias("s"), F.col("id").alias("doc_id")), "s")
    out = out.join(resources.where("n_predicate > 0").select(F.col("text").alias("p"), F.col("id").alias("pid")), "p")
    out = out.join(resources.where("n_context > 0").select(F.col("text").alias("c"), F.col("id").alias("cid")), "c", "left")
    link = F.when(F.col("o_type").isin("RESOURCE", "BNODE"), F.col("o"))
    out = out.withColumn("_link", link).join(resources.where("n_object > 0").select(F.col("text").alias("_link"), F.col("id").alias("oid")), "_link", "left")
    return out.where((F.col("_link").isNull() | F.col("oid").isNotNull()) & (F.col("c").isNull() | F.col("cid").isNotNull())).drop("_link")


def missing(rels: DataFrame, resources: DataFrame) -> DataFrame:
    """(slot, n): how many relations name a predicate or object that the dictionary lacks."""
    r = resources.select("text")
    objects = rels.where("o_type in ('RESOURCE', 'BNODE')")
    parts = [d.select(F.col(c).alias("text")).join(r, "text", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit(slot).alias("slot"), "n") for slot, c, d in (("predicate", "p", rels), ("object", "o", objects))]
    return parts[0].unionByName(parts[1])


def object_terms(stop: tuple[str, ...] = STOP_WORDS):
    """The terms of a relation's object: its reference, or a literal's words.  rels: with_ids."""
    return F.when(F.col("oid").isNotNull(), F.array(F.concat(F.lit(REF), F.col("oid").cast("string")))).otherwise(terms(F.col("o"), stop))


def _terms(rels: DataFrame, stop):
    """Terms stored as `t` by the caller, for several layouts, or made here."""
    return F.col("t") if "t" in rels.columns else object_terms(stop)


def horizontal_tokens(rels: DataFrame, stop: tuple[str, ...] = STOP_WORDS, contexts: bool = True) -> DataFrame:
    """(field, doc_id, pos, term) of the five fields.  rels: with_ids.  Object, predicate and context stand at the same positions,
    a literal's words one after the other without a gap between relations; a missing context leaves its positions empty."""
    r = rels.where(~F.lower("p").isin(*BLACKLIST)).select("doc_id", "s", "ord", "pid", "cid", _terms(rels, stop).alias("t"))
    docs = r.groupBy("doc_id").agg(F.first("s").alias("s"), F.sort_array(F.collect_list(F.struct("ord", "pid", "cid", "t"))).alias("r"))
    ref = lambda c: F.concat(F.lit(REF), c.cast("string"))
    parallel = F.flatten(F.transform("r", lambda x: F.transform(x["t"], lambda t: F.struct(t.alias("object"), ref(x["pid"]).alias("predicate"), ref(x["cid"]).alias("context")))))
    about = F.concat(F.array(ref(F.col("doc_id"))), terms(subject_text(F.col("s")), stop))
    body = docs.select("doc_id", F.posexplode(parallel).alias("pos", "x"))
    named = ["object", "predicate"] + (["context"] if contexts else [])
    rows = body.select("doc_id", "pos", F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(f"x.{n}").alias("term")) for n in named])).alias("y")).select("y.field", "doc_id", "pos", "y.term").where("term is not null")
    head = docs.select("doc_id", F.posexplode(about).alias("pos", "term")).withColumn("field", F.lit("subjectText"))
    me = docs.select("doc_id", ref(F.col("doc_id")).alias("term")).withColumns({"field": F.lit("subject"), "pos": F.lit(0)})
    return rows.unionByName(head.select("field", "doc_id", "pos", "term")).unionByName(me.select("field", "doc_id", "pos", "term"))


def vertical_tokens(rels: DataFrame, fields: DataFrame, ancestors: DataFrame | None = None, stop: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """(field, doc_id, pos, term), one field for each predicate of fields (predicate).  ancestors: (id, ancestor_id); the types of a
    document are followed by those of all their super-classes."""
    r = rels.where(~F.col("p").isin(*BLACKLIST)).join(F.broadcast(fields.select(F.col("predicate").alias("p"))), "p", "left_semi").select("doc_id", "p", "ord", "oid", _terms(rels, stop).alias("t"))
    if ancestors is not None:
        up = ancestors.groupBy(F.col("id").alias("oid")).agg(F.transform(F.sort_array(F.collect_list("ancestor_id")), lambda a: F.concat(F.lit(REF), a.cast("string"))).alias("up"))
        r = r.join(up, "oid", "left").withColumn("t", F.when((F.col("p") == RDF_TYPE) & F.col("up").isNotNull(), F.concat("t", "up")).otherwise(F.col("t")))
    d = r.groupBy("doc_id", "p").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("ord", "t"))), lambda x: x["t"])).alias("t"))
    return d.select(encode_field(F.col("p")).alias("field"), "doc_id", F.posexplode("t").alias("pos", "term"))


def check_fields(fields: DataFrame) -> DataFrame:
    """(predicate, field); an error when the result runs if two predicates share an encoded name."""
    f = fields.select("predicate", encode_field(F.col("predicate")).alias("field"))
    n = f.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.first("predicate").alias("predicate"))
    return n.select(F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("two predicates are called "), "field"))).otherwise(F.col("predicate")).alias("predicate"), "field")


def text_tokens(docs: DataFrame, id_col: str, text_col: str, stop: tuple[str, ...] = (), field: str = "object") -> DataFrame:
    """(field, doc_id, pos, term) of plain texts."""
    return docs.where(F.col(text_col).isNotNull()).select(F.lit(field).alias("field"), F.col(id_col).alias("doc_id"), F.posexplode(terms(F.col(text_col), stop)).alias("pos", "term"))


def doc_term_stats(tokens: DataFrame) -> DataFrame:
    """(field, doc_id, term, tf, last_pos)."""
    return tokens.groupBy("field", "doc_id", "term").agg(F.count(F.lit(1)).cast("int").alias("tf"), F.max("pos").alias("last_pos"))


def postings(tokens: DataFrame) -> DataFrame:
    """(field, term, doc_id, tf, positions)."""
    p = tokens.groupBy("field", "term", "doc_id").agg(F.sort_array(F.collect_list("pos")).alias("positions"))
    return p.select("field", "term", "doc_id", F.size("positions").alias("tf"), "positions")


def term_stats(tokens: DataFrame) -> DataFrame:
    """(field, term, df, occurrences, sum_max_pos)."""
    return doc_term_stats(tokens).groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"), F.sum(F.col("tf").cast("long")).alias("occurrences"), F.sum(F.col("last_pos").cast("long")).alias("sum_max_pos"))


def doc_sizes(tokens: DataFrame) -> DataFrame:
    """(field, doc_id, size) of documents with any token there."""
    return tokens.groupBy("field", "doc_id").agg(F.count(F.lit(1)).cast("int").alias("size"))


def zero_filled(sizes: DataFrame, ids: DataFrame, field: str) -> DataFrame:
    """(doc_id, size) for every id, 0 where the field is empty."""
    s = sizes.where(F.col("field") == field).select("doc_id", "size")
    return ids.select(F.col("id").alias("doc_id")).join(s, "doc_id", "left").select("doc_id", F.coalesce("size", F.lit(0)).alias("size"))


def alignment(tokens: DataFrame) -> DataFrame:
    """(term, field): the fields that hold a term."""
    return tokens.select("term", "field").distinct()


def alignment_counts(tokens: DataFrame) -> DataFrame:
    return alignment(tokens).groupBy("term").agg(F.count(F.lit(1)).alias("n_fields"))


def average_length(sizes: DataFrame, n_docs: int, field: str = "object") -> DataFrame:
    """(avgdl): empty documents count."""
    return sizes.where(F.col("field") == field).agg((F.coalesce(F.sum(F.col("size").cast("long")), F.lit(0)) / F.lit(n_docs)).alias("avgdl"))


def term_histogram(stats: DataFrame, resources: DataFrame, field: str) -> DataFrame:
    """(text, df) of the resources referred to in a field: predicates, or types."""
    t = stats.where((F.col("field") == field) & F.col("term").startswith(REF)).select(F.substring("term", 2, 20).cast("long").alias("id"), "df")
    return t.join(resources.select("id", "text"), "id").select("text", "df")
