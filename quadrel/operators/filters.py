"""Filters of quads at ingest, and of predicates and fields."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.analyze import rewritten
from ..sources.quads import _kind, _text
from .model import MAX_ELEMENT, MAX_RELATION

RDF, RDFS, OWLNS = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2002/07/owl#"
IRI = r"^[A-Za-z][A-Za-z0-9+.-]*:(?:[A-Za-z0-9;/?:@&=+$,\-_.!~*'()\[\]#]|%[0-9A-Fa-f]{2}|[^\x00-\x7f])+$"
#: Predicates that are never indexed.
BLACKLIST = ("stag", "tagspace", "ctag", "rel", "mm")


@dataclass(frozen=True)
class RegexFilter:
    """Patterns to be found in the N3 of each slot; all or any of them must be.  A missing context isn't tried."""

    subject: str | None = None
    predicate: str | None = None
    object: str | None = None
    context: str | None = None
    conjunction: bool = True


@dataclass(frozen=True)
class PrefixFilter:
    """Keeps vocabulary predicates, and rewrites those of a prefix to prefix + last segment."""

    predicate_prefix: str
    type_prefix: str | None = None
    drop_others: bool = True
    lowercase: bool = False


def n3(quads: DataFrame, slot: str) -> Column:
    """The N3 of a slot of quads."""
    if slot == "o":
        return F.col("o_n3")
    mark = F.when(F.col(f"{slot}_type") == "BNODE", F.concat(F.lit("_:"), slot)) if f"{slot}_type" in quads.columns else F.lit(None)
    return F.when(F.col(slot).isNotNull(), F.coalesce(mark, F.concat(F.lit("<"), F.col(slot), F.lit(">"))))


def regex_keeps(quads: DataFrame, f: RegexFilter) -> Column:
    tried = []
    for slot, pattern in (("s", f.subject), ("p", f.predicate), ("o", f.object), ("c", f.context)):
        if pattern is not None:
            x = n3(quads, slot)
            hit = x.rlike(pattern)
            tried.append(F.coalesce(hit, F.lit(True)) if f.conjunction else F.struct(x.isNotNull().alias("on"), F.coalesce(hit, F.lit(False)).alias("hit")))
    if not tried:
        return F.lit(True)
    if f.conjunction:
        return reduce(lambda a, b: a & b, tried)
    any_hit = reduce(lambda a, b: a | b, [t["hit"] for t in tried])
    any_on = reduce(lambda a, b: a | b, [t["on"] for t in tried])
    return any_hit | ~any_on


def by_regex(quads: DataFrame, f: RegexFilter) -> DataFrame:
    return quads.where(regex_keeps(quads, f))


def by_prefix(quads: DataFrame, f: PrefixFilter) -> DataFrame:
    """Drops and rewrites by the predicate's vocabulary; a rewrite is in lower case whatever `lowercase` says."""
    p, o = F.col("p"), F.col("o")
    vocabulary = p.startswith(RDFS) | p.startswith(OWLNS)
    syntax = p.startswith(RDF)
    typed = F.lit(True) if f.type_prefix is None else o.startswith(f.type_prefix)
    mine = p.startswith(f.predicate_prefix)
    low = (lambda c: F.lower(c)) if f.lowercase else (lambda c: c)
    keep = vocabulary | (syntax & typed) | (~syntax & (mine | F.lit(not f.drop_others)))
    new_p = F.when(vocabulary | syntax, p).when(mine, F.when(rewritten(p, f.predicate_prefix, False) == p, p).otherwise(rewritten(p, f.predicate_prefix, True))).otherwise(low(p))
    new_o = o if f.type_prefix is None else F.when(syntax & ~vocabulary & typed, F.when(rewritten(o, f.type_prefix, False) == o, o).otherwise(rewritten(o, f.type_prefix, True))).otherwise(o)
    q = quads.where(keep).withColumns({"_p": new_p, "_o": new_o})
    obj = F.when(F.col("_o") == o, F.col("o_n3")).otherwise(F.concat(F.lit("<"), "_o", F.lit(">")))
    rel = F.concat_ws(" ", F.concat(F.lit("<"), "_p", F.lit(">")), obj, F.when(F.col("c").isNotNull(), F.concat(F.lit("<"), "c", F.lit(">"))), F.lit("."))
    return q.withColumns({"o_n3": obj, "relation_n3": rel}).withColumns({"p": F.col("_p"), "o": F.col("_o")}).drop("_p", "_o")


def apply_filters(quads: DataFrame, filters: list) -> DataFrame:
    """Filters in turn: the two kinds above or any function from DataFrame to DataFrame."""
    for f in filters:
        quads = by_regex(quads, f) if isinstance(f, RegexFilter) else by_prefix(quads, f) if isinstance(f, PrefixFilter) else f(quads)
    return quads


def filter_from_xml(text: str) -> RegexFilter | PrefixFilter:
    """The two known shapes of filter files; anything else is an error, nothing is instantiated by name."""
    root = ET.fromstring(text)
    get = {x.tag: (x.text or "") for x in root}
    on = lambda k, d: get.get(k, str(d)).strip().lower() == "true"
    name = root.tag.rsplit(".", 1)[-1]
    if name == "RegexTupleFilter":
        pattern = lambda k: get[k] if k in get else None
        return RegexFilter(pattern("subjectRegex"), pattern("predicateRegex"), pattern("objectRegex"), pattern("contextRegex"), on("andNotOrConjunction", False))
    if name == "PredicatePrefixTupleFilter":
        return PrefixFilter(get["predicatePrefix"], get.get("rdfTypePrefix"), on("filterNonMatches", False), on("lowercase", False))
    raise ValueError(f"unknown filter {root.tag}")


def reject_reason(nodes: DataFrame) -> Column:
    """Why a parsed line is no quad, in the order of the checks; null for a good one."""
    x = F.col("nodes")
    some = F.slice(x, 1, 4)
    bad_iri = F.exists(some, lambda n: (_kind(n) == "RESOURCE") & ~_text(n).rlike(IRI))
    return (
        F.when(x.isNull() | (F.size(x) == 0), "parse").when((F.size(x) < 3) | (F.size(x) > 5), "arity")
        .when(F.exists(some, lambda n: F.length(_text(n)) > MAX_ELEMENT), "long element").when(bad_iri, "bad iri")
        .when(~_kind(F.get(x, 0)).isin("RESOURCE", "BNODE"), "subject type").when(_kind(F.get(x, 1)) != "RESOURCE", "predicate type")
    )


def reject_counts(nodes: DataFrame, quads: DataFrame | None = None) -> DataFrame:
    """(reason, n); with quads, also the relations that are too long (their resources count all the same)."""
    out = nodes.select(reject_reason(nodes).alias("reason")).where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    if quads is not None:
        n = quads.where(F.length("relation_n3") > MAX_RELATION).agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(F.lit("long relation").alias("reason"), "n")
        out = out.unionByName(n)
    return out


def indexed_predicates(rels: DataFrame, fields: DataFrame | None = None, lower: bool = False) -> DataFrame:
    """Relations whose predicate isn't blacklisted and, with fields (predicate), has a field."""
    name = F.lower("p") if lower else F.col("p")
    kept = rels.where(~name.isin(*BLACKLIST))
    return kept if fields is None else kept.join(F.broadcast(fields.select(F.col("predicate").alias("p"))), "p", "left_semi").select(*rels.columns)


def indexed_fields(tokens: DataFrame) -> DataFrame:
    return tokens.where(~F.col("field").startswith("NOINDEX"))


def blocked(query: str, phrases: list[str]) -> bool:
    """Whether a listed phrase occurs in the query as consecutive words."""
    import re

    said = re.findall(r"\w+", query.lower())
    for p in phrases:
        w = re.findall(r"\w+", p.lower())
        if w and any(said[i : i + len(w)] == w for i in range(len(said) - len(w) + 1)):
            return True
    return False


def blocked_column(text: Column, phrases: list[str]) -> Column:
    """The same for a column of texts: words between single spaces, framed by spaces."""
    import re

    line = F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{Nd}_]+"), F.lit(0)), " "), F.lit(" "))
    hit = F.lit(False)
    for p in phrases:
        w = re.findall(r"\w+", p.lower())
        if w:
            hit = hit | F.contains(line, F.lit(" " + " ".join(w) + " "))
    return hit


def check_range(start: int, size: int | None) -> None:
    """A page has at most 10,000 results; no size stands for all of them."""
    if start < 0 or (size is not None and not 0 <= size <= 10_000):
        raise ValueError(f"bad range: start {start}, size {size}")
