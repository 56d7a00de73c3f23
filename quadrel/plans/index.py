"""Build, store, open and ask an index."""

from __future__ import annotations

import re
import time
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.analyze import STOP_WORDS, encode_field, local_name, short_names, stemmed
from ..operators import filters, layouts, model, ontology, rank, results
from ..sources.quads import RDF_TYPE
from . import query as Q
from .store import delete, folders, shared_path, written

TABLES = ("resources", "docs", "tokens", "term_stats", "doc_sizes", "alignment", "fields")


@dataclass
class Config:
    contexts: bool = True
    stop: tuple[str, ...] = STOP_WORDS
    stem: bool = False
    top_predicates: int = 200
    weights: rank.Weights = field(default_factory=rank.Weights)
    block_phrases: list[str] = field(default_factory=list)
    query_filters: tuple[Callable[[str], bool], ...] = ()  # a query that one of them holds for is blocked
    scorer: Callable[..., DataFrame] = rank.score
    term_steps: Callable | None = None  # a processor of arrays of words (functions.analyze.chained) instead of the default steps
    query_word: Callable[[str], str | None] | None = None  # its counterpart for a word of a query
    layouts: tuple[str, ...] = ("horizontal", "vertical")
    default_field: str = Q.DEFAULT_FIELD


@dataclass
class Ontology:
    classes: DataFrame
    subclass: DataFrame
    domains: DataFrame


def build(quads: DataFrame, config: Config = Config(), onto: Ontology | None = None, selected: list[str] | None = None) -> dict[str, DataFrame]:
    """The tables of an index.  selected: predicates with a field of their own, instead of the most used."""
    extra = onto.classes.select("iri") if onto else None
    resources = model.dictionary(quads, extra, config.contexts)
    rels = written(model.relations(quads), "rels")  # read by documents and by tokens
    docs = model.documents(rels, resources)
    spark = quads.sparkSession
    top = model.top_predicates(resources, config.top_predicates) if selected is None else spark.createDataFrame([(p, 0) for p in selected], "predicate string, uses long")
    fields = top.where(~F.col("predicate").isin(*filters.BLACKLIST)).select("predicate", encode_field(F.col("predicate")).alias("field"), "uses")
    up = ontology.ancestor_ids(ontology.closure(onto.subclass), resources) if onto else None
    stop = config.term_steps or config.stop
    named = written(layouts.with_ids(rels.drop("relation_n3"), resources).withColumn("t", layouts.object_terms(stop)), "named")
    h = layouts.horizontal_tokens(named, stop, config.contexts).withColumn("layout", F.lit("horizontal"))
    v = layouts.vertical_tokens(named, fields, up, stop).withColumn("layout", F.lit("vertical"))
    tokens = h.unionByName(v) if len(config.layouts) == 2 else h if config.layouts == ("horizontal",) else v
    if config.stem:
        tokens = stemmed(tokens)
    return {"resources": resources, "docs": docs, "tokens": tokens, "fields": fields, "term_stats": layouts.term_stats(tokens), "doc_sizes": layouts.doc_sizes(h if not config.stem else tokens.where("layout = 'horizontal'")), "alignment": layouts.alignment(tokens.where("layout = 'vertical'"))}


def _ranged(df: DataFrame, by: list[str], within: list[str]) -> DataFrame:
    """df in sorted ranges.  It is stored first: to find where ranges begin and to fill them are two passes, and what made df would run in both."""
    return written(df, "whole").repartitionByRange(*by).sortWithinPartitions(*within)


def save(tables: dict[str, DataFrame], path: str, priors: DataFrame | None = None) -> None:
    """Writes the tables so that reads prune: documents and resources in ranges of id, tokens by layout and in ranges of term
    and document, so that a frequent term is spread.  What
    follows from tokens is made from the stored table."""
    spark = next(iter(tables.values())).sparkSession
    tables["resources"].repartitionByRange("id").sortWithinPartitions("id").write.parquet(f"{path}/resources")
    _ranged(tables["docs"], ["id"], ["id"]).write.parquet(f"{path}/docs")
    tables["fields"].write.parquet(f"{path}/fields")
    _ranged(tables["tokens"], ["layout", "term", "doc_id"], ["layout", "term", "field", "doc_id", "pos"]).write.partitionBy("layout").parquet(f"{path}/tokens")
    if priors is not None:
        priors.select("doc_id", "category").repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.parquet(f"{path}/priors")
    t = spark.read.parquet(f"{path}/tokens")
    layouts.term_stats(t).repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/term_stats")
    layouts.doc_sizes(t.where("layout = 'horizontal'")).write.parquet(f"{path}/doc_sizes")
    layouts.alignment(t.where("layout = 'vertical'")).repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/alignment")


class QueryLog:
    """Times of queries: mean of all and of the last 50."""

    def __init__(self, window: int = 50) -> None:
        self.n, self.total, self.last = 0, 0.0, deque(maxlen=window)

    def add(self, ms: float) -> dict[str, float]:
        self.n, self.total = self.n + 1, self.total + ms
        self.last.append(ms)
        return {"ms": ms, "mean": self.total / self.n, "rolling": sum(self.last) / len(self.last)}


class Index:
    def __init__(self, tables: dict[str, DataFrame], config: Config = Config(), onto: Ontology | None = None, priors: DataFrame | None = None) -> None:
        self.t, self.config, self.onto, self.priors, self.log = tables, config, onto, priors, QueryLog()
        rows = tables["fields"].orderBy(F.desc("uses"), "predicate").collect()
        self.fields = {r["predicate"]: r["field"] for r in rows}
        free = short_names([r["field"] for r in rows], "_", layouts.HORIZONTAL)
        self.aliases = {short: full for full, short in free.items()}

    @classmethod
    def open(cls, spark: SparkSession, path: str, config: Config = Config(), onto: Ontology | None = None, priors: DataFrame | None = None) -> Index:
        """priors stored with the index count unless others are given."""
        if priors is None and "priors" in folders(spark, path):
            priors = spark.read.parquet(f"{path}/priors")
        out = cls({t: spark.read.parquet(f"{path}/{t}") for t in TABLES}, config, onto, priors)
        out.path = path
        return out

    @classmethod
    def built(cls, quads: DataFrame, config: Config = Config(), onto: Ontology | None = None, priors: DataFrame | None = None) -> Index:
        """Builds an index, stores it in the shared folder and opens it."""
        path = shared_path(quads.sparkSession, "index")
        save(build(quads, config, onto), path, priors)
        return cls.open(quads.sparkSession, path, config, onto)

    def destroy(self) -> None:
        """Deletes the stored tables."""
        delete(next(iter(self.t.values())).sparkSession, self.path)

    def documents(self) -> DataFrame:
        """All documents in order of id."""
        return self.t["docs"].orderBy("id")

    def titles(self) -> DataFrame:
        """(id, title): what every resource is called, also those without content."""
        return self.t["resources"].select("id", F.col("text").alias("title"))

    def document_or_title(self, id_: int) -> DataFrame:
        """The document; for a resource without content a document of its title alone."""
        d = self.t["docs"]
        bare = self.t["resources"].where(F.col("id") == id_).join(d.where(F.col("id") == id_).select("id"), "id", "left_anti")
        return self.document(id_).unionByName(bare.select("id", F.lit(-1).cast("long").alias("previous_id"), F.col("text").alias("subject"), F.array().cast(d.schema["relations"].dataType).alias("relations")))

    def reconfigure(self, config: Config) -> None:
        self.config = config

    @property
    def n(self) -> int:
        if not hasattr(self, "_n"):
            self._n = self.t["resources"].count()
        return self._n

    @property
    def avgdl(self) -> float:
        if not hasattr(self, "_avgdl"):
            self._avgdl = layouts.average_length(self.t["doc_sizes"], self.n).first()["avgdl"] or 1.0
        return self._avgdl

    def ids_of(self, names: list[str]) -> dict[str, int]:
        wanted = sorted({x for n in names for x in (n, n.lower())})
        return {r["text"]: r["id"] for r in self.t["resources"].where(F.col("text").isin(*wanted)).select("id", "text").collect()} if wanted else {}

    def resource(self, id_: int) -> str | None:
        r = self.t["resources"].where(F.col("id") == id_).select("text").first()
        return r and r["text"]

    def document(self, id_: int) -> DataFrame:
        return self.t["docs"].where(F.col("id") == id_)

    def document_size(self, id_: int, field_name: str = "object") -> int:
        r = self.t["doc_sizes"].where((F.col("doc_id") == id_) & (F.col("field") == field_name)).select("size").first()
        return r["size"] if r else 0

    def has_content(self, id_: int) -> bool:
        return not self.document(id_).isEmpty()

    def parse(self, text: str, mode: str = "free") -> Q.Node:
        """mode free analyses and rewrites; raw takes the text as it is, in the default field."""
        if filters.blocked(text, self.config.block_phrases) or any(f(text) for f in self.config.query_filters):
            raise Q.QueryError("the query is blocked")
        text = Q.encode_resources(Q.decode_entities(text), self.ids_of(Q.resource_names(text)))
        raw = mode == "raw"
        node = Q.Parser(self.config.stop, self.config.stem, {} if raw else {**self.aliases, **{p: f for p, f in self.fields.items()}}, raw, self.config.query_word)(text)
        if raw:
            return Q.Node("in", (node,), (self.config.default_field,)) if node.kind in ("term", "phrase", "prefix", "range") else node
        bare = sorted(Q.bare_terms(node))
        align: dict[str, list[str]] = {}
        if bare:
            for r in self.t["alignment"].where(F.col("term").isin(*bare)).collect():
                align.setdefault(r["term"], []).append(r["field"])
        return Q.rewrite(node, {k: sorted(v) for k, v in align.items()}, sorted(self.fields.values()))

    def matching(self, node: Q.Node) -> DataFrame:
        ids = self.t["docs"].select(F.col("id").alias("doc_id"))
        return Q.matching(node, self.t["tokens"].select("field", "doc_id", "pos", "term"), ids)

    def ranked(self, node: Q.Node) -> DataFrame:
        """(doc_id, score) of all matches; a query for a type alone isn't scored."""
        found = self.matching(node)
        leaves = Q.positive_leaves(node)
        if Q.type_only(node) or not leaves:
            return found.select("doc_id", F.lit(1.0).alias("score"))
        fields = sorted({f for _, fs in leaves for f in (fs or [Q.DEFAULT_FIELD])})
        s = self.config.scorer(self.t["tokens"], self.t["doc_sizes"], self.t["term_stats"], list(dict.fromkeys(x for x, _ in leaves)), fields, self.n, self.avgdl, self.config.weights, found, self.priors)
        return found.join(s, "doc_id", "left").select("doc_id", F.coalesce("score", F.lit(0.0)).alias("score"))

    def search(self, text: str, start: int = 0, size: int | None = 10, mode: str = "free", deref: bool = True, limit: int = results.LIMIT) -> dict:
        """A page of results, or with size None all of them from start: query, parsed query, number of results, times, and `items`, a DataFrame."""
        filters.check_range(start, size)
        began = time.time()
        m = re.fullmatch(r"\s*doc:\s*(\S+)\s*", text)
        if m:
            iri = m[1].strip("{}<>")
            got = int(iri) if iri.isdigit() else self.ids_of([iri]).get(iri)
            page = self.t["docs"].where(F.col("id") == F.lit(got if got is not None else -1)).select(F.col("id").alias("doc_id"), F.lit(1.0).alias("score"))
            total, node, limit = page.count(), None, None
        else:
            node = self.parse(text, mode)
            ranked = self.ranked(node) if size is not None else written(self.ranked(node), "ranked")
            total, page = ranked.count(), rank.top(ranked, size, start)
        searched = time.time()
        items = results.items(page, self.t["docs"], self.t["fields"], limit, deref).orderBy(F.desc("score"), "subject_id")
        times = self.log.add((time.time() - began) * 1000)
        return {"query": text, "parsed_query": node, "num_results": total, "page_start": start, "page_size": size, "time": times["ms"], "search_time": (searched - began) * 1000, "items": items}

    def statistics(self) -> dict:
        """Fields by alias, statistics of classes and properties."""
        types = layouts.term_histogram(self.t["term_stats"], self.t["resources"], self.fields.get(RDF_TYPE, "")).select(F.col("text").alias("name"), F.col("df").alias("count"))
        preds = self.t["term_stats"].where("field = 'predicate'")
        counts = layouts.term_histogram(preds, self.t["resources"], "predicate").select(F.col("text").alias("name"), F.col("df").alias("count"))
        out = {"fields": self.aliases, "predicates": counts}
        if self.onto:
            closed = ontology.closure(self.onto.subclass)
            counted = ontology.class_counts(types, self.onto.classes, closed)
            out |= {"classes": ontology.class_stats(counted, self.onto.subclass, self.onto.domains, closed), "roots": ontology.roots(counted, self.onto.subclass), "properties": ontology.property_counts(self.onto.domains, counts)}
        else:
            out |= {"classes": types.select(F.col("name").alias("class"), local_name(F.col("name")).alias("local_name"), "count")}
        return out
