"""Ranking: BM25F over fields with one document length, that of `object`, and document priors."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPSILON = 1e-6
IMPORTANT, NEUTRAL, UNIMPORTANT = 2, 1, 0


@dataclass(frozen=True)
class Weights:
    """b, k1, least length, number of terms that counts, its weight; weights of the three classes of fields and of documents."""

    b: float = 0.75
    k1: float = 1.2
    dl_cutoff: int = 10
    max_norm: int = 5
    w_matches: float = 1.0
    fields: tuple[float, float, float] = (0.6, 1.0, 1.4)  # unimportant, neutral, important
    documents: tuple[float, float, float] = (1.0, 1.0, 1.08)
    field_class: dict[str, int] = field(default_factory=dict)


def field_weights(fields: list[str], w: Weights) -> dict[str, float]:
    """Weights of mean 1; a field without a class is unimportant."""
    raw = {f: w.fields[w.field_class.get(f, UNIMPORTANT)] for f in fields}
    return {f: x * len(raw) / sum(raw.values()) for f, x in raw.items()}


def idf(term_stats: DataFrame, n_docs: int) -> DataFrame:
    """(term, idf) from the statistics of `object`, whichever field is asked."""
    df = F.col("df")
    return term_stats.where("field = 'object'").select("term", F.greatest(F.lit(EPSILON), F.ln((F.lit(n_docs) - df + 0.5) / (df + 0.5))).alias("idf"))


@dataclass(frozen=True)
class Leaf:
    """What a query asks for: a term, all terms of a prefix, or those of a range (ends included, either may be missing), with a weight."""

    kind: str
    value: object
    weight: float = 1.0

    def holds(self, term: Column) -> Column:
        if self.kind == "prefix":
            return term.startswith(self.value)
        if self.kind == "range":
            lo, hi = self.value
            return (F.lit(True) if lo is None else term >= lo) & (F.lit(True) if hi is None else term <= hi)
        return term == self.value


def score(tokens: DataFrame, sizes: DataFrame, term_stats: DataFrame, terms: list[str | Leaf], fields: list[str], n_docs: int, avgdl: float, w: Weights = Weights(), matches: DataFrame | None = None, priors: DataFrame | None = None) -> DataFrame:
    """(doc_id, score) of the documents that hold a term in one of the fields.  terms: what the query asks for; a leaf's weight
    multiplies the contribution of its terms (of several leaves that hold a term the largest counts); matches: (doc_id) that may score; priors: (doc_id, category).
    Only the postings asked for are read; the statistics of single terms, which are few, are broadcast, those of prefixes and ranges joined."""
    leaves = [x if isinstance(x, Leaf) else Leaf("term", x) for x in terms]
    single = [x.value for x in leaves if x.kind == "term"]
    wanted = reduce(lambda a, b: a | b, [x.holds(F.col("term")) for x in leaves if x.kind != "term"] + ([F.col("term").isin(*single)] if single else []))
    factor_of = reduce(lambda acc, x: F.when(x.holds(F.col("term")), F.lit(float(x.weight))).otherwise(acc), sorted(leaves, key=lambda x: x.weight), F.lit(0.0))
    weight = field_weights(fields, w)
    t = tokens.where(wanted & F.col("field").isin(*fields))
    if matches is not None:
        t = t.join(matches, "doc_id", "left_semi")
    count = t.groupBy("doc_id", "term", "field").agg(F.count(F.lit(1)).alias("n"))
    length = sizes.where("field = 'object'").select("doc_id", "size")
    c = count.join(length, "doc_id", "left")
    norm = F.lit(1.0) if w.b == 1 else F.lit(1 - w.b) + F.lit(w.b) * F.greatest(F.coalesce("size", F.lit(0)), F.lit(w.dl_cutoff)) / F.lit(avgdl)
    wf = F.lit(0.0)
    for f, x in weight.items():
        wf = F.when(F.col("field") == f, F.lit(x)).otherwise(wf)
    vc = c.groupBy("doc_id", "term").agg(F.sum(F.col("n") * wf / norm).alias("vc"))
    asked = idf(term_stats.where(wanted), n_docs)
    s = vc.join(F.broadcast(asked) if len(single) == len(leaves) else asked, "term", "left")
    one = factor_of * F.coalesce("idf", F.lit(0.0)) * F.lit(w.k1 + 1) * F.col("vc") / (F.col("vc") + F.lit(w.k1))
    total = s.groupBy("doc_id").agg(F.sum(one).alias("s"), F.sum(F.when(F.col("vc") > 0, 1).otherwise(0)).alias("m"))
    out = total.select("doc_id", (F.col("s") * w.w_matches * F.least("m", F.lit(w.max_norm)) / w.max_norm).alias("score"))
    if priors is not None:
        factor = F.lit(w.documents[NEUTRAL])
        for k in (UNIMPORTANT, IMPORTANT):
            factor = F.when(F.col("category") == k, F.lit(w.documents[k])).otherwise(factor)
        out = out.join(priors, "doc_id", "left").select("doc_id", (F.col("score") * factor).alias("score"))
    return out


def top(scored: DataFrame, n: int | None, start: int = 0) -> DataFrame:
    """The page of n, or all, from start; equal scores in order of id."""
    if n is None and not start:
        return scored
    page = scored.orderBy(F.desc("score"), "doc_id").offset(start)
    return page if n is None else page.limit(n)


def host_priors(docs: DataFrame, rules: DataFrame, host_col: str = "host") -> DataFrame:
    """(doc_id, category): the highest category of the rules that contain the document's host.  Rules are a small hand-written table."""
    r = rules.select("rule", "category")
    hit = docs.where(F.length(host_col) > 0).join(F.broadcast(r), F.contains(F.col("rule"), F.col(host_col)))
    return hit.groupBy("doc_id").agg(F.max("category").alias("category"))
