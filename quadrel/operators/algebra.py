"""Retrieval algebra.  Positional operands are spans (field, doc_id, l, r); documents are (doc_id)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["field", "doc_id"]


def _in(tokens: DataFrame, fields: list[str] | None) -> DataFrame:
    return tokens if fields is None else tokens.where(F.col("field").isin(*fields)) if fields else tokens.limit(0)


def _spans(tokens: DataFrame) -> DataFrame:
    return tokens.select("field", "doc_id", F.col("pos").alias("l"), F.col("pos").alias("r"))


def term(tokens: DataFrame, t: str, fields: list[str] | None = None) -> DataFrame:
    return _spans(_in(tokens, fields).where(F.col("term") == t))


def multi_term(tokens: DataFrame, ts: list[str], fields: list[str] | None = None) -> DataFrame:
    return _spans(_in(tokens, fields).where(F.col("term").isin(*ts)))


def prefix(tokens: DataFrame, p: str, fields: list[str] | None = None) -> DataFrame:
    return _spans(_in(tokens, fields).where(F.col("term").startswith(p)))


def term_range(tokens: DataFrame, low: str | None, high: str | None, fields: list[str] | None = None) -> DataFrame:
    t = _in(tokens, fields)
    if low is not None:
        t = t.where(F.col("term") >= low)
    return _spans(t if high is None else t.where(F.col("term") <= high))


def docs(spans: DataFrame) -> DataFrame:
    return spans.select("doc_id").distinct()


def all_docs(ids: DataFrame) -> DataFrame:
    return ids.select("doc_id").distinct()


def no_docs(ids: DataFrame) -> DataFrame:
    return ids.select("doc_id").limit(0)


def and_(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.join(b, "doc_id", "left_semi"), parts)


def or_(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts).distinct()


def not_(ids: DataFrame, part: DataFrame) -> DataFrame:
    return all_docs(ids).join(part, "doc_id", "left_anti")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, "doc_id", "left_anti")


def span_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Spans of a that contain no span of b."""
    inner = b.select(*KEYS, F.col("l").alias("bl"), F.col("r").alias("br"))
    return a.join(inner, [a[k] == inner[k] for k in KEYS] + [F.col("bl") >= a["l"], F.col("br") <= a["r"]], "left_anti")


def or_spans(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts).distinct()


def consecutive(parts: list[DataFrame]) -> DataFrame:
    """Spans that follow each other without a gap.  Single positions meet in one shuffle: each votes for the start it implies, as a bit of its
    operand (a count of distinct operands would shuffle the votes twice)."""
    n = len(parts)
    votes = [p.where("l = r").select(*KEYS, (F.col("l") - i).alias("l"), *[F.lit(1 << i % 62 if i // 62 == k else 0).cast("long").alias(f"b{k}") for k in range(-(-n // 62))]) for i, p in enumerate(parts)]
    masks = [f"b{k}" for k in range(-(-n // 62))]
    start = reduce(lambda a, b: a.unionByName(b), votes).groupBy(*KEYS, "l").agg(*[F.bit_or(m).alias(m) for m in masks])
    for k, m in enumerate(masks):
        start = start.where(F.col(m) == F.lit((1 << min(62, n - 62 * k)) - 1))
    return start.select(*KEYS, "l", (F.col("l") + n - 1).alias("r"))


def ordered(parts: list[DataFrame]) -> DataFrame:
    """The operands one after the other: for each start the nearest end."""
    out = parts[0]
    for p in parts[1:]:
        nxt = p.select(*KEYS, F.col("l").alias("nl"), F.col("r").alias("nr"))
        out = out.join(nxt, KEYS).where("nl > r").groupBy(*KEYS, "l").agg(F.min("nr").alias("r"))
    return out


def low_pass(parts: list[DataFrame], k: int) -> DataFrame:
    """Spans of at most k positions that hold all operands: for each left end the shortest."""
    tagged = [p.select(*KEYS, "l", "r", F.lit(i).alias("i")) for i, p in enumerate(parts)]
    got = reduce(lambda a, b: a.unionByName(b), tagged).groupBy(*KEYS).agg(F.collect_list(F.struct("l", "r", "i")).alias("x"), F.count_distinct("i").alias("n")).where(F.col("n") == len(parts))
    starts = got.withColumn("s", F.explode(F.array_distinct(F.transform("x", lambda y: y["l"]))))

    def nearest(i: int):
        return F.array_min(F.transform(F.filter("x", lambda y: (y["i"] == i) & (y["l"] >= F.col("s"))), lambda y: y["r"]))

    ends = [nearest(i) for i in range(len(parts))]
    end = F.when(reduce(lambda a, b: a & b, [e.isNotNull() for e in ends]), F.greatest(*ends) if len(ends) > 1 else ends[0])
    return starts.select(*KEYS, F.col("s").alias("l"), end.alias("r")).where(F.col("r") - F.col("l") < k)


def align(a: DataFrame, b: DataFrame) -> DataFrame:
    """Spans of a with a span of b at the same place in a parallel field."""
    other = b.select("doc_id", "l", "r").distinct()
    return a.join(other, ["doc_id", "l", "r"], "left_semi").select(*KEYS, "l", "r")


def select(spans: DataFrame, field: str) -> DataFrame:
    return spans.where(F.col("field") == field)


def remap(spans: DataFrame, names: dict[str, str]) -> DataFrame:
    """Spans with fields renamed."""
    out = F.col("field")
    for a, b in names.items():
        out = F.when(F.col("field") == a, F.lit(b)).otherwise(out)
    return spans.withColumn("field", out)
