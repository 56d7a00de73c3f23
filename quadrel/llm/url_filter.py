"""Operator 8: exact URL filter by a cascade of Bloom filters.

The universe is every distinct URL key of the corpus; some keys are listed.  Level 1 encodes the listed keys; the keys of
the universe that pass it wrongly are encoded in level 2, the listed ones among them that pass level 2 wrongly in level
3, and so on until no error is left.  A key of the universe is listed exactly if the first level that it doesn't pass is
even.  The cascade is built by hash bucket of the key, so each bucket is one small task whatever the number of keys, and
it is read without a join: it goes to the tasks as a broadcast while it is below `broadcast_mb`, beyond that the pages are
routed to their buckets, with the same answers.

Keys are compared by 128 bits of hash (two 64-bit hashes), which stands for the key itself.

Defined results: a null or empty URL, or one without a host, has no key; its `listed` is null.  Repeated rows and URLs with the
same key get the same answer.  With no page the cascade has no bucket and the result is empty; with no listed key every
key is answered false.  Only the id and URL columns are read; ids must be integers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, map_slices, written

#: Listed hosts of the default rule (with all their subdomains).
LISTED_HOSTS = ("spam-farm.example.org", "cheap-pills.example.com", "casino-win.example.net", "click-bait.example.com", "adult-zone.example.net", "malware-host.example.org")
TRACKING = r"(?:utm_[a-z]+|ref|fbclid|gclid|session|sid)"
SCHEMA = "bucket long, levels array<struct<bits:binary,m:long,k:int>>"


def url_key(url: Column) -> Column:
    """host/path?query in lower-case host, without scheme, www., user, default port, fragment, tracking parameters and last slash."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.lower(F.regexp_extract(u, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))
    port = F.regexp_extract(u, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?[^/?#:]+:(\d+)", 1)
    path = F.regexp_replace(F.regexp_extract(u, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*([^?#]*)", 1), "/+$", "")
    query = F.regexp_extract(u, r"\?(.*)$", 1)
    query = F.regexp_replace(F.regexp_replace(query, "(^|&)" + TRACKING + "=[^&]*", ""), "^&", "")
    key = F.concat(F.regexp_replace(host, r"^www\.", ""), F.when(port.isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), port)), path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(F.length(host) > 0, key)


def key_host(key: Column) -> Column:
    return F.regexp_extract(key, r"^([^/?:]*)", 1)


def listed_host(key: Column, hosts: tuple[str, ...] = LISTED_HOSTS) -> Column:
    h = key_host(key)
    hit = F.lit(False)
    for x in hosts:
        hit = hit | (h == x) | h.endswith("." + x)
    return hit


def _positions(h1: np.ndarray, h2: np.ndarray, level: int, m: int, k: int) -> np.ndarray:
    """(k, n) bit positions: double hashing, salted by the level."""
    salt = [np.uint64((level + 1) * c & 0xFFFFFFFFFFFFFFFF) for c in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)]
    a = (h1.astype(np.uint64) ^ salt[0]) * np.uint64(0xBF58476D1CE4E5B9)
    b = (h2.astype(np.uint64) + salt[1]) * np.uint64(0x94D049BB133111EB)
    a, b = a ^ (a >> np.uint64(31)), (b ^ (b >> np.uint64(29))) | np.uint64(1)
    return (a[None] + np.arange(k, dtype=np.uint64)[:, None] * b[None]) % np.uint64(m)


def _passes(bits: np.ndarray, pos: np.ndarray) -> np.ndarray:
    return ((bits[pos >> np.uint64(3)] >> (pos & np.uint64(7)).astype(np.uint8)) & 1).all(0)


def build_levels(h1: np.ndarray, h2: np.ndarray, listed: np.ndarray, rate: float = 0.3) -> list[dict]:
    """Levels for one bucket of distinct keys."""
    h1, h2 = h1.view(np.uint64), h2.view(np.uint64)
    inside, outside, levels = np.flatnonzero(listed), np.flatnonzero(~listed), []
    while len(inside):
        n = len(inside)
        p = rate if levels else min(0.5, max(1e-4, n / max(1, len(outside)) * rate))
        m, k = max(64, int(np.ceil(-n * np.log(p) / np.log(2) ** 2))), max(1, round(-np.log2(p)))
        bits = np.zeros((m + 7) // 8, np.uint8)
        pos = _positions(h1[inside], h2[inside], len(levels), m, k).ravel()
        np.bitwise_or.at(bits, (pos >> np.uint64(3)).astype(np.int64), np.uint8(1) << (pos & np.uint64(7)).astype(np.uint8))
        wrong = outside[_passes(bits, _positions(h1[outside], h2[outside], len(levels), m, k))]
        levels.append({"bits": bits.tobytes(), "m": m, "k": k})
        inside, outside = wrong, inside
    return levels


def probe(levels: list[dict], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    h1, h2 = h1.view(np.uint64), h2.view(np.uint64)
    left, out = np.arange(len(h1)), np.zeros(len(h1), bool)
    for i, level in enumerate(levels):
        ok = _passes(np.frombuffer(level["bits"], np.uint8), _positions(h1[left], h2[left], i, level["m"], level["k"]))
        out[left[~ok]] = i % 2 == 1
        left = left[ok]
    out[left] = len(levels) % 2 == 1
    return out


def _hashed(pages: DataFrame, key: Column, keep: list[Column], buckets: int) -> DataFrame:
    k = pages.select(*keep, key.alias("key"))
    h = k.withColumn("h1", F.xxhash64("key")).withColumn("h2", F.xxhash64(F.lit(17), F.col("key")))
    return h.withColumn("bucket", F.when(F.col("key").isNotNull(), F.pmod("h1", F.lit(buckets))))


def build(pages: DataFrame, url_col: str = "url", hosts: tuple[str, ...] = LISTED_HOSTS, listed: DataFrame | None = None, bucket_keys: int = 200_000) -> tuple[DataFrame, int]:
    """The cascade (SCHEMA) over all keys of pages, and its number of buckets.  listed: a table with a column `key` of listed
    keys instead of hosts; keys outside the universe don't count."""
    n = pages.count()
    buckets = max(1, -(-n // bucket_keys))
    keys = _hashed(pages, url_key(col(url_col)), [], buckets).where("key is not null")
    keys = keys.withColumn("listed", listed_host(F.col("key"), hosts).cast("int")) if listed is None else keys.withColumn("listed", F.lit(0)).unionByName(_hashed(listed, F.col("key"), [], buckets).where("key is not null").withColumn("listed", F.lit(2)))
    distinct = keys.groupBy("bucket", "h1", "h2").agg(F.max("listed").alias("top"), F.min("listed").alias("low")).select("bucket", "h1", "h2", F.when(F.col("low") == 2, None).otherwise(F.col("top") > 0).alias("listed")).where("listed is not null")

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h1", "h2"])
        return pd.DataFrame({"bucket": [int(pdf.bucket.iloc[0])], "levels": [build_levels(pdf.h1.to_numpy(), pdf.h2.to_numpy(), pdf.listed.to_numpy().astype(bool))]})

    return written(distinct.groupBy("bucket").applyInPandas(make, SCHEMA), "cascade"), buckets


def apply_filter(pages: DataFrame, cascade: DataFrame, buckets: int, id_col: str = "page_id", url_col: str = "url", broadcast_mb: float = 64, group_rows: int = 500_000) -> DataFrame:
    """(page_id, url_key, listed) of every row."""
    rows = _hashed(pages, url_key(col(url_col)), [col(id_col).cast("long").alias("page_id")], buckets)
    size = cascade.select(F.sum(F.aggregate("levels", F.lit(0).cast("long"), lambda a, x: a + F.length(x["bits"]))).alias("n")).first()["n"] or 0
    out = "page_id long, url_key string, listed boolean"

    def answer(levels: dict, b: pa.RecordBatch) -> pa.RecordBatch:
        names = b.schema.names
        bucket = b.column(names.index("bucket")).fill_null(-1).to_numpy(zero_copy_only=False)
        h1, h2 = (b.column(names.index(c)).to_numpy(zero_copy_only=False) for c in ("h1", "h2"))
        hit = np.zeros(b.num_rows, bool)
        for x in np.unique(bucket):
            if x >= 0:
                at = np.flatnonzero(bucket == x)
                hit[at] = probe(levels.get(int(x), []), np.ascontiguousarray(h1[at]), np.ascontiguousarray(h2[at]))
        return pa.RecordBatch.from_arrays([b.column(names.index("page_id")), b.column(names.index("key")), pa.array(hit, pa.bool_(), mask=bucket < 0)], ["page_id", "url_key", "listed"])

    if size <= broadcast_mb * 1e6:
        whole = pages.sparkSession.sparkContext.broadcast({r["bucket"]: [x.asDict() for x in r["levels"]] for r in cascade.collect()})
        return map_slices(rows, lambda b: answer(whole.value, b), out, 50_000)

    # beyond that a bucket's pages go where its levels are, in groups of at most about group_rows, each with a copy of the levels: one URL may hold any share of the rows
    of = rows.where("bucket is not null")
    cut = of.groupBy("bucket").agg(F.ceil(F.count("*") / group_rows).cast("int").alias("s"))
    sent = of.join(cut.hint("merge"), "bucket").withColumn("part", F.pmod(F.xxhash64("page_id", F.monotonically_increasing_id()), F.col("s")).cast("int")).drop("s")
    copies = cascade.join(cut.hint("merge"), "bucket").select("bucket", "levels", F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("part"))

    def routed(left: pa.Table, right: pa.Table) -> pa.Table:
        levels = {b: x for b, x in zip(right["bucket"].to_pylist(), right["levels"].to_pylist())}
        got = [answer(levels, b) for b in left.combine_chunks().to_batches()]
        return pa.Table.from_batches(got, got[0].schema if got else pa.schema([("page_id", pa.int64()), ("url_key", pa.string()), ("listed", pa.bool_())]))

    some = sent.groupBy("bucket", "part").cogroup(copies.groupBy("bucket", "part")).applyInArrow(routed, out)
    return some.unionByName(rows.where("bucket is null").select("page_id", F.col("key").alias("url_key"), F.lit(None).cast("boolean").alias("listed")))


ORACLE = """
WITH a AS (SELECT page_id, regexp_replace(trim(url), '#.*$', '') AS u FROM pages),
b AS (SELECT page_id,
  lower(regexp_extract(u, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host,
  regexp_extract(u, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?[^/?#:]+:(\\d+)', 1) AS port,
  regexp_replace(regexp_extract(u, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*([^?#]*)', 1), '/+$', '') AS path,
  regexp_replace(regexp_replace(regexp_extract(u, '\\?(.*)$', 1), '(^|&)(?:utm_[a-z]+|ref|fbclid|gclid|session|sid)=[^&]*', '', 'g'), '^&', '') AS query FROM a),
c AS (SELECT page_id, CASE WHEN length(host) > 0 THEN regexp_replace(host, '^www\\.', '') || CASE WHEN port IN ('', '80', '443') THEN '' ELSE ':' || port END || path || CASE WHEN query = '' THEN '' ELSE '?' || query END END AS url_key FROM b)
SELECT page_id, url_key, CASE WHEN url_key IS NULL THEN NULL ELSE regexp_matches(regexp_extract(url_key, '^([^/?:]*)', 1), '(^|\\.)(HOSTS)$') END AS listed FROM c
""".replace("HOSTS", "|".join(h.replace(".", r"\.") for h in LISTED_HOSTS))
