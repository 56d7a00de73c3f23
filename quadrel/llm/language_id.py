"""Operator 2: nearest-centroid language identification.

Every text becomes a normalised TF-IDF vector of hashed byte trigrams of its letters; each language has several
spherical k-means centroids; a text goes to the language of the nearest centroid by cosine, unless its distance exceeds
what labelled texts of about the same length show, in which case it is rejected.

Document frequencies are counted over all texts.  Only the centroids and distance limits are fitted on a sample of
labelled rows, bounded by `max_train` texts per language (chosen by hash of the text) and `max_languages` languages.

Defined results: a null, empty or letterless text has no language (`lang_id` null, `rejected` true, `distance` 1).  A
null `doc_id` passes through.  Repeated rows are classified one by one, alike.  A tie between centroids goes to the
language that sorts first.  With no labelled text every row is rejected.  Only `id_col` and `text_col` are read; further
columns, whatever their names, play no part.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, map_slices

BITS = 12
DIM = 1 << BITS
NOT_LETTERS = re.compile(r"[\W\d_]+")
LENGTH_EDGES = (8, 16, 32, 64, 128, 256, 512, 1024)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # (k, DIM)
    owner: np.ndarray  # language index of each centroid
    limits: np.ndarray  # (languages, length bands)


def _grams(text: str | None) -> np.ndarray | None:
    """Hashed trigrams of the letters, words separated and framed by one space."""
    if not text:
        return None
    b = np.frombuffer((" " + NOT_LETTERS.sub(" ", text.lower()).strip() + " ").encode("utf-8", "surrogatepass"), np.uint8)
    if len(b) < 3:
        return None
    b = b.astype(np.uint32)
    h = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA6B)) ^ (b[2:] * np.uint32(0xC2B2AE35))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return h >> np.uint32(32 - BITS)


def counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Term counts (n, DIM) and the number of trigrams of each text."""
    x, n = np.zeros((len(texts), DIM), np.float32), np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        if (g := _grams(t)) is not None:
            x[i] = np.bincount(g, minlength=DIM)
            n[i] = len(g)
    return x, n


def weigh(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Sublinear TF times IDF, rows of length 1 (or 0)."""
    v = np.log1p(x) * idf
    norm = np.sqrt((v * v).sum(1, keepdims=True))
    return v / np.where(norm > 0, norm, 1)


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """Over all texts: in how many each hashed trigram occurs, and the number of texts with any."""

    def run(batches):
        df, n = np.zeros(DIM, np.int64), 0
        for b in batches:
            for i in range(0, b.num_rows, 256):
                x, length = counts(b.column(0).slice(i, 256).to_pylist())
                df += (x > 0).sum(0)
                n += int((length > 0).sum())
        yield pa.RecordBatch.from_pydict({"term": pa.array(np.arange(DIM + 1), pa.int32()), "n": pa.array(np.append(df, n), pa.int64())})

    rows = docs.select(col(text_col).alias("t")).mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(DIM + 1, np.int64)
    for r in rows:
        out[r["term"]] = r["n"]
    return out[:DIM], int(out[DIM])


def _kmeans(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means, started at the farthest points."""
    c = [v.mean(0) / max(np.linalg.norm(v.mean(0)), 1e-9)]
    while len(c) < min(k, len(v)):
        c.append(v[int(np.argmin((v @ np.array(c).T).max(1)))])
    m = np.array(c)
    for _ in range(rounds):
        near = (v @ m.T).argmax(1)
        for j in range(len(m)):
            if (near == j).any():
                s = v[near == j].sum(0)
                m[j] = s / max(np.linalg.norm(s), 1e-9)
    return m


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", clusters: int = 4, max_train: int = 400, max_languages: int = 200, quantile: float = 0.99, slack: float = 0.15) -> Model:
    """max_train: different labelled texts per language for the centroids, max_languages: languages learnt, those of most rows; they bound what the driver gets.
    A distance limit is the quantile of the training distances of its length band, and `slack` of the way from there to 1."""
    df, n = document_frequencies(docs, text_col)
    idf = np.log((n + 1) / (df + 1)).astype(np.float32) + 1
    named = docs.select(col(text_col).alias("t"), col(lang_col).alias("l")).where("l is not null and t is not null and length(t) > 0")
    counted = named.groupBy("l").count().orderBy(F.desc("count"), "l").limit(max_languages)
    langs = sorted(r["l"] for r in counted.collect())
    # the max_train smallest hashes of each language; a text that is repeated counts once and is fetched once
    pick = named.select("l", F.xxhash64("t").alias("h")).distinct()
    cut = pick.where(F.col("l").isin(langs)).withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy("h"))).where(F.col("r") == max_train).select("l", "h").collect()
    top = {r["l"]: r["h"] for r in cut}
    within = F.lit(False)
    for lang in langs:
        within = within | ((F.col("l") == F.lit(lang)) & (F.xxhash64("t") <= F.lit(top[lang]) if lang in top else F.col("l") == F.lit(lang)))
    sample = named.where(within).select("l", "t", F.xxhash64("t").alias("h")).dropDuplicates(["l", "h"]).select("l", "t").collect() if langs else []
    cents, owner, limits, kept = [], [], [], []
    own: dict[str, set[str]] = {}
    for r in sample:
        own.setdefault(r["l"], set()).add(r["t"])
    data = {}
    for lang in langs:
        x, length = counts(sorted(own.get(lang, ())))
        if (length > 0).any():
            data[lang] = (weigh(x[length > 0], idf), length[length > 0])
            kept.append(lang)
            c = _kmeans(data[lang][0], clusters)
            cents.append(c)
            owner += [len(kept) - 1] * len(c)
    if not kept:
        return Model([], idf, np.zeros((0, DIM), np.float32), np.zeros(0, int), np.zeros((0, len(LENGTH_EDGES) + 1)))
    for i, lang in enumerate(kept):
        v, length = data[lang]
        d = 1 - (v @ cents[i].T).max(1)
        band = np.searchsorted(LENGTH_EDGES, length)
        row = []
        for j in range(len(LENGTH_EDGES) + 1):
            near = d[np.abs(band - j) <= 1]
            row.append(np.quantile(near, quantile) if len(near) >= 20 else 1.0 if j < 3 else d.max())
        # a shorter text is never held to a closer limit than a longer one
        q = np.maximum.accumulate(np.array(row)[::-1])[::-1]
        limits.append(q + slack * (1 - q))
    return Model(kept, idf, np.concatenate(cents).astype(np.float32), np.array(owner), np.array(limits))


def classify(model: Model, texts: list[str | None]) -> tuple[list[str | None], np.ndarray, np.ndarray]:
    x, n = counts(texts)
    if not model.languages or not len(texts):
        return [None] * len(texts), np.ones(len(texts)), np.ones(len(texts), bool)
    sim = weigh(x, model.idf) @ model.centroids.T
    best = sim.argmax(1)
    lang, d = model.owner[best], 1 - sim[np.arange(len(texts)), best].astype(float)
    rejected = (n == 0) | (d > model.limits[lang, np.searchsorted(LENGTH_EDGES, n)])
    return [model.languages[j] if m else None for j, m in zip(lang, n > 0)], np.where(n > 0, d, 1.0), rejected


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_id, distance, rejected) of every row."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        lang, d, rejected = classify(model, b.column(1).to_pylist())
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(np.round(d, 6), pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "lang_id", "distance", "rejected"])

    df = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("t"))
    return map_slices(df, run, "doc_id long, lang_id string, distance double, rejected boolean", 256)


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs without the rejected rows, `lang` being the language found; all other columns as they were."""
    at, lang_at = docs.columns.index(text_col), docs.columns.index(lang_col)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        lang, _, rejected = classify(model, b.column(at).to_pylist())
        cols = [pa.array(lang, pa.string()) if i == lang_at else c for i, c in enumerate(b.columns)]
        return pa.RecordBatch.from_arrays(cols, b.schema.names).filter(pa.array(~rejected))

    return map_slices(docs, run, docs.schema, 256)
