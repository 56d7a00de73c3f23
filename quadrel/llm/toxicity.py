"""Operator 6: toxicity by a gap-weighted subsequence kernel with Nystroem landmarks and a linear support vector machine.

A text is a bag of sentences, a sentence a bag of units: its words in lower case with inner punctuation removed
("i.d-i*ot"), runs of single characters joined ("i d i o t"), all framed by marks of their ends; longer words than WIDTH
are overlapping windows.  k(s, t) sums LAMBDA^(spanned length) over common subsequences of ORDER characters, normalised and raised to POWER (a
product of kernels is one), so that gaps and inserted characters lower it without breaking it.  A sentence scores as its best unit does (multiple-instance machine).

Training: labelled documents, at most `max_train` of them by hash of the id.  All sentences of clean documents are
negative; in toxic documents the units that the machine (at first, the log odds of their document frequency) holds for
the reason of the label are positive, also with characters inserted at random; three rounds refit both.  A text is toxic
if units score above `cut` and are at least `min_rate` of its units, both fitted on the training documents.

Defined results: null and empty texts and texts without letters are not toxic, with score null.  Repeated rows score
alike, ties need no rule.  With no toxic label or no labelled text nothing is toxic.  Null ids pass through.  Only the
id and text columns are read.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, map_slices

ORDER, LAMBDA, WIDTH, POWER, GATE, BUCKETS = 3, 0.75, 26, 4, 0.45, 512
SENTENCE = re.compile(r"(?<=[.!?;])\s+|\n+|\s\|\s")
DROP = re.compile(r"[\W_]+")
CACHE = 200_000


@dataclass
class Model:
    landmarks: list[str]
    project: np.ndarray  # Nystroem map: kernel values -> features, already times the weights
    bias: float
    cut: float
    min_rate: float


def units(sentence: str) -> list[str]:
    out: list[str] = []
    single: list[str] = []
    for w in sentence.lower().split():
        if not w.isalnum():
            w = DROP.sub("", w)
            if not w:
                continue
        if len(w) == 1:
            single.append(w)
            continue
        if single:
            if len(single) >= ORDER:
                out.append("".join(single))
            single = []
        out.append(w)
    if len(single) >= ORDER:
        out.append("".join(single))
    most = WIDTH - 2
    return ["\x02" + p + "\x03" for w in out for p in ([w] if len(w) <= most else [w[i : i + most] for i in range(0, len(w) - most // 2, most // 2)])]


def _codes(words: list[str], width: int) -> np.ndarray:
    """Code points, padded with 0 (words) to the longest; longer words were cut into windows before."""
    n = max((len(w) for w in words), default=0)
    return np.frombuffer("".join(w[:width].ljust(min(n, width), "\0") for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), min(n, width)) if words and n else np.zeros((len(words), 1), np.uint32)


def kernel(a: list[str], b: list[str]) -> np.ndarray:
    """Gap-weighted subsequence kernel of ORDER characters, not normalised: (len(a), len(b))."""
    out = np.zeros((len(a), len(b)), np.float32)
    cb = _codes(b, WIDTH)
    cb = np.where(cb == 0, 0xFFFFFFFF, cb)
    t = cb.shape[1]
    gap = np.arange(t)[None, :] - np.arange(t)[:, None] - 1
    tri = np.where(gap >= 0, np.float32(LAMBDA) ** np.maximum(gap, 0), 0).astype(np.float32)  # from position j to later ones
    lam = np.float32(LAMBDA)
    by_len: dict[int, list[int]] = {}
    for i, w in enumerate(a):
        by_len.setdefault(len(w), []).append(i)
    for length, idx in by_len.items():
        if length < ORDER:
            continue
        for at in range(0, len(idx), 256):
            part = idx[at : at + 256]
            ca = _codes([a[i] for i in part], WIDTH)
            n = len(part)
            # prefix[i][:, m, j]: K'_i of the word so far against the first j characters of landmark m
            prefix = [np.ones((n, len(b), t), np.float32), *[np.zeros((n, len(b), t), np.float32) for _ in range(ORDER - 1)]]
            total = np.zeros((n, len(b)), np.float32)
            for p in range(ca.shape[1]):
                eq = (ca[:, p, None, None] == cb[None]).astype(np.float32)
                if p >= ORDER - 1:
                    total += lam * lam * np.einsum("nmj,nmj->nm", eq, prefix[ORDER - 1])
                for i in range(ORDER - 1, 0, -1):
                    if p >= i - 1:
                        prefix[i] *= lam
                        prefix[i] += (lam * lam) * ((eq * prefix[i - 1]).reshape(-1, t) @ tri).reshape(n, len(b), t)
            out[part] = total
    return out


def self_kernel(words: list[str]) -> np.ndarray:
    out = np.zeros(len(words), np.float32)
    for i, w in enumerate(words):
        if len(w) >= ORDER:
            k = [np.ones(len(w) + 1), *[np.zeros(len(w) + 1) for _ in range(ORDER - 1)]]
            c = np.frombuffer(w.encode("utf-32-le", "surrogatepass"), np.uint32)
            total = 0.0
            for x in c:
                eq = np.flatnonzero(c == x)
                total += LAMBDA**2 * k[ORDER - 1][eq].sum()
                for j in range(ORDER - 1, 0, -1):
                    run = np.zeros(len(w) + 1)
                    for q in eq:
                        run[q + 1 :] += LAMBDA**2 * k[j - 1][q] * LAMBDA ** np.arange(len(w) - q)
                    k[j] = LAMBDA * k[j] + run
            out[i] = total
    return out


def _self_fast(words: list[str]) -> np.ndarray:
    """self_kernel for many words of few lengths."""
    out = np.zeros(len(words), np.float32)
    by_len: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_len.setdefault(len(w), []).append(i)
    for length, idx in by_len.items():
        if length < ORDER:
            continue
        c = _codes([words[i] for i in idx], WIDTH)
        t = c.shape[1]
        gap = np.arange(t)[None, :] - np.arange(t)[:, None] - 1
        tri = np.where(gap >= 0, np.float32(LAMBDA) ** np.maximum(gap, 0), 0).astype(np.float32)
        k = [np.ones((len(idx), t), np.float32), *[np.zeros((len(idx), t), np.float32) for _ in range(ORDER - 1)]]
        total = np.zeros(len(idx), np.float32)
        for p in range(t):
            eq = (c[:, p, None] == c).astype(np.float32)
            total += LAMBDA**2 * (eq * k[ORDER - 1]).sum(1)
            for j in range(ORDER - 1, 0, -1):
                k[j] = LAMBDA * k[j] + LAMBDA**2 * ((eq * k[j - 1]) @ tri)
        out[idx] = total
    return out


def _bigrams(words: list[str]) -> np.ndarray:
    """Which hashed pairs of characters, at most two apart, each word has: (n, BUCKETS) of 0 and 1."""
    c = _codes(words, WIDTH).astype(np.int64)
    out = np.zeros((len(words), BUCKETS), np.float32)
    rows = np.arange(len(words))
    for gap in (1, 2, 3):
        for p in range(c.shape[1] - gap):
            both = c[:, p + gap] > 0
            out[rows[both], (c[both, p] * 41 + c[both, p + gap] * 7) % BUCKETS] = 1
    return out


def similarities(words: list[str], landmarks: list[str], own: np.ndarray) -> np.ndarray:
    """Normalised kernel to POWER; 0 for words that share less than GATE of the close character pairs of every landmark."""
    out = np.zeros((len(words), len(landmarks)), np.float32)
    if not words or not landmarks:
        return out
    marks = _bigrams(landmarks).T
    need = GATE * marks.sum(0)
    words = np.array(words, object)
    size = np.array([len(w) for w in words])
    order = np.argsort(size, kind="stable")
    for at in range(0, len(words), 2048):
        part = order[at : at + 2048]
        part = part[(_bigrams(list(words[part])) @ marks >= need).any(1)]
        if len(part):
            out[part] = _similar(list(words[part]), landmarks, own)
    return out


def _similar(words: list[str], landmarks: list[str], own: np.ndarray) -> np.ndarray:
    k = kernel(words, landmarks)
    d = np.sqrt(np.maximum(_self_fast(words), 1e-12))[:, None] * own[None]
    return np.where(d > 1e-5, k / d, 0) ** POWER


class Scorer:
    """Scores units, remembering those seen."""

    def __init__(self, model: Model) -> None:
        self.model, self.seen = model, {}
        self.own = np.sqrt(np.maximum(_self_fast(model.landmarks), 1e-12)) if model.landmarks else np.zeros(0)

    def __call__(self, words: list[str]) -> np.ndarray:
        new = [w for w in set(words) if w not in self.seen]
        if len(self.seen) + len(new) > CACHE:
            self.seen = {}
            new = list(set(words))
        if new:
            self.seen.update(zip(new, (similarities(new, self.model.landmarks, self.own) @ self.model.project + self.model.bias).tolist()))
        seen = self.seen
        return np.array([seen[w] for w in words], np.float32)


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 20.0, rounds: int = 300) -> np.ndarray:
    """Squared-hinge linear machine by Newton steps; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        m = 1 - y * (x @ w)
        on = m > 0
        g = w - c * (x[on] * (weight * y * m)[on, None]).sum(0)
        h = np.eye(len(w)) + c * (x[on].T * weight[on]) @ x[on]
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _insert(unit: str, rng: np.random.Generator) -> str:
    """The unit with one character inserted, or one doubled."""
    at = int(rng.integers(2, max(3, len(unit) - 1)))
    return (unit[:at] + ("xq01zvj"[int(rng.integers(7))] if rng.random() < 0.7 else unit[at - 1]) + unit[at:])[:WIDTH]


def _spread(words: list[str], worth: np.ndarray, n: int) -> list[str]:
    """n words of high worth that are unlike each other."""
    own = np.sqrt(np.maximum(_self_fast(words), 1e-12))
    near, out = np.zeros(len(words)), []
    while len(out) < min(n, len(words)):
        i = int(np.argmax(worth * (1 - near) ** 2))
        out.append(words[i])
        near = np.maximum(near, similarities(words, [words[i]], own[i : i + 1])[:, 0])
        near[i] = 1
    return out


def text_units(text: str | None) -> list[list[str]]:
    return [u for s in SENTENCE.split(text) if (u := units(s))] if text else []


def fit_rows(rows: list[tuple[str | None, int | None]], landmarks: int = 48, rounds: int = 3, c: float = 2e4) -> Model:
    none = Model([], np.zeros(0), -1.0, 0.0, 1.0)
    bags = [(text_units(t), int(y == 1)) for t, y in rows if t and y is not None]
    n1, n0 = sum(y for _, y in bags), sum(1 - y for _, y in bags)
    if not n1 or not n0:
        return none
    in1, in0 = Counter(), Counter()
    for b, y in bags:
        (in1 if y else in0).update({w for s in b for w in s if len(w) >= ORDER})
    odds = {w: np.log((in1[w] + 0.5) / (n1 + 1)) - np.log((in0[w] + 0.5) / (n0 + 1)) for w in in1}
    positive = sorted((w for w in odds if in1[w] >= max(3, 0.004 * n1) and odds[w] > 2.2), key=lambda w: (-in1[w] * odds[w], w))
    if not positive:
        return none
    rng = np.random.default_rng(7)
    negative = sorted(w for w in in0 if w not in set(positive))
    marks = _spread(positive[:600], np.array([min(in1[w], 8) * odds[w] for w in positive[:600]]), landmarks * 3 // 4)
    own = np.sqrt(np.maximum(_self_fast(marks), 1e-12))
    pool = [negative[i] for i in rng.permutation(len(negative))[:60_000]]
    near = similarities(pool, marks, own).max(1)
    hard = [pool[i] for i in np.argsort(-near, kind="stable")[:4000]]
    marks = marks + hard[: landmarks - len(marks)]
    own = np.sqrt(np.maximum(_self_fast(marks), 1e-12))
    kmm = similarities(marks, marks, own).astype(float)
    val, vec = np.linalg.eigh((kmm + kmm.T) / 2)
    ok = val > 1e-6
    half = vec[:, ok] / np.sqrt(val[ok])
    easy = pool[-2000:]
    model = none
    candidates = sorted(w for w in in1 if in1[w] >= 2)
    xc = similarities(candidates, marks, own) @ half
    xp = similarities(pool, marks, own) @ half
    at = {w: i for i, w in enumerate(pool)}
    neg = list(dict.fromkeys(hard + easy))
    where = {w: i for i, w in enumerate(candidates)}
    in_doubt = {w for w in candidates if in0[w] and odds[w] < 2.2}
    spoilt = [_insert(w, rng) for w in positive[:200] for _ in range(6)]
    xs = similarities(spoilt, marks, own) @ half
    ws = np.array([min(in1[w], 20) / 12 for w in positive[:200] for _ in range(6)], float)
    for _ in range(rounds):
        idx = [where[w] for w in positive if w in where and w not in in_doubt]
        x = np.vstack([xc[idx], xs, xp[[at[w] for w in neg]]])
        y = np.concatenate([np.ones(len(idx) + len(xs)), -np.ones(len(neg))])
        wp, wn = np.concatenate([[min(float(in1[candidates[i]]), 20.0) for i in idx], ws]), np.minimum(1.0 + np.array([in0[w] for w in neg]), 20)
        w = _svm(x, y, np.concatenate([0.5 * wp / wp.sum(), 1.5 * wn / wn.sum()]), c=c)
        model = Model(marks, (half @ w[:-1]).astype(np.float32), float(w[-1]), 0.0, 0.0)
        f = xc @ w[:-1] + w[-1]
        neg = list(dict.fromkeys(neg + [pool[i] for i in np.argsort(-(xp @ w[:-1]), kind="stable")[:3000]]))
        positive = [c for c, v in zip(candidates, f) if v > 0 and odds[c] > 1.5] or positive
    score = Scorer(model)
    docs, truth = [], []
    for b, y in bags:
        if flat := [w for s in b for w in s]:
            f = score(flat)
            docs.append((np.sort(f[f > 0])[::-1], len(flat)))
            truth.append(y)
    t = np.array(truth, bool)
    best = (np.inf, 0.0, 1.0)
    for cut in np.arange(0.0, 1.5, 0.05):
        rate = np.array([(f > cut).sum() / n for f, n in docs])
        for least in (0.0, 0.002, 0.005, 0.01, 0.02, 0.03, 0.05):
            said = (rate > 0) & (rate >= least)
            # a clean document's loss counts twice
            best = min(best, (2 * int((said & ~t).sum()) + int((~said & t).sum()), -float(cut), least))
    model.cut, model.min_rate = -best[1], best[2]
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = 4000, landmarks: int = 48) -> Model:
    """max_train: the number of labelled documents that the machine learns from."""
    ids = labels.select(col(id_col).alias("i"), col(label_col).alias("y")).where("i is not null and y is not null").groupBy("i").agg(F.max("y").alias("y"))
    pick = ids.orderBy(F.xxhash64("i"), "i").limit(max_train)  # the bound of the sample; ids only are sorted
    rows = docs.select(col(id_col).alias("i"), col(text_col).alias("t")).join(F.broadcast(pick), "i").select("i", "t", "y").collect()
    return fit_rows([(r["t"], r["y"]) for r in sorted(rows, key=lambda r: (r["i"], r["t"] or ""))], landmarks)


def judge(scorer: Scorer, texts: list[str | None]) -> tuple[list[float | None], list[int], list[bool]]:
    """Best sentence's score, number of units above the cut, decision."""
    m = scorer.model
    flat: list[str] = []
    size = []
    for t in texts:
        n = len(flat)
        if t and m.landmarks:
            for s in SENTENCE.split(t):
                flat += units(s)
        size.append(len(flat) - n)
    f = scorer(flat) if flat else np.zeros(0)
    best, hits, toxic, at = [], [], [], 0
    for n in size:
        part = f[at : at + n]
        at += n
        h = int((part > m.cut).sum())
        best.append(round(float(part.max()), 4) if n else None)
        hits.append(h)
        toxic.append(bool(h and h / n >= m.min_rate))
    return best, hits, toxic


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, hits, toxic) of every row."""
    holder: list[Scorer] = []

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        if not holder:
            holder.append(Scorer(model))
        best, hits, toxic = judge(holder[0], b.column(1).to_pylist())
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(best, pa.float64()), pa.array(hits, pa.int32()), pa.array(toxic, pa.bool_())], ["doc_id", "score", "hits", "toxic"])

    df = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("t"))
    return map_slices(df, run, "doc_id long, score double, hits int, toxic boolean", 512)


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs without the toxic rows, all columns as they were."""
    at = docs.columns.index(text_col)
    holder: list[Scorer] = []

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        if not holder:
            holder.append(Scorer(model))
        return b.filter(pa.array([not t for t in judge(holder[0], b.column(at).to_pylist())[2]], pa.bool_()))

    return map_slices(docs, run, docs.schema, 512)
