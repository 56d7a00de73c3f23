"""Operator 1: line dedup by pairwise alignment.

1. Every line is hashed (white space at its ends apart).  Keys are the lines of at least `anchor_words` words, and the windows: from each
   line on, and back from each line, the fewest lines of at least `block_words` words together, blank ones apart.  A key counts if more than one document has it.
2. A window that an earlier document has is deleted.  Windows of both directions cover every line of every run of whole lines of at least `block_words` words
   that any earlier document holds line by line, however many documents share it.
3. For each rare key (at most `rare` occurrences) the first document that holds it (smallest id) is paired with every later one.  Each pair is
   aligned with patience diff: lines that are unique in both and common to both, their longest increasing run, then the same between
   neighbours, ends extended line by line.  So blocks are found between whose lines the earlier document has others.
4. The aligned lines of a pair form runs in the later document (blank lines join a run); a run of at least `block_words` words is deleted.  Runs are judged
   pair by pair, then all that is to be deleted is united.  The earlier document keeps its text.

Defined results: rows whose id or text is null are returned as they are, with 0 lines removed.  An empty text has no
lines to share.  Rows with the same id and the same text are one document and keep or lose the same lines; rows with the
same id and different texts are ordered by the hash of the text.  A text that loses all its lines becomes empty.  Further
columns pass through whatever their names; working columns, the count too, take names that the table doesn't have (a `_` is added).  Ids must be integers.
"""

from __future__ import annotations

from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, free_name, written


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of pairs (sorted by the first) that also increases in the second."""
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tops, b)
        if k == len(tops):
            tops.append(b)
            at.append(i)
        else:
            tops[k], at[k] = b, i
        back[i] = at[k - 1] if k else -1
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions of equal lines of a and b."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        in_a: dict[int, int] = {}
        for i in range(a0, a1):
            in_a[a[i]] = -1 if a[i] in in_a else i
        in_b: dict[int, int] = {}
        for j in range(b0, b1):
            in_b[b[j]] = -1 if b[j] in in_b else j
        unique = sorted((i, in_b[h]) for h, i in in_a.items() if i >= 0 and in_b.get(h, -1) >= 0)
        chain = _increasing(unique)
        if not chain:
            continue
        out += chain
        for (i, j), (p, q) in zip([(a0 - 1, b0 - 1), *chain], [*chain, (a1, b1)]):
            todo.append((i + 1, p, j + 1, q))
    return sorted(out)


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(i, h, hs): id, hash of the text, hashes of its lines (0 for a blank one), words of each line."""
    d = docs.select(col(id_col).cast("long").alias("i"), col(text_col).cast("string").alias("t")).where("i is not null and t is not null and length(t) > 0")

    def run(batches):
        import xxhash

        for b in batches:
            text = b.column(1)
            hs, ws = [], []
            for s in range(0, b.num_rows, 256):
                for t in text.slice(s, 256).to_pylist():
                    h, w = [], []
                    for line in t.split("\n"):
                        n = len(line.split())
                        h.append(xxhash.xxh3_64_intdigest(line.strip().encode("utf-8", "surrogatepass")) - (1 << 63) if n else 0)
                        w.append(n)
                    hs.append(h)
                    ws.append(w)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(hs, pa.list_(pa.int64())), pa.array(ws, pa.list_(pa.int32()))], ["i", "h", "hs", "ws"])

    return d.select("i", "t", F.xxhash64("t").alias("h")).mapInArrow(run, "i long, h long, hs array<long>, ws array<int>")


def windows(hs: list[int], ws: list[int], block_words: int) -> list[tuple[int, int, int]]:
    """(hash, first line, line after the last) of the fewest lines on from each one, and back from each one, that have block_words words, blank ones apart."""
    import xxhash

    on = [k for k, w in enumerate(ws) if w]
    spans: set[tuple[int, int]] = set()
    e, words = 0, 0
    for s, k in enumerate(on):
        while e < len(on) and words < block_words:
            words += ws[on[e]]
            e += 1
        if words < block_words:
            break
        spans.add((s, e))
        words -= ws[k]
    s, words = 0, 0
    for e, k in enumerate(on):
        words += ws[k]
        while words - ws[on[s]] >= block_words:
            words -= ws[on[s]]
            s += 1
        if words >= block_words:
            spans.add((s, e + 1))
    key = lambda s, e: hs[on[s]] if e == s + 1 else xxhash.xxh3_64_intdigest(b"".join(hs[x].to_bytes(8, "little", signed=True) for x in on[s:e])) - (1 << 63)
    return [(key(s, e), on[s], on[e - 1] + 1) for s, e in sorted(spans)]


def long_runs(hit: set[int], ws: list[int], block_words: int) -> list[int]:
    """The lines of runs of hits (blank lines join a run) that have block_words words."""
    keep: list[int] = []
    j = 0
    while j < len(ws):
        if j not in hit:
            j += 1
            continue
        k, last = j, j
        while k < len(ws) and (k in hit or not ws[k]):
            last = k if k in hit else last
            k += 1
        if sum(ws[j : last + 1]) >= block_words:
            keep += range(j, last + 1)
        j = k
    return keep


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", anchor_words: int = 8, block_words: int = 20, rare: int = 100) -> DataFrame:
    """(i, h, gone): the line numbers that each document (by id and hash of the text) loses."""
    seqs = written(_lines(docs, id_col, text_col), "lines").dropDuplicates(["i", "h"])

    def keys(batches):
        for b in batches:
            cols: list[list] = [[] for _ in range(5)]
            for i, h, hs, ws in zip(*(c.to_pylist() for c in b.columns)):
                found = windows(hs, ws, block_words)
                seen = {x for x, _, _ in found}
                for x, s, e in found + [(x, 0, 0) for x in {x for x, w in zip(hs, ws) if w >= anchor_words} - seen]:
                    for c, v in zip(cols, (x, i, h, s, e)):
                        c.append(v)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["line", "i", "h", "s", "e"])

    occ = seqs.select("i", "h", "hs", "ws").mapInArrow(keys, "line long, i long, h long, s int, e int").select("line", F.struct("i", "h").alias("d"), "s", "e")
    first = occ.groupBy("line").agg(F.min("d").alias("first"), F.max("d").alias("last"), F.count("*").alias("n")).where("first != last").select("line", "first", (F.col("n") <= rare).alias("rare"))
    shared = written(occ.join(first, "line").where("d != first").select("first", "d", "s", "e", "rare"), "shared")
    pairs = shared.where("rare").select("first", "d").distinct()
    one = seqs.select(F.struct("i", "h").alias("first"), F.col("hs").alias("a"))
    two = seqs.select(F.struct("i", "h").alias("d"), F.col("hs").alias("b"), "ws")
    both = pairs.join(one, "first").join(two, "d").select("d", "a", "b", "ws")

    def align(batches):
        for b in batches:
            got = [long_runs({j for _, j in patience(x, y) if y[j]}, w, block_words) for x, y, w in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.list_(pa.int32()))], ["d", "hit"])

    runs = both.mapInArrow(align, "d struct<i:long,h:long>, hit array<int>").where("size(hit) > 0")
    whole = shared.where("e > s").select("d", F.sequence("s", F.col("e") - 1).alias("hit"))
    return runs.unionByName(whole).groupBy("d").agg(F.array_distinct(F.flatten(F.collect_list("hit"))).alias("gone")).select("d.i", "d.h", "gone")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", anchor_words: int = 8, block_words: int = 20, rare: int = 100, count_col: str | None = "lines_removed") -> DataFrame:
    """docs with the shared blocks deleted from the later documents, and the number of lines deleted in `count_col`."""
    gone = written(removals(docs, id_col, text_col, anchor_words, block_words, rare), "gone")
    i, h, g = free_name(docs, "_i"), free_name(docs, "_h"), free_name(docs, "_gone")
    side = gone.select(F.col("i").alias(i), F.col("h").alias(h), F.col("gone").alias(g))
    text = col(text_col).cast("string")
    # the same join at every size: a broadcast side would grow with the table
    keyed = docs.select(*[col(c) for c in docs.columns], col(id_col).cast("long").alias(i), F.xxhash64(text).alias(h))
    j = keyed.join(side.hint("merge"), [i, h], "left")
    left = F.array_join(F.filter(F.split(text, "\n", -1), lambda _, k: ~F.array_contains(g, k)), "\n")
    cols = [F.when(F.col(g).isNull(), text).otherwise(left).alias(c) if c == text_col else col(c) for c in docs.columns]
    if count_col:
        cols.append(F.coalesce(F.size(g), F.lit(0)).alias(free_name(docs, count_col)))
    return j.select(*cols)
