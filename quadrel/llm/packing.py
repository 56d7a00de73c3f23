"""Operator 9: best-fit packing with swap-based local search.

A document of more than `capacity` words is cut into full bins and a remainder.  Pieces are packed shard by shard: best
fit by decreasing size, then local search between underfull bins.  The search takes the emptiest underfull bin as the
one to empty and looks, for pieces of it, for a move into another bin, an exchange one for one or an exchange of two of
its pieces for one, such that the other bin gains words and stays within capacity; each such step raises the sum of squared fills, so
the search ends.  A bin that has lost all its pieces is gone.

The search ends when the underfull bins but the emptiest lack the room for what that one holds: no bin can then be emptied, though
the sum of squared fills could still rise.

Shards hold `shard_docs` documents on average, by hash of id, text and input partition (so that repeated rows spread), and tasks stay alike in size as
the table grows; each leaves at most a few underfull bins, a share that falls with the shard size, not with the table's.

Defined results: a null or blank text has no words and is in no bin.  Null ids are packed like others (the entry's id is
null).  Repeated rows are packed each.  Equal sizes are taken in order of id, then text hash.  An empty table gives no bin.  Only the
id and text columns are read; ids must be integers.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col

SCHEMA = "bin_id string, doc_ids array<long>, parts array<int>, sizes array<int>, fill int, capacity int, searched boolean"


def words(text: Column) -> Column:
    """Number of runs of non-space characters: a position starts one if the one before it is space."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(t) > 0, F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1).otherwise(0)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices; each piece (largest first) goes to the fullest bin that holds it."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms: list[int] = []  # sorted rooms that some bin has
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        s = sizes[i]
        at = bisect_left(rooms, s)
        if at < len(rooms):
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(at)
            bins[b].append(i)
        else:
            b, room = len(bins), capacity
            bins.append([i])
        left = room - s
        if not by_room[left]:
            rooms.insert(bisect_left(rooms, left), left)
        by_room[left].append(b)
    return bins


def local_search(sizes: list[int], bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Raises the sum of squared fills by moves and exchanges between underfull bins."""
    fill = [sum(sizes[i] for i in b) for b in bins]
    open_ = sorted((b for b in range(len(bins)) if fill[b] < capacity), key=lambda b: (fill[b], b))
    fixed: set[int] = set()
    while True:
        todo = [b for b in open_ if bins[b] and fill[b] < capacity and b not in fixed]
        if len(todo) < 2:
            break
        src = min(todo, key=lambda b: (fill[b], b))
        if sum(capacity - fill[b] for b in open_ if bins[b] and b != src) < fill[src]:
            break  # the others lack the room for even the emptiest bin: none can be emptied any more
        others = sorted((b for b in open_ if b != src and bins[b] and fill[src] <= fill[b] < capacity), key=lambda b: (-fill[b], b))
        if _step(sizes, bins, fill, src, others, capacity):
            fixed.clear()  # other bins have changed, so what was stuck may move again
        else:
            fixed.add(src)
    return [b for b in bins if b]


def _step(sizes: list[int], bins: list[list[int]], fill: list[int], src: int, others: list[int], capacity: int) -> bool:
    done = False
    for dst in others:
        while bins[src]:
            room = capacity - fill[dst]
            if room <= 0:
                break
            own = sorted(bins[src], key=lambda i: sizes[i])
            have = [sizes[i] for i in own]
            best = (0, None, None)
            k = bisect_right(have, room)
            if k:  # move
                best = (have[k - 1], (own[k - 1],), ())
            if best[0] < room:
                for j in bins[dst]:
                    s = sizes[j]
                    k = bisect_right(have, room + s)  # one for one: a larger piece for a smaller
                    if k and have[k - 1] - s > best[0]:
                        best = (have[k - 1] - s, (own[k - 1],), (j,))
                    if best[0] == room:
                        break
                    lo, hi = 0, len(have) - 1  # two for one: the largest pair sum within s + room
                    while lo < hi:
                        both = have[lo] + have[hi]
                        if both > room + s:
                            hi -= 1
                        else:
                            if both - s > best[0]:
                                best = (both - s, (own[lo], own[hi]), (j,))
                            lo += 1
                    if best[0] == room:
                        break
            gain, out, back = best
            if gain <= 0:
                break
            gone, came = set(out), set(back)
            bins[src] = [i for i in bins[src] if i not in gone] + list(back)
            bins[dst] = [i for i in bins[dst] if i not in came] + list(out)
            fill[src], fill[dst] = fill[src] - gain, fill[dst] + gain
            done = True
        if not bins[src]:
            break
    return done


def pack(docs: DataFrame, capacity: int = 2048, shard_docs: int = 10_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each bin: its documents, which part of each, their words, the fill."""
    text = col(text_col).cast("string")
    sized = docs.select(col(id_col).cast("long").alias("i"), F.xxhash64(text).alias("h"), words(text).cast("int").alias("n")).where("n > 0")
    shards = max(1, -(-docs.count() // shard_docs))
    keyed = sized.withColumn("shard", F.pmod(F.xxhash64("i", "h", F.spark_partition_id()), F.lit(shards)).cast("int"))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("i", "ascending"), ("h", "ascending")])
        shard, ids = t["shard"][0].as_py(), t["i"].to_pylist()  # a null beside large ids must not turn them into doubles
        rows, pieces = [], []
        for d, n in enumerate(t["n"].to_pylist()):
            full, rest = divmod(n, capacity)
            rows += [([d], [p], [capacity], False) for p in range(full)]
            if rest:
                pieces.append((rest, d, full))
        sizes = [p[0] for p in pieces]
        for b in local_search(sizes, best_fit(sizes, capacity), capacity):
            b = sorted(b)
            rows.append(([pieces[i][1] for i in b], [pieces[i][2] for i in b], [sizes[i] for i in b], True))
        rows = [([ids[d] for d in r[0]], *r[1:]) for r in rows]
        off = pa.array(np.r_[0, np.cumsum([len(r[0]) for r in rows])], pa.int32())
        of = lambda k, t: pa.ListArray.from_arrays(off, pa.array([x for r in rows for x in r[k]], t))
        return pa.table(
            {
                "bin_id": [f"{shard}-{k}" for k in range(len(rows))],
                "doc_ids": of(0, pa.int64()),
                "parts": of(1, pa.int32()),
                "sizes": of(2, pa.int32()),
                "fill": pa.array([sum(r[2]) for r in rows], pa.int32()),
                "capacity": pa.array([capacity] * len(rows), pa.int32()),
                "searched": pa.array([r[3] for r in rows], pa.bool_()),
            }
        )

    return keyed.groupBy("shard").applyInArrow(run, SCHEMA)
