"""Operator 5: n-gram Jaccard join of documents at a Jaccard similarity of at least `threshold`.

A document is its set of word n-grams (40-bit hashes); documents of equal sets are one class, told by 128 bits of hash, and classes
are what is joined.  All sets share one order: n-grams that a document-frequency sketch over all documents holds for common come last, those
before go by how often chance would give their words (from a sketch of all words), the rarest first, equals by hash.  A pair that reaches the threshold shares one of the first |x| - ceil(threshold |x|) + 1 n-grams of both
sets, whatever the order, and at its first common n-gram neither set has fewer n-grams left than the overlap needs.  So

1. every such n-gram is a tile; within a tile two classes are a candidate if their sizes and the n-grams left at their positions allow it;
2. each tile and size band offers its leader to the others; every class takes the leader with which it shares the most tiles, if
   the bit counts of the hashed bitmap signatures don't rule it out.  Classes so connected form families: nothing depends on whether they are alike;
3. within a family all pairs are compared, in blocks: sizes first, then the bound by bitmaps, then exact sorted-array intersection.  A large
   family is cut into blocks by size band and hash, and only blocks of neighbouring bands meet, so a task holds two blocks whatever the family's size;
4. candidates of a tile that belong to different families are bounded by bitmaps and those that are left compared exactly.  A tile of very many
   documents is cut into blocks too.

Every pair of different sets is therefore compared exactly or ruled out by a bound: no link is missed, but for collisions of hashes.  Pairs
within a family are counted where they are compared and never listed; what leaves a block is each class's number of links and a forest that connects them.

Defined results: null ids, null texts and texts without words are in no group.  Rows with the same id and text are one document; rows with the same
id and different texts are different documents.  Texts with fewer than n words have one n-gram, all their words.  Equal sets have similarity 1.  A group's id is its
smallest doc_id.  An empty table gives no groups.  Only the id (an integer) and text columns are read.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, dropped, free_name, written

MASK40 = np.uint64((1 << 40) - 1)
CHUNK = 1 << 16
#: Places in the order: RARITIES by the words of an n-gram, then the levels of what is common as a whole.
RARITIES = 64
_ALNUM = None


def _alnum() -> np.ndarray:
    global _ALNUM
    if _ALNUM is None:
        _ALNUM = np.array([chr(i).isalnum() for i in range(0x110000)])
    return _ALNUM


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words of all texts in turn, and how many each text has."""
    low = [t.lower() if t else "" for t in texts]
    joined = "\n".join(low) + "\n"
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    is_word = _alnum()[np.minimum(c, 0x10FFFF)]
    start = np.flatnonzero(is_word & ~np.r_[False, is_word[:-1]])
    stop = np.flatnonzero(is_word & ~np.r_[is_word[1:], False]) + 1
    bounds = np.cumsum([len(t) + 1 for t in low])  # where each text ends
    words_upto = np.searchsorted(start, bounds)
    count = np.diff(np.r_[0, words_upto])
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    # hash of a word: wrapping sum of character * odd power of its place
    size = stop - start
    at = np.repeat(np.cumsum(size) - size, size)
    place = np.arange(len(at)) - at
    power = np.cumprod(np.full(64, 0x9E3779B97F4A7C15 | 1, np.uint64))
    ch = _mix(c[np.repeat(start, size) + place].astype(np.uint64) + np.uint64(0x1234567) + (place.astype(np.uint64) << np.uint64(32)))
    return _mix(np.add.reduceat(ch * power[place & 63], np.cumsum(size) - size)), count


def grams(w: np.ndarray, each: np.ndarray, n: int, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Hashed n-grams of texts of the words w, how many each text has (repeats counted), and the sums of their words' weights."""
    upto = np.cumsum(each)
    # a text of fewer words has one of all its words
    count = np.where(each > 0, np.maximum(each - n + 1, 1), 0)
    base = np.repeat(upto - each, count) + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
    last = np.repeat(upto, count)
    out = np.zeros(len(base), np.uint64)
    total = None if weight is None else np.zeros(len(base), np.float32)
    for k in range(n if len(w) else 0):
        here = base + k
        ok = here < last
        here = np.minimum(here, len(w) - 1)
        out = _mix(out * np.uint64(0xD1B54A32D192ED03) + np.where(ok, w[here] + np.uint64(k), 0).astype(np.uint64))
        if total is not None:
            total += np.where(ok, weight[here], 0)
    return out, count, total


def _distinct(g: np.ndarray, count: np.ndarray, rare: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of each text as sorted 40-bit hashes below 8 bits of rarity, and how many."""
    doc = np.repeat(np.arange(len(count), dtype=np.uint64), count)
    x = np.sort((doc << np.uint64(48)) | (np.uint64(rare) << np.uint64(40)) | (g >> np.uint64(24)))
    x = x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x
    return x & np.uint64((1 << 48) - 1), np.bincount((x >> np.uint64(48)).astype(np.int64), minlength=len(count))


def _sets(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of each text as sorted 40-bit hashes, and how many."""
    return _distinct(*grams(*words(texts), n)[:2])


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    i, t = col(id_col).cast("long"), col(text_col).cast("string")
    return docs.select(i.alias("i"), F.xxhash64(t).alias("th"), t.alias("t")).where("i is not null and t is not null and length(t) > 0")


def _chunks(x: np.ndarray, off: np.ndarray) -> pa.Array:
    """x cut at off, as binary values."""
    return pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer((off * x.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])


def _set_hashes(g: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of hash of each set, as two longs."""
    import xxhash

    raw, off = memoryview(np.ascontiguousarray(g).view(np.uint8)), np.r_[0, np.cumsum(size)] * 8
    both = b"".join(xxhash.xxh3_128_digest(raw[a:e]) for a, e in zip(off.tolist(), off[1:].tolist()))
    h = np.frombuffer(both, np.int64).reshape(-1, 2)
    return h[:, 0], h[:, 1]


def heads(rows: DataFrame, n: int, bits: int) -> DataFrame:
    """(i, th, h1, h2) of every document with words, and (k, c, p): packed counters of two sketches for each task p, 2 ** bits of documents by n-gram,
    then as many of occurrences by word."""

    def run(batches):
        total = np.zeros(2 << bits, np.int32)
        for b in batches:
            for s in range(0, b.num_rows, 128):
                part = b.slice(s, 128)
                w, each = words(part.column(2).to_pylist())
                g, size = _distinct(*grams(w, each, n)[:2])
                np.add.at(total, (g >> np.uint64(40 - bits)).astype(np.int64), 1)
                np.add.at(total, (1 << bits) + (w >> np.uint64(64 - bits)).astype(np.int64), 1)
                h1, h2 = _set_hashes(g, size)
                m = len(size)
                out = [part.column(0), part.column(1), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())]
                yield pa.RecordBatch.from_arrays(out, ["i", "th", "h1", "h2", "k", "c"]).filter(pa.array(size > 0))
        for k in range(0, 2 << bits, CHUNK):
            part = total[k : k + CHUNK]
            if part.any():
                null = pa.nulls(1, pa.int64())
                yield pa.RecordBatch.from_arrays([null, null, null, null, pa.array([k], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], ["i", "th", "h1", "h2", "k", "c"])

    return rows.mapInArrow(run, "i long, th long, h1 long, h2 long, k int, c binary").withColumn("p", F.spark_partition_id())


def frequency_sketch(parts: DataFrame, bits: int) -> np.ndarray:
    """The sketches of all tasks, added by trees of 64, so that no task gets more than 64 parts of CHUNK counters."""

    def add(t: pa.Table) -> pa.Table:
        c = sum(np.frombuffer(zlib.decompress(x), np.int32).astype(np.int64) for x in t["c"].to_pylist())
        return pa.table({"k": t["k"].combine_chunks()[:1], "c": pa.array([zlib.compress(np.minimum(c, (1 << 31) - 1).astype(np.int32).tobytes(), 1)], pa.binary()), "p": t["p"].combine_chunks()[:1]})

    left = (parts.agg(F.max("p")).first()[0] or 0) + 1
    while True:
        left = -(-left // 64)
        parts = parts.withColumn("p", F.expr("cast(p div 64 as int)")).groupBy("k", "p").applyInArrow(add, "k int, c binary, p int")
        if left == 1:
            break
    out = np.zeros(2 << bits, np.int64)
    for r in parts.select("k", "c").collect():  # 2 ** (bits + 1) counters, whatever the number of documents
        c = np.frombuffer(zlib.decompress(r["c"]), np.int32)
        out[r["k"] : r["k"] + len(c)] = c
    return out


def levels(sketch: np.ndarray) -> np.ndarray:
    """Order of the buckets: 0 for what chance explains (few documents beyond the mean), then one more for each quarter of a doubling."""
    mean = float(sketch.mean())
    over = np.maximum(sketch - mean - 3 * math.sqrt(mean), 0)
    return np.where(over > 0, np.minimum(1 + np.floor(4 * np.log2(np.maximum(over, 1))), 256 - RARITIES), 0).astype(np.uint8)


def surprise(sketch: np.ndarray) -> np.ndarray:
    """Bits of information of a word of each bucket."""
    return np.log2(max(float(sketch.sum()), 1) / np.maximum(sketch, 1)).astype(np.float32)


def rarity(bits: np.ndarray, total: float) -> np.ndarray:
    """Place of an n-gram by the information of its words: 0 for the rarest, one more for each doubling of how often chance gives it in `total` words.
    The sketch of n-grams can't tell such counts: in a large table far more different n-grams fall into each of its buckets."""
    return np.clip(np.floor(math.log2(max(total, 1)) - bits + RARITIES // 2), 0, RARITIES - 1).astype(np.uint8)


def class_sets(rows: DataFrame, n: int, order, bits: int) -> DataFrame:
    """(h1, h2, z, sig, lo, hi): one row for each different set: its size, bitmap and n-grams, 40-bit hashes below 8 bits of rarity in 4 + 2 bytes."""

    def run(batches):
        _, info, many = order.value
        seen: set[tuple[int, int]] = set()  # copies within a task go before the shuffle
        for b in batches:
            for s in range(0, b.num_rows, 128):
                w, each = words(b.column(0).slice(s, 128).to_pylist())
                g, count, total = grams(w, each, n, info[(w >> np.uint64(64 - bits)).astype(np.int64)])
                h1, h2 = _set_hashes(*_distinct(g, count))
                g, size = _distinct(g, count, rarity(total, many).astype(np.uint64))
                lo, hi, off = (g & np.uint64(0xFFFFFFFF)).astype(np.uint32), (g >> np.uint64(32)).astype(np.uint16), np.r_[0, np.cumsum(size)]
                new = np.zeros(len(size), bool)
                for k, key in enumerate(zip(h1.tolist(), h2.tolist())):
                    if size[k] and key not in seen:
                        new[k] = True
                        if len(seen) < 100_000:
                            seen.add(key)
                sig = [signature(lo[a:e]).tobytes() if w else b"" for a, e, w in zip(off, off[1:], new)]
                out = [pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(size, pa.int32()), pa.array(sig, pa.binary()), _chunks(lo, off), _chunks(hi, off)]
                yield pa.RecordBatch.from_arrays(out, ["h1", "h2", "z", "sig", "lo", "hi"]).filter(pa.array(new))

    each = rows.select("t").mapInArrow(run, "h1 long, h2 long, z int, sig binary, lo binary, hi binary")
    return each.groupBy("h1", "h2").agg(*[F.first(c).alias(c) for c in ("z", "sig", "lo", "hi")])


def _unpack(lo: pa.Array, hi: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of all rows in turn, and how many each row has."""
    size = np.diff(np.frombuffer(hi.buffers()[1], np.int32)[hi.offset : hi.offset + len(hi) + 1]) // 2
    raw = lambda c, t: np.frombuffer(c.buffers()[2], np.uint8)[(o := np.frombuffer(c.buffers()[1], np.int32))[c.offset] : o[c.offset + len(c)]].copy().view(t)
    return (raw(hi, np.uint16).astype(np.uint64) << np.uint64(32)) | raw(lo, np.uint32), size.astype(np.int64)


def prefix_length(size: np.ndarray, threshold: float) -> np.ndarray:
    return size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1


def band_of(size: np.ndarray, threshold: float) -> np.ndarray:
    """Band of a set size; sets that can match are in the same band or neighbours."""
    return np.floor(np.log(np.maximum(size, 1)) / -np.log(threshold) + 1e-9).astype(np.int64)


def _need(x, y, threshold: float):
    """Least overlap of sets of sizes x and y that reach the threshold."""
    return np.ceil(threshold / (1 + threshold) * (x + y) - 1e-9)


def _hot_blocks(level: np.ndarray, block: int) -> np.ndarray:
    """Into how many blocks a tile is cut, by the level of its n-gram: its count is below 2 ** (level / 4) beyond the mean."""
    return np.maximum(1, np.ceil(2.0 ** (level.astype(float) / 4) / block)).astype(np.int64)


def tiles(sets: DataFrame, order, bits: int, threshold: float, buckets: int, block: int) -> DataFrame:
    """(bucket, keys, at, place, ids, sizes, ranks): packed prefix n-grams with their positions, and their sets with size and share of common n-grams.
    Sets of a tile that may be larger than `block` go to several buckets."""

    def run(batches):
        level = order.value[0]
        for b in batches:
            for s in range(0, b.num_rows, 4096):
                part = b.slice(s, 4096)
                ids = part.column(0).to_numpy()
                g, size = _unpack(part.column(1), part.column(2))
                rare, g = g >> np.uint64(40), g & MASK40
                lv = level[(g >> np.uint64(40 - bits)).astype(np.int64)].astype(np.uint64)
                doc = np.repeat(np.arange(len(ids), dtype=np.uint64), size)
                rank = np.bincount(doc.astype(np.int64), lv > 0, len(ids)) * 255 / np.maximum(size, 1)
                x = np.sort((doc << np.uint64(48)) | (np.where(lv > 0, lv + np.uint64(RARITIES - 1), rare) << np.uint64(40)) | g)
                place = np.arange(len(x)) - np.repeat(np.cumsum(size) - size, size)
                ahead = place < np.repeat(prefix_length(size, threshold), size)
                x, place = x[ahead], place[ahead]
                k, d = x & MASK40, (x >> np.uint64(48)).astype(np.int64)
                # positions in 16 bits, rounded down for sets of more than 65,535
                place = place >> _shift(size)[d]
                cut_in = _hot_blocks(level[(k >> np.uint64(40 - bits)).astype(np.int64)], block)
                salt = np.where(cut_in > 1, (_mix(ids.astype(np.uint64))[d] % cut_in.astype(np.uint64)).astype(np.int64), 0)
                of = ((k + salt.astype(np.uint64) * np.uint64(0x9E3779B1)) % np.uint64(buckets)).astype(np.int64)
                by = np.argsort(of, kind="stable")
                k, d, of, place = k[by], d[by], of[by], place[by]
                cut = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else []
                out: list[list] = [[] for _ in range(7)]
                for a, e in zip(cut, np.r_[cut[1:], len(of)] if len(of) else []):
                    # sets are numbered within the row: an entry takes 5 + 2 + 2 bytes
                    own, at = np.unique(d[a:e], return_inverse=True)
                    kk = k[a:e]
                    key = (kk & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes() + (kk >> np.uint64(32)).astype(np.uint8).tobytes()
                    for c, v in zip(out, (int(of[a]), key, at.astype(np.uint16).tobytes(), place[a:e].astype(np.uint16).tobytes(), ids[own].tobytes(), size[own].astype(np.int32).tobytes(), rank[own].astype(np.uint8).tobytes())):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *[pa.array(c, pa.binary()) for c in out[1:]]], ["bucket", "keys", "at", "place", "ids", "sizes", "ranks"])

    return sets.select("u", "lo", "hi").mapInArrow(run, "bucket int, keys binary, at binary, place binary, ids binary, sizes binary, ranks binary")


def _shift(size: np.ndarray) -> np.ndarray:
    return np.maximum(np.ceil(np.log2(np.maximum(size, 1) + 1)).astype(np.int64) - 16, 0)


def _members(t: pa.Table, order, bits: int, block: int) -> tuple[np.ndarray, ...]:
    """Entries of one bucket in tile order: n-gram, set, size, rank, n-grams left; of tiles with several sets, and of tiles that other buckets have too."""
    cols: list[list] = [[] for _ in range(5)]
    for key, a, pl, i, z, r in zip(*(t[c].to_pylist() for c in ("keys", "at", "place", "ids", "sizes", "ranks"))):
        at = np.frombuffer(a, np.uint16)
        n = len(at)
        k = np.frombuffer(key[: 4 * n], np.uint32).astype(np.uint64) | (np.frombuffer(key[4 * n :], np.uint8).astype(np.uint64) << np.uint64(32))
        z = np.frombuffer(z, np.int32).astype(np.int64)
        rest = z[at] - (np.frombuffer(pl, np.uint16).astype(np.int64) << _shift(z)[at])
        for c, v in zip(cols, (k, np.frombuffer(i, np.int64)[at], z[at], np.frombuffer(r, np.uint8)[at], rest)):
            c.append(v)
    k, d, z, r, rest = (np.concatenate(c) for c in cols)
    by = np.lexsort((d, k))
    k, d, z, r, rest = k[by], d[by], z[by], r[by], rest[by]
    n = np.diff(np.r_[np.flatnonzero(np.r_[True, k[1:] != k[:-1]]), len(k)])
    several = np.repeat(n > 1, n) | (_hot_blocks(order.value[0][(k >> np.uint64(40 - bits)).astype(np.int64)], block) > 1)
    return k[several], d[several], z[several], r[several], rest[several]


def _meet(x, y, z, rest, threshold: float) -> np.ndarray:
    """Whether entries x and y of one tile are a candidate: by their sizes and by the n-grams left."""
    zx, zy = z[x], z[y]
    return (np.minimum(zx, zy) >= threshold * np.maximum(zx, zy) - 1e-9) & (np.minimum(rest[x], rest[y]) >= _need(zx, zy, threshold))


def _met(start: np.ndarray, n: np.ndarray, z: np.ndarray, rest: np.ndarray, threshold: float, most: int = 64) -> np.ndarray:
    """Which entries of tiles (start, length) have a candidate; in tiles of more than `most` sets, which aren't looked at, all count."""
    out = np.zeros(len(z), bool)
    out[np.repeat(n > most, n)] = True
    for m in np.unique(n[(n > 1) & (n <= most)]).tolist():
        i, j = np.triu_indices(m, 1)
        t = start[n == m]
        for at in range(0, len(t), max(1, 1_000_000 // len(i))):
            s = t[at : at + max(1, 1_000_000 // len(i))]
            x, y = (s[:, None] + i).ravel(), (s[:, None] + j).ravel()
            ok = _meet(x, y, z, rest, threshold)
            out[x[ok]] = out[y[ok]] = True
    return out


FOUND = "a long, b long, n int, g long, u long, z int, rest int"


def stars(packed: DataFrame, order, bits: int, threshold: float, block: int) -> DataFrame:
    """Pairs (a, b) of the leader of a tile and band with its other sets, and in how many tiles (n); and the entries (g, u, z, rest) of tiles that have
    candidates.  The leader is the set most of whose n-grams are common (the least changed of many copies), then the one of the smallest number."""

    def run(t: pa.Table) -> pa.Table:
        k, d, z, r, rest = _members(t, order, bits, block)
        if len(k):
            start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            n = np.diff(np.r_[start, len(k)])
            hot = _hot_blocks(order.value[0][(k >> np.uint64(40 - bits)).astype(np.int64)], block) > 1
            on = hot | _met(start, n, z, rest, threshold)
            k, d, z, r, rest = k[on], d[on], z[on], r[on], rest[on]
        if not len(k):
            return pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int32()), ("g", pa.int64()), ("u", pa.int64()), ("z", pa.int32()), ("rest", pa.int32())]).empty_table()
        band = band_of(z, threshold)
        by = np.lexsort((d, 255 - r, band, k))
        first = np.flatnonzero(np.r_[True, (k[by][1:] != k[by][:-1]) | (band[by][1:] != band[by][:-1])])
        size = np.diff(np.r_[first, len(k)])
        lead, lead_z = np.repeat(d[by][first], size), np.repeat(z[by][first], size)
        fits = (lead != d[by]) & (np.minimum(z[by], lead_z) >= threshold * np.maximum(z[by], lead_z) - 1e-9)
        ab, n = np.unique(np.stack([lead[fits], d[by][fits]], 1), axis=0, return_counts=True)
        m, o = len(ab), len(k)
        none = np.r_[np.ones(m, bool), np.zeros(o, bool)]
        pair = lambda v, t: pa.array(np.r_[v, np.zeros(o, np.int64)], t, mask=~none)
        entry = lambda v, t: pa.array(np.r_[np.zeros(m, np.int64), v.astype(np.int64)], t, mask=none)
        return pa.table({"a": pair(ab[:, 0], pa.int64()), "b": pair(ab[:, 1], pa.int64()), "n": pair(n, pa.int32()), "g": entry(k, pa.int64()), "u": entry(d, pa.int64()), "z": entry(z, pa.int32()), "rest": entry(rest, pa.int32())})

    return packed.groupBy("bucket").applyInArrow(run, FOUND)


def signature(s: np.ndarray) -> np.ndarray:
    """Bitmap of a power of two of 64-bit words, at least two bits for each n-gram: its size grows with the set's band."""
    words = 1 << max(0, math.ceil(math.log2(max(len(s), 1) / 32)))
    on = np.zeros(64 * words, np.uint8)
    on[(s * np.uint32(0x9E3779B1) >> np.uint32(3)) & np.uint32(64 * words - 1)] = 1
    return np.packbits(on, bitorder="little").view(np.uint64)


def _fold(sig: np.ndarray, words: int) -> np.ndarray:
    """The bitmap in fewer words, of one set or of many (rows)."""
    while sig.shape[-1] > words:
        half = sig.shape[-1] // 2
        sig = sig[..., :half] | sig[..., half:]
    return sig


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Exact |x & y| of sorted arrays."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    at = np.searchsorted(large, small)
    return int((large[np.minimum(at, len(large) - 1)] == small).sum()) if len(small) else 0


def bounded(pairs: DataFrame, sigs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) that the bitmaps (u, z, sig) don't rule out."""
    side = lambda c: sigs.select(F.col("u").alias(c), F.col("z").alias("z" + c), F.col("sig").alias("s" + c))
    both = pairs.select("a", "b").join(side("b").hint("merge"), "b").join(side("a").hint("merge"), "a").select("a", "b", "za", "zb", "sa", "sb")

    def run(batches):
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for k, (zx, zy, x, y) in enumerate(zip(*(b.column(c).to_pylist() for c in ("za", "zb", "sa", "sb")))):
                n = min(len(x), len(y))
                p, q = int.from_bytes(_fold(np.frombuffer(x, np.uint64), n // 8).tobytes(), "little"), int.from_bytes(_fold(np.frombuffer(y, np.uint64), n // 8).tobytes(), "little")
                keep[k] = (zx + zy - (p ^ q).bit_count()) // 2 >= math.ceil(threshold / (1 + threshold) * (zx + zy) - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep))

    return both.mapInArrow(run, "a long, b long")


def linked(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, jaccard) of the pairs (a, b) that reach the threshold, by their sets (u, lo, hi)."""
    side = lambda c: sets.select(F.col("u").alias(c), F.col("lo").alias("lo" + c), F.col("hi").alias("hi" + c))
    both = pairs.select("a", "b").join(side("b").hint("merge"), "b").join(side("a").hint("merge"), "a").select("a", "b", "loa", "hia", "lob", "hib")

    def run(batches):
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                x, nx = _unpack(part.column(2), part.column(3))
                y, ny = _unpack(part.column(4), part.column(5))
                xe, ye = np.cumsum(nx), np.cumsum(ny)
                n = np.array([overlap(x[p - i : p], y[q - j : q]) for p, i, q, j in zip(xe, nx, ye, ny)], np.int64)
                j = n / (nx + ny - n)
                ok = n >= _need(nx, ny, threshold)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.round(j, 6), pa.float64())], ["a", "b", "jaccard"]).filter(pa.array(ok))

    return both.mapInArrow(run, "a long, b long, jaccard double")


def _cross(t: pa.Table, threshold: float) -> pa.Table:
    """(a, b): the candidates within each tile (g, x, y) whose families differ; of two blocks x and y only those of different blocks."""
    g, u, z, rest, c, own = (t[n].to_numpy() for n in ("g", "u", "z", "rest", "c", "own"))
    apart = t["x"].to_numpy() != t["y"].to_numpy()
    z, rest = z.astype(np.int64), rest.astype(np.int64)
    by = np.lexsort((c, g))
    g, u, z, rest, c, own, apart = g[by], u[by], z[by], rest[by], c[by], own[by], apart[by]
    start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    count = np.diff(np.r_[start, len(g)])
    tile = np.repeat(np.arange(len(start)), count)
    run = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (c[1:] != c[:-1])])  # a family within a tile
    length = np.diff(np.r_[run, len(g)])
    pick = np.lexsort((-length, tile[run]))
    main = c[run[pick[np.flatnonzero(np.r_[True, tile[run][pick][1:] != tile[run][pick][:-1]])]]]
    outside = np.flatnonzero(c != main[tile])
    todo = np.cumsum(count[tile[outside]])
    seen, at = np.zeros((0, 2), np.int64), 0
    while at < len(outside):
        upto = max(at + 1, int(np.searchsorted(todo, (todo[at - 1] if at else 0) + 2_000_000, "right")))
        r = outside[at:upto]
        n = count[tile[r]]
        x = np.repeat(r, n)
        y = np.repeat(start[tile[r]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        ok = (c[x] != c[y]) & ((c[y] == main[tile[y]]) | (u[y] > u[x])) & ~(apart[x] & (own[x] == own[y])) & _meet(x, y, z, rest, threshold)
        x, y = u[x[ok]], u[y[ok]]
        seen = np.unique(np.concatenate([seen, np.stack([np.minimum(x, y), np.maximum(x, y)], 1)]), axis=0)
        at = upto
    return pa.table({"a": pa.array(seen[:, 0], pa.int64()), "b": pa.array(seen[:, 1], pa.int64())})


def crossing(entries: DataFrame, family: DataFrame, threshold: float, buckets: int, block: int) -> DataFrame:
    """(a, b): candidates of different families (u, c; who isn't there is a family alone), each once."""
    named = entries.join(family.hint("merge"), "u", "left").select("g", "u", "z", "rest", F.coalesce("c", "u").alias("c"))
    named = written(named, "named")
    mixed = named.groupBy("g").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("m")).where("lo != hi").select("g", F.ceil(F.col("m") / block).cast("int").alias("s"))
    cut = named.join(mixed.hint("merge"), "g").withColumn("own", F.pmod(F.xxhash64("u"), F.col("s")).cast("int"))
    met = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("s") - 1))).withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other"))
    # small tiles share a group; two blocks of a large one are a group of their own
    key = F.when(F.col("s") == 1, F.pmod(F.xxhash64("g"), F.lit(buckets))).otherwise(F.xxhash64("g", "x", "y"))
    pairs = met.select(key.alias("key"), "g", "u", "z", "rest", "c", "own", "x", "y").groupBy("key").applyInArrow(lambda t: _cross(t, threshold), "a long, b long")
    out = written(pairs.distinct(), "crossing")
    dropped(named)
    return out


def _within(t: pa.Table, threshold: float) -> pa.Table:
    """All pairs of a block, or of two blocks: each set's number of linked documents (a, n), and a forest (a, b) of the links."""
    t = t.combine_chunks()
    u, w, own = (t[c].to_numpy() for c in ("u", "w", "own"))
    other = t["x"].to_numpy()[0] != t["y"].to_numpy()[0]
    one = lambda c: t[c].chunk(0) if isinstance(t[c], pa.ChunkedArray) else t[c]
    g, size = _unpack(one("lo"), one("hi"))
    end = np.cumsum(size)
    words = np.array([len(s) // 8 for s in t["sig"].to_pylist()])
    # bitmaps in so many words, only of the sets that have as many (few long sets among many short ones would take a gigabyte else), and their rows
    folded: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    raw = [np.frombuffer(s, np.uint64) for s in t["sig"].to_pylist()]
    code = np.unique(g, return_inverse=True)[1]
    mark = np.zeros(int(code.max()) + 1 if len(code) else 1, np.int32)
    links, root, forest = np.zeros(len(u), np.int64), list(range(len(u))), []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for x in range(len(u)):
        y = np.arange(x + 1, len(u))
        y = y[np.minimum(size[x], size[y]) >= threshold * np.maximum(size[x], size[y]) - 1e-9]
        if other:
            y = y[own[y] != own[x]]
        if not len(y):
            continue
        least = int(min(words[x], words[y].min()))
        if least not in folded:
            enough = np.flatnonzero(words >= least)
            at = np.zeros(len(u), np.int32)
            at[enough] = np.arange(len(enough))
            folded[least] = np.array([_fold(raw[i], least) for i in enough]), at
        m, at = folded[least]
        need = _need(size[x], size[y], threshold)
        differ = np.bitwise_count(m[at[y]] ^ m[at[x]]).sum(1).astype(np.int64)
        fit = (size[x] + size[y] - differ) // 2 >= need
        y, need = y[fit], need[fit]
        if not len(y):
            continue
        mine = code[end[x] - size[x] : end[x]]
        if size[y].sum() * 8 < len(code):
            n = np.array([overlap(mine, code[end[j] - size[j] : end[j]]) for j in y])
        else:  # the same for all at once
            mark[mine] = 1
            n = np.add.reduceat(mark[code], end - size)[y]
            mark[mine] = 0
        y = y[n >= need]
        links[x] += w[y].sum()
        links[y] += w[x]
        for j in y.tolist():
            p, q = find(x), find(j)
            if p != q:
                root[max(p, q)] = min(p, q)
                forest.append((int(u[x]), int(u[j])))
    on = np.flatnonzero(links)
    a = np.r_[u[on], [p for p, _ in forest]].astype(np.int64)
    edge = np.arange(len(a)) >= len(on)
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(np.r_[np.zeros(len(on)), [q for _, q in forest]].astype(np.int64), pa.int64(), mask=~edge), "n": pa.array(np.r_[links[on], np.zeros(len(forest))].astype(np.int64), pa.int64(), mask=edge)})


def within(sets: DataFrame, family: DataFrame, threshold: float, grams: int) -> DataFrame:
    """_within of every family; one of more than `grams` n-grams, or a fiftieth as many sets, in blocks of about that many."""
    band = F.floor(F.ln(F.col("z")) / F.lit(-math.log(threshold)) + F.lit(1e-9)).cast("int")
    sized = written(sets.select("u", "z").join(family, "u").select("u", "c", "z", band.alias("band")), "sized")
    load = F.greatest(F.sum("z"), F.count("*") * 50)  # short sets count by their number: a block's pairs are compared row by row
    total = sized.groupBy("c").agg(load.alias("all"))
    banded = sized.join(total.hint("merge"), "c").select("u", "c", "z", F.when(F.col("all") > grams, F.col("band")).otherwise(0).alias("band"))
    blocks = banded.groupBy("c", "band").agg(F.ceil(load / grams).cast("int").alias("s"))
    near = blocks.select("c", "band", "s", F.explode(F.array(*[F.col("band") + k for k in (-1, 0, 1)])).alias("near"))
    meets = near.join(blocks.select("c", F.col("band").alias("near"), F.col("s").alias("there")).hint("merge"), ["c", "near"]).select("c", "band", "s", "near", F.explode(F.sequence(F.lit(0), F.col("there") - 1)).alias("other"))
    own, far = F.struct("band", F.pmod(F.xxhash64("u"), F.col("s")).cast("int").alias("k")), F.struct(F.col("near").alias("band"), F.col("other").alias("k"))
    keyed = banded.join(meets.hint("merge"), ["c", "band"]).select("u", "c", own.alias("own"), F.least(own, far).alias("x"), F.greatest(own, far).alias("y"))
    flat = lambda s: F.xxhash64(f"{s}.band", f"{s}.k")
    keyed = keyed.select("u", "c", flat("own").alias("own"), flat("x").alias("x"), flat("y").alias("y"))
    rows = keyed.join(sets.hint("merge"), "u").select("c", "x", "y", "u", "own", "w", "sig", "lo", "hi")
    out = written(rows.groupBy("c", "x", "y").applyInArrow(lambda t: _within(t, threshold), "a long, b long, n long"), "within")
    dropped(sized)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(u, c): for every number in edges (a, b) the smallest of its component, by hooking to smaller labels and shortening."""
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("c")), "labels")
    while True:
        near = both.join(label.select(F.col("u").alias("b"), F.col("c").alias("cb")), "b").groupBy("a").agg(F.min("cb").alias("m"))
        hooked = label.select("u", "c").join(near.select(F.col("a").alias("u"), "m"), "u").select("u", F.col("c").alias("was"), F.least("c", "m").alias("c"))
        up = label.select(F.col("u").alias("c"), F.col("c").alias("cc"))
        new = written(hooked.join(up, "c", "left").select("u", "was", F.least("c", F.coalesce("cc", "c")).alias("c")), "labels")
        dropped(label)
        if new.where("c != was").isEmpty():
            dropped(both)
            return new
        label = new


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, threshold: float = 0.6, tile_docs: int = 4000, block_docs: int = 20_000, block_grams: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """(i, th, c, least, links) of every document that has a link: id, hash of its text, group, smallest id of its class, number of linked documents.
    tile_docs: sets for each bucket of tiles; block_docs, block_grams: where a tile and a family are cut into blocks.  They bound a task's memory
    whatever the size of the table, and change no result.  And (i, th) of the documents that several rows hold."""
    spark = docs.sparkSession
    rows = _rows(docs, id_col, text_col)
    n_docs = docs.count()
    bits = min(max(n_docs.bit_length() + 6, 16), 22)
    head = written(heads(rows, n, bits), "heads")
    named = head.where("k is null").groupBy("i", "th").agg(F.first("h1").alias("h1"), F.first("h2").alias("h2"))
    sketch = frequency_sketch(head.where("k is not null").select("k", "c", "p"), bits)
    order = spark.sparkContext.broadcast((levels(sketch[: 1 << bits]), surprise(sketch[1 << bits :]), float(sketch[1 << bits :].sum())))
    sets = written(class_sets(rows, n, order, bits).withColumn("u", F.monotonically_increasing_id()), "sets")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sets.count() // tile_docs))
    found = written(stars(tiles(sets, order, bits, threshold, buckets, block_docs), order, bits, threshold, block_docs), "stars")
    sigs = sets.select("u", "z", "sig")
    counted = found.where("a is not null").groupBy("a", "b").agg(F.sum("n").alias("n"))
    best = written(bounded(counted.groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a")), sigs, threshold), "best")
    family = components(best)
    cross = crossing(found.where("g is not null").select("g", "u", "z", "rest"), family, threshold, buckets, block_docs)
    left = written(bounded(cross, sigs, threshold), "left")
    dropped(found, cross, best)
    classes = written(named.groupBy("h1", "h2").agg(F.count("*").alias("w"), F.min("i").alias("least")).join(sets.select("h1", "h2", "u").hint("merge"), ["h1", "h2"]), "classes")
    active = family.select("u").union(left.select("a")).union(left.select("b")).distinct()
    live = written(sets.join(active.hint("merge"), "u", "left_semi").join(classes.select("u", "w"), "u").select("u", "w", "z", "sig", "lo", "hi"), "live")
    dropped(sets)
    inner = within(live, family, threshold, block_grams)
    outer = written(linked(left, live, threshold), "links")
    dropped(live, left, family)
    forest = inner.where("b is not null").select("a", "b").unionByName(outer.select("a", "b"))
    comp = components(forest)
    weight = classes.select("u", "w")
    met = outer.select(F.col("a").alias("x"), F.col("b").alias("u")).unionByName(outer.select(F.col("b").alias("x"), F.col("a").alias("u"))).join(weight, "u").select(F.col("x").alias("u"), F.col("w").alias("n"))
    count = inner.where("b is null").select(F.col("a").alias("u"), "n").unionByName(met).groupBy("u").agg(F.sum("n").alias("n"))
    each = classes.join(comp, "u", "left").join(count, "u", "left").where("w > 1 or c is not null").select("h1", "h2", "least", F.coalesce("c", "u").alias("c"), (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("links"))
    return named.join(each.hint("merge"), ["h1", "h2"]).select("i", "th", "c", "least", "links"), head.where("k is null").groupBy("i", "th").count().where("count > 1").select("i", "th")


def groups(docs: DataFrame, **params) -> DataFrame:
    """(doc_id, group_id, links): every document with a link, its group (the smallest id that links lead to) and how many documents reach the threshold with it."""
    member = written(join(docs, **params)[0], "member")
    least = member.groupBy("c").agg(F.min("least").alias("group_id"))
    return member.join(least.hint("merge"), "c").select(F.col("i").alias("doc_id"), "group_id", "links")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """docs with one document of each group, the one of the smallest id (then text hash); of rows with the same id and text one stays, the one of the smallest hash of all columns.
    Rows that are in no group stay, null ids, null texts and texts without words among them."""
    member, repeats = join(docs, id_col=id_col, text_col=text_col, **params)
    member = written(member, "member")
    first = member.groupBy("c").agg(F.min(F.struct("i", "th")).alias("keep"))
    i, th = free_name(docs, "_i"), free_name(docs, "_th")
    gone = written(member.join(first.hint("merge"), "c").where("i != keep.i or th != keep.th").select(F.col("i").alias(i), F.col("th").alias(th)), "gone")
    dropped(member)
    own = [col(c) for c in docs.columns]
    text = col(text_col).cast("string")
    keyed = docs.select(*own, col(id_col).cast("long").alias(i), F.xxhash64(text).alias(th))
    kept = keyed.join(gone.hint("merge"), [i, th], "left_anti")
    twice = written(repeats.select(F.col("i").alias(i), F.col("th").alias(th)), "twice")
    if twice.isEmpty():
        return kept.select(*own)
    lone = kept.join(twice.hint("merge"), [i, th], "left_anti").select(*own)
    some = kept.join(twice.hint("merge"), [i, th], "left_semi")
    one = some.groupBy(i, th).agg(F.min_by(F.struct(*own), F.xxhash64(*own)).alias("r"))
    return lone.unionByName(one.select(*[F.col("r").getField(c).alias(c) for c in docs.columns]))


def brute_force(rows: list[tuple[int, str]], n: int, threshold: float) -> tuple[dict[tuple[int, int], float], dict[int, int]]:
    """All pairs that reach the threshold, and the components they make."""
    import re

    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\W_]+", t.lower()) if t else []
        if i is not None and w:
            sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))}
    ids = sorted(sets)
    pairs, root = {}, {i: i for i in ids}

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            j = both / (len(sets[a]) + len(sets[b]) - both)
            if j >= threshold - 1e-12:
                pairs[a, b] = j
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return pairs, {i: find(i) for i in ids if any(i in p for p in pairs)}
