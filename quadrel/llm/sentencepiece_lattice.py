"""Operator 10: SentencePiece encoding and decoding over a relational lattice.

1. Texts are cut into units where no piece of the model can reach across (between two characters that are neighbours in no
   piece; such a cut can't change the encoding).  Each block of rows gives its distinct units.
2. Substrings of bounded length of every distinct unit are exploded and equi-joined to the piece table (its size is that of
   the vocabulary, checked before it is broadcast); the edges are grouped by unit again without another shuffle.
3. A higher-order aggregate folds each unit's lattice.  Unigram models: Viterbi, the best sum of scores over the edges in
   order of their ends.  BPE models, such as the public one: Viterbi over a BPE model's scores doesn't give the model's encoding,
   so the fold merges, step by step, the best-ranked edge that joins two current pieces; the state is a bit mask of the boundaries.
   One pass over the edges by rank does that, but for units where a merge makes an edge of an earlier rank ready; they are folded again step by step.
   Units of more than 60 characters, whose boundaries don't fit the mask, are merged by the same rule in Python.
4. Each block's dictionary (unit to ids) is written to the shared folder; a second pass over the texts looks units up.  Texts are never
   shuffled.

Blocks are known by file and row number, so the second pass finds the same blocks however tasks are split.

Defined results: null text gives null ids, null text back; an empty text gives no ids and decodes to the empty text.  White space
is kept as it is.  A literal U+2581 decodes to a space, as in the library.  Characters outside the vocabulary become bytes, or the unknown
piece where the model has no bytes.  Null ids pass through; repeated rows are encoded each.  Only the id and text columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import col, dropped, free_name, scratch_path, write, written

SPACE = "▁"
CUT, END = "\uffff", "\ufffe"  # no characters; a text that has them all the same is cut alone
MASK_CHARS = 60
BLOCK_BITS = 13
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@dataclass
class Model:
    pieces: list[str]
    scores: list[float]
    kinds: list[int]  # 1 normal, 2 unknown, 3 control, 4 user-defined, 5 unused, 6 byte
    bpe: bool
    dummy_prefix: bool
    unk: int
    usable: dict[str, int] = field(default_factory=dict)
    bytes_at: dict[int, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.usable = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k in (1, 4)}
        self.bytes_at = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == 6}
        # between units in lists: a character that no piece has, so that it is a unit of its own
        self.sep = next(c for c in "\n\0\1\2" if not any(c in p for p in self.usable))
        self.longest = max(map(len, self.usable), default=1)
        self.kind = np.uint16 if len(self.pieces) <= 1 << 16 else np.uint32
        # an id for each character of a piece, and which pairs of them are neighbours in some piece
        chars = sorted({c for p in self.usable for c in p})
        self.char_id = np.zeros(0x110000, np.uint16 if len(chars) < 65535 else np.uint32)
        self.char_id[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        pairs = {(p[i], p[i + 1]) for p in self.usable for i in range(len(p) - 1)}
        at = {c: i + 1 for i, c in enumerate(chars)}
        lefts = sorted({at[a] for a, _ in pairs})
        rights = sorted({at[b] for _, b in pairs})
        self.left = np.zeros(len(chars) + 1, np.int32)
        self.left[lefts] = np.arange(1, len(lefts) + 1)
        self.right = np.zeros(len(chars) + 1, np.int32)
        self.right[rights] = np.arange(1, len(rights) + 1)
        self.joins = np.zeros((len(lefts) + 1, len(rights) + 1), bool)
        for a, b in pairs:
            self.joins[self.left[at[a]], self.right[at[b]]] = True
        # by code point: the row of joins where it is the left neighbour, as an offset, and the column where it is the right one
        self.row, self.column = (self.left.astype(np.int32) * self.joins.shape[1])[self.char_id], self.right[self.char_id]
        self.flat = self.joins.ravel()
        self.single: dict[str, bytes] = {}

    def char(self, c: str) -> bytes:
        """ids, packed, of one character."""
        if (got := self.single.get(c)) is None:
            if c in self.usable:
                ids = [self.usable[c]]
            elif self.bytes_at:
                ids = [self.bytes_at[b] for b in c.encode("utf-8", "surrogatepass")]
            else:
                ids = [self.unk]
            self.single[c] = got = np.array(ids, self.kind).tobytes()
        return got

    def units(self, text: str) -> list[str]:
        s = ((SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE)) if text else ""
        if not s:
            return []
        c = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
        cut = (np.flatnonzero(~self.flat[self.row[c[:-1]] + self.column[c[1:]]]) + 1).tolist()
        return [s[a:b] for a, b in zip([0, *cut], [*cut, len(s)])]

    def splits(self, texts: list[str]) -> list[list[str]]:
        """`units` of each text; texts are cut together, up to 64k characters at once."""
        out: list[list[str]] = []
        a = 0
        while a < len(texts):
            e, n = a + 1, len(texts[a])
            while e < len(texts) and n + len(texts[e]) < 1 << 16:
                n += len(texts[e])
                e += 1
            out += self._splits(texts[a:e])
            a = e
        return out

    def _splits(self, texts: list[str]) -> list[list[str]]:
        start = SPACE if self.dummy_prefix else ""
        joined = END.join([start + t.replace(" ", SPACE) if t else "" for t in texts])
        if CUT in joined or joined.count(END) >= len(texts) or self.char_id[[ord(CUT), ord(END)]].any():
            return [self.units(t) for t in texts]
        c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        end = c == ord(END)
        cut = ~(self.flat[self.row[c[:-1]] + self.column[c[1:]]] | end[:-1] | end[1:])
        at = np.arange(len(c))
        at[1:] += np.cumsum(cut)
        marked = np.full(len(c) + np.count_nonzero(cut), ord(CUT), np.uint32)
        marked[at] = c
        return [x.split(CUT) if x else [] for x in marked.tobytes().decode("utf-32-le", "surrogatepass").split(END)]

    def merge(self, unit: str) -> bytes:
        """BPE of one unit by a heap of candidate merges, for units too long for the mask."""
        import heapq

        n = len(unit)
        nxt, prev, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        alive = [True] * n
        heap: list[tuple[float, int, int]] = []

        def offer(a: int) -> None:
            b = nxt[a]
            if a >= 0 and b < n and end[b] - a <= self.longest and (i := self.usable.get(unit[a : end[b]])) is not None:
                heapq.heappush(heap, (-self.scores[i], a, end[b]))

        for a in range(n):
            offer(a)
        while heap:
            _, a, e = heapq.heappop(heap)
            if not alive[a] or nxt[a] >= n or end[nxt[a]] != e:
                continue
            b = nxt[a]
            alive[b] = False
            end[a], nxt[a] = e, nxt[b]
            if nxt[b] < n:
                prev[nxt[b]] = a
            offer(a)
            if prev[a] >= 0:
                offer(prev[a])
        out, a = b"", 0
        while a < n:
            out += self.char(unit[a]) if end[a] - a == 1 else np.array([self.usable[unit[a : end[a]]]], self.kind).tobytes()
            a = nxt[a]
        return out

    def viterbi(self, unit: str) -> bytes:
        """Best path of one unit in Python, for units too long for the mask."""
        lowest = min((self.scores[i] for i in self.usable.values()), default=0.0) - 10
        best, back = [0.0] + [-np.inf] * len(unit), [(0, -1)] * (len(unit) + 1)
        for e in range(1, len(unit) + 1):
            for s in range(max(0, e - self.longest), e):
                i = self.usable.get(unit[s:e], -1 if e - s == 1 else None)
                if i is not None and (v := best[s] + (self.scores[i] if i >= 0 else lowest)) > best[e]:
                    best[e], back[e] = v, (s, i)
        parts, e = [], len(unit)
        while e:
            s, i = back[e]
            parts.append(np.array([i], self.kind).tobytes() if i >= 0 else self.char(unit[s:e]))
            e = s
        return b"".join(parts[::-1])

    def surface(self) -> list[bytes]:
        """The bytes that each piece stands for."""
        out = []
        for p, k in zip(self.pieces, self.kinds):
            out.append(bytes([int(p[3:5], 16)]) if k == 6 else b"" if k == 3 else " ⁇ ".encode() if k == 2 else p.replace(SPACE, " ").encode("utf-8", "surrogatepass"))
        return out


def load(path: str = DEFAULT_MODEL) -> Model:
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    n = m.normalizer_spec
    if n.precompiled_charsmap or n.remove_extra_whitespaces or not n.escape_whitespaces:
        raise ValueError("only models without normalisation are supported")
    if len(m.pieces) >= 1 << 20:
        raise ValueError("ids take 20 bits at most")
    if m.trainer_spec.model_type not in (1, 2):
        raise ValueError("only unigram and BPE models are supported")
    return Model([p.piece for p in m.pieces], [p.score for p in m.pieces], [p.type for p in m.pieces], m.trainer_spec.model_type == 2, n.add_dummy_prefix, next((i for i, p in enumerate(m.pieces) if p.type == 2), 0))


def merge_codes(model: Model) -> dict[str, int]:
    """For each piece of more than one character of a BPE model its rank among all scores (from bit 33), id (from bit 1), and whether merging it
    can make an edge of an earlier rank ready (bit 0): it begins or ends a piece of that rank, whose rest is a character or a piece."""
    score = {p: float(model.scores[i]) for p, i in model.usable.items() if len(p) > 1}
    rank = {x: n for n, x in enumerate(sorted(set(score.values()), reverse=True))}
    late = set()
    for p, x in score.items():
        for i in range(1, len(p)):
            if all(len(y) == 1 or y in score for y in (p[:i], p[i:])):
                late.update(y for y in (p[:i], p[i:]) if len(y) > 1 and score[y] <= x)
    return {p: (rank[x] << 33) + (model.usable[p] << 1) + (p in late) for p, x in score.items()}


def piece_table(spark: SparkSession, model: Model) -> DataFrame:
    """(piece, id, score, code): code is that of `merge_codes` (BPE), score is the piece's (unigram)."""
    if len(model.pieces) > 1_000_000:
        raise ValueError("the piece table is too large to broadcast")
    codes = merge_codes(model) if model.bpe else {}
    rows = [(p, i, float(model.scores[i]), codes.get(p)) for p, i in model.usable.items() if not model.bpe or len(p) > 1]
    return spark.createDataFrame(pa.table({"piece": [r[0] for r in rows], "id": pa.array([r[1] for r in rows], pa.int32()), "score": pa.array([r[2] for r in rows], pa.float64()), "code": pa.array([r[3] for r in rows], pa.int64())}))


def lattice(units: DataFrame, pieces: DataFrame, longest: int, shortest: int) -> DataFrame:
    """(unit_no, bucket, unit, edges): all substrings of units that are pieces.  units: (bucket, unit), partitioned by bucket.  Units are numbered in
    the order they are read, so that grouping by number first finds its rows in order."""
    n = F.length("unit")
    # numbered in a step of its own: beside explode, rows would be numbered after it
    numbered = units.where(n >= shortest).select(F.monotonically_increasing_id().alias("unit_no"), "bucket", "unit")
    starts = numbered.select("*", F.explode(F.sequence(F.lit(0), n - shortest)).alias("s"))
    e = starts.select("*", F.explode(F.sequence(F.lit(shortest), F.least(F.lit(longest), n - F.col("s")))).alias("w"))
    return e.select("*", F.substring(F.col("unit"), F.col("s") + 1, F.col("w")).alias("piece")).join(F.broadcast(pieces), "piece")


def _shl(value, by):
    return F.call_function("shiftleft", value, by)


def _shr(value, by):
    return F.call_function("shiftright", value, by)


def fold_merges(edges: DataFrame) -> DataFrame:
    """(bucket, unit, path): the multi-character pieces of the BPE encoding, from the edges.

    An edge is one number: rank from bit 33, start from bit 27, width from bit 21, id from bit 1, and bit 0 of `merge_codes`.  Edges are tried once in order of
    rank.  That is the rule itself unless a merge makes an edge of an earlier rank ready, which is looked for after merges that can; such a
    unit is folded again, the first edge that is ready at each step."""
    one, two = F.lit(1).cast("long"), F.lit(2).cast("long")
    s = lambda x: _shr(x, F.lit(27)).bitwiseAND(F.lit(63)).cast("int")
    w = lambda x: _shr(x, F.lit(21)).bitwiseAND(F.lit(63)).cast("int")
    here = lambda mask, x: _shr(mask, s(x)).bitwiseAND(_shl(two, w(x)) - 1)  # noqa: E731  boundaries from the edge's start to its end
    ready = lambda mask, x: (F.bit_count(here(mask, x)) == 3) & (here(mask, x).bitwiseAND(_shl(one, w(x)) + 1) == _shl(one, w(x)) + 1)
    merged = lambda mask, x: mask.bitwiseAND(F.bitwise_not(_shl(_shl(one, w(x)) - 2, s(x))))
    packed = F.col("code") + _shl(F.col("s").cast("long"), F.lit(27)) + _shl(F.col("w").cast("long"), F.lit(21))
    g = edges.groupBy("unit_no", "bucket", "unit").agg(F.sort_array(F.collect_list(packed)).alias("e"))
    n = F.length("unit")
    every = _shl(one, n + 1) - 1
    none = F.lit(0).cast("long")

    def once(mask, x):
        """The boundaries after edge x; none of them from where an earlier edge would have to be next."""
        checked = F.get(F.transform(F.array(merged(mask, x)), lambda m: F.when(F.exists("e", lambda y: (y < x) & ready(m, y)), none).otherwise(m)), 0)
        return F.when(ready(mask, x), F.when(x.bitwiseAND(one) == 0, merged(mask, x)).otherwise(checked)).otherwise(mask)

    def step(mask, _):
        return F.coalesce(F.get(F.transform(F.filter("e", lambda x: ready(mask, x)), lambda x: merged(mask, x)), 0), mask)

    m = g.withColumn("once", F.aggregate("e", every, once))
    m = m.withColumn("mask", F.when(F.col("once") != 0, F.col("once")).otherwise(F.aggregate(F.sequence(F.lit(1), n - 1), every, step)))
    path = F.filter("e", lambda x: here(F.col("mask"), x) == _shl(one, w(x)) + 1)
    return m.select("bucket", "unit", F.sort_array(F.transform(path, lambda x: _shr(x, F.lit(1)).bitwiseAND(F.lit((1 << 32) - 1)))).alias("path"))


def fold_viterbi(edges: DataFrame, unknown: float) -> DataFrame:
    """(bucket, unit, path): the best path by sum of scores.  A position without an edge is passed by one unknown character."""
    g = edges.groupBy("unit_no", "bucket", "unit").agg(F.sort_array(F.collect_list(F.struct((F.col("s") + F.col("w")).alias("t"), "s", "w", "id", "score"))).alias("e"))
    n = F.length("unit")
    cell = "struct<score:double,s:int,id:int>"
    start = F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(F.when(i == 0, 0.0).cast("double").alias("score"), F.lit(-1).alias("s"), F.lit(-1).alias("id")).cast(cell))

    def relax(acc, t):
        """Cell t from the edges that end there, or one unknown character."""
        blank = F.struct((F.get(acc, t - 1)["score"] + unknown).alias("score"), (t - 1).alias("s"), F.lit(-1).alias("id")).cast(cell)
        best = F.aggregate(F.filter("e", lambda x: x["t"] == t), F.when(F.exists("e", lambda x: (x["t"] == t) & (x["w"] == 1)), F.lit(None).cast(cell)).otherwise(blank), lambda b, x: F.when(b.isNull() | (F.get(acc, x["s"])["score"] + x["score"] > b["score"]), F.struct((F.get(acc, x["s"])["score"] + x["score"]).alias("score"), x["s"].alias("s"), x["id"].alias("id")).cast(cell)).otherwise(b))
        return F.transform(acc, lambda c, i: F.when(i == t, best).otherwise(c))

    cells = g.withColumn("c", F.aggregate(F.sequence(F.lit(1), n), start, relax))
    none = F.array().cast("array<struct<s:int,w:int,id:int>>")
    back = F.aggregate(
        F.sequence(F.lit(1), n),
        F.struct(n.alias("at"), none.alias("path")),
        lambda a, _: F.when(a["at"] <= 0, a).otherwise(
            F.struct(F.get("c", a["at"])["s"].alias("at"), F.array_prepend(a["path"], F.struct(F.get("c", a["at"])["s"].alias("s"), (a["at"] - F.get("c", a["at"])["s"]).alias("w"), F.get("c", a["at"])["id"].alias("id"))).alias("path"))
        ),
    )
    path = F.transform(F.filter(back["path"], lambda x: x["id"] >= 0), lambda x: _shl(x["s"].cast("long"), F.lit(26)) + _shl(x["w"].cast("long"), F.lit(20)) + x["id"])
    return cells.select("bucket", "unit", F.sort_array(path).alias("path"))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, t, file, row) of docs; a table that isn't read straight from Parquet is written first."""
    cols = [col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("t")]
    where = [F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    try:
        return docs.select(*cols, *where)
    except AnalysisException:
        return written(docs.select(*cols), "texts").select("doc_id", "t", *where)


def _block(file: np.ndarray, row: np.ndarray) -> np.ndarray:
    return (file * np.int64(0x9E3779B97F4A7C1 | 1)) ^ (row >> BLOCK_BITS)


def _unit_lists(rows: DataFrame, model: Model, buckets: int) -> DataFrame:
    """(bucket, block, units): the distinct units of more than one character of each block that a task reads, in one text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        now = None

        def flush() -> Iterator[pa.RecordBatch]:
            by: dict[int, list[str]] = {}
            for u in seen:
                if len(u) == 1:
                    continue
                by.setdefault(zlib.crc32(u.encode("utf-8", "surrogatepass")) % buckets, []).append(u)
            for k, us in by.items():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([now], pa.int64()), pa.array([model.sep.join(sorted(us))], pa.string())], ["bucket", "block", "units"])

        for b in batches:
            block = _block(b.column(2).to_numpy(), b.column(3).to_numpy())
            for s in range(0, b.num_rows, 256):
                texts = [t or "" for t in b.column(1).slice(s, 256).to_pylist()]
                for k, us in zip(block[s : s + 256].tolist(), model.splits(texts)):
                    if k != now:
                        if now is not None:
                            yield from flush()
                        seen, now = set(), k
                    seen.update(us)
        if now is not None:
            yield from flush()

    return rows.mapInArrow(run, "bucket int, block long, units string")


def dictionary(spark: SparkSession, rows: DataFrame, model: Model) -> str:
    """Writes (block, units, sizes, codes), partitioned by block, to the shared folder: the units in one text, how many ids each has, and
    all ids packed."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lists = written(_unit_lists(rows, model, 4 * parts), "units")
    routed = lists.repartition(parts, "bucket")
    units = routed.select("bucket", F.explode(F.split("units", "\\Q" + model.sep + "\\E")).alias("unit")).groupBy("bucket", "unit").agg(F.count(F.lit(1)).alias("n")).select("bucket", "unit").where(F.length("unit") <= MASK_CHARS)
    edges = lattice(units, piece_table(spark, model), model.longest, 2 if model.bpe else 1)
    unknown = min((model.scores[i] for i in model.usable.values()), default=0.0) - 10
    paths = fold_merges(edges) if model.bpe else fold_viterbi(edges, unknown)

    def pack(left: pa.Table, right: pa.Table) -> pa.Table:
        path = dict(zip(left["unit"].to_pylist(), left["path"].to_pylist()))
        width = np.dtype(model.kind).itemsize
        ids = np.arange(len(model.pieces), dtype=model.kind).tobytes()
        code: dict[str, bytes] = {}

        def encode(u: str) -> bytes:
            if len(u) > MASK_CHARS:
                return model.merge(u) if model.bpe else model.viterbi(u)
            out, at = [], 0
            for x in path.get(u) or ():
                b = x >> 26 & 63
                if b > at:
                    out += [model.char(c) for c in u[at:b]]
                i = (x & 0xFFFFF) * width
                out.append(ids[i : i + width])
                at = b + (x >> 20 & 63)
            return b"".join(out + [model.char(c) for c in u[at:]])

        blocks, units, sizes, codes = [], [], [], []
        for block, text in zip(right["block"].to_pylist(), right["units"].to_pylist()):
            got = []
            for u in text.split(model.sep):
                if (c := code.get(u)) is None:
                    code[u] = c = encode(u)
                got.append(c)
            blocks.append(block)
            units.append(text)
            sizes.append(np.fromiter(map(len, got), np.int64, len(got)).astype(np.uint32) // width)
            codes.append(b"".join(got))
        small = [x.astype(np.uint8).tobytes() if x.max() < 256 else x.tobytes() for x in sizes]
        return pa.table({"block": pa.array(blocks, pa.int64()), "units": pa.array(units, pa.string()), "sizes": pa.array(small, pa.binary()), "codes": pa.array(codes, pa.binary())})

    out = scratch_path(spark, "dictionary")
    packed = paths.groupBy("bucket").cogroup(routed.select(F.col("bucket").alias("of"), "block", "units").groupBy("of")).applyInArrow(pack, "block long, units string, sizes binary, codes binary")
    write(packed.repartition("block"), out, "block")
    dropped(lists)
    return out


class Codes(dict):
    """ids, packed, of units; those of one character are in no dictionary and come from the model."""

    def __init__(self, model: Model) -> None:
        self.model = model

    def __missing__(self, unit: str) -> bytes:
        if len(unit) > 1:
            raise KeyError(unit)
        self[unit] = code = self.model.char(unit)
        return code


class Lookup:
    """One block's dictionary at a time."""

    def __init__(self, path: str, model: Model) -> None:
        self.path, self.model, self.block, self.code = path, model, None, Codes(model)

    def __call__(self, block: int) -> dict[str, bytes]:
        if block != self.block:
            import pyarrow.dataset as ds
            from pyarrow import fs

            system, base = fs.FileSystem.from_uri(self.path if "://" in self.path else self.path.replace("file:", "file://", 1) if self.path.startswith("file:") else "file://" + self.path)
            self.code = Codes(self.model)
            folder = f"{base}/block={block}"
            if system.get_file_info(folder).type == fs.FileType.Directory:
                width = np.dtype(self.model.kind).itemsize
                for x in ds.dataset(folder, filesystem=system, format="parquet").to_batches(columns=["units", "sizes", "codes"]):
                    for text, size, code in zip(*(c.to_pylist() for c in x.columns)):
                        us = text.split(self.model.sep)
                        n = np.frombuffer(size, np.uint8 if len(size) == len(us) else np.uint32).astype(np.int64) * width
                        end = np.cumsum(n)
                        self.code.update(zip(us, [code[a:b] for a, b in zip((end - n).tolist(), end.tolist())]))
            self.block = block
        return self.code


def _apply(rows: DataFrame, path: str, model: Model, decoded: bool) -> DataFrame:
    surface = model.surface()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Lookup(path, model)
        for b in batches:
            block = _block(b.column(2).to_numpy(), b.column(3).to_numpy()).tolist()
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                chunks, offsets, null, back = [], [0], [], []
                texts = part.column(1).to_pylist()
                for k, t, us in zip(block[s : s + 256], texts, model.splits([t or "" for t in texts])):
                    null.append(t is None)
                    got = np.frombuffer(b"".join(map(look(k).__getitem__, us)), model.kind) if t else np.zeros(0, model.kind)
                    chunks.append(got)
                    offsets.append(offsets[-1] + len(got))
                    if decoded:
                        back.append(None if t is None else _text(got.tolist(), surface, model))
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(chunks).astype(np.int32)), mask=pa.array(null, pa.bool_()))
                cols = [part.column(0), ids] + ([pa.array(back, pa.string())] if decoded else [])
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "ids", "decoded"][: len(cols)])

    return rows.mapInArrow(run, "doc_id long, ids array<int>" + ", decoded string" * decoded)


def _text(ids: list[int], surface: list[bytes], model: Model) -> str:
    out = b"".join(map(surface.__getitem__, ids)).decode("utf-8", "replace")
    return out[1:] if model.dummy_prefix and out[:1] == " " else out


def encode(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(doc_id, ids) of every row; with `decoded`, also the text that the ids decode to."""
    model = model or load()
    rows = _rows(docs, id_col, text_col)
    return _apply(rows, dictionary(docs.sparkSession, rows, model), model, decoded)


def decode(df: DataFrame, model: Model | None = None, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """df with the text of each array of ids; null for null.  If df has a column of the name out_col, a `_` is added."""
    model = model or load()
    surface = model.surface()
    at, out_col = df.columns.index(ids_col), free_name(df, out_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = pa.array([None if x is None else _text(x, surface, model) for x in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, text], [*b.schema.names, out_col])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(out_col, StringType())]))
