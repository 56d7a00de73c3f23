"""Operator 3: media columns: progressive JPEG to RGB tensors in numpy.

Scans are accumulated into one coefficient array per component: DC and AC bands (spectral selection), first and refining
passes (successive approximation), end-of-band runs and restart intervals; baseline frames are the case of one full scan.  Then coefficients
are dequantised, transformed back by two matrix products over all blocks at once, chroma is repeated to full resolution, and YCbCr
(or grey) becomes RGB of full resolution.

Defined results: null bytes give null pixels and null error; empty, damaged, truncated or unsupported files (12 bits, arithmetic coding, four components), and pictures of more
than `max_pixels`, give null pixels and the reason in `error`.  A null id passes through; repeated rows are decoded each.  Only the id and bytes columns are read.

`encode` writes progressive files (used to make media columns from tables without images, and in tests).
"""

from __future__ import annotations

from functools import lru_cache

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import col, map_slices

_ZZ = sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8) if (i // 8 + i % 8) % 2 else i % 8))
ZIGZAG = np.array(_ZZ)
COS = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(0.125) if u == 0 else 0.5) for x in range(8)] for u in range(8)])
#: A picture of more pixels is reported as an error: its header alone would claim the memory for it.
MAX_PIXELS = 1 << 24
SCHEMA = "id long, height int, width int, channels int, pixels binary, error string"


class Broken(ValueError):
    pass


@lru_cache(maxsize=256)
def _table(spec: bytes) -> list[int]:
    """For each 16-bit window: length << 8 | symbol, or 0."""
    out, code, at = [0] * 65536, 0, 16
    for length in range(1, 17):
        for _ in range(spec[length - 1]):
            if at >= len(spec) or code >= 1 << length:
                raise Broken("bad Huffman table")
            a = code << (16 - length)
            out[a : a + (1 << (16 - length))] = [length << 8 | spec[at]] * (1 << (16 - length))
            code, at = code + 1, at + 1
        code <<= 1
    return out


class Bits:
    def __init__(self, segment: bytes) -> None:
        b = np.frombuffer(segment.replace(b"\xff\x00", b"\xff") + b"\0" * 8, np.uint8).astype(np.int64)
        self.window = ((b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]).tolist()
        self.at, self.end = 0, 8 * (len(b) - 8)

    def symbol(self, table: list[int]) -> int:
        at = self.at
        if at >= self.end:
            raise Broken("truncated")
        x = table[(self.window[at >> 3] >> (16 - (at & 7))) & 0xFFFF]
        if not x:
            raise Broken("bad code")
        self.at = at + (x >> 8)
        return x & 255

    def take(self, n: int) -> int:
        at = self.at
        self.at = at + n
        if self.at > self.end:
            raise Broken("truncated")
        return (self.window[at >> 3] >> (32 - (at & 7) - n)) & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        if not n:
            return 0
        v = self.take(n)
        return v if v >> (n - 1) else v - (1 << n) + 1


class Component:
    def __init__(self, ident: int, h: int, v: int, tq: int) -> None:
        self.ident, self.h, self.v, self.tq = ident, h, v, tq


def _scan(frame: dict, comps: list, ss: int, se: int, ah: int, al: int, dc: list, ac: list, segments: list[bytes]) -> None:
    """Decodes one scan into the components' coefficients."""
    whole = len(comps) > 1
    if whole:
        units = [(c, i) for i, c in enumerate(comps)]
        across, down = frame["mcu_x"], frame["mcu_y"]
    else:
        c = comps[0]
        across, down = -(-(-(-frame["w"] * c.h // frame["hmax"])) // 8), -(-(-(-frame["h"] * c.v // frame["vmax"])) // 8)
        units = [(c, 0)]
    total, every = across * down, frame["restart"] or across * down
    if len(segments) < -(-total // every):
        raise Broken("truncated")
    for part in range(-(-total // every)):
        bits, pred, run = Bits(segments[part]), [0] * len(comps), 0
        for mcu in range(part * every, min(total, (part + 1) * every)):
            my, mx = divmod(mcu, across)
            for c, i in units:
                for v in range(c.v if whole else 1):
                    for h in range(c.h if whole else 1):
                        block, base = c.flat, 64 * ((my * c.v + v) * c.across + mx * c.h + h if whole else my * c.across + mx)
                        if frame["kind"] != 2:
                            pred[i] += bits.signed(bits.symbol(dc[i]))
                            block[base] = pred[i]
                            _first(block, base, bits, ac[i], 1, 63, 0, 0)
                        elif ss == 0:
                            if ah == 0:
                                pred[i] += bits.signed(bits.symbol(dc[i]))
                                block[base] = pred[i] << al
                            elif bits.take(1):
                                block[base] |= 1 << al
                        elif ah == 0:
                            run = _first(block, base, bits, ac[i], ss, se, al, run)
                        else:
                            run = _refine(block, base, bits, ac[i], ss, se, al, run)


def _first(block: memoryview, base: int, bits: Bits, table: list[int], ss: int, se: int, al: int, run: int) -> int:
    if run:
        return run - 1
    k = ss
    while k <= se:
        rs = bits.symbol(table)
        r, s = rs >> 4, rs & 15
        if s:
            k += r
            if k > se:
                raise Broken("band overrun")
            block[base + _ZZ[k]] = bits.signed(s) * (1 << al)
            k += 1
        elif r == 15:
            k += 16
        else:
            return (1 << r) - 1 + (bits.take(r) if r else 0)
    return 0


def _refine(block: memoryview, base: int, bits: Bits, table: list[int], ss: int, se: int, al: int, run: int) -> int:
    plus, k = 1 << al, ss
    if not run:
        while k <= se:
            rs = bits.symbol(table)
            r, s = rs >> 4, rs & 15
            value = 0
            if s:
                value = plus if bits.take(1) else -plus
            elif r < 15:
                run = (1 << r) + (bits.take(r) if r else 0)
                break
            while k <= se:
                z = base + _ZZ[k]
                c = block[z]
                if c:
                    if bits.take(1) and not abs(c) & plus:
                        block[z] = c + plus if c > 0 else c - plus
                elif r == 0:
                    if value:
                        block[z] = value
                    k += 1
                    break
                else:
                    r -= 1
                k += 1
    if run:
        while k <= se:
            z = base + _ZZ[k]
            c = block[z]
            if c and bits.take(1) and not abs(c) & plus:
                block[z] = c + plus if c > 0 else c - plus
            k += 1
        run -= 1
    return run


def decode(data: bytes, max_pixels: int = MAX_PIXELS) -> np.ndarray:
    """(height, width, 3) of uint8."""
    if len(data) < 4 or data[:2] != b"\xff\xd8":
        raise Broken("not a JPEG file")
    quant: dict[int, np.ndarray] = {}
    huff: dict[tuple[int, int], list[int]] = {}
    frame: dict | None = None
    comps: list[Component] = []
    at, restart, ended = 2, 0, False
    while at + 4 <= len(data) or (at + 2 <= len(data) and data[at : at + 2] == b"\xff\xd9"):
        if data[at] != 0xFF:
            raise Broken("marker expected")
        m = data[at + 1]
        if m == 0xFF:
            at += 1
            continue
        if m == 0xD9:
            ended = True
            break
        n = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + n]
        if n < 2 or len(body) != n - 2:
            raise Broken("truncated")
        at += 2 + n
        if m == 0xDB:
            p = 0
            while p < len(body):
                wide, tq = body[p] >> 4, body[p] & 15
                q = np.frombuffer(body[p + 1 : p + 1 + 64 * (1 + wide)], ">u2" if wide else np.uint8)
                if len(q) != 64:
                    raise Broken("bad quantisation table")
                quant[tq] = q.astype(np.int64)
                p += 1 + 64 * (1 + wide)
        elif m == 0xC4:
            p = 0
            while p < len(body):
                size = sum(body[p + 1 : p + 17])
                huff[body[p] >> 4, body[p] & 15] = _table(bytes(body[p + 1 : p + 17 + size]))
                p += 17 + size
        elif m == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif m in (0xC0, 0xC1, 0xC2):
            if frame or body[0] != 8 or body[5] not in (1, 3) or len(body) < 6 + 3 * body[5]:
                raise Broken("unsupported frame")
            h, w = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            if not h or not w:
                raise Broken("empty frame")
            comps = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
            if any(not 1 <= x <= 4 for c in comps for x in (c.h, c.v)):
                raise Broken("bad sampling")
            hmax, vmax = max(c.h for c in comps), max(c.v for c in comps)
            frame = {"kind": m & 15, "h": h, "w": w, "hmax": hmax, "vmax": vmax, "mcu_x": -(-w // (8 * hmax)), "mcu_y": -(-h // (8 * vmax))}
            if h * w > max_pixels:
                raise Broken("too many pixels")
            for c in comps:
                c.across, c.down = frame["mcu_x"] * c.h, frame["mcu_y"] * c.v
                c.coef = np.zeros((c.down, c.across, 8, 8), np.int32)
                c.flat = memoryview(c.coef.reshape(-1))
        elif m in (0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF):
            raise Broken("unsupported coding")
        elif m == 0xDA:
            if not frame:
                raise Broken("scan before frame")
            k = body[0]
            ids = [body[1 + 2 * i] for i in range(k)]
            in_scan = [next((c for c in comps if c.ident == x), None) for x in ids]
            if not in_scan or None in in_scan:
                raise Broken("unknown component")
            sel = [body[2 + 2 * i] for i in range(k)]
            ss, se, a = body[1 + 2 * k], body[2 + 2 * k], body[3 + 2 * k]
            # entropy-coded data: up to the next marker that isn't a restart
            segments, begin, p = [], at, at
            while True:
                p = data.find(b"\xff", p)
                if p < 0 or p + 1 >= len(data):
                    raise Broken("truncated")
                if data[p + 1] == 0:
                    p += 2
                elif 0xD0 <= data[p + 1] <= 0xD7:
                    segments.append(data[begin:p])
                    p += 2
                    begin = p
                elif data[p + 1] == 0xFF:
                    p += 1
                else:
                    break
            segments.append(data[begin:p])
            at = p
            frame["restart"] = restart
            try:
                full = frame["kind"] != 2
                dc = [huff[0, x >> 4] if full or (ss == 0 and a >> 4 == 0) else [] for x in sel]
                ac = [huff[1, x & 15] if full or ss > 0 else [] for x in sel]
            except KeyError:
                raise Broken("missing Huffman table") from None
            if not full and (se > 63 or ss > se or (ss > 0 and k > 1)):
                raise Broken("bad scan")
            _scan(frame, in_scan, ss, se, a >> 4, a & 15, dc, ac, segments)
    if not frame:
        raise Broken("no frame")
    if not ended:
        raise Broken("truncated")
    planes = []
    for c in comps:
        if c.tq not in quant:
            raise Broken("missing quantisation table")
        q = np.zeros(64, np.int64)
        q[ZIGZAG] = quant[c.tq]
        px = COS.T @ (c.coef * q.reshape(8, 8).astype(float)) @ COS + 128
        plane = np.clip(np.rint(px), 0, 255).transpose(0, 2, 1, 3).reshape(8 * c.down, 8 * c.across)
        plane = np.repeat(np.repeat(plane, frame["vmax"] // c.v, 0), frame["hmax"] // c.h, 1)
        planes.append(plane[: frame["h"], : frame["w"]])
    return to_rgb(planes)


def to_rgb(planes: list[np.ndarray]) -> np.ndarray:
    if len(planes) == 1:
        return np.repeat(planes[0][..., None], 3, 2).astype(np.uint8)
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    return np.clip(np.rint(np.stack([y + 1.402 * cr, y - 0.344136286 * cb - 0.714136286 * cr, y + 1.772 * cb], 2)), 0, 255).astype(np.uint8)


# ---------------------------------------------------------------- encoder

_LENGTHS = bytes([0] * 7 + [128, 127] + [0] * 7)
_SPEC = _LENGTHS + bytes(range(255))
_DC_SPEC = bytes([0, 0, 0, 12] + [0] * 12) + bytes(range(12))  # sizes 0 to 11, 4 bits each
#: code and length of each symbol of the flat table: 128 symbols of 8 bits, 127 of 9
_CODE = [(i, 8) for i in range(128)] + [(256 + i, 9) for i in range(127)]
SCANS = ((None, 0, 0, 0, 1), (0, 1, 5, 0, 2), (2, 1, 63, 0, 1), (1, 1, 63, 0, 1), (0, 6, 63, 0, 2), (0, 1, 63, 2, 1), (None, 0, 0, 1, 0), (2, 1, 63, 1, 0), (1, 1, 63, 1, 0), (0, 1, 63, 1, 0))


class _Out:
    def __init__(self) -> None:
        self.parts: list[tuple[int, int]] = []

    def put(self, value: int, n: int) -> None:
        if n:
            self.parts.append((value & ((1 << n) - 1), n))

    def sym(self, s: int) -> None:
        self.parts.append(_CODE[s])

    def bytes(self) -> bytes:
        v, n = 0, 0
        out = bytearray()
        for x, k in self.parts:
            v, n = v << k | x, n + k
            while n >= 8:
                out.append(v >> (n - 8) & 255)
                n -= 8
                v &= (1 << n) - 1
        if n:
            out.append((v << (8 - n) | (1 << (8 - n)) - 1) & 255)
        return bytes(out).replace(b"\xff", b"\xff\x00")


def _eob(out: _Out, run: int, late: list[int]) -> None:
    if run:
        n = run.bit_length() - 1
        out.sym(n << 4)
        out.put(run, n)
    for b in late:
        out.put(b, 1)


def _write_ac(out: _Out, blocks: list[list[int]], ss: int, se: int, ah: int, al: int) -> None:
    run, late = 0, []
    for z in blocks:
        mag = [abs(c) >> al for c in z[ss : se + 1]]
        if ah == 0:
            last, r = max((i for i, m in enumerate(mag) if m), default=-1), 0
            if last >= 0:
                _eob(out, run, [])
                run = 0
            for i in range(last + 1):
                m = mag[i]
                if not m:
                    r += 1
                    continue
                while r > 15:
                    out.sym(0xF0)
                    r -= 16
                n = m.bit_length()
                out.sym(r << 4 | n)
                out.put(m if z[ss + i] > 0 else ~m, n)
                r = 0
            if last < len(mag) - 1:
                run += 1
        else:
            newest, r, own = max((i for i, m in enumerate(mag) if m == 1), default=-1), 0, []
            for i, m in enumerate(mag):
                if not m:
                    r += 1
                    continue
                while r > 15 and i <= newest:
                    _eob(out, run, late)
                    run, late = 0, []
                    out.sym(0xF0)
                    r -= 16
                    for b in own:
                        out.put(b, 1)
                    own = []
                if m > 1:
                    own.append(m & 1)
                    continue
                _eob(out, run, late)
                run, late = 0, []
                out.sym(r << 4 | 1)
                out.put(int(z[ss + i] > 0), 1)
                for b in own:
                    out.put(b, 1)
                own, r = [], 0
            if r or own:
                run += 1
                late += own
                if run == 0x7FFF or len(late) > 900:
                    _eob(out, run, late)
                    run, late = 0, []
        if run == 0x7FFF:
            _eob(out, run, late)
            run, late = 0, []
    _eob(out, run, late)


def encode(rgb: np.ndarray, quality: int = 8, subsample: bool = True) -> bytes:
    """A progressive JPEG file of an RGB array; quality: the quantiser of the lowest frequencies, growing with frequency."""
    h, w = rgb.shape[:2]
    x = rgb.astype(float)
    y = 0.299 * x[..., 0] + 0.587 * x[..., 1] + 0.114 * x[..., 2]
    planes = [y, (x[..., 2] - y) / 1.772 + 128, (x[..., 0] - y) / 1.402 + 128]
    s = 2 if subsample else 1
    q = np.array([min(255, quality + quality * (i // 8 + i % 8) // 2) for i in range(64)])
    mx, my = -(-w // (8 * s)), -(-h // (8 * s))
    coef = []
    for i, p in enumerate(planes):
        p = np.pad(p, ((0, my * 8 * s - h), (0, mx * 8 * s - w)), mode="edge")
        if i and s == 2:
            p = p.reshape(my * 8, 2, mx * 8, 2).mean((1, 3))
        b = p.reshape(p.shape[0] // 8, 8, p.shape[1] // 8, 8).transpose(0, 2, 1, 3) - 128
        c = np.rint((COS @ b @ COS.T).reshape(*b.shape[:2], 64) / q).astype(int)
        coef.append(c[..., ZIGZAG])
    out = b"\xff\xd8\xff\xe0\x00\x10JFIF\x00\x01\x01\x00\x00\x01\x00\x01\x00\x00"
    out += b"\xff\xdb\x00\x43\x00" + bytes(q[ZIGZAG].tolist())
    out += b"\xff\xc2\x00\x11\x08" + h.to_bytes(2, "big") + w.to_bytes(2, "big") + bytes([3, 1, s << 4 | s, 0, 2, 0x11, 0, 3, 0x11, 0])
    for cls, spec in ((0, _DC_SPEC), (0x10, _SPEC)):
        out += b"\xff\xc4" + (3 + len(spec)).to_bytes(2, "big") + bytes([cls]) + spec
    for comp, ss, se, ah, al in SCANS:
        ids = [0, 1, 2] if comp is None else [comp]
        o = _Out()
        if comp is None:
            pred = [0, 0, 0]
            for m in range(mx * my):
                for i in ids:
                    k = s if i == 0 else 1
                    for v in range(k):
                        for u in range(k):
                            c = int(coef[i][m // mx * k + v, m % mx * k + u, 0])
                            if ah:
                                o.put(c >> al & 1, 1)
                            else:
                                d = (c >> al) - pred[i]
                                pred[i] = c >> al
                                n = abs(d).bit_length()
                                o.put(n, 4)
                                o.put(d if d >= 0 else d - 1, n)
        else:
            k = s if comp else 1
            bw, bh = -(-(-(-w // k)) // 8), -(-(-(-h // k)) // 8)
            _write_ac(o, coef[comp][:bh, :bw].reshape(-1, 64).tolist(), ss, se, ah, al)
        out += b"\xff\xda" + (6 + 2 * len(ids)).to_bytes(2, "big") + bytes([len(ids)]) + b"".join(bytes([i + 1, 0]) for i in ids) + bytes([ss, se, ah << 4 | al]) + o.bytes()
    return out + b"\xff\xd9"


def decode_column(media: DataFrame, id_col: str = "id", bytes_col: str = "jpeg", max_pixels: int = MAX_PIXELS) -> DataFrame:
    """(id, height, width, channels, pixels, error) of every row; pixels in rows of RGB bytes."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list] = [[], [], [], [], []]
        for data in b.column(1).to_pylist():
            got: tuple = (None, None, None, None, None)
            if data is not None:
                try:
                    x = decode(bytes(data), max_pixels)
                    got = (x.shape[0], x.shape[1], 3, x.tobytes(), None)
                except Broken as e:
                    got = (None, None, None, None, str(e))
                except (IndexError, ValueError, OverflowError, MemoryError):
                    got = (None, None, None, None, "damaged")
            for c, v in zip(cols, got):
                c.append(v)
        types = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
        return pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(cols, types)]], ["id", "height", "width", "channels", "pixels", "error"])

    return map_slices(media.select(col(id_col).cast("long").alias("id"), col(bytes_col).cast("binary").alias("jpeg")), run, SCHEMA, 64)


def picture(vector: np.ndarray) -> np.ndarray:
    """An RGB image that all values of a vector determine: three channels of a square grid of them, smoothly enlarged.
    Up to 48 values make 16 x 16 pixels; more make a grid of g x g and 8g - 3 by 8g + 5 pixels, several MCUs with padded edges."""
    g = max(4, math.ceil(math.sqrt(len(vector) / 3)))
    v = np.resize(np.nan_to_num(vector.astype(float)), 3 * g * g)
    lo, hi = v.min(), v.max()
    grid = ((v - lo) / (hi - lo or 1) * 255).reshape(g, g, 3)
    height, width = (16, 16) if g == 4 else (8 * g - 3, 8 * g + 5)
    y, x = np.linspace(0, g - 1, height), np.linspace(0, g - 1, width)
    i, k = np.minimum(y.astype(int), g - 2), np.minimum(x.astype(int), g - 2)
    f, e = (y - i)[:, None, None], (x - k)[None, :, None]
    rows = grid[i] * (1 - f) + grid[i + 1] * f
    out = rows[:, k] * (1 - e) + rows[:, k + 1] * e
    return np.rint(out).astype(np.uint8)


def media_of_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, jpeg): a progressive JPEG file for every row; null for a null vector."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        files = [None if v is None else encode(picture(np.array([np.nan if x is None else x for x in v] or [0.0]))) for v in b.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(files, pa.binary())], ["id", "jpeg"])

    return map_slices(table.select(col(id_col).cast("long").alias("id"), col(vector_col).alias("v")), run, "id long, jpeg binary", 64)
