"""Media columns: progressive JPEG.

``decode`` accumulates spectral-selection and successive-approximation scans into coefficient arrays, applies the
inverse transform as one exact matrix product in numpy, upsamples the chroma planes and gives full-resolution RGB.
``encode_payload`` stores bytes losslessly in the format's unit, the quantised coefficient: a byte is a coefficient
of category 8 (128..255 or -255..-128), sent without its lowest bit in spectral bands first and refined after.

Defined cases: a null text is an empty text; payloads end in spaces up to a positive multiple of 192 bytes; equal
texts give equal media; repeated rows are stored one by one; media that is not a progressive JPEG is an error; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, small, texts_of

UNIT = 192
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))
_MARKER = re.compile(rb"\xff+[\x01-\xcf\xd8-\xfe]")
_RESTART = re.compile(rb"\xff[\xd0-\xd7]")
_SCALE = 1 << 20


@lru_cache(maxsize=64)
def _inverse(quant: bytes) -> np.ndarray:
    """Coefficients in zigzag order times this are pixels; whole numbers, so sums are exact in any order."""
    u = np.arange(8)
    basis = np.cos((2 * u[None, :] + 1) * u[:, None] * np.pi / 16) * np.where(u == 0, np.sqrt(0.5), 1.0)[:, None] / 2
    full = np.einsum("ux,vy->uvxy", basis, basis).reshape(64, 64)[ZIGZAG]
    return np.rint(full * np.frombuffer(quant, np.uint16)[:, None] * _SCALE)


@lru_cache(maxsize=64)
def _codes(spec: bytes) -> tuple[bytes, bytes]:
    """Length and symbol for every 16-bit window."""
    length, symbol = bytearray(1 << 16), bytearray(1 << 16)
    code, at = 0, 16
    for bits in range(1, 17):
        for _ in range(spec[bits - 1]):
            lo, n = code << 16 - bits, 1 << 16 - bits
            length[lo : lo + n], symbol[lo : lo + n] = bytes([bits]) * n, spec[at : at + 1] * n
            code, at = code + 1, at + 1
        code <<= 1
    return bytes(length), bytes(symbol)


@dataclass
class Component:
    ident: int
    h: int
    v: int
    table: int
    rows: int = 0  # blocks that non-interleaved scans hold
    cols: int = 0
    coefs: np.ndarray | None = None  # blocks of the padded grid, 64 coefficients in zigzag order each


class Bits:
    def __init__(self, data: bytes):
        self.data, self.at = data + bytes(8), 0
        self.count = 8 * len(data)
        self._all: np.ndarray | None = None

    @property
    def all(self) -> np.ndarray:
        if self._all is None:
            self._all = np.unpackbits(np.frombuffer(self.data, np.uint8))
        return self._all

    def peek(self) -> int:
        i = self.at >> 3
        d = self.data
        if i + 3 > len(d):
            raise ValueError("the scan ends early")
        return (d[i] << 16 | d[i + 1] << 8 | d[i + 2]) >> 8 - (self.at & 7) & 0xFFFF

    def take(self, n: int) -> int:
        if not n:
            return 0
        v = self.peek() >> 16 - n
        self.at += n
        return v

    def symbol(self, codes: tuple[bytes, bytes]) -> int:
        w = self.peek()
        n = codes[0][w]
        if not n:
            raise ValueError("no such code")
        self.at += n
        return codes[1][w]

    def many(self, n: int) -> np.ndarray:
        out = self.all[self.at : self.at + n]
        if len(out) < n or self.at + n > self.count:
            raise ValueError("the scan ends early")
        self.at += n
        return out


def _signed(bits: int, size: int) -> int:
    return bits if not size or bits >> size - 1 else bits - (1 << size) + 1


def _first_ac(bits: Bits, codes: tuple[bytes, bytes], flat: np.ndarray, band: int, low: int) -> None:
    """First scan of a band: ``flat`` holds the band's coefficients of the segment's blocks one after another."""
    pos, end, last = 0, len(flat), -1
    while pos < end:
        mark = bits.at
        sym = bits.symbol(codes)
        run, size = sym >> 4, sym & 15
        if sym == last and not run and size <= 8:
            # The same plain symbol again: see how far it repeats, and read those at once.
            bits.at = mark
            width, head = codes[0][bits.peek()] + size, codes[0][bits.peek()]
            want, got = min(64, end - pos), 0
            while want:
                m = min(want, (bits.count - bits.at) // width)
                rows = bits.all[bits.at : bits.at + m * width].reshape(m, width)
                other = np.flatnonzero((rows[:, :head] != rows[:1, :head]).any(axis=1)) if got == 0 else np.flatnonzero((rows[:, :head] != first).any(axis=1))
                if got == 0 and m:
                    first = rows[:1, :head].copy()
                good = int(other[0]) if len(other) else m
                v = np.packbits(rows[:good, head:], axis=1)[:, 0].astype(np.int32) >> 8 - size
                flat[pos : pos + good] = np.where(v >> size - 1, v, v - (1 << size) + 1) << low
                pos, got = pos + good, got + good
                bits.at += good * width
                want = min(16 * m, end - pos) if good == m and m else 0
            last = -1
            continue
        last = sym
        if size:
            pos += run
            flat[pos] = _signed(bits.take(size), size) << low
            pos += 1
        elif run == 15:
            pos += 16
        else:
            blocks = (1 << run) + bits.take(run)
            pos = (pos // band + blocks) * band
            last = -1


def _refine_ac(bits: Bits, codes: tuple[bytes, bytes], flat: np.ndarray, band: int, low: int) -> None:
    """Later scan of a band: one bit more for what is known, new coefficients of size one, runs over blocks."""
    pos, end, one = 0, len(flat), 1 << low

    def correct(lo: int, hi: int) -> None:
        at = lo + np.flatnonzero(flat[lo:hi])
        known = flat[at]
        flat[at] = known + np.sign(known) * bits.many(len(at)).astype(flat.dtype) * one

    while pos < end:
        sym = bits.symbol(codes)
        run, size = sym >> 4, sym & 15
        if not size and run < 15:
            stop = (pos // band + (1 << run) + bits.take(run)) * band
            correct(pos, min(stop, end))
            pos = stop
            continue
        value = (one if bits.take(1) else -one) if size else 0
        zeros = np.flatnonzero(flat[pos : (pos // band + 1) * band] == 0)
        stop = pos + int(zeros[run]) if run < len(zeros) else (pos // band + 1) * band - (size == 0)
        correct(pos, stop)
        if value:
            flat[stop] = value
        pos = stop + 1


def coefficients(data: bytes) -> tuple[int, int, list[Component], dict[int, bytes], bytes]:
    """Height, width, components with all scans accumulated, quantisation tables and the comment."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, quant, tables, parts, restart, comment = 2, {}, {}, [], 0, b""
    height = width = 0
    while True:
        while data[at + 1] == 0xFF:
            at += 1
        kind = data[at + 1]
        if kind == 0xD9:
            break
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if kind == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 1 + 64 * (1 + wide)
                quant[body[0] & 15] = np.frombuffer(body[1:n], ">u2" if wide else "u1").astype(np.uint16).tobytes()
                body = body[n:]
        elif kind == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                tables[body[0]] = body[1:n]
                body = body[n:]
        elif kind == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif kind == 0xFE:
            comment = body
        elif kind == 0xC2:
            _, height, width, count = struct.unpack(">BHHB", body[:6])
            parts = [Component(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * count, 3)]
            high, wide = max(p.v for p in parts), max(p.h for p in parts)
            mrows, mcols = -(-height // (8 * high)), -(-width // (8 * wide))
            for p in parts:
                p.rows, p.cols = -(-(-(-height * p.v // high)) // 8), -(-(-(-width * p.h // wide)) // 8)
                p.coefs = np.zeros((mrows * p.v, mcols * p.h, 64), np.int32)
        elif 0xC0 <= kind <= 0xCF:
            raise ValueError("not a progressive JPEG with Huffman codes")
        elif kind == 0xDA:
            chosen = [(next(p for p in parts if p.ident == body[1 + 2 * i]), body[2 + 2 * i]) for i in range(body[0])]
            ss, se, approx = body[1 + 2 * body[0] : 4 + 2 * body[0]]
            end = _MARKER.search(data, at)
            if end is None:
                raise ValueError("no end of the image")
            _scan(chosen, ss, se, approx >> 4, approx & 15, [Bits(s.replace(b"\xff\x00", b"\xff")) for s in _RESTART.split(data[at : end.start()])], restart, tables, mrows, mcols)
            at = end.end() - 2
    return height, width, parts, quant, comment


def _scan(chosen, ss, se, high, low, segments, restart, tables, mrows, mcols) -> None:
    if ss == 0:
        # blocks in the order of the scan, a row for each MCU
        order, units = [], []
        for p, _ in chosen:
            grid = np.arange(p.coefs.shape[0] * p.coefs.shape[1]).reshape(p.coefs.shape[:2])
            order.append(grid.reshape(mrows, p.v, mcols, p.h).transpose(0, 2, 1, 3).reshape(mrows * mcols, -1) if len(chosen) > 1 else grid[: p.rows, : p.cols].reshape(-1, 1))
            units.append(order[-1].shape[1])
        total, step = len(order[0]), restart or len(order[0])
        for k, bits in enumerate(segments):
            lo, hi = k * step, min(total, (k + 1) * step)
            if high:
                each = bits.many((hi - lo) * sum(units)).reshape(hi - lo, sum(units)).astype(np.int32)
                for c, (p, _) in enumerate(chosen):
                    p.coefs.reshape(-1, 64)[order[c][lo:hi], 0] |= each[:, sum(units[:c]) : sum(units[: c + 1])] << low
                continue
            found = [[] for _ in chosen]
            last = [0] * len(chosen)
            plan = [(c, _codes(tables[t >> 4])) for c, (_, t) in enumerate(chosen) for _ in range(units[c])]
            for _ in range(hi - lo):
                for c, codes in plan:
                    size = bits.symbol(codes)
                    last[c] += _signed(bits.take(size), size)
                    found[c].append(last[c])
            for c, (p, _) in enumerate(chosen):
                p.coefs.reshape(-1, 64)[order[c][lo:hi].ravel(), 0] = np.array(found[c], np.int32) << low
        return
    (p, table), band = chosen[0], se - ss + 1
    codes = _codes(tables[16 | table & 15])
    view = p.coefs[: p.rows, : p.cols, ss : se + 1]
    flat = view.reshape(-1) if high else np.zeros(p.rows * p.cols * band, np.int32)
    step = (restart or p.rows * p.cols) * band
    for k, bits in enumerate(segments):
        (_refine_ac if high else _first_ac)(bits, codes, flat[k * step : (k + 1) * step], band, low)
    view[...] = flat.reshape(view.shape)


def to_rgb(height: int, width: int, parts: list[Component], quant: dict[int, bytes]) -> np.ndarray:
    """height x width x 3 bytes."""
    planes = []
    high, wide = max(p.v for p in parts), max(p.h for p in parts)
    for p in parts:
        rows, cols = p.coefs.shape[:2]
        x = p.coefs.reshape(-1, 64).astype(np.float64) @ _inverse(quant[p.table])
        x = np.clip(np.floor(x / _SCALE + 0.5) + 128, 0, 255).astype(np.int32)
        x = x.reshape(rows, cols, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, cols * 8)
        planes.append(x.repeat(high // p.v, 0).repeat(wide // p.h, 1)[:height, :width])
    if len(planes) == 1:
        return np.repeat(planes[0][..., None], 3, 2).astype(np.uint8)
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    half = 1 << 15  # 16-bit fixed point of 1.402, 0.344136, 0.714136 and 1.772
    out = np.empty((height, width, 3), np.uint8)
    out[..., 0] = np.clip(y + (91881 * cr + half >> 16), 0, 255)
    out[..., 1] = np.clip(y - (22554 * cb + 46802 * cr + half >> 16), 0, 255)
    out[..., 2] = np.clip(y + (116130 * cb + half >> 16), 0, 255)
    return out


def decode(data: bytes) -> np.ndarray:
    return to_rgb(*coefficients(data)[:4])


def _segment(kind: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, kind, len(body) + 2) + body


#: Coefficients of category 7 take one bit before theirs; runs over blocks take five.
_AC_SPEC = bytes([1, 0, 0, 0, 15] + [0] * 11) + bytes([0x07] + [n << 4 for n in range(15)])
_DC_SPEC = bytes([0, 0, 0, 12] + [0] * 12) + bytes(range(12))
_TABLES = _segment(0xDB, b"\x00" + b"\x01" * 64) + _segment(0xC4, b"\x00" + _DC_SPEC + b"\x10" + _AC_SPEC)


def _packed(bits: np.ndarray) -> bytes:
    if len(bits) % 8:
        bits = np.concatenate((bits, np.ones(-len(bits) % 8, np.uint8)))
    return np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")


def _binary(value: int, size: int) -> np.ndarray:
    return np.array([value >> k & 1 for k in reversed(range(size))], np.uint8)


def _scan_header(idents: list[int], ss: int, se: int, high: int, low: int) -> bytes:
    return _segment(0xDA, bytes([len(idents), *(x for i in idents for x in (i, 0)), ss, se, high << 4 | low]))


def encode_payload(payload: bytes, n_bytes: int) -> bytes:
    """A 4:2:0 progressive JPEG whose coefficients are the payload's bytes; the comment holds its sizes."""
    units = -(-len(payload) // (2 * UNIT))
    cols = min(4095, int(np.ceil(np.sqrt(units))))
    rows = -(-units // cols)
    raw = np.full(rows * cols * 384, 32, np.uint8)
    raw[: len(payload)] = np.frombuffer(payload, np.uint8)
    blocks = raw.reshape(rows, cols, 6, 64)
    luma = blocks[:, :, :4].reshape(rows, cols, 2, 2, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 64)
    planes = {1: luma, 2: blocks[:, :, 4].reshape(-1, 64), 3: blocks[:, :, 5].reshape(-1, 64)}
    dc = raw[::64].reshape(-1, 6).astype(np.int32)
    dc = np.where(dc >= 128, dc, dc - 255)
    top = dc >> 1
    diff = np.empty_like(top)
    y = top[:, :4].ravel()
    diff[:, :4] = np.diff(y, prepend=0).reshape(-1, 4)
    diff[:, 4:] = np.diff(top[:, 4:], axis=0, prepend=0)
    diff = diff.ravel()
    size = np.frexp(np.abs(diff).astype(np.float64))[1].astype(np.int32)
    word = size << 12 | np.where(diff < 0, diff + (1 << size) - 1, diff) << 12 - size
    kept = np.arange(16) < (4 + size)[:, None]
    out = [
        b"\xff\xd8", _segment(0xFE, struct.pack(">QQ", n_bytes, len(payload))), _TABLES, _segment(0xC2, struct.pack(">BHHB", 8, rows * 16, cols * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])),
        _scan_header([1, 2, 3], 0, 0, 0, 1), _packed(np.unpackbits(word.astype(">u2").view(np.uint8)).reshape(-1, 16)[kept]),
    ]
    for ident, ss, se in ((1, 1, 5), (1, 6, 63), (2, 1, 63), (3, 1, 63)):
        out += [_scan_header([ident], ss, se, 0, 1), (planes[ident][:, ss : se + 1] >> 1).tobytes()]
    out += [_scan_header([1, 2, 3], 0, 0, 1, 0), _packed((dc & 1).astype(np.uint8).ravel())]
    for ident, plane in planes.items():
        body = plane[:, 1:]
        low, bits = (body & 1) ^ (body < 128), []
        for lo in range(0, len(plane), 32767):
            run = min(32767, len(plane) - lo)
            n = run.bit_length() - 1
            bits += [_binary(16 + n, 5), _binary(run - (1 << n), n), low[lo : lo + run].ravel()]
        out += [_scan_header([ident], 1, 63, 1, 0), _packed(np.concatenate(bits))]
    return b"".join([*out, b"\xff\xd9"])


def payload_of(parts: list[Component], size: int) -> bytes:
    """The bytes that encode_payload() stored."""
    rows, cols = parts[1].coefs.shape[:2]
    blocks = np.empty((rows, cols, 6, 64), np.int32)
    blocks[:, :, :4] = parts[0].coefs.reshape(rows, 2, cols, 2, 64).transpose(0, 2, 1, 3, 4).reshape(rows, cols, 4, 64)
    blocks[:, :, 4], blocks[:, :, 5] = parts[1].coefs, parts[2].coefs
    return np.where(blocks < 0, blocks + 255, blocks).astype(np.uint8).tobytes()[:size]


def feature_of(rgb: np.ndarray) -> str:
    """Size, means and deviations of the channels, and a 64-bit hash of which parts of an 8 x 8 grid are bright."""
    h, w = rgb.shape[:2]
    flat = rgb.reshape(-1, 3).astype(np.float64)  # sums of whole numbers below 2**53
    total, square, n = np.ones(len(flat)) @ flat, np.einsum("ij,ij->j", flat, flat), h * w
    grid = np.add.reduceat(np.add.reduceat(rgb.sum(2, dtype=np.int64), np.arange(8) * h // 8, 0), np.arange(8) * w // 8, 1).ravel()
    bright = int.from_bytes(np.packbits(grid * 64 > grid.sum()).tobytes(), "big")
    mean = ",".join(str(int(t) * 1000 // n) for t in total)
    spread = ",".join(str((n * int(s) - int(t) ** 2) * 1000 // (n * n)) for s, t in zip(square.tolist(), total.tolist(), strict=True))
    return f"{w}x{h}:{mean}:{spread}:{bright:016x}"


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the stored ``media`` of every row's text; no shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = texts_of(batch, "t")
            for a, b in slices(texts):
                media = []
                for t in texts[a:b]:
                    raw = t.encode()
                    media.append(encode_payload(raw + b" " * ((-len(raw)) % UNIT if raw else UNIT), len(raw)))
                yield pa.RecordBatch.from_arrays([batch.column("i").slice(a, b - a), pa.array(media, pa.binary())], [id_col, "media"])

    return docs.select(docs[id_col].alias("i"), docs[text_col].alias("t")).mapInArrow(run, f"`{id_col}` {kind}, media binary")


def tensors(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Full-resolution RGB of a media column: height, width and rgb (height x width x 3 bytes)."""
    kind = media.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            for i in range(batch.num_rows):
                data = batch.column("media")[i].as_py()
                rgb = None if data is None else decode(data)
                yield pa.RecordBatch.from_arrays([batch.column(id_col).slice(i, 1), *(pa.array([None if rgb is None else x], t) for x, t in ((rgb is not None and rgb.shape[0], pa.int32()), (rgb is not None and rgb.shape[1], pa.int32()), (rgb is not None and rgb.tobytes(), pa.binary())))], [id_col, "height", "width", "rgb"])

    return media.select(id_col, "media").mapInArrow(run, f"`{id_col}` {kind}, height int, width int, rgb binary")


def read_texts(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What the stored bytes of store_texts() hold, with features of the decoded picture; no shuffle."""
    kind = media.schema[id_col].dataType.simpleString()
    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows = []
            for data in batch.column("media").to_pylist():
                height, width, parts, quant, comment = coefficients(data)
                n_bytes, size = struct.unpack(">QQ", comment)
                payload = payload_of(parts, size)
                rows.append((n_bytes, size, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature_of(to_rgb(height, width, parts, quant))))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(id_col), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names)

    return media.select(id_col, "media").mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
