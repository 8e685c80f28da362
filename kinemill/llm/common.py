"""Helpers shared by the operators: table access, shared storage, ragged numpy arrays."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Characters that one numpy pass works on; bounds the working memory of a Python worker.
SLICE_CHARS = 500_000
#: Rows that are turned into Python objects at once.
PART_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; the package lies on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary folder only in local mode where none is set, as in tests."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named is None:
        named = getattr(sc, "_kinemill_checkpoints", None)
        if named is None:
            if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            named = sc._kinemill_checkpoints = "file://" + tempfile.mkdtemp(prefix="kinemill-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, below a folder of this application that goes when the driver ends."""
    sc = spark.sparkContext
    own = f"{ensure_checkpoint_dir(spark).rstrip('/')}/kinemill/{sc.applicationId}"
    if getattr(sc, "_kinemill_scratch", None) != own:
        sc._kinemill_scratch = own
        atexit.register(discard, spark, own)
    return f"{own}/{what}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that no result reads any more."""
    with contextlib.suppress(Exception):  # at the driver's end the JVM may be gone
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def fresh(taken: Iterable[str], *wanted: str) -> list[str]:
    """The wanted names, with underscores before those that are taken already (Spark's names ignore case)."""
    used, out = {t.lower() for t in taken}, []
    for name in wanted:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small(batches: Iterable[pa.RecordBatch], rows: int = PART_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in parts of a few rows, without copies; what the allocators keep is given back after each batch."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)
        del batch
        _give_back()


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def slices(texts: list[str], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``limit`` characters; a longer text is a range of its own."""
    lo = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def offsets(lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of flat[starts[i] : starts[i] + lengths[i]]."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    at = np.arange(total, dtype=np.int64)
    at += np.repeat(starts - (ends - lengths), lengths)
    return flat[at]


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_M3 = np.uint64(0xD6E8FEB86659FD93)
_R = np.uint64(31)


def chunk_hashes(octets: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """64-bit hashes of octets[starts[i] : starts[i] + lens[i]]; eight octets at least must follow the last chunk."""
    eight = np.ndarray((len(octets) - 7,), "<u8", octets, strides=(1,))
    h = (eight[starts] & _MASKS[np.minimum(lens, 8)]) + lens.astype(np.uint64) * _M2
    h *= _M1
    h ^= h >> _R
    more, done = np.flatnonzero(lens > 8), 8
    while len(more):
        left = lens[more] - done
        x = h[more] ^ (eight[starts[more] + done] & _MASKS[np.minimum(left, 8)])
        x *= _M1
        x ^= x >> _R
        h[more] = x
        more, done = more[left > 8], done + 8
    h *= _M2
    h ^= h >> _R
    return h


def chunk_checks(octets: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """What tells chunks of equal chunk_hashes() apart: the length for those of up to eight octets, which with the hash
    tells them exactly, and 64 more bits for the others."""
    out = lens.astype(np.uint64)
    more, done = np.flatnonzero(lens > 8), 0
    eight = np.ndarray((len(octets) - 7,), "<u8", octets, strides=(1,))
    while len(more):
        left = lens[more] - done
        x = (out[more] + (eight[starts[more] + done] & _MASKS[np.minimum(left, 8)])) * _M3
        x ^= x >> np.uint64(29)
        out[more] = x
        more, done = more[left > 8], done + 8
    return out


class ChunkTable:
    """Ids that each chunk of text becomes, computed once a worker; chunks are known by hash and check.

    ``encode`` takes a list of new chunks (str) and returns (flat ids, lengths). The table starts anew once it
    holds ``limit`` chunks, so its memory is bounded.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], dtype, limit: int = 1_000_000):
        self.encode, self.dtype, self.limit = encode, dtype, limit
        self.reset()

    def reset(self) -> None:
        self.bits = 16
        self.row_of = np.full(1 << self.bits, -1, np.int32)
        self.hashes = np.empty(1 << 14, np.uint64)
        self.checks = np.empty(1 << 14, np.uint64)
        self.flat = np.empty(1 << 16, self.dtype)
        self.starts = np.empty(1 << 14, np.int64)
        self.lens = np.empty(1 << 14, np.int32)
        self.rows = self.used = 0

    @staticmethod
    def _room(a: np.ndarray, used: int, more: int) -> np.ndarray:
        if used + more <= len(a):
            return a
        out = np.empty(max(used + more, len(a) * 3 // 2), a.dtype)
        out[:used] = a[:used]
        return out

    def _find(self, h: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Rows of chunks, -1 for those that are new."""
        slots = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        rows = self.row_of[slots]
        other = lambda r, on: (r >= 0) & ((self.hashes[r] != h[on]) | (self.checks[r] != check[on]))
        on = np.flatnonzero(other(rows, slice(None)))
        while len(on):
            slots[on] = (slots[on] + 1) & (len(self.row_of) - 1)
            rows[on] = self.row_of[slots[on]]
            on = on[other(rows[on], on)]
        return rows

    def _insert(self, h: np.ndarray, rows: np.ndarray) -> None:
        slots, todo = (h >> np.uint64(64 - self.bits)).astype(np.int64), np.arange(len(h))
        while len(todo):
            at = slots[todo]
            free = self.row_of[at] < 0
            self.row_of[at[free]] = rows[todo[free]]  # of several, the last stays
            todo = todo[self.row_of[at] != rows[todo]]
            slots[todo] = (slots[todo] + 1) & (len(self.row_of) - 1)

    def look_up(self, octets: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Row of each chunk in ``starts`` and ``lens`` of this table; they hold until the next call."""
        if self.rows > self.limit:
            self.reset()
        h, check = chunk_hashes(octets, starts, lens), chunk_checks(octets, starts, lens)
        rows = self._find(h, check)
        missing = np.flatnonzero(rows < 0)
        if len(missing):
            order = missing[np.lexsort((check[missing], h[missing]))]
            head = np.ones(len(order), bool)
            head[1:] = (h[order[1:]] != h[order[:-1]]) | (check[order[1:]] != check[order[:-1]])
            first = order[head]
            n, data = len(first), octets.tobytes()
            a, b = starts[first].tolist(), (starts[first] + lens[first]).tolist()
            flat, sizes = self.encode([data[i:j].decode() for i, j in zip(a, b, strict=True)])
            self.starts, self.lens, self.hashes, self.checks = (self._room(x, self.rows, n) for x in (self.starts, self.lens, self.hashes, self.checks))
            self.flat = self._room(self.flat, self.used, len(flat))
            self.flat[self.used : self.used + len(flat)] = flat
            at = slice(self.rows, self.rows + n)
            self.lens[at], self.hashes[at], self.checks[at] = sizes, h[first], check[first]
            self.starts[at] = self.used + np.cumsum(sizes) - sizes
            while (self.rows + n) * 2 > len(self.row_of):
                self.bits += 1
                self.row_of = np.full(1 << self.bits, -1, np.int32)
                if (self.rows + n) * 2 <= len(self.row_of):
                    self._insert(self.hashes[: self.rows], np.arange(self.rows, dtype=np.int32))
            new = np.arange(self.rows, self.rows + n, dtype=np.int32)
            self._insert(h[first], new)
            rows[order] = new[np.cumsum(head) - 1]
            self.rows += n
            self.used += len(flat)
        return rows

    def ids(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the rows one after another, and how many each row has."""
        lens = self.lens[rows]
        return gather(self.flat, self.starts[rows], lens), lens


def joined(texts: list[str], gap: str = " ") -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 of the texts, ``gap`` before the first and after each, with eight spare octets; where each text begins."""
    raw = [t.encode() for t in texts]
    starts = np.fromiter(map(len, raw), np.int64, len(raw)) + len(gap)
    return np.frombuffer(b"".join([gap.encode(), gap.encode().join(raw), gap.encode(), bytes(8)]), np.uint8), np.cumsum(starts) - starts + len(gap)


def words_of(octets: np.ndarray, text_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of runs free of ASCII white space in joined() texts, and the number in each text."""
    body = octets[:-8]
    inside = (body > 32).view(np.int8)
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edge[::2], edge[1::2]
    at = np.searchsorted(starts, text_starts)
    return starts, ends - starts, np.diff(np.append(at, len(starts)))


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of each consecutive group of ``counts`` values."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def counted(parts: list[list[str]]) -> tuple[Iterable[str], np.ndarray]:
    """A flat view of lists, and each list's length."""
    return chain.from_iterable(parts), np.fromiter(map(len, parts), np.int64, len(parts))


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """A text column; a null becomes an empty text."""
    return [t or "" for t in batch.column(column).to_pylist()]
