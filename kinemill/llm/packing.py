"""Cost-balanced packing of token sequences.

A document's cost is linear plus quadratic in its length (attention). Within a window, documents go by descending
cost to the sequence of lowest cost that has room for them; what fits nowhere whole is cut to fill the rooms that
remain. Every sequence is full but the last tokens of a partition, which become sequences of powers of two, so no
padding is needed. A partition is packed by itself, window by window: nothing is shuffled, and a worker holds the
ids of one window.

Defined cases: a null or empty text is the end id alone; repeated rows are packed one by one; a document longer than
a sequence is cut at full sequences first; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import offsets, slices, small, texts_of
from .word_bpe import word_bpe


class Packer:
    """Takes documents' ids; gives pieces (document, start, length, sequence, offset)."""

    def __init__(self, capacity: int, linear: float, quadratic: float):
        self.capacity, self.linear, self.quadratic = capacity, linear, quadratic
        self.sequences = 0
        self.costs: dict[int, float] = {}

    def cost(self, n: int) -> float:
        return self.linear * n + self.quadratic * n * n

    def _put(self, out: list, doc: int, start: int, length: int, seq: int, offset: int) -> None:
        out.append((doc, start, length, seq, offset))
        self.costs[seq] = self.costs.get(seq, 0.0) + self.cost(length)

    def pack(self, items: list[tuple[int, int, int]], last: bool) -> tuple[list[tuple], list[tuple[int, int, int]]]:
        """items: (document, start, length). Returns pieces and the items that are left for the next window."""
        full, out, rest = self.capacity, [], []
        self.costs = {}
        for doc, start, length in items:
            while length >= full:
                self._put(out, doc, start, full, self.sequences, 0)
                self.sequences += 1
                start, length = start + full, length - full
            if length:
                rest.append((doc, start, length))
        rest.sort(key=lambda x: -x[2])  # descending cost; stable, so the result is defined for ties
        first, n = self.sequences, sum(x[2] for x in rest) // full
        self.sequences += n
        room = [full] * n
        open_ = [(0.0, s) for s in range(n)]  # by cost
        tight: list[tuple[int, int]] = []  # by room, largest first: too little for the items so far
        whole_nowhere = []
        for doc, start, length in rest:
            while tight and -tight[0][0] >= length:
                s = heapq.heappop(tight)[1]
                heapq.heappush(open_, (self.costs.get(first + s, 0.0), s))
            while open_ and room[open_[0][1]] < length:
                s = heapq.heappop(open_)[1]
                if room[s]:
                    heapq.heappush(tight, (-room[s], s))
            if not open_:
                whole_nowhere.append((doc, start, length))
                continue
            s = heapq.heappop(open_)[1]
            self._put(out, doc, start, length, first + s, full - room[s])
            room[s] -= length
            heapq.heappush(open_, (self.costs[first + s], s))
        gaps = sorted((s for s in range(n) if room[s]), key=lambda s: room[s])
        left = []
        for doc, start, length in whole_nowhere:
            while length and gaps:
                s = gaps[-1]
                take = min(length, room[s])
                self._put(out, doc, start, take, first + s, full - room[s])
                room[s] -= take
                start, length = start + take, length - take
                if not room[s]:
                    gaps.pop()
            if length:
                left.append((doc, start, length))
        if last:
            remaining = sum(x[2] for x in left)
            size = room_now = 0
            for doc, start, length in left:
                while length:
                    if not room_now:
                        size = room_now = 1 << remaining.bit_length() - 1
                        self.sequences += 1
                    take = min(length, room_now)
                    self._put(out, doc, start, take, self.sequences - 1, size - room_now)
                    room_now, remaining = room_now - take, remaining - take
                    start, length = start + take, length - take
            left = []
        return out, left


SCHEMA = pa.schema([("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("sequence_cost", pa.float64())])


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = 4096, linear: float = 1.0, quadratic: float = 1 / 4096, window_tokens: int = 1 << 22, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row a piece. ``keep_ids`` adds the piece's ids; ``window_tokens`` bounds the ids that a worker holds."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, packer = word_bpe(vocabulary), Packer(capacity, linear, quadratic)
        base = TaskContext.get().partitionId() << 32
        held: dict[int, tuple[object, np.ndarray]] = {}
        items: list[tuple[int, int, int]] = []
        size = count = 0
        id_type = None

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal items, size, held
            pieces, items = packer.pack(items, last)
            for lo in range(0, len(pieces), 20_000):
                part = pieces[lo : lo + 20_000]
                ids = [held[d][1][s : s + n] for d, s, n, _, _ in part]
                data = [
                    pa.array([held[p[0]][0] for p in part], id_type), [p[1] for p in part], [p[2] for p in part], [zlib.crc32(x.astype("<u4")) for x in ids],
                    [len(held[p[0]][1]) for p in part], [base + p[3] for p in part], [p[4] for p in part], [packer.costs[p[3]] for p in part],
                ]
                names = [id_col, *SCHEMA.names]
                if keep_ids:
                    data.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays([data[0], *(pa.array(x, f.type) for x, f in zip(data[1:8], SCHEMA, strict=True)), *data[8:]], names)
            held = {d: held[d] for d in {i[0] for i in items}}
            size = sum(i[2] for i in items)

        for batch in small(batches):
            texts, keys, id_type = texts_of(batch, "t"), batch.column("i").to_pylist(), batch.column("i").type
            for a, b in slices(texts):
                ids, sizes = bpe.encode(texts[a:b])
                at = offsets(sizes)
                for k in range(a, b):
                    own = np.append(ids[at[k - a] : at[k - a + 1]], ids.dtype.type(end_id))
                    held[count] = (keys[k], own)
                    items.append((count, 0, len(own)))
                    count, size = count + 1, size + len(own)
                if size >= window_tokens:
                    yield from flush(False)
        if items:
            yield from flush(True)

    more = ", ids array<int>" if keep_ids else ""
    return docs.select(docs[id_col].alias("i"), docs[text_col].alias("t")).mapInArrow(
        run, f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_cost double{more}"
    )
