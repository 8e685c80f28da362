"""SentencePiece encoding and decoding by vectorised merge rounds.

A text's chunks (a run of spaces with what follows up to the next space; a line feed by itself) never share a piece,
so each distinct chunk is encoded once a worker: its characters become flat symbols, and merge rounds run over all
new chunks together. Characters without a piece fall back to bytes. Decoding joins the pieces' bytes by one gather.

Defined cases: a null text is an empty text, which has the end id only; repeated rows are encoded one by one; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ChunkTable, gather, joined, offsets, slices, small, sums, texts_of
from .merges import PairTable, merge_rounds

MARK = "▁"


class Pieces:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        text = [sp.id_to_piece(i) for i in range(size)]
        special = np.array([sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(size)])
        normal = {text[i]: i for i in range(size) if not special[i]}
        if any(MARK in p.lstrip(MARK) or "\n" in p and len(p) > 1 for p in normal):
            raise ValueError("a piece of this vocabulary holds a word mark or a line feed after other characters")
        score = np.array([sp.get_score(i) for i in range(size)])
        _, order = np.unique(-score, return_inverse=True)
        pairs = [(normal[p[:k]], normal[p[k:]], order[i], i) for p, i in normal.items() for k in range(1, len(p)) if p[:k] in normal and p[k:] in normal]
        self.pairs = PairTable(*np.array(pairs, np.int64).reshape(-1, 4).T)
        self.end = sp.eos_id()
        self.of_char = np.full(0x110000, -1, np.int32)
        for p, i in normal.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        self.of_byte = np.full(256, sp.unk_id(), np.int32)
        for i in range(size):
            if sp.is_byte(i):
                self.of_byte[int(text[i][3:5], 16)] = i
        raw = [b"" if sp.is_control(i) else bytes([int(text[i][3:5], 16)]) if sp.is_byte(i) else " ⁇ ".encode() if sp.is_unknown(i) else text[i].replace(MARK, " ").encode() for i in range(size)]
        self.raw, self.raw_len = np.frombuffer(b"".join(raw), np.uint8), np.array([len(r) for r in raw], np.int32)
        self.raw_at = offsets(self.raw_len)[:-1]
        digits = [b"%d " % i for i in range(size)]
        self.dec, self.dec_len = np.frombuffer(b"".join(digits), np.uint8), np.array([len(d) for d in digits], np.int32)
        self.dec_at = offsets(self.dec_len)[:-1]
        self.table = ChunkTable(self._chunks, np.uint16 if size <= 1 << 16 else np.int32)

    def _chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lens = np.fromiter(map(len, chunks), np.int64, len(chunks))
        points = np.frombuffer("".join(chunks).replace(" ", MARK).encode("utf-32-le"), np.uint32).astype(np.int64)
        symbols = self.of_char[points]
        unknown = symbols < 0
        symbols[unknown] = -2 - points[unknown]
        ids, sizes = merge_rounds(self.pairs, symbols, lens)
        lost = np.flatnonzero(ids < 0)
        if len(lost):  # each such character becomes its bytes
            raw = [chr(-2 - c).encode("utf-8", "surrogatepass") for c in ids[lost].tolist()]
            wide = np.ones(len(ids), np.int64)
            wide[lost] = [len(r) for r in raw]
            ends = np.cumsum(wide)
            sizes = sums(wide, sizes).astype(np.int32)
            ids = np.repeat(ids, wide)
            for k, r in zip(lost.tolist(), raw, strict=True):
                ids[ends[k] - len(r) : ends[k]] = self.of_byte[list(r)]
        return ids, sizes

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids, each text's followed by the end id, and how many each text has."""
        octets, begins = joined([t.replace(MARK, " ") for t in texts])  # the space before each text is the dummy prefix
        body = octets[:-9]  # without the gap after the last text
        begins = begins - 1
        space, line = body == 32, body == 10
        edge = space.copy()
        edge[1:] &= ~space[:-1]
        edge |= line
        edge[1:] |= line[:-1]
        edge[begins] = True
        starts = np.flatnonzero(edge)
        lens = np.diff(np.append(starts, len(body)))
        n = np.diff(np.append(np.searchsorted(starts, begins), len(starts)))
        empty = np.fromiter((not t for t in texts), bool, len(texts))
        if empty.any():
            keep = ~np.repeat(empty, n)
            starts, lens, n = starts[keep], lens[keep], np.where(empty, 0, n)
        ids, per = self.table.ids(self.table.look_up(octets, starts, lens))
        sizes = sums(per, n) + 1
        out = np.empty(len(ids) + len(texts), ids.dtype)
        ends = np.cumsum(sizes) - 1
        inner = np.ones(len(out), bool)
        inner[ends] = False
        out[inner], out[ends] = ids, self.end
        return out, sizes

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """UTF-8 of each text, without the dummy prefix."""
        lens = self.raw_len[ids]
        data, at = gather(self.raw, self.raw_at[ids], lens).tobytes(), offsets(sums(lens, sizes)).tolist()
        return [data[a + (data[a : a + 1] == b" " and a < b) : b] for a, b in zip(at, at[1:], strict=False)]

    def decimals(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """Each text's ids in decimal, joined by one space."""
        lens = self.dec_len[ids]
        data, at = gather(self.dec, self.dec_at[ids], lens).tobytes(), offsets(sums(lens, sizes)).tolist()
        return [data[a : b - 1] for a, b in zip(at, at[1:], strict=False)]


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _mapped(docs: DataFrame, model: str, id_col: str, text_col: str, columns: str, fill) -> DataFrame:
    names = [id_col, *(c.split()[0] for c in columns.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = pieces(model)
        for batch in small(batches):
            texts = texts_of(batch, "t")
            for a, b in slices(texts):
                yield pa.RecordBatch.from_arrays([batch.column("i").slice(a, b - a), *fill(coder, *coder.encode(texts[a:b]))], names)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("i"), docs[text_col].alias("t")).mapInArrow(run, f"`{id_col}` {kind}, {columns}")


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """ids of each row's text, with the end id, and the text that they decode to."""

    def fill(coder: Pieces, ids: np.ndarray, sizes: np.ndarray):
        return pa.ListArray.from_arrays(pa.array(offsets(sizes), pa.int32()), pa.array(ids, pa.int32())), pa.array([t.decode("utf-8", "replace") for t in coder.decode(ids, sizes)], pa.string())

    return _mapped(docs, model, id_col, text_col, "ids array<int>, decoded string", fill)


def digest_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Number and SHA-256 of each row's ids, and SHA-256 of the text that they decode to; no shuffle."""

    def fill(coder: Pieces, ids: np.ndarray, sizes: np.ndarray):
        sha = lambda raw: pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string())
        return pa.array(sizes, pa.int64()), sha(coder.decimals(ids, sizes)), sha(coder.decode(ids, sizes))

    return _mapped(docs, model, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", fill)
