"""Token counts by a linear longest-match automaton.

The vocabulary's pieces form a byte trie. Each node has a failure link and the number of pieces that are popped
when it is followed, so a word's greedy longest-match length comes from one pass over its bytes, and no piece is
ever built. A word is a run without ASCII white space, with the word mark before it. A character that no piece
holds counts one token a byte.

Defined cases: a null or empty text has 0 words and 0 tokens; repeated rows are counted one by one; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ChunkTable, joined, slices, small, sums, texts_of, words_of

MARK = "▁"


class LongestMatch:
    """Trie of byte strings with failure links; every single byte must be a piece, so matching never fails."""

    def __init__(self, pieces: list[bytes]):
        self.goto: dict[int, int] = {}  # node << 8 | byte -> node
        final = [False]
        for piece in {*pieces, *(bytes([b]) for b in range(256))}:
            node = 0
            for b in piece:
                nxt = self.goto.get(node << 8 | b)
                if nxt is None:
                    nxt = self.goto[node << 8 | b] = len(final)
                    final.append(False)
                node = nxt
            final[node] = True
        self.link, self.popped = [0] * len(final), [0] * len(final)
        edges: dict[int, list[tuple[int, int]]] = {}
        for key, child in self.goto.items():
            edges.setdefault(key >> 8, []).append((key & 255, child))
        queue = deque([0])
        while queue:
            node = queue.popleft()
            for b, child in edges.get(node, ()):
                queue.append(child)
                if final[child]:
                    self.popped[child] = 1  # and the link leads to the root
                else:
                    self.link[child], more = self._move(self.link[node], b)
                    self.popped[child] = self.popped[node] + more
        self.moves: dict[int, tuple[int, int]] = {}

    def _move(self, node: int, byte: int) -> tuple[int, int]:
        """The node after a byte, and how many pieces are popped on the way."""
        popped = 0
        while (nxt := self.goto.get(node << 8 | byte)) is None:
            popped += self.popped[node]
            node = self.link[node]
        return nxt, popped

    def count(self, word: bytes) -> int:
        node = total = 0
        moves = self.moves
        for b in word:
            key = node << 8 | b
            step = moves.get(key)
            if step is None:
                if len(moves) > 2_000_000:
                    moves.clear()
                step = moves[key] = self._move(node, b)
            node = step[0]
            total += step[1]
        while node:
            total += self.popped[node]
            node = self.link[node]
        return total


class PieceCounter:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.match = LongestMatch([sp.id_to_piece(i).encode() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))])
        self.table = ChunkTable(self._counts, np.int32)

    def _counts(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        count = self.match.count
        return np.fromiter((count((MARK + w).encode()) for w in words), np.int32, len(words)), np.ones(len(words), np.int32)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words and tokens of each text."""
        octets, begins = joined(texts)
        starts, lens, n = words_of(octets, begins)
        counts, _ = self.table.ids(self.table.look_up(octets, starts, lens))
        return n, sums(counts, n)


@lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """n_chars (code points), n_words and n_tokens of each row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary)
        for batch in small(batches):
            texts = texts_of(batch, "t")
            parts = [count(texts[a:b]) for a, b in slices(texts)]
            words, tokens = (np.concatenate([p[k] for p in parts]) if parts else np.empty(0, np.int64) for k in (0, 1))
            chars = np.fromiter(map(len, texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("i"), *map(pa.array, (chars, words, tokens))], [id_col, "n_chars", "n_words", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("i"), docs[text_col].alias("t")).mapInArrow(run, f"`{id_col}` {kind}, n_chars long, n_words long, n_tokens long")
