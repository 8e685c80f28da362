"""Ids of the ``tokenizers`` library for a BPE vocabulary with word ends, computed once a distinct chunk.

The vocabulary lower-cases, drops white space and splits into words before the merges, so white space is a
hard boundary: a text's ids are its chunks' ids one after another.
"""

from __future__ import annotations

import json
import re
from functools import cached_property, lru_cache
from pathlib import Path

import numpy as np

from .common import ChunkTable, counted, gather, joined, sums, words_of
from .merges import PairTable, merge_rounds

#: Texts with other characters go to the library whole: numbers beyond digits, letters whose lower case
#: depends on the context, marks that normalisation joins, and white space that Python splits differently.
_ODD = re.compile("[^\t\n\r -~\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f\u2010-\u2027\u20ac]")
#: The vocabulary's pattern of words, for the other characters.
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")


class WordBpe:
    def __init__(self, path: str):
        self.path = path
        whole = json.loads(Path(path).read_text())
        self.special, model = [t["content"] for t in whole["added_tokens"]], whole["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        column = lambda f: np.fromiter((vocab[f(a, b)] for a, b in pairs), np.int64, len(pairs))
        self.pairs = PairTable(column(lambda a, _: a), column(lambda _, b: b), np.arange(len(pairs)), column(lambda a, b: a + b))
        letters = byte_letters()
        self.inner = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[letters[b] + end] for b in range(256)], np.int32)
        self.table = ChunkTable(self._chunks, np.uint16 if len(vocab) <= 1 << 16 else np.uint32)

    @cached_property
    def tokenizer(self):
        """The library itself: only for odd texts."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        lens = np.fromiter(map(len, found), np.int32, len(found))
        return np.fromiter((i for ids in found for i in ids), self.table.dtype, int(lens.sum())), lens

    def _chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks without white space, in lower case."""
        words, n = counted(list(map(_WORD.findall, chunks)))
        index: dict[str, int] = {}
        rows = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, int(n.sum()))
        raw = [w.encode() for w in index]
        lens = np.fromiter(map(len, raw), np.int64, len(raw))
        octets = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.inner[octets]
        ends = np.cumsum(lens) - 1
        symbols[ends] = self.last[octets[ends]]
        ids, sizes = merge_rounds(self.pairs, symbols, lens)
        per_word = sizes[rows]
        return gather(ids, (np.cumsum(sizes) - sizes)[rows], per_word), sums(per_word, n).astype(np.int32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the number of each text's ids."""
        odd, plain = [], []
        for k, t in enumerate(texts):
            if _ODD.search(t) or any(s in t for s in self.special):
                odd.append(k)
                t = ""
            plain.append(t.lower())
        octets, begins = joined(plain)
        starts, lens, n = words_of(octets, begins)
        ids, lens = self.table.ids(self.table.look_up(octets, starts, lens))
        sizes = sums(lens, n)
        if odd:
            whole, those = self._library([texts[k] for k in odd])
            pieces, at, w = np.split(ids, np.cumsum(sizes)[:-1]) if len(sizes) else [], 0, 0
            for k, m in zip(odd, those, strict=True):
                pieces[k] = whole[at : at + m]
                at += m
                sizes[k] = m
            ids = np.concatenate(pieces).astype(self.table.dtype)
        return ids, sizes


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself where it prints, else the next of U+0100.."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in prints else next(spare)) for b in range(256)]


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    """One a worker process: its table stays warm from task to task."""
    return WordBpe(path)
