"""Merges of symbol pairs for many words at once, in rounds over flat numpy arrays."""

from __future__ import annotations

import numpy as np

from .common import gather

NONE = np.iinfo(np.int32).max
_MIX = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """(left, right) -> (rank, merged symbol), as an open-addressing hash table in numpy."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray):
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        size = 1 << self.bits
        self.keys = np.full(size, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.rank = np.full(size, NONE, np.int32)
        self.merged = np.zeros(size, np.int32)
        slots, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[slots[todo]] == np.uint64(0xFFFFFFFFFFFFFFFF)
            _, first = np.unique(slots[todo], return_index=True)
            takes = np.zeros(len(todo), bool)
            takes[first] = True
            takes &= free
            at = todo[takes]
            self.keys[slots[at]], self.rank[slots[at]], self.merged[slots[at]] = keys[at], rank[at], merged[at]
            todo = todo[~takes]
            slots[todo] = (slots[todo] + 1) & (size - 1)
        # A merge is unsafe to do at several places at once if a pair with its result comes earlier.
        best = np.full(int(max(left.max(initial=0), right.max(initial=0), merged.max(initial=0))) + 1, NONE, np.int64)
        np.minimum.at(best, left, rank)
        np.minimum.at(best, right, rank)
        self.one_by_one = np.zeros(int(rank.max(initial=0)) + 1, bool)
        self.one_by_one[rank[best[merged] <= rank]] = True

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks (NONE if there is no such pair) and merged symbols. A negative symbol is in no pair."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64) & np.uint64(0xFFFFFFFF)
        slots = self._slot(keys)
        found = self.keys[slots]
        rank, merged = self.rank[slots], self.merged[slots]
        wrong = np.flatnonzero(found != keys)
        rank[wrong] = NONE
        wrong = wrong[found[wrong] != np.uint64(0xFFFFFFFFFFFFFFFF)]
        while len(wrong):
            slots[wrong] = (slots[wrong] + 1) & (len(self.keys) - 1)
            found = self.keys[slots[wrong]]
            hit = wrong[found == keys[wrong]]
            rank[hit], merged[hit] = self.rank[slots[hit]], self.merged[slots[hit]]
            wrong = wrong[(found != keys[wrong]) & (found != np.uint64(0xFFFFFFFFFFFFFFFF))]
        return rank, merged


def merge_rounds(table: PairTable, symbols: np.ndarray, lengths: np.ndarray, group: int = 8000) -> tuple[np.ndarray, np.ndarray]:
    """Flat symbols and each word's number after all merges; ``group`` words at a time, to stay in the cache."""
    ends = np.concatenate(([0], np.cumsum(lengths)))
    parts = []
    for lo in range(0, len(lengths), group):
        hi = min(lo + group, len(lengths))
        parts.append(_rounds(table, symbols[ends[lo] : ends[hi]], lengths[lo:hi]))
    if not parts:
        return np.empty(0, np.int32), np.empty(0, np.int32)
    return tuple(map(np.concatenate, zip(*parts, strict=True)))


def _rounds(table: PairTable, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge each word's pairs by ascending rank, leftmost first, until no pair remains.

    Every round takes the smallest rank of each word, merges all its places at once from the left (only the
    first place where a pair with the result would come earlier), and compacts the arrays; words without pairs
    leave. Returns the flat symbols in the order of the words, and each word's number.
    """
    n = len(lengths)
    word = np.repeat(np.arange(n, dtype=np.int32), lengths)
    sym = symbols.astype(np.int32)
    done_word: list[np.ndarray] = []
    done_sym: list[np.ndarray] = []
    rank = np.full(len(sym), NONE, np.int32)
    result = np.zeros(len(sym), np.int32)
    same = np.flatnonzero(word[1:] == word[:-1])
    rank[same], result[same] = table.look_up(sym[same], sym[same + 1])
    while len(sym):
        starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        least = np.minimum.reduceat(rank, starts)
        least_at = np.repeat(least, np.diff(np.append(starts, len(sym))))
        over = least_at == NONE
        if over.any():
            done_word.append(word[over])
            done_sym.append(sym[over])
            stay = ~over
            word, sym, rank, result, least_at = word[stay], sym[stay], rank[stay], result[stay], least_at[stay]
            if not len(sym):
                break
        at = np.flatnonzero(rank == least_at)
        turn = np.arange(len(at))
        starts_run = np.ones(len(at), bool)
        starts_run[1:] = at[1:] != at[:-1] + 1
        take = (turn - np.maximum.accumulate(np.where(starts_run, turn, 0))) % 2 == 0
        first = np.ones(len(at), bool)
        first[1:] = word[at[1:]] != word[at[:-1]]
        take &= first | ~table.one_by_one[rank[at]]
        at = at[take]
        sym[at] = result[at]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        moved = at - np.arange(len(at))
        word, sym, rank, result = word[keep], sym[keep], rank[keep], result[keep]
        touched = np.zeros(len(sym) + 1, bool)
        touched[moved] = touched[moved - 1] = True  # before the first symbol: the spare last place
        stale = np.flatnonzero(touched[:-1])
        rank[stale] = NONE
        stale = stale[stale + 1 < len(sym)]
        stale = stale[word[stale] == word[stale + 1]]
        rank[stale], result[stale] = table.look_up(sym[stale], sym[stale + 1])
    if not done_word:
        return np.empty(0, np.int32), np.zeros(n, np.int32)
    word, sym = np.concatenate(done_word), np.concatenate(done_sym)
    lens = np.bincount(word, minlength=n)
    began = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    place = np.zeros(n, np.int64)
    place[word[began]] = began
    return gather(sym, place, lens), lens.astype(np.int32)
