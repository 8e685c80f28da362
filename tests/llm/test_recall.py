"""Recall of the forest's ascent by similarity, against exact prefix filtering."""

from __future__ import annotations

import os
from collections import defaultdict

import duckdb
import numpy as np

from kinemill.llm import near

SF = os.environ.get("RECALL_SF", "/root/testdata/sf0.01")


def test_recall_by_similarity():
    texts = [r[0] for r in duckdb.sql(f"SELECT DISTINCT text FROM '{SF}/documents.parquet' WHERE text IS NOT NULL").fetchall()]
    sets, keys, nodes = [], [], {}
    last = near.prefix_length()
    for lo in range(0, len(texts), 100):
        flat, sizes = near.gram_sets(texts[lo : lo + 100])
        k = iter(near.trie_keys(flat, sizes, near.TREES, near.DEPTH, last).view(np.uint64))
        ends = np.cumsum(sizes)
        for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
            if b > a:
                own = next(k)
                if nodes.setdefault(flat[a:b].tobytes(), len(sets)) == len(sets):
                    sets.append(flat[a:b])
                    keys.append(own)
    # pairs of a similarity of 0.8 share one of the rarest fifth of their grams
    grams, count = np.unique(np.concatenate(sets), return_counts=True)
    index, alike = defaultdict(list), {}
    for i, s in enumerate(sets):
        rare = s[np.lexsort((s, count[np.searchsorted(grams, s)]))]
        for g in rare[: int(np.floor(len(s) * (1 - near.THRESHOLD))) + 1].tolist():
            for j in index[g]:
                if (j, i) not in alike and min(len(sets[j]), len(s)) >= near.THRESHOLD * max(len(sets[j]), len(s)):
                    both = len(np.intersect1d(sets[j], s, assume_unique=True))
                    alike[j, i] = both / (len(sets[j]) + len(s) - both)
            index[g].append(i)
    pairs = {p: v for p, v in alike.items() if v >= near.THRESHOLD}
    width, open_, found, weakest = near.key_bits(near.DEPTH, last), [True] * len(sets), set(), [2.0] * len(sets)
    level_of = {}
    for a, b in pairs:
        x = keys[a] ^ keys[b]
        level_of[a, b] = max((level for level in range(last, near.DEPTH + 1) if (x >> np.uint64(width * (near.DEPTH - level)) == 0).any()), default=0)
    for level in range(near.DEPTH, last - 1, -1):
        for (a, b), v in pairs.items():
            if level_of[a, b] == level and (open_[a] or open_[b]):
                found.add((a, b))
                weakest[a], weakest[b] = min(weakest[a], v), min(weakest[b], v)
        open_ = [not near.least_similarity(level) <= w <= 1 for w in weakest]
    bands = {}
    for low, high in ((0.8, 0.85), (0.85, 0.9), (0.9, 0.95), (0.95, 1.01)):
        own = [p for p, v in pairs.items() if low <= v < high]
        if own:
            bands[low] = (len(own), len(found.intersection(own)) / len(own))
    print(bands)
    assert all(recall >= 0.97 for _, recall in bands.values())
