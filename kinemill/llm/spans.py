"""Substring dedup by sliding sentence spans.

Every run of several consecutive sentences that is just long enough (two sentences and ``least_words`` words; the
shortest from each sentence on, and the shortest up to each sentence) is hashed. Hashes are grouped over all documents;
the first occurrence of a run stays, and every sentence that another occurrence covers is removed. So each repeated
passage of whole sentences with that many words goes, but for its first place. Case and spacing don't count.

A sentence ends after a word that ends in ``.``, ``!`` or ``?``, or at a line feed. Far from such ends it also ends
after each word whose hash is the smallest among ``REACH`` words on either side; an end of a sentence counts as smaller
than any. That rule looks at the near words alone, so a passage is cut alike wherever it stands, also if it begins or
ends within a sentence, or has no full stops. Words are runs without ASCII white space.

A run is known by 96 bits: a 64-bit hash and an independent 32-bit one, which only runs that agree in both share.

Defined cases: the first occurrence is the one in the document with the smallest id, and there the earliest; ids of
whole numbers go by value, ids of other types by their text; rows that share an id count as one document; a null id is
a document of its own, told by its text; a null text stays null; a text without words stays as it is; a text may become
empty; a very long text is worked on by itself; an empty table gives an empty result; all columns of the input are
kept, whatever their names, and the names of the two counts get underscores until they are free.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunk_hashes, discard, fresh, joined, scratch_path, slices, small, texts_of, words_of

LEAST_WORDS = 20
REACH = 4
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_ENDS = np.isin(np.arange(256), list(b".!?"))
_P, _Q = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F


def _run_hashes(words: np.ndarray, lo: np.ndarray, hi: np.ndarray, base: int) -> np.ndarray:
    """Hash of words[lo:hi] for each run: the difference of prefix sums of word * base**place, moved to the place 0."""
    n = len(words)
    power, back, prefix = np.full(n + 1, base, np.uint64), np.full(n + 1, pow(base, -1, 1 << 64), np.uint64), np.zeros(n + 1, np.uint64)
    power[0] = back[0] = 1
    power, back = np.cumprod(power), np.cumprod(back)
    np.cumsum(words * power[:n], out=prefix[1:])
    x = (prefix[hi] - prefix[lo]) * back[lo] + (hi - lo).astype(np.uint64)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class Sentences:
    """Sentences and runs of some texts, in flat arrays."""

    def __init__(self, texts: list[str], least_words: int):
        octets, self.begins = joined(texts)
        self.octets = octets
        starts, lens, self.words = words_of(octets, self.begins)
        n = len(starts)
        doc = np.repeat(np.arange(len(texts)), self.words)
        h = chunk_hashes(_LOWER[octets], starts, lens)
        lines = np.concatenate(([0], np.cumsum(octets == 10)))
        last = np.ones(n, bool)
        if n:
            last[:-1] = (doc[1:] != doc[:-1]) | (lines[starts[1:]] != lines[(starts + lens)[:-1]])
            last |= _ENDS[octets[starts + lens - 1]]
            rank = np.concatenate((np.zeros(REACH, np.uint64), np.where(last, np.uint64(0), h | np.uint64(1)), np.zeros(REACH, np.uint64)))
            near = rank
            for step in (1, 2, 4, 2 * REACH + 1 - 8):  # smallest of 2, 4, 8 and 9 consecutive words
                near = np.minimum(near[:-step], near[step:])
            last |= rank[REACH:-REACH] == near
        ends = np.flatnonzero(last) + 1
        self.first = np.concatenate(([0], ends))[:-1]  # first word of each sentence
        self.doc = doc[self.first]
        self.place = starts[self.first]
        self.count = np.bincount(self.doc, minlength=len(texts))
        bounds = np.concatenate((self.first, [n]))
        k = len(self.first)
        at, doc_to = np.arange(k), np.cumsum(self.count)
        to = np.maximum(np.searchsorted(bounds, self.first + least_words), at + 2)  # forward: the first boundary far enough
        fits = to <= doc_to[self.doc]
        a1, b1 = at[fits], to[fits]
        frm = np.minimum(np.searchsorted(bounds, bounds[1:] - least_words, side="right") - 1, at - 1)  # backward: the last one
        fits = frm >= (doc_to - self.count)[self.doc]
        a2, b2 = frm[fits], at[fits] + 1
        run = np.unique(np.concatenate((a1 * (k + 1) + b1, a2 * (k + 1) + b2)))
        self.a, self.b = run // (k + 1), run % (k + 1)
        self.run_doc = self.doc[self.a] if k else np.empty(0, np.int64)
        lo, hi = bounds[self.a], bounds[self.b]
        self.hash = _run_hashes(h, lo, hi, _P).view(np.int64)
        other = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        self.check = (_run_hashes(other ^ other >> np.uint64(32), lo, hi, _Q) >> np.uint64(32)).astype(np.uint32).view(np.int32)

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """Document and earliest place of each different run of each document."""
        order = np.lexsort((self.a, self.check, self.hash, self.run_doc))
        d, h, c = self.run_doc[order], self.hash[order], self.check[order]
        first = np.ones(len(order), bool)
        first[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1]) | (c[1:] != c[:-1])
        return d[first], order[first]

    def without(self, doomed: list[tuple[np.ndarray, np.ndarray] | None]) -> tuple[list[bytes], np.ndarray]:
        """Texts without the sentences that doomed runs or later copies in the same text cover, and their numbers."""
        gone = np.ones(len(self.a), bool)
        gone[self.distinct()[1]] = False
        cuts = np.searchsorted(self.run_doc, np.arange(len(doomed) + 1))
        for i, known in enumerate(doomed):
            if known is not None:
                order = np.lexsort(known[::-1])
                h, c, own = known[0][order], known[1][order], slice(cuts[i], cuts[i + 1])
                at = np.minimum(np.searchsorted(h, self.hash[own]), len(h) - 1)
                gone[own] |= (h[at] == self.hash[own]) & (c[at] == self.check[own])
        depth = np.zeros(len(self.first) + 1, np.int64)
        np.add.at(depth, self.a[gone], 1)
        np.add.at(depth, self.b[gone], -1)
        removed = np.cumsum(depth[:-1]) > 0
        n_removed = np.bincount(self.doc[removed], minlength=len(doomed))
        text_end = np.append(self.begins[1:] - 1, len(self.octets) - 9)
        data, out = self.octets.tobytes(), []
        until = np.append(self.place[1:], 0)
        at = np.cumsum(self.count) - self.count
        for i, hit in enumerate(n_removed.tolist()):
            lo, hi = int(self.begins[i]), int(text_end[i])
            if not hit:
                out.append(data[lo:hi])
                continue
            mine = range(int(at[i]), int(at[i] + self.count[i]))
            parts = [data[lo : int(self.place[mine[0]])]]
            parts += [data[int(self.place[s]) : int(until[s]) if s + 1 < mine.stop else hi] for s in mine if not removed[s]]
            out.append(b"".join(parts))
        return out, n_removed


def _key(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """What orders documents: a whole number, or for ids of other types a text."""
    id_, text = docs[id_col], docs[text_col]
    if isinstance(docs.schema[id_col].dataType, T.IntegralType):
        return F.coalesce(id_.cast("long"), F.xxhash64(text))
    return F.coalesce(id_.cast("string"), F.concat(F.lit("\uffff"), F.coalesce(F.sha2(text, 256), F.lit(""))))


def span_hashes(docs: DataFrame, id_col: str, text_col: str, least_words: int) -> DataFrame:
    """(hash, check, doc): each run once a document."""
    key = _key(docs, id_col, text_col)
    keyed = docs.select(key.alias("k"), docs[text_col].alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = texts_of(batch, "t")
            for a, b in slices(texts):
                found = Sentences(texts[a:b], least_words)
                doc, at = found.distinct()
                yield pa.RecordBatch.from_arrays([pa.array(found.hash[at]), pa.array(found.check[at]), batch.column("k").slice(a, b - a).take(pa.array(doc))], ["hash", "check", "doc"])

    return keyed.mapInArrow(run, f"hash long, check int, doc {keyed.schema['k'].dataType.simpleString()}")


def dedup_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, count_cols: tuple[str, str] = ("n_sentences", "n_removed")) -> DataFrame:
    """All columns, the text without repeated passages, and two numbers of sentences: all, and those removed.

    The runs' hashes are written once to the shared folder. Counting them combines before the shuffle, so a run in
    any number of documents is one row a task; the join back has one row a repeated run on its other side.
    """
    spark, path = docs.sparkSession, scratch_path(docs.sparkSession, "spans")
    hashes = span_hashes(docs, id_col, text_col, least_words)
    hashes.write.parquet(f"{path}/runs")
    spans = spark.read.schema(hashes.schema).parquet(f"{path}/runs")
    repeated = spans.groupBy("hash", "check").agg(F.min("doc").alias("first"), F.count("*").alias("n")).where("n > 1").select("hash", "check", "first")
    doomed = spans.join(repeated, ["hash", "check"]).where("doc <> first").groupBy("doc").agg(F.collect_list("hash").alias("h"), F.collect_list("check").alias("c"))
    doomed.write.parquet(f"{path}/doomed")
    discard(spark, f"{path}/runs")
    doomed = spark.read.schema(doomed.schema).parquet(f"{path}/doomed")
    names, counts = docs.columns, fresh(docs.columns, *count_cols)
    key, hash_col, check_col = fresh(docs.columns, "doc", "h", "c")
    keyed = docs.withColumn(key, _key(docs, id_col, text_col))
    both = keyed.join(doomed.toDF(key, hash_col, check_col), key, "left").select(*(F.col(f"`{c}`") for c in (*names, hash_col, check_col)))
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            known = batch.column(at)
            texts = [t or "" for t in known.to_pylist()]
            lists = batch.column(len(names)), batch.column(len(names) + 1)
            for a, b in slices(texts):
                pairs = [(h.values.to_numpy(), c.values.to_numpy()) if h.is_valid else None for h, c in zip(*(x.slice(a, b - a) for x in lists), strict=True)]
                found = Sentences(texts[a:b], least_words)
                cleaned, removed = found.without(pairs)
                part = batch.slice(a, b - a)
                cols = [part.column(i) for i in range(len(names))]
                valid = known.slice(a, b - a).is_valid().to_pylist()
                cols[at] = pa.array([c.decode() if v else None for c, v in zip(cleaned, valid, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([*cols, pa.array(found.count, pa.int64()), pa.array(removed, pa.int64())], [*names, *counts])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return both.mapInArrow(run, f"{kinds}, `{counts[0]}` long, `{counts[1]}` long")
