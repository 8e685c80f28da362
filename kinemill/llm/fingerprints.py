"""Document fingerprints from closed syncmers.

A k-mer of the UTF-8 bytes is a closed syncmer if the smallest hash of its inner s-mers stands at its first or last
place; whether it is one depends on its own bytes alone, so copies of a passage give the same anchors wherever they
stand. A fingerprint keeps the anchors with the smallest hashes over the whole text, in the order in which they
occur (8 hex digits each): LEAST of them, and one more for every SHARE different anchors that the text has, so that it
grows with the text. Likeness matches anchors by position: those of both texts that lie on one increasing chain,
against the anchors of the union up to the hash that both fingerprints reach, turned from a share of the union
(Jaccard) into a share of the texts (Dice).

Defined cases: a null text is an empty text, whose fingerprint is empty; a text too short for an anchor has one
anchor, the hash of the whole; two empty fingerprints are alike (1), an empty and another are not (0). Ids are numbers.
The next document is the next in descending order of id (nulls last and by a hash of their text, ties by text); the
last one's is the first; a document alone is its own next. A very long text is worked on by itself. An empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunk_hashes, shuffle_partitions, slices, small

S_MER, WINDOW = 8, 16
K_MER = S_MER + WINDOW - 1
LEAST, SHARE = 128, 32
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def anchors(octets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and 32-bit hashes of the closed syncmers of a byte array (eight spare bytes must follow it)."""
    n = len(octets) - 8
    if n < K_MER:
        return np.empty(0, np.int64), np.empty(0, np.uint32)
    eight = np.ndarray((len(octets) - 7,), "<u8", octets, strides=(1,))
    h = eight[: n - S_MER + 1] * _M1
    h ^= h >> np.uint64(32)
    h *= _M2
    inner = (h >> np.uint64(32)).astype(np.uint32)
    least, width = inner, 1
    while width < WINDOW:
        step = min(width, WINDOW - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    at = np.flatnonzero((inner[: len(least)] == least) | (inner[WINDOW - 1 :] == least))
    mixed = h[at] ^ (h[at + 8] * _M1) ^ (h[at + WINDOW - 1] * _M2)
    mixed ^= mixed >> np.uint64(29)
    mixed *= _M1
    return at, (mixed >> np.uint64(32)).astype(np.uint32)


def fingerprints(texts: list[str], least: int = LEAST, share: int = SHARE) -> list[bytes]:
    """Big-endian anchors of each text, in reading order."""
    out: list[bytes] = []
    for a, b in slices(texts, 250_000):
        raw = [t.encode() for t in texts[a:b]]
        lens = np.fromiter(map(len, raw), np.int64, len(raw))
        ends = np.cumsum(lens)
        octets = np.frombuffer(b"".join([*raw, bytes(8)]), np.uint8)
        at, mark = anchors(octets)
        doc = np.searchsorted(ends, at, side="right")
        inside = at + K_MER <= ends[doc]
        at, mark, doc = at[inside], mark[inside], doc[inside]
        bare = np.setdiff1d(np.flatnonzero(lens), doc)
        if len(bare):  # too short, or without an anchor
            begins = ends - lens
            at, doc = np.concatenate((at, begins[bare])), np.concatenate((doc, bare))
            mark = np.concatenate((mark, (chunk_hashes(octets, begins[bare], lens[bare]) >> np.uint64(32)).astype(np.uint32)))
        # the smallest distinct anchors of each text, at their first places
        key = doc.astype(np.uint64) << np.uint64(32) | mark.astype(np.uint64)
        key, first = np.unique(key, return_index=True)
        own = (key >> np.uint64(32)).astype(np.int64)
        rank = np.arange(len(key)) - np.searchsorted(own, np.arange(b - a))[own]
        kept = rank < (least + np.bincount(own, minlength=b - a) // share)[own]
        own, place, mark = own[kept], at[first[kept]], (key[kept] & np.uint64(0xFFFFFFFF)).astype(">u4")
        order = np.lexsort((place, own))
        data = mark[order].tobytes()
        cuts = np.searchsorted(own, np.arange(b - a + 1)) * 4
        out += [data[i:j] for i, j in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)]
    return out


def likeness(a: bytes, b: bytes, least: int = LEAST) -> float:
    """0 to 1: the share of the texts that lies on one increasing chain of common anchors."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    x, y = np.frombuffer(a, ">u4"), np.frombuffer(b, ">u4")
    # a fingerprint of fewer anchors holds all of its text's; of others, each knows the anchors up to its largest
    reach = min((int(v.max()) for v in (x, y) if len(v) >= least), default=1 << 32)
    xs, ys = x[x <= reach].tolist(), y[y <= reach].tolist()
    union = {*xs, *ys}
    place = {v: i for i, v in enumerate(ys)}
    tails: list[int] = []
    for v in xs:
        if (p := place.get(v)) is not None:
            i = bisect_left(tails, p)
            tails[i : i + 1] = [p]
    share = len(tails) / len(union)
    return 2 * share / (1 + share)


def above(cuts: list[float], value: Column) -> Column:
    """How many of the ascending cuts are larger than a value, by a search in two steps."""
    if not cuts:
        return F.lit(0)
    step = max(1, round(len(cuts) ** 0.5))
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    firsts, inner = F.array(*[F.lit(g[0]) for g in groups]), F.array(*[F.array(*map(F.lit, g)) for g in groups])
    below = F.size(F.filter(firsts, lambda c: c <= value))  # groups that begin at or below the value
    own = F.element_at(inner, F.greatest(below, F.lit(1)))
    return F.lit(len(cuts)) - F.when(below == 0, 0).otherwise((below - 1) * step + F.size(F.filter(own, lambda c: c <= value)))


_OUT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how near the edited and the next text's are.

    The edited text is the text with its last half replaced by as much of the next text's beginning. The ids are cut
    into ranges; each range also gets the first document of the next one. One shuffle, of the texts.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    parts = shuffle_partitions(spark)
    value, text = docs[id_col].cast("double"), F.coalesce(docs[text_col], F.lit(""))
    cuts = sorted({*docs.select(value.alias("d")).approxQuantile("d", [k / parts for k in range(1, parts)], 1 / (8 * parts))}) if parts > 1 else []
    lost = parts if docs.where(docs[id_col].isNull()).limit(1).count() else 0  # ranges for the rows without an id
    hashed = F.when(value.isNull(), F.xxhash64(text))
    # ranges in descending order of id, then the rows without one in ascending order of their hashes
    place = F.when(value.isNull(), len(cuts) + 1 + F.floor((hashed / float(1 << 64) + 0.5) * (1 - 1e-12) * max(1, lost)).cast("int")).otherwise(above(cuts, value))
    ranged = docs.select(docs[id_col].alias("id"), text.alias("text"), hashed.alias("hash"), place.alias("range"))
    # one row a range: at most twice as many as there are shuffle partitions
    heads = sorted((r["range"], r["top"], r["low"]) for r in ranged.groupBy("range").agg(F.max("id").alias("top"), F.min("hash").alias("low")).collect())
    n = len(cuts) + 1 + max(1, lost)
    tops, lows, before = [None] * n, [None] * n, [0] * n
    for k, (own, top, low) in enumerate(heads):
        tops[own], lows[own], before[own] = top, low, heads[k - 1][0]
    at = F.col("range")
    leads = F.col("id").eqNullSafe(F.array(*[F.lit(t).cast(kind) for t in tops])[at]) & F.col("hash").eqNullSafe(F.array(*[F.lit(t).cast("long") for t in lows])[at])
    here, there = F.struct(at.alias("range"), F.lit(0).alias("extra")), F.struct(F.array(*map(F.lit, before))[at].alias("range"), F.lit(1).alias("extra"))
    copies = F.when(leads, F.array(here, there)).otherwise(F.array(here))
    dealt = ranged.select("id", "text", "hash", F.explode(copies).alias("c")).select("id", "text", "c.range", "c.extra", "hash")
    order = [F.col("range"), F.col("extra"), F.col("id").desc_nulls_last(), F.col("hash"), F.col("text")]
    # a partition a range: hashed, several ranges would fall together
    dealt = dealt.repartitionById(n, "range").sortWithinPartitions(*order).drop("hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the last row so far: its next one isn't known yet
        for batch in small(batches):
            cols = [batch.column(k).to_pylist() for k in range(4)]
            for a, b in slices(cols[1]):
                rows = held + list(zip(*(c[a:b] for c in cols), strict=True))
                held = rows[-1:]
                yield from _edited(rows, batch.schema.field(0).type, id_col)

    return dealt.mapInArrow(run, f"`{id_col}` {kind}, {_OUT}")


def _edited(rows: list[tuple], kind: pa.DataType, id_col: str) -> Iterator[pa.RecordBatch]:
    """Results of all rows but the last, each with the row after it; copies of another range's first row have none."""
    texts = [r[1] for r in rows]
    own = fingerprints(texts)
    pairs = [k for k in range(len(rows) - 1) if not rows[k][3]]
    edited = [texts[k][: len(texts[k]) - len(texts[k]) // 2] + texts[k + 1][: len(texts[k]) // 2] for k in pairs]
    changed = fingerprints(edited)
    if pairs:
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([rows[k][0] for k in pairs], kind), pa.array([len(texts[k]) for k in pairs], pa.int64()), pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]), pa.array([own[k].hex() for k in pairs]), pa.array([c.hex() for c in changed]),
                pa.array([likeness(own[k], c) for k, c in zip(pairs, changed, strict=True)], pa.float64()), pa.array([likeness(own[k], own[k + 1]) for k in pairs], pa.float64()),
            ],
            [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )
