"""N-gram Jaccard join by a MinHash LSH forest.

Texts are sets of word five-grams (words are runs without ASCII white space, ASCII letters in lower case; fewer than
five words are one gram). Equal sets are one node. Each of the trees sorts the nodes by ``depth`` labels of its own, so
a prefix of the labels is a node of a trie. Matching goes up all tries together: first nodes that share the deepest
prefix in some tree are verified on their whole sets; then prefixes are shortened by one label, level by level, for
the nodes whose recall falls short. A node's recall at a level is estimated from the weakest link that it has: pairs of
that similarity meet in some tree with a known probability; a node without a link stays open. The ascent ends at the
level where pairs at the threshold meet with the target recall, so no node needs to go further.

No pair is ever a row. Within a prefix, tasks compare blocks of nodes by matrix products and return one row a node: how
many nodes it is linked to, the weakest of these links, and the smallest node of its group. A pair counts at the
deepest level, and there in the first tree, in which it meets, so links add up over tasks. Prefixes with members that
another tree or a deeper level had are compared once, and large ones are cut into pairs of blocks (a group of n
different near copies has n * n / 2 links to count; its lists travel n / block times, the least that tasks of that
memory allow). Groups join into classes by alternating star contraction with checkpoints.

Nodes are 128-bit hashes of the sets, grams 64-bit hashes. A trie key is one number: a hash of the labels down to the
last level of the ascent, then some bits of each deeper label.

Defined cases: a null, empty or blank text has no gram: all of these are one class without links; ids may be of any
type that sorts; class_id is the smallest id in the class, copy_id the smallest id with the same grams, both null if no
row there has an id (class_key tells such classes apart); n_links counts different gram sets, not copies; a null id
takes part by its text; rows that share an id are documents of their own; a text of any length is one set; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import chunk_hashes, discard, ensure_checkpoint_dir, fresh, joined, offsets, scratch_path, shuffle_partitions, slices, small, texts_of, words_of

GRAM, THRESHOLD, RECALL = 5, 0.8, 0.9999
TREES, DEPTH = 24, 8
BLOCK = 512
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_P = np.uint64(0x9E3779B97F4A7C15)


def prefix_length(trees: int = TREES, depth: int = DEPTH, threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """Longest prefix with which a pair at the threshold meets in some tree with probability ``recall``: the last level."""
    for k in range(depth, 0, -1):
        if 1 - (1 - threshold**k) ** trees >= recall:
            return k
    raise ValueError("more trees are needed for this recall")


def least_similarity(level: int, trees: int = TREES, recall: float = RECALL) -> float:
    """Pairs of this similarity share ``level`` labels in some tree with probability ``recall``."""
    return (1 - (1 - recall) ** (1 / trees)) ** (1 / level)


def key_bits(depth: int, last: int) -> int:
    """Bits of a trie key for each label beyond the last level."""
    return min(8, 24 // max(1, depth - last))


def gram_sets(texts: list[str], gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's grams, one text after another, and how many each has."""
    octets, begins = joined(texts)
    low = _LOWER[octets]
    starts, lens, n = words_of(octets, begins)
    word = chunk_hashes(low, starts, lens)
    doc = np.repeat(np.arange(len(texts)), n)
    ends = np.cumsum(n)
    if len(word) >= gram:
        h = word[: len(word) - gram + 1].copy()
        for k in range(1, gram):
            h *= _P
            h += word[k : len(word) - gram + 1 + k]
        inside = np.flatnonzero(np.arange(len(h)) + gram <= ends[doc[: len(h)]])
        h, own = h[inside], doc[inside]
    else:
        h, own = np.empty(0, np.uint64), np.empty(0, np.int64)
    few = np.flatnonzero((n > 0) & (n < gram))
    if len(few):
        more = np.zeros(len(few), np.uint64)
        for k in range(gram - 1):
            on = n[few] > k
            more[on] = more[on] * _P + word[(ends - n)[few[on]] + k] + np.uint64(1)
        h, own = np.concatenate((h, more)), np.concatenate((own, few))
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    order = np.lexsort((h, own))
    h, own = h[order], own[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    return h[first], np.bincount(own[first], minlength=len(texts))


def labels(sets: np.ndarray, sizes: np.ndarray, count: int, seed: int = 11) -> np.ndarray:
    """``count`` minima of independent hashes over each set that isn't empty."""
    rng = np.random.default_rng(seed)
    a, b = rng.integers(1, 1 << 32, count, np.uint32), rng.integers(0, 1 << 31, count, np.uint32) * np.uint32(2) + np.uint32(1)
    x = (sets ^ sets >> np.uint64(32)).astype(np.uint32)
    sizes = sizes[sizes > 0]
    starts = np.cumsum(sizes) - sizes
    out = np.empty((len(sizes), count), np.uint32)
    step = 1 << 15  # sets are cut at this many grams, so that every pass stays in the cache
    cuts = np.unique(np.concatenate((starts, np.arange(0, len(x), step))))
    owner = np.searchsorted(starts, cuts, side="right") - 1
    least = np.empty((len(cuts), count), np.uint32)
    for lo in range(0, len(x), step):
        part = x[lo : lo + step]
        at = np.searchsorted(cuts, [lo, lo + step])
        inner = cuts[at[0] : at[1]] - lo
        for j in range(count):
            v = (part ^ a[j]) * b[j]
            v ^= v >> np.uint32(15)
            v *= np.uint32(0x2C1B3C6D)
            v ^= v >> np.uint32(13)
            least[at[0] : at[1], j] = np.minimum.reduceat(v, inner)
    if len(sizes):
        out = np.minimum.reduceat(least, np.searchsorted(owner, np.arange(len(sizes))), axis=0)
    return out


def trie_keys(sets: np.ndarray, sizes: np.ndarray, trees: int, depth: int, last: int) -> np.ndarray:
    """The place of each set that isn't empty in every tree's sorted order."""
    mins = labels(sets, sizes, trees * depth).reshape(-1, trees, depth).astype(np.uint64)
    width = np.uint64(key_bits(depth, last))
    h = np.zeros(mins.shape[:2], np.uint64)
    for k in range(last):
        h = (h ^ mins[:, :, k]) * _P
        h ^= h >> np.uint64(32)
    h >>= width * np.uint64(depth - last)
    for k in range(last, depth):
        h = h << width | (mins[:, :, k] * _P) >> (np.uint64(64) - width)
    return h.view(np.int64)


def set_hashes(sets: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """16 octets for each set."""
    out = np.empty((len(sizes), 2), np.uint64)
    ends = np.cumsum(sizes)
    for k, by in enumerate((0xD6E8FEB86659FD93, 0xA0761D6478BD642F)):
        x = (sets + np.uint64(k + 1)) * np.uint64(by)
        x ^= x >> np.uint64(32)
        x *= _P
        x ^= x >> np.uint64(29)
        total = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x, out=total[1:])
        out[:, k] = (total[ends] - total[ends - sizes]) * np.uint64(0xBF58476D1CE4E5B9) + sizes.astype(np.uint64)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(np.arange(0, 16 * len(sizes) + 1, 16, dtype=np.int32)), pa.py_buffer(out)])


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root) for every node of the edges; the root is the smallest node that it is connected with.

    Large-star and small-star steps in turn, each round written to the shared checkpoint folder.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    mark = lambda e: tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    e = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v").distinct().checkpoint()
    before = mark(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct().checkpoint()
        after = mark(e)
        if after == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after


def _verify(sets: list[np.ndarray], keys: np.ndarray, open_: np.ndarray, side: np.ndarray, tree: int, up: int, cross: bool, threshold: float, width: int) -> tuple[np.ndarray, ...]:
    """Within a prefix (or, if ``cross``, between its two blocks): which are linked, to how many, their smallest, the weakest link.

    ``up`` is the number of labels by which the prefix is short of the whole depth. Only pairs with an open node that
    meet here first take part.
    """
    m, sizes = len(sets), np.fromiter(map(len, sets), np.int64, len(sets))
    linked = np.triu(open_[:, None] | open_[None, :], 1)
    if cross:
        linked &= side[:, None] != side[None, :]
    here, below = keys >> np.uint64(width * up), keys >> np.uint64(width * max(0, up - 1))
    for t in range(keys.shape[1]):
        if t < tree:
            linked &= here[:, t][:, None] != here[:, t][None, :]
        elif up:
            linked &= below[:, t][:, None] != below[:, t][None, :]
    none = np.empty(0, np.int64)
    if not linked.any():
        return none, none, none, none
    if m == 2:
        common = np.array([[0, len(np.intersect1d(*sets, assume_unique=True))]] * 2)
    else:
        _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(m), sizes)
        shared = count[column] > 1
        renamed = np.cumsum(count > 1) - 1
        row, column = row[shared], renamed[column[shared]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        step, common = 8192, np.zeros((m, m), np.float32)
        for lo in range(0, int(renamed[-1]) + 1 if len(renamed) else 0, step):
            a, b = np.searchsorted(column, [lo, lo + step])
            x = np.zeros((m, step), np.float32)
            x[row[a:b], column[a:b] - lo] = 1
            common += x @ x.T
    both = sizes[:, None] + sizes[None, :]
    # as fractions, so that a pair at the threshold counts
    linked &= common * (1 + threshold) >= threshold * both - 1e-6
    i, j = np.nonzero(linked)
    least = np.arange(m)
    while True:
        low = np.minimum(least[i], least[j])
        new = least.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        if (new == least).all():
            break
        least = new
    links = np.bincount(i, minlength=m) + np.bincount(j, minlength=m)
    weakest, alike = np.ones(m), common[i, j] / (both[i, j] - common[i, j])
    np.minimum.at(weakest, i, alike)
    np.minimum.at(weakest, j, alike)
    on = np.flatnonzero(links)
    return on, links[on], least[on], weakest[on]


def _text_keys(id_: Column, text: Column) -> list[Column]:
    """A row's key (spread by id and text, so that copies lie apart) and 128 bits that tell its text."""
    return [F.xxhash64(id_, text), F.xxhash64(text), F.xxhash64(F.lit(1), text)]


def _gram_table(docs: DataFrame, id_col: str, text_col: str, trees: int, depth: int, last: int, gram: int) -> DataFrame:
    """(id, k, t1, t2, node, n_grams, keys) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = texts_of(batch, "t")
            for a, b in slices(texts):
                sets, sizes = gram_sets(texts[a:b], gram)
                keys = trie_keys(sets, sizes, trees, depth, last)
                lists = pa.ListArray.from_arrays(pa.array(offsets((sizes > 0) * trees), pa.int32()), pa.array(keys.ravel(), pa.int64()))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("id", "k", "t1", "t2")), set_hashes(sets, sizes), pa.array(sizes, pa.int64()), lists], ["id", "k", "t1", "t2", "node", "n_grams", "keys"])

    names = zip(_text_keys(docs[id_col], docs[text_col]), ("k", "t1", "t2"), strict=True)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), *(c.alias(n) for c, n in names), docs[text_col].alias("t")).mapInArrow(run, f"id {kind}, k long, t1 long, t2 long, node binary, n_grams long, keys array<long>")


def _candidate_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, gram: int) -> DataFrame:
    """(node, keys, grams) of the wanted rows (k, t1, t2, node, keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = texts_of(batch, "t")
            for a, b in slices(texts):
                sets, sizes = gram_sets(texts[a:b], gram)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column("node"), part.column("keys"), pa.ListArray.from_arrays(pa.array(offsets(sizes), pa.int32()), pa.array(sets.view(np.int64), pa.int64()))], ["node", "keys", "grams"])

    keyed = docs.select(*(c.alias(n) for c, n in zip(_text_keys(docs[id_col], docs[text_col]), ("k", "t1", "t2"), strict=True)), docs[text_col].alias("t"))
    return keyed.join(wanted, ["k", "t1", "t2"]).select("t", "node", "keys").mapInArrow(run, "node binary, keys array<long>, grams array<long>")


def _links(work: DataFrame, up: int, threshold: float, width: int) -> DataFrame:
    """(node, links, least, weakest) from rows that stand together by (tree, prefix, i, j)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple] = {}  # a repeated row brings its node again
        key = None

        def closed() -> list[tuple]:
            if len(held) < 2:
                return []
            nodes = sorted(held)
            open_, side, sets, keys = zip(*(held[n] for n in nodes), strict=True)
            on, links, least, weakest = _verify(list(sets), np.array(keys).view(np.uint64), np.array(open_), np.array(side), key[0], up, key[2] != key[3], threshold, width)
            return [(nodes[a], n, nodes[b], w) for a, n, b, w in zip(on.tolist(), links.tolist(), least.tolist(), weakest.tolist(), strict=True)]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.binary(), pa.float64()), strict=True)], ["node", "links", "least", "weakest"])

        for batch in small(batches):
            rows: list[tuple] = []
            cols = [batch.column(k).to_pylist() for k in ("tree", "prefix", "i", "j", "node", "side", "open")]
            lists = []
            for k in ("grams", "keys"):
                c = batch.column(k)
                lists.append((c.offsets.to_numpy().tolist(), c.values.to_numpy()))
            (go, gv), (ko, kv) = lists
            for r, (tree, prefix, i, j, node, side, is_open) in enumerate(zip(*cols, strict=True)):
                if (tree, prefix, i, j) != key:
                    rows += closed()
                    held, key = {}, (tree, prefix, i, j)
                held[node] = (is_open, side, gv[go[r] : go[r + 1]].view(np.uint64), kv[ko[r] : ko[r + 1]])
            if rows:
                yield out(rows)
        if rows := closed():
            yield out(rows)

    return work.mapInArrow(run, "node binary, links long, least binary, weakest double")


def _linked(docs: DataFrame, id_col: str, text_col: str, threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH, gram: int = GRAM, block: int = BLOCK) -> DataFrame:
    """(id, k, t1, t2, class_key, class_id, copy_id, n_links, n_grams) of every row of ``docs``.

    Tables between the steps are written to the shared folder, so no step runs twice, nor after a lost executor.
    """
    spark = docs.sparkSession
    last, n = prefix_length(trees, depth, threshold, recall), shuffle_partitions(spark)
    width, path = key_bits(depth, last), scratch_path(spark, "near")

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    rows = kept(_gram_table(docs, id_col, text_col, trees, depth, last, gram), "rows")
    rep = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k", "t1", "t2")).alias("rep")
    nodes = kept(rows.groupBy("node").agg(rep, F.first("keys").alias("keys")), "nodes")
    short = lambda up: F.shiftrightunsigned("key", width * up)
    spread = nodes.select("node", F.posexplode("keys").alias("tree", "key")).withColumn("prefix", short(depth - last))
    crowd = spread.groupBy("tree", "prefix").agg(F.count("*").alias("n")).where("n > 1").select("tree", "prefix")
    members = kept(spread.join(crowd, ["tree", "prefix"]).select("node", "tree", "key"), "members")
    wanted = members.select("node").distinct().join(nodes, "node").select("rep.k", "rep.t1", "rep.t2", "node", "keys")
    # bucketed by node, so that the join of each level moves its tasks only
    name = f"near_sets_{path.rsplit('-', 1)[-1]}"
    _candidate_sets(docs, wanted, id_col, text_col, gram).repartition(n, "node").write.bucketBy(n, "node").option("path", f"{path}/sets").saveAsTable(name)
    sets = spark.table(name)
    found = seen = None
    for level in range(depth, last - 1, -1):
        at = members.select("node", "tree", short(depth - level).alias("prefix"))
        if found is None:
            at = at.withColumn("open", F.lit(True))
        else:
            enough = found.groupBy("node").agg(F.min("weakest").alias("w")).where(F.col("w") >= least_similarity(level + 1, trees, recall)).select("node", F.lit(False).alias("shut"))
            at = at.join(enough, "node", "left").withColumn("open", F.coalesce("shut", F.lit(True))).drop("shut")
        groups = at.groupBy("tree", "prefix").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"), F.bool_or("open").alias("some")).where("n > 1 and some")
        # of prefixes with the same members, the one of the first tree, where each of their pairs meets first
        once = groups.groupBy("n", "x", "y").agg(F.min(F.struct("tree", "prefix")).alias("first")).select("n", "x", "y", "first.tree", "first.prefix")
        once = kept(once if seen is None else once.join(seen, ["n", "x", "y"], "left_anti"), f"groups-{level}")
        seen = once.select("n", "x", "y") if seen is None else seen.unionByName(once.select("n", "x", "y"))
        blocks = F.ceil(F.col("n") / block).cast("int")
        tasks = at.join(once.select("n", "tree", "prefix"), ["tree", "prefix"]).withColumn("side", F.pmod(F.xxhash64("node", F.lit(2)), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        tasks = tasks.select("tree", "prefix", "node", "open", "side", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"))
        work = tasks.join(sets, "node").repartition(n, "tree", "prefix", "i", "j").sortWithinPartitions("tree", "prefix", "i", "j").select("tree", "prefix", "i", "j", "node", "side", "open", "grams", "keys")
        links = kept(_links(work, depth - level, threshold, width), f"links-{level}")
        found = links if found is None else found.unionByName(links)
    roots = components(found.where("node <> least").select(F.col("node").alias("u"), F.col("least").alias("v")))
    counts = found.groupBy("node").agg(F.sum("links").alias("n_links"))
    grouped = nodes.select("node", F.col("rep.id").alias("copy_id")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = grouped.groupBy("root").agg(F.min("copy_id").alias("class_id"))
    result = kept(grouped.join(least, "root").join(counts, "node", "left").select("node", F.lower(F.hex("root")).alias("class_key"), "class_id", "copy_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "classes")
    spark.sql(f"DROP TABLE {name}")
    for name in ("nodes", "members", "sets", *(f"{k}-{level}" for k in ("groups", "links") for level in range(last, depth + 1))):
        discard(spark, f"{path}/{name}")
    return rows.drop("keys").join(result, "node")


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row a row of ``docs``: id, class_id, copy_id, n_links, n_grams, class_key."""
    found = _linked(docs.select(id_col, text_col), id_col, text_col, **options)
    return found.select(F.col("id").alias(id_col), "class_id", "copy_id", "n_links", "n_grams", "class_key")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """All columns of one row of each class: the smallest id (nulls last), of rows that share it one text, once."""
    found = _linked(docs.select(id_col, text_col), id_col, text_col, **options)
    best = found.groupBy("class_key").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "t1", "t2", "k")).alias("b")).select("b.k", "b.id", "b.t1", "b.t2")
    k, t1, t2, turn = fresh(docs.columns, "k", "t1", "t2", "turn")
    keyed = docs.withColumns(dict(zip((k, t1, t2), _text_keys(docs[id_col], docs[text_col]), strict=True)))
    stay = keyed.join(best, (keyed[k] == best["k"]) & keyed[id_col].eqNullSafe(best["id"]) & (keyed[t1] == best["t1"]) & (keyed[t2] == best["t2"]), "left_semi")
    return stay.withColumn(turn, F.row_number().over(Window.partitionBy(k, t1, t2, id_col).orderBy(text_col))).where(F.col(turn) == 1).select(*(F.col(f"`{c}`") for c in docs.columns))
