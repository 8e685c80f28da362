"""Keys and similarities of skeletons: ``nodes`` array<string>, ``edges`` (src, dst), ``symmetries`` (a, b) by index."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _name(nodes: Column, i: Column) -> Column:
    return F.get(nodes, i)


def structure_key(nodes: Column, edges: Column, symmetries: Column, ordered: bool = False) -> Column:
    """Equal for skeletons with the same nodes (in the same order, if ``ordered``), directed edges and symmetries."""
    own = nodes if ordered else F.array_sort(nodes)
    links = F.array_sort(F.transform(edges, lambda e: F.concat(_name(nodes, e["src"]), F.lit("→"), _name(nodes, e["dst"]))))
    pairs = F.array_sort(F.transform(symmetries, lambda s: F.concat_ws("↔", F.array_sort(F.array(_name(nodes, s["a"]), _name(nodes, s["b"]))))))
    return F.to_json(F.struct(own.alias("n"), links.alias("e"), pairs.alias("s")))


def signature(nodes: Column, edges: Column, symmetries: Column, name: Column) -> Column:
    return F.sha2(F.to_json(F.struct(name.alias("name"), nodes.alias("nodes"), edges.alias("edges"), symmetries.alias("symmetries"))), 256)


def common(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, common(a, b) / union).otherwise(0.0)


def dice(a: Column, b: Column) -> Column:
    total = F.size(a) + F.size(b)
    return F.when(total > 0, 2 * common(a, b) / total).otherwise(0.0)


def similarity(a: Column, b: Column) -> Column:
    return F.struct(common(a, b).alias("n_common"), F.size(F.array_except(a, b)).alias("self_only"), F.size(F.array_except(b, a)).alias("other_only"), jaccard(a, b).alias("jaccard"), dice(a, b).alias("dice"))


def matches(a: Column, b: Column, method: str, least: float = 0.5, key_a: Column | None = None, key_b: Column | None = None) -> Column:
    """``exact`` and ``structure`` compare keys; ``overlap`` the share of names; ``subset`` whether b has a's names."""
    if method in ("exact", "structure"):
        return key_a == key_b
    if method == "overlap":
        return jaccard(a, b) >= least
    if method == "subset":
        return F.size(F.array_except(a, b)) == 0
    raise ValueError(f"unknown method: {method}")
