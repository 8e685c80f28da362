"""Colours as [r, g, b]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
NAMED = {
    "black": [0, 0, 0],
    "white": [255, 255, 255],
    "red": [255, 0, 0],
    "green": [0, 255, 0],
    "blue": [0, 0, 255],
    "yellow": [255, 255, 0],
    "cyan": [0, 255, 255],
    "magenta": [255, 0, 255],
    "gray": [128, 128, 128],
    "grey": [128, 128, 128],
    "orange": [255, 165, 0],
    "purple": [128, 0, 128],
    "pink": [255, 192, 203],
    "brown": [139, 69, 19],
}
STANDARD = [[0, 114, 189], [217, 83, 25], [237, 177, 32], [126, 47, 142], [119, 172, 48], [77, 190, 238], [162, 20, 47]]


def _rgb(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def resolve(color: Column, palette: list[list[int]] = STANDARD) -> Column:
    """A name, #rgb, #rrggbb, standard[i] or rgb(r, g, b); NULL for anything else."""
    s = F.lower(F.trim(color))
    named = F.create_map(*[x for k, v in NAMED.items() for x in (F.lit(k), _rgb(v))])
    pair = lambda at, n: F.conv(F.substring(s, at, n), 16, 10).cast("int")
    cell = F.regexp_extract(s, r"^standard\[(\d+)\]$", 1)
    part = lambda k: F.regexp_extract(s, r"^rgb\s*\(\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\s*\)$", k).try_cast("int")
    table = F.array(*[_rgb(c) for c in palette])
    return (
        F.when(F.map_contains_key(named, s), named[s])
        .when(s.rlike("^#[0-9a-f]{6}$"), F.array(pair(2, 2), pair(4, 2), pair(6, 2)))
        .when(s.rlike("^#[0-9a-f]{3}$"), F.array(*[pair(k, 1) * 17 for k in (2, 3, 4)]))
        .when(cell != "", F.get(table, (cell.try_cast("bigint") % len(palette)).cast("int")))
        .when(s.rlike(r"^rgb\s*\("), F.when(part(1).isNotNull(), F.array(part(1), part(2), part(3))))
    )


def cycle(index: Column, palette: list[list[int]] = STANDARD) -> Column:
    return F.get(F.array(*[_rgb(c) for c in palette]), F.pmod(index, F.lit(len(palette))).cast("int"))


def scheme(has_tracks: Column, n_instances: Column) -> Column:
    """By track if there are tracks, else by instance if a frame has several, else by node."""
    return F.when(has_tracks, "track").when(n_instances > 1, "instance").otherwise("node")


def blend(below: Column, above: Column, alpha: Column) -> Column:
    """trunc(below * (1 - a) + above * a), kept within 0 to 255."""
    return F.least(F.lit(255), F.greatest(F.lit(0), F.floor(below * (1 - alpha) + above * alpha))).cast("int")


def fade(k: Column, n: Column, alpha: Column | float = 1.0) -> Column:
    """Alpha of a trail's k-th of n segments."""
    return F.greatest((k + 1) / n, F.lit(0.05)) * alpha


def css(rgb: Column) -> Column:
    return F.concat(F.lit("rgb("), F.array_join(F.transform(rgb, lambda v: v.cast("string")), ", "), F.lit(")"))
