"""Dense arrays in files: axis orders, transposes, layouts of embedded pictures, time lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Place of each axis in the stored order.
PRESETS = {"matlab": {"frame": 3, "track": 0, "node": 2, "xy": 1}, "standard": {"frame": 0, "track": 1, "node": 2, "xy": 3}}
AXES = ("frame", "track", "node", "xy")


def axis_order(preset: str | None = None, places: dict[str, int] | None = None) -> dict[str, int]:
    """The place of each axis, by a preset (matlab unless told) or spelt out."""
    if places:
        if preset is not None:
            raise ValueError("either a preset or places, not both")
        if sorted(places) != sorted(AXES) or sorted(places.values()) != [0, 1, 2, 3]:
            raise ValueError(f"places must give {', '.join(AXES)} the numbers 0 to 3, each once")
        return dict(places)
    if (preset or "matlab") not in PRESETS:
        raise ValueError(f"unknown preset: {preset}")
    return dict(PRESETS[preset or "matlab"])


def stored_axes(order: dict[str, int], without: tuple[str, ...] = ()) -> list[str]:
    """Names of the axes as stored; arrays with fewer axes leave some out."""
    return [a for a in sorted(order, key=order.get) if a not in without]


def permutation(source: list[str], target: list[str]) -> list[int]:
    """Which source axis becomes each target axis."""
    return [source.index(a) for a in target]


def guess_axes(dims: str | None, transpose: bool | None) -> str:
    """How a file's arrays are stored: its ``dims`` attribute, else the old transpose flag, else the default."""
    if dims is not None:
        names = [d.strip(" \"'[]") for d in dims.split(",")]
        return next((p for p, o in PRESETS.items() if stored_axes(o) == names), "custom")
    return "standard" if transpose is False else "matlab"


def flat_index(at: list[Column], shape: list[Column]) -> Column:
    """Row-major place of an element."""
    out = F.lit(0).cast("bigint")
    for i, n in zip(at, shape, strict=True):
        out = out * n + i
    return out


def unflatten(index: Column, shape: list[Column]) -> list[Column]:
    """Places on each axis of a row-major index."""
    out, rest = [], index
    for n in reversed(shape):
        out.append(F.pmod(rest, n))
        rest = F.floor(rest / n)
    return out[::-1]


def transposed_index(index: Column, shape: list[Column], axes: list[int]) -> Column:
    """Where an element of a flat array goes when its axes are put in the order ``axes``."""
    at = unflatten(index, shape)
    return flat_index([at[a] for a in axes], [shape[a] for a in axes])


def layout(shape: Column, n_frames: Column) -> Column:
    """How pictures lie in a dataset: padded rows, one blob each (vlen), one after another (concat), or unknown."""
    length = F.get(shape, F.lit(0))
    flat = F.when(F.coalesce(n_frames, F.lit(0)) <= 0, "ambiguous1d").when(length == n_frames, "vlen").otherwise("concat")
    return F.when(F.size(shape) >= 2, "padded").when(F.size(shape) == 1, flat).otherwise("ambiguous1d")


def trim_padding(row: Column, size: Column) -> Column:
    """A padded row cut to its size; without one, without the zeros at its end. Both as hexadecimal text."""
    n = F.length(row) / 2
    return F.when(size.between(0, n), F.substr(row, F.lit(1), (size * 2).cast("int"))).otherwise(F.regexp_replace(row, "(?:00)+$", ""))


def nwb_track(name: Column) -> Column:
    """The track of a container named ``track=…``; NULL for others, ``untracked`` and no name."""
    own = F.nullif(F.regexp_extract(name, "^track=(.+)$", 1), F.lit(""))
    return F.nullif(own, F.lit("untracked"))


def sample_time(timestamp: Column, start: Column, i: Column) -> Column:
    """A sample's time: its stamp, else consecutive from the start."""
    return F.coalesce(timestamp, F.coalesce(start, F.lit(0.0)) + i)


def prefetch(last: Column, current: Column, n_frames: Column, ahead: int, behind: int) -> Column:
    """Frames to load next: some in the direction of travel (forward if unknown), then a few behind."""
    step = F.when(current < last, -1).otherwise(1)
    offsets = [*range(1, ahead + 1), *range(-1, -behind - 1, -1)]
    return F.filter(F.transform(F.array(*map(F.lit, offsets)), lambda k: current + step * k), lambda f: (f >= 0) & (f < n_frames))


def _low_product(a: Column, b: Column) -> Column:
    """The low 32 bits of a product of two 32-bit numbers; no intermediate value has more than 49 bits."""
    word = F.lit(0xFFFFFFFF)
    high = F.shiftleft((a * F.shiftright(b, 16)).bitwiseAND(F.lit(0xFFFF)), 16)
    return (a * b.bitwiseAND(F.lit(0xFFFF)) + high).bitwiseAND(word)


def random_number(i: Column, seed: int = 0x9E3779B9) -> Column:
    """The i-th number (from 0) in [0, 1) of the seeded splits' 32-bit generator, for any row on its own.

    A number's state is the seed plus a multiple of a step, so no number needs the one before. The constants are fixed values.
    """
    word = F.lit(0xFFFFFFFF)
    t = (F.lit(seed).cast("bigint") + _low_product((i + 1).cast("bigint"), F.lit(0x6D2B79F5).cast("bigint"))).bitwiseAND(word)
    t = _low_product(t.bitwiseXOR(F.shiftright(t, 15)), t.bitwiseOR(F.lit(1)))
    t = t.bitwiseXOR((t + _low_product(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(F.lit(61)))).bitwiseAND(word))
    return t.bitwiseXOR(F.shiftright(t, 14)) / F.lit(4294967296.0)
