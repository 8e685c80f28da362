"""Keypoint projects: their configuration, CSV files, splits and source videos.

Configurations are small and read on the driver; rows of the CSV files stay tables.
"""

from __future__ import annotations

import io
import os
import pickle
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formats as T
from .tabular import keypoint_frames, read_keypoint_csv

_CONFIG = ("config.yaml", "config.yml")


def is_project(config: dict) -> bool:
    """Whether a configuration is one of a keypoint project."""
    return "video_sets" in config and ("bodyparts" in config or "multianimalbodyparts" in config)


def find_config(path: str) -> str | None:
    """The configuration beside a file or folder, or in one of the folders above it."""
    folder = path if os.path.isdir(path) else os.path.dirname(path)
    while True:
        for name in _CONFIG:
            if os.path.isfile(own := os.path.join(folder, name)):
                return own
        if os.path.dirname(folder) == folder:
            return None
        folder = os.path.dirname(folder)


def node_names(config: dict) -> list[str]:
    """Body parts of the skeleton: those of every animal, then the unique ones."""
    parts = config.get("multianimalbodyparts") or config.get("bodyparts") or []
    return [str(p) for p in [*parts, *(config.get("uniquebodyparts") or [])] if str(p) != "MULTI!"]


def edges(config: dict) -> list[tuple[int, int]]:
    """Edges by node number; a chain is an edge for each pair of neighbours, and names that aren't nodes are left out."""
    at = {n: i for i, n in enumerate(node_names(config))}
    out: list[tuple[int, int]] = []
    for chain in config.get("skeleton") or []:
        known = [at.get(str(n)) for n in chain]
        out += [(a, b) for a, b in zip(known, known[1:], strict=False) if a is not None and b is not None and (a, b) not in out]
    return out


def source_videos(spark: SparkSession, config: dict) -> DataFrame:
    """(stem, path, crop) of the configured videos; of several with one stem the first."""
    rows = [(i, str(p), str((v or {}).get("crop", ""))) for i, (p, v) in enumerate((config.get("video_sets") or {}).items())]
    all_ = spark.createDataFrame(rows, "i int, path string, crop string").withColumn("stem", T.stem(F.col("path")))
    first = all_.groupBy("stem").agg(F.min_by(F.struct("path", "crop"), "i").alias("v"))
    return first.select("stem", "v.path", T.dlc_crop(F.col("v.crop")).alias("crop"))


def read_project(spark: SparkSession, root: str, config: dict) -> dict[str, DataFrame]:
    """frames (folder, image, frame_idx), points (folder, image, individual, node, x, y) and videos (folder, path, crop) of all CSV files.

    A folder of labelled images is a video; its source is the configured one with the folder's name as stem. Files of
    another scorer are left out.
    """
    scorer = config.get("scorer")
    pattern = f"CollectedData_{scorer}.csv" if scorer else "CollectedData_*.csv"
    points = read_keypoint_csv(spark, f"{root}/labeled-data/*/{pattern}").withColumn("folder", F.element_at(F.split("path", "/"), -2))
    frames = keypoint_frames(points).withColumn("folder", F.element_at(F.split("path", "/"), -2)).drop("path")
    found = points.select("folder").distinct().join(source_videos(spark, config).withColumnRenamed("stem", "folder"), "folder", "left")
    return {"frames": frames, "points": points.drop("path"), "videos": found}


# ---- Splits ----------------------------------------------------------------------------------------------

#: What a pickled split may hold besides plain values. Fixed values.
_ALLOWED = {("numpy", "ndarray"), ("numpy", "dtype"), ("numpy.core.multiarray", "_reconstruct"), ("numpy._core.multiarray", "_reconstruct"), ("numpy.core.multiarray", "scalar"), ("numpy._core.multiarray", "scalar"), ("_codecs", "encode")}


class _Restricted(pickle.Unpickler):
    """Builds plain values and number arrays; any other class or function in the data is an error."""

    def find_class(self, module: str, name: str):
        if (module, name) not in _ALLOWED:
            raise pickle.UnpicklingError(f"{module}.{name} isn't allowed in a split")
        return super().find_class(module, name)

    def persistent_load(self, pid):
        raise pickle.UnpicklingError("no outside objects in a split")


def read_split(data: bytes) -> tuple[list[int], list[int]]:
    """Row numbers of the train and test parts: second and third value of the pickled list, without -1."""
    found = _Restricted(io.BytesIO(data)).load()
    train, test = ([int(i) for i in found[k] if int(i) != -1] for k in (1, 2))
    return train, test


def split_frames(spark: SparkSession, frames: DataFrame, train: list[int], test: list[int]) -> DataFrame:
    """frames with ``split``: rows are numbered over all folders by (folder, image) as text."""
    from ..operators.windows import positional_rank

    named = spark.createDataFrame([(i, "train") for i in train] + [(i, "test") for i in test], "row long, split string")
    # a project's labelled images: few enough for one sort
    return positional_rank(frames, [], ["folder", "image"], "row").join(named, "row", "left")


def misordered(frames: DataFrame) -> DataFrame:
    """Folders whose images stand in another order by number than by text, so that row numbers may mislead."""
    from pyspark.sql import Window

    by = lambda *c: F.row_number().over(Window.partitionBy("folder").orderBy(*c))
    both = frames.withColumn("a", by("image")).withColumn("b", by(T.trailing_number(F.col("image")), "image"))
    return both.groupBy("folder").agg(F.bool_or(F.col("a") != F.col("b")).alias("bad")).where("bad").select("folder")


def class_names(config: dict) -> dict[int, str]:
    """Classes of a YOLO description: a map, or a list from 0."""
    names = config.get("names") or {}
    return {int(k): str(v) for k, v in (names.items() if isinstance(names, dict) else enumerate(names))}


def yolo_skeleton(config: dict) -> tuple[list[str], list[tuple[int, int]]]:
    """Node names and edges of a YOLO description; without names the keypoints are numbered."""
    n = int((config.get("kpt_shape") or [0])[0])
    names = [str(v) for v in config.get("node_names") or []]
    nodes = [names[i] if i < len(names) else f"point_{i}" for i in range(n)]
    return nodes, [(int(a), int(b)) for a, b in config.get("skeleton") or [] if 0 <= int(a) < n and 0 <= int(b) < n]


def read_yaml(text: str) -> dict:
    """A description in the simple YAML that these formats use: scalars, flow lists, and one level of blocks."""
    out: dict = {}
    key = None
    for line in text.splitlines():
        bare = re.sub(r"(^|\s)#.*$", "", line).rstrip()
        if not bare.strip():
            continue
        inner = bare.startswith((" ", "\t", "-"))
        body = bare.strip()
        if not inner:
            key, _, value = body.partition(":")
            key, value = _scalar(key.strip()), value.strip()
            out[key] = _value(value) if value else None
        elif body.startswith("- "):
            out[key] = [*(out[key] or []), _value(body[2:].strip())] if isinstance(out[key], list) or out[key] is None else out[key]
        else:
            k, _, value = re.match(r"""("[^"]*"|'[^']*'|[A-Za-z]:[\\/].*?|[^:]*)(:)\s*(.*)$""", body).groups()
            out[key] = (out[key] if isinstance(out[key], dict) else {}) | {_scalar(k.strip()): _value(value) if value else None}
    return out


def _value(text: str):
    if text.startswith("[") and text.endswith("]"):
        return [_value(t.strip()) for t in _items(text[1:-1])]
    return _scalar(text)


def _items(text: str) -> list[str]:
    out, depth, part = [], 0, ""
    for c in text:
        depth += (c == "[") - (c == "]")
        if c == "," and not depth:
            out.append(part)
            part = ""
        else:
            part += c
    return [*out, part] if part.strip() else out


def _scalar(text: str):
    if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'":
        return text[1:-1]
    if re.fullmatch(r"[+-]?\d+", text):
        return int(text)
    if re.fullmatch(r"[+-]?(\d+\.\d*|\.\d+)([eE][+-]?\d+)?", text):
        return float(text)
    return {"true": True, "false": False, "null": None, "~": None}.get(text.lower(), text)
