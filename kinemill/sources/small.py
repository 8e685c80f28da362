"""Driver-side readers of small files: skeletons, configurations, sequence headers, picture sizes."""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

HDF5_MAGIC = b"\x89HDF\r\n\x1a\n"
PICTURES = {b"\x89PNG\r\n\x1a\n": "png", b"\xff\xd8\xff": "jpeg", b"II*\x00": "tiff", b"MM\x00*": "tiff"}


@dataclass
class Skeleton:
    nodes: list[str]
    edges: list[tuple[int, int]] = field(default_factory=list)
    symmetries: list[tuple[int, int]] = field(default_factory=list)
    name: str | None = None


def skeleton_from_json(text: str | dict) -> Skeleton:
    """Node-link JSON with pickled objects: an object gets the next number, and ``py/id`` refers to it.

    Where nodes are spelt out each time, only the types of edges are numbered. Type 2 is a symmetry.
    """
    data = json.loads(text) if isinstance(text, str) else text
    data = data.get("nx_graph", data)
    shared = any("py/id" in link[k] for link in data["links"] for k in ("source", "target"))
    nodes_seen: list = []
    kinds_seen: list = nodes_seen if shared else []

    def node(x: dict) -> str:
        if "py/id" in x:
            return nodes_seen[x["py/id"] - 1]
        name = x["py/state"]["py/tuple"][0] if "py/state" in x else x["name"]
        if shared:
            nodes_seen.append(name)
        return name

    def kind(x: dict) -> int:
        if "py/id" in x:
            return kinds_seen[x["py/id"] - 1]
        value = x["py/reduce"][1]["py/tuple"][0] if "py/reduce" in x else 1
        kinds_seen.append(value)
        return value

    links, order = [], {}
    for link in data["links"]:
        a, b, k = node(link["source"]), node(link["target"]), kind(link["type"])
        order.setdefault(a)
        order.setdefault(b)
        links.append((a, b, k, link.get("edge_insert_idx", len(links))))
    names = []
    for entry in data["nodes"]:
        x = entry["id"]
        name = x if isinstance(x, str) else nodes_seen[x["py/id"] - 1] if "py/id" in x and shared else list(order)[x["py/id"] - 1] if "py/id" in x else node(x)
        if isinstance(name, str) and name not in names:
            names.append(name)
    names += [n for n in order if n not in names]
    at = {n: i for i, n in enumerate(names)}
    edges = [(at[a], at[b]) for a, b, k, _ in sorted((x for x in links if x[2] == 1), key=lambda x: x[3])]
    pairs = {tuple(sorted((at[a], at[b]))) for a, b, k, _ in links if k == 2}
    return Skeleton(names, edges, sorted(pairs), data.get("graph", {}).get("name"))


def skeleton_to_json(s: Skeleton) -> str:
    """Node-link JSON in which nodes are numbered by their first mention."""
    seen: dict[str, int] = {}

    def ref(key: str, make: dict) -> dict:
        if key in seen:
            return {"py/id": seen[key]}
        seen[key] = len(seen) + 1
        return make

    node = lambda i: ref(f"n{i}", {"py/object": "skeleton.Node", "py/state": {"py/tuple": [s.nodes[i], 1.0]}})
    kind = lambda k: ref(f"k{k}", {"py/reduce": [{"py/type": "skeleton.EdgeType"}, {"py/tuple": [k]}]})
    links = [{"edge_insert_idx": n, "key": 0, "source": node(a), "target": node(b), "type": kind(1)} for n, (a, b) in enumerate(s.edges)]
    links += [{"key": 0, "source": node(a), "target": node(b), "type": kind(2)} for a, b in s.symmetries]
    return json.dumps({"directed": True, "graph": {"name": s.name, "num_edges_inserted": len(s.edges)}, "links": links, "multigraph": True, "nodes": [{"id": node(i)} for i in range(len(s.nodes))]})


def skeletons_from_dict(data: dict) -> list[Skeleton]:
    """Skeletons of a parsed YAML document: one with ``nodes``, or several by name."""
    named = [(data.get("name"), data)] if "nodes" in data else list(data.items())
    label = lambda x: x["name"] if isinstance(x, dict) else x
    out = []
    for name, d in named:
        nodes = [label(n) for n in d["nodes"]]
        place = lambda x, nodes=nodes: x if isinstance(x, int) else nodes.index(label(x))
        edges = [(place(e[0]), place(e[1])) if isinstance(e, list) else (place(e["source"]), place(e["destination"])) for e in d.get("edges") or []]
        out.append(Skeleton(nodes, edges, [(place(a), place(b)) for a, b in d.get("symmetries") or []], d.get("name") or name))
    return out


def skeletons_to_dict(skeletons: list[Skeleton]) -> dict:
    one = lambda n: {"name": n}
    return {s.name or f"Skeleton-{i}": {"nodes": [one(n) for n in s.nodes], "edges": [{"source": one(s.nodes[a]), "destination": one(s.nodes[b])} for a, b in s.edges], "symmetries": [[one(s.nodes[a]), one(s.nodes[b])] for a, b in s.symmetries]} for i, s in enumerate(skeletons)}


def skeletons_from_yaml(text: str) -> list[Skeleton]:
    import yaml

    data = yaml.safe_load(text)
    if not data:
        raise ValueError("an empty skeleton document")
    return skeletons_from_dict(data)


def skeletons_of_training_config(text: str) -> list[Skeleton]:
    """Skeletons within a training configuration."""
    data = json.loads(text)
    found = data.get("data", data).get("labels", {}).get("skeletons") or data.get("skeletons") or []
    return [skeleton_from_json(s) for s in found]


@dataclass
class SeqHeader:
    """Header of a .seq recording."""

    version: int
    header_size: int
    width: int
    height: int
    bit_depth: int
    image_bytes: int
    image_format: int
    n_frames: int
    true_image_bytes: int
    fps: float

    @classmethod
    def of(cls, raw: bytes) -> SeqHeader:
        if len(raw) < 1024:
            raise ValueError("too small for a .seq header")
        if struct.unpack_from("<I", raw)[0] != 0xFEED:
            raise ValueError("not a .seq file")
        version, size = struct.unpack_from("<iI", raw, 28)
        w, h, depth, _, nbytes, kind, n, _, true = struct.unpack_from("<9I", raw, 548)
        return cls(version, size, w, h, depth, nbytes, kind, n, true, struct.unpack_from("<d", raw, 584)[0])


def seq_timestamps(raw: bytes, header: SeqHeader, size: int = 8) -> Iterator[float]:
    """Seconds of each frame of an uncompressed recording: a stamp of ``size`` bytes follows the picture."""
    for k in range(header.n_frames):
        at = header.header_size + k * header.true_image_bytes + header.image_bytes
        s, ms = struct.unpack_from("<IH", raw, at)
        yield s + ms / 1000 + (struct.unpack_from("<H", raw, at + 6)[0] / 1e6 if size == 8 else 0)


def picture_kind(data: bytes) -> str | None:
    return next((k for m, k in PICTURES.items() if data.startswith(m)), None)


def picture_size(data: bytes, default: tuple[int, int] = (480, 640)) -> tuple[int, int]:
    """(height, width) from the headers of PNG or JPEG data."""
    kind = picture_kind(data)
    if kind == "png" and len(data) >= 24:
        w, h = struct.unpack_from(">2I", data, 16)
        return h, w
    at = 2
    while kind == "jpeg" and at + 9 < len(data):
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            return struct.unpack_from(">2H", data, at + 5)
        at += 2 + size
    return default


def embedded_offsets(sizes: list[int]) -> list[tuple[int, int]]:
    """(start, end) of frames that stand one after another."""
    out, at = [], 0
    for n in sizes:
        out.append((at, at + n))
        at += n
    return out


def tiff_axes(description: str, pages: int) -> dict[str, int]:
    """Frames, slices and channels of a stack by its description (ImageJ or OME); else every page is a frame."""
    pick = lambda pattern: int(m[1]) if (m := re.search(pattern, description)) else None
    found = {"frames": pick(r"frames=(\d+)") or pick(r'SizeT="(\d+)"'), "slices": pick(r"slices=(\d+)") or pick(r'SizeZ="(\d+)"'), "channels": pick(r"channels=(\d+)") or pick(r'SizeC="(\d+)"')}
    return {k: v or 1 for k, v in found.items()} if any(found.values()) else {"frames": pages, "slices": 1, "channels": 1}
