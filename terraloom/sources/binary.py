"""Codecs of binary formats: FlatGeobuf, Shapefile (with its siblings), GeoPackage."""

from __future__ import annotations

import io
import os
import sqlite3
import struct
from collections.abc import Callable, Iterable, Iterator
from contextlib import closing
from dataclasses import dataclass
from itertools import chain
from typing import BinaryIO

import numpy as np

from ..crs.model import WGS84, Crs
from ..functions import geometry as G
from ..functions.columns import clipped, gpb_header
from . import parts
from .textual import Feature, FormatError

KIND_OF = {bool: "bool", int: "int", float: "double"}


def column_kinds(features: list[Feature]) -> list[tuple[str, str]]:
    """Names and kinds of the columns that hold all values, in the order they are first seen."""
    found: dict[str, set[str]] = {}
    for p, _ in features:
        for k, v in p:
            s = found.setdefault(k, set())
            if v is not None:
                s.add(KIND_OF.get(type(v), "string"))
    return [(k, "string" if not s or "string" in s or "bool" in s and len(s) > 1 else "bool" if "bool" in s else "double" if "double" in s else "int") for k, s in found.items()]


def cell(v, kind: str):
    """A value as its column's kind, or None."""
    if v is None:
        return None
    if kind == "string":
        return v if isinstance(v, str) else G.json_text(v)
    if isinstance(v, str | list | dict) or (isinstance(v, bool) != (kind == "bool")):
        return None
    return float(v) if kind == "double" else bool(v) if kind == "bool" else int(v)


# ---- FlatGeobuf

FGB_MAGIC, NODE = b"fgb\x03fgb\x00", 16
# Column types of the format.
FGB_READ = {0: "<b", 1: "<B", 2: "<?", 3: "<h", 4: "<H", 5: "<i", 6: "<I", 7: "<q", 8: "<Q", 9: "<f", 10: "<d"}
FGB_WRITE = {"bool": (2, "<?"), "int": (7, "<q"), "double": (10, "<d"), "string": (11, None)}


class _Table:
    """A FlatBuffers table: fields by number."""

    def __init__(self, buf: bytes, at: int):
        self.buf, self.at = buf, at
        self.vtable = at - struct.unpack_from("<i", buf, at)[0]
        self.size = struct.unpack_from("<H", buf, self.vtable)[0]

    def _field(self, i: int) -> int:
        slot = 4 + 2 * i
        offset = struct.unpack_from("<H", self.buf, self.vtable + slot)[0] if slot < self.size else 0
        return self.at + offset if offset else 0

    def value(self, i: int, form: str, default=0):
        f = self._field(i)
        return struct.unpack_from(form, self.buf, f)[0] if f else default

    def _ref(self, i: int) -> int:
        f = self._field(i)
        return f + struct.unpack_from("<I", self.buf, f)[0] if f else 0

    def vector(self, i: int, kind: str) -> np.ndarray | None:
        f = self._ref(i)
        if not f:
            return None
        n = struct.unpack_from("<I", self.buf, f)[0]
        return np.frombuffer(self.buf, dtype=kind, count=n, offset=f + 4)

    def text(self, i: int) -> str | None:
        v = self.vector(i, "<u1")
        return None if v is None else v.tobytes().decode()

    def table(self, i: int) -> _Table | None:
        f = self._ref(i)
        return _Table(self.buf, f) if f else None

    def tables(self, i: int) -> list[_Table]:
        f = self._ref(i)
        if not f:
            return []
        n = struct.unpack_from("<I", self.buf, f)[0]
        return [_Table(self.buf, f + 4 + 4 * k + struct.unpack_from("<I", self.buf, f + 4 + 4 * k)[0]) for k in range(n)]


def _root(buf: bytes) -> _Table:
    return _Table(buf, struct.unpack_from("<I", buf, 0)[0])


def level_sizes(n: int, node: int) -> list[int]:
    """Nodes of each level of a packed tree over n features, leaves first; above the leaves there is at least a root."""
    sizes = [n]
    while len(sizes) < 2 or sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // node))
    return sizes


def index_size(n: int, node: int) -> int:
    """Bytes of a packed tree over n features."""
    return sum(level_sizes(n, node)) * 40


@dataclass
class FgbHead:
    """What the header of a FlatGeobuf file says, and where index and features begin."""

    columns: list[tuple[str, int]]
    kind: int
    z: bool
    m: bool
    count: int
    node: int
    crs: Crs | None
    index: int
    features: int


def fgb_head(data: bytes) -> FgbHead:
    """``data`` holds at least the header."""
    if data[:4] != FGB_MAGIC[:4]:
        raise FormatError("not a FlatGeobuf file")
    (size,) = struct.unpack_from("<I", data, 8)
    header = _root(data[12 : 12 + size])
    columns = [(c.text(0) or "", c.value(1, "<B")) for c in header.tables(7)]
    count, node = header.value(8, "<Q"), header.value(9, "<H", 16)
    c = header.table(10)
    crs = None
    if c:
        code = c.value(1, "<i")
        crs = Crs.of_code(c.text(0), str(code) if code else c.text(5), wkt=c.text(4))
    index = 12 + size
    return FgbHead(columns, header.value(2, "<B"), header.value(3, "<?", False), header.value(4, "<?", False), count, node if count else 0, crs, index, index + (index_size(count, node) if node and count else 0))


def fgb_crs(path: str) -> Crs | None:
    """The CRS of a file, of which only the header is read."""
    with open(path, "rb") as file:
        return fgb_file_head(file).crs


def search_fgb(data: bytes, box: tuple[float, float, float, float]) -> list[int]:
    """Byte offsets (from the first feature) of the features whose boxes meet ``box``, found by walking the packed tree."""
    head = fgb_head(data)
    if not head.node:
        raise FormatError("the file has no index")
    sizes = level_sizes(head.count, head.node)[::-1]
    starts = [sum(sizes[:i]) for i in range(len(sizes))]
    found, open_ = [], [(0, 0)]
    while open_:
        at, level = open_.pop()
        minx, miny, maxx, maxy, ref = struct.unpack_from("<4dQ", data, head.index + 40 * at)
        if minx > box[2] or maxx < box[0] or miny > box[3] or maxy < box[1]:
            continue
        if level == len(sizes) - 1:
            found.append(ref)
        else:
            end = starts[level + 1] + sizes[level + 1]
            open_ += [(i, level + 1) for i in range(ref, min(ref + head.node, end))]
    return sorted(found)


def fgb_feature(data: bytes, head: FgbHead, offset: int) -> Feature:
    """The feature at an offset from the first one."""
    at = head.features + offset
    (size,) = struct.unpack_from("<I", data, at)
    f = _root(data[at + 4 : at + 4 + size])
    g = f.table(0)
    return _fgb_properties(f.vector(1, "<u1"), head.columns), _fgb_geometry(g, head.kind, head.z, head.m) if g else None


def fgb_file_head(file: BinaryIO) -> FgbHead:
    start = file.read(12)
    if start[:4] != FGB_MAGIC[:4] or len(start) < 12:
        raise FormatError("not a FlatGeobuf file")
    return fgb_head(start + file.read(struct.unpack_from("<I", start, 8)[0]))


def fgb_pieces(path: str, size: int) -> list[tuple[int, int, int]]:
    """(first byte, end, features before) of pieces of about ``size`` bytes: by leaves of the index, or from feature to feature."""
    end = os.path.getsize(path)
    with open(path, "rb") as file:
        head = fgb_file_head(file)
        starts = []
        if head.node and head.count and end > head.features:
            step = max(1, head.count * size // (end - head.features))
            leaves = head.features - 40 * head.count
            for i in range(0, head.count, step):
                file.seek(leaves + 40 * i + 32)
                starts.append((head.features + struct.unpack("<Q", file.read(8))[0], i))
            if starts[0][0] != head.features or any(a >= b for (a, _), (b, _) in zip(starts, [*starts[1:], (end, 0)], strict=True)):
                starts = []  # leaves in another order than features
        if not starts:
            at, n = head.features, 0
            while at + 4 <= end:
                if not starts or at - starts[-1][0] >= size:
                    starts.append((at, n))
                file.seek(at)
                at, n = at + 4 + struct.unpack("<I", file.read(4))[0], n + 1
    return [(low, high, n) for (low, n), (high, _) in zip(starts, [*starts[1:], (end, 0)], strict=True)]


def fgb_rows(path: str, low: int, high: int) -> Iterator[Feature]:
    """Features whose first bytes are in a range."""
    with open(path, "rb") as file:
        head = fgb_file_head(file)
        head.features = 0
        file.seek(low)
        while low + 4 <= high and len(size := file.read(4)) == 4:
            n = struct.unpack("<I", size)[0]
            yield fgb_feature(size + file.read(n), head, 0)
            low += 4 + n


def read_fgb(data: bytes) -> tuple[list[Feature], Crs | None]:
    head, out = fgb_head(data), []
    at = head.features
    while at + 4 <= len(data):
        out.append(fgb_feature(data, head, at - head.features))
        at += 4 + struct.unpack_from("<I", data, at)[0]
    return out, head.crs


def _fgb_properties(raw, columns) -> list[tuple[str, object]]:
    out: list[tuple[str, object]] = []
    data, at = raw.tobytes() if raw is not None else b"", 0
    while at + 2 <= len(data):
        (i,) = struct.unpack_from("<H", data, at)
        at += 2
        name, kind = columns[i]
        if kind in FGB_READ:
            (v,) = struct.unpack_from(FGB_READ[kind], data, at)
            at += struct.calcsize(FGB_READ[kind])
        else:
            (n,) = struct.unpack_from("<I", data, at)
            v = None if kind == 14 else data[at + 4 : at + 4 + n].decode()
            at += 4 + n
        out.append((name, v))
    return out


def _fgb_geometry(t: _Table, kind: int, z: bool, m: bool) -> G.Geometry:
    name = G.KINDS.get(t.value(6, "<B") or kind)
    if name is None:
        raise FormatError("a FlatGeobuf geometry of an unknown type")
    if name in ("MultiPolygon", "GeometryCollection"):
        parts = [_fgb_geometry(p, 3 if name == "MultiPolygon" else 0, z, m) for p in t.tables(7)]
        return G.Geometry(name, parts if name == "GeometryCollection" else [p.coordinates for p in parts])
    xy, zs, ms, ends = t.vector(1, "<f8"), t.vector(2, "<f8"), t.vector(3, "<f8"), t.vector(0, "<u4")
    n = len(xy) // 2 if xy is not None else 0
    ps = [(float(xy[2 * i]), float(xy[2 * i + 1]), float(zs[i]) if zs is not None and len(zs) else None, float(ms[i]) if ms is not None and len(ms) else None) for i in range(n)]
    if name == "Point":
        return G.Geometry(name, ps[0])
    if name in ("LineString", "MultiPoint"):
        return G.Geometry(name, ps)
    cuts = [0, *(int(e) for e in ends)] if ends is not None and len(ends) else [0, n]
    return G.Geometry(name, [ps[a:b] for a, b in zip(cuts, cuts[1:], strict=False)])


def _put_geometry(b, g: G.Geometry) -> int:
    if g.kind in ("MultiPolygon", "GeometryCollection"):
        inner = g.coordinates if g.kind == "GeometryCollection" else [G.Geometry("Polygon", c) for c in g.coordinates]
        made = [_put_geometry(b, p) for p in inner]
        b.StartVector(4, len(made), 4)
        for p in reversed(made):
            b.PrependUOffsetTRelative(p)
        parts = b.EndVector()
    else:
        ps = list(g.positions())
        ordinate = lambda k: np.array([p[k] or 0.0 for p in ps], dtype="<f8") if ps and ps[0][k] is not None else None
        ends = np.cumsum([len(r) for r in g.coordinates]) if g.kind in ("Polygon", "MultiLineString") and len(g.coordinates) > 1 else ()
        return _put_flat(b, G.CODES[g.kind], np.array([v for p in ps for v in p[:2]], dtype="<f8"), ordinate(2), ordinate(3), ends)
    b.StartObject(8)
    b.PrependUOffsetTRelativeSlot(7, parts, 0)
    b.PrependUint8Slot(6, G.CODES[g.kind], 0)
    return b.EndObject()


def _put_flat(b, code: int, xy: np.ndarray, zs: np.ndarray | None, ms: np.ndarray | None, ends) -> int:
    """A geometry without parts."""
    at_xy = b.CreateNumpyVector(xy)
    at_zs = 0 if zs is None else b.CreateNumpyVector(zs)
    at_ms = 0 if ms is None else b.CreateNumpyVector(ms)
    at_ends = b.CreateNumpyVector(np.asarray(ends).astype("<u4")) if len(ends) else 0
    b.StartObject(8)
    for i, v in ((0, at_ends), (1, at_xy), (2, at_zs), (3, at_ms)):
        if v:
            b.PrependUOffsetTRelativeSlot(i, v, 0)
    b.PrependUint8Slot(6, code, 0)
    return b.EndObject()


def _put_feature(b, shape: int, properties: int) -> None:
    b.StartObject(3)
    if shape:
        b.PrependUOffsetTRelativeSlot(0, shape, 0)
    if properties:
        b.PrependUOffsetTRelativeSlot(1, properties, 0)
    b.FinishSizePrefixed(b.EndObject())


def fgb_row(feature: Feature, kinds: list[tuple[str, str]]) -> tuple[bytes, list[float] | None, int, bool, bool]:
    """A feature as it stands in the file, its box, its geometry's type (0 without one), and whether it has z and m."""
    import flatbuffers

    p, g = feature
    b = flatbuffers.Builder(256)
    raw = fgb_properties(dict(reversed(p)), kinds)
    shape = _put_geometry(b, g) if g else 0
    _put_feature(b, shape, b.CreateByteVector(raw) if raw else 0)
    box, first = g.bbox() if g else None, g.first() if g else None
    return bytes(b.Output()), list(map(float, box[:4])) if box else None, G.CODES[g.kind] if g else 0, bool(first and first[2] is not None), bool(first and first[3] is not None)


#: Features of one make (kind, numbers of positions and bytes) differ only in what stands at known places.
_MADE: dict[tuple, tuple[bytes, int, int, int, int]] = {}


def _made_like(code: int, n: int, ends: tuple[int, ...], z: bool, m: bool, raw: int) -> tuple[bytes, int, int, int, int]:
    """A feature of zeros, and where its x and y, z, m and properties stand."""
    import flatbuffers

    key = (code, n, ends, z, m, raw)
    if (known := _MADE.get(key)) is not None:
        return known
    b = flatbuffers.Builder(256)
    shape = _put_flat(b, code, np.zeros(2 * n), np.zeros(n) if z else None, np.zeros(n) if m else None, np.array(ends, dtype="<u4"))
    properties = b.CreateByteVector(bytes(raw)) if raw else 0
    _put_feature(b, shape, properties)
    data = bytes(b.Output())
    f = _root(data[4:])
    g = f.table(0)
    place = lambda t, i: 8 + t._ref(i) if t._ref(i) else 0  # noqa: E731 - behind the size and the vector's length
    if len(_MADE) > 4096:
        _MADE.clear()
    _MADE[key] = made = (data, place(g, 1), place(g, 2), place(g, 3), place(f, 1))
    return made


def fgb_properties(values: dict, kinds: list[tuple[str, str]]) -> bytes:
    raw = bytearray()
    for i, (k, kind) in enumerate(kinds):
        v = cell(values.get(k), kind)
        if v is not None:
            form = FGB_WRITE[kind][1]
            body = struct.pack(form, v) if form else struct.pack("<I", len(v.encode())) + v.encode()
            raw += struct.pack("<H", i) + body
    return bytes(raw)


def fgb_row_of_wkb(values: dict, wkb: bytes | None, kinds: list[tuple[str, str]]) -> tuple[bytes, list[float] | None, int, bool, bool]:
    """``fgb_row`` of properties and a geometry's WKB; points, lines and polygons go by the bytes of others of their make."""
    if wkb is None or (flat := G.flat_wkb(wkb)) is None:
        return fgb_row((list(values.items()), None if wkb is None else G.from_wkb(wkb)), kinds)
    code, z, m, counts, v = flat
    raw, w, n = fgb_properties(values, kinds), 2 + z + m, sum(counts)
    ends = tuple(np.cumsum(counts).tolist()) if len(counts) > 1 else ()
    made, at_xy, at_z, at_m, at_raw = _made_like(code, n, ends, z, m, len(raw))
    out = bytearray(made)
    xs, ys = v[0::w], v[1::w]
    struct.pack_into(f"<{2 * n}d", out, at_xy, *(v if w == 2 else chain.from_iterable(zip(xs, ys, strict=True))))
    if z:
        struct.pack_into(f"<{n}d", out, at_z, *v[2::w])
    if m:
        struct.pack_into(f"<{n}d", out, at_m, *v[w - 1 :: w])
    if raw:
        out[at_raw : at_raw + len(raw)] = raw
    return bytes(out), [min(xs), min(ys), max(xs), max(ys)], code, z, m


def write_fgb(features: Iterable[Feature], path: str, crs: Crs | None = None) -> None:
    features = list(features)
    kinds = column_kinds(features)
    write_fgb_rows([fgb_row(f, kinds) for f in features], kinds, path, crs)


def write_fgb_rows(rows: list[tuple], kinds: list[tuple[str, str]], path: str, crs: Crs | None = None) -> None:
    """A FlatGeobuf file of ``fgb_row``s; in Hilbert order with a packed tree if there are features and all have geometries."""
    boxes = [r[1] for r in rows]
    indexed = bool(rows) and all(b is not None for b in boxes)
    extent = None
    if indexed:
        extent = [f(b[i] for b in boxes) for i, f in ((0, min), (1, min), (2, max), (3, max))]
        order = np.argsort(centre_values(np.array(boxes), extent), kind="stable").tolist()
        rows, boxes = [rows[i] for i in order], [boxes[i] for i in order]
    blobs = [r[0] for r in rows]
    with open(path, "wb") as out:
        out.write(fgb_header(kinds, {r[2] for r in rows if r[2]}, any(r[3] for r in rows), any(r[4] for r in rows), len(rows), extent, crs))
        if indexed:
            out.write(packed_tree([x[:4] for x in boxes], [len(x) for x in blobs]))
        for x in blobs:
            out.write(x)


def fgb_header(kinds: list[tuple[str, str]], types: set[int], z: bool, m: bool, count: int, extent: list[float] | None, crs: Crs | None) -> bytes:
    """What stands before the index; ``extent`` is None for files without one."""
    import flatbuffers

    indexed = extent is not None
    b = flatbuffers.Builder(1024)
    made = []
    for k, kind in kinds:
        name = b.CreateString(k)
        b.StartObject(11)
        b.PrependUOffsetTRelativeSlot(0, name, 0)
        b.PrependUint8Slot(1, FGB_WRITE[kind][0], 0)
        made.append(b.EndObject())
    b.StartVector(4, len(made), 4)
    for x in reversed(made):
        b.PrependUOffsetTRelative(x)
    columns = b.EndVector()
    system = 0
    if crs is not None:
        authority, code = ("EPSG", "4326") if crs.wgs84 else (crs.authority, crs.code)
        org = b.CreateString(authority) if authority else 0
        wkt = b.CreateString(crs.as_wkt()) if crs.as_wkt() else 0
        b.StartObject(6)
        if org:
            b.PrependUOffsetTRelativeSlot(0, org, 0)
        if code and code.lstrip("-").isdigit():
            b.PrependInt32Slot(1, int(code), 0)
        if wkt:
            b.PrependUOffsetTRelativeSlot(4, wkt, 0)
        system = b.EndObject()
    envelope = b.CreateNumpyVector(np.array(extent, dtype="<f8")) if indexed else 0
    b.StartObject(14)
    if envelope:
        b.PrependUOffsetTRelativeSlot(1, envelope, 0)
    b.PrependUint8Slot(2, next(iter(types)) if len(types) == 1 else 0, 0)
    b.PrependBoolSlot(3, z, False)
    b.PrependBoolSlot(4, m, False)
    b.PrependUOffsetTRelativeSlot(7, columns, 0)
    b.PrependUint64Slot(8, count, 0)
    b.PrependUint16Slot(9, NODE if indexed else 0, 16)
    if system:
        b.PrependUOffsetTRelativeSlot(10, system, 0)
    b.FinishSizePrefixed(b.EndObject())
    return FGB_MAGIC + bytes(b.Output())


#: A node of the packed tree, and what a piece's box file has of each feature: box, and node or byte offset (there: bytes).
NODE_TYPE = np.dtype([("box", "<f8", (4,)), ("ref", "<u8")])
NODES_AT_ONCE = NODE << 14


def fgb_piece(batches: Iterator, path: str) -> dict:
    """Features of batches (blob and box) as a piece of a file, with their nodes beside it."""
    n = 0
    with open(path, "wb") as out, open(f"{path}.box", "wb") as beside:
        for b in batches:
            nodes = np.zeros(b.num_rows, dtype=NODE_TYPE)
            blobs = b.column(0).to_pylist()
            out.write(b"".join(blobs))
            nodes["ref"] = np.fromiter(map(len, blobs), dtype=np.uint64, count=len(blobs))
            for k in range(4):
                nodes["box"][:, k] = b.column(1 + k).to_numpy(zero_copy_only=False)
            beside.write(nodes.tobytes())
            n += len(blobs)
    return {"n": n}


def join_fgb(out: BinaryIO, header: bytes, pieces: list[tuple[str, dict]], indexed: bool) -> None:
    """Header, packed tree and features of pieces in their order; a block of nodes is in memory at a time."""
    out.write(header)
    if indexed:
        sizes = level_sizes(sum(x["n"] for _, x in pieces), NODE)
        at = len(header) + 40 * sum(sizes[1:])
        out.seek(at)
        offset = 0
        for path, _ in pieces:
            with open(f"{path}.box", "rb") as boxes:
                while raw := boxes.read(40 * NODES_AT_ONCE):
                    nodes = np.frombuffer(raw, dtype=NODE_TYPE).copy()
                    ends = np.cumsum(nodes["ref"]) + np.uint64(offset)
                    nodes["ref"] = np.concatenate((np.array([offset], dtype=np.uint64), ends[:-1]))
                    offset = int(ends[-1])
                    out.write(nodes.tobytes())
            os.remove(f"{path}.box")
        end = out.tell()
        for k, n in enumerate(sizes[1:], 1):  # each level from the one below it, which stands behind it
            below = at
            at -= 40 * n
            done = 0
            while done < sizes[k - 1]:
                out.seek(below + 40 * done)
                nodes = np.frombuffer(out.read(40 * min(NODES_AT_ONCE, sizes[k - 1] - done)), dtype=NODE_TYPE)
                starts = np.arange(0, len(nodes), NODE)
                made = np.zeros(len(starts), dtype=NODE_TYPE)
                for i, f in enumerate((np.minimum, np.minimum, np.maximum, np.maximum)):
                    made["box"][:, i] = f.reduceat(nodes["box"][:, i], starts)
                made["ref"] = starts + (sum(sizes[k:]) + done)  # the first child's node
                out.seek(at + 40 * (done // NODE))
                out.write(made.tobytes())
                done += len(nodes)
        out.seek(end)
    for path, _ in pieces:
        parts.append(out, path)


def hilbert_values(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places of cells (16-bit x and y) on the Hilbert curve: the quadrant walk of ``functions.columns.hilbert``, for arrays."""
    x, y, d = x.astype(np.int64), y.astype(np.int64), np.zeros(len(x), dtype=np.int64)
    for s in (1 << i for i in range(15, -1, -1)):
        right, up = (x & s) > 0, (y & s) > 0
        d += s * s * ((3 * right) ^ up)
        fx, fy = np.where(right, 65535 - x, x), np.where(right, 65535 - y, y)
        x, y = np.where(up, x, fy), np.where(up, y, fx)
    return d


def centre_values(boxes: np.ndarray, extent: list[float]) -> np.ndarray:
    at = []
    for low, high in ((0, 2), (1, 3)):
        span = extent[high] - extent[low]
        v = ((boxes[:, low] + boxes[:, high]) / 2 - extent[low]) / span if span else np.zeros(len(boxes))
        at.append(np.clip((65535 * v).astype(np.int64), 0, 65535))
    return hilbert_values(*at)


def packed_tree(boxes: list[tuple], sizes: list[int]) -> bytes:
    """Nodes of a packed tree, root first: box and, for leaves, the feature's byte offset, else the number of the first child's node."""
    offsets = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(int).tolist()
    levels = [[(*b, o) for b, o in zip(boxes, offsets, strict=True)]]
    while len(levels) < 2 or len(levels[-1]) > 1:
        below = levels[-1]
        groups = [below[i : i + NODE] for i in range(0, len(below), NODE)]
        levels.append([(min(c[0] for c in g), min(c[1] for c in g), max(c[2] for c in g), max(c[3] for c in g), i * NODE) for i, g in enumerate(groups)])
    levels.reverse()
    out, start = [], 0
    for k, level in enumerate(levels):
        start += len(level)
        for *box, ref in level:
            out.append(struct.pack("<4dQ", *box, ref if k == len(levels) - 1 else start + ref))
    return b"".join(out)


# ---- Shapefile

SHAPES = {"Point": 1, "LineString": 3, "Polygon": 5, "MultiPoint": 8}
NO_DATA = -1e38


@dataclass
class Shapefile:
    shp: bytes
    shx: bytes
    dbf: bytes
    prj: str | None
    warnings: list[str]


def read_shapefile(shp: bytes, dbf: bytes, prj: str | None = None, cpg: str | None = None) -> tuple[list[Feature], Crs | None]:
    shapes = list(_records(shp))
    rows = list(read_dbf(dbf, cpg))
    if len(shapes) != len(rows):
        raise FormatError(f"{len(shapes)} shapes and {len(rows)} records don't pair up")
    crs = Crs.of_definition(prj) if prj and prj.strip() else None
    return [(r, g) for g, r in zip(shapes, rows, strict=True) if r is not None], crs


def _records(shp: bytes) -> Iterator[G.Geometry | None]:
    if len(shp) < 100 or struct.unpack_from(">i", shp)[0] != 9994:
        raise FormatError("not a shapefile")
    at = 100
    while at + 8 <= len(shp):
        size = struct.unpack_from(">i", shp, at + 4)[0] * 2
        yield _shape(shp[at + 8 : at + 8 + size])
        at += 8 + size


def shp_pieces(shp: str, dbf: str, size: int) -> list[tuple[int, int, int, int, int]]:
    """(first byte, end, records before, records, features before) of pieces of about ``size`` bytes in both files; deleted records are no features."""
    with open(shp, "rb") as file, open(dbf, "rb") as table:
        start = file.read(100)
        if len(start) < 100 or struct.unpack_from(">i", start)[0] != 9994:
            raise FormatError("not a shapefile")
        records, head, width = struct.unpack("<IHH", table.read(12)[4:])
        cuts, at, n, buffer, base = [(100, 0)], 100, 0, b"", 100
        while True:
            if at + 8 > base + len(buffer):
                file.seek(at)
                base, buffer = at, file.read(parts.BLOCK)
                if len(buffer) < 8:
                    break
            if at - cuts[-1][0] + (n - cuts[-1][1]) * width >= size:
                cuts.append((at, n))
            at, n = at + 8 + 2 * struct.unpack_from(">i", buffer, at - base + 4)[0], n + 1
        if records != n:
            raise FormatError(f"{n} shapes and {records} records don't pair up")
        out, kept = [], 0
        for (low, first), (high, end) in zip(cuts, [*cuts[1:], (at, n)], strict=True):
            out.append((low, high, first, end - first, kept))
            table.seek(head + first * width)
            left = (end - first) * width
            while left and (raw := table.read(min(left, width * max(1, parts.BLOCK // width)))):
                kept += -(-len(raw) // width) - raw[::width].count(b"*")
                left -= len(raw)
        return out


def shp_piece(shp: str, dbf: str, low: int, high: int, first: int, n: int) -> tuple[bytes, bytes]:
    """A piece as a .shp and a .dbf of their own."""
    with open(shp, "rb") as file, open(dbf, "rb") as table:
        shapes = file.read(100)
        file.seek(low)
        shapes += file.read(high - low)
        _, head, width = struct.unpack("<IHH", table.read(12)[4:])
        table.seek(0)
        records = bytearray(table.read(head))
        struct.pack_into("<I", records, 4, n)
        table.seek(head + first * width)
        return shapes, bytes(records) + table.read(n * width)


def _shape(r: bytes) -> G.Geometry | None:
    (code,) = struct.unpack_from("<i", r)
    if code == 0:
        return None
    kind, z, m = code % 10, 10 < code < 20, code > 20
    missing = lambda v: None if v <= NO_DATA else v
    if kind == 1:
        v = struct.unpack_from(f"<{(len(r) - 4) // 8}d", r, 4)
        return G.Geometry("Point", (v[0], v[1], v[2] if z else None, missing(v[3]) if z and len(v) > 3 else missing(v[2]) if m and len(v) > 2 else None))
    at = 36
    parts = [0]
    if kind in (3, 5):
        n_parts, n = struct.unpack_from("<2i", r, at)
        parts = list(struct.unpack_from(f"<{n_parts}i", r, at + 8))
        at += 8 + 4 * n_parts
    else:
        (n,) = struct.unpack_from("<i", r, at)
        at += 4
    xy = struct.unpack_from(f"<{2 * n}d", r, at)
    at += 16 * n
    zs = ms = [None] * n
    if z:
        zs = list(struct.unpack_from(f"<{n}d", r, at + 16))
        at += 16 + 8 * n
    if (z or m) and at + 16 + 8 * n <= len(r):
        ms = [missing(v) for v in struct.unpack_from(f"<{n}d", r, at + 16)]
    ps = [(xy[2 * i], xy[2 * i + 1], zs[i], ms[i]) for i in range(n)]
    if kind == 8:
        return G.Geometry("MultiPoint", ps)
    cut = [ps[a:b] for a, b in zip(parts, [*parts[1:], n], strict=True)]
    if kind == 5:
        return G.shells(cut)
    return G.Geometry("LineString", cut[0]) if len(cut) == 1 else G.Geometry("MultiLineString", cut)


def read_dbf(data: bytes, cpg: str | None = None) -> Iterator[list[tuple[str, object]] | None]:
    """Properties of each record; None for a deleted one."""
    n, head, size = struct.unpack_from("<IHH", data, 4)
    fields, at = [], 32
    while at < head - 1 and data[at] != 13:
        name = data[at : at + 11].split(b"\0")[0].decode("latin-1")
        fields.append((name, chr(data[at + 11]), data[at + 16], data[at + 17]))
        at += 32
    latin = bool(cpg) and cpg.strip().upper().replace("-", "") in ("ISO88591", "88591", "LATIN1", "1252", "CP1252", "ANSI 1252")

    def text(raw: bytes) -> str:
        if not latin:
            try:
                return raw.decode()
            except UnicodeDecodeError:
                pass
        return raw.decode("latin-1")

    for i in range(n):
        r = data[head + i * size : head + (i + 1) * size]
        if r[:1] == b"*":
            yield None
            continue
        out: list[tuple[str, object]] = []
        at = 1
        for name, kind, width, decimals in fields:
            raw = r[at : at + width]
            at += width
            out.append((name, _dbf_value(kind, text(raw).strip(" \0"), decimals)))
        yield out


def _dbf_value(kind: str, v: str, decimals: int):
    if kind == "C":
        return v or None
    if kind == "D":
        return f"{v[:4]}-{v[4:6]}-{v[6:]}" if len(v) == 8 and v.isdigit() else None
    if kind == "L":
        return True if v in tuple("TtYy") else False if v in tuple("FfNn") else None
    if kind in "NF":
        try:
            return int(v) if decimals == 0 and "." not in v else float(v)
        except ValueError:
            return None
    return None


_FAMILY = {"Point": "Point", "MultiPoint": "MultiPoint", "LineString": "LineString", "MultiLineString": "LineString", "Polygon": "Polygon", "MultiPolygon": "Polygon"}


def shape_facts(features: Iterable[Feature]) -> dict:
    """What the heads of a Shapefile need to know of (some of) its features; ``shape_facts_of`` puts such facts together."""
    kinds, z, m, n, spans, columns = set(), False, False, 0, [None] * 8, {}
    for p, g in features:
        n += 1
        if g:
            kinds.add(g.kind)
            z, m = z or g.has_z(), m or g.has_m()
            spans = _spanned(spans, g.bbox() or [None] * 8)
        for k, v in p:
            found = columns.setdefault(k, [])
            if v is not None and (kind := KIND_OF.get(type(v), "string")) not in found:
                found.append(kind)
    return {"n": n, "kinds": sorted(kinds), "z": z, "m": m, "spans": spans, "columns": columns}


def _spanned(a: list, b: Iterable) -> list:
    """Spans (as ``Geometry.bbox`` has them) of both."""
    return [y if x is None else x if y is None else f(x, y) for x, y, f in zip(a, b, (min, min, max, max, min, max, min, max), strict=True)]


def shape_facts_of(many: list[dict]) -> dict:
    out = {"n": 0, "kinds": [], "z": False, "m": False, "spans": [None] * 8, "columns": {}}
    for x in many:
        columns = out["columns"]
        for k, found in x["columns"].items():
            columns[k] = sorted({*columns.get(k, []), *found})
        out = {"n": out["n"] + x["n"], "kinds": sorted({*out["kinds"], *x["kinds"]}), "z": out["z"] or x["z"], "m": out["m"] or x["m"], "spans": _spanned(out["spans"], x["spans"]), "columns": columns}
    return out


def _shape_code(facts: dict) -> int:
    if "GeometryCollection" in facts["kinds"] or len({_FAMILY[k] for k in facts["kinds"]}) > 1:
        raise FormatError("a shapefile holds one kind of geometry; it got " + ", ".join(facts["kinds"]))
    base = SHAPES[_FAMILY[facts["kinds"][0]]] if facts["kinds"] else 0
    return base + (10 if facts["z"] else 20 if facts["m"] else 0) if base else 0


def shape_records(features: Iterable[Feature], facts: dict, first: int, out: BinaryIO) -> Iterator[int]:
    """Write the records of features, numbered after ``first``; yields each one's words without its head."""
    code = _shape_code(facts)
    for i, (_, g) in enumerate(features, first + 1):
        record = _shape_bytes(g, code, facts["z"], facts["m"]) if g else struct.pack("<i", 0)
        out.write(struct.pack(">2i", i, len(record) // 2) + record)
        yield len(record) // 2


def shape_head(facts: dict, words: int) -> bytes:
    """The head of a .shp or .shx of so many 16-bit words."""
    if words >= 1 << 31:
        raise FormatError("the features need more than the 4 GB that a .shp can have")
    b = [x or 0.0 for x in facts["spans"]]
    ranges = (*(b[4:6] if facts["z"] else (0.0, 0.0)), *(b[6:8] if facts["m"] else (0.0, 0.0)))
    return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, words) + struct.pack("<2i", 1000, _shape_code(facts)) + struct.pack("<8d", *b[:4], *ranges)


def shx_entries(words: np.ndarray, at: int) -> bytes:
    """Entries of a .shx for records of so many words, the first one at ``at``."""
    entries = np.empty((len(words), 2), dtype=">i4")
    entries[:, 0] = at + np.concatenate(([0], np.cumsum(words + 4)[:-1])) if len(words) else 0
    entries[:, 1] = words
    return entries.tobytes()


def write_shapefile(features: list[Feature], crs: Crs | None = None) -> Shapefile:
    facts, body = shape_facts(features), io.BytesIO()
    words = np.array(list(shape_records(features, facts, 0, body)), dtype=np.int64)
    shp = shape_head(facts, 50 + len(body.getvalue()) // 2) + body.getvalue()
    dbf, warnings = write_dbf(features)
    return Shapefile(shp, shape_head(facts, 50 + 4 * len(words)) + shx_entries(words, 50), dbf, crs.as_wkt() if crs else None, warnings)


def _shape_bytes(g: G.Geometry, code: int, z: bool, m: bool) -> bytes:
    kind = code % 10
    if kind == 1:
        p = g.coordinates
        return struct.pack("<i2d", code, *p[:2]) + (struct.pack("<d", p[2] or 0.0) if z else b"") + (struct.pack("<d", NO_DATA * 1.5 if p[3] is None else p[3]) if z or m else b"")
    if kind == 8:
        parts = None
        ps = list(g.positions())
    else:
        lines = [g.coordinates] if g.kind == "LineString" else g.coordinates if g.kind in ("MultiLineString",) else [G.wound(r, i == 0) for poly in ([g.coordinates] if g.kind == "Polygon" else g.coordinates) for i, r in enumerate(poly)]
        ps = [p for line in lines for p in line]
        parts = np.concatenate(([0], np.cumsum([len(x) for x in lines])[:-1])).astype(int).tolist() if lines else []
    xs, ys = [p[0] for p in ps], [p[1] for p in ps]
    out = struct.pack("<i4d", code, min(xs, default=0), min(ys, default=0), max(xs, default=0), max(ys, default=0))
    if parts is not None:
        out += struct.pack("<i", len(parts))
    out += struct.pack("<i", len(ps)) + (struct.pack(f"<{len(parts)}i", *parts) if parts else b"")
    out += struct.pack(f"<{2 * len(ps)}d", *(v for p in ps for v in p[:2]))
    if z:
        zs = [p[2] or 0.0 for p in ps]
        out += struct.pack(f"<{2 + len(zs)}d", min(zs, default=0), max(zs, default=0), *zs)
    if z or m:
        real = [p[3] for p in ps if p[3] is not None]
        out += struct.pack(f"<{2 + len(ps)}d", min(real, default=NO_DATA * 1.5), max(real, default=NO_DATA * 1.5), *(NO_DATA * 1.5 if p[3] is None else p[3] for p in ps))
    return out


def dbf_names(kinds: list[tuple[str, str]]) -> tuple[list[str], list[str]]:
    """Names of fields, cut to ten bytes, and warnings of that."""
    warnings, names = [], []
    for k, _ in kinds:
        short = clipped(k, 10)
        if short != k:
            warnings.append(f"field {k} is named {short}")
        if short in names:
            raise FormatError(f"two fields are named {short} in a shapefile")
        names.append(short)
    return names, warnings


def dbf_cells(p: list[tuple[str, object]], kinds: list[tuple[str, str]]) -> list[bytes]:
    """Texts of a record's fields, without their padding; those of more than 255 bytes aren't cut yet."""
    values, out = dict(reversed(p)), []
    for k, kind in kinds:
        v = cell(values.get(k), kind)
        if kind == "bool":
            text = "?" if v is None else "T" if v else "F"
        else:
            text = "" if v is None else str(v) if kind == "int" else f"{v:.6f}" if kind == "double" else v
        out.append(text.encode())
    return out


_DBF_CODES = {"bool": ("L", 0), "int": ("N", 0), "double": ("N", 6), "string": ("C", 0)}


def dbf_head(kinds: list[tuple[str, str]], longest: list[int], n: int) -> tuple[bytes, list[int], list[str]]:
    """Head, widths of fields and warnings, by the longest text of each field."""
    names, warnings = dbf_names(kinds)
    fields = []
    for (_, kind), name, width in zip(kinds, names, longest, strict=True):
        if width > 255:
            if kind != "string":
                raise FormatError(f"numbers of field {name} are too long for a shapefile")
            warnings.append(f"texts of field {name} are cut at 255 bytes")
        fields.append((name, *_DBF_CODES[kind], max(1, min(width, 255))))
    fields = fields or [("FID", "N", 0, 10)]
    out = bytearray(struct.pack("<4BIHH20x", 3, 126, 1, 1, n, 32 + 32 * len(fields) + 1, 1 + sum(f[3] for f in fields)))
    for name, code, decimals, width in fields:
        out += name.encode().ljust(11, b"\0") + code.encode() + b"\0" * 4 + bytes([width, decimals]) + b"\0" * 14
    return bytes(out + b"\r"), [f[3] for f in fields], warnings


def dbf_record(cells: list[bytes], kinds: list[tuple[str, str]], widths: list[int], number: int) -> bytes:
    if not kinds:
        return b" " + str(number).encode().rjust(10)
    cut = (c if len(c) <= w else c[:w].decode(errors="ignore").encode() for c, w in zip(cells, widths, strict=True))
    return b" " + b"".join(c.rjust(w) if _DBF_CODES[kind][0] == "N" else c.ljust(w) for c, w, (_, kind) in zip(cut, widths, kinds, strict=True))


def write_dbf(features: list[Feature]) -> tuple[bytes, list[str]]:
    kinds = column_kinds(features)
    rows = [dbf_cells(p, kinds) for p, _ in features]
    head, widths, warnings = dbf_head(kinds, [max(map(len, c)) for c in zip(*rows, strict=True)] if rows else [], len(rows))
    return head + b"".join(dbf_record(r, kinds, widths, i) for i, r in enumerate(rows)) + b"\x1a", warnings


def write_shapefile_pieces(stem: str, into: str, store: Callable, kinds: list[tuple[str, str]], crs: Crs | None) -> list[str]:
    """A Shapefile whose records are made by ``store(write)``: first their facts are gathered, then the records are written. Returns warnings.

    ``kinds`` are those of the columns; a column without values becomes text.
    """

    def gather(batches, _path):
        longest = [0] * len(kinds)

        def seen():
            for found in batches:
                for f in found:
                    longest[:] = map(max, longest, map(len, dbf_cells(f[0], kinds)))
                    yield f

        return shape_facts(seen()) | {"longest": longest}

    gathered = [x for _, x in store(gather)]
    facts = shape_facts_of(gathered)
    longest = [max(x) for x in zip(*(x["longest"] for x in gathered), strict=True)] if gathered else []
    _shape_code(facts)  # kinds that don't go together are an error before anything is written
    columns = [(k, kind if facts["columns"].get(k) else "string") for k, kind in kinds] if facts["n"] else []
    longest = [w if facts["columns"].get(k) else 0 for (k, _), w in zip(kinds, longest, strict=True)] if facts["n"] else []
    head, widths, warnings = dbf_head(columns, longest, facts["n"])
    before = np.cumsum([0, *(x["n"] for x in gathered)]).tolist()

    def write(batches, path):
        from pyspark import TaskContext

        first = number = before[TaskContext.get().partitionId()]
        words = []
        with open(path, "wb") as shp, open(f"{path}.dbf", "wb") as dbf, open(f"{path}.words", "wb") as lengths:
            for found in batches:
                words = list(shape_records(found, facts, number, shp))
                dbf.write(b"".join(dbf_record(dbf_cells(p, columns), columns, widths, i) for i, (p, _) in enumerate(found, number)))
                lengths.write(np.array(words, dtype="<i4").tobytes())
                number += len(found)
        return {"n": number - first, "bytes": os.path.getsize(path)}

    made = store(write)
    if [x["n"] for _, x in made] != [x["n"] for x in gathered]:
        raise FormatError("features changed while the shapefile was written")
    with open(f"{stem}.shp", "wb") as shp, open(f"{stem}.shx", "wb") as shx, open(f"{stem}.dbf", "wb") as dbf:
        shp.write(shape_head(facts, 50 + sum(x["bytes"] for _, x in made) // 2))
        shx.write(shape_head(facts, 50 + 4 * facts["n"]))
        dbf.write(head)
        for path, x in made:
            at = shp.tell() // 2
            with open(f"{path}.words", "rb") as lengths:
                while raw := lengths.read(parts.BLOCK):
                    words = np.frombuffer(raw, dtype="<i4").astype(np.int64)
                    shx.write(shx_entries(words, at))
                    at += int((words + 4).sum())
            parts.append(shp, path)
            parts.append(dbf, f"{path}.dbf")
        dbf.write(b"\x1a")
    if crs and crs.as_wkt():
        with open(f"{stem}.prj", "wb") as prj:
            prj.write(crs.as_wkt().encode())
    return warnings


def sibling(path: str, extension: str) -> str | None:
    """The file beside ``path`` with this extension, in the case of its own or the other."""
    stem, own = os.path.splitext(path)
    upper = own[1:].isupper()
    for e in (extension.upper() if upper else extension, extension if upper else extension.upper()):
        if os.path.exists(f"{stem}.{e}"):
            return f"{stem}.{e}"
    return None


# ---- GeoPackage


def gpkg_layers(path: str) -> list[tuple[str, str, int, Crs | None]]:
    """(table, geometry column, greatest rowid, CRS) of each feature layer."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        tables = {r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}
        geometry = {t: (c, s) for t, c, s in db.execute("SELECT table_name, column_name, srs_id FROM gpkg_geometry_columns")} if "gpkg_geometry_columns" in tables else {}
        srs = {i: (o, c, d) for i, o, c, d in db.execute("SELECT srs_id, organization, organization_coordsys_id, definition FROM gpkg_spatial_ref_sys") if isinstance(i, int)}
        out = []
        for (name,) in db.execute("SELECT table_name FROM gpkg_contents WHERE data_type = 'features' ORDER BY rowid").fetchall():
            if name in tables:
                column, i = geometry.get(name) or (_geometry_like(db, name), 0)  # a layer whose geometry isn't registered
                if column is None:
                    continue
                crs = None
                if i not in (0, -1) and i in srs:
                    o, c, d = srs[i]
                    wkt = d if d and d != "undefined" else None
                    crs = Crs.of_code(o, str(c), wkt=wkt)
                out.append((name, column, db.execute(f'SELECT coalesce(max(rowid), 0) FROM "{_quoted(name)}"').fetchone()[0], crs))
        return out


def _geometry_like(db, table: str) -> str | None:
    """A column that holds geometries by its declared type, or by its name."""
    info = db.execute(f'PRAGMA table_info("{_quoted(table)}")').fetchall()
    kinds = {"GEOMETRY", *(k.upper() for k in G.CODES)}
    return next((r[1] for r in info if (r[2] or "").upper() in kinds), next((r[1] for r in info if r[1].lower() in ("geom", "geometry")), None))


def _quoted(name: str) -> str:
    return name.replace('"', '""')


#: Bytes of a row at least, by which a layer's rowids are told to be dense.
LEAST_ROW = 20


def gpkg_ranges(path: str, table: str, rows: int) -> list[tuple[int, int]]:
    """Ranges low < rowid <= high of ``rows`` rows each (the last may have fewer), whatever gaps the rowids have."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        name = _quoted(table)
        out, low = [], None
        first = db.execute(f'SELECT min(rowid) FROM "{name}"').fetchone()[0]
        if first is None:
            return [(0, 0)]
        low = first - 1
        last = db.execute(f'SELECT max(rowid) FROM "{name}"').fetchone()[0]
        dense = (last - low) * LEAST_ROW <= os.path.getsize(path)
        while True:
            # so many rowids hold at most so many rows: where few are missing, rows needn't be counted
            if dense and low + rows < last and db.execute(f'SELECT 1 FROM "{name}" WHERE rowid = ?', (low + rows,)).fetchone():
                out.append((low, low + rows))
                low += rows
                continue
            high = db.execute(f'SELECT rowid FROM "{name}" WHERE rowid > ? ORDER BY rowid LIMIT 1 OFFSET ?', (low, rows - 1)).fetchone()
            if high is None:
                return [*out, (low, last)] if last > low else out
            out.append((low, high[0]))
            low = high[0]


def gpkg_before(path: str, table: str) -> int:
    """The number before a layer's first rowid; rowids can be 0 and negative."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        return db.execute(f'SELECT coalesce(min(rowid), 1) - 1 FROM "{_quoted(table)}"').fetchone()[0]


def gpkg_rows(path: str, table: str, column: str, low: int, high: int) -> Iterator[tuple[int, Feature]]:
    """rowid and feature of rows with low < rowid <= high."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        names = _gpkg_columns(db, table, column)[1]
        listed = ", ".join(f'"{_quoted(n)}"' for n in [column, *names])
        for rowid, blob, *values in db.execute(f'SELECT rowid, {listed} FROM "{_quoted(table)}" WHERE rowid > ? AND rowid <= ? ORDER BY rowid', (low, high)):
            yield rowid, ([(n, None if isinstance(v, bytes) else v) for n, v in zip(names, values, strict=True)], from_gpb(blob))


def from_gpb(blob: bytes | None) -> G.Geometry | None:
    if blob is None:
        return None
    if blob[:2] != b"GP":
        raise FormatError("not a GeoPackage geometry")
    flags = blob[3]
    if flags & 16:
        return None
    return G.from_wkb(blob[8 + (0, 32, 48, 48, 64)[flags >> 1 & 7] :])


def to_gpb(g: G.Geometry, srs_id: int, envelope: bool = False) -> bytes:
    head = bytearray(gpb_header(srs_id))
    if envelope and (b := g.bbox()):
        values = [b[0], b[2], b[1], b[3]] + ([b[4], b[5]] if b[4] is not None else [])
        head[3] |= (2 if len(values) == 6 else 1) << 1
        head += struct.pack(f"<{len(values)}d", *values)
    return bytes(head) + G.to_wkb(g)


# The tables that every GeoPackage has.
GPKG_TABLES = """
CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT);
CREATE TABLE gpkg_contents (table_name TEXT NOT NULL PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE, description TEXT DEFAULT '', last_change DATETIME NOT NULL DEFAULT (strftime('%Y-%m-%dT%H:%M:%fZ','now')), min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER);
CREATE TABLE gpkg_geometry_columns (table_name TEXT NOT NULL, column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL, srs_id INTEGER NOT NULL, z TINYINT NOT NULL, m TINYINT NOT NULL, PRIMARY KEY (table_name, column_name));
CREATE TABLE gpkg_extensions (
  table_name TEXT,
  column_name TEXT,
  extension_name TEXT NOT NULL,
  definition TEXT NOT NULL,
  scope TEXT NOT NULL,
  CONSTRAINT ge_tce UNIQUE (table_name, column_name, extension_name)
);
"""
SQL_TYPES = {"bool": "BOOLEAN", "int": "INTEGER", "double": "REAL", "string": "TEXT"}


def gpkg_piece(features: Iterable[Feature], path: str, srs: int, kinds: list[tuple[str, str]], rtree: bool, envelope: bool) -> dict:
    """Features as a database of their own, whose rows ``write_gpkg`` moves into the package."""
    n, types, z, m, spans = 0, set(), False, False, [None] * 8
    names = [f"c{i}" for i in range(len(kinds))]
    with closing(sqlite3.connect(path)) as db:
        db.execute("PRAGMA journal_mode = OFF")
        db.execute("PRAGMA synchronous = OFF")
        db.execute(f"CREATE TABLE piece ({', '.join(['id INTEGER PRIMARY KEY', 'geom', *names])})")
        db.execute("CREATE TABLE tree (id INTEGER PRIMARY KEY, minx, maxx, miny, maxy)")
        marks = ",".join("?" * (2 + len(kinds)))

        def rows():
            nonlocal n, z, m, spans
            for p, g in features:
                n += 1
                values = dict(reversed(p))
                if g:
                    types.add(g.kind)
                    z, m, b = z or g.has_z(), m or g.has_m(), g.bbox()
                    if b:
                        spans = _spanned(spans, b)
                        if rtree:
                            db.execute("INSERT INTO tree VALUES (?,?,?,?,?)", (n, b[0], b[2], b[1], b[3]))
                yield (n, to_gpb(g, srs, envelope) if g else None, *(cell(values.get(k), t) for k, t in kinds))

        db.executemany(f"INSERT INTO piece VALUES ({marks})", rows())
        db.commit()
    return {"n": n, "types": sorted(types), "z": z, "m": m, "box": spans[:4]}


#: Makes pieces of a layer's features, given its spatial reference system's id.
Pieces = Callable[[int], list[tuple[str, dict]]]


def write_gpkg(layers: list[tuple[str, Pieces, list[tuple[str, str]], Crs | None]], path: str, rtree: bool = False) -> None:
    """A GeoPackage of these layers: (name, pieces by ``gpkg_piece``, columns, CRS)."""
    part = f"{path}.part"
    if os.path.exists(part):
        os.remove(part)
    db = sqlite3.connect(part, isolation_level=None)
    try:
        db.execute("PRAGMA journal_mode = OFF")  # a package that isn't finished is thrown away
        db.execute("PRAGMA synchronous = OFF")
        db.execute("PRAGMA application_id = 1196444487")
        db.execute("PRAGMA user_version = 10300")
        db.executescript(GPKG_TABLES)
        from ..crs.model import WGS84_WKT

        rows = [("Undefined cartesian SRS", -1, "NONE", -1, "undefined"), ("Undefined geographic SRS", 0, "NONE", 0, "undefined"), ("WGS 84", 4326, "EPSG", 4326, WGS84_WKT)]
        db.executemany("INSERT INTO gpkg_spatial_ref_sys VALUES (?,?,?,?,?,NULL)", rows)
        known: dict[tuple, int] = {}
        for name, pieces, kinds, crs in layers:
            srs = 0 if crs is None else 4326 if crs.wgs84 else known.get((crs.authority, crs.code, crs.body()))
            if srs is None:
                used = {r[0] for r in db.execute("SELECT srs_id FROM gpkg_spatial_ref_sys")}
                srs = int(crs.code) if crs.code and crs.code.isdigit() and int(crs.code) not in used else max(99_999, *used) + 1
                known[crs.authority, crs.code, crs.body()] = srs
                db.execute("INSERT INTO gpkg_spatial_ref_sys VALUES (?,?,?,?,?,NULL)", (crs.authority_code() or name, srs, crs.authority or "NONE", int(crs.code) if crs.code and crs.code.isdigit() else srs, crs.as_wkt() or "undefined"))
            key = "fid"
            while key in {k for k, _ in kinds}:
                key = f"_{key}"
            q = _quoted(name)
            columns = "".join(f', "{_quoted(k)}" {SQL_TYPES[t]}' for k, t in kinds)
            db.execute(f'CREATE TABLE "{q}" ({key} INTEGER PRIMARY KEY AUTOINCREMENT NOT NULL, geom GEOMETRY{columns})')
            if rtree:
                db.execute(f'CREATE VIRTUAL TABLE "rtree_{q}_geom" USING rtree(id, minx, maxx, miny, maxy)')
            box, types, dims, before = [None] * 4, set(), [False, False], 0
            for at, facts in pieces(srs):
                db.execute("ATTACH ? AS piece", (at,))
                db.execute("BEGIN")
                db.execute(f'INSERT INTO "{q}" SELECT id + ?, geom{"".join(f", c{i}" for i in range(len(kinds)))} FROM piece.piece ORDER BY id', (before,))
                if rtree:
                    db.execute(f'INSERT INTO "rtree_{q}_geom" SELECT id + ?, minx, maxx, miny, maxy FROM piece.tree ORDER BY id', (before,))
                db.execute("COMMIT")
                db.execute("DETACH piece")
                os.remove(at)
                before += facts["n"]
                types |= set(facts["types"])
                dims = [dims[0] or facts["z"], dims[1] or facts["m"]]
                box = [y if x is None else x if y is None else f(x, y) for x, y, f in zip(box, facts["box"], (min, min, max, max), strict=True)]
            db.execute("INSERT INTO gpkg_contents (table_name, data_type, identifier, min_x, min_y, max_x, max_y, srs_id) VALUES (?,?,?,?,?,?,?,?)", (name, "features", name, *box, srs))
            db.execute("INSERT INTO gpkg_geometry_columns VALUES (?,?,?,?,?,?)", (name, "geom", types.pop().upper() if len(types) == 1 else "GEOMETRY", srs, *(2 * d for d in dims)))
            if rtree:
                db.execute("INSERT INTO gpkg_extensions VALUES (?,?,?,?,?)", (name, "geom", "gpkg_rtree_index", "http://www.geopackage.org/spec120/#extension_rtree", "write-only"))
    finally:
        db.close()
    os.replace(part, path)


def gpkg_kinds(path: str, table: str, column: str) -> list[tuple[str, str]]:
    """``column_kinds`` of a layer's rows, by SQLite's own types; a layer without rows has none."""
    with closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as db:
        key, names = _gpkg_columns(db, table, column)
        if db.execute(f'SELECT 1 FROM "{_quoted(table)}" LIMIT 1').fetchone() is None or not names:
            return []
        seen = ", ".join(f"max(typeof(\"{_quoted(n)}\") = '{t}')" for n in names for t in ("text", "real", "integer"))
        found = iter(db.execute(f'SELECT {seen} FROM "{_quoted(table)}"').fetchone())
        return [(n, "string" if text else "double" if real else "int" if whole else "string") for n, text, real, whole in zip(names, found, found, found, strict=False)]


def _gpkg_columns(db, table: str, column: str) -> tuple[str | None, list[str]]:
    info = db.execute(f'PRAGMA table_info("{_quoted(table)}")').fetchall()
    key = next((r[1] for r in info if r[5] and r[2].upper() == "INTEGER"), None)
    return key, [r[1] for r in info if r[1] not in (key, column)]


__all__ = ["WGS84"]
