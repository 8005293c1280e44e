"""Geometry model and codecs: WKB, WKT, GeoJSON geometries, number text.

A geometry in Python is ``Geometry(kind, coordinates, has_z, has_m)``. Coordinates nest as in GeoJSON; a position is a tuple (x, y, z, m) in
which z and m are None where absent. Geometry columns hold little-endian ISO WKB.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal
from typing import Any

# WKB type codes.
CODES = {"Point": 1, "LineString": 2, "Polygon": 3, "MultiPoint": 4, "MultiLineString": 5, "MultiPolygon": 6, "GeometryCollection": 7}
KINDS = {code: kind for kind, code in CODES.items()}
#: How deep positions are nested.
DEPTH = {"Point": 0, "LineString": 1, "MultiPoint": 1, "Polygon": 2, "MultiLineString": 2, "MultiPolygon": 3}
PART = {"MultiPoint": "Point", "MultiLineString": "LineString", "MultiPolygon": "Polygon"}

Position = tuple[float, float, float | None, float | None]


class GeometryError(ValueError):
    pass


@dataclass(frozen=True)
class Geometry:
    kind: str
    coordinates: Any  # of a GeometryCollection: a list of geometries

    def positions(self) -> Iterator[Position]:
        if self.kind == "GeometryCollection":
            for g in self.coordinates:
                yield from g.positions()
        else:
            yield from _flat(self.coordinates, DEPTH[self.kind])

    def first(self) -> Position | None:
        return next(self.positions(), None)

    def has_z(self) -> bool:
        return any(p[2] is not None for p in self.positions())

    def has_m(self) -> bool:
        return any(p[3] is not None for p in self.positions())

    def map_positions(self, f: Callable[[Position], Position]) -> Geometry:
        if self.kind == "GeometryCollection":
            return Geometry(self.kind, [g.map_positions(f) for g in self.coordinates])
        return Geometry(self.kind, _mapped(self.coordinates, DEPTH[self.kind], f))

    def map_runs(self, f: Callable[[list[Position]], list[Position]]) -> Geometry:
        """Apply ``f`` to each run of neighbouring positions: a point, a line, a ring, a multipoint."""
        if self.kind == "GeometryCollection":
            return Geometry(self.kind, [g.map_runs(f) for g in self.coordinates])
        return Geometry(self.kind, _run_mapped(self.coordinates, DEPTH[self.kind], f))

    def bbox(self) -> tuple[float | None, ...] | None:
        """minx, miny, maxx, maxy, minz, maxz, minm, maxm; z and m from the positions that have them; None if empty."""
        ps = list(self.positions())
        if not ps:
            return None
        out: list[float | None] = [min(p[0] for p in ps), min(p[1] for p in ps), max(p[0] for p in ps), max(p[1] for p in ps)]
        for i in (2, 3):
            vs = [p[i] for p in ps if p[i] is not None]
            out += [min(vs), max(vs)] if vs else [None, None]
        return tuple(out)

    def type_and_dimension(self) -> str:
        """The kind, with Z, M or ZM behind it as the first position has them."""
        p = self.first()
        suffix = ("Z" if p and p[2] is not None else "") + ("M" if p and p[3] is not None else "")
        return f"{self.kind} {suffix}".rstrip()


def _flat(c, depth):
    if depth == 0:
        yield c
    else:
        for x in c:
            yield from _flat(x, depth - 1)


def _mapped(c, depth, f):
    return f(c) if depth == 0 else [_mapped(x, depth - 1, f) for x in c]


def _run_mapped(c, depth, f):
    if depth == 0:
        return f([c])[0]
    return f(list(c)) if depth == 1 else [_run_mapped(x, depth - 1, f) for x in c]


# ---- numbers


def number_text(v: float) -> str:
    """Shortest text that reads back as the same number: no exponent, no point behind whole numbers."""
    if isinstance(v, int):
        return str(v)
    if v and v.is_integer() and -1e15 < v < 1e15:
        return str(int(v))
    if v != v or v in (float("inf"), float("-inf")):
        return "NaN" if v != v else "inf" if v > 0 else "-inf"
    if v == int(v) and abs(v) < 1e15:
        return "-0" if v == 0 and str(v)[0] == "-" else str(int(v))
    text = repr(v)
    if "e" not in text:
        return text
    text = format(Decimal(text), "f")
    return text.rstrip("0").rstrip(".") if "." in text else text


# ---- WKB


def _flags(g: Geometry) -> tuple[bool, bool]:
    p = g.first()
    return (p is not None and p[2] is not None, p is not None and p[3] is not None)


_POINT = struct.Struct("<BIdd")
_POINT_HEAD = b"\x01\x01\x00\x00\x00"


def to_wkb(g: Geometry) -> bytes:
    """Little-endian ISO WKB; the first position tells whether z and m are written, absent ones are 0."""
    if g.kind == "Point" and g.coordinates[2] is None and g.coordinates[3] is None:
        return _POINT.pack(1, 1, *g.coordinates[:2])
    z, m = _flags(g)
    return b"".join(_wkb(g, z, m))


def _wkb(g: Geometry, z: bool, m: bool) -> Iterator[bytes]:
    yield struct.pack("<BI", 1, CODES[g.kind] + 1000 * z + 2000 * m)
    pack = struct.Struct("<" + "d" * (2 + z + m)).pack

    def position(p):
        return pack(p[0], p[1], *([p[2] or 0.0] if z else []), *([p[3] or 0.0] if m else []))

    def line(ps):
        return struct.pack("<I", len(ps)) + b"".join(map(position, ps))

    c = g.coordinates
    if g.kind == "Point":
        yield position(c)
    elif g.kind == "LineString":
        yield line(c)
    elif g.kind == "Polygon":
        yield struct.pack("<I", len(c))
        for ring in c:
            yield line(ring)
    else:
        yield struct.pack("<I", len(c))
        for part in c:
            part = part if g.kind == "GeometryCollection" else Geometry(PART[g.kind], part)
            yield from _wkb(part, *(_flags(part) if g.kind == "GeometryCollection" else (z, m)))


def from_wkb(data: bytes) -> Geometry:
    """Geometry of little-endian ISO WKB; bytes behind it are ignored."""
    if data[:5] == _POINT_HEAD and len(data) >= 21:
        _, _, x, y = _POINT.unpack_from(data)
        return Geometry("Point", (x, y, None, None))
    return _Wkb(data).geometry()


class _Wkb:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, form: str):
        size = struct.calcsize(form)
        if self.at + size > len(self.data):
            raise GeometryError("WKB ends too early")
        out = struct.unpack_from(form, self.data, self.at)
        self.at += size
        return out

    def count(self, least: int) -> int:
        (n,) = self.take("<I")
        if n * least > len(self.data) - self.at:
            raise GeometryError("WKB ends too early")
        return n

    def geometry(self) -> Geometry:
        (order,) = self.take("<B")
        if order != 1:
            raise GeometryError("big-endian WKB isn't read")
        (code,) = self.take("<I")
        if code & 0xE0000000:
            raise GeometryError("EWKB flags aren't read")
        z, m = code // 1000 in (1, 3), code // 1000 in (2, 3)
        kind = KINDS.get(code % 1000)
        if kind is None or code // 1000 > 3:
            raise GeometryError(f"unknown WKB type {code}")
        width = 2 + z + m
        form = "<" + "d" * width

        def position():
            v = self.take(form)
            return (v[0], v[1], v[2] if z else None, v[-1] if m else None)

        def line():
            return [position() for _ in range(self.count(8 * width))]

        if kind == "Point":
            return Geometry(kind, position())
        if kind == "LineString":
            return Geometry(kind, line())
        if kind == "Polygon":
            return Geometry(kind, [line() for _ in range(self.count(4))])
        parts = [self.geometry() for _ in range(self.count(5))]
        if kind == "GeometryCollection":
            return Geometry(kind, parts)
        if any(p.kind != PART[kind] for p in parts):
            raise GeometryError(f"a {kind} holds another kind")
        return Geometry(kind, [p.coordinates for p in parts])


def flat_wkb(data: bytes) -> tuple[int, bool, bool, list[int], tuple[float, ...]] | None:
    """Type, z, m, numbers of positions of each run, and all ordinates of a point, line or polygon; None of others, which ``from_wkb`` reads (or refuses)."""
    if len(data) < 21 or data[0] != 1:
        return None
    (code,) = _U32.unpack_from(data, 1)
    dims, code = divmod(code, 1000)
    if dims > 3 or code not in (1, 2, 3):
        return None
    z, m = dims & 1 == 1, dims > 1
    width = 2 + z + m
    if code == 1:
        return (1, z, m, [1], struct.unpack_from(f"<{width}d", data, 5)) if len(data) >= 5 + 8 * width else None
    (n,) = _U32.unpack_from(data, 5)
    if code == 2:
        return (2, z, m, [n], struct.unpack_from(f"<{n * width}d", data, 9)) if n and len(data) >= 9 + 8 * width * n else None
    at, counts, out = 9, [], ()
    for _ in range(n):
        if at + 4 > len(data):
            return None
        (k,) = _U32.unpack_from(data, at)
        if not k or at + 4 + 8 * width * k > len(data):
            return None
        out += struct.unpack_from(f"<{k * width}d", data, at + 4)
        counts.append(k)
        at += 4 + 8 * width * k
    return (3, z, m, counts, out) if counts else None


_U32 = struct.Struct("<I")


# ---- WKT

WKT_NAMES = {k.upper(): k for k in CODES}
_TOKEN = re.compile(r"\s*([A-Za-z]+|[(),]|[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)")


def to_wkt(g: Geometry) -> str:
    z, m = _flags(g)
    tag = ("Z" if z else "") + ("M" if m else "")
    return g.kind.upper() + (f" {tag} " if tag else " ") + _wkt_body(g, z, m)


def _wkt_body(g: Geometry, z: bool, m: bool) -> str:
    if g.kind == "GeometryCollection":
        return "(" + ", ".join(to_wkt(x) for x in g.coordinates) + ")"

    def position(p):
        return " ".join(number_text(v) for v in (p[0], p[1], *([p[2] or 0.0] if z else []), *([p[3] or 0.0] if m else [])))

    def nested(c, depth):
        return position(c) if depth == 0 else "(" + ", ".join(nested(x, depth - 1) for x in c) + ")"

    return f"({position(g.coordinates)})" if g.kind == "Point" else nested(g.coordinates, DEPTH[g.kind])


def wkt_of_wkb(data: bytes) -> str:
    """``to_wkt(from_wkb(data))``."""
    if (flat := flat_wkb(data)) is None:
        return to_wkt(from_wkb(data))
    code, z, m, counts, v = flat
    width = 2 + z + m
    words = list(map(number_text, v if width == 2 else (x or 0.0 if i % width > 1 else x for i, x in enumerate(v))))
    positions = list(map(" ".join, zip(*[iter(words)] * width, strict=True)))
    tag = ("Z" if z else "") + ("M" if m else "")
    head = KINDS[code].upper() + (f" {tag} (" if tag else " (")
    if code < 3:
        return f"{head}{', '.join(positions)})"
    rings, at = [], 0
    for n in counts:
        rings.append(f"({', '.join(positions[at : at + n])})")
        at += n
    return f"{head}{', '.join(rings)})"


_NUMBER = r"[-+]?(?:\d++\.?\d*+|\.\d++)(?:[eE][-+]?\d++)?"
_RUN = {tag: rf"\({_NUMBER}(?: {_NUMBER}){{{n}}}(?:, {_NUMBER}(?: {_NUMBER}){{{n}}})*+\)" for tag, n in (("", 1), ("Z", 2), ("M", 2), ("ZM", 3))}
#: Points, lines and polygons of two to four ordinates, each position with as many as the tag says.
_FLAT_WKT = {tag: re.compile(rf"(?:POINT|LINESTRING) {tag}{' ' if tag else ''}{run}|POLYGON {tag}{' ' if tag else ''}\({run}(?:, {run})*+\)", re.ASCII) for tag, run in _RUN.items()}
_FLAT_HEAD = re.compile(r"(POINT|LINESTRING|POLYGON) (Z |M |ZM )?\(")


def wkb_of_wkt(text: str) -> bytes:
    """``to_wkb(from_wkt(text))``."""
    if (head := _FLAT_HEAD.match(text)) and "-0" not in text:
        tag = (head[2] or "").rstrip()
        if _FLAT_WKT[tag].fullmatch(text):
            width, code = 2 + len(tag), 1000 * ("Z" in tag) + 2000 * ("M" in tag)
            if head[1] == "POLYGON":
                runs = [r.replace(",", "").split(" ") for r in text[head.end() + 1 : -2].split("), (")]
                return struct.pack("<BII", 1, 3 + code, len(runs)) + b"".join(struct.pack(f"<I{len(r)}d", len(r) // width, *map(float, r)) for r in runs)
            words = text[head.end() : -1].replace(",", "").split(" ")
            n = len(words) // width
            if head[1] == "LINESTRING":
                return struct.pack(f"<BII{len(words)}d", 1, 2 + code, n, *map(float, words))
            if n == 1:
                return struct.pack(f"<BI{len(words)}d", 1, 1 + code, *map(float, words))
    return to_wkb(from_wkt(text))


def from_wkt(text: str) -> Geometry:
    tokens, at = [], 0
    end = len(text.rstrip())
    while at < end:
        found = _TOKEN.match(text, at)
        if not found:
            raise GeometryError(f"unexpected WKT at {at}")
        tokens.append(found[1])
        at = found.end()
    reader = _Wkt(tokens)
    g = reader.geometry()
    if reader.at != len(tokens):
        raise GeometryError("text behind the WKT geometry")
    return g


class _Wkt:
    def __init__(self, tokens: list[str]):
        self.tokens, self.at = tokens, 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, what: str = "") -> str:
        token = self.peek()
        if not token or what and token != what:
            raise GeometryError(f"WKT has {token or 'its end'} where {what or 'more'} is expected")
        self.at += 1
        return token

    def listed(self, item):
        self.take("(")
        out = [item()]
        while self.peek() == ",":
            self.take(",")
            out.append(item())
        self.take(")")
        return out

    def geometry(self) -> Geometry:
        name = self.take().upper()
        kind = WKT_NAMES.get(name)
        if kind is None:
            raise GeometryError(f"unknown WKT type {name}")
        tag = self.take().upper() if self.peek().upper() in ("Z", "M", "ZM") else ""

        def position():
            values = []
            while self.peek() and self.peek() not in "(),":
                try:
                    values.append(float(self.take()))
                except ValueError as e:
                    raise GeometryError("WKT has a word in a position") from e
            if len(values) < 2 + len(tag):
                raise GeometryError("a WKT position lacks ordinates")
            z = values[2] if len(values) > 2 and tag != "M" else None
            m = values[2] if tag == "M" else values[3] if len(values) > 3 else None
            return (values[0], values[1], z, m)

        def point_of_many():
            return self.listed(position)[0] if self.peek() == "(" else position()

        def line():
            return self.listed(position)

        def rings():
            return self.listed(line)

        if kind == "Point":
            found = self.listed(position)
            if len(found) != 1:
                raise GeometryError("a WKT point has one position")
            return Geometry(kind, found[0])
        reads = {"LineString": line, "Polygon": rings, "MultiLineString": rings, "MultiPoint": lambda: self.listed(point_of_many), "MultiPolygon": lambda: self.listed(rings), "GeometryCollection": lambda: self.listed(self.geometry)}
        return Geometry(kind, reads[kind]())


# ---- GeoJSON


def from_geojson(value: Any) -> Geometry | None:
    """Geometry of a parsed GeoJSON geometry; a third ordinate is z, a fourth is skipped."""
    if value is None:
        return None
    if not isinstance(value, dict) or "type" not in value:
        raise GeometryError("a GeoJSON geometry is an object with a type")
    kind = value["type"]
    if kind == "Point":
        c = value.get("coordinates")
        if type(c) is list and len(c) == 2 and type(c[0]) is float and type(c[1]) is float:
            return Geometry(kind, (c[0], c[1], None, None))
    if kind == "GeometryCollection":
        return Geometry(kind, [from_geojson(g) for g in value.get("geometries") or []])
    if kind not in DEPTH:
        raise GeometryError(f"unknown GeoJSON type {kind}")

    def read(c, depth):
        if not isinstance(c, list):
            raise GeometryError("GeoJSON coordinates are arrays")
        if depth:
            return [read(x, depth - 1) for x in c]
        if len(c) < 2 or not all(isinstance(x, int | float) and not isinstance(x, bool) for x in c):
            raise GeometryError("a GeoJSON position has two numbers at least")
        return (float(c[0]), float(c[1]), float(c[2]) if len(c) > 2 else None, None)

    return Geometry(kind, read(value.get("coordinates"), DEPTH[kind]))


def geojson_text(g: Geometry | None) -> str:
    """GeoJSON of a geometry; m is left out."""
    if g is None:
        return "null"
    if g.kind == "GeometryCollection":
        return '{"type":"GeometryCollection","geometries":[' + ",".join(map(geojson_text, g.coordinates)) + "]}"

    def text(c, depth):
        if depth:
            return "[" + ",".join(text(x, depth - 1) for x in c) + "]"
        return "[" + ",".join(number_text(v) for v in c[:3] if v is not None) + "]"

    return f'{{"type":"{g.kind}","coordinates":{text(g.coordinates, DEPTH[g.kind])}}}'


def json_text(value: Any) -> str:
    """Compact JSON whose numbers have no exponents."""
    if isinstance(value, bool) or value is None:
        return json.dumps(value)
    if isinstance(value, int | float):
        return number_text(value) if value == value and abs(value) != float("inf") else "null"
    if isinstance(value, dict):
        return "{" + ",".join(f"{json_string(k)}:{json_text(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list | tuple):
        return "[" + ",".join(map(json_text, value)) + "]"
    return json_string(str(value))


def json_string(s: str) -> str:
    return json.dumps(s, ensure_ascii=False)


def raw_at(text: str, path: list[str]) -> str | None:
    """The verbatim text of the value at a path of member names; of repeated names the first."""
    scan, blank = json.JSONDecoder().raw_decode, re.compile(r"\s*")
    skip = lambda i: blank.match(text, i).end()
    at = skip(0)
    for name in path:
        if text[at : at + 1] != "{":
            return None
        at = skip(at + 1)
        while text[at] != "}":
            key, at = scan(text, at)
            at = skip(skip(at) + 1)  # behind the colon
            if key == name:
                break
            at = skip(scan(text, at)[1])
            at = skip(at + 1) if text[at] == "," else at
        else:
            return None
    return text[at : scan(text, at)[1]]


# ---- rings


def signed_area(ring: list[Position]) -> float:
    """Shoelace area: positive if the ring runs counter-clockwise."""
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, [*ring[1:], ring[0]], strict=True)) / 2 if ring else 0.0


def is_clockwise(ring: list[Position]) -> bool:
    return signed_area(ring) < 0


def wound(ring: list[Position], clockwise: bool) -> list[Position]:
    return list(ring) if is_clockwise(ring) == clockwise else list(reversed(ring))


def shells(rings: list[list[Position]]) -> Geometry:
    """Polygon or MultiPolygon: a clockwise ring (and the first) opens a shell, others are holes of the latest."""
    out: list[list[list[Position]]] = []
    for r in rings:
        if not out or is_clockwise(r):
            out.append([r])
        else:
            out[-1].append(r)
    return Geometry("Polygon", out[0] if out else []) if len(out) <= 1 else Geometry("MultiPolygon", out)


def combined(parts: list[Geometry]) -> Geometry:
    """The Multi* of parts of one simple kind, else a collection."""
    if not parts:
        raise GeometryError("an empty multi-geometry")
    kinds = {p.kind for p in parts}
    multi = {v: k for k, v in PART.items()}
    if len(kinds) == 1 and (kind := kinds.pop()) in multi:
        return Geometry(multi[kind], [p.coordinates for p in parts])
    return Geometry("GeometryCollection", parts)
