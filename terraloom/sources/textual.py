"""Codecs of text formats: GeoJSON, WKT lines, CSV, KML and KMZ.

A feature is (properties, geometry): properties as a list of (name, JSON value), in order, geometry or None.
"""

from __future__ import annotations

import csv
import io
import json
import os
import re
import struct
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import partial
from itertools import chain
from typing import BinaryIO
from xml.sax.saxutils import escape

import numpy as np

from ..functions import geometry as G

Feature = tuple[list[tuple[str, object]], "G.Geometry | None"]


class FormatError(ValueError):
    pass


class Pairs(list):
    """A JSON object as its pairs, so that order and repeated names are kept."""

    def to_dict(self):
        return {k: _plain(v) for k, v in reversed(self)}


def _object(pairs: list):
    """An object whose names all differ is a dict; others stay pairs."""
    found = dict(pairs)
    return found if len(found) == len(pairs) else Pairs(pairs)


def _plain_top(v) -> dict:
    return v if isinstance(v, dict) else dict(reversed(v))


def _plain(v):
    """Pairs, at any depth, as dicts in which the first of equal names wins."""
    if isinstance(v, Pairs):
        return v.to_dict()
    if isinstance(v, list):
        return [_plain(x) for x in v] if any(isinstance(x, list | dict) for x in v) else v
    return {k: _plain(x) for k, x in v.items()} if isinstance(v, dict) else v


# ---- GeoJSON


def read_geojson(data: bytes) -> Iterator[Feature]:
    """Features of a FeatureCollection, a Feature or a bare geometry."""
    root = json.loads(data.decode(), object_pairs_hook=_object)
    if not isinstance(root, dict | Pairs):
        raise FormatError("GeoJSON is an object")
    top = _plain_top(root)
    if isinstance(top.get("features"), list):
        for f in top["features"]:
            yield _feature(f)
    elif top.get("type") == "Feature":
        yield _feature(root)
    elif top.get("type") in G.CODES:
        yield [], G.from_geojson(_plain(root))
    else:
        raise FormatError(f"not GeoJSON: {top.get('type')}")


BLOCK = 4 << 20
_NESTING = np.zeros(256, dtype=np.int8)
_NESTING[[ord(c) for c in "{["]], _NESTING[[ord(c) for c in "}]"]] = 1, -1


def _blocks(file: BinaryIO) -> Iterator[bytes]:
    """Blocks of a file, none of which ends with a backslash."""
    while block := file.read(BLOCK):
        while block.endswith(b"\\") and (more := file.read(1)):
            block += more
        yield block


def _quotes(block: bytes) -> np.ndarray:
    """Places of the quotes before which there is an even number of backslashes."""
    b = np.frombuffer(block, dtype=np.uint8)
    quotes = np.flatnonzero(b == 34)
    if b"\\" in block:
        odd, run, k = np.zeros(len(quotes), dtype=bool), quotes > 0, 1
        while (run := run & (b[np.maximum(quotes - k, 0)] == 92) & (quotes >= k)).any():
            odd[run] = k & 1 == 1
            k += 1
        quotes = quotes[~odd]
    return quotes


def geojson_pieces(path: str, size: int) -> list[tuple[int, int, int]] | None:
    """(first byte, end, features before) of pieces of a FeatureCollection, of about ``size`` bytes each; None of other JSON.

    One pass over the bytes: quotes tell what is text, brackets outside of it how deep it is nested; features begin in the third level.
    """
    base, text, depth, array, end, n = 0, 0, 0, None, None, 0
    cuts: list[tuple[int, int]] = []
    with open(path, "rb") as file, open(path, "rb") as again:
        for block in _blocks(file):
            quotes = _quotes(block)
            b = np.frombuffer(block, dtype=np.uint8)
            at = np.flatnonzero(_NESTING[b])
            at = at[(np.searchsorted(quotes, at) + text) & 1 == 0]
            delta = _NESTING[b[at]]
            depths = depth + np.cumsum(delta, dtype=np.int64)
            if end is None:
                for i in np.flatnonzero(((depths == 2) & (delta == 1)) | ((depths == 1) & (delta == -1))).tolist():
                    place = base + int(at[i])
                    if delta[i] == 1 and array is None:
                        again.seek(max(0, place - 256))
                        if re.search(rb'[{,]\s*"features"\s*:\s*\Z', again.read(min(256, place))):
                            if block[at[i]] != ord("["):
                                return None
                            array = place
                    elif delta[i] == -1 and array is not None:
                        end = place
                        break
                if array is not None:
                    opens = base + at[(depths == 3) & (delta == 1)].astype(np.int64)
                    opens = opens[(opens > array) & ((opens < end) if end is not None else True)]
                    while len(opens):
                        k = int(np.searchsorted(opens, cuts[-1][0] + size)) if cuts else 0
                        if k < len(opens):
                            cuts.append((int(opens[k]), n + k))
                            k += 1
                        n, opens = n + k, opens[k:]
            text = (text + len(quotes)) & 1
            depth = int(depths[-1]) if len(depths) else depth
            base += len(block)
        if end is None or not cuts or end - cuts[0][0] < size:
            return None
        again.seek(0)
        head = again.read(array + 1) if array < BLOCK else b""
        again.seek(end)
        tail = again.read(BLOCK + 1)
        try:  # what stands around the features is an object whose first member of that name is the array
            root = json.loads((head + tail).decode(), object_pairs_hook=_object)
            if not isinstance(root, dict | Pairs) or _plain_top(root).get("features") != []:
                return None
        except ValueError:
            return None
    # what isn't an object, between the bracket and the first feature, is left to the first piece
    return [(low, high, n) for (low, n), (high, _) in zip([(array + 1, 0), *cuts[1:]], [*cuts[1:], (end, 0)], strict=True)]


def read_geojson_piece(data: bytes) -> Iterator[Feature]:
    for f in json.loads("[" + data.decode().strip().removesuffix(",") + "]", object_pairs_hook=_object):
        yield _feature(f)


def _feature(f) -> Feature:
    if not isinstance(f, dict | Pairs):
        raise FormatError("a feature is an object")
    top = _plain_top(f)
    g, p = top.get("geometry"), top.get("properties") or {}
    return [(k, _plain(v)) for k, v in (p.items() if isinstance(p, dict) else p)], G.from_geojson(_plain(g)) if g is not None else None


def geojson_feature(feature: Feature) -> str:
    p, g = feature
    body = ",".join(f"{G.json_string(k)}:{G.json_text(v)}" for k, v in p)
    return f'{{"type":"Feature","geometry":{G.geojson_text(g)},"properties":{{{body}}}}}'


@dataclass(frozen=True)
class TextForm:
    """How a text format is put together: what opens it, a feature's text, what stands between features, what ends it."""

    head: str
    each: Callable[[Feature], str]
    between: str = ""
    tail: str = ""

    def write(self, features: Iterable[Feature], out: io.BufferedIOBase) -> None:
        self.join((self.each(f).encode() for f in features), out)

    def join(self, chunks: Iterable[bytes], out: io.BufferedIOBase) -> None:
        """Write chunks of features' texts that are joined already."""
        out.write(self.head.encode())
        for i, c in enumerate(chunks):
            out.write(self.between.encode() * (i > 0) + c)
        out.write(self.tail.encode())


GEOJSON_FORM = TextForm('{"type":"FeatureCollection","features":[', geojson_feature, ",", "]}")


def write_geojson(features: Iterable[Feature], out: io.BufferedIOBase, crs=None) -> None:
    GEOJSON_FORM.write(features, out)


# ---- WKT lines


def read_wkt(data: bytes) -> Iterator[Feature]:
    for n, line in enumerate(data.decode().splitlines(), 1):
        if line.strip():
            try:
                yield [], G.from_wkt(line.strip())
            except G.GeometryError as e:
                raise FormatError(f"line {n}: {e}") from e


def wkt_line(feature: Feature) -> str:
    return (G.to_wkt(feature[1]) if feature[1] else "") + "\n"


WKT_FORM = TextForm("", wkt_line)


def write_wkt(features: Iterable[Feature], out: io.BufferedIOBase, crs=None) -> None:
    WKT_FORM.write(features, out)


# ---- CSV

GEOMETRY_NAMES = ("geometry", "geom", "wkt", "the_geom")
_INT, _DOUBLE = re.compile(r"[+-]?\d+"), re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?")


def csv_value(cell: str):
    """null, bool, int, double or string of a cell."""
    if cell == "":
        return None
    if cell.lower() in ("true", "false"):
        return cell.lower() == "true"
    if _INT.fullmatch(cell) and abs(int(cell)) < 1 << 63:
        return int(cell)
    if _DOUBLE.fullmatch(cell) and (v := float(cell)) not in (float("inf"), float("-inf")):
        return v
    return cell


def read_csv(data: bytes) -> Iterator[Feature]:
    rows = csv.reader(io.StringIO(data.decode(), newline=""))
    header = next(rows, None)
    if header is None:
        return
    names = [h.strip().lower() for h in header]
    at = next((i for i, n in enumerate(names) if n in GEOMETRY_NAMES), None)
    if at is None:
        raise FormatError("CSV has no geometry column (" + ", ".join(GEOMETRY_NAMES) + ")")
    for row in rows:
        if not any(row):
            continue
        row = row + [""] * (len(header) - len(row))
        text = row[at].strip()
        yield [(h, csv_value(c)) for i, (h, c) in enumerate(zip(header, row, strict=False)) if i != at], G.from_wkt(text) if text else None


def csv_pieces(path: str, size: int) -> list[tuple[int, int]] | None:
    """(first byte, end) of pieces of a file's records behind the first one; None if quotes don't tell for certain where a record ends.

    A line feed between quotes (an odd number of them before it) is text. That holds if each quote that opens stands at the start of a field.
    """
    base, text, last, begin = 0, 0, b"\n", None
    cuts: list[int] = []
    with open(path, "rb") as file:
        while block := file.read(BLOCK):
            b = np.frombuffer(block, dtype=np.uint8)
            quotes, ends = np.flatnonzero(b == 34), np.flatnonzero(b == 10)
            opening = quotes[text::2]
            before = np.where(opening > 0, b[np.maximum(opening - 1, 0)], last[-1])
            again = np.isin(opening - 1, quotes) | ((opening == 0) & (last == b'"'))  # the second of two quotes in a field
            if not (np.isin(before, (44, 10)) | again).all():
                return None
            returns = np.flatnonzero(b == 13)
            if len(returns) and (b[np.minimum(returns + 1, len(b) - 1)] != 10).any() or base == 0 and block.startswith((b"\xef\xbb\xbf", b"\xff\xfe", b"\xfe\xff")):
                return None
            ends = ends[(np.searchsorted(quotes, ends) + text) & 1 == 0] + base + 1
            if len(ends) and begin is None:
                begin = int(ends[0])
                cuts.append(begin)
            while begin is not None and (k := int(np.searchsorted(ends, cuts[-1] + size))) < len(ends):
                cuts.append(int(ends[k]))
                ends = ends[k + 1 :]
            text, last, base = (text + len(quotes)) & 1, block[-1:], base + len(block)
    if text or begin is None:
        return None
    return [(low, high) for low, high in zip(cuts, [*cuts[1:], base], strict=True) if high > low]


def csv_records(data: bytes, crlf: bool = False) -> list[bytes]:
    """Records of a piece without their line ends; blank lines are left out. In files with CR LF, line ends in text become LF, as by Spark."""
    data = data.replace(b"\r\n", b"\n") if crlf else data
    b = np.frombuffer(data, dtype=np.uint8)
    quotes, ends = np.flatnonzero(b == 34), np.flatnonzero(b == 10)
    cuts = [0, *(ends[np.searchsorted(quotes, ends) & 1 == 0] + 1).tolist(), len(data)]
    return [x for low, high in zip(cuts, cuts[1:], strict=False) if (x := data[low:high].removesuffix(b"\n").removesuffix(b"\r"))]


def csv_field(text: str) -> str:
    return '"' + text.replace('"', '""') + '"' if any(c in text for c in ',"\n\r') else text


def csv_text(v) -> str:
    return "" if v is None else v if isinstance(v, str) else G.json_text(v)


def csv_row(feature: Feature, names: list[str]) -> str:
    values, g = dict(reversed(feature[0])), feature[1]
    return ",".join([*(csv_field(csv_text(values.get(n))) for n in names), csv_field(G.to_wkt(g) if g else "")]) + "\n"


def csv_form(names: list[str]) -> TextForm:
    return TextForm(",".join(map(csv_field, [*names, "geometry"])) + "\n", partial(csv_row, names=names))


def write_csv(features: Iterable[Feature], out: io.BufferedIOBase, crs=None, names: list[str] | None = None) -> None:
    features = iter(features)
    first = next(features, None)
    form = csv_form(names or [k for k, _ in first[0]] if first else names or [])
    form.write([] if first is None else chain([first], features), out)


# ---- KML

SIMPLE = {"Point", "LineString", "LinearRing", "Polygon", "MultiGeometry"}


def _local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _children(e: ET.Element, name: str) -> list[ET.Element]:
    return [c for c in e if _local(c) == name]


def _text(e: ET.Element) -> str:
    return "".join(e.itertext())


def _coordinates(e: ET.Element) -> list[G.Position]:
    found = _children(e, "coordinates")
    out = []
    for word in _text(found[0]).split() if found else []:
        v = [float(x) for x in word.split(",")]
        if len(v) < 2:
            raise FormatError("a KML position has two numbers at least")
        out.append((v[0], v[1], v[2] if len(v) > 2 else None, None))
    if not out:
        raise FormatError("a KML geometry has no coordinates")
    return out


def _kml_geometry(e: ET.Element) -> G.Geometry:
    kind = _local(e)
    if kind == "Point":
        return G.Geometry("Point", _coordinates(e)[0])
    if kind in ("LineString", "LinearRing"):
        return G.Geometry("LineString", _coordinates(e))
    if kind == "Polygon":
        ring = lambda b: _coordinates(next(iter(_children(b, "LinearRing"))))
        return G.Geometry("Polygon", [ring(b) for n in ("outerBoundaryIs", "innerBoundaryIs") for b in _children(e, n)])
    return G.combined([_kml_geometry(c) for c in e if _local(c) in SIMPLE])


def _placemarks(e: ET.Element) -> Iterator[ET.Element]:
    for c in e:
        if _local(c) == "Placemark":
            yield c
        else:
            yield from _placemarks(c)


def read_kml(data: bytes) -> Iterator[Feature]:
    if b"<!DOCTYPE" in data or b"<!ENTITY" in data:
        raise FormatError("KML with a document type isn't read")
    for mark in _placemarks(ET.Element("top")) if not data.strip() else _placemarks(_wrapped(ET.fromstring(data))):
        properties: list[tuple[str, object]] = []
        for c in mark:
            if _local(c) in ("name", "description"):
                properties.append((_local(c), _text(c)))
            elif _local(c) == "ExtendedData":
                for d in c.iter():
                    if _local(d) == "Data":
                        value = _children(d, "value")
                        properties.append((d.get("name", ""), _text(value[0]) if value else ""))
                    elif _local(d) == "SimpleData":
                        properties.append((d.get("name", ""), _text(d)))
        shape = next((c for c in mark if _local(c) in SIMPLE), None)
        yield properties, _kml_geometry(shape) if shape is not None else None


_MARKS = re.compile(rb"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<(?P<ends>/?)(?:[\w.-]+:)?Placemark(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*?(?P<empty>/?)>|(?P<cut><!--|<!\[CDATA\[|<\?|</?(?:[\w.-]+:)?Placemark(?=[\s/>]))", re.DOTALL)
#: No tag, comment or the like may be longer, if a file is to be read in pieces.
LONGEST_MARK = 1 << 16


def _spans(data: bytes, depth: int = 0, limit: int | None = None) -> Iterator[tuple[int, int, int, int]]:
    """(start, end, depth behind, end of the mark) of marks up to a limit; start and end, else -1, are those of outermost placemarks."""
    for found in _MARKS.finditer(data):
        if limit is not None and found.start() >= limit:
            return
        start = finish = -1
        if found["cut"] is not None:
            raise FormatError("a tag or comment has no end, or is too long for pieces")
        if found["ends"] == b"/":
            depth -= 1
            finish = found.end() if depth == 0 else -1
            if depth < 0:
                raise FormatError("a placemark ends that didn't begin")
        elif found["empty"] == b"/":
            start, finish = (found.start(), found.end()) if depth == 0 else (-1, -1)
        elif found["ends"] is not None:
            depth += 1
            start = found.start() if depth == 1 else -1
        yield start, finish, depth, found.end()


def kml_pieces(path: str, size: int, low: int = 0, length: int | None = None) -> tuple[list[tuple[int, int, int]], list[str]] | None:
    """(first byte, end, placemarks before) of pieces of a KML document, and prefixes of names in it; None of documents that aren't so simple.

    Markup can't stand in text or attributes, so one pass finds all placemarks; what is around them is checked by the parser.
    """
    from xml.parsers import expat

    length = os.path.getsize(path) - low if length is None else length
    prefixes: set[str] = set()
    parser = expat.ParserCreate(namespace_separator="}")
    parser.StartNamespaceDeclHandler = lambda prefix, uri: prefixes.add(prefix) if prefix else None
    cuts: list[tuple[int, int]] = []
    end = n = depth = done = 0
    buffer, base, around = b"", 0, 0  # base: the buffer's place; around: where what hasn't gone to the parser begins
    try:
        with open(path, "rb") as file:
            file.seek(low)
            while True:
                block = file.read(min(BLOCK, length - base - len(buffer)))
                buffer += block
                if base == 0 and (re.match(rb"\xff\xfe|\xfe\xff|\x00", buffer) or (found := re.match(rb"(?:\xef\xbb\xbf)?<\?xml[^>]*encoding\s*=\s*[\"']([^\"']*)", buffer)) and found[1].lower() not in (b"utf-8", b"us-ascii", b"ascii")):
                    return None
                if b"<!DOCTYPE" in buffer or b"<!ENTITY" in buffer:
                    return None
                limit = len(buffer) if not block else max(0, len(buffer) - LONGEST_MARK)
                stop = limit
                for start, finish, depth, mark_end in _spans(buffer, depth, limit):  # noqa: B020 - depth goes on from block to block
                    stop = max(stop, mark_end)
                    if start >= 0:
                        parser.Parse(buffer[max(0, around - base) : start] + b"<x/>")
                        if not cuts or base + start - cuts[-1][0] >= size:
                            cuts.append((base + start, n))
                        n += 1
                    if finish >= 0:
                        end = around = base + finish
                if depth == 0:
                    parser.Parse(buffer[max(0, around - base) : stop])
                    around = base + stop
                if not block:
                    break
                base, buffer = base + stop, buffer[stop:]
            parser.Parse(b"", True)
    except (expat.ExpatError, FormatError):
        return None
    if depth or len(cuts) < 2:
        return None
    return [(low + a, low + b, k) for (a, k), (b, _) in zip(cuts, [*cuts[1:], (end, 0)], strict=True)], sorted(prefixes)


def read_kml_piece(data: bytes, prefixes: list[str]) -> Iterator[Feature]:
    """Placemarks in a part of a document that begins with one; what stands between them is left out."""
    marks, begin = [], 0
    for start, finish, *_ in _spans(data):
        begin = start if start >= 0 else begin
        if finish >= 0:
            marks.append(data[begin:finish])
    bound = "".join(f' xmlns:{p}="{p}"' for p in prefixes)
    yield from read_kml(f"<top{bound}>".encode() + b"".join(marks) + b"</top>")


def kmz_entries(path: str) -> list[tuple[str, int, int] | tuple[str, None, None]]:
    """The documents of a KMZ: name, and where those that are stored as they are begin, and how long they are."""
    out = []
    with zipfile.ZipFile(path) as z, open(path, "rb") as file:
        for info in z.infolist():
            if not info.filename.lower().endswith(".kml"):
                continue
            file.seek(info.header_offset)
            head = file.read(30)
            at = info.header_offset + 30 + sum(struct.unpack_from("<2H", head, 26))
            plain = info.compress_type == zipfile.ZIP_STORED and not info.flag_bits & 1
            out.append((info.filename, at, info.file_size) if plain else (info.filename, None, None))
    return out


def _wrapped(root: ET.Element) -> ET.Element:
    top = ET.Element("top")
    top.append(root)
    return top


def _kml_coordinates(ps: list[G.Position]) -> str:
    return "<coordinates>" + " ".join(",".join(G.number_text(v) for v in p[:3] if v is not None) for p in ps) + "</coordinates>"


def kml_geometry(g: G.Geometry) -> str:
    if g.kind == "Point":
        return f"<Point>{_kml_coordinates([g.coordinates])}</Point>"
    if g.kind == "LineString":
        return f"<LineString>{_kml_coordinates(g.coordinates)}</LineString>"
    if g.kind == "Polygon":
        rings = [f"<LinearRing>{_kml_coordinates(r)}</LinearRing>" for r in g.coordinates]
        return "<Polygon>" + "".join(f"<{n}BoundaryIs>{r}</{n}BoundaryIs>" for r, n in zip(rings, ["outer", *["inner"] * len(rings)], strict=False)) + "</Polygon>"
    parts = g.coordinates if g.kind == "GeometryCollection" else [G.Geometry(G.PART[g.kind], c) for c in g.coordinates]
    return "<MultiGeometry>" + "".join(map(kml_geometry, parts)) + "</MultiGeometry>"


def kml_placemark(feature: Feature) -> str:
    special, data = [], []
    for k, v in feature[0]:
        if v is None:
            continue
        text = escape(v if isinstance(v, str) else G.json_text(0 if isinstance(v, float) and v == 0 else v))  # text has no negative zero
        if k in ("name", "description"):
            special.append(f"<{k}>{text}</{k}>")
        else:
            data.append(f'<Data name="{escape(k, {chr(34): "&quot;"})}"><value>{text}</value></Data>')
    extended = f"<ExtendedData>{''.join(data)}</ExtendedData>" if data else ""
    return f"<Placemark>{''.join(special)}{extended}{kml_geometry(feature[1]) if feature[1] else ''}</Placemark>"


KML_FORM = TextForm('<?xml version="1.0" encoding="UTF-8"?>\n<kml xmlns="http://www.opengis.net/kml/2.2"><Document>', kml_placemark, "", "</Document></kml>\n")


def write_kml(features: Iterable[Feature], out: io.BufferedIOBase, crs=None) -> None:
    KML_FORM.write(features, out)


def read_kmz(data: bytes) -> Iterator[Feature]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = [n for n in z.namelist() if n.lower().endswith(".kml")]
        if not names:
            raise FormatError("the KMZ holds no .kml file")
        for n in names:
            yield from read_kml(z.read(n))


def write_kmz(features: Iterable[Feature], out: io.BufferedIOBase, crs=None) -> None:
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z, z.open("doc.kml", "w") as f:
        write_kml(features, f)
