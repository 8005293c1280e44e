"""Geometry functions on columns. Expressions where Catalyst can do it, Arrow UDFs for the codecs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geometry as G

HILBERT_MAX = 65535


def _mapped(f: Callable, kind: str, to: pa.DataType) -> Callable[[Column], Column]:
    """An Arrow UDF of one column; null stays null."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([None if v is None else f(v) for v in b.to_pylist()], type=to)

    return F.arrow_udf(run, kind)


def wkt_of(wkb: Column) -> Column:
    return _mapped(G.wkt_of_wkb, "string", pa.string())(wkb)


def wkb_of(wkt: Column) -> Column:
    return _mapped(G.wkb_of_wkt, "binary", pa.binary())(wkt)


def geojson_of(wkb: Column) -> Column:
    return _mapped(lambda v: G.geojson_text(G.from_wkb(v)), "string", pa.string())(wkb)


def wkb_of_geojson(text: Column) -> Column:
    import json

    return _mapped(lambda v: (g := G.from_geojson(json.loads(v))) and G.to_wkb(g), "binary", pa.binary())(text)


def positions_mapped(wkb: Column, f: Callable[[np.ndarray], np.ndarray]) -> Column:
    """Geometries with each run of positions replaced by ``f`` of an (n, 4) array of x, y, z, m (NaN where absent)."""

    def run(ps: list[G.Position]) -> list[G.Position]:
        given = np.array([[np.nan if v is None else v for v in p] for p in ps], dtype=float)
        out = f(given)
        return [tuple(None if v is None else float(n) for v, n in zip(p, row, strict=True)) for p, row in zip(ps, out, strict=True)]

    return _mapped(lambda v: G.to_wkb(G.from_wkb(v).map_runs(run)), "binary", pa.binary())(wkb)


_BOX = ("minx", "miny", "maxx", "maxy", "minz", "maxz", "minm", "maxm")


def bbox_of(wkb: Column) -> Column:
    """struct of eight bounds; null for a null or empty geometry."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield _boxes(b)

    return F.arrow_udf(run, "struct<" + ",".join(f"{n}:double" for n in _BOX) + ">")(wkb)


_POINT_HEAD = np.frombuffer(b"\x01\x01\x00\x00\x00", dtype=np.uint8)


def _boxes(wkb: pa.Array) -> pa.Array:
    """Boxes of a batch: plain points by their bytes, at once, other geometries one by one."""
    n = len(wkb)
    out, known = np.full((n, len(_BOX)), np.nan), np.zeros(n, dtype=bool)
    if n and pa.types.is_binary(wkb.type):
        _, ends, data = wkb.buffers()
        at = np.frombuffer(ends, dtype=np.int32)[wkb.offset : wkb.offset + n + 1]
        points = np.flatnonzero((np.diff(at) == 21) & wkb.is_valid().to_numpy(zero_copy_only=False))
        if len(points):
            raw = np.frombuffer(data, dtype=np.uint8)[at[points][:, None] + np.arange(21)]
            plain = (raw[:, :5] == _POINT_HEAD).all(axis=1)
            points, xy = points[plain], np.ascontiguousarray(raw[plain, 5:]).view("<f8")
            out[points, 0:2] = out[points, 2:4] = xy
            known[points] = True
    others = np.flatnonzero(~known)
    for i, v in zip(others.tolist(), wkb.take(pa.array(others)).to_pylist(), strict=True):
        if v is None:
            continue
        if flat := G.flat_wkb(v):
            _, z, m, _, at_all = flat
            w = 2 + z + m
            by = [at_all[k::w] for k in range(w)]
            out[i, :4] = min(by[0]), min(by[1]), max(by[0]), max(by[1])
            if z:
                out[i, 4:6] = min(by[2]), max(by[2])
            if m:
                out[i, 6:8] = min(by[-1]), max(by[-1])
            known[i] = True
        elif box := G.from_wkb(v).bbox():
            out[i] = [np.nan if x is None else x for x in box]
            known[i] = True
    columns = [pa.array(out[:, k], mask=np.isnan(out[:, k])) for k in range(len(_BOX))]
    return pa.StructArray.from_arrays(columns, names=list(_BOX), mask=pa.array(~known))


def type_code(wkb: Column) -> Column:
    """The ISO WKB type code, by byte arithmetic on the header."""
    h = F.hex(F.substring(wkb, 2, 4))
    return F.conv(F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)]), 16, 10).cast("int")


def type_name(wkb: Column) -> Column:
    """Kind with its dimension suffix, from the header alone."""
    code = type_code(wkb)
    kinds = F.array(*[F.lit(G.KINDS[i]) for i in range(1, 8)])
    suffix = F.get(F.array(F.lit(""), F.lit(" Z"), F.lit(" M"), F.lit(" ZM")), (code / 1000).cast("int"))
    return F.concat(F.get(kinds, code % 1000 - 1), suffix)


def point_wkt(*ordinates: Column, tag: str = "") -> Column:
    """WKT of points from columns of whole numbers (others go by ``wkt_of``)."""
    return F.concat(F.lit("POINT " + (f"{tag} " if tag else "") + "("), F.concat_ws(" ", *[o.cast("string") for o in ordinates]), F.lit(")"))


def hilbert(x: Column, y: Column) -> Column:
    """Place of a cell (16-bit x and y) on the Hilbert curve, as bigint: sixteen quadrant steps in one fold."""
    steps = F.lit([1 << i for i in range(15, -1, -1)]).cast("array<bigint>")
    start = F.struct(x.cast("bigint").alias("x"), y.cast("bigint").alias("y"), F.lit(0).cast("bigint").alias("d"))

    def step(t: Column, s: Column) -> Column:
        right, up = t["x"].bitwiseAND(s) > 0, t["y"].bitwiseAND(s) > 0
        quadrant = F.when(right, F.when(up, 2).otherwise(3)).otherwise(F.when(up, 1).otherwise(0))
        fx, fy = F.when(right, HILBERT_MAX - t["x"]).otherwise(t["x"]), F.when(right, HILBERT_MAX - t["y"]).otherwise(t["y"])
        return F.struct(F.when(up, t["x"]).otherwise(fy).alias("x"), F.when(up, t["y"]).otherwise(fx).alias("y"), (t["d"] + s * s * quadrant).alias("d"))

    return F.aggregate(steps, start, step, lambda t: t["d"])


def quantised(v: Column, low: Column, high: Column) -> Column:
    """A value's cell of 65536 between two bounds; 0 if they are equal; beyond them the nearest."""
    cell = F.floor((v - low) / (high - low) * HILBERT_MAX)
    return F.when(high == low, F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(F.lit(HILBERT_MAX), cell))).cast("bigint")


def signed_area(ring: Column) -> Column:
    """Shoelace area of a closed ring given as array<struct<x, y>>; positive if counter-clockwise."""
    ends = F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0)))
    begins = F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0)))
    return F.aggregate(F.zip_with(begins, ends, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda t, v: t + v) / 2


def iso_timestamp(ts: Column) -> Column:
    """YYYY-MM-DDTHH:MM:SS, with three or six digits of a second where it has a fraction."""
    micros = F.unix_micros(ts) % 1_000_000
    fraction = F.when(micros == 0, "").when(micros % 1000 == 0, F.date_format(ts, ".SSS")).otherwise(F.date_format(ts, ".SSSSSS"))
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), fraction)


def csv_kind(cell: Column) -> Column:
    """The kind a CSV cell is read as: null, bool, int, double or string."""
    return (
        F.when(cell.isNull() | (cell == ""), "null")
        .when(F.lower(cell).isin("true", "false"), "bool")
        .when(cell.rlike(r"^[+-]?\d+$") & F.ltrim(cell, F.lit("+")).try_cast("bigint").isNotNull(), "int")
        .when(cell.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), "double")
        .otherwise("string")
    )


def csv_field(text: Column) -> Column:
    """A field quoted if it holds a comma, a quote or a line end."""
    return F.when(text.rlike('[,"\n\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def clipped(text: str, limit: int) -> str:
    """The longest start of a text whose UTF-8 has at most ``limit`` bytes."""
    raw = text.encode()
    return text if len(raw) <= limit else raw[:limit].decode(errors="ignore")


def clipped_column(text: Column, limit: int) -> Column:
    return _mapped(lambda v: clipped(v, limit), "string", pa.string())(text)


def visible(text: str) -> str:
    """Text with control and non-ASCII bytes written the way ``cat -v`` does."""
    out = []
    for b in text.encode():
        high, low = ("M-", b - 128) if b >= 128 else ("", b)
        out.append(high + ("^?" if low == 127 else f"^{chr(low + 64)}" if low < 32 and not (low in (9, 10) and not high) else chr(low)))
    return "".join(out)


def visible_column(text: Column) -> Column:
    return _mapped(visible, "string", pa.string())(text)


@cache
def gpb_header(srs_id: int) -> bytes:
    import struct

    return b"GP" + struct.pack("<BBi", 0, 1, srs_id)


def gpb_of(wkb: Column, srs_id: int = 0) -> Column:
    """GeoPackage blob without an envelope."""
    return F.concat(F.lit(bytearray(gpb_header(srs_id))), wkb)


def wkb_of_gpb(blob: Column) -> Column:
    """WKB behind a GeoPackage header; the envelope's size is told by bits 1 to 3 of the flags."""
    flags = F.conv(F.hex(F.substring(blob, 4, 1)), 16, 10).cast("int")
    size = F.get(F.lit([0, 32, 48, 48, 64]), F.shiftright(flags, 1).bitwiseAND(F.lit(7)))
    return F.substring(blob, F.lit(9) + size, F.length(blob))
