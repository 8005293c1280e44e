import json
import struct

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from terraloom.functions import geometry as G
from terraloom.sources.binary import hilbert_values

WKTS = [
    "POINT (1 2)",
    "POINT Z (1 2 3)",
    "POINT M (1 2 3)",
    "POINT ZM (1 2 3 4)",
    "LINESTRING (0 0, 1.5 -2)",
    "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 1))",
    "MULTIPOINT (1 2, 3 4)",
    "MULTILINESTRING ((0 0, 1 1), (2 2, 3 3))",
    "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))",
    "GEOMETRYCOLLECTION (POINT (1 2), LINESTRING Z (0 0 1, 1 1 2))",
]


@pytest.mark.parametrize("text", WKTS)
def test_wkt_and_wkb_round_trip(text):
    g = G.from_wkt(text)
    assert G.to_wkt(g) == text
    assert G.from_wkb(G.to_wkb(g)) == g
    assert G.from_wkb(G.to_wkb(g) + b"more") == g


@pytest.mark.parametrize("text", [t for t in WKTS if " M" not in t and "ZM" not in t])
def test_geojson_round_trip(text):
    g = G.from_wkt(text)
    assert G.from_geojson(json.loads(G.geojson_text(g))) == g


@pytest.mark.parametrize("text", ["", "POINT EMPTY", "POINTZ (1 2 3)", "POINT (1)", "POINT (1 2", "CIRCLE (1 2)", "POINT (1 2) x"])
def test_bad_wkt(text):
    with pytest.raises(G.GeometryError):
        G.from_wkt(text)


def test_loose_wkt():
    assert G.from_wkt("multipoint ((1 2), (3 4))") == G.from_wkt("MULTIPOINT (1 2, 3 4)")
    assert G.from_wkt("POINT (1 2 3 4 5)").coordinates == (1, 2, 3, 4)


@pytest.mark.parametrize("data", [b"", b"\x00" + struct.pack(">I", 1), b"\x01" + struct.pack("<I", 0x20000001) + b"\0" * 20, b"\x01" + struct.pack("<I", 99), b"\x01" + struct.pack("<Id", 1, 1.0)])
def test_bad_wkb(data):
    with pytest.raises(G.GeometryError):
        G.from_wkb(data)


@given(st.floats(allow_nan=False, allow_infinity=False))
def test_number_text_reads_back_without_exponent(v):
    text = G.number_text(v)
    assert float(text) == v and "e" not in text.lower()


def test_numbers():
    assert [G.number_text(v) for v in (3.0, 1e21, 1e-7, 0.1, -2.5, 5)] == ["3", "1000000000000000000000", "0.0000001", "0.1", "-2.5", "5"]


def test_rings():
    ccw = [(0, 0, None, None), (4, 0, None, None), (4, 4, None, None), (0, 4, None, None), (0, 0, None, None)]
    assert G.signed_area(ccw) == 16 and not G.is_clockwise(ccw) and G.is_clockwise(G.wound(ccw, True))
    cw = G.wound(ccw, True)
    assert G.shells([cw, ccw]).kind == "Polygon" and G.shells([cw, ccw, cw]).kind == "MultiPolygon"


def test_bbox_has_only_real_z():
    g = G.from_wkt("GEOMETRYCOLLECTION (POINT (1 2), POINT Z (3 4 9))")
    assert g.bbox() == (1, 2, 3, 4, 9, 9, None, None)


def test_hilbert_values():
    known = {(0, 0): 0, (1, 0): 1, (1, 1): 2, (0, 1): 3, (2, 3): 9, (32768, 32768): 2147483648, (12345, 54321): 1555040834, (65535, 65535): 2863311530, (65535, 0): 4294967295, (0, 65535): 1431655765}
    found = hilbert_values(*(np.array(list(v)) for v in zip(*known, strict=True)))
    assert dict(zip(known, found.tolist(), strict=True)) == known


def test_raw_at():
    text = '{"a" : {"x": [1, {"b":2}], "b":{"c": 1.50 , "d":"}"} }, "z":1}'
    assert G.raw_at(text, ["a", "b"]) == '{"c": 1.50 , "d":"}"}'
    assert G.raw_at(text, ["z"]) == "1" and G.raw_at(text, ["a", "q"]) is None and G.raw_at(text, ["z", "q"]) is None
