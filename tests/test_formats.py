import io
import json
import os
import sqlite3
import struct

import pytest

from terraloom import cli
from terraloom.convert import ConversionError, convert, read, read_layers, write
from terraloom.crs.model import WGS84, Crs
from terraloom.functions import geometry as G
from terraloom.sources import binary, textual

SAMPLE = {
    "type": "FeatureCollection",
    "features": [
        {"type": "Feature", "properties": {"name": "Zürich, \"A\"", "n": 5, "x": 1.5, "ok": True, "tags": ["a"]}, "geometry": {"type": "Point", "coordinates": [8.5, 47.4]}},
        {"type": "Feature", "properties": {"name": None, "n": 7, "x": 2, "later": "y"}, "geometry": {"type": "Point", "coordinates": [-1, 2]}},
        {"type": "Feature", "properties": {"n": None}, "geometry": {"type": "Point", "coordinates": [3, 4]}},
    ],
}


@pytest.fixture
def sample(tmp_path):
    path = tmp_path / "in.geojson"
    path.write_text(json.dumps(SAMPLE))
    return str(path)


def rows(frame):
    names = sorted(frame.columns())
    return sorted((G.to_wkt(g) if g else "", tuple(dict(p).get(n) for n in names)) for p, g in frame.features())


def test_schema_is_inferred_in_first_seen_order(spark, sample):
    frame = read(spark, sample)
    assert frame.df.dtypes[1:-1] == [("name", "string"), ("n", "bigint"), ("x", "double"), ("ok", "boolean"), ("tags", "string"), ("later", "string")]
    assert frame.crs == WGS84
    assert rows(frame)[2][1][-1] in (1.5, None, 2.0)


@pytest.mark.parametrize("extension", ["parquet", "fgb", "csv", "gpkg", "shp", "kml", "kmz", "wkt"])
def test_there_and_back(spark, sample, tmp_path, extension):
    target = str(tmp_path / f"out.{extension}")
    convert(spark, sample, target)
    frame = read(spark, target)
    wkts = sorted(G.to_wkt(g) for _, g in frame.features())
    assert wkts == ["POINT (-1 2)", "POINT (3 4)", "POINT (8.5 47.4)"]
    if extension not in ("wkt", "kml", "kmz"):
        values = sorted((dict(p).get("n") or 0, dict(p).get("name") or "") for p, _ in frame.features())
        assert values == [(0, ""), (5, 'Zürich, "A"'), (7, "")]


def test_polygons_and_dimensions(spark, tmp_path):
    lines = ["POLYGON Z ((0 0 1, 0 4 1, 4 4 1, 4 0 1, 0 0 1), (1 1 2, 2 1 2, 2 2 2, 1 1 2))", "MULTIPOLYGON Z (((0 0 1, 0 1 1, 1 1 1, 0 0 1)), ((5 5 1, 5 6 1, 6 6 1, 5 5 1)))"]
    (tmp_path / "in.wkt").write_text("\n\n".join(lines))
    for extension in ("shp", "fgb", "gpkg", "parquet", "csv"):
        target = str(tmp_path / f"o.{extension}")
        convert(spark, str(tmp_path / "in.wkt"), target)
        assert sorted(G.to_wkt(g) for _, g in read(spark, target).features()) == sorted(lines), extension


def test_geoparquet_footer(spark, sample, tmp_path):
    import pyarrow.parquet as pq

    target = str(tmp_path / "o.parquet")
    convert(spark, sample, target)
    first = next(os.path.join(target, f) for f in os.listdir(target) if f.endswith(".parquet"))
    geo = json.loads(pq.read_schema(first).metadata[b"geo"])
    assert geo["primary_column"] == "geometry" and geo["columns"]["geometry"]["geometry_types"] == ["Point"]
    assert geo["columns"]["geometry"]["bbox"] == [-1, 2, 8.5, 47.4]


def test_geoparquet_keeps_definitions(spark, sample, tmp_path):
    definition = '{"type": "GeographicCRS",  "name":"odd", "id": {"authority": "EPSG", "code": 7844}}'
    target = str(tmp_path / "o.parquet")
    convert(spark, sample, target, crs=Crs.of_definition(definition))
    back = read(spark, target).crs
    assert back.authority_code() == "EPSG:7844" and json.loads(back.body()) == json.loads(definition)


def test_gpkg_rowids_of_zero_and_less(spark, sample, tmp_path):
    from terraloom.formats import GEOPACKAGE
    from terraloom.sources import binary, features

    target = str(tmp_path / "z.gpkg")
    convert(spark, sample, target)
    name = binary.gpkg_layers(target)[0][0]
    before = features.read_raw(spark, target, GEOPACKAGE).count()
    with sqlite3.connect(target) as db:
        key = next(r[1] for r in db.execute(f'PRAGMA table_info("{name}")') if r[5])
        for trigger in db.execute("SELECT name FROM sqlite_master WHERE type = 'trigger'").fetchall():
            db.execute(f'DROP TRIGGER "{trigger[0]}"')
        db.execute(f'UPDATE "{name}" SET "{key}" = "{key}" - 1000')
        db.execute(f'UPDATE "{name}" SET "{key}" = 0 WHERE "{key}" = (SELECT max("{key}") FROM "{name}")')
    found = [r._fid for r in features.read_raw(spark, target, GEOPACKAGE).collect()]
    assert len(found) == before and max(found) == 0 and min(found) < 0
    convert(spark, sample, target, layer="second")
    assert features.read_raw(spark, target, GEOPACKAGE, name).count() == before


def test_gpkg_layers_upsert_and_index(spark, sample, tmp_path):
    target = str(tmp_path / "o.gpkg")
    write(read(spark, sample), target, rtree=True, envelope=True)
    convert(spark, sample, target, layer="second")
    assert list(read_layers(spark, target)) == ["o", "second"]
    write(read(spark, sample), target)
    assert list(read_layers(spark, target)) == ["second", "o"]
    with sqlite3.connect(target) as db:
        assert db.execute("PRAGMA integrity_check").fetchone()[0] == "ok"
    with pytest.raises(ConversionError):
        read(spark, target)
    folder = tmp_path / "all"
    folder.mkdir()
    convert(spark, target, str(folder), to="geojson")
    assert sorted(os.listdir(folder)) == ["o.geojson", "second.geojson"]


def test_fgb_index(tmp_path):
    found = [([("i", i)], G.Geometry("Point", (float(i % 17), float(i % 13), None, None))) for i in range(40)]
    binary.write_fgb(found, str(tmp_path / "x.fgb"), Crs.of_code("EPSG", "3857"))
    back, crs = binary.read_fgb((tmp_path / "x.fgb").read_bytes())
    assert sorted(p[0][1] for p, _ in back) == list(range(40)) and crs.authority_code() == "EPSG:3857"
    boxes = [(i, i, i, i) for i in range(40)]
    assert len(binary.packed_tree(boxes, [1] * 40)) == binary.index_size(40, 16)


@pytest.mark.parametrize("n", [1, 16, 17, 300])
def test_fgb_index_is_walked(tmp_path, n):
    points = [(float(i * 7 % 101), float(i * 13 % 97)) for i in range(n)]
    binary.write_fgb([([("i", i)], G.Geometry("Point", (*p, None, None))) for i, p in enumerate(points)], str(tmp_path / "x.fgb"))
    data = (tmp_path / "x.fgb").read_bytes()
    head = binary.fgb_head(data)
    assert head.count == n and head.features - head.index == 40 * sum(binary.level_sizes(n, 16)) >= 80
    root, child = struct.unpack_from("<4d", data, head.index), struct.unpack_from("<Q", data, head.index + 32)[0]
    assert child == 1 and root == (min(x for x, _ in points), min(y for _, y in points), max(x for x, _ in points), max(y for _, y in points))
    for box in ((0.0, 0.0, 50.0, 50.0), (3.0, 90.0, 4.0, 97.0), (-9.0, -9.0, -1.0, -1.0), (-1.0, -1.0, 200.0, 200.0)):
        found = sorted(dict(binary.fgb_feature(data, head, at)[0])["i"] for at in binary.search_fgb(data, box))
        assert found == [i for i, (x, y) in enumerate(points) if box[0] <= x <= box[2] and box[1] <= y <= box[3]]
    assert sorted(dict(p)["i"] for p, _ in binary.read_fgb(data)[0]) == list(range(n))


def test_wide_integers_and_empty_collections(spark, tmp_path):
    (tmp_path / "w.geojson").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","geometry":null,"properties":{"a":12345678901234567890,"b":1}},{"type":"Feature","geometry":null,"properties":{"a":5,"b":9223372036854775807}}]}')
    found = read(spark, str(tmp_path / "w.geojson")).df
    assert dict(found.dtypes)["a"] == "double" and [tuple(r) for r in found.orderBy("_fid").select("a", "b").collect()] == [(12345678901234567890.0, 1), (5.0, 9223372036854775807)]
    (tmp_path / "e.geojson").write_text('{"type":"FeatureCollection","features":[]}')
    convert(spark, str(tmp_path / "e.geojson"), str(tmp_path / "e.parquet"))
    assert read(spark, str(tmp_path / "e.parquet")).df.count() == 0
    (tmp_path / "none.parquet").mkdir()
    with pytest.raises(textual.FormatError):
        read(spark, str(tmp_path / "none.parquet"))


def test_gpkg_ranges_and_unregistered_layers(spark, sample, tmp_path):
    target = str(tmp_path / "r.gpkg")
    convert(spark, sample, target)
    name = binary.gpkg_layers(target)[0][0]
    with sqlite3.connect(target) as db:
        db.execute(f'UPDATE "{name}" SET fid = 1000000000000 WHERE fid = 3')
        db.execute("DELETE FROM gpkg_geometry_columns")
    assert binary.gpkg_ranges(target, name, 2) == [(0, 2), (2, 10**12)]
    assert binary.gpkg_layers(target)[0][1] == "geom" and read(spark, target).df.count() == 3


def test_kml_details():
    text = b'<kml xmlns="x"><Document><Folder><Placemark><name>A&amp;B</name><ExtendedData><SchemaData><SimpleData name="n">1</SimpleData></SchemaData></ExtendedData><MultiGeometry><Point><coordinates>1,2,3</coordinates></Point><Point><coordinates>4,5,6</coordinates></Point></MultiGeometry></Placemark></Folder></Document></kml>'
    (found,) = textual.read_kml(text)
    assert found[0] == [("name", "A&B"), ("n", "1")] and G.to_wkt(found[1]) == "MULTIPOINT Z (1 2 3, 4 5 6)"
    with pytest.raises(textual.FormatError):
        list(textual.read_kml(b"<!DOCTYPE a><kml/>"))


def test_kml_zero_has_no_sign():
    text = textual.kml_placemark(([("a", -0.0), ("b", 0.0), ("c", -0.5), ("d", "-0")], None))
    assert [v for _, v in next(textual.read_kml(f"<kml>{text}</kml>".encode()))[0]] == ["0", "0", "-0.5", "-0"]


def test_shapefile_rules():
    mixed = [([], G.from_wkt("POINT (1 2)")), ([], G.from_wkt("LINESTRING (1 2, 3 4)"))]
    with pytest.raises(textual.FormatError):
        binary.write_shapefile(mixed)
    made = binary.write_shapefile([([("a_very_long_name", "x")], G.from_wkt("POINT M (1 2 5)")), ([("a_very_long_name", None)], None)])
    back, _ = binary.read_shapefile(made.shp, made.dbf)
    assert made.warnings and back[0] == ([("a_very_lon", "x")], G.from_wkt("POINT M (1 2 5)")) and back[1][1] is None
    with pytest.raises(textual.FormatError):
        binary.write_dbf([([("long_name_1a", 1), ("long_name_1b", 2)], None)])


def test_csv_rules():
    data = b'name,Geom,n\n"a,""b""",POINT (1 2),5\n,,\nshort\n'
    found = list(textual.read_csv(data))
    assert found == [([("name", 'a,"b"'), ("n", 5)], G.from_wkt("POINT (1 2)")), ([("name", "short"), ("n", None)], None)]
    out = io.BytesIO()
    textual.write_csv(found, out)
    assert out.getvalue().decode().splitlines() == ["name,n,geometry", '"a,""b""",5,POINT (1 2)', "short,,"]


def test_command_line(spark, sample, tmp_path, capsys):
    assert cli.run([sample, "--print-crs-code"]) == 0 and capsys.readouterr().out == "OGC:CRS84\n"
    assert cli.run([sample, str(tmp_path / "x.geojson")]) == 1
    assert "both GeoJSON" in capsys.readouterr().err
    assert cli.run([sample, str(tmp_path / "p.csv"), "--progress"]) == 0
    said = capsys.readouterr().err
    assert "\nread 3 features\n" in said and "\nwrote 3 features in 1 layer to" in said
    (tmp_path / "bad.gpkg").write_text("no database at all, but long enough to be looked at")
    assert cli.run([str(tmp_path / "bad.gpkg"), str(tmp_path / "x.csv")]) == 1 and "error: " in capsys.readouterr().err
    assert cli.run([sample, str(tmp_path / "x.wkt")]) == 0
    assert "warning: WKT can't hold properties" in capsys.readouterr().err
    with pytest.raises(SystemExit):
        cli.run([sample, "--escape"])


def test_streamed_lines(spark, tmp_path):
    from terraloom.streaming.lines import counts_by_type, wkt_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.wkt").write_text("POINT (1 2)\n\nLINESTRING (0 0, 1 1)\nPOINT (3 4)\n")
    q = counts_by_type(wkt_stream(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("kinds").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert {r["type"]: r.n for r in spark.table("kinds").collect()} == {"Point": 2, "LineString": 1}


def test_map_positions_and_hilbert(spark, sample):
    frame = read(spark, sample)
    moved = frame.map_positions(lambda p: p + 1, None)
    assert sorted(G.to_wkt(g) for _, g in moved.features())[0] == "POINT (0 3)"
    assert len(list(frame.sort_hilbert().features())) == 3
