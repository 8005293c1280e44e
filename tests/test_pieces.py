"""Files of one format are written and read in pieces: the driver gets no features, and a large file is read by many tasks."""

import json
import os
import xml.etree.ElementTree as ET
import zipfile

import numpy as np
import pytest
from pyspark.sql.classic.dataframe import DataFrame

from terraloom.convert import convert, read, read_layers, write
from terraloom.formats import format_of
from terraloom.functions import geometry as G
from terraloom.plans import catalogue, formats
from terraloom.sources import binary, features, parts, textual

MOST = 200


@pytest.fixture
def quiet_driver(monkeypatch):
    """Neither rows by rows nor many at once come to the driver."""
    frame = DataFrame
    collect = frame.collect

    def few(self):
        rows = collect(self)
        assert len(rows) <= MOST, f"{len(rows)} rows were sent to the driver"
        return rows

    def none(self, *_, **__):
        raise AssertionError("rows were sent to the driver")

    monkeypatch.setattr(frame, "collect", few)
    monkeypatch.setattr(frame, "toLocalIterator", none)


def sample(n=600, same=False):
    shapes = [None, "POINT ({0} 2)", "LINESTRING Z ({0} 1 2, 3 4 5)", "POLYGON ((0 0, {0} 0, 1 1, 0 0))"]
    texts = ['a"b\\', '{[\\\\"', "x]}<&>\n", "</Placemark>", ""]
    return [([("name", texts[i % 5] + str(i)), ("n", i), ("x", None if i % 4 else i + 0.5)], (g := "POINT ({0} 2)" if same else shapes[i % 4]) and G.from_wkt(g.format(i + 1))) for i in range(n)]


def table(spark, found, slices=5):
    rows = [(i, *(v for _, v in p), bytearray(G.to_wkb(g)) if g else None) for i, (p, g) in enumerate(found)]
    return formats.FeatureFrame(spark.createDataFrame(rows, "_fid bigint, name string, n bigint, x double, geometry binary").repartitionByRange(slices, "_fid").sortWithinPartitions("_fid"), None)


@pytest.mark.parametrize("extension", ["geojson", "csv", "wkt", "kml", "kmz", "fgb", "gpkg", "shp", "parquet"])
def test_writers_leave_features_to_executors(spark, tmp_path, quiet_driver, extension):
    found = sample(same=True)
    write(table(spark, found), str(tmp_path / f"o.{extension}"), **({"rtree": True} if extension == "gpkg" else {}))
    df = read(spark, str(tmp_path / f"o.{extension}")).df
    assert df.count() == 600 and not [x for x in os.listdir(tmp_path) if "parts" in x or x.endswith(".part")]
    if extension != "wkt":
        got = df.selectExpr("count(distinct name) a", "count(distinct cast(n as bigint)) b", "count(x) c", "sum(cast(n as bigint)) d").first()
        assert (got.a, got.b, got.c, got.d) == (600, 600, 150, sum(range(600)))


def test_layers_that_stay_are_moved_by_executors(spark, tmp_path, quiet_driver):
    path = str(tmp_path / "o.gpkg")
    found = sample()
    write(table(spark, found), path, rtree=True)
    write(formats.FeatureFrame(table(spark, found).df, None, "second"), path, envelope=True)
    layers = read_layers(spark, path)
    assert list(layers) == ["o", "second"]
    for x in layers.values():
        assert x.df.dtypes == [("_fid", "bigint"), ("name", "string"), ("n", "bigint"), ("x", "double"), ("geometry", "binary")]
        got = x.df.selectExpr("count(geometry) a", "sum(n) b", "min(_fid) c", "max(_fid) d", "sum(x) e").first()
        assert tuple(got) == (450, sum(range(600)), 1, 600, sum(i + 0.5 for i in range(0, 600, 4)))


@pytest.mark.parametrize("name", ["polygons_shp_rings", "deleted_records", "dbf_widths", "nested_properties", "flatgeobuf_index_search", "package_upsert"])
def test_queries_leave_rows_to_executors(spark, sf, quiet_driver, name):
    catalogue.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()


@pytest.mark.parametrize("extension", ["geojson", "kml", "kmz", "fgb", "shp"])
@pytest.mark.parametrize("block", [4 << 20, 300])
def test_pieces_are_the_whole(tmp_path, monkeypatch, extension, block):
    path, f, found = str(tmp_path / f"x.{extension}"), format_of(extension), sample(same=extension == "shp")
    if extension == "fgb":
        binary.write_fgb(found, path)
    elif extension == "shp":
        made = binary.write_shapefile(found)
        dbf = bytearray(made.dbf)
        head, width = int.from_bytes(dbf[8:10], "little"), int.from_bytes(dbf[10:12], "little")
        dbf[head : head + 600 * width : 7 * width] = b"*" * 86  # deleted records
        (tmp_path / "x.shp").write_bytes(made.shp)
        (tmp_path / "x.dbf").write_bytes(dbf)
    else:
        with open(path, "wb") as out:
            {"geojson": textual.write_geojson, "kml": textual.write_kml, "kmz": textual.write_kmz}[extension](found, out)
    if extension == "geojson":  # other members, of the same name at other depths or in text
        text = open(path).read().split('"features":[', 1)[1][:-1]
        open(path, "w").write('{"a":[{"features":[1]},"\\"features\\":["],"b":"x\\\\", "features" : [\n ' + text + ', "z": {"features":[{}]}}')
    if extension == "kmz":
        with zipfile.ZipFile(path, "a") as z:
            z.writestr("more/other.KML", z.read("doc.kml"))
    monkeypatch.setattr(textual, "BLOCK", block)
    monkeypatch.setattr(textual, "LONGEST_MARK", 200)
    monkeypatch.setattr(parts, "BLOCK", block)
    whole = list(features.features_of(path, f)[0])
    for size in (1, 3000):
        monkeypatch.setattr(features, "PIECE", size)
        cut, got = features.pieces(path, f, 0), []
        for x in cut:
            assert x.before == len(got) and not x.whole
            got += features.piece_features(x, f)
        assert got == whole and len(cut) > 5


def test_pieces_of_kml_with_folders_and_prefixes(tmp_path, monkeypatch):
    marks = "".join(f'<k:Folder><k:name>f{i}</k:name><k:Placemark id="a>b"><k:name><![CDATA[</k:Placemark> {i}]]></k:name><gx:t/><!-- </k:Placemark> --><k:Point><k:coordinates>{i},2</k:coordinates></k:Point></k:Placemark><k:Placemark/></k:Folder>' for i in range(50))
    path = tmp_path / "z.kml"
    path.write_text(f'<?xml version="1.0" encoding="UTF-8"?><!-- <Placemark> --><k:kml xmlns:k="http://x" xmlns:gx="y"><k:Document>{marks}</k:Document></k:kml>')
    whole = list(features.features_of(str(path), format_of("kml"))[0])
    monkeypatch.setattr(textual, "BLOCK", 300)
    monkeypatch.setattr(textual, "LONGEST_MARK", 200)
    monkeypatch.setattr(features, "PIECE", 500)
    cut = features.pieces(str(path), format_of("kml"), 0)
    assert len(cut) > 5 and [f for x in cut for f in features.piece_features(x, format_of("kml"))] == whole and len(whole) == 100
    path.write_text("<kml>" + marks.replace("k:", "") + "</kml>")  # a prefix without a meaning
    with pytest.raises(ET.ParseError):
        [f for x in features.pieces(str(path), format_of("kml"), 0) for f in features.piece_features(x, format_of("kml"))]
    path.write_text("<kml>" + marks.replace("k:", "").replace("<gx:t/>", "") + "</Folder></kml>")  # an end without its beginning
    assert textual.kml_pieces(str(path), 500) is None


CSVS = {
    "lf": 'name,n,geometry\n"a,""b""\r\nx",5,POINT (1 2)\n,,\n\nshort\n"",1,POINT (1 2)\nlong,1,POINT (3 4),extra\n  sp ,2,\n"é\t\nz",+3,"LINESTRING (0 0, 1 1)"\n' + "q,7,POINT (5 6)\n" * 50,
    "crlf": 'name,n,geometry\r\n"a\r\nb",5,POINT (1 2)\r\n\r\n' + "q,7,POINT (5 6)\r\n" * 50 + '"z""",8,POINT (1 1)',
    "stray": 'name,n,geometry\na"b,5,POINT (1 2)\n' + "q,7,POINT (5 6)\n" * 50,
}


@pytest.mark.parametrize("name", CSVS)
def test_pieces_of_csv(spark, tmp_path, monkeypatch, name):
    path = str(tmp_path / "x.csv")
    with open(path, "w", newline="") as out:
        out.write(CSVS[name])
    whole = features.read_csv(spark, path).select("properties", "geometry").collect()
    monkeypatch.setattr(features, "PIECE", 100)
    found = features.read_csv(spark, path)
    assert found.select("properties", "geometry").collect() == whole and len(whole) > 50
    assert found.rdd.getNumPartitions() > 5 or name == "stray"


def test_large_files_have_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(features, "PIECE", 5000)
    for extension in ("geojson", "fgb", "kml", "shp", "csv"):
        write(table(spark, sample(same=True)), str(tmp_path / f"o.{extension}"))
        df = read(spark, str(tmp_path / f"o.{extension}")).df
        assert df.rdd.getNumPartitions() > 3 and df.selectExpr("sum(cast(n as bigint))").first()[0] == sum(range(600)), extension
    convert(spark, str(tmp_path / "o.geojson"), str(tmp_path / "p.fgb"))
    assert read(spark, str(tmp_path / "p.fgb")).df.selectExpr("sum(n)").first()[0] == sum(range(600))


@pytest.mark.parametrize("n", [1, 16, 17, 300, 5000])
def test_tree_of_pieces(tmp_path, monkeypatch, n):
    monkeypatch.setattr(binary, "NODES_AT_ONCE", 32)
    rng, kinds = np.random.default_rng(1), [("i", "int")]
    rows = [binary.fgb_row(([("i", i)], G.Geometry("Point", (float(x), float(y), None, None))), kinds) for i, (x, y) in enumerate(rng.integers(0, 100, (n, 2)))]
    binary.write_fgb_rows(rows, kinds, str(tmp_path / "whole.fgb"))
    extent = [f(r[1][k] for r in rows) for k, f in ((0, min), (1, min), (2, max), (3, max))]
    order = np.argsort(binary.centre_values(np.array([r[1] for r in rows]), extent), kind="stable").tolist()
    made = []
    for k in range(0, n, 700):
        batch = [rows[i] for i in order[k : k + 700]]
        import pyarrow as pa

        b = pa.RecordBatch.from_arrays([pa.array([r[0] for r in batch]), *(pa.array([r[1][k] for r in batch]) for k in range(4))], names=list("abcde"))
        made.append((str(tmp_path / f"piece{k}"), binary.fgb_piece([b], str(tmp_path / f"piece{k}"))))
    with open(tmp_path / "made.fgb", "w+b") as out:
        binary.join_fgb(out, binary.fgb_header(kinds, {1}, False, False, n, extent, None), made, True)
    assert (tmp_path / "made.fgb").read_bytes() == (tmp_path / "whole.fgb").read_bytes()


@pytest.mark.parametrize("wkt", ["LINESTRING ZM (1234 234 1 17, 9346 437 6 17)", "POINT (1.25 -3.5)", "POINT M (1 2 3)", "LINESTRING (0 0, 1e-7 2)", "POINT (-0 1)", "LINESTRING Z (0 0 -0, 1 1 1)", "POLYGON Z ((0 0 1, 0 4 1, 4 4 1, 0 0 1), (1 1 2, 2 1 2, 2 2 2, 1 1 2))", "POLYGON ((-1.5 0, 1 0, 1 1e5, -1.5 0))", "POLYGON M ((1 2 3))", "MULTIPOINT (1 2, 3 4)", "POINT (1 2 3)", "point(1 2)"])
def test_short_ways_give_the_same(wkt):
    wkb = G.to_wkb(G.from_wkt(wkt))
    assert G.wkb_of_wkt(wkt) == wkb and G.wkt_of_wkb(wkb) == G.to_wkt(G.from_wkb(wkb))
    kinds = [("key", "int"), ("s", "string")]
    assert binary.fgb_row_of_wkb({"key": 5, "s": "é"}, wkb, kinds) == binary.fgb_row(([("key", 5), ("s", "é")], G.from_wkb(wkb)), kinds)
    for bad in ("POINT (1 2", "POINT ZM (1 2)", "LINESTRING (1 2, 3)", "POINT (1 2, 3 4)", "POINT (1_0 2)", "POLYGON ((1 2, 3 4)", "POLYGON (1 2, 3 4)", "POLYGON ((1 2), 3 4)", "POLYGON ((1 2), (3))"):
        with pytest.raises(G.GeometryError):
            G.wkb_of_wkt(bad)


def test_json_of_other_kinds_is_read_whole(tmp_path):
    for text in ('{"type":"Point","coordinates":[1,2]}', '[{"features":[{}]}]', '{"features":null,"features":[{"type":"Feature"},{"type":"Feature"}]}', json.dumps({"features": {"a": [{}, {}]}})):
        (tmp_path / "x.geojson").write_text(text)
        assert textual.geojson_pieces(str(tmp_path / "x.geojson"), 1) is None
