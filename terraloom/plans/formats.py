"""Queries that write the driver's tables as files of each format and read them back, with the SQL that must give the same rows.

The files are small and of this machine (formats of a single file are local); they go when the process ends.
"""

from __future__ import annotations

import atexit
import mmap
import os
import shutil
import sqlite3
import struct
import tempfile
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import convert
from ..crs.model import WGS84, Crs, distinct_codes
from ..formats import GEOPACKAGE
from ..frame import FeatureFrame
from ..functions import columns as C
from ..functions import geometry as G
from ..operators import core as O
from ..sources import binary, features, geoparquet, parts
from .catalogue import ORACLES, QUERIES, customer_points, query, read, square

_folder: list[str] = []


def place(name: str) -> str:
    """A path of its own for a file, where executors see it too."""
    if not _folder or not os.path.isdir(_folder[0]):
        where = parts.shared_place(SparkSession.getActiveSession(), os.path.join(tempfile.gettempdir(), name))
        os.makedirs(where, exist_ok=True)
        _folder[:] = [tempfile.mkdtemp(prefix="terraloom-files-", dir=where)]
        atexit.register(shutil.rmtree, _folder[0], ignore_errors=True)
    return os.path.join(tempfile.mkdtemp(dir=_folder[0]), name)


def written(frame: FeatureFrame, name: str, **kw) -> str:
    path = place(name)
    convert.write(frame, path, **kw)
    return path


def there_and_back(spark: SparkSession, frame: FeatureFrame, name: str) -> DataFrame:
    return convert.read(spark, written(frame, name)).df


# ---- sources and sinks

#: Text that every text format has to quote or escape.
AWKWARD = ' "q", a\\b <&> \n\té'
_AWKWARD = "' \"q\", a\\b <&> ' || chr(10) || chr(9) || 'é'"
_POINTS = "'POINT (' || c_custkey || '.25 ' || (c_nationkey - 30) || '.5)'"


def customers(spark: SparkSession, sf_dir: str, awkward: bool = True) -> FeatureFrame:
    """Customers as points with properties of all four types, some of them null."""
    c = read(spark, sf_dir, "customer")
    wkt = F.concat(F.lit("POINT ("), F.col("c_custkey").cast("string"), F.lit(".25 "), (F.col("c_nationkey") - 30).cast("string"), F.lit(".5)"))
    name = F.concat("c_name", F.when(F.col("c_custkey") % 3 == 0, AWKWARD if awkward else " é").otherwise(""))
    balance = F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal"))
    return FeatureFrame(c.select(F.col("c_custkey").alias(O.FID), F.col("c_custkey").alias("key"), name.alias("name"), balance.alias("balance"), (F.col("c_nationkey") > 9).alias("far"), C.wkb_of(wkt).alias(O.GEOMETRY)), WGS84)


def back(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*names, C.wkt_of(F.col(O.GEOMETRY)).alias("wkt"))


def _customers_sql(name: str = _AWKWARD, key: str = "c_custkey", balance: str = "CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END", far: str = "c_nationkey > 9") -> str:
    return f"SELECT {key} AS key, c_name || CASE WHEN c_custkey % 3 = 0 THEN {name} ELSE '' END AS name, {balance} AS balance, {far} AS far, {_POINTS} AS wkt FROM customer"


NAMES = ("key", "name", "balance", "far")


@query(_customers_sql())
def geojson_file(spark, sf_dir):
    """Names with every character that JSON escapes, shortest texts of doubles, nulls."""
    return back(there_and_back(spark, customers(spark, sf_dir), "c.geojson"), *NAMES)


@query(_customers_sql())
def geoparquet_file(spark, sf_dir):
    """S3, S4."""
    return back(there_and_back(spark, customers(spark, sf_dir), "c.parquet"), *NAMES)


@query(_customers_sql())
def flatgeobuf_file(spark, sf_dir):
    """S5, S6, C7, G12."""
    return back(there_and_back(spark, customers(spark, sf_dir), "c.fgb"), *NAMES)


@query(_customers_sql())
def csv_file(spark, sf_dir):
    """Fields with commas, quotes and line ends."""
    return back(there_and_back(spark, customers(spark, sf_dir), "c.csv"), *NAMES)


@query(f"SELECT {_POINTS} AS wkt FROM customer")
def wkt_lines_file(spark, sf_dir):
    """Blank lines between the others don't count."""
    path = written(customers(spark, sf_dir), "c.wkt")
    with open(path, encoding="utf-8") as file:
        lines = file.read().splitlines()
    with open(path, "w", encoding="utf-8") as file:
        file.write("\n \n".join(lines) + "\n\n")
    return back(convert.read(spark, path).df)


@query(_customers_sql(far="CAST(CASE WHEN c_nationkey > 9 THEN 1 ELSE 0 END AS BIGINT)"))
def geopackage_file(spark, sf_dir):
    """SQLite has no truth values, they come back as numbers."""
    return back(there_and_back(spark, customers(spark, sf_dir), "c.gpkg"), *NAMES)


@query(_customers_sql(name="' é'"))
def shapefile_file(spark, sf_dir):
    """S13, S14, J1, N8, T9, G13."""
    return back(there_and_back(spark, customers(spark, sf_dir, awkward=False), "c.shp"), *NAMES)


_KML = {"key": "CAST(c_custkey AS VARCHAR)", "balance": "CASE WHEN c_custkey % 7 <> 0 THEN CASE WHEN c_acctbal = trunc(c_acctbal) THEN CAST(CAST(c_acctbal AS BIGINT) AS VARCHAR) ELSE CAST(c_acctbal AS VARCHAR) END END", "far": "CASE WHEN c_nationkey > 9 THEN 'true' ELSE 'false' END"}


@query(_customers_sql(**_KML))
def kml_file(spark, sf_dir):
    """Properties are text."""
    return back(there_and_back(spark, customers(spark, sf_dir), "c.kml"), *NAMES)


@query(f"{_customers_sql(**_KML)} UNION ALL {_customers_sql(**_KML)}")
def kmz_file(spark, sf_dir):
    """Two documents and an entry of another kind; the documents' features follow each other."""
    path = written(customers(spark, sf_dir), "c.kmz")
    with zipfile.ZipFile(path, "a") as z:
        z.writestr("notes.txt", "no features")
        with zipfile.ZipFile(path) as own, own.open("doc.kml") as doc, z.open("more/other.KML", "w", force_zip64=True) as copy:
            shutil.copyfileobj(doc, copy, parts.BLOCK)
    return back(convert.read(spark, path).df, *NAMES)


_CELL = "'POLYGON ((' || p_partkey || ' 0, ' || (p_partkey + p_size) || ' 0, ' || (p_partkey + p_size) || ' ' || p_size || ', ' || p_partkey || ' ' || p_size || ', ' || p_partkey || ' 0))'"


def cells(spark: SparkSession, sf_dir: str) -> FeatureFrame:
    p = read(spark, sf_dir, "part")
    return FeatureFrame(p.select(F.col("p_partkey").alias(O.FID), F.col("p_partkey").alias("key"), C.wkb_of(square(F.col("p_partkey"), F.col("p_size"))).alias(O.GEOMETRY)), WGS84)


def _polygons(name: str):
    def run(spark, sf_dir):
        return back(there_and_back(spark, cells(spark, sf_dir), f"p.{name}"), "key")

    run.__name__ = f"polygons_{name}"
    return query(f"SELECT p_partkey AS key, {_CELL} AS wkt FROM part")(run)


for _name in ("fgb", "gpkg", "csv", "geojson", "parquet"):
    _polygons(_name)


_CLOCKWISE = "'POLYGON ((' || p_partkey || ' 0, ' || p_partkey || ' ' || p_size || ', ' || (p_partkey + p_size) || ' ' || p_size || ', ' || (p_partkey + p_size) || ' 0, ' || p_partkey || ' 0))'"


@query(f"SELECT p_partkey AS key, {_CLOCKWISE} AS wkt FROM part")
def polygons_shp_rings(spark, sf_dir):
    """Shells of the file run clockwise, whatever way they came (raw rings of the records)."""
    path = written(cells(spark, sf_dir), "p.shp")
    dbf = f"{path[:-3]}dbf"

    def rings(piece):
        shp, records = binary.shp_piece(path, dbf, *piece[:4])
        rows, at = [], 100
        for p in binary.read_dbf(records):
            n = struct.unpack_from(">i", shp, at + 4)[0] * 2
            count, points = struct.unpack_from("<2i", shp, at + 8 + 36)
            xy = struct.unpack_from(f"<{2 * points}d", shp, at + 8 + 44 + 4 * count)
            rows.append((dict(p)["key"], G.to_wkt(G.Geometry("Polygon", [[(x, y, None, None) for x, y in zip(xy[::2], xy[1::2], strict=True)]]))))
            at += 8 + n
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([w for _, w in rows], pa.string())], names=["key", "wkt"])

    return parts.over(spark, binary.shp_pieces(path, dbf, features.PIECE), rings, "key bigint, wkt string")


_LINES = "SELECT l_orderkey AS key, 'LINESTRING ZM (' || string_agg(l_partkey || ' ' || l_suppkey || ' ' || l_linenumber || ' ' || CAST(l_quantity AS BIGINT), ', ' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) || ')' AS wkt FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1"


def lines(spark: SparkSession, sf_dir: str) -> FeatureFrame:
    order = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")))
    at = lambda p: F.concat_ws(" ", p["l_partkey"].cast("string"), p["l_suppkey"].cast("string"), p["l_linenumber"].cast("string"), p["l_quantity"].cast("bigint").cast("string"))
    grouped = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(order.alias("p")).where(F.size("p") > 1)
    wkt = F.concat(F.lit("LINESTRING ZM ("), F.array_join(F.transform("p", at), ", "), F.lit(")"))
    return FeatureFrame(grouped.select(F.col("l_orderkey").alias(O.FID), F.col("l_orderkey").alias("key"), C.wkb_of(wkt).alias(O.GEOMETRY)), None)


def _lines_back(name: str):
    def run(spark, sf_dir):
        return back(there_and_back(spark, lines(spark, sf_dir), f"l.{name}"), "key")

    run.__name__ = f"lines_zm_{name}"
    return query(_LINES)(run)


for _name in ("fgb", "gpkg", "csv", "parquet", "shp"):
    _lines_back(_name)


# ---- layers and their systems

_SYSTEM = "CASE r_regionkey WHEN 0 THEN 'OGC:CRS84' WHEN 1 THEN 'EPSG:3857' WHEN 2 THEN 'EPSG:32633' WHEN 3 THEN 'EPSG:3857' END"


def region_layers(spark: SparkSession, sf_dir: str) -> dict[str, FeatureFrame]:
    systems = [WGS84, Crs.of_code("EPSG", "3857"), Crs.of_code("EPSG", "32633"), Crs.of_code("EPSG", "3857"), None]
    points = customer_points(spark, sf_dir)
    names = sorted((r.r_regionkey, r.r_name) for r in read(spark, sf_dir, "region").collect())
    return {f'{name} "{k}"': FeatureFrame(points.where(F.col("c_nationkey") % 5 == k), systems[k]) for k, name in names}


def region_package(spark: SparkSession, sf_dir: str, **kw) -> str:
    path = place("r.gpkg")
    convert.write_layers(region_layers(spark, sf_dir), path, **kw)
    return path


@query(f"SELECT r_name || ' \"' || r_regionkey || '\"' AS layer, r_regionkey AS place, {_SYSTEM} AS code FROM region")
def layer_systems(spark, sf_dir):
    """Layers in their order, with the system that each one's id leads to; names need quotes."""
    found = binary.gpkg_layers(region_package(spark, sf_dir))
    return spark.createDataFrame([(name, i, crs and crs.authority_code()) for i, (name, _, _, crs) in enumerate(found)], "layer string, place int, code string")


@query(f"SELECT {_SYSTEM} AS code, min(r_regionkey) AS place FROM region WHERE r_regionkey < 4 GROUP BY 1")
def distinct_layer_codes(spark, sf_dir):
    """Codes of all layers, each once, in the order they are first seen."""
    found = features.crs_of(region_package(spark, sf_dir), GEOPACKAGE)
    codes = distinct_codes(list(found.values()))
    at = [c and c.authority_code() for c in found.values()]
    return spark.createDataFrame([(c, at.index(c)) for c in codes], "code string, place int")


@query("SELECT c_custkey AS key FROM customer WHERE c_nationkey % 5 = 2")
def one_layer_of_many(spark, sf_dir):
    """a layer read by its name."""
    path = region_package(spark, sf_dir)
    name = next(n for n in features.crs_of(path, GEOPACKAGE) if n.endswith('"2"'))
    return convert.read(spark, path, layer=name).df.select(C.wkt_of(F.col(O.GEOMETRY)).alias("w")).select(F.regexp_extract("w", r"\((\d+) ", 1).cast("bigint").alias("key"))


@query("SELECT c_custkey AS key FROM customer WHERE c_nationkey % 5 <> 1 UNION ALL SELECT s_suppkey AS key FROM supplier")
def package_upsert(spark, sf_dir):
    """A layer of the same name is replaced, others stay; all layers are read."""
    path = region_package(spark, sf_dir)
    name = next(n for n in features.crs_of(path, GEOPACKAGE) if n.endswith('"1"'))
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias(O.FID), C.wkb_of(C.point_wkt(F.col("s_suppkey"), F.col("s_nationkey"))).alias(O.GEOMETRY))
    convert.write_layers({name: FeatureFrame(s, None)}, path)
    found = None
    for x in convert.read_layers(spark, path).values():
        own = x.df.select(C.wkt_of(F.col(O.GEOMETRY)).alias("w")).select(F.regexp_extract("w", r"\((\d+) ", 1).cast("bigint").alias("key"))
        found = own if found is None else found.unionByName(own)
    return found


@query("SELECT r_regionkey AS place, CAST(min(c_custkey) AS DOUBLE) AS minx, CAST(max(c_custkey) AS DOUBLE) AS maxx, CAST(min(c_nationkey) AS DOUBLE) AS miny, CAST(max(c_nationkey) AS DOUBLE) AS maxy, 'POINT' AS type FROM customer JOIN region ON c_nationkey % 5 = r_regionkey GROUP BY r_regionkey")
def layer_bounds(spark, sf_dir):
    """The extent and the one geometry type that a GeoPackage has of each layer."""
    with sqlite3.connect(region_package(spark, sf_dir)) as db:
        rows = db.execute("SELECT row_number() OVER (ORDER BY c.rowid) - 1, min_x, max_x, min_y, max_y, geometry_type_name FROM gpkg_contents c JOIN gpkg_geometry_columns g ON g.table_name = c.table_name").fetchall()
    return spark.createDataFrame(rows, "place int, minx double, maxx double, miny double, maxy double, type string")


@query("SELECT c_custkey AS key FROM customer WHERE c_custkey BETWEEN 100 AND 900 AND c_nationkey BETWEEN 3 AND 12 AND c_nationkey % 5 = 0")
def package_index_search(spark, sf_dir):
    """Rows that the R*Tree of a layer finds in a box."""
    with sqlite3.connect(region_package(spark, sf_dir, rtree=True)) as db:
        table = next(r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE name LIKE 'rtree_%\"0\"_geom'"))
        layer = table.removeprefix("rtree_").removesuffix("_geom")
        quoted = lambda n: n.replace('"', '""')
        rows = db.execute(f'SELECT c.geom FROM "{quoted(table)}" r JOIN "{quoted(layer)}" c ON c.fid = r.id WHERE r.maxx >= 100 AND r.minx <= 900 AND r.maxy >= 3 AND r.miny <= 12').fetchall()
    return spark.createDataFrame([(int(binary.from_gpb(r[0]).coordinates[0]),) for r in rows], "key bigint")


# ---- FlatGeobuf's index


@query("SELECT c_custkey AS key, c_name AS name FROM customer WHERE c_custkey + 0.25 BETWEEN 100 AND 900 AND c_nationkey - 30.5 BETWEEN -26 AND -15")
def flatgeobuf_index_search(spark, sf_dir):
    """Features that a walk of the packed tree finds in a box, read at the byte offsets of its leaves."""
    frame = customers(spark, sf_dir, awkward=False)
    path = written(FeatureFrame(frame.df.withColumn("name", F.regexp_replace("name", " é$", "")), frame.crs), "c.fgb")
    with open(path, "rb") as file, mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ) as data:  # of which only nodes and features that are met are read
        head = binary.fgb_head(data)
        found = [dict(binary.fgb_feature(data, head, at)[0]) for at in binary.search_fgb(data, (100.0, -26.0, 900.0, -15.0))]
    return spark.createDataFrame([(p["key"], p["name"]) for p in found], "key bigint, name string")


@query("WITH RECURSIVE l AS (SELECT 0 AS level, count(*) AS n FROM customer UNION ALL SELECT level + 1, (n + 15) // 16 FROM l WHERE n > 1) SELECT level, CAST(n AS BIGINT) AS nodes FROM l WHERE level > 0")
def packed_tree_levels(spark, sf_dir):
    """Nodes of each level above the leaves, of boxes numbered in Hilbert order."""
    numbered = O.running_number(O.with_hilbert(customer_points(spark, sf_dir)), ["_hilbert", O.FID])
    box = C.bbox_of(F.col(O.GEOMETRY))
    boxes = numbered.select("rn", box.alias("b")).select("rn", "b.minx", "b.miny", "b.maxx", "b.maxy")
    levels = O.index_levels(boxes)
    found = levels[0].agg(F.lit(1).alias("level"), F.count("*").alias("nodes"))
    for i, x in enumerate(levels[1:], 2):
        found = found.unionByName(x.agg(F.lit(i).alias("level"), F.count("*").alias("nodes")))
    return found


# ---- rows, columns, properties


@query("SELECT c_custkey AS key, c_name AS name FROM customer WHERE c_custkey % 5 <> 0")
def deleted_records(spark, sf_dir):
    """records of a .dbf that are marked deleted go, with their shapes."""
    frame = customers(spark, sf_dir, awkward=False)
    path = written(FeatureFrame(frame.df.withColumn("name", F.regexp_replace("name", " é$", "")), frame.crs), "c.shp")
    dbf = path[:-3] + "dbf"
    with open(dbf, "r+b") as file:
        n, head, width = struct.unpack("<IHH", file.read(12)[4:])
        file.seek(0)
        top = bytearray(file.read(head))
        for first in range(0, n, 10_000):  # marked where they stand, some records at a time
            count = min(10_000, n - first)
            struct.pack_into("<I", top, 4, count)
            file.seek(head + first * width)
            records = bytearray(file.read(count * width))
            for i, p in enumerate(binary.read_dbf(bytes(top + records))):
                if dict(p)["key"] % 5 == 0:
                    records[i * width] = 0x2A
            file.seek(head + first * width)
            file.write(records)
    return convert.read(spark, path).df.select("key", "name")


@query("SELECT 'key' AS field, CAST(max(strlen(CAST(c_custkey AS VARCHAR))) AS BIGINT) AS needed FROM customer UNION ALL SELECT 'name', max(strlen(c_name || CASE WHEN c_custkey % 3 = 0 THEN ' é' ELSE '' END)) FROM customer")
def dbf_widths(spark, sf_dir):
    """A text field of a .dbf is as wide as its longest value in bytes; a number's width holds its longest text."""
    path = written(customers(spark, sf_dir, awkward=False), "c.shp")
    with open(path[:-3] + "dbf", "rb") as file:
        head = struct.unpack("<H", file.read(10)[8:])[0]
        file.seek(0)
        data = file.read(head)
    rows = [(data[at : at + 11].split(b"\0")[0].decode(), chr(data[at + 11]), data[at + 16]) for at in range(32, head - 1, 32)]
    longest = read(spark, sf_dir, "customer").agg(F.max(F.length(F.col("c_custkey").cast("string")))).first()[0]
    return spark.createDataFrame([(n, w if kind == "C" else min(w, longest)) for n, kind, w in rows if n in ("key", "name")], "field string, needed bigint")


@query("SELECT key, row_number() OVER (ORDER BY place) AS place FROM (SELECT * FROM (VALUES ('c', 0), ('a', 1), ('z', 2), ('b', 3)) AS t(key, place))")
def columns_in_first_seen_order(spark, sf_dir):
    """Columns in the order in which any feature first has them."""
    k = F.col("o_orderkey")
    least = read(spark, sf_dir, "orders").agg(F.min("o_orderkey")).first()[0]
    pair = lambda n: F.struct(F.lit(n).alias("k"), F.lit("1").alias("v"))
    pairs = F.when(k == least, F.array(pair("c"), pair("a"), pair("z"))).otherwise(F.array(pair("z"), pair("b"), pair("a")))
    rows = read(spark, sf_dir, "orders").select(k.alias(O.FID), pairs.alias("properties"), F.lit(None).cast("binary").alias(O.GEOMETRY))
    names = O.columns_of(O.typed_properties(rows))
    return spark.createDataFrame([(n, i) for i, n in enumerate(names, 1)], "key string, place bigint")


@query("SELECT o_orderkey AS key, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey AS VARCHAR) ELSE o_orderpriority END AS a, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_custkey AS DOUBLE) END AS b, CASE WHEN o_orderkey % 5 = 0 THEN 12345678901234567890.0::DOUBLE ELSE CAST(o_orderkey AS DOUBLE) END AS wide FROM orders")
def typed_columns(spark, sf_dir):
    """Cast to the inferred types; of repeated names the first counts; integers beyond 64 bits make a column of doubles."""
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    pair = lambda n, v: F.struct(F.lit(n).alias("k"), v.alias("v"))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    a = F.when(k % 2 == 0, k.cast("string")).otherwise(quoted(F.col("o_orderpriority")))
    b = F.when(k % 3 == 0, "null").when(k % 3 == 1, F.concat(F.col("o_custkey").cast("string"), F.lit(".0"))).otherwise(F.col("o_custkey").cast("string"))
    wide = F.when(k % 5 == 0, "12345678901234567890").otherwise(k.cast("string"))
    pairs = F.array(pair("a", a), pair("b", b), pair("a", F.lit('"second"')), pair("wide", wide))
    rows = o.select(k.alias(O.FID), pairs.alias("properties"), F.lit(None).cast("binary").alias(O.GEOMETRY))
    return O.typed_properties(rows).select(F.col(O.FID).alias("key"), "a", "b", "wide")


@query("SELECT event_id AS key, CAST(json(props) AS VARCHAR) AS props FROM events")
def nested_properties(spark, sf_dir):
    """A nested property becomes the compact text of its JSON."""
    e = read(spark, sf_dir, "events")
    lines = e.select(F.concat(F.lit('{"type":"Feature","geometry":null,"properties":{"key":'), F.col("event_id").cast("string"), F.lit(',"props":'), F.col("props"), F.lit("}}")).alias("f"))
    path = place("e.geojson")
    parts.write_lines(lines, path, '{"type": "FeatureCollection", "features": [', ",\n", "]}")
    return convert.read(spark, path).df.select("key", "props")


@query("SELECT c_custkey AS key, CASE c_custkey % 4 WHEN 0 THEN left(c_name, 10) WHEN 1 THEN 'ééééé' WHEN 2 THEN 'aéééé' ELSE 'abc日本' END AS name FROM customer")
def text_of_ten_bytes(spark, sf_dir):
    """Cut to ten bytes of UTF-8, between characters."""
    k = F.col("c_custkey")
    text = F.when(k % 4 == 0, F.col("c_name")).when(k % 4 == 1, F.lit("éééééé")).when(k % 4 == 2, F.lit("aééééé")).otherwise(F.lit("abc日本語"))
    return read(spark, sf_dir, "customer").select(k.alias("key"), C.clipped_column(text, 10).alias("name"))


@query("SELECT c_custkey AS key, CASE c_custkey % 3 WHEN 0 THEN '^A' || c_name || '^?' WHEN 1 THEN 'M-CM-)' || c_name ELSE c_name || '^M' END AS name FROM customer")
def visible_text(spark, sf_dir):
    """Control characters and bytes beyond ASCII, as cat -v writes them."""
    k = F.col("c_custkey")
    text = F.when(k % 3 == 0, F.concat(F.lit("\x01"), F.col("c_name"), F.lit("\x7f"))).when(k % 3 == 1, F.concat(F.lit("é"), F.col("c_name"))).otherwise(F.concat(F.col("c_name"), F.lit("\r")))
    return read(spark, sf_dir, "customer").select(k.alias("key"), C.visible_column(text).alias("name"))


@query("SELECT r.row AS row, a.c_custkey, b.c_custkey AS other FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS row FROM customer) a JOIN (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS row FROM customer) b ON a.row = b.row JOIN (SELECT row_number() OVER () AS row FROM customer) r ON r.row = a.row")
def rows_side_by_side(spark, sf_dir):
    """Rows of equal number."""
    c = read(spark, sf_dir, "customer")
    a = O.running_number(c.select("c_custkey"), ["c_custkey"], "row")
    b = O.running_number(c.select(F.col("c_custkey").alias("other"), "c_acctbal"), ["c_acctbal", "other"], "row").drop("c_acctbal")
    return O.zip_rows(a, b, "row").select("row", "c_custkey", "other")


# ---- geometry blobs


@query("SELECT c_custkey AS key, '475000010' || '0000000' || hex(st_aswkb(('POINT (' || c_custkey || ' ' || c_nationkey || ')')::GEOMETRY)) AS blob, 'POINT (' || c_custkey || ' ' || c_nationkey || ')' AS wkt FROM customer")
def package_blobs(spark, sf_dir):
    """GeoPackage blobs, and the geometry behind their headers."""
    blobs = customer_points(spark, sf_dir).select(F.col(O.FID).alias("key"), C.gpb_of(F.col(O.GEOMETRY)).alias("b"))
    return blobs.select("key", F.hex("b").alias("blob"), C.wkt_of(C.wkb_of_gpb(F.col("b"))).alias("wkt"))


@query("WITH p AS (SELECT c_custkey AS key, hex(st_aswkb(('POINT (' || c_custkey || ' ' || c_nationkey || ')')::GEOMETRY)) AS w FROM customer) SELECT key, '4750000300000000' || substr(w, 11, 16) || substr(w, 11, 16) || substr(w, 27, 16) || substr(w, 27, 16) || w AS blob FROM p")
def package_envelopes(spark, sf_dir):
    """Blobs with the envelope of their geometry."""
    points = customer_points(spark, sf_dir).withColumnRenamed("c_custkey", O.FID)
    path = written(FeatureFrame(points.select(O.FID, O.GEOMETRY), None), "c.gpkg", envelope=True)
    with sqlite3.connect(path) as db:
        rows = [(int(binary.from_gpb(b).coordinates[0]), bytes(b).hex().upper()) for (b,) in db.execute("SELECT geom FROM c")]
    return spark.createDataFrame(rows, "key bigint, blob string")


_GRID = "SELECT c_custkey AS id, (c_custkey * 7919) % 1000 AS x, (c_custkey * 104729 + c_nationkey) % 777 AS y FROM customer"


@query(f"""WITH RECURSIVE p AS ({_GRID}), e AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p),
g AS (SELECT id, CAST(floor(CAST(x - x0 AS DOUBLE) / (x1 - x0) * 65535) AS BIGINT) AS x, CAST(floor(CAST(y - y0 AS DOUBLE) / (y1 - y0) * 65535) AS BIGINT) AS y FROM p, e), h AS (
  SELECT id, x, y, CAST(0 AS BIGINT) AS d, CAST(32768 AS BIGINT) AS s FROM g
  UNION ALL
  SELECT id, CASE WHEN y & s > 0 THEN x WHEN x & s > 0 THEN 65535 - y ELSE y END, CASE WHEN y & s > 0 THEN y WHEN x & s > 0 THEN 65535 - x ELSE x END,
         d + s * s * (CASE WHEN x & s > 0 THEN CASE WHEN y & s > 0 THEN 2 ELSE 3 END ELSE CASE WHEN y & s > 0 THEN 1 ELSE 0 END END), s // 2 FROM h WHERE s >= 1
) SELECT id AS key, row_number() OVER (ORDER BY d, id) AS place FROM h WHERE s = 0""")
def sorted_by_hilbert(spark, sf_dir):
    """The order of a GeoParquet file that is written sorted."""
    c, k = read(spark, sf_dir, "customer"), F.col("c_custkey")
    points = c.select(k.alias(O.FID), k.alias("key"), C.wkb_of(C.point_wkt(k * 7919 % 1000, (k * 104729 + F.col("c_nationkey")) % 777)).alias(O.GEOMETRY))
    path = written(FeatureFrame(points, WGS84).sort_hilbert(), "s.csv")
    df = convert.read(spark, path).df
    return O.running_number(df.select(O.FID, "key"), [O.FID], "place").select("key", "place")


@query("SELECT CAST(min(p_partkey) AS DOUBLE) AS minx, 0.0::DOUBLE AS miny, CAST(max(p_partkey + p_size) AS DOUBLE) AS maxx, CAST(max(p_size) AS DOUBLE) AS maxy, 'Polygon' AS types FROM part")
def geoparquet_footer(spark, sf_dir):
    """Bounds and types in the footer."""
    geo, names = geoparquet.footer(written(cells(spark, sf_dir), "p.parquet"))
    meta = geo["columns"][geoparquet.geometry_column(geo, names)]
    return spark.createDataFrame([(*map(float, meta["bbox"]), ",".join(meta["geometry_types"]))], "minx double, miny double, maxx double, maxy double, types string")


@query("SELECT o_orderkey % 4 AS kind, min(o_orderkey % 4 IN (1)) AS z, min(o_orderkey % 4 IN (2, 3)) AS m FROM orders GROUP BY 1")
def dimensions_by_kind(spark, sf_dir):
    """Which geometries have z and m, by their headers."""
    k = F.col("o_orderkey")
    key = k.cast("string")
    wkt = F.when(k % 4 == 0, F.concat(F.lit("POINT ("), key, F.lit(" 1)"))).when(k % 4 == 1, F.concat(F.lit("LINESTRING Z (0 0 "), key, F.lit(", 1 1 2)"))).when(k % 4 == 2, F.concat(F.lit("POINT M (1 2 "), key, F.lit(")"))).otherwise(F.concat(F.lit("MULTIPOINT M (1 2 "), key, F.lit(", 3 4 5)")))
    code = (C.type_code(C.wkb_of(wkt)) / 1000).cast("int")
    return read(spark, sf_dir, "orders").select((k % 4).alias("kind"), code.alias("c")).groupBy("kind").agg(F.bool_and(F.col("c").isin(1, 3)).alias("z"), F.bool_and(F.col("c").isin(2, 3)).alias("m"))


@query("SELECT c_nationkey AS nation, 'MULTIPOINT (' || string_agg(c_custkey || ' ' || c_nationkey, ', ' ORDER BY c_custkey) || ')' AS wkt FROM customer GROUP BY c_nationkey HAVING count(*) > 1")
def combined_points(spark, sf_dir):
    """Parts of one kind become the multi-geometry of that kind, by way of KML."""
    rows = read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.sort_array(F.collect_list("c_custkey")).alias("k")).where(F.size("k") > 1)
    wkt = F.concat(F.lit("MULTIPOINT ("), F.array_join(F.transform("k", lambda k: F.concat_ws(" ", k.cast("string"), F.col("c_nationkey").cast("string"))), ", "), F.lit(")"))
    df = rows.select(F.col("c_nationkey").cast("bigint").alias(O.FID), F.col("c_nationkey").alias("nation"), C.wkb_of(wkt).alias(O.GEOMETRY))
    found = there_and_back(spark, FeatureFrame(df, WGS84), "n.kml")
    return back(found.withColumn("nation", F.col("nation").cast("int")), "nation")


# ---- systems


def _systems_of(spark: SparkSession, sf_dir: str, text, of) -> DataFrame:
    rows = [(r.n_nationkey, of(text(r.n_nationkey))) for r in read(spark, sf_dir, "nation").collect()]
    return spark.createDataFrame(rows, "nation int, code string")


def utm(n: int) -> str:
    return f'PROJCS["WGS 84 / UTM zone {n + 1}N",GEOGCS["WGS 84",DATUM["WGS_1984",SPHEROID["WGS 84",6378137,298.257223563]],PRIMEM["Greenwich",0],UNIT["degree",0.0174532925199433],AUTHORITY["EPSG","4326"]],PROJECTION["Transverse_Mercator"],PARAMETER["latitude_of_origin",0],PARAMETER["central_meridian",{6 * n - 177}],PARAMETER["scale_factor",0.9996],PARAMETER["false_easting",500000],PARAMETER["false_northing",0],UNIT["metre",1],AXIS["Easting",EAST],AXIS["Northing",NORTH],AUTHORITY["EPSG","{32601 + n}"]]'


@query("SELECT n_nationkey AS nation, 'EPSG:' || (32601 + n_nationkey) AS code FROM nation")
def codes_of_wkt(spark, sf_dir):
    """The identity of a definition is that of its outermost element."""
    return _systems_of(spark, sf_dir, utm, lambda t: Crs.of_definition(t).authority_code())


@query("SELECT n_nationkey AS nation, CAST(6 * n_nationkey - 177 AS VARCHAR) AS code FROM nation")
def projjson_of_wkt_files(spark, sf_dir):
    """WKT of a Shapefile's .prj, translated into a GeoParquet footer: the central meridian."""

    def meridian(text: str) -> str:
        found = Crs.of_definition(text).as_projjson()
        values = {p["id"]["code"]: p["value"] for p in found["conversion"]["parameters"]}
        return G.number_text(float(values[8802]))

    return _systems_of(spark, sf_dir, utm, meridian)


@query("SELECT n_nationkey AS nation, 'EPSG:' || (32601 + n_nationkey) AS code FROM nation")
def systems_through_files(spark, sf_dir):
    """A definition in the file beside a Shapefile comes back as it went in."""
    point = spark.createDataFrame([(1, bytearray(G.to_wkb(G.from_wkt("POINT (1 2)"))))], f"{O.FID} bigint, {O.GEOMETRY} binary")

    def through(text: str) -> str | None:
        path = written(FeatureFrame(point, Crs.of_definition(text)), "x.shp")
        found = convert.read(spark, path).crs
        return found.authority_code() if found.wkt == text else None

    return _systems_of(spark, sf_dir, utm, through)


@query("SELECT n_nationkey AS nation, CASE n_nationkey % 3 WHEN 0 THEN 'GeoJSON is always WGS 84; coordinates in EPSG:' || (32601 + n_nationkey) || ' will be mislabelled' WHEN 1 THEN 'CSV can''t hold a CRS; EPSG:' || (32601 + n_nationkey) || ' is dropped' END AS code FROM nation")
def losses_of_systems(spark, sf_dir):
    """What a format can't hold is told, once."""
    from ..formats import CSV, FLATGEOBUF, GEOJSON

    rows = [(r.n_nationkey, Crs.of_definition(utm(r.n_nationkey)).loss((GEOJSON, CSV, FLATGEOBUF)[r.n_nationkey % 3])) for r in read(spark, sf_dir, "nation").collect()]
    return spark.createDataFrame(rows, "nation int, code string")


__all__ = ["ORACLES", "QUERIES"]
