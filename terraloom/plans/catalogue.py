"""Queries over the driver's tables, one for each operator, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import core as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customer_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias(O.FID), "c_nationkey", "c_name", C.wkb_of(C.point_wkt(F.col("c_custkey"), F.col("c_nationkey"))).alias(O.GEOMETRY))


@query("SELECT c_custkey, st_aswkt(('POINT (' || c_custkey || ' ' || c_nationkey || ')')::GEOMETRY) AS wkt FROM customer")
def point_wkt(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", C.point_wkt(F.col("c_custkey"), F.col("c_nationkey")).alias("wkt"))


@query("SELECT c_custkey, hex(st_aswkb(('POINT (' || c_custkey || ' ' || c_nationkey || ')')::GEOMETRY)) AS wkb FROM customer")
def point_wkb_hex(spark, sf_dir):
    return customer_points(spark, sf_dir).select(F.col(O.FID).alias("c_custkey"), F.hex(O.GEOMETRY).alias("wkb"))


@query("SELECT l_orderkey, l_linenumber, st_aswkt(('POINT ZM (' || l_orderkey || ' ' || l_partkey || ' ' || l_linenumber || ' ' || l_suppkey || ')')::GEOMETRY) AS wkt FROM lineitem")
def point_zm_wkt(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", C.point_wkt(*map(F.col, ("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey")), tag="ZM").alias("wkt"))


@query("SELECT s_suppkey, 'POINT (' || s_suppkey || ' ' || s_nationkey || ')' AS wkt FROM supplier")
def wkb_to_wkt_roundtrip(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select("s_suppkey", C.wkb_of(C.point_wkt(F.col("s_suppkey"), F.col("s_nationkey"))).alias("g"))
    return s.select("s_suppkey", C.wkt_of(F.col("g")).alias("wkt"))


@query("SELECT user_id, st_aswkt(('LINESTRING (' || string_agg(event_id || ' ' || user_id, ', ' ORDER BY ts, event_id) || ')')::GEOMETRY) AS wkt FROM events GROUP BY user_id HAVING count(*) > 1")
def linestring_by_user(spark, sf_dir):
    e = read(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id"))).alias("p")).where(F.size("p") > 1)
    line = F.concat(F.lit("LINESTRING ("), F.array_join(F.transform("p", lambda p: F.concat_ws(" ", p["event_id"].cast("string"), F.col("user_id").cast("string"))), ", "), F.lit(")"))
    return e.select("user_id", C.wkt_of(C.wkb_of(line)).alias("wkt"))


def square(x, s):
    corner = lambda a, b: F.concat_ws(" ", a.cast("string"), b.cast("string"))
    return F.concat(F.lit("POLYGON (("), F.concat_ws(", ", corner(x, F.lit(0)), corner(x + s, F.lit(0)), corner(x + s, s), corner(x, s), corner(x, F.lit(0))), F.lit("))"))


@query("SELECT p_partkey, 'POLYGON ((' || p_partkey || ' 0, ' || (p_partkey + p_size) || ' 0, ' || (p_partkey + p_size) || ' ' || p_size || ', ' || p_partkey || ' ' || p_size || ', ' || p_partkey || ' 0))' AS wkt FROM part")
def polygon_cell_wkt(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return p.select("p_partkey", C.wkt_of(C.wkb_of(square(F.col("p_partkey"), F.col("p_size")))).alias("wkt"))


@query("""SELECT c_custkey, st_aswkt(st_geomfromgeojson('{"type":"Point","coordinates":[' || c_custkey || ',' || c_nationkey || ']}')) AS wkt FROM customer""")
def geojson_parse(spark, sf_dir):
    text = F.concat(F.lit('{"type":"Point","coordinates":['), F.col("c_custkey").cast("string"), F.lit(","), F.col("c_nationkey").cast("string"), F.lit("]}"))
    return read(spark, sf_dir, "customer").select("c_custkey", C.wkt_of(C.wkb_of_geojson(text)).alias("wkt"))


@query("""SELECT c_custkey, '{"type":"Point","coordinates":[' || c_custkey || ',' || c_nationkey || ']}' AS geojson FROM customer""")
def geojson_write(spark, sf_dir):
    return customer_points(spark, sf_dir).select(F.col(O.FID).alias("c_custkey"), C.geojson_of(F.col(O.GEOMETRY)).alias("geojson"))


@query("SELECT c_nationkey, CAST(min(c_custkey) AS DOUBLE) AS minx, CAST(min(c_nationkey) AS DOUBLE) AS miny, CAST(max(c_custkey) AS DOUBLE) AS maxx, CAST(max(c_nationkey) AS DOUBLE) AS maxy FROM customer GROUP BY c_nationkey")
def bbox_by_group(spark, sf_dir):
    return O.bounds(customer_points(spark, sf_dir), "c_nationkey").select("c_nationkey", "minx", "miny", "maxx", "maxy")


def mixed(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey").cast("string")
    wkt = (
        F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("POINT ("), k, F.lit(" 1)")))
        .when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("LINESTRING Z (0 0 "), k, F.lit(", 1 1 2)")))
        .when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit("POINT M (1 2 "), k, F.lit(")")))
    )
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias(O.FID), C.wkb_of(wkt).alias(O.GEOMETRY))


_MIXED = "CASE o_orderkey % 4 WHEN 0 THEN 'Point' WHEN 1 THEN 'LineString Z' WHEN 2 THEN 'Point M' END"


@query(f"SELECT DISTINCT {_MIXED} AS type FROM orders WHERE o_orderkey % 4 < 3")
def geometry_types_set(spark, sf_dir):
    return O.geometry_types(mixed(spark, sf_dir)).select(F.explode("types").alias("type"))


@query("SELECT bool_or(o_orderkey % 4 = 1) AS has_z, bool_or(o_orderkey % 4 = 2) AS has_m FROM orders")
def has_z_m_flags(spark, sf_dir):
    code = (C.type_code(F.col(O.GEOMETRY)) / 1000).cast("int")
    return mixed(spark, sf_dir).agg(F.bool_or(code.isin(1, 3)).alias("has_z"), F.bool_or(code.isin(2, 3)).alias("has_m"))


_KINDS = "CASE WHEN bool_or(t = 'VARCHAR' OR t = 'ARRAY' OR t = 'OBJECT') OR (bool_or(t = 'BOOLEAN') AND bool_or(t IN ('BIGINT', 'UBIGINT', 'DOUBLE'))) THEN 'string' WHEN bool_or(t = 'BOOLEAN') THEN 'bool' WHEN bool_or(t = 'DOUBLE') THEN 'double' WHEN bool_or(t IN ('BIGINT', 'UBIGINT')) THEN 'int' ELSE 'string' END"


def json_pairs(df: DataFrame, fid: str, text) -> DataFrame:
    """key, value (JSON text) of objects given as text: keys by json_object_keys, values by a variant."""
    keys = F.json_object_keys(text)
    v = F.try_parse_json(text)
    rows = df.select(F.col(fid).alias(O.FID), F.posexplode(keys).alias("pos", "key"), v.alias("v"))
    return rows.select(O.FID, "pos", "key", F.to_json(F.try_variant_get("v", F.concat(F.lit("$['"), F.col("key"), F.lit("']")), "variant")).alias("value"))


@query(f"WITH k AS (SELECT unnest(json_keys(props)) AS key, props FROM events), t AS (SELECT key, json_type(props, '$.' || key) AS t FROM k) SELECT key, {_KINDS} AS type FROM t GROUP BY key")
def schema_infer_props(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return O.infer_schema(json_pairs(e, "event_id", F.col("props"))).select("key", "type")


_JSON = """CASE o_orderkey % 3 WHEN 0 THEN '{"a":' || o_orderkey || ',"b":true,"c":1}' WHEN 1 THEN '{"a":1.5,"b":false,"d":null}' ELSE '{"c":"x","e":[1,2],"a":2}' END"""


@query(f"WITH j AS (SELECT {_JSON} AS props FROM orders), k AS (SELECT unnest(json_keys(props)) AS key, props FROM j), t AS (SELECT key, json_type(props, '$.' || key) AS t FROM k) SELECT key, {_KINDS} AS type FROM t GROUP BY key")
def schema_infer_mixed(spark, sf_dir):
    k = F.col("o_orderkey")
    text = F.when(k % 3 == 0, F.concat(F.lit('{"a":'), k.cast("string"), F.lit(',"b":true,"c":1}'))).when(k % 3 == 1, F.lit('{"a":1.5,"b":false,"d":null}')).otherwise(F.lit('{"c":"x","e":[1,2],"a":2}'))
    rows = read(spark, sf_dir, "orders").select("o_orderkey", text.alias("j"))
    return O.infer_schema(json_pairs(rows, "o_orderkey", F.col("j"))).select("key", "type")


@query(r"""WITH c AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN c_name WHEN 1 THEN CAST(c_custkey AS VARCHAR) WHEN 2 THEN 'TRUE' WHEN 3 THEN '' WHEN 4 THEN '-' || c_custkey || '.5' ELSE '1e3' END AS cell FROM customer)
SELECT c_custkey, CASE WHEN cell IS NULL OR cell = '' THEN 'null' WHEN lower(cell) IN ('true', 'false') THEN 'bool' WHEN regexp_full_match(cell, '[+-]?\d{1,18}') THEN 'int' WHEN regexp_full_match(cell, '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?') THEN 'double' ELSE 'string' END AS kind FROM c""")
def csv_infer_kind(spark, sf_dir):
    k = F.col("c_custkey")
    cell = F.when(k % 6 == 0, F.col("c_name")).when(k % 6 == 1, k.cast("string")).when(k % 6 == 2, F.lit("TRUE")).when(k % 6 == 3, F.lit("")).when(k % 6 == 4, F.concat(F.lit("-"), k.cast("string"), F.lit(".5"))).otherwise(F.lit("1e3"))
    return read(spark, sf_dir, "customer").select("c_custkey", C.csv_kind(cell).alias("kind"))


_GRID = "SELECT c_custkey AS id, (c_custkey * 7919) % 65536 AS x, (c_custkey * 104729 + c_nationkey) % 65536 AS y FROM customer"
_HILBERT = f"""WITH RECURSIVE g AS ({_GRID}), h AS (
  SELECT id, x, y, CAST(0 AS BIGINT) AS d, CAST(32768 AS BIGINT) AS s FROM g
  UNION ALL
  SELECT id, CASE WHEN y & s > 0 THEN x WHEN x & s > 0 THEN 65535 - y ELSE y END, CASE WHEN y & s > 0 THEN y WHEN x & s > 0 THEN 65535 - x ELSE x END,
         d + s * s * (CASE WHEN x & s > 0 THEN CASE WHEN y & s > 0 THEN 2 ELSE 3 END ELSE CASE WHEN y & s > 0 THEN 1 ELSE 0 END END), s // 2 FROM h WHERE s >= 1
), v AS (SELECT id, d FROM h WHERE s = 0)"""


def grid(spark, sf_dir) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    g = c.select(F.col("c_custkey").alias("id"), (F.col("c_custkey") * 7919 % 65536).alias("x"), ((F.col("c_custkey") * 104729 + F.col("c_nationkey")) % 65536).alias("y"))
    return g.select("id", "x", "y", C.hilbert(F.col("x"), F.col("y")).alias("hilbert"))


@query(f"{_HILBERT} SELECT id, d AS hilbert FROM v")
def hilbert_value(spark, sf_dir):
    return grid(spark, sf_dir).select("id", "hilbert")


@query(f"{_HILBERT} SELECT id, row_number() OVER (ORDER BY d, id) AS rn FROM v")
def hilbert_order_rank(spark, sf_dir):
    return O.running_number(grid(spark, sf_dir), ["hilbert", "id"]).select("id", "rn")


@query(f"""{_HILBERT}, r AS (SELECT v.id, x, y, row_number() OVER (ORDER BY d, v.id) AS rn FROM v JOIN g ON g.id = v.id)
SELECT (rn - 1) // 16 AS node, min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy, count(*) AS n FROM r GROUP BY 1""")
def rtree_leaf_pages(spark, sf_dir):
    r = O.running_number(grid(spark, sf_dir), ["hilbert", "id"])
    return O.index_nodes(r.select("rn", F.col("x").alias("minx"), F.col("y").alias("miny"), F.col("x").alias("maxx"), F.col("y").alias("maxy")), "rn")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS fid FROM orders")
def fid_assignment(spark, sf_dir):
    return O.running_number(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], "fid").select("o_orderkey", "fid")


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) * p_size AS area FROM part")
def ring_signed_area(spark, sf_dir):
    x, s = F.col("p_partkey").cast("double"), F.col("p_size").cast("double")
    at = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    zero = F.lit(0.0)
    ring = F.array(at(x, zero), at(x + s, zero), at(x + s, s), at(x, s), at(x, zero))
    return read(spark, sf_dir, "part").select("p_partkey", C.signed_area(ring).alias("area"))


_RINGS = "PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate"


@query(f"""WITH r AS (SELECT *, l_partkey % 3 = 0 OR row_number() OVER ({_RINGS}) = 1 AS opens FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CAST(sum(CAST(opens AS INT)) OVER ({_RINGS} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS shell FROM r""")
def ring_grouping(spark, sf_dir):
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
    r = read(spark, sf_dir, "lineitem").select("l_orderkey", *order, (F.col("l_partkey") % 3 == 0).alias("cw"))
    return O.ring_numbers(r, "l_orderkey", order, "cw").select("l_orderkey", "l_linenumber", "l_partkey", "shell")


_LAYERS = "SELECT 'a' AS layer, c_custkey AS id FROM customer WHERE c_nationkey < 5 UNION ALL SELECT 'b' AS layer, c_custkey AS id FROM customer WHERE c_nationkey >= 5"


@query(f"WITH o AS ({_LAYERS}), n AS (SELECT 'b' AS layer, s_suppkey AS id FROM supplier) SELECT layer, id FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.layer = o.layer) UNION ALL SELECT layer, id FROM n")
def layer_upsert(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.when(F.col("c_nationkey") < 5, "a").otherwise("b").alias("layer"), F.col("c_custkey").alias("id"))
    s = read(spark, sf_dir, "supplier").select(F.lit("b").alias("layer"), F.col("s_suppkey").alias("id"))
    return O.upsert_layers(c, s, "layer")


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' WHEN epoch_us(ts) % 1000 = 0 THEN '.' || lpad(CAST(epoch_us(ts) % 1000000 // 1000 AS VARCHAR), 3, '0') ELSE '.' || lpad(CAST(epoch_us(ts) % 1000000 AS VARCHAR), 6, '0') END AS iso FROM events""")
def iso_timestamp_text(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", C.iso_timestamp(F.col("ts").cast("timestamp")).alias("iso"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def date_text(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS DECIMAL(15, 2)) AS VARCHAR) AS quantity FROM lineitem")
def decimal_text(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("decimal(15,2)").cast("string").alias("quantity"))


@query("SELECT r_regionkey, lower(hex(r_name)) AS hex FROM region")
def hex_text(spark, sf_dir):
    return read(spark, sf_dir, "region").select("r_regionkey", F.lower(F.hex("r_name")).alias("hex"))


@query("SELECT c_custkey FROM customer WHERE c_custkey BETWEEN 100 AND 900 AND c_nationkey BETWEEN 3 AND 12")
def extent_intersects(spark, sf_dir):
    b = C.bbox_of(F.col(O.GEOMETRY))
    boxed = customer_points(spark, sf_dir).select(O.FID, b.alias("b"))
    return boxed.where("b.maxx >= 100 AND b.minx <= 900 AND b.maxy >= 3 AND b.miny <= 12").select(F.col(O.FID).alias("c_custkey"))


@query("SELECT c_custkey, 'POINT (' || (c_custkey + 10) || ' ' || (c_nationkey - 5) || ')' AS wkt FROM customer")
def map_positions_shift(spark, sf_dir):
    def shift(p):
        p = p.copy()
        p[:, 0] += 10
        p[:, 1] -= 5
        return p

    moved = O.map_positions(customer_points(spark, sf_dir), shift)
    return moved.select(F.col(O.FID).alias("c_custkey"), C.wkt_of(F.col(O.GEOMETRY)).alias("wkt"))
