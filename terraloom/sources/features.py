"""The ``terraloom`` data source: features of vector files as rows (_layer, _fid, properties, geometry).

``properties`` is array<struct<k, v>>: names and JSON values in their order; ``geometry`` is ISO WKB. Files are read on the executors:
one partition for each file, and ranges of rows for GeoPackage layers. WKT lines and CSV have ``read_lines`` and ``read_csv``, which
split large files.
"""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..crs.model import WGS84, Crs
from ..formats import CSV, FLATGEOBUF, GEOJSON, GEOPACKAGE, KML, KMZ, SHAPEFILE, WKT, Format, format_of
from ..functions import columns as C
from ..functions import geometry as G
from ..operators.core import FID, GEOMETRY
from . import binary, parts, textual

SCHEMA = "_layer string, _fid bigint, properties array<struct<k:string,v:string>>, geometry binary"
_ARROW = pa.schema([("_layer", pa.string()), ("_fid", pa.int64()), ("properties", pa.list_(pa.struct([("k", pa.string()), ("v", pa.string())]))), ("geometry", pa.binary())])
ROWS = 50_000
BATCH = 2_000


@dataclass
class Part(InputPartition):
    path: str
    number: int
    layer: str = ""
    column: str = ""
    low: int = 0
    high: int = 0
    before: int = 0
    first: int = 0
    records: int = 0
    prefixes: tuple[str, ...] = ()
    whole: bool = True


#: Larger files are read in pieces of about so many bytes.
PIECE = 8 << 20


def pieces(path: str, f: Format, number: int) -> list[Part]:
    """Parts of a file: itself, or pieces of a large one. Planned by the driver, which passes over text (and record heads) once."""
    part = lambda **x: Part(path, number, whole=False, **x)
    beside = binary.sibling(path, "dbf") if f is SHAPEFILE else None
    found: list[Part] = []
    if f not in (GEOJSON, FLATGEOBUF, SHAPEFILE, KML, KMZ) or os.path.getsize(path) + (os.path.getsize(beside) if beside else 0) <= PIECE:
        pass
    elif f is FLATGEOBUF:
        found = [part(low=a, high=b, before=n) for a, b, n in binary.fgb_pieces(path, PIECE)]
    elif f is SHAPEFILE and beside:
        found = [part(low=a, high=b, first=i, records=n, before=k) for a, b, i, n, k in binary.shp_pieces(path, beside, PIECE)]
    elif f is GEOJSON:
        found = [part(low=a, high=b, before=n) for a, b, n in textual.geojson_pieces(path, PIECE) or ()]
    elif f is KML and (cut := textual.kml_pieces(path, PIECE)):
        found = [part(low=a, high=b, before=n, prefixes=tuple(cut[1])) for a, b, n in cut[0]]
    elif f is KMZ:
        found = _kmz_pieces(path, part)
    return found or [Part(path, number)]


def _kmz_pieces(path: str, part) -> list[Part]:
    """Pieces of all documents of a KMZ, if all are stored as they are and can be cut; their features go on counting."""
    found: list[Part] = []
    before = 0
    for _, at, size in textual.kmz_entries(path):
        cut = at is not None and textual.kml_pieces(path, PIECE, at, size)
        if not cut:
            return []
        found += [part(low=a, high=b, before=before + n, prefixes=tuple(cut[1])) for a, b, n in cut[0]]
        with open(path, "rb") as file:  # the last piece's own number of placemarks
            file.seek(cut[0][-1][0])
            before += cut[0][-1][2] + sum(start >= 0 for start, *_ in textual._spans(file.read(cut[0][-1][1] - cut[0][-1][0])))
    return found


def piece_features(part: Part, f: Format) -> Iterator:
    if f is FLATGEOBUF:
        return binary.fgb_rows(part.path, part.low, part.high)
    if f is SHAPEFILE:
        shp, dbf = binary.shp_piece(part.path, binary.sibling(part.path, "dbf"), part.low, part.high, part.first, part.records)
        cpg = binary.sibling(part.path, "cpg")
        return iter(binary.read_shapefile(shp, dbf, None, open(cpg, encoding="utf-8", errors="replace").read() if cpg else None)[0])  # noqa: SIM115
    with open(part.path, "rb") as file:
        file.seek(part.low)
        data = file.read(part.high - part.low)
    return textual.read_geojson_piece(data) if f is GEOJSON else textual.read_kml_piece(data, list(part.prefixes))


def expand(path: str) -> list[str]:
    path = path.removeprefix("file://")
    found = sorted(glob.glob(path)) if glob.has_magic(path) else [path]
    return [p for f in found for p in (sorted(os.path.join(f, x) for x in os.listdir(f) if not x.startswith((".", "_"))) if os.path.isdir(f) else [f])]


def features_of(path: str, f: Format) -> tuple[Iterator, Crs | None]:
    """Features and CRS of a file of any format but GeoPackage and GeoParquet."""
    if f is SHAPEFILE:
        beside = {e: binary.sibling(path, e) for e in ("dbf", "prj", "cpg")}
        if not beside["dbf"]:
            raise textual.FormatError(f"{path} has no .dbf beside it")
        text = lambda e: open(beside[e], encoding="utf-8", errors="replace").read() if beside[e] else None  # noqa: E731, SIM115
        with open(path, "rb") as a, open(beside["dbf"], "rb") as b:
            found, crs = binary.read_shapefile(a.read(), b.read(), text("prj"), text("cpg"))
        return iter(found), crs
    with open(path, "rb") as file:
        data = file.read()
    if f is FLATGEOBUF:
        found, crs = binary.read_fgb(data)
        return iter(found), crs
    read = {GEOJSON: textual.read_geojson, WKT: textual.read_wkt, CSV: textual.read_csv, KML: textual.read_kml, KMZ: textual.read_kmz}[f]
    return read(data), WGS84 if f.crs == "fixed WGS 84" else None


def crs_of(path: str, f: Format) -> dict[str, Crs | None]:
    """CRS of each layer, from metadata as far as the format allows."""
    first = expand(path)[0]
    if f is GEOPACKAGE:
        return {name: crs for name, _, _, crs in binary.gpkg_layers(first)}
    if f.crs == "fixed WGS 84":
        return {"": WGS84}
    if f in (CSV, WKT):
        return {"": None}
    if f is SHAPEFILE:
        prj = binary.sibling(first, "prj")
        text = open(prj, encoding="utf-8", errors="replace").read().strip() if prj else ""  # noqa: SIM115
        return {"": Crs.of_definition(text) if text else None}
    return {"": binary.fgb_crs(first)}


class FeatureSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "terraloom"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FeatureReader(self.options)


class FeatureReader(DataSourceReader):
    def __init__(self, options):
        self.format = format_of(options["fileformat"]).name
        self.path, self.layer = options["path"], options.get("layer")
        self.planned = options.get("planned")

    def partitions(self) -> list[Part]:
        if self.planned:
            return [Part(**x) for x in json.loads(self.planned)]
        return self.plan()

    def plan(self) -> list[Part]:
        paths = expand(self.path)
        if not paths:
            raise textual.FormatError(f"nothing is at {self.path}")
        if self.format != GEOPACKAGE.name:
            f = format_of(self.format)
            return [x for i, p in enumerate(paths) for x in pieces(p, f, i)]
        out = []
        for p in paths:
            for name, column, _, _ in binary.gpkg_layers(p):
                if self.layer in (None, name):
                    out += [Part(p, len(out), name, column, low, high) for low, high in binary.gpkg_ranges(p, name, ROWS)]
        if not out:
            raise textual.FormatError(f"{self.path} has no layer {self.layer or 'of features'}")
        return out

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if self.format == GEOPACKAGE.name:
            rows = binary.gpkg_rows(part.path, part.layer, part.column, part.low, part.high)
        else:
            f = format_of(self.format)
            rows = enumerate(features_of(part.path, f)[0] if part.whole else piece_features(part, f), part.before + 1)
        first = 0 if self.format == GEOPACKAGE.name else part.number << 40
        rows = iter(rows)
        while batch := list(islice(rows, BATCH)):
            fids, keys, values, ends, shapes = [], [], [], [0], []
            for fid, (properties, g) in batch:
                fids.append(first + fid)
                for k, v in properties:
                    keys.append(k)
                    values.append(G.json_text(v))
                ends.append(len(keys))
                shapes.append(G.to_wkb(g) if g else None)
            pairs = pa.StructArray.from_arrays([pa.array(keys, pa.string()), pa.array(values, pa.string())], names=["k", "v"])
            columns = [pa.array([part.layer] * len(fids), pa.string()), pa.array(fids, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs), pa.array(shapes, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=_ARROW)


def read_raw(spark: SparkSession, path: str, f: Format, layer: str | None = None) -> DataFrame:
    spark.dataSource.register(FeatureSource)
    options = {"fileformat": f.name, "path": path} | ({"layer": layer} if layer else {})
    planned = json.dumps([asdict(x) for x in FeatureReader(options).plan()])  # once, though a frame is planned for each job
    reader = spark.read.format("terraloom").option("fileformat", f.name).option("planned", planned)
    return (reader.option("layer", layer) if layer else reader).load(path)


def spread(raw: DataFrame) -> DataFrame:
    """Features of one file dealt to all cores by ranges of their number, in order, and kept, so that the file is parsed once. Those of many pieces stay where they are."""
    if raw.rdd.getNumPartitions() >= raw.sparkSession.sparkContext.defaultParallelism:
        return raw.persist()
    parts = max(raw.sparkSession.sparkContext.defaultParallelism, int(raw.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return raw.persist().repartitionByRange(parts, FID).sortWithinPartitions(FID)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """WKT lines of files of any size; no line is lost, blank ones are skipped, a bad one is an error."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias(FID), F.trim("value").alias("v")).where(F.length("v") > 0)
    return lines.select(FID, C.wkb_of(F.col("v")).alias(GEOMETRY))


def _csv_in_pieces(spark: SparkSession, path: str, cells: DataFrame, rules: dict[str, str]) -> DataFrame | None:
    """Cells of a large local file whose records the driver can tell apart: executors cut pieces into records, which Spark parses by the same rules."""
    local = path.removeprefix("file://")
    if not os.path.isfile(local) or os.path.getsize(local) <= PIECE or not (cuts := textual.csv_pieces(local, PIECE)):
        return None

    with open(local, "rb") as file:
        file.seek(max(0, cuts[0][0] - 2))
        crlf = file.read(2) == b"\r\n"

    def records(cut):
        with open(local, "rb") as file:
            file.seek(cut[0])
            found = textual.csv_records(file.read(cut[1] - cut[0]), crlf)
        for i in range(0, len(found), BATCH):
            yield pa.RecordBatch.from_arrays([pa.array([x.decode(errors="replace") for x in found[i : i + BATCH]], pa.string())], names=["r"])

    lines = parts.over(spark, cuts, records, "r string")
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(cells.columns))])
    row = lines.select(F.from_csv("r", schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), rules | {"multiLine": "true"}).alias("r"))
    return row.select(*[F.col(f"r.c{i}").alias(c) for i, c in enumerate(cells.columns)])


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV of any size as raw features: Spark parses the text, that of a large local file in pieces; cells are read by this library's rules."""
    rules = {"quote": '"', "escape": '"', "nullValue": "", "emptyValue": ""}
    cells = spark.read.csv(path, header=True, multiLine=True, inferSchema=False, **rules)
    cells = _csv_in_pieces(spark, path, cells, rules) or cells
    at = next((c for c in cells.columns if c.strip().lower() in textual.GEOMETRY_NAMES), None)
    if at is None:
        raise textual.FormatError("CSV has no geometry column")
    ordinal = F.monotonically_increasing_id().alias(FID)
    quoted = lambda c: F.to_json(F.struct(F.col(f"`{c}`").alias("v")))
    value = lambda c: F.when(C.csv_kind(F.col(f"`{c}`")) == "null", F.lit("null")).when(C.csv_kind(F.col(f"`{c}`")) == "bool", F.lower(F.col(f"`{c}`"))).when(C.csv_kind(F.col(f"`{c}`")).isin("int", "double"), F.ltrim(F.col(f"`{c}`"), F.lit("+"))).otherwise(F.regexp_extract(quoted(c), r'(?s)^\{"v":(.*)\}$', 1))
    pairs = F.array(*[F.struct(F.lit(c).alias("k"), value(c).alias("v")) for c in cells.columns if c != at]).cast("array<struct<k:string,v:string>>")
    filled = cells.where(F.coalesce(*[F.col(f"`{c}`") for c in cells.columns]).isNotNull())
    return filled.select(F.lit("").alias("_layer"), ordinal, pairs.alias("properties"), C.wkb_of(F.trim(F.col(f"`{at}`"))).alias(GEOMETRY))
