"""GeoParquet: Spark's Parquet scan with the ``geo`` footer key on reading, pyarrow files with that key on writing."""

from __future__ import annotations

import json
import os
import uuid

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..crs.model import WGS84, Crs
from ..functions.columns import bbox_of, iso_timestamp, type_name
from ..functions.geometry import raw_at
from ..operators.core import FID, GEOMETRY, columns_of
from .features import expand
from .textual import FormatError


def footer(path: str) -> tuple[dict | None, list[str]]:
    """The ``geo`` value of a file (or of the first file of a folder) and its columns."""
    first = next((p for p in expand(path) if p.endswith(".parquet")), None)
    if first is None:
        raise FormatError(f"no Parquet file is at {path}")
    schema = pq.read_schema(first)
    raw = (schema.metadata or {}).get(b"geo")
    geo = json.loads(raw) if raw else None
    for name, meta in ((geo or {}).get("columns") or {}).items():
        if meta.get("crs"):
            meta["crs"] = raw_at(raw.decode(), ["columns", name, "crs"])  # kept as it was written
    return geo, schema.names


def geometry_column(geo: dict | None, names: list[str]) -> str:
    if geo:
        columns = list(geo.get("columns") or {})
        if len(columns) > 1:
            raise FormatError("more than one geometry column: " + ", ".join(columns))
        return geo.get("primary_column") or columns[0]
    if GEOMETRY in names:
        return GEOMETRY
    raise FormatError("the Parquet file has no geometry column")


def crs_of_geo(geo: dict | None, column: str) -> Crs | None:
    if not geo:
        return None
    meta = geo["columns"].get(column, {})
    if "crs" not in meta:
        return WGS84
    return Crs.of_definition(meta["crs"]) if meta["crs"] else None


def covering_roots(geo: dict | None, column: str) -> set[str]:
    boxes = ((geo or {}).get("columns", {}).get(column, {}).get("covering") or {}).get("bbox") or {}
    return {v[0] for v in boxes.values()}


def _parity(c: str, kind: T.DataType):
    """A column as the four property types; lists as JSON text."""
    col = F.col(f"`{c}`")
    if isinstance(kind, T.DecimalType):
        return col.cast("string")
    if isinstance(kind, T.DateType):
        return F.date_format(col, "yyyy-MM-dd")
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        return iso_timestamp(col.cast("timestamp"))
    if isinstance(kind, T.ByteType | T.ShortType | T.IntegerType):
        return col.cast("bigint")
    if isinstance(kind, T.FloatType):
        return col.cast("double")
    if isinstance(kind, T.BinaryType):
        return F.lower(F.hex(col))
    if isinstance(kind, T.ArrayType | T.StructType | T.MapType):
        return F.to_json(col)
    return col


def read(spark: SparkSession, path: str, bbox: tuple[float, float, float, float] | None = None) -> tuple[DataFrame, Crs | None]:
    """Features and CRS. ``bbox`` filters by a covering column where the file has one; the filter reaches the scan."""
    geo, names = footer(path)
    column = geometry_column(geo, names)
    roots = covering_roots(geo, column)
    df = spark.read.parquet(path)
    if bbox and roots:
        r = next(iter(roots))
        df = df.where((F.col(f"{r}.xmax") >= bbox[0]) & (F.col(f"{r}.ymax") >= bbox[1]) & (F.col(f"{r}.xmin") <= bbox[2]) & (F.col(f"{r}.ymin") <= bbox[3]))
    kept = [f for f in df.schema.fields if f.name not in roots and f.name != column]
    properties = [_parity(f.name, f.dataType).alias(f.name) for f in kept]
    return df.select(F.monotonically_increasing_id().alias(FID), *properties, F.col(f"`{column}`").alias(GEOMETRY)), crs_of_geo(geo, column)


def geo_value(features: DataFrame, crs: Crs | None) -> dict:
    """The ``geo`` key: bounds and types in one aggregate."""
    found = F.sort_array(F.collect_set("type")).alias("types")
    b = features.select(type_name(F.col(GEOMETRY)).alias("type"), bbox_of(F.col(GEOMETRY)).alias("b")).agg(found, *[f(f"b.{n}").alias(n) for n, f in (("minx", F.min), ("miny", F.min), ("maxx", F.max), ("maxy", F.max), ("minz", F.min), ("maxz", F.max))]).first()
    meta: dict = {"encoding": "WKB", "geometry_types": list(b.types)}
    if b.minx is not None:
        meta["bbox"] = [b.minx, b.miny, b.maxx, b.maxy] if b.minz is None else [b.minx, b.miny, b.minz, b.maxx, b.maxy, b.maxz]
    if crs is None:
        meta["crs"] = None
    elif (found := crs.as_projjson()) is not None:
        meta["crs"] = found
    return {"version": "1.1.0", "primary_column": GEOMETRY, "columns": {GEOMETRY: meta}}


class GeoParquetSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "terraloom_geoparquet"

    def writer(self, schema, overwrite) -> DataSourceArrowWriter:
        return GeoParquetWriter(self.options["path"], self.options["geo"], schema)


class GeoParquetWriter(DataSourceArrowWriter):
    """One file for each task, under a name of its own; the driver removes what an aborted job left."""

    def __init__(self, path: str, geo: str, schema: T.StructType):
        self.path, self.geo, self.schema = path, geo, schema

    def write(self, batches) -> WriterCommitMessage:
        from pyspark import TaskContext

        os.makedirs(self.path, exist_ok=True)
        name = os.path.join(self.path, f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.parquet")
        writer = None
        for b in batches:
            if writer is None:
                schema = b.schema.with_metadata({**(b.schema.metadata or {}), b"geo": self.geo.encode()})
                writer = pq.ParquetWriter(f"{name}.tmp", schema, compression="snappy")
            writer.write_table(pa.Table.from_batches([b.cast(schema)] if hasattr(b, "cast") else [b]).replace_schema_metadata(schema.metadata))
        if writer is None:
            return _Written("")
        writer.close()
        return _Written(name)

    def commit(self, messages) -> None:
        for m in messages:
            if m and m.path:
                os.replace(f"{m.path}.tmp", m.path)
        if not any(m and m.path for m in messages):  # no features: a file without rows says what there would be
            os.makedirs(self.path, exist_ok=True)
            empty = to_arrow_schema(self.schema).empty_table().replace_schema_metadata({b"geo": self.geo.encode()})
            pq.write_table(empty, os.path.join(self.path, f"part-00000-{uuid.uuid4().hex}.parquet"))

    def abort(self, messages) -> None:
        for m in messages:
            if m and m.path and os.path.exists(f"{m.path}.tmp"):
                os.remove(f"{m.path}.tmp")


class _Written(WriterCommitMessage):
    def __init__(self, path: str):
        self.path = path


def write(features: DataFrame, path: str, crs: Crs | None) -> None:
    """A folder of GeoParquet files, one for each partition."""
    spark = features.sparkSession
    spark.dataSource.register(GeoParquetSource)
    out = features.select(*[F.col(f"`{c}`") for c in columns_of(features)], GEOMETRY).persist(StorageLevel.DISK_ONLY)  # the footer needs all geometries before the first file is written
    try:
        out.write.format("terraloom_geoparquet").mode("append").option("geo", json.dumps(geo_value(out, crs))).save(path)
    finally:
        out.unpersist()
