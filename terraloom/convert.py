"""Reading any format into feature frames and writing them in any other, with warnings of what gets lost."""

from __future__ import annotations

import os
import shutil
import zipfile
from collections.abc import Callable
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .crs.model import Crs
from .formats import CSV, FLATGEOBUF, GEOJSON, GEOPACKAGE, GEOPARQUET, KML, KMZ, SHAPEFILE, WKT, Format, format_of, format_of_path
from .frame import FeatureFrame, decoded
from .operators import core
from .sources import binary, features, geoparquet, parts, textual

SPARK_KINDS = {"boolean": "bool", "bigint": "int", "double": "double", "string": "string"}


class ConversionError(ValueError):
    pass


def read_layers(spark: SparkSession, path: str, f: Format | str | None = None, layer: str | None = None, kept: list[DataFrame] | None = None) -> dict[str, FeatureFrame]:
    """All layers of a file or folder, in their order; formats without layers have one, without a name.

    With a list ``kept``, what is parsed from files is kept by Spark for later jobs (executors that are lost parse again), and added to
    the list; the caller lets go of it by ``unpersist``.
    """

    def raw_of(name: str | None = None) -> DataFrame:
        raw = features.read_raw(spark, path, f, name)
        if kept is None:
            return raw
        kept.append(raw)
        return features.spread(raw)

    f = format_of(f) if isinstance(f, str) else f or format_of_path(path)
    if f is GEOPARQUET:
        df, crs = geoparquet.read(spark, path)
        return {"": FeatureFrame(df, crs)}
    if f is WKT:
        return {"": FeatureFrame(features.read_lines(spark, path))}
    systems = features.crs_of(path, f)
    if f is CSV:
        raw = features.read_csv(spark, path)
        if kept is not None:
            kept.append(raw.persist())
        return {"": FeatureFrame(core.typed_properties(raw), None)}
    if f is not GEOPACKAGE:
        return {"": FeatureFrame(core.typed_properties(raw_of()), systems.get(""))}
    if layer is not None and layer not in systems:
        raise ConversionError(f"{path} has no layer {layer}")
    names = [n for n in systems if layer in (None, n)]
    return {n: FeatureFrame(core.typed_properties(raw_of(n)), systems[n], n) for n in names}


def read(spark: SparkSession, path: str, f: Format | str | None = None, layer: str | None = None) -> FeatureFrame:
    found = read_layers(spark, path, f, layer)
    if len(found) != 1:
        raise ConversionError(f"{path} has {len(found)} layers; name one of {', '.join(found)}")
    return next(iter(found.values()))


def losses(frame: FeatureFrame, to: Format, check_m: bool = True) -> list[str]:
    """Warnings of what ``to`` can't hold. ``check_m`` looks for measures, at the cost of a job."""
    out = []
    if frame.crs and (lost := frame.crs.loss(to)):
        out.append(lost)
    if not to.m and check_m and frame.has_m():
        out.append(f"{to.title} can't hold M values; they are dropped")
    if not to.keeps_properties and frame.columns():
        out.append(f"{to.title} can't hold properties; {len(frame.columns())} columns are dropped")
    return out


def kinds(frame: FeatureFrame) -> list[tuple[str, str]]:
    types = dict(frame.df.dtypes)
    return [(c, SPARK_KINDS.get(types[c], "string")) for c in frame.columns()]


def ordered(df: DataFrame) -> DataFrame:
    return df.orderBy(core.FID) if core.FID in df.columns else df


def write(frame: FeatureFrame, path: str, f: Format | str | None = None, *, rtree: bool = False, envelope: bool = False) -> list[str]:
    """Write a frame; returns warnings of the writer.

    GeoParquet is written by the executors, a file for each partition. Of other formats, which are a single file, the executors write pieces
    (texts, FlatGeobuf's features, records of a Shapefile, databases for a GeoPackage), and the driver moves them into one file.
    """
    f = format_of(f) if isinstance(f, str) else f or format_of_path(path)
    if f is GEOPARQUET:
        if path.endswith(".parquet") and os.path.isdir(path):
            shutil.rmtree(path)
        geoparquet.write(frame.df, path, frame.crs)
        return []
    if f is GEOPACKAGE:
        return write_layers({frame.layer or os.path.splitext(os.path.basename(path))[0]: frame}, path, rtree=rtree, envelope=envelope)
    spark = frame.df.sparkSession
    if f is FLATGEOBUF:
        write_fgb(frame, path)
        return []
    if f is SHAPEFILE:
        df = FeatureFrame(ordered(frame.df)).plain().persist(StorageLevel.DISK_ONLY)
        names = frame.columns()
        try:
            with parts.folder(spark, path) as into:
                return binary.write_shapefile_pieces(os.path.splitext(path)[0], into, lambda write: parts.store(df, into, lambda batches, at: write(decoded(batches, names), at)), kinds(frame), frame.crs)
        finally:
            df.unpersist()
    form = {GEOJSON: textual.GEOJSON_FORM, WKT: textual.WKT_FORM, CSV: textual.csv_form(frame.columns()), KML: textual.KML_FORM, KMZ: textual.KML_FORM}[f]
    ends = (form.head.encode(), form.between.encode(), form.tail.encode())
    with parts.folder(spark, path) as into, open(f"{path}.part", "wb") as out:
        made = frame.store_texts(into, form)
        if f is KMZ:
            with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z, z.open("doc.kml", "w", force_zip64=True) as doc:
                parts.join(doc, made, *ends)
        else:
            parts.join(out, made, *ends)
    os.replace(f"{path}.part", path)
    return []


def write_fgb(frame: FeatureFrame, path: str) -> None:
    """A FlatGeobuf file: encoded once by the executors, sorted by Hilbert value (ties by their order) and written there; the driver makes the tree."""
    columns, names, spark = kinds(frame), frame.columns(), frame.df.sparkSession
    box = ("x0", "y0", "x1", "y1")

    def rows(batches):
        for b in batches:
            values = [c.to_pylist() for c in b.columns]
            shapes = values.pop()
            found = [binary.fgb_row_of_wkb(dict(zip(names, row, strict=True)), g, columns) for g, row in zip(shapes, zip(*values, strict=True) if values else repeat(()), strict=False)]
            if found:
                blobs, boxes, types, z, m = zip(*found, strict=True)
                sides = zip(*(x or [None] * 4 for x in boxes), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary()), *(pa.array(c, pa.float64()) for c in sides), pa.array(types, pa.int32()), pa.array(z), pa.array(m)], names=["blob", *box, "kind", "z", "m"])

    made = frame.plain().mapInArrow(rows, "blob binary, x0 double, y0 double, x1 double, y1 double, kind int, z boolean, m boolean").persist(StorageLevel.DISK_ONLY)
    try:
        told = made.agg(F.count("*").alias("n"), F.count("x0").alias("boxes"), *[f(c).alias(c) for c, f in zip(box, (F.min, F.min, F.max, F.max), strict=True)], F.collect_set("kind").alias("kinds"), F.bool_or("z").alias("z"), F.bool_or("m").alias("m")).first()
        extent = [told[c] for c in box] if told.n and told.boxes == told.n else None
        placed = made
        if extent:

            def curve(a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array) -> pa.Array:
                return pa.array(binary.centre_values(np.stack([x.to_numpy(zero_copy_only=False) for x in (a, b, c, d)], axis=1), extent))

            placed = made.withColumn("h", F.arrow_udf(curve, "bigint")(*map(F.col, box))).withColumn("i", F.monotonically_increasing_id()).orderBy("h", "i")
        with parts.folder(spark, path) as into, open(f"{path}.part", "w+b") as out:
            pieces = parts.store(placed.select("blob", *box), into, binary.fgb_piece)
            header = binary.fgb_header(columns, {k for k in told.kinds if k}, bool(told.z), bool(told.m), told.n, extent, frame.crs)
            binary.join_fgb(out, header, pieces, extent is not None)
    finally:
        made.unpersist()
    os.replace(f"{path}.part", path)


def write_layers(layers: dict[str, FeatureFrame], path: str, *, rtree: bool = False, envelope: bool = False) -> list[str]:
    """Layers into a GeoPackage: those of the same name are replaced and come last, others stay. Executors make databases of the rows, which the driver moves together."""
    spark = next((x.df.sparkSession for x in layers.values()), None) or SparkSession.getActiveSession()
    with parts.folder(spark, path) as into:

        def kept_layer(name: str, column: str, columns: list):
            piece = lambda srs: lambda r, at: binary.gpkg_piece((f for _, f in binary.gpkg_rows(path, name, column, *r)), at, srs, columns, rtree, envelope)
            return lambda srs: parts.store_over(spark, binary.gpkg_ranges(path, name, features.ROWS), into, piece(srs))

        def new_layer(frame: FeatureFrame, columns: list):
            piece = lambda srs: lambda batches, at: binary.gpkg_piece(chain.from_iterable(batches), at, srs, columns, rtree, envelope)
            return lambda srs: frame.stored(into, piece(srs))

        found = []
        if os.path.exists(path):
            for name, column, _, crs in binary.gpkg_layers(path):
                if name not in layers:
                    columns = binary.gpkg_kinds(path, name, column)
                    found.append((name, kept_layer(name, column, columns), columns, crs))
        binary.write_gpkg([*found, *((n, new_layer(x, kinds(x)), kinds(x), x.crs) for n, x in layers.items())], path, rtree)
    return []


def convert(spark: SparkSession, source: str, target: str, *, from_: str | None = None, to: str | None = None, layer: str | None = None, crs: Crs | None = None, sort_hilbert: bool = False, rtree: bool = False, envelope: bool = False, progress: Callable[[str, int], None] | None = None) -> list[str]:
    """Read, relabel, reorder and write; returns all warnings, each once. ``progress`` is told of each layer read, with its number of features."""
    a = format_of(from_) if from_ else format_of_path(source)
    b = format_of(to) if to else format_of_path(target) if os.path.splitext(target)[1] else None
    if b is None:
        raise ConversionError(f"{target} has no extension; name the format with --to")
    if a is b and a is not GEOPACKAGE:
        raise ConversionError(f"source and target are both {a.title}")
    kept: list[DataFrame] = []
    try:
        found = read_layers(spark, source, a, layer, kept)
        for name, frame in found.items() if progress else ():
            progress(name, count(frame))
        return _converted(found, source, target, a, b, layer, crs, sort_hilbert, rtree, envelope)
    finally:
        for df in kept:
            df.unpersist()


def _converted(found: dict[str, FeatureFrame], source: str, target: str, a: Format, b: Format, layer: str | None, crs: Crs | None, sort_hilbert: bool, rtree: bool, envelope: bool) -> list[str]:
    warnings: list[str] = []
    if crs is not None:
        for other in {x.crs for x in found.values() if x.crs and x.crs != crs}:
            warnings.append(f"coordinates in {other.authority_code() or 'another CRS'} are relabelled, not reprojected")
        found = {n: x.with_crs(crs) for n, x in found.items()}
    if sort_hilbert:
        found = {n: x.sort_hilbert() for n, x in found.items()}
    for x in found.values():
        warnings += losses(x, b, a.m)
    if b is GEOPACKAGE:
        stem = os.path.splitext(os.path.basename(source))[0]
        warnings += write_layers({layer or n or stem: x for n, x in found.items()}, target, rtree=rtree, envelope=envelope)
    elif os.path.isdir(target) and not target.endswith(f".{b.extension}"):
        for n, x in found.items():
            warnings += write(x, os.path.join(target, f"{n or 'layer'}.{b.extension}"), b)
    elif len(found) > 1:
        raise ConversionError(f"{source} has {len(found)} layers; name one with --layer or give a folder")
    else:
        warnings += write(next(iter(found.values())), target, b)
    return list(dict.fromkeys(warnings))


def count(frame: FeatureFrame) -> int:
    return frame.df.agg(F.count("*")).first()[0]
