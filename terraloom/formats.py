"""Formats and what they can carry."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import PurePath


@dataclass(frozen=True)
class Format:
    """A file format: names it goes by, extension, and what its files hold."""

    name: str
    title: str
    extension: str
    aliases: tuple[str, ...]
    z: bool = True
    m: bool = True
    crs: str = "none"
    layers: bool = False
    keeps_properties: bool = True


GEOJSON = Format("geojson", "GeoJSON", "geojson", ("json",), m=False, crs="fixed WGS 84")
GEOPARQUET = Format("geoparquet", "GeoParquet", "parquet", ("parquet",), crs="PROJJSON")
FLATGEOBUF = Format("flatgeobuf", "FlatGeobuf", "fgb", ("fgb",), crs="code and WKT")
CSV = Format("csv", "CSV", "csv", ())
WKT = Format("wkt", "WKT", "wkt", (), keeps_properties=False)
GEOPACKAGE = Format("geopackage", "GeoPackage", "gpkg", ("gpkg",), crs="WKT", layers=True)
SHAPEFILE = Format("shapefile", "Shapefile", "shp", ("shp",), crs="WKT")
KML = Format("kml", "KML", "kml", (), m=False, crs="fixed WGS 84")
KMZ = Format("kmz", "KMZ", "kmz", (), m=False, crs="fixed WGS 84")

FORMATS = (GEOJSON, GEOPARQUET, FLATGEOBUF, CSV, WKT, GEOPACKAGE, SHAPEFILE, KML, KMZ)


def format_of(name: str) -> Format:
    """The format of a name, alias or extension, in any case."""
    low = name.lower().lstrip(".")
    for f in FORMATS:
        if low in (f.name, f.extension, *f.aliases):
            return f
    raise ValueError(f"unknown format: {name}")


def format_of_path(path: str) -> Format:
    suffix = PurePath(path).suffix
    if not suffix:
        raise ValueError(f"{path} has no extension; name its format")
    return format_of(suffix)
