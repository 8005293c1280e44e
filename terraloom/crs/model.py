"""Coordinate reference systems as labels: identity, definition texts, what a format would lose. Nothing is reprojected."""

from __future__ import annotations

import json
from dataclasses import dataclass

from ..formats import CSV, FLATGEOBUF, GEOPACKAGE, GEOPARQUET, KML, KMZ, SHAPEFILE, WKT, Format, GEOJSON
from .definitions import parse_wkt, projjson_of_wkt, wkt_id, wkt_of_projjson

# Words that open a WKT definition.
WKT_WORDS = ("GEOGCS", "PROJCS", "GEOCCS", "VERT_CS", "COMPD_CS", "LOCAL_CS", "GEOGCRS", "GEODCRS", "PROJCRS", "VERTCRS", "COMPOUNDCRS", "ENGCRS", "GEODETICCRS", "GEOGRAPHICCRS", "PROJECTEDCRS", "BOUNDCRS", "TIMECRS", "PARAMETRICCRS", "DERIVEDPROJCRS")


@dataclass(frozen=True)
class Crs:
    """WGS 84 in longitude-latitude order (``wgs84``), or a named system of which any part may be unknown."""

    wgs84: bool = False
    authority: str | None = None
    code: str | None = None
    wkt: str | None = None
    projjson: str | None = None

    @staticmethod
    def of_code(authority: str | None, code: str | None, wkt: str | None = None, projjson: str | None = None) -> Crs:
        """EPSG:4326 and OGC:CRS84 are WGS 84; a blank identity is taken from the WKT."""
        if not authority and not code and wkt:
            authority, code = wkt_id(wkt) or (None, None)
        if (authority or "").upper() == "EPSG" and code == "4326" or (authority or "").upper() == "OGC" and (code or "").upper() == "CRS84":
            return WGS84
        return Crs(False, authority, code, wkt, projjson)

    @staticmethod
    def of_definition(text: str) -> Crs:
        """From PROJJSON (text that opens with a brace) or WKT, which is kept as it is."""
        body = text.strip()
        if body.startswith("{"):
            value = json.loads(body)
            ident = value.get("id") or {}
            return Crs.of_code(str(ident["authority"]) if "authority" in ident else None, str(ident["code"]) if "code" in ident else None, projjson=body)
        if body.upper().startswith(WKT_WORDS):
            parse_wkt(body)
            return Crs.of_code(None, None, wkt=body)
        raise ValueError("a CRS definition is PROJJSON or WKT")

    def authority_code(self) -> str | None:
        if self.wgs84:
            return "OGC:CRS84"
        if self.authority and self.code and self.authority.upper() != "NONE":
            return f"{self.authority}:{self.code}"
        return None

    def body(self) -> str | None:
        """The definition as it came, PROJJSON before WKT."""
        return None if self.wgs84 else self.projjson or self.wkt

    def as_projjson(self) -> dict | None:
        """PROJJSON, translated from WKT if need be; an object with only an id if no definition is known."""
        if self.wgs84:
            return None
        if self.projjson:
            return json.loads(self.projjson)
        if self.wkt and (found := projjson_of_wkt(self.wkt)):
            return found
        if self.authority and self.code:
            return {"id": {"authority": self.authority, "code": int(self.code) if self.code.isdigit() else self.code}}
        return None

    def as_wkt(self) -> str | None:
        if self.wgs84:
            return WGS84_WKT
        if self.wkt:
            return self.wkt
        return wkt_of_projjson(json.loads(self.projjson)) if self.projjson else None

    def loss(self, to: Format) -> str | None:
        """What a format can't hold of this CRS, as a warning; None if nothing is lost."""
        name = self.authority_code() or "a CRS without a code"
        if to in (GEOJSON, KML, KMZ):
            return None if self.wgs84 else f"{to.title} is always WGS 84; coordinates in {name} will be mislabelled"
        if to in (CSV, WKT):
            return f"{to.title} can't hold a CRS; {name} is dropped"
        if self.wgs84:
            return None
        if to is GEOPARQUET:
            known = self.as_projjson()
            if known is None:
                return f"GeoParquet needs PROJJSON; {name} is dropped"
            return f"no definition of {name} is known; GeoParquet gets its id only" if set(known) == {"id"} else None
        if to is FLATGEOBUF:
            if self.code and not self.code.lstrip("-").isdigit():
                return f"FlatGeobuf codes are integers; the code of {name} is dropped"
            return None if self.code or self.wkt else f"FlatGeobuf holds a code or WKT; {name} is dropped"
        if to is GEOPACKAGE:
            return f"GeoPackage ids are integers; {name} gets one of its own" if self.code and not self.code.isdigit() else None
        if to is SHAPEFILE:
            return None if self.as_wkt() else f"no WKT of {name} is known; no .prj is written"
        return None


WGS84 = Crs(wgs84=True)
# Fixed value: the definition of EPSG:4326 in the public EPSG registry, as well-known text of the first kind.
WGS84_WKT = 'GEOGCS["WGS 84",DATUM["WGS_1984",SPHEROID["WGS 84",6378137,298.257223563,AUTHORITY["EPSG","7030"]],AUTHORITY["EPSG","6326"]],PRIMEM["Greenwich",0,AUTHORITY["EPSG","8901"]],UNIT["degree",0.0174532925199433,AUTHORITY["EPSG","9122"]],AUTHORITY["EPSG","4326"]]'


def distinct_codes(found: list[Crs | None]) -> list[str]:
    return list(dict.fromkeys(c for x in found if x and (c := x.authority_code())))


def single_definition(found: dict[str, Crs | None]) -> str:
    """The one definition of all layers; an error names layers that differ."""
    bodies: dict[str, str] = {}
    for layer, crs in found.items():
        if crs and (body := crs.body()):
            bodies.setdefault(body, layer)
    if len(bodies) > 1:
        raise ValueError("layers have different definitions: " + ", ".join(bodies.values()))
    if not bodies:
        raise ValueError("no CRS definition is known")
    return next(iter(bodies))
