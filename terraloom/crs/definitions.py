"""WKT definitions as trees, and their translation to and from PROJJSON for geographic and projected systems.

A translation that can't be certain (unknown method, missing axis order for methods where it matters, unusual units) is declined: None.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

_TOKEN = re.compile(r'\s*(?:"((?:[^"]|"")*)"|([A-Za-z_][A-Za-z0-9_]*)|([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)|([\[\](),]))')

#: WKT1 method name, PROJJSON name, EPSG code; parameters as (WKT1, PROJJSON, EPSG code, kind of unit).
_LAT0 = ("latitude_of_origin", "Latitude of natural origin", 8801, "angle")
_LON0 = ("central_meridian", "Longitude of natural origin", 8802, "angle")
_K0 = ("scale_factor", "Scale factor at natural origin", 8805, "scale")
_FE, _FN = ("false_easting", "False easting", 8806, "length"), ("false_northing", "False northing", 8807, "length")
_SP1, _SP2 = ("standard_parallel_1", "Latitude of 1st standard parallel", 8823, "angle"), ("standard_parallel_2", "Latitude of 2nd standard parallel", 8824, "angle")
_FLAT, _FLON = ("latitude_of_origin", "Latitude of false origin", 8821, "angle"), ("central_meridian", "Longitude of false origin", 8822, "angle")
_FFE, _FFN = ("false_easting", "Easting at false origin", 8826, "length"), ("false_northing", "Northing at false origin", 8827, "length")
_CENTRE = ("latitude_of_center", "Latitude of projection centre", 8811, "angle"), ("longitude_of_center", "Longitude of projection centre", 8812, "angle")
_AZIMUTH, _KC = ("azimuth", "Azimuth at projection centre", 8813, "angle"), ("scale_factor", "Scale factor at projection centre", 8815, "scale")
_CFE, _CFN = ("false_easting", "Easting at projection centre", 8816, "length"), ("false_northing", "Northing at projection centre", 8817, "length")


def _named(*parameters):
    """Parameters that WKT1 calls by their full names too."""
    return tuple((name, name, code, kind) for _, name, code, kind in parameters)


METHODS = (
    ("Transverse_Mercator", "Transverse Mercator", 9807, (_LAT0, _LON0, _K0, _FE, _FN)),
    ("Mercator_1SP", "Mercator (variant A)", 9804, (_LAT0, _LON0, _K0, _FE, _FN)),
    ("Lambert_Conformal_Conic_1SP", "Lambert Conic Conformal (1SP)", 9801, (_LAT0, _LON0, _K0, _FE, _FN)),
    ("Lambert_Conformal_Conic_2SP", "Lambert Conic Conformal (2SP)", 9802, (_FLAT, _FLON, _SP1, _SP2, _FFE, _FFN)),
    ("Albers_Conic_Equal_Area", "Albers Equal Area", 9822, (("latitude_of_center", "Latitude of false origin", 8821, "angle"), ("longitude_of_center", "Longitude of false origin", 8822, "angle"), _SP1, _SP2, _FFE, _FFN)),
    ("Lambert_Azimuthal_Equal_Area", "Lambert Azimuthal Equal Area", 9820, (("latitude_of_center", *_LAT0[1:]), ("longitude_of_center", *_LON0[1:]), _FE, _FN)),
    ("Oblique_Stereographic", "Oblique Stereographic", 9809, (_LAT0, _LON0, _K0, _FE, _FN)),
    ("Polar_Stereographic", "Polar Stereographic (variant A)", 9810, (_LAT0, _LON0, _K0, _FE, _FN)),
    ("Cassini_Soldner", "Cassini-Soldner", 9806, (_LAT0, _LON0, _FE, _FN)),
    ("Hotine_Oblique_Mercator", "Hotine Oblique Mercator (variant A)", 9812, (("latitude_of_center", "Latitude of projection centre", 8811, "angle"), ("longitude_of_center", "Longitude of projection centre", 8812, "angle"), ("azimuth", "Azimuth at projection centre", 8813, "angle"), ("rectified_grid_angle", "Angle from Rectified to Skew Grid", 8814, "angle"), ("scale_factor", "Scale factor at projection centre", 8815, "scale"), _FE, _FN)),
    ("Polyconic", "American Polyconic", 9818, (_LAT0, _LON0, _FE, _FN)),
    ("Bonne_(South_Orientated)", "Bonne (South Orientated)", 9828, _named(_LAT0, _LON0, _FE, _FN)),
    ("Equirectangular", "Equidistant Cylindrical", 1028, (_SP1, _LON0, _FE, _FN)),
    ("Hotine_Oblique_Mercator_Azimuth_Center", "Hotine Oblique Mercator (variant B)", 9815, (*_CENTRE, _AZIMUTH, ("rectified_grid_angle", "Angle from Rectified to Skew Grid", 8814, "angle"), _KC, _CFE, _CFN)),
    ("Laborde_Oblique_Mercator", "Laborde Oblique Mercator", 9813, (*_CENTRE, _AZIMUTH, _KC, _FE, _FN)),
    ("Lambert_Conformal_Conic_2SP_Belgium", "Lambert Conic Conformal (2SP Belgium)", 9803, (_FLAT, _FLON, _SP1, _SP2, _FFE, _FFN)),
    ("Lambert_Conic_Conformal_(West_Orientated)", "Lambert Conic Conformal (West Orientated)", 9826, _named(_LAT0, _LON0, _K0, _FE, _FN)),
    ("Lambert_Conic_Near-Conformal", "Lambert Conic Near-Conformal", 9817, _named(_LAT0, _LON0, _K0, _FE, _FN)),
    ("Local Orthographic", "Local Orthographic", 1130, (*_CENTRE, _AZIMUTH, _KC, _CFE, _CFN)),
    ("Mercator_2SP", "Mercator (variant B)", 9805, (_SP1, _LON0, _FE, _FN)),
    ("New_Zealand_Map_Grid", "New Zealand Map Grid", 9811, (_LAT0, _LON0, _FE, _FN)),
    ("Polar_Stereographic_(variant_C)", "Polar Stereographic (variant C)", 9830, _named(("", "Latitude of standard parallel", 8832, "angle"), ("", "Longitude of origin", 8833, "angle"), _FFE, _FFN)),
    ("Transverse_Mercator_South_Orientated", "Transverse Mercator (South Orientated)", 9808, (_LAT0, _LON0, _K0, _FE, _FN)),
    ("Transverse_Mercator_Zoned_Grid_System", "Transverse Mercator Zoned Grid System", 9824, _named(_LAT0, ("", "Initial longitude", 8830, "angle"), ("", "Zone width", 8831, "angle"), _K0, _FE, _FN)),
    ("Tunisia_Mining_Grid", "Tunisia Mining Grid", 9816, (_FLAT, _FLON, _FFE, _FFN)),
)
#: Methods whose axes are east, north when WKT1 names none: none of their systems points south or west.
PLAIN_AXES = {"Equirectangular", "Hotine_Oblique_Mercator", "Lambert_Conformal_Conic_2SP_Belgium", "Lambert_Conic_Near-Conformal", "Local Orthographic", "New_Zealand_Map_Grid", "Polyconic", "Transverse_Mercator_Zoned_Grid_System", "Tunisia_Mining_Grid"}


class WktError(ValueError):
    pass


@dataclass
class Node:
    name: str
    values: list[Any] = field(default_factory=list)

    def all(self, *names: str) -> list[Node]:
        return [v for v in self.values if isinstance(v, Node) and v.name in names]

    def get(self, *names: str) -> Node | None:
        return next(iter(self.all(*names)), None)


def parse_wkt(text: str) -> Node:
    tokens, at, body = [], 0, text.rstrip()
    while at < len(body):
        m = _TOKEN.match(body, at)
        if not m:
            raise WktError(f"unexpected text in WKT at {at}")
        quoted, word, number, mark = m.groups()
        tokens.append(("s", quoted.replace('""', '"')) if quoted is not None else ("w", word) if word else ("n", number) if number else ("m", mark))
        at = m.end()
    node, end = _node(tokens, 0)
    if end != len(tokens):
        raise WktError("text behind the WKT definition")
    return node


def _node(tokens, i):
    if i >= len(tokens) or tokens[i][0] != "w":
        raise WktError("a WKT keyword is missing")
    node = Node(tokens[i][1].upper())
    i += 1
    if i >= len(tokens) or tokens[i] not in (("m", "["), ("m", "(")):
        return node, i
    i += 1
    while True:
        if i >= len(tokens):
            raise WktError("WKT ends within brackets")
        kind, value = tokens[i]
        if kind == "w":
            inner, i = _node(tokens, i)
            node.values.append(inner if inner.values else inner.name)
        elif kind in "sn":
            node.values.append(value if kind == "s" else float(value))
            i += 1
        else:
            raise WktError("WKT has a bracket where a value is expected")
        if i < len(tokens) and tokens[i] == ("m", ","):
            i += 1
        elif i < len(tokens) and tokens[i] in (("m", "]"), ("m", ")")):
            return node, i + 1
        else:
            raise WktError("WKT lacks a closing bracket")


def _number(v: float) -> int | float:
    return int(v) if float(v).is_integer() and abs(v) < 1e15 else v


def wkt_id(text: str) -> tuple[str, str] | None:
    """Authority and code: of all ids the shallowest, the last of those at its depth."""
    try:
        level = [parse_wkt(text)]
    except WktError:
        return None
    while level:
        ids = [v for n in level for v in n.all("AUTHORITY", "ID") if len(v.values) >= 2]
        if ids:
            authority, code = ids[-1].values[:2]
            return str(authority), str(_number(code) if isinstance(code, float) else code)
        level = [v for n in level for v in n.values if isinstance(v, Node)]
    return None


def _id(node: Node) -> dict:
    found = node.get("AUTHORITY", "ID")
    if not found or len(found.values) < 2:
        return {}
    authority, code = found.values[:2]
    code = _number(code) if isinstance(code, float) else int(code) if str(code).isdigit() else code
    return {"id": {"authority": str(authority), "code": code}}


def _geographic(node: Node) -> dict | None:
    datum, ensemble = node.get("DATUM", "GEODETICDATUM", "TRF"), node.get("ENSEMBLE")
    base = datum or ensemble
    ellipsoid = base and base.get("SPHEROID", "ELLIPSOID")
    if not base or not ellipsoid or len(ellipsoid.values) < 3:
        return None
    shape = {"name": ellipsoid.values[0], "semi_major_axis": _number(ellipsoid.values[1]), "inverse_flattening": _number(ellipsoid.values[2]), **_id(ellipsoid)}
    out: dict = {"$schema": "https://proj.org/schemas/v0.7/projjson.schema.json", "type": "GeographicCRS", "name": node.values[0]}
    name = str(base.values[0])
    if ensemble:
        out["datum_ensemble"] = {"name": name, "members": [{"name": m.values[0], **_id(m)} for m in ensemble.all("MEMBER")], "ellipsoid": shape, "accuracy": str(_number(ensemble.get("ENSEMBLEACCURACY").values[0])) if ensemble.get("ENSEMBLEACCURACY") else "", **_id(ensemble)}
    else:
        frame: dict = {"type": "GeodeticReferenceFrame", "name": name.replace("_", " ") if node.name == "GEOGCS" else name, "ellipsoid": shape, **_id(base)}
        meridian = node.get("PRIMEM", "PRIMEMERIDIAN")
        if meridian and len(meridian.values) > 1 and meridian.values[1]:
            frame["prime_meridian"] = {"name": meridian.values[0], "longitude": _number(meridian.values[1]), **_id(meridian)}
        out["datum"] = frame
    out["coordinate_system"] = {"subtype": "ellipsoidal", "axis": [{"name": "Geodetic latitude", "abbreviation": "Lat", "direction": "north", "unit": "degree"}, {"name": "Geodetic longitude", "abbreviation": "Lon", "direction": "east", "unit": "degree"}]}
    unit = node.get("UNIT", "ANGLEUNIT")
    if unit and len(unit.values) > 1 and abs(unit.values[1] - 0.0174532925199433) > 1e-12:
        return None
    return out | _id(node)


_UNIT_TYPES = {"ANGLEUNIT": "AngularUnit", "SCALEUNIT": "ScaleUnit", "LENGTHUNIT": "LinearUnit", "UNIT": "LinearUnit"}


def _unit_of(unit: Node | None, default: str) -> str | dict | None:
    """The unit of a UNIT node as PROJJSON writes it; None if its factor is missing."""
    if unit is None:
        return default
    name = str(unit.values[0])
    if name.lower() in ("degree", "metre", "meter", "unity"):
        return {"meter": "metre"}.get(name.lower(), name.lower())
    factors = [v for v in unit.values[1:] if not isinstance(v, Node)]
    return {"type": _UNIT_TYPES[unit.name], "name": name, "conversion_factor": _number(factors[0])} if factors else None


def projjson_of_wkt(text: str) -> dict | None:
    """PROJJSON of WKT1 or WKT2, or None if it can't be told for certain."""
    try:
        node = parse_wkt(text)
    except WktError:
        return None
    if node.name in ("GEOGCS", "GEOGCRS", "GEODCRS", "GEOGRAPHICCRS"):
        return _geographic(node)
    if node.name not in ("PROJCS", "PROJCRS", "PROJECTEDCRS"):
        return None
    base = node.get("GEOGCS", "BASEGEOGCRS", "BASEGEODCRS", "GEOGCRS")
    inner = _geographic(base) if base else None
    if inner is None:
        return None
    inner.pop("$schema")
    length = _unit_of(node.get("UNIT", "LENGTHUNIT"), "metre")
    if length is None:
        return None
    units = {"angle": "degree", "length": length, "scale": "unity"}
    if node.name == "PROJCS":
        method = node.get("PROJECTION")
        known = method and next((m for m in METHODS if m[0].lower() == str(method.values[0]).lower()), None)
        if not known or not node.all("AXIS") and known[0] not in PLAIN_AXES:
            return None
        given = {str(p.values[0]).lower(): p.values[1] for p in node.all("PARAMETER") if len(p.values) > 1}
        if set(given) != {p[0].lower() for p in known[3]}:
            return None
        parameters = [{"name": p[1], "value": _number(given[p[0].lower()]), "unit": units[p[3]], "id": {"authority": "EPSG", "code": p[2]}} for p in known[3]]
        conversion = {"name": "unnamed", "method": {"name": known[1], "id": {"authority": "EPSG", "code": known[2]}}, "parameters": parameters}
    else:
        c = node.get("CONVERSION")
        method = c and c.get("METHOD", "PROJECTION")
        if not method:
            return None
        parameters = []
        for p in c.all("PARAMETER"):
            u = next((k for k in p.values if isinstance(k, Node) and k.name in ("ANGLEUNIT", "LENGTHUNIT", "SCALEUNIT")), None)
            parameters.append({"name": p.values[0], "value": _number(p.values[1]), "unit": _unit_of(u, "unity"), **_id(p)})
        conversion = {"name": c.values[0], "method": {"name": method.values[0], **_id(method)}, "parameters": parameters, **_id(c)}
    axes = [a for a in node.all("AXIS") if len(a.values) > 1]
    axis = [{"name": re.sub(r"\s*\(.*\)", "", str(a.values[0])) or str(a.values[0]), "abbreviation": (re.search(r"\((.*)\)", str(a.values[0])) or [None, str(a.values[0])[:1].upper()])[1], "direction": str(a.values[1].name if isinstance(a.values[1], Node) else a.values[1]).lower(), "unit": _unit_of(a.get("LENGTHUNIT"), length)} for a in axes]
    axis = axis or [{"name": "Easting", "abbreviation": "E", "direction": "east", "unit": length}, {"name": "Northing", "abbreviation": "N", "direction": "north", "unit": length}]
    return {"$schema": "https://proj.org/schemas/v0.7/projjson.schema.json", "type": "ProjectedCRS", "name": node.values[0], "base_crs": inner, "conversion": conversion, "coordinate_system": {"subtype": "Cartesian", "axis": axis}} | _id(node)


def _quoted(s: str) -> str:
    return '"' + str(s).replace('"', '""') + '"'


def _text(v: float) -> str:
    from ..functions.geometry import number_text

    return number_text(v)


def _authority(value: dict) -> str:
    ident = value.get("id")
    return f",AUTHORITY[{_quoted(ident['authority'])},{_quoted(ident['code'])}]" if ident else ""


def wkt_of_projjson(value: dict) -> str | None:
    """WKT1 of a geographic or projected system, or None if WKT1 can't express it."""
    try:
        if value.get("type") == "GeographicCRS":
            datum = value.get("datum")
            if not datum:
                return None
            e = datum["ellipsoid"]
            flattening = e["inverse_flattening"] if "inverse_flattening" in e else 0 if e.get("semi_minor_axis") in (None, e["semi_major_axis"]) else e["semi_major_axis"] / (e["semi_major_axis"] - e["semi_minor_axis"])
            meridian = datum.get("prime_meridian") or {"name": "Greenwich", "longitude": 0}
            spheroid = f"SPHEROID[{_quoted(e['name'])},{_text(e['semi_major_axis'])},{_text(flattening)}{_authority(e)}]"
            return f"GEOGCS[{_quoted(value['name'])},DATUM[{_quoted(datum['name'].replace(' ', '_'))},{spheroid}{_authority(datum)}],PRIMEM[{_quoted(meridian['name'])},{_text(meridian['longitude'])}],UNIT[\"degree\",0.0174532925199433]{_authority(value)}]"
        if value.get("type") == "ProjectedCRS":
            base = wkt_of_projjson({"type": "GeographicCRS", **value["base_crs"]})
            method = value["conversion"]["method"]["name"]
            known = next((m for m in METHODS if m[1] == method), None)
            units = [a.get("unit", "metre") for a in value["coordinate_system"]["axis"]]
            if base is None or known is None or any(u != units[0] for u in units):
                return None
            name, factor = ("metre", 1) if units[0] == "metre" else (units[0]["name"], units[0]["conversion_factor"])
            given = {p["name"]: p for p in value["conversion"]["parameters"]}
            if set(given) != {p[1] for p in known[3]}:
                return None
            if any(p[3] == "length" and given[p[1]].get("unit", "metre") != units[0] for p in known[3]):
                return None
            parameters = ",".join(f"PARAMETER[{_quoted(p[0])},{_text(given[p[1]]['value'])}]" for p in known[3])
            axes = ",".join(f"AXIS[{_quoted(a['name'])},{a['direction'].upper()}]" for a in value["coordinate_system"]["axis"])
            return f"PROJCS[{_quoted(value['name'])},{base},PROJECTION[{_quoted(known[0])}],{parameters},UNIT[{_quoted(name)},{_text(factor)}],{axes}{_authority(value)}]"
    except (KeyError, TypeError):
        return None
    return None
