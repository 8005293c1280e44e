from terraloom.crs.definitions import METHODS, projjson_of_wkt, wkt_id, wkt_of_projjson
from terraloom.crs.model import WGS84, WGS84_WKT, Crs, distinct_codes
from terraloom.formats import CSV, FLATGEOBUF, GEOJSON, GEOPACKAGE, GEOPARQUET, SHAPEFILE, format_of

UTM = 'PROJCS["WGS 84 / UTM zone 33N",' + WGS84_WKT + ',PROJECTION["Transverse_Mercator"],PARAMETER["latitude_of_origin",0],PARAMETER["central_meridian",15],PARAMETER["scale_factor",0.9996],PARAMETER["false_easting",500000],PARAMETER["false_northing",0],UNIT["metre",1],AUTHORITY["EPSG","32633"]]'


def test_identity():
    assert Crs.of_code("EPSG", "4326") == WGS84 == Crs.of_code("ogc", "crs84")
    assert Crs.of_definition(WGS84_WKT) == WGS84
    assert Crs.of_definition(UTM).authority_code() == "EPSG:32633"
    assert wkt_id(UTM) == ("EPSG", "32633")
    assert Crs.of_code("NONE", "1").authority_code() is None


AXES = 'AXIS["Easting",EAST],AXIS["Northing",NORTH],AUTHORITY["EPSG","32633"]]'
WITH_AXES = UTM.replace('AUTHORITY["EPSG","32633"]]', AXES)


def test_axes_that_wkt_doesnt_name_are_not_guessed():
    # some transverse Mercator systems point south or west
    assert projjson_of_wkt(UTM) is None and projjson_of_wkt(WITH_AXES) is not None
    assert "id only" in Crs.of_definition(UTM).loss(GEOPARQUET)
    new_zealand = UTM.replace("Transverse_Mercator", "New_Zealand_Map_Grid").replace('PARAMETER["scale_factor",0.9996],', "")
    assert [a["direction"] for a in projjson_of_wkt(new_zealand)["coordinate_system"]["axis"]] == ["east", "north"]


def test_every_method_there_and_back():
    assert len(METHODS) == 25
    for name, full, code, parameters in METHODS:
        body = ",".join(f'PARAMETER["{p[0]}",{i + 1}]' for i, p in enumerate(parameters))
        text = f'PROJCS["x",{WGS84_WKT},PROJECTION["{name}"],{body},UNIT["US survey foot",0.304800609601219],AXIS["X",EAST],AXIS["Y",NORTH],AUTHORITY["EPSG","1"]]'
        value = projjson_of_wkt(text)
        assert value["conversion"]["method"] == {"name": full, "id": {"authority": "EPSG", "code": code}}
        assert [(p["name"], p["value"], p["id"]["code"]) for p in value["conversion"]["parameters"]] == [(p[1], i + 1, p[2]) for i, p in enumerate(parameters)]
        foot = {"type": "LinearUnit", "name": "US survey foot", "conversion_factor": 0.304800609601219}
        assert all(a["unit"] == foot for a in value["coordinate_system"]["axis"]) and all(p["unit"] == foot for p, own in zip(value["conversion"]["parameters"], parameters, strict=True) if own[3] == "length")
        assert projjson_of_wkt(wkt_of_projjson(value)) == value


def test_wkt_to_projjson_and_back():
    value = projjson_of_wkt(WITH_AXES)
    assert value["type"] == "ProjectedCRS" and value["id"]["code"] == 32633
    assert value["base_crs"]["datum"]["ellipsoid"]["semi_major_axis"] == 6378137
    back = wkt_of_projjson(value)
    assert 'PROJECTION["Transverse_Mercator"]' in back and projjson_of_wkt(back)["conversion"]["parameters"] == value["conversion"]["parameters"]


def test_declined():
    assert projjson_of_wkt(UTM.replace("Transverse_Mercator", "Unknown")) is None
    assert projjson_of_wkt('UNIT["metre",1],') is None
    assert wkt_of_projjson({"type": "GeographicCRS", "name": "x", "datum_ensemble": {}}) is None


def test_losses():
    utm = Crs.of_definition(WITH_AXES)
    assert utm.loss(GEOPARQUET) is None and utm.loss(GEOPACKAGE) is None and utm.loss(SHAPEFILE) is None
    assert "mislabelled" in utm.loss(GEOJSON) and "dropped" in utm.loss(CSV)
    assert "id only" in Crs.of_code("EPSG", "2154").loss(GEOPARQUET)
    assert "integers" in Crs.of_code("X", "ab").loss(FLATGEOBUF)
    assert distinct_codes([utm, None, WGS84, utm]) == ["EPSG:32633", "OGC:CRS84"]


def test_formats():
    assert format_of("JSON") is GEOJSON and format_of("gpkg") is GEOPACKAGE and format_of(".parquet") is GEOPARQUET
    assert not GEOJSON.m and SHAPEFILE.m
