"""Command line: ``python -m terraloom.cli SOURCE TARGET`` and CRS diagnostics."""

from __future__ import annotations

import argparse
import os
import sqlite3
import sys
import tempfile

from pyspark.errors import PySparkException

from .convert import ConversionError, convert
from .crs.model import Crs, distinct_codes, single_definition
from .formats import GEOPARQUET, SHAPEFILE, format_of, format_of_path
from .functions.columns import visible


def arguments(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="terraloom", description="Convert vector geospatial files; relabel, reorder, and tell what gets lost.")
    p.add_argument("source")
    p.add_argument("target", nargs="?")
    p.add_argument("--from", dest="from_", help="format of the source")
    p.add_argument("--to", help="format of the target")
    p.add_argument("--layer", help="the layer to read, or the name of the one to write")
    p.add_argument("--crs", help="file with a WKT or PROJJSON definition that replaces the CRS")
    p.add_argument("--sort-hilbert", action="store_true")
    p.add_argument("--rtree", action="store_true", help="add a spatial index (GeoPackage)")
    p.add_argument("--envelope", action="store_true", help="add envelopes to geometries (GeoPackage)")
    p.add_argument("--print-crs-code", action="store_true")
    p.add_argument("--print-crs", action="store_true")
    p.add_argument("--escape", action="store_true", help="with --print-crs: control characters in a visible form")
    p.add_argument("--progress", action="store_true")
    p.add_argument("--quiet", "--no-warn", action="store_true")
    a = p.parse_args(argv)
    diagnostic = a.print_crs or a.print_crs_code
    if a.print_crs and a.print_crs_code:
        p.error("--print-crs and --print-crs-code exclude each other")
    if a.escape and not a.print_crs:
        p.error("--escape goes with --print-crs")
    if diagnostic and a.target:
        p.error("CRS diagnostics take no target")
    if not diagnostic and not a.target:
        p.error("a target is missing")
    if a.crs == "-" and a.source == "-":
        p.error("only one input can be the standard input")
    for name, f in ((a.source, a.from_), (a.target, a.to)):
        if name == "-" and not f:
            p.error("the standard streams need --from and --to")
        if name == "-" and format_of(f) is SHAPEFILE:
            p.error("a shapefile can't be a stream")
    return a


def crs_by_layer(path: str, f) -> dict[str, Crs | None]:
    if f is GEOPARQUET:
        from .sources import geoparquet

        geo, names = geoparquet.footer(path)
        return {"": geoparquet.crs_of_geo(geo, geoparquet.geometry_column(geo, names))}
    from .sources.features import crs_of

    return crs_of(path, f)


def run(argv: list[str]) -> int:
    a = arguments(argv)
    say = lambda text: print(text, file=sys.stderr)
    with tempfile.TemporaryDirectory() as folder:
        try:
            crs = None
            if a.crs:
                crs = Crs.of_definition(sys.stdin.read() if a.crs == "-" else open(a.crs, encoding="utf-8").read())  # noqa: SIM115
            source = a.source
            f = format_of(a.from_) if a.from_ else format_of_path(source)
            if source == "-":
                source = os.path.join(folder, f"stdin.{f.extension}")
                with open(source, "wb") as out:
                    out.write(sys.stdin.buffer.read())
            if a.print_crs_code or a.print_crs:
                found = crs_by_layer(source, f)
                if a.layer:
                    found = {n: c for n, c in found.items() if n == a.layer}
                if a.print_crs:
                    text = single_definition(found)
                    print(visible(text) if a.escape else text)
                    return 0
                codes = distinct_codes(list(found.values()))
                for c in codes:
                    print(c)
                return 0 if codes else 1
            from .session import local_session

            spark = local_session()
            target = a.target if a.target != "-" else os.path.join(folder, f"stdout.{format_of(a.to).extension}")
            read: list[int] = []

            def told(layer: str, n: int) -> None:
                read.append(n)
                say(f"read {n} features" + (f" of {layer}" if layer else ""))

            if a.progress:
                say(f"reading {a.source}")
            warnings = convert(spark, source, target, from_=f.name, to=a.to, layer=a.layer, crs=crs, sort_hilbert=a.sort_hilbert, rtree=a.rtree, envelope=a.envelope, progress=told if a.progress else None)
            if not a.quiet:
                for w in warnings:
                    say(f"warning: {w}")
            if a.target == "-":
                with open(target, "rb") as made:
                    sys.stdout.buffer.write(made.read())
            elif a.progress:
                say(f"wrote {sum(read)} features in {len(read)} layer{'s' * (len(read) != 1)} to {a.target}")
            return 0
        except (ConversionError, ValueError, OSError, sqlite3.Error, PySparkException) as e:
            say(f"error: {e}")
            return 1


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
