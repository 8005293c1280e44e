"""Feature frames: a DataFrame with a geometry column, its CRS, and what can be done with both."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from itertools import repeat

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .crs.model import Crs
from .functions import geometry as G
from .functions.columns import type_code
from .operators import core
from .sources import parts


def decoded(batches: Iterator, names: list[str]) -> Iterator[list]:
    """Features of batches of properties and, last, geometries."""
    for b in batches:
        values = [c.to_pylist() for c in b.columns]
        shapes = [None if g is None else G.from_wkb(g) for g in values.pop()]
        rows = zip(*values, strict=True) if values else repeat(())
        yield [(list(zip(names, row, strict=True)), g) for g, row in zip(shapes, rows, strict=False)]


@dataclass(frozen=True)
class FeatureFrame:
    """``df`` has _fid, typed property columns and geometry (ISO WKB)."""

    df: DataFrame
    crs: Crs | None = None
    layer: str = ""

    def with_crs(self, crs: Crs | None) -> FeatureFrame:
        """Relabelled; coordinates stay."""
        return replace(self, crs=crs)

    def sort_hilbert(self) -> FeatureFrame:
        return replace(self, df=core.sort_hilbert(self.df))

    def map_positions(self, f: Callable, crs: Crs | None) -> FeatureFrame:
        """Positions replaced by ``f`` of (n, 4) arrays, run by run; the caller says which CRS they are in now."""
        return replace(self, df=core.map_positions(self.df, f), crs=crs)

    def columns(self) -> list[str]:
        return core.columns_of(self.df)

    def bounds(self) -> DataFrame:
        return core.bounds(self.df)

    def has_m(self) -> bool:
        """Whether any geometry has measures, by the headers."""
        return bool(self.df.agg(F.bool_or((type_code(F.col(core.GEOMETRY)) / 1000).cast("int").isin(2, 3)).alias("m")).first().m)

    def stored(self, into: str, write: Callable[[Iterator[list], str], dict]) -> list[tuple[str, dict]]:
        """Let ``write`` make a file of the features of each partition (lists of them, by batches), on the executors; see ``parts.store``."""
        names = self.columns()
        return parts.store(self.plain(), into, lambda batches, path: write(decoded(batches, names), path))

    def plain(self) -> DataFrame:
        """Properties and, last, the geometry."""
        return self.df.select(*[F.col(f"`{n}`") for n in self.columns()], core.GEOMETRY)

    def store_texts(self, into: str, form) -> list[tuple[str, dict]]:
        """Texts of features, as files of the executors."""

        def write(batches, path):
            n, between = 0, form.between.encode()
            with open(path, "wb") as out:
                for found in batches:
                    if found:
                        out.write((between if n else b"") + form.between.join(map(form.each, found)).encode())
                        n += len(found)
            return {"n": n}

        return self.stored(into, write)

    def features(self) -> Iterator[tuple[list[tuple[str, object]], G.Geometry | None]]:
        """Features on the driver, in order, a partition at a time: for formats of a single file."""
        names = self.columns()
        for r in self.df.toLocalIterator(prefetchPartitions=True):
            yield [(n, r[n]) for n in names], G.from_wkb(bytes(r[core.GEOMETRY])) if r[core.GEOMETRY] is not None else None
