"""Operators on feature DataFrames: schema inference, bounds, ordering, indexes, layers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import bbox_of, hilbert, quantised, type_name

FID, GEOMETRY = "_fid", "geometry"

# ---- schema inference


def json_kind(value: Column) -> Column:
    """bool, int, double or string, of a JSON value as text; null for null. A number is int without point or exponent, if 64 bits hold it."""
    return (
        F.when(value.isNull() | (value == "null"), None)
        .when(value.isin("true", "false"), "bool")
        .when(value.rlike(r"^-?\d+$") & value.try_cast("bigint").isNotNull(), "int")
        .when(value.rlike(r"^-?\d"), "double")
        .otherwise("string")
    )


def lattice(bools: Column, ints: Column, doubles: Column, strings: Column) -> Column:
    """The column type that holds all kinds seen."""
    return F.when(strings | (bools & (ints | doubles)), "string").when(bools, "bool").when(doubles, "double").when(ints, "int").otherwise("string")


def infer_schema(rows: DataFrame, key: str = "key", value: str = "value", place: list[str] | None = None) -> DataFrame:
    """key, type, first_seen of key-value rows (values as JSON text), in one aggregate with partial sums.

    ``place`` names the columns that order the rows; columns come in the order in which they are first seen.
    """
    kind = json_kind(F.col(value))
    seen = lambda k: F.coalesce(F.bool_or(kind == k), F.lit(False))
    order = F.min(F.struct(*[F.col(c) for c in place or [FID, "pos"]]))
    return rows.groupBy(F.col(key).alias("key")).agg(lattice(seen("bool"), seen("int"), seen("double"), seen("string")).alias("type"), order.alias("first_seen"))


SPARK_TYPES = {"bool": "boolean", "int": "bigint", "double": "double", "string": "string"}


def _named(name: str):
    return lambda p: p["k"] == F.lit(name)


def typed_properties(features: DataFrame, properties: str = "properties", schema: list[tuple[str, str]] | None = None) -> DataFrame:
    """Features with a JSON-object column replaced by typed columns (array<struct<k, v>> of keys and JSON values)."""
    if schema is None:
        rows = features.select(FID, F.posexplode(properties)).select(FID, "pos", F.col("col.k").alias("key"), F.col("col.v").alias("value"))
        schema = [(r.key, r.type) for r in infer_schema(rows).orderBy("first_seen").collect()]  # one row for each column
    out = []
    for name, kind in schema:
        first = F.get(F.filter(F.col(properties), _named(name)), F.lit(0))["v"]  # the first of equal keys wins
        null = first.isNull() | (first == "null")
        text = F.when(first.startswith('"'), F.from_json(F.concat(F.lit("["), first, F.lit("]")), "array<string>")[0]).otherwise(first)
        out.append(F.when(~null, text if kind == "string" else first.try_cast(SPARK_TYPES[kind])).alias(name))
    return features.select(FID, *out, GEOMETRY)


def columns_of(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in (FID, GEOMETRY, "_layer")]


# ---- bounds and types


def bounds(features: DataFrame, *by: str) -> DataFrame:
    """One row (for each group): extents in x, y, z, m; empty and null geometries don't count."""
    boxed = features.select(*by, bbox_of(F.col(GEOMETRY)).alias("b"))
    return boxed.groupBy(*by).agg(*[f(f"b.{n}").alias(n) for n, f in (("minx", F.min), ("miny", F.min), ("maxx", F.max), ("maxy", F.max), ("minz", F.min), ("maxz", F.max), ("minm", F.min), ("maxm", F.max))])


def geometry_types(features: DataFrame) -> DataFrame:
    """types (sorted), uniform (whether there is one only)."""
    found = F.sort_array(F.collect_set(type_name(F.col(GEOMETRY))))
    return features.agg(found.alias("types")).withColumn("uniform", F.size("types") == 1)


# ---- ordering and indexes


def with_hilbert(features: DataFrame, name: str = "_hilbert") -> DataFrame:
    """Features with the Hilbert value of their box's centre over the extent of all; 0 for empty geometries."""
    boxed = features.withColumn("__b", bbox_of(F.col(GEOMETRY)))
    extent = boxed.agg(F.min("__b.minx").alias("x0"), F.min("__b.miny").alias("y0"), F.max("__b.maxx").alias("x1"), F.max("__b.maxy").alias("y1")).first()
    if extent.x0 is None:
        return features.withColumn(name, F.lit(0).cast("bigint"))
    x, y = (F.col("__b.minx") + F.col("__b.maxx")) / 2, (F.col("__b.miny") + F.col("__b.maxy")) / 2
    value = hilbert(quantised(x, F.lit(extent.x0), F.lit(extent.x1)), quantised(y, F.lit(extent.y0), F.lit(extent.y1)))
    return boxed.withColumn(name, F.when(F.col("__b").isNull(), 0).otherwise(value)).drop("__b")


def sort_hilbert(features: DataFrame) -> DataFrame:
    """Features in Hilbert order, ties by input order: a range-partitioned sort."""
    return with_hilbert(features).orderBy("_hilbert", FID).drop("_hilbert")


def running_number(df: DataFrame, order: list[str], name: str = "rn") -> DataFrame:
    """1-based number in a global order without one task for all rows: sort by ranges, count partitions, add what lies before."""
    spark = df.sparkSession
    from pyspark import StorageLevel

    # ties in the order are told apart by all other columns, so that a partition that is computed again has the same numbers
    rest = [c for c, kind in df.dtypes if c not in order and not kind.startswith(("map", "variant"))]
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order, *rest).withColumn("__p", F.spark_partition_id()).withColumn("__m", F.monotonically_increasing_id()).persist(StorageLevel.DISK_ONLY)
    counts = sorted((r["__p"], r["count"]) for r in ordered.groupBy("__p").count().collect())  # one row for each partition
    before, total = [], 0
    for p, n in counts:
        before.append((p, total))
        total += n
    table = F.broadcast(spark.createDataFrame(before, "__p int, __before bigint"))
    place = F.col("__m").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return ordered.join(table, "__p").withColumn(name, place + F.col("__before")).drop("__p", "__m", "__before")


def index_nodes(boxes: DataFrame, number: str, size: int = 16) -> DataFrame:
    """Boxes of one level of a packed tree: ``size`` children (numbered from 1) in each node."""
    node = ((F.col(number) - 1) / size).cast("bigint")
    return boxes.groupBy(node.alias("node")).agg(F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"), F.count("*").alias("n"))


def index_levels(boxes: DataFrame, number: str = "rn", size: int = 16) -> list[DataFrame]:
    """All levels of a packed tree, leaves' parents first, up to one root."""
    levels, n = [], boxes.count()
    while n > 1:
        boxes = index_nodes(boxes, number, size).withColumn(number, F.col("node") + 1)
        levels.append(boxes)
        n = -(-n // size)
    return levels


# ---- layers and joins


def upsert_layers(old: DataFrame, new: DataFrame, layer: str = "_layer") -> DataFrame:
    """Layers of ``new`` replace those of the same name and come last."""
    return old.join(new.select(layer).distinct(), layer, "left_anti").unionByName(new)


def zip_rows(left: DataFrame, right: DataFrame, number: str = "row") -> DataFrame:
    """Rows of equal number side by side; differing lengths are an error."""
    a, b = left.count(), right.count()
    if a != b:
        raise ValueError(f"{a} shapes and {b} records don't pair up")
    return left.join(right, number)


def map_positions(features: DataFrame, f: Callable) -> DataFrame:
    """Features with positions replaced by ``f`` of (n, 4) arrays; see ``positions_mapped``."""
    from ..functions.columns import positions_mapped

    return features.withColumn(GEOMETRY, positions_mapped(F.col(GEOMETRY), f))


def ring_numbers(rings: DataFrame, fid: str, ring: str | list[str], clockwise: str) -> DataFrame:
    """Rings with the number of the shell each belongs to: the first and each clockwise one open a shell."""
    order = W.partitionBy(fid).orderBy(*([ring] if isinstance(ring, str) else ring))
    opens = F.when(F.col(clockwise) | (F.row_number().over(order) == 1), 1).otherwise(0)
    return rings.withColumn("__o", opens).withColumn("shell", F.sum("__o").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("__o")
