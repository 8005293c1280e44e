"""Single files made and read in pieces: executors write and read the pieces, the driver gets their paths and figures only.

Pieces of a file to be written lie in a folder that the driver and all executors see: in ``spark.checkpoint.dir``, if that names a local or
mounted folder, else beside the file.
"""

from __future__ import annotations

import json
import os
import re
import shutil
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_SCHEMA = "k int, path string, facts string"
BLOCK = 4 << 20


def shared_place(spark: SparkSession | None, beside: str) -> str:
    """The folder in which driver and executors can leave files for each other."""
    given = spark.conf.get("spark.checkpoint.dir", None) if spark else None
    if given and re.match(r"/|file:/", given):
        return re.sub(r"^file:(//)?(?=/)", "", given)
    return os.path.dirname(os.path.abspath(beside.removeprefix("file://")))


@contextmanager
def folder(spark: SparkSession, beside: str) -> Iterator[str]:
    """A folder of its own for pieces, gone afterwards."""
    path = os.path.join(shared_place(spark, beside), f"terraloom-parts-{uuid.uuid4().hex}")
    os.makedirs(path)
    try:
        yield path
    finally:
        shutil.rmtree(path, ignore_errors=True)


def _one(k: int, path: str, facts: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int32()), "path": [path], "facts": [json.dumps(facts)]})


def store(df: DataFrame, into: str, write: Callable[[Iterator[pa.RecordBatch], str], dict]) -> list[tuple[str, dict]]:
    """Let ``write`` make a file of each partition; (path, what ``write`` returned) in the order of partitions. Attempts have names of their own."""

    def run(batches):
        from pyspark import TaskContext

        k = TaskContext.get().partitionId()
        path = os.path.join(into, f"{k:06d}-{uuid.uuid4().hex}")
        yield _one(k, path, write(batches, path))

    return [(r.path, json.loads(r.facts)) for r in sorted(df.mapInArrow(run, _SCHEMA).collect())]


def over(spark: SparkSession, items: list, each: Callable[[object], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Rows that ``each`` makes of the items, a task for each of them, in order."""

    def run(batches):
        for b in batches:
            for i in b.column(0).to_pylist():
                yield from each(items[i])

    if not items:
        return spark.createDataFrame([], schema)
    return spark.range(0, len(items), 1, len(items)).mapInArrow(run, schema)


def store_over(spark: SparkSession, items: list, into: str, write: Callable[[object, str], dict]) -> list[tuple[str, dict]]:
    """Let ``write`` make a file of each item."""
    numbered = list(enumerate(items))

    def each(item):
        k, x = item
        path = os.path.join(into, f"{k:06d}-{uuid.uuid4().hex}")
        yield _one(k, path, write(x, path))

    return [(r.path, json.loads(r.facts)) for r in sorted(over(spark, numbered, each, _SCHEMA).collect())]


def append(out: BinaryIO, path: str) -> None:
    """Move a piece to the end of a file."""
    with open(path, "rb") as piece:
        shutil.copyfileobj(piece, out, BLOCK)
    os.remove(path)


def join(out: BinaryIO, pieces: list[tuple[str, dict]], head: bytes = b"", between: bytes = b"", tail: bytes = b"") -> None:
    """Pieces of text one behind the other; those without rows (``n``) leave nothing."""
    out.write(head)
    first = True
    for path, facts in pieces:
        if facts["n"]:
            out.write(b"" if first else between)
            append(out, path)
            first = False
    out.write(tail)


def write_lines(df: DataFrame, path: str, head: str = "", between: str = "", tail: str = "") -> None:
    """The one text column of a frame as a file, made by the executors."""

    def write(batches, name):
        n = 0
        with open(name, "wb") as out:
            for b in batches:
                if b.num_rows:
                    out.write((between if n else "").encode() + between.join(b.column(0).to_pylist()).encode())
                    n += b.num_rows
        return {"n": n}

    with folder(df.sparkSession, path) as into, open(path, "wb") as out:
        join(out, store(df, into, write), head.encode(), between.encode(), tail.encode())
