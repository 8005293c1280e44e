"""Shared helpers of the training-data operators: staging tables, reading inputs, text normalisation."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper-case ASCII letters and their lower-case forms; other scripts are left alone on purpose.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Byte table: A-Z are lowered, digits, a-z and every byte of a non-ASCII character stay, the rest become spaces.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one in ``spark.checkpoint.dir``. Where none is set, a local session (tests) gets a temporary one; a cluster is an error."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not set_dir:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        set_dir = known.get() if known.isDefined() else None
    if not set_dir:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir isn't set: on a cluster it must name a folder that the driver and all executors share")
        set_dir = "file://" + tempfile.mkdtemp(prefix="terraloom-")
        spark.sparkContext.setCheckpointDir(set_dir)
    return set_dir.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), own


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder of staged tables, in the shared folder. It goes when the driver ends."""
    path = f"{shared_dir(spark)}/terraloom-{spark.sparkContext.applicationId}"
    fs, own = _file_system(spark, path)
    if not fs.exists(own):
        fs.mkdirs(own)
        fs.deleteOnExit(own)
    return path


def stage(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors, and is computed once."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged.staged_at = path
    return staged


def unstage(*frames: DataFrame) -> None:
    """Remove what ``stage`` wrote for these frames, once nothing reads them any more."""
    for df in frames:
        fs, own = _file_system(df.sparkSession, df.staged_at)
        fs.delete(own, True)


#: Keys with more than one in so many of all rows are joined by broadcast; there are at most as many of them.
HOT_KEYS = 20_000
#: Keys of so many rows at most are broadcast to filter rows by them.
FILTER_KEYS = 1_000_000


def join_hot(rows: DataFrame, facts: DataFrame, key: str, n: str = "n", most: int = HOT_KEYS) -> DataFrame:
    """Inner join of ``rows`` with ``facts``: a row for each key, in which ``n`` is the number of the key's rows.

    Keys with more than a share of 1 / ``most`` of the rows are at most ``most`` by count, so their facts are broadcast, and their
    rows stay where they are. All others meet by a shuffle, in which no key has more than that share. Both inputs are read twice.
    """
    total = facts.agg(F.sum(n)).first()[0] or 0
    cut = total // most
    hot = facts.where(F.col(n) > cut)
    joined = rows.join(F.broadcast(hot), key)
    if not cut:  # fewer rows than hot keys are allowed
        return joined
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return joined.unionByName(rest.join(facts.where(F.col(n) <= cut), key))


def filter_by(rows: DataFrame, keys: DataFrame, on: list[str], how: str) -> DataFrame:
    """Semi or anti join of rows with distinct keys, which are broadcast if there are at most ``FILTER_KEYS``."""
    few = keys.count() <= FILTER_KEYS
    return rows.join(F.broadcast(keys) if few else keys, on, how)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also within lambdas, where Spark doesn't share common expressions."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Entries of an array that are summed at once by ``sums_before``.
SUM_RUN = 64


def sums_before(lengths: Column) -> Column:
    """For each entry of an array of numbers, the sum of the entries before it: within runs, over the sums of runs."""
    runs = F.sequence(F.lit(0), ((F.size(lengths) - 1) / SUM_RUN).cast("int"))
    add = lambda values: F.aggregate(values, F.lit(0), lambda a, x: a + x)
    own = lambda r: F.slice(lengths, r * SUM_RUN + 1, F.lit(SUM_RUN))

    def summed(totals: Column) -> Column:
        within = lambda r: let(F.struct(add(F.slice(totals, F.lit(1), r)).alias("b"), own(r).alias("v")), lambda t: F.transform(t["v"], lambda _, i: t["b"] + add(F.slice(t["v"], F.lit(1), i))))
        return F.flatten(F.transform(runs, within))

    return F.when(F.size(lengths) == 0, F.array().cast("array<int>")).otherwise(let(F.transform(runs, lambda r: add(own(r))), summed))


def normal_words(text: bytes | None) -> list[bytes]:
    """Lower-cased words of a UTF-8 text: runs of ASCII letters, digits and any non-ASCII characters."""
    return text.translate(WORD_BYTES).split() if text else []


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file: the folder in TERRALOOM_TOKENIZERS if set, else the installed helper's."""
    folder = os.environ.get("TERRALOOM_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


#: Bytes of a batch that goes to Python: few, as the JVM holds one for each running task, and so does its worker.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Hold batches for Python to ``BATCH_BYTES``, unless the session asks for less."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


#: Batches are handed to kernels in slices of about this many bytes, so that memory doesn't depend on the length of texts.
SLICE_BYTES = 4 << 20


def sliced(column: pa.Array, limit: int = SLICE_BYTES):
    """Consecutive values of a string or binary column as lists, each of about ``limit`` bytes (one longer value is a slice of its own)."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield column.slice(start, i - start).to_pylist()
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield column.slice(start).to_pylist()
