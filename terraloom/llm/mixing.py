"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a sequence of slots of ``block`` words. Slot i has the golden-ratio point of i (in fixed point, so that any
engine computes the same), which the cumulative target shares map to a source; the slots of a source are ranked. A
source's documents, shuffled by a hash, form a stream that repeats up to three times; it is cut into equal blocks of words,
and the slot of rank k takes block k. Only DataFrame functions are used.

Targets: sources in the order of their code points (null last) weigh 1, 2, 3, repeating, and share all words; a
target stops at three times its source's words, and the excess is shared again by weight until none is above.

Ranks and word positions are running sums; they are taken within buckets of bounded size (slots by number, documents
by a hash), and the buckets' totals are summed by source, so that a source with most of the rows isn't one task.

What is known of each source (a row for each) is ordered and summed in one task, and read by the driver. Slots have
``BLOCK`` words whatever the size of a source, so one whose target is near that or below may be off by all its words.

Defined results: a null or empty text has no words, and takes none; a very long text is a document of many blocks; repeated rows are documents of their own, ordered by the hash, then doc_id, then text hash;
a null source is a source; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stage

#: Words in a slot.
BLOCK = 256
REPEATS = 3
#: Golden-ratio points in fixed point of 31 bits: slot i has (i * STEP) mod 2^31.
BITS, STEP = 31, 1327217885
#: Slots whose ranks are counted together.
RUN = 1 << 14
#: Hash buckets of a source's documents: the first characters of an MD5 in hex.
HEX = 3
BROADCAST_SOURCES = 50_000


def word_count(text: Column) -> Column:
    """Runs of characters other than space and U+0009 to U+000D."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def targets(sizes: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """source, rank, source_size, weight, target of each source. ``sizes`` has source and source_size, a row for each source."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    t = sizes.withColumn("rank", F.row_number().over(order)).withColumn("weight", (F.pmod(F.col("rank") - 1, F.lit(3)) + 1).cast("double"))
    # the shares are min(cap, level * weight); sources fill in the order of cap / weight
    t = t.withColumn("cap", (F.col("source_size") * repeats).cast("double"))
    fill = W.orderBy(F.col("source_size") / F.col("weight"), "rank")
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    t = t.withColumn("all", F.sum("source_size").over(every).cast("double"))
    t = t.withColumn("left", F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    t = t.withColumn("open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    # the first source that its own share doesn't fill sets the level for itself and all that follow
    t = t.withColumn("level", F.when(F.col("cap") > F.col("left") * F.col("weight") / F.col("open"), F.struct(F.col("left").alias("l"), F.col("open").alias("o"))))
    t = t.withColumn("level", F.first("level", ignorenulls=True).over(fill.rowsBetween(W.unboundedPreceding, W.currentRow)))
    share = F.col("level.l") * F.col("weight") / F.col("level.o")
    return t.select("source", "rank", "source_size", "weight", F.coalesce(share, F.col("cap")).alias("target"))


def _running(df: DataFrame, keys: list[str], bucket: str, order: list, value: Column, name: str) -> DataFrame:
    """``name``: the sum of ``value`` over the rows before, by ``keys``: within a bucket by a window, over buckets by their totals."""
    totals = df.groupBy(*keys, bucket).agg(F.sum(value).alias("__t"))
    first = totals.select(*keys, bucket, (F.sum("__t").over(W.partitionBy(*keys).orderBy(bucket)) - F.col("__t")).alias("__b"))
    within = F.sum(value).over(W.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)) - value
    summed = df.withColumn("__w", within)
    return summed.join(first, [*keys, bucket]).withColumn(name, F.col("__w") + F.col("__b")).drop("__w", "__b")


def schedule(shares: DataFrame, block: int = BLOCK) -> DataFrame:
    """rank, slot, k: the slots of the mix, the source of each (by rank), and the slot's place among its source's slots."""
    spark = shares.sparkSession
    rows = shares.orderBy("rank").select("rank", "target").collect()  # a row for each source
    words = [int(r.target) for r in rows]
    total = sum(words)
    slots = -(-total // block)
    edges = [w * 2**BITS // total if total else 0 for w in accumulate(words)]
    cuts = spark.createDataFrame([(r.rank, a, b) for r, a, b in zip(rows, [0, *edges], edges, strict=False) if a < b], "rank int, lo bigint, hi bigint")
    points = spark.range(slots).withColumnRenamed("id", "slot").withColumn("point", F.pmod("slot", F.lit(2**BITS)) * STEP % F.lit(2**BITS))
    # points and the sources' intervals meet in cells of equal width, each of which a few intervals cross
    width = max(1, 2**BITS // max(1, len(rows)))
    cells = cuts.select("*", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))).alias("cell"))
    cells = F.broadcast(cells) if len(rows) <= BROADCAST_SOURCES else cells
    ranked = points.withColumn("cell", F.floor(F.col("point") / width)).join(cells, "cell").where("point >= lo and point < hi").select("slot", "rank")
    ranked = ranked.withColumn("run", (F.col("slot") / RUN).cast("bigint"))
    return _running(ranked, ["rank"], "run", ["slot"], F.lit(1), "k").select("rank", "slot", "k")


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK, repeats: int = REPEATS, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken of each document (one row per input row); ``keep`` adds source or h."""
    size = word_count(F.col(text).cast("string"))
    sized = stage(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), size.alias("size"), F.xxhash64(text).alias("h")), "sizes")
    shares = stage(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), repeats), "targets")
    shuffled = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    docs = sized.join(shares, sized["source"].eqNullSafe(shares["source"])).select("doc_id", sized["source"].alias("source"), "size", "source_size", "target", "rank", "h", shuffled.alias("md5"))
    docs = docs.withColumn("bucket", F.substring("md5", 1, HEX))
    placed = _running(docs, ["rank"], "bucket", ["md5", "doc_id", "h"], F.col("size"), "at")
    # a document's words in each of the stream's repeats, cut at the blocks' edges
    begin = F.col("at") + F.col("source_size") * F.col("turn")
    pieces = placed.where("size > 0").select("doc_id", "rank", "at", "size", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("turn"), "source_size").select("doc_id", "rank", "at", begin.alias("a"), (begin + F.col("size")).alias("b"))
    pieces = pieces.select("*", F.explode(F.sequence(F.floor(F.col("a") / block), F.floor((F.col("b") - 1) / block))).alias("k"))
    words = F.least(F.col("b"), (F.col("k") + 1) * block) - F.greatest(F.col("a"), F.col("k") * block)
    taken = pieces.join(schedule(shares, block), ["rank", "k"]).groupBy("rank", "at").agg(F.sum(words).alias("taken"))
    # a place in a source's stream names one document that has words
    own = placed.withColumn("__place", F.when(F.col("size") > 0, F.col("at")))
    joined = own.join(taken.withColumnRenamed("at", "__place"), ["rank", "__place"], "left")
    return joined.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"), *keep)


def mixed_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", **kw) -> DataFrame:
    """``docs`` as the mix takes them: a row is repeated as often as its words are taken, to the nearest whole number.

    A row cut by the mix's end stays if at least half of its words are taken; one without words is taken once, as it costs nothing. Columns unchanged.
    Rows of one doc_id, source, size and text hash are taken alike.
    """
    taken = mix(docs, doc_id=doc_id, text=text, source=source, keep=("source", "h"), **kw)
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size")))).cast("int")
    # null keys are told apart from values by the names' hash
    key = lambda i, s, h: F.xxhash64(i, F.coalesce(s, F.lit("")), s.isNull(), h)
    times = taken.select(key(F.col("doc_id"), F.col("source"), F.col("h")).alias("__key"), F.col("doc_id").alias("__d"), copies.alias("__n")).groupBy("__key", F.coalesce("__d", F.lit(-(2**63))).alias("__i")).agg(F.max("__n").alias("__n")).where("__n > 0")
    columns = docs.columns
    own = docs.withColumn("__key", key(F.col(doc_id), F.col(source).cast("string"), F.xxhash64(text))).withColumn("__i", F.coalesce(F.col(doc_id), F.lit(-(2**63))))
    return own.join(times, ["__key", "__i"]).withColumn("__turn", F.explode(F.sequence(F.lit(1), F.col("__n")))).select(*columns)
