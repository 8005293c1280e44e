"""Benchmark decontamination by Wu-Manber multi-pattern search.

Benchmark items become windows of eight consecutive words (an item of fewer words is one window). A window is the
byte pattern ``" w1 w2 ... w8 "`` and a document is searched in the same normal form, so a byte match is a word match.

Search: patterns are grouped by length; each group has a *shift table* over hashed blocks of a few bytes, which tells
how far a window of the text can move before a pattern could end at this block, and *suffix-hash buckets* of the
patterns whose last block (within the group's shortest length) has this hash. Where the shift is 0, the bucket's patterns are compared directly with the
text. The text is cut into lanes, which advance together under NumPy, so that the skips stay data-dependent without a
Python step per position.

Defined results: a null or empty text has no words, no hits and is clean; very long texts are searched whole; repeated rows are judged one by one; null
item texts and items without words have no windows; repeated items count once per item_id; a null item_id reads
``null``. Empty tables of documents give empty results, those of items
no hits. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, normal_words, sliced, small_batches, stage

WINDOW = 8
#: Items of more text than this are searched in several passes, each over a shard of the items.
SHARD_BYTES = 32 << 20
#: Length groups: patterns of at least this many bytes use blocks of so many bytes.
GROUPS = ((24, 8), (12, 6), (6, 4), (0, 3))
LANE = 2048
#: Hits of several shards are broadcast if they have about so many values at most.
HIT_VALUES = 4_000_000
#: What a word is once A-Z are lowered, for Spark's regular expressions.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RESULT = "struct<n_words:bigint,hits:array<int>,items:array<string>>"


def windows(words: list[bytes], size: int = WINDOW) -> list[tuple[bytes, int]]:
    """(pattern, words in it) of each window of an item."""
    if not words:
        return []
    size = min(size, len(words))
    return [(b" " + b" ".join(words[i : i + size]) + b" ", size) for i in range(len(words) - size + 1)]


class WuManber:
    """Search for patterns of at least ``block`` bytes; positions of all occurrences, overlapping ones too."""

    def __init__(self, patterns: list[bytes], block: int):
        self.patterns, self.block = patterns, block
        self.m = m = min(map(len, patterns))
        blocks = len(patterns) * (m - block + 1)
        self.bits = np.uint64(64 - max(12, min(24, blocks.bit_length() + 3)))
        self.mask = np.uint64(2 ** (8 * block) - 1)
        self.shift = np.full(1 << (64 - int(self.bits)), m - block + 1, dtype=np.int32)
        heads = np.zeros((len(patterns), m + 8), dtype=np.uint8)
        for row, p in zip(heads, patterns, strict=True):
            row[:m] = np.frombuffer(p[:m], dtype=np.uint8)
        for j in range(m - block + 1):
            v = heads[:, j : j + 8].copy().view("<u8").ravel()
            np.minimum.at(self.shift, self._hash(v), m - block - j)
        self.buckets: dict[bytes, list[int]] = {}
        for k, p in enumerate(patterns):
            self.buckets.setdefault(p[m - block : m], []).append(k)

    def _hash(self, v: np.ndarray) -> np.ndarray:
        return ((v & self.mask) * np.uint64(0x9E3779B97F4A7C15)) >> self.bits

    def find(self, raw: bytes) -> list[tuple[int, int]]:
        """(start, pattern) of every occurrence. ``raw`` ends with at least 8 bytes of padding."""
        n = len(raw) - 8
        if n < self.m:
            return []
        view = np.ndarray((n + 1,), dtype="<u8", buffer=raw, strides=(1,))
        starts = np.arange(0, n - self.m + 1, LANE)
        ends = np.minimum(starts + LANE, n - self.m + 1)
        pos, tail, found = starts, self.m - self.block, []
        while len(pos):
            step = self.shift[self._hash(view[pos + tail])]
            zero = step == 0
            if zero.any():
                found.append(pos[zero])
            pos = pos + np.maximum(step, 1)
            alive = pos < ends
            if not alive.all():
                pos, ends = pos[alive], ends[alive]
        out, m, block, get = [], self.m, self.block, self.buckets.get
        for p in np.concatenate(found).tolist() if found else ():
            for k in get(raw[p + m - block : p + m], ()):
                if raw.startswith(self.patterns[k], p):
                    out.append((p, k))
        return out


class Matcher:
    """All windows of a set of items, ready to search documents."""

    def __init__(self, items: list[tuple[str, bytes | None]], size: int = WINDOW):
        owners: dict[bytes, set[str]] = {}
        self.words: dict[bytes, int] = {}
        for item, text in items:
            for pattern, n in windows(normal_words(text), size):
                owners.setdefault(pattern, set()).add(item)
                self.words[pattern] = n
        self.owners = owners
        groups: dict[int, list[bytes]] = {}
        for p in owners:
            groups.setdefault(next(b for least, b in GROUPS if len(p) >= least), []).append(p)
        self.searches = [WuManber(sorted(v), b) for b, v in sorted(groups.items())]

    def search(self, texts: list[bytes | None]) -> list[tuple[int, list[int], list[str]]]:
        """Per text: number of words, hit words as flat [from, to) pairs, items with occurring windows."""
        parts, offsets, counts, at = [], [], [], 0
        for t in texts:
            w = normal_words(t)
            norm = b" " + b" ".join(w) + b" \n"
            offsets.append(at)
            counts.append(len(w))
            parts.append(norm)
            at += len(norm)
        raw = b"".join(parts) + b"\n" * 8
        hits: dict[int, list[tuple[int, bytes]]] = {}
        offs = np.array(offsets)
        for s in self.searches:
            found = s.find(raw)
            if found:
                docs = np.searchsorted(offs, [p for p, _ in found], side="right") - 1
                for d, (p, k) in zip(docs.tolist(), found, strict=True):
                    hits.setdefault(d, []).append((p, s.patterns[k]))
        out: list = [(n, [], []) for n in counts]
        for d, found in hits.items():
            begin = offsets[d]
            spaces = np.flatnonzero(np.frombuffer(parts[d], dtype=np.uint8) == 32) + begin
            first = np.searchsorted(spaces, [p for p, _ in found])
            edge = np.zeros(counts[d] + 1, dtype=np.int32)
            items: set[str] = set()
            for i, (_, pattern) in zip(first.tolist(), found, strict=True):
                edge[i] += 1
                edge[i + self.words[pattern]] -= 1
                items |= self.owners[pattern]
            inside = np.concatenate(([0], (np.cumsum(edge) > 0).astype(np.int8)))
            out[d] = (counts[d], np.flatnonzero(np.diff(inside)).tolist(), sorted(items))
        return out


_built: dict[int, Matcher] = {}


def matcher_of(shared) -> Matcher:
    """The matcher of a broadcast set of items, built once per Python worker."""
    key = hash(tuple(shared.value))
    if key not in _built:
        _built.clear()
        _built[key] = Matcher(shared.value)
    return _built[key]


def _matcher_udf(items: list[tuple[str, bytes | None]], spark):
    shared = spark.sparkContext.broadcast(items)
    kind = pa.struct([("n_words", pa.int64()), ("hits", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])

    @F.arrow_udf(RESULT)
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matcher = matcher_of(shared)
        for texts in batches:
            rows = []
            for part in sliced(texts.cast(pa.binary())):
                rows += [{"n_words": n, "hits": h, "items": i} for n, h, i in matcher.search(part)]
            yield pa.array(rows, type=kind)

    return search


def find_windows(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", out: str = "found", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``docs`` with a struct column ``out``: n_words, hits (flat [from, to) word ranges), items (sorted ids).

    The items are broadcast only in shards of checked size. With one shard, documents aren't shuffled. More shards are searched one after the other;
    only digests of texts with hits, and the hits, are written, and meet the documents by a broadcast if they are few.
    """
    spark = docs.sparkSession
    small_batches(spark)
    items = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("i"), F.col(item_text).cast("string").cast("binary").alias("t")).where("t is not null")
    size = items.agg(F.sum(F.length("t") + 16)).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    if shards == 1:
        rows = [(r.i, bytes(r.t)) for r in items.collect()]
        return docs.withColumn(out, _matcher_udf(rows, spark)(F.col(text).cast("string")))
    items = items.withColumn("k", F.pmod(F.xxhash64("i", "t"), F.lit(shards)))
    # each pass keeps what occurs in texts that have hits, by a digest of the text; texts without hits are never written
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    keyed = docs.select(F.sha2(t.cast("binary"), 256).alias("__text"), t.alias("t"))
    hits = None
    for k in range(shards):
        rows = [(r.i, bytes(r.t)) for r in items.where(F.col("k") == k).collect()]
        found = keyed.select("__text", _matcher_udf(rows, spark)(F.col("t")).alias("f")).where(F.size("f.items") > 0).select("__text", "f.hits", "f.items").dropDuplicates(["__text"])
        found = stage(found, f"windows{k}")
        hits = found if hits is None else hits.unionByName(found)
    # a row for each shard at most
    merged = stage(hits.groupBy("__text").agg(F.flatten(F.collect_list("hits")).alias("__hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("__items")), "windows")
    size = merged.agg(F.sum(F.size("__hits") + F.size("__items") * 4 + 16)).first()[0] or 0
    joined = docs.withColumn("__text", F.sha2(t.cast("binary"), 256)).join(F.broadcast(merged) if size <= HIT_VALUES else merged, "__text", "left")
    result = F.struct(
        F.regexp_count(ascii_lower(t), F.lit(WORDS)).cast("bigint").alias("n_words"),
        F.coalesce("__hits", F.array().cast("array<int>")).alias("hits"),
        F.coalesce("__items", F.array().cast("array<string>")).alias("items"),
    )
    return joined.select(*docs.columns, result.alias(out))


def n_hit(hits: Column) -> Column:
    """Number of words in the union of flat [from, to) ranges; ranges of several shards may overlap."""
    pairs = F.array_sort(F.transform(F.sequence(F.lit(0), (F.size(hits) / 2).cast("int") - 1), lambda i: F.struct(F.get(hits, i * 2).alias("a"), F.get(hits, i * 2 + 1).alias("b"))))
    total = F.aggregate(
        pairs,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda s, p: F.struct((s["n"] + F.greatest(F.lit(0), p["b"] - F.greatest(p["a"], s["to"]))).alias("n"), F.greatest(p["b"], s["to"]).alias("to")),
        lambda s: s["n"],
    )
    return F.when(F.size(hits) == 0, F.lit(0)).otherwise(total).cast("bigint")


def decontaminate(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", min_items: int = 2, **kw) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (n_items >= min_items)."""
    text = kw.get("text", "text")
    found = find_windows(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), items, **{**kw, "text": "text", "out": "found"})
    ids = F.array_sort(F.col("found.items"))
    return found.select(
        "doc_id",
        F.col("found.n_words").alias("n_words"),
        n_hit(F.col("found.hits")).alias("n_hit"),
        F.size("found.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("found.items") >= min_items).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, *, min_items: int = 2, **kw) -> DataFrame:
    """The rows of ``docs`` with windows of fewer than ``min_items`` items, their columns unchanged."""
    columns = docs.columns
    found = find_windows(docs, items, **{**kw, "out": "__found"})
    return found.where(F.size("__found.items") < min_items).select(*columns)
