"""Document fingerprints: a Merkle tree over sentences, paragraphs and sections.

Leaves are the sentences of a paragraph (they end with ``.``, ``!``, ``?`` or the like and white space), long ones in
pieces; paragraphs are lines, sections are parted by empty lines. A node's digest is taken over the joined digests of its children, the
root's over those of the sections. Digests are the first 128 bits of SHA-256: equal texts have equal roots, and texts that differ
have different ones but for a collision of that hash.

The fingerprint is text: ``root|sections``, sections by ``/``, each ``digest:paragraphs``, paragraphs by ``;``, each
``digest:leaves``, leaves by ``,``, each ``digest.length``, with 32 hex digits for a digest. So two
fingerprints alone show whether texts are equal, which branches differ, and how much of one occurs in the other. White space at the edge
of a leaf belongs to it, so that leaves joined give the text.

Likeness is 1 for equal roots, else the length of the distinct leaves that both have over that of the distinct leaves
that either has (a Jaccard weighted by length). For that, a leaf is 56 bits of a hash of its digest and 8 bits of length, of which a
neighbour is sent 8 bytes instead of the fingerprint's text.

Only DataFrame functions are used. Defined results: a null text is empty; very long texts are taken whole; an empty table gives an empty result; two empty texts have likeness 1; repeated rows keep
their own rows; the next document of a row is the one with the next greater doc_id (of several rows of that id, the one with the
smallest text), the first for the last; a null doc_id has no place in the order: its edited columns are null. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import let, stage, unstage

#: A leaf: up to 60 code points that end no sentence, then what ends one, then one white-space character. Leaves joined give the paragraph.
LEAF = r"(?s)[^.!?;|]{1,60}[.!?;|]{0,60}\s?|[.!?;|]{1,60}\s?"
#: Hex digits of a digest.
HEX = 32


def _digest(c: Column) -> Column:
    return F.substring(F.sha2(c.cast("binary"), 256), 1, HEX)


def fingerprint(text: Column) -> Column:
    """The Merkle fingerprint of a text."""
    text = F.coalesce(text, F.lit(""))

    def paragraph(p: Column) -> Column:
        found = F.regexp_extract_all(p, F.lit(LEAF), F.lit(0))
        leaves = F.array_join(F.transform(found, lambda x: F.concat(_digest(x), F.lit("."), F.length(x).cast("string"))), ",")
        return let(leaves, lambda x: F.concat(_digest(x), F.lit(":"), x))

    def section(s: Column) -> Column:
        inner = F.array_join(F.transform(F.split(s, "\n", -1), paragraph), ";")
        return let(inner, lambda x: F.concat(_digest(x), F.lit(":"), x))

    sections = F.array_join(F.transform(F.split(text, "\n\n", -1), section), "/")
    return let(sections, lambda x: F.concat(_digest(x), F.lit("|"), x))


def nodes(print_: Column) -> Column:
    """All nodes of a fingerprint; the leaves are those written ``digest.length``."""
    return F.split(F.translate(print_, "|/;:", ",,,,"), ",", -1)


def leaves(print_: Column) -> Column:
    """The distinct leaves of a fingerprint: 56 bits of a hash of the digest, 8 of the length."""
    own = F.filter(nodes(print_), lambda x: F.substring(x, HEX + 1, 1) == ".")
    size = lambda x: F.substring(x, HEX + 2, 4).cast("bigint")
    return F.array_distinct(F.transform(own, lambda x: F.xxhash64(x).bitwiseAND(F.lit(~0xFF)).bitwiseOR(size(x))))


def root(print_: Column) -> Column:
    return F.substring(print_, 1, HEX)


def _mass(found: Column) -> Column:
    return F.aggregate(found, F.lit(0).cast("bigint"), lambda n, x: n + x.bitwiseAND(F.lit(0xFF).cast("bigint")))


def likeness_of(a: Column, b: Column, same: Column) -> Column:
    """Weighted Jaccard of two sets of leaves, 1 where the roots are the ``same``."""
    masses = let(F.struct(a.alias("x"), b.alias("y")), lambda n: F.struct(_mass(F.array_intersect(n["x"], n["y"])).alias("shared"), _mass(F.array_union(n["x"], n["y"])).alias("every")))
    share = let(masses, lambda m: F.when(m["every"] == 0, F.lit(0.0)).otherwise(m["shared"] / m["every"]))
    return F.when(same, F.lit(1.0)).otherwise(share).cast("double")


def likeness(a: Column, b: Column) -> Column:
    """Weighted Jaccard of the distinct leaves of two fingerprints, 0 to 1."""
    return likeness_of(leaves(a), leaves(b), root(a) == root(b))


def differing_sections(a: Column, b: Column) -> Column:
    """Zero-based sections and paragraphs of ``a`` (``section.paragraph``) whose digests ``b`` doesn't have in that section."""
    parts = lambda p: F.split(F.substring_index(p, "|", -1), "/", -1)
    inner = lambda s: F.split(F.substring(s, F.lit(HEX + 2), F.length(s)), ";", -1)

    def of(s: Column, theirs: Column, i: Column) -> Column:
        same = F.substring(s, 1, HEX) == F.substring(theirs, 1, HEX)
        known = F.transform(inner(theirs), lambda p: F.substring(p, 1, HEX))
        rows = let(known, lambda n: F.transform(inner(s), lambda p, k: F.when(~F.array_contains(n, F.substring(p, 1, HEX)), F.concat(i.cast("string"), F.lit("."), k.cast("string")))))
        return F.when(same, F.array().cast("array<string>")).otherwise(F.filter(rows, lambda x: x.isNotNull()))

    return F.flatten(let(parts(b), lambda other: F.transform(parts(a), lambda s, i: of(s, F.coalesce(F.get(other, i), F.lit("")), i))))


def next_ids(ids: DataFrame) -> DataFrame:
    """doc_id, next_id over the distinct ids: the next greater one, the least for the greatest.

    The ids are dealt to partitions by ascending ranges. The next id is in the same partition, or it is the first one of the next
    partition; the table of these (a row for each partition) is ordered in one task and broadcast.
    """
    spark = ids.sparkSession
    distinct = stage(ids.where("doc_id is not null").select("doc_id").distinct(), "ids")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = stage(distinct.repartitionByRange(parts, "doc_id").withColumn("part", F.spark_partition_id()), "id-ranges")
    unstage(distinct)
    firsts = ranged.groupBy("part").agg(F.min("doc_id").alias("first"))
    after = firsts.select("part", F.coalesce(F.lead("first").over(W.orderBy("part")), F.min("first").over(W.partitionBy(F.lit(0)))).alias("after"))
    within = ranged.withColumn("next", F.lead("doc_id").over(W.partitionBy("part").orderBy("doc_id")))
    return within.join(F.broadcast(after), "part").select("doc_id", F.coalesce("next", "after").alias("next_id"))


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_chars, fingerprint."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.length(t).cast("bigint").alias("n_chars"), fingerprint(t).alias("fingerprint"))


def compare_edits(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text (its last quarter replaced by the next document's start).

    The texts are shuffled once, by doc_id; the exchange serves both joins. What a document needs of the next one (a
    start of a quarter of its own length, and root and leaves of the fingerprint) travels back to it.
    """
    # names of their own: an alias that keeps a name can be dropped on one side of a self-join, and the exchanges would differ
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    own = docs.select(F.col(doc_id).cast("bigint").alias("d"), t.alias("t"))
    known = own.where("d is not null")
    lengths = known.groupBy("d").agg(F.max(F.length("t")).alias("n"))
    # of several rows of an id, each takes what it needs of the longest start
    asks = next_ids(own.select(F.col("d").alias("doc_id"))).join(lengths, F.col("doc_id") == F.col("d")).select(F.col("doc_id").alias("asker"), F.col("next_id").alias("wanted"), F.floor(F.col("n") / 4).cast("int").alias("need"))
    sent = known.join(asks, F.col("d") == F.col("wanted")).select("asker", F.substring("t", F.lit(1), F.col("need")).alias("start"), F.xxhash64("t").alias("h"), fingerprint(F.col("t")).alias("p"))
    sent = sent.select("asker", F.struct("start", "h", root(F.col("p")).alias("root"), leaves(F.col("p")).alias("leaves")).alias("next"))
    sent = sent.groupBy("asker").agg(F.min("next").alias("next"))
    met = known.join(sent, F.col("d") == F.col("asker"), "left").select("d", "t", "next")
    met = met.unionByName(own.where("d is null").withColumn("next", F.lit(None).cast(met.schema["next"].dataType)))
    n = F.length("t")
    cut = F.floor(n / 4).cast("int")
    edited = F.when(F.col("next").isNotNull(), F.concat(F.substring("t", F.lit(1), n - cut), F.substring("next.start", F.lit(1), cut)))
    made = met.select(F.col("d").alias("doc_id"), n.cast("bigint").alias("n_chars"), fingerprint(F.col("t")).alias("fingerprint"), edited.alias("edited"), "next")
    made = made.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", leaves(F.col("fingerprint")).alias("leaves"), F.when(F.col("edited").isNotNull(), fingerprint(F.col("edited"))).alias("edited_fingerprint"), "next")
    same = lambda other: root(F.col("fingerprint")) == other
    near_edited = likeness_of(F.col("leaves"), leaves(F.col("edited_fingerprint")), same(root(F.col("edited_fingerprint"))))
    near_next = likeness_of(F.col("leaves"), F.col("next.leaves"), same(F.col("next.root")))
    known_next = F.col("next").isNotNull()
    return made.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", F.when(known_next, near_edited).alias("near_edited"), F.when(known_next, near_next).alias("near_next"))
