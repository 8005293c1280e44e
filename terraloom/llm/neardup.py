"""Near-duplicate join (Jaccard of word shingles) by the chosen-path method.

1. *Sets.* A text becomes the set of its five-word shingles (one shingle of all words if there are fewer), as 64-bit
   hashes; a 128-bit digest of the sorted set names it. Texts with equal sets are copies: one node stands for them.
2. *Embedding.* A node keeps ``COORDINATES`` min-wise hashes: two sets agree in a coordinate with the probability of their Jaccard.
3. *Chosen paths.* A run splits all nodes on the value of a sampled coordinate (a "shared token"). Buckets of more than
   ``LIMIT`` nodes are split again, on one coordinate or two, 1 / threshold on average: so a pair at the threshold
   keeps one common bucket on average, and a node has never more rows than before unless it shares more than the
   threshold with most of its bucket. Such dense buckets are told by a sample of ``SAMPLE`` nodes and its medoid: nodes that
   agree with the medoid in ``ALIKE`` of the coordinates leave the splitting, linked to it; so that none of their pairs
   is lost, nodes that agree less, by what the two of a pair can differ, are linked too, and stay in it. Runs repeat until a pair
   at the threshold is found with the target recall at depth ``DEPTH``; what is still large there is linked whole.
4. *Small buckets* are compared pair by pair on the embedding, and give the edges of a spanning forest, not pairs.
5. *Exact check.* The connected groups get their whole shingle sets, packed into rows of at most ``BLOCK`` nodes or
   ``BLOCK_BYTES``. A task compares two blocks (or one with itself) exactly and returns counts of links by node and a spanning
   forest of the true links.
6. Connected components of the true links are the classes.

No step emits the pairs of a group. Copies are never expanded: their number is a weight. The exact check compares all
pairs of a connected group of different texts, so its time, and the number of its tasks (and of packed blocks sent),
grow with the square of such a group's size divided by ``BLOCK``; no other step's rows do.

Hot keys (buckets, hubs, nodes with very many copies) meet what is known of them by ``join_hot``, not in one task.

Defined results: null is an empty text; texts without words are alike only if they are equal, and have no other
links; very long texts are whole sets; repeated rows are copies of each other; of tied documents the least doc_id names the class; a null doc_id is never a class id unless the class has no other; an empty table gives an empty result.
Extra columns are ignored by ``near_duplicates`` and kept by ``drop_near_duplicates``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTES, filter_by, join_hot, sliced, small_batches, stage, unstage

SHINGLE, THRESHOLD = 5, 0.8
#: Least probability that a pair at the threshold shares a bucket, wherever its buckets end.
RECALL = 0.999
COORDINATES = 64
#: Largest bucket that is brute-forced, levels of splitting.
LIMIT, DEPTH = 128, 12
#: Nodes that tell whether a bucket is dense; agreement with their medoid of nodes that leave; share of such nodes in a dense bucket.
SAMPLE, ALIKE, DENSE = 24, 0.6, 0.25
#: Nodes and bytes of a block of the exact check, nodes compared at once.
BLOCK, BLOCK_BYTES, TILE = 2048, 4 << 20, 512
#: Rounds after which connected components must have settled (they take about the logarithm of a component's size).
ROUNDS = 100

_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)
_MULTIPLIERS = np.array([int.from_bytes(hashlib.blake2b(f"coordinate {k}".encode(), digest_size=8).digest(), "little") | 1 for k in range(COORDINATES)], dtype=np.uint64)
_powers: list[np.ndarray] = []


def found_at(threshold: float, depth: int) -> float:
    """Probability that a pair at the threshold shares a bucket of one run at this depth, with 1 / threshold children on average."""
    second, found = 1 / threshold - 1, 1.0
    for _ in range(depth - 1):
        x = threshold * found
        found = x + second * x * (1 - x)
    return threshold * found


def runs_needed(threshold: float, recall: float, depth: int = DEPTH) -> int:
    """Runs after which a pair at the threshold has shared a bucket at this depth with this probability."""
    n, missed = 1, 1 - found_at(threshold, depth)
    while missed**n > 1 - recall:
        n += 1
    return n


def least_agreement(threshold: float, coordinates: int = COORDINATES, sigmas: float = 4.3) -> float:
    """Share of coordinates in which a pair at the threshold agrees, but for one pair in 10^5."""
    return threshold - sigmas * (threshold * (1 - threshold) / coordinates) ** 0.5


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of P and of its inverse modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(16, n.bit_length())
        base = np.full(size, _P, dtype=np.uint64)
        inverse = np.full(size, _P_INVERSE, dtype=np.uint64)
        base[0] = inverse[0] = 1
        _powers[:] = [np.cumprod(base), np.cumprod(inverse)]
    return _powers[0], _powers[1]


def shingle_sets(texts: list[bytes | None], size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    lengths = [len(t) + 1 if t else 1 for t in texts]
    buf = np.frombuffer(b"".join((t.translate(WORD_BYTES) if t else b"") + b" " for t in texts), dtype=np.uint8)
    inside = np.concatenate(([False], buf != 32, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    power, inverse = _tables(len(buf) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((buf.astype(np.uint64) + np.uint64(7)) * power[: len(buf)])))
    words = _mix((sums[ends] - sums[starts]) * inverse[starts])
    shingles = words[: max(0, len(words) - size + 1)].copy()
    for k in range(1, size):
        shingles = shingles * np.uint64(_P) + words[k : len(words) - size + 1 + k]
    shingles = _mix(shingles)
    bounds = np.concatenate(([0], np.cumsum(lengths)))
    first = np.searchsorted(starts, bounds)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(shingles[a : b - size + 1]))
        elif b > a:
            h = np.uint64(b - a)
            for w in words[a:b]:
                h = h * np.uint64(_P) + w
            out.append(_mix(np.array([h])))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out


def sketch(s: np.ndarray) -> bytes:
    """Min-wise hashes of a set, 32 bits each."""
    least = np.full(COORDINATES, 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    for i in range(0, len(s), 2048):
        least = np.minimum(least, (s[i : i + 2048, None] * _MULTIPLIERS).min(axis=0))
    return (least >> np.uint64(32)).astype("<u4").tobytes()


def node_of(s: np.ndarray, text: bytes | None) -> bytes:
    """The name of a set; of a text without words, a name of its own kind."""
    return hashlib.blake2b(s.tobytes() if len(s) else b"no words\x00" + (text or b""), digest_size=16, person=b"set" if len(s) else b"text").digest()


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for b in batches:
            at = 0
            for texts in sliced(b.column(2), 1 << 18):
                sets = shingle_sets(texts)
                n = len(sets)
                nodes = pa.array([node_of(s, t) for s, t in zip(sets, texts, strict=True)], pa.binary())
                marks = pa.array([sketch(s) if len(s) else None for s in sets], pa.binary())
                sizes = pa.array([len(s) for s in sets], pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, n), b.column(1).slice(at, n), nodes, marks, sizes], names=["doc_id", "h", "node", "sketch", "size"])
                at += n


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for b in batches:
            for texts in sliced(b.column(0), 1 << 18):
                sets = shingle_sets(texts)
                yield pa.RecordBatch.from_arrays([pa.array([node_of(s, t) for s, t in zip(sets, texts, strict=True)], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "shingles"])


def _grouped(batches: Iterator[pa.RecordBatch], keys: int):
    """Consecutive rows of equal keys (the first columns), as (key, list of columns)."""
    key, rows = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row[:keys] != key:
                if rows:
                    yield key, list(zip(*rows, strict=True))
                key, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield key, list(zip(*rows, strict=True))


def _labels(near: np.ndarray) -> np.ndarray:
    """Connected components of a symmetric adjacency matrix: the least index of each."""
    n = len(near)
    label = np.arange(n)
    while True:
        new = np.minimum(label, np.where(near, label[None, :], n).min(axis=1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=-1)


def _marks(values: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(values), dtype="<u4").reshape(-1, COORDINATES)


def _compare_sketches(agreement: float):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for _, (nodes, marks) in _grouped(batches, 1):
            m = _marks(marks)
            label = _labels(_agreement(m[:, None, :], m[None, :, :]) >= agreement)
            for i in np.flatnonzero(label != np.arange(len(label))).tolist():
                a.append(nodes[i])
                b.append(nodes[label[i]])
            if len(a) >= 5000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return compare


def _medoids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each bucket's sample, the node that agrees most with the others, and whether the bucket is dense around it."""
    for (path,), (nodes, marks) in _grouped(batches, 1):
        m = _marks(marks)
        near = _agreement(m[:, None, :], m[None, :, :])
        best = int(near.sum(axis=1).argmax())
        dense = bool((near[best] >= ALIKE).mean() >= DENSE)
        yield pa.RecordBatch.from_arrays([pa.array([path], pa.int64()), pa.array([nodes[best] if dense else None], pa.binary()), pa.array([marks[best] if dense else None], pa.binary())], names=["path", "hub", "hub_sketch"])


def _judged(link: float):
    """Which nodes of large buckets are linked to the hub (agreement of ``link``), and which stay in the splitting."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hubs, theirs = b.column(3), b.column(4).to_pylist()
            near = np.full(b.num_rows, -1.0)
            dense = [i for i, x in enumerate(theirs) if x is not None]
            if dense:
                near[dense] = _agreement(_marks(b.column(2).take(pa.array(dense)).to_pylist()), _marks([theirs[i] for i in dense]))
            linked = pa.compute.if_else(pa.array(near >= link), hubs, pa.scalar(None, hubs.type))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), linked, pa.array(near < ALIKE)], names=["path", "node", "sketch", "hub", "stays"])

    return judge


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of sets of ``a`` with sets of ``b``, by ranges of the hashes that both lists have."""
    out = np.zeros((len(a), len(b)), dtype=np.float64)
    if not a or not b:
        return out
    everything = [np.concatenate(x) for x in (a, b)]
    owners = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (a, b)]
    both = np.intersect1d(*map(np.unique, everything), assume_unique=True)
    if not len(both):
        return out
    sides = []
    for values, owner in zip(everything, owners, strict=True):
        column = np.minimum(np.searchsorted(both, values), len(both) - 1)
        keep = both[column] == values
        column, owner = column[keep], owner[keep]
        order = np.argsort(column, kind="stable")
        sides.append((column[order], owner[order]))
    width = 4096
    for c in range(0, len(both), width):
        m = []
        for (column, owner), x in zip(sides, (a, b), strict=True):
            i, j = np.searchsorted(column, [c, c + width])
            own = np.zeros((len(x), min(width, len(both) - c)), dtype=np.float32)
            own[owner[i:j], column[i:j] - c] = 1
            m.append(own)
        out += m[0] @ m[1].T
    return out


def _near(a: list[np.ndarray], b: list[np.ndarray], threshold: float) -> np.ndarray:
    sizes = np.array([len(s) for s in a], dtype=np.float64)[:, None] + np.array([len(s) for s in b], dtype=np.float64)[None, :]
    return overlaps(a, b) * (1 + threshold) >= threshold * sizes - 1e-9


def _links(nodes: list[bytes], copies: np.ndarray, sets: list[np.ndarray], edge: int, threshold: float) -> tuple[list[bytes], list[bytes], np.ndarray, np.ndarray]:
    """Nodes with links, their root in this task, other texts and documents linked: of all pairs if ``edge`` is 0, else of nodes before ``edge`` with those from it on."""
    n = len(sets)
    texts, docs, root = np.zeros(n, np.int64), np.zeros(n, np.int64), np.arange(n)

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = int(root[i])
        return i

    for i in range(0, edge or n, TILE):
        rows = range(i, min(i + TILE, edge or n))
        for j in range(edge or i, n, TILE):
            near = _near(sets[i : rows.stop], sets[j : j + TILE], threshold)
            if i == j:
                np.fill_diagonal(near, False)
            width = near.shape[1]
            texts[i : rows.stop] += near.sum(axis=1)
            docs[i : rows.stop] += near @ copies[j : j + width]
            if i != j:
                texts[j : j + width] += near.sum(axis=0)
                docs[j : j + width] += copies[i : rows.stop] @ near
            for k in np.flatnonzero(near.any(axis=1)).tolist():
                a = top(i + k)
                for other in np.unique(root[j + np.flatnonzero(near[k])]).tolist():
                    b = top(other)
                    a, b = min(a, b), max(a, b)
                    root[b] = a
    linked = np.flatnonzero(texts).tolist()
    return [nodes[k] for k in linked], [nodes[top(k)] for k in linked], texts[linked], docs[linked]


_PACKED = "root binary, block int, blocks int, nodes array<binary>, roots array<binary>, texts array<bigint>, docs array<bigint>, lengths array<int>, payload binary"
_PACKED_TYPES = [pa.binary(), pa.int32(), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]


def _pack(threshold: float):
    """Groups of one block are compared; the blocks of larger ones are packed into a row each (``docs`` has the copies of their nodes)."""
    names = [c.split()[0] for c in _PACKED.split(", ")]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (root, block, blocks), (nodes, copies, raw) in _grouped(batches, 3):
            copies = np.array(copies, dtype=np.int64)
            if blocks == 1:
                found = _links(list(nodes), copies, [np.frombuffer(r, dtype=np.uint64) for r in raw], 0, threshold)
                row = (root, block, blocks, *found, None, None)
            else:
                row = (root, block, blocks, list(nodes), None, None, copies, [len(r) // 8 for r in raw], b"".join(raw))
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _PACKED_TYPES, strict=True)], names=names)

    return pack


def _compare_blocks(threshold: float):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (_, nodes, copies, lengths, payload) in _grouped(batches, 3):
            sets: list[np.ndarray] = []
            for own, raw in zip(lengths, payload, strict=True):
                values = np.frombuffer(raw, dtype=np.uint64)
                sets += np.split(values, np.cumsum(own)[:-1])
            found = _links([n for own in nodes for n in own], np.concatenate([np.array(c, np.int64) for c in copies]), sets, len(nodes[0]) if len(nodes) > 1 else 0, threshold)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, (pa.binary(), pa.binary(), pa.int64(), pa.int64()), strict=True)], names=["node", "root", "texts", "docs"])

    return compare


def _dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of a key side by side in one partition."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys).sortWithinPartitions(*keys)


def components(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """node, root of the connected components of edges (a, b): large-star and small-star rounds, each written to the shared folder."""
    pairs = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before, settled = None, False
    for _ in range(rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stage(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "least")
        large = stage(join_hot(both.where("v > u"), least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large-star")
        least2 = stage(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
        links = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")))
        old, pairs = pairs, stage(join_hot(large, least2, "u").select(F.explode(links).alias("e")).select("e.u", "e.v").where("u <> v").distinct(), "small-star")
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        unstage(old, least, large, least2)
        if settled := now == before:
            break
        before = now
    if not settled:
        raise RuntimeError(f"connected components haven't settled in {rounds} rounds")
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    out = stage(pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots), "components")
    unstage(pairs)
    return out


def _children(path: Column, threshold: float) -> Column:
    """The buckets of a node below a path: (path, coordinate, value) for one coordinate or two, 1 / threshold on average."""
    which = [F.pmod(F.xxhash64(path, F.lit(j)), F.lit(COORDINATES)).cast("int") for j in (0, 1)]
    first, second = (F.xxhash64(path, i, F.substring("sketch", 4 * i + 1, F.lit(4))) for i in which)
    fork = F.pmod(F.xxhash64(path, F.lit("fork")), F.lit(1000)) < round(1000 * (1 / threshold - 1))
    return F.when(fork & (which[0] != which[1]), F.array(first, second)).otherwise(F.array(first))


def candidate_edges(nodes: DataFrame, threshold: float, recall: float) -> DataFrame:
    """Edges (a, b), staged, of a forest over the nodes (node, sketch) that shared a bucket of the chosen-path splits and agree."""
    runs = runs_needed(threshold, recall)
    if runs > COORDINATES or threshold <= 0.5:
        raise ValueError(f"a recall of {recall} at {threshold} needs {runs} runs; there are coordinates for {COORDINATES}, and thresholds are above 0.5")
    agreement = least_agreement(threshold)
    first = F.array(*[F.xxhash64(F.lit(i), F.substring("sketch", 4 * i + 1, 4)) for i in range(runs)])  # each run starts on a coordinate of its own
    members = nodes.select("node", F.explode(first).alias("path"))
    small, edges, used = [], [], []
    for depth in range(1, DEPTH + 1):
        sizes = stage(members.groupBy("path").agg(F.count("*").alias("n"), F.min("node").alias("least")).where("n > 1"), f"sizes{depth}")
        found = stage(join_hot(members, sizes.select("path", "n"), "path"), f"bucket{depth}")
        if depth > 1:
            unstage(members)
        small.append(found.where(F.col("n") <= LIMIT).select("path", "node"))
        used += [sizes, found]
        big = sizes.where(F.col("n") > LIMIT)
        if big.isEmpty():
            break
        if depth == DEPTH:
            edges.append(join_hot(found.where(F.col("n") > LIMIT).select("path", "node"), big, "path").select(F.col("node").alias("a"), F.col("least").alias("b")))
            break
        large = stage(found.where(F.col("n") > LIMIT).join(nodes, "node"), f"large{depth}")
        # about SAMPLE nodes of each bucket, by hash
        sample = large.where(F.pmod(F.xxhash64("path", "node"), F.col("n")) < SAMPLE).select("path", "node", "sketch")
        medoids = _dealt(sample, "path").mapInArrow(_medoids, "path bigint, hub binary, hub_sketch binary")
        hubs = stage(big.select("path", "n").join(medoids, "path", "left"), f"hubs{depth}")
        asked = join_hot(large.select("path", "node", "sketch"), hubs, "path").select("path", "node", "sketch", "hub", "hub_sketch")
        judged = stage(asked.mapInArrow(_judged(ALIKE - (1 - agreement)), "path bigint, node binary, sketch binary, hub binary, stays boolean"), f"judged{depth}")
        unstage(large, hubs)
        used.append(judged)
        edges.append(judged.where("hub is not null and hub <> node").select(F.col("node").alias("a"), F.col("hub").alias("b")))
        members = stage(judged.where("stays").select("node", F.explode(_children(F.col("path"), threshold)).alias("path")), f"members{depth + 1}")  # read up to three times, made once
    leaves = small[0]
    for x in small[1:]:
        leaves = leaves.unionByName(x)
    compared = _dealt(leaves.join(nodes, "node").select("path", "node", "sketch"), "path").mapInArrow(_compare_sketches(agreement), "a binary, b binary")
    for x in edges:
        compared = compared.unionByName(x)
    out = stage(compared.distinct(), "candidates")
    unstage(*used)
    return out


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per document: doc_id, class_id (least doc_id of its class), n_links (other documents at the threshold or
    above), n_copies (documents with the same set), n_texts (other sets linked), h (a hash of its text), root (the name
    of its class)."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = stage(docs.select("doc_id", F.xxhash64("text").alias("h"), F.col("text").cast("binary").alias("t")).mapInArrow(_sketches, "doc_id bigint, h bigint, node binary, sketch binary, size int"), "sketches")
    nodes = stage(rows.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("sketch").alias("sketch"), F.first("size").alias("size")), "nodes")
    edges = candidate_edges(nodes.where("sketch is not null").select("node", "sketch"), threshold, recall)
    groups = components(edges)
    unstage(edges)

    known = stage(groups.join(nodes.select("node", "rep", "copies", "size"), "node"), "grouped")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum(F.col("size").cast("bigint") * 8) / BLOCK_BYTES)).cast("int")
    sizes = stage(known.groupBy("root").agg(F.count("*").alias("n"), blocks.alias("blocks")), "groups")
    block = F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("node"), F.col("blocks"))).otherwise(0).cast("int")
    members = stage(join_hot(known, sizes, "root").select("root", block.alias("block"), "blocks", "node", "rep", "copies"), "members")
    unstage(groups, known, sizes)

    absent = F.lit(-(2**63))
    wanted = stage(members.select(F.coalesce("rep", absent).alias("rep")).distinct(), "wanted")
    texts = filter_by(docs.select(F.coalesce("doc_id", absent).alias("rep"), F.col("text").cast("binary").alias("t")), wanted, ["rep"], "left_semi")
    sets = texts.select("t").mapInArrow(_sets, "node binary, shingles binary").dropDuplicates(["node"])  # a node may come with several of its documents
    gathered = sets.join(members, "node").select("root", "block", "blocks", "node", "copies", "shingles")
    packed = stage(_dealt(gathered, "root", "block", "blocks").mapInArrow(_pack(threshold), _PACKED), "packed", "none")
    alone = packed.where("payload is null").select(F.explode(F.arrays_zip(F.col("nodes").alias("node"), F.col("roots").alias("root"), "texts", "docs")).alias("x")).select("x.*")
    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("block", k).alias("i"), F.greatest("block", k).alias("j"))))
    tasks = packed.where("payload is not null").select("root", pairs.alias("p"), "block", "nodes", F.col("docs").alias("copies"), "lengths", "payload").select("root", "p.i", "p.j", "block", "nodes", "copies", "lengths", "payload")
    linked = stage(alone.unionByName(_dealt(tasks, "root", "i", "j").mapInArrow(_compare_blocks(threshold), "node binary, root binary, texts bigint, docs bigint")), "links")
    unstage(members, wanted, packed)

    classes = components(linked.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = linked.groupBy("node").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    whole = stage(nodes.select("node", "rep", "copies").join(counts, "node", "left").join(classes, "node", "left").withColumn("root", F.coalesce("root", "node")), "whole")
    named = stage(whole.groupBy("root").agg(F.min("rep").alias("class_id"), F.count("*").alias("n")), "named")
    facts = stage(join_hot(whole, named, "root").select("node", "root", "class_id", "copies", F.coalesce("texts", F.lit(0)).alias("n_texts"), (F.col("copies") - 1 + F.coalesce("docs", F.lit(0))).alias("n_links")), "facts")
    unstage(nodes, linked, classes, whole, named)
    return join_hot(rows.select("doc_id", "h", "node"), facts, "node", "copies").select("doc_id", "class_id", "n_links", F.col("copies").alias("n_copies"), "n_texts", "h", "root")


def drop_near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """One row of each class of near duplicates, the one of the least doc_id; columns unchanged.

    Rows that go are few next to those that stay: their keys (doc_id and text hash) are what the documents are filtered by.
    """
    found = near_duplicates(docs, doc_id=doc_id, text=text, **kw)
    absent = F.lit(-(2**63))
    keyed = stage(found.select(F.coalesce("doc_id", absent).alias("__id"), F.col("h").alias("__h"), "root", F.coalesce("doc_id", F.lit(2**63 - 1)).alias("order")), "classes")
    kept = keyed.groupBy("root").agg(F.min(F.struct("order", "__id", "__h")).alias("k")).select("k.__id", "k.__h")
    rows = keyed.groupBy("__id", "__h").agg(F.count("*").alias("rows"))
    gone = stage(rows.join(kept, ["__id", "__h"], "left_anti").select("__id", "__h"), "gone")
    again = stage(rows.join(kept, ["__id", "__h"]).where("rows > 1").select("__id", "__h"), "again")  # rows that are repeated as they are
    own = docs.withColumn("__id", F.coalesce(F.col(doc_id).cast("bigint"), absent)).withColumn("__h", F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    stay = filter_by(own, gone, ["__id", "__h"], "left_anti")
    if not again.isEmpty():
        once = filter_by(stay, again, ["__id", "__h"], "left_semi").dropDuplicates(["__id", "__h"])
        stay = filter_by(stay, again, ["__id", "__h"], "left_anti").unionByName(once)
    return stay.select(*docs.columns)
