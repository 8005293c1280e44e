"""Token-ID files: documents as separately compressed id arrays with a shared zstandard dictionary.

A token file is a folder of two Parquet tables, so that any store Spark can commit to will do:

* ``dictionary`` holds one row: the zstandard dictionary trained on serialized id arrays of a bounded sample of
  documents, its SHA-256, the id width, the end id;
* ``blocks`` holds the documents in ascending order of their id. A row is a block of a few MB: ``payload`` joins the
  compressed id arrays, ``index`` has (doc_id, offset, length, start, n_tokens) for each of them, ``dict_sha256`` names the dictionary.
  A single document is read with the index column and one slice of one payload.

Each task encodes and compresses what it scans (the shuffle carries compressed ids, not texts), rows are dealt to
partitions by ascending ranges of doc_id and sorted there. ``start`` counts the ids of all documents before; a block
keeps it within its part, the parts' totals (one row for each part) give the rest when reading.

Encoding is by the tokenizers library. A text is cut into the pieces that no token crosses, the pieces' ids are kept in
a bounded cache of each Python worker, and only unknown pieces go through the library's model.

Defined results: a null or empty text is just the end id; very long texts are encoded whole; repeated rows are all kept, next to each other, tied doc_ids in
the order of a checksum of their ids, then of their frames; null doc_ids come first; an empty table gives an empty file. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_dir, sliced, small_batches, tokenizer_path

#: Documents, chosen by a hash of doc_id, whose id arrays train the dictionary, and the bytes of each array that are looked at.
DICTIONARY_SAMPLE, SAMPLE_BYTES = 1000, 16 << 10
DICTIONARY_BYTES = 112 << 10
BLOCK_BYTES = 2 << 20
CACHE_ENTRIES = 350_000
LEVEL = 3

#: Byte-level BPE cuts a text into such pieces before it merges; written with Python's classes, which agree with the
#: Unicode ones but for other numbers (No, Nl) and a few code points that count as space only for some libraries.
_PIECE = re.compile(r" ?[A-Za-z]++(?![^\W\d_])|'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_ASCII_PIECE = re.compile(r" ?[A-Za-z]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
_UNSURE = frozenset(map(chr, (*range(0x1C, 0x20), 0x85, 0x180E, *range(0x200B, 0x200E), 0x2060, 0xFEFF, *(c for c in range(0x80, 0x110000) if unicodedata.category(chr(c)) in ("No", "Nl")))))
_UNSURE_ASCII = re.compile("[\x1c-\x1f]")
_ENCODED = "doc_id bigint, part int, n_tokens int, frame binary"
_BLOCK = "part int, block int, dict_sha256 string, id_bytes int, n_docs int, n_tokens bigint, start bigint, index array<struct<doc_id:bigint,offset:int,length:int,start:bigint,n_tokens:int>>, payload binary"


def _byte_letters() -> str:
    """The 256 characters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return "".join(chr(b) if b in plain else chr(next(spare)) for b in range(256))


class _Cache(dict):
    """Ids by piece, made when first asked for. When full, it becomes the old generation, from which used keys come back."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > 40:  # hardly ever seen again
                return value
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class PieceEncoder:
    """Ids of texts as little-endian bytes, equal to the tokenizer's on whole texts.

    With a byte-level tokenizer, pieces are looked up in a cache of at most twice ``cache`` entries; texts with code
    points of which the cut isn't certain, and all texts with other tokenizers, are encoded as they are.
    """

    def __init__(self, path: str, cache: int = CACHE_ENTRIES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # texts with the string of an added token are left to the library, which gives them that token's id
        self.added = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or r"(?!)")
        self.type = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        settings = json.loads(self.tokenizer.to_str())
        before = settings.get("pre_tokenizer") or {}
        self.byte_level = settings.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        letters = _byte_letters()
        self.letters = {b: letters[b] for b in range(256)}
        self.model = self.tokenizer.model
        self.written = [i.to_bytes(self.type.itemsize, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.pieces = _Cache(self._piece, cache)

    def _piece(self, piece: str) -> bytes:
        # printable ASCII but the space stands for itself
        letters = piece.replace(" ", self.letters[32]) if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.letters)
        ids = self.written
        return b"".join([ids[t.id] for t in self.model.tokenize(letters)])

    def encode(self, texts: list[str]) -> list[bytes]:
        out, whole, ids = [b""] * len(texts), [], self.pieces.__getitem__
        for i, t in enumerate(texts):
            plain = t.isascii()
            if not self.byte_level or self.added.search(t) or (_UNSURE_ASCII.search(t) if plain else not _UNSURE.isdisjoint(t)):
                whole.append(i)
            else:
                out[i] = b"".join(map(ids, (_ASCII_PIECE if plain else _PIECE).findall(t)))
        if whole:
            for i, x in zip(whole, self.tokenizer.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False), strict=True):
                out[i] = np.array(x.ids, dtype=self.type).tobytes()
        return out


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def train(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary for these id arrays; too few samples to train on give one of their plain bytes."""
    try:
        return zstandard.train_dictionary(min(size, max(256, sum(map(len, samples)) // 8)), samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


def _dictionary(content: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(content) if content else None


def write_token_files(docs: DataFrame, path: str, *, tokenizer: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", parts: int | None = None, level: int = LEVEL) -> None:
    """Encode ``docs`` and write a token file to the folder ``path``."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    chosen = [r.doc_id for r in docs.where("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(DICTIONARY_SAMPLE).collect()]
    own = encoder(tokenizer)
    end = np.array([end_id], dtype=own.type).tobytes()

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            heads = [(x + end)[:SAMPLE_BYTES] for texts in sliced(b.column(1)) for x in enc.encode(texts)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(heads, pa.binary())], names=["doc_id", "ids"])

    # at most 2 * DICTIONARY_SAMPLE * SAMPLE_BYTES reach the driver
    sample = docs.where(F.col("doc_id").isin(chosen)).mapInArrow(heads, "doc_id bigint, ids binary").orderBy("doc_id", "ids").limit(2 * DICTIONARY_SAMPLE).collect() if chosen else []
    content = train([bytes(r.ids) for r in sample])
    name = hashlib.sha256(content).hexdigest()
    spark.createDataFrame([(name, bytearray(content), own.type.itemsize, end_id)], "dict_sha256 string, dictionary binary, id_bytes int, end_id int").coalesce(1).write.mode("overwrite").parquet(f"{path}/dictionary")

    # ascending ranges of doc_id with about as many rows each: a list as long as the number of parts. A doc_id with more rows
    # than a part is the end of several ranges; its rows are dealt to them by what they hold
    cuts = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10_000).alias("q")).first().q if parts > 1 else []
    shared = spark.sparkContext.broadcast((content, np.array(sorted(cuts or []), dtype=np.int64)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        content, edges = shared.value
        packer = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(content))
        for b in batches:
            ids, at = b.column(0), 0
            keys = ids.fill_null(-(2**63)).to_numpy(zero_copy_only=False)
            part = np.searchsorted(edges, keys, side="left")
            ends = np.searchsorted(edges, keys, side="right") - part  # ranges that end with this key
            for texts in sliced(b.column(1)):
                arrays = [x + end for x in enc.encode(texts)]
                n = len(arrays)
                counts = pa.array([len(x) // enc.type.itemsize for x in arrays], pa.int32())
                frames = pa.array([packer.compress(x) for x in arrays], pa.binary())
                own_part = np.array([p + zlib.crc32(x) % e if e > 1 else p for x, p, e in zip(arrays, part[at : at + n].tolist(), ends[at : at + n].tolist(), strict=True)], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([ids.slice(at, n), pa.array(own_part), counts, frames], names=["doc_id", "part", "n_tokens", "frame"])
                at += n

    width = own.type.itemsize

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("dict_sha256", pa.string()), ("id_bytes", pa.int32()), ("n_docs", pa.int32()), ("n_tokens", pa.int64()), ("start", pa.int64()), ("index", pa.list_(pa.struct([("doc_id", pa.int64()), ("offset", pa.int32()), ("length", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int32())]))), ("payload", pa.binary())])
        index, frames, size, block, start, begun = [], [], 0, 0, 0, 0

        def row(part):
            nonlocal index, frames, size, block, begun
            out = pa.RecordBatch.from_pylist([{"part": part, "block": block, "dict_sha256": name, "id_bytes": width, "n_docs": len(index), "n_tokens": start - begun, "start": begun, "index": index, "payload": b"".join(frames)}], schema=schema)
            index, frames, size, block, begun = [], [], 0, block + 1, start
            return out

        part = None
        for b in batches:
            for d, p, n, f in zip(*(c.to_pylist() for c in b.columns), strict=True):
                part = p
                index.append({"doc_id": d, "offset": size, "length": len(f), "start": start - begun, "n_tokens": n})
                frames.append(f)
                size, start = size + len(f), start + n
                if size >= BLOCK_BYTES:
                    yield row(part)
        if index:
            yield row(part)

    dealt = docs.mapInArrow(encode, _ENCODED).repartitionById(parts, F.col("part")).sortWithinPartitions("doc_id", "frame")
    dealt.mapInArrow(pack, _BLOCK).write.mode("overwrite").option("compression", "uncompressed").parquet(f"{path}/blocks")


def _opened(spark: SparkSession, path: str):
    head = spark.read.parquet(f"{path}/dictionary").first()
    content = bytes(head.dictionary)
    if hashlib.sha256(content).hexdigest() != head.dict_sha256:
        raise ValueError(f"the dictionary of {path} doesn't have its hash")
    return content, head.dict_sha256, np.dtype("<u2") if head.id_bytes == 2 else np.dtype("<u4")


def read_token_files(spark: SparkSession, path: str, *, ids: bool = False) -> DataFrame:
    """One row per document of a token file: doc_id, start, n_tokens, ids_crc32, and the ids themselves if asked for."""
    content, name, kind = _opened(spark, path)
    blocks = spark.read.parquet(f"{path}/blocks")
    totals = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row for each part
    base = totals.select("part", (F.sum("n").over(_by_part()) - F.col("n")).alias("base"))
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<int>" if ids else "")
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * ids
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * ids

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor(dict_data=_dictionary(content))
        for b in batches:
            for base, dictionary, index, payload in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if dictionary != name:
                    raise ValueError(f"a block of {path} needs the dictionary {dictionary}")
                columns: list[list] = [[] for _ in names]
                for e in index:
                    raw = unpacker.decompress(payload[e["offset"] : e["offset"] + e["length"]])
                    found = np.frombuffer(raw, dtype=kind)
                    row = (e["doc_id"], base + e["start"], len(found), zlib.crc32(found.astype("<u4").tobytes()), *([found.astype(np.int32)] if ids else ()))
                    for c, v in zip(columns, row, strict=True):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    located = blocks.join(F.broadcast(base), "part") if _few(spark) else blocks.join(base, "part")
    return located.select((F.col("base") + F.col("start")).alias("base"), "dict_sha256", "index", "payload").mapInArrow(decode, schema)


def _few(spark: SparkSession) -> bool:
    """Whether there are so few parts (at most one for each shuffle partition) that their totals can be broadcast."""
    return int(spark.conf.get("spark.sql.shuffle.partitions")) <= 100_000


def _by_part():
    from pyspark.sql import Window

    return Window.orderBy("part")


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """The ids of each document of this id: finds the block by the index column, reads one slice of its payload."""
    content, name, kind = _opened(spark, path)
    unpacker = zstandard.ZstdDecompressor(dict_data=_dictionary(content))
    entry = F.filter("index", lambda e: e["doc_id"] == doc_id)
    rows = spark.read.parquet(f"{path}/blocks").where(F.size(entry) > 0).select("part", "block", F.explode(entry).alias("e"), "payload")
    slices = rows.orderBy("part", "block", "e.offset").select(F.expr("substring(payload, e.offset + 1, e.length)").alias("f")).collect()
    return [np.frombuffer(unpacker.decompress(bytes(r.f)), dtype=kind).tolist() for r in slices]


def encode_documents(docs: DataFrame, *, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, **kw) -> DataFrame:
    """Write ``docs`` as a token file in the shared folder and return what the file says of each document."""
    path = f"{scratch_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write_token_files(docs, path, tokenizer=tokenizer_path(tokenizer), end_id=end_id, **kw)
    return read_token_files(docs.sparkSession, path)
