"""Token ids in files of compressed documents.

A file set is a folder of two tables.  `dictionary` has one row: a zstandard
dictionary trained on serialized id arrays, and its SHA-256.  `blocks` has a
row per run of documents, in ascending order of id over all parts: counts in
plain columns, and the payload

    magic, id width, dictionary hash, number of documents n,
    n ids, n null marks, n token counts, n + 1 offsets, n zstandard frames

all little-endian.  A frame holds one document's ids and is readable with the
dictionary alone, so `fetch` opens single documents by the offset index.

The files are Parquet written and committed by Spark, so a lost task is simply
run again, and any store that Spark reads will do.

Defined results: a null text is an empty one; every document gets the end id;
documents with equal ids keep a stable order by their contents; a null doc_id
sorts first; an empty table gives no blocks; other columns are not kept.  A very
long text has one frame, and a block of its own if it fills one.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkloom.llm.pieces import IdLists, cut, joined, slices
from linkloom.llm.sampling import some_rows
from linkloom.llm.words import spread_ranges
from linkloom.operators.staging import staged

MAGIC = b"LLTK"
HEAD = struct.Struct("<4sB32sI")
BLOCK_BYTES = 2 << 20
SAMPLE_DOCS = 400
SAMPLE_CHARS = (100, 8_000)  # the dictionary serves short documents
DICTIONARY_BYTES = 32 << 10
LEVEL = 3
LINE_WORDS = 500
HELD_WORDS = 500_000
_LETTERS = np.zeros(256, bool)
_LETTERS[65:91] = _LETTERS[97:123] = True

FRAMES = "doc_id bigint, n_tokens bigint, frame binary"
BLOCKS = "part int, block int, n_docs bigint, n_ids bigint, first_doc bigint, last_doc bigint, payload binary"


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    closes = np.zeros(max(library.get_vocab().values()) + 1, bool)
    closes[[i for token, i in library.get_vocab().items() if token.endswith("</w>")]] = True
    return library, IdLists(HELD_WORDS), closes


def plain_words(pieces: list[bytes]) -> np.ndarray:
    """Which pieces are letters of Latin-1 only, but for one blank or newline before them."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    data = np.frombuffer(b"".join(pieces), np.uint8)
    starts = np.cumsum(sizes) - sizes
    leads = data == 0xC3
    trails = np.zeros(len(data), bool)
    trails[1:] = leads[:-1] & (data[1:] >= 0x80) & (data[1:] < 0xC0) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    leads[:-1] &= trails[1:]
    good = _LETTERS[data] | leads | trails
    lone = (sizes == 1) & ~good[starts]
    good[starts] |= (data[starts] == 32) | (data[starts] == 10)
    return np.logical_and.reduceat(good, starts) & ~lone if len(pieces) else np.zeros(0, bool)


def token_lists(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, and where each text begins, with the end behind.

    The tokenizer drops white space and never looks across it, so each distinct
    piece is encoded once.
    """
    library, held, closes = _tokenizer(path)

    def each(new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in library.encode_batch_fast(new, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum())), sizes

    def encode(new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Plain words go through in lines of many; each ends with the first token that closes a word."""
        plain = plain_words(new)
        simple = plain.tolist()
        lines = [p for p, is_plain in zip(new, simple) if is_plain]
        ids, _ = each([b" ".join(lines[i : i + LINE_WORDS]).decode() for i in range(0, len(lines), LINE_WORDS)])
        ends = np.flatnonzero(closes[ids])
        if len(ends) != len(lines):
            return each([p.decode() for p in new])
        rest, rest_sizes = each([p.decode() for p, is_plain in zip(new, simple) if not is_plain])
        sizes, starts = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
        sizes[plain], sizes[~plain] = np.diff(ends, prepend=-1), rest_sizes
        starts[plain] = ends + 1 - sizes[plain]
        starts[~plain] = len(ids) + np.cumsum(rest_sizes) - rest_sizes
        return np.concatenate([ids, rest])[spread_ranges(starts, sizes)], sizes

    pieces = cut(texts)
    # The tokenizer lower-cases; what may be a special token is left as it is.
    folded = [p if b"<" in p else p.lower() for p in pieces.distinct]
    return joined(*held.of(folded, encode), pieces)


def id_width(path: str) -> int:
    return 2 if _tokenizer(path)[0].get_vocab_size() <= 1 << 16 else 4


def _codec(dictionary: bytes):
    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return shared


def train(docs: DataFrame, path: str, end_id: int, text: str = "text") -> bytes:
    """A dictionary from a bounded sample of documents of medium length.

    The sample decides about compression only, never about contents.
    """
    size = F.char_length(text)
    short = docs.where((size >= SAMPLE_CHARS[0]) & (size <= SAMPLE_CHARS[1])).select(F.col(text).alias("t"))
    texts = [r.t for r in some_rows(short, SAMPLE_DOCS, docs.count())]
    ids, bounds = token_lists(pa.array(texts, pa.string()), path)
    kind = f"<u{id_width(path)}"
    samples = [np.append(ids[a:b], end_id).astype(kind).tobytes() for a, b in zip(bounds, bounds[1:])]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too little to train on
        return b""


def frames(docs: DataFrame, path: str, dictionary: bytes, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, frame): each text encoded and compressed on its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = f"<u{id_width(path)}"
        writer = zstandard.ZstdCompressor(level=LEVEL, dict_data=_codec(dictionary), write_dict_id=False)
        for batch in batches:
            lo = 0
            for texts in slices(batch.column(1)):
                ids, bounds = token_lists(texts, path)
                sizes = np.diff(bounds) + 1
                full = np.full(len(ids) + len(sizes), end_id, kind)
                ends = np.cumsum(sizes) - 1
                inner = np.ones(len(full), bool)
                inner[ends] = False
                full[inner] = ids
                raw = memoryview(full).cast("B")
                cuts = np.append(0, ends + 1) * full.itemsize
                packed = [writer.compress(raw[a:b]) for a, b in zip(cuts.tolist(), cuts[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, len(texts)), pa.array(sizes), pa.array(packed, pa.binary())],
                    names=["doc_id", "n_tokens", "frame"],
                )
                lo += len(texts)

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, FRAMES)


def _packed(ids: list, counts: list, packed: list, width: int, digest: bytes) -> bytes:
    n = len(ids)
    offsets = np.zeros(n + 1, "<u8")
    np.cumsum([len(f) for f in packed], out=offsets[1:])
    known = np.array([i is not None for i in ids], np.uint8)
    return b"".join(
        [
            HEAD.pack(MAGIC, width, digest, n), np.array([i or 0 for i in ids], "<i8").tobytes(), (1 - known).tobytes(),
            np.array(counts, "<u8").tobytes(), offsets.tobytes(), *packed,
        ]
    )


class BlockReader:
    """A payload's index, and its documents one by one."""

    def __init__(self, payload: bytes, dictionary: bytes):
        magic, self.width, digest, n = HEAD.unpack_from(payload)
        if magic != MAGIC or digest != hashlib.sha256(dictionary).digest():
            raise ValueError("not a token block, or one of another dictionary")
        at = HEAD.size
        self.doc_ids = np.frombuffer(payload, "<i8", n, at)
        self.nulls = np.frombuffer(payload, np.uint8, n, at + 8 * n).astype(bool)
        self.counts = np.frombuffer(payload, "<u8", n, at + 9 * n).astype(np.int64)
        self.offsets = np.frombuffer(payload, "<u8", n + 1, at + 17 * n).astype(np.int64)
        self.body = memoryview(payload)[at + 25 * n + 8 :]
        self.codec = zstandard.ZstdDecompressor(dict_data=_codec(dictionary))

    def ids(self, i: int) -> np.ndarray:
        frame = self.body[self.offsets[i] : self.offsets[i + 1]]
        return np.frombuffer(self.codec.decompress(frame), f"<u{self.width}").astype("<u4")


def write(
    docs: DataFrame, folder: str, path: str, end_id: int = 1, doc_id: str = "doc_id", text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> None:
    """Encode all texts into a new file set."""
    spark = docs.sparkSession
    dictionary = train(docs, path, end_id, text)
    width, digest = id_width(path), hashlib.sha256(dictionary).digest()
    spark.createDataFrame([(digest, dictionary)], "hash binary, content binary").coalesce(1).write.parquet(f"{folder}/dictionary")
    coded = staged(frames(docs, path, dictionary, end_id, doc_id, text))
    order = ["doc_id", "n_tokens", F.xxhash64("frame")]  # the last two part equal ids, however many rows have them
    ordered = coded.repartitionByRange(*order).sortWithinPartitions(*order)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        ids, counts, packed, size, block = [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            payload = _packed(ids, counts, packed, width, digest)
            row = [[part], [block], [len(ids)], [sum(counts)], [ids[0]], [ids[-1]], [payload]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], names=[c.split()[0] for c in BLOCKS.split(", ")])

        for batch in batches:
            for i, n, frame in zip(*(c.to_pylist() for c in batch.columns)):
                ids.append(i)
                counts.append(n)
                packed.append(frame)
                size += len(frame)
                if size >= block_bytes:
                    yield flush()
                    ids, counts, packed, size, block = [], [], [], 0, block + 1
        if ids:
            yield flush()

    ordered.mapInArrow(pack, BLOCKS).write.parquet(f"{folder}/blocks")


def dictionary_of(spark: SparkSession, folder: str) -> bytes:
    return bytes(spark.read.parquet(f"{folder}/dictionary").first().content)


def starts(blocks: DataFrame) -> DataFrame:
    """(part, block, start): ids before each block.  Parts are summed first, so no task sees all blocks."""
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    of_part = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__of_part"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    rows = blocks.select("part", "block", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("__inside"))
    return rows.join(of_part, "part").select("part", "block", (F.col("__of_part") + F.col("__inside")).alias("start"))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    dictionary = dictionary_of(spark, folder)
    blocks = spark.read.parquet(f"{folder}/blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, block, payload in zip(*(batch.column(i).to_pylist() for i in range(3))):
                reader = BlockReader(payload, dictionary)
                n = len(reader.doc_ids)
                crcs = [zlib.crc32(reader.ids(i).tobytes()) for i in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, block, np.int32)),
                        pa.array(reader.doc_ids, pa.int64(), mask=reader.nulls), pa.array(np.cumsum(reader.counts) - reader.counts),
                        pa.array(reader.counts), pa.array(crcs, pa.int64()),
                    ],
                    names=["part", "block", "doc_id", "within", "n_tokens", "ids_crc32"],
                )

    docs = blocks.select("part", "block", "payload").mapInArrow(
        run, "part int, block int, doc_id bigint, within bigint, n_tokens bigint, ids_crc32 bigint"
    )
    found = docs.join(starts(blocks), ["part", "block"])
    return found.select("doc_id", (F.col("start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def fetch(spark: SparkSession, folder: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids) of some documents: only blocks that can hold them are opened, only their frames decompressed."""
    dictionary = dictionary_of(spark, folder)
    wanted = np.array(sorted(set(doc_ids)), np.int64)
    blocks = spark.read.parquet(f"{folder}/blocks")
    values = F.array(*map(F.lit, wanted.tolist())).cast("array<bigint>")
    near = blocks.where(F.exists(values, lambda d: (d >= F.coalesce("first_doc", F.lit(-(1 << 63)))) & (d <= F.col("last_doc"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column(0).to_pylist():
                reader = BlockReader(payload, dictionary)
                rows = np.flatnonzero(np.isin(reader.doc_ids, wanted) & ~reader.nulls)
                ids = [reader.ids(i).tolist() for i in rows]
                yield pa.RecordBatch.from_arrays([pa.array(reader.doc_ids[rows]), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return near.select("payload").mapInArrow(run, "doc_id bigint, ids array<bigint>")
