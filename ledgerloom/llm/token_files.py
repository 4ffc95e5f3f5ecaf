"""Operator 6: token-id files with fixed-width bit packing.

File format (little-endian). A file is a row of shards. A shard holds whole documents in ascending doc_id order:

    header   magic "LLTK", u8 version, u8 bits, u16 block, u32 part, u32 shard, u64 docs, u64 tokens, u64 before, u64 bytes
    ids      i64 x docs        doc_id (0 where null)
    nulls    u8 x docs         1 where doc_id is null
    ends     u64 x docs        running number of tokens in the shard
    offsets  u64 x blocks      byte offset of each block of `block` ids in the payload
    payload  every id in `bits` bits, least significant first; a block starts on a byte
    end      one byte 0x0A

`bits` is the smallest width that holds the vocabulary. `before` counts the part's tokens in earlier shards. Any run of
tokens can be unpacked alone: its blocks are found by the offsets. Files are written and read by Spark's own
readers and writers, so any store that Spark reaches will do; a file holds one shard, which bounds a reader's memory.

Rows sort by (doc_id, hash of the text); a null doc_id comes first; rows with equal doc_id and text are
interchangeable. A null text counts as empty and has the end id only. Extra columns play no part.
"""

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.llm.common import materialise, slices
from ledgerloom.llm.token_cache import CachedTokenizer
from ledgerloom.shipping import ship
from ledgerloom.sources.shared import new_path

HEADER = struct.Struct("<4sBBHIIQQQQ")
#: Ids a block, and tokens a shard: 64 MB and more in 16 bits, so that files are not many.
BLOCK, SHARD = 4096, 1 << 25


def pack(ids: np.ndarray, bits: int, block: int = BLOCK) -> tuple[bytes, np.ndarray]:
    """The ids in `bits` bits each, and the byte offset of every block."""
    starts = np.arange(0, len(ids), block)
    offsets = (starts // block * ((block * bits + 7) // 8)).astype("<u8")
    if bits in (8, 16, 32) and block * bits % 8 == 0:
        return ids.astype(f"<u{bits // 8}").tobytes(), offsets
    out = []
    for s in starts:
        some = ids[s : s + block].astype(np.uint32)
        out.append(np.packbits(((some[:, None] >> np.arange(bits, dtype=np.uint32)) & 1).astype(np.uint8), bitorder="little").tobytes())
    return b"".join(out), offsets


def unpack(payload: bytes | memoryview, offsets: np.ndarray, bits: int, start: int, end: int, block: int = BLOCK) -> np.ndarray:
    """The ids start..end-1, from the blocks that hold them."""
    if end <= start:
        return np.zeros(0, np.uint32)
    if bits in (8, 16, 32) and block * bits % 8 == 0:
        return np.frombuffer(payload, f"<u{bits // 8}", end - start, start * bits // 8).astype(np.uint32)
    out = []
    for k in range(start // block, (end - 1) // block + 1):
        raw = np.frombuffer(payload, np.uint8)[int(offsets[k]) : int(offsets[k]) + (block * bits + 7) // 8]
        n = min(block, len(raw) * 8 // bits)
        flags = np.unpackbits(raw, bitorder="little")[: n * bits].reshape(n, bits)
        ids = (flags.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(1, dtype=np.uint32)
        out.append(ids[max(0, start - k * block) : end - k * block])
    return np.concatenate(out)


def write_shard(part: int, shard: int, before: int, doc_ids: list, ids: list[np.ndarray], bits: int) -> bytes:
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    payload, offsets = pack(flat, bits)
    ends = np.cumsum([len(x) for x in ids]).astype("<u8")
    body = np.array([i or 0 for i in doc_ids], "<i8").tobytes() + np.array([i is None for i in doc_ids], np.uint8).tobytes() + ends.tobytes() + offsets.tobytes() + payload
    return HEADER.pack(b"LLTK", 1, bits, BLOCK, part, shard, len(doc_ids), len(flat), before, len(body)) + body


class Shard:
    """A shard in a file's bytes; tokens(i) are the ids of its i-th document."""

    def __init__(self, raw: memoryview):
        magic, version, self.bits, self.block, self.part, self.shard, self.docs, self.tokens, self.before, size = HEADER.unpack_from(raw)
        if magic != b"LLTK" or version != 1:
            raise ValueError("not a token file")
        at, n = HEADER.size, self.docs
        self.size = at + size + 1
        self.doc_ids = np.frombuffer(raw, "<i8", n, at)
        self.null = np.frombuffer(raw, np.uint8, n, at + 8 * n).astype(bool)
        self.ends = np.frombuffer(raw, "<u8", n, at + 9 * n).astype(np.int64)
        blocks = -(-self.tokens // self.block)
        self.offsets = np.frombuffer(raw, "<u8", blocks, at + 17 * n)
        self.payload = raw[at + 17 * n + 8 * blocks : at + size]

    def run(self, start: int, end: int) -> np.ndarray:
        return unpack(self.payload, self.offsets, self.bits, start, end, self.block)

    def document(self, i: int) -> np.ndarray:
        return self.run(int(self.ends[i - 1]) if i else 0, int(self.ends[i]))


def shards(raw: bytes | pa.Buffer) -> Iterator[Shard]:
    view = memoryview(raw)
    while len(view):
        shard = Shard(view)
        yield shard
        view = view[shard.size :]


_tokenizers: dict = {}


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, shard_tokens: int = SHARD) -> None:
    """Encodes all documents, each followed by end_id, into files under `path`."""

    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _tokenizers:
            _tokenizers[tokenizer_path] = CachedTokenizer(tokenizer_path, words=True)
        t = _tokenizers[tokenizer_path]
        part, shard, before, held = TaskContext.get().partitionId(), 0, 0, 0
        doc_ids, ids = [], []

        def flush():
            raw = write_shard(part, shard, before, doc_ids, ids, t.bits)
            return pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], ["shard"])

        for b in slices(batches, "text"):
            for i, x in zip(b["doc_id"].to_pylist(), t.encode([x or "" for x in b["text"].to_pylist()]), strict=True):
                doc_ids.append(i)
                ids.append(np.append(x, t.kind.type(end_id)))
                held += len(ids[-1])
                if held >= shard_tokens:
                    yield flush()
                    shard, before, held, doc_ids, ids = shard + 1, before + held, 0, [], []
        if doc_ids:
            yield flush()

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    rows = rows.withColumn("_h", F.xxhash64("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, "doc_id", "_h").sortWithinPartitions("doc_id", "_h").select("doc_id", "text")
    packed = dealt.mapInArrow(run, "shard binary")
    # the text writer puts a string's bytes down as they are, then the line end that closes the shard
    packed.select(F.col("shard").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("lineSep", "\n").text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: part, doc_id, start within the part, n_tokens, ids_crc32."""

    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for value in b["content"]:
                for s in shards(value.as_buffer()):
                    n = np.diff(s.ends, prepend=0)
                    ids = s.run(0, s.tokens).astype("<u4")
                    raw = memoryview(ids).cast("B")
                    stop = (s.ends * 4).tolist()
                    crc = [zlib.crc32(raw[e - k * 4 : e]) for e, k in zip(stop, n.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(s.docs, s.part), pa.int64()), pa.array(s.doc_ids, pa.int64(), mask=s.null), pa.array(s.before + s.ends - n, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["part", "doc_id", "start", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "part long, doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_read(docs: DataFrame, tokenizer_path: str, end_id: int = 1, path: str | None = None) -> DataFrame:
    """Writes the token files, reads them back, and gives each document's place among all tokens."""
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    write(docs, path, tokenizer_path, end_id)
    found = materialise(read(spark, path), "token-index")
    parts = found.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    # one row a written partition, so this window is small at any size
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    return found.join(base, "part").select("doc_id", (F.col("start") + F.col("_base")).alias("start"), "n_tokens", "ids_crc32")
