"""Operator 8: token counts by a map-side two-tier lookup, without any shuffle of pre-tokens.

Pass 1 counts pre-tokens map-side: every task keeps a bounded heavy-hitter summary of all its texts, and the
summaries merge in a tree, so what moves is one bounded blob a task. The most frequent pre-tokens with their
lengths in tokens form the compact table that is broadcast (tier 1). Pass 2 looks every pre-token up there and then
in the worker's own bounded cache (tier 2), which encodes what it misses. The table decides speed only: counts
are exact whatever it holds.

Nulls count as empty (0 bytes, 0 tokens); other columns play no part; an empty table gives an empty result;
repeated rows give repeated rows.
"""

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ledgerloom.llm.common import flat, slices
from ledgerloom.llm.token_cache import CachedTokenizer, PartTable, byte_level_parts, identities
from ledgerloom.shipping import ship

#: Entries of the broadcast table, and counters that a task's summary may hold while it runs.
TABLE, COUNTERS = 32_768, 200_000


def prune(counts: dict[bytes, int], size: int) -> dict[bytes, int]:
    """The `size` largest counters, less the largest that goes (Misra-Gries): bounded, and mergeable."""
    if len(counts) <= size:
        return counts
    kept = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: size + 1]
    floor = kept[-1][1]
    return {k: v - floor for k, v in kept[:-1] if v > floor}


def merge(a: bytes, b: bytes, size: int = TABLE) -> bytes:
    if not a or not b:
        return a or b
    both: dict[bytes, int] = pickle.loads(a)
    for k, v in pickle.loads(b).items():
        both[k] = both.get(k, 0) + v
    return pickle.dumps(prune(both, size))


class Summary:
    """Heavy hitters among the parts of many texts, with at most 2 * counters entries."""

    def __init__(self, counters: int):
        self.counters, self.table, self.seen, self.parts = counters, PartTable(None), np.zeros(0, np.int64), []

    def add(self, column: pa.Array) -> None:
        data, offsets = flat(column)
        starts, ends, _ = byte_level_parts(data, offsets)
        key, tag = identities(data, starts, ends)
        both, first, times = np.unique(key ^ (tag >> np.uint64(1)), return_index=True, return_counts=True)
        entry = self.table.find(key[first], tag[first])
        new = np.flatnonzero(entry < 0)
        raw = data.tobytes()
        self.parts += [raw[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)]
        entry[new] = np.arange(len(self.seen), len(self.seen) + len(new))
        self.table.add(key[first[new]], tag[first[new]], np.zeros(len(new), np.int64))
        self.seen = np.concatenate([self.seen, np.zeros(len(new), np.int64)])
        self.seen[entry] += times
        if len(self.seen) > 2 * self.counters:
            order = np.argsort(-self.seen, kind="stable")
            floor = self.seen[order[self.counters]]
            kept = np.sort(order[: self.counters][self.seen[order[: self.counters]] > floor])
            self.table, self.seen, self.parts = self.table.only(kept), self.seen[kept] - floor, [self.parts[k] for k in kept.tolist()]

    def counts(self) -> dict[bytes, int]:
        return dict(zip(self.parts, self.seen.tolist(), strict=True))


def frequent(docs: DataFrame, text_column: str = "text", size: int = TABLE, counters: int = COUNTERS) -> dict[bytes, int]:
    """Heavy-hitter pre-tokens of the whole column, at most `size`."""

    ship(docs.sparkSession)

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Summary(counters)
        for b in slices(batches, "text"):
            found.add(b["text"])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(prune(found.counts(), size))], pa.binary())], ["blob"])

    blobs = docs.select(docs[text_column].alias("text")).mapInArrow(summarise, "blob binary").rdd.map(lambda r: bytes(r.blob))
    merged = blobs.treeAggregate(b"", lambda a, b: merge(a, b, size), lambda a, b: merge(a, b, size), depth=3)
    return pickle.loads(merged) if merged else {}


def length_table(parts: list[str], path: str) -> PartTable:
    """The compact table: the number of tokens of each part by its hashes."""
    own = CachedTokenizer(path, words=False, lengths=True)
    own.count([p for p in parts if not own.whole(p)])
    return own.table


_tokenizers: dict = {}


def _worker(path: str, name: str, table) -> CachedTokenizer:
    """One a worker process; only the newest stays in memory."""
    if (path, name) not in _tokenizers:
        _tokenizers.clear()
        _tokenizers[path, name] = CachedTokenizer(path, words=False, lengths=True, hot=table.value)
    return _tokenizers[path, name]


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, text_column: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit)."""
    spark = docs.sparkSession
    seen = sorted(frequent(docs, text_column))
    table = spark.sparkContext.broadcast(length_table([p.decode("utf-8", "surrogatepass") for p in seen], path))
    name = uuid.uuid4().hex

    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _worker(path, name, table)
        for b in slices(batches, "text"):
            n = pa.array(t.count([x or "" for x in b["text"].to_pylist()]), pa.int64())
            size = pc.fill_null(pc.binary_length(b["text"]).cast(pa.int64()), 0)
            yield pa.RecordBatch.from_arrays([b["doc_id"], size, n, pc.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs[text_column].alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
