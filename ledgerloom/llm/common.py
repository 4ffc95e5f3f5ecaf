"""Shared plumbing: written tables in the cluster's folder, salted group statistics, Arrow text buffers.

Spark hands Python whole Arrow batches, so the text of a batch is one byte buffer with offsets. The
helpers below work on that buffer with numpy: no Python object exists per word.
"""

import contextlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.sources.shared import delete, new_path, written_to

#: The white space that separates words in every contract: space and \t \n \v \f \r.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"

_open: list[list[str]] = []


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Writes df once to the shared folder and reads it back, which cuts its lineage.

    Ids given by position stay fixed from here on, and a lost executor costs a reread only. The table goes with the
    application, inside `scratch` when the block ends.
    """
    path = new_path(df.sparkSession, label)
    if _open:
        _open[-1].append(path)
    return written_to(df, path)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Yields keep(df, label), which writes a table that outlives the block; all other tables written in it are deleted."""
    _open.append(mine := [])

    def keep(df: DataFrame, label: str) -> DataFrame:
        out = materialise(df, label)
        path = mine.pop()
        if len(_open) > 1:  # it lives as long as the block around this one
            _open[-2].append(path)
        return out

    try:
        yield keep
    finally:
        _open.pop()
        for path in mine:
            delete(spark, path)


def with_group(df: DataFrame, keys: list[str], spread: Column, stats: dict[str, tuple[Column, str]], salts: int = 64) -> DataFrame:
    """Adds to every row statistics of its whole group, though one group may hold a third of all rows.

    stats: name -> (aggregate over rows, "min" | "max" | "sum" that merges partial results). A group is
    dealt over `salts` tasks by `spread`; its at most `salts` partial results are merged and joined
    back by (keys, salt), so no task ever sees a whole hot group.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    by = [*keys, "_salt"]
    partial = salted.groupBy(*by).agg(*[a.alias(n) for n, (a, _) in stats.items()])
    group = Window.partitionBy(*keys)
    merge = {"min": F.min, "max": F.max, "sum": F.sum}
    total = partial.select(*by, *[merge[m](n).over(group).alias(n) for n, (_, m) in stats.items()])
    return salted.join(total, by).drop("_salt")


def salted_join(df: DataFrame, other: DataFrame, key: str, spread: Column, how: str = "inner", salts: int = 64) -> DataFrame:
    """df joined to `other` (one row a key), though one key may hold a third of df's rows: at most `salts` copies of that row."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    each = salted.select(key, "_salt").distinct().join(other, key)
    return salted.join(each, [key, "_salt"], how).drop("_salt")


def quoted(name: str) -> str:
    """A column name that may hold dots or back quotes, as Spark reads it."""
    return "`" + name.replace("`", "``") + "`"


def whole_row(docs: DataFrame) -> Column:
    return F.struct(*[F.col(quoted(c)) for c in docs.columns])


def boxed(docs: DataFrame, **keys: Column) -> DataFrame:
    """The keys beside `_row`, which holds all columns of docs: no name of the caller can clash with an operator's."""
    return docs.select(whole_row(docs).alias("_row"), *[c.alias(n) for n, c in keys.items()])


def id_keys(doc_id: Column) -> dict[str, Column]:
    """A doc_id as two columns without nulls, so that it can be grouped and joined by plain equality."""
    return {"_key": F.coalesce(doc_id.cast("long"), F.lit(0)), "_none": doc_id.isNull()}


def one_of_each(docs: DataFrame, stay: DataFrame, **keys: Column) -> DataFrame:
    """The rows of docs whose keys are in `stay` (columns named like the keys, none null), one for each key.

    Of rows with equal keys the one with the smallest hash of all its columns stays, so reruns agree. Equal keys
    collapse where the rows lie, before they move.
    """
    kinds = dict(docs.dtypes)
    plain = [F.to_json(F.struct(F.col(quoted(c)))) if "map<" in kinds[c] or "variant" in kinds[c] else F.col(quoted(c)) for c in docs.columns]
    keyed = boxed(docs, **keys, _hash=F.xxhash64(*plain))
    first = keyed.groupBy(*keys).agg(F.min_by("_row", "_hash").alias("_row"))
    return first.join(stay, list(keys), "left_semi").select("_row.*")


# ---------------------------------------------------------------- text in Arrow batches


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array, nulls as empty texts, and the offsets of its rows."""
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    ends = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` bytes of text (a longer text alone), to bound memory."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            done = size[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(size, done + limit, "right")))
            yield batch.slice(start, end - start)
            start = end


_SPACE = np.zeros(256, bool)
_SPACE[[ord(c) for c in SPACES]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in the buffer, and for each text the offset of its first word."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    gap = space[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    first = ~gap
    last = first.copy()
    first[1:] &= gap[:-1] | cut[1:n]
    last[:-1] &= gap[1:] | cut[1:n]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


#: The lowest k bytes of a long, for k up to 8.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finishes 64-bit hashes so that all bits depend on all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lower-cased if fold.

    Each 8 bytes, with a key of their place in the word, are mixed before they are added up, so neither order nor structure cancels out.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    chunks = (size + 7) >> 3
    at = np.cumsum(chunks) - chunks
    place = np.arange(int(at[-1] + chunks[-1]), dtype=np.int64) - np.repeat(at, chunks)
    padded = np.concatenate([_LOWER[data] if fold else data, np.zeros(8, np.uint8)])
    eights = np.lib.stride_tricks.sliding_window_view(padded, 8)[np.repeat(starts, chunks) + (place << 3)]
    code = np.ascontiguousarray(eights).view("<u8").reshape(-1)
    left = np.repeat(size, chunks) - (place << 3)
    code &= _FIRST[np.minimum(left, 8)]
    code = mix(code ^ mix(place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    return mix(np.add.reduceat(code, at) + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_GRAM = [np.uint64(x) for x in (0x9FB21C651E98DF25, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n successive words (n up to 5), in order."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for i in range(n):
        out += mix(hashes[i : i + m] * _GRAM[i] + np.uint64(i + 1))
    return mix(out)


def crc_of(ids: pa.Array) -> np.ndarray:
    """crc32 of each id written as text, the split that contracts name (null: of an empty text)."""
    import zlib

    return np.array([zlib.crc32(b"" if i is None else b"%d" % i) for i in ids.to_pylist()], np.int64)
