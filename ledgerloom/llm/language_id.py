"""Operator 9: language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1 (drawn from its code point, so workers agree). An n-gram's vector
binds its letters: the product of their vectors, each rotated by its place. A text bundles the vectors of all its
n-grams into a sum; a language's prototype bundles the unit vectors of its texts. The prediction is the language with
the largest cosine between text and prototype.

N-grams run over letters, lower-cased, with one space for anything between words and at both ends. Bundles and prototypes
are whole numbers, so sums are exact: a text's score depends on the text alone, not on the rows beside it. Prototypes are learned
from about `rows` texts (default TRAIN_ROWS), shared equally among the languages, so that a rare one is learned too; the
languages are few, one prototype each. Partial sums merge in two steps, so no task gathers a language. Prediction covers every
text, map-side.

A null text or one without letters is `und` with score 0; so is every text where nothing could be learned (accept() then keeps
every text with letters). Ties go to the first language in code point order. Rows that repeat doc_id and text are learned once
a language. Other columns play no part; repeated rows give repeated rows.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import slices
from ledgerloom.llm.labelled import remainder
from ledgerloom.shipping import ship

DIM, GRAM, TRAIN_ROWS = 1024, 3, 30_000
_ROWS, _GRAMS = 256, 8192
#: Unit vectors are rounded to multiples of 1 / SCALE when they are learned from, prototypes to those of 1 / FINE.
SCALE, FINE = 1 << 20, 1 << 15

_alpha: list = []
_letters: dict[tuple, np.ndarray] = {}


def _is_letter() -> np.ndarray:
    if not _alpha:
        _alpha.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _alpha[0]


def letter_vectors(points: np.ndarray, dim: int = DIM) -> np.ndarray:
    """One row of +1 and -1 for each code point."""
    out = np.empty((len(points), dim), np.int8)
    for i, c in enumerate(points.tolist()):
        v = _letters.get((c, dim))
        if v is None:
            v = np.random.Generator(np.random.PCG64(0x5EED0000 + c)).integers(0, 2, dim, dtype=np.int8) * 2 - 1
            if len(_letters) < 20_000:
                _letters[c, dim] = v
        out[i] = v
    return out


def bundles(texts: list[str], dim: int = DIM) -> tuple[np.ndarray, np.ndarray]:
    """The bundle of each text, and whether it has a letter."""
    # 32-bit sums of whole numbers are exact up to 2^24
    exact = np.float32 if sum(map(len, texts)) < 1 << 24 else np.float64
    out, has = np.zeros((len(texts), dim), exact), np.zeros(len(texts), bool)
    code = np.frombuffer(" ".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    letter = _is_letter()[code]
    row = np.concatenate([np.zeros(1, np.int64), np.repeat(np.arange(len(texts)), sizes)])
    has[row[letter]] = True
    keep = letter.copy()
    keep[0] = True  # the space before the first word
    keep[1:] |= letter[:-1]  # the one space after a word
    code, row = np.where(letter, code, 32)[keep], row[keep]
    points, sym = np.unique(code, return_inverse=True)
    k = len(points)
    space = np.searchsorted(points, 32)
    a, b, c = sym[:-2], sym[1:-1], sym[2:]
    inside = b != space  # so no n-gram spans two words, or two texts
    gram = ((a * k + b) * k + c)[inside]
    kinds, which = np.unique(gram, return_inverse=True)
    row = row[1:-1][inside]
    pair, count = np.unique(row * len(kinds) + which, return_counts=True)
    row, which = pair // max(1, len(kinds)), pair % max(1, len(kinds))
    vectors = letter_vectors(points, dim)
    first, second = np.roll(vectors, 2, 1), np.roll(vectors, 1, 1)
    order = np.argsort(which, kind="stable")
    row, which, count = row[order], which[order], count[order].astype(exact)
    for g in range(0, len(kinds), _GRAMS):
        ids = kinds[g : g + _GRAMS]
        bound = (first[ids // (k * k)] * second[ids // k % k] * vectors[ids % k]).astype(exact)
        lo, hi = np.searchsorted(which, [g, g + len(ids)])
        table = np.zeros((len(texts), len(ids)), exact)
        table[row[lo:hi], which[lo:hi] - g] = count[lo:hi]
        out += table @ bound
    return out, has


def _blocks(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for i in range(0, len(texts), _ROWS):
        yield (i, *bundles(texts[i : i + _ROWS]))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(-1, keepdims=True)), 1e-12)


class Profiles:
    def __init__(self, langs: list[str], prototypes: np.ndarray):
        self.langs, self.prototypes = langs, np.rint(_unit(prototypes.astype(np.float64)) * FINE)
        self.lengths = np.sqrt((self.prototypes**2).sum(1))

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        langs, scores = ["und"] * len(texts), np.zeros(len(texts))
        if self.langs:
            for i, sums, has in _blocks(texts):
                sums = sums.astype(np.float64)
                cos = sums @ self.prototypes.T / (np.maximum(np.sqrt((sums * sums).sum(1)), 1e-12)[:, None] * self.lengths)
                best = cos.argmax(1)
                for j in np.flatnonzero(has).tolist():
                    langs[i + j] = self.langs[best[j]]
                scores[i : i + len(has)] = np.where(has, np.clip(cos.max(1), 0, 1), 0)
        return langs, scores

    def accepts(self, texts: list[str]) -> np.ndarray:
        """Whether each text is in a learned language; where none was learned, whether it has a letter."""
        if not self.langs:
            return np.array([any(c.isalpha() for c in t) for t in texts], bool)
        return np.array([x != "und" for x in self.predict(texts)[0]], bool)


def _rows(docs: DataFrame, *more):
    text = F.lower(F.coalesce(F.col("text"), F.lit(""))).alias("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *more, text)


def train(docs: DataFrame, rows: int = TRAIN_ROWS, mod: int = 4, held: int = 2) -> Profiles:
    """Prototypes from about `rows` texts in all, as many of each language or all that it has, chosen by a hash of id and text."""
    known = docs.filter(F.col("lang").isNotNull() & (remainder(F.col("doc_id"), mod) != held))
    counts = known.groupBy(F.col("lang").cast("string").alias("lang")).agg(F.count("*").alias("n"))
    each = max(1, rows // max(1, counts.count()))
    # the share of a language as a limit on 64-bit hashes: as fine as the hashes, however many rows there are
    limit = F.when(F.col("n") > each, (F.lit(float(each)) / F.col("n") * 2.0**64 - 2.0**63).cast("long"))
    shares = counts.select(F.col("lang").alias("_lang"), limit.alias("_limit"))
    hashed = _rows(known, F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id", "text").alias("h"))
    some = hashed.join(F.broadcast(shares), F.col("lang") == F.col("_lang")).filter(F.col("_limit").isNull() | (F.col("h") < F.col("_limit")))
    some = some.dropDuplicates(["lang", "h"])

    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in slices(batches, "text"):
            langs = np.array(b["lang"].to_pylist(), object)
            for i, vectors, has in _blocks(b["text"].to_pylist()):
                own = langs[i : i + len(has)]
                vectors = np.rint(_unit(vectors.astype(np.float64)) * SCALE).astype(np.int64)
                for lang in set(own[has]):
                    sums[lang] = sums.get(lang, 0) + vectors[has & (own == lang)].sum(0)
        task = TaskContext.get().partitionId() % 64
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([task] * len(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["lang", "task", "sums"])

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x, np.int64) for x in table["sums"].to_pylist()], 0)
        return pa.table({"lang": table["lang"][:1].cast(pa.string()), "task": pa.array([0], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    kind = "lang string, task int, sums binary"
    merged = some.select("lang", "text").mapInArrow(run, kind).groupBy("lang", "task").applyInArrow(add, kind).groupBy("lang").applyInArrow(add, kind).collect()
    found = sorted((r.lang, np.frombuffer(r.sums, np.int64)) for r in merged)
    return Profiles([x for x, _ in found], np.array([v for _, v in found]).reshape(len(found), DIM))


def predict(docs: DataFrame, profiles: Profiles, mod: int = 4, held: int = 2) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score (the cosine)."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            langs, scores = shared.value.predict(b["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["held_out"], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    held_out = (remainder(F.col("doc_id"), mod) == held).alias("held_out")
    return _rows(docs, held_out).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def accept(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """The rows of docs, all columns, that are in a learned language (any with letters, where none is); decided where the rows lie.

    No floor on the score: a text of one n-gram scores as low as an unknown one, so a floor would cut short texts.
    """
    shared, names = docs.sparkSession.sparkContext.broadcast(profiles), docs.columns
    # by number, as names may hold dots and may clash
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text = inner.columns[names.index("text")]

    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "lower"):
            yield b.select(inner_names).filter(pa.array(shared.value.accepts(b["lower"].to_pylist()), pa.bool_()))

    inner_names, kind = inner.columns, inner.schema
    return inner.withColumn("lower", F.lower(F.coalesce(F.col(text), F.lit("")))).mapInArrow(run, kind).toDF(*names)
