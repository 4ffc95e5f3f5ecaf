"""Operator 3: SentencePiece encoding and decoding by vectorised merge rounds.

encode(): a text is cut before every space that follows a non-space; no piece of the vocabulary crosses
such a place, so words merge independently. The distinct words that a worker does not remember go through
`bpe.merge_words` together; characters outside the vocabulary become their UTF-8 bytes.
decode(): pieces are looked up as bytes and joined; the space that encoding put first is taken off.

Nulls count as empty texts, which encode to begin and end only; other columns play no part; an empty table gives an
empty result; repeated rows give repeated rows.
"""

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerloom.llm.bpe import PairTable, merge_words
from ledgerloom.llm.common import slices
from ledgerloom.shipping import ship

SPACE = "▁"


class PieceModel:
    """A SentencePiece BPE model with byte fallback; the library only reads the model file."""

    def __init__(self, path: str, limit: int = 200_000):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.size = lib.vocab_size()
        self.begin, self.end, self.limit = lib.bos_id(), lib.eos_id(), limit
        pieces = [lib.id_to_piece(i) for i in range(n)]
        byte = {int(p[3:5], 16): i for i, p in enumerate(pieces) if lib.is_byte(i)}
        if len(byte) != 256:
            raise ValueError("the model has no byte fallback")
        plain = {p: i for i, p in enumerate(pieces) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))}
        if any(SPACE in p.lstrip(SPACE) for p in plain):
            raise ValueError("a piece has a space inside")
        self.byte = np.array([byte[b] for b in range(256)], np.int32)
        order = {s: k for k, s in enumerate(sorted({lib.get_score(i) for i in plain.values()}, reverse=True))}
        rows = [(plain[p[:k]], plain[p[k:]], order[lib.get_score(i)], i) for p, i in plain.items() for k in range(1, len(p)) if p[:k] in plain and p[k:] in plain]
        self.pairs = PairTable(*np.array(rows, np.int64).T)
        self.of_char = np.arange(0x110000, dtype=np.int32) + n  # unknown characters keep their code point
        for p, i in plain.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        self.of_char[32] = self.of_char[ord(SPACE)]
        hard = "".join(c for c in "\n\t\r" if not any(c in p and len(p) > 1 for p in plain))
        self.cut = re.compile(f" *[^ {hard}]+| +(?=[{hard}])|[{hard}]| +" if hard else " *[^ ]+| +")
        self.bytes = [b"" if lib.is_control(i) else " ⁇ ".encode() if lib.is_unknown(i) else bytes([int(p[3:5], 16)]) if lib.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.silent = np.array([lib.is_control(i) for i in range(n)])
        self.is_byte = np.array([lib.is_byte(i) for i in range(n)])
        self.spaced = np.array([p.startswith(SPACE) and p in plain for p in pieces])
        self.cache: dict[str, bytes] = {}

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words in a row, and the number of ids of each."""
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        ids, number = merge_words(self.of_char[code], np.fromiter(map(len, words), np.int64, len(words)), self.pairs)
        odd = np.flatnonzero(ids >= self.size)
        if len(odd):
            point = ids[odd] - self.size
            wide = np.ones(len(ids), np.int64)
            wide[odd] = 1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000)
            at = np.cumsum(wide) - wide
            out = np.empty(int(wide.sum()), np.int32)
            out[at[ids < self.size]] = ids[ids < self.size]
            raw = np.frombuffer("".join(map(chr, point.tolist())).encode("utf-8"), np.uint8)
            mask = np.ones(len(out), bool)
            mask[at[ids < self.size]] = False
            out[mask] = self.byte[raw]
            number = np.add.reduceat(np.append(wide, 0), np.minimum(np.cumsum(number) - number, len(wide))) * (number > 0)
            ids = out
        return ids, number

    def encode(self, texts: list) -> list[bytes]:
        """The ids of each text, begin and end included, as little-endian unsigned 32-bit integers."""
        cuts = [self.cut.findall(" " + t.replace(SPACE, " ")) if t else [] for t in texts]
        parts = set().union(*cuts)
        new = list(parts.difference(self.cache))
        if len(self.cache) + len(new) > self.limit:
            self.cache = {}
            new = list(parts)
        for i in range(0, len(new), 50_000):
            some = new[i : i + 50_000]
            ids, number = self.encode_words(some)
            packed, ends = ids.astype("<u4").tobytes(), np.cumsum(number) * 4
            self.cache.update((p, packed[e - k * 4 : e]) for p, e, k in zip(some, ends.tolist(), number.tolist(), strict=True))
        get, first, last = self.cache.__getitem__, np.array([self.begin], "<u4").tobytes(), np.array([self.end], "<u4").tobytes()
        return [first + b"".join(map(get, c)) + last for c in cuts]

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of the ids in UTF-8; bytes that form no character become U+FFFD one by one."""
        table, quiet = self.bytes, self.silent[ids]
        loud = np.flatnonzero(~quiet)
        if not len(loud):
            return b""
        ids = ids[loud[0] : loud[-1] + 1]
        raw = b"".join([table[i] for i in ids.tolist()])
        byte = self.is_byte[ids]
        if byte.any() and (len(ids) > len(loud) or not _valid(raw)):  # bytes form characters only within a run
            runs = np.split(ids, np.flatnonzero(np.diff(byte)) + 1)
            raw = b"".join((_mend if self.is_byte[run[0]] else bytes)(b"".join([table[i] for i in run.tolist()])) for run in runs)
        return raw[1:] if self.spaced[ids[0]] else raw


def _valid(raw: bytes) -> bool:
    try:
        raw.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


def _mend(raw: bytes) -> bytes:
    out, i = [], 0
    while i < len(raw):
        for k in (1, 2, 3, 4):
            try:
                out.append(raw[i : i + k].decode("utf-8").encode())
                i += k
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�".encode())
            i += 1
    return b"".join(out)


_models: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """One model a worker process."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: doc_id and its ids as ARRAY<INT>."""

    ship(docs.sparkSession)

    def run(batches):
        m = model(path)
        for b in slices(batches, "text"):
            ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in m.encode([t or "" for t in b["text"].to_pylist()])]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.ListArray.from_arrays(offsets, np.concatenate(ids))], ["doc_id", "ids"])

    return docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Per row of encode(): doc_id and the decoded text."""

    ship(encoded.sparkSession)

    def run(batches):
        m = model(path)
        for b in batches:
            texts = [m.decode(np.array(x or [], np.int64)).decode("utf-8") for x in b["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """encode() then decode() of whole texts in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    ship(docs.sparkSession)

    def run(batches):
        m = model(path)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in slices(batches, "text"):
            packed = m.encode([t or "" for t in b["text"].to_pylist()])
            back = [sha(m.decode(np.frombuffer(x, "<u4"))) for x in packed]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([len(x) // 4 for x in packed], pa.int64()), pa.array([sha(x) for x in packed]), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
