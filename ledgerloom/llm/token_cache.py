"""Exact encoding by the tokenizers library with each distinct part of texts encoded once per worker.

A text is cut only where the tokenizer itself always cuts, so the ids of the parts in a row are the ids of
the whole text. Texts in which that is not certain (rare white space, special strings) go to the library whole.

The texts of a batch are one byte buffer. Parts are places in it; a part is known by two 64-bit hashes that share no
structure, and all parts of a batch are looked up at once in an open-addressing table of numpy arrays. Only parts that the table
does not hold become Python strings.
"""

import json
import re

import numpy as np
import regex

from ledgerloom.llm.bpe import PairTable, merge_words
from ledgerloom.llm.common import _SPACE, mix, word_hashes, words

#: White space beyond ASCII and control characters on which regex engines differ.
ODD_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
#: Parts whose characters every Unicode version classes, lower-cases and normalises alike.
PLAIN = re.compile("[ !-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e]+")
#: Any other character but ASCII white space.
NOT_PLAIN = re.compile("[^ !-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e\t\n\x0b\x0c\r]")


def _byte_chars() -> list[str]:
    """The character by which byte-level vocabularies write each byte: itself if printable, else from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def byte_level_parts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and each text's first of the parts for byte-level BPE: a word with the one space before it, the white space before that.

    A part begins at a text; at white space after a word; at the last white space before a word; at a word after white space other than a space.
    """
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    gap = _SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    begin = cut[:n].copy()
    after_gap = gap[:-1] & ~cut[1:n]
    begin[1:] |= (after_gap & ~gap[1:] & (data[:-1] != 32)) | (gap[1:] & ~gap[:-1])
    begin[:-1] |= gap[:-1] & ~gap[1:] & ~cut[1:n]
    starts = np.flatnonzero(begin)
    return starts, np.append(starts[1:], n), np.searchsorted(starts, offsets)


def identities(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each part: one of all its bytes, one of its size and its first and last eight bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    padded = np.concatenate([np.zeros(8, np.uint8), data, np.zeros(8, np.uint8)])
    eight, size = np.lib.stride_tricks.sliding_window_view(padded, 8), ends - starts
    short = np.minimum(size, 8)
    keep = np.array([0] + [(1 << 8 * k) - 1 for k in range(1, 9)], np.uint64)[short]
    head = np.ascontiguousarray(eight[starts + 8]).view("<u8").reshape(-1) & keep
    tail = np.ascontiguousarray(eight[ends]).view("<u8").reshape(-1) >> (np.uint64(8) * (8 - short).astype(np.uint64))
    return word_hashes(data, starts, ends, fold=False), mix(head * np.uint64(0x9FB21C651E98DF25) + mix(tail + size.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)))


class PartTable:
    """Part -> entry, by its two hashes; an entry has a number of ids and, unless only lengths are kept, the ids."""

    def __init__(self, kind: np.dtype | None, bits: int = 16):
        self.kind, self.n, self.used = kind, 0, 0
        self.key, self.tag = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64)
        self.count, self.start = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        self.ids = np.zeros(1 << bits, kind or np.uint8)
        self._slots(bits + 1)

    def _slots(self, bits: int) -> None:
        self.mask, self.shift = (1 << bits) - 1, np.uint64(64 - bits)
        self.entry = np.full(1 << bits, -1, np.int32)

    def find(self, key: np.ndarray, tag: np.ndarray) -> np.ndarray:
        """The entry of each part, -1 for unknown ones."""
        slot = (key >> self.shift).astype(np.int64)
        entry = self.entry[slot]
        wrong = np.flatnonzero((entry >= 0) & ((self.key[entry] != key) | (self.tag[entry] != tag)))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & self.mask
            e = self.entry[slot[wrong]]
            entry[wrong] = e
            wrong = wrong[(e >= 0) & ((self.key[e] != key[wrong]) | (self.tag[e] != tag[wrong]))]
        return entry

    def add(self, key: np.ndarray, tag: np.ndarray, count: np.ndarray, ids: np.ndarray | None = None) -> None:
        """New parts, all different; ids holds theirs in a row."""
        a, b = self.n, self.n + len(key)
        if b > len(self.key):
            more = max(b, 2 * len(self.key))
            self.key, self.tag, self.count, self.start = (np.resize(x, more) for x in (self.key, self.tag, self.count, self.start))
        self.key[a:b], self.tag[a:b], self.count[a:b], self.n = key, tag, count, b
        if self.kind is not None:
            end = self.used + len(ids)
            if end > len(self.ids):
                self.ids = np.resize(self.ids, max(end, 2 * len(self.ids)))
            self.ids[self.used : end] = ids
            self.start[a:b] = self.used + np.cumsum(count) - count
            self.used = end
        if 2 * b > len(self.entry):
            self._slots(int(4 * b).bit_length())
            a = 0
        self._place(np.arange(a, b))

    def _place(self, todo: np.ndarray) -> None:
        slot = (self.key[todo] >> self.shift).astype(np.int64)
        while len(todo):
            free = np.flatnonzero(self.entry[slot] < 0)
            self.entry[slot[free]] = todo[free]  # of several parts at a slot the last one holds it
            rest = self.entry[slot] != todo
            todo, slot = todo[rest], (slot[rest] + 1) & self.mask

    def gather(self, entry: np.ndarray) -> np.ndarray:
        """The ids of the entries in a row."""
        count = self.count[entry]
        total = int(count.sum())
        return self.ids[np.arange(total) + np.repeat(self.start[entry] - (np.cumsum(count) - count), count)]

    def only(self, entries: np.ndarray) -> "PartTable":
        """A table of these entries alone."""
        out = PartTable(self.kind)
        out.add(self.key[entries], self.tag[entries], self.count[entries], None if self.kind is None else self.gather(entries))
        return out


class CachedTokenizer:
    """encode(texts) and count(texts) as the library does it.

    words: parts are words (BPE that drops white space), else those of byte-level BPE; lengths: only counts are kept;
    hot: a table of lengths that is looked up first and never dropped; limit: parts that the worker's own table holds.
    """

    def __init__(self, path: str, words: bool, lengths: bool = False, hot: PartTable | None = None, limit: int = 800_000):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.special = {t.content: i for i, t in self.lib.get_added_tokens_decoder().items()}
        self.mark = max(self.special, key=self.special.get)
        self.by_word, self.limit, self.hot = words, limit, hot
        spec = json.loads(self.lib.to_str())
        vocab, merges = spec["model"]["vocab"], [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.pairs = PairTable([vocab[a] for a, _ in merges], [vocab[b] for _, b in merges], range(len(merges)), [vocab[a + b] for a, b in merges])
        suffix, pre = spec["model"].get("end_of_word_suffix") or "", spec["pre_tokenizer"]
        self.of_byte = np.array([vocab[c] for c in _byte_chars()], np.int32)
        self.of_last = np.array([vocab[c + suffix] for c in _byte_chars()], np.int32) if suffix else None
        self.lower = "Lowercase" in json.dumps(spec["normalizer"])
        if pre["type"] == "ByteLevel":  # the pattern that this pre-tokenizer has built in
            self.pre_tokens = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        else:
            spec_pattern = pre["pretokenizers"][0]["pattern"]["Regex"]
            self.words_and_spaces = regex.compile(spec_pattern + "| ").findall
        size = self.lib.get_vocab_size(with_added_tokens=True)
        self.bits = max(1, (size - 1).bit_length())
        self.kind = np.dtype("<u2") if self.bits <= 16 else np.dtype("<u4")
        self.table = PartTable(None if lengths else self.kind)

    def whole(self, text: str) -> bool:
        odd = any(c in text for c in "\x1c\x1d\x1e\x1f") if text.isascii() else ODD_SPACE.search(text) is not None
        return odd or any(s in text for s in self.special)

    def encode_whole(self, text: str) -> np.ndarray:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, self.kind)

    def _merged(self, cuts: list[bytes], of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Pre-tokens in a row, of[i] the part that pre-token i belongs to -> all ids, and the number of each of the n parts."""
        sizes, raw = np.fromiter(map(len, cuts), np.int64, len(cuts)), np.frombuffer(b"".join(cuts), np.uint8)
        symbols, last = self.of_byte[raw], np.cumsum(sizes) - 1
        if self.of_last is not None:
            symbols[last] = self.of_last[raw[last]]
        ids, number = merge_words(symbols, sizes, self.pairs)
        return ids, np.bincount(of, number, n).astype(np.int64)

    def _by_merges(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Parts of well-known characters, cut into pre-tokens here and merged in rounds for all at once."""
        if not self.by_word:
            cuts = [self.pre_tokens(p.lower() if self.lower else p) for p in parts]
            return self._merged([x.encode() for c in cuts for x in c], np.repeat(np.arange(len(parts)), list(map(len, cuts))), len(parts))
        # one pass of the pre-tokenizer over all words, with a space between them
        flat = [x.encode() for x in self.words_and_spaces(" ".join([p.lower() for p in parts] if self.lower else parts))]
        space = np.array([x == b" " for x in flat], bool)
        return self._merged([x for x in flat if x != b" "], np.cumsum(space)[~space], len(parts))

    def _by_library(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Other parts, joined by a special string that marks where each ends."""
        sep = self.special[self.mark]
        ids = np.array(self.lib.encode(self.mark.join(parts), add_special_tokens=False).ids, np.int64)
        cuts = np.flatnonzero(ids == sep)
        if len(cuts) != len(parts) - 1:
            raise ValueError("a part holds the separator")
        return ids[ids != sep], np.diff(cuts, prepend=-1, append=len(ids)) - 1

    def _learn(self, parts: list[str], key: np.ndarray, tag: np.ndarray) -> None:
        """Encodes different parts that the table lacks, and adds them."""
        plain = np.array([PLAIN.fullmatch(p) is not None for p in parts], bool)
        for how, which in ((self._by_merges, np.flatnonzero(plain)), (self._by_library, np.flatnonzero(~plain))):
            for i in range(0, len(which), 20_000):
                at = which[i : i + 20_000]
                ids, number = how([parts[k] for k in at.tolist()])
                self.table.add(key[at], tag[at], number, ids)

    def _entries(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For all parts of the texts in a row: entries in the hot table (-1: none), in the worker's table, and each text's first part."""
        # where a text has known characters only, lower case at once makes fewer different words
        raw = [(t.lower() if self.by_word and self.lower and NOT_PLAIN.search(t) is None else t).encode("utf-8", "surrogatepass") for t in texts]
        data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        starts, ends, first = (words if self.by_word else byte_level_parts)(data, offsets)
        key, tag = identities(data, starts, ends)
        hot = self.hot.find(key, tag) if self.hot else np.full(len(key), -1, np.int32)
        own = np.full(len(key), -1, np.int64)
        cold = np.flatnonzero(hot < 0)
        own[cold] = self.table.find(key[cold], tag[cold])
        new = cold[own[cold] < 0]
        if len(new):
            _, one = np.unique(key[new] ^ mix(tag[new]), return_index=True)
            once = new[one]
            if self.table.n + len(once) > self.limit:
                # what this batch uses again stays: mostly the frequent parts
                self.table = self.table.only(np.unique(own[own >= 0]))
            joined = b"".join(raw)
            self._learn([joined[a:b].decode("utf-8", "surrogatepass") for a, b in zip(starts[once].tolist(), ends[once].tolist(), strict=True)], key[once], tag[once])
            own[cold] = self.table.find(key[cold], tag[cold])
        return hot, own, first

    def _split(self, texts: list[str]) -> tuple[list[int], list[int]]:
        odd = [self.whole(t) for t in texts]
        return [i for i, o in enumerate(odd) if not o], [i for i, o in enumerate(odd) if o]

    def count(self, texts: list[str]) -> np.ndarray:
        """The number of ids of each text."""
        cut, odd = self._split(texts)
        hot, own, first = self._entries([texts[i] for i in cut])
        number = self.table.count[own]
        if self.hot:
            number = np.where(hot >= 0, self.hot.count[hot], number)
        total = np.concatenate([[0], np.cumsum(number)])
        out = np.zeros(len(texts), np.int64)
        out[cut] = total[first[1:]] - total[first[:-1]]
        for i in odd:
            out[i] = len(self.encode_whole(texts[i]))
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        cut, odd = self._split(texts)
        _, own, first = self._entries([texts[i] for i in cut])
        ids = self.table.gather(own)
        at = np.concatenate([[0], np.cumsum(self.table.count[own])])[first]
        out: list = [None] * len(texts)
        for i, a, b in zip(cut, at[:-1].tolist(), at[1:].tolist(), strict=True):
            out[i] = ids[a:b]
        for i in odd:
            out[i] = self.encode_whole(texts[i])
        return out
