"""Operator 10: toxicity by a weighted lexicon, matched with Aho-Corasick after folding.

Folding lower-cases, drops zero-width signs, maps homoglyphs (Cyrillic, Greek, full width) to Latin letters and digits or signs
that stand for letters to those letters, and turns everything else into single spaces. The lexicon holds whole
words and word beginnings, learned from labelled texts: patterns that occur in many different toxic texts and far more
often than in others, weighted by their log odds. At each word the longest pattern counts. A hit inside an
exception phrase (a learned pattern with a neighbour word that occurs in harmless texts only) does not count. The sum of
weights is normalised by length, and a logistic curve turns it into a score in 0..1.

Learning sees at most `rows` labelled texts that are not held out (at most MAX_BYTES together, one an id, none with conflicting labels), near copies once; scoring covers every text,
map-side, with a lexicon of at most `size` entries. Null and empty texts have no hit and get the score of no hits. Other
columns play no part; repeated rows give repeated rows.
"""

import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import labelled
from ledgerloom.llm.common import slices
from ledgerloom.shipping import ship

TRAIN_ROWS, SIZE = 12_000, 4_000

#: Letters that look like Latin ones.
HOMOGLYPHS = {"а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x"}
#: Digits that stand for letters, anywhere; signs that do so before a letter.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a"}
SIGNS = {"$": "s", "!": "i"}
ZERO_WIDTH = "​‌‍﻿­"


def fold(text: Column) -> Column:
    """Folded text: letters in words between single spaces, with a space at both ends."""
    wide = {chr(0xFF41 + i): chr(97 + i) for i in range(26)} | {chr(0xFF10 + i): DIGITS.get(str(i), " ") for i in range(10)}
    table = HOMOGLYPHS | DIGITS | wide
    x = F.lower(F.coalesce(text, F.lit("")))
    for sign, letter in SIGNS.items():
        x = F.when(F.contains(x, F.lit(sign)), F.regexp_replace(x, rf"\{sign}(?=\p{{L}})", letter)).otherwise(x)
    x = F.translate(x, "".join(table) + ZERO_WIDTH, "".join(table.values()))
    return F.concat(F.lit(" "), F.regexp_replace(x, r"[^\p{L}]+", " "), F.lit(" "))


def patterns(folded: str, shortest: int = 4, longest: int = 8) -> set[str]:
    """Patterns of a folded text: " word " for words and " begin" for word beginnings."""
    out = set()
    for w in set(folded.split()):
        out.add(f" {w} ")
        out.update([f" {w[:k]}" for k in range(shortest, min(longest, len(w)) + 1)])
    return out


def _copy_key(folded: str) -> int:
    """Near copies mostly share it: the smallest hash of five successive words."""
    import zlib

    w = folded.split()
    return min((zlib.crc32(" ".join(w[i : i + 5]).encode()) for i in range(max(1, len(w) - 4))), default=0)


class Lexicon:
    """weights by pattern, exception phrases, and the curve from normalised sums to scores."""

    def __init__(self, weights: dict[str, float], exceptions: set[str], power: float = 0.5, slope: float = 0.0, shift: float = 0.0):
        self.weights, self.exceptions, self.power, self.slope, self.shift = weights, exceptions, power, slope, shift
        self._machine = None

    def __getstate__(self):
        return self.__dict__ | {"_machine": None}

    def machine(self):
        if self._machine is None:
            import ahocorasick

            self._machine = ahocorasick.Automaton()
            for p, w in self.weights.items():
                self._machine.add_word(p, (len(p), w))
            for p in self.exceptions:
                self._machine.add_word(p, (len(p), None))
            if len(self._machine):
                self._machine.make_automaton()
        return self._machine

    def density(self, folded: str) -> float:
        """Sum of the weights of all hits over length to the power `power`."""
        machine = self.machine()
        if not len(machine):
            return 0.0
        hits: dict[int, tuple] = {}
        spans = []
        for end, (size, weight) in machine.iter(folded):
            start = end - size + 1
            if weight is None:
                spans.append((start, end))
            elif start not in hits or size > hits[start][0]:
                hits[start] = (size, weight)
        if not hits:
            return 0.0
        if spans:
            # the furthest end of all phrases that begin at or before a place tells whether one of them covers it
            spans.sort()
            begins, furthest = [a for a, _ in spans], list(accumulate((b for _, b in spans), max))
            inside = {s for s in hits if (k := bisect_right(begins, s)) and furthest[k - 1] > s}
            hits = {s: h for s, h in hits.items() if s not in inside}
        return sum(w for _, w in hits.values()) / max(1, folded.count(" ") - 1) ** self.power

    def scores(self, folded: list[str]) -> np.ndarray:
        x = np.array([self.density(t) for t in folded], np.float64)
        return 1 / (1 + np.exp(-np.clip(self.slope * np.log1p(x * 10) + self.shift, -35, 35)))


def learn(texts: list[str], y: np.ndarray, size: int = SIZE, support: int = 4, odds: float = 1.2) -> Lexicon:
    """texts: folded; y: 0/1. Patterns need `support` different toxic texts and log odds of `odds`. Every fourth text only calibrates."""
    y = np.asarray(y)
    share = float((y == 1).mean()) if len(y) else 0.0
    none = Lexicon({}, set(), shift=math.log((share * len(y) + 0.5) / ((1 - share) * len(y) + 0.5)))
    if not 0 < share < 1:
        return none
    groups: dict[tuple, list[int]] = {}
    for i, t in enumerate(texts):
        groups.setdefault((int(y[i]), _copy_key(t)), []).append(i)
    first = [g[0] for g in groups.values()]
    fitted, kept_out = [i for k, i in enumerate(first) if k % 4 != 3], [i for k, i in enumerate(first) if k % 4 == 3]
    bad: Counter = Counter()
    n1 = sum(1 for i in fitted if y[i] == 1)
    n0 = len(fitted) - n1
    for i in fitted:
        if y[i] == 1:
            bad.update(patterns(texts[i]))
    bad = Counter({p: c for p, c in bad.items() if c >= support})
    good: Counter = Counter()
    for i in fitted:
        if y[i] == 0:
            good.update(patterns(texts[i]) & bad.keys())
    found = {p: math.log((c + 0.5) / (n1 + 1)) - math.log((good[p] + 0.5) / (n0 + 1)) for p, c in bad.items()}
    # a pattern stands for its texts as a whole: rank by how sure it is and how many it explains
    # and of a pattern and a longer one that is in the same texts, the longer one stays
    shorter = {q[:k] for q in found for k in range(5, len(q)) if bad[q[:k]] == bad[q] and good[q[:k]] == good[q]}
    ranked = sorted((p for p, w in found.items() if w >= odds and bad[p] * w >= 12 and p not in shorter), key=lambda p: (-bad[p] * found[p], p))[:size]
    weights = {p: round(found[p], 6) for p in ranked}
    lexicon = Lexicon(weights, set())
    lexicon.exceptions = _exceptions(lexicon, [texts[i] for i in fitted], y[fitted], support)
    lexicon._machine = None
    best = None
    fit_x = kept_out if len({int(y[i]) for i in kept_out}) == 2 else fitted
    for power in (0.25, 0.5, 0.75, 1.0):
        lexicon.power = power
        x = np.log1p(10 * np.array([lexicon.density(texts[i]) for i in fit_x]))
        a, b = labelled.logistic(x, y[fit_x])
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -35, 35)))
        loss = float(-np.mean(np.where(y[fit_x] == 1, np.log(p + 1e-12), np.log(1 - p + 1e-12))))
        if best is None or loss < best[0] - 1e-9:
            best = (loss, power, a, b)
    _, lexicon.power, lexicon.slope, lexicon.shift = best
    return lexicon


def _exceptions(lexicon: Lexicon, texts: list[str], y: np.ndarray, support: int) -> set[str]:
    """Hits with the word before or after them, seen in `support` harmless texts and in no toxic one."""
    seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
    whole = {p.strip() for p in lexicon.weights if p.endswith(" ")}
    for t, label in zip(texts, y, strict=True):
        w = t.split()
        seen[int(label)].update({f" {a} {b} " for a, b in zip(w, w[1:], strict=False) if a in whole or b in whole})
    return {p for p, c in seen[0].items() if c >= support and not seen[1][p]}


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TRAIN_ROWS, size: int = SIZE) -> Lexicon:
    """Learns from at most `rows` labelled texts, which come to the driver folded."""
    found = labelled.sample(docs, labels, label, rows).select("_id", fold(F.col("text")).alias("text"), "label").toArrow().sort_by([("_id", "ascending"), ("text", "ascending")])
    return learn(found["text"].to_pylist(), found["label"].to_numpy(), size)


def score(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.5, mod: int = 5, held: int = 0) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted (1 where score >= threshold)."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            s = shared.value.scores(b["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["held_out"], pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (labelled.remainder(F.col("doc_id"), mod) == held).alias("held_out"), fold(F.col("text")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
