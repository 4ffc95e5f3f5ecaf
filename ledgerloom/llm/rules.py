"""Operator 7 (native): quality rules as a bitmask ledger.

ledger() evaluates every rule once and stores the measurements and one bit for each rule that failed; policies are
versioned masks that apply() lays over the stored bits, so a new policy needs no new pass over the texts, and
ablation() tells from counts by mask what each rule of a policy does alone.

All of it is SQL expressions on one row: no shuffle, no Python. Repeated 8-word windows are found by
doubling hashes (1, 2, 4, 8 words; 64 bits) and one sort within the text, so work is near linear in the longest text.

Null and empty texts have all measurements 0 and fail too_few_words. Other columns play no part; an empty table
gives an empty ledger; repeated rows give repeated rows.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import SPACE_CLASS, SPACES

SYMBOLS = "#*$%&|<>"

#: Rules by bit: name and condition of failure on the measurements. Bits are never reused for another rule.
RULES: list[tuple[str, str]] = [
    ("too_few_words", "n_words < 20"),
    ("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "5 * n_symbols > n_words"),
    ("repeated_lines", "n_dup_lines >= 3 and 100 * n_dup_lines > 30 * n_lines"),
    ("long_words", "word_chars > 25 * n_words"),
]
#: Versioned policies: the rules that reject a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("too_few_words", "repeated_words"),
    "v1": ("too_few_words", "repeated_words", "symbols", "repeated_lines", "long_words"),
}


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once, also inside lambda functions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _window_hashes(words: Column, n: Column) -> Column:
    h = F.transform(words, lambda w: F.xxhash64(w))

    def doubled(step: int) -> Callable[[Column], Column]:
        return lambda a: F.transform(a, lambda x, i: F.xxhash64(x, F.get(a, i + step)))

    for step in (1, 2, 4):
        h = let(h, doubled(step))
    return F.slice(h, F.lit(1), F.greatest(n - 7, F.lit(0)))


def _covered(windows: Column) -> Column:
    """Words in windows whose hash occurs twice or more."""
    pairs = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    twice = let(pairs, lambda p: F.filter(p, lambda e, i: F.coalesce(e["h"] == F.get(p, i - 1)["h"], F.lit(False)) | F.coalesce(e["h"] == F.get(p, i + 1)["h"], F.lit(False))))
    starts = F.sort_array(F.transform(twice, lambda e: e["i"]))
    return let(starts, lambda q: F.aggregate(F.transform(q, lambda v, i: F.least(F.lit(8), F.coalesce(F.get(q, i + 1) - v, F.lit(8)))), F.lit(0), lambda s, x: s + x))


def measurements(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACES))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS + "+"))
    squeezed = F.translate(text, SPACES, "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")

    def of(w: Column) -> Column:
        repeats = let(_window_hashes(w, F.size(w)), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _covered(h)).otherwise(F.lit(0)))
        line = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
        return F.struct(F.size(w).cast("long").alias("n_words"), F.length(squeezed).cast("long").alias("word_chars"), (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"), line.alias("line"), repeats.cast("long").alias("n_repeat_words"))

    return let(words, of)


def ledger(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, the measurements, and failed: a BIGINT with bit k set where RULES[k] failed."""
    m = docs.select(F.col("doc_id").cast("long").alias("doc_id"), measurements(F.col("text")).alias("m"))
    m = m.select("doc_id", "m.n_words", "m.word_chars", "m.n_symbols", F.col("m.line.dup").cast("long").alias("n_dup_lines"), F.col("m.line.n").cast("long").alias("n_lines"), "m.n_repeat_words")
    failed = F.lit(0).cast("long")
    for k, (_, condition) in enumerate(RULES):
        failed = failed.bitwiseOR(F.when(F.expr(condition), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return m.withColumn("failed", failed)


def mask(policy: str) -> int:
    names = [n for n, _ in RULES]
    return sum(1 << names.index(n) for n in POLICIES[policy])


def apply(ledger_: DataFrame, policy: str = "v1") -> DataFrame:
    """The ledger with kept: no rule of the policy failed."""
    return ledger_.withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask(policy))) == 0)


def ablation(ledger_: DataFrame, policy: str = "v1") -> DataFrame:
    """Per rule of the policy: rows that fail it, that only it rejects, and that the policy keeps without it."""
    m = mask(policy)
    bits = [(k, n) for k, (n, _) in enumerate(RULES) if m >> k & 1]
    by_mask = ledger_.groupBy(F.col("failed").bitwiseAND(F.lit(m)).alias("f")).agg(F.count("*").alias("n"))
    each = by_mask.select("f", "n", F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(1 << k).alias("bit")) for k, n in bits])).alias("r")).select("f", "n", "r.*")
    some = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return each.groupBy("rule").agg(some(F.col("f").bitwiseAND(F.col("bit")) != 0).alias("failed"), some(F.col("f") == F.col("bit")).alias("rejected_alone"), some((F.col("f") == 0) | (F.col("f") == F.col("bit"))).alias("kept_without"))


SQL = """
WITH base AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM base),
grams AS (SELECT rid, unnest(range(1, len(ws) - 6)) AS i, ws FROM w WHERE len(ws) >= 8),
keyed AS (SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS k FROM grams),
flagged AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM keyed) WHERE c > 1),
gaps AS (SELECT rid, least(8, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 8)) AS g FROM flagged),
cover AS (SELECT rid, sum(g) AS n FROM gaps GROUP BY rid),
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls)::BIGINT AS n_lines, coalesce(cover.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cover USING (rid)),
f AS (
  SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 5 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars > 25 * n_words THEN 16 ELSE 0 END)::BIGINT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, failed FROM f
"""
