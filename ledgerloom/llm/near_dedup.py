"""Operator 5: near-duplicate detection by b-bit MinHash, with every link confirmed on full sets.

1. Signatures (map-side): a text's set of hashed word shingles gives `HASHES` minima. Bands of `ROWS` minima are the
   candidate keys; the low `BITS` bits of all minima, packed in longs, are the sketch.
2. Texts with equal sets form one class, whose smallest row stands for all: copies cost nothing further on.
3. Candidates: each bucket (classes with a band in common) gets a pivot, the member that shares most
   buckets. Buckets with the same pivot make a cluster; each member is paired with its pivot only, never with all others.
4. Pairs whose collision-corrected sketch similarity is too low are dropped; the rest are confirmed on full sets, and the
   links' connected components are found.
5. What is left: in every cluster, the members outside the pivot's component are the queries against all members. Small
   clusters are compared on full sets at once. In large ones sketches are compared first, in blocks, and a full set goes only to
   the blocks in which a sketch is near enough to its own. So every pair in a common bucket is looked at, however large the bucket.

Recall: at similarity 0.8 a pair has no band in common with probability (1 - 0.8^5)^32 = 3e-6, and its sketch is too far off
(6 standard deviations) with probability 1e-9. Links are confirmed on full sets of 64-bit shingle hashes.

Hot keys: statistics of classes, clusters and components, and the joins on a pivot or a class, are salted; joins on a band key are
left to the skew-join rule of adaptive execution, as salting all bands would copy the many small buckets.

Nulls and texts without words have an empty set and no link. Fewer words than a shingle: the whole sequence is the one
shingle. A null doc_id is larger than any in component_id. Repeated rows are copies; extra columns play no part. dedup() keeps
one row of each group: the one with the smallest doc_id (then the smallest hash of its text, then of all columns); rows that repeat
doc_id and text are one document. Tables written on the way are deleted at the end.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import flat, gram_hashes, id_keys, materialise, mix, one_of_each, salted_join, scratch, slices, with_group, word_hashes, words
from ledgerloom.shipping import ship

ROWS, BANDS, BITS = 5, 32, 4
HASHES = ROWS * BANDS
#: A sketch estimate this far below the threshold drops a pair (6 standard deviations of the estimate).
MARGIN = 0.2
#: Members in one block of a cluster beside the pivot alone, members in a block of full sets, elements of the sets in
#: either, and blocks of full sets whose sketches are compared together.
STAR_ROWS, BLOCK_ROWS, BLOCK_ITEMS, GROUP = 32, 128, 300_000, 4

_rng = np.random.Generator(np.random.PCG64(20240229))
_A = (_rng.integers(0, 2**32, HASHES, dtype=np.uint64) | 1).astype(np.uint32)[:, None]
_B = _rng.integers(0, 2**32, HASHES, dtype=np.uint64).astype(np.uint32)[:, None]


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = flat(column)
    starts, ends, first = words(data, offsets)
    h = word_hashes(data, starts, ends)
    grams = gram_hashes(h, size)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        else:
            out.append(gram_hashes(h[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def minima(items: np.ndarray) -> np.ndarray:
    """The minimum of each of the HASHES permutations over a set that is not empty."""
    x = (items >> np.uint64(32)).astype(np.uint32)
    low = (_A * x[:4096] + _B).min(1)
    for i in range(4096, len(x), 4096):
        low = np.minimum(low, (_A * x[i : i + 4096] + _B).min(1))
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    band = low.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        key = mix(key * np.uint64(0x9FB21C651E98DF25) + band[:, j])
    return key.astype(np.int64)


def sketch(low: np.ndarray) -> np.ndarray:
    """The low BITS bits of the minima, 16 values in a long."""
    v = (low & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(-1, 64 // BITS)
    return (v << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(1, dtype=np.uint64).astype(np.int64)


def similarity(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two sketches: agreeing values by bit counts, less what agrees by chance."""

    def differing(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        z = z.bitwiseOR(F.shiftrightunsigned(z, 1))
        z = z.bitwiseOR(F.shiftrightunsigned(z, 2))
        return F.bit_count(z.bitwiseAND(F.lit(0x1111111111111111)))

    off = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda s, x: s + x)
    return (1 - off / F.lit(float(HASHES)) - 2.0**-BITS) / (1 - 2.0**-BITS)


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    at = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(at, pa.array(np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)))


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """Per row: rid, doc_id, h (of the text), n (set size), d1 and d2 (the set's digest), bands, sketch."""

    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        for b in slices(batches, "text"):
            sets = shingle_sets(b["text"], size)
            low = [minima(s) if len(s) else None for s in sets]
            d1 = [int(mix(s * np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64).astype(np.int64)) for s in sets]
            d2 = [int(mix(s ^ np.uint64(0xE7037ED1A0B428DB)).sum(dtype=np.uint64).astype(np.int64)) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b["rid"], b["doc_id"], b["h"], pa.array([len(s) for s in sets], pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), _lists([none if x is None else band_keys(x) for x in low]), _lists([none if x is None else sketch(x) for x in low])],
                ["rid", "doc_id", "h", "n", "d1", "d2", "bands", "sketch"],
            )

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    return rows.mapInArrow(run, "rid long, doc_id long, h long, n long, d1 long, d2 long, bands array<long>, sketch array<long>")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in the edges (a, b); root is its component's smallest node.

    Large-star and small-star steps in turn until nothing changes; hubs are dealt over many tasks, and each round is
    written to the shared folder.
    """
    cur, before = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges"), None
    while True:
        both = cur.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(cur.select(F.col("b").alias("u"), F.col("a").alias("v")))
        near = with_group(both, ["u"], F.col("v"), {"m": (F.min("v"), "min")})
        large = near.filter("v > u").select(F.col("v").alias("a"), F.least("u", "m").alias("b")).distinct()
        near = with_group(large, ["a"], F.col("b"), {"m": (F.min("b"), "min")})
        small = near.select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        cur = materialise(small.filter("a <> b").distinct(), "edges")
        state = tuple(cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    return cur.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(cur.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows in runs of equal keys, over batch ends; the rows come sorted by keys."""
    held: list[pa.Table] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        cols = [t[k].to_numpy() for k in keys]
        change = np.zeros(t.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), t.num_rows]
        for a, e in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(c[a] for c in cols)
            if held and key != last:
                yield pa.concat_tables(held)
                held = []
            held.append(t.slice(a, e - a))
            last = key
    if held:
        yield pa.concat_tables(held)


def links(table: pa.Table, percent: int) -> list[tuple[int, int]]:
    """Links between queries (q) and targets (t) of one block, on full sets; one for each pair of components that they join."""
    node, comp = table["node"].to_numpy(), table["comp"].to_numpy()
    query, target = table["q"].to_numpy(), table["t"].to_numpy()
    sets = table["items"].combine_chunks()
    at, items = sets.offsets.to_numpy(), sets.flatten().to_numpy()
    at = at - at[0]
    size = np.diff(at)
    _, one = np.unique(node[target], return_index=True)
    ts = np.flatnonzero(target)[one]
    if not len(ts):
        return []
    owner = np.repeat(np.arange(len(ts)), size[ts])
    pool = np.concatenate([items[at[i] : at[i + 1]] for i in ts])
    order = np.argsort(pool, kind="stable")
    pool, owner = pool[order], owner[order]
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    found, n_t = [], size[ts]
    _, one = np.unique(node[query], return_index=True)
    for i in np.flatnonzero(query)[one].tolist():
        own = items[at[i] : at[i + 1]]
        lo, hi = np.searchsorted(pool, own, "left"), np.searchsorted(pool, own, "right")
        count = hi - lo
        total = int(count.sum())
        if not total:
            continue
        place = np.arange(total) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
        both = np.bincount(owner[place], minlength=len(ts))
        for j in np.flatnonzero((100 * both >= percent * (size[i] + n_t - both)) & (node[ts] != node[i])).tolist():
            a, b = root(int(comp[i])), root(int(comp[ts[j]]))
            if a != b:
                parent[max(a, b)] = min(a, b)
                found.append((int(node[i]), int(node[ts[j]])))
    return found


def _confirm(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """rows: p, ub, mb, node, comp, q, t -> links (a, b) between queries and targets of equal (p, ub, mb)."""

    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches, ["p", "ub", "mb"]):
            if e := links(table, percent):
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in e], pa.int64()), pa.array([y for _, y in e], pa.int64())], ["a", "b"])

    held = rows.join(sets, "node").select("p", "ub", "mb", "node", "comp", "q", "t", "items")
    return held.repartition("p", "ub", "mb").sortWithinPartitions("p", "ub", "mb").mapInArrow(run, "a long, b long")


def near_blocks(table: pa.Table, percent: int) -> tuple[np.ndarray, ...]:
    """Of one block of sketches: (row, block of the other side) wherever a query and a target of another component may link, for queries and for targets."""
    comp, sub, n = (table[c].to_numpy() for c in ("comp", "sub", "n"))
    qs, ts = np.flatnonzero(table["q"].to_numpy()), np.flatnonzero(table["t"].to_numpy())
    bits = table["sketch"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(n), -1)
    base = 2.0**-BITS
    most = HASHES * (1 - base) * (1 - (percent / 100 - MARGIN))
    width = int(sub.max()) + 1 if len(sub) else 1
    asked, told = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(0, len(qs), 32):
        q = qs[i : i + 32]
        x = bits[q][:, None, :] ^ bits[ts][None, :, :]
        x |= x >> np.uint64(1)
        x |= x >> np.uint64(2)
        off = np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(-1, dtype=np.int64)
        small, big = np.minimum(n[q][:, None], n[ts]), np.maximum(n[q][:, None], n[ts])
        a, b = np.nonzero((off <= most) & (100 * small >= percent * big) & (comp[q][:, None] != comp[ts]))
        asked.append(np.unique(q[a] * width + sub[ts[b]]))
        told.append(np.unique(ts[b] * width + sub[q[a]]))
    asked, told = np.unique(np.concatenate(asked)), np.unique(np.concatenate(told))
    return asked // width, asked % width, told // width, told % width


def _routed(rows: DataFrame, percent: int) -> DataFrame:
    """rows: p, ub, mb, sub, node, comp, n, sketch, q, t, by blocks of sketches -> rows for _confirm, by blocks of full sets."""

    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches, ["p", "ub", "mb"]):
            qi, qb, ti, tb = near_blocks(table, percent)
            if len(qi):
                row, sub = np.concatenate([qi, ti]), table["sub"].to_numpy()
                ub, mb = np.concatenate([sub[qi], tb]), np.concatenate([qb, sub[ti]])
                ask = np.arange(len(row)) < len(qi)
                taken = table.select(["p", "node", "comp"]).take(row).combine_chunks()
                cols = [taken["p"].chunk(0), pa.array(ub.astype(np.int32)), pa.array(mb.astype(np.int32)), taken["node"].chunk(0), taken["comp"].chunk(0), pa.array(ask), pa.array(~ask)]
                yield pa.RecordBatch.from_arrays(cols, ["p", "ub", "mb", "node", "comp", "q", "t"])

    dealt = rows.select("p", "ub", "mb", "sub", "node", "comp", "n", "sketch", "q", "t").repartition("p", "ub", "mb").sortWithinPartitions("p", "ub", "mb")
    return dealt.mapInArrow(run, "p long, ub int, mb int, node long, comp long, q boolean, t boolean")


def _block_count(size: str, items: str, rows: int) -> Column:
    return F.greatest(F.ceil(F.col(size) / rows), F.ceil(F.col(items) / BLOCK_ITEMS), F.lit(1)).cast("int")


def _groups(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Per row: doc_id, h (of the text), n (set size), best: the first of its group by (doc_id is null, doc_id, h)."""
    sig = materialise(signatures(docs, size), "signatures")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    same = with_group(sig.filter("n > 0").select("rid", "doc_id", "h", "n", "d1", "d2"), ["d1", "d2"], F.col("rid"), {"node": (F.min("rid"), "min"), "low": (F.min(first), "min")})
    same = materialise(same.select("rid", "doc_id", "h", "n", "node", "low"), "set-classes")
    own = same.filter("rid = node").select("node", "n", "low", F.col("h").alias("_h"), *[c.alias(k) for k, c in id_keys(F.col("doc_id")).items()])
    reps = materialise(sig.select(F.col("rid").alias("node"), "bands", "sketch").join(own, "node"), "representatives")

    # buckets of more than one class, each with its pivot
    cells = reps.select("node", F.explode("bands").alias("key"))
    buckets = cells.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
    cells = materialise(cells.join(buckets, "key"), "cells")
    central = cells.groupBy("node").agg(F.sum("members").alias("weight"))
    pivots = cells.join(central, "node").groupBy("key").agg(F.max(F.struct("weight", (-F.col("node")).alias("minus"))).alias("x")).select("key", (-F.col("x.minus")).alias("p"))
    member = materialise(cells.join(pivots, "key").filter("p <> node").select("p", "node").distinct(), "clusters")

    # full sets of the classes that have a candidate, one a class
    wanted = member.select("node").unionByName(member.select(F.col("p").alias("node"))).distinct().join(own.select("node", "_key", "_none", "_h"), "node")
    texts = docs.select(F.xxhash64("text").alias("_h"), "text", *[c.alias(k) for k, c in id_keys(F.col("doc_id")).items()])

    ship(docs.sparkSession)

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b["node"], _lists([s.view(np.int64) for s in shingle_sets(b["text"], size)])], ["node", "items"])

    picked = texts.join(wanted, ["_key", "_none", "_h"]).select("node", "text").dropDuplicates(["node"])
    sets = materialise(picked.mapInArrow(full, "node long, items array<long>"), "sets")

    # every member against its pivot: by sketch, then on full sets
    slim = reps.select("node", "n", "sketch")
    pair = salted_join(member.join(slim, "node"), slim.select(F.col("node").alias("p"), F.col("n").alias("pn"), F.col("sketch").alias("ps")), "p", F.col("node"))
    near = (100 * F.least("n", "pn") >= percent * F.greatest("n", "pn")) & (similarity(F.col("sketch"), F.col("ps")) >= percent / 100 - MARGIN)
    pair = materialise(pair.filter(near).select("p", "node", "n"), "pairs")
    sized = with_group(pair, ["p"], F.col("node"), {"size": (F.count("*"), "sum"), "total": (F.sum("n"), "sum")})
    sized = sized.withColumn("blocks", _block_count("size", "total", STAR_ROWS))
    target = sized.select("p", F.lit(0).alias("ub"), F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("mb"), "node", F.col("node").alias("comp"), F.lit(False).alias("q"), F.lit(True).alias("t"))
    query = sized.select("p", "blocks").distinct().select("p", F.lit(0).alias("ub"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("mb"), F.col("p").alias("node"), F.col("p").alias("comp"), F.lit(True).alias("q"), F.lit(False).alias("t"))
    star = _confirm(target.unionByName(query), sets, percent)

    # the rest: members outside their pivot's component against their whole cluster
    found = components(star)
    whole = member.unionByName(member.select("p", F.col("p").alias("node")).distinct())
    whole = whole.join(found.select("node", F.col("root").alias("comp")), "node", "left")
    whole = salted_join(whole, found.select(F.col("node").alias("p"), F.col("root").alias("pcomp")), "p", F.col("node"), "left")
    whole = whole.select("p", "node", F.coalesce("comp", "node").alias("comp"), F.coalesce("pcomp", "p").alias("pcomp")).join(slim, "node")
    whole = whole.withColumn("open", F.col("comp") != F.col("pcomp"))
    opened = lambda x: F.sum(F.when(F.col("open"), x).otherwise(F.lit(0)))
    sized = with_group(whole, ["p"], F.col("node"), {"size": (F.count("*"), "sum"), "total": (F.sum("n"), "sum"), "left": (opened(F.lit(1)), "sum"), "left_total": (opened(F.col("n")), "sum")})
    sized = sized.filter("size > 2 and left > 0").withColumn("blocks", _block_count("size", "total", BLOCK_ROWS)).withColumn("asking", _block_count("left", "left_total", BLOCK_ROWS))
    sized = materialise(sized.select("p", "node", "comp", "n", "sketch", "open", "blocks", "asking"), "open-clusters")
    rest = sized.filter("blocks = 1").select("p", F.lit(0).alias("ub"), F.lit(0).alias("mb"), "node", "comp", F.col("open").alias("q"), F.lit(True).alias("t"))
    large = sized.filter("blocks > 1")
    if large.limit(1).count():
        sub = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
        upto = lambda n: F.explode(F.sequence(F.lit(0), F.floor((F.col(n) - 1) / GROUP).cast("int")))
        asked = large.filter("open").withColumn("sub", sub("asking")).select("*", F.floor(F.col("sub") / GROUP).cast("int").alias("ub"), upto("blocks").alias("mb"), F.lit(True).alias("q"), F.lit(False).alias("t"))
        told = large.withColumn("sub", sub("blocks")).select("*", upto("asking").alias("ub"), F.floor(F.col("sub") / GROUP).cast("int").alias("mb"), F.lit(False).alias("q"), F.lit(True).alias("t"))
        rest = rest.unionByName(_routed(asked.unionByName(told), percent))
    more = materialise(_confirm(rest, sets, percent), "links")
    if more.limit(1).count():
        tree = found.select(F.col("node").alias("a"), F.col("root").alias("b"))
        found = components(tree.unionByName(more))

    low = found.join(own.select("node", "low"), "node")
    low = with_group(low, ["root"], F.col("node"), {"best": (F.min("low"), "min")}).select("node", "best")
    linked = salted_join(same, low, "node", F.col("rid"), "left").select("doc_id", "h", "n", F.coalesce("best", "low").alias("best"))
    return linked.unionByName(sig.filter("n = 0").select("doc_id", "h", "n", first.alias("best")))


def classes(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept. Links: 100 * intersection >= percent * union of shingle sets."""
    with scratch(docs.sparkSession) as keep:
        best = F.col("best.doc_id")
        return keep(_groups(docs, size, percent).select("doc_id", F.col("n").alias("n_shingles"), best.alias("component_id"), F.col("doc_id").eqNullSafe(best).alias("kept")), "classes")


def dedup(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay, all their columns: one document of each group."""
    with scratch(docs.sparkSession) as keep:
        rows = _groups(docs, size, percent).filter(F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("h") == F.col("best.h")))
        stay = keep(rows.select(F.col("h").alias("_h"), *[c.alias(k) for k, c in id_keys(F.col("doc_id")).items()]).distinct(), "first-of-group")
    return one_of_each(docs, stay, **id_keys(F.col("doc_id")), _h=F.xxhash64("text"))
