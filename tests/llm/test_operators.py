"""Each operator against a brute-force version, on awkward rows, an empty table and clashing extra columns."""

import hashlib
import math
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import exact_dedup, language_id, mixing, near_dedup, pieces, quality_model, rules, token_count, token_files, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bag(df):
    return Counter(tuple(r) for r in df.collect())


# ---------------------------------------------------------------- 1
def fill(sizes, weights, cap=3):
    """Targets by repeated resharing."""
    total, open_, out = sum(sizes), set(range(len(sizes))), {}
    while open_:
        left, w = total - sum(out.values()), sum(weights[i] for i in open_)
        over = {i for i in open_ if weights[i] * left / w > cap * sizes[i]}
        if not over:
            out |= {i: weights[i] * left / w for i in open_}
            break
        out |= {i: float(cap * sizes[i]) for i in over}
        open_ -= over
    return [out[i] for i in range(len(sizes))]


def test_mixing(docs, data):
    got = mixing.plan(docs).collect()
    size = defaultdict(int)
    for _, t, _, s, _ in data:
        size[s] += len(WORD.findall(t or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    want = fill([size[s] for s in order], [1 + i % 3 for i in range(len(order))])
    assert len(got) == len(data)
    by = defaultdict(list)
    for r in got:
        by[r.source_size, round(r.target, 6)].append(r)
    assert sorted(by) == sorted((size[s], round(t, 6)) for s, t in zip(order, want, strict=True))
    for (_, target), rs in by.items():
        assert abs(sum(r.taken for r in rs) - target) <= max(r.size for r in rs)
        assert all(r.taken <= 3 * r.size for r in rs)
    assert bag(mixing.plan(docs)) == Counter(tuple(r) for r in got)
    at = [r.position for r in got if r.position is not None]
    assert at == sorted(at) and 0 <= at[0] and at[-1] <= 1


def brute_positions(data, wants):
    """(position, order, doc_id, text) of every copy, by walking each source in hash order."""
    out, size = [], lambda t: len(WORD.findall(t or ""))
    sources = sorted({r[3] for r in data}, key=lambda s: (s is None, s or ""))
    for k, (source, target) in enumerate(zip(sources, wants, strict=True)):
        key = lambda r: (hashlib.md5(f"{'' if r[0] is None else r[0]} {r[1] or ''}".encode()).hexdigest(), r[0] is not None, r[0] or 0, size(r[1]))
        mine = sorted((r for r in data if r[3] == source), key=key)
        total, at = sum(size(r[1]) for r in mine), 0
        (t0, a), (t1, b) = mixing.SCHEDULES[k % 3]
        for r in mine:
            n = size(r[1])
            passes = math.floor(target / total) if total else 1
            rest = target - passes * total
            copies = passes + (total > 0 and rest > 0 and 2 * at + n <= 2 * rest)
            for c in range(copies):
                v = (at + c * total) / target * (a + b) / 2 if target else 0.0
                out.append((2 * v / (a + math.sqrt(max(a * a + 2 * (b - a) * v, 0))), key(r)[0], r[0], r[1]))
            at += n
    return sorted(out, key=lambda x: (x[0], x[1]))


def test_mixing_copies_and_schedule(spark, docs, data, none, clashing):
    size = defaultdict(int)
    for _, t, _, s, _ in data:
        size[s] += len(WORD.findall(t or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    want = brute_positions(data, fill([size[s] for s in order], [1 + i % 3 for i in range(len(order))]))
    got = [(r.doc_id, r.text) for r in mixing.copies(docs).collect()]
    assert Counter(got) == Counter(x[2:] for x in want)
    place = defaultdict(list)
    for x in want:
        place[x[2:]].append(x[0])
    # the k-th time a row comes it is at its k-th position, and positions never go back
    seen, at = Counter(), []
    for x in got:
        at.append(place[x][seen[x]])
        seen[x] += 1
    assert all(b >= a - 1e-9 for a, b in zip(at, at[1:], strict=False))
    assert Counter({k: v for k, v in Counter((i, len(WORD.findall(t or ""))) for i, t in got).items()}) == sum((Counter({(r.doc_id, r.size): r.copies}) for r in mixing.plan(docs).collect()), Counter())
    # empty documents of a source at its cap come as often as the cap says, not once more
    small = spark.createDataFrame([(i, "", None, "a", 0) for i in range(5)] + [(9, "one", None, "a", 0)] + [(10 + i, "word " * 50, None, "b", 0) for i in range(9)], docs.schema)
    assert max(Counter(r.doc_id for r in mixing.copies(small).collect()).values()) == 3
    assert mixing.plan(none).count() == 0 and mixing.copies(none).count() == 0
    assert mixing.copies(clashing).columns == clashing.columns
    assert bag(mixing.plan(docs, buckets=3)) == bag(mixing.plan(docs))
    # demand and its inverse
    for knots in mixing.SCHEDULES:
        (t0, a), (t1, b) = knots
        for t in (0.0, 0.25, 0.5, 0.9):
            u = (a * t + (b - a) * t * t / 2) / ((a + b) / 2)
            v = u * (a + b) / 2
            assert abs(2 * v / (a + np.sqrt(a * a + 2 * (b - a) * v)) - t) < 1e-9


# ---------------------------------------------------------------- 2
def labelled_docs(spark):
    good = [(i, f"the report of day {i} says that all is well and calm in town number {i * 7}") for i in range(120)]
    bad = [(200 + i, f"buy $$$ now ### click {i} !!! win $$$ free ### {i * 3}") for i in range(60)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in good + bad] + [(999, None, "en", "s", 0), (998, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 1) for i, _ in bad], "doc_id long, quality int, toxic int")
    return docs, labels


def test_quality(spark, docs, none):
    d, lab = labelled_docs(spark)
    m = quality_model.train(d, lab, rows=150)
    got = {r.doc_id: r for r in quality_model.score(d, m).collect()}
    assert len(got) == 182 and all(0 <= r.score <= 1 for r in got.values())
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in held) for i in got)
    right = [got[i].predicted == (1 if i < 200 else 0) for i in held if i < 900]
    assert np.mean(right) > 0.95
    assert quality_model.score(none, m).count() == 0
    assert quality_model.score(docs, quality_model.train(docs, lab.limit(0))).count() == docs.count()
    again = quality_model.train(d, lab, rows=150)
    assert np.array_equal(m.weights, again.weights)


def test_sample_is_bounded(spark, docs):
    from ledgerloom.llm import labelled

    rows = [(1, f"text {i}", "en", "s", 0) for i in range(500)] + [(i, "x" * 300, "en", "s", 0) for i in range(2, 60)] + [(70, "y" * 100_000, "en", "s", 0)]
    df = spark.createDataFrame(rows, docs.schema)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(70, 1), (3, 0), (3, 1), (7, None)], "doc_id long, quality int")
    got = labelled.sample(df, labels, "quality", 10, held=-1).collect()
    assert len(got) == 10 and len({r._id for r in got}) == 10
    every = labelled.sample(df, labels, "quality", 1000, max_bytes=6_400_000, held=-1).collect()
    assert sorted(r._id for r in every) == [i for i in range(1, 71) if i != 3 and (i < 60 or i == 70)]
    few = labelled.sample(df, labels, "quality", 1000, max_bytes=64_000, held=-1).collect()
    assert 70 not in {r._id for r in few} and sum(len(r.text) for r in few) <= 64_000
    tight = labelled.sample(df, labels, "quality", 1000, max_bytes=20_000, held=-1).collect()
    assert {r._id for r in tight} == {1} or sum(len(r.text) for r in tight) <= 20_000


def brute_tokens(t):
    """Runs of letters and digits (and all beyond ASCII), runs of other signs, and line ends one by one; A-Z in lower case."""
    return re.findall(r"\n|[0-9A-Za-z\x80-\U0010ffff]+|[^\s0-9A-Za-z\x80-\U0010ffff]+|[\x1c-\x1f]+", t.translate(UPPER))


def test_indicators_are_the_distinct_grams():
    texts = ["One two two, three!", "", "two, three", "a\n\nb one TWO", "über\tnaïve ##$ 12", " one "]
    column = pa.array(texts)
    row, index = quality_model.features(column, 30)
    name = {}
    for k, t in enumerate(texts):
        w = brute_tokens(t)
        grams = {(x,) for x in w} | set(zip(w, w[1:], strict=False))
        twice = sum(a == b for a, b in zip(w, w[1:], strict=False))
        assert (row == k).sum() == len(grams) + (twice > 0)
        if twice:  # the share of repeats in eighths is an indicator of its own
            name.setdefault(twice * 8 // len(w), set()).update([k])
        for g in grams:  # equal grams share an index, in whatever text
            alone = quality_model.features(pa.array([" ".join(g) if "\n" not in g else "".join(g)]), 30)[1]
            assert set(alone.tolist()) & set(index[row == k].tolist())
            name.setdefault(g, set()).update([k])
    shared = lambda a, b: len(set(index[row == a].tolist()) & set(index[row == b].tolist()))
    for a in range(len(texts)):
        for b in range(a):
            assert shared(a, b) == sum(1 for g, k in name.items() if {a, b} <= k)


def test_fit_is_ratios_and_the_hinge_optimum():
    """The ratios by counting, and the hinge loss of the fit against its dual: the gap of an optimum is nought."""
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 120)
    sets = [sorted(set(rng.integers(0, 20, 8).tolist()) | set(rng.integers(20 + 6 * v, 30 + 6 * v, 4).tolist())) for v in y.tolist()]
    row, index = np.repeat(np.arange(120), [len(x) for x in sets]), np.concatenate(sets)
    c = 0.5
    m = quality_model.fit(row, index, y, bits=6, c=c, epochs=3000)
    learn = [i for i in range(120) if i % 5 != 4]
    count = lambda label: np.array([1 + sum(j in sets[i] for i in learn if y[i] == label) for j in range(64)], float)
    p, q = count(1), count(0)
    ratio = np.where((p == 1) & (q == 1), 0, np.log(p / p.sum()) - np.log(q / q.sum()))
    assert np.allclose(m.ratio, ratio, atol=1e-6)
    x = np.zeros((120, 65))
    for i, js in enumerate(sets):
        x[i, js] = ratio[js]
        x[i] /= np.linalg.norm(x[i])
    x[:, 64] = 1
    # the same problem, solved again: its primal and dual values meet, and the fit is this optimum
    sign = np.where(y == 1, 1.0, -1.0)
    spans = [(k * 65, k * 65 + 64) for k in range(len(learn))]
    w, alpha = quality_model._descend(x[learn].ravel(), np.tile(np.arange(65), len(learn)), spans, sign[learn], 64, c, 3000)
    assert np.allclose(w, (alpha * sign[learn]) @ x[learn]) and alpha.min() >= 0 and alpha.max() <= c
    primal = w @ w / 2 + c * np.maximum(0, 1 - sign[learn] * (x[learn] @ w)).sum()
    assert abs(primal - (alpha.sum() - w @ w / 2)) < 0.01 * primal
    mine = np.append(np.divide(m.weights, ratio, out=np.zeros(64), where=ratio != 0), m.bias)
    assert mine @ mine / 2 + c * np.maximum(0, 1 - sign[learn] * (x[learn] @ mine)).sum() < 1.01 * primal
    assert np.allclose(m.slope * x @ mine + m.shift, m.slope * (x[:, :64] @ mine[:64] + m.bias) + m.shift)


def test_descent_finds_the_margin():
    x = np.array([[2.0, 0.0], [0.0, 2.0], [1.5, 0.2], [0.1, 1.0]])
    w, _ = quality_model._descend(x.ravel(), np.tile([0, 1], 4), [(i, i + 2) for i in range(0, 8, 2)], np.array([1.0, -1, 1, -1]), 2, 10.0, 200)
    assert all((x @ w[:2] + w[2]) * np.array([1, -1, 1, -1]) > 0.98)


# ---------------------------------------------------------------- 3
def test_pieces(docs, data, none, clashing):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    want = Counter()
    for i, t, *_ in data:
        ids = lib.encode(t or "", add_bos=True, add_eos=True)
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()] += 1
    assert bag(pieces.digests(docs, path)) == want == bag(pieces.digests(clashing, path))
    assert pieces.digests(none, path).count() == 0
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(docs, path), path).collect()}
    assert back[402] == "one two three" and back[300] == ""


def test_pieces_odd_texts():
    import random

    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    lib, m, rng = sentencepiece.SentencePieceProcessor(model_file=path), pieces.PieceModel(path, limit=500), random.Random(5)
    signs = [*" \t\nabcdehrtiosn1'é.▁ß中文🙂aaa   ", "the", "ing", "<s>", "<0x0A>", "\x00"]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 50))) for _ in range(3000)] + ["a" * 900, "abab" * 300, "中文" * 300, " " * 77 + "x"]
    for t, got in zip(texts, [x for i in range(0, len(texts), 200) for x in m.encode(texts[i : i + 200])], strict=True):
        ids = lib.encode(t, add_bos=True, add_eos=True)
        assert np.frombuffer(got, "<u4").tolist() == ids
        assert m.decode(np.array(ids)).decode() == lib.decode(ids)
    for _ in range(3000):
        ids = [rng.choice([0, 1, 2, rng.randint(3, 258), rng.randint(0, 31999)]) for _ in range(rng.randint(0, 10))]
        assert m.decode(np.array(ids, np.int64)).decode() == lib.decode(ids)


@pytest.mark.parametrize("text", [" " * 100_000, " " * 50_000 + "x y" + " " * 50_000, "ab" * 50_000, "qzxjkv" * 15_000, "-" * 100_000])
def test_pieces_long_runs(text):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    lib, m = sentencepiece.SentencePieceProcessor(model_file=path), pieces.PieceModel(path)
    m.encode([" " * 200])
    start = time.process_time()
    got = np.frombuffer(m.encode([text])[0], "<u4")
    assert time.process_time() - start < 2
    assert got.tolist() == lib.encode(text, add_bos=True, add_eos=True) and m.decode(got).decode() == lib.decode(got.tolist())


def test_queue_equals_rounds(monkeypatch):
    import random

    from ledgerloom.llm import bpe

    m, rng = pieces.PieceModel(P.path("piece_bpe_32k.model")), random.Random(2)
    texts = ["".join(rng.choices([" ", "a", "b", "the", "   "], k=rng.randint(1, 200))) for _ in range(300)]
    want = m.encode(texts)
    for rounds in (0, 1, 5):
        monkeypatch.setattr(bpe, "ROUNDS", rounds)
        m.cache = {}
        assert m.encode(texts) == want


# ---------------------------------------------------------------- 4
@pytest.mark.parametrize("block", [8192, 7])
def test_exact_dedup(docs, data, none, clashing, monkeypatch, block):
    monkeypatch.setattr(exact_dedup, "BLOCK", block)
    groups = defaultdict(list)
    for i, t, *_ in data:
        groups[(t or "").translate(UPPER)].append(i)
    some = docs if block > 100 else docs.filter("doc_id is null or doc_id <> 400")
    got = exact_dedup.classes(some).collect()
    n = Counter()
    for t, ids in groups.items():
        if block < 100 and 400 in ids:
            continue
        best = max((i for i in ids if i is not None), default=None)
        rs = [r for r in got if r.text_sha256 == hashlib.sha256(t.encode()).hexdigest()]
        assert len(rs) == len(ids) and all(r.group_size == len(ids) and r.keep_id == best for r in rs)
        assert sum(r.kept for r in rs) == 1
        n["groups"] += 1
    if block > 100:
        kept = exact_dedup.dedup(clashing)
        assert kept.columns == clashing.columns and kept.count() == n["groups"]
        assert exact_dedup.classes(none).count() == 0 and exact_dedup.dedup(none).count() == 0


def test_exact_dedup_hot_blocks(spark, docs, monkeypatch):
    """Texts of several blocks, most of which very many rows share; named ahead, and in the same groups as without that."""
    monkeypatch.setattr(exact_dedup, "BLOCK", 5)
    data = [(i, "aaaaabbbbb" * (i % 4) + ("ccccc" if i % 3 else ""), "en", "s", 0) for i in range(200)] + [(300, "", None, None, 0)] * 3
    df = spark.createDataFrame(data, docs.schema).repartition(5)
    groups = defaultdict(list)
    for i, t, *_ in data:
        groups[t].append(i)
    want = Counter((i, max(groups[t]), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t, *_ in data)
    for few, hot in ((3, 4096), (20, 2), (10**9, 1)):
        monkeypatch.setattr(exact_dedup, "FEW", few)
        monkeypatch.setattr(exact_dedup, "HOT", hot)
        got = exact_dedup.classes(df).collect()
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
        assert sum(r.kept for r in got) == len(groups)


def test_exact_dedup_is_the_same_on_reruns(spark, docs):
    data = [(7, "Same Text", "en", "s", k) for k in range(30)] + [(7, "same text", "de", "s", k) for k in range(30)]
    kept = {tuple(exact_dedup.dedup(spark.createDataFrame(data, docs.schema).repartition(n)).first()) for n in (1, 3, 7)}
    assert len(kept) == 1


# ---------------------------------------------------------------- 5
def brute_components(data, size, percent):
    sets, parent = {}, {}
    for k, (_, t, *_) in enumerate(data):
        w = WORD.findall((t or "").translate(UPPER))
        sets[k] = frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
        parent[k] = k

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    low = {}
    for k in sets:
        i = data[k][0]
        r = root(k)
        low[r] = min((x for x in (low.get(r), i) if x is not None), default=None)
    return Counter((data[k][0], len(sets[k]), low[root(k)]) for k in sets)


@pytest.mark.parametrize(("size", "percent"), [(4, 80), (5, 90)])
def test_near_dedup(docs, data, size, percent):
    got = near_dedup.classes(docs, size, percent).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(data, size, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_dedup_hot_group(spark, monkeypatch):
    """A large group whose members link only partly, in several blocks."""
    import random

    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 16)
    rng, base, data = random.Random(8), [f"w{i}" for i in range(90)], []
    for i in range(260):
        w = list(base)
        for _ in range(rng.randint(0, 7)):
            w[rng.randrange(90)] = f"q{rng.randrange(10**6)}"
        data.append((i, " ".join(w), "en", "s", 0))
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    got = near_dedup.classes(df, 4, 80).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(data, 4, 80)


def test_near_dedup_edges(none, clashing):
    assert near_dedup.classes(none).count() == 0
    kept = near_dedup.dedup(clashing)
    assert kept.columns == clashing.columns and 0 < kept.count() < clashing.count()


def test_near_dedup_large_bucket_without_links(spark, docs, monkeypatch):
    """Two families and boilerplate that many share without linking, in blocks small enough that sketches route the sets."""
    import random

    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 8)
    monkeypatch.setattr(near_dedup, "GROUP", 2)
    rng, data = random.Random(4), []
    boiler = [f"b{i}" for i in range(60)]
    for i in range(90):
        data.append((i, " ".join(boiler + [f"u{i}_{k}" for k in range(rng.choice([4, 12, 16, 30]))]), "en", "s", 0))
    other = boiler + [f"v{k}" for k in range(18)]
    for i in range(90, 150):
        w = list(other)
        w[rng.randrange(78)] = f"z{i}"
        data.append((i, " ".join(w), "en", "s", 0))
    got = near_dedup.classes(spark.createDataFrame(data, docs.schema), 4, 80).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(data, 4, 80)


def test_near_dedup_repeated_ids(spark, docs):
    base = [f"w{i}" for i in range(60)]
    near = " ".join(base[:59] + ["end"])
    data = [(1, " ".join(base), "en", "s", 0), (5, near, "en", "s", 0), (5, "something else that nothing is like at all", "en", "s", 0)]
    data += [(None, "without an id one two three four five six", "en", "s", 0), (None, "without an id one two three four five six", "de", "s", 0)]
    data += [(8, "the same row many times over and over again", "en", "s", k % 2) for k in range(300)]
    df = spark.createDataFrame(data, docs.schema).repartition(6)
    kept = Counter((r.doc_id, r.text) for r in near_dedup.dedup(df, 4, 80).collect())
    assert kept == Counter({(1, data[0][1]): 1, (5, data[2][1]): 1, (None, data[3][1]): 1, (8, data[-1][1]): 1})
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.classes(df, 4, 80).collect())
    assert got == brute_components(data, 4, 80)


def test_word_hashes_keep_words_apart():
    """Words that polynomials modulo 2^64 confuse, words that differ in order, length or case of other letters only."""
    from ledgerloom.llm.common import word_hashes, words

    def hashes(ws):
        data = np.frombuffer(" ".join(ws).encode(), np.uint8)
        starts, ends, _ = words(data, np.array([0, len(data)]))
        return word_hashes(data, starts, ends).tolist()

    for k in (10, 11, 12):
        w = "a"
        for _ in range(k):
            w += w.translate(str.maketrans("ab", "ba"))
        assert len(set(hashes([w, w.translate(str.maketrans("ab", "ba"))]))) == 2
    odd = ["a" * n for n in range(1, 40)] + ["abcdefgh12345678", "12345678abcdefgh", "É", "é", "a\x00", "a\x00\x00"]
    assert len(set(hashes(odd))) == len(odd)
    assert hashes(["HELLO", "hello", "Hello"]) == hashes(["hello"] * 3)


def test_written_tables_go(spark, docs, tmp_path):
    import pathlib

    from ledgerloom.sources.shared import shared_root

    folder = pathlib.Path(shared_root(spark)) / "ledgerloom"
    before = set(folder.glob("*"))
    near_dedup.classes(docs).count()
    exact_dedup.classes(docs).count()
    assert {p.name.rsplit("-", 1)[0] for p in set(folder.glob("*")) - before} == {"classes"}


def test_sketch_estimate():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.8, 0.95):
        pool = rng.integers(0, 2**63, 4000).astype(np.uint64)
        k = int(2000 * share * 2 / (1 + share))
        a, b = pool[:2000], np.concatenate([pool[:k], pool[2000 : 4000 - k]])
        x, y = (near_dedup.sketch(near_dedup.minima(np.unique(s))).view(np.uint64) for s in (a, b))
        z = x ^ y
        z |= z >> np.uint64(1)
        z |= z >> np.uint64(2)
        off = int(np.bitwise_count(z & np.uint64(0x1111111111111111)).sum())
        assert abs((1 - off / near_dedup.HASHES - 1 / 16) / (15 / 16) - share) < 0.15


# ---------------------------------------------------------------- 6
def test_packing_round_trip():
    rng = np.random.default_rng(2)
    for bits in (1, 5, 8, 13, 16, 17, 32):
        ids = rng.integers(0, 2**bits, 10_000, dtype=np.uint64).astype(np.uint32)
        raw, offsets = token_files.pack(ids, bits, 512)
        for a, b in ((0, 10_000), (0, 0), (511, 513), (9_999, 10_000), (700, 2_100)):
            assert np.array_equal(token_files.unpack(raw, offsets, bits, a, b, 512), ids[a:b])


def test_token_files(docs, data, none, clashing, tmp_path):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    out = str(tmp_path / "files")
    got = token_files.write_and_read(docs, path, path=out).collect()
    want = Counter()
    for i, x, *_ in data:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        want[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))
    one = next(s for f in (tmp_path / "files").glob("part-*") for s in token_files.shards(f.read_bytes()))
    assert len(one.document(0)) == one.ends[0] and one.bits == 16
    assert token_files.write_and_read(none, path).count() == 0
    assert token_files.write_and_read(clashing, path).count() == len(data)


# ---------------------------------------------------------------- 7
def brute_rules(t):
    t = t or ""
    w = WORD.findall(t)
    at = defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    hit = {j for p in at.values() if len(p) > 1 for i in p for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_rules(spark, docs, data, none, clashing):
    extra = [(900, "a b c d e f g h i j " * 30, "en", "a", 0), (901, "x y\nx y\n \nx y\nz # $ | <b>", "en", "a", 0), (902, "a " * 50, "en", "a", 0)]
    df = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rules.ledger(df).collect())
    assert got == Counter((i, *brute_rules(t)) for i, t, *_ in data + extra)
    led = rules.ledger(df).cache()
    kept = {(r.doc_id, r.failed): r.kept for r in rules.apply(led, "base").collect()}
    assert all(k == (f & 3 == 0) for (_, f), k in kept.items())
    table = {r.rule: r for r in rules.ablation(led).collect()}
    fails = [r.failed & rules.mask("v1") for r in led.collect()]
    for k, (name, _) in enumerate(rules.RULES):
        assert table[name].failed == sum(f >> k & 1 for f in fails)
        assert table[name].rejected_alone == sum(f == 1 << k for f in fails)
        assert table[name].kept_without == sum(f & ~(1 << k) == 0 for f in fails)
    assert rules.ledger(none).count() == 0 and rules.ledger(clashing).count() == len(data)


# ---------------------------------------------------------------- 8
def test_token_counts(docs, data, none, clashing):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    want = Counter()
    for i, x, *_ in data:
        n = len(t.encode(x or "", add_special_tokens=False).ids)
        want[i, len((x or "").encode()), n, n > 1024] += 1
    assert bag(token_count.count_tokens(docs, path)) == want == bag(token_count.count_tokens(clashing, path))
    assert token_count.count_tokens(none, path).count() == 0


def test_byte_level_parts_equal_the_pattern():
    import random

    from ledgerloom.llm.token_cache import byte_level_parts

    pattern = re.compile("[ ]?[^ \t\n\x0b\x0c\r]+|[ \t\n\x0b\x0c\r]+(?![^ \t\n\x0b\x0c\r])|[ \t\n\x0b\x0c\r]+")
    rng = random.Random(6)
    texts = ["".join(rng.choices(" \n\tab\u00e9", k=rng.randint(0, 9))) for _ in range(3000)]
    raw = [t.encode() for t in texts]
    starts, ends, first = byte_level_parts(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
    joined = b"".join(raw)
    for k, t in enumerate(texts):
        assert [joined[starts[i] : ends[i]].decode() for i in range(first[k], first[k + 1])] == pattern.findall(t)


def test_part_table_grows_and_shrinks():
    from ledgerloom.llm.token_cache import PartTable

    rng = np.random.default_rng(3)
    table, key, tag = PartTable(np.dtype("<u2"), bits=2), rng.integers(0, 50, 4000).astype(np.uint64) << np.uint64(58), np.arange(4000).astype(np.uint64)
    count = rng.integers(0, 4, 4000)
    ids = rng.integers(0, 60_000, int(count.sum()))
    ends = np.cumsum(count)
    for i in range(0, 4000, 500):
        a, b = (ends[i - 1] if i else 0), ends[i + 499]
        table.add(key[i : i + 500], tag[i : i + 500], count[i : i + 500], ids[a:b])
    assert np.array_equal(table.find(key, tag), np.arange(4000)) and (table.find(key, tag + np.uint64(9000)) == -1).all()
    assert np.array_equal(table.gather(np.arange(4000)), ids)
    few = table.only(np.arange(1000, 1010))
    assert np.array_equal(few.gather(few.find(key[1000:1010], tag[1000:1010])), ids[ends[999] : ends[1009]]) and few.find(key[:1], tag[:1])[0] == -1


def test_heavy_hitters_are_counted(docs, data):
    """With counters enough the counts are exact; with few, each is short by no more than what was taken away."""
    pattern = re.compile("[ ]?[^ \t\n\x0b\x0c\r]+|[ \t\n\x0b\x0c\r]+(?![^ \t\n\x0b\x0c\r])|[ \t\n\x0b\x0c\r]+")
    want = Counter(x.encode() for _, t, *_ in data for x in pattern.findall(t or ""))
    assert token_count.frequent(docs, size=10**6) == want
    few = token_count.frequent(docs, size=50, counters=60)
    assert len(few) <= 50 and all(v <= want[k] for k, v in few.items()) and b" the" in few


def test_heavy_hitters_are_bounded(docs):
    found = token_count.frequent(docs, size=5, counters=20)
    assert 0 < len(found) <= 5


def test_cached_tokenizers_equal_the_library():
    import random

    from tokenizers import Tokenizer

    from ledgerloom.llm.token_cache import CachedTokenizer

    rng = random.Random(4)
    signs = [*" \t\n\x0b\x0c\r  aAbBZ1'sé.,!ß̈\x1c\x85\xa0 　İΣςÀ", "<|endoftext|>", "<|ENDOFTEXT|>", "'re", "中文", "🙂", "the", "ing"]
    texts = ["".join(rng.choices(signs if k % 2 else signs[:22], k=rng.randint(0, 30))) for k in range(4000)]
    for name, by_word in (("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)):
        hot = None if by_word else token_count.length_table([" the", "'re", "\n", "ing", "\u0130"], P.path(name))
        c, t = CachedTokenizer(P.path(name), by_word, limit=300), Tokenizer.from_file(P.path(name))
        lengths = CachedTokenizer(P.path(name), by_word, lengths=True, hot=hot, limit=200)
        got = [x for i in range(0, len(texts), 100) for x in c.encode(texts[i : i + 100])]
        number = [x for i in range(0, len(texts), 77) for x in lengths.count(texts[i : i + 77]).tolist()]
        for a, k, b in zip(got, number, t.encode_batch(texts, add_special_tokens=False), strict=True):
            assert a.tolist() == b.ids and k == len(b.ids)


# ---------------------------------------------------------------- 9
def test_language(spark, docs, none, clashing):
    import random

    rng = random.Random(6)
    roots = {"en": "the and ing with shore under", "de": "der und schön über nicht eine", "fr": "les que être avec où déjà"}
    data = [(i, " ".join(rng.choice(roots[k].split()) for _ in range(rng.randint(5, 40))), k, "s", 0) for i, k in enumerate(rng.choices(list(roots), k=300))]
    df = spark.createDataFrame(data + [(1000, None, "en", "s", 0), (1001, "123 !!", "en", "s", 0)], docs.schema)
    profiles = language_id.train(df)
    assert profiles.langs == ["de", "en", "fr"]
    got = {r.doc_id: r for r in language_id.predict(df, profiles).collect()}
    held = [(i, k) for i, _, k, *_ in data if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got[i].lang_pred == k for i, k in held]) > 0.98 and all(got[i].held_out for i, _ in held)
    assert got[1000].lang_pred == got[1001].lang_pred == "und" and got[1000].score == 0
    assert language_id.predict(none, profiles).count() == 0
    nothing = language_id.train(none)
    assert {r.lang_pred for r in language_id.predict(df, nothing).collect()} == {"und"}
    kept = language_id.accept(clashing, profiles)
    assert kept.columns == clashing.columns and not {300, 301, 302, 303} & {r.doc_id for r in kept.collect()}


def test_language_stage_keeps_short_documents(spark, docs):
    long = [(i, t, k, "s", 0) for i, (t, k) in enumerate([("the shore under the morning and its long shadows", "en"), ("les enfants que nous avons vus avec leurs amis", "fr")] * 20)]
    short = [(1000 + i, t, None, "s", 0) for i, t in enumerate(["A.\nAll rights reserved.", "Avec.", "Hello world", "Zoom call", "Q", "x = f(y)", "\u4e2d\u6587"])]
    df = spark.createDataFrame([*long, *short, (2000, None, "en", "s", 0), (2001, "12 !!", "en", "s", 0)], docs.schema)
    kept = language_id.accept(df, language_id.train(df))
    assert sorted(r.doc_id for r in kept.collect()) == [r[0] for r in [*long, *short]]


def brute_bundle(t, dim):
    vec = lambda c: language_id.letter_vectors(np.array([ord(c)]), dim)[0].astype(int)
    s = "".join(c if c.isalpha() else " " for c in t)
    s = f" {' '.join(s.split(' '))} "
    s = re.sub(" +", " ", s)
    want = np.zeros(dim, int)
    for a, b, c in zip(s, s[1:], s[2:], strict=False):
        if b != " ":
            want += np.roll(vec(a), 2) * np.roll(vec(b), 1) * vec(c)
    return want


BUNDLED = ["abc ab", "", "x", "a-b c", "x", " a", "123", "x y", "über naïve", "x", "\n\n", "a" * 50]


def test_bundles_equal_the_definition():
    import itertools

    for texts in (BUNDLED, BUNDLED[::-1], ["x"], [""], *itertools.permutations(["x", "", "a b"])):
        got, has = language_id.bundles(list(texts), 64)
        for t, v, h in zip(texts, got, has, strict=True):
            assert np.array_equal(v, brute_bundle(t, 64)) and h == any(c.isalpha() for c in t)


def test_language_depends_on_the_text_alone(spark, docs):
    """Profiles and scores by brute force, and the same on equal rows however the table lies."""
    known = [(i, t, k, "s", 0) for i, (t, k) in enumerate([("the shore under the morning", "en"), ("les enfants avec leurs amis", "fr"), ("a", "en"), ("der schöne tag und", "de")] * 30)]
    data = known + [(500 + i, t, None, "s", 0) for i, t in enumerate(["a"] * 40 + ["les", "tag", "Zoom call"] * 9)]
    df = spark.createDataFrame(data, docs.schema)
    profiles = language_id.train(df, rows=60)
    learned = {(r[0], r[1], r[2]) for r in known if zlib.crc32(str(r[0]).encode()) % 4 != 2}
    full = language_id.train(df, rows=10_000)
    assert profiles.langs == full.langs == ["de", "en", "fr"]
    unit = lambda x: x / np.sqrt((x * x).sum())
    want = {k: sum(unit(brute_bundle(t, language_id.DIM)) for _, t, lang in learned if lang == k) for k in full.langs}
    for k, got in zip(full.langs, full.prototypes, strict=True):
        assert abs(unit(got) @ unit(want[k]) - 1) < 1e-6
    once = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(df, full).collect()}
    for i, t, *_ in data:
        cos = [unit(brute_bundle(t.lower(), language_id.DIM)) @ unit(want[k]) for k in full.langs]
        assert once[i][0] == full.langs[int(np.argmax(cos))] and abs(once[i][1] - max(0, max(cos))) < 1e-3
    assert len({once[500 + i] for i in range(40)}) == 1
    for n in (1, 3, 16):
        moved = df.repartition(n).sortWithinPartitions(F.xxhash64("doc_id", F.lit(n)))
        assert {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(moved, language_id.train(moved, rows=10_000)).collect()} == once


def test_rare_languages_are_learned_and_unknown_ones_kept(spark, docs):
    data = [(i, f"the morning {i} by the shore", "en", "s", 0) for i in range(3000)] + [(5000 + i, "les enfants que", "fr", "s", 0) for i in range(4)]
    df = spark.createDataFrame(data, docs.schema)
    assert language_id.train(df, rows=20).langs == ["en", "fr"]
    unknown = spark.createDataFrame([(1, "some words", None, "s", 0), (2, "12", None, "s", 0), (3, None, None, "s", 0)], docs.schema)
    nothing = language_id.train(unknown)
    assert nothing.langs == [] and [r.doc_id for r in language_id.accept(unknown, nothing).collect()] == [1]


# ---------------------------------------------------------------- 10
def test_toxicity(spark, docs, none):
    import random

    rng = random.Random(9)
    clean = lambda: " ".join(f"{rng.choice('bcdfgh')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.randrange(90)}" for _ in range(40))
    calm = [(i, clean(), "en", "s", 0) for i in range(160)]
    rude = [(500 + i, f"{clean()} you stupid zorgon {clean()}", "en", "s", 0) for i in range(80)]
    sly = [(800, f"{clean()} you ѕtup1d z0rgon {clean()}", "en", "s", 0), (801, f"{clean()} YOU $TUPID! zorgon {clean()}", "en", "s", 0), (802, None, "en", "s", 0), (803, "", "en", "s", 0)]
    df = spark.createDataFrame(calm + rude + sly, docs.schema)
    labels = spark.createDataFrame([(r[0], 0) for r in calm] + [(r[0], 1) for r in rude], "doc_id long, toxic int")
    lexicon = toxicity.train(df, labels)
    assert " stupid " in lexicon.weights
    got = {r.doc_id: r for r in toxicity.score(df, lexicon).collect()}
    held = [r[0] for r in calm + rude if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert np.mean([got[i].predicted == (i >= 500) for i in held]) > 0.95
    assert got[800].predicted == got[801].predicted == 1 and got[802].predicted == got[803].predicted == 0
    assert toxicity.score(none, lexicon).count() == 0
    assert toxicity.score(docs, toxicity.train(docs, labels.limit(0))).count() == docs.count()


def naive_density(x, folded):
    """At each start the longest pattern, unless an exception phrase covers its first sign and the next."""
    total = 0.0
    for s in range(len(folded)):
        here = [p for p in x.weights if folded.startswith(p, s)]
        covered = any(folded.startswith(e, a) and a <= s and s + 1 <= a + len(e) - 1 for e in x.exceptions for a in range(max(0, s - len(e)), s + 1))
        if here and not covered:
            total += x.weights[max(here, key=len)]
    return total / max(1, len(folded.split())) ** x.power


def test_density_equals_a_naive_matcher():
    import random

    rng = random.Random(12)
    words_ = ["kill", "killer", "kilo", "time", "the", "dumb", "dumbbell", "row", "a"]
    for k in range(300):
        weights = {f" {w}{rng.choice(['', ' '])}": rng.randint(1, 9) for w in rng.sample(words_, 4)}
        phrases = {f" {rng.choice(words_)} {rng.choice(words_)} " for _ in range(rng.randint(0, 4))}
        x = toxicity.Lexicon(weights, phrases, rng.choice([0.25, 1.0]))
        text = f" {' '.join(rng.choices(words_, k=rng.randint(0, 30)))} ".replace("  ", " ")
        assert abs(x.density(text) - naive_density(x, text)) < 1e-9


def test_many_hits_and_phrases_take_linear_time():
    x = toxicity.Lexicon({" kill ": 5.0}, {" kill time "}, 0.5)
    start = time.process_time()
    assert x.density(" " + "kill time " * 30_000) == 0 and x.density(" " + "kill time " * 30_000 + "kill ") > 0
    assert time.process_time() - start < 2


def test_exceptions_are_learned(spark, docs):
    import random

    rng = random.Random(3)
    fill = lambda: " ".join(f"{rng.choice('bcdfgh')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.randrange(900)}x" for _ in range(12))
    bad = [f" {fill()} grumpel {fill()} " for _ in range(80)]
    calm = [f" {fill()} grumpel cake {fill()} " for _ in range(8)] + [f" {fill()} {fill()} " for _ in range(300)]
    x = toxicity.learn(bad + calm, np.array([1] * 80 + [0] * 308))
    assert " grumpel " in x.weights and " grumpel cake " in x.exceptions
    assert x.density(f" {fill()} grumpel cake {fill()} ") < x.density(f" {fill()} grumpel {fill()} ")


def test_exceptions_do_not_count():
    x = toxicity.Lexicon({" kill ": 5.0}, {" kill time "}, 0.0, 1.0, 0.0)
    assert x.density(" we kill time here ") == 0 and x.density(" we kill here ") == 5
