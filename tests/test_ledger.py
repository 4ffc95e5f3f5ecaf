"""Planted ledgers: features, motifs, graph evidence, windows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import graph as G
from ledgerloom.operators import ledger as L
from ledgerloom.operators import motifs as M
from ledgerloom.operators import temporal as T
from ledgerloom.sources.views import account_view

START = dt.datetime(2023, 1, 2, 10)
KIND = "src string, dst string, amount double, ts timestamp"


def day(n, hour=0):
    return START + dt.timedelta(days=n, hours=hour)


def test_features_of_one_sided_accounts_and_no_nulls(spark):
    df = spark.createDataFrame([("A", "B", 49000.0, day(0)), ("B", "C", 48000.0, day(1)), ("A", "B", -1000.0, day(2, -8)), ("X", "Y", 5.0, None)], KIND)
    f = {r.account_id: r for r in L.features(df).collect()}
    assert set(f) == {"A", "B", "C"}
    assert f["A"].retention == 1.0 and f["A"].passthrough == 0.0 and f["C"].in_out_ratio == 0.0
    assert f["B"].sum_in == 50000.0 and abs(f["B"].passthrough - 0.96) < 1e-12 and f["A"].threshold_share == 0.5 and f["A"].night_share == 0.5
    assert all(v is not None and v == v for r in f.values() for v in r)
    with pytest.raises(KeyError):
        L.features(df.drop("amount"))
    assert L.features(df.limit(0)).count() == 0


def test_rank_blend_averages_ties(spark):
    rows = [(str(i), float(i // 2), 0.0, 0.0, 0.0, 0.0, 0.0, 0.5) for i in range(4)]
    df = spark.createDataFrame(rows, "account_id string, passthrough double, burstiness double, threshold_share double, round_share double, night_share double, txn_per_counterparty double, retention double")
    got = {r.account_id: r.is_mule for r in L.rank_blend(df).collect()}
    assert got["0"] == got["1"] < got["2"] == got["3"]


def test_motifs(spark):
    fan = [("HUB", f"L{i}", 49000.0, day(i % 3)) for i in range(6)] + [("P", f"E{i}", 12000.0 * (i + 1), day(1)) for i in range(8)] + [("S", f"T{i}", 10.0, day(0)) for i in range(3)]
    fan += [("W", f"A{i}", 10.0, day(0)) for i in range(4)] + [("W", f"A{i}", 10.0, day(8)) for i in range(4)]
    got = M.detect(spark.createDataFrame(fan, KIND))["fan_out"].collect()
    by = {(r.account, r.bucket): r for r in got}
    assert set(by) == {("HUB", 0), ("P", 0), ("W", 0), ("W", 1)}
    assert by["HUB", 0].uniformity - by["P", 0].uniformity > 0.3 and by["HUB", 0].threshold_hugging == 1.0 and by["HUB", 0].counterparties == [f"L{i}" for i in range(6)]
    hub = [(f"I{i}", "C", 50000.0, day(0)) for i in range(5)] + [("C", f"O{i}", 49000.0, day(1)) for i in range(5)] + [(f"J{i}", "SHOP", 50000.0, day(0)) for i in range(5)] + [("SHOP", "K", 5000.0, day(1))]
    gs = M.detect(spark.createDataFrame(hub, KIND))["gather_scatter"].collect()
    assert [r.account for r in gs] == ["C"] and gs[0].conservation > 0.9
    for rows, n in (([("A", "B", 1e5, day(0)), ("B", "C", 98000.0, day(1))], 1), ([("A", "B", 1e5, day(1)), ("B", "C", 98000.0, day(0))], 0), ([("A", "B", 1e5, day(0)), ("B", "A", 98000.0, day(1))], 0), ([("A", "B", 1e5, day(0)), ("B", "C", 5e4, day(1))], 0)):
        assert M.detect(spark.createDataFrame(rows, KIND))["chain"].count() == n


def ring():
    rng, edges = random.Random(1), []
    for _ in range(4):
        edges += [(0, 1), (0, 2), (1, 3), (2, 4), (3, 5), (4, 5), (5, 0), (1, 2), (3, 4)]
    edges += [tuple(rng.sample(range(100, 160), 2)) for _ in range(60)] + [(200, 201 + i) for i in range(15)]
    return edges


def test_graph(spark):
    e = spark.createDataFrame(ring(), "src long, dst long")
    g = G.collapse(e.unionByName(spark.createDataFrame([(7, 7)], "src long, dst long")))
    assert g.filter("src = dst").count() == 0 and g.filter("src = 0 and dst = 1").first().weight == 4
    assert {r.account: r.role for r in G.roles(g).collect()}[200] == "SOURCE"
    comm = G.communities(g)
    own = {r.account: r.grp for r in comm.collect()}
    assert sum(own[i] == own[3] for i in range(6)) >= 4
    rings = G.ring_scores(g, comm).collect()
    assert rings and own[3] in {r.grp for r in rings}
    groups = spark.createDataFrame([(i, 1) for i in range(6)], "account long, grp int")
    assert G.cycles(g, groups).first().cycles == brute_cycles({(a, b) for a, b in ring() if a < 6})
    hops = {r.account: (r.hop, r.score) for r in G.propagate(g, spark.createDataFrame([(0,)], "account long")).collect()}
    assert hops[0] == (0, 1.0) and hops[1] == (1, 0.85) and 100 not in hops


def test_rings_inside_a_large_community_are_found(spark):
    rng = random.Random(2)
    ring = [(a, b) for a in range(6) for b in range(6) if a != b]
    edges = ring * 3 + [(a, 6 + rng.randrange(60)) for a in range(6) for _ in range(3)] + [(6 + i, 6 + j) for i in range(60) for j in rng.sample(range(60), 12) if i != j]
    g = G.collapse(spark.createDataFrame(edges, "src long, dst long"))
    found = {}
    for r in G.candidate_groups(g).collect():
        found.setdefault(r.grp, set()).add(r.account)
    large = [m for k, m in found.items() if k.startswith("0:") and len(m) > 25]
    assert large and {a for k, m in found.items() if k.startswith("0:") for a in m} == set(range(66))
    assert any(m < big for big in large for k, m in found.items() if not k.startswith("0:"))
    assert len({frozenset(m) for m in found.values()}) == len(found)
    assert any(len(m & set(range(6))) >= 4 and len(m) <= 25 for m in found.values())


def test_communities_are_a_fixed_point(spark):
    line = [(i, i + 1) for i in range(60)] + [(i, i + 1) for i in range(0, 60, 7)]
    g = G.collapse(spark.createDataFrame(line, "src long, dst long"))
    own = {r.account: r.grp for r in G.communities(g).collect()}
    near = {}
    for r in g.collect():
        for a, b in ((r.src, r.dst), (r.dst, r.src)):
            votes = near.setdefault(a, {})
            votes[own[b]] = votes.get(own[b], 0) + r.weight
    assert all(v.get(own[a], 0) == max(v.values()) for a, v in near.items())


def test_passthrough_of_overlapping_groups(spark):
    g = G.collapse(spark.createDataFrame([(1, 2, 10.0), (2, 3, 5.0), (3, 9, 2.0), (8, 1, 4.0)], "src long, dst long, amount double"))
    groups = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (1, "b"), (2, "b")], "account long, grp string")
    assert {r.grp: (r.inflow, r.outflow) for r in G.group_passthrough(g, groups).collect()} == {"a": (4.0, 2.0), "b": (4.0, 5.0)}


def brute_cycles(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    n = 0

    def walk(first, at, seen):
        nonlocal n
        for x in out.get(at, ()):
            if x == first and len(seen) >= 2:
                n += 1
            elif x > first and x not in seen and len(seen) < 5:
                walk(first, x, seen | {x})

    for v in out:
        walk(v, v, {v})
    return n


def kadane(x):
    best, cur, start, out = 0.0, 0.0, 0, None
    for i, v in enumerate(x):
        if cur <= 1e-12:
            cur, start = 0.0, i
        cur += v
        if cur > best + 1e-12:
            best, out = cur, (start, i)
    return out


def test_window_is_the_best_interval(spark):
    rng = random.Random(5)
    rows = [(a, dt.date(2023, 1, 1) + dt.timedelta(days=i), round(rng.random(), 3)) for a in range(60) for i in range(rng.randint(5, 40))]
    s = spark.createDataFrame(rows, "account_id int, day date, score double")
    cut = s.select("account_id").distinct().withColumn("threshold", F.lit(0.6)).withColumn("separation", F.lit(0.0))
    got = {r.account_id: r for r in T.windows(s, cut).collect()}
    for a in range(60):
        mine = sorted(r for r in rows if r[0] == a)
        want = kadane([r[2] - 0.6 for r in mine])
        if want and want[1] - want[0] >= 2:
            assert (got[a].start, got[a].end) == (mine[want[0]][1], mine[want[1]][1])
        elif want:
            assert got[a].days == 3


def test_episode_and_iou(spark):
    rng, rows = random.Random(2), []
    for i in range(280):
        hot = 120 <= i < 160
        for _ in range(5 if hot else 1):
            rows.append(("m", f"x{rng.randrange(99)}" if not hot else "y", 48000.0 if hot else 900.0 + rng.random(), day(i)))
            if hot:
                rows.append(("z", "m", 48500.0, day(i)))
    found = T.detect(account_view(spark.createDataFrame(rows, KIND)).filter("account_id = 'm'"))
    truth = spark.createDataFrame([("m", day(120).date(), day(159).date())], "account_id string, suspicious_start date, suspicious_end date")
    assert T.score_windows(found, truth).first().mean_iou > 0.6
    d = lambda n: F.lit(dt.date(2023, 1, 1) + dt.timedelta(days=n))
    none = F.lit(None).cast("date")
    r = spark.range(1).select(T.iou(d(0), d(9), d(9), d(0)).alias("a"), T.iou(d(0), d(1), d(5), d(6)).alias("b"), T.iou(none, none, none, none).alias("c"), T.iou(d(0), d(1), none, none).alias("d"), T.iou(d(0), d(1), d(1), d(2)).alias("e")).first()
    assert (r.a, r.b, r.c, r.d) == (1.0, 0.0, 1.0, 0.0) and abs(r.e - 1 / 3) < 1e-12
