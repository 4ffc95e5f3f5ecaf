"""Unknown tables, the ensemble as one model, batches, extracts, rings end to end, readers and submissions."""

import datetime as dt
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.numeric import finite
from ledgerloom.operators import export as E
from ledgerloom.operators import graph as G
from ledgerloom.operators import learn as H
from ledgerloom.operators import ledger as L
from ledgerloom.operators import monitor as N
from ledgerloom.operators import motifs as M
from ledgerloom.operators import scoring as C
from ledgerloom.operators import temporal as T
from ledgerloom.operators import unified as U
from ledgerloom.sources import io

START = dt.datetime(2023, 1, 2, 10)


def foreign(spark, n=60):
    """Conduits (every tenth row) pass on what arrives, in round amounts and soon."""
    rng, rows = random.Random(4), []
    for i in range(n):
        bad = i % 10 == 0
        came = rng.uniform(100, 1000)
        rows.append((i, came, came * (1.0 if bad else rng.uniform(0, 0.5)), 0.9 if bad else rng.uniform(0, 0.4), None if i == 5 else 1.0 if bad else rng.uniform(10, 90), "x"))
    return spark.createDataFrame(rows, "ref long, `total inward 31 days` double, `total outward 31 days` double, round_ratio double, time_to_out double, note string")


def test_quantiles_are_exact(spark):
    import numpy as np

    from ledgerloom.functions.numeric import quantiles

    rng, probs = random.Random(5), [0.0, 0.1, 0.25, 0.5, 0.9, 0.99, 1.0]
    rows = [(rng.gauss(0, 1), float(rng.choice([1, 1, 1, 1, 7])), None if i % 3 else rng.random(), None, float("nan") if i % 2 else float(i)) for i in range(700)]
    got = {(r.column, r.prob): r.value for r in quantiles(spark.createDataFrame(rows, "a double, b double, c double, d double, `e x` double"), ["a", "b", "c", "d", "e x"], probs).collect()}
    for k, c in ((0, "a"), (1, "b"), (2, "c"), (4, "e x")):
        want = np.quantile([r[k] for r in rows if r[k] is not None and r[k] == r[k]], probs)
        assert np.allclose([got[c, p] for p in probs], want, atol=1e-12)
    assert len(got) == 28
    one = spark.createDataFrame([(3.0,)], "x double")
    assert {r.value for r in quantiles(one, ["x"], probs).collect()} == {3.0} and quantiles(one.limit(0), ["x"], probs).count() == 0


def test_typology(spark):
    df = foreign(spark)
    signals, source = C.typology(df, "ref")
    assert set(signals.columns) == {"ref", "passthrough", "round-amount_share", "hours_to_outflow"}
    assert source["passthrough (in)"] == "total inward 31 days" and "low is suspicious" in source["hours_to_outflow"]
    rows, _ = C.ranking(df, "ref")
    got = {r.ref: r for r in rows.collect()}
    best = sorted(got, key=lambda i: -got[i].score)[:6]
    assert len(got) == 60 and set(best) == set(range(0, 60, 10)) and {i for i, r in got.items() if r.flagged} <= set(best)
    cut = C.otsu(rows.select("score")).first().threshold
    assert all(r.flagged == (r.score >= cut) for r in got.values()) and got[best[0]].flagged
    # ranks are those of each column's own rows, ties averaged
    want = {}
    for c in ("passthrough", "round-amount_share", "hours_to_outflow"):
        xs = {r.ref: r[c] for r in signals.collect() if r[c] is not None}
        for i, x in xs.items():
            want.setdefault(i, []).append((sum(v < x for v in xs.values()) + (sum(v == x for v in xs.values()) + 1) / 2) / len(xs))
    assert all(abs(got[i].score - sum(v) / len(v)) < 1e-9 for i, v in want.items())
    with pytest.raises(ValueError):
        C.ranking(df.select("ref", "note"), "ref")


def test_rank_score_is_the_double_nearest_to_the_mean(spark):
    """Shares added as doubles end in a last bit that hangs on their order, which decides how a mean halfway between two roundings is rounded."""
    n = 10
    rows = [(i, float(i), float(i * 3 % n), float(i * 7 % n)) for i in range(n)]
    got = {r.ref: r.score for r in C.rank_score(spark.createDataFrame(rows, "ref long, a double, b double, c double"), "ref").collect()}
    assert got == {i: float(Fraction(sum(int(x) + 1 for x in xs), 3 * n)) for i, *xs in rows}


def test_router():
    assert C.route(60, 100, True) == C.route(60, 100, False) == "SCORE_ONLY"
    assert C.route(20, 100, True) == "FITTED_ON_SHARED_COLUMNS" and C.route(20, 100, False) == "TYPOLOGY_RANKING"
    assert C.route(3, 100, True) == "TYPOLOGY_RANKING" and C.route(4, 6, True) == "SCORE_ONLY"
    assert C.shared(["Txn Amt", "other", "TXN_AMT"], ["TXN_AMT", "b"]) == {"Txn Amt": "TXN_AMT"}


def labelled(spark, n=160):
    rng = random.Random(7)
    rows = []
    for i in range(n):
        y = int(i % 4 == 0)
        rows.append((i, y, *[rng.gauss(2.0 * y if k < 3 else 0, 1) for k in range(6)]))
    return spark.createDataFrame(rows, "id long, y int, a double, b double, c double, d double, e double, f double")


def test_ensemble_is_one_model(spark, tmp_path):
    df, names = labelled(spark), list("abcdef")
    model = H.Ensemble(names, trees=5, k=2).fit(df.filter("id % 5 <> 0"), "id")
    test = df.filter("id % 5 = 0")
    got = {r.id: r.p for r in model.predict(test, "id").collect()}
    y = {r.id: r.y for r in test.collect()}
    pos, neg = [got[i] for i in y if y[i]], [got[i] for i in y if not y[i]]
    assert sum(p > q for p in pos for q in neg) > 0.8 * len(pos) * len(neg) and all(0 <= p <= 1 for p in got.values())
    model.save(str(tmp_path / "m"), spark)
    again = H.Ensemble.load(str(tmp_path / "m"), spark)
    assert {r.id: round(r.p, 9) for r in again.predict(test, "id").collect()} == {i: round(p, 9) for i, p in got.items()}
    one = C.score_account({"a": 2.5, "B": 2.0, "c": "3", "unknown": 1, "d": "text"}, model, spark)
    assert one["features_recognised"] == 3 and one["features_ignored"] == ["unknown", "d (not numeric)"] and one["features_imputed"] == 3 and one["band"] in C.ACTIONS
    scored = C.score_table(test.drop("y", "f"), "id", model)
    assert scored.mode == "SCORE_ONLY" and scored.detail["imputed"] == ["f"] and scored.rows.count() == 32
    ranked = C.score_table(foreign(spark), "ref", model)
    assert ranked.mode == "TYPOLOGY_RANKING" and ranked.rows.count() == 60


def test_shared_columns_are_fitted(spark):
    df = labelled(spark)
    rows, quality = C.fit_on_shared(df.drop("id"), "y", df.filter("id % 3 = 0").select("id", *[F.col(c).alias(c.upper()) for c in "abcde"]), "id", trees=5, k=2)
    assert quality["columns"] == list("ABCDE") and quality["oof_auprc"] > 0.5 and rows.count() == 54
    with pytest.raises(ValueError):
        C.fit_on_shared(df.drop("id"), "y", df.select("id", "a"), "id", trees=2)


def test_calibration_lines(spark):
    df = spark.createDataFrame([(x / 10,) for x in range(11)], "s double")
    got = [r.p for r in H.Calibration({"at": [0.2, 0.6], "p": [0.1, 0.9]}).apply(df, "s").orderBy("s").collect()]
    assert got[:3] == [0.1] * 3 and abs(got[4] - 0.5) < 1e-9 and got[6:] == [0.9] * 5
    assert H.Calibration({"slope": 1.0, "shift": 0.0}).apply(df.filter("s = 0.5"), "s").first().p == 0.5


def test_batches_are_assessed(spark):
    ref = spark.createDataFrame([(i, i / 500, float(i % 50)) for i in range(500)], "id long, p double, x double")
    same = N.monitor_batch(ref, ref, {"x": 1.0, "gone": 2.0})
    assert same["action"] == "MONITOR" and same["band"] == "stable" and same["missing"] == ["gone"]
    moved = ref.withColumn("x", F.col("x") + 100)
    first = N.monitor_batch(ref, moved, {"x": 1.0})
    second = N.monitor_batch(ref, moved, {"x": 1.0}, history=first["state"])
    assert first["action"] == "MONITOR" and first["band"] == "severe" and second["action"] == "HALT_AUTOMATION" and second["signoff"]
    none = N.monitor_batch(ref, ref.select(F.col("x").alias("z")), {"x": 1.0})
    assert none["action"] == "CANNOT_ASSESS" and none["signoff"] and none["drift"] is None


def test_extract_drift(spark):
    rng = random.Random(3)
    rows = [("A" if i % 3 else "B", rng.gauss(0, 1), rng.gauss(0 if i % 3 else 2, 1), rng.random() if i < 20 else None) for i in range(900)]
    got = {r.column: r for r in N.extract_drift(spark.createDataFrame(rows, "e string, same double, moved double, few double"), "e", ["same", "moved", "few"]).collect()}
    assert set(got) == {"same", "moved"} and got["moved"].shifted and got["moved"].p_value == 0 and not got["same"].shifted and got["same"].p_value > 0.01


def test_holdout_and_verdict(spark):
    df = spark.createDataFrame([(i, int(i < 40), f"m{i % 3 if i < 39 else 9}") for i in range(900)], "id long, y int, month string")
    held = H.blind_holdout(df, "id", "y", "month")
    got = held.filter("held_out")
    assert got.filter("y = 1").count() == 13 and got.filter("y = 0").count() == 200 and held.count() == 900
    assert got.filter("y = 1").select("month").distinct().count() == 4
    assert H.blind_holdout(df.limit(0), "id", "y").count() == 0
    audit = spark.createDataFrame([("missingness", 0.5, 0.01), ("weak_columns", None, 0.01), ("shuffled_labels", 0.01, 0.01)], "test string, auprc double, prevalence double")
    v = H.verdict(audit, False, {"MONTH": 1.0, "x": 0.5}, 0.01)
    assert v["contaminated"] and len(v["grounds"]) == 2 and v["unavailable"] == ["weak_columns"] and "CONTAMINATED" in H.integrity_report(v, audit)
    assert not H.verdict(audit.filter("test = 'shuffled_labels'"), False, {}, 0.01)["contaminated"]


def test_rings_end_to_end(spark):
    none = spark.createDataFrame([], "src long, dst long")
    assert not G.detect_rings(none).graph_possible and G.detect_rings(none).reason
    rng = random.Random(2)
    edges = [(a, b) for a in range(6) for b in range(6) if a != b] * 3 + [(rng.randrange(6, 60), rng.randrange(6, 60)) for _ in range(150)] + [(0, 30), (1, 40)]
    found = G.detect_rings(spark.createDataFrame(edges, "src long, dst long"))
    best = found.rings.orderBy(F.desc("score")).first()
    assert {r.account for r in found.members.filter(F.col("grp") == best.grp).collect()} >= set(range(6)) and found.n_rings_flagged == found.rings.count() and sum(found.role_distribution.values()) == found.n_nodes
    assert G.detect_rings(spark.createDataFrame(edges, "src long, dst long"), min_score=2.0).n_rings_flagged == 0
    groups = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (1, "b"), (3, "c")], "account long, grp string")
    assert {r.grp for r in G.distinct_groups(groups).collect()} == {"a", "c"}
    rings = spark.createDataFrame([("a", 0.9), ("c", 0.5), ("d", 0.4)], "grp string, score double")
    curve = G.ring_curve(rings, groups, spark.createDataFrame([(1,), (9,)], "account long"), tops=(1, 2, 3, 50)).orderBy("top_k_rings").collect()
    assert [(r.top_k_rings, r.accounts_surfaced, r.members_found, r.recall) for r in curve] == [(1, 2, 1, 0.5), (2, 3, 1, 0.5), (3, 3, 1, 0.5)]
    cells = spark.createDataFrame([(0, 1.0, None), (1, 1.0, 7.0), (2, -1.0, 0.0)], "row long, a double, b double")
    assert sorted((r.src, r.dst) for r in G.edges_of_columns(cells, "row", ["a", "b"]).collect()) == [(0, 1), (2, 0)]
    led = spark.createDataFrame([(1, 2, 1, "x"), (2, 3, 1, "y"), (4, 5, 0, "z")], "src long, dst long, flag int, typology string")
    assert {r.account: r.typologies for r in G.laundering_truth(led).collect()} == {1: ["x"], 2: ["x", "y"], 3: ["y"]}


def transfers(spark, n=400):
    rng = random.Random(9)
    rows = [(rng.randrange(20), rng.randrange(20), round(rng.choice([rng.uniform(1, 100), 49000.0, 10.0, 0.0]), 2), START + dt.timedelta(hours=rng.randrange(400))) for _ in range(n)]
    return rows, spark.createDataFrame(rows, "src long, dst long, amount double, ts timestamp")


def test_chains_equal_all_pairs(spark):
    rows, df = transfers(spark)
    start = min(r[3] for r in rows)
    week = lambda t: (t - start) // dt.timedelta(days=7)
    want = sorted((a, b, d, x, y) for a, b, x, t in rows for c, d, y, u in rows if b == c and week(t) == week(u) and x > 0 and a != d and u >= t and 0.75 <= y / x <= 1.05)
    got = sorted((r.a, r.b, r.c, r.amount_in, r.amount_out) for r in M.detect(df)["chain"].collect())
    assert got == want and len(got) > 100
    odd = spark.createDataFrame([(1, 2, float("inf"), START), (2, 3, float("inf"), START), (1, 2, float("nan"), START), (2, 3, -75.0, START), (1, 2, 100.0, START)], "src long, dst long, amount double, ts timestamp")
    assert [(r.amount_in, r.amount_out) for r in M.detect(odd)["chain"].collect()] == [(100.0, 75.0)]
    assert M.detect(df.limit(0))["evidence"].count() == 0


def test_short_windows_widen_to_the_larger_neighbour(spark):
    rng, rows, want = random.Random(1), [], {}
    for a in range(80):
        s = [round(rng.random() * 0.4, 3) for _ in range(rng.randint(1, 6))]
        s[rng.randrange(len(s))] = 0.9
        rows += [(a, dt.date(2023, 1, 1) + dt.timedelta(days=i), x) for i, x in enumerate(s)]
        lo = hi = s.index(0.9)
        while hi - lo < 2 and (lo > 0 or hi < len(s) - 1):
            left, right = (s[lo - 1] if lo else None), (s[hi + 1] if hi + 1 < len(s) else None)
            lo, hi = (lo - 1, hi) if left is not None and (right is None or left > right) else (lo, hi + 1)
        want[a] = (dt.date(2023, 1, 1) + dt.timedelta(days=lo), dt.date(2023, 1, 1) + dt.timedelta(days=hi))
    df = spark.createDataFrame(rows, "account_id int, day date, score double")
    cut = df.select("account_id").distinct().withColumn("threshold", F.lit(0.6)).withColumn("separation", F.lit(0.0))
    assert {r.account_id: (r.start, r.end) for r in T.windows(df, cut).collect()} == want


def test_unified(spark):
    _, df = transfers(spark)
    f = U.build(df)
    assert len(f.columns) == 39 and f.count() == 20 and all(v is not None and v == v for r in f.collect() for v in r)
    scorer = U.UnifiedScorer(trees=3)
    assert scorer.mode == "unfitted" and scorer.predict(f).count() == 20
    f = f.withColumn("y", (F.col("account_id") % 2).cast("int"))
    assert scorer.fit(f, "y").mode == "supervised" and scorer.predict(f).columns == ["account_id", "is_mule"]


def test_infinite_values_count_as_missing(spark):
    df = spark.createDataFrame([(1, 2, float("inf"), START), (1, 2, 10.0, START), (2, 1, float("nan"), START)], "src long, dst long, amount double, ts timestamp")
    f = {r.account_id: r for r in L.features(df).collect()}
    assert f[1].sum_out == 10.0 and all(v == v and abs(v) < float("inf") for r in f.values() for v in r[1:])
    assert spark.createDataFrame([(float("-inf"),), (None,), (2.0,)], "x double").select(finite(F.col("x")).alias("x")).filter("x is not null").count() == 1


def test_readers_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 0.5)], "id long, feature string, value double")
    df.write.parquet(str(tmp_path / "t.parquet"))
    (tmp_path / "u.csv").write_text("x,y\n1,2\n")
    assert io.read_frame(spark, str(tmp_path / "t")).count() == 1 and io.read_frame(spark, str(tmp_path / "u.parquet")).columns == ["x", "y"]
    assert io.read_attributions(spark, str(tmp_path / "t.parquet")).columns == ["id", "feature", "value"]
    assert io.check_upload("../../a b.csv", 10) == "a_b.csv"
    for bad in (("x.exe", 10), ("x.csv", 0), ("x.csv", 5 << 30)):
        with pytest.raises(ValueError):
            io.check_upload(*bad)
    state = str(tmp_path / "state")
    io.save_state(df, state)
    io.save_state(spark.read.parquet(state).unionByName(df), state)
    assert spark.read.parquet(state).count() == 2
    assert C.detect_target(df.withColumn("is_mule", (F.col("id") == 1).cast("int")).unionByName(df.withColumn("is_mule", F.lit(0))))["target"] == "is_mule"
    assert not C.detect_target(df)["labelled"]


def test_submission_columns_are_found(spark):
    df = spark.createDataFrame([("A", 100.0, 1), ("B", 400.0, 2)], "acct_id string, risk_score double, z int")
    out, notes = E.build_submission(df, None)
    assert {r.account_id: r.is_mule for r in out.collect()} == {"A": 0.25, "B": 1.0} and len(notes) == 1
    out, notes = E.build_submission(df.select("risk_score").repartition(3), None)
    assert sorted(r.account_id for r in out.collect()) == [1, 2] and len(notes) == 2
    with pytest.raises(ValueError):
        E.build_submission(df.select("acct_id"))
