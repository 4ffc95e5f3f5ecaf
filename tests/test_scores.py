"""Metrics, monitoring, cleaning, names, readers, learners and the streaming extension."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import learn as H
from ledgerloom.operators import metrics as X
from ledgerloom.operators import monitor as N
from ledgerloom.operators import names as R
from ledgerloom.operators import quality as K
from ledgerloom.sources import io
from ledgerloom.streaming import fans, policy


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(3)
    rows = [(i, int(rng.random() < 0.2), round(rng.random(), 2)) for i in range(500)]
    return spark.createDataFrame([(i, y, min(1.0, p + 0.3 * y)) for i, y, p in rows], "id long, y int, p double")


def test_auroc_and_average_precision(scored):
    rows = [(r.y, r.p) for r in scored.collect()]
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    assert abs(X.auroc(scored).first().auroc - want) < 1e-9
    ap = 0.0
    for t in sorted({p for _, p in rows}, reverse=True):
        above = [y for y, p in rows if p >= t]
        ap += sum(y for y, p in rows if p == t) / len(pos) * sum(above) / len(above)
    assert abs(X.average_precision(scored).first().auprc - ap) < 1e-9
    one = scored.withColumn("y", F.lit(0))
    assert X.auroc(one).first().auroc is None and X.pick_threshold(one, 0.9).first().threshold == 0.5


def test_ranks_and_folds(scored):
    want = [r.id for r in sorted(scored.collect(), key=lambda r: (-r.p, r.id))]
    assert [r.id for r in X.ranked(scored).orderBy("rank").collect()] == want
    f = X.folds(scored).groupBy("y", "fold").count().collect()
    for y in (0, 1):
        n = [r["count"] for r in f if r.y == y]
        assert len(n) == 5 and max(n) - min(n) <= 1
    assert sorted(map(tuple, X.folds(scored.repartition(7)).collect())) == sorted(map(tuple, X.folds(scored).collect()))


def test_psi_and_ks(spark):
    rng = random.Random(1)
    a = spark.createDataFrame([(rng.gauss(0, 1), 0.0) for _ in range(2000)], "x double, c double")
    b = spark.createDataFrame([(rng.gauss(2, 1), 0.0) for _ in range(2000)], "x double, c double")
    same, moved = ({r.feature: r.psi for r in N.psi(a, o, ["x", "c"]).collect()} for o in (a, b))
    assert same["x"] < 0.01 and moved["x"] > 0.25 and moved["c"] == 0.0
    assert {r.feature: r.ks for r in N.ks(a, b, ["x"]).collect()}["x"] > 0.5
    assert N.psi(a, b.limit(0), ["x"]).first().psi == 0.0


def test_policy_needs_two_batches_in_a_row(spark):
    rows = [(1, 0.6, 0.0, 0.9, 100), (2, 0.0, 0.0, 0.9, 100), (3, 0.6, 0.0, 0.9, 100), (4, 0.6, 0.0, 0.9, 100), (5, 0.0, 0.0, 0.5, 200), (6, 0.0, 0.0, 0.5, 200), (7, 0.0, 0.3, 0.9, 5), (8, 0.0, 0.3, 0.5, 5)]
    got = [r.action for r in N.policy(spark.createDataFrame(rows, "batch int, weighted_psi double, score_psi double, precision double, reviewed long"), 0.9).orderBy("batch").collect()]
    assert got == ["MONITOR", "MONITOR", "MONITOR", "HALT_AUTOMATION", "MONITOR", "REFIT_THRESHOLDS", "MONITOR", "RECALIBRATE"]


def test_label_noise_finds_flips_and_ignores_scale(spark):
    rng = random.Random(4)
    rows = [(i, 0, rng.uniform(0, 0.05)) for i in range(500)] + [(500 + i, 1, rng.uniform(0.85, 0.99)) for i in range(25)] + [(900, 0, 0.97), (901, 1, 0.01)]
    df = spark.createDataFrame(rows, "id long, y int, p double")
    assert {900, 901} <= {r.id for r in N.noise_suspects(df).collect()}
    cube = df.withColumn("p", F.col("p") * F.col("p") * F.col("p"))
    assert {r.id for r in N.noise_rank(df).collect()} == {r.id for r in N.noise_rank(cube).collect()}


def test_dominant_value_gets_its_own_band(spark):
    df = spark.createDataFrame([(i, 0.0 if i < 300 else float(i)) for i in range(400)], "id long, v double")
    n = {r.band: r["count"] for r in N.fair_bands(df, "v").groupBy("band").count().collect()}
    assert n["Q1"] == 300 and sum(n.values()) == 400


def test_cleaning(spark):
    rng = random.Random(6)
    rows = []
    for i in range(300):
        y = int(i % 10 == 0)
        x = rng.random()
        rows.append((f"A{i}", x, 2 * x + 1, float("nan") if i % 3 else x, "M1" if y else f"M{2 + i % 3}", rng.choice(["red", "blue", "green"]), y * 50.0 + x, 1.0, y))
    df = spark.createDataFrame(rows, "account_number string, a double, copy double, rare double, data_month string, colour string, leak double, flat double, is_mule int")
    assert K.resolve_target(df) == ("is_mule", "name")
    out, report = K.hardened(df, "is_mule")
    assert report["identifiers"] == ["account_number"] and "data_month" in report["leak_names"] and report["sparse"] == ["rare"] and report["constant"] == ["flat"] and report["collinear"] == ["copy"] and report["leak_correlation"] == ["leak"]
    assert {"a", "mg_colour_blue", "mg_colour_green", "mg_colour_red", "is_mule"} == set(out.columns)
    assert K.row_order(df.withColumn("o", F.col("is_mule") * 2**50 + F.monotonically_increasing_id()), "is_mule", "o").first().is_sorted
    assert K.ordinal_mapping(["low", "High", "medium"])["HIGH"] == 3 and K.ordinal_mapping(["L7D", "L31D", "G365D"])["G365D"] == 730 and K.ordinal_mapping(["a", "b", "c"]) is None


@pytest.mark.parametrize(("name", "want"), [("TOT_TXNAMT_CR_L7D", ("amount", "credit", 7)), ("InwardAmount7Day", ("amount", "credit", 7)), ("credit_value_week", ("amount", "credit", 7)), ("outflow.amt.31d", ("amount", "debit", 31)), ("mean balance 31 days", ("balance", None, 31)), ("cash_withdrawal_amt_7d", ("amount", "debit", 7)), ("AVG_BAL_7DAYS", ("balance", None, 7)), ("TOT_TXNS_L7D", ("count", None, 7)), ("credit_amt_7_d", ("amount", "credit", 7))])
def test_names(name, want):
    facts = R.meaning(name)
    assert (facts.get("measure"), facts.get("direction"), facts.get("window")) == want


def test_name_lookup():
    for name in ("MNTH", "MONTH", "data_month", "extract_month"):
        assert "window" not in R.meaning(name)
    for name in ("customer_ref", "account_number", "acct_opened_on", "ref_key"):
        assert "measure" not in R.meaning(name)
    for name, channel in (("upi_inflow_value_week", "UPI"), ("atm_debit_amount_7d", "ATM"), ("NEFT_AMT_DB_L7D", "ELEC_XFER"), ("credit_value_week", None)):
        assert R.meaning(name).get("channel") == channel
    assert R.meaning("TOT_TXNAMT_CR_L7D") == {"measure": "amount", "direction": "credit", "stat": "TOT", "window": 7}
    assert R.meaning("amt_d_7_x").get("stat") is None and R.meaning("D_AMT").get("stat") == "DEV" and R.meaning("D7_AMT") == {"measure": "amount", "window": 7}
    names = ["InwardAmount7Day", "OutwardAmount7Day", "total value 7 days", "mean.balance.7d", "transaction count week", "cash_withdrawal_amt_7d", "upi_inflow_value_week", "total inward amount 31 days", "customer_ref", "MNTH"]
    table = R.Columns(names)
    for want, got in (("TOT_TXNAMT_CR_L7D", "InwardAmount7Day"), ("TOT_TXNAMT_DB_L7D", "OutwardAmount7Day"), ("AVG_BAL_7DAYS", "mean.balance.7d"), ("CASH_AMT_DB_L7D", "cash_withdrawal_amt_7d"), ("UPI_AMT_CR_L7D", "upi_inflow_value_week"), ("TOT_TXNAMT_CR_L31D", "total inward amount 31 days"), ("TOT_TXNAMT_L7D", "total value 7 days"), ("CHQ_AMT_DB_L7D", None)):
        assert table.find(R.meaning(want)) == got
    found = R.resolutions(["TOT_TXNAMT_CR_L7D", "mean balance 7d", "CHQ_AMT_DB_L7D"], names, protected=("InwardAmount7Day",))
    assert [found[w]["how"] for w in found] == ["absent", "normalised", "absent"]


def test_leak_names_and_dates(spark):
    names = ["FALSE_POSITIVE", "Investigated by", "CHARGEBACKS", "WriteOff_amt", "analyst_verdict", "LOAD_DATE", "RUN_DATE", "VINTAGE", "amount", "MONTHLY_BAL", "open_date"]
    got = {r.column: r for r in K.leak_names(spark.createDataFrame([(n,) for n in names], "column string")).collect()}
    assert all(got[n].post_outcome for n in names[:5]) and all(got[n].structural for n in names[5:8])
    assert not any(got[n].post_outcome or got[n].structural for n in names[8:]) and got["open_date"].raw_date
    df = spark.createDataFrame([("2020-01-01", 3, 1)], "open_date string, close_date int, y int")
    assert K.raw_dates(df, "y") == ["open_date"]
    codes = spark.createDataFrame([("F1", "FALSE_POSITIVE"), ("F2", "Data month"), ("F3", "balance"), ("MNTH", None)], "feature string, name string")
    assert {r.feature: r.kind for r in K.leak_codes(codes).collect()} == {"F1": "post_outcome", "F2": "structural", "MNTH": "structural"}


def test_skewed_ranks(spark):
    """Most rows share a score: ranks are as in one sorted list, and no range holds most rows."""
    from ledgerloom.functions.numeric import ranged

    rows = [(i, 0.5 if i % 10 else (i % 97) / 97) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, p double")
    want = {i: k + 1 for k, (i, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}
    assert {r.id: r["rank"] for r in X.ranked(df).collect()} == want
    text = df.select(F.concat(F.lit("A"), F.col("id").cast("string")).alias("id"), "p")
    want = {i: k + 1 for k, (i, _) in enumerate(sorted(((f"A{i}", p) for i, p in rows), key=lambda r: (-r[1], r[0])))}
    assert {r.id: r["rank"] for r in X.ranked(text).collect()} == want
    assert ranged(df, "p", "id").groupBy("_b", "_c").count().agg(F.max("count")).first()[0] < 300


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x;y\n1;2\n3;4\n")
    (tmp_path / "b.csv").write_text("x\n1\n")
    assert io.read_any(spark, str(tmp_path / "a.csv")).columns == ["x", "y"]
    with pytest.raises(ValueError):
        io.read_any(spark, str(tmp_path / "b.csv"))
    with pytest.raises(ValueError):
        io.read_any(spark, "sheet.xlsx")
    log = str(tmp_path / "log")
    io.append_decisions(spark.createDataFrame([(1, "CONFIRMED")], "id int, outcome string"), log)
    io.append_decisions(spark.createDataFrame([(2, "OPEN")], "id int, outcome string"), log)
    assert spark.read.parquet(log).count() == 2
    with pytest.raises(ValueError):
        io.append_decisions(spark.createDataFrame([(3, "MAYBE")], "id int, outcome string"), log)
    raw = spark.createDataFrame([("2023-01-01", "10:00:00", "A", "B", 5.0, 1, "fan"), ("2023-05-01", "10:00:00", "A", "B", 5.0, 0, "x"), ("bad", "x", "A", "B", 5.0, 0, "x")], "Date string, Time string, Sender_account string, Receiver_account string, Amount double, Is_laundering int, Laundering_type string")
    assert io.third_party_ledger(raw).count() == 2 and io.third_party_ledger(raw, 3).count() == 1


def test_dictionary_key_may_lie_beyond_any_prefix(spark):
    long = spark.range(0, 100_010, 1, 1).select(F.when(F.col("id") >= 100_000, F.concat(F.lit("f"), F.col("id") - 100_000)).otherwise("x").alias("code"), F.lit("n").alias("name"))
    short = spark.createDataFrame([("f1", "wrong")], "code string, name string")
    assert {r.name for r in io.read_dictionary([short, long], ["f1", "f2", "f3"]).filter("feature = 'f1'").collect()} == {"n"}


def test_isolation_forest_ranks_outliers(spark):
    rng = random.Random(7)
    df = spark.createDataFrame([(i, rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(300)] + [(999, 9.0, -9.0)], "id long, a double, b double")
    p = {r.id: r.p_iso for r in H.IsolationForest(60).fit(df, ["a", "b"], "id").transform(df, "id").collect()}
    assert max(p, key=p.get) == 999 and all(0 <= v <= 1 for v in p.values())


def test_isolation_forest_draws_from_and_ranges_over_all_rows(spark):
    rng = random.Random(9)
    rows = [(i, rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(6000)] + [(10_000 + i, 6.0 + 3 * i, -6.0 - 3 * i) for i in range(8)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    forest = H.IsolationForest(60).fit(df, ["a", "b"], "id")
    raw = forest.raw(np.array([r[1:] for r in rows]))
    assert abs(forest.lo - raw.min()) < 1e-12 and abs(forest.hi - raw.max()) < 1e-12
    p = {r.id: r.p_iso for r in forest.transform(df, "id").collect()}
    assert len({v for v in p.values() if v == 1.0}) == 1 and sum(v == 1.0 for v in p.values()) == sum(raw == raw.max())
    drawn = forest._trees(H.impute(df, forest.fill), "id", 1.0).collect()
    assert [r.n for r in drawn] == [len(rows)] * 60 and len(forest.forest) == 60


def test_registered_learners_use_the_reference_tree_counts(spark, monkeypatch):
    class Seen(Exception):
        pass

    def fit(kind, df, names, target, trees):
        raise Seen(trees)

    monkeypatch.setattr(H, "_fit", fit)
    df = spark.createDataFrame([(i, i % 2, float(i)) for i in range(12)], "id long, y int, a double")
    for run, want in ((H.out_of_fold, 400), (H.gbt_scores, 400), (H.missingness_audit, 200), (H.degradation, 400)):
        with pytest.raises(Seen, match=f"^{want}$"):
            run(df, ["a"], "id")
    with pytest.raises(Seen, match="^150$"):
        H.feature_gain(df, ["a"])
    assert H.IsolationForest().trees == 300


def test_attributions_are_out_of_fold(spark):
    rng = random.Random(8)
    df = spark.createDataFrame([(i, int(x > 0.7), x, rng.random()) for i, x in enumerate(rng.random() for _ in range(200))], "id long, y int, a double, b double")
    a = H.attributions(df, ["a", "b"], "id")
    assert a.count() == 400
    # values are linear in the distance from the mean of the other folds' rows, with one slope a fold
    fold = {r.id: r.fold for r in X.folds(df, 3).collect()}
    x, v = {r.id: r.a for r in df.collect()}, {r.id: r.value for r in a.filter("feature = 'a'").collect()}
    for i in range(3):
        mean = np.mean([x[k] for k in x if fold[k] != i])
        slopes = [v[k] / (x[k] - mean) for k in x if fold[k] == i and abs(x[k] - mean) > 1e-3]
        assert max(slopes) - min(slopes) < 1e-6 and slopes[0] > 0


def test_live_policy_equals_batch(spark, tmp_path):
    rng = random.Random(4)
    pick = lambda *xs: rng.choice(xs)
    rows = [(s, b, pick(0.1, 0.3, 0.7, None), pick(0.05, 0.2), pick(0.5, 0.95, None), pick(10, 40)) for s in "abc" for b in range(30)]
    kind = "source string, batch long, weighted_psi double, score_psi double, precision double, reviewed long"
    for part in range(3):
        spark.createDataFrame([r for r in rows if r[1] // 10 == part], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = policy.live_policy(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), 0.9)
        q.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)
    got = {(r.source, r.batch): (r.action, r.signoff) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    for s in "abc":
        batch = spark.createDataFrame([r[1:] for r in rows if r[0] == s], kind.split(", ", 1)[1])
        assert {(s, r.batch): (r.action, r.signoff) for r in N.policy(batch, 0.9).collect()}.items() <= got.items()
    assert len(got) == 90


def test_streaming_fans_equal_batch(spark, tmp_path):
    rows = [(f"h{i % 2}", f"l{i}", 10.0, f"2023-01-{1 + i % 20:02d} 10:00:00") for i in range(60)]
    df = spark.createDataFrame(rows, "src string, dst string, amount double, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    late = spark.createDataFrame([("z", "z", 1.0, "2024-01-01 00:00:00")], "src string, dst string, amount double, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    q = fans.start(fans.fan_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    late.write.mode("append").parquet(str(tmp_path / "in"))
    q = fans.start(fans.fan_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    key = lambda d: sorted((r.account, str(r.start), r.legs, r.n) for r in d.collect())
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(fans.fan_counts(df))
