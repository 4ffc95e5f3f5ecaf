"""Drift, label noise, fairness, rules and decisions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.numeric import div0, finite, quantiles, ranged

#: Fixed values of the monitoring policy.
PSI_MATERIAL, PSI_SEVERE, KS_ALARM, SCORE_PSI, PRECISION_TOL, BREACHES, MIN_REVIEWED = 0.25, 0.50, 0.15, 0.10, 0.10, 2, 30
KS_RANGES = 256


def _finite(df: DataFrame, features: list[str], period: str) -> DataFrame:
    ok = df.select(*[finite(F.col(c)).alias(c) for c in features])
    return ok.unpivot([], features, "feature", "x").filter("x is not null").withColumn("period", F.lit(period))


def psi(reference: DataFrame, current: DataFrame, features: list[str], bins: int = 10) -> DataFrame:
    """feature, psi: all features in one pass; bins at the reference's quantiles (unique ones), half a count added to each.

    Fewer than 3 different quantiles, or an empty side, give 0.
    """
    r, c = _finite(reference, features, "r"), _finite(current, features, "c")
    q = quantiles(reference, features, [i / bins for i in range(bins + 1)])
    q = q.groupBy(F.col("column").alias("feature")).agg(F.array_sort(F.collect_set("value")).alias("q"))
    inner = F.slice("q", 2, F.greatest(F.size("q") - 2, F.lit(0)))
    at = F.size(F.filter(inner, lambda e: e <= F.col("x")))
    counts = r.unionByName(c).join(F.broadcast(q.filter("size(q) >= 3")), "feature").groupBy("feature", at.alias("bin"), F.size("q").alias("k")).agg(*[F.count(F.when(F.col("period") == p, 1)).alias(p) for p in ("r", "c")])
    total = counts.groupBy("feature").agg(F.sum("r").alias("nr"), F.sum("c").alias("nc"), F.max("k").alias("k"))
    grid = total.select("*", F.explode(F.sequence(F.lit(0), F.col("k") - 2)).alias("bin")).join(counts.select("feature", "bin", "r", "c"), ["feature", "bin"], "left").fillna(0, ["r", "c"])
    share = lambda n, t: (F.col(n) + 0.5) / (F.col(t) + 0.5 * (F.col("k") - 1))
    a, b = share("r", "nr"), share("c", "nc")
    out = grid.filter("nr > 0 and nc > 0").groupBy("feature").agg(F.sum((b - a) * F.ln(b / a)).alias("psi"))
    names = reference.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    return names.join(out, "feature", "left").select("feature", F.coalesce("psi", F.lit(0.0)).alias("psi"))


def ks(reference: DataFrame, current: DataFrame, features: list[str]) -> DataFrame:
    """feature, ks: the largest distance of the two distribution functions; 0 with fewer than 2 values on a side."""
    x = _finite(reference, features, "r").unionByName(_finite(current, features, "c"))
    # ranges of each feature's values, cut at approximate quantiles: no task sorts all values of a feature
    cuts = x.groupBy("feature").agg(F.percentile_approx("x", F.array(*[F.lit(i / KS_RANGES) for i in range(1, KS_RANGES)]), 5_000).alias("q"))
    d = x.groupBy("feature", "x").agg(*[F.count(F.when(F.col("period") == p, 1)).alias(p) for p in ("r", "c")]).join(F.broadcast(cuts), "feature")
    d = d.select("feature", "x", "r", "c", F.size(F.filter("q", lambda e: e < F.col("x"))).alias("range"))
    before, every = Window.partitionBy("feature").orderBy("range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("feature")
    by = d.groupBy("feature", "range").agg(F.sum("r").alias("nr"), F.sum("c").alias("nc"))
    by = by.select("feature", "range", *[F.coalesce(F.sum(f"n{p}").over(before), F.lit(0)).alias(f"before_{p}") for p in "rc"], *[F.sum(f"n{p}").over(every).alias(f"all_{p}") for p in "rc"])
    up = Window.partitionBy("feature", "range").orderBy("x")
    share = lambda p: (F.col(f"before_{p}") + F.sum(p).over(up)) / F.nullif(F.col(f"all_{p}"), F.lit(0))
    d = d.join(by, ["feature", "range"])
    gap, enough = F.abs(share("r") - share("c")), (F.col("all_r") >= 2) & (F.col("all_c") >= 2)
    out = d.select("feature", F.when(enough, gap).alias("gap")).groupBy("feature").agg(F.max("gap").alias("ks"))
    names = reference.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    return names.join(out, "feature", "left").select("feature", F.coalesce("ks", F.lit(0.0)).alias("ks"))


def feature_drift(reference: DataFrame, current: DataFrame, importance: dict[str, float]) -> DataFrame:
    """feature, psi, ks (4 places), importance, drifted."""
    names = list(importance)
    w = reference.sparkSession.createDataFrame(list(importance.items()), "feature string, importance double")
    d = psi(reference, current, names).join(ks(reference, current, names), "feature").join(w, "feature")
    d = d.select("feature", F.round("psi", 4).alias("psi"), F.round("ks", 4).alias("ks"), "importance")
    return d.withColumn("drifted", (F.col("psi") >= PSI_MATERIAL) | (F.col("ks") >= KS_ALARM))


def drift_summary(drift: DataFrame) -> DataFrame:
    """weighted_psi: by importance, or the mean where nothing has any."""
    w = F.sum("importance")
    return drift.agg(F.round(F.when(w > 0, F.sum(F.col("psi") * F.col("importance")) / F.nullif(w, F.lit(0.0))).otherwise(F.avg("psi")), 4).alias("weighted_psi"), F.round(F.max("psi"), 4).alias("max_psi"), F.count(F.when(F.col("drifted"), 1)).alias("n_drifted"), F.count("*").alias("n_features"))


def realised_precision(decisions: DataFrame) -> DataFrame:
    closed = decisions.filter(F.col("outcome").isin("CONFIRMED", "DISMISSED"))
    a = closed.agg(F.count("*").alias("reviewed"), F.count(F.when(F.col("outcome") == "CONFIRMED", 1)).alias("confirmed"))
    return a.select("reviewed", "confirmed", F.round(F.col("confirmed") / F.nullif("reviewed", F.lit(0)), 4).alias("precision"), (F.col("reviewed") >= MIN_REVIEWED).alias("sufficient"))


def policy(batches: DataFrame, target: float) -> DataFrame:
    """batches: batch, weighted_psi, score_psi, precision, reviewed -> batch, action, signoff.

    A condition acts once it holds in BREACHES batches in a row (runs found as gaps and islands over the ordered
    batches, one row each); of several the most severe decides.
    """
    order = Window.orderBy("batch")
    raw = {
        "severe": F.col("weighted_psi") >= PSI_SEVERE, "material": F.col("weighted_psi") >= PSI_MATERIAL, "shift": F.col("score_psi") >= SCORE_PSI,
        "fell": (F.col("reviewed") >= MIN_REVIEWED) & F.col("precision").isNotNull() & (F.col("precision") < target * (1 - PRECISION_TOL)),
    }
    b = batches
    for n, c in raw.items():
        b = b.withColumn(n, F.coalesce(c, F.lit(False))).withColumn(f"_{n}", F.sum((~F.col(n)).cast("int")).over(order))
    for n in raw:
        run = F.sum(F.col(n).cast("int")).over(Window.partitionBy(f"_{n}").orderBy("batch"))
        b = b.withColumn(f"streak_{n}", F.when(F.col(n), run).otherwise(F.lit(0)))
    on = lambda n: F.col(f"streak_{n}") >= BREACHES
    action = F.when(on("severe"), "HALT_AUTOMATION").when(on("fell"), "REFIT_THRESHOLDS").when(on("material"), "RETRAIN").when(on("shift"), "RECALIBRATE").otherwise("MONITOR")
    return b.select("batch", action.alias("action"), on("severe").alias("signoff"), *[F.col(f"streak_{n}").cast("long").alias(f"streak_{n}") for n in raw])


def extract_drift(rows: DataFrame, extract: str, columns: list[str], least: tuple[int, int] = (30, 10), alpha: float = 0.01) -> DataFrame:
    """column, ks, p_value, shifted: each column's values in the most frequent extract against those in all others.

    Columns with fewer values than `least` on a side are not tested. The p-value is the asymptotic one of Kolmogorov's distribution.
    """
    sizes = rows.filter(F.col(extract).isNotNull()).groupBy(F.col(extract).cast("string").alias("_e")).agg(F.count("*").alias("_n"))
    main = sizes.agg(F.max(F.struct("_n", "_e")).alias("m")).first().m
    if main is None:
        return rows.sparkSession.createDataFrame([], "column string, ks double, p_value double, shifted boolean")
    same = F.coalesce(F.col(extract).cast("string") == main["_e"], F.lit(False))
    a, b = rows.filter(same), rows.filter(~same)
    counts = _finite(a, columns, "r").unionByName(_finite(b, columns, "c")).groupBy("feature").agg(*[F.count(F.when(F.col("period") == p, 1)).alias(p) for p in ("r", "c")])
    d = ks(a, b, columns).join(counts.filter((F.col("r") >= least[0]) & (F.col("c") >= least[1])), "feature")
    x = F.col("ks") * F.sqrt(F.col("r") * F.col("c") / (F.col("r") + F.col("c")))
    terms = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * x * x))
    p_value = F.when(x < 0.2, F.lit(1.0)).otherwise(F.least(F.greatest(2.0 * terms, F.lit(0.0)), F.lit(1.0)))
    d = d.withColumn("_p", p_value)
    return d.select(F.col("feature").alias("column"), F.round("ks", 4).alias("ks"), F.round("_p", 6).alias("p_value"), (F.col("_p") < alpha).alias("shifted"))


def extract_drift_summary(drift: DataFrame) -> DataFrame:
    """columns_tested, columns_shifted, share_shifted."""
    n = F.count(F.when(F.col("shifted"), 1))
    return drift.agg(F.count("*").alias("columns_tested"), n.alias("columns_shifted"), F.round(n / F.greatest(F.count("*"), F.lit(1)), 4).alias("share_shifted"))


#: Fixed edges of the words for a weighted PSI.
PSI_WORDS = ((PSI_SEVERE, "severe"), (PSI_MATERIAL, "significant"), (0.10, "moderate"), (0.0, "stable"))


def monitor_batch(reference: DataFrame, current: DataFrame, importance: dict[str, float], history: DataFrame | None = None, decisions: DataFrame | None = None, target: float = 0.9, score: str = "p") -> dict:
    """What a batch measures against the training population, and what the policy says to do.

    Compared are the features of `importance` that both tables have, and the scores where both have them; a feature that the
    batch lacks is listed, never imputed. With nothing to compare the action is CANNOT_ASSESS, which is no clean result. history: the
    measurements of earlier batches (batch, weighted_psi, score_psi, precision, reviewed), so that a condition must hold twice in a row.
    Returns signal, band, missing, drift (DataFrame), action, signoff, and state: history with this batch, to be written.
    """
    spark = reference.sparkSession
    both = [f for f in importance if f in reference.columns and f in current.columns]
    missing = [f for f in importance if f not in current.columns]
    scores = score in reference.columns and score in current.columns and current.filter(F.col(score).isNotNull()).limit(2).count() == 2
    drift = feature_drift(reference, current, {f: importance[f] for f in both}) if both else None
    weighted = float(drift_summary(drift).first().weighted_psi or 0.0) if both else None
    moved = float(psi(reference, current, [score]).first().psi) if scores else None
    seen = realised_precision(decisions).first() if decisions is not None else None
    now = (weighted, moved, float(seen.precision) if seen and seen.precision is not None else None, int(seen.reviewed) if seen else 0)
    kind = "batch long, weighted_psi double, score_psi double, precision double, reviewed long"
    last = history.agg(F.max("batch")).first()[0] if history is not None else None
    number = 0 if last is None else last + 1
    state = spark.createDataFrame([(number, *now)], kind)
    if history is not None:
        state = history.select("batch", "weighted_psi", "score_psi", "precision", "reviewed").unionByName(state)
    if not both and not scores:
        return {"action": "CANNOT_ASSESS", "signoff": True, "signal": None, "band": None, "missing": missing, "drift": None, "state": state}
    got = policy(state, target).filter(F.col("batch") == number).first()
    band = next(w for at, w in PSI_WORDS if (weighted or 0.0) >= at)
    return {"action": got.action, "signoff": got.signoff, "signal": {"weighted_psi": weighted, "score_psi": moved, "precision": now[2], "reviewed": now[3]}, "band": band, "missing": missing, "drift": drift, "state": state}


# ------------------------------------------------------------------ label noise
def noise_thresholds(scored: DataFrame) -> DataFrame:
    """t1, t0: mean p of the positives, mean 1 - p of the negatives (1 without any)."""
    return scored.agg(F.coalesce(F.avg(F.when(F.col("y") == 1, F.col("p"))), F.lit(1.0)).alias("t1"), F.coalesce(F.avg(F.when(F.col("y") == 0, 1 - F.col("p"))), F.lit(1.0)).alias("t0"))


def outranked(scored: DataFrame) -> DataFrame:
    """scored with over_pos, over_neg: the shares of positives and negatives with a strictly smaller p."""
    from ledgerloom.operators.metrics import curve

    c = curve(scored)
    below_pos = F.col("all_pos") - F.col("cum_pos")
    below_neg = (F.col("all_n") - F.col("all_pos")) - (F.col("cum_n") - F.col("cum_pos"))
    c = c.select("p", (below_pos / F.greatest("all_pos", F.lit(1))).alias("over_pos"), (below_neg / F.greatest(F.col("all_n") - F.col("all_pos"), F.lit(1))).alias("over_neg"))
    return scored.join(c, "p")


def noise_suspects(scored: DataFrame) -> DataFrame:
    s = outranked(scored).crossJoin(F.broadcast(noise_thresholds(scored)))
    high, low = (F.col("y") == 0) & (F.col("p") >= F.col("t1")), (F.col("y") == 1) & (1 - F.col("p") >= F.col("t0"))
    s = s.filter(high | low)
    return s.select("id", "y", "p", F.when(F.col("y") == 0, "LABELLED_LEGITIMATE_SCORED_HIGH").otherwise("LABELLED_MULE_SCORED_LOW").alias("direction"), F.round(F.when(F.col("y") == 0, F.col("p") - F.col("t1")).otherwise(1 - F.col("p") - F.col("t0")), 6).alias("margin"), F.round(F.when(F.col("y") == 0, F.col("over_pos")).otherwise(F.col("over_neg")), 6).alias("outranks"))


def noise_rank(scored: DataFrame, alarm: float = 0.95) -> DataFrame:
    s = outranked(scored)
    s = s.filter(((F.col("y") == 0) & (F.col("over_pos") >= alarm)) | ((F.col("y") == 1) & (F.round("over_neg", 12) <= F.lit(round(1 - alarm, 12)))))
    return s.select("id", "y", "p", F.round(F.when(F.col("y") == 0, F.col("over_pos")).otherwise(F.col("over_neg")), 6).alias("outranks"))


def noise_estimate(scored: DataFrame) -> DataFrame:
    s = scored.crossJoin(F.broadcast(noise_thresholds(scored)))
    pos, neg = F.col("y") == 1, F.col("y") == 0
    g = s.agg(F.round(F.max("t1"), 6).alias("self_confidence_mule"), F.round(F.max("t0"), 6).alias("self_confidence_legitimate"), F.count(F.when(neg, 1)).alias("legitimate"), F.count(F.when(neg & (F.col("p") >= F.col("t1")), 1)).alias("legitimate_flagged"), F.count(F.when(pos, 1)).alias("mules"), F.count(F.when(pos & (1 - F.col("p") >= F.col("t0")), 1)).alias("mules_flagged"))
    return g.withColumn("legitimate_flagged_pct", F.round(100 * F.col("legitimate_flagged") / F.greatest("legitimate", F.lit(1)), 4)).withColumn("mules_flagged_pct", F.round(100 * F.col("mules_flagged") / F.greatest("mules", F.lit(1)), 2))


# ------------------------------------------------------------------ fairness
def fair_bands(rows: DataFrame, column: str, labels: tuple[str, ...] = ("Q1", "Q2", "Q3", "Q4")) -> DataFrame:
    """id, band: quartiles in rank order (ties by id); a value held by 15 % or more gets the first band of its own.

    Ranks come from ranges that hold about equally many rows, so no single task sorts all rows.
    """
    v = rows.select("id", F.col(column).cast("double").alias("v")).filter("v is not null")
    by = v.groupBy("v").agg(F.count("*").alias("n"))
    top = by.agg(F.max(F.struct(F.col("n"), (-F.col("v")).alias("m"))).alias("t"), F.sum("n").alias("all")).select((-F.col("t.m")).alias("mode"), (F.col("t.n") / F.col("all") >= 0.15).alias("dominant"))
    v = v.crossJoin(F.broadcast(top)).withColumn("own", F.col("dominant") & (F.col("v") == F.col("mode")))
    rest = v.filter(~F.col("own"))
    r = ranged(rest.crossJoin(F.broadcast(rest.agg(F.count("*").alias("m")))), "v", "id")
    n = r.groupBy("_b", "_c").agg(F.count("*").alias("_n"))
    n = n.select("_b", "_c", F.coalesce(F.sum("_n").over(Window.orderBy("_b", "_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    r = r.join(n, ["_b", "_c"]).withColumn("rank", F.col("_before") + F.row_number().over(Window.partitionBy("_b", "_c").orderBy("v", "id")))
    k = F.when(F.col("dominant"), F.lit(len(labels) - 1)).otherwise(F.lit(len(labels)))
    # the i-th quantile edge of ranks 1..m is 1 + (m - 1) * i / k; a rank on an edge belongs below it
    cut = F.greatest(F.ceil((F.col("rank") - 1) * k / F.nullif(F.col("m") - 1, F.lit(0)).cast("double")) - 1, F.lit(0)).cast("int")
    name = F.get(F.array(*[F.lit(x) for x in labels]), F.coalesce(cut, F.lit(0)) + F.when(F.col("dominant"), 1).otherwise(0))
    return r.select("id", name.alias("band")).unionByName(v.filter("own").select("id", F.lit(labels[0]).alias("band")))


def fair_slices(rows: DataFrame, group: str, flagged: Column) -> DataFrame:
    """Per group: accounts, true_mules, base_rate, flagged, selection_rate, precision, burden_ratio, flagged_for_review."""
    g = rows.groupBy(F.col(group).cast("string").alias("grp")).agg(F.count("*").alias("accounts"), F.sum("y").cast("long").alias("true_mules"), F.count(F.when(flagged, 1)).alias("flagged"), F.count(F.when(flagged & (F.col("y") == 1), 1)).alias("hits"))
    rate = F.round(F.col("flagged") / F.greatest("accounts", F.lit(1)), 4)
    g = g.withColumn("base_rate", F.round(F.col("true_mules") / F.col("accounts"), 5)).withColumn("selection_rate", rate).withColumn("precision", F.round(F.col("hits") / F.nullif("flagged", F.lit(0)), 4))
    floor = F.min(F.when(F.col("accounts") >= 20, F.col("selection_rate"))).over(Window.partitionBy())
    g = g.withColumn("burden_ratio", F.when((F.col("accounts") >= 20) & (floor > 0), F.round(F.col("selection_rate") / F.nullif(floor, F.lit(0.0)), 3)))
    return g.withColumn("flagged_for_review", F.coalesce(F.col("burden_ratio") > 1.25, F.lit(False))).drop("hits")


def proxy_signature(slices: DataFrame) -> DataFrame:
    """One row of a slice report: the rates of the least and most burdened groups of 20 or more, and whether the most burdened one,
    over the cap, is also flagged less accurately than groups are on average: the mark of a model that learned a proxy."""
    sized = slices.filter("accounts >= 20")
    s = sized.agg(F.min("selection_rate").alias("least_burdened_rate"), F.max("selection_rate").alias("most_burdened_rate"), F.avg("precision").alias("mean"), F.max(F.struct("selection_rate", F.struct("grp", "precision", "burden_ratio").alias("g"))).alias("m"))
    over = slices.agg(F.coalesce(F.max(F.col("flagged_for_review")), F.lit(False)).alias("any_group_over_cap"))
    heavy = F.col("m.g")
    mark = F.coalesce((heavy["burden_ratio"] > 1.25) & (heavy["precision"] < F.col("mean")), F.lit(False))
    spread = F.when(F.col("least_burdened_rate") > 0, F.round(F.col("most_burdened_rate") / F.nullif("least_burdened_rate", F.lit(0.0)), 2))
    return s.crossJoin(F.broadcast(over)).select(F.round("least_burdened_rate", 4).alias("least_burdened_rate"), F.round("most_burdened_rate", 4).alias("most_burdened_rate"), spread.alias("selection_rate_spread"), heavy["grp"].alias("most_burdened_group"), "any_group_over_cap", F.round("mean", 4).alias("mean_precision"), mark.alias("proxy_signature_present"))


# ------------------------------------------------------------------ rules
#: Rules as conditions on matrix features. A rule whose inputs are absent is not evaluated; unevaluated() names it.
RULES: dict[str, tuple[tuple[str, ...], str]] = {
    "R01": (("mg_passthrough_7d",), "mg_passthrough_7d >= 0.90"),
    "R02": (("mg_turnover_over_balance_7d",), "mg_turnover_over_balance_7d >= 50"),
    "R03": (("mg_amount_burst_7v31",), "mg_amount_burst_7v31 >= 3.0"),
    "R04": (("mg_cash_out_share_7d",), "mg_cash_out_share_7d >= 0.50"),
    "R05": (("mg_channel_active_7d",), "mg_channel_active_7d <= 1"),
    "R06": (("mg_avg_ticket_7d",), "mg_avg_ticket_7d > 0 and mg_avg_ticket_7d <= 5000"),
    "R07": (("mg_alert_share_night",), "mg_alert_share_night >= 0.50"),
    "R08": (("mg_balance_volatility_7d",), "mg_balance_volatility_7d >= 2.0"),
    "R09": (("mg_occ_deviation_max",), "mg_occ_deviation_max >= 50"),
    "R10": (("ACCT_OPN_DAYS", "mg_turnover_over_balance_7d"), "ACCT_OPN_DAYS <= 90 and mg_turnover_over_balance_7d >= 10"),
    "R11": (("mg_net_flow_7d", "mg_turnover_over_balance_7d"), "abs(mg_net_flow_7d) <= 0.05 and mg_turnover_over_balance_7d >= 5"),
    "R12": (("mg_passthrough_7d", "mg_channel_active_7d"), "mg_passthrough_7d >= 0.85 and mg_channel_active_7d <= 1"),
}


def evaluated(df: DataFrame) -> list[str]:
    return [r for r, (needs, _) in RULES.items() if all(n in df.columns for n in needs)]


def unevaluated(df: DataFrame) -> list[dict]:
    """rule, missing: the rules that the table lacks inputs for."""
    return [{"rule": r, "missing": [n for n in needs if n not in df.columns]} for r, (needs, _) in RULES.items() if r not in evaluated(df)]


def rule_hits(features: DataFrame) -> DataFrame:
    """features with rules_fired ("R01|R06") and n_rules_fired; a null comparison has not fired."""
    fired = F.filter(F.array(*[F.when(F.coalesce(F.expr(RULES[r][1]), F.lit(False)), r) for r in evaluated(features)]), lambda x: x.isNotNull())
    return features.withColumn("_f", fired).withColumn("rules_fired", F.concat_ws("|", "_f")).withColumn("n_rules_fired", F.size("_f")).drop("_f")


def _quality(g: DataFrame, every: DataFrame) -> DataFrame:
    x = g.crossJoin(F.broadcast(every))
    precision = div0(F.col("caught"), F.col("flagged"))
    return x.select("rule", "flagged", "caught", F.round(precision, 4).alias("precision"), F.round(div0(F.col("caught"), F.col("pos")), 4).alias("recall"), F.round(div0(precision, F.col("pos") / F.col("n")), 2).alias("lift"), F.round(F.col("flagged") / F.nullif("caught", F.lit(0)), 2).alias("alerts_per_mule"))


def _totals(hits: DataFrame) -> DataFrame:
    return hits.agg(F.count("*").alias("n"), F.sum("y").cast("long").alias("pos"))


def rule_metrics(hits: DataFrame) -> DataFrame:
    """Per evaluated rule that fired: flagged, caught, precision, recall, lift, alerts_per_mule. hits needs y."""
    each = hits.filter("n_rules_fired > 0").select("y", F.explode(F.split("rules_fired", r"\|")).alias("rule"))
    return _quality(each.groupBy("rule").agg(F.count("*").alias("flagged"), F.sum("y").cast("long").alias("caught")), _totals(hits))


def rule_combined(hits: DataFrame) -> DataFrame:
    """The same for any, at least 2 and at least 3 rules."""
    names = F.filter(F.array(*[F.when(F.col("n_rules_fired") >= k, n) for n, k in (("any", 1), ("two_plus", 2), ("three_plus", 3))]), lambda x: x.isNotNull())
    each = hits.select("y", F.explode(names).alias("rule"))
    return _quality(each.groupBy("rule").agg(F.count("*").alias("flagged"), F.sum("y").cast("long").alias("caught")), _totals(hits))


def agreement(decisions: DataFrame) -> DataFrame:
    """decisions: decision, ground_truth -> total, resolved, agreed, agreement_rate."""
    agreed = ((F.col("decision") == "CONFIRMED_MULE") & (F.col("ground_truth") == 1)) | ((F.col("decision") == "DISMISSED") & (F.col("ground_truth") == 0))
    a = decisions.agg(F.count("*").alias("total"), F.count(F.when(F.col("decision") != "NEEDS_REVIEW", 1)).alias("resolved"), F.count(F.when(agreed, 1)).alias("agreed"))
    return a.withColumn("agreement_rate", F.round(F.col("agreed") / F.nullif("resolved", F.lit(0)), 4))
