"""Queries on scored rows: ranking metrics, monitoring, label noise, fairness, decisions."""

from pyspark.sql import functions as F

from ledgerloom.operators import metrics as X
from ledgerloom.operators import monitor as N
from ledgerloom.plans.registry import query
from ledgerloom.sources.views import DECISIONS, SCORED, decisions, scored

S = f"WITH {SCORED}, "
RK, CV = S + X.RANKED_SQL, S + X.CURVE_SQL


@query(S + """c AS (SELECT count(*) FILTER (p >= 0.5 AND y = 1) AS tp, count(*) FILTER (p >= 0.5 AND y = 0) AS fp, count(*) FILTER (p < 0.5 AND y = 1) AS fn, count(*) FILTER (p < 0.5 AND y = 0) AS tn FROM scored)
 SELECT tp, fp, fn, tn, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall, round(2 * tp / (2 * tp + fp + fn), 4) AS f1, round(fp / (fp + tn), 4) AS fpr, round((tp / (tp + fp)) / ((tp + fn) / (tp + fp + fn + tn)), 2) AS lift FROM c""")
def metric_confusion(spark, d):
    return X.confusion(scored(spark, d), 0.5)


@query(CV + " SELECT round(sum(pos * ((all_n - all_pos) - (cum_n - cum_pos) + (n - pos) / 2.0)) / max(all_pos * (all_n - all_pos)), 8) AS auroc FROM curve")
def metric_auroc(spark, d):
    return X.auroc(scored(spark, d)).select(F.round("auroc", 8).alias("auroc"))


@query(CV + " SELECT round(sum(pos / all_pos * (cum_pos / cum_n)), 8) AS auprc FROM curve")
def metric_average_precision(spark, d):
    return X.average_precision(scored(spark, d)).select(F.round("auprc", 8).alias("auprc"))


@query(CV + ", t AS (SELECT p, cum_pos, cum_pos / cum_n AS prec FROM curve WHERE cum_pos >= 5) SELECT p AS threshold, true AS reached FROM t WHERE prec >= 0.205 ORDER BY cum_pos DESC, p LIMIT 1")
def metric_pick_threshold(spark, d):
    return X.pick_threshold(scored(spark, d), 0.205)


@query(CV + ", t AS (SELECT p, round(2 * (cum_pos / cum_n) * (cum_pos / all_pos) / (cum_pos / cum_n + cum_pos / all_pos + 1e-12), 12) AS f FROM curve) SELECT p AS threshold, false AS reached FROM t ORDER BY f DESC, p LIMIT 1")
def metric_pick_threshold_fallback(spark, d):
    return X.pick_threshold(scored(spark, d), 0.999)


@query(S + "f AS (SELECT id, y, (row_number() OVER (PARTITION BY y ORDER BY md5(CAST(id AS VARCHAR) || ':42'), id) - 1) % 5 AS fold FROM scored) SELECT id, y, CAST(fold AS INTEGER) AS fold FROM f")
def metric_stratified_folds(spark, d):
    return X.folds(scored(spark, d).select("id", "y"))


def _budget_sql(shares, k):
    rows = ", ".join(f"({s})" for s in shares)
    return RK + f""", b AS (SELECT CAST(share AS DOUBLE) AS share, CAST(greatest(1, {k}) AS BIGINT) AS k FROM (VALUES {rows}) v(share))
 SELECT share, k, sum(y)::BIGINT AS hits, round(sum(y) / (SELECT sum(y) FROM scored), 4) AS recall, round(sum(y) / k, 4) AS precision FROM b JOIN ranked ON rank <= k GROUP BY share, k"""


REVIEW, TABLE = (0.005, 0.01, 0.02, 0.05, 0.1), (0.0025, 0.005, 0.01, 0.02, 0.05)


@query(_budget_sql(REVIEW, "ceil((SELECT count(*) FROM scored) * CAST(share AS DOUBLE))"))
def metric_review_budget(spark, d):
    return X.budgets(scored(spark, d), REVIEW, up=True)


@query(_budget_sql(TABLE, "round_even((SELECT count(*) FROM scored) * CAST(share AS DOUBLE), 0)"))
def metric_budget_table(spark, d):
    return X.budgets(scored(spark, d), TABLE, up=False)


def _k_sql(ks):
    rows = ", ".join(f"({k})" for k in ks)
    return RK + f""", b AS (SELECT CAST(k AS BIGINT) AS k FROM (VALUES {rows}) v(k)), t AS (SELECT count(*) AS n, sum(y) AS pos FROM scored)
 SELECT k, sum(y)::BIGINT AS hits, round(sum(y) / least(k, max(n)), 4) AS precision, round(sum(y) / max(pos), 4) AS recall, round((sum(y) / least(k, max(n))) / (max(pos) / max(n)), 2) AS lift, round(k / 40, 1) AS analyst_days FROM b JOIN ranked ON rank <= k CROSS JOIN t GROUP BY k"""


AT, DAILY, LIFT = (10, 25, 50, 100, 200, 500), (40, 80, 200), (50, 100, 200, 500, 1000, 2000, 5000)


@query(_k_sql(AT))
def metric_precision_at_k(spark, d):
    return X.at_k(scored(spark, d), AT)


@query(_k_sql(DAILY))
def metric_daily_budget(spark, d):
    return X.at_k(scored(spark, d), DAILY)


@query(_k_sql(LIFT))
def metric_lift_curve(spark, d):
    return X.at_k(scored(spark, d), LIFT)


@query(S + "b AS (SELECT y, p, CASE WHEN p >= 0.9 THEN 8 WHEN p >= 0.7 THEN 7 WHEN p >= 0.5 THEN 6 WHEN p >= 0.3 THEN 5 WHEN p >= 0.1 THEN 4 WHEN p >= 0.05 THEN 3 WHEN p >= 0.01 THEN 2 WHEN p >= 0.001 THEN 1 ELSE 0 END AS bin FROM scored) SELECT bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS observed FROM b GROUP BY bin")
def metric_calibration_bins(spark, d):
    return X.calibration(scored(spark, d))


BAND_SQL = S + "bands AS (SELECT id, y, risk_score, CASE WHEN risk_score < 400 THEN 'LOW' WHEN risk_score < 750 THEN 'MEDIUM' ELSE 'HIGH' END AS band FROM (SELECT *, CAST(round(least(greatest(p, 0), 1) * 1000) AS INTEGER) AS risk_score FROM scored))"


def _bands(spark, d):
    return X.banded(scored(spark, d), 400, 750)


@query(BAND_SQL + " SELECT id, risk_score, band FROM bands")
def metric_bands(spark, d):
    return _bands(spark, d).select("id", "risk_score", "band")


@query(BAND_SQL + " SELECT band, count(*) AS accounts, sum(y)::BIGINT AS mules, count(*) - sum(y)::BIGINT AS false_positives, round(1000 * (count(*) - sum(y)) / (SELECT count(*) FROM scored), 2) AS false_positives_per_1000, round(sum(y) / count(*), 4) AS precision, round(count(*) / 40, 1) AS analyst_days FROM bands GROUP BY band")
def metric_band_load(spark, d):
    return X.band_load(_bands(spark, d))


@query(S + "q AS (SELECT quantile_cont(p, 0.5) AS med, quantile_cont(p, 0.9) AS p90, quantile_cont(p, 0.99) AS p99 FROM scored) SELECT id, CASE WHEN p >= p99 THEN 'top 1% of all accounts' WHEN p >= p90 THEN 'top 10% of all accounts' WHEN p > med THEN 'above the population median' ELSE 'at or below the population median' END AS standing FROM scored, q")
def metric_evidence_standing(spark, d):
    return X.standing(scored(spark, d), "p").select("id", "standing")


@query(RK + " SELECT id, rank FROM ranked WHERE y = 1")
def metric_positive_ranks(spark, d):
    return X.ranked(scored(spark, d)).filter("y = 1").select("id", "rank")


# ------------------------------------------------------------------ drift
FEATS = ("p", "segment", "hour")
DRIFT_SQL = S + "rows_ AS (SELECT id, p, CAST(segment AS DOUBLE) AS segment, CAST(hour(ts) AS DOUBLE) AS hour FROM scored), half AS (SELECT max(id) / 2 AS h FROM scored), "
DRIFT_SQL += "x AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, {'CASE WHEN id > h THEN round(p * p, 6) ELSE p END' if f == 'p' else f} AS x, id <= h AS ref FROM rows_, half" for f in FEATS) + "),"
DRIFT_SQL += """
q AS (SELECT feature, list_sort(list_distinct(quantile_cont(x, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) AS q FROM x WHERE ref GROUP BY feature),
binned AS (SELECT x.feature, len(q) - 1 AS k, len(list_filter(q[2:len(q) - 1], lambda e: e <= x)) AS bin, ref FROM x JOIN q USING (feature) WHERE len(q) >= 3),
cnt AS (SELECT feature, bin, count(*) FILTER (ref) AS r, count(*) FILTER (NOT ref) AS c FROM binned GROUP BY 1, 2),
tot AS (SELECT feature, max(k) AS k, count(*) FILTER (ref) AS nr, count(*) FILTER (NOT ref) AS nc FROM binned GROUP BY 1),
grid AS (SELECT t.*, b.bin FROM tot t, LATERAL (SELECT unnest(range(0, t.k)) AS bin) b),
shares AS (SELECT g.feature, (coalesce(r, 0) + 0.5) / (nr + 0.5 * k) AS a, (coalesce(c, 0) + 0.5) / (nc + 0.5 * k) AS b FROM grid g LEFT JOIN cnt USING (feature, bin)),
psi AS (SELECT feature, sum((b - a) * ln(b / a)) AS psi FROM shares GROUP BY 1),
dd AS (SELECT feature, x, count(*) FILTER (ref) AS r, count(*) FILTER (NOT ref) AS c FROM x GROUP BY 1, 2),
gap AS (SELECT feature, abs(sum(r) OVER (PARTITION BY feature ORDER BY x) / sum(r) OVER (PARTITION BY feature) - sum(c) OVER (PARTITION BY feature ORDER BY x) / sum(c) OVER (PARTITION BY feature)) AS g FROM dd),
ks AS (SELECT feature, max(g) AS ks FROM gap GROUP BY 1),
drift AS (SELECT feature, round(psi, 4) AS psi, round(ks, 4) AS ks, CASE feature WHEN 'p' THEN 0.6 WHEN 'segment' THEN 0.3 ELSE 0.1 END::DOUBLE AS importance FROM psi JOIN ks USING (feature))"""
WEIGHTS = {"p": 0.6, "segment": 0.3, "hour": 0.1}


def _periods(spark, d):
    s = scored(spark, d).select("id", "p", F.col("segment").cast("double").alias("segment"), F.hour("ts").cast("double").alias("hour"))
    half = s.agg((F.max("id") / 2).alias("h"))
    s = s.crossJoin(F.broadcast(half))
    return s.filter("id <= h").select(*FEATS), s.filter("id > h").withColumn("p", F.round(F.col("p") * F.col("p"), 6)).select(*FEATS)


@query(DRIFT_SQL + " SELECT feature, round(psi, 6) AS psi FROM psi")
def monitor_psi(spark, d):
    return N.psi(*_periods(spark, d), list(FEATS)).select("feature", F.round("psi", 6).alias("psi"))


@query(DRIFT_SQL + " SELECT feature, round(ks, 6) AS ks FROM ks")
def monitor_ks(spark, d):
    return N.ks(*_periods(spark, d), list(FEATS)).select("feature", F.round("ks", 6).alias("ks"))


@query(DRIFT_SQL + " SELECT *, psi >= 0.25 OR ks >= 0.15 AS drifted FROM drift")
def monitor_feature_drift(spark, d):
    return N.feature_drift(*_periods(spark, d), WEIGHTS)


@query(DRIFT_SQL + " SELECT round(sum(psi * importance) / sum(importance), 4) AS weighted_psi, round(max(psi), 4) AS max_psi, count(*) FILTER (psi >= 0.25 OR ks >= 0.15) AS n_drifted, count(*) AS n_features FROM drift")
def monitor_drift_summary(spark, d):
    return N.drift_summary(N.feature_drift(*_periods(spark, d), WEIGHTS))


@query(DRIFT_SQL + " SELECT round(psi, 4) AS psi, round(ks, 4) AS ks FROM psi JOIN ks USING (feature) WHERE feature = 'p'")
def monitor_score_drift(spark, d):
    r, c = _periods(spark, d)
    return N.psi(r, c, ["p"]).join(N.ks(r, c, ["p"]), "feature").select(F.round("psi", 4).alias("psi"), F.round("ks", 4).alias("ks"))


@query(f"WITH {DECISIONS} SELECT count(*) AS reviewed, count(*) FILTER (outcome = 'CONFIRMED') AS confirmed, round(count(*) FILTER (outcome = 'CONFIRMED') / count(*), 4) AS precision, count(*) >= 30 AS sufficient FROM decisions WHERE outcome IN ('CONFIRMED', 'DISMISSED')")
def monitor_realised_precision(spark, d):
    return N.realised_precision(decisions(spark, d))


# one batch a day of events; its measures are shares of that day's rows
POLICY_SQL = S + """b AS (SELECT CAST(datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS batch, round(2 * avg(CASE WHEN y = 1 THEN p END), 4) - 0.75 AS weighted_psi, round(avg(y), 4) - 0.11 AS score_psi, round(avg(p), 4) AS precision, count(*) AS reviewed FROM scored GROUP BY 1),
f AS (SELECT *, coalesce(weighted_psi >= 0.5, false) AS severe, coalesce(weighted_psi >= 0.25, false) AS material, coalesce(score_psi >= 0.1, false) AS shift, coalesce(reviewed >= 30 AND precision < 0.65 * (1 - 0.1), false) AS fell FROM b),
g AS (SELECT *, sum(CAST(NOT severe AS INTEGER)) OVER o AS g1, sum(CAST(NOT material AS INTEGER)) OVER o AS g2, sum(CAST(NOT shift AS INTEGER)) OVER o AS g3, sum(CAST(NOT fell AS INTEGER)) OVER o AS g4 FROM f WINDOW o AS (ORDER BY batch)),
s AS (SELECT batch, CASE WHEN severe THEN sum(severe::INT) OVER (PARTITION BY g1 ORDER BY batch) ELSE 0 END::BIGINT AS streak_severe, CASE WHEN material THEN sum(material::INT) OVER (PARTITION BY g2 ORDER BY batch) ELSE 0 END::BIGINT AS streak_material,
 CASE WHEN shift THEN sum(shift::INT) OVER (PARTITION BY g3 ORDER BY batch) ELSE 0 END::BIGINT AS streak_shift, CASE WHEN fell THEN sum(fell::INT) OVER (PARTITION BY g4 ORDER BY batch) ELSE 0 END::BIGINT AS streak_fell FROM g)
SELECT batch, CASE WHEN streak_severe >= 2 THEN 'HALT_AUTOMATION' WHEN streak_fell >= 2 THEN 'REFIT_THRESHOLDS' WHEN streak_material >= 2 THEN 'RETRAIN' WHEN streak_shift >= 2 THEN 'RECALIBRATE' ELSE 'MONITOR' END AS action, streak_severe >= 2 AS signoff, streak_severe, streak_material, streak_shift, streak_fell FROM s"""


@query(POLICY_SQL)
def monitor_policy(spark, d):
    s = scored(spark, d)
    b = s.groupBy(F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long").alias("batch")).agg(
        (F.round(2 * F.avg(F.when(F.col("y") == 1, F.col("p"))), 4) - 0.75).alias("weighted_psi"), (F.round(F.avg(F.col("y").cast("double")), 4) - 0.11).alias("score_psi"), F.round(F.avg("p"), 4).alias("precision"), F.count("*").alias("reviewed"),
    )
    return N.policy(b, 0.65)


# ------------------------------------------------------------------ label noise
TH = S + "th AS (SELECT avg(p) FILTER (y = 1) AS t1, avg(1 - p) FILTER (y = 0) AS t0, count(*) FILTER (y = 1) AS np, count(*) FILTER (y = 0) AS nn FROM scored), r AS (SELECT id, y, p, coalesce(sum(y) OVER w, 0) / np AS over_pos, coalesce(sum(1 - y) OVER w, 0) / nn AS over_neg, t1, t0, np, nn FROM scored, th WINDOW w AS (ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND 0.00000001 PRECEDING))"


@query(TH + " SELECT round(t1, 6) AS t1, round(t0, 6) AS t0 FROM th")
def noise_thresholds(spark, d):
    return N.noise_thresholds(scored(spark, d)).select(F.round("t1", 6).alias("t1"), F.round("t0", 6).alias("t0"))


@query(TH + " SELECT id, y, p, CASE WHEN y = 0 THEN 'LABELLED_LEGITIMATE_SCORED_HIGH' ELSE 'LABELLED_MULE_SCORED_LOW' END AS direction, round(CASE WHEN y = 0 THEN p - t1 ELSE 1 - p - t0 END, 6) AS margin, round(CASE WHEN y = 0 THEN over_pos ELSE over_neg END, 6) AS outranks FROM r WHERE (y = 0 AND p >= t1) OR (y = 1 AND 1 - p >= t0)")
def noise_suspects(spark, d):
    return N.noise_suspects(scored(spark, d))


@query(TH + " SELECT id, y, p, round(CASE WHEN y = 0 THEN over_pos ELSE over_neg END, 6) AS outranks FROM r WHERE (y = 0 AND over_pos >= 0.95) OR (y = 1 AND round(over_neg, 12) <= 0.05)")
def noise_rank(spark, d):
    return N.noise_rank(scored(spark, d))


@query(TH + " SELECT round(max(t1), 6) AS self_confidence_mule, round(max(t0), 6) AS self_confidence_legitimate, max(nn) AS legitimate, count(*) FILTER (y = 0 AND p >= t1) AS legitimate_flagged, max(np) AS mules, count(*) FILTER (y = 1 AND 1 - p >= t0) AS mules_flagged, round(100 * count(*) FILTER (y = 0 AND p >= t1) / max(nn), 4) AS legitimate_flagged_pct, round(100 * count(*) FILTER (y = 1 AND 1 - p >= t0) / max(np), 2) AS mules_flagged_pct FROM r")
def noise_estimate(spark, d):
    return N.noise_estimate(scored(spark, d))


# ------------------------------------------------------------------ fairness
FAIR = S + """m AS (SELECT p AS v, count(*) AS n FROM scored GROUP BY p), dm AS (SELECT v AS mode, n / (SELECT count(*) FROM scored) >= 0.15 AS dominant FROM m ORDER BY n DESC, v LIMIT 1),
rk AS (SELECT id, p, dominant, row_number() OVER (ORDER BY p, id) AS rank, count(*) OVER () AS m FROM scored, dm WHERE NOT (dominant AND p = mode)),
fb AS (SELECT id, ['Q1', 'Q2', 'Q3', 'Q4'][CAST(greatest(ceil((rank - 1) * (CASE WHEN dominant THEN 3 ELSE 4 END) / CAST(m - 1 AS DOUBLE)) - 1, 0) AS INTEGER) + 1 + CASE WHEN dominant THEN 1 ELSE 0 END] AS band FROM rk
 UNION ALL SELECT id, 'Q1' FROM scored, dm WHERE dominant AND p = mode)"""


@query(FAIR + " SELECT id, band FROM fb")
def fair_bands(spark, d):
    return N.fair_bands(scored(spark, d), "p")


@query(S + """g AS (SELECT CAST(segment AS VARCHAR) AS grp, count(*) AS accounts, sum(y)::BIGINT AS true_mules, count(*) FILTER (p >= 0.75) AS flagged, round(sum(y) / count(*), 5) AS base_rate, round(count(*) FILTER (p >= 0.75) / count(*), 4) AS selection_rate, round(count(*) FILTER (p >= 0.75 AND y = 1) / nullif(count(*) FILTER (p >= 0.75), 0), 4) AS precision FROM scored GROUP BY 1),
 h AS (SELECT *, min(CASE WHEN accounts >= 20 THEN selection_rate END) OVER () AS fl FROM g), k AS (SELECT *, CASE WHEN accounts >= 20 AND fl > 0 THEN round(selection_rate / fl, 3) END AS burden_ratio FROM h)
 SELECT grp, accounts, true_mules, flagged, base_rate, selection_rate, precision, burden_ratio, coalesce(burden_ratio > 1.25, false) AS flagged_for_review FROM k""")
def fair_slices(spark, d):
    return N.fair_slices(scored(spark, d), "segment", F.col("p") >= 0.75)


@query("WITH x AS (SELECT CASE WHEN doc_id % 13 = 0 THEN 'NEEDS_REVIEW' WHEN quality = 1 THEN 'CONFIRMED_MULE' ELSE 'DISMISSED' END AS decision, 1 - toxic AS ground_truth FROM labels) SELECT count(*) AS total, count(*) FILTER (decision <> 'NEEDS_REVIEW') AS resolved, count(*) FILTER ((decision = 'CONFIRMED_MULE' AND ground_truth = 1) OR (decision = 'DISMISSED' AND ground_truth = 0)) AS agreed, round(count(*) FILTER ((decision = 'CONFIRMED_MULE' AND ground_truth = 1) OR (decision = 'DISMISSED' AND ground_truth = 0)) / count(*) FILTER (decision <> 'NEEDS_REVIEW'), 4) AS agreement_rate FROM x")
def decision_agreement(spark, d):
    lab = spark.read.parquet(f"{d}/labels.parquet")
    return N.agreement(lab.select(F.when(F.col("doc_id") % 13 == 0, "NEEDS_REVIEW").when(F.col("quality") == 1, "CONFIRMED_MULE").otherwise("DISMISSED").alias("decision"), (1 - F.col("toxic")).alias("ground_truth")))
