"""Queries on tables with unknown columns, extracts, hold-outs and submissions."""

from pyspark.sql import functions as F

from ledgerloom.operators import export as E
from ledgerloom.operators import learn as H
from ledgerloom.operators import metrics as X
from ledgerloom.operators import monitor as N
from ledgerloom.operators import quality as K
from ledgerloom.operators import scoring as C
from ledgerloom.plans.registry import query, rounded
from ledgerloom.sources.views import MATRIX, SCORED, acct_matrix, scored

# the account matrix as another institution might write it
FOREIGN = f"""WITH {MATRIX}, foreign_ AS (SELECT user_id AS customer_ref, TOT_TXNAMT_CR_L31D AS "total incoming 31d", TOT_TXNAMT_DB_L31D AS "total outgoing 31d", TOT_TXNS_L7D / nullif(CAST(TOT_TXNS_L31D AS DOUBLE), 0) AS burst_ratio,
 CASE WHEN user_id % 11 <> 0 THEN user_id % 700 END AS account_age, VIEW_AMT_L7D AS concentration_view, CAST(NULL AS DOUBLE) AS round_share, COUNT_ALERTS AS disputes FROM mx),
sig AS (SELECT customer_ref, CASE WHEN "total incoming 31d" IS NOT NULL AND "total outgoing 31d" IS NOT NULL THEN least(greatest("total outgoing 31d" / ("total incoming 31d" + 1e-9), 0), 5) END AS passthrough, CAST(burst_ratio AS DOUBLE) AS burst_activity, CAST(concentration_view AS DOUBLE) AS concentration, -CAST(account_age AS DOUBLE) AS account_age, CAST(disputes AS DOUBLE) AS chargebacks FROM foreign_)"""
SIGNALS = ("passthrough", "burst_activity", "concentration", "account_age", "chargebacks")
RANKS = ", cells AS (" + " UNION ALL ".join(f"SELECT customer_ref, (rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0) / count(*) OVER () AS share FROM sig WHERE {c} IS NOT NULL" for c in SIGNALS) + "), ranked_ AS (SELECT s.customer_ref, coalesce(avg(share), 0) AS score FROM sig s LEFT JOIN cells USING (customer_ref) GROUP BY 1)"
CUT = """, top_ AS (SELECT greatest(max(score), 1e-9) AS hi FROM ranked_), hist AS (SELECT CAST(least(floor(score / hi * 64), 63) AS INTEGER) AS bin, count(*) AS n, max(hi) AS hi FROM ranked_, top_ GROUP BY 1),
 split AS (SELECT bin, hi, (bin + 0.5::DOUBLE) * hi / 64 AS mid, sum(n) OVER () AS n1, sum(n * ((bin + 0.5::DOUBLE) * hi / 64)) OVER () AS m1, sum(n) OVER w AS n0, sum(n * ((bin + 0.5::DOUBLE) * hi / 64)) OVER w AS m0 FROM hist WINDOW w AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 cut AS (SELECT mid AS threshold, round(n0 / n1 * ((n1 - n0) / n1) * pow(m0 / n0 - (m1 - m0) / (n1 - n0), 2), 12) AS separation FROM split WHERE n0 IS NOT NULL ORDER BY 2 DESC, bin LIMIT 1)"""


def _foreign(spark, d):
    m, u = acct_matrix(spark, d), F.col("user_id")
    return m.select(
        u.alias("customer_ref"), F.col("TOT_TXNAMT_CR_L31D").alias("total incoming 31d"), F.col("TOT_TXNAMT_DB_L31D").alias("total outgoing 31d"), (F.col("TOT_TXNS_L7D") / F.nullif("TOT_TXNS_L31D", F.lit(0)).cast("double")).alias("burst_ratio"),
        F.when(u % 11 != 0, u % 700).alias("account_age"), F.col("VIEW_AMT_L7D").alias("concentration_view"), F.lit(None).cast("double").alias("round_share"), F.col("COUNT_ALERTS").alias("disputes"),
    )


@query(FOREIGN + " SELECT customer_ref, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in SIGNALS) + " FROM sig")
def score_typology_signals(spark, d):
    return rounded(C.typology(_foreign(spark, d), "customer_ref")[0])


@query(FOREIGN + RANKS + " SELECT customer_ref, round(score, 6) + 0.0 AS score FROM ranked_")
def score_typology_rank(spark, d):
    return rounded(C.rank_score(C.typology(_foreign(spark, d), "customer_ref")[0], "customer_ref"))


@query(FOREIGN + RANKS + CUT + " SELECT round(threshold, 6) AS threshold, round(separation, 6) AS separation, (SELECT count(*) FROM ranked_ WHERE score >= round(threshold, 12)) AS flagged FROM cut")
def score_typology_cut(spark, d):
    s = C.rank_score(C.typology(_foreign(spark, d), "customer_ref")[0], "customer_ref")
    rows = C.ranking(_foreign(spark, d), "customer_ref")[0]
    return rounded(C.otsu(s)).crossJoin(rows.agg(F.count(F.when(F.col("flagged"), 1)).alias("flagged")))


DRIFT = f"""WITH {SCORED}, rows_ AS (SELECT 'E' || CAST(day(ts) // 11 AS VARCHAR) AS extract, CASE WHEN day(ts) // 11 = 1 THEN p * p ELSE p END AS p, CAST(segment AS DOUBLE) AS segment, CASE WHEN id % 400 = 0 THEN CAST(hour(ts) AS DOUBLE) END AS hour FROM scored),
 main AS (SELECT extract FROM rows_ GROUP BY 1 ORDER BY count(*) DESC, extract DESC LIMIT 1),
 x AS (SELECT feature, x, extract = (SELECT extract FROM main) AS r FROM (SELECT extract, 'p' AS feature, p AS x FROM rows_ UNION ALL SELECT extract, 'segment', segment FROM rows_ UNION ALL SELECT extract, 'hour', hour FROM rows_) WHERE x IS NOT NULL),
 v AS (SELECT feature, x, count(*) FILTER (r) AS a, count(*) FILTER (NOT r) AS b FROM x GROUP BY 1, 2),
 c AS (SELECT feature, sum(a) OVER w / sum(a) OVER e AS fa, sum(b) OVER w / sum(b) OVER e AS fb, sum(a) OVER e AS na, sum(b) OVER e AS nb FROM v WINDOW w AS (PARTITION BY feature ORDER BY x), e AS (PARTITION BY feature)),
 k AS (SELECT feature, max(abs(fa - fb)) AS ks, max(na) AS na, max(nb) AS nb, max(abs(fa - fb)) * sqrt(max(na) * max(nb) / (max(na) + max(nb))) AS l FROM c GROUP BY 1 HAVING max(na) >= 30 AND max(nb) >= 10),
 pv AS (SELECT *, CASE WHEN l < 0.2 THEN 1.0 ELSE least(greatest(2 * list_sum(list_transform(range(1, 101), lambda k: CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END * exp(-2.0 * k * k * l * l))), 0), 1) END AS pval FROM k)"""


def _extracts(spark, d):
    s = scored(spark, d)
    part = F.floor(F.dayofmonth("ts") / 11)
    return s.select(F.concat(F.lit("E"), part.cast("string")).alias("extract"), F.when(part == 1, F.col("p") * F.col("p")).otherwise(F.col("p")).alias("p"), F.col("segment").cast("double").alias("segment"), F.when(F.col("id") % 400 == 0, F.hour("ts").cast("double")).alias("hour"))


@query(DRIFT + " SELECT feature AS \"column\", round(ks, 4) AS ks, round(pval, 6) + 0.0 AS p_value, pval < 0.01 AS shifted FROM pv")
def monitor_extract_drift(spark, d):
    return N.extract_drift(_extracts(spark, d), "extract", ["p", "segment", "hour"])


@query(DRIFT + " SELECT count(*) AS columns_tested, count(*) FILTER (pval < 0.01) AS columns_shifted, round(count(*) FILTER (pval < 0.01) / greatest(count(*), 1), 4) AS share_shifted FROM pv")
def monitor_extract_summary(spark, d):
    return N.extract_drift_summary(N.extract_drift(_extracts(spark, d), "extract", ["p", "segment", "hour"]))


@query(f"""WITH {SCORED}, g AS (SELECT CAST(segment AS VARCHAR) AS grp, count(*) AS accounts, round(count(*) FILTER (p >= 0.75) / count(*), 4) AS rate, round(count(*) FILTER (p >= 0.75 AND y = 1) / nullif(count(*) FILTER (p >= 0.75), 0), 4) AS precision FROM scored GROUP BY 1),
 z AS (SELECT * FROM g WHERE accounts >= 20), f AS (SELECT min(rate) AS lo, max(rate) AS hi, avg(precision) AS mean FROM z), m AS (SELECT * FROM z ORDER BY rate DESC, grp DESC LIMIT 1)
 SELECT lo AS least_burdened_rate, hi AS most_burdened_rate, CASE WHEN lo > 0 THEN round(hi / lo, 2) END AS selection_rate_spread, m.grp AS most_burdened_group, coalesce((SELECT max(CASE WHEN lo > 0 THEN round(rate / lo, 3) END) > 1.25 FROM z), false) AS any_group_over_cap, round(mean, 4) AS mean_precision,
  coalesce(CASE WHEN lo > 0 THEN round(m.rate / lo, 3) END > 1.25 AND m.precision < mean, false) AS proxy_signature_present FROM f, m""")
def fair_proxy_signature(spark, d):
    return N.proxy_signature(N.fair_slices(scored(spark, d), "segment", F.col("p") >= 0.75))


@query(f"WITH {SCORED}, f AS (SELECT segment, max(p) AS threshold_high, quantile_cont(p, 0.5) AS threshold_medium FROM scored GROUP BY 1) SELECT round(least(avg(threshold_high), avg(threshold_medium)) * 1000, 2) AS low_max, round(greatest(avg(threshold_high), avg(threshold_medium)) * 1000, 2) AS medium_max, true AS derived, abs(avg(threshold_high) - avg(threshold_medium)) * 1000 < 1e-6 AS degenerate FROM f")
def metric_band_edges(spark, d):
    by = scored(spark, d).groupBy("segment").agg(F.max("p").alias("threshold_high"), F.percentile("p", F.lit(0.5)).alias("threshold_medium"))
    return X.band_edges(by)


@query(f"""WITH {MATRIX}, f AS (SELECT user_id, y, CAST(user_id % 4 AS VARCHAR) AS month, md5(CAST(user_id AS VARCHAR) || ':holdout') AS h FROM mx),
 q AS (SELECT month, greatest(1, round_even(13 * n / (SELECT count(*) FROM f WHERE y = 1)::DOUBLE, 0)) AS quota FROM (SELECT month, count(*) AS n FROM f WHERE y = 1 GROUP BY 1)),
 r AS (SELECT f.*, row_number() OVER (PARTITION BY f.month ORDER BY h, user_id) AS rn, quota FROM f JOIN q USING (month) WHERE y = 1),
 p AS (SELECT user_id FROM r ORDER BY rn > quota, CASE WHEN rn > quota THEN '' ELSE month END, CASE WHEN rn > quota THEN 0 ELSE rn END, h, user_id LIMIT 13),
 n AS (SELECT user_id FROM f WHERE y = 0 ORDER BY h, user_id LIMIT 200)
 SELECT user_id, y, user_id IN (SELECT user_id FROM p UNION ALL SELECT user_id FROM n) AS held_out FROM f""")
def blind_holdout(spark, d):
    m = acct_matrix(spark, d).select("user_id", "y", (F.col("user_id") % 4).cast("string").alias("month"))
    return H.blind_holdout(m, "user_id", "y", "month").select("user_id", "y", "held_out")


@query("SELECT e.column_name AS \"column\" FROM (DESCRIBE SELECT * FROM orders) e WHERE substr(e.column_name, 3) IN (SELECT substr(column_name, 3) FROM (DESCRIBE SELECT * FROM lineitem))")
def shared_columns(spark, d):
    """The columns of orders that line items have too, apart from the table's prefix and whatever their case and signs."""
    o, li = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("orders", "lineitem"))
    names = K.shared_columns(o.toDF(*[c[2:] for c in o.columns]), li.toDF(*[c[2:].upper() + "_" for c in li.columns]))
    return spark.createDataFrame([(f"o_{c}",) for c in names], "`column` string")


@query(f"WITH {SCORED}, s AS (SELECT id AS account_id, round(p * 1000) AS s FROM scored), r AS (SELECT account_id, s / (SELECT max(s) FROM s) AS p FROM s) SELECT account_id, round(CASE WHEN p >= 0.3 THEN 0.5 + 0.5 * least(greatest((p - 0.3) / 0.7, 0), 1) ELSE 0.5 * least(greatest(p / 0.3, 0), 1) END, 6) AS is_mule FROM r")
def export_submission(spark, d):
    return E.build_submission(scored(spark, d).select(F.col("id").alias("acct_id"), F.round(F.col("p") * 1000).alias("risk_score"), "segment"), 0.3)[0]


NAMES = ["TOT_TXNAMT_L7D", "TOT_TXNS_L7D", "AVG_BAL_7DAYS", "TOT_TXNAMT_CR_L31D", "TOT_TXNAMT_DB_L31D", "COUNT_ALERTS"]
#: Trees of the registered queries that fit several ensembles; the functions' own default is learn.TREES.
FEW = 20


def _rows(spark, d):
    return acct_matrix(spark, d).select(F.col("user_id").alias("id"), "y", *NAMES)


@query()
def ml_nested_cv(spark, d):
    return H.nested_cv(_rows(spark, d), NAMES, k=2, trees=FEW)[0]


@query()
def ml_ablation(spark, d):
    rows = _rows(spark, d).withColumn("mg_net_flow_31d", (F.col("TOT_TXNAMT_CR_L31D") - F.col("TOT_TXNAMT_DB_L31D")) / (F.abs(F.col("TOT_TXNAMT_CR_L31D") + F.col("TOT_TXNAMT_DB_L31D")) + 1))
    return H.ablation(rows, [*NAMES, "mg_net_flow_31d"], k=3, trees=FEW)


@query()
def ml_fit_shared(spark, d):
    """A model of the columns that a table and the training data share, applied to that table."""
    rows = _rows(spark, d)
    other = rows.filter("id % 3 = 0").toDF(*[c if c in ("id", "y") else c.lower().replace("_", " ") for c in rows.columns]).drop("y")
    return C.fit_on_shared(rows.filter("id % 3 <> 0").drop("id"), "y", other, "id", trees=FEW, k=3)[0]


@query()
def ml_score_table(spark, d):
    """The ensemble fitted on half of the accounts, applied to a table of the rest that lacks two columns."""
    rows = _rows(spark, d)
    model = H.Ensemble(NAMES, trees=FEW).fit(rows.filter("id % 2 <> 0"), "id")
    return C.score_table(rows.filter("id % 2 = 0").drop("y", *NAMES[:2]), "id", model).rows


@query()
def monitor_batch(spark, d):
    """A batch whose scores and one column have moved, after one that moved as well."""
    s = scored(spark, d).select("id", "p", F.col("segment").cast("double").alias("segment"))
    half = s.agg(F.max("id") / 2).first()[0]
    ref, cur = s.filter(F.col("id") <= half), s.filter(F.col("id") > half).withColumn("segment", F.col("segment") + 3).withColumn("p", F.col("p") * F.col("p"))
    first = N.monitor_batch(ref, cur, {"segment": 2.0, "absent": 1.0})
    second = N.monitor_batch(ref, cur, {"segment": 2.0, "absent": 1.0}, history=first["state"])
    return spark.createDataFrame([(i, x["action"], x["band"], x["signal"]["weighted_psi"], x["signal"]["score_psi"], ",".join(x["missing"])) for i, x in enumerate((first, second))], "batch int, action string, band string, weighted_psi double, score_psi double, missing string")
