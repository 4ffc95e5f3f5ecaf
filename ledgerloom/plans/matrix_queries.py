"""Queries on wide account tables: features, schema and cleaning decisions, rules, exports."""

import ast

from pyspark.sql import functions as F

from ledgerloom.operators import export as E
from ledgerloom.operators import matrix as MX
from ledgerloom.operators import monitor as N
from ledgerloom.operators import quality as K
from ledgerloom.plans.metric_queries import BAND_SQL, _bands
from ledgerloom.plans.registry import cols, query, rounded
from ledgerloom.sources.views import MATRIX, RAILS, SCORED, acct_matrix, scored, table

M = f"WITH {MATRIX}, "
RAIL_COLS = tuple(f"{r.upper()}_AMT_L7D" for r in RAILS)
CASH, ATM, DEBIT, DIGITAL = "CLICK_AMT_L7D", "ERROR_AMT_L7D", "TOT_TXNAMT_DB_L7D", ("SIGNUP_AMT_L7D", "PURCHASE_AMT_L7D")


def _safe(n, d):
    return f"coalesce(({n}) / (abs({d}) + 1), 0)"


MG = {}
for _d in (7, 14, 31):
    _a, _b = f"TOT_TXNAMT_CR_L{_d}D", f"TOT_TXNAMT_DB_L{_d}D"
    MG[f"mg_passthrough_{_d}d"] = f"coalesce(CASE WHEN {_a} IS NULL OR {_b} IS NULL THEN NULL ELSE least({_a}, {_b}) / (greatest({_a}, {_b}) + 1) END, 0)"
    MG[f"mg_net_flow_{_d}d"] = _safe(f"{_a} - {_b}", f"{_a} + {_b}")
    MG[f"mg_turnover_over_balance_{_d}d"] = _safe(f"TOT_TXNAMT_L{_d}D", f"AVG_BAL_{_d}DAYS")
MG["mg_amount_burst_7v31"] = _safe("TOT_TXNAMT_L7D / 7", "TOT_TXNAMT_L31D / 31")
MG["mg_count_burst_7v31"] = _safe("TOT_TXNS_L7D / 7", "TOT_TXNS_L31D / 31")
MG["mg_cash_out_share_7d"], MG["mg_atm_out_share_7d"] = _safe(CASH, DEBIT), _safe(ATM, DEBIT)
MG["mg_digital_in_cash_out_7d"] = _safe(" + ".join(f"coalesce({c}, 0)" for c in DIGITAL), CASH)
_abs = [f"abs(coalesce({c}, 0))" for c in RAIL_COLS]
_tot = f"({' + '.join(_abs)} + 1)"
MG["mg_channel_hhi_7d"] = " + ".join(f"pow({a} / {_tot}, 2)" for a in _abs)
MG["mg_channel_active_7d"] = " + ".join(f"CAST({a} > 0 AS DOUBLE)" for a in _abs)
MG["mg_channel_top_share_7d"] = f"greatest({', '.join(f'{a} / {_tot}' for a in _abs)})"
for _d in (7, 31):
    MG[f"mg_avg_ticket_{_d}d"] = _safe(f"TOT_TXNAMT_L{_d}D", f"TOT_TXNS_L{_d}D")
    MG[f"mg_balance_volatility_{_d}d"] = _safe(f"MAX_BAL_{_d}DAYS - MIN_BAL_{_d}DAYS", f"AVG_BAL_{_d}DAYS")
_time = [f"COUNT_ALERTS_{t}" for t in MX.TIMES]
for _t in MX.TIMES:
    MG[f"mg_alert_share_{_t.lower()}"] = _safe(f"COUNT_ALERTS_{_t}", "COUNT_ALERTS")
_tt = f"({' + '.join(_time)} + 1.0)"
MG["mg_alert_time_entropy"] = "-(" + " + ".join(f"({t} / {_tt}) * ln({t} / {_tt} + 1e-9)" for t in _time) + ")"


def _feat(spark, d):
    return MX.features(acct_matrix(spark, d), RAIL_COLS, CASH, ATM, DEBIT, DIGITAL)


def _family(name, *prefixes):
    names = [n for n in MG if n.startswith(tuple(f"mg_{p}" for p in prefixes))]
    sql = M[:-2] + " SELECT user_id, " + ", ".join(f"round(CAST({MG[n]} AS DOUBLE), 6) + 0.0 AS {n}" for n in names) + " FROM mx"

    @query(sql, name)
    def run(spark, d):
        return rounded(_feat(spark, d).select("user_id", *names))


_family("mx_passthrough", "passthrough", "net_flow")
_family("mx_turnover", "turnover")
_family("mx_burst", "amount_burst", "count_burst")
_family("mx_cashout", "cash_out", "atm_out", "digital")
_family("mx_channel", "channel")
_family("mx_ticket", "avg_ticket")
_family("mx_alert_time", "alert")
_family("mx_balance", "balance")

OCC = ("TOT_TXNAMT_L7D", "AVG_BAL_7DAYS", "MAX_BAL_31DAYS")


@query(M + "o AS (SELECT user_id, list_filter([" + ", ".join(f"{c} / 100" for c in OCC) + "], lambda x: x IS NOT NULL) AS v FROM mx) SELECT user_id, round(coalesce(list_sum(v) / nullif(len(v), 0), 0), 8) + 0.0 AS mg_occ_deviation_mean, round(coalesce(list_max(list_transform(v, lambda x: abs(x))), 0), 8) AS mg_occ_deviation_max, CAST(len(list_filter(v, lambda x: abs(x) > 3)) AS DOUBLE) AS mg_occ_extreme_count FROM o")
def mx_occupation(spark, d):
    df = acct_matrix(spark, d).select("user_id", *[(F.col(c) / 100).alias(f"F{i}_OCC") for i, c in enumerate(OCC)])
    return rounded(df.select("user_id", *[c.alias(n) for n, c in MX.occupation(df).items()]), 8)


PROFILE = ("TOT_TXNAMT_L7D", "TOT_TXNAMT_CR_L7D", "TOT_TXNAMT_DB_L7D", "VIEW_AMT_L7D", "CLICK_AMT_L7D", "AVG_BAL_7DAYS")


@query(M + f"o AS (SELECT user_id, list_filter([{', '.join(PROFILE)}], lambda x: x IS NOT NULL) AS v, [{', '.join(PROFILE)}] AS a FROM mx) SELECT user_id, round(coalesce(list_avg(v), 0), 8) + 0.0 AS mg_row_mean, round(coalesce(list_stddev_pop(v), 0), 8) AS mg_row_std, round(coalesce(list_max(v), 0), 8) + 0.0 AS mg_row_max, round(coalesce(list_min(v), 0), 8) + 0.0 AS mg_row_min, round(coalesce(list_max(v) - list_min(v), 0), 8) AS mg_row_range, round(len(list_filter(a, lambda x: x IS NULL OR x <> 0)) / 6.0, 8) AS mg_row_nonzero_frac FROM o")
def mx_row_profile(spark, d):
    df = acct_matrix(spark, d)
    return rounded(df.select("user_id", *[c.alias(n) for n, c in MX.row_profile(df, list(PROFILE)).items()]), 8)


EDGE = ("user_id", "TOT_TXNS_L7D", "TOT_TXNAMT_L7D", "COUNT_ALERTS")


@query(M[:-2] + " " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} <> floor({c})) = 0 AND min({c}) >= 0 AND max({c}) <= count(*) - 1 AND count(DISTINCT {c}) > 0.3 * count(*) AS edge FROM mx" for c in EDGE))
def mx_edge_columns(spark, d):
    return MX.edge_columns(acct_matrix(spark, d), list(EDGE))


# ------------------------------------------------------------------ rules
RULE_COLS = ("mg_passthrough_7d", "mg_turnover_over_balance_7d", "mg_amount_burst_7v31", "mg_cash_out_share_7d", "mg_channel_active_7d", "mg_avg_ticket_7d", "mg_alert_share_night", "mg_balance_volatility_7d", "mg_net_flow_7d")
HITS_SQL = M + "f AS (SELECT user_id, y, " + ", ".join(f"CAST({MG[c]} AS DOUBLE) AS {c}" for c in RULE_COLS) + """ FROM mx),
h AS (SELECT user_id, y, list_filter([CASE WHEN mg_passthrough_7d >= 0.9 THEN 'R01' END, CASE WHEN mg_turnover_over_balance_7d >= 50 THEN 'R02' END, CASE WHEN mg_amount_burst_7v31 >= 3 THEN 'R03' END,
 CASE WHEN mg_cash_out_share_7d >= 0.5 THEN 'R04' END, CASE WHEN mg_channel_active_7d <= 1 THEN 'R05' END, CASE WHEN mg_avg_ticket_7d > 0 AND mg_avg_ticket_7d <= 5000 THEN 'R06' END, CASE WHEN mg_alert_share_night >= 0.5 THEN 'R07' END,
 CASE WHEN mg_balance_volatility_7d >= 2 THEN 'R08' END, CASE WHEN mg_net_flow_7d BETWEEN -0.05 AND 0.05 AND mg_turnover_over_balance_7d >= 5 THEN 'R11' END,
 CASE WHEN mg_passthrough_7d >= 0.85 AND mg_channel_active_7d <= 1 THEN 'R12' END], lambda x: x IS NOT NULL) AS fired FROM f)"""


@query("SELECT * FROM (VALUES ('R09', 'mg_occ_deviation_max'), ('R10', 'ACCT_OPN_DAYS')) v(rule, missing)")
def rule_unevaluated(spark, d):
    """The rules that the account matrix lacks inputs for."""
    return spark.createDataFrame([(r["rule"], "|".join(r["missing"])) for r in N.unevaluated(_feat(spark, d))], "rule string, missing string")


TAIL = "(SELECT count(*) AS n, sum(y) AS pos FROM h) t"
SCORE_RULE = "SELECT rule, count(*) AS flagged, sum(y)::BIGINT AS caught, round(sum(y) / count(*), 4) AS precision, round(coalesce(sum(y) / nullif(max(pos), 0), 0), 4) AS recall, round(coalesce((sum(y) / count(*)) / nullif(max(pos) / max(n), 0), 0), 2) AS lift, round(count(*) / nullif(sum(y), 0), 2) AS alerts_per_mule"


def _hits(spark, d):
    return N.rule_hits(_feat(spark, d))


@query(HITS_SQL + " SELECT user_id, array_to_string(fired, '|') AS rules_fired, CAST(len(fired) AS INTEGER) AS n_rules_fired FROM h")
def rule_hits(spark, d):
    return _hits(spark, d).select("user_id", "rules_fired", "n_rules_fired")


@query(HITS_SQL + f", e AS (SELECT y, unnest(fired) AS rule FROM h) {SCORE_RULE} FROM e, {TAIL} GROUP BY rule")
def rule_metrics(spark, d):
    return N.rule_metrics(_hits(spark, d))


@query(HITS_SQL + f", e AS (SELECT y, 'any' AS rule FROM h WHERE len(fired) >= 1 UNION ALL SELECT y, 'two_plus' FROM h WHERE len(fired) >= 2 UNION ALL SELECT y, 'three_plus' FROM h WHERE len(fired) >= 3) {SCORE_RULE} FROM e, {TAIL} GROUP BY rule")
def rule_combined(spark, d):
    return N.rule_combined(_hits(spark, d))


# ------------------------------------------------------------------ schema and cleaning
DIRTY = f"""WITH {MATRIX}, dirty AS (SELECT user_id, y, TOT_TXNAMT_L7D, TOT_TXNS_L7D, AVG_BAL_7DAYS, COUNT_ALERTS, CAST(user_id * 7 + 1 AS BIGINT) AS ACCOUNT_NUMBER, CASE WHEN y = 1 THEN 'M1' ELSE 'M' || CAST(2 + user_id % 3 AS VARCHAR) END AS DATA_MONTH,
 CASE WHEN user_id % 5 = 0 THEN TOT_TXNAMT_L7D END AS SPARSE_COL, 1.0::DOUBLE AS CONST_COL, TOT_TXNAMT_L7D * 2 AS COPY_COL, y * 100.0 + user_id % 3 AS LEAK_COL, ['LOW', 'MEDIUM', 'HIGH'][CAST(user_id % 3 AS INTEGER) + 1] AS RISK_LEVEL, CASE WHEN y = 0 AND user_id % 2 = 0 THEN NULL ELSE CAST(user_id % 11 AS DOUBLE) END AS BLANKY FROM mx)"""
NUM = ("TOT_TXNAMT_L7D", "TOT_TXNS_L7D", "AVG_BAL_7DAYS", "COUNT_ALERTS", "SPARSE_COL", "CONST_COL", "COPY_COL", "LEAK_COL", "BLANKY")
ALL = (*NUM, "ACCOUNT_NUMBER", "DATA_MONTH", "RISK_LEVEL")


def _dirty(spark, d):
    u = F.col("user_id")
    return acct_matrix(spark, d).select(
        "user_id", "y", "TOT_TXNAMT_L7D", "TOT_TXNS_L7D", "AVG_BAL_7DAYS", "COUNT_ALERTS", (u * 7 + 1).alias("ACCOUNT_NUMBER"), F.when(F.col("y") == 1, "M1").otherwise(F.concat(F.lit("M"), (2 + u % 3).cast("string"))).alias("DATA_MONTH"),
        F.when(u % 5 == 0, F.col("TOT_TXNAMT_L7D")).alias("SPARSE_COL"), F.lit(1.0).alias("CONST_COL"), (F.col("TOT_TXNAMT_L7D") * 2).alias("COPY_COL"), (F.col("y") * 100.0 + u % 3).alias("LEAK_COL"),
        F.get(F.array(F.lit("LOW"), F.lit("MEDIUM"), F.lit("HIGH")), (u % 3).cast("int")).alias("RISK_LEVEL"), F.when(~((F.col("y") == 0) & (u % 2 == 0)), (u % 11).cast("double")).alias("BLANKY"),
    )


def _each(template, names=NUM):
    """One SELECT a column; C is its name, X its value as a number."""
    return DIRTY + " " + " UNION ALL ".join(template.replace("X", c).replace("C~", f"'{c}'") for c in names)


REAL = ("TOT_TXNAMT_L7D", "AVG_BAL_7DAYS", "SPARSE_COL", "CONST_COL", "COPY_COL", "LEAK_COL", "BLANKY")


def _profile_sql():
    out = []
    for c in ALL:
        num = "NULL::DOUBLE" if c in ("DATA_MONTH", "RISK_LEVEL") else f"CAST({c} AS DOUBLE)"
        named = "true" if c == "ACCOUNT_NUMBER" else "false"
        ids = named if c in REAL else f"({named} OR (count(*) > 50 AND count(DISTINCT {c}) >= 0.99 * count(*)))"
        cat = f"count(DISTINCT {c}) > 1 AND count(DISTINCT {c}) <= 30" if c in ("DATA_MONTH", "RISK_LEVEL") else "false"
        out.append(f"SELECT '{c}' AS \"column\", count(*) AS n, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS \"distinct\", coalesce(count(DISTINCT {num}) = 2 AND min({num}) = 0 AND max({num}) = 1, false) AS is_binary, {ids} AS is_id, {cat} AS is_categorical FROM dirty")
    return DIRTY + " " + " UNION ALL ".join(out)


@query(_profile_sql())
def profile_columns(spark, d):
    p = K.profile(_dirty(spark, d).select(*ALL))
    return p.withColumn("is_binary", F.coalesce("is_binary", F.lit(False)))


# column names as extracts have them, put together from every event: a statistic, a rail, a direction, a window, or a leak's name
STATS_SQL = "['TOT_', 'RA_', 'avg-', 'MAX.', 'D_', 'DA_', 'MM_', 'min ', 'X_', 'R_CI_']"
RAILS_SQL = "['UPI_AMT', 'NON_CASH_CHQ_TXN', 'ELEC_XFER_AMT', 'pos pymt', 'GST', 'LOAN_BAL', 'ATM_TXNS', 'NET_BNKING', 'BI_FEES_CHRGS', 'SELF', 'BBPS', 'MBNKING_CNT', 'STDNG']"
LEAKS_SQL = "['False_Positive', 'case status', 'Investigated_By', 'CHARGEBACK_AMT', 'write-off', 'Analyst.Verdict', 'LoadDate', 'RUN_DATE', 'Vintage', 'MNTH', 'data month', 'Max Resolve Days', 'SAR_NO', 'NECESSARY', 'STR_FILED', 'OPENING_DATE', 'DT_LAST', 'EXTRACT_ID', 'EXTRACTION', 'Month_End_Bal', 'BATCH 7', 'PARTITION', 'Closure Reason', 'SNAPSHOT_TIMESTAMP']"
NAMES_SQL = f"""WITH c AS (SELECT DISTINCT CASE WHEN event_id % 5 = 4 THEN {LEAKS_SQL}[event_id // 5 % 24 + 1] || CASE WHEN user_id % 2 = 0 THEN '' ELSE '_' || event_type END
 ELSE {STATS_SQL}[event_id % 10 + 1] || {RAILS_SQL}[user_id % 13 + 1] || ['', '_CR', '_DB', '_cr_x'][event_id // 10 % 4 + 1] || ['', '_L7D', '_L31D', '_L7_31D', '_7D'][user_id % 5 + 1] END AS "column" FROM events)"""


def _name_rows(spark, d):
    ev, (i, u) = table(spark, d, "events"), (F.col("event_id"), F.col("user_id"))
    pick = lambda sql, at: F.get(F.array(*[F.lit(x) for x in ast.literal_eval(sql)]), at.cast("int"))
    leak = F.concat(pick(LEAKS_SQL, F.floor(i / 5) % 24), F.when(u % 2 == 0, "").otherwise(F.concat(F.lit("_"), "event_type")))
    plain = F.concat(pick(STATS_SQL, i % 10), pick(RAILS_SQL, u % 13), pick("['', '_CR', '_DB', '_cr_x']", F.floor(i / 10) % 4), pick("['', '_L7D', '_L31D', '_L7_31D', '_7D']", u % 5))
    return ev.select(F.when(i % 5 == 4, leak).otherwise(plain).alias("column")).distinct()


@query(NAMES_SQL + " SELECT \"column\", regexp_replace(upper(\"column\"), '[^A-Z0-9]+', '', 'g') AS normalised FROM c")
def name_normalise(spark, d):
    return _name_rows(spark, d).select("column", K.normalise(F.col("column")).alias("normalised"))


@query(NAMES_SQL + """, n AS (SELECT "column", regexp_replace(upper("column"), '[^A-Z0-9]+', '', 'g') AS normalised FROM c)
 SELECT "column", normalised, contains(normalised, 'FRAUDSUSPECT') OR contains(normalised, 'SUSPECTEDFRAUD') OR contains(normalised, 'FALSEPOSITIVE') OR contains(normalised, 'TRUEPOSITIVE') OR contains(normalised, 'RESOLUTION')
  OR contains(normalised, 'RESOLVEDAYS') OR contains(normalised, 'RESOLVEDDAYS') OR contains(normalised, 'RESOLVEDBY') OR contains(normalised, 'UNATTENDED') OR contains(normalised, 'DISPOSITION') OR contains(normalised, 'INVESTIGAT')
  OR contains(normalised, 'CASESTATUS') OR contains(normalised, 'CASEOUTCOME') OR contains(normalised, 'ALERTOUTCOME') OR contains(normalised, 'CONFIRMEDFRAUD') OR starts_with(normalised, 'SAR') OR starts_with(normalised, 'STRFILED')
  OR starts_with(normalised, 'STRRAISED') OR contains(normalised, 'CHARGEBACK') OR contains(normalised, 'WRITEOFF') OR contains(normalised, 'CLOSUREREASON') OR contains(normalised, 'ANALYSTVERDICT') AS post_outcome,
  normalised IN ('MNTH', 'MONTH', 'VINTAGE') OR contains(normalised, 'SNAPSHOT') OR ends_with(normalised, 'EXTRACT') OR ends_with(normalised, 'EXTRACTDATE') OR ends_with(normalised, 'EXTRACTMONTH') OR ends_with(normalised, 'EXTRACTID')
  OR starts_with(normalised, 'BATCH') OR contains(normalised, 'LOADDATE') OR contains(normalised, 'ASOFDATE') OR starts_with(normalised, 'PARTITION') OR starts_with(normalised, 'DATAMONTH') OR starts_with(normalised, 'RUNDATE') OR starts_with(normalised, 'FILEDATE') AS structural,
  ends_with(normalised, 'DATE') OR starts_with(normalised, 'DT') OR contains(normalised, 'DTTM') OR ends_with(normalised, 'TIMESTAMP') AS raw_date FROM n""")
def name_leaks(spark, d):
    return K.leak_names(_name_rows(spark, d))


@query(NAMES_SQL + """, u AS (SELECT "column", upper("column") AS n FROM c) SELECT "column",
 CASE WHEN starts_with(n, 'RA_') THEN 'RA' WHEN starts_with(n, 'DA_') THEN 'DA' WHEN starts_with(n, 'D_TA_') THEN 'D_TA' WHEN starts_with(n, 'AVG_') THEN 'AVG' WHEN starts_with(n, 'MAX_') THEN 'MAX' WHEN starts_with(n, 'MIN_') THEN 'MIN'
  WHEN starts_with(n, 'MM_') THEN 'MM' WHEN starts_with(n, 'TOT_') THEN 'TOT' WHEN starts_with(n, 'R_') THEN 'R' WHEN starts_with(n, 'D_') THEN 'D' END AS stat,
 CASE WHEN contains(n, 'CASH') THEN 'cash' WHEN contains(n, 'CHQ') THEN 'cheque' WHEN contains(n, 'UPI') THEN 'UPI' WHEN contains(n, 'ATM') THEN 'ATM' WHEN contains(n, 'ELEC_XFER') THEN 'online transfer (IMPS/NEFT/RTGS)'
  WHEN contains(n, 'POS_PYMT') THEN 'merchant payment' WHEN contains(n, 'NET_BNKING') THEN 'net banking' WHEN contains(n, 'MBNKING') THEN 'mobile banking' WHEN contains(n, 'BBPS') THEN 'bill payment' WHEN contains(n, 'APB') THEN 'Aadhaar Payment Bridge'
  WHEN contains(n, 'GST') THEN 'GST' WHEN contains(n, 'LOAN') THEN 'loan' WHEN contains(n, 'STDNG') THEN 'standing instruction' WHEN contains(n, 'NON_CASH_CHQ') THEN 'non-cash non-cheque' WHEN contains(n, 'CI') THEN 'customer-induced'
  WHEN contains(n, 'BI_FEES_CHRGS') THEN 'bank fees/charges' END AS channel,
 CASE WHEN contains(n, '_CR_') OR ends_with(n, '_CR') THEN 'CR' WHEN contains(n, '_DB_') OR ends_with(n, '_DB') THEN 'DB' END AS direction,
 coalesce(nullif(regexp_extract(n, '_L([0-9]+_[0-9]+D)$', 1), ''), nullif(regexp_extract(n, '_L([0-9]+D)$', 1), '')) AS "window" FROM u""")
def name_family(spark, d):
    return K.name_family(_name_rows(spark, d))


PART = ("DATA_MONTH", "RISK_LEVEL", "COUNT_ALERTS")


@query(DIRTY + " " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n_values, round(sum(CASE WHEN pos = 0 OR pos = n THEN n ELSE 0 END) / (SELECT count(*) FROM dirty), 6) AS purity, count(*) > 1 AND count(*) <= 60 AND round(sum(CASE WHEN pos = 0 OR pos = n THEN n ELSE 0 END) / (SELECT count(*) FROM dirty), 6) >= 0.98 AND max(CAST(pos = n AS INTEGER)) = 1 AND max(CAST(pos = 0 AS INTEGER)) = 1 AS is_partition FROM (SELECT {c}, count(*) AS n, sum(y) AS pos FROM dirty WHERE {c} IS NOT NULL GROUP BY {c})" for c in PART))
def partition_columns(spark, d):
    return K.partitions(_dirty(spark, d), "y", list(PART))


@query(DIRTY + ", r AS (SELECT y, row_number() OVER (ORDER BY user_id) AS place FROM dirty), a AS (SELECT (sum(place) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / CAST(sum(y) * (count(*) - sum(y)) AS DOUBLE) AS auc FROM r) SELECT round(auc, 6) AS auroc, round(2 * abs(auc - 0.5), 6) AS separation, round(2 * abs(auc - 0.5), 6) > 0.98 AS is_sorted FROM a")
def row_order(spark, d):
    return K.row_order(_dirty(spark, d), "y", "user_id")


@query(_each("SELECT C~ AS \"column\", round(avg(CAST(X IS NULL AS DOUBLE)) FILTER (y = 1), 6) AS blank_pos, round(avg(CAST(X IS NULL AS DOUBLE)) FILTER (y = 0), 6) AS blank_neg, abs(avg(CAST(X IS NULL AS DOUBLE)) FILTER (y = 1) - avg(CAST(X IS NULL AS DOUBLE)) FILTER (y = 0)) > 0.10 AS \"drop\" FROM dirty"))
def blank_rate_gap(spark, d):
    return K.blank_gap(_dirty(spark, d), "y", list(NUM))


@query(M[:-2] + " SELECT user_id, round(coalesce(VIEW_AMT_L7D, 0), 6) + 0.0 AS VIEW_AMT_L7D, round(coalesce(AVG_BAL_7DAYS, 0), 6) + 0.0 AS AVG_BAL_7DAYS, COUNT_ALERTS FROM mx")
def zero_fill(spark, d):
    return rounded(K.zero_fill(acct_matrix(spark, d).select("user_id", "VIEW_AMT_L7D", "AVG_BAL_7DAYS", "COUNT_ALERTS")))


@query(_each("SELECT C~ AS \"column\", round(avg(CAST(X IS NULL AS DOUBLE)), 6) AS missing, avg(CAST(X IS NULL AS DOUBLE)) > 0.5 AS \"drop\" FROM dirty"))
def sparse_columns(spark, d):
    return K.sparse(_dirty(spark, d), list(NUM))


CORR = tuple(c for c in NUM if c != "CONST_COL")


@query(_each("SELECT C~ AS \"column\", round(corr(CAST(X AS DOUBLE), CAST(y AS DOUBLE)), 6) + 0.0 AS corr, coalesce(abs(corr(CAST(X AS DOUBLE), CAST(y AS DOUBLE))) > 0.90, false) AS \"drop\" FROM dirty", CORR))
def target_correlation(spark, d):
    return rounded(K.target_correlation(_dirty(spark, d), "y", list(CORR)))


@query(_each("SELECT C~ AS \"column\", count(DISTINCT X) + max(CAST(X IS NULL AS INTEGER)) AS n_values, (count(DISTINCT X) + max(CAST(X IS NULL AS INTEGER)) <= 1) OR coalesce(var_pop(X) = 0, false) AS \"drop\" FROM dirty"))
def constant_columns(spark, d):
    return K.constant(_dirty(spark, d), list(NUM))


PAIR = ("TOT_TXNAMT_L7D", "AVG_BAL_7DAYS", "COPY_COL", "LEAK_COL", "BLANKY")
FILL = ", ".join(f"coalesce({c}, (SELECT avg({c}) FROM dirty)) AS {c}" for c in PAIR)


@query(DIRTY + f", f AS (SELECT {FILL} FROM dirty), c AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM f" for i, a in enumerate(PAIR) for b in PAIR[i + 1 :]) + ") SELECT a, b, corr, true AS \"drop\" FROM c WHERE abs(corr) > 0.98")
def collinear_pairs(spark, d):
    return K.collinear(_dirty(spark, d), "TOT_TXNAMT_L7D AVG_BAL_7DAYS COPY_COL LEAK_COL BLANKY".split())


SEP = ("LEAK_COL", "BLANKY", "COUNT_ALERTS")


@query(DIRTY + " " + " UNION ALL ".join(f"""SELECT "column", disjoint, max_share_gap, disjoint OR coalesce(max_share_gap > 0.95, false) AS separates FROM (SELECT '{c}' AS "column", coalesce(min(x) FILTER (p > 0) > max(x) FILTER (q > 0) OR max(x) FILTER (p > 0) < min(x) FILTER (q > 0), false) AS disjoint, CASE WHEN count(*) <= 20 THEN round(max(p / tp - q / tq), 6) END AS max_share_gap
 FROM (SELECT x, p, q, sum(p) OVER () AS tp, sum(q) OVER () AS tq FROM (SELECT CAST({c} AS DOUBLE) AS x, count(*) FILTER (y = 1) AS p, count(*) FILTER (y <> 1) AS q FROM dirty WHERE {c} IS NOT NULL GROUP BY 1)))""" for c in SEP))
def separation(spark, d):
    return K.separation(_dirty(spark, d), "y", list(SEP))


@query(DIRTY + " SELECT user_id, CAST(CASE RISK_LEVEL WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END AS DOUBLE) AS level FROM dirty")
def encode_ordinal(spark, d):
    return _dirty(spark, d).select("user_id", K.encode_ordinal(F.col("RISK_LEVEL"), K.ordinal_mapping(["LOW", "MEDIUM", "HIGH"])).alias("level"))


@query(DIRTY + " SELECT user_id, " + ", ".join(f"CAST(DATA_MONTH = 'M{i}' AS INTEGER) AS mg_DATA_MONTH_M{i}" for i in range(1, 5)) + " FROM dirty")
def encode_onehot(spark, d):
    return K.encode_onehot(_dirty(spark, d).select("user_id", "DATA_MONTH"), "DATA_MONTH")


@query(DIRTY + " " + " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS position, '{c}' AS \"column\", round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) + 0.0 AS median FROM dirty" for i, c in enumerate(NUM)))
def training_medians(spark, d):
    return rounded(K.training_medians(_dirty(spark, d), list(NUM)))


@query("SELECT * FROM (VALUES ('identifiers', 'ACCOUNT_NUMBER'), ('leak_names', 'DATA_MONTH'), ('blank_gap', 'BLANKY'), ('sparse', 'SPARSE_COL'), ('partitions', 'LEAK_COL'), ('constant', 'CONST_COL'), ('collinear', 'COPY_COL')) v(step, \"column\")")
def cleaned_matrix(spark, d):
    """The whole cleaning of the table with planted faults, with what it dropped by step: each fault by the step made for it."""
    _, report = K.hardened(_dirty(spark, d), "y", keep=("user_id",))
    return spark.createDataFrame([(step, c) for step, names in report.items() for c in names], "step string, column string")


# ------------------------------------------------------------------ exports
ATTR = "attr AS (SELECT id, f AS feature, CASE f WHEN 'amount' THEN round(p - 0.5, 4) WHEN 'hour' THEN round((hour(ts) - 12) / 24.0, 4) ELSE round((segment - 3) / 10.0, 4) END AS value FROM scored, (VALUES ('amount'), ('hour'), ('segment')) v(f))"


def _attr(spark, d):
    s = scored(spark, d)
    a = F.array(F.struct(F.lit("amount").alias("feature"), F.round(F.col("p") - 0.5, 4).alias("value")), F.struct(F.lit("hour").alias("feature"), F.round((F.hour("ts") - 12) / 24.0, 4).alias("value")), F.struct(F.lit("segment").alias("feature"), F.round((F.col("segment") - 3) / 10.0, 4).alias("value")))
    return s.select("id", F.explode(a).alias("a")).select("id", "a.*")


def _bands_hits(spark, d):
    b = _bands(spark, d)
    return b, b.select("id", F.when(F.col("id") % 3 == 0, "R01|R06").when(F.col("id") % 3 == 1, "R04").otherwise("").alias("rules_fired"))


ALERT_SQL = BAND_SQL + f""", {ATTR}, why0 AS (SELECT id, feature, value, row_number() OVER (PARTITION BY id ORDER BY abs(value) DESC, feature) AS place FROM attr WHERE value <> 0),
why AS (SELECT id, string_agg(feature || ' (' || CASE WHEN value > 0 THEN 'INCREASES_RISK' ELSE 'DECREASES_RISK' END || ')', ' ; ' ORDER BY place) AS top_reasons FROM why0 WHERE place <= 3 GROUP BY id),
top AS (SELECT b.id, b.risk_score, b.band, s.p FROM bands b JOIN scored s USING (id) WHERE band IN ('HIGH', 'MEDIUM') ORDER BY b.risk_score DESC, b.id LIMIT 500),
al AS (SELECT 'MG-' || upper(substr(sha256('ledgerloom|' || id || '|' || risk_score), 1, 12)) AS alert_id, 'ACCOUNT' AS entity_type, CAST(id AS VARCHAR) AS entity_ref, CAST(risk_score AS BIGINT) AS risk_score, round(p, 6) AS risk_probability, band AS risk_band, CAST(CASE band WHEN 'HIGH' THEN 1 ELSE 2 END AS BIGINT) AS priority,
 CASE id % 3 WHEN 0 THEN 'R01|R06' WHEN 1 THEN 'R04' ELSE 'ML' END AS scenario_codes, CASE id % 3 WHEN 0 THEN 'Pass-through account ; Structuring by ticket size' WHEN 1 THEN 'Cash-out dominance' ELSE 'Model-derived behavioural risk (no single rule fired)' END AS scenario_names, CAST(CASE id % 3 WHEN 0 THEN 2 ELSE 1 END AS BIGINT) AS n_scenarios, coalesce(top_reasons, '') AS top_reasons, 'ledgerloom' AS model_id, 'OPEN' AS disposition FROM top LEFT JOIN why USING (id))"""


def _alerts(spark, d):
    b, h = _bands_hits(spark, d)
    return E.alerts(b, h, E.reasons(_attr(spark, d)), "ledgerloom")


@query(ALERT_SQL + " SELECT * FROM al")
def export_alerts(spark, d):
    return _alerts(spark, d)


@query(ALERT_SQL + " SELECT alert_id, entity_ref FROM al")
def export_alert_ids(spark, d):
    return _alerts(spark, d).select("alert_id", "entity_ref")


@query(ALERT_SQL + " SELECT alert_id, entity_type, entity_ref, risk_score, risk_probability, risk_band, priority, scenario_codes AS scenarios, model_id, disposition FROM al")
def export_case_packs(spark, d):
    """Case packs, with their nested fields side by side."""
    return E.case_packs(_alerts(spark, d)).select("alert_id", "entity.*", "risk.*", F.concat_ws("|", "scenarios").alias("scenarios"), "audit.*")


@query(BAND_SQL + f", {ATTR}, r AS (SELECT id, feature, value, row_number() OVER (PARTITION BY id, value > 0 ORDER BY abs(value) DESC, feature) AS n FROM attr WHERE value <> 0), k AS (SELECT id, feature, row_number() OVER (PARTITION BY id ORDER BY CAST(value < 0 AS INTEGER), n) AS place FROM r WHERE (value > 0 AND n <= 4) OR (value < 0 AND n <= 2)), t AS (SELECT id, risk_score, band FROM bands ORDER BY risk_score DESC, id LIMIT 25) SELECT t.id, risk_score, band, string_agg(feature, '|' ORDER BY place) AS features FROM t LEFT JOIN k USING (id) GROUP BY ALL")
def export_account_cards(spark, d):
    return E.account_cards(_bands(spark, d), _attr(spark, d)).withColumn("features", F.concat_ws("|", "features"))


@query("SELECT 0 AS breaches")
def export_contract(spark, d):
    """The alerts keep their contract."""
    return spark.createDataFrame([(len(E.contract_breaches(_alerts(spark, d))),)], "breaches int")


@query(f"WITH {SCORED}, {ATTR}, r AS (SELECT id, feature, value, row_number() OVER (PARTITION BY id, value > 0 ORDER BY abs(value) DESC, feature) AS n FROM attr WHERE value <> 0), k AS (SELECT * FROM r WHERE (value > 0 AND n <= 4) OR (value < 0 AND n <= 2)) SELECT id, row_number() OVER (PARTITION BY id ORDER BY CAST(value < 0 AS INTEGER), n) AS place, feature, round(value, 6) AS value FROM k")
def export_reasons(spark, d):
    return E.account_reasons(_attr(spark, d)).withColumn("place", F.col("place").cast("long"))


@query(f"WITH {SCORED}, {ATTR} SELECT feature, round(avg(abs(value)), 6) AS mean_abs FROM attr GROUP BY 1")
def export_top_features(spark, d):
    return E.top_features(_attr(spark, d))


@query(f"WITH {SCORED} SELECT id, round(CASE WHEN p >= 0.3 THEN 0.5 + 0.5 * least(greatest((p - 0.3) / 0.7, 0), 1) ELSE 0.5 * least(greatest(p / 0.3, 0), 1) END, 6) AS is_mule FROM scored")
def export_rescale(spark, d):
    return scored(spark, d).select("id", F.round(E.align_to_half(F.col("p"), 0.3), 6).alias("is_mule"))


@query(HITS_SQL + f", e AS (SELECT y, unnest(fired) AS rule FROM h), m AS ({SCORE_RULE} FROM e, {TAIL} GROUP BY rule) SELECT rule, lift, CASE WHEN lift > 2 THEN 'useful signal' WHEN lift > 1 THEN 'weak signal, corroborate before acting' ELSE 'performs at or below the base rate on this data; informational only' END AS guidance FROM m")
def export_reliability(spark, d):
    return E.reliability(N.rule_metrics(_hits(spark, d)))


@query(BAND_SQL + " SELECT id, risk_score, band FROM bands ORDER BY risk_score DESC, id LIMIT 25 OFFSET 50")
def export_page(spark, d):
    return E.page(_bands(spark, d).select("id", "risk_score", "band"), 50, 25)
