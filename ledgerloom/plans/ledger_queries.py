"""Queries on ledgers: features, motifs, graph, temporal localisation."""

from pyspark.sql import functions as F

from ledgerloom.operators import graph as G
from ledgerloom.operators import ledger as L
from ledgerloom.operators import motifs as M
from ledgerloom.operators import temporal as T
from ledgerloom.operators import unified as U
from ledgerloom.plans.registry import cols, query, rounded
from ledgerloom.sources.io import written
from ledgerloom.sources.views import ACCOUNT_VIEW, LEDGER_EV, LEDGER_ORD, account_view, ledger_ev, ledger_ord, table

EV = f"WITH {LEDGER_EV}, "
ORD = f"WITH {LEDGER_ORD}, "
FEAT = "WITH " + L.features_sql(LEDGER_EV)
SIDE = cols(double="sum mean max std round near night", long="n cp days", plain="account_id", time="first last")


@query(EV + L.PREP_SQL + f" SELECT {cols(double='amount', long='hour', plain='src dst is_round near_threshold is_night', date='day', time='ts')} FROM prep")
def ledger_prep_flags(spark, d):
    return rounded(L.prepare(ledger_ev(spark, d)))


@query(EV + L.PREP_SQL + ", " + L.side_sql("s", "src", "dst") + f" SELECT {SIDE} FROM s")
def ledger_side_out(spark, d):
    return rounded(L.sides(ledger_ev(spark, d)).filter("side = 'out'").drop("side"))


@query(EV + L.PREP_SQL + ", " + L.side_sql("s", "dst", "src") + f" SELECT {SIDE} FROM s")
def ledger_side_in(spark, d):
    return rounded(L.sides(ledger_ev(spark, d)).filter("side = 'in'").drop("side"))


@query(f"{FEAT} SELECT {cols(double='n_in n_out sum_in sum_out max_in max_out std_in std_out round_in near_out', plain='account_id', time='first_in last_out')} FROM sides")
def ledger_outer_join(spark, d):
    return rounded(L.joined_sides(ledger_ev(spark, d)).select("n_in", "n_out", "sum_in", "sum_out", "max_in", "max_out", "std_in", "std_out", "round_in", "near_out", "account_id", "first_in", "last_out"))


def _features(name: str, columns: str):
    @query(f"{FEAT} SELECT {cols(double=columns, plain='account_id')} FROM feat", name)
    def run(spark, d):
        return rounded(L.features(ledger_ev(spark, d)).select("account_id", *columns.split()))


_features("ledger_conduit", "passthrough net_flow turnover retention")
_features("ledger_traffic_shape", "txn_count in_out_ratio avg_ticket_in avg_ticket_out ticket_cv_in ticket_cv_out")
_features("ledger_counterparties", "counterparties txn_per_counterparty fan_in_ratio cp_in cp_out")
_features("ledger_burst", "active_days span_days burstiness txn_per_active_day")
_features("ledger_tradecraft", "round_share threshold_share night_share")
_features("ledger_features", " ".join(L.FEATURES))


@query(f"{EV}{ACCOUNT_VIEW} SELECT account_id, direction, count(*) AS n, round(sum(amount), 2) AS total FROM acct GROUP BY 1, 2")
def ledger_account_view(spark, d):
    return account_view(ledger_ev(spark, d)).groupBy("account_id", "direction").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("total"))


@query(f"{FEAT}, {L.blend_sql()} SELECT {cols(double='is_mule', plain='account_id')} FROM blend")
def ledger_rank_blend(spark, d):
    return rounded(L.rank_blend(L.features(ledger_ev(spark, d))))


@query(f"{FEAT}, {L.blend_sql()} SELECT {cols(double='is_mule', plain='account_id')} FROM blend ORDER BY round(is_mule, 9) DESC, account_id LIMIT 50")
def ledger_top50(spark, d):
    return rounded(L.rank_blend(L.features(ledger_ev(spark, d))).orderBy(F.desc(F.round("is_mule", 9)), "account_id").limit(50))


NETWORK_SQL = f"{FEAT}, " + ", ".join(x.replace("prep AS", "mprep AS").replace("FROM prep", "FROM mprep").replace("JOIN prep", "JOIN mprep") for x in (M.MOTIF_SQL, M.FANS_SQL, M.HUB_SQL, M.CHAIN_SQL, M.EVIDENCE_SQL)) + ", " + G.EDGES_SQL + ", " + G.ROLES_SQL


@query(NETWORK_SQL + """ SELECT f.account_id, round(CAST(f.passthrough AS DOUBLE), 6) AS passthrough, round(CAST(coalesce(e.score, 0) AS DOUBLE), 6) AS motif_score,
 CAST(f.account_id IN (SELECT account FROM fan_out) AS DOUBLE) AS motif_fan_out, CAST(f.account_id IN (SELECT account FROM fan_in) AS DOUBLE) AS motif_fan_in,
 CAST(f.account_id IN (SELECT account FROM hub) AS DOUBLE) AS motif_gather_scatter, CAST(f.account_id IN (SELECT b FROM chain) AS DOUBLE) AS motif_chain,
 CAST(coalesce(r.role, '') = 'RELAY' AS DOUBLE) AS role_relay, CAST(coalesce(r.role, '') = 'COLLECTOR' AS DOUBLE) AS role_collector, CAST(coalesce(r.role, '') = 'DISPERSER' AS DOUBLE) AS role_disperser, CAST(coalesce(r.role, '') = 'TERMINAL' AS DOUBLE) AS role_terminal
 FROM feat f LEFT JOIN evidence e ON e.account = f.account_id LEFT JOIN roles r ON r.account = f.account_id""")  # fmt: skip
def ledger_network_features(spark, d):
    """Behaviour with motif and role evidence; ring scores hang on communities, so unified_features has them."""
    led = written(ledger_ev(spark, d), "ledger")
    both = L.features(led).select("account_id", "passthrough").join(U.network(led, rings=False), "account_id", "left").fillna(0.0)
    return rounded(both)


@query()
def unified_features(spark, d):
    """The 28 behavioural and 10 network columns of each account."""
    return U.build(_planted(spark, d))


@query()
def unified_scores(spark, d):
    """The supervised scorer, fitted on one half of the accounts and applied to all."""
    f = written(U.build(_planted(spark, d)), "features").withColumn("y", (F.floor(F.col("account_id") / 6) % 4 == 0).cast("int"))
    return U.UnifiedScorer(trees=20).fit(f.filter("account_id % 2 = 0"), "y").predict(f)


# ------------------------------------------------------------------ motifs
MO = f"WITH {LEDGER_ORD}, {M.ALL_SQL} "
FAN = cols(double="total uniformity threshold_hugging", long="bucket legs", plain="account motif", time='"start" "end"', arrays="counterparties")


def _motif(spark, d, name):
    return rounded(M.detect(ledger_ord(spark, d))[name])


@query(MO + "SELECT bucket, count(*) AS n, round(sum(amount), 2) AS total FROM prep GROUP BY 1")
def motif_bucket(spark, d):
    return M.prepare(ledger_ord(spark, d)).groupBy("bucket").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("total"))


@query(MO + f"SELECT {FAN} FROM fan_out")
def motif_fan_out(spark, d):
    return _motif(spark, d, "fan_out")


@query(MO + f"SELECT {FAN} FROM fan_in")
def motif_fan_in(spark, d):
    return _motif(spark, d, "fan_in")


@query(MO + f"SELECT {cols(double='total conservation', long='bucket legs', plain='account motif')} FROM hub")
def motif_gather_scatter(spark, d):
    return _motif(spark, d, "gather_scatter")


@query(MO + f"SELECT {cols(double='amount_in amount_out relay_retention', long='bucket', plain='a b c')} FROM chain")
def motif_chain(spark, d):
    return _motif(spark, d, "chain")


@query(f"WITH {LEDGER_EV}, {M.ALL_SQL} SELECT {cols(double='score', plain='account')} FROM evidence")
def motif_scores(spark, d):
    return rounded(M.detect(ledger_ev(spark, d))["evidence"].select("account", "score"))


@query(MO + f"SELECT {cols(double='score', plain='account', arrays='tags')} FROM evidence")
def motif_evidence(spark, d):
    return _motif(spark, d, "evidence")


@query(MO + "SELECT motif, account FROM fan_out UNION SELECT motif, account FROM fan_in UNION SELECT 'GATHER_SCATTER', account FROM hub UNION SELECT 'CHAIN', b FROM chain")
def motif_accounts(spark, d):
    return _motif(spark, d, "by_motif")


@query(MO + "SELECT 'fan_out' AS motif, count(*) AS n FROM fan_out UNION ALL SELECT 'fan_in', count(*) FROM fan_in UNION ALL SELECT 'gather_scatter', count(*) FROM hub UNION ALL SELECT 'chain', count(*) FROM chain")
def motif_counts(spark, d):
    return _motif(spark, d, "counts")


# ------------------------------------------------------------------ graph
GR = f"{ORD}{G.EDGES_SQL}, {G.ROLES_SQL}"
GROUPS_SQL = "groups AS (SELECT account, account % 40 AS grp FROM (SELECT src AS account FROM g UNION SELECT dst FROM g))"
SEEDS_SQL = "seeds AS (SELECT DISTINCT account FROM (SELECT src AS account FROM g UNION SELECT dst FROM g) WHERE account % 97 = 0)"


def _graph(spark, d):
    return G.collapse(ledger_ord(spark, d))


def _accounts(g):
    return g.select(F.explode(F.array("src", "dst")).alias("account")).distinct()


def _groups(g):
    return _accounts(g).withColumn("grp", F.col("account") % 40)


@query(f"{GR} SELECT src, dst, weight, round(amount, 2) AS amount FROM g")
def graph_edges(spark, d):
    return _graph(spark, d).withColumn("amount", F.round("amount", 2))


@query(f"{GR} SELECT account, ind, outd, round(inflow, 2) AS inflow, round(outflow, 2) AS outflow, role FROM roles")
def graph_roles(spark, d):
    return G.roles(_graph(spark, d)).withColumn("inflow", F.round("inflow", 2)).withColumn("outflow", F.round("outflow", 2))


@query(f"WITH {LEDGER_EV}, {G.EDGES_SQL}, {G.ROLES_SQL} SELECT role, count(*) AS n FROM roles GROUP BY 1")
def graph_role_counts(spark, d):
    return G.roles(G.collapse(ledger_ev(spark, d))).groupBy("role").agg(F.count("*").alias("n"))


@query(f"{GR}, {SEEDS_SQL}, {G.HOPS_SQL} SELECT {cols(double='score', long='hop', plain='account')} FROM hops")
def graph_propagation(spark, d):
    g = _graph(spark, d)
    return rounded(G.propagate(g, _accounts(g).filter("account % 97 = 0")))


@query(f"{GR}, {SEEDS_SQL}, {G.HOPS_SQL}, truth AS (SELECT DISTINCT account FROM (SELECT src AS account FROM g UNION SELECT dst FROM g) WHERE account % 10 = 3 OR account % 97 = 0),"
       " by_hop AS (SELECT hop, count(*) AS reached, count(*) FILTER (account IN (SELECT account FROM truth)) AS hits FROM hops WHERE hop > 0 GROUP BY 1),"
       " cum AS (SELECT *, sum(reached) OVER (ORDER BY hop) AS cr, sum(hits) OVER (ORDER BY hop) AS ch, (SELECT count(*) FROM truth WHERE account NOT IN (SELECT account FROM h0)) AS total FROM by_hop)"
       " SELECT CAST(hop AS BIGINT) AS hop, reached, hits, round(hits / reached, 6) AS precision, round(ch / cr, 6) AS cum_precision, round(coalesce(ch / nullif(total, 0), 0), 6) AS cum_recall FROM cum")  # fmt: skip
def graph_hop_eval(spark, d):
    g = _graph(spark, d)
    acc = _accounts(g)
    return rounded(G.hop_evaluation(G.propagate(g, acc.filter("account % 97 = 0")), acc.filter("account % 10 = 3 or account % 97 = 0")))


SPARSE = "WITH ledger AS (SELECT o_custkey % 4000 AS src, l_partkey % 4000 AS dst, l_extendedprice AS amount, l_shipdate AS ts FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
BLOCKS = "groups AS (SELECT account, account // 20 AS grp FROM (SELECT src AS account FROM g UNION SELECT dst FROM g))"
RING = f"{SPARSE}, {G.EDGES_SQL}, {G.ROLES_SQL}, {BLOCKS}, {G.GROUP_SQL}"


def _sparse(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 4000).alias("src"))
    li = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_partkey") % 4000).alias("dst"), F.col("l_extendedprice").alias("amount"))
    return G.collapse(li.join(o, li["l_orderkey"] == o["o_orderkey"]))


def _blocks(g):
    return _accounts(g).withColumn("grp", F.floor(F.col("account") / 20))


@query(f"{RING} SELECT grp, size, internal, round(density, 6) AS density FROM dens")
def graph_density(spark, d):
    g = _sparse(spark, d)
    return rounded(G.density(g, _blocks(g)))


@query(f"{RING} SELECT grp, round(conductance, 6) AS conductance FROM cond")
def graph_conductance(spark, d):
    g = _sparse(spark, d)
    return rounded(G.conductance(g, _blocks(g)))


@query(f"{RING} SELECT grp, cycles FROM cycles")
def graph_cycles(spark, d):
    g = _sparse(spark, d)
    return G.cycles(g, _blocks(g))


@query(f"{RING} SELECT grp, round(inflow, 2) AS inflow, round(outflow, 2) AS outflow, round(passthrough, 6) AS passthrough FROM gpass")
def graph_group_passthrough(spark, d):
    g = _sparse(spark, d)
    return G.group_passthrough(g, _blocks(g)).select("grp", *[F.round(c, p).alias(c) for c, p in (("inflow", 2), ("outflow", 2), ("passthrough", 6))])


def _rings(spark, d):
    g = written(G.collapse(_planted(spark, d)), "graph")  # every part of the score reads it
    groups = written(_accounts(g).withColumn("grp", F.floor(F.col("account") / 6)), "groups")
    return G.ring_scores(g, groups), groups


def _planted(spark, d):
    """The events ledger with accounts dealt so that blocks of six trade mostly among themselves."""
    led = ledger_ev(spark, d)
    return led.select("src", (F.floor(F.col("src") / 6) * 6 + F.col("dst") % 6 + F.when(F.col("dst") % 11 == 0, 6).otherwise(0)).alias("dst"), "amount", "ts")


PLANTED = f"WITH {LEDGER_EV.replace('ledger AS', 'led0 AS')}, ledger AS (SELECT src, src // 6 * 6 + dst % 6 + CASE WHEN dst % 11 = 0 THEN 6 ELSE 0 END AS dst, amount, ts FROM led0), {G.EDGES_SQL}, {G.ROLES_SQL}, groups AS (SELECT account, account // 6 AS grp FROM (SELECT src AS account FROM g UNION SELECT dst FROM g)), {G.GROUP_SQL}"


@query(f"{PLANTED} SELECT * FROM rings")
def graph_ring_score(spark, d):
    return _rings(spark, d)[0]


@query(f"{PLANTED} SELECT account, max(score) AS ring_score FROM groups JOIN rings USING (grp) GROUP BY 1")
def graph_account_ring(spark, d):
    return G.account_ring(*_rings(spark, d))


@query(f"{ORD}{G.EDGES_SQL} SELECT src AS account FROM ledger WHERE amount > 95000 UNION SELECT dst FROM ledger WHERE amount > 95000")
def graph_label_side(spark, d):
    led = ledger_ord(spark, d).filter("amount > 95000")
    return led.select(F.explode(F.array("src", "dst")).alias("account")).distinct()


@query()
def graph_communities(spark, d):
    return G.candidate_groups(G.collapse(_planted(spark, d)))


@query()
def graph_community_rings(spark, d):
    g = written(G.collapse(_planted(spark, d)), "graph")
    return G.ring_scores(g, written(G.candidate_groups(g), "groups"))


CURVE_KS = "(VALUES (3), (5), (8), (10), (15), (20), (30), (50)) k(top_k)"


@query(PLANTED + f""", truth AS (SELECT account FROM groups WHERE grp % 4 = 0), placed AS (SELECT grp, row_number() OVER (ORDER BY score DESC, grp) AS place FROM rings),
 best AS (SELECT account, min(place) AS place FROM groups JOIN placed USING (grp) GROUP BY 1),
 curve AS (SELECT top_k, count(*) AS n, count(*) FILTER (account IN (SELECT account FROM truth)) AS hits FROM best, {CURVE_KS} WHERE place <= top_k AND top_k <= (SELECT max(place) FROM placed) GROUP BY 1)
 SELECT CAST(top_k AS INTEGER) AS top_k_rings, n AS accounts_surfaced, hits AS members_found, round(hits / n, 4) AS precision, round(hits / (SELECT count(*) FROM truth), 4) AS recall, round(n / greatest(hits, 1), 1) AS alerts_per_member FROM curve""")
def graph_ring_curve(spark, d):
    rings, groups = _rings(spark, d)
    return G.ring_curve(written(rings, "rings"), groups, groups.filter("grp % 4 = 0"))


@query(PLANTED.replace(", groups AS", ", seeds AS (SELECT DISTINCT account FROM (SELECT src AS account FROM g UNION SELECT dst FROM g) WHERE account % 37 = 0), groups AS") + f""", {G.HOPS_SQL}, ring AS (SELECT account, max(score) AS ring_score FROM groups JOIN rings USING (grp) GROUP BY 1)
 SELECT a.account, CAST(coalesce(h.score, 0) AS DOUBLE) AS graph_proximity, CAST(coalesce(r.ring_score, 0) AS DOUBLE) AS ring_score FROM (SELECT src AS account FROM g UNION SELECT dst FROM g) a LEFT JOIN hops h USING (account) LEFT JOIN ring r USING (account)""")
def graph_account_scores(spark, d):
    g = written(G.collapse(_planted(spark, d)), "graph")
    rings, groups = _rings(spark, d)
    return G.account_scores(g, _accounts(g).filter("account % 37 = 0"), rings, groups)


@query(f"{EV[:-2]}, flagged AS (SELECT src, dst, CASE WHEN amount > 150000 THEN 'large' ELSE 'night' END AS kind FROM ledger WHERE amount > 150000 OR hour(ts) < 2), both_ AS (SELECT src AS account, kind FROM flagged UNION SELECT dst, kind FROM flagged) SELECT account, string_agg(kind, '|' ORDER BY kind) AS typologies FROM both_ GROUP BY 1")
def graph_truth_sets(spark, d):
    large = F.col("amount") > 150000
    led = ledger_ev(spark, d).withColumn("flag", (large | (F.hour("ts") < 2)).cast("int")).withColumn("typology", F.when(large, "large").otherwise("night"))
    return rounded(G.laundering_truth(led))


@query("""WITH c AS (SELECT c_custkey - 1 AS src, unnest([CAST(floor(c_acctbal) AS BIGINT), CASE WHEN c_nationkey > 3 THEN c_nationkey * 7 END, c_custkey - 1]) AS dst FROM customer) SELECT src, dst, count(*) AS n FROM c WHERE dst BETWEEN 0 AND (SELECT count(*) FROM customer) - 1 AND src <> dst GROUP BY 1, 2""")
def graph_index_edges(spark, d):
    c = table(spark, d, "customer")
    rows = c.select((F.col("c_custkey") - 1).alias("row"), F.floor("c_acctbal").alias("a"), F.when(F.col("c_nationkey") > 3, F.col("c_nationkey") * 7).alias("b"), (F.col("c_custkey") - 1).alias("c"))
    return G.edges_of_columns(rows, "row", ["a", "b", "c"]).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query()
def graph_detect_rings(spark, d):
    """Rings end to end, from transfers to members."""
    found = G.detect_rings(_planted(spark, d))
    return found.rings.join(found.members.groupBy("grp").agg(F.array_sort(F.collect_list("account")).alias("members")), "grp")


# ------------------------------------------------------------------ temporal
TE = f"{EV}{ACCOUNT_VIEW}, {T.TEMPORAL_SQL} "


def _days(spark, d):
    return T.daily(account_view(ledger_ev(spark, d)))


@query(TE + f"SELECT {cols(double='credit debit', long='n_txn n_near_threshold n_round', plain='account_id', date='day')} FROM daily")
def temporal_daily(spark, d):
    return rounded(_days(spark, d))


@query(TE + f"SELECT {cols(double='z_n', plain='account_id', date='day')} FROM zn")
def temporal_robust_z(spark, d):
    return rounded(T.robust_z(_days(spark, d), z_n="n_txn").select("account_id", "day", "z_n"))


@query(TE + f"SELECT {cols(double='score', plain='account_id', date='day')} FROM susp")
def temporal_suspicion(spark, d):
    return rounded(T.suspicion(_days(spark, d)).select("account_id", "day", "score"))


@query(TE + f"SELECT {cols(double='threshold separation', plain='account_id')} FROM otsu")
def temporal_otsu(spark, d):
    return rounded(T.otsu(T.suspicion(_days(spark, d))))


@query(TE + f"SELECT {cols(double='strength', long='days', plain='account_id')}, strftime(start_, '%Y-%m-%d') AS \"start\", strftime(end_, '%Y-%m-%d') AS \"end\" FROM win")
def temporal_window(spark, d):
    s = written(T.suspicion(_days(spark, d)).select("account_id", "day", "score"), "scores")  # read twice
    return rounded(T.windows(s, T.otsu(s)))


RISK_SQL = "risk AS (SELECT DISTINCT account_id, round((account_id % 100) / 100.0, 4) AS is_mule FROM acct)"
FOUND_SQL = """seen AS (SELECT account_id, count(*) AS n_days_observed, sum(n_txn) AS txns FROM daily GROUP BY 1),
found AS (SELECT s.account_id, CASE WHEN ok THEN start_ END AS suspicious_start, CASE WHEN ok THEN end_ END AS suspicious_end, CASE WHEN ok THEN strength END AS window_strength, CASE WHEN ok AND start_ IS NOT NULL THEN round(separation, 6) END AS window_confidence, n_days_observed
  FROM (SELECT seen.*, txns >= 5 AND coalesce(is_mule, 1) >= 0.3 AS ok FROM seen LEFT JOIN risk USING (account_id)) s LEFT JOIN win USING (account_id) LEFT JOIN otsu USING (account_id))"""


def _risk(view):
    return view.select("account_id").distinct().withColumn("is_mule", F.round((F.col("account_id") % 100) / 100.0, 4))


def _found(spark, d):
    view = account_view(ledger_ev(spark, d))
    return T.detect(view, _risk(view), 0.3), _risk(view)


@query(TE + f", {RISK_SQL}, {FOUND_SQL} SELECT {cols(double='window_strength window_confidence', long='n_days_observed', plain='account_id', date='suspicious_start suspicious_end')} FROM found")
def temporal_detect(spark, d):
    return rounded(_found(spark, d)[0])


TRUTH_SQL = "truth AS (SELECT account_id, min(day) + CAST(account_id % 7 AS INTEGER) AS t0, min(day) + CAST(account_id % 7 + 9 AS INTEGER) AS t1 FROM daily GROUP BY 1)"
IOU_SQL = """ious AS (SELECT account_id, CASE WHEN suspicious_start IS NULL THEN 0.0 ELSE CAST(greatest(least(t1 + 1, suspicious_end + 1) - greatest(t0, suspicious_start), 0) AS DOUBLE)
 / ((t1 + 1 - t0) + (suspicious_end + 1 - suspicious_start) - greatest(least(t1 + 1, suspicious_end + 1) - greatest(t0, suspicious_start), 0)) END AS iou FROM truth LEFT JOIN found USING (account_id))"""


def _truth(spark, d):
    n = F.col("account_id") % 7
    t = _days(spark, d).groupBy("account_id").agg(F.min("day").alias("m"))
    return t.select("account_id", F.date_add("m", n.cast("int")).alias("suspicious_start"), F.date_add("m", (n + 9).cast("int")).alias("suspicious_end"))


@query(TE + f", {RISK_SQL}, {FOUND_SQL}, {TRUTH_SQL}, {IOU_SQL} SELECT account_id, round(iou, 6) AS iou FROM ious")
def temporal_iou(spark, d):
    t = _truth(spark, d).select("account_id", F.col("suspicious_start").alias("t0"), F.col("suspicious_end").alias("t1"))
    j = t.join(_found(spark, d)[0], "account_id", "left")
    return j.select("account_id", F.round(T.iou(F.col("suspicious_start"), F.col("suspicious_end"), F.col("t0"), F.col("t1")), 6).alias("iou"))


@query(TE + f", {RISK_SQL}, {FOUND_SQL}, {TRUTH_SQL}, {IOU_SQL} SELECT round(avg(iou), 6) AS mean_iou, round(quantile_cont(iou, 0.5), 6) AS median_iou, round(avg(CAST(iou > 0 AS DOUBLE)), 6) AS any_overlap, round(avg(CAST(iou >= 0.5 AS DOUBLE)), 6) AS share_half, count(*) AS accounts FROM ious")
def temporal_iou_summary(spark, d):
    return T.score_windows(_found(spark, d)[0], _truth(spark, d))


SUB_SQL = """sub AS (SELECT account_id, round(is_mule, 6) AS is_mule, CASE WHEN is_mule >= 0.5 THEN coalesce(strftime(suspicious_start, '%Y-%m-%dT00:00:00'), '') ELSE '' END AS suspicious_start,
 CASE WHEN is_mule >= 0.5 THEN coalesce(strftime(suspicious_end, '%Y-%m-%dT00:00:00'), '') ELSE '' END AS suspicious_end FROM risk LEFT JOIN found USING (account_id))"""


@query(TE + f", {RISK_SQL}, {FOUND_SQL}, {SUB_SQL} SELECT account_id, CAST(is_mule AS DOUBLE) AS is_mule, suspicious_start, suspicious_end FROM sub")
def temporal_submission(spark, d):
    found, risk = _found(spark, d)
    return T.submission(risk, found)


@query(TE + f""", {RISK_SQL}, {FOUND_SQL}, {SUB_SQL}, bad AS (SELECT CASE WHEN account_id % 50 = 0 THEN ' ' ELSE CAST(account_id // 2 * 2 AS VARCHAR) END AS account_id, is_mule * CASE WHEN account_id % 40 = 39 THEN 3 ELSE 1 END AS is_mule, suspicious_start,
 CASE WHEN account_id % 30 = 29 THEN 'soon' ELSE suspicious_end END AS suspicious_end FROM sub)
 SELECT account_id, 'blank id' AS problem FROM bad WHERE trim(account_id) = '' UNION ALL SELECT account_id, 'score out of range' FROM bad WHERE NOT is_mule BETWEEN 0 AND 1
 UNION ALL SELECT account_id, 'malformed time' FROM bad WHERE NOT regexp_full_match(suspicious_start, '(\\d{{4}}-\\d{{2}}-\\d{{2}}T\\d{{2}}:\\d{{2}}:\\d{{2}})?') OR NOT regexp_full_match(suspicious_end, '(\\d{{4}}-\\d{{2}}-\\d{{2}}T\\d{{2}}:\\d{{2}}:\\d{{2}})?')
 UNION ALL SELECT account_id, 'repeated id' FROM bad GROUP BY 1 HAVING count(*) > 1""")  # fmt: skip
def submission_validate(spark, d):
    found, risk = _found(spark, d)
    a = F.col("account_id")
    bad = T.submission(risk, found).select(F.when(a % 50 == 0, " ").otherwise((F.floor(a / 2) * 2).cast("string")).alias("account_id"), (F.col("is_mule") * F.when(a % 40 == 39, 3).otherwise(1)).alias("is_mule"), "suspicious_start", F.when(a % 30 == 29, "soon").otherwise(F.col("suspicious_end")).alias("suspicious_end"))
    return T.violations(bad)
