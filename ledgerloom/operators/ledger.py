"""Ledger features: one row an account with the 28 behavioural columns, from one scan of the transfers."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.numeric import clip, div0, finite, near_any, rank_shares

REQUIRED = ("src", "dst", "amount", "ts")
#: Fixed values of the feature definitions.
ROUND_AMOUNTS = (1_000, 5_000, 10_000, 25_000, 50_000, 100_000, 500_000)
THRESHOLDS = (10_000, 50_000, 100_000, 1_000_000)
NIGHT_HOURS = (0, 5)


def prepare(ledger: DataFrame) -> DataFrame:
    """Magnitudes and flags; rows without a timestamp go; a missing column raises."""
    if missing := [c for c in REQUIRED if c not in ledger.columns]:
        raise KeyError(f"ledger lacks {', '.join(missing)}")
    t = ledger.select("src", "dst", F.abs(finite(F.col("amount"))).alias("amount"), F.col("ts").cast("timestamp").alias("ts")).filter("ts is not null")
    hour = F.hour("ts")
    return t.withColumns({
        "day": F.to_date("ts"), "hour": hour, "is_round": F.col("amount").isin(*[float(x) for x in ROUND_AMOUNTS]),
        "near_threshold": near_any(F.col("amount"), THRESHOLDS), "is_night": hour.between(*NIGHT_HOURS),
    })


def sides(ledger: DataFrame) -> DataFrame:
    """Per (account_id, side): totals of what left (out) and what arrived (in)."""
    t = prepare(ledger)
    both = F.array(F.struct(F.col("src").alias("account_id"), F.col("dst").alias("other"), F.lit("out").alias("side")), F.struct(F.col("dst").alias("account_id"), F.col("src").alias("other"), F.lit("in").alias("side")))
    rows = t.select("amount", "day", "is_round", "near_threshold", "is_night", "ts", F.explode(both).alias("b")).select("*", "b.*")
    share = lambda c: F.avg(F.col(c).cast("double"))
    return rows.groupBy("account_id", "side").agg(
        F.count("*").alias("n"), F.sum("amount").alias("sum"), F.avg("amount").alias("mean"), F.max("amount").alias("max"), F.stddev_samp("amount").alias("std"),
        F.count_distinct("other").alias("cp"), F.count_distinct("day").alias("days"), share("is_round").alias("round"), share("near_threshold").alias("near"), share("is_night").alias("night"),
        F.min("ts").alias("first"), F.max("ts").alias("last"),
    )


STATS = ("n", "sum", "mean", "max", "std", "cp", "days", "round", "near", "night", "first", "last")
FEATURES = ("passthrough", "net_flow", "turnover", "retention", "txn_count", "in_out_ratio", "avg_ticket_in", "avg_ticket_out", "ticket_cv_in", "ticket_cv_out", "counterparties", "txn_per_counterparty", "fan_in_ratio", "active_days", "span_days", "burstiness", "txn_per_active_day", "round_share", "threshold_share", "night_share", "n_in", "n_out", "sum_in", "sum_out", "max_in", "max_out", "cp_in", "cp_out")


def joined_sides(ledger: DataFrame) -> DataFrame:
    """Both sides in one row an account; a side that is absent counts 0. A conditional aggregate, not an outer join."""
    cols = []
    for s in ("in", "out"):
        for c in STATS:
            v = F.max(F.when(F.col("side") == s, F.col(c)))
            cols.append((v if c in ("first", "last") else F.coalesce(v.cast("double"), F.lit(0.0))).alias(f"{c}_{s}"))
    return sides(ledger).groupBy("account_id").agg(*cols)


def features(ledger: DataFrame) -> DataFrame:
    f = joined_sides(ledger)
    c = F.col
    w = div0(c("n_in"), c("n_in") + c("n_out"), 0.5)
    first, last = F.least("first_in", "first_out"), F.greatest("last_in", "last_out")
    f = f.withColumns({
        "passthrough": div0(F.least("sum_in", "sum_out"), F.greatest("sum_in", "sum_out")),
        "net_flow": div0(c("sum_in") - c("sum_out"), c("sum_in") + c("sum_out")),
        "turnover": c("sum_in") + c("sum_out"),
        "retention": clip(div0(F.abs(c("sum_in") - c("sum_out")), c("sum_in"), 1.0), 0.0, 1.0),
        "txn_count": c("n_in") + c("n_out"),
        "in_out_ratio": clip(div0(c("n_in"), c("n_out")), 0.0, 50.0),
        "avg_ticket_in": c("mean_in"), "avg_ticket_out": c("mean_out"),
        "ticket_cv_in": div0(c("std_in"), c("mean_in")), "ticket_cv_out": div0(c("std_out"), c("mean_out")),
        "counterparties": c("cp_in") + c("cp_out"),
        "active_days": F.greatest("days_in", "days_out"),
        "span_days": F.coalesce((F.unix_micros(last) - F.unix_micros(first)) / F.lit(86400e6), F.lit(0.0)),
        "round_share": c("round_in") * w + c("round_out") * (1 - w),
        "threshold_share": c("near_in") * w + c("near_out") * (1 - w),
        "night_share": c("night_in") * w + c("night_out") * (1 - w),
    })
    f = f.withColumns({
        "txn_per_counterparty": div0(c("txn_count"), c("counterparties")),
        "fan_in_ratio": div0(c("cp_in"), c("counterparties")),
        "burstiness": clip(div0(c("active_days"), c("span_days"), 1.0), 0.0, 1.0),
        "txn_per_active_day": div0(c("txn_count"), c("active_days")),
    })
    return f.select("account_id", *[F.coalesce(finite(c(x)), F.lit(0.0)).alias(x) for x in FEATURES])


DIRECTIONAL = ("passthrough", "burstiness", "threshold_share", "round_share", "night_share", "txn_per_counterparty", "motif_score", "ring_score")


def rank_blend(frame: DataFrame) -> DataFrame:
    """Unlabelled fallback: the mean of rank shares of the directional columns and of inverted retention."""
    used = [F.round(c, 9) for c in DIRECTIONAL if c in frame.columns]
    if "retention" in frame.columns:
        used.append(F.round(1 - F.col("retention"), 9))
    names = [f"_r{i}" for i in range(len(used))]
    f = frame.select("account_id", *[u.alias(n) for u, n in zip(used, names, strict=True)])
    return rank_shares(f, "account_id", names).groupBy("account_id").agg(F.avg("share").alias("is_mule"))


# ---- the same in DuckDB's SQL
PREP_SQL = """prep AS (SELECT src, dst, abs(amount) AS amount, ts, CAST(ts AS DATE) AS day, hour(ts) AS hour,
  abs(amount) IN (1000, 5000, 10000, 25000, 50000, 100000, 500000) AS is_round,
  ((abs(amount) >= 9000 AND abs(amount) < 10000) OR (abs(amount) >= 45000 AND abs(amount) < 50000) OR (abs(amount) >= 90000 AND abs(amount) < 100000) OR (abs(amount) >= 900000 AND abs(amount) < 1000000)) AS near_threshold,
  hour(ts) BETWEEN 0 AND 5 AS is_night FROM ledger WHERE ts IS NOT NULL)"""


def side_sql(name: str, key: str, other: str) -> str:
    return f"""{name} AS (SELECT {key} AS account_id, count(*) AS n, sum(amount) AS sum, avg(amount) AS mean, max(amount) AS max, stddev_samp(amount) AS std,
  count(DISTINCT {other}) AS cp, count(DISTINCT day) AS days, avg(CAST(is_round AS DOUBLE)) AS round, avg(CAST(near_threshold AS DOUBLE)) AS near, avg(CAST(is_night AS DOUBLE)) AS night,
  min(ts) AS first, max(ts) AS last FROM prep GROUP BY {key})"""


JOIN_SQL = "sides AS (SELECT coalesce(i.account_id, o.account_id) AS account_id, " + ", ".join((f"i.{c} AS {c}_in, o.{c} AS {c}_out" if c in ("first", "last") else f"coalesce(CAST(i.{c} AS DOUBLE), 0) AS {c}_in, coalesce(CAST(o.{c} AS DOUBLE), 0) AS {c}_out") for c in STATS) + " FROM side_in i FULL OUTER JOIN side_out o ON i.account_id = o.account_id)"
FEATURE_SQL = """feat0 AS (SELECT *, coalesce(n_in / nullif(n_in + n_out, 0), 0.5) AS w,
  coalesce((epoch_us(greatest(last_in, last_out)) - epoch_us(least(first_in, first_out))) / 86400e6, 0) AS span_days, greatest(days_in, days_out) AS active_days FROM sides),
feat AS (SELECT account_id, coalesce(least(sum_in, sum_out) / nullif(greatest(sum_in, sum_out), 0), 0) AS passthrough,
  coalesce((sum_in - sum_out) / nullif(sum_in + sum_out, 0), 0) AS net_flow, sum_in + sum_out AS turnover,
  least(greatest(coalesce(abs(sum_in - sum_out) / nullif(sum_in, 0), 1), 0), 1) AS retention, n_in + n_out AS txn_count,
  least(greatest(coalesce(n_in / nullif(n_out, 0), 0), 0), 50) AS in_out_ratio, mean_in AS avg_ticket_in, mean_out AS avg_ticket_out,
  coalesce(std_in / nullif(mean_in, 0), 0) AS ticket_cv_in, coalesce(std_out / nullif(mean_out, 0), 0) AS ticket_cv_out, cp_in + cp_out AS counterparties,
  coalesce((n_in + n_out) / nullif(cp_in + cp_out, 0), 0) AS txn_per_counterparty, coalesce(cp_in / nullif(cp_in + cp_out, 0), 0) AS fan_in_ratio,
  active_days, span_days, least(greatest(coalesce(active_days / nullif(span_days, 0), 1), 0), 1) AS burstiness, coalesce((n_in + n_out) / nullif(active_days, 0), 0) AS txn_per_active_day,
  round_in * w + round_out * (1 - w) AS round_share, near_in * w + near_out * (1 - w) AS threshold_share, night_in * w + night_out * (1 - w) AS night_share,
  n_in, n_out, sum_in, sum_out, max_in, max_out, cp_in, cp_out FROM feat0)"""


def features_sql(ledger: str) -> str:
    return ", ".join([ledger, PREP_SQL, side_sql("side_out", "src", "dst"), side_sql("side_in", "dst", "src"), JOIN_SQL, FEATURE_SQL])


def blend_sql(names=("passthrough", "burstiness", "threshold_share", "round_share", "night_share", "txn_per_counterparty")) -> str:
    ins = ", ".join([f"round({n}, 9) AS r{i}" for i, n in enumerate(names)] + [f"round(1 - retention, 9) AS r{len(names)}"])
    one = "(rank() OVER (ORDER BY r{i}) + (count(*) OVER (PARTITION BY r{i}) - 1) / 2.0) / count(*) OVER ()"
    return f"pre AS (SELECT account_id, {ins} FROM feat), blend AS (SELECT account_id, ({' + '.join(one.format(i=i) for i in range(len(names) + 1))}) / {len(names) + 1} AS is_mule FROM pre)"
