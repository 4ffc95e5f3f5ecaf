"""When was an account misused: daily series, suspicion score, Otsu threshold, best window, overlap with the truth.

All steps are window functions over an account's observed days, so no account is ever gathered into Python.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.numeric import clip, div0, near_any
from ledgerloom.sources.io import written

#: Fixed values of the definitions.
STRUCTURING = (50_000, 100_000, 1_000_000)
ROUND_AMOUNTS = (1_000, 5_000, 10_000, 25_000, 50_000, 100_000)
MIN_DAYS, MIN_TXNS, BINS = 3, 5, 64
DAY = 86_400


def daily(view: DataFrame) -> DataFrame:
    """account_id, day, n_txn, credit, debit, n_near_threshold, n_round of the observed days."""
    if missing := [c for c in ("account_id", "ts", "amount", "direction") if c not in view.columns]:
        raise KeyError(f"transactions lack {', '.join(missing)}")
    amount = F.abs(F.col("amount").cast("double"))
    t = view.select("account_id", F.to_date(F.col("ts").cast("timestamp")).alias("day"), amount.alias("amount"), (F.upper(F.substring("direction", 1, 1)) == "C").alias("credit")).filter("day is not null")
    return t.groupBy("account_id", "day").agg(
        F.count("*").alias("n_txn"), F.sum(F.when(F.col("credit"), F.col("amount")).otherwise(0.0)).alias("credit"), F.sum(F.when(~F.col("credit"), F.col("amount")).otherwise(0.0)).alias("debit"),
        F.count(F.when(near_any(F.col("amount"), STRUCTURING), 1)).alias("n_near_threshold"), F.count(F.when(F.col("amount").isin(*[float(x) for x in ROUND_AMOUNTS]), 1)).alias("n_round"),
    )


def _acct():
    return Window.partitionBy("account_id")



def robust_z(days: DataFrame, **columns: str) -> DataFrame:
    """For each name=column: (x - median) / (1.4826 MAD) within the account; MAD 0: standard deviation; that 0: 1.

    All columns share two passes of the same window.
    """
    middle = lambda x: F.percentile(x, F.lit(0.5)).over(_acct())
    x = {n: F.col(c).cast("double") for n, c in columns.items()}
    d = days.withColumns({f"_med_{n}": middle(v) for n, v in x.items()} | {f"_sd_{n}": F.stddev_pop(v).over(_acct()) for n, v in x.items()})
    d = d.withColumns({f"_mad_{n}": 1.4826 * middle(F.abs(v - F.col(f"_med_{n}"))) for n, v in x.items()})

    def z(n: str) -> Column:
        scale = F.when(F.col(f"_mad_{n}") > 0, F.col(f"_mad_{n}")).when(F.col(f"_sd_{n}") > 0, F.col(f"_sd_{n}")).otherwise(F.lit(1.0))
        return (x[n] - F.col(f"_med_{n}")) / scale

    return d.withColumns({n: z(n) for n in x}).drop(*[f"{k}{n}" for n in x for k in ("_med_", "_sd_", "_mad_")])


def suspicion(days: DataFrame) -> DataFrame:
    """days with score: the mean of symmetry, volume burst, velocity burst, structuring and round shares, 12 places."""
    d = days.withColumn("_total", F.col("credit") + F.col("debit")).withColumn("_days", F.count("*").over(_acct()))
    d = robust_z(d, _zt="_total", _zn="n_txn")
    burst = lambda z: F.when(F.col("_days") > 2, clip(F.col(z) / 4.0, 0.0, 1.0)).otherwise(F.lit(0.0))
    per = F.greatest("n_txn", F.lit(1))
    s = div0(F.least("credit", "debit"), F.greatest("credit", "debit")) + burst("_zt") + burst("_zn") + F.col("n_near_threshold") / per + F.col("n_round") / per
    return d.withColumn("score", F.round(clip(s / 5.0, 0.0, 1.0), 12)).drop("_total", "_days", "_zt", "_zn")


def otsu(scores: DataFrame) -> DataFrame:
    """account_id, threshold, separation: the 64-bin split with the largest between-class variance, its first bin's middle.

    One exchange by account: all its steps are windows and aggregates over it.
    """
    top = F.greatest(F.max("score").over(_acct()), F.lit(1e-9))
    binned = scores.select("account_id", "score").withColumn("_hi", top).withColumn("bin", F.least(F.floor(F.col("score") / F.col("_hi") * BINS), F.lit(BINS - 1)).cast("int"))
    h = binned.groupBy("account_id", "_hi", "bin").agg(F.count("*").alias("n"))
    mid = (F.col("bin") + 0.5) * F.col("_hi") / BINS
    up = Window.partitionBy("account_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    h = h.withColumn("_nm", F.col("n") * mid).withColumn("_n", F.sum("n").over(_acct())).withColumn("_m", F.sum("_nm").over(_acct()))
    h = h.withColumn("_n0", F.sum("n").over(up)).withColumn("_m0", F.sum("_nm").over(up))
    n1 = F.col("_n") - F.col("_n0")
    gap = F.col("_m0") / F.col("_n0") - (F.col("_m") - F.col("_m0")) / n1
    h = h.withColumn("between", F.round(F.col("_n0") / F.col("_n") * (n1 / F.col("_n")) * gap * gap, 12))
    best = F.max(F.when(F.col("_n0").isNotNull(), F.struct(F.col("between"), (-F.col("bin")).alias("minus"), mid.alias("mid"))))
    x = h.groupBy("account_id").agg(best.alias("b"), F.max("_hi").alias("_hi"))
    return x.select("account_id", F.round(F.coalesce("b.mid", F.col("_hi") / 2), 12).alias("threshold"), F.coalesce("b.between", F.lit(0.0)).alias("separation"))


def _widened(s: Column, e: Column, i: str = "i") -> tuple[Column, Column]:
    """The interval s..e of one or two days as MIN_DAYS days where there are so many, each time by the larger neighbour.

    It is looked at from the row of day e, whose two neighbours on either side hold all days that it may take.
    """
    at = {-2: F.col("b2"), -1: F.col("b1"), 1: F.col("a1"), 2: F.col("a2")}

    def score(offset: Column) -> Column:
        out = F.lit(None).cast("double")
        for k, v in at.items():
            out = F.when(offset == k, v).otherwise(out)
        return out

    end = F.col(i)
    lo, hi = s, e
    for _ in range(MIN_DAYS - 1):
        left, right = score(lo - 1 - end), score(hi + 1 - end)
        short = hi - lo + 1 < MIN_DAYS
        go_left = short & left.isNotNull() & (right.isNull() | (left > right))
        go_right = short & ~go_left & right.isNotNull()
        lo, hi = F.when(go_left, lo - 1).otherwise(lo), F.when(go_right, hi + 1).otherwise(hi)
    return lo, hi


def windows(scores: DataFrame, thresholds: DataFrame) -> DataFrame:
    """account_id, start, end, days, strength: the interval of observed days with the largest sum of score - threshold.

    Prefix sums: the best end is the first maximum of the running sum less its running minimum, the best start the day
    after the last place of that minimum. Intervals of 1 or 2 days widen to 3, towards the larger neighbour. After the join with the
    thresholds everything happens in windows over an account.
    """
    order = Window.partitionBy("account_id").orderBy("day")
    to_now = order.rowsBetween(Window.unboundedPreceding, 0)
    d = scores.select("account_id", "day", "score").join(thresholds, "account_id").withColumn("x", F.round(F.col("score") - F.col("threshold"), 12))
    near = {"b1": F.lag("score", 1), "b2": F.lag("score", 2), "a1": F.lead("score", 1), "a2": F.lead("score", 2)}
    d = d.withColumns({"i": F.row_number().over(order), "p": F.round(F.sum("x").over(to_now), 9)} | {n: f.over(order) for n, f in near.items()})
    d = d.withColumn("q", F.coalesce(F.lag("p").over(order), F.lit(0.0)))
    low = F.min(F.struct(F.col("q"), (-F.col("i")).alias("minus"))).over(to_now)
    d = d.withColumn("low", low).withColumn("gain", F.round(F.col("p") - F.col("low.q"), 9))
    lo, hi = _widened(-F.col("low.minus"), F.col("i"))
    best = F.max(F.struct("gain", (-F.col("i")).alias("minus"), lo.alias("s"), hi.alias("e"))).over(_acct())
    d = d.withColumn("b", best).filter((F.col("b.gain") > 0) & F.col("i").between(F.col("b.s"), F.col("b.e")))
    return d.groupBy("account_id").agg(F.min("day").alias("start"), F.max("day").alias("end"), F.count("*").alias("days"), F.round(F.avg("score"), 4).alias("strength"))


def detect(view: DataFrame, risk: DataFrame | None = None, min_risk: float = 0.0) -> DataFrame:
    """account_id, suspicious_start, suspicious_end, window_strength, window_confidence, n_days_observed.

    Accounts below min_risk (an account without a risk counts as 1) or with fewer than 5 transactions get no window.
    Heavy work runs on the accounts that can get one. The daily series and the scores are written once to the shared folder.
    """
    days = written(daily(view), "days")
    seen = days.groupBy("account_id").agg(F.count("*").alias("n_days_observed"), F.sum("n_txn").alias("_txns"))
    if risk is not None:
        seen = seen.join(risk.select("account_id", F.col("is_mule").alias("_risk")), "account_id", "left")
    else:
        seen = seen.withColumn("_risk", F.lit(None).cast("double"))
    able = (F.col("_txns") >= MIN_TXNS) & (F.coalesce("_risk", F.lit(1.0)) >= min_risk)
    scores = suspicion(days.join(seen.filter(able).select("account_id"), "account_id", "left_semi"))
    scores = written(scores.select("account_id", "day", "score"), "scores")
    cut = written(otsu(scores), "cuts")
    w = windows(scores, cut).join(cut, "account_id")
    out = seen.join(w, "account_id", "left")
    return out.select("account_id", F.col("start").alias("suspicious_start"), F.col("end").alias("suspicious_end"), F.col("strength").alias("window_strength"), F.when(F.col("start").isNotNull(), F.round("separation", 6)).alias("window_confidence"), "n_days_observed")


def iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Overlap over union of closed day intervals in seconds; both absent 1, one absent 0, reversed bounds swapped."""
    sec = lambda c: F.unix_micros(c.cast("timestamp")) / F.lit(1e6)
    a0, a1 = F.least(sec(s1), sec(e1)), F.greatest(sec(s1), sec(e1)) + DAY
    b0, b1 = F.least(sec(s2), sec(e2)), F.greatest(sec(s2), sec(e2)) + DAY
    both = F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0.0))
    value = both / ((a1 - a0) + (b1 - b0) - both)
    return F.when(s1.isNull() & s2.isNull(), F.lit(1.0)).when(s1.isNull() | s2.isNull(), F.lit(0.0)).otherwise(value)


def score_windows(found: DataFrame, truth: DataFrame) -> DataFrame:
    """mean_iou, median_iou, any_overlap, share_half over the true accounts."""
    t = truth.select("account_id", F.col("suspicious_start").alias("ts0"), F.col("suspicious_end").alias("ts1")).filter("ts0 is not null")
    j = t.join(found.select("account_id", "suspicious_start", "suspicious_end"), "account_id", "left")
    j = j.select(iou(F.col("suspicious_start"), F.col("suspicious_end"), F.col("ts0"), F.col("ts1")).alias("iou"))
    return j.agg(F.round(F.avg("iou"), 6).alias("mean_iou"), F.round(F.percentile("iou", F.lit(0.5)), 6).alias("median_iou"), F.round(F.avg((F.col("iou") > 0).cast("double")), 6).alias("any_overlap"), F.round(F.avg((F.col("iou") >= 0.5).cast("double")), 6).alias("share_half"), F.count("*").alias("accounts"))


def submission(risk: DataFrame, found: DataFrame, threshold: float = 0.5) -> DataFrame:
    """account_id, is_mule, suspicious_start, suspicious_end as ISO text, blank below the threshold."""
    j = risk.join(found.select("account_id", "suspicious_start", "suspicious_end"), "account_id", "left")
    text = lambda c: F.when(F.col("is_mule") >= threshold, F.coalesce(F.date_format(F.col(c).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(""))).otherwise(F.lit("")).alias(c)
    return j.select("account_id", F.round("is_mule", 6).alias("is_mule"), text("suspicious_start"), text("suspicious_end"))


def violations(sub: DataFrame) -> DataFrame:
    """account_id, problem: blank and repeated ids, scores outside 0..1, malformed times."""
    iso = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})?$"
    problems = F.filter(F.array(
        F.when(F.col("account_id").isNull() | (F.trim(F.col("account_id").cast("string")) == ""), "blank id"),
        F.when(~F.col("is_mule").between(0, 1) | F.col("is_mule").isNull(), "score out of range"),
        F.when(~F.coalesce("suspicious_start", F.lit("")).rlike(iso) | ~F.coalesce("suspicious_end", F.lit("")).rlike(iso), "malformed time"),
    ), lambda x: x.isNotNull())
    row = sub.select(F.col("account_id").cast("string").alias("account_id"), F.explode(problems).alias("problem"))
    twice = sub.groupBy(F.col("account_id").cast("string").alias("account_id")).agg(F.count("*").alias("n")).filter("n > 1").select("account_id", F.lit("repeated id").alias("problem"))
    return row.unionByName(twice)


DAILY_SQL = """daily AS (SELECT account_id, CAST(ts AS DATE) AS day, count(*) AS n_txn, sum(CASE WHEN direction = 'C' THEN abs(amount) ELSE 0 END) AS credit, sum(CASE WHEN direction <> 'C' THEN abs(amount) ELSE 0 END) AS debit,
  count(*) FILTER ((abs(amount) >= 45000 AND abs(amount) < 50000) OR (abs(amount) >= 90000 AND abs(amount) < 100000) OR (abs(amount) >= 900000 AND abs(amount) < 1000000)) AS n_near_threshold,
  count(*) FILTER (abs(amount) IN (1000, 5000, 10000, 25000, 50000, 100000)) AS n_round FROM acct GROUP BY 1, 2)"""


def z_sql(name: str, src: str, x: str, out: str) -> str:
    return f"""{name}0 AS (SELECT *, quantile_cont(CAST({x} AS DOUBLE), 0.5) OVER (PARTITION BY account_id) AS med_{out} FROM {src}),
{name}1 AS (SELECT *, 1.4826 * quantile_cont(abs({x} - med_{out}), 0.5) OVER (PARTITION BY account_id) AS mad_{out}, stddev_pop({x}) OVER (PARTITION BY account_id) AS sd_{out} FROM {name}0),
{name} AS (SELECT *, ({x} - med_{out}) / (CASE WHEN mad_{out} > 0 THEN mad_{out} WHEN sd_{out} > 0 THEN sd_{out} ELSE 1 END) AS {out} FROM {name}1)"""


Z_SQL = z_sql("zt", "daily", "(credit + debit)", "z_total") + ", " + z_sql("zn", "zt", "n_txn", "z_n")
SUSPICION_SQL = """susp AS (SELECT account_id, day, n_txn, round(least(greatest((coalesce(least(credit, debit) / nullif(greatest(credit, debit), 0), 0)
  + CASE WHEN count(*) OVER (PARTITION BY account_id) > 2 THEN least(greatest(z_total / 4.0, 0), 1) ELSE 0 END + CASE WHEN count(*) OVER (PARTITION BY account_id) > 2 THEN least(greatest(z_n / 4.0, 0), 1) ELSE 0 END
  + n_near_threshold / greatest(n_txn, 1) + n_round / greatest(n_txn, 1)) / 5.0, 0), 1), 12) AS score FROM zn)"""
OTSU_SQL = """hist0 AS (SELECT account_id, score, greatest(max(score) OVER (PARTITION BY account_id), 1e-9) AS hi FROM susp),
hist AS (SELECT account_id, hi, bin, count(*) AS n, count(*) * ((bin + 0.5::DOUBLE) * hi / 64) AS nm FROM (SELECT account_id, hi, CAST(least(floor(score / hi * 64), 63) AS INTEGER) AS bin FROM hist0) GROUP BY account_id, hi, bin),
split AS (SELECT *, sum(n) OVER (PARTITION BY account_id) AS nall, sum(nm) OVER (PARTITION BY account_id) AS mall,
  sum(n) OVER (PARTITION BY account_id ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n0, sum(nm) OVER (PARTITION BY account_id ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m0 FROM hist),
betw AS (SELECT *, round(n0 / nall * ((nall - n0) / nall) * pow(m0 / n0 - (mall - m0) / (nall - n0), 2), 12) AS between_ FROM split WHERE n0 IS NOT NULL),
pick AS (SELECT account_id, bin, between_, (bin + 0.5::DOUBLE) * hi / 64 AS mid FROM betw QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY between_ DESC, bin) = 1),
otsu AS (SELECT h.account_id, round(coalesce(p.mid, h.hi / 2), 12) AS threshold, coalesce(p.between_, 0) AS separation FROM (SELECT account_id, max(hi) AS hi FROM hist0 GROUP BY 1) h LEFT JOIN pick p USING (account_id))"""
WINDOW_SQL = """ser AS (SELECT account_id, day, score, row_number() OVER (PARTITION BY account_id ORDER BY day) AS i, round(score - threshold, 12) AS x FROM susp JOIN otsu USING (account_id)),
pre AS (SELECT *, round(sum(x) OVER (PARTITION BY account_id ORDER BY day), 9) AS p FROM ser),
lagged AS (SELECT *, coalesce(lag(p) OVER (PARTITION BY account_id ORDER BY day), 0) AS q FROM pre),
lows AS (SELECT *, min(q) OVER (PARTITION BY account_id ORDER BY day) AS low FROM lagged),
ends AS (SELECT account_id, i AS e, low, round(p - low, 9) AS gain FROM lows QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY round(p - low, 9) DESC, i) = 1),
w0 AS (SELECT n.account_id, max(l.i) AS s, max(n.e) AS e FROM ends n JOIN lagged l ON l.account_id = n.account_id AND l.i <= n.e AND l.q = n.low WHERE n.gain > 0 GROUP BY 1),
w1 AS (SELECT w.account_id, CASE WHEN e - s + 1 < 3 AND l.score IS NOT NULL AND (r.score IS NULL OR l.score > r.score) THEN s - 1 ELSE s END AS s,
  CASE WHEN e - s + 1 < 3 AND NOT (l.score IS NOT NULL AND (r.score IS NULL OR l.score > r.score)) AND r.score IS NOT NULL THEN e + 1 ELSE e END AS e
  FROM w0 w LEFT JOIN ser l ON l.account_id = w.account_id AND l.i = s - 1 LEFT JOIN ser r ON r.account_id = w.account_id AND r.i = e + 1),
w2 AS (SELECT w.account_id, CASE WHEN e - s + 1 < 3 AND l.score IS NOT NULL AND (r.score IS NULL OR l.score > r.score) THEN s - 1 ELSE s END AS s,
  CASE WHEN e - s + 1 < 3 AND NOT (l.score IS NOT NULL AND (r.score IS NULL OR l.score > r.score)) AND r.score IS NOT NULL THEN e + 1 ELSE e END AS e
  FROM w1 w LEFT JOIN ser l ON l.account_id = w.account_id AND l.i = s - 1 LEFT JOIN ser r ON r.account_id = w.account_id AND r.i = e + 1),
win AS (SELECT w.account_id, min(day) AS start_, max(day) AS end_, count(*) AS days, round(avg(score), 4) AS strength FROM w2 w JOIN ser USING (account_id) WHERE i BETWEEN s AND e GROUP BY 1)"""
TEMPORAL_SQL = ", ".join([DAILY_SQL, Z_SQL, SUSPICION_SQL, OTSU_SQL, WINDOW_SQL])
