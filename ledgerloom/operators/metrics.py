"""Ranking metrics on scored rows (id, y, p with p in 0..1), exact, without a global sort in one task.

Running counts are built from ranges of scores that hold about equally many rows (`numeric.ranged`): counts by range are few
rows, and rows are numbered within their range only.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.numeric import div0, quantiles, ranged
from ledgerloom.sources.io import written

REVIEWS_PER_DAY = 40


def ranked(scored: DataFrame) -> DataFrame:
    """scored with rank: 1 for the largest p, ties by id. Rows of a p that most share are dealt by id, so no task holds them all."""
    s = ranged(scored.withColumn("_neg", -F.col("p")), "_neg", "id")
    n = s.groupBy("_b", "_c").agg(F.count("*").alias("_n"))
    above = Window.orderBy("_b", "_c").rowsBetween(Window.unboundedPreceding, -1)
    n = n.select("_b", "_c", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_above"))
    inside = Window.partitionBy("_b", "_c").orderBy("_neg", "id")
    return s.join(n, ["_b", "_c"]).withColumn("rank", F.col("_above") + F.row_number().over(inside)).drop("_b", "_c", "_above", "_neg")


def curve(scored: DataFrame) -> DataFrame:
    """Per distinct p: n, pos, and cum_n, cum_pos of the rows at or above it, with the totals all_n and all_pos."""
    d = written(scored.groupBy("p").agg(F.count("*").alias("n"), F.sum("y").cast("long").alias("pos")), "curve")
    d = ranged(d, "p").drop("_c")
    by = d.groupBy("_b").agg(F.sum("n").alias("_n"), F.sum("pos").alias("_p"))
    above, every = Window.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    by = by.select("_b", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_an"), F.coalesce(F.sum("_p").over(above), F.lit(0)).alias("_ap"), F.sum("_n").over(every).alias("all_n"), F.sum("_p").over(every).alias("all_pos"))
    inside = Window.partitionBy("_b").orderBy(F.desc("p"))
    d = d.join(by, "_b")
    return d.select("p", "n", "pos", (F.col("_an") + F.sum("n").over(inside)).alias("cum_n"), (F.col("_ap") + F.sum("pos").over(inside)).alias("cum_pos"), "all_n", "all_pos")


def auroc(scored: DataFrame) -> DataFrame:
    """One row: auroc, ties averaged; null for a single class."""
    neg = F.col("n") - F.col("pos")
    below = (F.col("all_n") - F.col("all_pos")) - (F.col("cum_n") - F.col("cum_pos"))
    won = F.sum(F.col("pos") * (below + neg / 2.0))
    return curve(scored).agg((won / F.nullif((F.max("all_pos") * (F.max("all_n") - F.max("all_pos"))).cast("double"), F.lit(0.0))).alias("auroc"))


def average_precision(scored: DataFrame) -> DataFrame:
    return curve(scored).agg(F.sum(F.col("pos") / F.nullif(F.col("all_pos"), F.lit(0)) * (F.col("cum_pos") / F.col("cum_n"))).alias("auprc"))


def confusion(scored: DataFrame, threshold: float) -> DataFrame:
    hit, y = F.col("p") >= threshold, F.col("y") == 1
    c = scored.agg(*[F.count(F.when(w, 1)).alias(n) for n, w in (("tp", hit & y), ("fp", hit & ~y), ("fn", ~hit & y), ("tn", ~hit & ~y))])
    precision, recall = div0(F.col("tp"), F.col("tp") + F.col("fp")), div0(F.col("tp"), F.col("tp") + F.col("fn"))
    base = (F.col("tp") + F.col("fn")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))
    return c.select("tp", "fp", "fn", "tn", F.round(precision, 4).alias("precision"), F.round(recall, 4).alias("recall"), F.round(div0(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 4).alias("f1"), F.round(div0(F.col("fp"), F.col("fp") + F.col("tn")), 4).alias("fpr"), F.round(div0(precision, base), 2).alias("lift"))


def pick_threshold(scored: DataFrame, target: float, support: int = 5) -> DataFrame:
    """threshold, reached: the largest recall at that precision and support, lowest threshold of equals; else best F1; .5 for one class."""
    c = curve(scored).withColumn("precision", F.col("cum_pos") / F.col("cum_n")).withColumn("recall", F.col("cum_pos") / F.nullif(F.col("all_pos"), F.lit(0)))
    ok = (F.col("precision") >= target) & (F.col("cum_pos") >= support)
    f1 = F.round(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + 1e-12), 12)
    best = c.agg(F.max(F.when(ok, F.struct(F.col("cum_pos"), (-F.col("p")).alias("m")))).alias("a"), F.max(F.struct(f1.alias("f"), (-F.col("p")).alias("m"))).alias("b"), F.max("all_pos").alias("k"), F.max("all_n").alias("n"))
    one = F.coalesce(F.col("k") == 0, F.lit(True)) | (F.col("k") == F.col("n"))
    return best.select(F.when(one, F.lit(0.5)).otherwise(F.coalesce(-F.col("a.m"), -F.col("b.m"))).alias("threshold"), (~one & F.col("a").isNotNull()).alias("reached"))


def folds(rows: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """rows with fold 0..k-1, exactly stratified by y: the place within the class in hash order, numbered by hash range."""
    h = F.md5(F.concat(F.col("id").cast("string"), F.lit(f":{seed}")))
    r = rows.withColumn("_h", h).withColumn("_b", F.substring("_h", 1, 3))
    n = r.groupBy("y", "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("y").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    n = n.select("y", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.row_number().over(Window.partitionBy("y", "_b").orderBy("_h", "id")) - 1
    return r.join(n, ["y", "_b"]).withColumn("fold", (place % k).cast("int")).drop("_h", "_b", "_before")


def _top(scored: DataFrame, sizes: DataFrame) -> DataFrame:
    """sizes: label columns and k -> for each, hits among the k best, with totals. Counts by rank, so each row is used once a size."""
    r = ranked(scored).select("rank", "y")
    every = scored.agg(F.count("*").alias("all_n"), F.sum("y").cast("long").alias("all_pos"))
    j = r.join(F.broadcast(sizes), r["rank"] <= sizes["k"])
    return j.groupBy(*sizes.columns).agg(F.count("*").alias("taken"), F.sum("y").cast("long").alias("hits")).crossJoin(F.broadcast(every))


def _sizes(df: DataFrame, rows: list[tuple], names: list[str]) -> DataFrame:
    return df.sparkSession.createDataFrame(rows, names)


def at_k(scored: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """k, hits, precision (over k), recall, lift, analyst_days."""
    t = _top(scored, _sizes(scored, [(int(k),) for k in ks], ["k"]))
    precision = F.col("hits") / F.least("k", "all_n")
    return t.select("k", "hits", F.round(precision, 4).alias("precision"), F.round(div0(F.col("hits"), F.col("all_pos")), 4).alias("recall"), F.round(div0(precision, F.col("all_pos") / F.col("all_n")), 2).alias("lift"), F.round(F.col("k") / REVIEWS_PER_DAY, 1).alias("analyst_days"))


def budgets(scored: DataFrame, shares: tuple[float, ...], up: bool) -> DataFrame:
    """share, k, hits, recall, precision for the top share of rows: k rounded up, or half to even."""
    n = scored.count()
    k = (lambda s: -int(-(n * s) // 1)) if up else (lambda s: round(n * s))
    t = _top(scored, _sizes(scored, [(s, max(1, int(k(s)))) for s in shares], ["share", "k"]))
    return t.select("share", "k", "hits", F.round(div0(F.col("hits"), F.col("all_pos")), 4).alias("recall"), F.round(F.col("hits") / F.col("k"), 4).alias("precision"))


#: Fixed edges of the calibration table.
CALIBRATION = (0.0, 0.001, 0.01, 0.05, 0.1, 0.3, 0.5, 0.7, 0.9, 1.0001)


def calibration(scored: DataFrame) -> DataFrame:
    band = F.lit(0)
    for i, e in enumerate(CALIBRATION[1:-1], 1):
        band = F.when(F.col("p") >= e, F.lit(i)).otherwise(band)
    return scored.groupBy(band.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("mean_p"), F.round(F.avg(F.col("y").cast("double")), 6).alias("observed"))


def banded(scored: DataFrame, low: float, medium: float, graph: str | None = None) -> DataFrame:
    """scored with risk_score (0..1000, blended with graph proximity if given) and band."""
    p = 0.85 * F.col("p") + 0.15 * F.col(graph) if graph else F.col("p")
    s = F.round(F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)) * 1000).cast("int")
    return scored.withColumn("risk_score", s).withColumn("band", F.when(F.col("risk_score") < low, "LOW").when(F.col("risk_score") < medium, "MEDIUM").otherwise("HIGH"))


def band_edges(by_fold: DataFrame, fallback: tuple[float, float] = (400.0, 750.0)) -> DataFrame:
    """low_max, medium_max, derived, degenerate: the mean thresholds of the folds (threshold_high, threshold_medium) times 1000, in order.

    Without folds the fallback, not derived. Thresholds that meet leave no middle band; that is said, not mended.
    """
    m = by_fold.agg(F.avg("threshold_high").alias("h"), F.avg("threshold_medium").alias("m"))
    lo, hi = F.least("h", "m") * 1000, F.greatest("h", "m") * 1000
    known = F.col("h").isNotNull() & F.col("m").isNotNull()
    return m.select(F.when(known, F.round(lo, 2)).otherwise(F.lit(fallback[0])).alias("low_max"), F.when(known, F.round(hi, 2)).otherwise(F.lit(fallback[1])).alias("medium_max"), known.alias("derived"), F.coalesce(known & (F.abs(hi - lo) < 1e-6), F.lit(False)).alias("degenerate"))


def band_load(bands: DataFrame) -> DataFrame:
    every = bands.agg(F.count("*").alias("_all"))
    g = bands.groupBy("band").agg(F.count("*").alias("accounts"), F.sum("y").cast("long").alias("mules")).crossJoin(F.broadcast(every))
    fp = F.col("accounts") - F.col("mules")
    return g.select("band", "accounts", "mules", fp.alias("false_positives"), F.round(1000 * fp / F.col("_all"), 2).alias("false_positives_per_1000"), F.round(F.col("mules") / F.col("accounts"), 4).alias("precision"), F.round(F.col("accounts") / REVIEWS_PER_DAY, 1).alias("analyst_days"))


def standing(rows: DataFrame, column: str) -> DataFrame:
    """rows with standing of the column against the population's median, 90th and 99th percentile."""
    q = quantiles(rows, [column], [0.5, 0.9, 0.99])
    q = q.agg(*[F.max(F.when(F.col("prob") == x, F.col("value"))).alias(f"_{n}") for n, x in (("med", 0.5), ("p90", 0.9), ("p99", 0.99))])
    v = F.col(column)
    text = F.when(v.isNull(), "no value recorded").when(v >= F.col("_p99"), "top 1% of all accounts").when(v >= F.col("_p90"), "top 10% of all accounts").when(v > F.col("_med"), "above the population median").otherwise("at or below the population median")
    return rows.crossJoin(F.broadcast(q)).withColumn("standing", text).drop("_med", "_p90", "_p99")


RANKED_SQL = "ranked AS (SELECT *, row_number() OVER (ORDER BY p DESC, id) AS rank FROM scored)"
CURVE_SQL = "d AS (SELECT p, count(*) AS n, sum(y) AS pos FROM scored GROUP BY p), curve AS (SELECT *, sum(n) OVER (ORDER BY p DESC) AS cum_n, sum(pos) OVER (ORDER BY p DESC) AS cum_pos, sum(n) OVER () AS all_n, sum(pos) OVER () AS all_pos FROM d)"
