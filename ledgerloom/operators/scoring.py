"""Scoring a table nobody has seen: by the fitted model where its columns are there, by a model of the shared columns, or by typology.

Without labels nothing here claims a precision. Column choice is made on names in the driver, everything else in one plan.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.numeric import div0, finite, rank_means
from ledgerloom.operators import learn, metrics, names, quality

# What a column name must hold, whether high (1) or low (-1) is suspicious, and the signal's name.
SIGNALS = (
    (("round",), 1, "round-amount_share"),
    (("rapid", "velocity", "burst"), 1, "burst_activity"),
    (("time_to_out", "outflow_hour"), -1, "hours_to_outflow"),
    (("benefic_conc", "concentration"), 1, "concentration"),
    (("kyc_risk", "risk_score"), 1, "the_institution's_own_risk_score"),
    (("account_age", "age_days"), -1, "account_age"),
    (("chargeback", "dispute"), 1, "chargebacks"),
    (("device_count", "ip_count"), 1, "device_and_IP_spread"),
    (("geographic_distance", "geo_dist"), 1, "geographic_distance_from_profile"),
    (("cash_deposit", "cash_in"), 1, "cash_deposits"),
)
# The share of a model's columns below which it is not used, the fewest shared columns to fit on, the matched
# columns below which a table is ranked by typology, and the bins of the cut.
COVERAGE_FLOOR, MIN_SHARED, MIN_MATCHED, BINS = 0.50, 5, 40, 64
ACTIONS = {
    "LOW": "No action — routine monitoring",
    "MEDIUM": "Enhanced monitoring + step-up authentication (OTP) on transfers",
    "HIGH": "Freeze outward transfers, escalate to AML desk, prepare STR",
}


def _number(column: str) -> Column:
    return finite(F.expr(f"try_cast(`{column}` AS double)"))


def typology(df: DataFrame, key: str) -> tuple[DataFrame, dict[str, str]]:
    """(key and the signals found, larger always more suspicious; signal -> column). Directions are fixed before any data is seen.

    Pass-through is what left over what arrived, 0 to 5, of the first total columns in and out; every other signal is the first
    column whose name holds one of its words and that has a number.
    """
    rest = [c for c in df.columns if c != key]
    filled = df.agg(*[F.count(_number(c)).alias(c) for c in rest]).first().asDict() if rest else {}
    made: dict[str, Column] = {}
    source: dict[str, str] = {}
    means = {c: names.meaning(c) for c in rest}
    total = lambda way: next((c for c in rest if means[c].get("stat") == "TOT" and means[c].get("direction") == way), None)
    arrived, left = total("credit"), total("debit")
    if arrived and left:
        made["passthrough"] = F.least(F.greatest(_number(left) / (_number(arrived) + 1e-9), F.lit(0.0)), F.lit(5.0))
        # least and greatest skip nulls
        made["passthrough"] = F.when(_number(left).isNotNull() & _number(arrived).isNotNull(), made["passthrough"])
        source |= {"passthrough (in)": arrived, "passthrough (out)": left}
    for words, direction, signal in SIGNALS:
        column = next((c for c in rest if any(w in c.lower() for w in words) and filled[c]), None)
        if column:
            made[signal] = _number(column) * direction
            source[signal] = f"{column} ({'high' if direction > 0 else 'low'} is suspicious)"
    return df.select(key, *[c.alias(n) for n, c in made.items()]), source


def rank_score(signals: DataFrame, key: str) -> DataFrame:
    """key, score: the mean rank share of each row's signals that are not null, in whatever order they arrive; 0 without any."""
    inner = [c for c in signals.columns if c != key]
    if not inner:
        return signals.select(key, F.lit(0.0).alias("score"))
    known = rank_means(signals, key, inner)
    return signals.select(key).join(known, key, "left").select(key, F.coalesce("mean", F.lit(0.0)).alias("score"))


def otsu(scored: DataFrame) -> DataFrame:
    """One row: threshold, separation of a whole score column, as for one account's days: a histogram of BINS rows, then prefix sums over it."""
    top = scored.agg(F.greatest(F.max("score"), F.lit(1e-9)).alias("hi"))
    binned = scored.crossJoin(F.broadcast(top)).withColumn("bin", F.least(F.floor(F.greatest(F.col("score"), F.lit(0.0)) / F.col("hi") * BINS), F.lit(BINS - 1)).cast("int"))
    h = binned.groupBy("bin").agg(F.count("*").alias("n"), F.max("hi").alias("hi")).withColumn("mid", (F.col("bin") + 0.5) * F.col("hi") / BINS)
    every, up = Window.partitionBy(), Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    h = h.withColumn("n1", F.sum("n").over(every)).withColumn("m1", F.sum(F.col("n") * F.col("mid")).over(every))
    h = h.withColumn("n0", F.sum("n").over(up)).withColumn("m0", F.sum(F.col("n") * F.col("mid")).over(up))
    right = F.col("n1") - F.col("n0")
    gap = F.col("m0") / F.col("n0") - (F.col("m1") - F.col("m0")) / right
    between = F.round(F.col("n0") / F.col("n1") * (right / F.col("n1")) * gap * gap, 12)
    best = h.agg(F.max(F.when(F.col("n0").isNotNull(), F.struct(between.alias("between"), (-F.col("bin")).alias("minus"), "mid"))).alias("b"), F.max("hi").alias("hi"))
    return best.select(F.round(F.coalesce("b.mid", F.col("hi") / 2), 12).alias("threshold"), F.coalesce("b.between", F.lit(0.0)).alias("separation"))


def ranking(df: DataFrame, key: str) -> tuple[DataFrame, dict[str, str]]:
    """(key, score, flagged; signal -> column): rows ranked by typology, flagged from the split of the scores on. A rank is no probability."""
    signals, source = typology(df, key)
    if not source:
        raise ValueError("no column carries a typology signal, so nothing here can be scored")
    scored = rank_score(signals, key)
    return scored.crossJoin(F.broadcast(otsu(scored))).select(key, "score", (F.col("score") >= F.col("threshold")).alias("flagged")), source


def shared(columns: list[str], known: list[str]) -> dict[str, str]:
    """Column of a table -> column of the training data, by exact name or without case and signs; each training column once."""
    by = {quality.plain(k): k for k in reversed(known)}
    out: dict[str, str] = {}
    for c in columns:
        k = c if c in known else by.get(quality.plain(c))
        if k and k not in out.values():
            out[c] = k
    return out


def fit_on_shared(train: DataFrame, target: str, df: DataFrame, key: str, trees: int = learn.TREES, k: int = 5) -> tuple[DataFrame, dict]:
    """(key, p; quality): a boosted model of exactly the shared columns, with its out-of-fold average precision on the training data."""
    pairs = shared([c for c in df.columns if c != key], [c for c in train.columns if c != target])
    if len(pairs) < MIN_SHARED:
        raise ValueError(f"only {len(pairs)} columns are shared, too few to fit on")
    inner = list(pairs.values())
    rows = train.select(F.monotonically_increasing_id().alias("id"), F.col(target).cast("int").alias("y"), *[_number(c).alias(c) for c in inner])
    scores = learn.cross_scores(rows, inner, k=k, trees=trees)
    ap = metrics.average_precision(scores).first()[0] or 0.0
    base = scores.agg(F.avg(F.col("y").cast("double"))).first()[0] or 0.0
    fill = learn.medians(rows, inner)
    model = learn._fit("gbt", learn.impute(rows, fill), inner, "y", trees)
    new = learn.impute(df.select(key, *[_number(c).alias(n) for c, n in pairs.items()]), fill)
    return learn._score(model, new, inner, "p").select(key, "p"), {"columns": list(pairs), "oof_auprc": round(ap, 4), "oof_lift": round(ap / base, 1) if base else 0.0}


@dataclass
class Scored:
    """mode: SCORE_ONLY, FITTED_ON_SHARED_COLUMNS or TYPOLOGY_RANKING. rows: key with p and band, p, or score and flagged."""

    mode: str
    rows: DataFrame
    matched: int
    expected: int
    detail: dict


def route(matched: int, expected: int, can_fit: bool) -> str:
    """Which way a table is scored: half of the model's columns are enough for the model; else shared columns, if there are labelled
    rows to fit on; else, with few matches, typology."""
    if matched / max(expected, 1) < COVERAGE_FLOOR and can_fit and matched >= MIN_SHARED:
        return "FITTED_ON_SHARED_COLUMNS"
    return "TYPOLOGY_RANKING" if matched < min(MIN_MATCHED, max(1, int(expected * COVERAGE_FLOOR))) else "SCORE_ONLY"


def score_table(df: DataFrame, key: str, model: "learn.Ensemble", train: DataFrame | None = None, target: str = "y", edges: tuple[float, float] = (400.0, 750.0), trees: int = learn.TREES) -> Scored:
    """Scores every row of an unlabelled table; never looks for a label."""
    pairs = shared([c for c in df.columns if c != key], model.names)
    mode = route(len(pairs), len(model.names), train is not None)
    if mode == "FITTED_ON_SHARED_COLUMNS":
        rows, detail = fit_on_shared(train, target, df, key, trees)
    elif mode == "TYPOLOGY_RANKING":
        rows, source = ranking(df, key)
        share = rows.agg(F.avg(F.col("flagged").cast("double"))).first()[0] or 0.0
        detail = {"columns_used": source, "flag_rate": round(share, 4), "caution": "over a fifth is flagged: work down the ranking to a review budget" if share > 0.2 else None}
    else:
        back = {k: c for c, k in pairs.items()}
        full = df.select(F.col(key), *[_number(back[n]).alias(n) if n in back else F.lit(None).cast("double").alias(n) for n in model.names])
        rows = metrics.banded(model.predict(full, key), *edges).select(key, "p", "risk_score", "band")
        detail = {"imputed": [n for n in model.names if n not in back], "not_recognised": [c for c in df.columns if c != key and c not in pairs]}
    return Scored(mode, rows, len(pairs), len(model.names), detail)


def score_account(payload: dict, model: "learn.Ensemble", spark, edges: tuple[float, float] = (400.0, 750.0)) -> dict:
    """One account given as name -> value: unknown and non-numeric names are listed, absent ones get the training medians."""
    used, ignored = {}, []
    for name, value in payload.items():
        column = shared([str(name)], model.names).get(str(name))
        try:
            if column is None:
                raise ValueError
            used[column] = float(value)
        except (TypeError, ValueError):
            ignored.append(str(name)[:64] if column is None else f"{str(name)[:64]} (not numeric)")
    row = spark.createDataFrame([(0, *[used.get(n) for n in model.names])], "id long, " + ", ".join(f"`{n}` double" for n in model.names))
    got = metrics.banded(model.predict(row, "id"), *edges).first()
    return {"risk_score": got.risk_score, "calibrated_probability": got.p, "band": got.band, "recommended_action": ACTIONS[got.band], "features_recognised": len(used), "features_ignored": ignored[:20], "features_imputed": len(model.names) - len(used)}


def detect_target(df: DataFrame, configured: str | None = None) -> dict:
    """labelled, target, why: whether a table carries a label, decided on its whole columns, not on its first rows."""
    try:
        target, how = quality.resolve_target(df, configured)
        return {"labelled": True, "target": target, "why": how}
    except ValueError as e:
        return {"labelled": False, "target": None, "why": str(e)}


def flag_rates(rows: DataFrame, by: str) -> DataFrame:
    """Per value of `by`: rows, flagged, rate of a ranking joined with a column."""
    g = rows.groupBy(by).agg(F.count("*").alias("n"), F.count(F.when(F.col("flagged"), 1)).alias("flagged"))
    return g.withColumn("rate", F.round(div0(F.col("flagged"), F.col("n")), 4))
