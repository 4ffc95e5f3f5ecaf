"""Alerts, case fields, reasons and score alignment for other systems."""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Scenario names by rule code.
SCENARIOS = {
    "R01": "Pass-through account",
    "R02": "Turnover disproportionate to balance",
    "R03": "Sudden account activation",
    "R04": "Cash-out dominance",
    "R05": "Single payment rail concentration",
    "R06": "Structuring by ticket size",
    "R07": "Nocturnal activity pattern",
    "R08": "Spike-and-drain balance profile",
    "R09": "Customer profile mismatch",
    "R10": "New account rapid turnover",
    "R11": "Pure pass-through, net flow near zero",
    "R12": "Conduit on a single rail",
    "ML": "Model-derived behavioural risk (no single rule fired)",
}
PRIORITY = {"HIGH": 1, "MEDIUM": 2, "LOW": 3}


def alert_id(model: str, entity: Column, score: Column, prefix: str = "MG-") -> Column:
    text = F.concat_ws("|", F.lit(model), entity.cast("string"), score.cast("string"))
    return F.concat(F.lit(prefix), F.upper(F.substring(F.sha2(text, 256), 1, 12)))


def _names(codes: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in SCENARIOS.items() for x in kv])
    return F.transform(codes, lambda c: F.coalesce(F.try_element_at(table, c), c))


def alerts(bands: DataFrame, hits: DataFrame, reasons: DataFrame, model: str, floor: str = "MEDIUM", limit: int = 500) -> DataFrame:
    """Flat alerts at or above a band, best first: ids, scenario codes and names, the first three reasons."""
    allowed = [b for b, p in PRIORITY.items() if p <= PRIORITY[floor]]
    top = bands.filter(F.col("band").isin(*allowed)).orderBy(F.desc("risk_score"), "id").limit(limit)
    j = top.join(hits.select("id", "rules_fired"), "id", "left").join(reasons.filter("place <= 3").groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), " ; ").alias("top_reasons")), "id", "left")
    codes = F.when(F.coalesce("rules_fired", F.lit("")) == "", F.array(F.lit("ML"))).otherwise(F.split("rules_fired", r"\|"))
    rank = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])
    return j.select(
        alert_id(model, F.col("id"), F.col("risk_score")).alias("alert_id"), F.lit("ACCOUNT").alias("entity_type"), F.col("id").cast("string").alias("entity_ref"), F.col("risk_score").cast("long").alias("risk_score"), F.round("p", 6).alias("risk_probability"),
        F.col("band").alias("risk_band"), rank[F.col("band")].cast("long").alias("priority"), F.concat_ws("|", codes).alias("scenario_codes"), F.concat_ws(" ; ", _names(codes)).alias("scenario_names"), F.size(codes).cast("long").alias("n_scenarios"),
        F.coalesce("top_reasons", F.lit("")).alias("top_reasons"), F.lit(model).alias("model_id"), F.lit("OPEN").alias("disposition"),
    )


#: What receiving systems may rely on: column, type, and what it holds.
CONTRACT = (
    ("alert_id", "string", "unique and the same on every run, so a case is updated, not doubled"),
    ("entity_type", "string", "ACCOUNT"),
    ("entity_ref", "string", "the account as it was supplied"),
    ("risk_score", "bigint", "0 to 1000: the calibrated probability times 1000"),
    ("risk_probability", "double", "0 to 1"),
    ("risk_band", "string", "LOW, MEDIUM or HIGH, from fitted edges"),
    ("priority", "bigint", "1 is first, by band"),
    ("scenario_codes", "string", "codes of the rules that fired, or ML"),
    ("scenario_names", "string", "their names"),
    ("n_scenarios", "bigint", "how many"),
    ("top_reasons", "string", "the three strongest reasons"),
    ("model_id", "string", "the model behind the score"),
    ("disposition", "string", "OPEN until somebody decides"),
)


def contract_breaches(flat: DataFrame) -> list[str]:
    """What alerts lack of the contract: columns, types, repeated ids, scores out of range."""
    kinds = dict(flat.dtypes)
    out = [f"{c} is {kinds.get(c, 'absent')}, not {t}" for c, t, _ in CONTRACT if kinds.get(c) != t]
    if not out:
        n = flat.agg(F.count("*").alias("n"), F.count_distinct("alert_id").alias("d"), F.count(F.when(~F.col("risk_score").between(0, 1000) | ~F.col("risk_probability").between(0, 1), 1)).alias("bad")).first()
        out = [f"{n.n - n.d} ids are repeated"] * (n.n != n.d) + [f"{n.bad} scores are out of range"] * (n.bad > 0)
    return out


def account_cards(bands: DataFrame, attributions: DataFrame, n: int = 25, k: int = 6) -> DataFrame:
    """The n accounts with the highest scores, each with its raising and lowering features in order."""
    top = bands.orderBy(F.desc("risk_score"), "id").limit(n).select("id", "risk_score", "band")
    why = account_reasons(attributions.join(F.broadcast(top.select("id")), "id", "left_semi"), k)
    why = why.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "feature"))), lambda x: x["feature"]).alias("features"))
    return top.join(why, "id", "left")


def case_packs(flat: DataFrame) -> DataFrame:
    """Alerts nested by purpose, for JSON sinks."""
    return flat.select("alert_id", F.struct("entity_type", "entity_ref").alias("entity"), F.struct("risk_score", "risk_probability", "risk_band", "priority").alias("risk"), F.split("scenario_codes", r"\|").alias("scenarios"), F.struct("model_id", "disposition").alias("audit"))


def reasons(attributions: DataFrame, k: int = 6) -> DataFrame:
    """attributions: id, feature, value -> the k largest by size, zeros left out: id, place, feature, value, direction, text."""
    w = Window.partitionBy("id").orderBy(F.desc(F.abs("value")), "feature")
    r = attributions.filter("value <> 0").withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)
    direction = F.when(F.col("value") > 0, "INCREASES_RISK").otherwise("DECREASES_RISK")
    return r.select("id", "place", "feature", F.round("value", 6).alias("value"), direction.alias("direction"), F.concat("feature", F.lit(" ("), direction, F.lit(")")).alias("text"))


def account_reasons(attributions: DataFrame, k: int = 6) -> DataFrame:
    """Cards: k - max(1, k // 3) raising features first, largest first, then the strongest lowering ones."""
    up = k - max(1, k // 3)
    w = Window.partitionBy("id", F.col("value") > 0).orderBy(F.desc(F.abs("value")), "feature")
    r = attributions.filter("value <> 0").withColumn("n", F.row_number().over(w))
    r = r.filter(F.when(F.col("value") > 0, F.col("n") <= up).otherwise(F.col("n") <= k - up))
    place = F.row_number().over(Window.partitionBy("id").orderBy((F.col("value") < 0).cast("int"), "n"))
    return r.select("id", place.alias("place"), "feature", F.round("value", 6).alias("value"))


def top_features(attributions: DataFrame, k: int = 20) -> DataFrame:
    g = attributions.groupBy("feature").agg(F.round(F.avg(F.abs("value")), 6).alias("mean_abs"))
    return g.orderBy(F.desc("mean_abs"), "feature").limit(k)


def align_to_half(p: Column, threshold: float) -> Column:
    """Monotone map that takes the threshold to 0.5."""
    lo = 0.5 * F.least(F.greatest(p / threshold, F.lit(0.0)), F.lit(1.0))
    hi = 0.5 + 0.5 * F.least(F.greatest((p - threshold) / max(1.0 - threshold, 1e-9), F.lit(0.0)), F.lit(1.0))
    return F.when(p >= threshold, hi).otherwise(lo)


# Patterns of identifier and score columns, in order of trust.
ID_COLUMNS = ("ACCOUNT_?ID", "ACCT_?ID", "ACCOUNT_?NUMBER", "CUSTOMER_?ID", "CUST_?ID", "ROW_?NUMBER", "ID")
SCORE_COLUMNS = ("CALIBRATED_PROBABILITY", "PROBABILITY", "IS_MULE", "SCORE", "RISK_SCORE", "P_.*")


def _named(columns: list[str], patterns: tuple[str, ...]) -> str | None:
    return next((c for p in patterns for c in columns if re.fullmatch(p, c.strip().upper())), None)


def build_submission(scores: DataFrame, threshold: float | None = 0.5) -> tuple[DataFrame, list[str]]:
    """(account_id, is_mule; warnings): the identifier and score columns are found by name; scores that are no probabilities are
    divided by their maximum; with a threshold they are mapped so that it lies at 0.5. Without an identifier rows are numbered from 1
    in the order in which they lie, which is said."""
    found, score, warnings = _named(scores.columns, ID_COLUMNS), _named(scores.columns, SCORE_COLUMNS), []
    if score is None:
        raise ValueError(f"no score column; one of {', '.join(SCORE_COLUMNS)} is expected")
    p = F.expr(f"try_cast(`{score}` AS double)")
    s = scores.agg(F.min(p).alias("lo"), F.max(p).alias("hi"), F.count(F.when(p.isNull() | F.isnan(p), 1)).alias("bad")).first()
    if s.bad:
        raise ValueError(f"{s.bad} rows have a score that is no number")
    if found is None:
        warnings.append("no identifier column: rows are numbered in order")
        rows = scores.select(F.monotonically_increasing_id().alias("_i"), p.alias("_p"))
        n = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        part = F.shiftright("_i", 33)
        before = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(n), F.lit(0)).alias("_before"))
        rows = rows.join(F.broadcast(before), part == F.col("_part")).select((F.col("_before") + F.col("_i").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("account_id"), "_p")
    else:
        rows = scores.select(F.col(f"`{found}`").alias("account_id"), p.alias("_p"))
    if s.hi is not None and (s.hi > 1.0 or s.lo < 0.0):
        warnings.append(f"{score} is no probability; divided by its maximum")
        rows = rows.withColumn("_p", F.col("_p") / F.lit(float(s.hi)))
    value = align_to_half(F.col("_p"), threshold) if threshold is not None else F.col("_p")
    return rows.select("account_id", F.round(value, 6).alias("is_mule")), warnings


def reliability(metrics: DataFrame) -> DataFrame:
    """rule, lift -> guidance (fixed texts)."""
    return metrics.select("rule", "lift", F.when(F.col("lift") > 2, "useful signal").when(F.col("lift") > 1, "weak signal, corroborate before acting").otherwise("performs at or below the base rate on this data; informational only").alias("guidance"))


def page(rows: DataFrame, offset: int, limit: int) -> DataFrame:
    return rows.orderBy(F.desc("risk_score"), "id").offset(offset).limit(limit)
