"""Account-matrix features: one expression a feature over a wide row, nothing shuffles."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.numeric import damped, either_null


def _c(n: str) -> Column:
    return F.nanvl(F.col(f"`{n}`").cast("double"), F.lit(None).cast("double"))


def _have(df: DataFrame, *names: str) -> bool:
    return all(n in df.columns for n in names)


def passthrough(df: DataFrame) -> dict[str, Column]:
    out = {}
    for d in (7, 14, 31):
        cr, db = f"TOT_TXNAMT_CR_L{d}D", f"TOT_TXNAMT_DB_L{d}D"
        if _have(df, cr, db):
            a, b = _c(cr), _c(db)
            out[f"mg_passthrough_{d}d"] = F.coalesce(either_null(a, b, F.least(a, b) / (F.greatest(a, b) + 1)), F.lit(0.0))
            out[f"mg_net_flow_{d}d"] = damped(a - b, a + b)
    return out


def turnover(df: DataFrame) -> dict[str, Column]:
    return {f"mg_turnover_over_balance_{d}d": damped(_c(f"TOT_TXNAMT_L{d}D"), _c(f"AVG_BAL_{d}DAYS")) for d in (7, 14, 31) if _have(df, f"TOT_TXNAMT_L{d}D", f"AVG_BAL_{d}DAYS")}


def burst(df: DataFrame) -> dict[str, Column]:
    pairs = {"mg_amount_burst_7v31": "TOT_TXNAMT", "mg_count_burst_7v31": "TOT_TXNS"}
    return {n: damped(_c(f"{s}_L7D") / 7, _c(f"{s}_L31D") / 31) for n, s in pairs.items() if _have(df, f"{s}_L7D", f"{s}_L31D")}


def cash_out(df: DataFrame, cash: str, atm: str, total: str, digital: tuple[str, ...]) -> dict[str, Column]:
    here = [_c(x) for x in digital if x in df.columns]
    both = F.aggregate(F.filter(F.array(*here), lambda x: x.isNotNull()), F.lit(0.0), lambda s, x: s + x)
    return {"mg_cash_out_share_7d": damped(_c(cash), _c(total)), "mg_atm_out_share_7d": damped(_c(atm), _c(total)), "mg_digital_in_cash_out_7d": damped(both, _c(cash))}


def channels(df: DataFrame, rails: tuple[str, ...]) -> dict[str, Column]:
    here = [F.abs(F.coalesce(_c(r), F.lit(0.0))) for r in rails if r in df.columns]
    if len(here) < 3:
        return {}
    total = here[0]
    for h in here[1:]:
        total = total + h
    shares = F.array(*[h / (total + 1) for h in here])
    return {
        "mg_channel_hhi_7d": F.aggregate(shares, F.lit(0.0), lambda s, x: s + x * x),
        "mg_channel_active_7d": F.size(F.filter(F.array(*here), lambda x: x > 0)).cast("double"),
        "mg_channel_top_share_7d": F.array_max(shares),
    }


def ticket(df: DataFrame) -> dict[str, Column]:
    return {f"mg_avg_ticket_{d}d": damped(_c(f"TOT_TXNAMT_L{d}D"), _c(f"TOT_TXNS_L{d}D")) for d in (7, 31) if _have(df, f"TOT_TXNAMT_L{d}D", f"TOT_TXNS_L{d}D")}


TIMES = ("MORNING", "AFTERNOON", "EVENING", "NIGHT")


def alert_time(df: DataFrame) -> dict[str, Column]:
    names = [t for t in TIMES if f"COUNT_ALERTS_{t}" in df.columns]
    out = {f"mg_alert_share_{t.lower()}": damped(_c(f"COUNT_ALERTS_{t}"), _c("COUNT_ALERTS")) for t in names if "COUNT_ALERTS" in df.columns}
    if len(names) >= 3:
        b = [F.greatest(F.coalesce(_c(f"COUNT_ALERTS_{t}"), F.lit(0.0)), F.lit(0.0)) for t in names]
        total = b[0]
        for x in b[1:]:
            total = total + x
        out["mg_alert_time_entropy"] = -F.aggregate(F.array(*[x / (total + 1) for x in b]), F.lit(0.0), lambda s, p: s + p * F.ln(p + 1e-9))
    return out


def balance(df: DataFrame) -> dict[str, Column]:
    return {f"mg_balance_volatility_{d}d": damped(_c(f"MAX_BAL_{d}DAYS") - _c(f"MIN_BAL_{d}DAYS"), _c(f"AVG_BAL_{d}DAYS")) for d in (7, 31) if _have(df, f"MAX_BAL_{d}DAYS", f"MIN_BAL_{d}DAYS", f"AVG_BAL_{d}DAYS")}


def occupation(df: DataFrame) -> dict[str, Column]:
    """Over columns F..._OCC, null-skipping."""
    names = [c for c in df.columns if c.startswith("F") and c.endswith("_OCC")]
    if not names:
        return {}
    v = F.filter(F.array(*[_c(n) for n in names]), lambda x: x.isNotNull())
    size = lambda x: F.transform(x, lambda e: F.abs(e))
    return {
        "mg_occ_deviation_mean": F.coalesce(F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(v), F.lit(0)), F.lit(0.0)),
        "mg_occ_deviation_max": F.coalesce(F.array_max(size(v)), F.lit(0.0)),
        "mg_occ_extreme_count": F.size(F.filter(size(v), lambda x: x > 3)).cast("double"),
    }


def row_profile(df: DataFrame, names: list[str]) -> dict[str, Column]:
    """Null-skipping mean, spread (population), max, min and range of a row; a null counts as not zero."""
    v = F.filter(F.array(*[_c(n) for n in names]), lambda x: x.isNotNull())
    n = F.nullif(F.size(v).cast("double"), F.lit(0.0))
    total = F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    square = F.aggregate(F.transform(v, lambda x: (x - total / n) * (x - total / n)), F.lit(0.0), lambda s, x: s + x)
    nonzero = F.size(F.filter(F.array(*[_c(x) for x in names]), lambda x: x.isNull() | (x != 0)))
    zero = F.lit(0.0)
    return {
        "mg_row_mean": F.coalesce(total / n, zero), "mg_row_std": F.coalesce(F.sqrt(square / n), zero), "mg_row_max": F.coalesce(F.array_max(v), zero), "mg_row_min": F.coalesce(F.array_min(v), zero),
        "mg_row_range": F.coalesce(F.array_max(v) - F.array_min(v), zero), "mg_row_nonzero_frac": nonzero / float(len(names)),
    }


def edge_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """column, edge: whole numbers in 0..n-1 with more than .3 n different values, so that they may name rows."""
    n = F.count("*")
    stats = [F.struct(F.lit(c).alias("column"), ((F.sum(F.when(_c(c) != F.floor(_c(c)), 1).otherwise(0)) == 0) & (F.min(_c(c)) >= 0) & (F.max(_c(c)) <= n - 1) & (F.count_distinct(_c(c)) > 0.3 * n)).alias("edge")) for c in names]
    return df.agg(F.array(*stats).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def features(df: DataFrame, rails: tuple[str, ...], cash: str, atm: str, total: str, digital: tuple[str, ...]) -> DataFrame:
    """df with all mg_ features whose inputs it has."""
    out = passthrough(df) | turnover(df) | burst(df) | cash_out(df, cash, atm, total, digital) | channels(df, rails) | ticket(df) | alert_time(df) | balance(df) | occupation(df)
    return df.withColumns(out)
