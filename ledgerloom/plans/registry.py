"""Named queries with the SQL that checks them."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under its name."""

    def keep(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return keep


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, timestamps and dates as text: values that two engines write alike."""
    out = []
    for c, kind in df.dtypes:
        col = F.col(f"`{c}`")
        if kind in ("double", "float"):
            # + 0.0 makes a negative zero positive
            col = F.round(col.cast("double"), places) + F.lit(0.0)
        elif kind in ("timestamp", "timestamp_ntz"):
            col = F.date_format(col, "yyyy-MM-dd HH:mm:ss")
        elif kind == "date":
            col = F.date_format(col, "yyyy-MM-dd")
        elif kind.startswith("array"):
            col = F.concat_ws("|", col.cast("array<string>"))
        elif kind in ("int", "smallint", "tinyint"):
            col = col.cast("long")
        out.append(col.alias(c))
    return df.select(*out)


def cols(double: str = "", long: str = "", plain: str = "", time: str = "", date: str = "", arrays: str = "", places: int = 6) -> str:
    """The select list that gives `rounded` in DuckDB."""
    out = [f"round(CAST({c} AS DOUBLE), {places}) + 0.0 AS {c}" for c in double.split()]
    out += [f"CAST({c} AS BIGINT) AS {c}" for c in long.split()]
    out += [c for c in plain.split()]
    out += [f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}" for c in time.split()]
    out += [f"strftime({c}, '%Y-%m-%d') AS {c}" for c in date.split()]
    out += [f"array_to_string({c}, '|') AS {c}" for c in arrays.split()]
    return ", ".join(out)
