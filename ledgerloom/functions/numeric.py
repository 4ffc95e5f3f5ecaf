"""Column expressions that stay defined where the inputs are not: zero divisors, nulls, ties."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def finite(x: Column) -> Column:
    """x as a double, null where it is no finite number (NaN is larger than infinity here)."""
    x = x.cast("double")
    return F.when(F.abs(x) < F.lit(float("inf")), x)


def div(n: Column, d: Column) -> Column:
    """n / d, null where d is 0 or null (ANSI mode raises on /0)."""
    return n.cast("double") / F.nullif(d.cast("double"), F.lit(0.0))


def div0(n: Column, d: Column, default: float = 0.0) -> Column:
    return F.coalesce(div(n, d), F.lit(default))


def damped(n: Column, d: Column) -> Column:
    """n / (|d| + 1), the account-matrix ratio; 0 where undefined."""
    return F.coalesce(n.cast("double") / (F.abs(d.cast("double")) + 1), F.lit(0.0))


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def either_null(a: Column, b: Column, then: Column) -> Column:
    """then, but null if a or b is: least and greatest skip nulls."""
    return F.when(a.isNull() | b.isNull(), F.lit(None)).otherwise(then)


RANGES, TIE_RANGES = 1024, 64


def _number(df: DataFrame, column: str) -> Column:
    """A double in the order of the column: of a string its first six bytes."""
    if dict(df.dtypes)[column] != "string":
        return F.col(column).cast("double")
    return F.conv(F.rpad(F.substring(F.hex(column), 1, 12), 12, "0"), 16, 10).cast("double")


def _cuts(df: DataFrame, column: str, ranges: int) -> list[float]:
    """At most `ranges` - 1 approximate quantiles, read at once."""
    found = df.agg(F.percentile_approx(_number(df, column), [i / ranges for i in range(1, ranges)], 10_000)).first()[0]
    return sorted(set(found or []))


def _place(df: DataFrame, column: str, cuts: list[float], out: str) -> DataFrame:
    from pyspark.ml.feature import Bucketizer

    inf = float("inf")
    d = df.withColumn("_value", _number(df, column))
    return Bucketizer(splits=[-inf, *[c for c in cuts if abs(c) < inf], inf], inputCol="_value", outputCol=out, handleInvalid="keep").transform(d).drop("_value")


def ranged(df: DataFrame, column: str, ties: str | None = None) -> DataFrame:
    """df with _b and _c, the number of a range of `column` in its order.

    Ranges are cut at approximate quantiles, so they hold about equally many rows however the values lie. A value that is
    a cut has a range to itself; there _c deals the rows further by quantiles of `ties`, in that order. So no range
    grows with a value that most rows share. Elsewhere _c is 0.
    """
    cuts = _cuts(df, column, RANGES)
    if not cuts:
        return df.withColumn("_b", F.lit(0)).withColumn("_c", F.lit(0))
    d = _place(df, column, cuts, "_b")
    alone = F.coalesce(F.col(column).cast("double") == F.get(F.lit(cuts), F.col("_b").cast("int") - 1), F.lit(False))
    if ties:
        d = _place(d, ties, _cuts(df, ties, TIE_RANGES), "_c").withColumn("_c", F.when(alone, F.col("_c").cast("int")).otherwise(F.lit(0)))
    else:
        d = d.withColumn("_c", F.lit(0))
    return d.withColumn("_b", (2 * F.col("_b")).cast("int") + F.when(alone, 0).otherwise(1))


def _ranks(rows: DataFrame, key: str, names: list[str]) -> DataFrame:
    """key, column, twice, all: twice the rank of each value within its column (ties averaged, so twice is whole), and the column's count.

    Values are counted first, then numbered within ranges cut at approximate quantiles, so neither a whole column
    nor a value that most rows share is ever sorted in one task.
    """
    cells = rows.select(key, *names).unpivot([key], names, "column", "x").filter("x is not null")
    cuts = cells.groupBy("column").agg(F.percentile_approx("x", F.array(*[F.lit(i / 256) for i in range(1, 256)]), 1000).alias("q"))
    values = cells.groupBy("column", "x").agg(F.count("*").alias("n")).join(F.broadcast(cuts), "column")
    values = values.select("column", "x", "n", F.size(F.filter("q", lambda e: e < F.col("x"))).alias("range"))
    before = Window.partitionBy("column").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = values.groupBy("column", "range").agg(F.sum("n").alias("m"))
    ranges = ranges.select("column", "range", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("before"), F.sum("m").over(Window.partitionBy("column")).alias("all"))
    inside = Window.partitionBy("column", "range").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    ranks = values.join(ranges, ["column", "range"]).select("column", "x", (2 * below + F.col("n") + 1).alias("twice"), "all")
    return cells.join(ranks, ["column", "x"]).select(key, "column", "twice", "all")


def rank_shares(rows: DataFrame, key: str, names: list[str]) -> DataFrame:
    """key, column, share: rank over count of each value within its column, ties averaged; nulls have none and do not count."""
    return _ranks(rows, key, names).select(key, "column", (F.col("twice") / 2 / F.col("all")).alias("share"))


def rank_means(rows: DataFrame, key: str, names: list[str]) -> DataFrame:
    """key, mean: the mean rank share of each key.

    Shares are added as decimals of 19 places: a sum of doubles depends on the order in which the shares arrive, and its
    last bit decides which way a mean halfway between two roundings goes.
    """
    whole = lambda c: c.cast("decimal(18,0)")
    share = (whole(F.col("twice")) / whole(2 * F.col("all"))).cast("decimal(20,19)")
    return _ranks(rows, key, names).groupBy(key).agg(F.avg(share).cast("double").alias("mean"))


def quantiles(rows: DataFrame, names: list[str], probs: list[float]) -> DataFrame:
    """column, prob, value: exact quantiles of the finite values of each column, with lines between neighbours.

    Values are counted first and dealt to ranges cut at approximate quantiles; ranks are looked up in the counts of ranges, and only
    the ranges that hold one are numbered. So no task holds all values of a column. Columns without a value are absent.
    """
    cells = rows.select(*[finite(F.col(f"`{c}`")).alias(c) for c in names]).unpivot([], names, "column", "x").filter("x is not null")
    values = cells.groupBy("column", "x").agg(F.count("*").alias("n"))
    cuts = cells.groupBy("column").agg(F.percentile_approx("x", F.array(*[F.lit(i / 128) for i in range(1, 128)]), 1000).alias("q"))
    values = values.join(F.broadcast(cuts), "column").select("column", "x", "n", F.size(F.filter("q", lambda e: e < F.col("x"))).alias("range"))
    before, every = Window.partitionBy("column").orderBy("range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("column")
    ranges = values.groupBy("column", "range").agg(F.sum("n").alias("m"))
    ranges = ranges.select("column", "range", "m", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("before"), F.sum("m").over(every).alias("all"))
    at = F.col("prob") * (F.col("all") - 1)
    ranks = ranges.select("column", F.col("all"), F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob")).distinct()
    ranks = ranks.select("column", "prob", at.alias("at"), F.explode(F.array_distinct(F.array(F.floor(at), F.ceil(at)))).alias("rank"))
    held = ranks.join(ranges.select("column", "range", "m", "before"), "column").filter((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("m")))
    # a range is numbered once, whatever the number of ranks in it
    some = values.join(F.broadcast(held.select("column", "range", "before").distinct()), ["column", "range"])
    up = Window.partitionBy("column", "range").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    some = some.withColumn("first", F.col("before") + F.coalesce(F.sum("n").over(up), F.lit(0)))
    found = some.select("column", "range", "x", "n", "first").join(F.broadcast(held.select("column", "range", "prob", "at", "rank")), ["column", "range"]).filter((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n")))
    lo, hi = F.min_by("x", "rank"), F.max_by("x", "rank")
    value = F.when(F.min("rank") == F.max("rank"), lo).otherwise((F.max("rank") - F.max("at")) * lo + (F.max("at") - F.min("rank")) * hi)
    return found.groupBy("column", "prob").agg(value.alias("value"))


def near_any(amount: Column, limits: tuple[float, ...], band: float = 0.10) -> Column:
    """In the band just below any of the limits."""
    out = F.lit(False)
    for t in limits:
        out = out | ((amount >= t * (1 - band)) & (amount < t))
    return out
