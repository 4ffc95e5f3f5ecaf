"""Canonical inputs (ledger, account view, scored rows, account matrix) derived from the star-schema tables.

Each Spark view has a DuckDB text with the same meaning, for oracles.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ledger_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, amount, ts: one transfer an event."""
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "value", F.col("ts").cast("timestamp").alias("ts"))
    top = ev.agg((F.max("user_id") + 1).alias("n"))
    return ev.crossJoin(F.broadcast(top)).select(F.col("user_id").alias("src"), (F.col("event_id") % F.col("n")).alias("dst"), (F.round("value") * 1000).alias("amount"), "ts")


def ledger_ord(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, amount, ts: one transfer a line item, between 400 accounts."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 400).alias("src"))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") % 400).alias("dst"), F.col("l_extendedprice").alias("amount"), F.col("l_shipdate").cast("timestamp").alias("ts"))
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).select("src", "dst", "amount", "ts")


def account_view(ledger: DataFrame) -> DataFrame:
    """Two rows a transfer, from one scan: account_id, ts, amount, direction (D leaves, C arrives)."""
    sides = F.array(F.struct(F.col("src").alias("account_id"), F.lit("D").alias("direction")), F.struct(F.col("dst").alias("account_id"), F.lit("C").alias("direction")))
    return ledger.select("ts", "amount", F.explode(sides).alias("s")).select("s.account_id", "ts", "amount", "s.direction")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, y, p, segment: labelled probabilities."""
    ev = table(spark, sf_dir, "events")
    return ev.select(F.col("event_id").alias("id"), (F.col("event_type") == "error").cast("int").alias("y"), F.round(F.col("value") / (F.col("value") + 50), 4).alias("p"), (F.col("user_id") % 7).alias("segment"), "ts")


RAILS = ("view", "click", "signup", "purchase", "error")


def acct_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One wide row a user: windows of 7, 14 and 31 days back from the last event."""
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("value").alias("v"), F.col("ts").cast("timestamp").alias("ts"))
    last = ev.agg(F.max("ts").alias("end"))
    ev = ev.crossJoin(F.broadcast(last)).withColumn("age", (F.unix_micros("end") - F.unix_micros("ts")) / F.lit(86400e6))
    credit = F.col("event_type").isin("signup", "purchase")
    run = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ev = ev.withColumn("credit", credit).withColumn("bal", F.sum(F.when(credit, F.col("v")).otherwise(-F.col("v"))).over(run)).withColumn("hour", F.hour("ts"))
    aggs = []
    for d in (7, 14, 31):
        inside = F.col("age") < d
        total = lambda c=F.lit(True), i=inside: F.sum(F.when(i & c, F.col("v")))
        aggs += [total().alias(f"TOT_TXNAMT_L{d}D"), total(F.col("credit")).alias(f"TOT_TXNAMT_CR_L{d}D"), total(~F.col("credit")).alias(f"TOT_TXNAMT_DB_L{d}D"), F.count(F.when(inside, 1)).alias(f"TOT_TXNS_L{d}D")]
        aggs += [f(F.when(inside, F.col("bal"))).alias(f"{n}_BAL_{d}DAYS") for n, f in (("AVG", F.avg), ("MAX", F.max), ("MIN", F.min))]
    week = F.col("age") < 7
    for r in RAILS:
        aggs.append(F.sum(F.when(week & (F.col("event_type") == r), F.col("v"))).alias(f"{r.upper()}_AMT_L7D"))
    alert = F.col("event_type") == "error"
    aggs.append(F.count(F.when(alert, 1)).alias("COUNT_ALERTS"))
    for n, (a, b) in {"MORNING": (6, 12), "AFTERNOON": (12, 18), "EVENING": (18, 24), "NIGHT": (0, 6)}.items():
        aggs.append(F.count(F.when(alert & (F.col("hour") >= a) & (F.col("hour") < b), 1)).alias(f"COUNT_ALERTS_{n}"))
    return ev.groupBy("user_id").agg(*aggs).withColumn("y", (F.col("user_id") % 9 == 0).cast("int"))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "CONFIRMED").otherwise("DISMISSED").alias("outcome"))


LEDGER_EV = "ledger AS (SELECT user_id AS src, event_id % (SELECT max(user_id) + 1 FROM events) AS dst, round(value) * 1000 AS amount, ts FROM events)"
LEDGER_ORD = "ledger AS (SELECT o_custkey % 400 AS src, l_partkey % 400 AS dst, l_extendedprice AS amount, l_shipdate AS ts FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
ACCOUNT_VIEW = "acct AS (SELECT src AS account_id, ts, amount, 'D' AS direction FROM ledger UNION ALL SELECT dst, ts, amount, 'C' FROM ledger)"
SCORED = "scored AS (SELECT event_id AS id, CAST(event_type = 'error' AS INTEGER) AS y, round(value / (value + 50), 4) AS p, user_id % 7 AS segment, ts FROM events)"
DECISIONS = "decisions AS (SELECT doc_id AS id, CASE WHEN quality = 1 THEN 'CONFIRMED' ELSE 'DISMISSED' END AS outcome FROM labels)"


def _matrix_sql() -> str:
    cols = []
    for d in (7, 14, 31):
        i = f"age < {d}"
        cols += [f"sum(v) FILTER ({i}) AS TOT_TXNAMT_L{d}D", f"sum(v) FILTER ({i} AND cr) AS TOT_TXNAMT_CR_L{d}D", f"sum(v) FILTER ({i} AND NOT cr) AS TOT_TXNAMT_DB_L{d}D", f"count(*) FILTER ({i}) AS TOT_TXNS_L{d}D"]
        cols += [f"{f}(bal) FILTER ({i}) AS {n}_BAL_{d}DAYS" for n, f in (("AVG", "avg"), ("MAX", "max"), ("MIN", "min"))]
    cols += [f"sum(v) FILTER (age < 7 AND event_type = '{r}') AS {r.upper()}_AMT_L7D" for r in RAILS]
    cols.append("count(*) FILTER (event_type = 'error') AS COUNT_ALERTS")
    cols += [f"count(*) FILTER (event_type = 'error' AND hour(ts) >= {a} AND hour(ts) < {b}) AS COUNT_ALERTS_{n}" for n, (a, b) in {"MORNING": (6, 12), "AFTERNOON": (12, 18), "EVENING": (18, 24), "NIGHT": (0, 6)}.items()]
    return f"""mx0 AS (SELECT event_id, user_id, event_type, value AS v, ts, event_type IN ('signup', 'purchase') AS cr, (epoch_us((SELECT max(ts) FROM events)) - epoch_us(ts)) / 86400e6 AS age FROM events),
mx1 AS (SELECT *, sum(CASE WHEN cr THEN v ELSE -v END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS bal FROM mx0),
mx AS (SELECT user_id, {", ".join(cols)}, CAST(user_id % 9 = 0 AS INTEGER) AS y FROM mx1 GROUP BY user_id)"""


MATRIX = _matrix_sql()
