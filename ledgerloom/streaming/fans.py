"""Fan counts on a live ledger: tumbling event-time windows with a watermark for late transfers."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fan_counts(ledger: DataFrame, hub: str = "src", leg: str = "dst", window: str = "7 days", late: str = "2 days", min_legs: int = 4) -> DataFrame:
    """account, start, end, legs (approximate distinct count, which streams can keep), total, n; for readStream or a batch."""
    t = ledger.withColumn("ts", F.col("ts").cast("timestamp"))
    if t.isStreaming:
        t = t.withWatermark("ts", late)
    g = t.groupBy(F.window("ts", window).alias("w"), F.col(hub).alias("account")).agg(F.approx_count_distinct(leg, 0.02).alias("legs"), F.sum(F.abs("amount")).alias("total"), F.count("*").alias("n"))
    return g.filter(F.col("legs") >= min_legs).select("account", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "legs", "total", "n")


def start(counts: DataFrame, path: str, checkpoint: str):
    """Appends closed windows to Parquet as the watermark passes them."""
    return counts.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
