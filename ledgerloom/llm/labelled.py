"""A bounded sample of labelled rows to learn from, and the split that held-out accuracy is measured on."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bytes of text that a sample may hold.
MAX_BYTES = 64_000_000


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, mod n (null: of an empty text)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(n))


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, max_bytes: int = MAX_BYTES, mod: int = 5, held: int = 0) -> DataFrame:
    """At most `rows` texts of at most `max_bytes` UTF-8 bytes together with their label (0/1), none held out, the same on every run.

    One text an id: of several rows with an id, the text with the smallest hash. Ids labelled both 0 and 1 are left out;
    so are texts above a 64th of max_bytes, which no few of them may fill. Labels are few columns; the sample's ids, bounded by
    `rows`, go to every scan task, so only the sample's texts move.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("label"))
    known = known.filter(F.col("label").isin(0, 1) & F.col("_id").isNotNull() & (remainder(F.col("_id"), mod) != held))
    known = known.groupBy("_id").agg(F.min("label").alias("label"), F.max("label").alias("_most")).filter("label = _most").drop("_most")
    some = known.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    texts = texts.filter(F.octet_length("text") <= max_bytes // 64)
    found = texts.join(F.broadcast(some), "_id").groupBy("_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.col("text"))).alias("text"))
    # one task, over at most `rows` texts
    running = Window.orderBy(F.xxhash64("_id"), "_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = found.withColumn("_bytes", F.sum(F.octet_length("text")).over(running)).filter(F.col("_bytes") <= max_bytes)
    return found.select("_id", "text", "label")


def logistic(x, y, steps: int = 200):
    """(a, b) of the sigmoid a * x + b with the best likelihood (Platt's targets), by Newton steps."""
    import numpy as np

    pos, neg = float((y == 1).sum()), float((y != 1).sum())
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    mean, scale = float(x.mean()), float(x.std()) or 1.0
    z = (x - mean) / scale
    a, b = 0.0, float(np.log((pos + 1) / (neg + 1)))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -35, 35)))
        g, w = p - t, np.maximum(p * (1 - p), 1e-9)
        ga, gb = float((g * z).sum()) + 1e-3 * a, float(g.sum())
        haa, hab, hbb = float((w * z * z).sum()) + 1e-3, float((w * z).sum()), float(w.sum()) + 1e-9
        det = haa * hbb - hab * hab
        if det <= 0:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        step = min(1.0, 5.0 / max(abs(da), abs(db), 1e-12))
        a, b = a - step * da, b - step * db
        if max(abs(da), abs(db)) < 1e-9:
            break
    return a / scale, b - a * mean / scale
