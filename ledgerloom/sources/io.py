"""Readers and writers: delimited files with a sniffed delimiter, Parquet with checks, dictionaries, edges, sinks."""

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.sources.shared import new_path, written_to

DELIMITERS = (",", ";", "\t", "|")


def written(df: DataFrame, label: str) -> DataFrame:
    """df written once to the folder that all executors share, and read back: cuts the lineage of iterations."""
    return written_to(df, new_path(df.sparkSession, label))


def sniff(lines: list[str]) -> str:
    """The delimiter that splits the first lines into the most, and equally many, fields."""
    best = (0, ",")
    for d in DELIMITERS:
        counts = [x.count(d) for x in lines if x]
        if counts and min(counts) == max(counts) and counts[0] > best[0]:
            best = (counts[0], d)
    if not best[0]:
        best = max(((sum(x.count(d) for x in lines), d) for d in DELIMITERS), default=best)
    return best[1]


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Parquet by suffix, else a delimited file with header; one column only means that parsing failed."""
    if re.search(r"\.xls[xm]?$", path, re.I):
        raise ValueError("spreadsheets are not read here: save the sheet as CSV")
    if re.search(r"\.(parquet|pq)/?$", path, re.I):
        return spark.read.parquet(path)
    head = [r.value for r in spark.read.text(path).limit(50).collect()]
    df = spark.read.option("header", True).option("inferSchema", True).option("sep", sniff(head)).csv(path)
    if len(df.columns) < 2:
        raise ValueError(f"{path}: a single column, so its delimiter was not found")
    return df


def read_frame(spark: SparkSession, path: str) -> DataFrame:
    """A table written as `path`.parquet, or else as `path`.csv."""
    stem = re.sub(r"\.(parquet|csv)$", "", path)
    try:
        return spark.read.parquet(f"{stem}.parquet")
    except AnalysisException:
        return read_any(spark, f"{stem}.csv")


def read_attributions(spark: SparkSession, path: str) -> DataFrame:
    """id, feature, value of an attribution table; other columns are left out, a missing one raises."""
    df = spark.read.parquet(path)
    if missing := [c for c in ("id", "feature", "value") if c not in df.columns]:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    return df.select("id", "feature", F.col("value").cast("double").alias("value"))


UPLOADS = (".csv", ".tsv", ".txt", ".parquet")


def check_upload(name: str, size: int, limit: int = 2 << 30) -> str:
    """The file's base name if its kind and size may come in; else ValueError. No path of the sender is kept."""
    base = re.split(r"[\\/]", name)[-1]
    if not base.lower().endswith(UPLOADS):
        raise ValueError(f"files of kind {', '.join(UPLOADS)} are taken, not {base!r}")
    if not 0 < size <= limit:
        raise ValueError(f"{base} has {size} bytes; 1 to {limit} are taken")
    return re.sub(r"[^A-Za-z0-9._-]", "_", base)


def save_state(state: DataFrame, path: str) -> None:
    """Overwrites a small state table (as monitor_batch returns it), also where it was read from the same path."""
    written(state, "state").coalesce(1).write.mode("overwrite").parquet(path)


def read_dictionary(frames: list[DataFrame], columns: list[str]) -> DataFrame:
    """Of several tables the one, and in it the key column, that names most of `columns`: feature, name, desc."""
    known, best = set(columns), (0, None, None)
    for df in frames:
        wide = df.agg(*[F.sum(F.col(f"`{c}`").cast("string").isin(*known).cast("int")).alias(c) for c in df.columns]).first()
        for c in df.columns:
            if (wide[c] or 0) > best[0]:
                best = (wide[c], df, c)
    if best[1] is None:
        raise ValueError("no column of the dictionary names a known feature")
    _, df, key = best
    rest = [c for c in df.columns if c != key]
    pick = lambda i: F.col(f"`{rest[i]}`").cast("string") if len(rest) > i else F.lit(None).cast("string")
    return df.select(F.col(f"`{key}`").cast("string").alias("feature"), pick(0).alias("name"), pick(1).alias("desc"))


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """src, dst and, where the header has a third column, amount."""
    df = spark.read.option("header", True).csv(path)
    out = [F.col(df.columns[0]).cast("long").alias("src"), F.col(df.columns[1]).cast("long").alias("dst")]
    if len(df.columns) > 2:
        out.append(F.col(df.columns[2]).cast("double").alias("amount"))
    return df.select(*out)


def third_party_ledger(df: DataFrame, months: int | None = None) -> DataFrame:
    """Date, Time, Sender_account, Receiver_account, Amount, Is_laundering, Laundering_type -> ledger, first `months` only."""
    ts = F.try_to_timestamp(F.concat_ws(" ", F.col("Date").cast("string"), F.col("Time").cast("string")))
    out = df.select(F.col("Sender_account").alias("src"), F.col("Receiver_account").alias("dst"), F.col("Amount").cast("double").alias("amount"), ts.alias("ts"), F.col("Is_laundering").cast("int").alias("flag"), F.col("Laundering_type").alias("typology")).filter("ts is not null")
    if months is None:
        return out
    start = out.agg(F.min("ts").alias("_start"))
    return out.crossJoin(F.broadcast(start)).filter(F.col("ts") < F.add_months("_start", months).cast("timestamp")).drop("_start")


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


OUTCOMES = ("CONFIRMED", "DISMISSED", "OPEN")


def append_decisions(decisions: DataFrame, path: str) -> None:
    """Appends to the decision log; an unknown outcome raises before anything is written."""
    bad = decisions.filter(~F.col("outcome").isin(*OUTCOMES) | F.col("outcome").isNull()).limit(1).count()
    if bad:
        raise ValueError(f"outcome must be one of {', '.join(OUTCOMES)}")
    decisions.withColumn("decided_at", F.current_timestamp()).write.mode("append").parquet(path)
