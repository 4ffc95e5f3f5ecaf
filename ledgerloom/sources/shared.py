"""Tables written on the way: in the folder that driver and executors share, gone when the application ends."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_root: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where a local master names none."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _local_root.setdefault("root", tempfile.mkdtemp(prefix="ledgerloom-"))


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/ledgerloom/{label}-{uuid.uuid4().hex}"


def _store(spark: SparkSession, path: str):
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), there


def delete(spark: SparkSession, path: str) -> None:
    store, there = _store(spark, path)
    store.delete(there, True)


def written_to(df: DataFrame, path: str) -> DataFrame:
    """df written once and read back, which cuts its lineage; the table goes with the application."""
    df.write.parquet(path)
    store, there = _store(df.sparkSession, path)
    store.deleteOnExit(there)
    return df.sparkSession.read.schema(df.schema).parquet(path)
