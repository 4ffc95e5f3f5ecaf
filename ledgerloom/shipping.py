"""Makes this package importable on executors, wherever the driver was started."""

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once an application, sends the package to the executors with Spark's own file server."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = Path(__file__).resolve().parent
    if not root.is_dir():  # the package already came as an archive
        return
    path = Path(tempfile.mkdtemp(prefix="ledgerloom-")) / "ledgerloom.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, Path("ledgerloom") / f.relative_to(root))
    sc.addPyFile(str(path))
