"""Tables written to the folder that driver and executors share, and the package on the executors."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
#: Bytes of a batch that goes to Python, where the session has Spark's default: rows hold whole texts, and several operators of a task hold a batch each.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "64m", "2m")


def ship(spark: SparkSession) -> None:
    """Give the executors this package, whatever their path; once for each application."""
    key, default, ours = BATCH_BYTES
    if spark.conf.get(key, default).rstrip("b") in (default, str(64 << 20)):
        spark.conf.set(key, ours)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp()) / f"{top.name}-{uuid.uuid4().hex[:8]}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share: spark.checkpoint.dir; one of our own only where that is unset and all run on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        set_by_hand = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = set_by_hand.get() if set_by_hand.isDefined() else None
    if not base:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = os.path.join(tempfile.gettempdir(), "linkgraph-shared")
    return f"{base.rstrip('/')}/linkgraph"


_written: list[tuple[SparkSession, str]] = []


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc.sc().isStopped():
                continue
            remove(spark, path)
        except Exception:  # the session is gone; the folder is temporary in any case
            pass


def materialize(df: DataFrame, name: str, partitions: int | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: cuts the lineage, survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df if partitions is None else df.coalesce(partitions)).write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Materialised tables that can be dropped together once nothing lazy reads them."""

    def __init__(self) -> None:
        self.paths: list[tuple[SparkSession, str]] = []

    def __call__(self, df: DataFrame, name: str, partitions: int | None = None) -> DataFrame:
        before = len(_written)
        out = materialize(df, name, partitions)
        self.paths += _written[before:]
        return out

    def release(self, name: str, keep: int = 1) -> None:
        """Drops the tables of a name but for the last ones: those of iterations that nothing reads any more."""
        mine = [x for x in self.paths if x[1].rsplit("/", 1)[-1].rsplit("-", 1)[0] == name]
        for x in mine[: len(mine) - keep]:
            remove(*x)
            _written.remove(x)
            self.paths.remove(x)

    def drop(self) -> None:
        for spark, path in self.paths:
            remove(spark, path)
            _written.remove((spark, path))
        self.paths = []
