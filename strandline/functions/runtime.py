"""Session helpers shared by all jobs: the shared scratch folder and written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as the cluster names it.

    Only in a local session that names none (tests) is a temporary folder made and put into the
    session's settings; on a cluster executors could not see it, so a missing setting is refused there.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set(CHECKPOINT_KEY, named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; no two calls give the same one."""
    path = f"{shared_dir(spark)}/strandline/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write `df` as a table in the shared folder and return the table read back.

    This cuts the lineage like a reliable checkpoint does: a lost executor costs only the tasks
    that it was running, and both sides of a later join are plain scans, so that adaptive
    execution can split a skewed key on either side.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession, keep: str | None = None) -> int:
    """Delete this application's intermediate tables, but for those whose path begins with `keep`; returns how many went.

    For use between jobs: results that have not been written yet still read them.
    """
    gone = [p for p in _WRITTEN if not (keep and p.startswith(keep))]
    for path in gone:
        hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)
        _WRITTEN.remove(path)
    return len(gone)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to executors that don't have it installed; once for each application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="spark-")) / f"{package.name}.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted(package.rglob("*.py")):
            archive.write(source, source.relative_to(package.parent))
    context.addPyFile(str(target))
    _SHIPPED.add(context.applicationId)
