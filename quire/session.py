"""What every job needs from its session: the shared folder, cut lineage, and this package on the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent
RUN = uuid.uuid4().hex


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where that is unset, a temporary one, but only on a local master."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = f"file://{tempfile.mkdtemp(prefix='quire-')}"
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path below this process's folder in the shared one; release() deletes them all."""
    return f"{shared_dir(spark)}/quire/{RUN}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """df written to the shared folder and read back: lineage is cut and a lost executor costs no recomputation."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Deletes what this process has written to the shared folder; results that still read it must have been written before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/quire/{RUN}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Puts this package on the executors' path once per session (Python workers may start elsewhere)."""
    context = spark.sparkContext
    if getattr(context, "_quire_shipped", False):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="quire-zip-"), "quire_pkg.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted((ROOT / "quire").rglob("*.py")):
            out.write(path, path.relative_to(ROOT))
    context.addPyFile(archive)
    context._quire_shipped = True


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 2,000 rows for the session, where it has the default of 10,000: texts can be long. A session's own setting stays."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
