"""Session helpers: shipping the package to executors, and cutting lineage in shared storage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()
_swept: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Serve this package to the Python workers once per application.

    Executors need not share the driver's folders: the archive travels through
    Spark's own file server.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    target = Path(tempfile.mkdtemp(prefix="millrace-ship-")) / "millrace_src.zip"
    with zipfile.ZipFile(target, "w") as z:
        for folder, dirs, names in os.walk(_PACKAGE):
            dirs[:] = [d for d in dirs if d != "__pycache__"]
            for n in sorted(names):
                if n.endswith(".py"):
                    p = Path(folder) / n
                    z.write(p, str(Path("millrace") / p.relative_to(_PACKAGE)))
    sc.addPyFile(str(target))


def _goes_at_exit(spark: SparkSession, path: str) -> None:
    """Have the file system delete ``path`` when this application's driver ends."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``. Where none is set, a folder of its own on a local master, else an error.

    The folder of this application's checkpoints is deleted when it ends.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if named:
            sc.setCheckpointDir(named)
        elif sc.master == "local" or sc.master.startswith("local["):
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-checkpoint-"))
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.applicationId not in _swept:
        _swept.add(sc.applicationId)
        _goes_at_exit(spark, sc.getCheckpointDir())
    return named or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and forget its lineage.

    A reliable checkpoint: a lost executor costs nothing that was computed before. It goes with the
    application, or with the frame where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, kind: str) -> str:
    """A new path in the shared checkpoint folder; what is written there is deleted at exit."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    _goes_at_exit(spark, path)
    return path


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written as a Parquet table in the shared checkpoint folder and read again, and its path; deleted at exit, if ``dropped`` has not."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    _goes_at_exit(spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def dropped(spark: SparkSession, path: str) -> None:
    """Delete what ``stored`` wrote."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def tune(builder):
    """Settings that the operators are written for; each may be overridden by the cluster."""
    for key, value in {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }.items():
        builder = builder.config(key, value)
    return builder
