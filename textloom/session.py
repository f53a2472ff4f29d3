"""Session helpers shared by every operator: checkpoints, table access, size checks."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever the application was started from.

    The package's sources are added to the session as one archive, once per application.
    """
    sc = spark.sparkContext
    if getattr(sc, "_textloom_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="textloom-"), "textloom_package.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(package):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    sc.addPyFile(archive)
    sc._textloom_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints.

    A cluster names a shared folder in ``spark.checkpoint.dir``; that one is used as it is. Only where
    nothing is set and the master is local (tests, a laptop) a temporary folder of this machine is taken; on a
    cluster other machines couldn't read it, so there it is an error.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
    path = configured or os.path.join(tempfile.gettempdir(), f"textloom-checkpoints-{os.getuid()}")
    sc.setCheckpointDir(path)
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the reliable checkpoint folder and go on from the files.

    Used where a result is read by more than one later step; it also cuts the lineage, so the loss of
    an executor costs a re-read and not a recomputation.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written as a table into the checkpoint folder, and its path.

    For loops: unlike a checkpoint, the table carries no constraints of the plan that made it (these double from
    round to round), and the caller can drop the tables of earlier rounds with ``drop_written``.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop_written(spark: SparkSession, path: str) -> None:
    """Delete a table that ``written`` made."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions the session is set to."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
