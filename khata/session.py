"""Session defaults, shared folders and size checks."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "khata", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the jobs expect; cluster settings win where given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # generated methods beyond this size are not compiled by the JVM; smaller pieces are
        "spark.sql.codegen.hugeMethodLimit": "8000",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return ship(builder.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the workers, once a session, so that jobs with Python parts run from any folder."""
    root = Path(__file__).resolve().parent
    if not any(Path(f).name == f"{root.name}.zip" for f in spark.sparkContext.listFiles):
        folder = tempfile.mkdtemp(prefix="khata-package-")  # the driver serves it as long as it lives
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        shutil.make_archive(f"{folder}/{root.name}", "zip", root.parent, root.name)
        spark.sparkContext.addPyFile(f"{folder}/{root.name}.zip")
    return spark


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh path for written intermediates, below the cluster's shared folder.

    The folder named by ``spark.checkpoint.dir`` outlives any one executor. Only
    a local session may do without it: its one process sees a temporary folder,
    which is removed when the process ends. On a cluster a missing setting is an
    error, as executors would write to their own disks.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="khata-shared-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def rows_if_small(df: DataFrame, bound: int) -> list | None:
    """The rows of ``df`` when there are at most ``bound``, else None.

    At most ``bound + 1`` rows ever reach the driver.
    """
    rows = df.limit(bound + 1).collect()
    return rows if len(rows) <= bound else None


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    For results of costly steps that several branches of a plan read. Unlike a
    cache it survives lost executors.
    """
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A scan of more splits than this is never spread, so at most about a gigabyte is ever moved for it.
SPREAD_SPLITS = 8


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give idle cores work when a small scan has fewer splits than there are cores.

    Costly row work on a small file would otherwise run in one task. A scan of
    more than ``SPREAD_SPLITS`` splits is returned as it is on a cluster of any size.
    """
    cores, splits = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    return df.repartition(cores, *keys) if splits < min(cores, SPREAD_SPLITS + 1) else df
