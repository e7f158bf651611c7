"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, app: str = "branchwise") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.files.minPartitionNum", str(cpus))
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``.

    On one machine a temporary folder may stand in for the missing setting. On a cluster it may not: each executor would
    write to a disk of its own, and later reads would miss those files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not is_local(spark.conf.get("spark.master", "local")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _OWN_ROOTS.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="branchwise-"))
    return root


_OWN_ROOTS: dict[str, str] = {}


@atexit.register
def _clean_up() -> None:
    """Temporary folders of this process go with it; a named shared folder is its owner's to clean."""
    for root in _OWN_ROOTS.values():
        shutil.rmtree(root, ignore_errors=True)


def is_local(master: str) -> bool:
    """Whether driver and executors are one process; ``local-cluster`` is not."""
    return master == "local" or master.startswith("local[")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; never reused between runs."""
    return f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a derived table to the shared folder and read it back.

    Used where one small result feeds several passes: it is computed once and
    survives the loss of any executor.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Workers import it by name, wherever the driver program was started from.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="branchwise-"), "branchwise.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, files in os.walk(here):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("branchwise", os.path.relpath(full, here)))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)
