"""Session helpers: table access, the shared checkpoint folder, and size-checked small sides."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Only a single-machine session may get one of its own."""
    sc = spark.sparkContext
    now = sc._jsc.sc().getCheckpointDir()
    if now.isDefined():
        return now.get()
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not shared:
        master = sc.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="boardwright-ckpt-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    sc.setCheckpointDir(shared)
    return shared


def cut(df: DataFrame, drop: bool = False) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, which outlives lost executors.

    With `drop` the shuffle files that led to it go as soon as it stands; only for plans whose shuffles nothing else reads again.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    if not drop:
        return df.checkpoint(eager=True)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a plan takes up the setting when it is made
    finally:
        spark.conf.set(_CLEANUP, before)


def release(spark: SparkSession) -> None:
    """Let Spark drop the checkpoints and shuffle files of plans that nothing refers to any more: its cleaner waits for a garbage
    collection of the driver, which on an idle driver can be far off. When it acts is its own affair; `cut` with `drop` is sure."""
    gc.collect()
    spark._jvm.System.gc()


def collect_bounded(df: DataFrame, max_rows: int, what: str) -> list:
    """Collect a small reference side; raises beyond max_rows instead of taking part of it."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"{what}: more than {max_rows} rows, too many for a driver-side dictionary")
    return rows


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors, once a context, unless the launcher's PYTHONPATH already names it."""
    root = Path(__file__).resolve().parent.parent
    sc = spark.sparkContext
    if getattr(sc, "_boardwright_shipped", False) or any(p and Path(p).resolve() == root for p in os.environ.get("PYTHONPATH", "").split(os.pathsep)):
        return
    # served by the driver, like any file added to a context
    made = Path(tempfile.mkdtemp(prefix="boardwright-")) / "boardwright.zip"
    with zipfile.ZipFile(made, "w") as z:
        for p in sorted((root / "boardwright").rglob("*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(str(made))
    sc._boardwright_shipped = True
