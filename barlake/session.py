"""Session settings every query of this package relies on."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package's sources to the executors' Python workers, once per application, so it need not be installed there."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="barlake-")  # on the driver, which serves the archive until it ends
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "barlake.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, Path(root.name) / f.relative_to(root))
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)


def prepare(spark: SparkSession) -> SparkSession:
    """Pin what results depend on, UTC, and send the package along for the Python workers.

    No other setting is touched, so a session handed over by a cluster keeps its sizing.
    """
    ship_package(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a local one only where that is unset."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not set_dir and sc.master.startswith("local"):
        set_dir = os.path.join(tempfile.gettempdir(), "barlake-checkpoints")
    if not set_dir:
        raise RuntimeError("spark.checkpoint.dir must name a folder all executors share")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(set_dir)
    return set_dir


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")
