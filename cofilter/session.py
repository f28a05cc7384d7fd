"""Session helpers: a sane local session for tests/bench, and the shared
scratch/checkpoint folder every job writes through."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def build_session(master: str | None = None, app: str = "cofilter",
                  shuffle_partitions: int = 8, extra: dict | None = None) -> SparkSession:
    """Session for tests and the bench. On a cluster use the cluster's own
    session; nothing in the library depends on these settings."""
    b = (SparkSession.builder
         .master(master or "local[8]")
         .appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.driver.memory", "16g")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.ui.showConsoleProgress", "false"))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and scratch tables.

    Read from the session (``spark.checkpoint.dir`` or a directory already set
    on the context). Only a local-mode session without one gets a private
    folder; on a cluster an unset directory is an error, because a folder on
    one machine is not visible to the executors."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = sc.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        try:
            conf = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset key
            conf = None
    if conf:
        sc.setCheckpointDir(conf)
        return sc.getCheckpointDir()
    if sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="cofilter-ckpt-"))
        return sc.getCheckpointDir()
    raise RuntimeError("spark.checkpoint.dir is not set; point it at a shared folder "
                       "(HDFS/S3/DBFS) before running jobs that cut lineage")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder for written tables."""
    return os.path.join(checkpoint_dir(spark), "scratch", f"{name}-{uuid.uuid4().hex}")


def written(df, name: str):
    """``df`` written to a fresh scratch folder and read back: cuts the lineage and
    survives the loss of executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Rows go to Python in batches of ``BATCH_BYTES``; a session that sets a size of its
    own keeps it."""
    if spark.conf.get(_BATCH, "1b") == "1b":  # unset
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def trimmed() -> None:
    """Gives the memory that a Python worker has freed back to the system."""
    import pyarrow as pa
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def ship_package(spark: SparkSession) -> None:
    """Hand this package to the executors once per application, as ``--py-files``
    would, for the functions that run in Python there."""
    sc = spark.sparkContext
    name = "cofilter-package.zip"
    if any(str(f).endswith(name) for f in sc.listFiles):
        return
    top = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="cofilter-"), name)
    with zipfile.ZipFile(path, "w") as out:
        for f in sorted(top.rglob("*.py")):
            out.write(f, f.relative_to(top.parent))
    sc.addPyFile(path)
