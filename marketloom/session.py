"""Session defaults and the few cluster facilities the operators rely on."""

from __future__ import annotations

import atexit
import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SHIPPED: set[str] = set()

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int = 8, memory: str = "12g", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("marketloom")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
    )
    for k, v in {**DEFAULTS, **conf}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def reliable_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints.

    The cluster names it in ``spark.checkpoint.dir``.  Only where that is unset and the master
    is local (tests) a temporary folder takes its place; a cluster without the setting is refused,
    as a machine-local folder would lose data together with its executor.
    """
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not shared:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix=f"marketloom-{os.getpid()}-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared)
    return shared


def delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder; it is deleted when the driver ends, as lazy results may still read it."""
    path = f"{reliable_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def clear() -> None:
        try:
            if spark.sparkContext._jsc is not None:
                delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone
            pass

    atexit.register(clear)
    return path


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back, so that later stages never recompute it."""
    reliable_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, which need not have it on their path; once per application.

    Spark serves the archive from the driver to every executor, also to those that join later."""
    sc = spark.sparkContext
    if sc.applicationId in SHIPPED:
        return
    root = Path(__file__).parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    with tempfile.NamedTemporaryFile(prefix="marketloom-", suffix=".zip", delete=False) as out:
        out.write(data.getvalue())
    sc.addPyFile(out.name)
    SHIPPED.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables of a folder; the first one read ships the package."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
