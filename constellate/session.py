"""Session defaults and durable intermediate results.

Iterative and multi-pass operators cut lineage with :func:`materialize`, which writes a parquet table into the shared
folder named by ``spark.checkpoint.dir``; every executor can read it again after another one is lost.  Only where that
setting is absent (a laptop, the tests) is a folder of our own used.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: dict[str, str] = {}


def get_session(app: str = "constellate", cores: int | str = "*", **conf: str) -> SparkSession:
    """Local session with the settings the tests and the benchmark use; on a cluster pass the cluster's own session."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder for durable intermediates: ``spark.checkpoint.dir`` of the session, else the context's checkpoint folder,
    else, with a local master only, one made for this process.  On a cluster such a folder would be another one on every
    machine, so that readers would see parts of a table: there it is an error."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if set_dir:
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("no shared folder for intermediate tables: set spark.checkpoint.dir")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        _FALLBACK[app] = "file://" + tempfile.mkdtemp(prefix="constellate-")
    return _FALLBACK[app]


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have ended already
        if path.startswith("file:"):
            import shutil

            shutil.rmtree(path.split(":", 1)[1].replace("//", "/", 1) if path.startswith("file://") else path[5:], ignore_errors=True)


def materialize(df: DataFrame, name: str = "part", partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once as parquet into :func:`shared_dir` and return a reader of it.

    The result has no lineage to ``df``, survives the loss of executors, keeps values that a recomputation might not
    repeat (such as generated ids), and its size is known to the optimiser.  The files go when the process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/constellate-{os.getpid()}/{name}-{uuid.uuid4().hex}"
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    atexit.register(_delete, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete the files of a result of :func:`materialize` that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/constellate-" in f}:
        _delete(df.sparkSession, folder)
