"""Session settings and the lineage cut shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", partitions: int = 8, app: str = "millrace", **more: str) -> SparkSession:
    """A local session for tests and benches; a cluster brings its own session."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in {**DEFAULTS, "spark.sql.shuffle.partitions": str(partitions), "spark.driver.memory": "6g", **more}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def cut(df: DataFrame) -> DataFrame:
    """Write df once and read it back, so that later steps don't recompute it and survive lost executors.

    The folder is the one the session names in spark.checkpoint.dir, which all executors share.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession, "millrace-checkpoints"))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """The folder that all executors share: the context's, or spark.checkpoint.dir. A local session (tests) may go without
    and gets a folder of this machine; a cluster without one is an error."""
    given = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), name)


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, except workers of this machine's own process tree that find it anyway (PYTHONPATH
    or the working folder names its place).

    Functions that run in workers are pickled by reference to their modules, so a cluster needs the package there.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    sc = spark.sparkContext
    found = root in known or os.path.abspath(os.getcwd()) == root
    if getattr(sc, "_millrace_shipped", False) or found and sc.master.split("[")[0] == "local":
        return
    at = tempfile.mkdtemp(prefix="millrace-code-")
    archive = os.path.join(at, "millrace.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(os.path.join(root, "millrace")):
            for f in sorted(files):
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    z.write(path, os.path.relpath(path, root))
    sc.addPyFile(archive)
    sc._millrace_shipped = True


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that executors share."""
    return f"{shared_folder(spark, 'millrace-scratch')}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete a path written before."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
