"""Session helpers: building a session for tests/bench and finding the shared scratch folder.

On a cluster the session already exists and ``spark.checkpoint.dir`` names a shared
(HDFS/S3/ABFS) folder; we only read it.  A value is set here only when it is unset,
which is the case in local tests.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_CKPT_KEY = "spark.checkpoint.dir"


def build_session(master: str | None = None, app: str = "qlift", shuffle_partitions: int = 8,
                  extra: dict | None = None) -> SparkSession:
    """Local session with the settings the tests and the bench use."""
    master = master or os.environ.get("QLIFT_MASTER", "local[8]")
    b = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.parallelismFirst",
                os.environ.get("QLIFT_PARALLELISM_FIRST", "true"))
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("QLIFT_DRIVER_MEMORY", "16g"))
    )
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder.  Where none is configured a local session (tests) gets a
    temporary one; on a cluster that is an error, since executors don't share local folders."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get(_CKPT_KEY, None) or sc.getConf().get(_CKPT_KEY, None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return sc.getCheckpointDir() or current
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError(f"set {_CKPT_KEY} to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="qlift-ckpt-")  # tests / local runs only
    sc.setCheckpointDir(local)
    spark.conf.set(_CKPT_KEY, local)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder (never a machine-local temp dir on a cluster)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/qlift-scratch/{name}-{uuid.uuid4().hex[:12]}"


class Stored:
    """Tables in the shared checkpoint folder for loops of joins: unlike a checkpoint, a table read again has its own
    size, so that the planner's estimates don't grow (as products) from round to round."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name
        self.paths: list[str] = []

    def put(self, df):
        path = scratch_path(self.spark, self.name)
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def tidy(self) -> None:
        """Lets Spark delete the shuffle files that no table needs any more, which stay until the driver collects its garbage."""
        self.spark.sparkContext._jvm.System.gc()

    def forget(self, keep: int) -> None:
        """Deletes all tables but the last ``keep``; nothing that is still to be read may rest on them."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        while len(self.paths) > keep:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(0))
            path.getFileSystem(conf).delete(path, True)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``qlift`` importable in Python workers (``addPyFile`` of a zip of the package).

    Needed only for Python-side operators (``mapInPandas``); on a cluster it is the same as
    ``--py-files``.  Done once per SparkContext.
    """
    import zipfile

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    import qlift

    root = os.path.dirname(os.path.abspath(qlift.__file__))
    fd, path = tempfile.mkstemp(prefix="qlift-pkg-", suffix=".zip")  # code bundle served by the driver
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(dirpath, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    _SHIPPED.add(key)
