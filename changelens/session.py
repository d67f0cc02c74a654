"""Session helpers: building a session for tests/bench and finding shared dirs."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "changelens", extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "8g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint directory named by the cluster.

    The cluster names it in ``spark.checkpoint.dir``; we only invent one when
    it is unset *and* the session is local (tests, bench).  On a cluster an
    unset directory is an error: a machine-local folder would not survive the
    loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not _is_local(spark):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    local_dir = tempfile.mkdtemp(prefix="changelens-ckpt-", dir="/tmp")
    sc.setCheckpointDir(local_dir)
    return sc.getCheckpointDir()


_scratch: list[str] = []
_shipped: set[str] = set()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder under the shared checkpoint directory; ``clear_scratch`` removes it."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    _scratch.append(f"{base}/{name}-{uuid.uuid4().hex[:12]}")
    return _scratch[-1]


def scratch_mark() -> int:
    """How many scratch folders are taken; folders taken later can be dropped with ``clear_scratch``."""
    return len(_scratch)


def clear_scratch(spark: SparkSession, start: int = 0, stop: int | None = None) -> int:
    """Delete the scratch folders taken from mark ``start`` up to ``stop`` (default: all); call it when no frame reads them any more.

    The driver's garbage is collected too, as Spark deletes the shuffle files of a finished job when the job's plan is collected.
    """
    done = 0
    for i in range(start, len(_scratch) if stop is None else stop):
        if _scratch[i]:
            path = spark._jvm.org.apache.hadoop.fs.Path(_scratch[i])
            done += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
            _scratch[i] = ""
    spark.sparkContext._jvm.System.gc()
    return done


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application, as a zip that Spark serves to them."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="package-"), f"{os.path.basename(package)}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(package):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(folder, n), os.path.relpath(os.path.join(folder, n), os.path.dirname(package)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
