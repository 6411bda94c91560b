"""Session helpers: a tuned local session for tests/bench and the shared
checkpoint folder lookup used by jobs that cut lineage."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "quaymind") -> SparkSession:
    """Return the active session, or build one tuned for this library.

    On a cluster the caller's session (and its settings) wins: this only
    builds a session when none is active.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(cpus)
    spark = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("QUAYMIND_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints / intermediate tables.

    Reads ``spark.checkpoint.dir`` from the session (set by the cluster).
    Only when it is unset in a local session (tests) a scratch folder is
    created; on a cluster a missing setting is an error, because a folder of
    one machine is not seen by the others.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="quaymind-ckpt-")
    spark.sparkContext.setCheckpointDir(local)
    return local


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make the ``quaymind`` package importable in Python workers.

    Clusters normally ship it with ``--py-files``; when that was not done,
    the package is zipped on the driver and handed to Spark's ``addPyFile``,
    which copies it to every executor.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    py_files = spark.conf.get("spark.submit.pyFiles", "") or ""
    if "quaymind" not in py_files:
        import shutil
        pkg = os.path.dirname(os.path.abspath(__file__))
        staged = tempfile.mkdtemp(prefix="quaymind-pyfiles-")
        sc.addPyFile(shutil.make_archive(os.path.join(staged, "quaymind"), "zip", os.path.dirname(pkg), "quaymind"))
    _SHIPPED.add(sc.applicationId)
