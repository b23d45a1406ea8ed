"""Session helpers.

On a cluster the session is created by the platform; we only read its settings.
``local_session`` is for tests and the bench.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "pagecurate") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder and make sure ``DataFrame.checkpoint``
    writes there.

    A cluster names a shared folder in ``spark.checkpoint.dir`` (read from the
    session, never overridden). Only a ``local`` master, where driver and
    executors are one process, gets a scratch folder of our own when nothing is
    configured; elsewhere that would be a folder of the driver's machine, so it
    is an error."""
    sc = spark.sparkContext
    root = spark.conf.get(CHECKPOINT_CONF, None) or None
    if sc.getCheckpointDir() is None:
        if root is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that the driver and all executors share")
            root = tempfile.mkdtemp(prefix="pagecurate-ckpt-")
            atexit.register(shutil.rmtree, root, ignore_errors=True)  # our own folder, of this process only
        sc.setCheckpointDir(root)
    if root is None:
        # registered earlier without the setting: the folder above the
        # application's own sub-folder
        root = sc.getCheckpointDir().rstrip("/").rsplit("/", 1)[0]
    return root


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder for intermediate tables below the shared checkpoint folder,
    grouped by application: ``<root>/pagecurate-<application id>`` can go when
    the application has ended."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/pagecurate-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
