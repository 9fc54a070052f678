"""Session settings the operators rely on.

``configure`` only sets runtime SQL options (safe on a shared cluster session).
``checkpoint_dir`` reads ``spark.checkpoint.dir`` from the session and only falls
back to a private temporary folder when the setting is absent (local tests).
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Runtime options every operator assumes. Time is epoch milliseconds interpreted in
# UTC; duplicate JSON keys must parse because payloads are embedded verbatim.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    On a cluster ``spark.checkpoint.dir`` names a shared file system folder and is
    used as is; without one a cluster session is refused. Only in a local session, whose one process is driver
    and executors, a private folder is made.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir is not set: executors need a folder that they share")
        path = tempfile.mkdtemp(prefix="meshframes-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if not spark.sparkContext.getCheckpointDir():
        # reliable DataFrame.checkpoint() writes under the same shared folder
        spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the checkpoint folder for one written table."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "meshframes") -> SparkSession:
    """Session for tests and local benchmarks."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    checkpoint_dir(spark)
    return spark


def materialize(df, name: str = "stage"):
    """Write ``df`` as parquet under the shared checkpoint folder and read it back.

    Used where an intermediate feeds a plan that reads it twice (an ordered scan's
    summary and main branch): the lineage is cut, the work is done once, and the
    read keeps column pruning and statistics."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
