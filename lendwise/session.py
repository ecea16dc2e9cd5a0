"""SparkSession construction and the checkpoint-folder rule."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job in this library relies on. The session time zone is pinned so that
# DATE(ts), DATEDIFF and month formatting do not depend on the machine the driver runs on.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # remove reliable checkpoint files once their DataFrames are garbage collected
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str | None = None, app_name: str = "lendwise",
                  shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library's settings.

    ``shuffle_partitions`` defaults to the core count for local runs; on a cluster pass a value sized so a
    shuffle partition stays around 128-256 MB at the target scale (AQE then coalesces small ones).
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions is None and master and master.startswith("local"):
        inside = master[len("local["):-1] if "[" in master else "1"
        shuffle_partitions = os.cpu_count() if inside in ("*", "") else int(inside)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    return spark


def recommended_shuffle_partitions(input_bytes: int, cores: int, target_bytes: int = 256 << 20) -> int:
    """Shuffle partition count for a job reading ``input_bytes``: about ``target_bytes`` per partition, at least
    two waves of the cluster's cores. AQE coalesces partitions that turn out small, so erring high is cheap."""
    return max(2 * cores, -(-input_bytes // target_bytes))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, configuring the context from ``spark.checkpoint.dir``.

    On a cluster the folder must be shared storage named by the cluster in ``spark.checkpoint.dir``; it is
    read from the session. A private temporary folder is only created when nothing is configured (local
    runs and tests).
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: set it to shared storage visible to every executor")
        configured = tempfile.mkdtemp(prefix="lendwise-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured
