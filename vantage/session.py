"""Session helpers: a local builder for tests/bench and the shared work folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job of the engine relies on; applied to local sessions and
# checked (not forced) on a caller's session.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def recommended_conf(input_bytes: int, cores: int, target_partition_bytes: int = 256 << 20,
                     ) -> dict[str, str]:
    """Shuffle and scan sizes for a job reading ``input_bytes`` on ``cores`` cores:
    shuffle partitions so that one holds about ``target_partition_bytes`` (at
    least 2 waves of the cluster), scan splits of 256 MiB, AQE left to coalesce
    small partitions and split skewed ones. Apply to a session you own only."""
    parts = max(2 * cores, -(-int(input_bytes) // target_partition_bytes))
    return {
        **SCALE_CONF,
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(256 << 20),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
    }


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "vantage") -> SparkSession:
    """A local session for tests and the bench (UI off, AQE on)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
    )
    for key, value in SCALE_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared folder (``spark.checkpoint.dir``).

    The cluster names it; only a local session without it gets a folder of its
    own. A folder of one machine is no place for a cluster's tables, so any
    other session without the setting is an error.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: no SparkContext on the client
        sc = None
    base = (sc.getConf().get("spark.checkpoint.dir") if sc is not None else None) \
        or _conf(spark, "spark.checkpoint.dir")
    if not base:
        master = sc.master if sc is not None else "remote"
        if not re.match(r"local(\[|$)", master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors "
                               f"share (master is {master!r})")
        # kept for the session: sc.getCheckpointDir() gives it back from now on
        base = (sc.getCheckpointDir() or "").rsplit("/", 1)[0].removeprefix("file:") or tempfile.mkdtemp(prefix="/tmp/run-")
    if sc is not None and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return base


def session_key(spark: SparkSession) -> str:
    """An id of the running application (for per-session caches)."""
    return _conf(spark, "spark.app.id") or str(id(spark))


def shared_path(spark: SparkSession, *parts: str, unique: bool = True) -> str:
    """A path in the shared folder for a written table or staged export."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    leaf = list(parts)
    if unique:
        leaf.append(uuid.uuid4().hex[:12])
    return "/".join([base, "vantage", *leaf])


def _conf(spark: SparkSession, key: str) -> str | None:
    try:
        return spark.conf.get(key, None)
    except Exception:  # pragma: no cover - conf lookup differences
        return None


def env_secret(value):
    """Resolve ``env:NAME`` references so secrets never live in a spec file."""
    if isinstance(value, str) and value.startswith("env:"):
        name = value[4:]
        if name not in os.environ:
            raise KeyError(f"environment variable {name!r} is not set")
        return os.environ[name]
    return value
