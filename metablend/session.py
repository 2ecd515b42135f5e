"""Session helpers: local sessions for tests/bench and the checkpoint folder."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession
from pyspark.util import inheritable_thread_target

AT_ONCE = 8


def local_session(cores: int = 8, shuffle_partitions: int = 8,
                  app: str = "metablend", driver_memory: str = "8g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder of the session.

    The cluster names a shared folder in ``spark.checkpoint.dir``; we use it as
    is.  Only a local-mode session without one (tests, bench) gets a fresh
    scratch folder; on a cluster a missing setting is an error, never a
    machine-local fallback.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        sc.setCheckpointDir(conf)
        return sc.getCheckpointDir()
    if sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="metablend-ckpt-"))
        return sc.getCheckpointDir()
    raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")


def side_by_side(spark: SparkSession, jobs: list[Callable]) -> list:
    """Results of independent fits, in order.  A fit waits for one short Spark job per tree level; run from
    threads, the jobs of several fits share the executors instead of queueing up behind one another."""
    if len(jobs) < 2:
        return [job() for job in jobs]
    wrap = inheritable_thread_target(spark)
    run = (lambda job: job) if wrap is spark else wrap  # the session itself comes back where threads are not pinned
    with ThreadPoolExecutor(min(len(jobs), AT_ONCE)) as pool:
        return [f.result() for f in [pool.submit(run(job)) for job in jobs]]
