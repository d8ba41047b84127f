"""Session settings the operators rely on, and the shared folder they write to."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
_OWN: set[str] = set()
T, R = TypeVar("T"), TypeVar("R")


def build_session(
    app: str = "riskweave", master: str | None = None, shuffle_partitions: int | None = None
) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # frozen tables go away with the DataFrames that read them
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = (
            builder.master(master)
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
        )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. A temporary one only in local mode, where none is named.

    Raises ValueError on a cluster that names none: a folder on the driver's own disk would be
    invisible to the executors.
    """
    context = spark.sparkContext
    named = spark.conf.get(CHECKPOINT_CONF, None)
    if context.getCheckpointDir() is None:
        if named is None and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="riskweave-"))
    return named or str(context.getCheckpointDir())


def _drop_at_exit(spark: SparkSession, folder: str) -> None:
    """Removes a session's own folder when the driver's Python ends, whatever storage it is in."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def drop() -> None:
        with contextlib.suppress(Exception):  # the JVM may be gone by then
            target = jvm.org.apache.hadoop.fs.Path(folder)
            target.getFileSystem(conf).delete(target, True)

    atexit.register(drop)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, visible to every executor. All paths of a session
    lie in one folder, which goes away with it."""
    own = f"{shared_folder(spark).rstrip('/')}/riskweave-{spark.sparkContext.applicationId}"
    if own not in _OWN:
        _OWN.add(own)
        _drop_at_exit(spark, own)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def freeze(df: DataFrame) -> DataFrame:
    """A table that several passes read, computed once and written to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def side_by_side(fn: Callable[[T], R], items: Sequence[T], at_once: int = 8) -> list[R]:
    """`fn` of every item, several at a time, so that jobs too small for the cluster share it.
    For a bounded number of items, such as the fits of a grid. The first error is raised."""
    if len(items) < 2:
        return [fn(i) for i in items]
    # each thread gets the caller's local properties; a thread of its own has no active session
    session = SparkSession.getActiveSession()
    carried = inheritable_thread_target(session) if session else inheritable_thread_target
    with ThreadPoolExecutor(min(at_once, len(items))) as pool:
        return [f.result() for f in [pool.submit(carried(fn), i) for i in items]]


def store(df: DataFrame, name: str = "stored") -> DataFrame:
    """`df` written once as Parquet below the shared folder and read again: later passes see the
    same rows without running the plan anew, also after executors are lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to `path` to its end."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)
