"""Session defaults and lineage cutting.

Nothing here overrides a setting the cluster already made: shared folders, shuffle sizes and
adaptive options are read from the session first.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Whether Spark deletes what an action has shuffled once the action has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cpus: int | str = "*", app: str = "auditgrain", folder: str | None = None) -> SparkSession:
    """A session for tests and benchmarks on one machine, with its own folder for what queries write."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("AUDITGRAIN_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
    )
    return (builder.config("spark.checkpoint.dir", folder) if folder else builder).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, from `spark.checkpoint.dir`.

    Only a session on one machine may leave it unset: there driver and executors are one process, and
    a folder of its own is made. On a cluster a machine's own folder would lose data, so none is.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="auditgrain-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured


#: Paths made since `steps_dropped` was entered; None outside of it.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    path = os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")
    if (made := _made.get()) is not None:
        made.append(path)
    return path


@contextmanager
def steps_dropped(spark: SparkSession, kept: int = 1) -> Iterator[None]:
    """Tables written in here are deleted at its end, except the last `kept` ones, which no longer need the others.

    Only for what ends in so many tables: no frame made in here but those on them can be read afterwards. One
    within another leaves what it keeps to the outer one.
    """
    token = _made.set([])
    try:
        yield
    finally:
        made = _made.get()
        _made.reset(token)
    if (outer := _made.get()) is not None:
        outer.extend(made[-kept:])
    for name in made[:-kept]:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What an action in here shuffles is deleted at its end, not when the driver next collects garbage.

    Else the disks hold the shuffles of all steps of a query at once. What the session itself says holds.
    """
    if spark.conf.get(CLEANUP, None) is not None:
        yield
        return
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors, unlike a local one."""
    shared_folder(df.sparkSession)
    with shuffles_dropped(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # the setting counts for frames made under it


#: Level 1 writes faster than Spark's 3; the texts and digests of these steps take no more room.
ZSTD_LEVEL = "parquet.compression.codec.zstd.level"


def materialize(df: DataFrame, name: str = "table", compression: str = "snappy", unlike: Sequence[str] = (), folders: Sequence[str] = ()) -> DataFrame:
    """Write once to the shared folder and read back: for a wide result that feeds several outputs.

    Unlike a checkpoint the copy is columnar, so each consumer reads only its columns, and no
    consumer's filter is pushed down into the expensive expressions that built it. Its size is known:
    Spark sends a small copy to all tasks of a join and shuffles neither side. `zstd` halves digests. For the
    columns `unlike`, whose values hardly repeat, no dictionary is tried. Rows lie in folders by the columns `folders`.
    """
    path = fresh_path(df.sparkSession, name)
    options = {"compression": compression, ZSTD_LEVEL: "1", **{f"parquet.enable.dictionary#{c}": "false" for c in unlike}}
    with shuffles_dropped(df.sparkSession):
        df.write.options(**options).partitionBy(*folders).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
