"""Session defaults, table access and lineage cuts."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession


WAIT = 30.0
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int = 8, name: str = "fieldledger") -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Where that is unset, a temporary folder serves a local master (tests, a laptop); on any
    other master it is an error, for executors would not find one another's files.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if named is None:
            if not re.match(r"local(\[|$)", sc.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="fieldledger-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    return named or sc.getCheckpointDir()


@contextmanager
def _shuffles_freed(spark: SparkSession):
    """Frames made inside delete their shuffle files as soon as they are computed, not when the driver next collects its garbage."""
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, was) if was is not None else spark.conf.unset(CLEANUP)


def cut(df: DataFrame) -> DataFrame:
    """Compute `df` once into the shared folder and forget how it was made; what was shuffled for it is deleted.

    checkpoint() survives the loss of executors; local checkpoints would not.
    """
    shared_folder(df.sparkSession)
    with _shuffles_freed(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def pack(df: DataFrame) -> DataFrame:
    """`cut` into compressed columns, a fraction of a checkpoint's bytes, in fewer partitions. The caller deletes it with `free`."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/packed-{uuid.uuid4().hex}"
    with _shuffles_freed(spark):
        df.select("*").write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.packed_at = path
    return out


def cut_counted(df: DataFrame, **sums: Column) -> tuple[DataFrame, dict]:
    """`cut`, with aggregates of the rows taken in the same job instead of another pass over them.

    What the job saw comes over Spark's event queue, which may drop events under load. Where it does not come
    within WAIT seconds, the written frame is aggregated instead.
    """
    seen, columns, got = Observation(), [c.alias(k) for k, c in sums.items()], []
    out = cut(df.observe(seen, *columns))
    waiter = threading.Thread(target=lambda: got.append(seen.get), daemon=True)
    waiter.start()
    waiter.join(WAIT)
    return out, got[0] if got else out.agg(*columns).first().asDict()


def free(*frames: DataFrame | None) -> None:
    """Delete the files of frames made by `cut` or `pack`, none of which anything still to be computed reads.

    Loops call it with a round's frames once the next round is cut, so their disk does not grow
    with the number of rounds. Other frames are left alone.
    """
    for df in frames:
        if df is not None and "packed_at" in vars(df):
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.packed_at)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
            continue
        plan = df._jdf.queryExecution().analyzed() if df is not None else None
        if plan is None or plan.nodeName() != "LogicalRDD" and not plan.toString().startswith("LogicalRDD"):
            continue
        at = plan.rdd().getCheckpointFile()
        if at.isDefined():
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(at.get())
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
