"""Session helpers: the shared work folder and lineage cuts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "twinside") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster a
    machine-local path would be lost with its executor.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    own = tempfile.mkdtemp(prefix="twinside-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """The folder of this application below the shared one; all its work lies there."""
    return f"{shared_dir(spark)}/twinside-{spark.sparkContext.applicationId}"


#: Folder below the run's that takes the work of an open ``scratch``.
_SCRATCH: ContextVar[str] = ContextVar("scratch", default="")


def work_path(spark: SparkSession, label: str, lasting: bool = False) -> str:
    """A fresh path in the run's folder; never reused, so never overwritten. ``lasting`` work outlives the innermost open ``scratch``."""
    own = _SCRATCH.get()
    return f"{run_dir(spark)}{own.rpartition('/')[0] if lasting else own}/{label}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_ON_DROP: list[Callable[[], None]] = []


def on_drop(forget: Callable[[], None]) -> None:
    """Have ``forget`` called whenever work is dropped: what keeps frames that read it must let them go."""
    _ON_DROP.append(forget)


def drop_work(spark: SparkSession) -> None:
    """Delete what the application has written for its own use; frames that read it are void afterwards."""
    for forget in _ON_DROP:
        forget()
    _delete(spark, run_dir(spark))


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Work settled inside is deleted at the end, but for what is settled as ``lasting``; other frames made inside are void then."""
    outer = _SCRATCH.get()
    token = _SCRATCH.set(f"{outer}/scratch-{uuid.uuid4().hex}")
    try:
        yield
    finally:
        own = _SCRATCH.get()
        _SCRATCH.reset(token)
        _delete(spark, run_dir(spark) + own)


def settle(df: DataFrame, label: str, lasting: bool = False) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Cuts the lineage in a way that survives lost executors, and gives the
    optimizer the real size, so its own threshold decides about broadcasting.
    """
    spark = df.sparkSession
    path = work_path(spark, label, lasting)
    df.write.option("compression", "zstd").parquet(path)  # ids and probabilities hardly shrink by Spark's default
    return spark.read.schema(df.schema).parquet(path)
