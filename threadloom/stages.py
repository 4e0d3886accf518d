"""Written intermediate tables in the folder that all executors share.

A stage table cuts the lineage of an iterative job and survives the loss of an executor. The folder is the session's
``spark.checkpoint.dir``; only where that is unset and Spark runs in one local process (tests) a temporary folder is made. A lazy
result may read a table until it has been computed, so tables stay until the process ends, or until the ``scope`` they were
made in ends.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
_OPEN: set[tuple[str, str]] = set()


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; in local mode without one, a temporary folder of this process. A cluster must name one:
    its executors don't share the local folders of their machines."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if "dir" not in _OWN:
        _OWN["dir"] = "file://" + tempfile.mkdtemp(prefix="threadloom-")
    return _OWN["dir"]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Stage:
    """A table written once under the shared folder; ``df`` reads it, ``drop`` removes it when nothing needs it any more."""

    def __init__(self, df: DataFrame, label: str):
        self.spark = df.sparkSession
        self.path = f"{shared_folder(self.spark)}/threadloom-{label}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.schema = df.schema
        _OPEN.add((self.spark.sparkContext.applicationId, self.path))

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        _delete(self.spark, self.path)
        _OPEN.discard((self.spark.sparkContext.applicationId, self.path))


def write_bytes(spark: SparkSession, name: str, content: bytes) -> str:
    """Write a small file to the shared folder and return its path; removed when the process ends."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}/{name}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, False)
    out.write(bytearray(content))
    out.close()
    _OPEN.add((spark.sparkContext.applicationId, path.rsplit("/", 1)[0]))
    return path


#: Rows of a table made on the driver up to which it is broadcast; a larger one is joined like any other.
BROADCAST_ROWS = 200_000


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if its ``rows``, which the caller has counted, are few enough."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a frame that reads it; removed with its ``scope`` or when the process ends."""
    return Stage(df, label).df


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Removes the tables written inside it when it ends. Results must be computed (written, collected) inside it. A long session
    runs each job in a scope of its own."""
    before = set(_OPEN)
    try:
        yield
    finally:
        for made in _OPEN - before:
            if made[0] == spark.sparkContext.applicationId and "/threadloom-" in made[1]:
                _delete(spark, made[1])
                _OPEN.discard(made)


@atexit.register
def _clean() -> None:
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    for application, path in list(_OPEN):
        try:
            if application == spark.sparkContext.applicationId:
                _delete(spark, path)
        except Exception:  # the JVM may be gone already
            return
