"""Intermediate tables in the folder that the whole cluster shares."""

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str, str | None]] = []
_label: list[str | None] = [None]


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder of our own only where it is unset and all runs in one place,
    as in tests. On a cluster without the setting this is an error: executors don't share the driver's folders."""
    own = spark.conf.get("spark.checkpoint.dir", None)
    if not own:
        held = spark.sparkContext.getCheckpointDir()
        if not held:
            master = spark.sparkContext.master
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="palisade-"))
            held = spark.sparkContext.getCheckpointDir()
        own = held
    return own.rstrip("/") + "/palisade"


def place(spark: SparkSession, name: str) -> str:
    """A new path below folder(), under the label of the time; clear() deletes what is there."""
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path, _label[0]))
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read again: later plans start here, and lost executors cost no recomputation."""
    path = place(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(path: str, spark: SparkSession) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def clear(spark: SparkSession, label: str | None = None) -> None:
    """Delete every table written under the label; DataFrames that read them can't be used after it."""
    mine = [x for x in _written if x[0] is spark and x[2] == label]
    _written[:] = [x for x in _written if x not in mine]
    for _, path, _ in mine:
        drop(path, spark)


@contextlib.contextmanager
def labelled(label: str):
    """Tables placed within stand under the label."""
    before, _label[0] = _label[0], label
    try:
        yield
    finally:
        _label[0] = before


@atexit.register
def _at_exit() -> None:
    for spark, path, _ in _written:
        try:
            if spark.sparkContext._jsc is not None:
                drop(path, spark)
        except Exception:  # the JVM may have gone first
            return
