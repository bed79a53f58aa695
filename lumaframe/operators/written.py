"""Written intermediates: what later steps read more than once, in the folder all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir. Where it is unset, one in
    the temporary folder if all tasks run in this process's machine; else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{base or tempfile.gettempdir() + '/checkpoints'}/lumaframe"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage in a way that survives lost executors and lets later readers
    prune columns. Files go when the session's process ends, or by ``release`` or
    ``clear``.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._lumaframe_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete the files of a ``materialize`` result that nothing reads any more."""
    path = getattr(df, "_lumaframe_path", None)
    if path:
        _delete(df.sparkSession, path)
        _written[:] = [x for x in _written if x[1] != path]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clear() -> None:
    """Delete all intermediates written so far; results that read them are void."""
    while _written:
        _delete(*_written.pop())


@atexit.register
def _clean() -> None:
    try:
        clear()
    except Exception:  # the session may have ended
        return
