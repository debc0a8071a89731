"""Session helpers: cutting lineage in the shared folder, Arrow batches and column names."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of an Arrow batch between the JVM and Python, as texts can be long.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20

#: Files of frames that were cut or stored, and all such paths that still exist.
_files: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_left: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only where it is unset (tests) a local one."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="flatjet-")
        sc.setCheckpointDir(named)
    return str(named)


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches, which tasks hold on both sides."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        now = int(str(spark.conf.get(name)).rstrip("b"))
        if now <= 0 or now > most:
            spark.conf.set(name, str(most))


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint a small frame in the shared folder."""
    shared_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    path = out._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if path.isDefined():
        _noted(out, path.get())
    return out


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame as Parquet in the shared folder and read it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _noted(out, path)
    return out


def release(*frames: DataFrame) -> None:
    """Delete the files of frames of ``cut`` or ``stored`` that nothing reads any more.

    Files of frames that a result still reads stay until the driver ends.
    """
    for df in frames:
        if path := _files.pop(df, None):
            _delete(_left.pop(path), path)


def _noted(df: DataFrame, path: str) -> None:
    _files[df] = path
    _left[path] = df.sparkSession


@atexit.register
def _release_all() -> None:
    while _left:
        path, spark = _left.popitem()
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the gateway may be gone already
        return


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that others cannot clash with working columns."""
    return df.select(*[df[f"`{n}`"] for n in names])
