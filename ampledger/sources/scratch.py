"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: str | None = None
_driver = uuid.uuid4().hex  # drivers that share a folder keep their tables apart by it
_used: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where none is named, a local folder is made if the driver is all there is, as in tests; a
    cluster's executors would not see it, so there this fails.
    """
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="spark-")
    return f"file://{_own_dir}"


def folder(spark: SparkSession, name: str) -> str:
    """A path of its own for ``name`` in the shared folder, gone with the driver's other tables."""
    own = f"{shared_dir(spark)}/ampledger-{_driver}"
    if not _used:
        atexit.register(_clear_at_exit)
    _used.add(own)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage as checkpoint() does, but keeps columns prunable; a lost executor
    costs only the tasks that read it. ``release``, ``clear`` or the driver's end removes the table.
    """
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Remove tables that ``written`` made, once all that is to be read from them is written elsewhere; other tables stay."""
    for table in tables:
        spark = table.sparkSession
        for at in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            if f"/ampledger-{_driver}/" in at:
                path = spark._jvm.org.apache.hadoop.fs.Path(at)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Remove this driver's intermediate tables; results that still read them are then void."""
    jvm = spark._jvm
    for own in list(_used):
        path = jvm.org.apache.hadoop.fs.Path(own)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _used.discard(own)


def _clear_at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        with contextlib.suppress(Exception):  # the JVM may be gone
            clear(spark)
