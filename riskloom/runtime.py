"""Where intermediate tables live, and how lineage is cut."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    With the setting absent, local mode uses a folder below the session's warehouse; a
    cluster without the setting is an error, since no folder is then known to be shared.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local[") and context.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; what was written there goes when the driver ends."""
    folder = shared_folder(spark)
    if folder not in _folders:
        _folders[folder] = spark
    return f"{folder}/{name}-{uuid.uuid4().hex}"


@atexit.register
def clear_scratch() -> None:
    """Delete the folders of this driver's sessions (each is the session's own)."""
    for folder, spark in _folders.items():
        context = spark.sparkContext
        if context._jsc is None or context._jsc.sc().isStopped():
            continue
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def pin(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and read it back from reliable storage.

    Used where two branches of one plan must see the very same rows, and where
    recomputing would mean scanning the source again.  The rows are kept as Parquet, so
    readers prune columns, push filters down and know the size.
    """
    path = scratch_path(df.sparkSession, "pin")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
