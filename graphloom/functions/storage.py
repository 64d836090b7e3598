"""Folders that the driver and all executors share: where lineage is cut, and small texts that are replaced as a whole."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the cluster's ``spark.checkpoint.dir``; only where that is unset, as in tests, in a temporary folder."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if root is None:
        root = tempfile.mkdtemp(prefix="spark-shared-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def held(rows: DataFrame) -> DataFrame:
    """``rows`` as a checkpoint in the shared folder. Lost executors cost nothing; Spark's cleaner removes it once nothing refers to it."""
    shared_folder(rows.sparkSession, "held")
    return rows.checkpoint()


def _path(spark: SparkSession, path: str):
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small text of any store that Spark reaches; None if there is none."""
    place, store = _path(spark, path)
    if not store.exists(place):
        return None
    stream = store.open(place)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small text beside its place and moves it there, so that readers see the old or the new one."""
    jvm = spark.sparkContext._jvm
    place, store = _path(spark, path)
    draft, _ = _path(spark, f"{path}.{uuid.uuid4().hex}")
    stream = store.create(draft, True)
    stream.write(bytearray(text.encode("utf-8")))
    stream.close()
    overwrite = getattr(jvm, "org.apache.hadoop.fs.Options$Rename").OVERWRITE
    how = spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 1)
    how[0] = overwrite
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, place, how)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder; nothing happens if there is none."""
    place, store = _path(spark, path)
    store.delete(place, True)
