"""X1: changes of a project as its files arrive as a stream of versions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def file_changes(stream: DataFrame) -> DataFrame:
    """(path, status, version) of the files that change: added, modified or deleted.

    stream: a streaming DataFrame (path, content, version), a null content for a file that is gone. Each path's last version and the
    SHA-256 of its content are in Spark's state store, so a batch costs as much as it has files. Of several versions of a path in a batch the last
    counts, of rows of one version that with the largest hash; versions older than the one in the state have no effect. Null paths are left out.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = max(((int(v), h or "") for frame in frames for v, h in zip(frame["version"], frame["hash"])), default=None)
        known = state.get if state.exists else None
        if last is None or (known and last[0] < known[1]):
            return
        version, digest = last
        before = known[0] if known else ""
        # The version of a deleted file stays, so that a late older version doesn't bring it back.
        state.update((digest, version))
        if digest != before:
            status = "deleted" if not digest else "modified" if before else "added"
            yield pd.DataFrame({"path": [key[0]], "status": [status], "version": [version]})

    rows = stream.where("path is not null and version is not null").select("path", F.col("version").cast("bigint").alias("version"), F.sha2("content", 256).alias("hash"))
    return rows.groupBy("path").applyInPandasWithState(step, "path string, status string, version bigint", "hash string, version bigint", "append", GroupStateTimeout.NoTimeout)


def save(batch: DataFrame, path: str) -> None:
    batch.write.mode("overwrite").parquet(path)


def watch(stream: DataFrame, changes: str, checkpoint: str) -> StreamingQuery:
    """Writes the changes of ``stream`` below ``changes``, a folder batch=N for each batch.

    A batch that is run again after a failure starts from the state of the batch before and overwrites its own folder only, so every change is there once.
    """

    def write(batch: DataFrame, number: int) -> None:
        save(batch, f"{changes}/batch={number}")

    return file_changes(stream).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
