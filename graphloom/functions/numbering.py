"""Consecutive numbers over a whole table without a one-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.storage import held


def numbered(rows: DataFrame, *order: str, name: str = "n") -> DataFrame:
    """The rows with 1, 2, 3, ... in the given order; rows that tie in it are numbered in any order.

    Rows are sorted over ranges into a checkpoint, as ranges are drawn anew whenever they are computed; the driver learns the size of each range only.
    """
    low = (1 << 33) - 1
    kept = held(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit(low))
    sizes = {r["p"]: r["c"] for r in kept.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("c")).collect()}
    before, total = [], 0
    for p in sorted(sizes):
        before.append((p, total))
        total += sizes[p]
    # A row for each range, of which there are as many as shuffle partitions.
    offsets = rows.sparkSession.createDataFrame(before or [(0, 0)], "_part bigint, _before bigint")
    out = kept.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(name, place + F.col("_before") + 1)
    return out.select(*rows.columns, name)
