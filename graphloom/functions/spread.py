"""How rows are dealt over tasks: by how many there are, not by the bytes of the files that they come from.

A table of keys is a file of a few MB, which Spark reads in a task or two and takes for small enough to broadcast, however many rows and how much
text an operator makes of each of its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dealt(rows: DataFrame, *keys: str, per: int = 2000) -> DataFrame:
    """The rows dealt by their keys, about ``per`` to a task. They are counted for it, which for a stored table takes its footers only."""
    return rows.repartition(max(1, -(-rows.count() // per)), *keys)


def tasks_of(rows: DataFrame, per: int = 250_000) -> int:
    """How many tasks have about ``per`` of as many rows as a stored table has."""
    return max(1, -(-rows.count() // per))


def placed(rows: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """The rows by their keys on ``tasks`` tasks; None leaves it to Spark, which joins small partitions to ones of so many compressed bytes, however many rows."""
    return rows if tasks is None else rows.repartition(tasks, *keys)


def shuffled(rows: DataFrame) -> DataFrame:
    """One side of a join on equality that both sides are shuffled and sorted for: neither ever goes whole to the driver and to all tasks."""
    return rows.hint("merge")


def each(rows: DataFrame, array: str, name: str) -> DataFrame:
    """(path, position, name): the items of an array of each path.

    An outer explode, of which the empty ones go: before an inner one Spark filters on the array's size, and so computes a parsed text's arrays twice.
    """
    return rows.select("path", F.posexplode_outer(array).alias("position", name)).where("position is not null")
