"""File inventory of a project and its statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import columns as C


def inventory(files: DataFrame) -> DataFrame:
    """SRC1: (path, language, size_lines, file_category) of (path, content) rows; content may be text or bytes.

    Excluded paths are left out. Backslashes in paths become slashes (PRJ4).
    """
    path = F.replace(F.col("path"), F.lit("\\"), F.lit("/"))
    rows = files.select(path.alias("path"), _lines(files).alias("size_lines")).where(~C.excluded(F.col("path")))
    rows = rows.withColumn("language", C.language(F.col("path")))
    return rows.select("path", "language", "size_lines", C.category(F.col("path"), F.col("language")).alias("file_category"))


def _lines(files: DataFrame) -> Column:
    return C.binary_line_count(F.col("content")) if dict(files.dtypes)["content"] == "binary" else C.line_count(F.col("content"))


def examined(files: DataFrame, which: Column | None = None) -> DataFrame:
    """The rows of files (path, content, ...) with their inventory beside them, as ``file``, language, size_lines and file_category.

    ``file`` is null for excluded ones, and for those for which ``which`` doesn't hold.
    Contents stay with code only: the texts that parsers are given. A path with backslashes is none of an inventory, so its file is not parsed.
    """
    path = F.replace(F.col("path"), F.lit("\\"), F.lit("/"))
    wanted = ~C.excluded(path) if which is None else which & ~C.excluded(path)
    rows = files.withColumn("file", F.when(wanted, path)).withColumn("size_lines", _lines(files)).withColumn("language", C.language(F.col("file")))
    rows = rows.withColumn("file_category", C.category(F.col("file"), F.col("language")))
    return rows.withColumn("content", F.when((F.col("file_category") == "code") & (F.col("file") == F.col("path")), F.col("content")))


def language_counts(files: DataFrame) -> DataFrame:
    """AGG1."""
    return files.groupBy("language").agg(F.count(F.lit(1)).alias("files"))


def category_counts(files: DataFrame) -> DataFrame:
    """AGG1."""
    return files.groupBy("file_category").agg(F.count(F.lit(1)).alias("files"))


def project_stats(files: DataFrame, left_out: DataFrame | None = None) -> DataFrame:
    """AGG2, PRJ5: one row with total_files, total_lines, languages, filtered_by_ignore and estimated_complexity; ``left_out``: the rows that ignore files leave out."""
    total = files.agg(F.count(F.lit(1)).alias("total_files"), F.coalesce(F.sum("size_lines"), F.lit(0)).alias("total_lines"), F.sort_array(F.collect_set("language")).alias("languages"))
    none = F.lit(0).cast("bigint").alias("filtered_by_ignore")
    counted = total.select("*", none) if left_out is None else total.join(left_out.agg(F.count(F.lit(1)).alias("filtered_by_ignore")))
    return counted.select("*", C.project_complexity(F.col("total_files"), F.col("total_lines")).alias("estimated_complexity"))


def code_files(files: DataFrame) -> DataFrame:
    """FIL2."""
    return files.where(F.col("file_category") == "code")
