"""Ignore files: ordered rules with negation, inherited by all folders below, as column expressions.

The last rule that matches a path decides it, rules of deeper folders after those of folders above. A file is left out if it or any folder above it is;
so nothing below a folder that is left out comes back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import columns as C

IGNORE_FILE = ".graphignore"
#: Folders with rules that are sent to all tasks at most.
SENT_FOLDERS = 5000
_PIECES = r"\\.|/\*\*$|\*\*/|\*+|\?|\[[!^]?\]?[^\]]*\]|[^\\*?\[/]+|[\s\S]"


def _regex(pattern: Column) -> Column:
    """The regular expression of a pattern without its signs at both ends; it has to match a whole path below the rule's folder."""
    literal = lambda t: F.concat(F.lit(r"\Q"), t, F.lit(r"\E"))

    def piece(t: Column) -> Column:
        return (
            F.when(t == "**/", r"(?:.*/)?")
            .when(t == "/**", r"/.*")
            .when(t.startswith("*"), r"[^/]*")
            .when(t == "?", r"[^/]")
            .when(t.rlike(r"^\[.+\]$"), F.regexp_replace(F.regexp_replace(t, r"^\[!", "[^"), r"(?<=.)\[|&&", r"\\$0"))
            .when(t.rlike(r"^\\.$"), literal(F.substring(t, 2, 1)))
            .otherwise(literal(t))
        )

    return F.array_join(F.transform(F.regexp_extract_all(pattern, F.lit(_PIECES), F.lit(0)), piece), "")


def rules(ignore_files: DataFrame) -> DataFrame:
    """(base, rules) for each folder with rules: its patterns in order, with ``negated``, ``folders`` (folders only) and ``regex``.

    ignore_files: (path, content). Blank lines and lines that start with # are no rules; ! turns a rule around, a slash at the end limits it to
    folders, any other slash ties it to its folder. Blanks at the end of a line count only after a backslash. Unreadable files have no rules.
    """
    base = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    content = F.col("content").cast("string")
    lines = F.transform(F.split(content, "\r?\n"), lambda t: F.regexp_replace(t, r"(?<!\\)\s+$", ""))

    def rule(line: Column) -> Column:
        negated = line.startswith("!")
        text = F.when(negated, F.substr(line, F.lit(2))).otherwise(line)
        folders = text.endswith("/")
        bare = F.regexp_replace(text, "/+$", "")
        tied = bare.contains("/")
        regex = F.concat(F.when(tied, "^").otherwise("^(?:.*/)?"), _regex(F.regexp_replace(bare, "^/", "")), F.lit("$"))
        return F.struct(negated.alias("negated"), folders.alias("folders"), regex.alias("regex"))

    kept = F.filter(lines, lambda t: ~t.rlike(r"^(#|\s*$)") & ~t.rlike("^!?/*$"))
    rows = ignore_files.where(content.isNotNull()).select(base.alias("base"), F.transform(kept, rule).alias("rules"))
    return rows.where(F.size("rules") > 0).groupBy("base").agg(F.flatten(F.collect_list("rules")).alias("rules"))


def _decision(path: Column, is_folder: Column, rules: Column) -> Column:
    """True: left out, false: kept, null: no rule matches."""
    undecided = F.lit(None).cast("boolean")
    return F.aggregate(rules, undecided, lambda last, r: F.when((is_folder | ~r["folders"]) & F.rlike(path, r["regex"]), ~r["negated"]).otherwise(last))


def ignored(paths: DataFrame, ignore_files: DataFrame) -> DataFrame:
    """(path, ignored) of all distinct non-null paths.

    Each folder is decided once, whatever the number of files below it. Without ignore files nothing is left out.
    """
    table = rules(ignore_files)
    small = table.limit(SENT_FOLDERS + 1).count() <= SENT_FOLDERS
    sent = F.broadcast(table) if small else table
    files = paths.where("path is not null").select("path").distinct()
    folders = files.select(F.explode(C.ancestors(F.col("path"))).alias("path")).distinct()
    each = files.withColumn("folder", F.lit(False)).unionByName(folders.withColumn("folder", F.lit(True)))
    above = each.select("path", "folder", F.explode(F.concat(F.array(F.lit("")), C.ancestors(F.col("path")))).alias("base"))
    below = F.when(F.col("base") == "", F.col("path")).otherwise(F.substr("path", F.length("base") + 2))
    met = above.join(sent, "base").select("path", "folder", F.length("base").alias("depth"), _decision(below, F.col("folder"), F.col("rules")).alias("out")).where("out is not null")
    decided = met.groupBy("path", "folder").agg(F.max_by("out", "depth").alias("out")).where("out").select("path", "folder")
    # A file is out with any of its folders.
    chain = files.select("path", F.explode(C.ancestors(F.col("path"))).alias("above"))
    gone = decided.where("not folder").select("path").union(chain.join(decided.where("folder").select(F.col("path").alias("above")), "above", "left_semi").select("path")).distinct().withColumn("ignored", F.lit(True))
    return files.join(gone, "path", "left").select("path", F.coalesce("ignored", F.lit(False)).alias("ignored"))


def without_ignored(files: DataFrame, name: str = IGNORE_FILE) -> tuple[DataFrame, DataFrame]:
    """(kept, left_out) rows of (path, content), by the ignore files among them; those are hidden files and stay with the kept."""
    marks = ignored(files, files.where(C.file_name(F.col("path")) == name)).where("ignored").select("path")
    return files.join(marks, "path", "left_anti"), files.join(marks, "path", "left_semi")
