"""Command line: scan, parse, build and json."""

from __future__ import annotations

import argparse
import os
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import export as X
from graphloom.operators.graph import Graph
from graphloom.operators.incremental import build_full, build_incremental
from graphloom.operators.parse import Registry
from graphloom.operators.scan import code_files, inventory, language_counts, project_stats
from graphloom.sources.files import STATE_DIR, commit_hash, scanned_files

_NAMES = {"html": "report.html", "static": "report.html", "md": "report.md", "markdown": "report.md"}


def _session() -> SparkSession:
    return SparkSession.builder.appName("graphloom").getOrCreate()


def build(spark: SparkSession, root: str, out: str, incremental: bool = False) -> tuple[Graph | None, DataFrame]:
    """The graph of a project folder, and its files; with ``incremental`` None if nothing has changed since the snapshot below ``out``."""
    root = os.path.abspath(root)
    files, _ = scanned_files(spark, root)
    maker = build_incremental if incremental else build_full
    now = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    return maker(files, os.path.basename(root), f"{out}/state", commit_hash(root), now), files


def main(argv: list[str] | None = None) -> int:
    """CLI1, CLI2."""
    top = argparse.ArgumentParser(prog="graphloom", description=__doc__)
    commands = top.add_subparsers(dest="command")
    for name in ("scan", "parse", "json", "build"):
        one = commands.add_parser(name)
        one.add_argument("root", nargs="?", default=".")
        if name == "build":
            one.add_argument("output", nargs="?")
            one.add_argument("--format", default="json")
            one.add_argument("--incremental", action="store_true")
            one.add_argument("--full", action="store_true", help="build everything, even with --incremental")
    args = top.parse_args(argv)
    if args.command is None:
        top.print_help()
        return 0
    spark = _session()
    if args.command == "build":
        out = os.path.join(os.path.abspath(args.root), STATE_DIR)
        graph, files = build(spark, args.root, out, args.incremental and not args.full)
        if graph is None:
            print("up to date")
            return 0
        path = args.output or os.path.join(out, _NAMES.get(args.format, "knowledge-graph.json"))
        X.export(graph, args.format, path, inventory(files))
        print(path)
        return 0
    files, left_out = scanned_files(spark, os.path.abspath(args.root))
    found = inventory(files)
    if args.command == "json":
        print(X.scan_json(project_stats(found, left_out)).first()["json"])
    elif args.command == "parse":
        parsed = Registry().parse(files.join(code_files(found).select("path"), "path", "left_semi"))
        for r in X.parse_summary(parsed).orderBy("path").toLocalIterator():
            print(r["line"])
    else:
        counts = [(r["language"], r["files"]) for r in language_counts(found).orderBy(F.col("files").desc(), "language").collect()]
        print(X.scan_summary(project_stats(found, left_out).first().asDict(), counts))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
