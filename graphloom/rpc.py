"""JSON-RPC over lines of text: scan, graph and report as tools."""

from __future__ import annotations

import json
import os
import sys
import tempfile
from collections.abc import Iterable, Iterator
from pathlib import Path

from pyspark.sql import SparkSession

from graphloom.cli import build
from graphloom.operators import export as X
from graphloom.operators.scan import inventory, project_stats
from graphloom.sources.files import STATE_DIR, scanned_files

# The protocol's version and the tools.
PROTOCOL = "2024-11-05"
_PATH = {"path": {"type": "string"}}
TOOLS = [
    {"name": name, "description": text, "inputSchema": {"type": "object", "properties": _PATH | more, "required": ["path"]}}
    for name, text, more in (
        ("project_scan", "Inventory of a project", {}),
        ("project_graph", "Knowledge graph of a project", {"incremental": {"type": "boolean"}}),
        ("project_report", "Report on a project", {"format": {"type": "string", "enum": ["html", "md", "json"]}}),
    )
]


def _call(spark: SparkSession, name: str, args: dict) -> str:
    root = os.path.abspath(args.get("path", "."))
    if name == "project_scan":
        files, left_out = scanned_files(spark, root)
        return X.scan_json(project_stats(inventory(files), left_out)).first()["json"]
    graph, files = build(spark, root, os.path.join(root, STATE_DIR), bool(args.get("incremental", False)))
    if graph is None:
        return "up to date"
    form = args.get("format", "json") if name == "project_report" else "json"
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "out")
        X.export(graph, form, path, inventory(files))
        return Path(path).read_text(encoding="utf-8")


def answer(spark: SparkSession, request: dict) -> dict | None:
    """MCP1-5: the response to a request; None to a notification."""
    method, number = request.get("method"), request.get("id")
    if number is None:
        return None
    out: dict = {"jsonrpc": "2.0", "id": number}
    if method == "initialize":
        out["result"] = {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "graphloom", "version": "0.1.0"}}
    elif method == "tools/list":
        out["result"] = {"tools": TOOLS}
    elif method == "tools/call":
        params = request.get("params") or {}
        name = params.get("name")
        if name in {t["name"] for t in TOOLS}:
            out["result"] = {"content": [{"type": "text", "text": _call(spark, name, params.get("arguments") or {})}]}
        else:
            out["result"] = {"content": [{"type": "text", "text": f"unknown tool: {name}"}], "isError": True}
    else:
        out["error"] = {"code": -32601, "message": f"unknown method: {method}"}
    return out


def serve(spark: SparkSession, lines: Iterable[str]) -> Iterator[str]:
    """SRC10: a response line for each request line; blank and unreadable lines are passed over."""
    for line in lines:
        try:
            request = json.loads(line)
        except ValueError:
            continue
        if isinstance(request, dict) and (response := answer(spark, request)) is not None:
            yield json.dumps(response)


if __name__ == "__main__":
    for response in serve(SparkSession.builder.appName("graphloom").getOrCreate(), sys.stdin):
        print(response, flush=True)
