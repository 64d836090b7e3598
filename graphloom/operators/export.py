"""Sinks: JSON, Markdown and HTML of a finished graph.

``export`` writes one project's graph as one document, by the driver; ``json_rows``, ``markdown_lines`` and
``payload_rows`` give the same as rows, which nothing gathers.
"""

from __future__ import annotations

import html
import json
import uuid
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.storage import read_text, remove, replace_text
from graphloom.operators import query as Q
from graphloom.operators.graph import EDGE_COLUMNS, NODE_COLUMNS, ROW_TABLES, Graph, GraphRows, rows_of


def _exported(nodes: DataFrame) -> DataFrame:
    """The nodes without empty lists in their metadata."""
    void = lambda c: F.when(F.size(c) > 0, c)
    domain = F.col("domain_meta")
    for name in ("entities", "business_rules", "cross_domain_interactions"):
        domain = domain.withField(name, void(domain[name]))
    knowledge = F.col("knowledge_meta")
    for name in ("wikilinks", "backlinks"):
        knowledge = knowledge.withField(name, void(knowledge[name]))
    return nodes.withColumn("domain_meta", domain).withColumn("knowledge_meta", knowledge)


def graph_json(graph: Graph) -> DataFrame:
    """SNK1, GRF14: one row (json): the graph in the order version, kind, project, nodes, edges, layers, tour, without absent fields."""
    nodes = _exported(graph.nodes)

    def listed(rows: DataFrame, columns: tuple[str, ...], order: str, name: str) -> DataFrame:
        items = F.array_sort(F.collect_list(F.struct(order, F.struct(*columns).alias("x"))), lambda a, b: F.when(a[order] < b[order], -1).when(a[order] > b[order], 1).otherwise(0))
        return rows.agg(F.transform(items, lambda i: i["x"]).alias(name))

    parts = graph.project.select(F.struct("*").alias("project"))
    parts = parts.join(listed(nodes, NODE_COLUMNS, "ord", "nodes")).join(listed(graph.edges, EDGE_COLUMNS, "ord", "edges"))
    parts = parts.join(listed(graph.layers, ("id", "name", "description", "node_ids"), "id", "layers"))
    parts = parts.join(listed(graph.tour, ("order", "title", "description", "node_ids", "language_lesson"), "order", "tour"))
    root = F.struct(F.lit(graph.version).alias("version"), F.lit(graph.kind).alias("kind"), "project", "nodes", "edges", "layers", "tour")
    return parts.select(F.to_json(root, {"pretty": "true"}).alias("json"))


def json_rows(graph: Graph | GraphRows) -> DataFrame:
    """SNK1, GRF14 as rows (section, ord, json); sorted by both they are in ``graph_json``'s order, without absent fields.

    Sections: 0 version, kind and project; 1 a node, 2 an edge, 3 a layer, 4 a member of a layer, 5 a step of the tour, 6 a stop of a step.
    """
    rows = rows_of(graph) if isinstance(graph, Graph) else graph
    number = lambda c: F.lpad(F.col(c).cast("string"), 9, "0")
    head = rows.project.select(F.lit(rows.version).alias("version"), F.lit(rows.kind).alias("kind"), F.struct("*").alias("project"))
    parts = [
        (head, F.lit(""), head.columns),
        (_exported(rows.nodes), F.col("ord"), NODE_COLUMNS),
        (rows.edges, F.col("ord"), EDGE_COLUMNS),
        (rows.layers, F.col("id"), ("id", "name", "description", "members")),
        (rows.members, F.concat("layer", F.lit(" "), number("position")), ("layer", "position", "id")),
        (rows.tour, number("order"), ("order", "title", "description", "language_lesson")),
        (rows.stops, F.concat(number("order"), F.lit(" "), number("position")), ("order", "position", "id")),
    ]
    made = [part.select(F.lit(k).alias("section"), ord_.alias("ord"), F.to_json(F.struct(*columns)).alias("json")) for k, (part, ord_, columns) in enumerate(parts)]
    return reduce(DataFrame.unionByName, made)


def write_rows(graph: Graph | GraphRows, path: str) -> str:
    """SNK1 for a graph of any size: a table for each part below a new name, to which the folder's header is then switched over.

    Readers see the graph before or this one as a whole. The one before stays for those who read it; the one before that goes.
    """
    rows = rows_of(graph) if isinstance(graph, Graph) else graph
    spark = rows.nodes.sparkSession
    before = json.loads(read_text(spark, f"{path}/current.json") or "{}")
    tables = f"graph-{uuid.uuid4().hex}"
    for name in ROW_TABLES:
        getattr(rows, name).write.parquet(f"{path}/{tables}/{name}")
    replace_text(spark, f"{path}/current.json", json.dumps({"version": rows.version, "kind": rows.kind, "tables": tables, "before": before.get("tables")}))
    if before.get("before"):
        remove(spark, f"{path}/{before['before']}")
    return path


def scan_json(stats: DataFrame) -> DataFrame:
    """SNK4: the statistics row as JSON."""
    return stats.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("json"))


def markdown_lines(graph: Graph | GraphRows, files: DataFrame | None = None) -> DataFrame:
    """RND3: (section, ord, line): overview, layers, files, imports, tree and tour; sorted by both they are the report."""
    graph = rows_of(graph) if isinstance(graph, Graph) else graph
    row = lambda rows, section, ord_, line: rows.select(F.lit(section).alias("section"), ord_.cast("string").alias("ord"), line.alias("line"))
    lit, col = F.lit, F.col
    spark = graph.nodes.sparkSession
    heads = ["# %s", "## Layers", "## Files", "## Imports", "## Directory tree", "## Tour"]
    titles = spark.createDataFrame([(k, "", t) for k, t in enumerate(heads) if k], "section int, ord string, line string")
    one = Q.overview(graph)
    facts = ["name", "languages", "complexity", "analyzed_at", "commit", "nodes", "edges", "layers"]
    table = F.array(lit("| | |"), lit("|---|---|"), *[F.concat(lit(f"| {f} | "), col(f).cast("string"), lit(" |")) for f in facts], F.concat(lit(""), col("description")))
    named = one.select(F.posexplode(F.concat(F.array(F.concat(lit("# "), "name")), F.filter(table, lambda x: x.isNotNull()))).alias("k", "line"))
    parts = [titles, row(named, 0, F.lpad(col("k").cast("string"), 3, "0"), col("line"))]
    number = lambda c: F.lpad(col(c).cast("string"), 9, "0")
    parts.append(row(graph.layers, 1, F.concat(lit("1"), "id"), F.format_string("### %s (%d)", "name", "members")))
    members = graph.members.join(graph.nodes.select("id", F.coalesce("file_path", "name").alias("label")), "id")
    parts.append(row(members, 1, F.concat(lit("1"), "layer", lit(" "), number("position")), F.concat(lit("- "), "label")))
    parts.append(row(Q.file_inventory(graph.nodes), 2, F.concat(lit("1"), "path"), F.format_string("| %s | %s | %s | %s |", "path", "language", "lines", "type")))
    imports = Q.import_list(graph.edges, graph.nodes)
    parts.append(row(imports, 3, F.concat(lit("1"), "source", lit(" "), "target"), F.concat(lit("- "), "source", lit(" → "), "target")))
    parts.append(row(imports.agg(F.count(lit(1)).alias("n")), 3, lit("2"), F.when(col("n") == 0, "No imports.").otherwise(F.format_string("%d imports.", "n"))))
    paths = files if files is not None else graph.nodes.where("file_path is not null").select(col("file_path").alias("path"))
    below = Q.tree(paths)
    parts.append(row(below, 4, F.concat(lit("1"), "sort_key"), F.concat(F.repeat(lit("  "), col("depth")), lit("- "), F.element_at(F.split("path", "/"), -1))))
    parts.append(row(graph.tour, 5, F.concat(lit("1"), number("order"), lit(" 0")), F.format_string("%d. **%s** %s", "order", "title", "description")))
    parts.append(row(graph.tour.where("language_lesson is not null"), 5, F.concat(lit("1"), number("order"), lit(" 1")), F.concat(lit("   > "), "language_lesson")))
    stops = graph.stops.join(graph.nodes.select("id", "file_path"), "id", "left").withColumn("label", F.coalesce("file_path", "id")).where("label is not null")
    parts.append(row(stops, 5, F.concat(lit("1"), number("order"), lit(" 2 "), number("position")), F.concat(lit("   - "), "label")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def markdown(graph: Graph, files: DataFrame | None = None) -> str:
    return "\n".join(r["line"] for r in markdown_lines(graph, files).orderBy("section", "ord").collect()) + "\n"


def payload(graph: Graph) -> DataFrame:
    """QRY16, QRY17: one row (nodes, links, layers): what the page draws, as JSON; links with an unknown end are left out."""
    shown = Q.display(graph.nodes).join(graph.nodes.select("id", "type", "summary"), "id")
    links = Q.valid_links(graph.edges, graph.nodes).select("source", "target", "type")
    pack = lambda rows, name: rows.agg(F.to_json(F.sort_array(F.collect_list(F.struct(*rows.columns)))).alias(name))
    layers = graph.layers.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("id", "node_ids"))))).alias("layers"))
    return pack(shown, "nodes").join(pack(links, "links")).join(layers)


def payload_rows(graph: Graph | GraphRows) -> DataFrame:
    """QRY16, QRY17 as rows (section, ord, json): 0 a node, 1 a link with two known ends, 2 a member of a layer; sorted by both they are in ``payload``'s order."""
    rows = rows_of(graph) if isinstance(graph, Graph) else graph
    number = F.lpad(F.col("position").cast("string"), 9, "0")
    links = Q.valid_links(rows.edges, rows.nodes).select("source", "target", "type")
    parts = [(Q.display(rows.nodes, "type", "summary"), F.col("id")), (links, F.concat_ws("\u0000", "source", "target", "type")), (rows.members.select("layer", "position", "id"), F.concat("layer", F.lit(" "), number))]
    made = [part.select(F.lit(k).alias("section"), ord_.alias("ord"), F.to_json(F.struct(*part.columns)).alias("json")) for k, (part, ord_) in enumerate(parts)]
    return reduce(DataFrame.unionByName, made)


_PAGE = """<!DOCTYPE html>
<html lang="en"><head><meta charset="utf-8"><title>{title}</title>
<style>body{{font-family:sans-serif;margin:1em}}#list li{{cursor:pointer}}</style></head>
<body><h1>{title}</h1><p>{facts}</p>
<input id="search" placeholder="Search"><ul id="list"></ul><pre id="detail"></pre>
<script>
const nodes = {nodes}, links = {links}, layers = {layers};
const list = document.getElementById("list"), detail = document.getElementById("detail");
function show(text) {{
  list.replaceChildren();
  for (const n of nodes) {{
    if (!(n.label + " " + n.summary).toLowerCase().includes(text.toLowerCase())) continue;
    const item = document.createElement("li");
    item.textContent = n.label;
    item.style.color = n.colour;
    item.onclick = () => {{
      const near = links.filter(l => l.source === n.id || l.target === n.id).slice(0, 10);
      detail.textContent = n.summary + "\\n" + near.map(l => l.type + " " + (l.source === n.id ? l.target : l.source)).join("\\n");
    }};
    list.append(item);
  }}
}}
document.getElementById("search").oninput = e => show(e.target.value);
show("");
</script></body></html>
"""


def dashboard(graph: Graph) -> str:
    """RND1: a page by itself that lists, searches and explains nodes. Nothing in its data can end the script."""
    one, data = Q.overview(graph).first(), payload(graph).first()
    facts = f"{one['languages']} · {one['complexity']} · {one['nodes']} nodes · {one['edges']} edges · {one['layers']} layers"
    safe = {k: (data[k] or "[]").replace("</", "<\\/") for k in ("nodes", "links", "layers")}
    return _PAGE.format(title=html.escape(one["name"]), facts=html.escape(facts), **safe)


def static_html(graph: Graph, files: DataFrame | None = None) -> str:
    """RND2: the sections of the Markdown report as a page without scripts."""
    rows = markdown_lines(graph, files).orderBy("section", "ord").collect()
    body = []
    for k in sorted({r["section"] for r in rows}):
        own = [r["line"] for r in rows if r["section"] == k]
        body.append(f"<section><h2>{html.escape(own[0].lstrip('# '))}</h2><pre>{html.escape(chr(10).join(own[1:]))}</pre></section>")
    return f'<!DOCTYPE html>\n<html lang="en"><head><meta charset="utf-8"><title>Report</title></head><body>{"".join(body)}</body></html>\n'


def export(graph: Graph, form: str, path: str, files: DataFrame | None = None) -> None:
    """SNK1-3, SNK8: writes html, static (html without scripts), md or markdown; anything else is JSON. Folders are made."""
    if form == "html":
        text = dashboard(graph)
    elif form == "static":
        text = static_html(graph, files)
    elif form in ("md", "markdown"):
        text = markdown(graph, files)
    else:
        text = graph_json(graph).first()["json"]
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(text, encoding="utf-8")


def parse_summary(parsed: DataFrame) -> DataFrame:
    """SNK6: (line) for each parsed file."""
    return parsed.select("path", F.format_string("%s: %d defs, %d imports", "path", F.size("definitions"), F.size("imports")).alias("line"))


def scan_summary(stats: dict, languages: list[tuple[str, int]]) -> str:
    """SNK5."""
    return "\n".join([f"{stats['total_files']} files | {stats['estimated_complexity']}", *[f"  {name}: {n}" for name, n in languages]])


