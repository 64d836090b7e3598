"""Registered queries of the library, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import columns as C
from graphloom.functions import taxonomy as T
from graphloom.functions.spread import each, placed, tasks_of
from graphloom.functions.storage import held, shared_folder
from graphloom.operators import assist as A
from graphloom.operators import definitions as D
from graphloom.operators import export as X
from graphloom.operators import frameworks as K
from graphloom.operators import graph as G
from graphloom.operators import ignore as R
from graphloom.operators import incremental as I
from graphloom.operators import merge as M
from graphloom.operators import outline as O
from graphloom.operators import parse as P
from graphloom.operators import query as Q
from graphloom.operators import scan as N
from graphloom.operators import search as S
from graphloom.operators import wiki as W
from graphloom.plans import oracle
from graphloom.sources import files as L
from graphloom.sources import virtual as V

Query = Callable[[SparkSession, str], DataFrame]


def _nodes(rows: DataFrame) -> DataFrame:
    return rows.select("id", "type", "name", "file_path", "summary", F.array_join("tags", ",").alias("tags"), "complexity")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return N.inventory(V.document_files(spark, d))


def _places(spark: SparkSession, d: str) -> DataFrame:
    return N.inventory(V.place_files(spark, d))


def _all_nodes(files: DataFrame) -> DataFrame:
    return G.file_nodes(files).unionByName(G.directory_nodes(files))


def _stored_nodes(spark: SparkSession, d: str) -> DataFrame:
    """What a tour needs of the documents' nodes, computed once."""
    return held(_all_nodes(_docs(spark, d)).select("id", "type", "name", "file_path", "ord"))


def _picked(number: Column, *texts: str) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in texts]), (number % len(texts) + 1).cast("int"))


def _parsed_parts(spark: SparkSession, d: str) -> DataFrame:
    return P.Registry().parse(V.part_sources(spark, d))


def _line_tasks(spark: SparkSession, d: str) -> int:
    """On how many tasks what is made of lines meets."""
    return tasks_of(V.table(spark, d, "lineitem"))


def _imports(spark: SparkSession, d: str) -> DataFrame:
    imports, files = V.import_lines(spark, d)
    return G.import_rows(G.import_links(imports, G.import_keys(files), tasks=_line_tasks(spark, d)))


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Edges of documents and of orders' imports; nodes of documents and parts: the orders are unknown."""
    files = _docs(spark, d)
    part = F.concat(F.lit("parts/p_"), F.col("p_partkey").cast("string"), F.lit(".rs"))
    parts = V.table(spark, d, "part").select(C.node_id(part).alias("id"), part.alias("file_path"), C.display_name(part).alias("name"))
    nodes = _all_nodes(files).select("id", "file_path", "name").unionByName(parts)
    return G.contains_edges(files).unionByName(_imports(spark, d)), nodes


def _place_graph(spark: SparkSession, d: str) -> G.Graph:
    files = _places(spark, d)
    return G.build_graph(files, P.Registry().parse(V.place_files(spark, d)), "places", "2025-01-01T00:00:00Z")


def _part_graph(spark: SparkSession, d: str) -> G.GraphRows:
    """The graph of all parts' source files."""
    sources = V.part_sources(spark, d)
    return G.build_rows(N.inventory(sources), P.Registry().parse(sources), "parts", "2025-01-01T00:00:00Z")


def project_stats(spark: SparkSession, d: str) -> DataFrame:
    return N.project_stats(_docs(spark, d)).withColumn("languages", F.array_join("languages", ","))


def exclusion_filter(spark: SparkSession, d: str) -> DataFrame:
    start = _picked(F.col("doc_id"), ".git/", "a/.git/", "target/", "b/node_modules/", ".github/", "src/.", "targets/", "src/")
    paths = V.table(spark, d, "documents").select(F.concat(start, F.lit("f"), F.col("doc_id").cast("string")).alias("path"))
    return paths.select("path", C.excluded(F.col("path")).alias("excluded"))


def node_ids(spark: SparkSession, d: str) -> DataFrame:
    path = F.col("path")
    return V.page_files(spark, d).select("path", C.node_id(path).alias("id"), C.display_name(path).alias("name"))


def category_node_types(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).groupBy("file_category", C.node_type_of_category(F.col("file_category")).alias("type")).agg(F.count(F.lit(1)).alias("files"))


def file_summary_join(spark: SparkSession, d: str) -> DataFrame:
    sources = V.part_sources(spark, d)
    return G.file_nodes(N.inventory(sources), P.Registry().parse(sources)).select("file_path", "summary")


def edge_union(spark: SparkSession, d: str) -> DataFrame:
    edges = G.contains_edges(_docs(spark, d)).unionByName(_imports(spark, d))
    return placed(edges, _line_tasks(spark, d), "source").groupBy("type").agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("source").alias("sources"))


def layers(spark: SparkSession, d: str) -> DataFrame:
    return G.layer_positions(_all_nodes(_docs(spark, d)))


def tour_steps(spark: SparkSession, d: str) -> DataFrame:
    """The steps of the documents' tour, with the number of their stops."""
    nodes = _stored_nodes(spark, d)
    stops = G.tour_stops(nodes).groupBy("order").agg(F.count(F.lit(1)).alias("stops"))
    return G.tour(nodes, list_folders=False).drop("node_ids").join(stops, "order", "left").select("order", "title", "description", "language_lesson", F.coalesce("stops", F.lit(0)).alias("stops"))


def overview(spark: SparkSession, d: str) -> DataFrame:
    return Q.overview(_place_graph(spark, d)).drop("analyzed_at")


def import_list(spark: SparkSession, d: str) -> DataFrame:
    return Q.import_list(*_mixed(spark, d), _line_tasks(spark, d))


def neighbours(spark: SparkSession, d: str) -> DataFrame:
    edges, nodes = _mixed(spark, d)
    return Q.neighbours(edges, nodes, nodes.select("id"), tasks=_line_tasks(spark, d))


def search_nodes(spark: SparkSession, d: str) -> DataFrame:
    return Q.search(_all_nodes(_docs(spark, d)), "C0").drop("score")


def layer_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Layers in which files are missing and configuration is twice."""
    nodes = _all_nodes(_docs(spark, d))
    rows = nodes.where("type <> 'file'").select("type", "id")
    members = rows.unionByName(rows.where("type = 'config'").select(F.lit("again").alias("type"), "id"))
    return Q.layer_coverage(nodes, members.select(F.array("id").alias("node_ids")))


def visible_nodes(spark: SparkSession, d: str) -> DataFrame:
    nodes = _all_nodes(_docs(spark, d))
    members = G.layer_members(nodes).select(F.col("layer").alias("id"), F.array("id").alias("node_ids"))
    return Q.visible(nodes, members, ["docs", "infra"]).select("id", "type")


def tour_highlight(spark: SparkSession, d: str) -> DataFrame:
    nodes = _stored_nodes(spark, d)
    return Q.highlighted_rows(nodes, G.tour_stops(nodes), 3)


def valid_links(spark: SparkSession, d: str) -> DataFrame:
    return Q.valid_links(*_mixed(spark, d), _line_tasks(spark, d)).select("source", "target", "type")


def _snapshot(operator: Callable[[DataFrame, DataFrame], DataFrame], spark: SparkSession, d: str) -> DataFrame:
    old, new = V.snapshots(spark, d)
    return operator(I.fingerprints(old), I.fingerprints(new))


def batches(spark: SparkSession, d: str) -> DataFrame:
    return A.batches(_docs(spark, d))


def alias_nodes(spark: SparkSession, d: str) -> DataFrame:
    text = _picked(F.col("event_id"), "fn", "FUNC", "mod", "doc", "route", "view", "click", "Terraform")
    return V.table(spark, d, "events").select("event_id", C.node_alias(text).alias("type"))


def alias_edges(spark: SparkSession, d: str) -> DataFrame:
    text = _picked(F.col("event_id"), "calls", "Invokes", "extends", "reads", "depends", "BuildsOn", "x")
    return V.table(spark, d, "events").select("event_id", C.edge_alias(text).alias("type"))


def extract_json(spark: SparkSession, d: str) -> DataFrame:
    return V.model_answers(spark, d).select("batch", C.extract_json(F.col("response")).alias("json"))


def llm_nodes(spark: SparkSession, d: str) -> DataFrame:
    nodes = A.answer_nodes(A.answer_items(V.model_answers(spark, d)))
    return nodes.select("id", "type", "name", F.array_join("line_range", "-").alias("lines"), F.array_join("tags", ",").alias("tags"), "complexity")


def llm_edges(spark: SparkSession, d: str) -> DataFrame:
    return A.answer_edges(A.answer_items(V.model_answers(spark, d))).select("source", "target", "type", "direction", "weight")


def ensure_files(spark: SparkSession, d: str) -> DataFrame:
    files = _docs(spark, d)
    nodes = G.file_nodes(N.code_files(files))
    return A.ensure_file_nodes(files, nodes).where(F.col("id").startswith("file-")).select("id", "file_path", "name", "summary")


def fallback_layers(spark: SparkSession, d: str) -> DataFrame:
    return A.fallback_layer_rows(V.typed_nodes(spark, d, T.NODE_TYPES))


def display_types(spark: SparkSession, d: str) -> DataFrame:
    return Q.display(V.typed_nodes(spark, d, (*T.NODE_TYPES, "other")), "type")


def tree_depths(spark: SparkSession, d: str) -> DataFrame:
    return Q.tree_of_graph(*V.contained_parts(spark, d))


def fallback_tour(spark: SparkSession, d: str) -> DataFrame:
    """The fallback tour of all parts' source files, a row for each stop."""
    return A.fallback_tour_rows(_all_nodes(N.inventory(V.part_sources(spark, d)))).drop("language_lesson")


def tour_listing(spark: SparkSession, d: str) -> DataFrame:
    nodes = _stored_nodes(spark, d)
    return Q.tour_listing_rows(G.tour(nodes, list_folders=False), G.tour_stops(nodes), nodes)


def layer_listing(spark: SparkSession, d: str) -> DataFrame:
    nodes = _all_nodes(_docs(spark, d))
    return Q.layer_listing_rows(G.layer_positions(nodes), nodes)


def graph_json(spark: SparkSession, d: str) -> DataFrame:
    """The graph of all parts as JSON, a row for each of its objects."""
    return X.json_rows(_part_graph(spark, d))


def markdown_lines(spark: SparkSession, d: str) -> DataFrame:
    return X.markdown_lines(_part_graph(spark, d))


def dashboard_payload(spark: SparkSession, d: str) -> DataFrame:
    return X.payload_rows(_part_graph(spark, d))


def markdown_sections(spark: SparkSession, d: str) -> DataFrame:
    """Headings of all documents, whose whole texts are parsed as Markdown files."""
    found = P.Registry([P.MARKDOWN]).parse(V.markdown_files(spark, d))
    return found.select("path", F.explode("sections").alias("s")).select("path", "s.title", "s.level", F.col("s.line_range")[0].alias("line"))


def _change(spark: SparkSession, d: str, imports: bool = False) -> M.Change:
    """What the changes to the new sources make of the state of the old ones; ``imports``: whether several tables take from parsed texts."""
    old, new = V.source_versions(spark, d)
    prints, found, parsed = I.looked_at(old)
    rows = held(I.compared(prints, new).where("status <> 'unchanged'").drop("hash"))
    return M.Change(M.full(found, held(G.graph_parts(parsed)) if imports else parsed), *I.changes_of(rows))


def merged_nodes(spark: SparkSession, d: str) -> DataFrame:
    change = _change(spark, d)
    return _nodes(change.nodes.unionByName(G.folder_nodes(change.folders)))


def merged_edges(spark: SparkSession, d: str) -> DataFrame:
    change = _change(spark, d, imports=True)
    return G.contains_rows(change.contains).unionByName(G.import_rows(change.links)).drop("ord")


def merged_layers(spark: SparkSession, d: str) -> DataFrame:
    return M.layer_names(_change(spark, d).layers).drop("description")


def _program_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sources = V.program_sources(spark, d)
    parsed = P.Registry().parse(sources)
    return D.definition_graph(sources, G.import_links(G.imports_of(parsed), G.import_keys(parsed)))


def definition_nodes(spark: SparkSession, d: str) -> DataFrame:
    nodes = D.definition_nodes(V.program_sources(spark, d))
    return nodes.select("id", "type", "name", "file_path", F.array_join("line_range", "-").alias("lines"), "summary", F.array_join("tags", ",").alias("tags"), "complexity")


def definition_edges(spark: SparkSession, d: str) -> DataFrame:
    return _program_graph(spark, d)[1].drop("ord")


def part_definition_nodes(spark: SparkSession, d: str) -> DataFrame:
    nodes = D.definition_nodes(V.part_sources(spark, d))
    return nodes.select("type", "name", "file_path", F.array_join("line_range", "-").alias("lines"))


def ignored_files(spark: SparkSession, d: str) -> DataFrame:
    files = V.ignoring_files(spark, d, R.IGNORE_FILE)
    return R.ignored(V.document_files(spark, d), files.where(C.file_name(F.col("path")) == R.IGNORE_FILE))


def ignoring_stats(spark: SparkSession, d: str) -> DataFrame:
    kept, left_out = R.without_ignored(V.ignoring_files(spark, d, R.IGNORE_FILE))
    return N.project_stats(N.inventory(kept), left_out).withColumn("languages", F.array_join("languages", ","))


def scored_search(spark: SparkSession, d: str) -> DataFrame:
    nodes, asked = V.name_queries(spark, d)
    return S.search_names(S.build_index(nodes), asked)


def _scripts(spark: SparkSession, d: str) -> DataFrame:
    return P.Registry([P.PYTHON, P.TYPESCRIPT]).parse(V.script_sources(spark, d))


def script_endpoints(spark: SparkSession, d: str) -> DataFrame:
    return each(_scripts(spark, d), "endpoints", "e").select("path", "position", "e.method", F.col("e.path").alias("route"), F.col("e.line_range")[0].alias("line"))


def _stacks(spark: SparkSession, d: str) -> DataFrame:
    return P.Registry([O.YAML]).parse(V.stack_files(spark, d))


def compose_services(spark: SparkSession, d: str) -> DataFrame:
    return _stacks(spark, d).select("path", F.posexplode("services").alias("position", "s")).select("path", "position", "s.name", "s.image", F.array_join("s.ports", ",").alias("ports"))


def workflow_steps(spark: SparkSession, d: str) -> DataFrame:
    return _stacks(spark, d).select("path", F.posexplode("steps").alias("position", "s")).select("path", "position", "s.name", "s.command", F.col("s.line_range")[0].alias("line"))


def wiki_links(spark: SparkSession, d: str) -> DataFrame:
    return W.links(V.articles(spark, d))


def wiki_backlinks(spark: SparkSession, d: str) -> DataFrame:
    return W.backlinks(W.links(V.articles(spark, d)))


def wiki_counts(spark: SparkSession, d: str) -> DataFrame:
    articles = V.articles(spark, d)
    return W.link_counts(articles, W.links(articles))


def manifest_frameworks(spark: SparkSession, d: str) -> DataFrame:
    return K.frameworks(K.dependencies(V.manifests(spark, d)))


def project_frameworks(spark: SparkSession, d: str) -> DataFrame:
    files = V.manifests(spark, d)
    project = K.with_frameworks(G.project_row(N.inventory(files), "apps", "2025-01-01T00:00:00Z"), K.frameworks(K.dependencies(files)))
    return project.select("name", F.array_join("languages", ",").alias("languages"), F.array_join("frameworks", ",").alias("frameworks"), "analyzed_at")


def answer_layers(spark: SparkSession, d: str) -> DataFrame:
    """The layers of each usable answer, a row for each."""
    rows = A.answer_layers(V.agent_answers(spark, d)["layers"]).select("batch", F.posexplode("layers").alias("position", "x"))
    return rows.select("batch", "position", "x.id", "x.name", "x.description", F.array_join("x.node_ids", ",").alias("node_ids"))


def answer_tour(spark: SparkSession, d: str) -> DataFrame:
    rows = A.answer_tour(V.agent_answers(spark, d)["tour"]).select("batch", F.posexplode("tour").alias("position", "x"))
    return rows.select("batch", "position", "x.order", "x.title", "x.description", F.array_join("x.node_ids", ",").alias("node_ids"), "x.language_lesson")


def merged_tour(spark: SparkSession, d: str) -> DataFrame:
    """All answers' steps as one tour."""
    return A.merged_tour(A.answer_tour(V.agent_answers(spark, d)["tour"])).select("order", "title", "description", F.array_join("node_ids", ",").alias("node_ids"))


def layer_assignment(spark: SparkSession, d: str) -> DataFrame:
    """The one layer of each part: the first that an answer names, else by the rules for its type."""
    nodes = V.typed_nodes(spark, d, T.NODE_TYPES).withColumn("id", F.regexp_replace("id", "^n", "a"))
    return A.layer_members(A.answer_layers(V.agent_answers(spark, d)["layers"]), nodes).select("layer", "node")


def review_findings(spark: SparkSession, d: str) -> DataFrame:
    return A.review_findings(V.agent_answers(spark, d)["review"])


def _stored(spark: SparkSession, d: str) -> G.GraphRows:
    """The documents' graph, written to the shared folder and read back."""
    files = V.document_files(spark, d)
    graph = G.build_rows(N.inventory(files), P.Registry().parse(files), "documents", "2025-01-01T00:00:00Z")
    return L.load_rows(spark, X.write_rows(graph, shared_folder(spark, "graph")))


def stored_tour(spark: SparkSession, d: str) -> DataFrame:
    graph = _stored(spark, d)
    return Q.tour_listing_rows(graph.tour, graph.stops, graph.nodes)


def _snapshot_of_old(spark: SparkSession, d: str, builds: Callable[[SparkSession, str], tuple[DataFrame, DataFrame]]) -> tuple[str, DataFrame]:
    """A folder with the snapshot of the old files, and the new files."""
    old, new = builds(spark, d)
    place = shared_folder(spark, "snapshots")
    I.full_state(old, place, "first", "2025-01-01T00:00:00Z")
    return place, new


def stored_status(spark: SparkSession, d: str) -> DataFrame:
    """What became of the files of a snapshot that was written and read back."""
    place, new = _snapshot_of_old(spark, d, V.snapshots)
    return I.snapshot_status(L.read_snapshot(spark, place)[0], I.fingerprints(new))


def incremental_edges(spark: SparkSession, d: str) -> DataFrame:
    """A full build with a snapshot, then an incremental one of the new files, which leaves another."""
    place, new = _snapshot_of_old(spark, d, V.source_versions)
    return I.changed_state(new, place, "second", "2025-01-02T00:00:00Z").edges().drop("ord")


def queries() -> dict[str, Query]:
    one = lambda operator, source: lambda s, d: operator(source(s, d))
    return {
        "scan_inventory": _docs,
        "scan_pages": one(N.inventory, V.page_files),
        "language_counts": one(N.language_counts, _docs),
        "category_counts": one(N.category_counts, _docs),
        "project_stats": project_stats,
        "exclusion_filter": exclusion_filter,
        "node_ids": node_ids,
        "file_nodes": lambda s, d: _nodes(G.file_nodes(_docs(s, d))),
        "directory_nodes": lambda s, d: _nodes(G.directory_nodes(_places(s, d))),
        "directory_nodes_pages": lambda s, d: _nodes(G.directory_nodes(N.inventory(V.page_files(s, d)))),
        "contains_edges": lambda s, d: G.contains_edges(_docs(s, d)).drop("ord"),
        "category_node_types": category_node_types,
        "parse_definitions": one(P.definition_rows, _parsed_parts),
        "parse_imports": one(P.import_rows, _parsed_parts),
        "file_summary_join": file_summary_join,
        "import_edges": lambda s, d: _imports(s, d).drop("ord"),
        "edge_union": edge_union,
        "layer_membership": lambda s, d: G.layer_members(_all_nodes(_docs(s, d))).drop("ord"),
        "layer_summary": lambda s, d: G.layer_summary(_all_nodes(_docs(s, d))),
        "layers": layers,
        "tour_steps": tour_steps,
        "graph_complexity": lambda s, d: Q.graph_complexity(_all_nodes(_docs(s, d))),
        "overview": overview,
        "file_inventory": lambda s, d: Q.file_inventory(G.file_nodes(_docs(s, d))),
        "import_list": import_list,
        "tree_roots": lambda s, d: Q.tree_roots(G.contains_edges(_docs(s, d))),
        "tree_preorder": one(Q.tree, _docs),
        "neighbours": neighbours,
        "search_nodes": search_nodes,
        "valid_links": valid_links,
        "dangling_edges": lambda s, d: Q.dangling_edges(*_mixed(s, d), _line_tasks(s, d)),
        "degrees": one(Q.degrees, _imports),
        "layer_coverage": layer_coverage,
        "visible_nodes": visible_nodes,
        "tour_highlight": tour_highlight,
        "tour_listing": tour_listing,
        "layer_listing": layer_listing,
        "display_attributes": lambda s, d: Q.display(_all_nodes(_docs(s, d))),
        "fingerprints": one(I.fingerprints, V.document_files),
        "changed_files": partial(_snapshot, I.changed_files),
        "snapshot_status": partial(_snapshot, I.snapshot_status),
        "batches": batches,
        "project_context": lambda s, d: A.project_context(N.project_stats(_docs(s, d))),
        "alias_nodes": alias_nodes,
        "alias_edges": alias_edges,
        "extract_json": extract_json,
        "llm_nodes": llm_nodes,
        "llm_edges": llm_edges,
        "ensure_files": ensure_files,
        "fallback_layers": fallback_layers,
        "fallback_tour": fallback_tour,
        "graph_json": graph_json,
        "markdown_lines": markdown_lines,
        "markdown_sections": markdown_sections,
        "script_definitions": one(P.definition_rows, _scripts),
        "script_imports": one(P.import_rows, _scripts),
        "script_endpoints": script_endpoints,
        "compose_services": compose_services,
        "workflow_steps": workflow_steps,
        "wiki_links": wiki_links,
        "wiki_backlinks": wiki_backlinks,
        "wiki_counts": wiki_counts,
        "manifest_frameworks": manifest_frameworks,
        "project_frameworks": project_frameworks,
        "answer_layers": answer_layers,
        "answer_tour": answer_tour,
        "merged_tour": merged_tour,
        "layer_assignment": layer_assignment,
        "review_findings": review_findings,
        "display_types": display_types,
        "tree_depths": tree_depths,
        "merged_nodes": merged_nodes,
        "merged_edges": merged_edges,
        "merged_layers": merged_layers,
        "definition_nodes": definition_nodes,
        "definition_edges": definition_edges,
        "part_definition_nodes": part_definition_nodes,
        "ignored_files": ignored_files,
        "ignoring_stats": ignoring_stats,
        "scored_search": scored_search,
        "dashboard_payload": dashboard_payload,
        "stored_nodes": lambda s, d: _nodes(_stored(s, d).nodes),
        "stored_edges": lambda s, d: _stored(s, d).edges.drop("ord"),
        "stored_tour": stored_tour,
        "stored_status": stored_status,
        "incremental_edges": incremental_edges,
    }


def oracle_sql() -> dict[str, str]:
    return oracle.sql()
