"""Nodes, edges, layers and tour of a project. Paths order everything that has an order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import columns as C
from graphloom.functions import taxonomy as T
from graphloom.functions.numbering import numbered
from graphloom.functions.spread import each, placed, shuffled
from graphloom.functions.storage import held

VERSION = "0.1.0"
NODE_COLUMNS = ("id", "type", "name", "file_path", "line_range", "summary", "tags", "complexity", "language_notes", "domain_meta", "knowledge_meta")
EDGE_COLUMNS = ("source", "target", "type", "direction", "description", "weight")
_DOMAIN = "struct<entities: array<string>, business_rules: array<string>, cross_domain_interactions: array<string>, entry_point: string, entry_type: string>"
_KNOWLEDGE = "struct<wikilinks: array<string>, backlinks: array<string>, category: string, content: string>"
#: The tables of ``GraphRows``.
ROW_TABLES = ("project", "nodes", "edges", "layers", "members", "tour", "stops")

# The texts of the guided tour.
TOUR_OVERVIEW = "This project contains %d files organized across %d directories. Start here to understand the high-level structure."
TOUR_OVERVIEW_LESSON = "A knowledge graph represents code as interconnected nodes — files, functions, classes — with edges showing how they relate."
TOUR_FOLDERS = "The project has %d top-level directories. Each contains related files grouped by purpose."
TOUR_FOLDERS_LESSON = "Contains edges (parent→child) show the file tree hierarchy in graph form."
TOUR_TYPES = (("file", "Source Code"), ("config", "Configuration"), ("document", "Documentation"), ("resource", "Infrastructure"), ("schema", "Data & Schemas"))
TOUR_TYPE = "%d %s files found. These define the project's %s."
TOUR_LAST = "Use the graph to trace imports, dependencies, and directory structure. Each edge type reveals a different relationship."
TOUR_LAST_LESSON = "Imports edges show module dependencies. Contains edges show directory hierarchy. Together they reveal the project's architecture."


@dataclass(frozen=True)
class Graph:
    """A finished graph. nodes and edges carry ``ord``, which orders them and isn't exported; nor are a model's findings (kind, message)."""

    project: DataFrame
    nodes: DataFrame
    edges: DataFrame
    layers: DataFrame
    tour: DataFrame
    version: str = VERSION
    kind: str | None = "codebase"
    findings: DataFrame | None = None


@dataclass(frozen=True)
class GraphRows:
    """A finished graph of any size: no row holds the ids of a whole layer or tour step.

    layers: (id, name, description, members); members: (layer, position, id);
    tour: (order, title, description, language_lesson); stops: (order, position, id).
    """

    project: DataFrame
    nodes: DataFrame
    edges: DataFrame
    layers: DataFrame
    members: DataFrame
    tour: DataFrame
    stops: DataFrame
    version: str = VERSION
    kind: str | None = "codebase"


def node_rows(rows: DataFrame, **given: Column) -> DataFrame:
    """The node columns, in order, with what is not given null; ``ord`` last."""
    kinds = {"line_range": "array<int>", "tags": "array<string>", "domain_meta": _DOMAIN, "knowledge_meta": _KNOWLEDGE}
    return rows.select(*[given.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in NODE_COLUMNS], given["ord"].alias("ord"))


def file_nodes(files: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    """GRF6: one node for each inventory row; the summary counts definitions and imports where a parsed row has any."""
    rows = files
    counts = F.lit(0), F.lit(0)
    if parsed is not None:
        # A path is parsed once; of repeated rows the larger counts stand.
        sizes = parsed.groupBy(F.col("path").alias("_path")).agg(F.max(F.size("definitions")).alias("_d"), F.max(F.size("imports")).alias("_i"))
        rows = files.join(shuffled(sizes), F.col("path") == F.col("_path"), "left")
        counts = F.coalesce("_d", F.lit(0)), F.coalesce("_i", F.lit(0))
    long = F.format_string("%s (%d lines, %d definitions, %d imports)", "language", "size_lines", *counts)
    short = F.format_string("%s (%d lines)", "language", "size_lines")
    return node_rows(
        rows,
        id=C.node_id(F.col("path")),
        type=C.node_type_of_category(F.col("file_category")),
        name=C.display_name(F.col("path")),
        file_path=F.col("path"),
        summary=F.when((counts[0] > 0) | (counts[1] > 0), long).otherwise(short),
        tags=F.array("language"),
        complexity=C.file_complexity(F.col("size_lines")),
        ord=F.concat(F.lit("1"), F.col("path")),
    )


def directory_nodes(files: DataFrame) -> DataFrame:
    """GRF8: one module node for each folder above a file."""
    return folder_nodes(files.select(F.explode(C.ancestors(F.col("path"))).alias("p")).distinct())


def folder_nodes(folders: DataFrame) -> DataFrame:
    """The module node of each folder (p)."""
    return node_rows(
        folders,
        id=C.node_id(F.col("p")),
        type=F.lit("module"),
        name=C.file_name(F.col("p")),
        summary=F.concat(F.lit("Directory: "), F.col("p")),
        tags=F.array(F.lit("directory")),
        complexity=F.lit("simple"),
        ord=F.concat(F.lit("2"), F.col("p")),
    )


def contains_edges(files: DataFrame) -> DataFrame:
    """GRF9: folder to folder and folder to file, each once; files at the root have none."""
    return contains_rows(contains_pairs(files).distinct())


def contains_pairs(files: DataFrame) -> DataFrame:
    """(p, c): each folder above each file and what lies next below it on the way to the file."""
    chain = F.concat(C.ancestors(F.col("path")), F.array("path"))
    steps = F.when(F.size(chain) > 1, F.transform(F.slice(chain, 2, F.greatest(F.size(chain) - 1, F.lit(1))), lambda c, k: F.struct(F.get(chain, k).alias("p"), c.alias("c"))))
    return files.select(F.explode(steps).alias("s")).select("s.p", "s.c")


def contains_counts(files: DataFrame) -> DataFrame:
    """(p, c, files): the pairs of ``contains_pairs`` counted, in several rows maybe. Files are counted by their folder, and the few folders' chains are taken apart for them."""
    last = F.length(F.substring_index("path", "/", -1))
    leaf = files.where(F.col("path").contains("/")).select(F.left("path", F.length("path") - last - 1).alias("p"), F.col("path").alias("c"), F.lit(1).cast("bigint").alias("files"))
    folders = leaf.groupBy("p").agg(F.count(F.lit(1)).alias("files"))
    chain = C.ancestors(F.col("p"))
    above = F.transform(chain, lambda c, k: F.struct(c.alias("p"), F.coalesce(F.get(chain, k + 1), F.col("p")).alias("c")))
    return leaf.unionByName(folders.select(F.explode(above).alias("s"), "files").select("s.p", "s.c", "files"))


def folder_counts(files: DataFrame) -> DataFrame:
    """(p, files): how many files lie below each folder, in several rows maybe; counted by their own folder first."""
    last = F.length(F.substring_index("path", "/", -1))
    own = files.where(F.col("path").contains("/")).select(F.left("path", F.length("path") - last - 1).alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("files"))
    return own.select(F.explode(F.concat(C.ancestors(F.col("p")), F.array("p"))).alias("p"), "files")


def contains_rows(pairs: DataFrame) -> DataFrame:
    """The edges of pairs (p, c)."""
    return pairs.select(
        C.node_id(F.col("p")).alias("source"),
        C.node_id(F.col("c")).alias("target"),
        F.lit("contains").alias("type"),
        F.lit("forward").alias("direction"),
        F.format_string("%s contains %s", "p", "c").alias("description"),
        F.lit(0.3).cast("float").alias("weight"),
        F.concat(F.lit("1"), F.col("p"), F.lit("\u0000"), F.col("c")).alias("ord"),
    )


def import_edges(parsed: DataFrame, parent_fallback: bool = False) -> DataFrame:
    """GRF10: an edge for each import that names a parsed file, by stem or whole path; of files that share a stem the first path stands for it.

    An import is looked up by its last part, else by its whole source; with ``parent_fallback`` then by the
    part before the last. Imports of itself are dropped; of several imports of one file the first gives the description.
    """
    return import_rows(import_links(imports_of(parsed), import_keys(parsed), parent_fallback))


def graph_parts(parsed: DataFrame) -> DataFrame:
    """What a graph takes of parsed rows: the number of definitions, as an array of marks, and the sources of imports."""
    return parsed.select("path", F.transform("definitions", lambda _: F.lit(True)).alias("definitions"), F.transform("imports", lambda i: F.struct(i["source"].alias("source"))).alias("imports"))


def import_keys(parsed: DataFrame) -> DataFrame:
    """(key, path): the names by which each parsed file can be imported, its stem and its whole path."""
    paths = parsed.select("path").distinct()
    return paths.select(F.explode(F.array_distinct(F.array(C.display_name(F.col("path")), F.col("path")))).alias("key"), "path")


def imports_of(parsed: DataFrame) -> DataFrame:
    """(path, position, source, last) of all imports."""
    return each(parsed, "imports", "i").select("path", "position", "i.source", F.element_at(F.split("i.source", "::"), -1).alias("last"))


def import_links(imports: DataFrame, keys: DataFrame, parent_fallback: bool = False, tasks: int | None = None, names: DataFrame | None = None) -> DataFrame:
    """(path, target_path, position, source): the files that imports name, each once for an importing file, by its first import of it.

    ``tasks``: on how many tasks imports meet the keys and each other. ``names``: (source, last) of all imports, each once, if they are known; then
    it is they that are looked up, and imports meet only what they lead to.
    """
    index = shuffled(placed(keys, tasks, "key").groupBy("key").agg(F.min("path").alias("target_path")))
    rows = imports if names is None else names
    looks = [F.col("last"), F.col("source")] + ([F.when(F.size(F.split("source", "::")) > 1, F.element_at(F.split("source", "::"), -2))] if parent_fallback else [])
    for k, look in enumerate(looks):
        rows = placed(rows.withColumn(f"_k{k}", look), tasks, f"_k{k}").join(index.select(F.col("key").alias(f"_k{k}"), F.col("target_path").alias(f"_t{k}")), f"_k{k}", "left")
    found = rows.withColumn("target_path", F.coalesce(*[F.col(f"_t{k}") for k in range(len(looks))])).where("target_path is not null")
    if names is not None:
        found = imports.join(shuffled(found.select("source", "last", "target_path")), ["source", "last"])
    found = found.where("target_path <> path").select("path", "target_path", "position", "source")
    # By the path alone, so that a file's imports are sorted once and not before they are sent as well.
    met = found.repartition("path") if tasks is None else placed(found, tasks, "path")
    one = met.groupBy("path", "target_path").agg(F.min(F.struct("position", "source")).alias("first"))
    return one.select("path", "target_path", "first.position", "first.source")


def import_rows(links: DataFrame) -> DataFrame:
    """The edges of ``import_links``."""
    return links.select(
        C.node_id(F.col("path")).alias("source"),
        C.node_id(F.col("target_path")).alias("target"),
        F.lit("imports").alias("type"),
        F.lit("forward").alias("direction"),
        F.format_string("%s imports %s", "path", "source").alias("description"),
        F.lit(0.5).cast("float").alias("weight"),
        F.concat(F.lit("2"), F.col("path"), F.lit("\u0000"), F.lpad(F.col("position").cast("string"), 9, "0")).alias("ord"),
    )


def layers(nodes: DataFrame, table: tuple = T.LAYERS, other: bool = True) -> DataFrame:
    """GRF12, LLM21: (id, name, description, node_ids) of the layers that have nodes; node ids in node order.

    A layer lists its members, as an export needs it; ``layer_members`` has the same as rows, which nothing gathers.
    """
    named = [*table, *([(*T.OTHER_LAYER, ())] if other else [])]
    words = lambda at: C.lookup({layer[0]: layer[at] for layer in named}, F.col("layer"))
    rows = layer_members(nodes, table)
    grouped = rows.groupBy("layer").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "id"))), lambda x: x["id"]).alias("node_ids"))
    return grouped.select(F.col("layer").alias("id"), words(1).alias("name"), words(2).alias("description"), "node_ids").where("name is not null").orderBy("id")


def layer_rows(nodes: DataFrame, table: tuple = T.LAYERS, other: bool = True) -> DataFrame:
    """(id, name, description, members): the layers of ``layers`` with the number of their nodes."""
    named = [*table, *([(*T.OTHER_LAYER, ())] if other else [])]
    words = lambda at: C.lookup({layer[0]: layer[at] for layer in named}, F.col("id"))
    rows = layer_members(nodes, table).groupBy(F.col("layer").alias("id")).agg(F.count(F.lit(1)).alias("members"))
    return rows.select("id", words(1).alias("name"), words(2).alias("description"), "members").where("name is not null")


def layer_positions(nodes: DataFrame, table: tuple = T.LAYERS, other: bool = True) -> DataFrame:
    """(layer, position, id): the members of ``layers`` as rows, from 0 in node order."""
    names = [layer[0] for layer in table] + ([T.OTHER_LAYER[0]] if other else [])
    rows = numbered(layer_members(nodes, table).where(F.col("layer").isin(names)), "layer", "ord", "id")
    first = rows.groupBy("layer").agg(F.min("n").alias("first"))
    return rows.join(F.broadcast(first), "layer").select("layer", (F.col("n") - F.col("first")).cast("int").alias("position"), "id")


def layer_members(nodes: DataFrame, table: tuple = T.LAYERS) -> DataFrame:
    """(layer, id, ord): each node once."""
    return nodes.select(C.layer_of(F.col("type"), table).alias("layer"), "id", "ord")


def layer_summary(nodes: DataFrame, table: tuple = T.LAYERS) -> DataFrame:
    """(id, name, nodes) of the layers that have nodes."""
    names = {layer[0]: layer[1] for layer in (*table, T.OTHER_LAYER)}
    return layer_members(nodes, table).groupBy(F.col("layer").alias("id")).agg(F.count(F.lit(1)).alias("nodes")).withColumn("name", C.lookup(names, F.col("id")))


def _first_ids(rows: DataFrame, key: str, n: int) -> DataFrame:
    """(key, node_ids): the first n ids of each key in node order; no more than n rows of a key leave a task."""
    order = Window.partitionBy(key).orderBy("ord")
    few = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n)
    return few.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "id"))), lambda x: x["id"]).alias("node_ids"))


def tour(nodes: DataFrame, list_folders: bool = True) -> DataFrame:
    """GRF13: (order, title, description, node_ids, language_lesson).

    The overview, the folders if there are any, a step for each type of file node, and a last step. The type
    steps are numbered from 3 even when there are no folders. Without ``list_folders`` the folders' step has no
    ids, as ``tour_stops`` has them as rows; all other steps have 10 ids at most.
    """
    spark = nodes.sparkSession
    files = nodes.where("file_path is not null")
    folders = nodes.where("file_path is null and type = 'module'")
    counts = nodes.agg(F.count_if(F.col("file_path").isNotNull()).alias("files"), F.count_if(F.expr("file_path is null and type = 'module'")).alias("folders"))
    no_ids = F.array().cast("array<string>")
    by_type = files.groupBy("type").agg(F.count(F.lit(1)).alias("n")).join(_first_ids(files, "type", 10), "type")
    ranks = spark.createDataFrame([(k, t, label) for k, (t, label) in enumerate(TOUR_TYPES)], "k int, type string, label string")
    typed = ranks.join(by_type, "type")
    steps = typed.select(
        (F.row_number().over(Window.orderBy("k")) + 2).alias("order"),
        F.concat("label", F.lit(" Files")).alias("title"),
        F.format_string(TOUR_TYPE, "n", F.lower("label"), F.lower("label")).alias("description"),
        "node_ids",
        F.lit(None).cast("string").alias("language_lesson"),
    )
    first = _first_ids(files.select("id", "ord", F.lit(0).alias("all")), "all", 5)
    overview = counts.join(first.select("node_ids"), how="left").select(
        F.lit(1).alias("order"), F.lit("Project Overview").alias("title"), F.format_string(TOUR_OVERVIEW, "files", "folders").alias("description"), F.coalesce("node_ids", no_ids).alias("node_ids"), F.lit(TOUR_OVERVIEW_LESSON).alias("language_lesson")
    )
    ids = F.transform(F.array_sort(F.collect_list(F.struct("ord", "id"))), lambda x: x["id"]) if list_folders else no_ids
    listed = folders.agg(ids.alias("node_ids"), F.count(F.lit(1)).alias("n")).where("n > 0")
    structure = listed.select(
        F.lit(2).alias("order"), F.lit("Directory Structure").alias("title"), F.format_string(TOUR_FOLDERS, "n").alias("description"), "node_ids", F.lit(TOUR_FOLDERS_LESSON).alias("language_lesson")
    )
    last = steps.agg(F.coalesce(F.max("order") + 1, F.lit(3)).alias("order")).select(
        "order", F.lit("Explore Connections").alias("title"), F.lit(TOUR_LAST).alias("description"), no_ids.alias("node_ids"), F.lit(TOUR_LAST_LESSON).alias("language_lesson")
    )
    return overview.unionByName(structure).unionByName(steps).unionByName(last)


def tour_stops(nodes: DataFrame) -> DataFrame:
    """(order, position, id): the ids of ``tour``'s steps as rows, from 0 in node order."""
    few = tour(nodes, list_folders=False).select("order", F.posexplode("node_ids").alias("position", "id"))
    folders = numbered(nodes.where("file_path is null and type = 'module'").select("id", "ord"), "ord", "id")
    return few.unionByName(folders.select(F.lit(2).alias("order"), (F.col("n") - 1).cast("int").alias("position"), "id"))


def project_row(files: DataFrame, name: str, analyzed_at: str | None = None, commit: str = "unknown", form: str = "%s project with %d files across %d languages. Complexity: %s.") -> DataFrame:
    """GRF3, GRF5: the project's one row. ``analyzed_at``: a time as text, now in UTC by default."""
    total = files.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size_lines"), F.lit(0)).alias("lines"), F.sort_array(F.collect_set("language")).alias("languages"))
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'") if analyzed_at is None else F.lit(analyzed_at)
    level = F.initcap(C.project_complexity(F.col("n"), F.col("lines")))
    return total.select(
        F.lit(name).alias("name"), "languages", F.array().cast("array<string>").alias("frameworks"), F.format_string(form, F.lit(name), "n", F.size("languages"), level).alias("description"), now.alias("analyzed_at"), F.lit(commit).alias("git_commit_hash")
    )


def build_graph(files: DataFrame, parsed: DataFrame, name: str, analyzed_at: str | None = None, commit: str = "unknown") -> Graph:
    """GRF4, GRF11, GRF14: the whole graph of an inventory and its parsed files."""
    nodes = file_nodes(files, parsed).unionByName(directory_nodes(files))
    edges = contains_edges(files).unionByName(import_edges(parsed))
    return Graph(project_row(files, name, analyzed_at, commit), nodes, edges, layers(nodes), tour(nodes))


def build_rows(files: DataFrame, parsed: DataFrame, name: str, analyzed_at: str | None = None, commit: str = "unknown") -> GraphRows:
    """The graph of ``build_graph`` with layers and tour as rows; nodes and edges are held in checkpoints."""
    nodes = held(file_nodes(files, parsed).unionByName(directory_nodes(files)))  # layers and each part of the tour read them
    edges = held(contains_edges(files).unionByName(import_edges(parsed)))  # counts and lists of a report read them, each parsed all files again
    steps = tour(nodes, list_folders=False).drop("node_ids")
    return GraphRows(project_row(files, name, analyzed_at, commit), nodes, edges, layer_rows(nodes), layer_positions(nodes), steps, tour_stops(nodes))


def rows_of(graph: Graph) -> GraphRows:
    """A graph with the arrays of its layers and tour as rows."""
    layers = graph.layers.select("id", "name", "description", F.size("node_ids").alias("members"))
    members = graph.layers.select(F.col("id").alias("layer"), F.posexplode("node_ids").alias("position", "id"))
    stops = graph.tour.select("order", F.posexplode("node_ids").alias("position", "id"))
    return GraphRows(graph.project, graph.nodes, graph.edges, layers, members, graph.tour.drop("node_ids"), stops, graph.version, graph.kind)
