"""Questions to a finished graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import columns as C
from graphloom.functions.spread import placed, shuffled
from graphloom.functions.storage import held
from graphloom.operators.graph import Graph, GraphRows


def label(path: str = "file_path", name: str = "name", id_: str = "id") -> Column:
    return F.coalesce(F.col(path), F.col(name), F.col(id_))


def graph_complexity(nodes: DataFrame) -> DataFrame:
    """QRY2: one row (complexity): complex if most nodes are, moderate if more are than simple ones, else simple."""
    n = {k: F.count_if(F.col("complexity") == k) for k in ("simple", "moderate", "complex")}
    return nodes.agg(F.when(n["complex"] > n["simple"] + n["moderate"], "complex").when(n["moderate"] > n["simple"], "moderate").otherwise("simple").alias("complexity"))


def overview(graph: Graph | GraphRows) -> DataFrame:
    """QRY1: one row of the project's name, languages, complexity, time, commit (null if unknown), description and counts."""
    count = lambda rows, name: rows.agg(F.count(F.lit(1)).alias(name))
    parts = graph.project.join(graph_complexity(graph.nodes)).join(count(graph.nodes, "nodes")).join(count(graph.edges, "edges")).join(count(graph.layers, "layers"))
    return parts.select("name", F.array_join("languages", ", ").alias("languages"), "complexity", "analyzed_at", F.nullif("git_commit_hash", F.lit("unknown")).alias("commit"), "nodes", "edges", "layers", "description")


def layer_listing(layers: DataFrame, nodes: DataFrame) -> DataFrame:
    """QRY3: (layer, members, position, label): the members that are nodes, and how many ids the layer has."""
    rows = layers.select(F.col("id").alias("layer"), F.size("node_ids").alias("members"), F.posexplode("node_ids").alias("position", "id"))
    return rows.join(nodes, "id").select("layer", "members", "position", F.coalesce("file_path", "name").alias("label"))


def layer_listing_rows(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """QRY3 for ``layer_positions``: (layer, members, position, label), without gathering a layer."""
    sizes = members.groupBy("layer").agg(F.count(F.lit(1)).alias("members"))  # a row for each layer of a fixed table
    rows = members.join(F.broadcast(sizes), "layer").join(nodes.select("id", F.coalesce("file_path", "name").alias("label")), "id")
    return rows.select("layer", "members", "position", "label")


def file_inventory(nodes: DataFrame) -> DataFrame:
    """QRY4: (path, language, lines, type) of the nodes of files; lines as the summary names them."""
    return nodes.where("file_path is not null").select(F.col("file_path").alias("path"), F.get("tags", F.lit(0)).alias("language"), C.summary_lines(F.col("summary")).alias("lines"), "type")


def import_list(edges: DataFrame, nodes: DataFrame, tasks: int | None = None) -> DataFrame:
    """QRY6: (source, target) labels of imports; an unknown end keeps its id."""
    ends = nodes.select("id", F.coalesce("file_path", "name").alias("label"))
    rows = edges.where("type = 'imports'").select("source", "target")
    for end in ("source", "target"):
        own = ends.select(F.col("id").alias(end), F.col("label").alias(f"{end}_label"))
        rows = placed(rows, tasks, end).join(shuffled(placed(own, tasks, end)), end, "left")
    return rows.select(F.coalesce("source_label", "source").alias("source"), F.coalesce("target_label", "target").alias("target"))


def tree_roots(edges: DataFrame) -> DataFrame:
    """QRY7: (id) of the sources of contains edges that no contains edge leads to."""
    inside = edges.where("type = 'contains'")
    return inside.select(F.col("source").alias("id")).distinct().join(inside.select(F.col("target").alias("id")), "id", "left_anti")


def tree(files: DataFrame) -> DataFrame:
    """QRY7: (depth, path, sort_key) of all folders and files of an inventory; ordered by sort_key they are the tree in pre-order."""
    below = F.concat(C.ancestors(F.col("path")), F.array("path"))
    paths = files.select(F.explode(below).alias("path")).distinct()
    # A folder's separator sorts before all other characters, so that its content follows it.
    return paths.select((F.size(F.split("path", "/")) - 1).alias("depth"), "path", F.translate("path", "/", "\u0001").alias("sort_key"))


def tree_of_graph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """QRY7 for a loaded graph: (id, depth, label) of all that the roots contain, each at its least depth; a step for each level, however deep.

    Each level is held in a checkpoint. Nodes on a cycle that no root leads to are in no tree.
    """
    inside = edges.where("type = 'contains'").select("source", "target")
    seen = level = tree_roots(edges).select("id", F.lit(0).alias("depth"))
    depth = 0
    while True:
        depth += 1
        level = held(level.join(inside, F.col("id") == F.col("source")).select(F.col("target").alias("id")).distinct().join(seen, "id", "left_anti").select("id", F.lit(depth).alias("depth")))
        if not level.limit(1).count():
            break
        seen = seen.unionByName(level)
    return seen.join(nodes, "id", "left").select("id", "depth", label().alias("label"))


def tour_listing(tour: DataFrame, nodes: DataFrame) -> DataFrame:
    """QRY8: (order, title, position, label) of all ids of all steps; steps without ids have one row, at position 0, without a label."""
    rows = tour.select("order", "title", F.posexplode_outer("node_ids").alias("position", "id"))
    return rows.join(nodes.select("id", "file_path"), "id", "left").select("order", "title", F.coalesce("position", F.lit(0)).alias("position"), F.coalesce("file_path", "id").alias("label"))


def tour_listing_rows(steps: DataFrame, stops: DataFrame, nodes: DataFrame) -> DataFrame:
    """QRY8 for ``tour_stops``: (order, title, position, label), without gathering a step."""
    named = stops.join(F.broadcast(steps.select("order", "title")), "order")  # a step for each type of file and three more
    bare = steps.join(stops.groupBy("order").agg(F.count(F.lit(1)).alias("n")), "order", "left_anti").select("order", "title", F.lit(None).cast("int").alias("position"), F.lit(None).cast("string").alias("id"))
    rows = named.select("order", "title", "position", "id").unionByName(bare)
    return rows.join(nodes.select("id", "file_path"), "id", "left").select("order", "title", F.coalesce("position", F.lit(0)).alias("position"), F.coalesce("file_path", "id").alias("label"))


def valid_links(edges: DataFrame, nodes: DataFrame, tasks: int | None = None) -> DataFrame:
    """QRY9: the edges with two known ends."""
    ids = shuffled(placed(nodes.select("id"), tasks, "id").distinct())
    known = placed(edges, tasks, "source").join(ids, F.col("source") == F.col("id"), "left_semi")
    return placed(known, tasks, "target").join(ids, F.col("target") == F.col("id"), "left_semi")


def dangling_edges(edges: DataFrame, nodes: DataFrame, tasks: int | None = None) -> DataFrame:
    """QRY12: (source, target, type, missing) of the edges with an unknown end; missing: source, target or both."""
    ids = placed(nodes.select("id"), tasks, "id").distinct()
    rows = placed(edges, tasks, "source").join(shuffled(ids.select(F.col("id").alias("s"))), F.col("source") == F.col("s"), "left")
    rows = placed(rows, tasks, "target").join(shuffled(ids.select(F.col("id").alias("t"))), F.col("target") == F.col("t"), "left")
    missing = F.when(F.col("s").isNull() & F.col("t").isNull(), "both").when(F.col("s").isNull(), "source").when(F.col("t").isNull(), "target")
    return rows.select("source", "target", "type", missing.alias("missing")).where("missing is not null")


def layer_coverage(nodes: DataFrame, layers: DataFrame) -> DataFrame:
    """QRY13: (id, layers) of the nodes that are not in exactly one layer."""
    member = layers.select(F.explode("node_ids").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("layers"))
    return nodes.select("id").join(member, "id", "left").select("id", F.coalesce("layers", F.lit(0)).alias("layers")).where("layers <> 1")


def degrees(edges: DataFrame) -> DataFrame:
    """(id, outgoing, incoming) of all ends of edges."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("e.id").agg(F.sum("e.o").alias("outgoing"), F.sum("e.i").alias("incoming"))


def neighbours(edges: DataFrame, nodes: DataFrame, ids: DataFrame, most: int = 10, tasks: int | None = None) -> DataFrame:
    """QRY10: for each of ``ids`` (id) its first ``most`` links in edge order, outgoing and incoming ones, without loops: (id, rank, total, other, way, type, label)."""
    # Both ways of an edge are made at once, so that edges are computed once.
    way = lambda a, b, name: F.struct(F.col(a).alias("id"), F.col(b).alias("other"), F.lit(name).alias("way"), "type", "ord")
    links = edges.where("source <> target").select(F.explode(F.array(way("source", "target", "out"), way("target", "source", "in"))).alias("w")).select("w.*")
    links = placed(links, tasks, "id").join(shuffled(placed(ids, tasks, "id")), "id", "left_semi")
    each_id = Window.partitionBy("id")
    counted = links.withColumn("rank", F.row_number().over(each_id.orderBy("ord", "way", "other"))).withColumn("total", F.count(F.lit(1)).over(each_id))
    names = nodes.select(F.col("id").alias("other"), F.coalesce("file_path", "name").alias("label"))
    rows = placed(counted.where(F.col("rank") <= most), tasks, "other").join(shuffled(placed(names, tasks, "other")), "other", "left")
    return rows.select("id", "rank", "total", "other", "way", "type", F.coalesce("label", "other").alias("label"))


def search(nodes: DataFrame, text: str) -> DataFrame:
    """QRY11: the nodes whose path, name or tags hold the text in any case, with a score from 0 (equal) to 1; an empty text finds all.

    The id counts only for a node without a path and a name.
    """
    wanted = F.lit(text.lower())
    hay = F.lower(F.concat_ws(" ", label(), F.when(F.col("file_path").isNotNull(), F.col("name")), F.array_join("tags", " ")))
    shown = F.lower(label())
    far = F.levenshtein(F.lower(F.col("name")), wanted) / F.greatest(F.length("name"), F.lit(len(text)), F.lit(1))
    return nodes.where(hay.contains(wanted)).select("id", shown.alias("label"), far.cast("float").alias("score"))


def visible(nodes: DataFrame, layers: DataFrame, hidden: list[str]) -> DataFrame:
    """QRY14: the nodes whose first layer, by id, is not hidden; nodes in no layer stay."""
    first = layers.select(F.col("id").alias("layer"), F.explode("node_ids").alias("id")).groupBy("id").agg(F.min("layer").alias("layer"))
    return nodes.join(first, "id", "left").where(F.col("layer").isNull() | ~F.col("layer").isin(*hidden)).select(*nodes.columns)


def highlighted(nodes: DataFrame, tour: DataFrame, step: int) -> DataFrame:
    """QRY15: (id, in_step) of all nodes."""
    ids = tour.where(F.col("order") == step).select(F.explode("node_ids").alias("id")).distinct().withColumn("in_step", F.lit(True))
    return nodes.select("id").join(ids, "id", "left").select("id", F.coalesce("in_step", F.lit(False)).alias("in_step"))


def highlighted_rows(nodes: DataFrame, stops: DataFrame, step: int) -> DataFrame:
    """QRY15 for ``tour_stops``: (id, in_step) of all nodes."""
    ids = stops.where(F.col("order") == step).select("id").distinct().withColumn("in_step", F.lit(True))
    return nodes.select("id").join(ids, "id", "left").select("id", F.coalesce("in_step", F.lit(False)).alias("in_step"))


# The colour of each node type, of unknown types, and the radius by complexity.
COLOURS = {
    "file": "#58a6ff", "function": "#79c0ff", "class": "#1f6feb", "module": "#a5d6ff", "config": "#d29922", "document": "#3fb950", "service": "#f0883e",
    "table": "#bc8cff", "endpoint": "#f778ba", "pipeline": "#e5534b", "schema": "#a371f7", "resource": "#db6d28", "concept": "#56d364",
    "domain": "#ff7b72", "flow": "#ffa198", "step": "#ffc2bb", "article": "#7ee787", "entity": "#68e0b8", "topic": "#aff5b4", "claim": "#d2a8ff", "source": "#e3b341",
}
UNKNOWN_COLOUR = "#8b949e"
RADIUS = {"complex": "10", "moderate": "8"}


def display(nodes: DataFrame, *more: str) -> DataFrame:
    """QRY17: (id, colour, radius, label) and ``more`` columns: the label is the last 15 characters of the path, name or id."""
    radius = F.coalesce(C.lookup(RADIUS, F.col("complexity")), F.lit("6")).cast("int")
    return nodes.select("id", F.coalesce(C.lookup(COLOURS, F.col("type")), F.lit(UNKNOWN_COLOUR)).alias("colour"), radius.alias("radius"), F.right(label(), F.lit(15)).alias("label"), *more)
