"""Graphs from an external model's answers: batches, prompts, and the rows in the answers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import columns as C
from graphloom.functions import taxonomy as T
from graphloom.functions.numbering import numbered
from graphloom.functions.storage import held
from graphloom.operators import graph as G
from graphloom.operators.scan import project_stats

#: LLM1: answers a prompt for a named agent.
Dispatcher = Callable[[str, str], str]


@dataclass(frozen=True)
class AnalysisConfig:
    """LLM2."""

    max_files_per_batch: int = 5
    max_concurrent: int = 3
    use_llm_analysis: bool = False
    max_file_lines: int = 2000


def batches(files: DataFrame, config: AnalysisConfig = AnalysisConfig()) -> DataFrame:
    """LLM3: (batch, path) of the files that are short enough, in path order, batches numbered from 0."""
    if config.max_files_per_batch < 1:
        raise ValueError("a batch needs a file at least")
    rows = numbered(files.where(F.col("size_lines") <= config.max_file_lines).select("path"), "path")
    return rows.select(F.floor((F.col("n") - 1) / config.max_files_per_batch).cast("bigint").alias("batch"), "path")


def project_context(stats: DataFrame) -> DataFrame:
    """LLM4: one sentence about the project."""
    return stats.select(F.format_string("The project has %d files and %d lines in %s; its complexity is %s.", "total_files", "total_lines", F.array_join("languages", ", "), "estimated_complexity").alias("context"))


_FILE_PROMPT = (
    "Analyse the file %s, written in %s.\n%s\nAnswer with one JSON object with the keys file_summary, complexity "
    "(simple, moderate or complex), tags, nodes (objects with id, type, name, file_path, line_range, summary, tags, complexity), "
    "edges (objects with source, target, type, direction, description, weight), imports and exports.\n\n%s\n"
)
_AGENT_PROMPTS = {
    "architecture-analyzer": "Group the nodes of this graph into layers. Answer with a JSON array of objects with the keys id, name, description and node_ids.\n",
    "tour-builder": "Plan a guided tour of this graph. Answer with a JSON array of objects with the keys order, title, description, node_ids and language_lesson.\n",
    "graph-reviewer": "Review this graph. Answer with a JSON object with the keys issues (objects with severity and message), dangling_edges, missing_coverage and improvements.\n",
}


def file_prompts(files: DataFrame, contents: DataFrame, config: AnalysisConfig = AnalysisConfig()) -> DataFrame:
    """SRC8, LLM5: (batch, prompt), the prompts of a batch's files in path order; files without a text are left out."""
    context = project_context(project_stats(files))
    rows = batches(files, config).join(files.select("path", "language"), "path").join(contents.where("content is not null"), "path").join(F.broadcast(context))
    one = F.format_string(_FILE_PROMPT, "path", "language", "context", F.col("content").cast("string"))
    grouped = rows.select("batch", "path", one.alias("p")).groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("path", "p"))).alias("ps"))
    return grouped.select("batch", F.array_join(F.transform("ps", lambda x: x["p"]), "\n").alias("prompt"))


def graph_prompts(agent: str, context: DataFrame, nodes: DataFrame, edges: DataFrame, lines: int = 500, layers: DataFrame | None = None, tour: DataFrame | None = None) -> DataFrame:
    """LLM6-8: (batch, prompt): the whole graph for an agent, its nodes in order and then its edges, ``lines`` of them in a prompt.

    With ``layers`` each node names its layer, and a line for each layer follows; with ``tour`` a line for each step and each of its stops. So no line
    grows with a layer. A graph of up to ``lines`` lines is one prompt; a graph without any gives none.
    """
    node = ["id", "type", "name", "file_path", "summary", "tags", "complexity"]
    line = lambda rows, part, order, *columns: rows.select(F.lit(part).alias("part"), order.alias("ord"), F.to_json(F.struct(*columns)).alias("line"))
    number = lambda c: F.lpad(F.col(c).cast("string"), 12, "0")
    more = []
    if layers is not None:
        member = layers.select(F.col("id").alias("layer"), F.explode("node_ids").alias("id")).groupBy("id").agg(F.min("layer").alias("layer"))
        nodes, node = nodes.join(member, "id", "left"), [*node, "layer"]
        more.append(line(layers, 2, F.col("id"), F.col("id").alias("layer"), "name", "description"))
    if tour is not None:
        more.append(line(tour, 3, number("order"), F.col("order").alias("step"), "title", "description", "language_lesson"))
        stops = tour.select("order", F.posexplode("node_ids").alias("position", "node_id"))
        more.append(line(stops, 4, F.concat(number("order"), number("position")), F.col("order").alias("step"), "node_id"))
    shown = line(nodes, 0, F.col("ord"), *node).unionByName(line(edges, 1, F.col("ord"), "source", "target", "type", "direction"))
    for part in more:
        shown = shown.unionByName(part)
    rows = numbered(shown, "part", "ord", "line").withColumn("batch", F.floor((F.col("n") - 1) / lines).cast("bigint"))
    grouped = rows.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("ls"))
    text = F.concat_ws("\n", F.lit(_AGENT_PROMPTS[agent].rstrip()), "context", F.array_join(F.transform("ls", lambda x: x["line"]), "\n"))
    return grouped.join(F.broadcast(context)).select("batch", text.alias("prompt"))  # one row


def ask(prompts: DataFrame, dispatch: Dispatcher, path: str, config: AnalysisConfig = AnalysisConfig(), agent: str = "file-analyzer") -> DataFrame:
    """(batch, response) of all prompts, by ``max_concurrent`` tasks at a time, written to ``path`` so that no prompt is asked again."""

    def run(frames):
        for frame in frames:
            frame["response"] = [dispatch(agent, p) for p in frame["prompt"]]
            yield frame[["batch", "response"]]

    answers = prompts.repartition(max(1, config.max_concurrent)).mapInPandas(run, "batch bigint, response string")
    answers.write.parquet(path)
    return prompts.sparkSession.read.schema("batch bigint, response string").parquet(path)


def answer_items(responses: DataFrame) -> DataFrame:
    """LLM11: (batch, item, value) of the objects in each answer, an array's elements one by one; answers that are no JSON give none.

    Answers are taken apart once, into a checkpoint: nodes and edges are both read from there. What an answer is shows in its first character,
    as white space around it is gone; the schema of a variant is that of all within it.
    """
    json = responses.select("batch", C.extract_json(F.col("response")).alias("json"))
    rows = held(json.select("batch", F.substring("json", 1, 1).alias("kind"), F.try_parse_json("json").alias("v"))).where("v is not null")
    each = F.when(F.col("kind") == "[", F.try_variant_get("v", "$", "array<variant>")).when(F.col("kind") == "{", F.array("v"))
    # Outer explodes, of which the empty ones go: before an inner one Spark filters on the array's size, and so computes the array twice.
    return rows.select("batch", F.posexplode_outer(each).alias("item", "v")).where("item is not null")


def unreadable(responses: DataFrame) -> DataFrame:
    """The batches whose answer is neither an object nor an array, for a warning."""
    value = F.try_parse_json(C.extract_json(F.col("response")))
    return responses.where(F.coalesce(~F.schema_of_variant(value).rlike("^(OBJECT|ARRAY)"), F.lit(True))).select("batch")


def _elements(items: DataFrame, key: str) -> DataFrame:
    """(batch, item, pos, v): the elements of each item's array of that name; what is no array has none."""
    found = F.try_variant_get("v", f"$.{key}", "array<variant>")
    return items.select("batch", "item", F.posexplode_outer(found).alias("pos", "v")).where("pos is not null")


def _text(key: str):
    """A text field; values of other kinds count as absent."""
    field = F.try_variant_get("v", f"$.{key}", "variant")
    return F.when(F.schema_of_variant(field) == "STRING", F.try_variant_get("v", f"$.{key}", "string"))


_NODE_TEXTS = ("id", "type", "name", "file_path", "summary", "complexity", "language_notes")


def answer_nodes(items: DataFrame) -> DataFrame:
    """LLM12, LLM13: nodes in the order of batch, item and place, absent fields by default; ``node-{number}`` for an absent id."""
    # Fields are taken out of each node at once, before the numbers' sort, which then moves texts only.
    parts = ", ".join(f"{c}: variant" for c in (*_NODE_TEXTS, "line_range", "tags"))
    v = F.try_variant_get("v", "$", f"struct<{parts}>")
    read = _elements(items, "nodes").select("batch", "item", "pos", v.alias("v")).select("batch", "item", "pos", "v.*")
    lines, tags = F.try_variant_get("line_range", "$", "array<variant>"), F.try_variant_get("tags", "$", "array<variant>")
    texts = [F.try_variant_get(F.when(F.schema_of_variant(c) == "STRING", F.col(c)), "$", "string").alias(c) for c in _NODE_TEXTS]
    tag_texts = F.transform(F.filter(tags, lambda t: F.schema_of_variant(t) == "STRING"), lambda t: F.variant_get(t, "$", "string"))
    line = F.when(F.size(lines) >= 2, F.transform(F.slice(lines, 1, 2), lambda n: F.coalesce(F.try_variant_get(n, "$", "int"), F.lit(0))))
    # Ranges are drawn by a pass over all rows before the one that sorts them; neither takes the nodes apart again.
    rows = numbered(held(read.select("batch", "item", "pos", *texts, line.alias("line_range"), tag_texts.alias("tags"))), "batch", "item", "pos")
    level = F.lower("complexity")
    return G.node_rows(
        rows,
        id=F.coalesce("id", F.concat(F.lit("node-"), F.col("n").cast("string"))),
        type=F.coalesce(C.node_alias(F.col("type")), F.lit("file")),
        name=F.coalesce("name", F.lit("unknown")),
        file_path=F.col("file_path"),
        line_range=F.col("line_range"),
        summary=F.coalesce("summary", F.lit("")),
        tags=F.coalesce("tags", F.array().cast("array<string>")),
        complexity=F.when(level.isin("complex", "moderate"), level).otherwise("simple"),
        language_notes=F.col("language_notes"),
        ord=F.lpad(F.col("n").cast("string"), 12, "0"),
    )


def answer_edges(items: DataFrame) -> DataFrame:
    """LLM12, LLM14: edges that have a source and a target, other absent fields by default."""
    rows = _elements(items, "edges").where(_text("source").isNotNull() & _text("target").isNotNull())
    number = lambda c: F.lpad(F.col(c).cast("string"), 12, "0")
    return rows.select(
        _text("source").alias("source"),
        _text("target").alias("target"),
        C.edge_alias(F.coalesce(_text("type"), F.lit("related"))).alias("type"),
        F.when(_text("direction").isNull(), "forward").otherwise(C.direction_alias(_text("direction"))).alias("direction"),
        _text("description").alias("description"),
        F.coalesce(F.try_variant_get("v", "$.weight", "float"), F.lit(0.5)).cast("float").alias("weight"),
        F.concat_ws("-", number("batch"), number("item"), number("pos")).alias("ord"),
    )


def ensure_file_nodes(files: DataFrame, nodes: DataFrame, asked: int | None = None) -> DataFrame:
    """LLM17: the nodes with one more for each file that none names; these are numbered on from the nodes that were answered."""
    start = nodes.count() if asked is None else asked
    missing = files.join(nodes.select(F.col("file_path").alias("path")), "path", "left_anti")
    rows = numbered(missing, "path")
    added = G.node_rows(
        rows,
        id=F.concat(F.lit("file-"), (F.col("n") + start).cast("string")),
        type=F.lit("file"),
        name=C.file_name(F.col("path")),
        file_path=F.col("path"),
        summary=F.format_string("%s file (%d lines, %s)", "language", "size_lines", "path"),
        tags=F.array("language"),
        complexity=C.file_complexity(F.col("size_lines")),
        ord=F.concat(F.lit("f"), F.col("path")),
    )
    return nodes.unionByName(added)


_LAYERS = "array<struct<id: string, name: string, description: string, node_ids: array<string>>>"
_STEPS = "array<struct<`order`: int, title: string, description: string, node_ids: array<string>, language_lesson: string>>"


def answer_layers(responses: DataFrame) -> DataFrame:
    """LLM19: (key..., layers) with the array of layers in ``response``; null where it is no array or any layer lacks id or name."""
    parsed = F.from_json(C.extract_json(F.col("response")), _LAYERS)
    whole = F.forall(parsed, lambda x: x["id"].isNotNull() & x["name"].isNotNull())
    filled = F.transform(parsed, lambda x: F.struct(x["id"].alias("id"), x["name"].alias("name"), F.coalesce(x["description"], F.lit("")).alias("description"), F.coalesce(x["node_ids"], F.array().cast("array<string>")).alias("node_ids")))
    return responses.withColumn("layers", F.when(C.extract_json(F.col("response")).startswith("[") & whole, filled)).drop("response")


def answer_tour(responses: DataFrame) -> DataFrame:
    """LLM20: (key..., tour) with the array of steps in ``response``, absent fields by default; null where it is no array."""
    parsed = F.from_json(C.extract_json(F.col("response")), _STEPS)
    filled = F.transform(
        parsed,
        lambda x: F.struct(
            F.coalesce(x["order"], F.lit(0)).alias("order"), F.coalesce(x["title"], F.lit("Untitled Step")).alias("title"), F.coalesce(x["description"], F.lit("")).alias("description"),
            F.coalesce(x["node_ids"], F.array().cast("array<string>")).alias("node_ids"), x["language_lesson"].alias("language_lesson"),
        ),
    )
    return responses.withColumn("tour", F.when(C.extract_json(F.col("response")).startswith("["), filled)).drop("response")


def fallback_layers(nodes: DataFrame) -> DataFrame:
    """LLM21."""
    return G.layers(nodes, T.FALLBACK_LAYERS, other=False)


def fallback_layer_rows(nodes: DataFrame) -> DataFrame:
    """LLM21 as rows: (id, name, description, members), without gathering a layer."""
    return G.layer_rows(nodes, T.FALLBACK_LAYERS, other=False)


def fallback_tour(nodes: DataFrame) -> DataFrame:
    """LLM22: an overview with the first five files, and all files."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("ord", "id"))), lambda x: x["id"])
    return _fallback_steps(nodes.where("file_path is not null").agg(ids.alias("node_ids"), F.count(F.lit(1)).alias("n")))


def fallback_tour_rows(nodes: DataFrame) -> DataFrame:
    """LLM22 as rows: (order, title, description, language_lesson, position, id), one for each id of a step from 0 in node order; without files one row a step, without an id."""
    files = nodes.where("file_path is not null").select("id", "ord")
    none = F.array().cast("array<string>")
    steps = _fallback_steps(files.agg(none.alias("node_ids"), F.count(F.lit(1)).alias("n"))).drop("node_ids")
    at = numbered(files, "ord", "id").withColumn("position", (F.col("n") - 1).cast("int"))
    stops = at.withColumn("order", F.explode(F.when(F.col("position") < 5, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(2))))).select("order", "position", "id")
    columns = ("order", "title", "description", "language_lesson", "position", "id")
    empty = steps.join(files.agg(F.count(F.lit(1)).alias("n"))).where("n = 0").select("*", F.lit(None).cast("int").alias("position"), F.lit(None).cast("string").alias("id"))
    return stops.join(F.broadcast(steps), "order").select(*columns).unionByName(empty.select(*columns))


def _fallback_steps(whole: DataFrame) -> DataFrame:
    """The two steps of the fallback tour of all files' ids (node_ids) and their number (n)."""
    # The titles and sentences of the two steps.
    first = whole.select(
        F.lit(1).alias("order"), F.lit("Project Overview").alias("title"),
        F.format_string("This project contains %d files. Start here to understand the high-level structure.", "n").alias("description"),
        F.slice("node_ids", 1, 5).alias("node_ids"), F.lit("A knowledge graph represents code as interconnected nodes with edges showing relationships.").alias("language_lesson"),
    )
    second = whole.select(
        F.lit(2).alias("order"), F.lit("Key Files").alias("title"), F.lit("Explore the main source files to understand the project structure.").alias("description"),
        "node_ids", F.lit("LLM-powered analysis extracts semantic meaning beyond what static parsers can capture.").alias("language_lesson"),
    )
    return first.unionByName(second)


def merged_layers(answers: DataFrame) -> DataFrame:
    """The layers of ``answer_layers`` over all batches: one row for each layer id, named as where it comes first, with the distinct node ids of all."""
    rows = answers.select("batch", F.posexplode("layers").alias("pos", "x"))
    place = F.struct("batch", "pos")
    ids = F.array_sort(F.collect_list(F.struct("batch", "pos", "x.node_ids")))
    one = rows.groupBy("x.id").agg(F.min(place).alias("first"), F.min_by("x", place).alias("x"), F.array_distinct(F.flatten(F.transform(ids, lambda i: i["node_ids"]))).alias("node_ids"))
    return one.orderBy("first").select("id", "x.name", "x.description", "node_ids")


def layer_members(answers: DataFrame, nodes: DataFrame) -> DataFrame:
    """(layer, node, first): the one layer of each node, and of each id that an answer names: the first that names it, by batch, layer and place.

    A node that no answer names, as one of a batch whose answer can't be read, has the layer that the rules give its type.
    """
    named = answers.select("batch", F.posexplode("layers").alias("pos", "x")).select("batch", "pos", F.col("x.id").alias("layer"), F.posexplode("x.node_ids").alias("place", "node"))
    first = named.groupBy("node").agg(F.min(F.struct("batch", "pos", "place", "layer")).alias("first")).select("first.layer", "node", F.struct("first.batch", "first.pos", "first.place").alias("first"))
    rest = nodes.select(F.col("id").alias("node"), C.layer_of(F.col("type"), T.FALLBACK_LAYERS).alias("layer"), "ord").join(first, "node", "left_anti")
    # After all answers, in node order.
    last = F.struct(F.lit((1 << 62)).alias("batch"), F.lit(0).alias("pos"), F.lit(0).alias("place"))
    return first.withColumn("ord", F.lit("")).unionByName(rest.select("layer", "node", last.alias("first"), "ord"))


def covering_layers(answers: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, name, description, node_ids): the layers of ``merged_layers`` that keep a node, and those that the rules add; every node is in exactly one."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("first", "ord", "node"))), lambda x: x["node"])
    members = layer_members(answers, nodes).groupBy(F.col("layer").alias("id")).agg(ids.alias("node_ids"))
    answered = merged_layers(answers).select("id", F.struct("name", "description").alias("own"))
    words = lambda at: C.lookup({layer[0]: layer[at] for layer in T.FALLBACK_LAYERS}, F.col("id"))
    rows = members.join(answered, "id", "left")
    return rows.select("id", F.coalesce("own.name", words(1)).alias("name"), F.coalesce("own.description", words(2)).alias("description"), "node_ids").orderBy("id")


def merged_tour(answers: DataFrame) -> DataFrame:
    """The steps of ``answer_tour`` over all batches, numbered from 1 by batch and then by their own numbers."""
    rows = answers.select("batch", F.posexplode("tour").alias("pos", "x")).select("batch", "pos", F.col("x.order").alias("own"), "x.title", "x.description", "x.node_ids", "x.language_lesson")
    at = numbered(rows, "batch", "own", "pos")
    return at.select(F.col("n").cast("int").alias("order"), "title", "description", "node_ids", "language_lesson")


def review_findings(responses: DataFrame) -> DataFrame:
    """LLM23: (kind, message) of the errors and improvements in a reviewer's answers; they never change the graph."""
    parts = "struct<issues: array<struct<severity: string, message: string>>, improvements: array<string>>"
    rows = responses.select(F.from_json(C.extract_json(F.col("response")), parts).alias("r"))
    issues = rows.select(F.explode("r.issues").alias("i")).where("i.severity = 'error'").select(F.lit("error").alias("kind"), "i.message")
    better = rows.select(F.lit("improvement").alias("kind"), F.explode("r.improvements").alias("message"))
    return issues.unionByName(better).where("message is not null")


def build_with_model(files: DataFrame, contents: DataFrame, name: str, dispatch: Dispatcher, folder: str, config: AnalysisConfig, analyzed_at: str | None = None, commit: str = "unknown") -> G.Graph:
    """LLM9, LLM18: the graph that a model describes; files it left out get nodes, and a missing tour and missing layers, also of single nodes, are made by rule.

    The tour is asked for with the layers shown, the review with both.

    The answers are kept below ``folder``. Repeated node ids keep their first node. A review of the finished graph is in its findings;
    one that fails is left out. Raises if model analysis is not enabled.
    """
    if not config.use_llm_analysis:
        raise ValueError("model analysis is not enabled")
    items = answer_items(ask(file_prompts(files, contents, config), dispatch, f"{folder}/answers", config))
    answered = answer_nodes(items)
    first = answered.groupBy("id").agg(F.min("ord").alias("ord"))
    nodes = ensure_file_nodes(files, answered.join(first, ["id", "ord"], "left_semi").select(*answered.columns), answered.count())
    edges = answer_edges(items)
    project = G.project_row(files, name, analyzed_at, commit, "%s: LLM-analyzed project with %d files across %d languages. Complexity: %s.")
    context = project_context(project_stats(files))

    def asked(agent: str, dispatch: Dispatcher, **more: DataFrame) -> DataFrame:
        return ask(graph_prompts(agent, context, nodes, edges, **more), dispatch, f"{folder}/{agent}", config, agent)

    def review(agent: str, prompt: str) -> str:
        try:
            return dispatch(agent, prompt)
        except Exception:  # noqa: BLE001 - whatever a host's dispatcher raises, the graph doesn't depend on its review
            return ""

    found = answer_layers(asked("architecture-analyzer", dispatch)).where("layers is not null")
    layers = held(covering_layers(found, nodes) if found.count() else fallback_layers(nodes))
    steps = answer_tour(asked("tour-builder", dispatch, layers=layers)).where("tour is not null")
    tour = held(merged_tour(steps) if steps.count() else fallback_tour(nodes))
    findings = review_findings(asked("graph-reviewer", review, layers=layers, tour=tour))
    return G.Graph(project, nodes, edges, layers, tour, kind="llm-analyzed-codebase", findings=findings)
