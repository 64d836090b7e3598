"""Nodes of definitions and edges of calls, from source texts.

A text without its strings and comments is cut at every head of a definition, bracket, semicolon and call. In file order the sum of brackets gives
each token its depth. At one depth of one file, brackets that open and close alternate, so a bracket's partner is the next row at its depth,
a definition's body is the next brace at the depth of its head, and the definition around a call is found by looking up, at each smaller depth, the
last brace that opened before it. All of this are windows over (file, depth); no pair of a definition and a call is made that don't belong together.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import columns as C
from graphloom.functions.lexer import code_only
from graphloom.functions.spread import shuffled
from graphloom.functions.storage import held
from graphloom.operators import graph as G

_MARK = "\u0001"
_HEAD = r"(?:pub(?:\s*\([^)]*\))?\s+)?(?:default\s+)?(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?(?:extern\s+)?(?:fn|struct|enum|trait|union)\s+[A-Za-z_]\w*"
_IMPL = r"(?:unsafe\s+)?impl\b"
_CALL = r"\b[A-Za-z_]\w*(?=\s*\()"
_TOKEN = rf"(?mU)(?<![\w.]){_HEAD}|(?<![\w.]){_IMPL}|{_CALL}|[\[\](){{}};]"
#: Words before a bracket that call nothing.
NO_CALLS = ("if", "while", "for", "match", "return", "in", "loop", "else", "move", "let", "as", "await", "box", "where", "dyn", "impl", "fn", "mut", "ref", "pub", "crate", "super")
#: The node type of each kind of definition; an implementation is no node, what it holds belongs to what is around it.
NODE_TYPES = {"fn": "function", "struct": "class", "enum": "class", "union": "class", "trait": "class"}


def tokens(files: DataFrame, language: str = "rust") -> DataFrame:
    """(path, k, line, kind, name, depth, level) of the tokens in file order.

    kind: fn, struct, enum, trait, union, impl, call, open, close or end. depth: of all brackets, before the token. level: what a bracket and its
    partner share, the smaller of its depths; the depth for all others.
    """
    marked = F.regexp_replace(code_only(F.col("content"), language), _TOKEN, f"{_MARK}$0")
    rows = files.where("content is not null").select("path", F.posexplode(F.split(marked, _MARK, -1)).alias("k", "chunk"))
    feeds = F.length("chunk") - F.length(F.replace(F.col("chunk"), F.lit("\n"), F.lit("")))
    first = F.substring("chunk", 1, 1)
    head = F.regexp_extract("chunk", rf"(?U)^{_HEAD}", 0)
    opens, closes = first.isin("(", "[", "{"), first.isin(")", "]", "}")
    kind = (
        F.when(F.col("k") == 0, "text").when(opens, "open").when(closes, "close").when(first == ";", "end")
        .when(head != "", F.regexp_extract(head, r"(fn|struct|enum|trait|union)\s+\w+$", 1)).when(F.col("chunk").rlike(rf"^{_IMPL}"), "impl").otherwise("call")
    )
    before = Window.partitionBy("path").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    # A head's own line feeds come before its name; it begins where its chunk does.
    rows = rows.select("path", "k", "chunk", kind.alias("kind"), feeds.alias("feeds"), F.when(opens, 1).when(closes, -1).otherwise(0).alias("step"), F.when(head != "", head).otherwise(F.col("chunk")).alias("word"))
    rows = rows.withColumn("line", (1 + F.coalesce(F.sum("feeds").over(before), F.lit(0))).cast("int")).withColumn("depth", F.coalesce(F.sum("step").over(before), F.lit(0)))
    name = F.when(F.col("kind") == "call", F.regexp_extract("word", r"(?U)^\w+", 0)).when(F.col("kind").isin(*NODE_TYPES), F.regexp_extract("word", r"(?U)(\w+)$", 1)).when(F.col("kind").isin("open", "close"), F.substring("chunk", 1, 1))
    rows = rows.select("path", "k", "line", "kind", name.alias("name"), "depth", F.least("depth", F.col("depth") + F.col("step")).alias("level"))
    return rows.where((F.col("kind") != "text") & ~((F.col("kind") == "call") & F.coalesce(F.col("name").isin(*NO_CALLS), F.lit(False))))


def ended(toks: DataFrame) -> DataFrame:
    """The tokens with ``stop``, which is null but for heads: the last line of their definition.

    A definition ends with the brace that closes its body, or with its semicolon; one that is never closed ends on the file's last token's line.
    All of it are windows within a file, which one shuffle by path serves.
    """
    after = Window.partitionBy("path", "level").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, -1)
    is_head = F.col("kind").isin(*NODE_TYPES, "impl")
    is_body = ((F.col("kind") == "open") & (F.col("name") == "{")) | (F.col("kind") == "end")
    rows = toks.withColumn("last", F.max("line").over(Window.partitionBy("path")))
    # What closes a bracket is the next bracket at its level.
    rows = rows.withColumn("closed", F.last(F.when(F.col("kind").isin("open", "close"), F.col("line")), ignorenulls=True).over(after))
    body = F.when(is_body, F.when(F.col("kind") == "open", F.coalesce("closed", "last")).otherwise(F.col("line")))
    stop = F.when(is_head, F.coalesce(F.last(body, ignorenulls=True).over(after), "last"))
    return rows.withColumn("stop", stop).drop("last", "closed")


def enclosed(toks: DataFrame) -> DataFrame:
    """Heads of ``_identified`` and calls, with ``around_id``: the id of the definition whose body they are in, the innermost; null outside of all.

    A token asks at each smaller level for the brace that was opened last, and takes its own columns along, so that nothing is joined back:
    all of it are windows within a file, which one shuffle by path serves.
    """
    before = Window.partitionBy("path", "level").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    up_to = Window.partitionBy("path", "level").orderBy("k", F.col("asked").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_body = ((F.col("kind") == "open") & (F.col("name") == "{")) | (F.col("kind") == "end")
    owned = F.when(is_body, F.struct(F.lit(None).cast("string").alias("id"))).when(F.col("kind").isin(*NODE_TYPES), F.struct("id"))
    # A brace is the body of the last head before it at its level, unless another brace or a semicolon lies between.
    row, brace = "struct<kind: string, name: string, line: int, stop: int, id: string>", "struct<id: string>"
    entry = lambda level, opened, asked: F.struct(level.cast("bigint").alias("level"), opened.cast(brace).alias("brace"), asked.cast(row).alias("asked"))
    asks = F.transform(F.sequence(F.lit(-1), F.greatest(F.col("level").cast("int"), F.lit(0)) - 1), lambda at: entry(at, F.lit(None), F.struct("kind", "name", "line", "stop", "id")))
    entries = F.when(F.col("kind") == "open", F.array(entry(F.col("level"), F.struct("owner.id"), F.lit(None)))).otherwise(asks)
    rows = toks.withColumn("owner", F.last(owned, ignorenulls=True).over(before)).where("kind = 'open' and name = '{'" + f" or kind in {('call', *NODE_TYPES)}")
    rows = rows.select("path", "k", F.explode_outer(entries).alias("e")).select("path", "k", "e.*")
    seen = rows.withColumn("brace", F.last("brace", ignorenulls=True).over(up_to)).where("asked is not null")
    best = seen.groupBy("path", "k").agg(F.max(F.when(F.col("brace.id").isNotNull(), F.struct("level", "brace.id"))).alias("best"), F.first("asked").alias("asked"))
    return best.select("path", "k", "asked.*", F.col("best.id").alias("around_id"))


def _definition_id(path: Column, kind: Column, name: Column, number: Column) -> Column:
    return C.node_id(F.concat(path, F.lit("#"), kind, F.lit(" "), name, F.lit("#"), number.cast("string")))


def _identified(toks: DataFrame) -> DataFrame:
    """The tokens with the ids of definitions other than implementations; those of one kind and name in a file are numbered."""
    number = F.row_number().over(Window.partitionBy("path", "kind", "name").orderBy("k"))
    return toks.withColumn("id", F.when(F.col("kind").isin(*NODE_TYPES), _definition_id(F.col("path"), C.lookup(NODE_TYPES, F.col("kind")), F.col("name"), number)))


def _nodes(known: DataFrame, language: str) -> DataFrame:
    return G.node_rows(
        known,
        id=F.col("id"),
        type=C.lookup(NODE_TYPES, F.col("kind")),
        name=F.col("name"),
        file_path=F.col("path"),
        line_range=F.array("line", "stop"),
        summary=F.format_string("%s (%d lines)", "kind", F.col("stop") - F.col("line") + 1),
        tags=F.array(F.lit(language)),
        complexity=C.file_complexity(F.col("stop") - F.col("line") + 1),
        ord=F.concat(F.lit("3"), F.col("path"), F.lit("\u0000"), F.lpad(F.col("k").cast("string"), 9, "0")),
    )


def definition_nodes(files: DataFrame, language: str = "rust") -> DataFrame:
    """The nodes of ``definition_graph`` by themselves: windows within files only, without a join."""
    return _nodes(_identified(ended(tokens(files, language)).where(F.col("kind").isin(*NODE_TYPES))), language)


def definition_graph(files: DataFrame, imports: DataFrame | None = None, language: str = "rust") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): nodes of functions and types, contains edges to them from the definition or file around, and calls edges.

    files: (path, content), one row for each path. imports: (path, target_path), as of ``graph.import_links``. A call leads to the
    first definition of that name in its own file, else in the files that its file imports, else to the only one there is anywhere; calls that none of
    these resolves have no edge, nor have calls of a definition by itself. The source of a call outside of all definitions is the file. Several calls between
    the same two make one edge, described by the first. Null contents give nothing; a path that repeats is an error in the input and gives merged tokens.
    """
    # Heads and calls, with the definitions around them, are held: nodes, edges and what calls lead to read them.
    rows = held(enclosed(_identified(ended(tokens(files, language)))))
    rows = rows.withColumn("source", F.coalesce("around_id", C.node_id(F.col("path"))))
    known = rows.where("kind <> 'call'")
    nodes = _nodes(known, language)
    holds = known.select("source", F.col("id").alias("target"), "path", "k", "line", "name", F.lit("contains").alias("type"))

    callable_ = F.col("kind").isin("fn", "struct")
    own = F.min_by("id", F.when(callable_, F.col("k"))).over(Window.partitionBy("path", "name"))
    sites = rows.where((F.col("kind") == "call") | callable_).withColumn("own", own).where("kind = 'call'").select("path", "k", "line", "name", "source", "own")
    far = sites.where("own is null").drop("own")
    per_file = known.where(callable_).groupBy("path", "name").agg(F.min_by("id", "k").alias("id"))
    anywhere = known.where(callable_).groupBy("name").agg(F.min("id").alias("only"), F.count(F.lit(1)).alias("n")).where("n = 1").select("name", "only")
    if imports is None:
        far = far.withColumn("imported", F.lit(None).cast("string"))
    else:
        there = per_file.select(F.col("path").alias("target_path"), "name", F.col("id").alias("other"))
        wanted = far.select("path", "name").distinct().join(shuffled(imports.select("path", "target_path").distinct()), "path").join(shuffled(there), ["target_path", "name"])
        far = far.join(shuffled(wanted.groupBy("path", "name").agg(F.min_by("other", "target_path").alias("imported"))), ["path", "name"], "left")
    far = far.join(shuffled(anywhere), "name", "left").withColumn("target", F.coalesce("imported", "only")).drop("imported", "only")
    sites = sites.where("own is not null").withColumnRenamed("own", "target").unionByName(far).where("target is not null and target <> source")
    calls = sites.groupBy("source", "target").agg(F.min(F.struct("path", "k", "line", "name")).alias("s")).select("source", "target", "s.path", "s.k", "s.line", "s.name", F.lit("calls").alias("type"))
    edges = holds.unionByName(calls).select(
        "source", "target", "type", F.lit("forward").alias("direction"),
        F.format_string("%s line %d %s %s", "path", "line", "type", "name").alias("description"),
        F.when(F.col("type") == "calls", 0.8).otherwise(0.3).cast("float").alias("weight"),
        F.concat(F.lit("3"), F.col("path"), F.lit("\u0000"), F.lpad(F.col("k").cast("string"), 9, "0"), F.col("type")).alias("ord"),
    )
    return nodes, edges


def with_definitions(graph: G.Graph, files: DataFrame, parsed: DataFrame) -> G.Graph:
    """A project's graph with the nodes and edges of its definitions; layers are made anew. files: (path, content) of the parsed files."""
    nodes, edges = definition_graph(files, G.import_links(G.imports_of(parsed), G.import_keys(parsed)))
    nodes = graph.nodes.unionByName(nodes)
    return replace(graph, nodes=nodes, edges=graph.edges.unionByName(edges), layers=G.layers(nodes))
