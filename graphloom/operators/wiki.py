"""Links between articles by title: an inverted index of titles, resolution of links, and backlinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import columns as C
from graphloom.operators import graph as G

_LINK = r"\[\[([^\[\]|#\n]+)(?:#[^\[\]|\n]*)?(?:\|[^\[\]\n]*)?\]\]"


def normal_title(title: Column) -> Column:
    """Titles are equal if they differ only in case, underscores and white space."""
    return F.lower(C.trimmed(F.regexp_replace(title, r"[_\s]+", " ")))


def title_index(articles: DataFrame) -> DataFrame:
    """(title, folder, id, folder_n, n): for each title and folder the first id, how many articles there and anywhere have it, and ``first``, the first id anywhere.

    Articles without a title or an id are in no index.
    """
    own = articles.select("id", "folder", normal_title(F.col("title")).alias("title")).where("title is not null and title <> '' and id is not null")
    per_folder = own.groupBy("title", "folder").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("folder_n"))
    overall = per_folder.groupBy("title").agg(F.min("id").alias("first"), F.sum("folder_n").alias("n"))
    return per_folder.join(overall, "title")


def links(articles: DataFrame) -> DataFrame:
    """(source, position, title, target, rule) of all links [[Title]], [[Title#part]] and [[Title|shown]] of articles (id, folder, title, content).

    rule: unique, if one article has the title; folder, if several have it but one in the source's folder; first, if neither, for the article with
    the smallest id; missing, without a target. position counts an article's links from 0. Null contents have no links.
    """
    found = articles.select(F.col("id").alias("source"), "folder", F.posexplode(F.regexp_extract_all("content", F.lit(_LINK), F.lit(1))).alias("position", "text"))
    found = found.withColumn("title", normal_title(F.col("text"))).where("title <> ''")
    index = title_index(articles)
    # A title that many link to has one row on either side of these joins.
    overall = index.groupBy("title").agg(F.first("first").alias("first"), F.first("n").alias("n"))
    near = index.where("folder_n = 1 and n > 1").select("title", "folder", F.col("id").alias("near"))
    rows = found.join(overall, "title", "left").join(near, ["title", "folder"], "left")
    rule = F.when(F.col("n").isNull(), "missing").when(F.col("n") == 1, "unique").when(F.col("near").isNotNull(), "folder").otherwise("first")
    return rows.select("source", "position", C.trimmed(F.col("text")).alias("title"), F.coalesce("near", "first").alias("target"), rule.alias("rule"))


def backlinks(found: DataFrame) -> DataFrame:
    """(id, source, links): the articles that link to each article, other than itself, and how often."""
    rows = found.where("target is not null and target <> source")
    return rows.groupBy(F.col("target").alias("id"), "source").agg(F.count(F.lit(1)).alias("links"))


def link_counts(articles: DataFrame, found: DataFrame) -> DataFrame:
    """(id, outgoing, missing, incoming) of all articles: links, links without a target, and articles that link here."""
    out = found.groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("outgoing"), F.count_if(F.col("target").isNull()).alias("missing"))
    into = backlinks(found).groupBy("id").agg(F.count(F.lit(1)).alias("incoming"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return articles.select("id").distinct().join(out, "id", "left").join(into, "id", "left").select("id", zero("outgoing"), zero("missing"), zero("incoming"))


def article_graph(articles: DataFrame, most: int = 100) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): article nodes with wikilinks and backlinks in their knowledge_meta, ``most`` of each at most, and one cites edge for each pair.

    All links are in the edges, whatever their number; the lists are for showing, in the order of position and of id.
    """
    found = links(articles)
    out = found.where(F.col("position") < most).groupBy(F.col("source").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "title"))), lambda x: x["title"]).alias("wikilinks"))
    back = backlinks(found)
    # The first of each article by id, in two steps, so that an article that all link to is in no one task.
    part = F.pmod(F.xxhash64("source"), F.lit(64))
    few = lambda rows, *key: rows.groupBy(*key).agg(F.slice(F.sort_array(F.flatten(F.collect_list("s"))), 1, most).alias("s"))
    ranked = back.select("id", part.alias("part"), F.pmod(F.hash("source"), F.lit(1024)).alias("bit"), F.array("source").alias("s"))
    into = few(few(few(ranked, "id", "part", "bit"), "id", "part"), "id").withColumnRenamed("s", "backlinks")
    none = F.array().cast("array<string>")
    meta = F.struct(F.coalesce("wikilinks", none).alias("wikilinks"), F.coalesce("backlinks", none).alias("backlinks"), F.col("folder").alias("category"), F.lit(None).cast("string").alias("content"))
    rows = articles.join(out, "id", "left").join(into, "id", "left")
    nodes = G.node_rows(rows, id=F.col("id"), type=F.lit("article"), name=F.col("title"), summary=F.lit(""), tags=none, complexity=F.lit("simple"), knowledge_meta=meta, ord=F.concat(F.lit("4"), "id"))
    edges = back.select("source", F.col("id").alias("target"), F.lit("cites").alias("type"), F.lit("forward").alias("direction"), F.format_string("%d links", "links").alias("description"), F.lit(0.5).cast("float").alias("weight"), F.concat(F.lit("4"), "source", F.lit("\u0000"), "id").alias("ord"))
    return nodes, edges
