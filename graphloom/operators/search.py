"""Scored search: names within an edit distance of many queries, by what is left of them after deletions, or by trigram postings.

Two strings within k edits have in common what is left of them after up to k deletions. Names and queries whose variants are few enough meet by
these, so that only pairs that are nearly alike meet, however many names share a word. Longer ones have rarer trigrams: names within k edits of a query share all
but 3k of the longer one's trigrams, so a query is looked up by its rarest trigrams only, as many that a match can't miss them all; candidates need the
full number of common trigrams before the edit distance is computed.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.spread import dealt, shuffled

GRAM = 3
#: As many variants of a name at most, unless it is too short for trigrams.
VARIANTS = 512


@dataclass(frozen=True)
class SearchIndex:
    """names: (name, grams), each distinct name once. postings: (gram, name, length). frequencies: (gram, n). short: (variant, name), a variant being its hash. members: (name, id).

    All are tables that can be written once and searched often; ``most`` is the largest distance that they are made for.
    """

    names: DataFrame
    postings: DataFrame
    frequencies: DataFrame
    short: DataFrame
    members: DataFrame
    most: int


def _longest(most: int) -> int:
    """The length up to which strings meet by their variants: trigrams need 3 * most + 3 characters."""
    length = GRAM * most + GRAM - 1
    while sum(comb(length + 1, k) for k in range(most + 1)) <= VARIANTS:
        length += 1
    return length


def _grams(text: Column) -> Column:
    """The trigrams of a text, a repeated one with its number, so that sets count as often as texts do; none for shorter texts."""
    plain = F.when(F.length(text) < GRAM, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - GRAM + 1, F.lit(1))), lambda k: F.substring(text, k, GRAM)))
    return F.transform(plain, lambda g, k: F.concat(g, F.size(F.filter(F.slice(plain, F.lit(1), k), lambda h: h == g)).cast("string")))


def _deletions(text: Column, most: int) -> Column:
    """Hashes of the text and of all that is left of it after up to ``most`` deletions."""
    found = F.array(text)
    for _ in range(most):
        less = F.flatten(F.transform(found, lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))), lambda k: F.concat(F.substr(t, F.lit(1), k - 1), F.substr(t, k + 1)))))
        found = F.array_distinct(F.concat(found, less))
    return F.transform(found, lambda t: F.xxhash64(t))  # equal hashes of others are told apart by the distance


def build_index(nodes: DataFrame, most: int = 2, name: str = "name") -> SearchIndex:
    """The index of nodes (id, name) for distances of up to ``most``; names count in lower case, null names and ids are left out."""
    members = nodes.select(F.lower(F.col(name)).alias("name"), "id").where("name is not null and id is not null")
    # Names are dealt by their number: hundreds of variants are made of each.
    names = dealt(members.select("name"), "name").distinct().withColumn("grams", _grams(F.col("name")))
    # Shorter names have a longer partner at most ``most`` longer, or only short ones.
    long = names.where(F.length("name") > _longest(most) - most)
    postings = long.select(F.explode("grams").alias("gram"), "name", F.length("name").alias("length"))
    short = names.where(F.length("name") <= _longest(most)).select(F.explode(_deletions(F.col("name"), most)).alias("variant"), "name")
    return SearchIndex(names, postings, postings.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), short, members, most)


def candidates(index: SearchIndex, queries: DataFrame) -> DataFrame:
    """(query_id, text, name), distinct: all pairs within the distance, and those that can't be told from them without comparing."""
    k, longest = index.most, _longest(index.most)
    asked = dealt(queries.select("query_id", F.lower(F.col("text")).alias("text")).where("text is not null"), "query_id", "text")
    grams = asked.withColumn("grams", _grams(F.col("text"))).withColumn("size", F.length("text"))
    # A match shares size - 2 - 3k trigrams at least, or more if its name is longer: among all but as many less one of the query's rarest there is one.
    probes = grams.where(F.col("size") > longest - k).select("query_id", "text", "grams", "size", F.explode("grams").alias("gram"))
    counted = probes.join(shuffled(index.frequencies), "gram")
    absent = F.size("grams") - F.count(F.lit(1)).over(Window.partitionBy("query_id", "text"))
    rank = F.row_number().over(Window.partitionBy("query_id", "text").orderBy("n", "gram"))
    enough = F.size("grams") - F.greatest(F.col("size") - (GRAM - 1) - GRAM * k, F.lit(1)) + 1
    rare = counted.select("*", (rank + absent).alias("rank"), enough.alias("enough")).where("rank <= enough").select("query_id", "text", "grams", "size", "gram")
    near = (F.abs(F.col("length") - F.col("size")) <= k) & (F.greatest("length", "size") > longest)
    met = rare.join(shuffled(index.postings), "gram").where(near).select("query_id", "text", "grams", "size", "name", "length").dropDuplicates(["query_id", "text", "name"])
    shared = F.size(F.array_intersect("grams", "own"))
    least = F.greatest("length", "size") - (GRAM - 1) - GRAM * k
    long = met.join(shuffled(index.names.select("name", F.col("grams").alias("own"))), "name").where(shared >= least).select("query_id", "text", "name")
    variants = asked.where(F.length("text") <= longest).select("query_id", "text", F.explode(_deletions(F.col("text"), k)).alias("variant"))
    short = variants.join(shuffled(index.short), "variant").select("query_id", "text", "name").distinct()
    return long.unionByName(short)


def search_names(index: SearchIndex, queries: DataFrame) -> DataFrame:
    """(query_id, id, name, distance, score) of all nodes whose name is within the index's distance of a query (query_id, text).

    score: the distance in parts of the longer length, 0 for equal names. Repeated queries give their results once; null texts find nothing.
    """
    pairs = candidates(index, queries)
    far = F.levenshtein("text", "name", index.most)
    found = pairs.withColumn("distance", far).where("distance >= 0")
    score = F.col("distance") / F.greatest(F.length("text"), F.length("name"), F.lit(1))
    return found.join(shuffled(index.members), "name").select("query_id", "id", "name", "distance", score.cast("float").alias("score")).distinct()
