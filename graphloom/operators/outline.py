"""Services and steps of indented texts: compose files and workflows.

A line's ancestors are the lines before it that are indented less and that no line between is indented as little as. For each line the last line before it at
each smaller indent of its file is found by a window over (file, indent); of these, by rising indent, the ancestors are those that come after all
before them. What hangs below a block of text is text, whatever it looks like.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import columns as C
from graphloom.operators.parse import SCHEMA, Parser

_KEY = r"""^(?:"([^"]+)"|'([^']+)'|([^\s:#'"][^:#]*?))\s*:(?:\s+(.*))?$"""


def outline(files: DataFrame) -> DataFrame:
    """(path, at, line, level, item, key, value, chain, is_text) of the lines of (path, content), an item with a key on its line as two rows.

    at orders the rows; level: twice the indent, one more for an item; chain: (at, key) of the ancestors, outermost first, an item's key null;
    value: without quotes and remarks. is_text: a line of a block of text, whose value is the line as it is; empty lines are left out everywhere.
    """
    lines = files.where("content is not null").select("path", F.posexplode(F.split(F.col("content").cast("string"), "\r?\n")).alias("n", "raw"))
    lines = lines.where(~F.col("raw").rlike(r"^\s*$") & ~F.col("raw").rlike(r"^(---|\.\.\.)\s*$")).withColumn("indent", F.length(F.regexp_extract("raw", "^ *", 0)))
    body = F.regexp_replace("raw", r"^ +|\s+$", "")
    lines = lines.select("path", "n", "raw", "indent", body.alias("body"), F.length(F.regexp_extract(body, r"^-(?:\s+|$)", 0)).alias("dash"))
    rest = F.substr("body", F.col("dash") + 1)
    entry = lambda sub, level, item, text: F.struct(F.lit(sub).alias("sub"), level.cast("int").alias("level"), F.lit(item).alias("item"), text.alias("text"))
    remark = F.col("body").startswith("#")
    keyed = rest.rlike(_KEY) & ~remark
    item = entry(0, F.col("indent") * 2 + 1, True, F.when(~keyed, rest))
    plain = entry(1, (F.col("indent") + F.col("dash")) * 2, False, rest)
    rows = lines.select("path", "n", "raw", remark.alias("remark"), F.explode(F.when((F.col("dash") > 0) & keyed, F.array(item, plain)).when(F.col("dash") > 0, F.array(item)).otherwise(F.array(plain))).alias("e"))
    text = F.col("e.text")
    key = F.when(~F.col("e.item") & text.rlike(_KEY), F.concat(*[F.regexp_extract(text, _KEY, g) for g in (1, 2, 3)]))
    value = F.when(key.isNotNull(), F.regexp_extract(text, _KEY, 4)).otherwise(text)
    bare = F.regexp_replace(F.regexp_replace(value, r"""^(?!["'])(.*?)\s+#.*$""", "$1"), r"""^(["'])(.*)\1(?:\s+#.*)?$""", "$2")
    rows = rows.select("path", (F.col("n") * 2 + F.col("e.sub")).cast("bigint").alias("at"), (F.col("n") + 1).cast("int").alias("line"), "raw", "remark", F.col("e.level").alias("level"), F.col("e.item").alias("item"), key.alias("key"), bare.alias("value"))
    rows = rows.withColumn("block", F.col("key").isNotNull() & F.col("value").rlike(r"^[|>][-+0-9]*$"))

    # A remark is text inside of a block, and nothing elsewhere.
    indents = rows.where("not remark").groupBy("path").agg(F.collect_set("level").alias("levels"))
    probes = rows.join(indents, "path").select("path", "at", F.explode(F.filter("levels", lambda x: x < F.col("level"))).alias("level"), F.lit(None).cast("struct<at: bigint, key: string, block: boolean>").alias("own"))
    own = rows.where("not remark").select("path", "at", "level", F.struct("at", "key", "block").alias("own"))
    order = Window.partitionBy("path", "level").orderBy("at", F.col("own").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = own.withColumn("asks", F.lit(False)).unionByName(probes.withColumn("asks", F.lit(True))).withColumn("last", F.last("own", ignorenulls=True).over(order)).where("asks and last is not null")
    found = seen.groupBy("path", "at").agg(F.array_sort(F.collect_list(F.struct("level", "last"))).alias("met"))
    empty = F.array().cast("array<struct<at: bigint, key: string, block: boolean>>")
    chain = F.aggregate("met", empty, lambda held, x: F.when((F.size(held) == 0) | (F.coalesce(F.get(held, F.size(held) - 1)["at"], F.lit(-1)) < x["last"]["at"]), F.concat(held, F.array(x["last"]))).otherwise(held))
    rows = rows.join(found.select("path", "at", chain.alias("above")), ["path", "at"], "left").withColumn("above", F.coalesce("above", empty))
    is_text = F.exists("above", lambda x: x["block"])
    return rows.where(~F.col("remark") | is_text).select("path", "at", "line", "level", "item", "key", F.when(is_text, F.col("raw")).otherwise(F.col("value")).alias("value"), F.transform("above", lambda x: F.struct(x["at"].alias("at"), x["key"].alias("key"))).alias("chain"), is_text.alias("is_text"))


def _above(depth: int, *keys: str | None):
    """Whether the chain has this depth and, where given, these keys."""
    fine = F.size("chain") == depth
    for k, key in enumerate(keys):
        if key is not None:
            fine = fine & F.get("chain", F.lit(k))["key"].eqNullSafe(F.lit(key))
    return fine & ~F.col("is_text")


def services(rows: DataFrame) -> DataFrame:
    """(path, position, name, image, ports) of the services of compose files' outlines, in order; ports as the items are written."""
    made = rows.where(_above(1, "services") & F.col("key").isNotNull()).select("path", F.col("at").alias("own"), F.col("key").alias("name"))
    owner = F.get("chain", F.lit(1))["at"].alias("own")
    images = rows.where(_above(2, "services") & (F.col("key") == "image")).select("path", owner, "value").groupBy("path", "own").agg(F.first("value").alias("image"))
    ports = rows.where(_above(3, "services", None, "ports") & F.col("item")).select("path", owner, "at", "value").groupBy("path", "own").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]).alias("ports"))
    joined = made.join(images, ["path", "own"], "left").join(ports, ["path", "own"], "left")
    number = F.row_number().over(Window.partitionBy("path").orderBy("own")) - 1
    return joined.select("path", number.alias("position"), "name", "image", F.coalesce("ports", F.array().cast("array<string>")).alias("ports"))


def steps(rows: DataFrame) -> DataFrame:
    """(path, position, job, name, command, line) of the steps of workflows' outlines, in order; a command of several lines is joined by line feeds, without their common indent."""
    item = F.get("chain", F.lit(3))["at"]
    made = rows.where(_above(3, "jobs", None, "steps") & F.col("item")).select("path", F.col("at").alias("own"), F.get("chain", F.lit(1))["key"].alias("job"), "line")
    fields = rows.where(_above(4, "jobs", None, "steps") & F.col("key").isin("name", "run")).groupBy("path", item.alias("own"))
    fields = fields.agg(F.max(F.when(F.col("key") == "name", F.col("value"))).alias("name"), F.max(F.when(F.col("key") == "run", F.col("value"))).alias("run"), F.max(F.when(F.col("key") == "run", F.col("at"))).alias("block"))
    texts = rows.where("is_text").select("path", F.explode("chain").alias("c"), "line", "value").select("path", F.col("c.at").alias("block"), "line", "value").distinct()
    texts = texts.groupBy("path", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "value"))), lambda x: x["value"]).alias("ls"))
    indent = F.array_min(F.transform("ls", lambda t: F.length(F.regexp_extract(t, "^ *", 0))))
    texts = texts.select("path", "block", "ls", indent.alias("indent")).select("path", "block", F.array_join(F.transform("ls", lambda t: F.substr(t, F.col("indent") + 1)), "\n").alias("text"))
    joined = made.join(fields, ["path", "own"], "left").join(texts, ["path", "block"], "left")
    number = F.row_number().over(Window.partitionBy("path").orderBy("own")) - 1
    return joined.select("path", number.alias("position"), "job", "name", F.coalesce("text", "run").alias("command"), "line")


def yaml_parts(rows: DataFrame) -> DataFrame:
    """services of compose files and steps of workflows, for the parser registry."""
    name = F.lower(C.file_name(F.col("path")))
    kinds = {"services": name.rlike(r"^(docker-)?compose.*\.ya?ml$"), "steps": F.col("path").contains(".github/workflows/")}
    found = outline(rows.select("path", "content"))
    listed = {"services": services(found).select("path", "position", F.struct("name", "image", "ports").alias("x")), "steps": steps(found).select("path", "position", F.struct("name", "command", F.array("line", "line").alias("line_range")).alias("x"))}
    for column, own in listed.items():
        per_file = own.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "x"))), lambda p: p["x"]).cast(SCHEMA[column]).alias(column))
        rows = rows.join(per_file, "path", "left").withColumn(column, F.when(kinds[column], F.col(column)))
    return rows


YAML = Parser("yaml", ("yml", "yaml"), yaml_parts)
