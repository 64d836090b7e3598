"""Definitions and imports of source texts, by patterns and without UDFs.

Spark has no function that returns all matches of a pattern with their places. So every match is
marked in the text and the text is split at the marks: chunk i is the i-th match and what follows it up to
the next, and its line is one more than the line feeds in all chunks before.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import columns as C
from graphloom.functions.lexer import code_only
from graphloom.functions.spread import each

DEFINITION = "struct<name: string, kind: string, line_range: array<int>, fields: array<string>>"
IMPORT = "struct<name: string, source: string, line_range: array<int>>"
SCHEMA = {
    "definitions": f"array<{DEFINITION}>",
    "imports": f"array<{IMPORT}>",
    "sections": "array<struct<title: string, level: int, line_range: array<int>>>",
    "services": "array<struct<name: string, image: string, ports: array<string>>>",
    "endpoints": "array<struct<method: string, path: string, line_range: array<int>>>",
    "steps": "array<struct<name: string, command: string, line_range: array<int>>>",
}
_MARK, _REST = "\u0001", "\u0002"
_START = r"(?mdU)^\s*"
# Fixed value: how visibility is written.
_VISIBLE = r"(?:pub(?:\s*\([^)]*\))?\s+)?"
# For each kind of definition the pattern of its head, whose group is the name, and a word that is in each match.
RUST_DEFINITIONS = (
    ("function", _VISIBLE + r"(?:async\s+)?(?:unsafe\s+)?fn\s+(\w+)", "fn"),
    ("struct", _VISIBLE + r"struct\s+(\w+)", "struct"),
    ("trait", _VISIBLE + r"(?:unsafe\s+)?trait\s+(\w+)", "trait"),
    ("enum", _VISIBLE + r"enum\s+(\w+)", "enum"),
    ("implementation", _VISIBLE + r"(?:unsafe\s+)?impl(?:\s*<[^>]*>\s*)?\s+(\S+)", "impl"),
)
# Fixed value: how an import is written.
RUST_IMPORT = r"use\s+([^;]+);"


def matches(content: Column, pattern: str) -> Column:
    """All matches: an array of (text, rest, line), text being the pattern's group and rest the match and what follows it."""
    clean = F.translate(content, _MARK + _REST, "")
    chunks = F.split(F.regexp_replace(clean, pattern, f"{_MARK}$1{_REST}$0"), _MARK, -1)

    def step(state: Column, chunk: Column) -> Column:
        first = state["line"] == 0
        rest = F.substring_index(chunk, _REST, -1)
        feeds = F.length(rest) - F.length(F.replace(rest, F.lit("\n"), F.lit("")))
        item = F.struct(F.substring_index(chunk, _REST, 1).alias("text"), rest.alias("rest"), state["line"].alias("line"))
        found = F.when(first, state["found"]).otherwise(F.concat(state["found"], F.array(item)))
        return F.struct(found.alias("found"), (F.when(first, F.lit(1)).otherwise(state["line"]) + feeds).cast("int").alias("line"))

    empty = F.array().cast("array<struct<text: string, rest: string, line: int>>")
    return F.aggregate(chunks, F.struct(empty.alias("found"), F.lit(0).cast("int").alias("line")), step, lambda s: s["found"])


def texts(content: Column, pattern: str) -> Column:
    """The texts of all ``matches``, as (text, line) without lines: for what doesn't look at places, at a fifth of the time."""
    marked = content.contains(_MARK) | content.contains(_REST)
    clean = F.when(marked, F.translate(content, _MARK + _REST, "")).otherwise(content)
    return F.transform(F.regexp_extract_all(clean, F.lit(pattern), F.lit(1)), lambda t: F.struct(t.alias("text"), F.lit(None).cast("int").alias("line")))


def _range(line: Column) -> Column:
    return F.array(line, line)


def _has(content: Column, word: str) -> Column:
    """Whether a word may be in a text once its marks are gone; null texts are left to the patterns."""
    return F.coalesce(content.contains(word) | content.contains(_MARK) | content.contains(_REST), F.lit(True))


def _definition(kind: str, before: str) -> Callable[[Column], Column]:
    none = F.array().cast("array<string>")
    return lambda m: F.struct(F.concat(F.lit(before), m["text"]).alias("name"), F.lit(kind).alias("kind"), _range(m["line"]).alias("line_range"), none.alias("fields"))


def rust_definitions(content: Column, find: Callable[[Column, str], Column] = matches) -> Column:
    """PRS5-9, PRS12: definitions by kind, then place; functions named main are left out. Texts without a kind's word are not searched for it."""
    lists = []
    for kind, pattern, word in RUST_DEFINITIONS:
        found = find(content, _START + pattern)
        if kind == "function":
            found = F.filter(found, lambda m: m["text"] != "main")
        made = F.transform(found, _definition(kind, "impl " if kind == "implementation" else "")).cast(f"array<{DEFINITION}>")
        lists.append(F.when(_has(content, word), made).otherwise(F.array().cast(f"array<{DEFINITION}>")))
    return F.concat(*lists)


def rust_imports(content: Column) -> Column:
    """PRS10: imports in order; the source may span lines, the name is its last part."""
    found = matches(content, _START + RUST_IMPORT)
    source = lambda m: C.trimmed(m["text"])
    made = F.transform(found, lambda m: F.struct(F.element_at(F.split(source(m), "::"), -1).alias("name"), source(m).alias("source"), _range(m["line"]).alias("line_range")))
    return F.when(_has(content, "use"), made.cast(f"array<{IMPORT}>")).otherwise(F.array().cast(f"array<{IMPORT}>"))


def rust_sources(content: Column) -> Column:
    """The sources of ``rust_imports`` alone; names and places are null."""
    empty = [F.lit(None).cast(t).alias(n) for n, t in (("name", "string"), ("line_range", "array<int>"))]
    made = F.transform(texts(content, _START + RUST_IMPORT), lambda m: F.struct(empty[0], C.trimmed(m["text"]).alias("source"), empty[1]))
    return F.when(_has(content, "use"), made).otherwise(F.array().cast(f"array<{IMPORT}>"))


def markdown_sections(content: Column) -> Column:
    """Headings of a Markdown text: title, level, line."""
    found = matches(content, r"(?md)^(#{1,6} +[^\n]*)$")
    made = F.transform(found, lambda m: F.struct(F.regexp_replace(m["text"], r"^#+ +|\s+#*\s*$", "").alias("title"), F.length(F.regexp_extract(m["text"], "^#+", 0)).alias("level"), _range(m["line"]).alias("line_range")))
    return made.cast(SCHEMA["sections"])


PYTHON_DEFINITIONS = (("function", r"(?mU)^[ \t]*(?:async[ \t]+)?def[ \t]+(\w+)"), ("class", r"(?mU)^[ \t]*class[ \t]+(\w+)"))
PYTHON_IMPORT = r"(?mU)^[ \t]*(?:from|import)[ \t]+([\w.][\w., \t]*)"
_EXPORTED = r"(?mU)^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:declare[ \t]+)?"
TYPESCRIPT_DEFINITIONS = (
    ("function", _EXPORTED + r"(?:async[ \t]+)?function\b[ \t]*\*?[ \t]*([\w$]+)"),
    ("function", _EXPORTED + r"(?:const|let|var)[ \t]+([\w$]+)[ \t]*(?::[^=\n]+)?=\s*(?:async\b\s*)?(?:\([^()]*\)[^=;{\n]*|[\w$]+\s*)=>"),
    ("class", _EXPORTED + r"(?:abstract[ \t]+)?class[ \t]+([\w$]+)"),
    ("interface", _EXPORTED + r"interface[ \t]+([\w$]+)"),
    ("enum", _EXPORTED + r"(?:const[ \t]+)?enum[ \t]+([\w$]+)"),
    ("type", _EXPORTED + r"type[ \t]+([\w$]+)[^=\n]*="),
)
TYPESCRIPT_IMPORT = r"""(?mU)(?:^[ \t]*(?:import|export)\b[^;'"]*|\brequire\s*\(\s*|\bimport\s*\(\s*)['"]([^'"\n]+)['"]"""
#: Code before a string that is the name of a module, or the path of an endpoint.
_MODULE_BEFORE = r"\bfrom|\bimport|\brequire\s*\(|\bimport\s*\("
ENDPOINT = r"""(?mU)(?<![\w$.])(?:app|router|api|server|bp)\.(get|post|put|delete|patch|route)\s*\(\s*['"]([^'"\n]+)['"]"""


def _definitions(code: Column, patterns: tuple[tuple[str, str], ...]) -> Column:
    return F.concat(*[F.transform(matches(code, pattern), _definition(kind, "")) for kind, pattern in patterns]).cast(f"array<{DEFINITION}>")


def _imports(found: Column, sources: Callable[[Column], Column], parts: str) -> Column:
    """One import for each source of a match; its name is the last of its parts."""
    one = lambda m: F.transform(sources(m), lambda s: F.struct(F.element_at(F.split(F.regexp_replace(s, r"\.(?:js|ts|tsx|jsx|json)$", ""), parts), -1).alias("name"), s.alias("source"), _range(m["line"]).alias("line_range")))
    return F.flatten(F.transform(found, one)).cast(f"array<{IMPORT}>")


def python_parts(rows: DataFrame) -> DataFrame:
    """Functions, then classes, and imports of Python texts, outside of strings and comments; ``import a, b`` is two imports."""
    rows = rows.withColumn("_code", code_only(F.col("content"), "python"))  # a column of its own, once for all patterns
    code = F.col("_code")
    modules = lambda m: F.when(m["rest"].rlike(r"^\s*from\b"), F.array(F.regexp_extract(m["text"], r"^[\w.]+", 0))).otherwise(F.filter(F.transform(F.split(m["text"], ","), lambda t: F.regexp_extract(t, r"^\s*([\w.]+)", 1)), lambda t: t != ""))
    return rows.withColumn("definitions", _definitions(code, PYTHON_DEFINITIONS)).withColumn("imports", _imports(matches(code, PYTHON_IMPORT), modules, r"\."))


def typescript_parts(rows: DataFrame) -> DataFrame:
    """Functions, classes, interfaces, enums and types, imports and endpoints of TypeScript and JavaScript texts, outside of strings and comments."""
    rows = rows.withColumn("_code", code_only(F.col("content"), "typescript"))  # a column of its own, once for all patterns
    code = F.col("_code")
    named = code_only(F.col("content"), "typescript", _MODULE_BEFORE)
    routed = code_only(F.col("content"), "typescript", r"\.(?:get|post|put|delete|patch|route)\s*\(")
    rows = rows.withColumn("definitions", _definitions(code, TYPESCRIPT_DEFINITIONS)).withColumn("imports", _imports(matches(named, TYPESCRIPT_IMPORT), lambda m: F.array(m["text"]), "/"))
    one = lambda m: F.struct(F.upper(m["text"]).alias("method"), F.regexp_extract(m["rest"], r"""^[^'"]*['"]([^'"\n]+)['"]""", 1).alias("path"), _range(m["line"]).alias("line_range"))
    return rows.withColumn("endpoints", F.transform(matches(routed, ENDPOINT), one).cast(SCHEMA["endpoints"]))


@dataclass(frozen=True)
class Parser:
    """PRS1: a language, its extensions, and what it fills of a parsed row from (path, content) rows.

    ``transform`` maps a DataFrame with path, language, line_count and content to the same rows with any of
    the array columns of SCHEMA added; those it leaves out are empty.
    """

    language: str
    extensions: tuple[str, ...]
    transform: Callable[[DataFrame], DataFrame]


RUST = Parser("rust", ("rs",), lambda rows: rows.withColumn("definitions", rust_definitions(F.col("content"))).withColumn("imports", rust_imports(F.col("content"))))
#: The same for graphs, whose tables keep no places: definitions without lines, and imports by their sources alone.
RUST_UNPLACED = Parser("rust", ("rs",), lambda rows: rows.withColumn("definitions", rust_definitions(F.col("content"), texts)).withColumn("imports", rust_sources(F.col("content"))))
PYTHON = Parser("python", ("py", "pyi", "pyx"), python_parts)
TYPESCRIPT = Parser("typescript", ("ts", "tsx", "js", "jsx", "mjs", "cjs"), typescript_parts)
MARKDOWN = Parser("markdown", ("md", "mdx"), lambda rows: rows.withColumn("sections", markdown_sections(F.col("content"))))


@dataclass
class Registry:
    """PRS2-4: parsers in order; the first that lists a file's extension parses it."""

    parsers: list[Parser] = field(default_factory=lambda: [RUST])

    def register(self, parser: Parser) -> None:
        self.parsers.append(parser)

    def find(self, ext: str) -> Parser | None:
        return next((p for p in self.parsers if ext in p.extensions), None)

    def parse(self, files: DataFrame) -> DataFrame:
        """SRC4: parsed rows of the (path, content) rows that have a parser; null contents and others are left out."""
        content = F.col("content")
        if dict(files.dtypes)["content"] == "binary":
            content = F.when(F.is_valid_utf8(content), F.try_validate_utf8(content.cast("string")))
        rows = files.select("path", content.alias("content")).where("content is not null").withColumn("_ext", C.extension(F.col("path")))
        claimed: set[str] = set()
        parts = []
        for parser in self.parsers:
            own = [e for e in parser.extensions if e not in claimed]
            claimed.update(own)
            if own:
                mine = rows.where(F.col("_ext").isin(own)).select("path", F.lit(parser.language).alias("language"), C.line_count(F.col("content")).alias("line_count"), "content")
                made = parser.transform(mine)
                arrays = [(F.coalesce(F.col(c), F.array().cast(t)) if c in made.columns else F.array().cast(t)).alias(c) for c, t in SCHEMA.items()]
                parts.append(made.select("path", "language", "line_count", *arrays))
        if not parts:
            columns = "path string, language string, line_count bigint, " + ", ".join(f"{c} {t}" for c, t in SCHEMA.items())
            return files.sparkSession.createDataFrame([], columns)
        return reduce(DataFrame.unionByName, parts)


def definition_rows(parsed: DataFrame) -> DataFrame:
    """(path, position, name, kind, line) of all definitions."""
    rows = each(parsed, "definitions", "d")
    return rows.select("path", "position", "d.name", "d.kind", F.col("d.line_range")[0].alias("line"))


def import_rows(parsed: DataFrame) -> DataFrame:
    """(path, position, name, source, line) of all imports."""
    rows = each(parsed, "imports", "i")
    return rows.select("path", "position", "i.name", "i.source", F.col("i.line_range")[0].alias("line"))
