"""Column functions on paths, contents and summaries. All stay in Catalyst."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions import taxonomy as T


def lookup(table: Mapping[str, str], key: Column) -> Column:
    """The table's value for a key, null for others."""
    pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    return F.try_element_at(pairs, key)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """What follows the last dot of the file name; empty if there is none or only a leading one."""
    return F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1)


def language(path: Column) -> Column:
    """PRJ1: language by case-sensitive extension, else ``unknown``."""
    return F.coalesce(lookup(T.LANGUAGE_OF, extension(path)), F.lit("unknown"))


def excluded(path: Column) -> Column:
    """FIL1: hidden files, and all below .git, target and node_modules; judged on the path below the root."""
    rooted = F.concat(F.lit("/"), path)
    below = [rooted.contains(f"/{folder}/") for folder in (".git", "target", "node_modules")]
    return file_name(path).startswith(".") | below[0] | below[1] | below[2]


def _pattern(texts: Iterable[str], any_case: bool = False) -> str:
    """A pattern of literal texts, in any case if asked for; the Kelvin sign is a capital k too."""
    quoted = "|".join(re.escape(t) for t in texts)
    return "(?i:%s)" % quoted.replace("k", r"[k\u212a]") if any_case else quoted


def category(path: Column, lang: Column) -> Column:
    """PRJ2: the first rule that holds, in the order infra, config, docs, test, data, script, code.

    Each rule names the path once, and the language is looked up once: a filter on the category repeats the expressions of
    both wherever they stand, and generated code has a largest size.
    """
    name = lambda names: rf"(?:^|/)(?:{_pattern(names, any_case=True)})\z"
    within = lambda parts: rf"(?:{_pattern(parts, any_case=True)})[^/]*\z"
    rules = {
        "infra": path.rlike(rf"{name(T.INFRA_NAMES)}|{_pattern(T.INFRA_PATHS)}"),
        "config": path.rlike(rf"{name(T.CONFIG_NAMES)}|(?:^|/)(?i:\.env\.)[^/]*\z|(?i:rc|\.conf)\z"),
        "docs": path.rlike(name(T.DOC_NAMES)),
        "test": path.rlike(rf"{within(('test', 'spec'))}|{_pattern(T.TEST_PATHS)}|\A(?:{_pattern(p[1:] for p in T.TEST_PATHS)})"),
        "data": extension(path).isin(*T.DATA_EXTENSIONS),
    }
    order = [*rules, "script", "code", "unknown"]
    languages = dict.fromkeys(T.CODE_LANGUAGES, "code") | dict.fromkeys(T.CONFIG_LANGUAGES, "config") | {"markdown": "docs", "shell": "script"}
    by_language = F.try_element_at(F.create_map(*[F.lit(x) for k, c in languages.items() for x in (k, order.index(c))]), lang)
    first = F.least(*[F.when(holds, F.lit(order.index(c))) for c, holds in rules.items()], by_language, F.lit(len(order) - 1))
    return F.get(F.array(*[F.lit(c) for c in order]), first)


def line_count(content: Column) -> Column:
    """PRJ3: lines of a text; a trailing line feed adds none, null and empty have none."""
    feeds = F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit("")))
    whole = F.when(content.endswith("\n"), 0).otherwise(1)
    return F.coalesce(F.when(content == "", 0).otherwise(feeds + whole), F.lit(0)).cast("bigint")


def binary_line_count(content: Column) -> Column:
    """SRC3: lines of a file's bytes; bytes that are not UTF-8 count none."""
    return F.when(F.is_valid_utf8(content), line_count(F.try_validate_utf8(content.cast("string")))).otherwise(F.lit(0)).cast("bigint")


def file_complexity(lines: Column) -> Column:
    """GRF6b."""
    return F.when(lines <= 200, "simple").when(lines <= 1000, "moderate").otherwise("complex")


def project_complexity(files: Column, lines: Column) -> Column:
    """PRJ5."""
    return F.when((files < 50) & (lines < 10_000), "simple").when((files < 200) & (lines < 100_000), "moderate").otherwise("complex")


def node_id(path: Column) -> Column:
    """GRF1: 16 hex digits of the path's SHA-256."""
    return F.substring(F.sha2(path, 256), 1, 16)


def display_name(path: Column) -> Column:
    """GRF2: the last part of the path without its last extension."""
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def node_type_of_category(value: Column) -> Column:
    """GRF7."""
    return F.coalesce(lookup(T.CATEGORY_NODES, value), F.lit("file"))


def ancestors(path: Column) -> Column:
    """All folders above a path, outermost first; none for a path at the root."""
    parts = F.split(path, "/")
    steps = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def summary_lines(summary: Column) -> Column:
    """QRY5: the text between the first bracket and `` lines`` after it, ``?`` if there is none."""
    found = F.regexp_extract(summary, r"^[^(]*\((.*?) lines", 1)
    return F.when(summary.rlike(r"^[^(]*\(.*? lines"), found).otherwise("?")


def node_alias(value: Column) -> Column:
    """LLM15: the node type that a spelling stands for, null for unknown ones."""
    table = {spelling: kind for kind, others in T.NODE_ALIASES.items() for spelling in (kind, *others)}
    return lookup(table, F.lower(value))


def edge_alias(value: Column) -> Column:
    """LLM16: the edge type that a spelling stands for, ``related`` for unknown ones."""
    table = {t: t for t in T.EDGE_TYPES} | T.EDGE_ALIASES
    return F.coalesce(lookup(table, F.lower(value)), F.lit("related"))


def direction_alias(value: Column) -> Column:
    """LLM14: direction by its spellings, ``forward`` for unknown ones."""
    table = {t: t for t in T.DIRECTIONS} | T.DIRECTION_ALIASES
    return F.coalesce(lookup(table, F.lower(value)), F.lit("forward"))


def layer_of(node_type: Column, layers: tuple = T.LAYERS) -> Column:
    """The layer id of a node type, ``other`` for types in none."""
    return F.coalesce(lookup({t: layer[0] for layer in layers for t in layer[3]}, node_type), F.lit(T.OTHER_LAYER[0]))


def trimmed(text: Column) -> Column:
    """Without white space at both ends, line feeds included."""
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def extract_json(text: Column) -> Column:
    """LLM10: the JSON in a model's answer.

    The whole answer if it starts with a bracket; else the content of the first json fence, else of the first fence,
    if that does; else everything from the first bracket on; else the answer as it is.
    """
    whole = trimmed(text)
    # Texts without a fence are not searched by the patterns.
    tagged = F.when(whole.contains("```json"), trimmed(F.regexp_extract(whole, r"(?s)^.*?```json(.*?)```", 1)))
    fenced = F.when(whole.contains("```"), trimmed(F.regexp_extract(whole, r"(?s)^.*?```(.*?)```", 1)))
    rest = F.regexp_extract(whole, r"(?s)^[^{\[]*([{\[].*)$", 1)
    opens = r"^[{\[]"
    return F.when(whole.rlike(opens), whole).when(tagged.rlike(opens), tagged).when(fenced.rlike(opens), fenced).when(rest != "", rest).otherwise(whole)
