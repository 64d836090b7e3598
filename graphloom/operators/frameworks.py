"""Frameworks of a project, by the dependencies that its manifests name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import columns as C

#: A framework, the ecosystem of its packages, and the packages that a manifest must name, all of them.
RULES = (
    ("react", "npm", ("react",)),
    ("next", "npm", ("next", "react")),
    ("vue", "npm", ("vue",)),
    ("angular", "npm", ("@angular/core",)),
    ("express", "npm", ("express",)),
    ("django", "pypi", ("django",)),
    ("flask", "pypi", ("flask",)),
    ("fastapi", "pypi", ("fastapi",)),
    ("pyspark", "pypi", ("pyspark",)),
    ("axum", "cargo", ("axum", "tokio")),
    ("actix", "cargo", ("actix-web",)),
    ("tokio", "cargo", ("tokio",)),
    ("gin", "go", ("github.com/gin-gonic/gin",)),
)
_NAME = r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)"


def dependencies(files: DataFrame) -> DataFrame:
    """(path, ecosystem, name), distinct: what the manifests among (path, content) depend on: package.json, requirements.txt, Cargo.toml and go.mod.

    Development dependencies count. Names of Python packages are compared in lower case with dashes. Manifests that can't be read depend on nothing.
    """
    name = C.file_name(F.col("path"))
    text = F.col("content").cast("string")
    deps = F.from_json(text, "struct<dependencies: map<string, string>, devDependencies: map<string, string>, peerDependencies: map<string, string>>")
    keys = F.flatten(F.array(*[F.coalesce(F.map_keys(deps[c]), F.array().cast("array<string>")) for c in ("dependencies", "devDependencies", "peerDependencies")]))
    python = F.transform(F.filter(F.split(text, "\r?\n"), lambda t: t.rlike(_NAME)), lambda t: F.lower(F.regexp_replace(F.regexp_extract(t, _NAME, 1), r"[._-]+", "-")))
    # A table of dependencies ends at the next table; a dependency's own table names it in its head.
    tables = F.regexp_extract_all(F.concat(F.lit("\n"), text), F.lit(r"\n\[(?:workspace\.|target\.[^\]\n]+\.)?(?:dev-|build-)?dependencies\][^\n]*((?:\n(?!\[)[^\n]*)*+)"), F.lit(1))
    entries = F.flatten(F.transform(tables, lambda t: F.regexp_extract_all(t, F.lit(r"(?m)^\s*\"?([A-Za-z0-9_-]+)\"?\s*(?:\.[A-Za-z]+\s*)?="), F.lit(1))))
    heads = F.regexp_extract_all(text, F.lit(r"(?m)^\[(?:workspace\.)?(?:dev-|build-)?dependencies\.\"?([A-Za-z0-9_-]+)\"?\]"), F.lit(1))
    modules = F.regexp_extract_all(text, F.lit(r"(?m)^\s*(?:require\s+)?([a-z0-9.-]+\.[a-z]+/\S+)\s+v[0-9]"), F.lit(1))
    kinds = (("npm", name == "package.json", keys), ("pypi", name.rlike(r"^requirements.*\.txt$"), python), ("cargo", name == "Cargo.toml", F.concat(entries, heads)), ("go", name == "go.mod", modules))
    ecosystem = F.coalesce(*[F.when(when, F.lit(kind)) for kind, when, _ in kinds])
    found = F.coalesce(*[F.when(when, names) for _, when, names in kinds])
    return files.select("path", ecosystem.alias("ecosystem"), F.explode(found).alias("name")).where("name is not null").distinct()


def frameworks(deps: DataFrame, rules: tuple = RULES) -> DataFrame:
    """(path, framework): the rules whose packages a manifest names all."""
    rows = [(name, kind, package, len(packages)) for name, kind, packages in rules for package in packages]
    table = deps.sparkSession.createDataFrame(rows, "framework string, ecosystem string, name string, wanted int")
    met = deps.join(F.broadcast(table), ["ecosystem", "name"])  # a row for each package of a rule
    return met.groupBy("path", "framework").agg(F.count(F.lit(1)).alias("met"), F.first("wanted").alias("wanted")).where("met = wanted").select("path", "framework")


def with_frameworks(project: DataFrame, found: DataFrame) -> DataFrame:
    """A project's row with the sorted names of its frameworks."""
    names = found.agg(F.sort_array(F.collect_set("framework")).alias("frameworks"))  # no more than there are rules
    return project.drop("frameworks").join(names).select(*project.columns)
