"""Size-tiered compaction of append-only shards under a versioned manifest.

A store is a folder: ``data/`` holds immutable Parquet shards and ``manifest/`` one JSON file
for each version, which lists the shards that make the version up. Every arrival is
written as small shards of its own. Compaction puts shards into tiers by size (each tier
``fanout`` times as large as the one below), and merges a tier that has gathered ``fanout`` shards or more
into files of the target size, without a shuffle: a merge only strings shards together.
Nothing is visible before its manifest is: the next version's file is created exclusively, so
of two writers one fails, and what a lost job has written is never listed.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class CommitConflict(RuntimeError):
    """Another writer has committed this version."""


@dataclass(frozen=True)
class Shard:
    """A file of a version: path below the store, bytes and the arrival or merge that wrote it."""

    path: str
    bytes: int
    run: str


@dataclass(frozen=True)
class Manifest:
    """All shards of one version of the store."""

    version: int
    schema: str
    shards: tuple[Shard, ...]


class ShardStore:
    """A table in small immutable shards. ``target_bytes``: size of merged files; ``fanout``: growth of a tier, and shards that set off a merge."""

    def __init__(self, spark: SparkSession, path: str, target_bytes: int = 256 << 20, fanout: int = 4, floor_bytes: int = 1 << 20):
        self.spark, self.path = spark, path.rstrip("/")
        self.target_bytes, self.fanout, self.floor_bytes = target_bytes, fanout, floor_bytes
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._hadoop(self.path).getFileSystem(self._conf)

    def _hadoop(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def versions(self) -> list[int]:
        folder = self._hadoop(f"{self.path}/manifest")
        if not self._fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName().split(".")[0]) for s in self._fs.listStatus(folder))

    def manifest(self, version: int | None = None) -> Manifest:
        """A committed version, the last by default; an empty store is version 0 without shards."""
        if version is None:
            version = max(self.versions(), default=0)
        if version == 0:
            return Manifest(0, StructType().json(), ())
        text = self.spark.read.text(f"{self.path}/manifest/{version:012d}.json", wholetext=True).first()[0]
        held = json.loads(text)
        return Manifest(version, held["schema"], tuple(Shard(**x) for x in held["shards"]))

    def commit(self, base: Manifest, schema: str, shards: list[Shard]) -> Manifest:
        """Makes the version after ``base`` visible at once, or raises CommitConflict if there is one already.

        The text is complete in a draft before the version's name exists; the rename that
        gives it the name fails if the name is taken.
        """
        made = Manifest(base.version + 1, schema, tuple(shards))
        place = self._hadoop(f"{self.path}/manifest/{made.version:012d}.json")
        draft = self._hadoop(f"{self.path}/draft/{uuid.uuid4().hex}.json")
        self._fs.mkdirs(place.getParent())
        out = self._fs.create(draft, False)
        try:
            out.write(json.dumps({"schema": schema, "shards": [asdict(s) for s in shards]}).encode())
        finally:
            out.close()
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.makeQualified(draft).toUri(), self._conf)
        never_replace = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(self._fs.makeQualified(draft), self._fs.makeQualified(place), never_replace)
        except Py4JJavaError as error:
            self._fs.delete(draft, False)
            if self._fs.exists(place):
                raise CommitConflict(f"version {made.version} is taken") from error
            raise
        return made

    def _listed(self, folder: str, run: str) -> list[Shard]:
        """The shards that a finished write has left below a folder."""
        found, files = [], self._fs.listFiles(self._hadoop(f"{self.path}/{folder}"), True)
        while files.hasNext():
            status = files.next()
            if status.getPath().getName().endswith(".parquet"):
                name = status.getPath().toString()
                found.append(Shard(name[name.index(folder) :], status.getLen(), run))
        return sorted(found, key=lambda s: s.path)

    def append(self, arrivals: DataFrame, rows_per_shard: int = 5000, by: str | None = None) -> list[Manifest]:
        """Writes arrivals as small shards and commits them, each value of column ``by`` as an arrival and a version of its own.

        The column ``by`` is not stored. An arrival without rows adds nothing but, in an empty store, its schema.
        """
        stored = arrivals.drop(by) if by else arrivals
        last = self.manifest()
        if last.version and StructType.fromJson(json.loads(last.schema)) != stored.schema:
            raise ValueError("the arrivals have another schema than the store")
        folder = f"data/{uuid.uuid4().hex}"
        writer = arrivals.write.option("maxRecordsPerFile", rows_per_shard)
        (writer.partitionBy(by) if by else writer).parquet(f"{self.path}/{folder}")
        runs: dict[str, list[Shard]] = {}
        for shard in self._listed(folder, folder):
            run = shard.path.rpartition("/")[0]
            runs.setdefault(run, []).append(Shard(shard.path, shard.bytes, run))
        made = []
        for run in sorted(runs) or [folder]:
            last = self.commit(last, stored.schema.json(), [*last.shards, *runs.get(run, [])])
            made.append(last)
        return made

    def read(self, version: int | None = None, shard: str | None = None) -> DataFrame:
        """The rows of a version; ``shard`` names a column that holds each row's file, as ``Shard.path`` has it (a stored column of that name gives way)."""
        held = self.manifest(version)
        return self._rows(list(held.shards), StructType.fromJson(json.loads(held.schema)), shard)

    def _rows(self, shards: list[Shard], schema: StructType, shard: str | None = None) -> DataFrame:
        if not shards:
            rows = self.spark.createDataFrame([], schema)
            return rows.withColumn(shard, F.lit("")) if shard else rows
        rows = self.spark.read.schema(schema).parquet(*[f"{self.path}/{s.path}" for s in shards])
        if not shard:
            return rows
        # File names alone repeat: a task gives all arrivals that it writes the same.
        encoded = F.regexp_extract(F.col("_metadata.file_path"), "/(data/[0-9a-f]{32}/[^?#]*)$", 1)
        return rows.withColumn(shard, F.url_decode(F.replace(encoded, F.lit("+"), F.lit("%2B"))))

    def tier(self, size: int) -> int:
        return max(0, math.floor(math.log(max(size, 1) / self.floor_bytes, self.fanout)) + 1)

    def _due(self, held: Manifest) -> list[list[Shard]]:
        """The tiers to merge: at least ``fanout`` shards that are well below the target."""
        tiers: dict[int, list[Shard]] = {}
        for s in held.shards:
            if s.bytes < self.target_bytes / 2:
                tiers.setdefault(self.tier(s.bytes), []).append(s)
        return [tiers[k] for k in sorted(tiers) if len(tiers[k]) >= self.fanout]

    def compact(self) -> Manifest:
        """Merges tier by tier until none is due, and commits each merge. Superseded files stay for readers of older versions."""
        held = self.manifest()
        while due := self._due(held):
            old = due[0]
            run = f"data/{uuid.uuid4().hex}"
            files = max(1, round(sum(s.bytes for s in old) / self.target_bytes))
            schema = StructType.fromJson(json.loads(held.schema))
            self._rows(old, schema).coalesce(files).write.parquet(f"{self.path}/{run}")
            gone = {s.path for s in old}
            merged = self._listed(run, run)
            held = self.commit(held, held.schema, [s for s in held.shards if s.path not in gone] + merged)
            if len(merged) >= len(old):
                break  # the writer made no fewer files: merging again would not end
        return held

    def vacuum(self, keep_versions: int = 1) -> int:
        """Deletes the files that none of the last versions lists, and the older manifests; returns how many files went.

        Not to be run while an append is writing: its files are not listed yet.
        """
        versions = self.versions()
        kept = {s.path for v in versions[-keep_versions:] for s in self.manifest(v).shards}
        for v in versions[:-keep_versions]:
            self._fs.delete(self._hadoop(f"{self.path}/manifest/{v:012d}.json"), False)
        gone = [s.path for s in self._listed("data", "") if s.path not in kept] if self._fs.exists(self._hadoop(f"{self.path}/data")) else []
        for path in gone:
            self._fs.delete(self._hadoop(f"{self.path}/{path}"), False)
        return len(gone)
