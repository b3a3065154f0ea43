"""Sharding by size-tiered compaction with a versioned, atomically committed manifest.

Arrivals are appended as small immutable shards (one Parquet folder each).  A shard's tier
is the power of ``fan_in`` its size has over the smallest target; when a tier holds
``fan_in`` shards they are merged into one of the next tier, cut into files of the target
size; a shard of the target size stays.  The store's state is a manifest: a new version is
written beside the others and renamed to its number without overwriting, which fails if
another writer took that number (where renames are atomic, as on HDFS; an object store
needs a committer of its own).  A writer that loses starts again from the version that won.
Readers see whole versions only.  Shards that no kept version names are deleted.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.shared import delete


@dataclass(frozen=True)
class Shard:
    name: str
    rows: int
    bytes: int
    level: int
    added: int


class LostRace(RuntimeError):
    """Another writer has committed the version."""


class ShardStore:
    """A compacted table at ``path`` on any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str, target_bytes: int = 128 << 20, fan_in: int = 4, keep_versions: int = 2):
        self.spark, self.path = spark, path.rstrip("/")
        self.target_bytes, self.fan_in, self.keep_versions = target_bytes, fan_in, keep_versions
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.path).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.path).toUri(), conf)
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        self._no_overwrite = spark.sparkContext._gateway.new_array(rename, 1)
        self._no_overwrite[0] = rename.NONE

    # --- manifest ---------------------------------------------------------------

    def versions(self) -> list[int]:
        at = self._path(f"{self.path}/manifest")
        if not self._fs.exists(at):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(at)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> list[Shard]:
        """The shards of a version (the latest one without a number); none before the first commit."""
        if version is None:
            version = (self.versions() or [0])[-1]
        if not version:
            return []
        stream = self._fs.open(self._path(f"{self.path}/manifest/v{version:010d}.json"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [Shard(**s) for s in json.loads(text)["shards"]]

    def _commit(self, base: int, shards: list[Shard]) -> int:
        """Write version base + 1; raises if it exists (another writer committed first)."""
        version = base + 1
        body = json.dumps({"version": version, "shards": [vars(s) for s in shards]})
        temporary = self._path(f"{self.path}/manifest/.tmp-{uuid.uuid4().hex}")
        stream = self._fs.create(temporary, False)
        try:
            stream.write(bytearray(body.encode()))
        finally:
            stream.close()
        try:
            self._context.rename(temporary, self._path(f"{self.path}/manifest/v{version:010d}.json"), self._no_overwrite)
        except Py4JJavaError as error:
            self._fs.delete(temporary, False)
            if version in self.versions():
                raise LostRace(f"manifest version {version} was committed by another writer") from error
            raise
        self._vacuum(version)
        return version

    def _vacuum(self, version: int) -> None:
        """Delete old versions, and shards that were retired by them; shards not yet committed stay."""
        known = self.versions()
        old = [v for v in known if v <= version - self.keep_versions]
        kept = {s.name for v in known if v not in old for s in self.manifest(v)}
        for v in old:
            for name in {s.name for s in self.manifest(v)} - kept:
                delete(self.spark, f"{self.path}/data/{name}")
            self._fs.delete(self._path(f"{self.path}/manifest/v{v:010d}.json"), False)

    # --- writing ----------------------------------------------------------------

    def _write(self, df: DataFrame, level: int, version: int) -> Shard:
        name = f"L{level}-{uuid.uuid4().hex}"
        at = f"{self.path}/data/{name}"
        df.write.option("compression", "zstd").parquet(at)
        size = self._fs.getContentSummary(self._path(at)).getLength()
        return Shard(name, self.spark.read.schema(df.schema).parquet(at).count(), size, level, version)

    def append(self, arrivals: DataFrame) -> int:
        """Add arrivals (any rows and columns, none too) as one shard and commit; then merge tiers that are full.  Returns the version."""
        shard = self._write(arrivals, 0, (self.versions() or [0])[-1] + 1)
        while True:
            base = (self.versions() or [0])[-1]
            try:
                version = self._commit(base, [*self.manifest(base), shard])
                break
            except LostRace:
                continue
        while (merged := self.compact()) is not None:
            version = merged
        return version

    def tier(self, shard: Shard) -> int:
        """0 for shards below target / fan_in**2, then one more for each factor of fan_in."""
        size, tier = self.target_bytes // self.fan_in**2, 0
        while shard.bytes >= size:
            size, tier = size * self.fan_in, tier + 1
        return tier

    def compact(self) -> int | None:
        """Merge the lowest full tier (its oldest fan_in shards) and commit; None if none is full or another writer was first."""
        base = (self.versions() or [0])[-1]
        shards = self.manifest(base)
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            if s.bytes < self.target_bytes:
                tiers.setdefault(self.tier(s), []).append(s)
        full = next((t for t in sorted(tiers) if len(tiers[t]) >= self.fan_in), None)
        if full is None:
            return None
        merged = sorted(tiers[full], key=lambda s: (s.added, s.name))[: self.fan_in]
        files = max(1, round(sum(s.bytes for s in merged) / self.target_bytes))
        # partitions are concatenated without a shuffle
        shard = self._write(self._read(merged).coalesce(files), max(s.level for s in merged) + 1, base + 1)
        names = {s.name for s in merged}
        try:
            return self._commit(base, [*(s for s in shards if s.name not in names), shard])
        except LostRace:
            delete(self.spark, f"{self.path}/data/{shard.name}")
            return None

    def sweep(self, older_than_seconds: float) -> int:
        """Delete shards that no version names and that are older (left by writers that died); returns how many."""
        named = {s.name for v in self.versions() for s in self.manifest(v)}
        at = self._path(f"{self.path}/data")
        found = self._fs.listStatus(at) if self._fs.exists(at) else []
        old = [f.getPath().getName() for f in found if f.getModificationTime() / 1000 < time.time() - older_than_seconds]
        for name in set(old) - named:
            delete(self.spark, f"{self.path}/data/{name}")
        return len(set(old) - named)

    # --- reading ----------------------------------------------------------------

    def _read(self, shards: list[Shard]) -> DataFrame:
        return self.spark.read.option("mergeSchema", "true").parquet(*(f"{self.path}/data/{s.name}" for s in shards))

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version (repeats and nulls as they came; columns of all shards), with the shard they are in (``_shard``).

        Before the first commit there is nothing to read: ValueError.
        """
        shards = self.manifest(version)
        if not shards:
            raise ValueError(f"no shard in {self.path}")
        rows = self._read(shards)
        return rows.withColumn("_shard", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
