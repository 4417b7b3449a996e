"""Operator 2, sharding by size-tiered compaction with a versioned manifest.

Arrivals are appended as small immutable Parquet shards.  Shards of one size
tier (sizes within a factor of FAN_IN) are merged, FAN_IN or more at a time,
into runs of up to the target size; a run is one task that streams its shards
into one file, without a shuffle.  A version of the table is a manifest file,
published by an atomic rename that fails if the version exists, so readers see
whole versions only and of two writers one retries.  Files go through Hadoop's
file systems and Spark's readers, never through a local path.

Every published version stays readable, through compactions too, until ``vacuum``
retires it.  That drops the manifests beyond the newest ones first, then the
shards that only they name, then files that no manifest names and that are old
enough not to be some writer's.

Defined results: an empty arrival commits a version without new shards; null
columns, null values and repeated rows are stored as they come; columns that a later arrival
adds are null in the rows before it, columns that it lacks in its own, and a column of
another type is an error; a version that isn't there is an error; reading an
empty store gives no rows of the first arrival's schema (of an unwritten store, an error).
"""

from __future__ import annotations

import json
import math
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TARGET_BYTES = 128 << 20
#: Shards below this size share the lowest tier.
SMALL_BYTES = 1 << 20
FAN_IN = 4
#: Runs merged at the same time; each is a job of one task.
CONCURRENT = 8
COMMIT_TRIES = 10
#: What a vacuum keeps: the newest versions, and files without a version up to this age.
KEEP_VERSIONS = 10
ORPHAN_SECONDS = 24 * 3600


class CommitConflict(Exception):
    """Another writer published this version first."""


@dataclass(frozen=True)
class Shard:
    path: str
    rows: int
    bytes: int


@dataclass(frozen=True)
class Manifest:
    version: int
    schema: str
    shards: tuple[Shard, ...]


class ShardStore:
    """A table of immutable shards under one folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    # -- manifests ---------------------------------------------------------------------

    def _manifest_path(self, version: int) -> str:
        return f"{self.root}/_manifests/v{version:010d}.json"

    def versions(self) -> list[int]:
        where = self._path(f"{self.root}/_manifests")
        if not self._fs.exists(where):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(where)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest:
        """A published version, by default the newest; version 0 is the empty table."""
        if version is None:
            version = max(self.versions(), default=0)
        if version == 0:
            return Manifest(0, "", ())
        if not self._fs.exists(self._path(self._manifest_path(version))):
            raise ValueError(f"version {version} is not there: never published, or retired")
        data = self.spark.read.text(self._manifest_path(version), wholetext=True).first()[0]
        spec = json.loads(data)
        return Manifest(version, spec["schema"], tuple(Shard(**s) for s in spec["shards"]))

    def _publish(self, manifest: Manifest) -> None:
        """Write aside, then rename: FileContext's rename is atomic and refuses to overwrite."""
        data = json.dumps({"version": manifest.version, "schema": manifest.schema, "shards": [asdict(s) for s in manifest.shards]})
        aside = self._path(f"{self.root}/_manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(aside, False)
        try:
            out.write(bytearray(data.encode()))
        finally:
            out.close()
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), self._conf)
        no_options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(aside, self._path(self._manifest_path(manifest.version)), no_options)
        except Exception as e:
            self._fs.delete(aside, False)
            if "FileAlreadyExists" in str(e):
                raise CommitConflict(manifest.version) from e
            raise

    def _commit(self, added: list[Shard], removed: frozenset[str] = frozenset(), schema: str = "") -> Manifest:
        for _ in range(COMMIT_TRIES):
            base = self.manifest()
            if not removed <= {s.path for s in base.shards}:
                raise CommitConflict("shards of this merge were replaced meanwhile")
            shards = (*(s for s in base.shards if s.path not in removed), *added)
            new = Manifest(base.version + 1, widened(base.schema, schema), shards)
            try:
                self._publish(new)
            except CommitConflict:
                continue
            return new
        raise CommitConflict(f"gave up after {COMMIT_TRIES} tries")

    def _delete(self, paths) -> None:
        for path in paths:
            self._fs.delete(self._path(path), True)

    # -- writing -----------------------------------------------------------------------

    def _written(self, folder: str) -> list[Shard]:
        """Shards with rows that a finished write left in ``folder``."""
        try:
            rows = self.spark.read.parquet(folder).groupBy(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()
        except PySparkException:
            if any(s.getPath().getName().startswith("part-") for s in self._fs.listStatus(self._path(folder))):
                raise
            rows = []
        return [Shard(r["p"], r["n"], r["b"]) for r in sorted(rows)]

    def append(self, arrival: DataFrame) -> Manifest:
        """Publish an arrival: each of its partitions becomes a shard."""
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        arrival.write.parquet(folder)
        return self._commit(self._written(folder), schema=arrival.schema.json())

    def _merge_run(self, run: list[Shard], schema: StructType) -> list[Shard]:
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        self.spark.read.schema(schema).parquet(*(s.path for s in run)).coalesce(1).write.parquet(folder)
        return self._written(folder)

    def compact(self, target: int = TARGET_BYTES, fan_in: int = FAN_IN) -> Manifest:
        """Merge until no tier below the target has ``fan_in`` shards; each round commits once.

        If another writer replaced a shard of a round meanwhile, the round's files
        are deleted and the next is planned from the newest version.
        """
        lost = 0
        while True:
            base = self.manifest()
            runs = plan_runs(list(base.shards), target, fan_in)
            if not runs:
                return base
            schema = StructType.fromJson(json.loads(base.schema))
            merged: list[Shard] = []
            try:
                with ThreadPoolExecutor(CONCURRENT) as pool:
                    for new in pool.map(lambda r: self._merge_run(r, schema), runs):
                        merged += new
                self._commit(merged, frozenset(s.path for r in runs for s in r))
            except (CommitConflict, PySparkException):
                # a merge also fails if a vacuum retired what it was reading
                self._delete(s.path for s in merged)
                lost += 1
                if lost >= COMMIT_TRIES or self.manifest().version == base.version:
                    raise

    def vacuum(self, keep: int = KEEP_VERSIONS, orphan_seconds: float = ORPHAN_SECONDS) -> None:
        """Retire all but the newest ``keep`` versions and delete what no other version needs.

        Manifests go first, so nobody opens a version whose shards are going.
        Files that no manifest ever named (of lost commits) go once they are
        ``orphan_seconds`` old; younger ones may be on their way to a commit.
        """
        published = self.versions()
        old, kept = published[: -max(1, keep)], published[-max(1, keep) :]
        live = {s.path for v in kept for s in self.manifest(v).shards}
        retired = {s.path for v in old for s in self.manifest(v).shards} - live
        self._delete(map(self._manifest_path, old))
        self._delete(sorted(retired))
        data, named = self._path(f"{self.root}/data"), {path.rsplit("/data/", 1)[-1] for path in live}
        if not self._fs.exists(data):
            return
        newest = time.time() - orphan_seconds
        for folder in self._fs.listStatus(data):
            files = list(self._fs.listStatus(folder.getPath()))
            shards = [f for f in files if f.getPath().getName().startswith("part-")]
            stay = [f for f in shards if f"{folder.getPath().getName()}/{f.getPath().getName()}" in named or f.getModificationTime() / 1000 > newest]
            if not stay and folder.getModificationTime() / 1000 <= newest:
                self._fs.delete(folder.getPath(), True)
            elif len(stay) < len(shards):
                self._delete(f.getPath().toString() for f in shards if f not in stay)

    # -- reading -----------------------------------------------------------------------

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default the newest."""
        m = self.manifest(version)
        if not m.schema:
            raise ValueError("nothing was ever appended")
        schema = StructType.fromJson(json.loads(m.schema))
        if not m.shards:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(s.path for s in m.shards))


def widened(before: str, added: str) -> str:
    """The schema of both: columns that only ``added`` has come last and may be null."""
    if not before or not added:
        return before or added
    schema, new = StructType.fromJson(json.loads(before)), StructType.fromJson(json.loads(added))
    for field in new.fields:
        if field.name not in schema.names:
            schema = schema.add(field.name, field.dataType, True)
        elif schema[field.name].dataType != field.dataType:
            raise ValueError(f"column {field.name} was {schema[field.name].dataType.simpleString()}, now {field.dataType.simpleString()}")
    return schema.json()


def tier(size: int, fan_in: int = FAN_IN, small: int = SMALL_BYTES) -> int:
    """0 below ``small`` bytes, then one more for each factor of ``fan_in``."""
    return 0 if size < small else 1 + int(math.log(size / small, fan_in))


def plan_runs(shards: list[Shard], target: int = TARGET_BYTES, fan_in: int = FAN_IN) -> list[list[Shard]]:
    """Runs to merge: within a tier of ``fan_in`` or more shards, neighbours by size up to the target.

    Shards of half the target or more are finished: merging two of them would pass it.
    """
    tiers: dict[int, list[Shard]] = {}
    for s in shards:
        if 2 * s.bytes <= target:
            tiers.setdefault(tier(s.bytes, fan_in), []).append(s)
    runs = []
    for _, members in sorted(tiers.items()):
        if len(members) < fan_in:
            continue
        run: list[Shard] = []
        for s in sorted(members, key=lambda s: (s.bytes, s.path)):
            if run and sum(x.bytes for x in run) + s.bytes > target:
                runs.append(run)
                run = []
            run.append(s)
        runs.append(run)
    return [r for r in runs if len(r) > 1]
