"""Size-tiered sharding with a versioned manifest. DataFrame and SQL functions only.

Arrivals are appended as small immutable Parquet shards. Compaction groups live
shards into tiers by size (each tier ``fanout`` times the one below), and a tier
that holds at least ``fanout`` runs is merged into files of about the target size.
Each step ends with one atomic commit: a complete manifest (shards and schema) is
written beside the versions and renamed to the next version number, which fails if
another writer was first. Readers see one version, whole; shards are never changed in
place.

The driver handles shard names and sizes only (a row for each file, never rows).

Defined results
- every row is kept exactly once, nulls, repeated rows and extra columns included
- the schema is the manifest's: a column that an append adds is null in older rows, one
  that it lacks is null in its own; a column whose type differs raises ``ValueError``
- an empty table commits a version without shards and with its schema
- a lost commit race is taken up again on the new version: appends keep their files,
  a merge whose runs are gone is made anew; only ``commit`` raises ``CommitConflict``
- a writer announces its folder before it writes; ``vacuum`` removes what no kept version
  names, but for announced folders younger than ``grace`` seconds
"""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class CommitConflict(RuntimeError):
    """Another writer committed the version first."""


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int
    rows: int


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, schema: T.StructType | None = None, target_bytes: int = 128 << 20, fanout: int = 4, smallest: int = 64 << 10) -> None:
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.target, self.fanout, self.smallest = target_bytes, fanout, smallest
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _fs(self):
        return self._path().getFileSystem(self._conf)

    def versions(self) -> list[int]:
        folder = self._path("_manifest")
        if not self._fs().exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs().listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def _manifest(self, version: int | None) -> dict:
        known = self.versions()
        if version is None:
            version = known[-1] if known else 0
        if version == 0:
            return {"shards": [], "schema": None}
        name = self._path("_manifest", f"v{version:010d}.json")
        stream = self._fs().open(name)
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def shards(self, version: int | None = None) -> list[Shard]:
        """The live shards of a version; the newest by default."""
        return [Shard(**s) for s in self._manifest(version)["shards"]]

    def schema_of(self, version: int | None = None) -> T.StructType | None:
        """The schema of a version, or the one the store was opened with where none is committed."""
        known = self._manifest(version)["schema"]
        return T.StructType.fromJson(known) if known else self.schema

    def _merged(self, known: T.StructType | None, new: T.StructType) -> T.StructType:
        """``known`` with the columns that only ``new`` has; all may be null."""
        fields = {f.name.lower(): T.StructField(f.name, f.dataType, True) for f in (known or T.StructType())}
        for f in new:
            same = fields.setdefault(f.name.lower(), T.StructField(f.name, f.dataType, True))
            if same.dataType != f.dataType:
                raise ValueError(f"column {f.name} is {same.dataType.simpleString()}, not {f.dataType.simpleString()}")
        return T.StructType(list(fields.values()))

    def commit(self, base: int, shards: list[Shard], schema: T.StructType | None = None) -> int:
        """Publish ``shards`` as version ``base + 1``; all or nothing."""
        schema = schema or self.schema_of(base)
        draft = self._path("_manifest", f".draft-{uuid.uuid4().hex}")
        out = self._fs().create(draft, False)
        out.write(bytearray(json.dumps({"version": base + 1, "schema": schema and schema.jsonValue(), "shards": [asdict(s) for s in shards]}).encode()))
        out.close()
        final = self._path("_manifest", f"v{base + 1:010d}.json")
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, final, none)  # never overwrites
        except Exception as e:
            self._fs().delete(draft, False)
            if "FileAlreadyExists" in str(e) or "already exists" in str(e):
                raise CommitConflict(f"version {base + 1} is taken") from e
            raise
        return base + 1

    def _write(self, df: DataFrame) -> tuple[str, list[Shard]]:
        """The announced folder's name and the shards written to it."""
        name = uuid.uuid4().hex
        self._fs().create(self._path("_drafts", name), False).close()
        folder = f"{self.root}/data/{name}"
        df.write.option("compression", "zstd").parquet(folder)
        written = self.spark.read.schema(df.schema).parquet(folder)
        found = written.groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes")).agg(F.count("*").alias("rows"))
        return name, sorted((Shard(r["path"], r["bytes"], r["rows"]) for r in found.collect()), key=lambda s: s.path)

    def _done(self, name: str) -> None:
        self._fs().delete(self._path("_drafts", name), False)

    def _newest(self) -> int:
        return (self.versions() or [0])[-1]

    def append(self, df: DataFrame) -> int:
        """Add arrivals: each of their partitions becomes one small shard."""
        self._merged(self.schema_of(), df.schema)  # a wrong type shows before anything is written
        name, new = self._write(df)
        while True:
            base = self._newest()
            try:
                version = self.commit(base, self.shards(base) + new, self._merged(self.schema_of(base), df.schema))
            except CommitConflict:
                continue
            self._done(name)
            return version

    def tier(self, shard: Shard) -> int:
        return max(0, int(math.log(max(shard.bytes, 1) / self.smallest, self.fanout)) + 1) if shard.bytes > self.smallest else 0

    def runs_to_merge(self, shards: list[Shard]) -> list[Shard]:
        """All runs of the smallest tier that is full; shards near the target are finished."""
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            if s.bytes * 2 <= self.target:
                tiers.setdefault(self.tier(s), []).append(s)
        full = [t for t, runs in sorted(tiers.items()) if len(runs) >= self.fanout]
        return tiers[full[0]] if full else []

    def compact(self) -> int:
        """Merge full tiers until none is left; one commit for each merge."""
        while True:
            base = self._newest()
            runs = self.runs_to_merge(self.shards(base))
            if not runs:
                return base
            files = max(1, round(sum(s.bytes for s in runs) / self.target))
            name, merged = self._write(self._read(runs, self.schema_of(base)).coalesce(files))
            gone = {s.path for s in runs}
            while gone <= {s.path for s in self.shards(base)}:
                try:
                    self.commit(base, [s for s in self.shards(base) if s.path not in gone] + merged)
                    break
                except CommitConflict:
                    base = self._newest()
            self._done(name)

    def _read(self, shards: list[Shard], schema: T.StructType | None) -> DataFrame:
        if not shards:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[s.path for s in shards])

    def read(self, version: int | None = None) -> DataFrame:
        return self._read(self.shards(version), self.schema_of(version))

    def vacuum(self, keep_versions: int = 1, grace: float = 86_400) -> int:
        """Drop manifests but the newest ones, and shards that no kept version names.

        Folders are listed first, then what is announced, then what is committed, so a
        writer that ends in between is seen as one or the other.
        """
        fs, data, drafts = self._fs(), self._path("data"), self._path("_drafts")
        folders = [f.getPath() for f in fs.listStatus(data)] if fs.exists(data) else []
        young = (time.time() - grace) * 1000
        busy = {d.getPath().getName() for d in fs.listStatus(drafts) if d.getModificationTime() > young} if fs.exists(drafts) else set()
        known = self.versions()
        live = {self._jvm.org.apache.hadoop.fs.Path(s.path).toUri().getPath() for v in known[-keep_versions:] for s in self.shards(v)}
        for v in known[:-keep_versions]:
            fs.delete(self._path("_manifest", f"v{v:010d}.json"), False)
        removed = 0
        for folder in folders:
            if folder.getName() in busy:
                continue
            files = [f.getPath() for f in fs.listStatus(folder)]
            kept = [f for f in files if f.toUri().getPath() in live]
            removed += sum(f.getName().startswith("part-") for f in files if f not in kept)
            if not kept:
                fs.delete(folder, True)
            else:
                for f in files:
                    if f.getName().startswith("part-") and f not in kept:
                        fs.delete(f, False)
        return removed
