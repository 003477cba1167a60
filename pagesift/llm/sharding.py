"""Sharding by size-tiered compaction.

A store is a folder of immutable Parquet shards and of versioned manifests. ``append`` writes arrivals as
small shards; ``compact`` merges shards of a similar size, ``fanout`` or more at a time, into files of about
``target_bytes``. Each ends with one commit: the next manifest is written under another name and renamed to
its version number, which fails if that version exists. (Hadoop's file systems and local disks rename in one
step; object stores may not, and need a committer of their own.) Readers see one version whole or not at all; a job
that dies before its commit leaves only files that no manifest names. The driver handles file names and
sizes alone.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, table

SMALL_BYTES = 4 << 20
TARGET_BYTES = 128 << 20
FANOUT = 4
#: The list of shards is broadcast up to this length, joined by shuffle beyond it.
BROADCAST_SHARDS = 100_000


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int


class CommitConflict(RuntimeError):
    """Another writer has committed this version."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, small_bytes: int = SMALL_BYTES, fanout: int = FANOUT):
        self.spark, self.root = spark, root.rstrip("/")
        self.target_bytes, self.small_bytes, self.fanout = target_bytes, small_bytes, max(2, fanout)
        self._jvm = spark.sparkContext._jvm
        path = self._path(self.root)
        self._fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/manifests"))

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def _files(self, folder: str, ending: str) -> list[Shard]:
        path = self._path(folder)
        if not self._fs.exists(path):
            return []
        found = [(s.getPath().getName(), s.getLen()) for s in self._fs.listStatus(path)]
        return sorted((Shard(n, size) for n, size in found if n.endswith(ending) and n[0] not in "._"), key=lambda s: s.path)

    # Manifests

    def version(self) -> int:
        """The newest version; 0 if nothing was committed."""
        return max((int(f.path[1:-5]) for f in self._files(f"{self.root}/manifests", ".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "schema": None, "shards": []}
        stream = self._fs.open(self._path(f"{self.root}/manifests/v{version:08d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def shards(self, version: int | None = None) -> list[Shard]:
        return [Shard(**s) for s in self.manifest(version)["shards"]]

    def _commit(self, base: int, schema: str, shards: list[Shard]) -> int:
        body = json.dumps({"version": base + 1, "schema": schema, "shards": [asdict(s) for s in shards]})
        temp = self._path(f"{self.root}/manifests/.{uuid.uuid4().hex}")
        stream = self._fs.create(temp, False)
        stream.write(bytearray(body.encode("utf-8")))
        stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri())
        kind = self._jvm.org.apache.hadoop.fs.Options.Rename
        none = self.spark.sparkContext._gateway.new_array(kind, 1)
        none[0] = kind.NONE
        try:
            context.rename(temp, self._path(f"{self.root}/manifests/v{base + 1:08d}.json"), none)
        except Exception as e:
            self._fs.delete(temp, False)
            if "AlreadyExists" in str(e):
                raise CommitConflict(f"version {base + 1} exists") from e
            raise
        return base + 1

    # Data

    def _written(self, df: DataFrame) -> list[Shard]:
        folder = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{folder}")
        return [Shard(f"{folder}/{s.path}", s.bytes) for s in self._files(f"{self.root}/{folder}", ".parquet")]

    def append(self, df: DataFrame) -> int:
        """Adds rows as small shards, in the partitions that ``df`` has; returns the new version. Columns of other names or types than the store's are an error."""
        from pyspark.sql.types import StructType

        now = self.manifest()
        if now["schema"]:
            held = StructType.fromJson(json.loads(now["schema"]))
            columns = lambda schema: sorted((f.name, f.dataType.simpleString()) for f in schema)
            if columns(held) != columns(df.schema):
                raise ValueError(f"the store has {held.simpleString()}, the arrival {df.schema.simpleString()}")
        return self._commit(now["version"], now["schema"] or df.schema.json(), self.shards(now["version"]) + self._written(df))

    def read(self, version: int | None = None, only: list[Shard] | None = None) -> DataFrame:
        from pyspark.sql.types import StructType

        now = self.manifest(version)
        shards = [Shard(**s) for s in now["shards"]] if only is None else only
        if now["schema"] is None:
            raise ValueError("nothing was committed to this store")
        schema = StructType.fromJson(json.loads(now["schema"]))
        if not shards:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{s.path}" for s in shards])

    def tier(self, shard: Shard) -> int:
        """0 up to ``small_bytes``, then one more for each factor of ``fanout``; -1 for a finished shard."""
        if shard.bytes * 2 > self.target_bytes:
            return -1
        return max(0, math.ceil(math.log(max(1, shard.bytes) / self.small_bytes, self.fanout)))

    def compact(self) -> int:
        """Merges until no tier has ``fanout`` shards; returns the version then. Rows only ever move to other files."""
        while True:
            now = self.manifest()
            shards = [Shard(**s) for s in now["shards"]]
            tiers: dict[int, list[Shard]] = {}
            for s in shards:
                tiers.setdefault(self.tier(s), []).append(s)
            ripe = min((t for t, of in tiers.items() if t >= 0 and len(of) >= self.fanout), default=None)
            if ripe is None:
                return now["version"]
            merge = tiers[ripe]
            files = max(1, round(sum(s.bytes for s in merge) / self.target_bytes))
            if files >= len(merge):
                return now["version"]
            new = self._written(self.read(now["version"], merge).coalesce(files))
            gone = {s.path for s in merge}
            self._commit(now["version"], now["schema"], [s for s in shards if s.path not in gone] + new)

    def described(self) -> DataFrame:
        """(file, shard, shard_bytes, tier) of the newest version's shards."""
        import pyarrow as pa

        rows = [{"file": s.path.split("/")[-1], "shard": i, "shard_bytes": s.bytes, "tier": self.tier(s)} for i, s in enumerate(self.shards())]
        kinds = pa.schema([("file", pa.string()), ("shard", pa.int32()), ("shard_bytes", pa.int64()), ("tier", pa.int32())])
        return self.spark.createDataFrame(pa.Table.from_pylist(rows, kinds))

    def vacuum(self) -> None:
        """Deletes data folders that the newest version doesn't name, and older manifests. For times without readers or writers."""
        version = self.version()
        named = {s.path.split("/")[1] for s in self.shards(version)}
        data = self._path(f"{self.root}/data")
        for s in self._fs.listStatus(data) if self._fs.exists(data) else []:
            if s.getPath().getName() not in named:
                self._fs.delete(s.getPath(), True)
        for f in self._files(f"{self.root}/manifests", ".json"):
            if int(f.path[1:-5]) < version:
                self._fs.delete(self._path(f"{self.root}/manifests/{f.path}"), False)


def shard_arrivals(arrivals: list[DataFrame], root: str, history: bool = False, **options) -> ShardStore:
    """Appends each arrival, compacts, and returns the store. Only with ``history`` older versions can still be read.

    Rows are stored as they are: nulls, repeated rows and any columns are kept. Later arrivals must have the
    first one's columns, or an error is raised. An empty arrival adds no rows.
    """
    store = ShardStore(arrivals[0].sparkSession, root, **options)
    for df in arrivals:
        store.append(df)
    store.compact()
    if not history:
        store.vacuum()
    return store


def op10_sharding(spark, sf_dir):
    """The whole table, arriving in four parts, from the compacted store: each document, its shard's number and that shard's bytes and tier."""
    docs = table(spark, sf_dir, "documents")
    part = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4))
    store = shard_arrivals([docs.where(part == i) for i in range(4)], scratch(spark, "shards"))
    facts = store.described()
    files = store.read().select("doc_id", F.col("_metadata.file_name").alias("file"))
    small = len(store.shards()) <= BROADCAST_SHARDS
    return files.join(F.broadcast(facts) if small else facts, "file").select("doc_id", "shard", "shard_bytes", "tier", F.lit(store.version()).cast("long").alias("version"))


SQL: dict[str, str] = {}
QUERIES = {"op10_sharding": op10_sharding}
