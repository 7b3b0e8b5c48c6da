"""Sharding: size-tiered compaction of small immutable shards under a versioned manifest.

A table is a folder with data files that are never changed, and manifests v00000001.json, ... of which the last is the
table. Arrivals are appended as they come: each write task leaves one small shard. Compaction takes shards by tiers of
size (each `fanout` times the one below), merges runs of at least `fanout` shards of a tier, in their order, into files
of up to the target size, and repeats until no tier has as many. A manifest is written beside its name and renamed to
it, which fails if another writer was there first; readers see the old version or the new one, never a part of one.
Files of no manifest are left by failed writers, and like those of old versions they go with `expire`, which spares the
last versions and folders that are still young, as another writer may be filling them. An append or a merge that meets
another writer's version is committed again on top of it; a merge whose shards that version has already replaced is dropped. `shard` owns its table, so it expires old versions after each merge,
and the disk holds little more than a merge's input and output.

Only facts about shards (path, bytes, rows) come to the driver; rows are merged by Spark without a shuffle, each run by
one task, whose input is at most the target size.

Nulls, empty and very long texts, and any columns are kept as they are; where a column has the name of one that `rows`
adds, the added one gets an underscore. An append with other columns widens the table: its columns are those of all
appends, by name without regard to case, and null where a shard has none. A column of another type is refused. Shards of equal size keep their order. An empty arrival adds no shard; a table without shards has its schema and no
rows. Repeated rows are kept.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import remove, unused

#: Runs merged by one job, each by one of its tasks; more of them follow in the next commits.
RUNS_AT_ONCE = 256
#: Bytes of a row group of a merged file: what a task buffers while it writes or reads one.
ROW_GROUP = 32 << 20
#: Facts of so many shards, about 100 bytes each, are sent to all tasks; of more they are joined by a shuffle.
BROADCAST_SHARDS = 50_000


def _name() -> Column:
    """The last two parts of a file's path tell the files of a table apart."""
    return F.substring_index(F.col("_metadata.file_path"), "/", -2)


def widened(old: T.StructType | None, new: T.StructType) -> T.StructType:
    """The columns of both, the old ones first; ValueError if one would change its type. Any may hold nulls."""
    held = {f.name.lower(): f for f in (old.fields if old else [])}
    plain = lambda f: T.StructType([T.StructField("c", f.dataType)]).simpleString()
    for f in new.fields:
        known = held.setdefault(f.name.lower(), f)
        if plain(known) != plain(f):
            raise ValueError(f"column {f.name} is {known.dataType.simpleString()} in the table, {f.dataType.simpleString()} in the append")
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in held.values()])


class ShardTable:
    """A table of shards in a folder of a file system that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, target: int = 128 << 20, fanout: int = 4, smallest: int = 1 << 20):
        self.spark, self.path, self.target, self.fanout, self.smallest = spark, path.rstrip("/"), target, fanout, smallest

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        return jvm, path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The last version; 0 for a table that isn't there."""
        _, path, fs = self._files()
        if not fs.exists(path):
            return 0
        names = [f.getPath().getName() for f in fs.listStatus(path)]
        return max([0, *(int(n[1:9]) for n in names if n.startswith("v") and n.endswith(".json"))])

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "schema": None, "shards": []}
        text = self.spark.read.text(f"{self.path}/manifest/v{version:08}.json", wholetext=True).first()[0]
        return json.loads(text)

    def commit(self, before: dict, schema: str, shards: list[dict]) -> dict:
        """Publish the next version; FileExistsError if another writer has published it meanwhile."""
        jvm, path, fs = self._files()
        new = {"version": before["version"] + 1, "schema": schema, "shards": shards}
        fs.mkdirs(path)
        draft, final = jvm.org.apache.hadoop.fs.Path(path, f".{uuid.uuid4().hex}"), jvm.org.apache.hadoop.fs.Path(path, f"v{new['version']:08}.json")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(fs.makeQualified(draft), fs.makeQualified(final), none)
        except Exception as e:
            fs.delete(draft, False)
            if fs.exists(final):
                raise FileExistsError(f"version {new['version']} is already there") from e
            raise
        return new

    def _shards(self, folder: str, schema: T.StructType) -> list[dict]:
        """Facts about the files of a folder just written: those without rows are left out."""
        files = self.spark.read.schema(schema).parquet(folder).groupBy(_name().alias("name"), F.col("_metadata.file_size").alias("bytes")).count().collect()
        return sorted(({"path": f"{folder}/{r['name'].rpartition('/')[2]}", "name": r["name"], "bytes": r["bytes"], "rows": r["count"]} for r in files), key=lambda s: s["path"])

    def append(self, rows: DataFrame) -> dict:
        """Add rows as small shards, one of each write task; ValueError if a column has another type than in the table."""
        self._with(self.manifest(), rows.schema)
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        rows.write.parquet(folder)
        new = self._shards(folder, rows.schema)
        while True:
            before = self.manifest()
            try:
                schema = self._with(before, rows.schema)
            except ValueError:  # another writer has given the column its type meanwhile
                remove(self.spark, folder)
                raise
            try:
                return self.commit(before, schema.json(), before["shards"] + new)
            except FileExistsError:  # another writer was first: on top of its version
                continue

    def _with(self, manifest: dict, schema: T.StructType) -> T.StructType:
        return widened(T.StructType.fromJson(json.loads(manifest["schema"])) if manifest["schema"] else None, schema)

    def tier(self, size: int) -> int:
        return max(0, math.floor(math.log(max(size, 1) / self.smallest, self.fanout)))

    def runs(self, shards: list[dict]) -> list[list[dict]]:
        """Runs of shards to merge: of tiers below the target size with at least `fanout` shards, up to the target size each."""
        tiers: dict[int, list[dict]] = {}
        for s in shards:
            if s["bytes"] < self.target / 2:
                tiers.setdefault(self.tier(s["bytes"]), []).append(s)
        out = []
        for _, own in sorted(tiers.items()):
            if len(own) < self.fanout:
                continue
            run: list[dict] = []
            for s in own:
                if run and sum(x["bytes"] for x in run) + s["bytes"] > self.target:
                    out.append(run)
                    run = []
                run.append(s)
            out.append(run)
        return [r for r in out if len(r) > 1]

    def compact(self, expire: bool = False) -> dict:
        """Merge until no tier has a run left; with `expire`, delete the shards of older versions after each commit (for tables without other readers)."""
        now = self.manifest()
        while runs := self.runs(now["shards"])[:RUNS_AT_ONCE]:
            schema = T.StructType.fromJson(json.loads(now["schema"]))
            folder = f"{self.path}/data/{uuid.uuid4().hex}"
            # one task reads the shards of a run, at most the target size, and writes them as one file: rows are not shuffled
            merged = reduce(DataFrame.union, (self.spark.read.schema(schema).parquet(*(s["path"] for s in run)).coalesce(1) for run in runs))
            merged.write.option("parquet.block.size", ROW_GROUP).parquet(folder)
            old = {s["path"] for run in runs for s in run}
            made = self._shards(folder, schema)
            while True:
                try:
                    now = self.commit(now, now["schema"], [s for s in now["shards"] if s["path"] not in old] + made)
                    break
                except FileExistsError:  # on top of the other writer's version, unless that has no more of these shards
                    now = self.manifest()
                    if not old <= {s["path"] for s in now["shards"]}:
                        remove(self.spark, folder)
                        break
            if expire:
                self.expire(1, 0)
        return now

    def expire(self, versions: int = 3, grace: float = 86_400) -> None:
        """Delete the data files that the last `versions` don't name, and older versions.

        A folder that none of them names goes only once it is `grace` seconds old: a writer may be filling it.
        """
        jvm, path, fs = self._files()
        last = self.version()
        first = max(1, last - versions + 1)
        keep: dict[str, set[str]] = {}
        for version in range(first, last + 1):
            for s in self.manifest(version)["shards"] if fs.exists(jvm.org.apache.hadoop.fs.Path(path, f"v{version:08}.json")) else []:
                folder, _, name = s["path"].rpartition("/")
                keep.setdefault(folder.rpartition("/")[2], set()).add(name)
        root = jvm.org.apache.hadoop.fs.Path(f"{self.path}/data")
        for f in fs.listStatus(root) if fs.exists(root) else []:
            named = keep.get(f.getPath().getName())
            if named is None:
                if time.time() - f.getModificationTime() / 1000 >= grace:
                    remove(self.spark, f.getPath().toString())
                continue
            for shard in fs.listStatus(f.getPath()):
                if shard.getPath().getName() not in named:
                    fs.delete(shard.getPath(), True)
        for f in fs.listStatus(path):
            if f.getPath().getName() < f"v{first:08}.json" and f.getPath().getName().startswith("v"):
                fs.delete(f.getPath(), False)

    def rows(self) -> DataFrame:
        """The rows of the last version, with shard (its place in the manifest), shard_tier, shard_rows, shard_bytes and version."""
        now = self.manifest()
        schema = T.StructType.fromJson(json.loads(now["schema"])) if now["schema"] else T.StructType()
        name, *extra = (unused(schema.names, c) for c in ("shard_name", "shard", "shard_tier", "shard_rows", "shard_bytes", "version"))
        types = [T.StringType(), T.LongType(), T.IntegerType(), T.LongType(), T.LongType(), T.LongType()]
        added = T.StructType([T.StructField(c, t) for c, t in zip((name, *extra), types, strict=True)])
        if not now["shards"]:
            return self.spark.createDataFrame([], T.StructType([*schema.fields, *added.fields[1:]]))
        facts = self.spark.createDataFrame([(s["name"], k, self.tier(s["bytes"]), s["rows"], s["bytes"], now["version"]) for k, s in enumerate(now["shards"])], added)
        if len(now["shards"]) <= BROADCAST_SHARDS:
            facts = F.broadcast(facts)
        read = self.spark.read.schema(schema).parquet(*(s["path"] for s in now["shards"])).withColumn(name, _name())
        return read.join(facts, name).select(*schema.names, *extra)


def shard(docs: DataFrame, path: str, arrivals: int = 2, key: str = "doc_id", target: int = 128 << 20, fanout: int = 4) -> DataFrame:
    """Append docs in `arrivals` parts of about the same size, compacting after each; the rows of the final version."""
    table = ShardTable(docs.sparkSession, path, target, fanout)
    for k in range(arrivals):
        table.append(docs.where(F.pmod(F.xxhash64(key), F.lit(arrivals)) == k))
        table.compact(expire=True)
    table.expire(1, 0)
    return table.rows()
