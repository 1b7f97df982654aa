"""Tables of key buckets with a manifest: upserts that are seen whole or not at all, and reads of a few keys.

A table is a folder.  Rows lie in ``data/<commit>/bucket=<n>`` by a hash of the key; a manifest, one small JSON file a version, says for each bucket which
commits hold its rows.  A reader takes the newest manifest and sees its files alone.  A writer adds files that no manifest names yet, and then
creates the next manifest, which fails if another writer was faster; so a writer that dies leaves the version before it as it was, and files that nobody
names until :meth:`KeyedTable.vacuum`.  The manifest keeps the newest batch number of each writer, so a batch that comes again changes nothing.

The number of buckets is fixed when a table is created: what a manifest holds grows with it, not with the rows.
All files are reached through Hadoop's file systems, so a table may lie wherever Spark reads and writes.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another writer committed first; what this one read may be out of date."""


@dataclass
class Version:
    """One manifest."""

    number: int
    schema: str
    keys: list[str]
    buckets: int
    files: dict[int, list[str]] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop
        self._path = hadoop.fs.Path
        self.fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: StructType, keys: list[str], buckets: int = 64) -> KeyedTable:
        """The table at ``path``, empty if there is none yet."""
        table = cls(spark, path)
        if table.version() is None:
            try:
                table._commit(Version(0, schema.json(), keys, buckets))
            except Conflict:
                pass  # created meanwhile
        return table

    def _manifests(self) -> list[int]:
        folder = self._path(f"{self.path}/manifests")
        if not self.fs.exists(folder):
            return []
        names = (s.getPath().getName() for s in self.fs.listStatus(folder))
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def version(self, number: int | None = None) -> Version | None:
        """The newest version, or the one asked for."""
        known = self._manifests()
        if not known or (number is not None and number not in known):
            return None
        stream = self.fs.open(self._path(f"{self.path}/manifests/{known[-1] if number is None else number:012d}.json"))
        try:
            text = bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()
        held = json.loads(text)
        return Version(**held | {"files": {int(b): f for b, f in held["files"].items()}})

    def _commit(self, version: Version) -> None:
        """The next manifest: written beside its place and renamed into it, which fails where there is one."""
        target = self._path(f"{self.path}/manifests/{version.number:012d}.json")
        draft = self._path(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        stream = self.fs.create(draft, False)
        try:
            stream.write(bytearray(json.dumps(version.__dict__).encode()))
        finally:
            stream.close()
        try:
            if self.fs.exists(target) or not self.fs.rename(draft, target):
                raise Conflict(f"version {version.number} of {self.path} is there already")
        finally:
            if self.fs.exists(draft):
                self.fs.delete(draft, False)

    def bucket(self, version: Version) -> Column:
        return F.pmod(F.xxhash64(*version.keys), F.lit(version.buckets)).cast("int")

    def read(self, buckets: Iterable[int] | None = None, *, version: Version | None = None) -> DataFrame:
        """All rows of a version, or those of some buckets; no other files are listed or opened."""
        version = version or self.version()
        schema = StructType.fromJson(json.loads(version.schema))
        chosen = sorted(version.files if buckets is None else set(buckets) & version.files.keys())
        paths = [f"{self.path}/{f}/bucket={b}" for b in chosen for f in version.files[b]]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def lookup(self, keys: list[tuple], *, version: Version | None = None) -> DataFrame:
        """The rows of a few keys, from their buckets alone; the keys are pushed to the scan too."""
        version = version or self.version()
        schema = StructType.fromJson(json.loads(version.schema))
        asked = self.spark.createDataFrame(keys, StructType([schema[k] for k in version.keys]))
        found = self.read([r[0] for r in asked.select(self.bucket(version)).distinct().collect()], version=version)
        same = (reduce(Column.__and__, (F.col(k) == F.lit(v) for k, v in zip(version.keys, key, strict=True))) for key in keys)
        return found.where(reduce(Column.__or__, same, F.lit(False)))

    def _written(self, rows: DataFrame, version: Version, order: list[str | Column], spread: str | None, spreads: int) -> dict[int, str]:
        """Writes rows by bucket and says where; a frequent key's bucket may be several files, dealt by ``spread``."""
        commit = f"data/{uuid.uuid4().hex}"
        keyed = rows.withColumn("bucket", self.bucket(version))
        deal = [F.col("bucket")] + ([F.pmod(F.xxhash64(spread), F.lit(spreads))] if spread else [])
        keyed.repartition(*deal).sortWithinPartitions("bucket", *order).write.partitionBy("bucket").parquet(f"{self.path}/{commit}")
        found = self.fs.listStatus(self._path(f"{self.path}/{commit}"))
        names = [s.getPath().getName() for s in found]
        return {int(n.removeprefix("bucket=")): commit for n in names if n.startswith("bucket=")}

    def append(self, rows: DataFrame, batch: tuple[str, int] | None = None, *, order: list[str | Column] | None = None, spread: str | None = None, spreads: int = 8) -> bool:
        """Adds rows beside those held, none of which is read; False where the batch (writer, number) is known already."""
        held = self.version()
        if batch and held.batches.get(batch[0], -1) >= batch[1]:
            return False
        new = self._written(rows, held, order or held.keys, spread, spreads)
        files = {b: [*held.files.get(b, []), *([new[b]] if b in new else [])] for b in held.files.keys() | new.keys()}
        self._commit(Version(held.number + 1, held.schema, held.keys, held.buckets, files, held.batches | (dict([batch]) if batch else {})))
        return True

    def upsert(self, rows: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], batch: tuple[str, int] | None = None, *, order: list[str | Column] | None = None, spread: str | None = None, spreads: int = 8) -> bool:
        """Replaces the buckets that hold a key of ``rows`` by ``merge(held rows of these buckets, rows)``; False where the batch is known already.

        Only these buckets are read and written.
        """
        held = self.version()
        if batch and held.batches.get(batch[0], -1) >= batch[1]:
            return False
        touched = sorted(r[0] for r in rows.select(self.bucket(held)).distinct().collect())  # no more than there are buckets
        new = self._written(merge(self.read(touched, version=held), rows), held, order or held.keys, spread, spreads) if touched else {}
        files = {b: f for b, f in held.files.items() if b not in touched} | {b: [f] for b, f in new.items()}
        self._commit(Version(held.number + 1, held.schema, held.keys, held.buckets, files, held.batches | (dict([batch]) if batch else {})))
        return True

    def vacuum(self, keep: int = 1) -> int:
        """Removes the buckets' files that none of the newest ``keep`` versions names, and older manifests; not for use beside a running writer.  Returns how many buckets went."""
        numbers = self._manifests()
        named = {f"{f}/bucket={b}" for n in numbers[-keep:] for b, files in self.version(n).files.items() for f in files}
        gone = 0
        if self.fs.exists(self._path(f"{self.path}/data")):
            for commit in [s.getPath() for s in self.fs.listStatus(self._path(f"{self.path}/data"))]:
                inside = [s.getPath() for s in self.fs.listStatus(commit) if s.getPath().getName().startswith("bucket=")]
                old = [x for x in inside if f"data/{commit.getName()}/{x.getName()}" not in named]
                for x in [commit] if len(old) == len(inside) else old:
                    self.fs.delete(x, True)
                gone += len(old)
        for n in numbers[:-keep]:
            self.fs.delete(self._path(f"{self.path}/manifests/{n:012d}.json"), False)
        return gone
