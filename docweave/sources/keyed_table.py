"""A stored table with a key: buckets of Parquet files under a manifest that is swapped as a whole.

Rows are dealt into a fixed number of buckets by the hash of `group` columns, which are part of the key (a document's
id for its chunks, vectors or edges), so that all rows of a group lie in one bucket. A write reads and rewrites the
buckets that its rows touch and no others: the new files go to a folder of their own, then a manifest with the next
number names each bucket's folder. The manifest is put in place by one rename that fails if the number is taken, so
a writer that comes second, or that dies half way, changes nothing; readers see the version that they opened.
Folders and manifests are reached through Spark's file systems only.

Keys are unique: rows that repeat a key within one write are refused before anything is written. A null in a key is
a value like any other. Extra columns are kept; a write must have the table's columns.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Tasks that write a bucket, each a file of its own: a task holds no whole bucket.
SPLITS = 8


class Conflict(RuntimeError):
    """Another writer has put the next version in place."""


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    @classmethod
    def create(cls, rows: DataFrame, path: str, key: list[str], group: list[str] | None = None, buckets: int = 64) -> KeyedTable:
        """A new table of these rows. group: columns of the key whose rows lie together (the whole key if not given)."""
        table = cls(rows.sparkSession, path)
        group = group or key
        if not set(group) <= set(key):
            raise ValueError("groups are told by columns of the key")
        table._refuse_repeats(rows, key)
        head = {"key": key, "group": group, "buckets": buckets, "schema": rows.schema.json(), "where": {}}
        head["where"] = table._write(rows, head)
        table._publish(0, head)
        return table

    def versions(self) -> list[int]:
        folder = self._at(f"{self.path}/manifests")
        if not self._fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName().removesuffix(".json")) for s in self._fs.listStatus(folder) if s.getPath().getName().endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        found = self.versions()
        if not found:
            raise FileNotFoundError(self.path)
        text = self.spark.read.text(f"{self.path}/manifests/{found[-1] if version is None else version}.json", wholetext=True).first()[0]
        return json.loads(text)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the newest version, or of an older one that was not vacuumed."""
        head = self.manifest(version)
        return self._rows(head, head["where"])

    def lookup(self, groups: DataFrame) -> DataFrame:
        """The rows of the groups named by `groups`; only their buckets are read."""
        head = self.manifest()
        touched = {str(r[0]) for r in groups.select(self._bucket(head)).distinct().collect()}  # `buckets` numbers at most
        old = self._rows(head, {b: n for b, n in head["where"].items() if b in touched})
        gone = groups.select(*[F.col(c).alias(f"__{c}") for c in head["group"]]).distinct()
        return old.join(gone, reduce(lambda a, b: a & b, [old[c].eqNullSafe(gone[f"__{c}"]) for c in head["group"]]), "left_semi")

    def upsert(self, rows: DataFrame) -> int:
        """Puts rows in, in place of those of the same key. Returns the new version."""
        return self._change(rows, lambda old, new, head: self._without(old, new, head["key"]).unionByName(new), unique=True)

    def replace_groups(self, rows: DataFrame) -> int:
        """Puts rows in, in place of all rows of their groups: a document's chunks or edges as a whole."""
        return self._change(rows, lambda old, new, head: self._without(old, new, head["group"]).unionByName(new), unique=True)

    def delete_groups(self, groups: DataFrame) -> int:
        """Takes out all rows of the groups named by `groups`."""
        return self._change(groups, lambda old, new, head: self._without(old, new, head["group"]), unique=False)

    def vacuum(self, keep: int = 1) -> None:
        """Deletes all but the newest `keep` versions and the folders that none of these names."""
        kept = self.versions()[-keep:]
        used = {name for v in kept for name in self.manifest(v)["where"].values()}
        for v in self.versions():
            if v not in kept:
                self._fs.delete(self._at(f"{self.path}/manifests/{v}.json"), False)
        for s in self._fs.listStatus(self._at(f"{self.path}/data")):
            if not any(name.startswith(f"{s.getPath().getName()}/") for name in used):
                self._fs.delete(s.getPath(), True)

    @staticmethod
    def _without(old: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
        gone = new.select(*[F.col(c).alias(f"__{c}") for c in columns]).distinct()
        return old.join(gone, reduce(lambda a, b: a & b, [old[c].eqNullSafe(gone[f"__{c}"]) for c in columns]), "left_anti")

    @staticmethod
    def _refuse_repeats(rows: DataFrame, key: list[str]) -> None:
        twice = rows.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1").first()
        if twice is not None:
            raise ValueError(f"a key comes {twice.n} times: {twice.asDict()}")

    def _bucket(self, head: dict):
        return F.pmod(F.xxhash64(*head["group"]), F.lit(head["buckets"])).cast("int")

    def _rows(self, head: dict, where: dict) -> DataFrame:
        shape = T.StructType.fromJson(json.loads(head["schema"]))
        if not where:
            return self.spark.createDataFrame([], shape)
        return self.spark.read.schema(shape).parquet(*[f"{self.path}/data/{name}" for name in sorted(where.values())])

    def _write(self, rows: DataFrame, head: dict) -> dict:
        """Writes rows bucket by bucket; which folder each bucket is in."""
        name = uuid.uuid4().hex
        shape = T.StructType.fromJson(json.loads(head["schema"]))
        dealt = rows.select(*[F.col(f.name).cast(f.dataType) for f in shape]).withColumn("__bucket", self._bucket(head))
        dealt.repartition("__bucket", F.pmod(F.xxhash64(*head["key"]), F.lit(SPLITS))).sortWithinPartitions("__bucket", *head["key"]).write.partitionBy("__bucket").parquet(f"{self.path}/data/{name}")
        folders = [s.getPath().getName() for s in self._fs.listStatus(self._at(f"{self.path}/data/{name}"))]
        return {f.split("=")[1]: f"{name}/{f}" for f in folders if f.startswith("__bucket=")}

    def _change(self, rows: DataFrame, merge, unique: bool) -> int:
        version = self.versions()[-1]
        head = self.manifest(version)
        if unique:
            self._refuse_repeats(rows, head["key"])
        touched = [str(r[0]) for r in rows.select(self._bucket(head)).distinct().collect()]  # `buckets` numbers at most
        old = self._rows(head, {b: head["where"][b] for b in touched if b in head["where"]})
        new = self._write(merge(old, rows, head), head)
        head["where"] = {b: n for b, n in head["where"].items() if b not in touched} | new
        self._publish(version + 1, head)
        return version + 1

    def _publish(self, version: int, head: dict) -> None:
        """Puts a manifest in place by a rename, which fails where the version is there already."""
        draft, target = self._at(f"{self.path}/drafts/{uuid.uuid4().hex}.json"), self._at(f"{self.path}/manifests/{version}.json")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(head).encode()))
        out.close()
        self._fs.mkdirs(target.getParent())
        if self._fs.exists(target) or not self._fs.rename(draft, target):
            self._fs.delete(draft, False)
            raise Conflict(f"version {version} of {self.path}")
