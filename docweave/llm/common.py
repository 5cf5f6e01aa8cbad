"""Shared helpers of the training-data operators: arguments, shared storage, hashing."""

from __future__ import annotations

import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words in every contract of this package: space and \x09-\x0D.
WORD_BREAKS = r"[\x20\x09-\x0D]+"
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 4 << 20) -> None:
    """Bounds the rows and the bytes that one Arrow batch brings to a Python worker: whole texts can be long.
    A longer row comes by itself; none is cut."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def tidied(work):
    """A worker outlives its tasks: what a task has freed goes back to the system at its end."""

    def run(batches):
        import ctypes

        import pyarrow as pa

        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return run


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a session without one (a test) gets its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
        spark.sparkContext.setCheckpointDir(found)
    return found


class Shelf:
    """Tables written to the shared folder: they cut lineage and outlive executors."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark).rstrip('/')}/shelf-{uuid.uuid4().hex}"
        self.count = 0

    def put(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.shelf_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Deletes a table that no later plan reads."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.shelf_path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fold(text_id: int, modulus: int) -> int:
    return zlib.crc32(str(text_id).encode()) % modulus


def fold_col(id_col: str, modulus: int):
    """crc32 of the id as text, modulo: the folds that the contracts fix."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(modulus)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes:
    """Word -> 64-bit hash, remembered for words met before; the memory is bounded, the hashes are not affected."""

    def __init__(self, most: int = 400_000):
        import xxhash

        self._hash, self._most, self._known = xxhash.xxh3_64_intdigest, most, {}

    def __call__(self, words: list[bytes] | list[str]) -> np.ndarray:
        known = self._known
        if len(known) > self._most:
            known.clear()
        out = np.empty(len(words), dtype=np.uint64)
        h = self._hash
        try:
            out[:] = [known[w] for w in words]
            return out
        except KeyError:
            for w in set(words):
                if w not in known:
                    known[w] = h(w)
            out[:] = [known[w] for w in words]
            return out


def first_of_each(rows, key: str, order: list[str], n: int, parts: int = 16):
    """Each key's first n rows in order. A hot key is dealt over `parts` first, so that one task gets parts * n
    rows of it at most, whatever the key has."""
    from pyspark.sql import Window

    part = F.pmod(F.xxhash64(*order), F.lit(parts))
    local = rows.withColumn("__part", part).withColumn("__n", F.row_number().over(Window.partitionBy(key, "__part").orderBy(*order))).filter(F.col("__n") <= n)
    return local.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("__n") <= n).drop("__part", "__n")


def first_texts(rows, n: int):
    """The n distinct texts whose hashes come first (text, at), collected: hashes alone decide, so that tasks send
    n numbers and not n texts to the driver; copies of a text count once."""
    hashed = rows.filter("text IS NOT NULL").select("text", F.xxhash64("text").alias("at"))
    last = hashed.select("at").distinct().orderBy("at").limit(n).agg(F.max("at")).first()[0]
    return [] if last is None else sorted(hashed.filter(F.col("at") <= last).dropDuplicates(["at"]).collect(), key=lambda r: r.at)


def texts_as_bytes(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null is empty."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]
