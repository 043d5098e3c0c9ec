"""Helpers shared by the training-data operators: tables, scratch space, hashes, caches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.plans.scratch import discard, scratch_path, work_dir, written

__all__ = ["Kept", "bucketed", "crc_mod", "discard", "released", "scratch_path", "shuffle_partitions", "table", "work_dir", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucketed(df: DataFrame, key: str, name: str = "buckets") -> DataFrame:
    """df as a table in the shared folder, in as many buckets of key as a shuffle has
    partitions: one shuffle of its rows, after which joins and aggregations by key move
    none of them. The catalogue forgets the table at once; discard() deletes its files."""
    spark = df.sparkSession
    n, path, entry = shuffle_partitions(spark), scratch_path(spark, name), f"graphloom_{uuid.uuid4().hex}"
    df.repartition(n, key).write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(n, key).saveAsTable(entry)
    out = spark.table(entry)
    out.schema  # resolved while the catalogue knows it
    spark.sql(f"DROP TABLE {entry}")
    out._scratch = path
    return out


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(doc_id.cast("string")) % n


class Kept:
    """Values of a function by key, kept within a bound in bytes.

    One belongs to one task's iterator (or one cell) and goes with it, so that workers
    which serve several stages hold nothing between them. When the bound is reached the
    kept values are dropped and gathered anew.
    """

    ENTRY = 160
    """Bytes an entry takes beside its key and value."""

    def __init__(self, of: Callable[[list[bytes]], list], most: int = 48 << 20):
        self.of, self.most = of, most
        self.values: dict[bytes, object] = {}
        self.bytes = 0

    def all(self, keys: list[bytes]) -> Iterator:
        """The values of keys, in their order."""
        new = list(set(keys).difference(self.values))
        if new:
            if self.bytes + sum(map(len, new)) + self.ENTRY * len(new) > self.most:
                self.values.clear()
                self.bytes = 0
                new = list(set(keys))
            got = self.of(new)
            self.values.update(zip(new, got, strict=True))
            self.bytes += sum(map(len, new)) + self.ENTRY * len(new)
            if isinstance(got[0], bytes):
                self.bytes += sum(map(len, got))
        return map(self.values.__getitem__, keys)


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """batches, after which Arrow's unused memory goes back to the system."""
    try:
        yield from batches
    finally:
        pa.default_memory_pool().release_unused()
