"""Scratch tables in the folder that all executors share; they cut long lineages."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SPLIT = "spark.sql.files.maxPartitionBytes"
SPLIT_BYTES = 32 << 20
"""Most bytes of a file that a task of a write reads: tables of ids are a tenth of their rows' size."""


def work_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or on a local master without that setting a temporary folder."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    sc = spark.sparkContext._jsc.sc()
    if not sc.getCheckpointDir().isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="graphloom-"))
    return sc.getCheckpointDir().get().rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has gone; it is scratch space
        pass


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, deleted when Python ends."""
    path = f"{work_dir(spark)}/graphloom-{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


@contextlib.contextmanager
def _swept(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes within go when each of them ends, not when the driver collects garbage;
    and their tasks read at most SPLIT_BYTES."""
    before = {SWEEP: spark.conf.get(SWEEP, "false"), SPLIT: spark.conf.get(SPLIT)}
    spark.conf.set(SWEEP, "true")
    spark.conf.set(SPLIT, str(min(SPLIT_BYTES, spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Cuts the lineage: df as a Parquet table in the shared folder, read again.

    Survives lost executors, since its files belong to none of them. What the write shuffled
    is deleted with it, so that a loop holds the files of one round."""
    path = scratch_path(df.sparkSession, name)
    with _swept(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def bucketed(df: DataFrame, key: str, name: str = "buckets") -> DataFrame:
    """df as a table in the shared folder, in as many buckets of key as a shuffle has partitions:
    one shuffle of its rows, after which joins by key move none of them. The catalogue forgets
    the table at once; discard() deletes its files."""
    spark = df.sparkSession
    n, path, entry = int(spark.conf.get("spark.sql.shuffle.partitions")), scratch_path(spark, name), f"graphloom_{uuid.uuid4().hex}"
    with _swept(spark):
        df.repartition(n, key).write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(n, key).saveAsTable(entry)
    out = spark.table(entry)
    out.schema  # resolved while the catalogue knows it
    spark.sql(f"DROP TABLE {entry}")
    out._scratch = path
    return out


def discard(df: DataFrame | None) -> None:
    """Deletes the table that written() made for df; nothing may read it any more."""
    path = vars(df).get("_scratch") if df is not None else None
    if path:
        _delete(df.sparkSession, path)
