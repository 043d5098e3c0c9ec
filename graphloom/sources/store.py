"""Versioned tables in a folder: a manifest names the live files, nothing is overwritten.

A commit works out which rows differ from the live version, rewrites only the buckets that
hold such rows into new folders, and then publishes one manifest for all tables. Readers of
the version before keep their files, a commit that dies leaves that version the live one,
and of two commits from the same version the second fails.
"""

from __future__ import annotations

import json
import uuid
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StructType

from graphloom.plans.scratch import discard, written

BUCKETS = 16


class Conflict(RuntimeError):
    """Another commit was published since the version at hand was read."""


class Manifests:
    """Numbered JSON files in a folder; the last one counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.folder = self._path(f"{self.path}/_manifests")
        self.fs = self.folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, text: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(text)

    def last(self) -> tuple[int, dict]:
        """Number and content of the live version; 0 and {} before the first."""
        if not self.fs.exists(self.folder):
            return 0, {}
        names = [s.getPath().getName() for s in self.fs.listStatus(self.folder)]
        version = max((int(n[:-5]) for n in names if n.endswith(".json")), default=0)
        return version, self.read(version) if version else {}

    def _file(self, version: int):
        return self._path(f"{self.path}/_manifests/{version:012d}.json")

    def read(self, version: int) -> dict:
        stream = self.fs.open(self._file(version))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def publish(self, version: int, content: dict) -> None:
        """Makes content the version, in one step: the file is complete before it gets its name."""
        jvm, draft = self.spark._jvm, self._path(f"{self.path}/_manifests/.{uuid.uuid4().hex}")
        stream = self.fs.create(draft)
        stream.write(bytearray(json.dumps(content, sort_keys=True).encode()))
        stream.close()
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.folder.toUri(), self.spark._jsc.hadoopConfiguration())
        how = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(self.fs.makeQualified(draft), self.fs.makeQualified(self._file(version)), how)
        except Exception as error:
            self.fs.delete(draft, False)
            if "FileAlreadyExists" in str(error):
                raise Conflict(f"version {version} of {self.path} is there already") from error
            raise

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(f"{self.path}/{name}"), True)

    def folders(self, name: str) -> list[str]:
        top = self._path(f"{self.path}/{name}")
        return [s.getPath().getName() for s in self.fs.listStatus(top)] if self.fs.exists(top) else []


def row_hash(df: DataFrame, but: list[str]) -> Column:
    """A hash of all columns but some. Maps count by their sorted entries; a null isn't
    mistaken for its absence."""
    out = []
    for f in df.schema.fields:
        if f.name not in but:
            c = F.col(f.name)
            out += [c.isNull(), F.array_sort(F.map_entries(c)) if isinstance(f.dataType, MapType) else c]
    return F.xxhash64(*out)


class Store:
    """Tables of one folder. tables: name -> (schema, key, column that parts are named by or
    None, columns whose hash gives the bucket)."""

    def __init__(self, spark: SparkSession, path: str, tables: dict, buckets: int = BUCKETS):
        self.spark, self.tables = spark, tables
        self.manifests = Manifests(spark, path)
        self.path = self.manifests.path
        self.version, self.live = self.manifests.last()
        self.buckets = self.live.get("buckets", buckets)

    def _part(self, name: str) -> Column:
        """The part of a row: its project (escaped as in a folder's name) and its bucket."""
        _, _, by, spread = self.tables[name]
        bucket = F.pmod(F.xxhash64(*spread), F.lit(self.buckets)).cast("string")
        return F.concat(F.coalesce(F.url_encode(F.col(by)), F.lit("")), F.lit("/"), bucket) if by else F.concat(F.lit("/"), bucket)

    def _read(self, name: str, parts: dict[str, str]) -> DataFrame:
        schema = self.tables[name][0]
        if not parts:
            return self.spark.createDataFrame([], schema)
        folders = [f"{self.path}/{name}/{at}" for at in sorted(set(parts.values()))]
        return self.spark.read.schema(schema).parquet(*folders).select(*StructType.fromDDL(schema).names)

    def read(self, name: str, only: str | None = None) -> DataFrame:
        """The live rows of a table; only: those of one project, whose files alone are read."""
        parts = self.live.get("tables", {}).get(name, {})
        if only is not None:
            first = quote(only, safe="*-._").replace("%20", "+").replace("~", "%7E") + "/"
            parts = {k: v for k, v in parts.items() if k.startswith(first)}
        return self._read(name, parts)

    def delta(self, name: str, new: DataFrame, only: str | None = None) -> DataFrame:
        """Rows of new that the live version lacks or has differently (state insert, update),
        and the keys of those it has too many (delete), with their parts."""
        schema, key, by, _ = self.tables[name]
        names = StructType.fromDDL(schema).names
        old = self.read(name, only)
        a = old.select(*[F.col(k).alias(f"k_{k}") for k in key], row_hash(old, key).alias("h0"), F.lit(True).alias("was"))
        rows = new.select(*names)
        b = rows.withColumn("h1", row_hash(rows, key)).withColumn("is", F.lit(True))
        on = F.lit(True)
        for k in key:
            on &= F.col(f"k_{k}").eqNullSafe(F.col(k))
        state = F.when(F.col("was").isNull(), "insert").when(F.col("is").isNull(), "delete").otherwise("update")
        both = a.join(b, on, "full").where(~(F.col("h0").eqNullSafe(F.col("h1")) & F.col("was").eqNullSafe(F.col("is"))))
        both = both.select(state.alias("state"), *[F.when(F.col("is").isNull(), F.col(f"k_{k}")).otherwise(F.col(k)).alias(k) if k in key else F.col(k) for k in names])
        return both.withColumn("part", self._part(name))

    def commit(self, new: dict[str, DataFrame], only: str | None = None) -> dict[str, dict[str, int]]:
        """Makes the rows of each table (name -> all its rows) the live ones and returns how many
        were inserted, updated and deleted. Keys must not repeat. only: the rows, and
        what they replace, are those of one project."""
        live = {name: dict(parts) for name, parts in self.live.get("tables", {}).items()}
        stats = {}
        for name, df in new.items():
            seen = Observation()
            counts = [F.count_if(F.col("state") == s).alias(s) for s in ("insert", "update", "delete")]
            delta = written(self.delta(name, df, only).observe(seen, *counts), "delta")
            stats[name] = {k: int(v) for k, v in seen.get.items()}
            # a row a bucket
            touched = sorted(r[0] for r in delta.select("part").distinct().collect())
            if touched:
                at = self._rewritten(name, delta, live.setdefault(name, {}), touched)
                for part in touched:
                    live[name].pop(part, None)
                live[name].update(at)
            discard(delta)
        if any(n for s in stats.values() for n in s.values()) or not self.version:
            content = {"buckets": self.buckets, "tables": live, "stats": stats}
            self.manifests.publish(self.version + 1, content)
            self.version, self.live = self.version + 1, content
        return stats

    def _rewritten(self, name: str, delta: DataFrame, live: dict[str, str], touched: list[str]) -> dict[str, str]:
        """New folders of the touched parts: their live rows that delta doesn't name, and its own."""
        _, key, _, _ = self.tables[name]
        old = self._read(name, {p: live[p] for p in touched if p in live})
        gone = delta.where("state <> 'insert'").select(*[F.col(k).alias(f"k_{k}") for k in key])
        on = F.lit(True)
        for k in key:
            on &= F.col(k).eqNullSafe(F.col(f"k_{k}"))
        left = old.join(gone, on, "left_anti").withColumn("part", self._part(name))
        rows = left.unionByName(delta.where("state <> 'delete'").drop("state"))
        folder = uuid.uuid4().hex
        # folders by number: names of projects may hold anything
        place = F.element_at(F.map_from_arrays(F.lit(touched), F.lit(list(range(len(touched))))), F.col("part"))
        rows.withColumn("part", place).repartition("part").write.option("compression", "zstd").partitionBy("part").parquet(f"{self.path}/{name}/{folder}")
        there = {int(f.split("=")[1]) for f in self.manifests.folders(f"{name}/{folder}") if f.startswith("part=")}
        return {p: f"{folder}/part={i}" for i, p in enumerate(touched) if i in there}

    def vacuum(self, keep: int = 2) -> int:
        """Deletes files that none of the last versions names; returns how many folders went.
        Not while another commit runs: its files have no name yet."""
        used: dict[str, set[str]] = {}
        for v in range(max(1, self.version - keep + 1), self.version + 1):
            for name, parts in self.manifests.read(v).get("tables", {}).items():
                used.setdefault(name, set()).update(parts.values())
        n = 0
        for name in self.tables:
            for folder in self.manifests.folders(name):
                held = {u.split("/")[1] for u in used.get(name, ()) if u.startswith(f"{folder}/")}
                for sub in self.manifests.folders(f"{name}/{folder}") if held else [None]:
                    if sub is None or sub.startswith("part=") and sub not in held:
                        self.manifests.delete(f"{name}/{folder}" + (f"/{sub}" if sub else ""))
                        n += 1
        for v in range(1, max(1, self.version - keep + 1)):
            self.manifests.delete(f"_manifests/{v:012d}.json")
        return n
