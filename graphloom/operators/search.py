"""Search over names: prefix terms that must all hit, and the substring fallback.

The index is a table of tokens. It can be saved: range-partitioned and sorted by token, so
that a prefix term reads the row groups of its token range alone, and no text. What has
changed since is added in segments of its own; entries of older states are told by the
hash of their document and drop out when a term is looked up.
"""

from __future__ import annotations

import json
import re
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graphloom.plans.scratch import written
from graphloom.sources.store import Manifests

FIELDS = ("name", "fqn", "filePath", "summary")
SEGMENTS = 8
"""Segments after which an update writes the index anew."""


def inverted_index(nodes: DataFrame, fields: tuple[str, ...] = FIELDS, more: tuple[str, ...] = ()) -> DataFrame:
    """(id, field, token, more columns) of lower-case runs of letters and digits."""
    cols = [F.struct(F.lit(f).alias("field"), F.array_distinct(F.split(F.lower(F.col(f).cast("string")), "[^a-z0-9]+")).alias("tokens")) for f in fields]
    rows = nodes.select("id", *more, F.explode(F.array(*cols)).alias("x")).select("id", "x.field", F.explode("x.tokens").alias("token"), *more)
    return rows.where("token <> ''")


def terms_of(query: str) -> list[str]:
    return sorted({t for w in query.split() for t in re.split("[^a-z0-9]+", w.lower()) if t})


def in_range(terms: list[str]) -> Column:
    """token begins with one of terms, as ranges that file statistics can be held against."""
    return reduce(Column.__or__, [(F.col("token") >= t) & (F.col("token") < t[:-1] + chr(ord(t[-1]) + 1)) for t in terms])


def search(nodes: DataFrame | None, query: str, limit: int = 25, fields: tuple[str, ...] = FIELDS, index: DataFrame | None = None) -> DataFrame:
    """id, score: nodes where every term of the query begins a token of some field; the
    score counts (term, field) hits. Best first, then by id. index: rows (id, field, token)
    in place of the nodes' texts."""
    terms = terms_of(query)
    index = inverted_index(nodes, fields) if index is None else index
    if not terms:
        return index.select("id", F.lit(0).cast("long").alias("score")).limit(0)
    hits = [F.when(F.col("token").startswith(t), F.lit(i)) for i, t in enumerate(terms)]
    # what no term begins goes before anything is gathered
    found = index.where(in_range(terms)).select("id", "field", F.explode(F.array_compact(F.array(*hits))).alias("term")).distinct()
    scored = found.groupBy("id").agg(F.count_distinct("term").alias("terms"), F.count("*").alias("score"))
    return scored.where(F.col("terms") == len(terms)).select("id", "score").orderBy(F.desc("score"), "id").limit(limit)


def search_fallback(nodes: DataFrame, query: str, limit: int = 25) -> DataFrame:
    """id, score 1.0: the query is part of the name or fqn, whatever the case."""
    q = query.lower()
    hit = F.lower("name").contains(q) | F.lower("fqn").contains(q)
    return nodes.where(hit).select("id", F.lit(1.0).alias("score")).orderBy("id").limit(limit)


class SavedIndex:
    """An index in a folder. Ids must not repeat among the nodes."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.manifests = Manifests(spark, path)
        self.path = self.manifests.path
        self.version, self.live = self.manifests.last()

    def update(self, nodes: DataFrame, fields: tuple[str, ...] = FIELDS) -> SavedIndex:
        """The index of nodes (id, fields): the first time, and after SEGMENTS updates, all of
        it; else a segment with the tokens of nodes whose fields have changed. One manifest
        swaps it in; readers of the version before keep their files."""
        texts = [F.col(f).cast("string") for f in fields]
        h = F.xxhash64(*[x for c in texts for x in (c.isNull(), c)])
        now = nodes.withColumn("h", h)
        segments = self.live.get("segments", [])
        whole = not segments or len(segments) >= SEGMENTS or self.live["fields"] != list(fields)
        if not whole:
            known = self._docs().select(F.col("id").alias("old_id"), F.col("h").alias("old_h"))
            changed = written(now.select("id", "h").join(known, F.col("id").eqNullSafe(F.col("old_id")), "full").where(~F.col("h").eqNullSafe(F.col("old_h")) | ~F.col("id").eqNullSafe(F.col("old_id"))), "changed")
            if changed.isEmpty():
                return self
            now_changed = now.join(changed.where("h is not null").select(F.col("id").alias("new_id")), F.col("id").eqNullSafe(F.col("new_id")), "left_semi")
        name, docs = f"tokens/{uuid.uuid4().hex}", f"docs/{uuid.uuid4().hex}"
        rows = inverted_index(now if whole else now_changed, fields, ("h",)).select("token", "id", "field", "h")
        rows.repartitionByRange("token").sortWithinPartitions("token", "id").write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        now.select("id", "h").write.option("compression", "zstd").parquet(f"{self.path}/{docs}")
        schema = {"tokens": rows.schema.json(), "docs": now.select("id", "h").schema.json()}
        self.manifests.publish(self.version + 1, {"fields": list(fields), "segments": [*([] if whole else segments), name], "docs": docs, "schema": schema})
        return SavedIndex(self.spark, self.path)

    def _docs(self) -> DataFrame:
        return self._schema("docs").parquet(f"{self.path}/{self.live['docs']}")

    def _schema(self, table: str) -> DataFrameReader:
        return self.spark.read.schema(StructType.fromJson(json.loads(self.live["schema"][table])))

    def rows(self, terms: list[str]) -> DataFrame:
        """(id, field, token) of the live entries that begin with one of terms."""
        found = self._schema("tokens").parquet(*[f"{self.path}/{s}" for s in self.live["segments"]]).where(in_range(terms))
        if len(self.live["segments"]) > 1:  # entries of states that have passed
            docs = self._docs().select(F.col("id").alias("doc"), F.col("h").alias("doc_h"))
            found = found.join(docs, F.col("id").eqNullSafe(F.col("doc")) & (F.col("h") == F.col("doc_h")), "left_semi")
        return found.select("id", "field", "token")

    def search(self, query: str, limit: int = 25) -> DataFrame:
        """id, score, as search() over the nodes that were indexed last."""
        if not self.version:
            raise ValueError(f"no index at {self.path}")
        terms = terms_of(query)
        return search(None, query, limit, index=self.rows(terms or ["0"]))
