"""Continuous ingestion: extractor documents that arrive in a folder are upserted in turn."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.operators import upsert
from graphloom.plans.scratch import written
from graphloom.sources import documents


def document_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(documents.DOCUMENT).option("multiLine", True).json(folder)


def follow(spark: SparkSession, folder: str, graph: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Upserts documents from folder into the graph saved at graph (which may be empty).

    A batch's projects and stacks are taken one after another, and each becomes a version of
    the saved graph, nodes and edges in one step; upserts are idempotent, so that a batch
    may be run again."""

    def step(batch: DataFrame, _: int) -> None:
        batch = written(batch, "batch")
        for r in batch.select("project", "stack").distinct().orderBy("project", "stack").collect():
            one = batch.where((F.col("project") == r["project"]) & (F.col("stack") == r["stack"]))
            n, e = documents.document_nodes(one), documents.document_edges(one, last_wins=r["stack"] == "angular")
            old_n, old_e = documents.load_graph(spark, graph, r["project"])
            nodes, edges, _stats = upsert.ingest(old_n.select(n.columns), old_e.select(e.columns), n, e, r["project"], r["stack"])
            documents.save_graph(nodes, edges, graph, only=r["project"])

    start = document_stream(spark, folder).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (start.trigger(availableNow=True) if available_now else start).start()
