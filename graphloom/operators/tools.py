"""What an agent may ask of a graph: each answer is rows of one JSON text, bounded in size.

Objects leave out what is null. The caller picks the project; ids are looked up in it alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.views import node_detail
from graphloom.sources.documents import source_slice

# What a tool shows of a node, and how much of an answer.
SHOWN = ("id", "label", "name", "fqn", "stack", "filePath", "summary")
MOST_HITS = 25
MOST_NEIGHBOURS = 60
MOST_SOURCE = 7_000


def shown(nodes: DataFrame) -> Column:
    """A node as JSON with those of SHOWN that it has."""
    return F.to_json(F.struct(*[c for c in SHOWN if c in nodes.columns]))


def hits(nodes: DataFrame) -> DataFrame:
    """(id, json) of nodes."""
    return nodes.select("id", shown(nodes).alias("json"))


def node(nodes: DataFrame, edges: DataFrame, id_: str) -> DataFrame:
    """One row (json): the node and at most 60 neighbours, by direction, type and id; an error
    where there is no such node."""
    near = node_detail(nodes, edges, id_).orderBy(F.desc("direction"), "type", "other").limit(MOST_NEIGHBOURS)
    row = F.struct("direction", "type", "other", "label", "name")
    near = near.agg(F.array_sort(F.collect_list(row)).alias("n"))
    as_said = F.transform("n", lambda x: F.struct(x["type"].alias("rel"), x["direction"].alias("dir"), x["other"].alias("id"), x["label"].alias("label"), x["name"].alias("name")))
    of = nodes.where(F.col("id") == id_).limit(1).select(F.struct(*[c for c in SHOWN if c in nodes.columns]).alias("node"))
    found = near.join(of, how="left")  # one row and at most one
    missing = F.to_json(F.struct(F.lit("no such node").alias("error")))
    return found.select(F.when(F.col("node").isNull(), missing).otherwise(F.to_json(F.struct("node", as_said.alias("neighbors")))).alias("json"))


def source(nodes: DataFrame, files: DataFrame, id_: str) -> DataFrame:
    """(json): a node's numbered lines, 7,000 characters at most. files: filePath, text. A node
    without a start begins at line 1, one without an end ends with its file."""
    lines = files.select("filePath", F.size(F.split("text", "\n")).alias("lines"))
    at = nodes.where(F.col("id") == id_).join(lines, "filePath")
    first = F.greatest(F.lit(1), F.coalesce(F.nullif("startLine", F.lit(0)), F.lit(1)))
    last = F.least(F.col("lines"), F.greatest(F.coalesce(F.nullif("endLine", F.lit(0)), F.col("lines")), first))
    spans = at.select("id", "filePath", first.alias("startLine"), last.alias("endLine"))
    text = source_slice(files, spans, most=MOST_SOURCE, numbered=True)
    return spans.join(text, "id").select(F.to_json(F.struct("filePath", "startLine", "endLine", "source")).alias("json"))


def result(rows: DataFrame) -> DataFrame:
    """(json) of a query's rows, nulls too."""
    return rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"ignoreNullFields": "false"}).alias("json"))
