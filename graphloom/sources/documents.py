"""The extractors' exchange documents and the graph's own tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.plans.ontology import EDGES, LABELS, NODES, STACKS
from graphloom.sources.store import BUCKETS, Store

_NODE = "struct<id:string,label:string,fqn:string,name:string,filePath:string,startLine:int,endLine:int,hash:string,props:map<string,string>>"
_EDGE = "struct<source:string,target:string,type:string,props:map<string,string>>"
DOCUMENT = f"schemaVersion string, stack string, project string, root string, extractedAt string, nodes array<{_NODE}>, edges array<{_EDGE}>, warnings array<string>"
CORE = ("id", "label", "fqn", "name", "filePath", "startLine", "endLine", "hash", "project", "stack", "embedding")


def read_documents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row for each JSON document."""
    return spark.read.schema(DOCUMENT).json(paths, multiLine=True)


def document_nodes(documents: DataFrame) -> DataFrame:
    """Nodes of documents in the graph's schema; the first of an id wins. Properties that
    are objects are dropped, arrays of primitives go to arr_props, nulls vanish, and core
    columns aren't properties. An unknown label is kept, with Class as graph label."""
    n = documents.where(F.col("stack").isin(*STACKS)).select("project", "stack", F.posexplode("nodes").alias("ord", "n")).select("project", "stack", "ord", "n.*").where("id is not null")
    props = F.map_filter(F.coalesce("props", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), lambda k, v: ~k.isin(*CORE) & v.isNotNull())
    arrays = F.map_filter(props, lambda k, v: v.startswith("[") & ~v.startswith("[{"))
    plain = F.map_filter(props, lambda k, v: ~v.startswith("[") & ~v.startswith("{"))
    label = F.coalesce("label", F.lit("Class"))
    out = n.select(
        "project", "id", "fqn", "name", label.alias("label"), F.array(F.when(label.isin(*LABELS), label).otherwise("Class")).alias("labels"), "stack", "filePath", "startLine", "endLine", "hash",
        plain.alias("props"), F.transform_values(arrays, lambda k, v: F.from_json(v, "array<string>")).alias("arr_props"),
        F.lit(None).cast("string").alias("summary"), F.lit(None).cast("array<string>").alias("tags"), F.lit(None).cast("int").alias("community"), "ord",
    )
    others = [c for c in out.columns if c not in ("project", "id", "ord")]
    return out.groupBy("project", "id").agg(F.min_by(F.struct(*others), "ord").alias("r")).select("project", "id", "r.*")


def document_edges(documents: DataFrame, last_wins: bool = False) -> DataFrame:
    """Edges of documents, one for each (source, type, target): the first, or the last."""
    e = documents.select("project", F.posexplode("edges").alias("ord", "e")).select("project", F.col("e.source").alias("src"), F.col("e.type").alias("type"), F.col("e.target").alias("dst"), F.col("e.props").alias("props"), "ord")
    pick = F.max_by if last_wins else F.min_by
    return e.groupBy("project", "src", "type", "dst").agg(pick(F.struct("props"), "ord").alias("r")).select("project", "src", "type", "dst", "r.props")


PROJECTS = "name string, lastIngestedAt string, javaRoot string, angularRoot string"
TABLES = {
    "nodes": (NODES, ["project", "id"], "project", ["id"]),
    "edges": (EDGES, ["project", "src", "type", "dst"], "project", ["src"]),
    "projects": (PROJECTS, ["name"], None, ["name"]),
}


def exchange_documents(nodes: DataFrame, edges: DataFrame, size: int = 2_000) -> DataFrame:
    """The graph as exchange documents of some `size` nodes: rows in the documents' schema, in
    order of project, stack and part, each with its nodes by id and its edges by ends.

    A node is in the part that the hash of its id gives, an edge in that of its source; so
    no document grows with the graph, and the same graph gives the same texts. Read back
    together they give the graph: labels, hashes, lists and maps as they were. Edges
    whose source isn't a node are left out, and so is what enrichment adds."""
    nodes = nodes.withColumn("stack", F.coalesce("stack", F.lit("")))  # no stack is one of its own
    count = nodes.groupBy("project", "stack").agg(F.ceil(F.count("*") / size).alias("parts"))
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    n = nodes.join(count, ["project", "stack"]).withColumn("part", part)
    both = F.map_concat(F.coalesce("props", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), F.coalesce(F.transform_values("arr_props", lambda k, v: F.to_json(v)), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))))
    tidy = lambda m: F.map_from_entries(F.array_sort(F.map_entries(m)))
    node = F.struct("id", "label", "fqn", "name", "filePath", "startLine", "endLine", "hash", tidy(both).alias("props"))
    docs = n.groupBy("project", "stack", "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", F.to_json(node).alias("json")))), lambda x: F.from_json(x["json"], _NODE)).alias("nodes"))
    e = edges.join(n.select("project", F.col("id").alias("src"), "stack", "part"), ["project", "src"])
    edge = F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), "type", F.to_json(F.struct(tidy(F.col("props")).alias("p"))).alias("json"))
    links = e.groupBy("project", "stack", "part").agg(F.array_sort(F.collect_list(edge)).alias("e"))
    links = links.select("project", "stack", "part", F.transform("e", lambda x: F.struct(x["source"].alias("source"), x["target"].alias("target"), x["type"].alias("type"), F.from_json(x["json"], "p map<string,string>")["p"].alias("props"))).alias("edges"))
    empty = F.array().cast(f"array<{_EDGE}>")
    out = docs.join(links, ["project", "stack", "part"], "left").orderBy("project", "stack", "part")
    text = lambda v: F.lit(v).cast("string")
    return out.select(text("1").alias("schemaVersion"), F.nullif("stack", F.lit("")).alias("stack"), "project", text("").alias("root"), text("").alias("extractedAt"), "nodes", F.coalesce("edges", empty).alias("edges"), F.array().cast("array<string>").alias("warnings"))


def save_documents(docs: DataFrame, path: str) -> None:
    """Exchange documents as JSON files below path, one document a file."""
    docs.write.mode("overwrite").option("maxRecordsPerFile", 1).json(path)


def graph_store(spark: SparkSession, path: str, buckets: int = BUCKETS) -> Store:
    """The saved graph at path; buckets: parts of a project, settled by the first commit."""
    return Store(spark, path, TABLES, buckets)


def save_graph(nodes: DataFrame, edges: DataFrame, path: str, projects: DataFrame | None = None, only: str | None = None) -> dict[str, dict[str, int]]:
    """Makes nodes, edges and projects (if given) the live version at path in one step: only
    buckets with rows that differ are written, and the plans may read what is saved there.
    only: the rows are those of one project, others stay. Returns what was inserted,
    updated and deleted in each table."""
    new = {"nodes": nodes, "edges": edges.dropDuplicates(TABLES["edges"][1])} | ({} if projects is None else {"projects": projects})
    return graph_store(nodes.sparkSession, path).commit(new, only)


def load_graph(spark: SparkSession, path: str, project: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The live nodes and edges at path (none before the first save), of one project or of all."""
    store = graph_store(spark, path)
    return store.read("nodes", project), store.read("edges", project)


def source_slice(files: DataFrame, spans: DataFrame, context: int = 0, most: int = 20_000, numbered: bool = False) -> DataFrame:
    """(id, source) of spans (id, filePath, startLine, endLine) in files (filePath, text):
    the lines with context around them, cut at most characters; numbered: with `N: ` before
    each line."""
    context = min(50, max(0, context))
    j = spans.join(files.select("filePath", "text"), "filePath").withColumn("l", F.split("text", "\n"))
    lo = F.greatest(F.lit(1), F.col("startLine") - context)
    hi = F.least(F.size("l"), F.col("endLine") + context)
    part = F.slice("l", lo, F.greatest(F.lit(0), hi - lo + 1))
    if numbered:
        part = F.transform(part, lambda x, i: F.concat((i + lo).cast("string"), F.lit(": "), x))
    return j.select("id", F.substring(F.array_join(part, "\n"), 1, most).alias("source"))
