"""Idempotent upsert of one extractor document (project, stack) into the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.traverse import missing_ends
from graphloom.plans.ontology import KNOWN_EDGES

KEY = ["project", "id"]
ENRICHED = ("summary", "tags", "community")


def dangling(edges: DataFrame, nodes: DataFrame, known: tuple[str, ...] = KNOWN_EDGES) -> tuple[DataFrame, DataFrame]:
    """Edges to keep and edges to drop: of unknown type or with an end that isn't among nodes."""
    none, both, cols = missing_ends(edges, nodes), edges, edges.columns
    for end in ("src", "dst"):
        both = both.join(none.select(F.col("id").alias(end), F.lit(True).alias(f"{end}_lost")), end, "left")
    good = F.col("type").isin(*known) & F.col("src").isNotNull() & F.col("dst").isNotNull() & F.col("src_lost").isNull() & F.col("dst_lost").isNull()
    return both.where(good).select(cols), both.where(~good).select(cols)


def first_wins(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row of each key: the first by order."""
    others = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*others), order).alias("r")).select(*key, "r.*")


def upsert_nodes(existing: DataFrame, new: DataFrame, strict: bool = False) -> DataFrame:
    """Existing nodes with new ones merged in by (project, id).

    New values win where they aren't null; properties of the new map are laid over the
    old one (strict: replace it); labels are added; a changed hash clears summary, tags
    and community."""
    old = existing.select(*[F.col(c).alias(c if c in KEY else f"o_{c}") for c in existing.columns])
    both = old.join(new.withColumn("is_new", F.lit(True)), KEY, "full")
    changed = F.col("is_new") & ~F.col("hash").eqNullSafe(F.col("o_hash"))
    out = []
    for c in existing.columns:
        a, b = F.col(f"o_{c}"), F.col(c)
        if c in KEY:
            out.append(b)
        elif c in ENRICHED:
            out.append(F.when(changed, b).otherwise(F.coalesce(b, a)).alias(c))
        elif c == "labels":
            out.append(F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.array_union(a, b)).alias(c))
        elif c in ("props", "arr_props"):
            laid = F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)
            out.append((F.when(F.col("is_new"), b).otherwise(a) if strict else F.when(a.isNull(), b).when(b.isNull(), a).otherwise(laid)).alias(c))
        else:
            out.append(F.coalesce(b, a).alias(c))
    return both.select(*out)


def stale(existing: DataFrame, new: DataFrame, project: str, stack: str) -> DataFrame:
    """Nodes of (project, stack) that the new document no longer has."""
    return existing.where((F.col("project") == project) & (F.col("stack") == stack)).join(new.select(*KEY), KEY, "left_anti")


def without_edges_of(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that touch none of nodes, in either direction."""
    for end in ("src", "dst"):
        edges = edges.join(nodes.select("project", F.col("id").alias(end)), ["project", end], "left_anti")
    return edges


def hash_states(existing: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """key, state: insert, stale, changed or unchanged, by content hash."""
    both = existing.select(key, F.col("hash").alias("h0")).join(new.select(key, F.col("hash").alias("h1")), key, "full")
    state = F.when(F.col("h0").isNull(), "insert").when(F.col("h1").isNull(), "stale").when(F.col("h0") == F.col("h1"), "unchanged").otherwise("changed")
    return both.select(key, state.alias("state"))


def ingest(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame, project: str, stack: str, strict: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The new snapshot (nodes, edges) after a document, and one row of stats (nodes,
    edges, droppedEdges, staleRemoved). All edges of the stack's nodes give way to the
    document's; derived ones are to be derived again."""
    keep, drop = dangling(new_edges, new_nodes)
    keep = keep.dropDuplicates(["project", "src", "type", "dst"])
    gone = stale(nodes, new_nodes, project, stack)
    merged = upsert_nodes(nodes.join(gone.select(*KEY), KEY, "left_anti"), new_nodes, strict)
    own = nodes.where((F.col("project") == project) & (F.col("stack") == stack)).select(*KEY)
    left = without_edges_of(edges, own)
    n = lambda df, name: df.agg(F.count("*").alias(name))
    stats = n(new_nodes, "nodes").crossJoin(n(keep, "edges")).crossJoin(n(drop, "droppedEdges")).crossJoin(n(gone, "staleRemoved"))
    return merged, left.unionByName(keep), stats


def delete_project(nodes: DataFrame, edges: DataFrame, project: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes and edges without a project, and a row with the number of nodes deleted."""
    return nodes.where(F.col("project") != project), edges.where(F.col("project") != project), nodes.where(F.col("project") == project).agg(F.count("*").alias("deleted"))


def upsert_project(projects: DataFrame, name: str, java_root: str | None = None, angular_root: str | None = None) -> DataFrame:
    """The catalogue with a project's row renewed; roots not given stay."""
    spark = projects.sparkSession
    row = spark.createDataFrame([(name, java_root, angular_root)], "name string, j string, a string")
    old = projects.where(F.col("name") == name)
    new = row.join(old, "name", "left").select("name", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("lastIngestedAt"), F.coalesce("j", "javaRoot").alias("javaRoot"), F.coalesce("a", "angularRoot").alias("angularRoot"))
    return projects.where(F.col("name") != name).unionByName(new)
