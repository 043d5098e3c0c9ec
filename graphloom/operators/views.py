"""Overview counts and sub-graph views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from graphloom.operators.order import grown, numbered, recoded
from graphloom.operators.traverse import induced, missing_ends
from graphloom.plans.ontology import ARCHITECTURE_LABELS, VIEWS
from graphloom.plans.scratch import written


def counts_by_label(nodes: DataFrame) -> DataFrame:
    """Node counts by label and by stack in one pass: axis, value, n."""
    g = nodes.groupingSets([[F.col("label")], [F.col("stack")]], "label", "stack").agg(F.count("*").alias("n"), F.grouping("label").alias("by_stack"))
    return g.select(F.when(F.col("by_stack") == 1, "stack").otherwise("label").alias("axis"), F.when(F.col("by_stack") == 1, F.col("stack")).otherwise(F.col("label")).alias("value"), "n")


def edges_by_type(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """type, n of the edges with both ends present: those that lack one are the exception."""
    none, whole = missing_ends(edges, nodes), edges.where("src is not null and dst is not null")
    for end in ("src", "dst"):
        whole = whole.join(none.select(F.col("id").alias(end)), end, "left_anti")
    return whole.groupBy("type").agg(F.count("*").alias("n"))


def list_projects(projects: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Projects by name with a map of node counts by label and one of edge counts by type."""
    fold = lambda df, key: df.groupBy("project", key).count().groupBy("project").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "count")))).alias(f"by_{key}"))
    return projects.join(fold(nodes, "label"), projects["name"] == F.col("project"), "left").drop("project").join(fold(edges, "type"), projects["name"] == F.col("project"), "left").drop("project").orderBy("name")


def project_totals(projects: DataFrame) -> DataFrame:
    """name, edges, labels of list_projects(): the number of all edges, and array<struct<n,label>>
    with most nodes first, ties by label. Projects without any have 0 and none."""
    total = F.coalesce(F.aggregate(F.map_values("by_type"), F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0))
    pairs = F.transform(F.map_entries("by_label"), lambda e: F.struct((-e["value"]).alias("o"), e["key"].alias("label")))
    labels = F.transform(F.array_sort(pairs), lambda x: F.struct((-x["o"]).alias("n"), x["label"].alias("label")))
    return projects.select("name", total.cast("long").alias("edges"), F.coalesce(labels, F.array().cast("array<struct<n:bigint,label:string>>")).alias("labels"))


def link_coverage(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """calls and linked calls: one row."""
    calls = nodes.where("label = 'ApiCall'").select("id")
    links = edges.where("type = 'INVOKES_API'").select(F.col("src").alias("id"), F.lit(1).alias("one"))
    return calls.join(links, "id", "left").agg(F.count("*").alias("calls"), F.count("one").alias("linked"))


def capped(nodes: DataFrame, limit: int | None) -> DataFrame:
    return nodes if limit is None else nodes.orderBy("id").limit(limit)


def view_subgraph(nodes: DataFrame, edges: DataFrame, view: str, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """A preset's nodes and induced edges of its types; the process view drops endpoints
    without edges, the logical one adds collapsed calls; at most limit nodes, by id, and
    then the edges among these."""
    predicate, types = VIEWS[view]
    n = nodes.where(predicate())
    e = induced(edges if types is None else edges.where(F.col("type").isin(*types)), n)
    if view == "process":
        n = n.where("label <> 'Endpoint'").unionByName(connected_only(n.where("label = 'Endpoint'"), e))
    n = capped(n, limit)
    e = induced(e, n).select("src", "type", "dst", F.lit(False).alias("collapsed"))
    return n, e.unionByName(collapse_hops(n, edges, e)) if view == "logical" else e


def connected_only(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes at an end of an edge."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return nodes.join(ends, "id", "left_semi")


def architecture(nodes: DataFrame, edges: DataFrame, labels: tuple[str, ...] = ARCHITECTURE_LABELS, types: tuple[str, ...] | None = None, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes of some labels and the edges among them (collapsed false)."""
    n = capped(nodes.where(F.col("label").isin(*labels)), limit)
    return n, induced(edges if types is None else edges.where(F.col("type").isin(*types)), n).select("src", "type", "dst", F.lit(False).alias("collapsed"))


def collapse_hops(present: DataFrame, edges: DataFrame, existing: DataFrame, owns: str = "DECLARES", calls: str = "CALLS", makes: str = "MAKES_CALL") -> DataFrame:
    """Edges between present nodes through the methods that they own: owner to owner where
    a method calls another's, owner to call where a method makes it; distinct, not
    between a node and itself, and none that exists."""
    ids = lambda c: present.select(F.col("id").alias(c))
    # ends are checked before hops multiply
    own = edges.where(F.col("type") == owns).select(F.col("src").alias("owner"), F.col("dst").alias("method")).join(ids("owner"), "owner", "left_semi")
    call = edges.where(F.col("type") == calls).select(F.col("src").alias("method"), F.col("dst").alias("other"))
    make = edges.where(F.col("type") == makes).select(F.col("src").alias("method"), F.col("dst").alias("made")).join(ids("made"), "made", "left_semi")
    other = own.select(F.col("owner").alias("to"), F.col("method").alias("other"))
    hops = own.join(call, "method").join(other, "other").select(F.col("owner").alias("src"), F.lit(calls).alias("type"), F.col("to").alias("dst"))
    hops = hops.unionByName(own.join(make, "method").select(F.col("owner").alias("src"), F.lit(makes).alias("type"), F.col("made").alias("dst")))
    same = existing.where(F.col("type").isin(calls, makes)).select("src", "type", "dst")
    hops = hops.where("src <> dst").distinct().join(same, ["src", "type", "dst"], "left_anti")
    return hops.withColumn("collapsed", F.lit(True))


def node_detail(nodes: DataFrame, edges: DataFrame, id_: str) -> DataFrame:
    """The neighbours of a node: direction, type, other, label, name. A self-loop is outgoing, once."""
    out = edges.where(F.col("src") == id_).select(F.lit("out").alias("direction"), "type", F.col("dst").alias("other"))
    in_ = edges.where((F.col("dst") == id_) & (F.col("src") != id_)).select(F.lit("in").alias("direction"), "type", F.col("src").alias("other"))
    return out.unionByName(in_).join(nodes.select(F.col("id").alias("other"), "label", "name"), "other").select("direction", "type", "other", "label", "name")


def grouped_neighbours(detail: DataFrame, most: int = 1_000) -> DataFrame:
    """direction, type, n, others: neighbours by direction and type, how many there are, and the
    first of them, at most so many: they are cut before anything is gathered."""
    keys = ["direction", "type"]
    first = detail.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("other"))).where(F.col("k") <= most)
    lists = first.groupBy(*keys).agg(F.array_sort(F.collect_list("other")).alias("others"))
    return detail.groupBy(*keys).agg(F.count("*").alias("n")).join(lists, keys).select(*keys, "n", "others")


def by_path(nodes: DataFrame, path: str, ranks: tuple[str, ...]) -> DataFrame:
    """The node of a file path, exact or as a suffix: best label rank, then shortest path, then id."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in ranks]), F.col("label")), F.lit(0))
    hit = nodes.where((F.col("filePath") == path) | F.col("filePath").endswith(path)).withColumn("rank", F.when(rank == 0, len(ranks) + 1).otherwise(rank))
    return hit.orderBy("rank", F.length("filePath"), "id").limit(1)


def edge_payload(edges: DataFrame) -> DataFrame:
    """Edges as results show them, one for each id."""
    return edges.select(F.concat_ws("|", "src", "type", "dst").alias("id"), F.col("src").alias("source"), F.col("dst").alias("target"), "type").dropDuplicates(["id"])


def _laid(old: Column, new: Column) -> Column:
    """The entries of a map new, and those of old that it lacks."""
    both = F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)
    return F.when(old.isNull(), new).when(new.isNull(), old).otherwise(both)


def merged(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Two results in one: of rows with the same key the values of new that aren't null are laid
    over those of old, and maps key by key. Keys must not repeat."""
    a = old.select(*[F.col(c).alias(f"o_{c}") for c in old.columns])
    both = a.join(new, F.col(f"o_{key}").eqNullSafe(F.col(key)), "full")
    out = []
    for c in dict.fromkeys([*old.columns, *new.columns]):
        if c not in old.columns or c not in new.columns:
            out.append(F.col(f"o_{c}" if c in old.columns else c).alias(c))
        elif isinstance(old.schema[c].dataType, MapType) and isinstance(new.schema[c].dataType, MapType):
            out.append(_laid(F.col(f"o_{c}"), F.col(c)).alias(c))
        else:
            out.append(F.coalesce(c, f"o_{c}").alias(c))
    return both.select(*out)


def top_degree(nodes: DataFrame, edges: DataFrame, label: str, types: tuple[str, ...], k: int) -> DataFrame:
    """The k nodes of a label with most edges of some types, either way."""
    e = edges.where(F.col("type").isin(*types))
    ends = e.select(F.col("src").alias("id")).unionByName(e.where("src <> dst").select(F.col("dst").alias("id")))
    n = ends.groupBy("id").agg(F.count("*").alias("degree"))
    return nodes.where(F.col("label") == label).join(n, "id").orderBy(F.desc("degree"), "id").limit(k)


def layered_layout(nodes: DataFrame, edges: DataFrame, tier: str, sweeps: int = 4) -> DataFrame:
    """id, tier, position: barycenter sweeps over an undirected graph; ties by id. A tier is
    sorted by ranges, so that one may hold most nodes. Sweeps run on codes of the nodes: their
    places in the order of (tier, id), of which a tier's are consecutive."""
    ids = numbered(nodes.select("id", F.col(tier).alias("tier")), ["tier", "id"], "code")
    first = ids.groupBy(F.col("tier").alias("t")).agg(F.min("code").alias("first"))
    ids = written(ids.join(first, F.col("tier").eqNullSafe(F.col("t"))).select("id", "tier", "code", "first"), "places")
    walk = recoded(edges.where("src <> dst"), ids.select("id", "code"), "src", "dst")
    walk = written(walk.unionByName(walk.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), "walk")
    at = ids.select("code", "first", (F.col("code") - F.col("first")).alias("position"))
    for _ in range(sweeps):
        near = walk.join(grown(at.select(F.col("code").alias("dst"), F.col("position").cast("double").alias("p"))), "dst").groupBy(F.col("src").alias("code")).agg(F.avg("p").alias("center"))
        rows = at.join(grown(near), "code", "left").select("code", "first", F.coalesce("center", F.col("position")).alias("center"))
        at = numbered(written(rows, "centers"), ["first", "center", "code"]).select("code", "first", (F.col("number") - F.col("first")).alias("position"))
    return ids.join(grown(at.select("code", "position")), "code").select("id", "tier", F.col("position").cast("int").alias("position"))
