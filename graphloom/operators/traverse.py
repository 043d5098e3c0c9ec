"""Bounded traversal: everything a path query returns here is a function of distance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.ontology import ENTRY_LABELS, IMPACT_TYPES, STRUCTURAL_LABELS
from graphloom.plans.scratch import written


def steps(edges: DataFrame, direction: str, types: tuple[str, ...] | None = None) -> DataFrame:
    """(a, b): a walk goes from a to b. upstream goes against edges, downstream along, both either way."""
    e = edges if types is None else edges.where(F.col("type").isin(*types))
    down = e.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    up = e.select(F.col("dst").alias("a"), F.col("src").alias("b"))
    return {"downstream": down, "upstream": up, "both": down.unionByName(up)}[direction]


def bfs(edges: DataFrame, seeds: DataFrame, direction: str, depth: int, types: tuple[str, ...] | None = None) -> DataFrame:
    """(id, distance) of everything within depth steps of seeds (id), seeds at 0.

    One frontier join a level; visited ids drop out by an anti join, so that a level costs
    what it discovers. Levels are written to the shared folder, which keeps the plan flat.
    """
    walk = steps(edges, direction, types)
    seen = seeds.select("id").distinct().withColumn("distance", F.lit(0))
    frontier = seen
    for k in range(1, depth + 1):
        new = frontier.join(walk, frontier["id"] == walk["a"]).select(F.col("b").alias("id")).distinct()
        new = written(new.join(seen, "id", "left_anti"), "frontier").withColumn("distance", F.lit(k))
        if new.isEmpty():
            break
        seen, frontier = seen.unionByName(new), new
    return seen


def ball_edges(edges: DataFrame, reached: DataFrame, direction: str, depth: int, types: tuple[str, ...] | None = None) -> DataFrame:
    """The edges on paths of at most depth steps: those that leave a node nearer than depth."""
    e = edges if types is None else edges.where(F.col("type").isin(*types))
    inner = reached.where(F.col("distance") <= depth - 1).select(F.col("id").alias("near"))
    ends = {"downstream": ["src"], "upstream": ["dst"], "both": ["src", "dst"]}[direction]
    parts = [e.join(inner, F.col(c) == F.col("near"), "left_semi") for c in ends]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]).dropDuplicates(["src", "type", "dst"])


def impact(nodes: DataFrame, edges: DataFrame, id_: str, direction: str = "upstream", depth: int = 3, types: tuple[str, ...] | None = IMPACT_TYPES, compat: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes with their distance from a node (which is at 0), and the edges walked.

    depth is clamped to 1..6. compat: a start without any neighbour gives nothing."""
    depth = min(6, max(1, depth))
    reached = bfs(edges, nodes.where(F.col("id") == id_).select("id"), direction, depth, types)
    if compat and reached.where("distance > 0").isEmpty():
        reached = reached.limit(0)
    return nodes.join(reached, "id"), ball_edges(edges, reached, direction, depth, types)


def resolve_seeds(nodes: DataFrame, ids: list[str], found: DataFrame | None = None) -> DataFrame:
    """(id, ord) of the ids that exist and of a query's result: its column id and the fields id
    of its struct columns. ord tells their order: ids as given, then rows as they come,
    columns from left to right; of an id's places the first counts."""
    given = nodes.sparkSession.createDataFrame(list(enumerate(ids)), "ord long, id string")
    if found is not None:
        named = [(F.col(f"`{f.name}`"), f) for f in found.schema.fields]
        of = [c["id"] if f.dataType.typeName() == "struct" else c for c, f in named if f.name == "id" or f.dataType.typeName() == "struct" and "id" in f.dataType.names]
        if of:
            rows = found.select(F.monotonically_increasing_id().alias("row"), F.posexplode(F.array(*[c.cast("string") for c in of])).alias("pos", "id"))
            given = given.unionByName(rows.select((F.lit(len(ids)) + F.col("row") * len(of) + F.col("pos")).alias("ord"), "id"))
    first = given.where("id is not null and id <> ''").groupBy("id").agg(F.min("ord").alias("ord"))
    return first.join(nodes.select("id"), "id", "left_semi")


def blast_radius(
    nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = 4, types: tuple[str, ...] | None = IMPACT_TYPES,
    members: str = "DECLARES", structural: tuple[str, ...] = STRUCTURAL_LABELS, entries: tuple[str, ...] = ENTRY_LABELS,
) -> DataFrame:
    """Nodes affected by seeds (id) and by the methods these declare: distance, isSeed,
    isMember, isEntryPoint. Seeds, members and structural nodes are not affected ones."""
    seeds = seeds.select("id").distinct()
    owned = edges.where(F.col("type") == members).join(seeds, edges["src"] == seeds["id"], "left_semi").select(F.col("dst").alias("id"))
    owned = owned.join(nodes.where(F.col("label") == "Method").select("id"), "id", "left_semi").distinct()
    start = seeds.withColumn("isSeed", F.lit(True)).join(owned.withColumn("isMember", F.lit(True)), "id", "full")
    reached = bfs(edges, start, "upstream", min(6, max(1, depth)), types)
    out = nodes.join(reached, "id").join(start, "id", "left")
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return out.select(*nodes.columns, "distance", flag("isSeed"), flag("isMember"), F.col("label").isin(*entries).alias("isEntryPoint")).where(~F.col("isSeed") & ~F.col("isMember") & ~F.col("label").isin(*structural))


def by_distance(reached: DataFrame) -> DataFrame:
    """distance, n and label counts (map) of nodes with a distance, nearest first."""
    n = reached.where("distance > 0").groupBy("distance", "label").agg(F.count("*").alias("n"))
    entries = F.array_sort(F.collect_list(F.struct("label", "n")))
    return n.groupBy("distance").agg(F.sum("n").alias("n"), F.map_from_entries(entries).alias("by_label")).orderBy("distance")


def affected_by_label(affected: DataFrame) -> DataFrame:
    return affected.groupBy("label").agg(F.count("*").alias("n"))


def entry_points(affected: DataFrame) -> DataFrame:
    """Affected entry points by distance, label, name."""
    return affected.where("isEntryPoint").orderBy("distance", F.coalesce("label", F.lit("")), F.coalesce("name", F.lit("")), "id")


def neighbourhood(nodes: DataFrame, edges: DataFrame, id_: str, depth: int = 1, types: tuple[str, ...] | None = IMPACT_TYPES, labels: tuple[str, ...] | None = None, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The undirected ball around a node: nodes with distance, filtered by label after the
    walk (the start stays), at most limit by (distance, id); and the edges among them."""
    depth = min(4, max(1, depth))
    reached = bfs(edges, nodes.where(F.col("id") == id_).select("id"), "both", depth, types)
    ball = nodes.join(reached, "id")
    if labels is not None:
        ball = ball.where(F.col("label").isin(*labels) | (F.col("distance") == 0))
    if limit is not None:
        ball = ball.orderBy("distance", "id").limit(limit)
    walked = ball_edges(edges, reached, "both", depth, types)
    return ball, induced(walked, ball)


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges with both ends among nodes."""
    ids = nodes.select(F.col("id").alias("end"))
    return edges.join(ids, edges["src"] == ids["end"], "left_semi").join(ids, edges["dst"] == ids["end"], "left_semi")


def missing_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id) of the ends of edges that aren't among nodes, written: where few are, what joins them
    moves no edge."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).where("id is not null").distinct()
    return written(ends.join(nodes.select("id"), "id", "left_anti"), "missing")
