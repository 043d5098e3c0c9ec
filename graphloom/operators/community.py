"""Connected components and modularity communities as DataFrame loops."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.replies import reply
from graphloom.operators.order import coded, grown, numbered, recoded
from graphloom.plans.ontology import COMMUNITY_LABELS, COMMUNITY_TYPES
from graphloom.plans.scratch import bucketed, discard, written


HUBS = 1_000
"""Nodes with more than a 1/HUBS part of all ends (fewer than HUBS, then) are joined by a broadcast."""
HUB_ENDS = 1_000
"""Fewest ends of such a node."""
LARGE = 1_000_000
"""Edges of a walk from which on it is kept in buckets."""


def _with_least(pairs: DataFrame, most: int) -> DataFrame:
    """pairs (u, v) with m, the least v of u. Rows of a hub, a node with more than `most`
    pairs, stay where they are and get m by a broadcast of the hubs."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    hubs = least.where(F.col("n") > most).select("u", F.col("m").alias("hub_m"))
    marked = pairs.join(F.broadcast(hubs), "u", "left")
    light = marked.where("hub_m is null").join(least.where(F.col("n") <= most), "u").select("u", "v", "m")
    return light.unionByName(marked.where("hub_m is not null").select("u", "v", F.col("hub_m").alias("m")))


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id reachable over edges (a, b), by alternating stars.

    Each round every node sends its neighbours to its least one, which halves long chains;
    a hub's neighbours are summed by id, never gathered. A round's table replaces the one
    before on disk."""
    ids, e = coded(edges.where("a is not null and b is not null"), "a", "b")
    e = written(e.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "star")
    state = lambda e: tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    now, before = state(e), None
    while now != before:
        most = max(HUB_ENDS, 2 * now[0] // HUBS)
        both = _with_least(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))), most)
        large = written(both.where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u <> v").distinct(), "large")
        small = _with_least(large, most).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        last, e = e, written(small, "star")
        discard(last)
        discard(large)
        now, before = state(e), now
    # the stars lead from every node but the least of a component to that one
    at = ids.join(e.groupBy(F.col("u").alias("code")).agg(F.min("v").alias("top")), "code", "left").select("id", "code", F.coalesce("top", "code").alias("top"))
    return at.join(at.where("code = top").select(F.col("id").alias("component"), "top"), "top").select("id", "component")


def largest_component(edges: DataFrame) -> DataFrame:
    """The ids of the largest component; of equal ones the one with the least id."""
    c = components(edges)
    top = c.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1)
    return c.join(top, "component", "left_semi").select("id")


def projection(nodes: DataFrame, edges: DataFrame, labels: tuple[str, ...] | None = COMMUNITY_LABELS, types: tuple[str, ...] | None = COMMUNITY_TYPES) -> DataFrame:
    """(a, b): distinct undirected edges of some types between nodes of some labels."""
    e = edges if types is None else edges.where(F.col("type").isin(*types))
    if labels is not None:
        n = nodes.where(F.col("label").isin(*labels)).select("id")
        e = e.join(n.withColumnRenamed("id", "src"), "src", "left_semi").join(n.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return e.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def _move(walk: DataFrame, at: DataFrame, two_m: float, odd: int) -> DataFrame:
    """One round over at (id, k, c): nodes of one half (by their last bit) move to the
    neighbouring community with the largest gain in modularity, if any gains; ties to the
    least community. walk: that half's edges, in buckets of their far end if they are many, so that
    they stay where they are to get its community; they are shuffled by the near one for the choice."""
    mine = F.col("a").bitwiseAND(F.lit(1)) == odd
    total = at.groupBy("c").agg(F.sum("k").alias("tot"))
    placed = at.join(grown(total), "c")
    near = walk.where(F.col("a") != F.col("b")).join(grown(placed.select(F.col("id").alias("b"), "c", "tot")), "b").select("a", "c", "w", "tot")
    stay = placed.select(F.col("id").alias("a"), "c", F.lit(0.0).alias("w"), "tot").where(mine)
    own = at.select(F.col("id").alias("a"), F.col("c").alias("own"), "k").where(mine)
    cand = near.unionByName(stay).repartition("a").groupBy("a", "c").agg(F.sum("w").alias("w"), F.max("tot").alias("tot")).join(grown(own), "a")
    gain = F.col("w") - F.col("k") * (F.col("tot") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0.0)) / two_m
    best = cand.groupBy("a").agg(F.min(F.struct((-F.round(gain, 9)).alias("g"), (F.col("c") != F.col("own")).alias("moves"), "c")).alias("best"), F.max("k").alias("k"))
    return best.select(F.col("a").alias("id"), "k", F.col("best.c").alias("c")).unionByName(at.where(F.col("id").bitwiseAND(F.lit(1)) != odd))


def _halves(walk: DataFrame, n: float) -> list[DataFrame]:
    """The edges (a, b, w) of a walk of n edges by the last bit of a, each half a table."""
    half = lambda odd: walk.where(F.col("a").bitwiseAND(F.lit(1)) == odd)
    return [bucketed(half(odd), "b", "walk") if n >= LARGE else written(half(odd), "walk") for odd in (0, 1)]


def modularity(graph: DataFrame, at: DataFrame) -> float:
    """Modularity of communities (id, c) of an undirected graph (a, b)."""
    ends = graph.join(at.select(F.col("id").alias("a"), F.col("c").alias("ca")), "a").join(at.select(F.col("id").alias("b"), F.col("c").alias("cb")), "b")
    m, inside = ends.agg(F.count("*"), F.count_if(F.col("ca") == F.col("cb"))).first()
    if not m:
        return 0.0
    tot = ends.select(F.explode(F.array("ca", "cb")).alias("c")).groupBy("c").count().agg(F.sum(F.col("count").cast("double") ** 2)).first()[0]
    return inside / m - tot / (4.0 * m * m)


def communities(graph: DataFrame, levels: int = 3, rounds: int = 6) -> DataFrame:
    """(id, community) of an undirected graph (a, b): local moves by modularity gain, half of
    the nodes at a time, then the same on the graph of communities. community numbers
    run from 0 by size, then least member. Deterministic."""
    graph = written(graph.where("a <> b").select("a", "b").distinct(), "graph")
    ids, _ = coded(graph, "a", "b")
    # a node's half stands in the last bit of its code, which a community takes over from its first member
    ids = written(ids.select("id", (F.col("code") * 2 + F.pmod(F.xxhash64("id", F.lit(42)), F.lit(2))).alias("code")), "halves")
    pairs = written(recoded(graph, ids, "a", "b"), "pairs")
    discard(graph)
    two_m, before = 2.0 * pairs.count(), ids.count()
    walk = pairs.withColumn("w", F.lit(1.0))
    halves = _halves(walk.unionByName(walk.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")), two_m)
    discard(pairs)
    of = ids.select(F.col("code").alias("id"), F.col("code").alias("c"))
    for _ in range(levels if two_m else 0):
        walk = halves[0].unionByName(halves[1])
        at = written(walk.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("k")).withColumn("c", F.col("id")), "moved")
        for r in range(rounds):
            last, at = at, written(_move(halves[r % 2], at, two_m, r % 2), "moved")
            discard(last)
        last, of = of, written(of.join(grown(at.select(F.col("id").alias("c"), F.col("c").alias("n"))), "c").select("id", F.col("n").alias("c")), "of")
        discard(last)
        now = of.select("c").distinct().count()
        if now == before:
            break
        up, before, last = at.select(F.col("id").alias("a"), F.col("c").alias("ca")), now, halves
        far = grown(up.select(F.col("a").alias("b"), F.col("ca").alias("cb")))
        walk = written(walk.join(far, "b").join(grown(up), "a").groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("w").alias("w")), "edges")
        halves = _halves(walk, walk.count())
        for old in (walk, at, *last):
            discard(old)
    size = of.groupBy("c").agg(F.count("*").alias("size"), F.min("id").alias("first"))
    number = numbered(size, [F.desc("size"), F.col("first")], "community")
    named = of.select(F.col("id").alias("code"), "c").join(grown(number.select("c", F.col("community").cast("int").alias("community"))), "c")
    return ids.select("id", "code").join(grown(named), "code").select("id", "community")


def community_sizes(members: DataFrame, least: int = 3) -> DataFrame:
    """community, size, and whether it is large enough for a summary."""
    return members.groupBy("community").agg(F.count("*").alias("size")).withColumn("summarised", F.col("size") >= least)


def community_listing(nodes: DataFrame, members: DataFrame, least: int = 3, most: int = 60, said: int = 140) -> DataFrame:
    """(community, size, listing) of communities (id, community) of at least so many members:
    a line for each of the first members by id, at most so many, with label, name and
    the beginning of the summary. Members are cut before they are gathered."""
    sized = community_sizes(members, least).where("summarised").select("community", "size")
    first = members.withColumn("k", F.row_number().over(Window.partitionBy("community").orderBy("id"))).where(F.col("k") <= most)
    text = F.concat(F.lit("  - "), F.coalesce("label", F.lit("")), F.lit(" "), F.coalesce("name", F.lit("")), F.lit(": "), F.substring(F.coalesce("summary", F.lit("")), 1, said))
    lines = first.join(nodes.select("id", "label", "name", "summary"), "id").groupBy("community").agg(F.array_sort(F.collect_list(F.struct("id", text.alias("line")))).alias("x"))
    return sized.join(lines, "community").select("community", "size", F.array_join(F.transform("x", lambda x: x["line"]), "\n").alias("listing"))


def community_summaries(listing: DataFrame, answers: DataFrame) -> DataFrame:
    """(community, size, title, summary) of listed communities by what was answered to them
    (community, answer: text that holds a JSON object). Without a title it is the
    number's; 120 and 2000 characters at most. Answers without an object give no row."""
    a = answers.select("community", reply(F.col("answer"), "title string, summary string").alias("r")).where("r is not null")
    title = F.coalesce("r.title", F.concat(F.lit("community-"), F.col("community").cast("string")))
    return listing.join(a, "community").select("community", "size", F.substring(title, 1, 120).alias("title"), F.substring(F.coalesce("r.summary", F.lit("")), 1, 2000).alias("summary"))


def enrich_candidates(nodes: DataFrame, edges: DataFrame, labels: tuple[str, ...] = COMMUNITY_LABELS, neighbours: int = 25, limit: int = 500) -> DataFrame:
    """Nodes of some labels without a summary, with at most so many neighbours (relType, name), by id."""
    todo = nodes.where(F.col("label").isin(*labels) & F.col("summary").isNull()).orderBy("id").limit(limit)
    both = edges.select(F.col("src").alias("id"), "type", F.col("dst").alias("other")).unionByName(edges.where("src <> dst").select(F.col("dst").alias("id"), "type", F.col("src").alias("other")))
    near = both.join(todo.select("id"), "id", "left_semi").join(nodes.select(F.col("id").alias("other"), F.col("name").alias("n")), "other")
    # a hub's neighbours are cut before they are gathered
    near = near.select("id", F.struct("type", F.col("n").alias("name")).alias("x")).distinct().withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("x"))).where(F.col("k") <= neighbours)
    near = near.groupBy("id").agg(F.array_sort(F.collect_list("x")).alias("neighbours"))
    return todo.join(near, "id", "left").select("id", "label", "name", "neighbours")


def summaries(nodes: DataFrame, said: DataFrame) -> DataFrame:
    """Nodes with summaries (id, summary, tags) written back: 2000 characters, 8 tags at most."""
    s = said.select("id", F.substring("summary", 1, 2000).alias("s"), F.slice("tags", 1, 8).alias("t"))
    return nodes.join(s, "id", "left").withColumn("summary", F.coalesce("s", "summary")).withColumn("tags", F.coalesce("t", "tags")).select(*nodes.columns)
