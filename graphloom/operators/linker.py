"""Links client calls to server endpoints by verb and path."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import paths

ACCEPT = 0.5


def prepared(calls: DataFrame, endpoints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(call, verb, path, segs) and (endpoint, verb, path, segs) of rows (id, httpMethod, path).

    Each row is normalised once. Calls without a path or to / can't be resolved."""
    form = lambda df, name: df.select(F.col("id").alias(name), F.upper(F.coalesce("httpMethod", F.lit(""))).alias("verb"), paths.normalize(F.col("path")).alias("path")).withColumn("segs", paths.segments(F.col("path")))
    return form(calls, "call").where(~F.col("path").isin("", "/")), form(endpoints, "endpoint")


def exact_links(calls: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Tier 1: equal verb and path; the least endpoint id of several."""
    first = endpoints.groupBy("verb", "path").agg(F.min("endpoint").alias("endpoint"))
    return calls.join(first, ["verb", "path"]).select("call", "endpoint", F.lit(1.0).alias("confidence"), F.lit("exact").alias("tier"))


def pattern_candidates(calls: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Tier 2 pairs: equal verb and number of segments (the join key) with their score."""
    c = calls.select("call", "verb", "segs", F.size("segs").alias("n"))
    e = endpoints.select("endpoint", "verb", F.col("segs").alias("esegs"), F.size("segs").alias("n"))
    return c.join(e, ["verb", "n"]).withColumn("score", paths.pattern_score(F.col("segs"), F.col("esegs"))).where(F.col("score") >= ACCEPT).select("call", "endpoint", "score")


def pattern_links(calls: DataFrame, endpoints: DataFrame) -> DataFrame:
    """The best endpoint of each call by score, then id."""
    best = pattern_candidates(calls, endpoints).groupBy("call").agg(F.min(F.struct((-F.col("score")).alias("s"), "endpoint")).alias("b"))
    confidence = F.round(F.least(F.lit(0.9), 0.5 - 0.4 * F.col("b.s")), 3)
    return best.select("call", F.col("b.endpoint").alias("endpoint"), confidence.alias("confidence"), F.lit("pattern").alias("tier"))


def link(calls: DataFrame, endpoints: DataFrame, judge: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """call, endpoint, confidence, tier: exact links, then patterns for the rest, then what
    judge(calls, endpoints) says of those left (call, endpoint, confidence from 0.5,
    held at 0.85), if one is given."""
    c, e = prepared(calls, endpoints)
    exact = exact_links(c, e)
    rest = c.join(exact.select("call"), "call", "left_anti")
    pattern = pattern_links(rest, e)
    out = exact.unionByName(pattern)
    if judge is not None:
        left = rest.join(pattern.select("call"), "call", "left_anti")
        said = judge(left, e).where("confidence >= 0.5").join(left.select("call"), "call", "left_semi").join(e.select("endpoint"), "endpoint", "left_semi")
        out = out.unionByName(said.select("call", "endpoint", F.least(F.col("confidence"), F.lit(0.85)).alias("confidence"), F.lit("llm").alias("tier")))
    return out


def link_edges(links: DataFrame, project: str) -> DataFrame:
    """Links as INVOKES_API edges."""
    props = F.create_map(F.lit("confidence"), F.col("confidence").cast("string"), F.lit("tier"), F.col("tier"))
    return links.select(F.lit(project).alias("project"), F.col("call").alias("src"), F.lit("INVOKES_API").alias("type"), F.col("endpoint").alias("dst"), props.alias("props"))


def relink(edges: DataFrame, links: DataFrame, project: str) -> DataFrame:
    """Edges with a project's INVOKES_API replaced."""
    return edges.where((F.col("project") != project) | (F.col("type") != "INVOKES_API")).unionByName(link_edges(links, project))


def link_stats(calls: DataFrame, endpoints: DataFrame, links: DataFrame) -> DataFrame:
    """One row: apiCalls, endpoints, linked, unmatched, exact, pattern, llm, llmUsed."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    by = links.agg(F.count("*").alias("linked"), F.count_if(F.col("tier") == "exact").alias("exact"), F.count_if(F.col("tier") == "pattern").alias("pattern"), F.count_if(F.col("tier") == "llm").alias("llm"))
    return n(calls, "apiCalls").crossJoin(n(endpoints, "endpoints")).crossJoin(by).withColumn("unmatched", F.col("apiCalls") - F.col("linked")).withColumn("llmUsed", F.col("llm") > 0)


def controller_of(endpoint_fqn: Column) -> Column:
    """The controller's name in an endpoint's fqn."""
    return F.element_at(F.split(F.element_at(F.split(endpoint_fqn, "[:#]"), 1), r"\."), -1)


def link_report(links: DataFrame, least: float = 0.0) -> DataFrame:
    """Links of at least a confidence, best first, with their controller."""
    return links.where(F.col("confidence") >= least).withColumn("controller", controller_of(F.regexp_replace("endpoint", "^[a-z]+:", ""))).orderBy(F.desc("confidence"), "controller", "call")


def unmatched(all_: DataFrame, links: DataFrame, end: str) -> DataFrame:
    """Calls (end: call) or endpoints (end: endpoint) without a link."""
    return all_.join(links.select(F.col(end).alias("id")), "id", "left_anti")


def best_of(scored: DataFrame, key: str, score: str, tie: str) -> DataFrame:
    """The row of each key with the best score, ties by a column."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), tie))).where("rank = 1").drop("rank")
