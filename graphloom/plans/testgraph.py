"""A property graph over the star-schema tables: an edge says that src depends on dst."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TYPES = ("IN_REGION", "IN_NATION", "PLACED_BY", "CONTAINS", "SUPPLIED_BY")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(label: str, key: str):
    return F.concat(F.lit(f"{label}:"), F.col(key).cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, label, name, stack."""
    of = lambda t, label, key, name, stack: table(spark, sf_dir, t).select(_id(label, key).alias("id"), F.lit(label).alias("label"), name.cast("string").alias("name"), F.lit(stack).alias("stack"))
    parts = [
        of("region", "region", "r_regionkey", F.col("r_name"), "place"), of("nation", "nation", "n_nationkey", F.col("n_name"), "place"),
        of("customer", "customer", "c_custkey", F.col("c_name"), "party"), of("supplier", "supplier", "s_suppkey", F.col("s_name"), "party"),
        of("part", "part", "p_partkey", F.col("p_name"), "goods"), of("orders", "order", "o_orderkey", F.col("o_orderstatus"), "goods"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, type, dst; distinct. Only the pairs from lineitem can repeat."""
    of = lambda t, a, ka, kind, b, kb: table(spark, sf_dir, t).select(_id(a, ka).alias("src"), F.lit(kind).alias("type"), _id(b, kb).alias("dst"))
    line = table(spark, sf_dir, "lineitem")
    # pairs are dealt by their first key, so that a source's edges stay together
    contains = line.select("l_orderkey", "l_partkey").repartition("l_orderkey").distinct().select(_id("order", "l_orderkey").alias("src"), F.lit("CONTAINS").alias("type"), _id("part", "l_partkey").alias("dst"))
    supplied = line.select("l_partkey", "l_suppkey").repartition("l_partkey").distinct().select(_id("part", "l_partkey").alias("src"), F.lit("SUPPLIED_BY").alias("type"), _id("supplier", "l_suppkey").alias("dst"))
    return (
        of("nation", "nation", "n_nationkey", "IN_REGION", "region", "n_regionkey").unionByName(of("customer", "customer", "c_custkey", "IN_NATION", "nation", "c_nationkey"))
        .unionByName(of("supplier", "supplier", "s_suppkey", "IN_NATION", "nation", "s_nationkey")).unionByName(of("orders", "order", "o_orderkey", "PLACED_BY", "customer", "o_custkey"))
        .unionByName(contains).unionByName(supplied)
    )


#: The same in SQL, as common table expressions.
CTE = """
nodes AS (
  SELECT 'region:' || r_regionkey AS id, 'region' AS label, r_name AS name, 'place' AS stack FROM region UNION ALL
  SELECT 'nation:' || n_nationkey, 'nation', n_name, 'place' FROM nation UNION ALL
  SELECT 'customer:' || c_custkey, 'customer', c_name, 'party' FROM customer UNION ALL
  SELECT 'supplier:' || s_suppkey, 'supplier', s_name, 'party' FROM supplier UNION ALL
  SELECT 'part:' || p_partkey, 'part', p_name, 'goods' FROM part UNION ALL
  SELECT 'order:' || o_orderkey, 'order', o_orderstatus, 'goods' FROM orders),
edges AS (
  SELECT 'nation:' || n_nationkey AS src, 'IN_REGION' AS type, 'region:' || n_regionkey AS dst FROM nation UNION ALL
  SELECT 'customer:' || c_custkey, 'IN_NATION', 'nation:' || c_nationkey FROM customer UNION ALL
  SELECT 'supplier:' || s_suppkey, 'IN_NATION', 'nation:' || s_nationkey FROM supplier UNION ALL
  SELECT 'order:' || o_orderkey, 'PLACED_BY', 'customer:' || o_custkey FROM orders UNION ALL
  SELECT DISTINCT 'order:' || l_orderkey, 'CONTAINS', 'part:' || l_partkey FROM lineitem UNION ALL
  SELECT DISTINCT 'part:' || l_partkey, 'SUPPLIED_BY', 'supplier:' || l_suppkey FROM lineitem)
"""


def _kind(rows: DataFrame, label: str, prefix: str, key: str, name: str, stack: str) -> DataFrame:
    return rows.select(_id(prefix, key).alias("id"), F.lit(label).alias("label"), F.col(name).cast("string").alias("name"), F.lit(stack).alias("stack"))


def app_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same tables as an application: regions are routes, nations components (and
    repositories and entities), customers and suppliers methods, orders calls, parts endpoints."""
    t = lambda name: table(spark, sf_dir, name)
    parts = [
        _kind(t("region"), "Route", "route", "r_regionkey", "r_name", "angular"), _kind(t("region"), "Table", "tab", "r_regionkey", "r_name", "java"),
        _kind(t("nation"), "Component", "comp", "n_nationkey", "n_name", "angular"), _kind(t("nation"), "Repository", "repo", "n_nationkey", "n_name", "java"), _kind(t("nation"), "Entity", "ent", "n_nationkey", "n_name", "java"),
        _kind(t("customer"), "Method", "meth", "c_custkey", "c_name", "angular"), _kind(t("supplier"), "Method", "smeth", "s_suppkey", "s_name", "java"),
        _kind(t("orders"), "ApiCall", "api", "o_orderkey", "o_orderstatus", "angular"), _kind(t("part"), "Endpoint", "end", "p_partkey", "p_name", "java"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("props", F.create_map(F.lit("routePath"), "name"))


def app_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, type, dst of the application."""
    t = lambda name: table(spark, sf_dir, name)

    def of(rows: DataFrame, a: str, ka: str, kind: str, b: str, kb: str) -> DataFrame:
        return rows.select(_id(a, ka).alias("src"), F.lit(kind).alias("type"), _id(b, kb).alias("dst"))

    n, c, s, line = t("nation"), t("customer"), t("supplier"), t("lineitem")
    after = lambda rows, key, step: rows.withColumn("to", F.col(key) + step).join(rows.select(F.col(key).alias("to")), "to", "left_semi")
    first = line.groupBy("l_orderkey").agg(F.min("l_partkey").alias("l_partkey"))
    maker = line.groupBy("l_partkey").agg(F.min("l_suppkey").alias("l_suppkey"))
    parts = [
        of(n, "route", "n_regionkey", "NAVIGATES_TO", "comp", "n_nationkey"), of(after(n, "n_nationkey", 3).where("n_nationkey % 4 = 0"), "comp", "n_nationkey", "RENDERS", "comp", "to"),
        of(c, "comp", "c_nationkey", "DECLARES", "meth", "c_custkey"), of(after(c, "c_custkey", 1).where("c_custkey % 6 <> 0"), "meth", "c_custkey", "CALLS", "meth", "to"),
        of(t("orders"), "meth", "o_custkey", "MAKES_CALL", "api", "o_orderkey"), of(first, "api", "l_orderkey", "INVOKES_API", "end", "l_partkey"), of(maker, "end", "l_partkey", "HANDLED_BY", "smeth", "l_suppkey"),
        of(after(s, "s_suppkey", 1).where("s_suppkey % 3 <> 0"), "smeth", "s_suppkey", "CALLS", "smeth", "to"), of(s, "repo", "s_nationkey", "DECLARES", "smeth", "s_suppkey"),
        of(n.where("n_nationkey % 2 = 0"), "repo", "n_nationkey", "MANAGES", "ent", "n_nationkey"), of(n, "ent", "n_nationkey", "MAPS_TO", "tab", "n_regionkey"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


APP_CTE = """
nodes AS (
  SELECT 'route:' || r_regionkey AS id, 'Route' AS label, r_name AS name FROM region UNION ALL SELECT 'tab:' || r_regionkey, 'Table', r_name FROM region UNION ALL
  SELECT 'comp:' || n_nationkey, 'Component', n_name FROM nation UNION ALL SELECT 'repo:' || n_nationkey, 'Repository', n_name FROM nation UNION ALL SELECT 'ent:' || n_nationkey, 'Entity', n_name FROM nation UNION ALL
  SELECT 'meth:' || c_custkey, 'Method', c_name FROM customer UNION ALL SELECT 'smeth:' || s_suppkey, 'Method', s_name FROM supplier UNION ALL
  SELECT 'api:' || o_orderkey, 'ApiCall', o_orderstatus FROM orders UNION ALL SELECT 'end:' || p_partkey, 'Endpoint', p_name FROM part),
edges AS (
  SELECT 'route:' || n_regionkey AS src, 'NAVIGATES_TO' AS type, 'comp:' || n_nationkey AS dst FROM nation UNION ALL
  SELECT 'comp:' || n_nationkey, 'RENDERS', 'comp:' || (n_nationkey + 3) FROM nation WHERE n_nationkey % 4 = 0 AND n_nationkey + 3 IN (SELECT n_nationkey FROM nation) UNION ALL
  SELECT 'comp:' || c_nationkey, 'DECLARES', 'meth:' || c_custkey FROM customer UNION ALL
  SELECT 'meth:' || c_custkey, 'CALLS', 'meth:' || (c_custkey + 1) FROM customer WHERE c_custkey % 6 <> 0 AND c_custkey + 1 IN (SELECT c_custkey FROM customer) UNION ALL
  SELECT 'meth:' || o_custkey, 'MAKES_CALL', 'api:' || o_orderkey FROM orders UNION ALL
  SELECT 'api:' || l_orderkey, 'INVOKES_API', 'end:' || min(l_partkey) FROM lineitem GROUP BY l_orderkey UNION ALL
  SELECT 'end:' || l_partkey, 'HANDLED_BY', 'smeth:' || min(l_suppkey) FROM lineitem GROUP BY l_partkey UNION ALL
  SELECT 'smeth:' || s_suppkey, 'CALLS', 'smeth:' || (s_suppkey + 1) FROM supplier WHERE s_suppkey % 3 <> 0 AND s_suppkey + 1 IN (SELECT s_suppkey FROM supplier) UNION ALL
  SELECT 'repo:' || s_nationkey, 'DECLARES', 'smeth:' || s_suppkey FROM supplier UNION ALL
  SELECT 'repo:' || n_nationkey, 'MANAGES', 'ent:' || n_nationkey FROM nation WHERE n_nationkey % 2 = 0 UNION ALL
  SELECT 'ent:' || n_nationkey, 'MAPS_TO', 'tab:' || n_regionkey FROM nation)
"""
