"""Queries over the star-schema and text tables, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graphloom.functions import paths, replies
from graphloom.operators import community, derive, linker, resolve, scenarios, search, sequence, tools, traverse, upsert, views
from graphloom.plans import cypher, testgraph
from graphloom.plans.ontology import NODES
from graphloom.plans.scratch import scratch_path, written
from graphloom.plans.testgraph import APP_CTE, CTE, table
from graphloom.sources import documents as docs_source
from graphloom.sources import files as file_source

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return testgraph.nodes(spark, sf), testgraph.edges(spark, sf)


def _walked(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The graph with its edges as a table of its own, for walks: every hop joins them."""
    return testgraph.nodes(spark, sf), written(testgraph.edges(spark, sf), "edges")


def _ids(spark: SparkSession, *ids: str) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "id string")


def _reach(seeds: str, direction: str, depth: int) -> str:
    """SQL: reach(id, distance) from seeds, as the tail of WITH RECURSIVE."""
    step = {
        "downstream": "SELECT e.dst, w.d + 1 FROM walk w JOIN edges e ON e.src = w.id",
        "upstream": "SELECT e.src, w.d + 1 FROM walk w JOIN edges e ON e.dst = w.id",
        "both": "SELECT e.b, w.d + 1 FROM walk w JOIN (SELECT src AS a, dst AS b FROM edges UNION ALL SELECT dst, src FROM edges) e ON e.a = w.id",
    }[direction]
    return f"WITH RECURSIVE {CTE}, walk(id, d) AS (SELECT id, 0 FROM ({seeds}) UNION {step} WHERE w.d < {depth}), reach AS (SELECT id, min(d)::INT AS distance FROM walk GROUP BY id)"


# Overview

@query(f"WITH {CTE} SELECT CASE WHEN grouping(label) = 1 THEN 'stack' ELSE 'label' END AS axis, CASE WHEN grouping(label) = 1 THEN stack ELSE label END AS value, count(*)::BIGINT AS n FROM nodes GROUP BY GROUPING SETS ((label), (stack))")
def overview_nodes_by_label(spark, sf):
    return views.counts_by_label(testgraph.nodes(spark, sf))


@query(f"WITH {CTE} SELECT type, count(*)::BIGINT AS n FROM edges WHERE src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes) GROUP BY type")
def overview_edges_by_type(spark, sf):
    return views.edges_by_type(*_graph(spark, sf))


# Traversal

def _impact(spark, sf, start, direction, depth):
    return traverse.impact(*_walked(spark, sf), start, direction, depth, types=None)


@query(_reach("SELECT 'nation:7' AS id", "upstream", 3) + " SELECT r.id, n.label, n.name, r.distance FROM reach r JOIN nodes n ON n.id = r.id")
def impact_upstream(spark, sf):
    return _impact(spark, sf, "nation:7", "upstream", 3)[0].select("id", "label", "name", "distance")


@query(_reach("SELECT 'order:1' AS id", "downstream", 6) + " SELECT r.id, n.label, n.name, r.distance FROM reach r JOIN nodes n ON n.id = r.id")
def impact_downstream(spark, sf):
    return _impact(spark, sf, "order:1", "downstream", 6)[0].select("id", "label", "name", "distance")


@query(_reach("SELECT 'customer:5' AS id", "both", 2) + " SELECT r.id, n.label, n.name, r.distance FROM reach r JOIN nodes n ON n.id = r.id")
def impact_both(spark, sf):
    return _impact(spark, sf, "customer:5", "both", 2)[0].select("id", "label", "name", "distance")


@query(_reach("SELECT 'nation:7' AS id", "upstream", 2) + " SELECT e.src, e.type, e.dst FROM edges e JOIN reach r ON r.id = e.dst AND r.distance <= 1")
def impact_edges(spark, sf):
    return _impact(spark, sf, "nation:7", "upstream", 2)[1]


_BLAST = "SELECT 'supplier:3' AS id UNION ALL SELECT 'supplier:4' UNION ALL SELECT 'part:9'"


def _blast(spark, sf):
    nodes, edges = _walked(spark, sf)
    seeds = traverse.resolve_seeds(nodes, ["supplier:3", "part:9", "none:0"], cypher.run(spark, nodes, edges, "MATCH (s:supplier) WHERE s.id = 'supplier:4' RETURN s.id AS id"))
    return traverse.blast_radius(nodes, edges, seeds, 3, types=None, members="SUPPLIED_BY", structural=("part",), entries=("order",))


@query(_reach(_BLAST, "upstream", 3) + f" SELECT r.id, n.label, n.name, r.distance FROM reach r JOIN nodes n ON n.id = r.id WHERE n.label = 'order' AND r.id NOT IN (SELECT id FROM ({_BLAST}))")
def blast_radius_entry_points(spark, sf):
    return traverse.entry_points(_blast(spark, sf)).select("id", "label", "name", "distance")


@query(_reach(_BLAST, "upstream", 3) + f" SELECT n.label, count(*)::BIGINT AS n FROM reach r JOIN nodes n ON n.id = r.id WHERE n.label <> 'part' AND r.id NOT IN (SELECT id FROM ({_BLAST})) GROUP BY n.label")
def blast_radius_by_label(spark, sf):
    return traverse.affected_by_label(_blast(spark, sf))


@query(_reach("SELECT 'customer:5' AS id", "both", 2) + " SELECT r.id, n.label, r.distance FROM reach r JOIN nodes n ON n.id = r.id WHERE n.label IN ('order', 'part', 'nation') OR r.distance = 0")
def neighborhood(spark, sf):
    return traverse.neighbourhood(*_walked(spark, sf), "customer:5", 2, types=None, labels=("order", "part", "nation"))[0].select("id", "label", "distance")


@query(_reach("SELECT 'customer:5' AS id", "both", 2) + " SELECT id, distance FROM (SELECT id, distance, row_number() OVER (ORDER BY distance, id) AS k FROM reach) WHERE k <= 40")
def neighborhood_limited(spark, sf):
    return traverse.neighbourhood(*_walked(spark, sf), "customer:5", 2, types=None, limit=40)[0].select("id", "distance")


# Views

@query(f"WITH {CTE}, n AS (SELECT id FROM nodes WHERE label IN ('customer', 'nation', 'region')) SELECT src, type, dst FROM edges WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)")
def view_induced(spark, sf):
    nodes, edges = _graph(spark, sf)
    return traverse.induced(edges, nodes.where(F.col("label").isin("customer", "nation", "region")))


@query(f"WITH {CTE} SELECT id, label FROM nodes n WHERE label = 'customer' AND EXISTS (SELECT 1 FROM edges e WHERE e.type = 'PLACED_BY' AND e.dst = n.id)")
def view_process_connected(spark, sf):
    nodes, edges = _graph(spark, sf)
    return views.connected_only(nodes.where("label = 'customer'"), edges.where("type = 'PLACED_BY'")).select("id", "label")


@query(f"WITH {CTE}, n AS (SELECT id FROM nodes WHERE label = 'supplier' ORDER BY id LIMIT 30) SELECT e.src, e.type, e.dst FROM edges e JOIN n ON n.id = e.src")
def view_capped(spark, sf):
    nodes, edges = _graph(spark, sf)
    return edges.join(views.capped(nodes.where("label = 'supplier'"), 30).select(F.col("id").alias("src")), "src", "left_semi")


@query(f"""WITH {CTE}, own AS (SELECT dst AS owner, src AS method FROM edges WHERE type = 'PLACED_BY'), call AS (SELECT src AS method, dst AS other FROM edges WHERE type = 'CONTAINS'),
  made AS (SELECT src AS method, dst AS made FROM edges WHERE type = 'SUPPLIED_BY')
SELECT DISTINCT o.owner AS src, 'CONTAINS' AS type, c.other AS dst FROM own o JOIN call c USING (method)""")
def collapse_hops(spark, sf):
    nodes, edges = _graph(spark, sf)
    owns = edges.where("type = 'PLACED_BY'").select(F.col("dst").alias("src"), F.lit("DECLARES").alias("type"), F.col("src").alias("dst"))
    all_ = owns.unionByName(edges.where("type = 'CONTAINS'"))
    return views.collapse_hops(nodes, all_, edges, calls="NONE", makes="CONTAINS").select("src", "type", "dst")


@query(f"""WITH {CTE} SELECT x.direction, x.type, x.other, n.label, n.name FROM (
  SELECT 'out' AS direction, type, dst AS other FROM edges WHERE src = 'nation:3' UNION ALL SELECT 'in', type, src FROM edges WHERE dst = 'nation:3') x JOIN nodes n ON n.id = x.other""")
def node_detail(spark, sf):
    return views.node_detail(*_graph(spark, sf), "nation:3")


@query(f"""WITH {CTE} SELECT x.direction, x.type, count(*)::BIGINT AS n, min(x.other) AS first FROM (
  SELECT 'out' AS direction, type, dst AS other FROM edges WHERE src = 'nation:3' UNION ALL SELECT 'in', type, src FROM edges WHERE dst = 'nation:3') x GROUP BY 1, 2""")
def neighbours_grouped(spark, sf):
    g = views.grouped_neighbours(views.node_detail(*_graph(spark, sf), "nation:3"))
    return g.select("direction", "type", "n", F.col("others")[0].alias("first"))


@query(f"""WITH {CTE} SELECT n.id, count(*)::BIGINT AS degree FROM nodes n JOIN (SELECT src AS id FROM edges WHERE type = 'IN_NATION' UNION ALL SELECT dst FROM edges WHERE type = 'IN_NATION') e ON e.id = n.id
  WHERE n.label = 'nation' GROUP BY n.id ORDER BY degree DESC, n.id LIMIT 3""")
def top_degree(spark, sf):
    return views.top_degree(*_graph(spark, sf), "nation", ("IN_NATION",), 3).select("id", "degree")


@query("SELECT page_id AS id, url FROM (SELECT page_id, url, row_number() OVER (ORDER BY CASE WHEN page_id % 3 = 0 THEN 1 WHEN page_id % 3 = 1 THEN 2 ELSE 3 END, strlen(url), page_id) AS k FROM pages WHERE ends_with(url, '/')) WHERE k = 1")
def by_path_ranked(spark, sf):
    label = F.when(F.col("page_id") % 3 == 0, "Controller").when(F.col("page_id") % 3 == 1, "Service").otherwise("Other")
    n = table(spark, sf, "pages").select(F.col("page_id").alias("id"), label.alias("label"), F.col("url").alias("filePath"))
    return views.by_path(n, "/", ("Controller", "Service")).select("id", F.col("filePath").alias("url"))


# Links

_VERBS = "CASE WHEN page_id % 7 = 0 THEN 'POST' ELSE 'GET' END"
_FORM = r"""array_to_string([CASE WHEN contains(s, '{{') OR regexp_full_match(s, ':[A-Za-z_]\w*|\*') THEN '{{*}}' ELSE lower(s) END FOR s IN string_split(
  CASE WHEN {p} = '/' THEN '/' ELSE rtrim({p}, '/') END, '/')], '/')"""
_BARE = "regexp_replace(CASE WHEN starts_with({b}, '/') THEN {b} ELSE '/' || {b} END, '/+', '/', 'g')"


def _sql_normalize(url: str) -> str:
    bare = _BARE.format(b=f"string_split(regexp_replace(trim({url}), '^[a-z]+://[^/]+', ''), '?')[1]")
    return _FORM.format(p=f"({bare})")


# Fixed rows: calls and endpoints that try every tier.
_CALLS = (("c1", "GET", "/api/orders/5"), ("c2", "GET", "/en/{id}"), ("c3", "get", "/a/b/c"), ("c4", "GET", "/x/:y"), ("c5", "DELETE", "/api/orders/5"), ("c6", "GET", "/"), ("c7", "GET", ""), ("c8", "GET", "/any/1"))
_ENDPOINTS = (("e1", "GET", "/api/orders/{id}"), ("e2", "GET", "/a/{x}/{y}"), ("e3", "ANY", "/any/{z}"), ("e4", "GET", "/{a}/{b}"))


def _link_tables(spark, sf):
    pages = table(spark, sf, "pages")
    calls = pages.select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), F.when(F.col("page_id") % 7 == 0, "POST").otherwise("GET").alias("httpMethod"), F.regexp_replace("url", "#.*$", "").alias("path"))
    calls = calls.unionByName(spark.createDataFrame(_CALLS, "id string, httpMethod string, path string"))
    langs = table(spark, sf, "documents").select("lang").where("lang is not null").distinct().select(F.concat(F.lit("l"), "lang").alias("id"), F.lit("GET").alias("httpMethod"), F.concat(F.lit("/"), "lang", F.lit("/{n}")).alias("path"))
    some = pages.select(F.concat(F.lit("q"), F.col("page_id").cast("string")).alias("id"), F.lit("GET").alias("httpMethod"), F.regexp_replace("url", "#.*$", "").alias("path"))
    return calls, langs.unionByName(some).unionByName(spark.createDataFrame(_ENDPOINTS, "id string, httpMethod string, path string"))


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in rows)


_LINK_CTE = f"""WITH calls0 AS (
  SELECT 'p' || page_id AS id, {_VERBS} AS verb, regexp_replace(url, '#.*$', '') AS path FROM pages UNION ALL SELECT * FROM (VALUES {_values(_CALLS)})),
ends0 AS (
  SELECT 'l' || lang AS id, 'GET' AS verb, '/' || lang || '/{{n}}' AS path FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL) UNION ALL
  SELECT 'q' || page_id, 'GET', regexp_replace(url, '#.*$', '') FROM pages UNION ALL SELECT * FROM (VALUES {_values(_ENDPOINTS)})),
calls AS (SELECT id AS call, upper(verb) AS verb, p AS path, string_split(p, '/')[2:] AS segs FROM (SELECT *, CASE WHEN trim(path) = '' THEN '' ELSE {_sql_normalize('path')} END AS p FROM calls0) WHERE p NOT IN ('', '/')),
ends AS (SELECT id AS endpoint, upper(verb) AS verb, p AS path, string_split(p, '/')[2:] AS segs FROM (SELECT *, {_sql_normalize('path')} AS p FROM ends0)),
exact AS (SELECT call, min(endpoint) AS endpoint, 1e0 AS confidence, 'exact' AS tier FROM calls JOIN ends USING (verb, path) GROUP BY call),
pairs AS (SELECT c.call, e.endpoint, len(c.segs) AS n, [CASE WHEN z[1] = '{{*}}' OR z[2] = '{{*}}' THEN 0 WHEN z[1] = z[2] THEN 1 ELSE -1 END FOR z IN list_zip(c.segs, e.segs)] AS m
  FROM calls c JOIN ends e ON c.verb = e.verb AND len(c.segs) = len(e.segs) WHERE c.call NOT IN (SELECT call FROM exact)),
scored AS (SELECT call, endpoint, CASE WHEN list_contains(m, -1) THEN 0e0 WHEN NOT list_contains(m, 1) THEN 0.5e0 ELSE list_sum(m)::DOUBLE / n END AS score FROM pairs),
pattern AS (SELECT call, endpoint, round(least(0.9e0, 0.5e0 + 0.4e0 * score), 3) AS confidence, 'pattern' AS tier FROM (
  SELECT *, row_number() OVER (PARTITION BY call ORDER BY score DESC, endpoint) AS k FROM scored WHERE score >= 0.5e0) WHERE k = 1),
links AS (SELECT * FROM exact UNION ALL SELECT * FROM pattern)
"""


@query(_LINK_CTE + "SELECT * FROM links")
def links_best(spark, sf):
    return linker.link(*_link_tables(spark, sf))


@query(_LINK_CTE + "SELECT * FROM exact")
def links_exact(spark, sf):
    return linker.exact_links(*linker.prepared(*_link_tables(spark, sf)))


@query(_LINK_CTE + "SELECT call, endpoint, score FROM scored WHERE score >= 0.5e0")
def links_pattern(spark, sf):
    c, e = linker.prepared(*_link_tables(spark, sf))
    rest = c.join(linker.exact_links(c, e).select("call"), "call", "left_anti")
    return linker.pattern_candidates(rest, e)


@query(_LINK_CTE + "SELECT id FROM ends0 WHERE id NOT IN (SELECT endpoint FROM links)")
def links_unmatched(spark, sf):
    calls, ends = _link_tables(spark, sf)
    return linker.unmatched(ends, linker.link(calls, ends), "endpoint").select("id")


@query(_LINK_CTE + """SELECT (SELECT count(*) FROM calls0)::BIGINT AS "apiCalls", (SELECT count(*) FROM ends0)::BIGINT AS endpoints, count(*)::BIGINT AS linked, count(*) FILTER (tier = 'exact')::BIGINT AS exact,
  count(*) FILTER (tier = 'pattern')::BIGINT AS pattern, (SELECT count(*) FROM calls0)::BIGINT - count(*)::BIGINT AS unmatched FROM links""")
def links_stats(spark, sf):
    calls, ends = _link_tables(spark, sf)
    return linker.link_stats(calls, ends, linker.link(calls, ends)).drop("llm", "llmUsed")


@query(f"SELECT page_id, {_sql_normalize('url')} AS path FROM pages")
def url_normalize(spark, sf):
    return table(spark, sf, "pages").select("page_id", paths.normalize(F.col("url")).alias("path"))


# Upserts

def _versions(spark, sf):
    d = table(spark, sf, "documents")
    old = d.where("doc_id % 7 <> 0").select(F.lit("p").alias("project"), F.col("doc_id").cast("string").alias("id"), F.sha2("text", 256).alias("hash"))
    new = d.where("doc_id % 5 <> 0").select(F.lit("p").alias("project"), F.col("doc_id").cast("string").alias("id"), F.sha2(F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("hash"))
    return old, new


_VERSIONS = """WITH old AS (SELECT doc_id::VARCHAR AS id, sha256(text) AS h0 FROM documents WHERE doc_id % 7 <> 0),
new AS (SELECT doc_id::VARCHAR AS id, sha256(CASE WHEN doc_id % 4 = 0 THEN text || '!' ELSE text END) AS h1 FROM documents WHERE doc_id % 5 <> 0) """


@query(_VERSIONS + "SELECT coalesce(old.id, new.id) AS id, CASE WHEN h0 IS NULL THEN 'insert' WHEN h1 IS NULL THEN 'stale' WHEN h0 = h1 THEN 'unchanged' ELSE 'changed' END AS state FROM old FULL JOIN new USING (id)")
def upsert_hash_diff(spark, sf):
    return upsert.hash_states(*_versions(spark, sf))


@query(_VERSIONS + "SELECT id FROM old WHERE id NOT IN (SELECT id FROM new)")
def stale_nodes(spark, sf):
    old, new = _versions(spark, sf)
    return upsert.stale(old.withColumn("stack", F.lit("java")), new, "p", "java").select("id")


def _saved_twice(spark, sf):
    """A graph of documents that is saved, then loaded, brought up to date by a document of its
    java stack and saved in the same place."""
    d = table(spark, sf, "documents").select("doc_id", "text", "lang", F.when(F.col("doc_id") % 3 == 0, "angular").otherwise("java").alias("stack"))
    none = lambda kind: F.lit(None).cast(kind)

    def nodes(d, hash_, name, summary):
        text = lambda c: c.cast("string")
        rows = {"project": F.lit("p"), "id": text(F.col("doc_id")), "name": name, "label": F.lit("Class"), "labels": F.array(F.lit("Class")), "stack": F.col("stack"), "hash": hash_, "props": F.create_map(F.lit("lang"), F.coalesce("lang", F.lit(""))), "summary": summary}
        return d.select(*[(rows[f.name] if f.name in rows else none(f.dataType)).alias(f.name) for f in StructType.fromDDL(NODES).fields])

    def links(d, step):
        e = d.select(F.lit("p").alias("project"), F.col("doc_id").cast("string").alias("src"), F.lit("CALLS").alias("type"), (F.col("doc_id") + step).cast("string").alias("dst"), none("map<string,string>").alias("props"))
        return e.join(d.select(F.col("doc_id").cast("string").alias("dst")), "dst", "left_semi").select("project", "src", "type", "dst", "props")

    path = scratch_path(spark, "graph")
    docs_source.save_graph(nodes(d, F.sha2("text", 256), F.col("lang"), F.concat(F.lit("s"), F.col("doc_id"))), links(d, 1).unionByName(links(d, 3)), path)
    new = d.where("stack = 'java' and doc_id % 5 <> 0")
    changed = F.sha2(F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256)
    e = new.select(F.lit("p").alias("project"), F.col("doc_id").cast("string").alias("src"), F.lit("CALLS").alias("type"), (F.col("doc_id") + 2).cast("string").alias("dst"), none("map<string,string>").alias("props"))
    old = docs_source.load_graph(spark, path, "p")
    n, e, _ = upsert.ingest(*old, nodes(new, changed, F.when(F.col("doc_id") % 2 == 0, F.upper("lang")), none("string")), e, "p", "java")
    docs_source.save_graph(n, e, path, only="p")
    return docs_source.load_graph(spark, path)


_SAVED = """WITH d AS (SELECT doc_id AS i, *, doc_id % 3 <> 0 AS java FROM documents), kept AS (SELECT i FROM d WHERE java AND i % 5 <> 0) """


@query(_SAVED + """SELECT i::VARCHAR AS id, CASE WHEN java AND i % 2 = 0 THEN upper(lang) ELSE lang END AS name, sha256(CASE WHEN java AND i % 4 = 0 THEN text || '!' ELSE text END) AS hash, CASE WHEN java AND i % 4 = 0 THEN NULL ELSE 's' || i END AS summary
FROM d WHERE NOT java OR i IN (SELECT i FROM kept)""")
def upsert_saved_nodes(spark, sf):
    return _saved_twice(spark, sf)[0].select("id", "name", "hash", "summary")


@query(_SAVED + """SELECT a.i::VARCHAR AS src, 'CALLS' AS type, b.i::VARCHAR AS dst FROM d a JOIN d b ON b.i = a.i + 3 WHERE NOT a.java
UNION ALL SELECT a.i::VARCHAR, 'CALLS', b.i::VARCHAR FROM kept a JOIN kept b ON b.i = a.i + 2""")
def upsert_saved_edges(spark, sf):
    return _saved_twice(spark, sf)[1].select("src", "type", "dst")


@query("SELECT doc_id::VARCHAR AS id, lang AS name, sha256(text) AS hash, '[\"' || coalesce(source, '') || '\"]' AS sources, doc_id // 2 || '' AS target FROM documents")
def export_round_trip(spark, sf):
    """A graph of documents written as exchange documents and read again."""
    d = table(spark, sf, "documents")
    i = F.col("doc_id").cast("string")
    rows = {"project": F.lit("p"), "id": i, "name": F.col("lang"), "label": F.lit("Class"), "stack": F.when(F.col("doc_id") % 3 == 0, "java").otherwise("angular"), "hash": F.sha2("text", 256), "arr_props": F.create_map(F.lit("sources"), F.array(F.coalesce("source", F.lit(""))))}
    n = d.select(*[rows.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(NODES).fields])
    e = d.select(F.lit("p").alias("project"), i.alias("src"), F.lit("CALLS").alias("type"), F.floor(F.col("doc_id") / 2).cast("string").alias("dst"), F.lit(None).cast("map<string,string>").alias("props"))
    path = scratch_path(spark, "export")
    docs_source.save_documents(docs_source.exchange_documents(n, e, 100), path)
    back = docs_source.read_documents(spark, [path])
    got = docs_source.document_nodes(back).join(docs_source.document_edges(back).select(F.col("src").alias("id"), F.col("dst").alias("target")), "id")
    return got.select("id", "name", "hash", F.to_json(F.col("arr_props")["sources"]).alias("sources"), "target")


@query(f"WITH {CTE}, present AS (SELECT id FROM nodes WHERE label <> 'supplier' OR id LIKE '%1') SELECT src, type, dst FROM edges WHERE type = 'IN_REGION' OR src NOT IN (SELECT id FROM present) OR dst NOT IN (SELECT id FROM present)")
def dangling_edges(spark, sf):
    nodes, edges = _graph(spark, sf)
    some = nodes.where((F.col("label") != "supplier") | F.col("id").endswith("1"))
    return upsert.dangling(edges, some, ("IN_NATION", "PLACED_BY", "CONTAINS", "SUPPLIED_BY"))[1]


# Derived joins

_HOST = "regexp_extract(url, '://([^/?#]+)', 1)"


@query(f"""WITH h AS (SELECT DISTINCT array_to_string(list_reverse(string_split({_HOST}, '.')), '.') AS name FROM pages),
g AS (SELECT DISTINCT array_to_string(string_split(name, '.')[1:2], '.') AS g FROM h UNION SELECT DISTINCT array_to_string(string_split(name, '.')[1:3], '.') FROM h WHERE strlen(name) % 2 = 0 UNION SELECT 'com')
SELECT name, g AS "group" FROM (SELECT name, g, rank() OVER (PARTITION BY name ORDER BY strlen(g) DESC) AS k FROM h JOIN g ON name = g OR starts_with(name, g || '.')) WHERE k = 1""")
def longest_prefix(spark, sf):
    names = table(spark, sf, "pages").select(F.array_join(F.reverse(F.split(F.regexp_extract("url", "://([^/?#]+)", 1), r"\.")), ".").alias("name")).distinct()
    parts = F.split("name", r"\.")
    g = names.select(F.array_join(F.slice(parts, 1, 2), ".").alias("group")).unionByName(names.where(F.length("name") % 2 == 0).select(F.array_join(F.slice(parts, 1, 3), ".").alias("group"))).unionByName(spark.createDataFrame([("com",)], "group string"))
    return derive.longest_prefix(names, g)


@query("""SELECT DISTINCT 'part:' || p_partkey AS src, 'supplier:' || s_suppkey AS dst FROM part JOIN supplier ON contains(lower(s_name), lower(p_brand)) OR s_name = p_name OR contains(s_suppkey::VARCHAR, (p_size + 40)::VARCHAR)""")
def or_join(spark, sf):
    p = table(spark, sf, "part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_brand").alias("vendor"), F.col("p_name").alias("host"), (F.col("p_size") + 40).cast("string").alias("port"))
    s = table(spark, sf, "supplier").select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("name"), F.col("s_name").alias("image"), F.array(F.col("s_suppkey").cast("string")).alias("ports"))
    return derive.provided_by(p, s)


@query("SELECT c_custkey AS src, r_regionkey AS dst FROM customer CROSS JOIN region WHERE r_name IS NOT NULL")
def hosts_cross(spark, sf):
    ds = table(spark, sf, "customer").select(F.lit("p").alias("project"), F.col("c_custkey").alias("id"))
    t = table(spark, sf, "region").where("r_name is not null").select(F.lit("p").alias("project"), F.col("r_regionkey").alias("id"), F.lit("Table").alias("label"))
    return derive.hosts(ds, t)


# Scenarios

def _app(spark, sf):
    return testgraph.app_nodes(spark, sf), written(testgraph.app_edges(spark, sf), "edges")


def _follow(frm: str, to: str, kind: str, more: str = "") -> str:
    return f"{to} AS (SELECT DISTINCT f.route, e.dst AS id FROM {frm} f JOIN edges e ON e.src = f.id AND e.type = '{kind}'{more})"


def _closed(frm: str, to: str, kind: str, most: int) -> str:
    steps = []
    for k in range(1, most + 1):
        steps.append(_follow(frm if k == 1 else f"{to}{k - 1}", f"{to}{k}", kind))
    return ", ".join([*steps, f"{to} AS ({' UNION '.join(f'SELECT route, id FROM {x}' for x in [frm, *(f'{to}{k}' for k in range(1, most + 1))])})"])


_TRACE = f"""WITH {APP_CTE}, routes AS (SELECT id AS route, id FROM nodes WHERE label = 'Route'), {_follow('routes', 'firsts', 'NAVIGATES_TO')}, {_closed('firsts', 'comps', 'RENDERS', 2)},
{_follow('comps', 'own', 'DECLARES')}, {_closed('own', 'meths', 'CALLS', 3)}, {_follow('meths', 'apis', 'MAKES_CALL')}, {_follow('apis', 'ends', 'INVOKES_API')},
{_follow('ends', 'handlers', 'HANDLED_BY')}, {_closed('handlers', 'servers', 'CALLS', 4)},
repos AS (SELECT DISTINCT s.route, e.src AS id FROM servers s JOIN edges e ON e.dst = s.id AND e.type = 'DECLARES' AND e.src LIKE 'repo:%'), {_follow('repos', 'ents', 'MANAGES')}, {_follow('ents', 'tabs', 'MAPS_TO')},
traced AS (SELECT route, 'route' AS role, id FROM routes UNION ALL SELECT route, 'component', id FROM comps UNION ALL SELECT route, 'apicall', id FROM apis UNION ALL SELECT route, 'endpoint', id FROM ends UNION ALL SELECT route, 'entity', id FROM ents UNION ALL SELECT route, 'table', id FROM tabs)
"""


@query(_TRACE + "SELECT route, role, count(*)::BIGINT AS n, min(id) AS first, max(id) AS last FROM traced GROUP BY route, role")
def scenario_trace(spark, sf):
    return scenarios.trace(*_app(spark, sf)).groupBy("route", "role").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))


@query(_TRACE + "SELECT 'system:scenario:p:' || n.name AS src, t.id AS dst, t.role FROM traced t JOIN nodes n ON n.id = t.route")
def scenario_covers(spark, sf):
    n, e = _app(spark, sf)
    return scenarios.build_scenarios(n, scenarios.trace(n, e), "p")[1]


_COLLAPSED = """hops AS (
  SELECT DISTINCT o.src, 'CALLS' AS type, p.src AS dst FROM edges o JOIN edges c ON c.src = o.dst AND c.type = 'CALLS' JOIN edges p ON p.dst = c.dst AND p.type = 'DECLARES' WHERE o.type = 'DECLARES' AND o.src <> p.src
  UNION SELECT DISTINCT o.src, 'MAKES_CALL', m.dst FROM edges o JOIN edges m ON m.src = o.dst AND m.type = 'MAKES_CALL' WHERE o.type = 'DECLARES')"""


@query(f"""WITH {APP_CTE}, {_COLLAPSED}, n AS (SELECT id FROM nodes WHERE label IN ('Controller', 'Service', 'Component', 'Endpoint', 'Entity', 'DTO', 'Repository', 'ApiCall', 'Route', 'Dependency'))
SELECT src, type, dst, false AS collapsed FROM edges WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)
UNION ALL SELECT src, type, dst, true FROM hops WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n) AND (src, type, dst) NOT IN (SELECT (src, type, dst) FROM edges)""")
def view_logical(spark, sf):
    """The logical preset, whole: owner to owner and owner to call, through methods."""
    return views.view_subgraph(*_app(spark, sf), "logical")[1]


@query(f"WITH {APP_CTE} SELECT src, type, dst, false AS collapsed FROM edges WHERE type IN ('CALLS', 'HANDLED_BY', 'MAKES_CALL', 'INVOKES_API')")
def view_callgraph(spark, sf):
    return views.view_subgraph(*_app(spark, sf), "callgraph")[1]


@query(f"WITH {CTE} SELECT src AS scenario, count(*)::BIGINT AS covered FROM edges WHERE type = 'CONTAINS' GROUP BY src ORDER BY covered DESC, src LIMIT 3")
def scenario_coverage_top3(spark, sf):
    return scenarios.top_scenarios(testgraph.edges(spark, sf).where("type = 'CONTAINS'"), 3)


# Search and source text


_PREFIX_AND = """WITH t AS (SELECT DISTINCT doc_id AS id, 'text' AS field, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS token FROM documents UNION SELECT DISTINCT doc_id, 'source', unnest(regexp_split_to_array(lower(source), '[^a-z0-9]+')) FROM documents),
h AS (SELECT DISTINCT id, field, term FROM t JOIN (VALUES ('ther'), ('src1')) q(term) ON starts_with(token, term))
SELECT id, score FROM (SELECT id, count(DISTINCT term) AS terms, count(*)::BIGINT AS score FROM h GROUP BY id) WHERE terms = 2 ORDER BY score DESC, id LIMIT 25"""


@query(_PREFIX_AND)
def search_prefix_and(spark, sf):
    n = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", "source")
    return search.search(n, "ther SRC1", 25, fields=("text", "source"))


@query(_PREFIX_AND)
def search_saved_index(spark, sf):
    """The index of a half of the texts, brought up to date and searched."""
    n = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", "source")
    old = n.where("id % 2 = 0").unionByName(n.where("id % 10 = 1").withColumn("text", F.lit("thermal thermos")))
    index = search.SavedIndex(spark, scratch_path(spark, "index")).update(old, ("text", "source"))
    return index.update(n, ("text", "source")).search("ther SRC1", 25)


@query("SELECT p_partkey AS id, 1e0 AS score FROM part WHERE contains(lower(p_name), 'ar') OR contains(lower(p_type), 'ar') ORDER BY p_partkey LIMIT 25")
def search_fallback(spark, sf):
    n = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("fqn"))
    return search.search_fallback(n, "AR")


@query("SELECT doc_id AS id, left(array_to_string(string_split(text, chr(10))[2:4], chr(10)), 20000) AS source FROM documents")
def source_slice(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("filePath"), "text")
    return docs_source.source_slice(d.select("filePath", "text"), d.select("id", "filePath", F.lit(3).alias("startLine"), F.lit(3).alias("endLine")), context=1)


@query("SELECT page_id, h AS href FROM (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS h FROM pages)")
def href_edges(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1)).alias("href")).distinct()


@query("SELECT event_type, count(*)::BIGINT AS n, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS k FROM events GROUP BY event_type")
def event_props(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"))


# Components, communities, sequences, layout

def _components_sql(rounds: int) -> str:
    """The least id within so many hops, which is more than any two nodes of a component are apart."""
    parts = ["n AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges)", "r0 AS (SELECT DISTINCT a AS id, a AS m FROM n)"]
    parts += [f"r{k} AS MATERIALIZED (SELECT r.id, least(r.m, x.m) AS m FROM r{k - 1} r JOIN (SELECT n.a AS id, min(q.m) AS m FROM n JOIN r{k - 1} q ON q.id = n.b GROUP BY n.a) x USING (id))" for k in range(1, rounds + 1)]
    return f"WITH {CTE}, {', '.join(parts)} SELECT id, m AS component FROM r{rounds}"


@query(_components_sql(14))
def components(spark, sf):
    e = testgraph.edges(spark, sf)
    return community.components(e.select(F.col("src").alias("a"), F.col("dst").alias("b")))


@query()
def communities(spark, sf):
    nodes, edges = _graph(spark, sf)
    return community.communities(community.projection(nodes, edges, None, None))


# A nation is called by customers and by suppliers; parents are expanded at their first step only.
@query(f"""WITH {CTE}, c AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY line, dst) AS k FROM (SELECT src, dst, min(string_split(dst, ':')[2]::INT) AS line FROM edges GROUP BY src, dst)),
s1 AS (SELECT n.id AS root, n.id AS a, c.dst AS b, [c.k] AS path FROM nodes n JOIN c ON c.src = n.id WHERE n.label = 'order'),
s2 AS (SELECT s.root, s.b AS a, c.dst AS b, list_append(s.path, c.k) AS path FROM s1 s JOIN c ON c.src = s.b),
first2 AS (SELECT root, b, min(path) AS path FROM s2 WHERE b LIKE 'supplier:%' GROUP BY root, b),
s3 AS (SELECT s.root, s.b AS a, c.dst AS b, list_append(s.path, c.k) AS path FROM first2 s JOIN c ON c.src = s.b),
first3 AS (SELECT root, b, min(path) AS path FROM (SELECT root, b, path FROM s2 WHERE b LIKE 'nation:%' UNION ALL SELECT root, b, path FROM s3) GROUP BY root, b),
s4 AS (SELECT s.root, s.b AS a, c.dst AS b, list_append(s.path, c.k) AS path FROM first3 s JOIN c ON c.src = s.b),
steps AS (SELECT root, a, b, path, row_number() OVER (PARTITION BY root ORDER BY path) - 1 AS step, count(*) OVER (PARTITION BY root) AS total
  FROM (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3 UNION ALL SELECT * FROM s4))
SELECT s.root, s.step::INT AS step, x.name AS caller, y.name AS callee, y.name AS message, (len(s.path) - 1)::INT AS depth, x.name = y.name AS self_call, s.total > 60 AS truncated
FROM steps s JOIN nodes x ON x.id = s.a JOIN nodes y ON y.id = s.b WHERE s.step < 60""")
def sequence_preorder(spark, sf):
    nodes, edges = _walked(spark, sf)
    calls = edges.withColumn("props", F.create_map(F.lit("line"), F.substring_index("dst", ":", -1))).withColumn("type", F.lit("CALLS"))
    roots = nodes.where("label = 'order'").select(F.col("id").alias("root"))
    return sequence.sequence(nodes, calls, roots)


def _layout_sql(sweeps: int) -> str:
    parts = ["ends AS (SELECT src, dst FROM edges WHERE src <> dst UNION ALL SELECT dst, src FROM edges WHERE src <> dst)"]
    parts += ["p0 AS MATERIALIZED (SELECT id, label AS tier, row_number() OVER (PARTITION BY label ORDER BY id) - 1 AS position FROM nodes)"]
    for k in range(1, sweeps + 1):
        near = f"SELECT e.src AS id, avg(q.position) AS center FROM ends e JOIN p{k - 1} q ON q.id = e.dst GROUP BY e.src"
        parts.append(f"p{k} AS MATERIALIZED (SELECT p.id, p.tier, row_number() OVER (PARTITION BY p.tier ORDER BY coalesce(c.center, p.position), p.id) - 1 AS position FROM p{k - 1} p LEFT JOIN ({near}) c ON c.id = p.id)")
    return f"WITH {CTE}, {', '.join(parts)} SELECT id, tier, position::INT AS position FROM p{sweeps}"


@query(_layout_sql(4))
def layered_layout(spark, sf):
    return views.layered_layout(*_walked(spark, sf), "label")


# Answers, listings, totals

@query(f"""WITH {CTE}, m AS (SELECT src AS id, string_split(dst, ':')[2]::BIGINT AS community FROM edges WHERE type = 'IN_NATION'),
x AS (SELECT m.community, n.*, row_number() OVER (PARTITION BY m.community ORDER BY m.id) AS k, count(*) OVER (PARTITION BY m.community) AS size FROM m JOIN nodes n ON n.id = m.id)
SELECT community, min(size)::BIGINT AS size, string_agg('  - ' || label || ' ' || name || ': ' || left(stack || name, 7), chr(10) ORDER BY id) AS listing FROM x WHERE k <= 60 AND size >= 3 GROUP BY community""")
def community_listing(spark, sf):
    """The parties of each nation as one community."""
    nodes, edges = _graph(spark, sf)
    members = edges.where("type = 'IN_NATION'").select(F.col("src").alias("id"), F.substring_index("dst", ":", -1).cast("long").alias("community"))
    return community.community_listing(nodes.withColumn("summary", F.concat("stack", "name")), members, said=7)


@query("SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN json_extract_string(props, '$.k')::BIGINT END AS k FROM events")
def reply_blocks(spark, sf):
    """Properties of events inside answers in prose and fences; every seventh is broken."""
    said = F.when(F.col("event_id") % 7 != 0, F.concat(F.lit("So it is:\n```json\n"), "props", F.lit("\n```\nas said"))).otherwise(F.concat(F.lit("{ no: "), "props"))
    return table(spark, sf, "events").select("event_id", replies.reply(said, "k bigint")["k"].alias("k"))


@query(f"""WITH {APP_CTE} SELECT id, '{{' || concat_ws(',', '"id":' || to_json(id), '"label":' || to_json(label), '"name":' || to_json(nullif(name, 'ASIA'))) || '}}' AS json FROM nodes""")
def tool_hits(spark, sf):
    """Every node as an agent's tool shows it; what is null is left out."""
    n = testgraph.app_nodes(spark, sf).select("id", "label", F.nullif("name", F.lit("ASIA")).alias("name"), F.lit(None).cast("string").alias("fqn"))
    return tools.hits(n)


@query("""SELECT doc_id AS id, left(array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: i || ': ' || x), chr(10)), 7000) AS source FROM documents""")
def source_numbered(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("filePath"), "text")
    return docs_source.source_slice(d.select("filePath", "text"), d.select("id", "filePath", F.lit(1).alias("startLine"), F.lit(2**30).alias("endLine")), most=tools.MOST_SOURCE, numbered=True)


@query(_reach("SELECT 'nation:7' AS id", "upstream", 3) + """, x AS (SELECT r.distance, n.label, count(*) AS n FROM reach r JOIN nodes n ON n.id = r.id WHERE r.distance > 0 GROUP BY ALL)
SELECT distance, sum(n)::BIGINT AS n, string_agg(label || '=' || n, ',' ORDER BY label) AS labels FROM x GROUP BY distance""")
def impact_by_distance(spark, sf):
    found = traverse.by_distance(_impact(spark, sf, "nation:7", "upstream", 3)[0])
    pairs = F.transform(F.map_entries("by_label"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return found.select("distance", "n", F.array_join(F.array_sort(pairs), ",").alias("labels"))


@query(f"""WITH {CTE}, p AS (SELECT DISTINCT stack AS name FROM nodes UNION ALL SELECT 'none'), c AS (SELECT stack AS name, label, count(*) AS n FROM nodes GROUP BY ALL),
l AS (SELECT name, string_agg(label || '=' || n, ',' ORDER BY n DESC, label) AS labels FROM c GROUP BY name), e AS (SELECT n.stack AS name, count(*) AS edges FROM edges e JOIN nodes n ON n.id = e.src GROUP BY n.stack)
SELECT p.name, coalesce(e.edges, 0)::BIGINT AS edges, coalesce(l.labels, '') AS labels FROM p LEFT JOIN e USING (name) LEFT JOIN l USING (name)""")
def project_totals(spark, sf):
    """The stacks as projects, and one without nodes."""
    nodes, edges = _graph(spark, sf)
    names = nodes.select(F.col("stack").alias("name")).distinct().unionByName(spark.createDataFrame([("none",)], "name string"))
    of = edges.join(nodes.select(F.col("id").alias("src"), F.col("stack").alias("project")), "src")
    got = views.project_totals(views.list_projects(names, nodes.withColumn("project", F.col("stack")), of))
    return got.select("name", "edges", F.array_join(F.transform("labels", lambda x: F.concat_ws("=", x["label"], x["n"].cast("string"))), ",").alias("labels"))


# The query language on the graph

def _cypher(name: str, text: str, sql: str | None, **params):
    def run(spark, sf):
        return cypher.run(spark, *(_walked if "*]" in text or ".." in text else _graph)(spark, sf), text, **params)

    run.__name__ = name
    query(sql)(run)


_cypher("cypher_filter_order", "MATCH (n:nation) WHERE n.name CONTAINS 'A' AND NOT n.id ENDS WITH '1' RETURN n.id AS id, toLower(n.name) AS name ORDER BY name, id SKIP 1 LIMIT 5",
        f"WITH {CTE} SELECT id, lower(name) AS name FROM nodes WHERE label = 'nation' AND contains(name, 'A') AND NOT ends_with(id, '1') ORDER BY lower(name), id OFFSET 1 LIMIT 5")
_cypher("cypher_count_hops", "MATCH (c:customer)-[:IN_NATION]->(n:nation)-[:IN_REGION]->(r:region {name: $r}) RETURN n.name AS nation, count(*) AS customers", 
        f"WITH {CTE} SELECT n.name AS nation, count(*)::BIGINT AS customers FROM edges a JOIN nodes n ON n.id = a.dst AND n.label = 'nation' JOIN edges b ON b.src = n.id AND b.type = 'IN_REGION' JOIN nodes r ON r.id = b.dst WHERE a.type = 'IN_NATION' AND starts_with(a.src, 'customer') AND r.name = 'ASIA' GROUP BY n.name", r="ASIA")
_cypher("cypher_optional_coalesce", "MATCH (c:customer) OPTIONAL MATCH (o:order)-[:PLACED_BY]->(c) WHERE o.name = 'F' RETURN c.id AS id, count(o) AS orders, CASE WHEN count(o) > 10 THEN 'many' ELSE 'few' END AS size",
        f"WITH {CTE} SELECT c.id, count(o.id)::BIGINT AS orders, CASE WHEN count(o.id) > 10 THEN 'many' ELSE 'few' END AS size FROM nodes c LEFT JOIN (SELECT o.id, e.dst FROM nodes o JOIN edges e ON e.src = o.id AND e.type = 'PLACED_BY' WHERE o.name = 'F') o ON o.dst = c.id WHERE c.label = 'customer' GROUP BY c.id")
_cypher("cypher_var_length", "MATCH (r:region {id: 'region:1'})<-[:IN_REGION|IN_NATION*1..2]-(x) RETURN x.label AS label, count(DISTINCT x.id) AS n",
        f"WITH {CTE}, w AS (SELECT src FROM edges WHERE dst = 'region:1' UNION SELECT b.src FROM edges a JOIN edges b ON b.dst = a.src AND b.type = 'IN_NATION' WHERE a.dst = 'region:1') SELECT n.label, count(*)::BIGINT AS n FROM w JOIN nodes n ON n.id = w.src GROUP BY n.label")
_cypher("cypher_not_exists", "MATCH (c:customer) WHERE NOT (:order {name: 'P'})-[:PLACED_BY]->(c) RETURN c.id AS id",
        f"WITH {CTE} SELECT id FROM nodes c WHERE label = 'customer' AND NOT EXISTS (SELECT 1 FROM edges e JOIN nodes o ON o.id = e.src WHERE e.type = 'PLACED_BY' AND o.name = 'P' AND e.dst = c.id)")
_cypher("cypher_pattern_or", "MATCH (p:part) WHERE (p)-[:SUPPLIED_BY]->(:supplier {id: 'supplier:3'}) OR NOT (EXISTS { (o:order)-[:CONTAINS]->(p) WHERE o.name = 'O' } AND p.name CONTAINS 'a') RETURN p.id AS id, EXISTS { (p)-[:SUPPLIED_BY]->() } AS supplied",
        f"""WITH {CTE} SELECT id, id IN (SELECT src FROM edges WHERE type = 'SUPPLIED_BY') AS supplied FROM nodes WHERE label = 'part' AND (id IN (SELECT src FROM edges WHERE type = 'SUPPLIED_BY' AND dst = 'supplier:3')
  OR NOT (id IN (SELECT e.dst FROM edges e JOIN nodes o ON o.id = e.src WHERE e.type = 'CONTAINS' AND o.name = 'O') AND contains(name, 'a')))""")
_cypher("cypher_count_block", "MATCH (s:supplier) WHERE COUNT { (s)<-[:SUPPLIED_BY]-(p) } % 2 = 0 OR COUNT { (s)-[:IN_NATION]->(n) WHERE n.name STARTS WITH 'A' } = 1 RETURN s.id AS id, COUNT { (s)<-[:SUPPLIED_BY]-(:part)<-[:CONTAINS]-(o:order) } AS orders",
        f"""WITH {CTE}, parts AS (SELECT dst AS id, count(*) AS k FROM edges WHERE type = 'SUPPLIED_BY' GROUP BY dst), sold AS (SELECT a.dst AS id, count(*) AS k FROM edges a JOIN edges b ON b.dst = a.src AND b.type = 'CONTAINS' WHERE a.type = 'SUPPLIED_BY' GROUP BY a.dst)
  SELECT s.id, coalesce(sold.k, 0)::BIGINT AS orders FROM nodes s LEFT JOIN parts ON parts.id = s.id LEFT JOIN sold ON sold.id = s.id WHERE s.label = 'supplier'
  AND (coalesce(parts.k, 0) % 2 = 0 OR s.id IN (SELECT e.src FROM edges e JOIN nodes n ON n.id = e.dst WHERE e.type = 'IN_NATION' AND starts_with(n.name, 'A')))""")
_cypher("cypher_label_alternation", "MATCH (x:customer or supplier)-[:IN_NATION]->(n:nation|region) WHERE n:nation AND NOT x:region RETURN x.label AS label, n.name AS nation, count(*) AS k",
        f"WITH {CTE} SELECT x.label, n.name AS nation, count(*)::BIGINT AS k FROM edges e JOIN nodes x ON x.id = e.src JOIN nodes n ON n.id = e.dst WHERE e.type = 'IN_NATION' GROUP BY ALL")
_cypher("cypher_unbounded", "MATCH (r:region {id: 'region:1'})<-[*]-(x) RETURN x.label AS label, count(DISTINCT x.id) AS n, min(x.id) AS first",
        f"WITH RECURSIVE {CTE}, w(id) AS (SELECT src FROM edges WHERE dst = 'region:1' UNION SELECT e.src FROM w JOIN edges e ON e.dst = w.id) SELECT n.label, count(*)::BIGINT AS n, min(n.id) AS first FROM w JOIN nodes n ON n.id = w.id GROUP BY n.label")
_cypher("cypher_unbounded_trails", "MATCH (p:part)-[:SUPPLIED_BY|IN_NATION|IN_REGION*2..]->(x) WHERE p.name CONTAINS 'e' RETURN p.id AS id, x.id AS other, count(*) AS trails",
        f"""WITH RECURSIVE {CTE}, steps AS (SELECT src, dst FROM edges WHERE type IN ('SUPPLIED_BY', 'IN_NATION', 'IN_REGION')), w(id, last, k) AS (SELECT id, id, 0 FROM nodes WHERE label = 'part' AND contains(name, 'e') UNION ALL SELECT w.id, s.dst, k + 1 FROM w JOIN steps s ON s.src = w.last)
  SELECT id, last AS other, count(*)::BIGINT AS trails FROM w WHERE k >= 2 GROUP BY 1, 2""")


def _shortest_sql(steps: int) -> str:
    """Levels of a search from every part to the regions: the least node before wins."""
    parts = ["l0 AS (SELECT id AS a, id AS b, NULL AS p FROM nodes WHERE label = 'part')"]
    for k in range(1, steps + 1):
        seen = " UNION ALL ".join(f"SELECT a, b FROM l{i}" for i in range(k))
        parts.append(f"l{k} AS (SELECT l.a, e.dst AS b, min(l.b) AS p FROM l{k - 1} l JOIN edges e ON e.src = l.b AND e.type IN ('SUPPLIED_BY', 'IN_NATION', 'IN_REGION') WHERE (l.a, e.dst) NOT IN ({seen}) GROUP BY 1, 2)")
    walks = []
    for k in range(1, steps + 1):
        joins = " ".join(f"JOIN l{i} ON l{i}.a = l{k}.a AND l{i}.b = l{i + 1}.p" for i in range(k - 1, -1, -1))
        ids = ", ".join(f"l{i}.b" for i in range(k + 1))
        walks.append(f"SELECT l{k}.a AS id, l{k}.b AS region, {k}::INT AS hops, array_to_string([{ids}], ' ') AS way FROM l{k} {joins} WHERE l{k}.b LIKE 'region:%'")
    return f"WITH {CTE}, {', '.join(parts)} {' UNION ALL '.join(walks)}"


@query(_shortest_sql(4))
def cypher_shortest_path(spark, sf):
    text = "MATCH w = shortestPath((p:part)-[:SUPPLIED_BY|IN_NATION|IN_REGION*]->(r:region)) RETURN p.id AS id, r.id AS region, length(w) AS hops, [n IN nodes(w) | n.id] AS way"
    return cypher.run(spark, *_walked(spark, sf), text).withColumn("way", F.array_join("way", " "))


_cypher("cypher_with_unwind", "MATCH (s:supplier)-[:IN_NATION]->(n) WITH n, collect(DISTINCT s.id) AS ids, count(*) AS k WHERE k >= 2 UNWIND ids AS id RETURN n.name AS nation, id, k",
        f"WITH {CTE}, g AS (SELECT n.name, list(DISTINCT e.src) AS ids, count(*)::BIGINT AS k FROM edges e JOIN nodes n ON n.id = e.dst WHERE e.type = 'IN_NATION' AND starts_with(e.src, 'supplier') GROUP BY n.id, n.name HAVING count(*) >= 2) SELECT name AS nation, unnest(ids) AS id, k FROM g")
_cypher("cypher_union", "MATCH (n:nation) WHERE n.name STARTS WITH 'A' RETURN n.name AS x UNION MATCH (r:region) RETURN r.name AS x",
        f"WITH {CTE} SELECT name AS x FROM nodes WHERE label = 'nation' AND starts_with(name, 'A') UNION SELECT name FROM nodes WHERE label = 'region'")
_cypher("cypher_undirected", "MATCH (n:nation {id: 'nation:4'})-[r]-(m) RETURN type(r) AS t, m.label AS label, count(*) AS k",
        f"WITH {CTE} SELECT t, n.label, count(*)::BIGINT AS k FROM (SELECT type AS t, dst AS m FROM edges WHERE src = 'nation:4' UNION ALL SELECT type, src FROM edges WHERE dst = 'nation:4') JOIN nodes n ON n.id = m GROUP BY t, n.label")
_cypher("cypher_aggregates", "MATCH (n) RETURN n.label AS label, min(n.id) AS first, max(size(n.name)) AS longest, avg(size(n.name)) AS mean",
        f"WITH {CTE} SELECT label, min(id) AS first, max(length(name))::INT AS longest, avg(length(name)) AS mean FROM nodes GROUP BY label")
_cypher("cypher_list_ops", "MATCH (n:nation) WITH n.id AS id, size(n.name) AS x WHERE x % 2 = 0 OR x IN [5] RETURN id, x, [y IN [x, x + 1, x * 2] WHERE y > 8 | y * 10][0] AS first, reduce(s = 0, y IN [x, x] | s + y) AS twice",
        f"WITH {CTE} SELECT id, x::INT AS x, (CASE WHEN x > 8 THEN x * 10 WHEN x + 1 > 8 THEN (x + 1) * 10 WHEN x * 2 > 8 THEN x * 20 END)::INT AS first, (2 * x)::BIGINT AS twice FROM (SELECT id, length(name) AS x FROM nodes WHERE label = 'nation') WHERE x % 2 = 0 OR x = 5")


# Sources on texts made from the tables


def _files(rows: DataFrame, path, text) -> DataFrame:
    return rows.select(path.alias("filePath"), text.alias("text"))


@query("""SELECT p_partkey || '/pom.xml' AS "filePath", 'org.' || lower(p_name) AS "groupId", p_brand AS "artifactId", CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size::VARCHAR END AS version, CASE WHEN p_partkey % 2 = 0 THEN 'test' END AS scope FROM part""")
def maven_dependencies(spark, sf):
    """A pom for every part: its own dependency beside managed and commented ones."""
    p = table(spark, sf, "part")
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>"))
    own = F.concat(tag("groupId", F.concat(F.lit("org."), F.lower("p_name"))), F.lit("\n  "), tag("artifactId", F.col("p_brand")), F.when(F.col("p_partkey") % 3 == 0, "").otherwise(tag("version", F.col("p_size").cast("string"))), F.when(F.col("p_partkey") % 2 == 0, tag("scope", F.lit("test"))).otherwise(""))
    other = "<dependencyManagement><dependencies><dependency><groupId>m</groupId><artifactId>x</artifactId></dependency></dependencies></dependencyManagement><!-- <dependency><groupId>c</groupId><artifactId>y</artifactId></dependency> -->"
    text = F.concat(F.lit(f"<project>{other}<dependencies><dependency>"), own, F.lit("</dependency></dependencies></project>"))
    return file_source.pom_dependencies(_files(p, F.concat(F.col("p_partkey").cast("string"), F.lit("/pom.xml")), text))


@query("""SELECT s_suppkey || '/docker-compose.yml' AS "filePath", x.name, CASE WHEN x.name = 'db' THEN 'postgres:' || s_nationkey ELSE '' END AS image, CASE WHEN x.name = 'db' THEN 'c' || s_suppkey ELSE '' END AS container,
  CASE WHEN x.name = 'db' THEN (5400 + s_nationkey) || ':5432,' || s_suppkey ELSE '' END AS ports, CASE WHEN x.name = 'db' THEN '' WHEN s_suppkey % 2 = 0 THEN 'db,q' ELSE 'db' END AS depends FROM supplier, (VALUES ('db'), ('api')) x(name)""")
def compose_rows(spark, sf):
    """A compose file for every supplier, in block and in flow form."""
    s = table(spark, sf, "supplier")
    n, k = F.col("s_nationkey").cast("string"), F.col("s_suppkey").cast("string")
    needs = F.when(F.col("s_suppkey") % 2 == 0, "    depends_on: [db, 'q']").otherwise("    depends_on:\n      db:\n        condition: up")
    text = F.concat(F.lit("version: 3\nservices:\n  db:  # one\n    image: postgres:"), n, F.lit("\n    container_name: \"c"), k, F.lit("\"\n    ports:\n    - "), (F.lit(5400) + F.col("s_nationkey")).cast("string"), F.lit(":5432\n    - "), k, F.lit("\n  api:\n"), needs, F.lit("\n"))
    got = file_source.compose_services(_files(s, F.concat(k, F.lit("/docker-compose.yml")), text))
    return got.withColumn("ports", F.array_join("ports", ",")).withColumn("depends", F.array_join("depends", ","))


@query("""SELECT p_partkey || '/k8s.yaml' AS "filePath", x.doc, x.kind, CASE WHEN x.doc = 0 THEN p_brand ELSE 'unnamed' END AS name, CASE WHEN x.doc = 0 THEN lower(p_brand) || ':' || p_size ELSE '' END AS image FROM part, (VALUES (0, 'Deployment'), (2, 'Service')) x(doc, kind)""")
def manifest_rows(spark, sf):
    """A manifest file of three documents for every part."""
    p = table(spark, sf, "part")
    text = F.concat(F.lit("kind: Deployment\nmetadata: {name: "), F.col("p_brand"), F.lit("}\nspec:\n  template:\n    spec:\n      containers:\n        - name: a\n          image: "), F.lower("p_brand"), F.lit(":"), F.col("p_size").cast("string"), F.lit("\n---\nkind: ConfigMap\n---\nkind: Service\n"))
    return file_source.k8s_objects(_files(p, F.concat(F.col("p_partkey").cast("string"), F.lit("/k8s.yaml")), text))


@query("""SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'postgresql' WHEN 1 THEN 'h2' WHEN 2 THEN 'sqlserver' ELSE 'mysql' END AS vendor, CASE c_custkey % 4 WHEN 1 THEN '' ELSE 'h' || c_nationkey END AS host,
  CASE c_custkey % 4 WHEN 0 THEN (5000 + c_nationkey)::VARCHAR WHEN 2 THEN '1433' ELSE '' END AS port, lower(c_mktsegment) || c_custkey AS dbname, 'app' || c_custkey AS application FROM customer""")
def datasource_rows(spark, sf):
    """Settings of every customer's application, half of them as properties, and their urls' parts."""
    c = table(spark, sf, "customer")
    k, n = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    db = F.concat(F.lower("c_mktsegment"), k)
    url = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("${DB:jdbc:postgresql://h"), n, F.lit(":"), (F.lit(5000) + F.col("c_nationkey")).cast("string"), F.lit("/"), db, F.lit("?ssl=true}"))).when(F.col("c_custkey") % 4 == 1, F.concat(F.lit("jdbc:h2:mem:"), db, F.lit(";MODE=x")))
    url = url.when(F.col("c_custkey") % 4 == 2, F.concat(F.lit("jdbc:sqlserver://h"), n, F.lit(":1433;databaseName="), db)).otherwise(F.concat(F.lit("jdbc:mysql://u@h"), n, F.lit(",other/"), db))
    yml = F.concat(F.lit("spring:\n  application:\n    name: app"), k, F.lit("\n  datasource: {url: \""), url, F.lit("\", username: u}\n"))
    plain = F.concat(F.lit("# x\nspring.application.name = app"), k, F.lit("\nspring.datasource.url="), url, F.lit("\n"))
    even = F.col("c_custkey") % 8 < 4
    got = file_source.application_settings(_files(c, F.concat(k, F.lit("/application"), F.when(even, ".yml").otherwise(".properties")), F.when(even, yml).otherwise(plain)))
    parts = derive.jdbc_parts(derive.resolve_placeholders(F.col("url")))
    return got.select(F.substring_index("filePath", "/", 1).cast("long").alias("id"), parts.alias("p"), "application").select("id", "p.*", "application")


# What references, routes and expressions stand for

_PAGE = "regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) AS origin, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[A-Za-z]+://[^/?#]*', '') AS path"


@query(f"""WITH p AS (SELECT page_id, html, {_PAGE}, url FROM pages), d AS (SELECT *, list_filter(string_split(path, '/')[:-2], lambda x: x <> '') AS dir FROM p),
h AS (SELECT DISTINCT page_id, origin, dir, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS h FROM d)
SELECT page_id, h AS reference, origin || h AS target FROM h
UNION ALL SELECT page_id, '.' || h, origin || '/' || array_to_string(list_concat(dir, [h[2:]]), '/') FROM h
UNION ALL SELECT page_id, '..' || h, origin || '/' || array_to_string(list_concat(dir[:-2], [h[2:]]), '/') FROM h""")
def href_targets(spark, sf):
    """Every reference of every page, as it is and made relative, against its page's url."""
    p = table(spark, sf, "pages").select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1)).alias("h")).distinct()
    r = p.select("page_id", "url", F.explode(F.array("h", F.concat(F.lit("."), "h"), F.concat(F.lit(".."), "h"))).alias("reference"))
    return r.select("page_id", "reference", paths.resolved_url(F.col("url"), F.col("reference")).alias("target"))


@query(rf"""WITH p AS (SELECT page_id, string_split(path, '/')[2] AS lang, regexp_extract(path, '^/[^/]*/(\d+)', 1) AS n, CASE WHEN ends_with(path, '.html') THEN regexp_replace(path, '\.html$', '.ts') WHEN ends_with(path, '/') THEN path || 'index.ts' ELSE path END AS f FROM (SELECT page_id, {_PAGE} FROM pages)),
c AS (SELECT page_id, x.k, CASE x.k WHEN 1 THEN '/' || lang || '/' || n WHEN 2 THEN '/' || lang || '/' || n || '.ts' ELSE '/' || lang || '/' || n || '/index.ts' END AS f FROM p, (VALUES (1), (2), (3)) x(k))
SELECT c.page_id AS ref, min_by(c.f, k) AS "filePath" FROM c WHERE f IN (SELECT f FROM p) GROUP BY c.page_id""")
def page_specifiers(spark, sf):
    """Pages as modules: each one's specifier, relative or by an alias, and the file it means."""
    path = F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), r"^[A-Za-z]+://[^/?#]*", "")
    p = table(spark, sf, "pages").select("page_id", path.alias("path"))
    lang, n = F.regexp_extract("path", "^/([^/]*)", 1), F.regexp_extract("path", r"^/[^/]*/(\d+)", 1)
    name = F.when(F.col("path").endswith(".html"), F.regexp_replace("path", r"\.html$", ".ts")).when(F.col("path").endswith("/"), F.concat("path", F.lit("index.ts"))).otherwise(F.col("path"))
    spec = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("./../x/../"), lang, F.lit("/"), n)).otherwise(F.concat(F.lit("@pages/"), lang, F.lit("/./"), n))
    refs = p.select(F.col("page_id").alias("ref"), F.concat(F.lit("/"), lang, F.lit("/from")).alias("fromFile"), spec.alias("spec"))
    return resolve.specifiers(refs, p.select(name.alias("filePath")).distinct(), spark.createDataFrame([("@pages/", "/"), ("@", "/none/")], "prefix string, target string"))


@query("""WITH t AS (SELECT 'r' || r_regionkey AS id, r_name AS path, r_regionkey AS ord FROM region UNION ALL SELECT 'n' || n_nationkey, r_name || '/' || n_name, n_nationkey FROM nation JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT 'c' || c_custkey, r_name || '/' || n_name || '/' || lower(c_mktsegment), c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT 'o' || o_orderkey, r_name || '/' || n_name || '/' || lower(c_mktsegment) || '/' || o_orderkey, o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
k AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ord, id) AS n FROM t)
SELECT id, path, 'route:' || path || CASE WHEN n > 1 THEN '#' || n ELSE '' END AS fqn, CASE WHEN id LIKE 'o%' AND ord % 10 = 0 THEN (SELECT x.id FROM k x WHERE x.n = 1 AND x.path = regexp_replace(k.path, '/[^/]*$', '')) END AS target FROM k""")
def route_paths(spark, sf):
    """Orders below customers, nations and regions as routes; every tenth redirects to its parent's path."""
    t = lambda name: table(spark, sf, name)
    row = lambda df, a, key, up, b, seg, to=F.lit(None): df.select(F.concat(F.lit(a), F.col(key).cast("string")).alias("id"), (F.concat(F.lit(up), F.col(b).cast("string")) if b else F.lit(None).cast("string")).alias("parent"), F.col(key).cast("long").alias("ord"), seg.cast("string").alias("segment"), to.cast("string").alias("redirect"))
    routes = row(t("region"), "r", "r_regionkey", "", "", F.col("r_name")).unionByName(row(t("nation"), "n", "n_nationkey", "r", "n_regionkey", F.concat(F.lit("/"), "n_name")))
    routes = routes.unionByName(row(t("customer"), "c", "c_custkey", "n", "c_nationkey", F.lower("c_mktsegment"))).unionByName(row(t("orders"), "o", "o_orderkey", "c", "o_custkey", F.col("o_orderkey"), F.when(F.col("o_orderkey") % 10 == 0, "./x/..")))
    return resolve.route_tree(routes).select("id", "path", "fqn", "target")


def _folded_sql(depth: int) -> str:
    """Values of all expressions by the depth left: v0 knows texts alone."""
    base = "SELECT page_id AS i, '/' || regexp_extract(url, '^[a-z]+://[^/]*/([^/?#]*)', 1) AS t, page_id % 5 = 4 AS unknown, page_id // 3 AS up FROM pages"
    parts = [f"p AS ({base})", "v0 AS (SELECT i, NULL::VARCHAR AS v FROM p)"]
    for k in range(1, depth + 1):
        # a page's expression joins what the page a third as far stands for with a text of its own; every fifth names nothing
        parts.append(f"v{k} AS (SELECT p.i, CASE WHEN unknown THEN NULL ELSE coalesce(u.v, '{{*}}') || t END AS v FROM p LEFT JOIN v{k - 2 if k >= 2 else 0} u ON u.i = p.up AND p.i > 2 AND {k} >= 2)")
    return f"WITH {', '.join(parts)} SELECT i AS page_id, v AS value FROM v{depth}"


@query(_folded_sql(8))
def folded_urls(spark, sf):
    """Expressions as long as chains of pages: each is what another stands for and a text."""
    p = table(spark, sf, "pages").select("page_id", F.concat(F.lit("/"), F.regexp_extract("url", r"^[a-z]+://[^/]*/([^/?#]*)", 1)).alias("t"))
    i = F.col("page_id")
    made = F.array(
        F.struct((i * 3).alias("id"), F.when(i % 5 == 4, "name").otherwise("join").alias("op"), F.lit("").alias("text")), F.struct((i * 3 + 1).alias("id"), F.lit("text").alias("op"), F.col("t").alias("text")),
        F.struct((i * 3 + 2).alias("id"), F.lit("name").alias("op"), F.lit("base").alias("text")),
    )
    nodes = p.select(F.explode(made).alias("n")).select("n.*")
    up = F.when(i > 2, F.floor(i / 3) * 3).otherwise(-1)
    links = F.array(F.struct((i * 3).alias("id"), F.lit(0).alias("ord"), (i * 3 + 2).alias("part")), F.struct((i * 3).alias("id"), F.lit(1).alias("ord"), (i * 3 + 1).alias("part")), F.struct((i * 3 + 2).alias("id"), F.lit(0).alias("ord"), up.alias("part")))
    parts = p.select(i.alias("page"), F.explode(links).alias("l")).select("page", "l.*").where("not (page % 5 = 4 and id = page * 3)").drop("page")
    return resolve.folded_expressions(nodes, parts).where("id % 3 = 0").select((F.col("id") / 3).cast("long").alias("page_id"), "value")


@query()
def element_parents(spark, sf):
    """How often each element stands in which, over all pages."""
    e = table(spark, sf, "pages").select(F.explode(resolve.element_parents(F.col("html"))).alias("e"))
    return e.groupBy(F.col("e.name").alias("name"), F.col("e.parent_name").alias("parent")).agg(F.count("*").alias("n"))
