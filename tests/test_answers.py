import json
import random

import pytest
from pyspark.sql import functions as F
from test_graph import edges_of, nodes_of, smoke

from graphloom.api import Graph
from graphloom.functions import replies
from graphloom.operators import community, order, sequence, traverse, views


@pytest.mark.parametrize("text,want", [
    ('{"a": 1}', 1), ('```json\n{"a": 2}\n```', 2), ('Here: {"a": 3, "b": {"c": 4}} and so on', 3), ("none", None), ("", None), (None, None), ('{"a": 5', None), ('{"a": 6} or {"a": 7}', None), ('{"a": 6}, {"a": 7}', None), ("[1, 2]", None), ('{"a":\n 8}', 8),
])
def test_replies(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(replies.reply(F.col("t"), "a int").alias("r"), replies.json_block(F.col("t")).alias("b")).first()
    assert (got.r and got.r.a) == want and (text is None) == (got.b is None)


def test_bare_answers_lose_their_fences(spark):
    df = spark.createDataFrame([("```json\n nothing \n```",)], "t string")
    assert df.select(replies.json_block(F.col("t"))).first()[0] == "nothing"


def test_numbered_equals_sorting(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "b", None]), r.randrange(40), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "t string, v int, id int").repartition(7)
    got = {x.id: x.number for x in order.numbered(df, ["t", F.desc("v"), "id"]).collect()}
    want = sorted(rows, key=lambda x: (x[0] is not None, x[0] or "", -x[1], x[2]))
    assert got == {x[2]: i for i, x in enumerate(want)}
    assert order.numbered(df.limit(0), ["t"]).count() == 0


def test_seeds_keep_their_order(spark):
    n = nodes_of(spark, [(i, "X") for i in "abcdef"])
    found = spark.createDataFrame([("e", ("b",)), ("c", ("zz",)), ("e", ("a",)), ("", (None,))], "id string, n struct<id:string>").coalesce(1)
    assert [x.id for x in traverse.resolve_seeds(n, ["d", "none", "c", "d"], found).orderBy("ord").collect()] == ["d", "c", "e", "b", "a"]
    assert traverse.resolve_seeds(n, [], found.select(F.lit(1).alias("k"))).count() == 0


def test_listings_and_what_is_said_of_them(spark):
    n = nodes_of(spark, [(f"n{i:03}", "Service") for i in range(90)]).withColumn("summary", F.when(F.col("id") == "n001", F.repeat(F.lit("x"), 200)))
    members = n.select("id", F.when(F.col("id") < "n080", 0).when(F.col("id") < "n088", 1).otherwise(2).alias("community"))
    rows = {x.community: x for x in community.community_listing(n, members).collect()}
    assert set(rows) == {0, 1} and rows[0].size == 80 and rows[1].size == 8
    lines = rows[0].listing.split("\n")
    assert len(lines) == 60 and lines[0] == "  - Service n000: " and lines[1] == "  - Service n001: " + "x" * 140
    answers = spark.createDataFrame([(0, 'Title: {"title": "Orders", "summary": "What is ordered"}'), (1, "no idea"), (2, "{}")], "community int, answer string")
    listing = community.community_listing(n, members)
    assert [tuple(x) for x in community.community_summaries(listing, answers).collect()] == [(0, 80, "Orders", "What is ordered")]
    unnamed = spark.createDataFrame([(1, "{}")], "community int, answer string")
    assert community.community_summaries(listing, unnamed).first().title == "community-1"


def test_a_caller_of_many_is_cut_before_the_walk(spark):
    calls = [("r", "CALLS", f"c{i:03}", {"line": str(i)}) for i in range(200)] + [("c000", "CALLS", "d", {"line": "1"})]
    n = nodes_of(spark, [("r", "Method"), ("d", "Method"), *[(f"c{i:03}", "Method") for i in range(200)]])
    roots = spark.createDataFrame([("r",)], "root string")
    for most, cut in ((60, True), (201, False), (200, True)):
        got = sequence.sequence(n, edges_of(spark, calls), roots, most).orderBy("step").collect()
        assert [x.callee for x in got] == ["c000", "d", *[f"c{i:03}" for i in range(1, 200)]][:most] and {x.truncated for x in got} == {cut}


def test_tools(spark, tmp_path):
    smoke(spark, tmp_path)
    g, stats = Graph.empty(spark).ingest([str(tmp_path / "java.json")], "__smoke__", "java")
    assert stats.first().warnings == 0
    one = lambda name, **a: [json.loads(x.json) for x in g.tool(name, "__smoke__", **a).collect()]
    hit = one("search_nodes", query="ordercontroller", limit=100)
    assert hit and set(hit[0]) <= {"id", "label", "name", "fqn", "stack", "filePath", "summary"} and None not in hit[0].values()
    detail = one("get_node", node_id="java:com.x.OrderController")[0]
    assert detail["node"]["label"] == "Controller" and 1 <= len(detail["neighbors"]) <= 60 and set(detail["neighbors"][0]) == {"rel", "dir", "id", "label", "name"}
    assert one("get_node", node_id="gone") == [{"error": "no such node"}]
    assert one("run_query", query="MATCH (c:Controller) RETURN count(c) AS n, null AS x") == [{"n": 1, "x": None}]
    path = g.nodes.where("id = 'java:com.x.OrderController'").first().filePath
    files = spark.createDataFrame([(path, "a\nb\n" + "c" * 9000)], "filePath string, text string")
    said = one("get_source", node_id="java:com.x.OrderController", files=files)[0]
    assert said["source"].split(": ")[0] == str(said["startLine"]) and len(said["source"]) <= 7000
    with pytest.raises(ValueError):
        g.tool("drop", "__smoke__")
    totals = views.project_totals(g.list_projects()).first()
    assert totals.edges == g.edges.count() and sum(x.n for x in totals.labels) == 8 and [x.n for x in totals.labels] == sorted((x.n for x in totals.labels), reverse=True)


def test_links_say_whether_a_model_judged(spark):
    from graphloom.operators import linker

    calls = spark.createDataFrame([("c1", "GET", "/a"), ("c2", "GET", "/zzz")], "id string, httpMethod string, path string")
    ends = spark.createDataFrame([("e1", "GET", "/a"), ("e2", "POST", "/q")], "id string, httpMethod string, path string")
    judge = lambda c, e: c.select("call", F.lit("e2").alias("endpoint"), F.lit(0.99).alias("confidence"))
    s = linker.link_stats(calls, ends, linker.link(calls, ends, judge)).first()
    assert (s.linked, s.exact, s.llm, s.llmUsed, s.unmatched) == (2, 1, 1, True, 0)
    assert linker.link_stats(calls, ends, linker.link(calls, ends)).first().llmUsed is False
