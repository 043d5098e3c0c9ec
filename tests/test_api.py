import pytest
from test_graph import smoke

from graphloom.api import Graph
from graphloom.sources import documents
from graphloom.streaming.ingest import follow


def test_surface(spark, tmp_path):
    smoke(spark, tmp_path)
    g, stats = Graph.empty(spark).ingest([str(tmp_path / "java.json")], "__smoke__", "java")
    assert stats.first().nodes == 8
    g, _ = g.ingest([str(tmp_path / "ng.json")], "__smoke__", "angular")
    g, linked = g.run_linker("__smoke__")
    assert linked.first().linked == 2
    g.save(str(tmp_path / "graph"))
    g = Graph(*documents.load_graph(spark, str(tmp_path / "graph")), g.projects)
    assert g.list_projects().count() == 1 and g.links("__smoke__")["links"].count() == 2
    assert g.query("MATCH (c:Controller)-[:EXPOSES]->(e) RETURN count(e) AS n").first().n == 2
    assert g.blast_radius(["java:com.x.OrderService"], depth=2).count() >= 1
    assert g.search("ordercontroller", "__smoke__").count() >= 1 and g.sequence("__smoke__", "java:com.x.OrderController#list()").count() == 1
    assert g.subgraph("__smoke__", node="java:com.x.OrderController")[0].count() >= 4 and g.node_by_path("__smoke__", "OrderController").count() == 1
    assert g.delete_project("__smoke__")[1].first().deleted == 14


def test_projects_keep_apart(spark, tmp_path):
    from graphloom.plans.ontology import EDGES, NODES

    node = lambda p, i: {"project": p, "id": i, "label": "Service", "name": i, "stack": "java"}
    nodes = spark.createDataFrame([node("p1", "a"), node("p1", "x"), node("p2", "a"), node("p2", "y"), node("p 3/ä", "only")], NODES)
    edge = lambda p, s, d: {"project": p, "src": s, "type": "CALLS", "dst": d}
    edges = spark.createDataFrame([edge("p1", "x", "a"), edge("p2", "y", "a")], EDGES)
    g = Graph(nodes, edges)
    assert sorted(r.id for r in g.impact("a", project="p1")[0].collect()) == ["a", "x"]
    with pytest.raises(ValueError):
        g.impact("a")
    assert [r.id for r in g.impact("only")[0].collect()] == ["only"]
    assert g.query("MATCH (n) RETURN count(n) AS n, avg(DISTINCT 2) AS m", project="p2").first() == (2, 2.0)
    path = str(tmp_path / "g")
    g.save(path)
    Graph.load(spark, path).delete_project("p2")[0].save(path)
    back = Graph.load(spark, path)
    assert sorted(r.id for r in back.nodes.collect()) == ["a", "only", "x"] and back.edges.count() == 1
    Graph(back.nodes, back.edges.limit(0)).save(path)
    assert Graph.load(spark, path).edges.count() == 0


def test_imports(spark):
    from graphloom.operators import derive

    f = spark.createDataFrame([("A.java", "import com.x.A;\nimport com.y.*;\nimport foo\n  import static org.z.B.c ;\n")], "filePath string, text string")
    assert sorted(r.name for r in derive.imports(f).collect()) == ["com.x.A", "org.z.B.c"]


def test_stream(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    smoke(spark, inbox)
    for _ in range(2):
        q = follow(spark, str(inbox), str(tmp_path / "g"), str(tmp_path / "cp"))
        q.awaitTermination(120)
        assert q.exception() is None
    nodes, edges = documents.load_graph(spark, str(tmp_path / "g"))
    assert nodes.count() == 14 and edges.count() == 9
