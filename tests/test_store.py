"""Versioned saves: load, change and save in one folder; crashes; conflicts."""

import pytest
from pyspark.sql import functions as F
from test_graph import smoke

from graphloom.api import Graph
from graphloom.plans.ontology import EDGES, NODES
from graphloom.sources import documents
from graphloom.sources.store import Conflict, Manifests


def _graph(spark, n, project="p"):
    nodes = spark.createDataFrame([{"project": project, "id": f"n{i}", "label": "Class", "name": f"name {i}", "props": {"b": "1", "a": str(i)}, "arr_props": {"x": ["y"]}} for i in range(n)], NODES)
    edges = spark.createDataFrame([{"project": project, "src": f"n{i}", "type": "CALLS", "dst": f"n{i + 1}"} for i in range(n - 1)], EDGES)
    return Graph(nodes, edges)


def _files(path, version=None):
    return documents.graph_store(path[0], path[1]).live["tables"]


def test_load_link_ingest_save_in_one_folder(spark, tmp_path):
    smoke(spark, tmp_path)
    path = str(tmp_path / "graph")
    g, _ = Graph.empty(spark).ingest([str(tmp_path / "java.json")], "__smoke__", "java")
    assert g.save(path)["nodes"] == {"insert": 8, "update": 0, "delete": 0}
    g, _ = Graph.load(spark, path).ingest([str(tmp_path / "ng.json")], "__smoke__", "angular")
    g.save(path)
    g, linked = Graph.load(spark, path).run_linker("__smoke__")
    assert g.save(path)["edges"]["insert"] == 2 == linked.first().linked
    back = Graph.load(spark, path)
    assert (back.nodes.count(), back.edges.count(), back.projects.count()) == (14, 11, 1)
    again, stats = back.ingest([str(tmp_path / "java.json")], "__smoke__", "java")
    assert stats.first().staleRemoved == 0
    again, _ = again.run_linker("__smoke__")
    changed = again.save(path)
    assert not any(changed["nodes"].values()) and not any(changed["edges"].values())
    assert Graph.load(spark, path).nodes.count() == 14


def test_buckets_without_a_change_keep_their_files(spark, tmp_path):
    path = str(tmp_path / "g")
    g = _graph(spark, 200)
    g.save(path)
    before = _files((spark, path))
    assert len(before["nodes"]) == 16
    g = Graph.load(spark, path)
    n = g.nodes.replace("name 7", "renamed", ["name"])
    assert Graph(n, g.edges, g.projects).save(path)["nodes"] == {"insert": 0, "update": 1, "delete": 0}
    after = _files((spark, path))
    assert sum(before["nodes"][k] != after["nodes"][k] for k in before["nodes"]) == 1 and before["edges"] == after["edges"]
    assert Graph.load(spark, path).nodes.where("name = 'renamed'").count() == 1
    _graph(spark, 3, "other/ö ~").save(str(tmp_path / "h"))
    assert documents.load_graph(spark, str(tmp_path / "h"), "other/ö ~")[0].count() == 3


def test_projects_of_one_save_leave_the_others(spark, tmp_path):
    path = str(tmp_path / "g")
    for p in ("a", "b c", None):
        g = _graph(spark, 5, p)
        documents.save_graph(g.nodes, g.edges, path, only=p) if p else documents.save_graph(g.nodes.unionByName(Graph.load(spark, path).nodes), Graph.load(spark, path).edges, path)
    assert documents.load_graph(spark, path)[0].count() == 15
    g = _graph(spark, 2, "b c")
    stats = documents.save_graph(g.nodes, g.edges, path, only="b c")
    assert stats["nodes"] == {"insert": 0, "update": 0, "delete": 3} and documents.load_graph(spark, path, "a")[1].count() == 4
    assert documents.load_graph(spark, path)[0].count() == 12


def test_a_crash_leaves_the_old_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "g")
    _graph(spark, 20).save(path)

    def dies(self, version, content):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(Manifests, "publish", dies)
        with pytest.raises(KeyboardInterrupt):
            _graph(spark, 30).save(path)
    back = Graph.load(spark, path)
    assert (back.nodes.count(), back.edges.count()) == (20, 19)
    _graph(spark, 30).save(path)
    assert Graph.load(spark, path).nodes.count() == 30 and back.nodes.count() == 20, "the version before stays readable"
    store = documents.graph_store(spark, path)
    assert store.vacuum(keep=1) > 0 and Graph.load(spark, path).edges.count() == 29


def test_two_commits_from_one_version(spark, tmp_path):
    path = str(tmp_path / "g")
    _graph(spark, 4).save(path)
    one, two = documents.graph_store(spark, path), documents.graph_store(spark, path)
    one.commit({"nodes": _graph(spark, 5).nodes})
    with pytest.raises(Conflict):
        two.commit({"nodes": _graph(spark, 6).nodes})
    assert Graph.load(spark, path).nodes.count() == 5


def test_empty_graph(spark, tmp_path):
    path = str(tmp_path / "g")
    Graph.empty(spark).save(path)
    assert Graph.load(spark, path).nodes.count() == 0
    _graph(spark, 2).save(path)
    Graph.empty(spark).save(path)
    assert Graph.load(spark, path).edges.count() == 0


def test_export_reads_back_equal_and_the_same(spark, tmp_path):
    g = _graph(spark, 50)
    texts = []
    for run in ("a", "b"):
        g.export(str(tmp_path / run), size=9)
        texts.append(sorted(f.read_text() for f in (tmp_path / run).glob("*.json")))
    assert texts[0] == texts[1] and len(texts[0]) > 1
    g = Graph(g.nodes.fillna("java", "stack").withColumn("stack", F.lit("java")), g.edges)
    g.export(str(tmp_path / "c"), size=9)
    back, stats = Graph.empty(spark).ingest([str(tmp_path / "c")], "p", "java")
    keep = ["id", "label", "name", "props", "arr_props"]
    rows = lambda df: sorted((r.id, r.label, r.name, sorted(r.props.items()), sorted(r.arr_props.items())) for r in df.select(*keep).collect())
    assert rows(back.nodes) == rows(g.nodes) and stats.first().edges == 49
    assert {(r.src, r.dst) for r in back.edges.collect()} == {(r.src, r.dst) for r in g.edges.collect()}


def test_scenarios_and_communities_are_saved(spark, tmp_path):
    def node(i, label, name, **props):
        return {"project": "p", "id": i, "label": label, "name": name, "stack": "angular", "props": props}

    nodes = [node("r", "Route", "orders", routePath="orders"), node("c", "Component", "List"), node("m", "Method", "load"), node("a", "ApiCall", "GET", httpMethod="GET", path="/o"), node("e", "Endpoint", "GET /o", httpMethod="GET", path="/o")]
    edges = [("r", "NAVIGATES_TO", "c"), ("c", "DECLARES", "m"), ("m", "MAKES_CALL", "a"), ("a", "INVOKES_API", "e")]
    g = Graph(spark.createDataFrame(nodes, NODES), spark.createDataFrame([{"project": "p", "src": s, "type": t, "dst": d} for s, t, d in edges], EDGES))
    path = str(tmp_path / "g")
    g.save_scenarios("p").save_communities("p").save(path)
    back = Graph.load(spark, path)
    s = back.list_scenarios("p").first()
    assert (s.id, s.title, s.routePath, s.covered) == ("system:scenario:p:orders", "Screen: /orders", "orders", 4) and s.steps[0].startswith("Route")
    again = back.save_scenarios("p").save(path)
    assert not any(again["nodes"].values()) and not any(again["edges"].values())


def test_results_are_merged_key_by_key(spark):
    from graphloom.operators import views

    old = spark.createDataFrame([("1", "a", {"x": "1", "y": "2"}), ("2", "b", None)], "id string, name string, props map<string,string>")
    new = spark.createDataFrame([("1", None, {"y": "3"}, 7), ("3", "c", {}, 8)], "id string, name string, props map<string,string>, distance int")
    assert sorted(tuple(r) for r in views.merged(old, new).collect()) == [("1", "a", {"x": "1", "y": "3"}, 7), ("2", "b", None, None), ("3", "c", {}, 8)]
