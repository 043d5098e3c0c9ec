"""Walks of any length, shortest paths, and predicates inside expressions, by brute force."""

import random
from collections import deque

import pytest

from graphloom.plans import cypher

NODES, EDGES = "id string, label string, name string", "src string, type string, dst string"


@pytest.fixture(scope="module")
def small(spark):
    rng = random.Random(6)
    ids = [f"v{i:02}" for i in range(24)]
    nodes = [(i, rng.choice("ABC"), i[-1]) for i in ids]
    edges = sorted({(rng.choice(ids), rng.choice("xy"), rng.choice(ids)) for _ in range(34)})
    chain = [(f"c{i:02}", "C" if i else "A", "c") for i in range(14)]
    edges += [(f"c{i:02}", "x", f"c{i + 1:02}") for i in range(13)]
    nodes += chain
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES), nodes, edges


def _run(spark, small, text, **how):
    return sorted(tuple(r) for r in cypher.run(spark, small[0], small[1], text, **how).collect())


def _steps(edges, both, types="xy"):
    out = {}
    for s, t, d in edges:
        if t in types:
            out.setdefault(s, []).append((d, (s, t, d)))
            if both and s != d:
                out.setdefault(d, []).append((s, (s, t, d)))
    return out


def _distance(edges, start, both=False, types="xy"):
    steps, seen, todo = _steps(edges, both, types), {start: 0}, deque([start])
    while todo:
        at = todo.popleft()
        for b, _ in steps.get(at, ()):
            if b not in seen:
                seen[b] = seen[at] + 1
                todo.append(b)
    return seen


def _trails(edges, start, lo, hi, both=False, types="xy"):
    steps, out = _steps(edges, both, types), []

    def walk(at, used):
        if len(used) >= lo:
            out.append((at, len(used)))
        if hi is None or len(used) < hi:
            for b, e in steps.get(at, ()):
                if e not in used:
                    walk(b, [*used, e])

    walk(start, [])
    return out


def test_unbounded_pairs_are_complete(spark, small):
    _, _, nodes, edges = small
    got = _run(spark, small, "MATCH (a:A)-[*]->(b) RETURN DISTINCT a.id AS a, b.id AS b")
    want = set()
    for i, label, _ in nodes:
        if label == "A":
            for b, _ in _steps(edges, False).get(i, ()):
                want |= {(i, x) for x in _distance(edges, b)}
    assert got == sorted(want) and ("c00", "c13") in want
    assert _run(spark, small, "MATCH (a {id: 'c00'})-[:x*0..]->(b) RETURN count(DISTINCT b) AS n") == [(14,)]
    assert _run(spark, small, "MATCH (a {id: 'c05'})<-[*..3]-(b) RETURN DISTINCT b.id AS b") == [("c02",), ("c03",), ("c04",)]
    assert _run(spark, small, "MATCH (a {id: 'c10'})-[*0..]-(b) RETURN count(DISTINCT b) AS n") == [(14,)]
    assert _run(spark, small, "MATCH (a:A) WHERE (a)-[:x*]->({id: 'c13'}) RETURN a.id AS a") == [("c00",)]


def test_trails_count_and_have_no_limit(spark, small):
    _, _, nodes, edges = small
    starts = [i for i, label, _ in nodes if label == "A" and i != "c00"]
    want = sorted((a, b) for a in starts for b, _ in _trails(edges, a, 1, 5, types="x"))
    assert [r for r in _run(spark, small, "MATCH (a:A)-[:x*..5]->(b) RETURN a.id AS a, b.id AS b") if r[0] != "c00"] == want
    assert _run(spark, small, "MATCH (a {id: 'c00'})-[r:x*9..]->(b) RETURN b.id AS b, size(r) AS n") == [(f"c{i:02}", i) for i in range(9, 14)]
    got = _run(spark, small, "MATCH (a {id: 'v03'})-[r:y*1..4]-(b) RETURN b.id AS b, size(r) AS n")
    assert got == sorted(_trails(edges, "v03", 1, 4, both=True, types="y"))
    assert _run(spark, small, "MATCH p = (b {name: 'c'})<-[*12..]-(a:A) RETURN [n IN nodes(p) | n.id][0] AS first, length(p) AS k, a.id AS a, b.id AS b") == [("c12", 12, "c00", "c12"), ("c13", 13, "c00", "c13")]


@pytest.mark.parametrize("both", [False, True])
def test_shortest_paths(spark, small, both):
    _, _, nodes, edges = small
    arrow = "-" if both else "->"
    got = _run(spark, small, f"MATCH p = shortestPath((a:A)-[*]{arrow}(b)) RETURN a.id AS a, b.id AS b, length(p) AS k, [n IN nodes(p) | n.id] AS way")
    want = {}
    for i, label, _ in nodes:
        if label == "A":
            want |= {(i, b): d for b, d in _distance(edges, i, both).items() if d}
    assert {r[:2]: r[2] for r in got} == want and len(got) == len(want)
    steps = {(a, b) for a, bs in _steps(edges, both).items() for b, _ in bs}
    for a, b, k, way in got:
        assert way[0] == a and way[-1] == b and len(way) == k + 1 and all((x, y) in steps for x, y in zip(way, way[1:], strict=False))
        # the least node before each, seen from the start
        assert all(x == min(y for y, d in _distance(edges, a, both).items() if d == at and (y, z) in steps) for at, (x, z) in enumerate(zip(way, way[1:], strict=False)))


def test_shortest_between_bound_nodes(spark, small):
    assert _run(spark, small, "MATCH (a {id: 'c03'}), (b {id: 'c09'}) MATCH p = shortestPath((a)-[:x*..9]->(b)) RETURN length(p) AS k, [r IN relationships(p) | r.dst][0] AS first") == [(6, "c04")]
    assert _run(spark, small, "MATCH p = shortestPath((a {id: 'c03'})-[*..5]->(b {id: 'c09'})) RETURN length(p) AS k") == []
    assert _run(spark, small, "MATCH (a {id: 'c03'}) OPTIONAL MATCH p = shortestPath((a)-[*]->(b {id: 'c01'})) RETURN a.id AS a, length(p) AS k") == [("c03", None)]
    with pytest.raises(cypher.CypherError):
        cypher.check_read_only("MATCH p = shortestPath((a)-->(b)) RETURN p")


def test_predicates_in_any_place(spark, small):
    _, _, nodes, edges = small
    out = {i: sum(s == i for s, _, _ in edges) for i, _, _ in nodes}
    into = {i: {t for _, t, d in edges if d == i} for i, _, _ in nodes}
    text = "MATCH (n) WHERE n.name = '3' OR (n)-[:x]->() XOR EXISTS { MATCH (m)-[:y]->(n) WHERE m.label <> n.label } RETURN n.id AS id, COUNT { (n)-->() } AS k, CASE WHEN (n)<-[:y]-() THEN 'y' ELSE '-' END AS c"
    label = {i: x for i, x, _ in nodes}
    want = []
    for i, _, name in nodes:
        x, y = any(s == i and t == "x" for s, t, _ in edges), any(d == i and t == "y" and label[s] != label[i] for s, t, d in edges)
        if name == "3" or x != y:
            want.append((i, out[i], "y" if "y" in into[i] else "-"))
    assert _run(spark, small, text) == sorted(want)
    got = _run(spark, small, "MATCH (n:A or B) WHERE NOT (n:B AND COUNT { (n)-->(:B) } > 0) RETURN n.label AS label, sum(COUNT { (n)-[:x]->(), (n)-[:y]->() }) AS k, count(*) AS n")
    has_b = {s for s, _, d in edges if label[d] == "B"}
    kept = [i for i, x, _ in nodes if x == "A" or x == "B" and i not in has_b]
    both = {i: sum(s == i and t == "x" for s, t, _ in edges) * sum(s == i and t == "y" for s, t, _ in edges) for i in kept}
    assert got == sorted((x, sum(both[i] for i in kept if label[i] == x), sum(label[i] == x for i in kept)) for x in {label[i] for i in kept})
    assert _run(spark, small, "MATCH (n:A|C {name: 'c'}) RETURN count(n) AS n") == [(14,)]


@pytest.mark.parametrize("arrow", ["-[:x|y*2..]->", "<-[*0..6]-", "-[:y*..5]-"])
def test_counted_trails(spark, small, arrow):
    both, types = ">" not in arrow and "<" not in arrow, "y" if ":y*" in arrow else "xy"
    lo, hi = {"-[:x|y*2..]->": (2, None), "<-[*0..6]-": (0, 6), "-[:y*..5]-": (1, 5)}[arrow]
    edges = [(d, t, s) for s, t, d in small[3]] if "<" in arrow else small[3]
    want = {}
    for i, label, _ in small[2]:
        if label == "A":
            for end, _k in _trails(edges, i, lo, hi, both, types):
                want[i, end] = want.get((i, end), 0) + 1
    assert _run(spark, small, f"MATCH (a:A){arrow}(b) RETURN a.id, b.id, count(*) AS n") == sorted((*k, n) for k, n in want.items())


def test_trails_that_nothing_tells_apart_are_counted(spark, monkeypatch):
    """Four diamonds in a row: 16 trails, and one row for each pair of ends."""
    made = []
    real = cypher.written
    monkeypatch.setattr(cypher, "written", lambda df, name="table": made.append((name, real(df, name))) or made[-1][1])
    edges = [e for i in range(4) for m in "lr" for e in ((f"d{i:02}", "x", f"{m}{i:02}"), (f"{m}{i:02}", "x", f"d{i + 1:02}"))]
    ids = sorted({i for s, _, d in edges for i in (s, d)})
    graph = spark.createDataFrame([(i, "A", i) for i in ids], NODES), spark.createDataFrame(edges, EDGES)
    got = cypher.run(spark, *graph, "MATCH (a {id: 'd00'})-[*3..]->(b) RETURN b.id AS b, count(*) AS n").collect()
    assert {(r.b, r.n) for r in got} == {(f"d{i:02}", 2**i) for i in range(2, 5)} | {(f"{m}{i:02}", 2**i) for i in range(1, 4) for m in "lr"}
    rounds = [df for name, df in made if name == "trails"]
    assert rounds and max(df.count() for df in rounds) <= 2
    assert not {"x", "via"} & {c for df in rounds for c in df.columns}
