import itertools
import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions import paths
from graphloom.operators import community, derive, linker, scenarios, search, sequence, traverse, upsert, views
from graphloom.plans import cypher
from graphloom.plans.ontology import VIEWS
from graphloom.sources import documents, files

EDGE = "project string, src string, type string, dst string, props map<string,string>"


def edges_of(spark, pairs, project="p"):
    return spark.createDataFrame([(project, a, t, b, p) for a, t, b, p in [(*x, {}) if len(x) == 3 else x for x in pairs]], EDGE)


def nodes_of(spark, rows):
    """rows: id, label, and properties."""
    full = [("p", i, label, i.rpartition(".")[2], [label], "java", f"src/{i}.java", {k: str(v) for k, v in p.items()}, None) for i, label, p in [(*x, {}) if len(x) == 2 else x for x in rows]]
    return spark.createDataFrame(full, "project string, id string, label string, name string, labels array<string>, stack string, filePath string, props map<string,string>, summary string")


def trails(pairs, start, depth, direction):
    """Brute force: distances and edges over all trails."""
    dist, used, todo = {start: 0}, set(), [(start, ())]
    while todo:
        at, path = todo.pop()
        if len(path) == depth:
            continue
        for k, (a, b) in enumerate(pairs):
            if k in path:
                continue
            for x, y in [(a, b)] * (direction != "upstream") + [(b, a)] * (direction != "downstream"):
                if x == at:
                    dist[y] = min(dist.get(y, 99), len(path) + 1)
                    used.add((a, b))
                    todo.append((y, (*path, k)))
    return dist, used


@pytest.mark.parametrize("seed,direction", list(itertools.product(range(2), ["upstream", "downstream", "both"])))
def test_bfs_equals_trails(spark, seed, direction):
    r = random.Random(seed)
    pairs = sorted({(r.randrange(6), r.randrange(6)) for _ in range(8)})
    e = edges_of(spark, [(f"n{a}", "T", f"n{b}") for a, b in pairs])
    n = nodes_of(spark, [(f"n{i}", "X") for i in range(6)])
    reached, walked = traverse.impact(n, e, "n0", direction, 3, types=None)
    dist, used = trails(pairs, 0, 3, direction)
    assert {x.id: x.distance for x in reached.collect()} == {f"n{k}": v for k, v in dist.items()}
    assert {(x.src, x.dst) for x in walked.collect()} == {(f"n{a}", f"n{b}") for a, b in used}


def test_isolated_start(spark):
    n, e = nodes_of(spark, [("a", "X")]), edges_of(spark, [("b", "T", "c")])
    assert traverse.impact(n, e, "a", types=None)[0].count() == 1
    assert traverse.impact(n, e, "a", types=None, compat=True)[0].count() == 0


def test_normal_forms(spark):
    cases = {"https://h.x/A/{id}/?q=1": "/a/{*}", "a//b/:id/*": "/a/b/{*}/{*}", "": "", None: "", "/": "/", "http://h": "/", "/x/${v}/y": "/x/{*}/y"}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "u string, want string").withColumn("got", paths.normalize(F.col("u"))).withColumn("again", paths.normalize(F.col("got")))
    for r in df.collect():
        assert r.got == r.want and r.again == r.got
    row = spark.range(1).select(paths.normalize_client(F.lit("HTTPS://h/a#b")).alias("c"), paths.join_paths(F.lit("/api"), F.lit("orders/{id}")).alias("j"), paths.snake_case(F.lit("unitPrice")).alias("s")).first()
    assert (row.c, row.j, row.s) == ("/a", "/api/orders/{*}", "unit_price")


def test_link_tiers(spark):
    form = "id string, httpMethod string, path string"
    ends = [("list", "GET", "/api/orders"), ("get", "GET", "/api/orders/{id}"), ("create", "POST", "/api/orders"), ("any", "ANY", "/api/x"), ("deep", "GET", "/a/{x}/{y}"), ("wild", "GET", "/{a}/{b}")]
    calls = [("c1", "get", "/api/orders"), ("c2", "GET", "/api/orders/5"), ("c3", "GET", "/api/x"), ("c4", "GET", "/a/b/c"), ("c5", "", "/api/orders"), ("c6", "GET", "/"), ("c7", "GET", "/q/r")]
    c, e = spark.createDataFrame(calls, form), spark.createDataFrame(ends, form)
    got = {r.call: (r.endpoint, r.confidence, r.tier) for r in linker.link(c, e).collect()}
    assert got == {"c1": ("list", 1.0, "exact"), "c2": ("get", 0.767, "pattern"), "c3": ("wild", 0.7, "pattern"), "c7": ("wild", 0.7, "pattern")}
    judged = linker.link(c, e, lambda left, ends: left.select("call", F.lit("deep").alias("endpoint"), F.lit(0.99).alias("confidence")))
    assert {(r.call, r.confidence) for r in judged.where("tier = 'llm'").collect()} == {("c4", 0.85), ("c5", 0.85)}


def smoke(spark, tmp_path):
    """The two documents of the fixtures."""
    import json

    def doc(stack, rows, edges):
        base = [{"id": i, "label": label, "fqn": i.partition(":")[2], "name": i.rpartition(".")[2], "filePath": f"src/{i}", "startLine": 1, "endLine": 10, "hash": f"h_{i}", "props": p} for i, label, p in rows]
        return {"schemaVersion": "1", "stack": stack, "project": "__smoke__", "root": "/", "nodes": base, "edges": [{"source": a, "target": b, "type": t, "props": p} for a, t, b, p in edges], "warnings": []}

    c, s, o, t = "java:com.x.OrderController", "java:com.x.OrderService", "java:com.x.Order", "java:table:orders"
    e1, e2 = f"{c}#list():GET /api/orders", f"{c}#get(long):GET /api/orders/{{id}}"
    java = doc("java", [(c, "Controller", {}), (s, "Service", {}), (o, "Entity", {"tableName": "orders"}), (t, "Table", {"tableName": "orders", "columns": ["id"], "odd": {"x": 1}, "none": None}),
        (e1, "Endpoint", {"httpMethod": "GET", "path": "/api/orders", "normalizedPath": "/api/orders"}), (e2, "Endpoint", {"httpMethod": "GET", "path": "/api/orders/{id}", "normalizedPath": "/api/orders/{*}"}),
        (f"{c}#list()", "Method", {}), (f"{s}#findAll()", "Method", {})],
        [(c, "INJECTS", s, {}), (c, "EXPOSES", e1, {}), (c, "EXPOSES", e2, {}), (e1, "HANDLED_BY", f"{c}#list()", {}), (f"{c}#list()", "CALLS", f"{s}#findAll()", {"line": 5}), (o, "MAPS_TO", t, {})])
    svc, cmp_ = "angular:OrderApi", "angular:OrderList"
    a1, a2 = f"{svc}#list@call0", f"{svc}#byId@call0"
    ng = doc("angular", [(svc, "Service", {}), (cmp_, "Component", {}), (f"{svc}#list", "Method", {}), (f"{svc}#byId", "Method", {}), (a1, "ApiCall", {"httpMethod": "GET", "path": "/api/orders"}), (a2, "ApiCall", {"httpMethod": "GET", "path": "/api/orders/{*}"})],
        [(cmp_, "INJECTS", svc, {}), (f"{svc}#list", "MAKES_CALL", a1, {}), (f"{svc}#byId", "MAKES_CALL", a2, {})])
    for name, d in (("java", java), ("ng", ng)):
        (tmp_path / f"{name}.json").write_text(json.dumps(d))
    return [documents.read_documents(spark, [str(tmp_path / f"{n}.json")]) for n in ("java", "ng")]


def test_smoke_documents(spark, tmp_path):
    docs = smoke(spark, tmp_path)
    parts = [(documents.document_nodes(d), documents.document_edges(d)) for d in docs]
    assert [n.count() for n, _ in parts] == [8, 6] and [e.count() for _, e in parts] == [6, 3]
    table = parts[0][0].where("label = 'Table'").first()
    assert table.arr_props == {"columns": ["id"]} and set(table.props) == {"tableName"}
    nodes, edges = parts[0][0].limit(0), parts[0][1].limit(0)
    for (n, e), stack in zip(parts, ("java", "angular"), strict=True):
        nodes, edges, stats = upsert.ingest(nodes, edges, n, e, "__smoke__", stack)
        assert stats.first().staleRemoved == 0
    nodes.write.mode("overwrite").parquet(str(tmp_path / "n"))
    edges.write.mode("overwrite").parquet(str(tmp_path / "e"))
    nodes, edges = spark.read.parquet(str(tmp_path / "n")), spark.read.parquet(str(tmp_path / "e"))
    again = upsert.ingest(nodes, edges, *parts[0], "__smoke__", "java")
    assert again[0].count() == 14 and again[1].count() == 9 and again[2].first().staleRemoved == 0
    pick = lambda label: nodes.where(F.col("label") == label).select("id", F.col("props")["httpMethod"].alias("httpMethod"), F.col("props")["path"].alias("path"))
    links = linker.link(pick("ApiCall"), pick("Endpoint"))
    assert {r.tier for r in links.collect()} == {"exact"} and links.count() == 2
    edges = linker.relink(edges, links, "__smoke__")
    order, controller = "java:com.x.Order", "java:com.x.OrderController"
    assert views.architecture(nodes, edges)[0].count() >= 6
    assert traverse.neighbourhood(nodes, edges, controller, 2)[0].count() >= 4
    assert views.node_detail(nodes, edges, controller).count() >= 3
    assert search.search(nodes, "OrderService").count() >= 1
    assert "java:table:orders" in {r.id for r in traverse.impact(nodes, edges, order, "both", 4)[0].collect()}
    hit = {r.id for r in traverse.impact(nodes, edges, f"{controller}#list():GET /api/orders", "both", 3)[0].collect()}
    assert "angular:OrderApi#list@call0" in hit
    for view in VIEWS:
        views.view_subgraph(nodes, edges, view, limit=50)[1].count()
    changed = parts[0][0].withColumn("hash", F.lit("new"))
    seen = upsert.upsert_nodes(nodes.withColumn("summary", F.lit("old")), changed)
    assert {(r.stack, r.summary) for r in seen.select("stack", "summary").collect()} == {("java", None), ("angular", "old")}
    gone = upsert.ingest(nodes, edges, parts[0][0].where("label <> 'Table'"), parts[0][1], "__smoke__", "java")
    assert (gone[2].first().staleRemoved, gone[2].first().droppedEdges) == (1, 1)


def test_read_only(spark):
    for bad in ("MATCH (n) DETACH DELETE n", "CREATE (n)", "MATCH (n) SET n.x = 1", "MERGE (n:A)"):
        with pytest.raises(cypher.CypherError):
            cypher.check_read_only(bad)
    cypher.check_read_only("MATCH (n) WHERE n.name = 'DELETE me' RETURN n.id")


def test_query_paths(spark):
    n = nodes_of(spark, [("a", "A", {"k": 1}), ("b", "B"), ("c", "B"), ("x.d", "C")])
    e = edges_of(spark, [("a", "R", "b", {"w": "2"}), ("b", "R", "c"), ("c", "R", "a"), ("c", "S", "x.d")])
    run = lambda q, **p: sorted(tuple(r) for r in cypher.run(spark, n, e, q, **p).collect())
    assert run("MATCH p = (a:A)-[:R*1..3]->(x) RETURN x.id AS id, length(p) AS n, [y IN nodes(p) | y.id][0] AS first") == [("a", 3, "a"), ("b", 1, "a"), ("c", 2, "a")]
    assert run("MATCH (a)-[r1:R]-(b)-[r2:R]-(c) WHERE a.id = 'a' RETURN c.id AS id") == [("b",), ("c",)]
    assert run("MATCH (a {k: $k}) RETURN a.id AS id, a.k AS k", k="1") == [("a", "1")]
    assert run("MATCH (a:A)-[r]->(b) RETURN r.w AS w, type(r) AS t, endNode(r).id AS id") == [("2", "R", "b")]
    assert run("MATCH (n) WHERE EXISTS { (n)-[:S]->() } RETURN n.id AS id") == [("c",)]
    assert run("MATCH (b:B) CALL { WITH b MATCH (b)-[:S]->(d) RETURN d.id AS d } RETURN b.id AS b, d") == [("c", "x.d")]
    assert run("MATCH (n:B) WITH n ORDER BY n.id DESC LIMIT 1 OPTIONAL MATCH (n)-[:NONE]->(m) RETURN n.id AS id, coalesce(m.id, '-') + '!' AS m") == [("c", "-!")]
    assert run("CALL db.index.fulltext.queryNodes('x', 'd*') YIELD node, score RETURN node.id AS id") == [("x.d",)]
    assert run("MATCH (a:A), (b:B) RETURN count(*) AS n, collect(b.id)[..1] AS some, sum(1) AS s") [0][0] == 2
    assert run("RETURN any(x IN [1, 2] WHERE x > 1) AS a, size([1, 2, 3][1..]) AS b, 7 / 2 AS c, toUpper('a') + 1 AS d") == [(True, 2, 3, "A1")]


def app(spark):
    n = nodes_of(spark, [("r", "Route", {"routePath": "orders"}), ("r0", "Route", {"routePath": ""}), ("C", "Component"), ("C2", "Component"), ("C.m", "Method"), ("S.m", "Method"), ("call", "ApiCall", {"httpMethod": "GET", "normalizedPath": "/o"}),
        ("ep", "Endpoint", {"httpMethod": "GET", "path": "/o"}), ("h", "Method"), ("find", "Method"), ("Repo", "Repository"), ("Ent", "Entity"), ("Tab", "Table")])
    e = edges_of(spark, [("r", "NAVIGATES_TO", "C"), ("C", "RENDERS", "C2"), ("C2", "DECLARES", "C.m"), ("C.m", "CALLS", "S.m"), ("S.m", "MAKES_CALL", "call"), ("call", "INVOKES_API", "ep"), ("ep", "HANDLED_BY", "h"), ("h", "CALLS", "find", {"line": "3"}), ("Repo", "DECLARES", "find"), ("Repo", "MANAGES", "Ent"), ("Ent", "MAPS_TO", "Tab"), ("find", "CALLS", "h", {"line": "9"})])
    return n, e


def test_scenarios(spark):
    n, e = app(spark)
    built, covers = scenarios.build_scenarios(n, scenarios.trace(n, e), "p")
    s = built.collect()
    assert [(x.id, x.title) for x in s] == [("system:scenario:p:orders", "Screen: /orders")]
    assert s[0].steps == ["Route /orders", "Component C", "Component C2", "API GET /o", "Endpoint GET /o", "Entity Ent", "Table Tab"]
    assert {(r.dst, r.role) for r in covers.collect()} >= {("Tab", "table"), ("r", "route")}
    assert scenarios.top_scenarios(covers).first().covered == 7
    assert scenarios.coverage_by_label(covers, n).count() == 6
    assert scenarios.suggestions(n, e, covers).count() >= 2


def test_sequence(spark):
    n, e = app(spark)
    roots = sequence.root_methods(n, e, spark.createDataFrame([("call",), ("Tab",)], "id string"))
    assert [tuple(r) for r in roots.collect()] == [("call", "h")]
    steps = sequence.sequence(n, e, roots.select("root")).orderBy("step").collect()
    assert [(r.caller, r.callee, r.depth) for r in steps] == [("h", "Repo", 0), ("Repo", "h", 1)]
    assert {r.name for r in sequence.participants(sequence.sequence(n, e, roots.select("root"))).collect()} == {"h", "Repo"}


def test_components_and_communities(spark):
    r = random.Random(3)
    pairs = [(r.randrange(60), r.randrange(60)) for _ in range(45)]
    up = list(range(60))
    for _ in range(60):
        for a, b in pairs:
            up[a] = up[b] = min(up[a], up[b])
    df = spark.createDataFrame(pairs, "a long, b long")
    used = {x for p in pairs for x in p}
    assert {x.id: x.component for x in community.components(df).collect()} == {i: up[i] for i in used}
    clique = lambda lo: [(i, j) for i in range(lo, lo + 5) for j in range(i + 1, lo + 5)]
    g = spark.createDataFrame([*clique(0), *clique(5), (4, 5)], "a long, b long")
    c = community.communities(g)
    got = {x.id: x.community for x in c.collect()}
    assert len({got[i] for i in range(5)}) == 1 and len({got[i] for i in range(5, 10)}) == 1 and got[0] != got[9]
    assert community.modularity(g, c.withColumnRenamed("community", "c")) > 0.3
    assert {x.id for x in community.largest_component(df).collect()} == {i for i in used if up[i] == max(set(up), key=lambda k: (sum(up[j] == k for j in used), -k))}


def test_derivations(spark):
    deps = spark.createDataFrame([("d1", "org.a"), ("d2", "org.a.b"), ("d3", "org.a.b")], "id string, groupId string")
    f = spark.createDataFrame([("src/t.A.java", "import org.a.b.C;\nimport static org.ab.D;\n")], "filePath string, text string")
    assert {r.dst for r in derive.dependency_usage(nodes_of(spark, [("t.A", "Class")]), f, deps).collect()} == {"d2", "d3"}
    urls = {"jdbc:postgresql://db:5432/shop": ("postgresql", "db", "5432", "shop"), "jdbc:h2:mem:test;X=1": ("h2", "", "", "test"), "jdbc:h2:file:./data/x": ("h2", "", "", "x")}
    for r in spark.createDataFrame([(u,) for u in urls], "u string").select("u", derive.jdbc_parts(F.col("u")).alias("p")).collect():
        assert tuple(r.p) == urls[r.u]
    one = spark.range(1).select(derive.resolve_placeholders(F.lit("${A:b}/c")).alias("a"), derive.repository_access(F.lit("findX"), F.lit(False), F.lit(False)).alias("b"), derive.unwrapped_type(F.lit("ResponseEntity<List<OrderDto>>")).alias("c"), derive.handler_name(F.lit("this.save($event)")).alias("d"), derive.client_kind(F.lit("AuthGuard")).alias("e")).first()
    assert tuple(one) == ("b/c", "READS", "OrderDto", "save", "guard")
    calls = derive.resolve_calls(spark.createDataFrame([("m", "A", "svc", "go", 1), ("m2", "A", "svc", "go", 3), ("m3", "A", "svc", "one", 9)], "caller string, owner string, field string, name string, arity int"),
        spark.createDataFrame([("A", "svc", "S")], "owner string, field string, type string"), spark.createDataFrame([("S", "go", 1, "go1"), ("S", "go", 2, "go2"), ("S", "one", 0, "one0")], "owner string, name string, arity int, id string"))
    assert {tuple(r) for r in calls.collect()} == {("m", "go1"), ("m3", "one0")}
    routes = derive.flat_routes(spark.createDataFrame([("1", None, "a"), ("2", "1", "b"), ("3", "2", ":id")], "id string, parent string, segment string"))
    assert {r.id: r.path for r in routes.collect()} == {"1": "a", "2": "a/b", "3": "a/b/:id"}


def test_files(spark, tmp_path):
    texts = {
        "srv/pom.xml": "<p><dependencies><dependency><groupId>g</groupId><artifactId>a</artifactId></dependency></dependencies></p>", "srv/src/main/java/A.java": "class A {}", "web/angular.json": "{}", "web/x.spec.ts": "x", "web/y.ts": "x",
        "node_modules/z.ts": "x", "docker-compose.yml": "services:\n  db:\n    image: postgres:16\n    ports: ['5432:5432']\n", "k8s.yaml": "kind: Deployment\nmetadata: {name: api}\nspec: {template: {spec: {containers: [{image: api:1}]}}}\n---\nkind: Other\n",
        "application.properties": "spring.datasource.url=jdbc:h2:mem:x\n", "application.yml": "spring: {application: {name: shop}, datasource: {url: 'jdbc:a://h/b'}}\n", "proxy.conf.json": '{"/api": {"target": "http://h:1"}}', "tsconfig.json": '{/* c */ "compilerOptions": {"paths": {"@a/*": ["src/a/*"],}}}',
    }
    for name, text in texts.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    f = files.scan(spark, str(tmp_path))
    assert {r.filePath for r in f.collect()} == {k for k in texts if not k.startswith("node_modules")}
    assert {tuple(r) for r in files.detect_stacks(f).collect()} == {("java", "srv"), ("angular", "web")}
    assert [r.root for r in files.java_roots(f).collect()] == ["srv/src/main/java"] and [r.filePath for r in files.ts_files(f).collect()] == ["web/y.ts"]
    assert [(r.name, r.image, r.ports) for r in files.compose_services(f).collect()] == [("db", "postgres:16", ["5432:5432"])]
    assert [(r.name, r.image) for r in files.k8s_objects(f).collect()] == [("api", "api:1")]
    assert {(r.url, r.application) for r in files.application_settings(f).collect()} == {("jdbc:h2:mem:x", None), ("jdbc:a://h/b", "shop")}
    assert [r.target for r in files.proxy_targets(f).collect()] == ["http://h:1"] and [tuple(r) for r in files.tsconfig_aliases(f).collect()] == [("@a/*", "src/a/*")]
    assert [(r.groupId, r.artifactId) for r in files.pom_dependencies(f).collect()] == [("g", "a")]
    s = documents.source_slice(spark.createDataFrame([("f", "1\n2\n3\n4")], "filePath string, text string"), spark.createDataFrame([("i", "f", 2, 3)], "id string, filePath string, startLine int, endLine int"), context=0, numbered=True)
    assert s.first().source == "2: 2\n3: 3"


def test_a_trace_keeps_routes_as_bits(spark, monkeypatch):
    made, real = [], scenarios.written

    def written(df, name="table"):
        made.append((name, real(df, name)))
        return made[-1][1]

    monkeypatch.setattr(scenarios, "written", written)
    routes = [f"r{i:03d}" for i in range(130)]
    n = nodes_of(spark, [(r, "Route", {"routePath": f"p{i // 2}" if i < 4 else f"q{i}"}) for i, r in enumerate(routes)] + [("C", "Component"), ("D", "Component"), *[(f"m{i}", "Method") for i in range(6)], *[(f"a{i}", "ApiCall") for i in range(40)], ("e", "Endpoint"), ("x", "Method")])
    links = [(r, "NAVIGATES_TO", "C" if i % 3 else "D") for i, r in enumerate(routes) if i != 77] + [("C", "RENDERS", "D"), ("C", "DECLARES", "m0"), ("D", "DECLARES", "m2"), ("C", "DECLARES", "gone")]
    links += [(f"m{i}", "CALLS", f"m{i + 1}") for i in range(5)] + [("m1", "CALLS", "m0"), ("m1", "CALLS", "C")] + [(f"m{i % 6}", "MAKES_CALL", f"a{i}") for i in range(40)] + [("m0", "MAKES_CALL", "e"), ("m0", "MAKES_CALL", "nowhere"), ("a3", "INVOKES_API", "e"), ("a4", "INVOKES_API", "x")]
    traced = scenarios.trace(n, edges_of(spark, links))
    want = set()
    for i, r in enumerate(routes):
        want.add((r, "route", r))
        if i == 77:
            continue
        comps = {"C", "D"} if i % 3 else {"D"}
        meths = {k for c in comps for k in (range(0, 4) if c == "C" else range(2, 6))}
        want |= {(r, "component", c) for c in comps} | {(r, "apicall", f"a{k}") for k in range(40) if k % 6 in meths}
        want |= {(r, "endpoint", "e")} if 3 in meths else set()
    rows = [tuple(x) for x in traced.select("route", "role", "id").collect()]
    assert set(rows) == want and len(rows) == len(want)
    assert max(df.count() for name, df in made if name in ("leg", "walk")) <= 3 * 40  # three rows of bits for an id, not 130
    got = [tuple(x) for x in scenarios.build_scenarios(n, traced, "p")[1].select("src", "dst", "role").collect()]
    path = {r: f"p{i // 2}" if i < 4 else f"q{i}" for i, r in enumerate(routes)}
    assert len(got) == len(set(got)) and set(got) == {(f"system:scenario:p:{path[r]}", d, role) for r, role, d in want if r != "r077"}


def test_scenarios_cover_calls_too_and_nodes_alone(spark):
    from graphloom.plans import registry, testgraph

    sf = "/root/testdata/sf0.001"
    got = {r.role: r.n for r in registry.QUERIES["scenario_covers"](spark, sf).groupBy("role").agg(F.count("*").alias("n")).collect()}
    traced = scenarios.trace(testgraph.app_nodes(spark, sf), testgraph.app_edges(spark, sf))
    assert got["apicall"] > 0 and got == {r.role: r.n for r in traced.groupBy("role").agg(F.count("*").alias("n")).collect()}
    n = nodes_of(spark, [("r", "Route", {"routePath": "a"}), ("c", "Component")])
    some = spark.createDataFrame([("r", "route", "r"), ("r", "component", "c"), ("r", "apicall", "gone")], "route string, role string, id string")
    rows = scenarios.build_scenarios(n, some, "p")[1].collect()
    assert sorted((x.src, x.dst, x.role) for x in rows) == [("system:scenario:p:a", "c", "component"), ("system:scenario:p:a", "r", "route")]
