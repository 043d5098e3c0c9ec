"""Names, expressions, routes, nesting and infrastructure."""

import random
import re
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F
from test_graph import smoke

from graphloom.api import Graph
from graphloom.functions import paths
from graphloom.functions.yaml_paths import yaml_paths
from graphloom.operators import derive, infra, resolve


def _pairs(df):
    return {tuple(r) for r in df.collect()}


def test_specifiers(spark):
    files = spark.createDataFrame([(f,) for f in ("src/app/a.ts", "src/app/b/index.ts", "src/app/b.ts", "src/lib/c.ts", "src/lib/deep/d.ts", "src/env.js", "src/env.ts", "top.ts")], "filePath string")
    refs = [(1, "src/app/a.ts", "./b"), (2, "src/app/a.ts", "../lib/c"), (3, "src/app/b/index.ts", "./../../lib/./deep/d"), (4, "src/app/a.ts", "@lib/c"), (5, "src/app/a.ts", "@lib/deep/d"), (6, "src/app/a.ts", "../env.js"), (7, "src/app/a.ts", "rxjs"), (8, "src/app/a.ts", "./gone"), (9, "src/app/a.ts", "@lib"), (10, "a.ts", "../../top")]
    aliases = spark.createDataFrame([("@lib/", "src/lib/"), ("@lib/deep/", "src/lib/deep/"), ("@", "node/")], "prefix string, target string")
    got = dict(_pairs(resolve.specifiers(spark.createDataFrame(refs, "ref int, fromFile string, spec string"), files, aliases)))
    assert got == {1: "src/app/b.ts", 2: "src/lib/c.ts", 3: "src/lib/deep/d.ts", 4: "src/lib/c.ts", 5: "src/lib/deep/d.ts", 6: "src/env.js", 10: "top.ts"}
    assert resolve.specifiers(spark.createDataFrame([], "ref int, fromFile string, spec string"), files).count() == 0


def test_urls_as_the_library_joins_them(spark):
    bases = ["https://h.example/a/b/c?x#y", "http://h.example", "http://h.example/a/", "https://u@h.example:8/a//b/../c.html"]
    refs = ["d", "./d", "../d", "../../../d", "/x/../y", "/", ".", "..", "../", "d/", "?q=1", "#f", "d?q#f", "//other/z", "ftp://k/l", "mailto:a@b", "d/./e/../f"]
    rows = [(b, r) for b in bases for r in refs]
    got = spark.createDataFrame(rows, "b string, r string").select("b", "r", paths.resolved_url(F.col("b"), F.col("r")).alias("u")).collect()
    for x in got:
        want = urljoin(x.b, x.r)
        same = lambda u: re.sub(r"(?<=[^:/])/+", "/", re.sub(r"^(https?://[^/?#]+)(?=[?#]|$)", r"\1/", u))
        if "//b" not in x.b:
            assert same(x.u) == same(want), (x.b, x.r, want, x.u)


def test_scopes_shadow_each_other(spark):
    types = spark.createDataFrame([("1", "p.Order", "Order", "p", "A.java"), ("2", "q.Order", "Order", "q", "B.java"), ("3", "r.Order", "Order", "r", "C.java"), ("4", "q.Item", "Item", "q", "B2.java"), ("5", "s.Lone", "Lone", "s", "D.java"), ("6", "a.Item", "Item", "a", "E.java"), ("7", "p.Inner", "Inner", "p", "F.java"), ("8", "q.Inner", "Inner", "q", "X.java")], "id string, fqn string, name string, package string, file string")
    imports = spark.createDataFrame([("X.java", "q.Order"), ("Y.java", "r.*"), ("Y.java", "q.*"), ("X.java", "p.Inner"), ("Z.java", "gone.Order")], "file string, target string")
    refs = [("own file", "X.java", "p", "Inner"), ("import", "X.java", "p", "Order"), ("package", "W.java", "p", "Order"), ("package before wildcard", "Y.java", "p", "Order"), ("wildcard", "Y.java", "none", "Item"), ("two wildcards", "Y.java", "none", "Order"), ("anywhere", "W.java", "none", "Lone"), ("least anywhere", "W.java", "none", "Item"), ("import of nothing", "Z.java", "r", "Order"), ("nothing", "W.java", "p", "String")]
    got = dict(_pairs(resolve.scoped_symbols(spark.createDataFrame(refs, "ref string, file string, package string, name string"), types, imports)))
    assert got == {"own file": "8", "import": "2", "package": "1", "package before wildcard": "1", "wildcard": "4", "two wildcards": "2", "anywhere": "5", "least anywhere": "6", "import of nothing": "3"}
    uses = spark.createDataFrame([("1", "A.java", "p", "EXTENDS", "Inner", None), ("1", "A.java", "p", "INJECTS", "Order", "self"), ("1", "A.java", "p", "INJECTS", "Lone", "b"), ("1", "A.java", "p", "INJECTS", "Lone", "a"), ("4", "B2.java", "q", "IMPLEMENTS", "Order", None)], "id string, file string, package string, type string, name string, via string")
    assert _pairs(resolve.hierarchy(uses, types, imports)) == {("1", "EXTENDS", "7", None), ("1", "INJECTS", "5", "a"), ("4", "IMPLEMENTS", "2", None)}


def test_inherited_methods(spark):
    chain = [(f"t{i}", f"t{i + 1}") for i in range(25)] + [("x", "y"), ("y", "x"), ("t3", "side")]
    methods = [("t25", "far", "m1"), ("t2", "near", "m2"), ("t5", "near", "m3"), ("side", "both", "m5"), ("t4", "both", "m4"), ("t0", "own", "m7"), ("t0", "own", "m6")]
    wanted = [("t0", "far"), ("t0", "near"), ("t3", "near"), ("x", "far"), ("t1", "both"), ("t0", "own"), ("t0", "none")]
    mk = spark.createDataFrame
    got = _pairs(resolve.inherited_method(mk(wanted, "type string, name string"), mk(chain, "type string, parent string"), mk(methods, "owner string, name string, id string")))
    assert got == {("t0", "far", "m1"), ("t0", "near", "m2"), ("t3", "near", "m3"), ("t1", "both", "m4"), ("t0", "own", "m6")}
    assert resolve.inherited_method(mk([], "type string, name string"), mk(chain, "type string, parent string"), mk(methods, "owner string, name string, id string")).collect() == []


def _value(nodes, parts, i, left):
    op, text = nodes.get(i, (None, None))
    if left < 0 or op is None:
        return None
    if op == "text":
        return text or ""
    inner = [_value(nodes, parts, p, left - 1) for _, p in sorted(parts.get(i, []))]
    if op == "join":
        return "".join("{*}" if v is None else v for v in inner) if any(v is not None for v in inner) else None
    return None if op == "call" and not re.search(resolve.URL_CALL, text or "") else inner[0] if inner else None


def test_folded_expressions(spark):
    rng = random.Random(9)
    nodes, parts = {}, {}
    for i in range(300):
        op = rng.choice(["text", "join", "join", "name", "name", "call"])
        nodes[i] = (op, {"text": f"/{i}", "call": rng.choice(["getEndpointFor", "other"])}.get(op, f"n{i}"))
        if op != "text":
            parts[i] = [(k, rng.randrange(310)) for k in range(3 if op == "join" else rng.choice([0, 1]))]
    nodes[0], nodes[1] = ("name", "a"), ("name", "b")
    parts[0], parts[1] = [(0, 1)], [(0, 0)]  # a cycle
    for i in range(400, 415):  # a chain that is too long at one end
        nodes[i], parts[i] = ("name", "c"), [(0, i + 1)]
    nodes[415] = ("text", "end")
    got = dict(_pairs(resolve.folded_expressions(spark.createDataFrame([(i, *v) for i, v in nodes.items()], "id int, op string, text string"), spark.createDataFrame([(i, k, p) for i, ps in parts.items() for k, p in ps], "id int, ord int, part int"))))
    assert got == {i: _value(nodes, parts, i, 8) for i in nodes}
    assert got[407] == "end" and got[406] is None and got[0] is None


def test_routes(spark):
    rows = [(1, None, 1, "", None), (2, 1, 2, "orders", None), (3, 2, 3, ":id", None), (4, 2, 4, "", "list"), (5, 2, 5, "list", None), (6, None, 6, "orders", None), (7, None, 7, "**", "/orders/list"), (8, None, 8, "a", "/b"), (9, None, 9, "b", "/a"), (10, None, 10, "old", "/**"), (11, 12, 11, "x", None), (12, 11, 12, "y", None), (13, 11, 13, "z", None), (14, 99, 14, "lost", None), (15, 2, 15, "lone", "nowhere"), (16, 14, 16, "below", None)]
    rows += [(100 + i, 99 + i if i else None, 100 + i, f"s{i}", None) for i in range(60)]
    got = {r.id: tuple(r)[1:] for r in resolve.route_tree(spark.createDataFrame(rows, "id int, parent int, ord int, segment string, redirect string")).collect()}
    assert got[3] == ("orders/:id", "route:orders/:id", None, False) and got[5][0] == "orders/list"
    assert [got[i][1] for i in (2, 4, 6)] == ["route:orders", "route:orders#2", "route:orders#3"]
    assert [got[i][2] for i in (4, 7, 10)] == [5, 5, 5] and got[8][2] is None and got[15][2] is None
    assert all(got[i] == (None, None, None, True) for i in (11, 12, 13, 14, 16))
    assert got[159][0] == "/".join(f"s{i}" for i in range(60)) and len(got) == len(rows)
    assert resolve.route_tree(spark.createDataFrame([], "id int, parent int, ord int, segment string, redirect string")).collect() == []


def _parents(html):
    html = re.sub(r"(?s)<!--.*?-->", "", html.lower())
    html = re.sub(r"(?s)(<(script|style)[^>]*>).*?(?=</\2)", r"\1", html)
    out, open_ = [], []
    for end, name in re.findall(r"<(/?)([a-z][a-z0-9]*)", html):
        if end:
            if name in [n for _, n in open_]:
                while open_.pop()[1] != name:
                    pass
        else:
            out.append((len(out), name, *(open_[-1] if open_ else (-1, None))))
            if name not in resolve.VOID:
                open_.append((len(out) - 1, name))
    return out


def test_elements_and_their_parents(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html")
    extra = spark.createDataFrame([("<a><b></a></b><c><!-- <d> --><br><e></c><f>",), ("",), ("</x><p>text",), ("<script>if (a<b) x='<i>'</script><p>",), (None,)], "html string")
    for r in pages.unionByName(extra).select("html", resolve.element_parents(F.col("html")).alias("e")).collect():
        assert [tuple(x) for x in r.e or []] == _parents(r.html or "")


JAVA = """package x;
// @GetMapping("/no")
@RestController @RequestMapping(value = "/api/things", produces = "a/b")
public class Things {
  private final String s = "{ @PostMapping(\\"/no\\") }"; /* @PutMapping("/no") void a() {} */
  @GetMapping public List<Thing> all(@RequestParam("q") String q) { return find(q); }
  @GetMapping("/{id}") public Thing one(@PathVariable Long id) { if (x(id)) { y(); } return null; }
  @Transactional @PostMapping(path = {"/new", "/other"})
  public ResponseEntity<Thing> make(@RequestBody Map<String, List<Thing>> body) { return null; }
  @RequestMapping(value = "/raw", method = RequestMethod.DELETE) void raw() {}
  @RequestMapping("/any") void any() {}
  void plain() {}
  @RequestMapping("/inner") static class Inner { @PatchMapping("p") void deep() {} }
  @PutMapping("/{id}") void put() {}
}
"""


def test_endpoints_by_nesting(spark):
    got = [tuple(e) for e in spark.createDataFrame([(JAVA,)], "t string").select(resolve.endpoints(F.col("t")).alias("e")).first().e]
    assert got == [
        ("Things", "all", "GET", "/api/things"), ("Things", "one", "GET", "/api/things/{*}"), ("Things", "make", "POST", "/api/things/new"), ("Things", "raw", "DELETE", "/api/things/raw"),
        ("Things", "any", "ANY", "/api/things/any"), ("Inner", "deep", "PATCH", "/inner/p"), ("Things", "put", "PUT", "/api/things/{*}"),
    ]


def test_type_arguments_and_dtos(spark):
    names = lambda t: spark.range(1).select(derive.type_names(F.lit(t)).alias("n"), derive.unwrapped_type(F.lit(t)).alias("u")).first()
    assert tuple(names("Map<String, List<Foo>>")) == (["Map", "String", "List", "Foo"], "Foo")
    assert tuple(names("ResponseEntity<? extends a.b.Page<Foo[]>>")) == (["ResponseEntity", "Page", "Foo"], "Foo")
    types = spark.createDataFrame([("1", "Foo", "Class"), ("2", "Bar", "Entity"), ("3", "Foo", "Class")], "id string, name string, label string")
    edges, dtos = derive.endpoint_types(spark.createDataFrame([("e", "RETURNS", "Map<Bar, List<Foo>>"), ("e", "ACCEPTS", "String")], "endpoint string, type string, text string"), types)
    assert _pairs(edges) == {("e", "RETURNS", "1"), ("e", "RETURNS", "2")} and _pairs(dtos) == {("1",)}


def test_selectors_need_all_their_parts(spark):
    used = spark.createDataFrame([("t", "button", ["appSave", "type"]), ("t", "a", []), ("u", "div", ["appSave"]), ("v", "app-x", None), ("w", "appSave", [])], "template string, tag string, attributes array<string>")
    comps = spark.createDataFrame([("Save", "button[appSave]"), ("Any", "[appSave]"), ("Both", "[appSave][type]"), ("X", "app-x, app-y"), ("X2", "app-x")], "fqn string, selector string")
    assert _pairs(derive.match_selectors(used, comps)) == {("t", "Save"), ("t", "Any"), ("t", "Both"), ("u", "Any"), ("v", "X"), ("w", "Any")}


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("jdbc:postgresql://db:5432/shop", ("postgresql", "db", "5432", "shop")), ("jdbc:mysql://u:p@h/app_1?useSSL=false", ("mysql", "h", "", "app_1")), ("jdbc:h2:mem:test;DB_CLOSE_DELAY=-1", ("h2", "", "", "test")),
        ("jdbc:h2:file:./data/x", ("h2", "", "", "x")), ("jdbc:h2:~/y", ("h2", "", "", "y")), ("jdbc:h2:mem:", ("h2", "", "", "h2")), ("jdbc:oracle:thin:@//o:1521/svc", ("oracle", "o", "1521", "svc")),
        ("jdbc:oracle:thin:@o:1521:sid", ("oracle", "", "", "sid")), ("jdbc:sqlserver://s:1433;databaseName=d;encrypt=true", ("sqlserver", "s", "1433", "d")), ("jdbc:postgresql://a:1,b:2/ha", ("postgresql", "a", "1", "ha")),
        ("jdbc:mariadb://[::1]:3306/m", ("mariadb", "[::1]", "3306", "m")), ("", ("unknown", "", "", "unknown")),
    ],
)
def test_jdbc(spark, url, want):
    assert tuple(spark.range(1).select(derive.jdbc_parts(F.lit(url)).alias("p")).first().p) == want


def test_yaml_rows(spark):
    text = "a:\n  b: 'x''y' # c\n  l:\n  - 1\n  - k: v\n    m: [p, \"q, r\", 's']\n  e:\n\n# no\n\"q k\": \"z # z\"\n---\nn: ~\nt: http://h:1/p\n---\n- - deep\n"
    got = [(r.doc, "/".join(r.path), r.value) for r in spark.range(1).select(F.explode(yaml_paths(F.lit(text))).alias("r")).select("r.*").collect()]
    assert got == [(0, "a/b", "x'y"), (0, "a/l/-0", "1"), (0, "a/l/-1/k", "v"), (0, "a/l/-1/m/-0", "p"), (0, "a/l/-1/m/-1", "q, r"), (0, "a/l/-1/m/-2", "s"), (0, "q k", "z # z"), (1, "t", "http://h:1/p"), (2, "-2", "- deep")]


FILES = [
    ("docker-compose.yml", "services:\n  db:\n    image: postgres:16\n    container_name: pg\n    ports:\n      - \"5432:5432\"\n  api:\n    build: .\n    depends_on: [db, gone]\n  web:\n    image: nginx\n    depends_on:\n      api:\n        condition: x\n"),
    ("k8s/api.yaml", "kind: Deployment\nmetadata:\n  name: shop\nspec:\n  template:\n    spec:\n      containers:\n        - name: a\n          image: shop:1\n---\nkind: Service\nmetadata:\n  name: shop\n---\nkind: ConfigMap\nmetadata:\n  name: c\n"),
    ("src/main/resources/application.yml", "spring:\n  application:\n    name: shop\n  datasource:\n    url: ${DB_URL:jdbc:postgresql://db:5432/shop}\n    username: u\n"),
    ("pom.xml", "<project><dependencies><dependency><groupId>org.a</groupId><artifactId>b</artifactId><version>1</version></dependency><dependency><groupId>org.a.c</groupId><artifactId>d</artifactId></dependency></dependencies></project>"),
    ("src/OrderController.java", "import org.a.c.X;\nimport java.util.List;\n"),
]


def test_infrastructure_is_replaced(spark, tmp_path):
    smoke(spark, tmp_path)
    g, _ = Graph.empty(spark).ingest([str(tmp_path / "java.json")], "__smoke__", "java")
    app = lambda i, stack: g.nodes.limit(1).withColumns({"id": F.lit(i), "label": F.lit("Application"), "stack": F.lit(stack), "filePath": F.lit("")})
    java = g.nodes.withColumn("filePath", F.when(F.col("id") == "java:com.x.OrderController", "src/OrderController.java").otherwise(F.col("filePath")))
    g = Graph(java.unionByName(app("java:app", "java")).unionByName(app("ng:app", "angular")), g.edges, g.projects)
    files = spark.createDataFrame(FILES, "filePath string, text string")
    proxy = spark.createDataFrame([("proxy.conf.json", '{"/api": {"target": "http://localhost:8080"}, "x": {}}')], "filePath string, text string")
    once = g.build_infrastructure("__smoke__", files, proxy).build_dependencies("__smoke__", files)
    path = str(tmp_path / "g")
    once.save(path)
    back = Graph.load(spark, path)
    infra_nodes = {(r.id, r.label, r.name): r for r in back.nodes.where("stack = 'infra'").collect()}
    d = "infra:deployment:__smoke__:"
    assert set(infra_nodes) == {(d + "db", "Deployment", "db"), (d + "api", "Deployment", "api"), (d + "web", "Deployment", "web"), (d + "k8s:deployment:shop", "Deployment", "shop"), (d + "k8s:service:shop", "Deployment", "shop"), ("infra:datasource:__smoke__:shop", "Datasource", "shop")}
    pg = infra_nodes[(d + "db", "Deployment", "db")]
    assert pg.props["image"] == "postgres:16" and pg.props["containerName"] == "pg" and pg.arr_props["ports"] == ["5432:5432"]
    ds = "infra:datasource:__smoke__:shop"
    want = {(d + "api", "CONNECTS_TO", d + "db"), (d + "web", "CONNECTS_TO", d + "api"), ("ng:app", "CONNECTS_TO", "java:app"), ("java:app", "USES_DATASOURCE", ds), (ds, "HOSTS", "java:table:orders"), (ds, "PROVIDED_BY", d + "db"), ("java:app", "DEPLOYED_AS", d + "k8s:deployment:shop")}
    made = back.edges.where("type in ('CONNECTS_TO', 'USES_DATASOURCE', 'HOSTS', 'PROVIDED_BY', 'DEPLOYED_AS')").select("src", "type", "dst")
    assert _pairs(made) == want
    dep = "java:dependency:org.a"
    assert _pairs(back.edges.where("type like '%_DEPENDENCY'").select("src", "type", "dst")) == {("java:app", "DECLARES_DEPENDENCY", f"{dep}:b"), ("java:app", "DECLARES_DEPENDENCY", f"{dep}.c:d"), ("java:com.x.OrderController", "USES_DEPENDENCY", f"{dep}.c:d")}
    assert back.subgraph("__smoke__", "physical")[0].count() >= 8
    again = back.build_infrastructure("__smoke__", files, proxy).build_dependencies("__smoke__", files)
    assert not any(n for t in again.save(path).values() for n in t.values()), "the same files change nothing"
    bare = Graph.load(spark, path).build_infrastructure("__smoke__", files.where("filePath = 'k8s/api.yaml'"))
    assert bare.nodes.where("stack = 'infra'").count() == 2 and bare.edges.where("type = 'HOSTS'").count() == 0


def test_providers_meet_without_all_pairs(spark):
    rng = random.Random(1)
    ds = [(f"d{i}", rng.choice(["PostgreSQL", "my", "h2", ""]), rng.choice(["db", "x", ""]), rng.choice(["5432", "33", "", None])) for i in range(20)]
    sv = [(f"s{i}", rng.choice(["db", "y"]), rng.choice(["postgresql:1", "mysql", "H2db", "", None]), rng.choice([["5432:5432"], ["3306"], [], None])) for i in range(15)]
    got = _pairs(derive.provided_by(spark.createDataFrame(ds, "id string, vendor string, host string, port string"), spark.createDataFrame(sv, "id string, name string, image string, ports array<string>")))
    want = {(a, b) for a, v, h, p in ds for b, n, im, ps in sv if h == n or v and v.lower() in (im or "").lower() or p and any(p in x for x in ps or [])}
    assert got == want
    assert infra.STACK == "infra"
