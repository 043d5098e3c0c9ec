"""What jobs over large tables may shuffle, keep on disk and hold in a task."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from graphloom.operators import community, derive, order, resolve, sequence, upsert, views
from graphloom.plans import cypher, scratch
from graphloom.sources import files


@pytest.fixture
def tables(monkeypatch):
    """Names and frames of the scratch tables that an operator writes, as it writes them."""
    made = []

    def written(df, name="table"):
        made.append((name, scratch.written(df, name)))
        return made[-1][1]

    for module in (community, views, order, sequence):
        monkeypatch.setattr(module, "written", written)
    return made


def _ring(spark, n):
    return spark.range(n).select(F.format_string("n%03d", "id").alias("a"), F.format_string("n%03d", (F.col("id") + 1) % n).alias("b"))


def test_communities_keep_one_round_on_disk(spark, tables):
    got = community.communities(_ring(spark, 60))
    assert got.count() == 60
    moved = [df._scratch for name, df in tables if name in ("moved", "walk", "of")]
    assert len(moved) > 10 and sum(os.path.exists(p.removeprefix("file:")) for p in moved) <= 4
    assert all(df.schema["id"].dataType.typeName() == "long" for name, df in tables if name in ("moved", "of"))


def test_a_written_table_leaves_no_shuffle_files(spark):
    before = spark.conf.get(scratch.SWEEP, "false")
    where = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: set(where.getAllBlocks().mkString(" ").split())
    kept = files()
    made = scratch.written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert not {f for f in files() - kept if f.startswith("shuffle_")}
    assert made.count() == 7
    assert spark.conf.get(scratch.SWEEP, "false") == before


def test_components_shuffle_codes(spark, tables):
    got = {r.id: r.component for r in community.components(_ring(spark, 50).unionByName(spark.createDataFrame([("x", "x"), ("y", None)], "a string, b string"))).collect()}
    assert got == {f"n{i:03d}": "n000" for i in range(50)} | {"x": "x"}
    assert {t.dataType.typeName() for name, df in tables if name == "star" for t in df.schema.fields} == {"long"}


def test_places_take_one_shuffle(spark, capsys):
    got = order.numbered(spark.range(500).select((F.col("id") * 37 % 500).alias("id")), ["id"])
    assert [(r.id, r.number) for r in got.orderBy("id").collect()] == [(i, i) for i in range(500)]
    capsys.readouterr()
    got.explain()
    assert "row_number" not in capsys.readouterr().out


def test_layout_sweeps_codes(spark, tables):
    nodes = spark.createDataFrame([("a", "t"), ("b", "t"), ("c", None), ("d", None)], "id string, tier string")
    edges = spark.createDataFrame([("a", "d"), ("b", "c"), ("b", "gone"), ("a", "a")], "src string, dst string")
    got = {r.id: (r.tier, r.position) for r in views.layered_layout(nodes, edges, "tier", 1).collect()}
    assert got == {"a": ("t", 1), "b": ("t", 0), "c": (None, 1), "d": (None, 0)}
    assert {t.dataType.typeName() for name, df in tables if name == "walk" for t in df.schema.fields} == {"long"}


def test_or_join_never_shuffles_pairs(spark, capsys):
    vendors, hosts, ports = ["Red", "blue", "", None], ["h1", "h2", None], ["41", "5", "", None]
    ds = [(f"d{i}", vendors[i % 4], hosts[i % 3], ports[(i // 3) % 4]) for i in range(40)]
    images, names, opened = ["x/RED:1", "blueish-red", None, "q"], ["h1", "h2", None, "h9"], [["541", "41", "15"], [], None, ["7"]]
    sv = [(f"s{i}", names[(i // 4) % 4], images[i % 4], opened[(i // 2) % 4]) for i in range(32)]
    got = derive.provided_by(spark.createDataFrame(ds, "id string, vendor string, host string, port string"), spark.createDataFrame(sv, "id string, name string, image string, ports array<string>"))
    want = [(d, s) for d, v, h, p in ds for s, n, i, o in sv if (v and v.lower() in (i or "").lower()) or (h is not None and h == n) or (p and any(p in x for x in o or []))]
    assert sorted((r.src, r.dst) for r in got.collect()) == sorted(want)
    capsys.readouterr()
    got.explain()
    assert not re.search(r"keys=\[src#\d+, dst#", capsys.readouterr().out)  # a distinct over all pairs
    assert got.rdd.getNumPartitions() >= 3 * 4 * spark.sparkContext.defaultParallelism


def test_yaml_is_read_by_many_tasks(spark):
    few = spark.range(40).coalesce(1).select(F.concat("id", F.lit("/k8s.yaml")).alias("filePath"), F.lit("kind: Service\nmetadata: {name: a}\n").alias("text"))
    rows = files.yaml_rows(few)
    assert rows.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    assert rows.groupBy("value").count().orderBy("value").collect() == [("Service", 40), ("a", 40)]


def test_sequences_carry_codes_and_cross_batches(spark, tables):
    calls = [("r%d" % i, "x", i) for i in range(9)] + [("x", "y%02d" % j, j) for j in range(20)] + [("y03", "x", 1), ("y03", "r1", 2), ("r1", "r1", 9), ("y05", "gone", 1)]
    nodes = spark.createDataFrame([(i, f"name of {i}") for i in sorted({e for a, b, _ in calls for e in (a, b)} - {"gone"})], "id string, name string")
    edges = spark.createDataFrame(calls, "src string, dst string, line int").select("src", F.lit("CALLS").alias("type"), "dst", F.create_map(F.lit("line"), F.col("line").cast("string")).alias("props"))
    out = {}
    for a, b, k in sorted(calls, key=lambda c: (c[0], c[2], c[1])):
        if b != "gone":
            out.setdefault(a, []).append(b)

    def walk(root):
        steps, seen = [], {root}

        def go(at, depth):
            for b in out.get(at, []) if depth <= 8 else []:
                steps.append((f"name of {at}", f"name of {b}", depth, at == b))
                if b not in seen:
                    seen.add(b)
                    go(b, depth + 1)

        go(root, 0)
        return steps

    roots = spark.createDataFrame([(f"r{i}",) for i in range(9)] + [("none",)], "root string")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        for most in (60, 7):
            got = {}
            for r in sequence.sequence(nodes, edges, roots, most).orderBy("root", "step").collect():
                got.setdefault(r.root, []).append((r.caller, r.callee, r.depth, r.self_call))
                assert r.step == len(got[r.root]) - 1 and r.message == r.callee and r.truncated == (len(walk(r.root)) > most)
            assert got == {f"r{i}": walk(f"r{i}")[:most] for i in range(9)}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert {t.dataType.typeName() for name, df in tables if name == "reach" for t in df.schema.fields} == {"long"}


def _small_graph(spark):
    nodes = spark.createDataFrame([(f"{k}{i}", k) for k, n in (("s", 3), ("p", 4), ("o", 5)) for i in range(n)], "id string, label string")
    edges = [("p0", "BY", "s0"), ("p1", "BY", "s0"), ("p2", "BY", "s1"), ("s0", "BY", "p3"), *[(f"o{i}", "HAS", f"p{j}") for i in range(5) for j in range(4) if (i + j) % 3], ("o0", "HAS", "gone"), ("s1", "HAS", "p2")]
    return nodes, spark.createDataFrame(edges, "src string, type string, dst string"), edges


def test_counts_are_summed_hop_by_hop(spark, monkeypatch):
    nodes, e, edges = _small_graph(spark)
    want = {s: sum(1 for a, t, b in edges if t == "BY" and b == s and a[0] == "p" for c, u, d in edges if u == "HAS" and d == a and c[0] == "o") for s in ("s0", "s1", "s2")}
    both = {s: sum(1 for a, t, b in edges if t == "BY" and s in (a, b)) for s in want}
    # no walk may be made for a count of parts without a type in common
    monkeypatch.setattr(cypher.Engine, "found", lambda *a, **k: pytest.fail("walks were made"))
    got = cypher.run(spark, nodes, e, "MATCH (s:s) RETURN s.id AS id, COUNT { (s)<-[:BY]-(:p)<-[:HAS]-(x:o) } AS n, COUNT { (s)-[:BY]-() } AS k")
    assert {r.id: (r.n, r.k) for r in got.collect()} == {s: (want[s], both[s]) for s in want}


def test_counts_of_parts_with_a_common_type_use_each_relationship_once(spark):
    nodes, e, edges = _small_graph(spark)
    got = cypher.run(spark, nodes, e, "MATCH (s:s) RETURN s.id AS id, COUNT { (s)<-[:BY]-(p)-[:BY]->(x) } AS n")
    assert {r.id: r.n for r in got.collect()} == {"s0": 0, "s1": 0, "s2": 0}


def test_closure_joins_edges_as_they_are(spark, monkeypatch):
    nodes, e, _ = _small_graph(spark)
    seen = []
    monkeypatch.setattr(cypher, "written", lambda df, name="table": seen.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or scratch.written(df, name))
    got = cypher.run(spark, nodes, e.unionByName(e), "MATCH (o:o {id: 'o1'})-[*]->(x) RETURN count(DISTINCT x.id) AS n").first().n
    assert got == 4  # p0, p1, p3 and s0
    assert all(plan.count("Aggregate") <= 1 for name, plan in seen if name == "pairs")


@pytest.mark.parametrize("what", ["counts", "dangling"])
def test_edges_with_missing_ends_are_found_without_moving_edges(spark, what):
    nodes = spark.range(5000).select(F.format_string("n%04d", "id").alias("id"))
    edges = spark.range(6000).select(F.format_string("n%04d", F.col("id") % 5001).alias("src"), F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("type"), F.when(F.col("id") != 7, F.format_string("n%04d", (F.col("id") * 3) % 5002)).alias("dst"))
    rows = [(i % 5001, "xy"[i % 2], i * 3 % 5002 if i != 7 else None) for i in range(6000)]
    good = [r for r in rows if r[0] < 5000 and r[2] is not None and r[2] < 5000]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")
    try:
        if what == "counts":
            got = views.edges_by_type(nodes, edges)
            assert {r.type: r.n for r in got.collect()} == {t: sum(r[1] == t for r in good) for t in "xy"}
        else:
            keep, got = upsert.dangling(edges, nodes, ("x",))
            assert keep.count() == sum(r[1] == "x" for r in good)
            assert got.count() == 6000 - sum(r[1] == "x" for r in good)
        plan = got._jdf.queryExecution().toString()
        assert "hashpartitioning(src" not in plan and "hashpartitioning(dst" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_collapsed_hops_meet_edges_of_their_types_alone(spark):
    edges = [(f"o{i % 3}", "DECLARES", f"m{i}") for i in range(9)] + [(f"m{i}", "CALLS", f"m{(i * 2 + 1) % 9}") for i in range(9)] + [(f"m{i}", "MAKES_CALL", f"c{i % 4}") for i in range(9)] + [("o0", "MAKES_CALL", "c0"), ("o1", "OTHER", "c1")]
    present = [(i,) for i in ("o0", "o1", "c0", "c1", "c2")]
    owner = {m: o for o, t, m in edges if t == "DECLARES"}
    want = {(owner[a], t, owner[b] if t == "CALLS" else b) for a, t, b in edges if a in owner and t in ("CALLS", "MAKES_CALL")}
    want = {e for e in want if {e[0], e[2]} <= {i for i, in present} and e[0] != e[2]} - set(edges)
    all_ = spark.createDataFrame(edges, "src string, type string, dst string")
    got = views.collapse_hops(spark.createDataFrame(present, "id string"), all_, all_)
    assert sorted((r.src, r.type, r.dst) for r in got.collect()) == sorted(want)
    assert re.search(r"IN \(CALLS, ?MAKES_CALL\)", got._jdf.queryExecution().optimizedPlan().toString())


def test_leaves_of_a_route_tree_take_one_step(spark, monkeypatch):
    made = []

    def written(df, name="table"):
        made.append((name, scratch.written(df, name)))
        return made[-1][1]

    monkeypatch.setattr(resolve, "written", written)
    monkeypatch.setattr(resolve, "discard", lambda df: None)
    rows = [(0, None, "app", None), (1, 0, "/a/", None), (2, 1, "b", None), (3, 7, "lost", None)] + [(10 + i, i % 4, f"s{i}" if i % 4 != 1 else "same", "/app" if i % 10 == 0 else "../a" if i == 5 else None) for i in range(400)]
    rows += [(1000, None, "x", "/y"), (1001, None, "y", "/z"), (1002, None, "z", "/app"), (1003, None, "u", "/v"), (1004, None, "v", "/u"), (1005, None, "w", "/v")]
    got = {r.id: tuple(r)[1:] for r in resolve.route_tree(spark.createDataFrame(rows, "id int, parent int, segment string, redirect string").withColumn("ord", F.col("id"))).collect()}
    assert len(got) == len(rows)
    assert got[12] == ("app/a/b/s2", "route:app/a/b/s2", None, False) and got[13] == (None, None, None, True) and got[11][:2] == ("app/a/same", "route:app/a/same") and got[19][1] == "route:app/a/same#3"
    assert [got[i][2] for i in (10, 20, 1000, 1001, 1002, 1003, 1004, 1005)] == [0, 0, 0, 0, 0, None, None, None] and got[15][2] == 1
    assert max(df.count() for name, df in made if name in ("pointers", "cyclic", "paths", "ends")) <= 6  # of 410 rows
    assert max(df.count() for name, df in made if name == "redirects") <= 47


def test_layout_broadcasts_no_codes(spark, monkeypatch):
    plans = []

    def written(df, name="table"):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return scratch.written(df, name)

    monkeypatch.setattr(views, "written", written)
    nodes = spark.range(50).select(F.format_string("n%02d", "id").alias("id"), (F.col("id") % 2).alias("tier"))
    edges = spark.range(50).select(F.format_string("n%02d", "id").alias("src"), F.format_string("n%02d", F.col("id") * 7 % 50).alias("dst"))
    got = views.layered_layout(nodes, edges, "tier", 2)
    assert got.count() == 50
    plans.append(("layout", got._jdf.queryExecution().executedPlan().toString()))
    joins = {name: (plan.count("ShuffledHashJoin"), re.search(r"BroadcastHashJoin \[(src|dst|code|id)#", plan)) for name, plan in plans if name != "places"}
    assert set(joins) == {"walk", "centers", "layout"} and all(n and not broadcast for n, broadcast in joins.values())


def test_roots_share_the_walks_of_their_callees(spark, tables):
    rng = random.Random(5)
    names = {i: f"name of {i}" for i in [f"r{i:02d}" for i in range(40)] + [f"m{i:02d}" for i in range(25)]}
    calls = {(f"r{i:02d}", f"m{i % 6:02d}", 1) for i in range(40)} | {(f"r{i:02d}", f"m{rng.randrange(25):02d}", 2) for i in range(40)} | {("r07", "r07", 0), ("m03", "r09", 1), ("m20", "r08", 3)}
    calls |= {(f"m{rng.randrange(25):02d}", f"m{rng.randrange(25):02d}", rng.randrange(9)) for _ in range(60)}
    out, lines = {}, {}
    for a, b, k in calls:
        lines[a, b] = min(k, lines.get((a, b), k))
    for a, b in sorted(lines, key=lambda e: (e[0], lines[e], e[1])):
        out.setdefault(a, []).append(b)

    def walk(root, deep):
        steps, seen = [], {root}

        def go(at, depth):
            for b in out.get(at, []):
                steps.append((names[at], names[b], depth, at == b))
                if b not in seen:
                    seen.add(b)
                    if depth < deep:
                        go(b, depth + 1)

        go(root, 0)
        return steps

    nodes = spark.createDataFrame(list(names.items()), "id string, name string")
    edges = spark.createDataFrame(sorted(calls), "src string, dst string, line int").select("src", F.lit("CALLS").alias("type"), "dst", F.create_map(F.lit("line"), F.col("line").cast("string")).alias("props"))
    roots = [f"r{i:02d}" for i in range(40)]
    for most, deep in ((6, 8), (1, 3), (9, 2), (60, 8), (4, 0)):
        tables.clear()
        got = {}
        for r in sequence.sequence(nodes, edges, spark.createDataFrame([(i,) for i in [*roots, "r00"]], "root string"), most, deep).orderBy("root", "step").collect():
            got.setdefault(r.root, []).append((r.caller, r.callee, r.depth, r.self_call))
            assert r.step == len(got[r.root]) - 1 and r.message == r.callee and r.truncated == (len(walk(r.root, deep)) > most)
        assert got == {r: walk(r, deep)[:most] for r in roots}
        if most == 6:
            assert [df.count() for name, df in tables if name == "roots"][-1] < 15  # of 40


def test_a_large_walk_stays_in_its_buckets(spark, monkeypatch):
    plans = []

    def written(df, name="table"):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return scratch.written(df, name)

    ring = _ring(spark, 60)
    want = sorted(map(tuple, community.communities(ring).collect()))
    monkeypatch.setattr(community, "written", written)
    monkeypatch.setattr(community, "LARGE", 1, raising=False)
    assert sorted(map(tuple, community.communities(ring).collect())) == want
    moves = [plan for name, plan in plans if name == "moved" and "Join" in plan]
    assert moves and all("Bucketed: true" in plan and "BroadcastHashJoin" not in plan for plan in moves)
    assert community.communities(ring.where("a = 'none'")).count() == 0
