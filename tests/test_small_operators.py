from pyspark.sql import functions as F
from test_graph import edges_of, nodes_of

from graphloom.operators import community, derive, linker, scenarios, upsert, views


def test_candidates_and_their_summaries(spark):
    n = nodes_of(spark, [("hub", "Service"), ("done", "Service"), ("file", "File"), *[(f"m{i:02}", "Controller") for i in range(40)]])
    n = n.withColumn("summary", F.when(F.col("id") == "done", "said")).withColumn("tags", F.lit(None).cast("array<string>"))
    e = edges_of(spark, [("hub", "CALLS", f"m{i:02}") for i in range(40)] + [("hub", "CALLS", "hub"), ("file", "DECLARES", "hub")])
    got = {x.id: x for x in community.enrich_candidates(n, e, ("Service", "Controller"), limit=30).collect()}
    assert len(got) == 30 and "hub" in got and "done" not in got and "file" not in got
    near = [tuple(x) for x in got["hub"].neighbours]
    assert near == sorted([("CALLS", "hub"), *[("CALLS", f"m{i:02}") for i in range(40)], ("DECLARES", "file")])[:25]
    assert [tuple(x) for x in got["m00"].neighbours] == [("CALLS", "hub")]
    said = spark.createDataFrame([("hub", "x" * 3000, list("abcdefghij")), ("gone", "y", [])], "id string, summary string, tags array<string>")
    after = {x.id: x for x in community.summaries(n, said).collect()}
    assert len(after) == 43 and len(after["hub"].summary) == 2000 and after["hub"].tags == list("abcdefgh") and after["done"].summary == "said"


def test_covered_nodes_are_cut_before_they_are_gathered(spark):
    n = nodes_of(spark, [(f"t{i}", "Table") for i in range(9)] + [("e", "Entity")])
    covers = spark.createDataFrame([("s", f"t{i}", "table") for i in range(9)] + [("s", "e", "entity"), ("s", "t0", "other")], "src string, dst string, role string")
    got = {x.label: (x.n, [y.id for y in x.covered]) for x in scenarios.coverage_by_label(covers, n, most=4).collect()}
    assert got == {"Table": (9, ["t0", "t1", "t2", "t3"]), "Entity": (1, ["e"])}


def test_columns_from_sources(spark):
    notes = "@Async @Transactional(readOnly = true) @Scheduled(fixedDelay = 5)"
    text = 'kafka.send("orders", x); t.convertAndSend( "mail" ); @KafkaListener(topics = "bills") void f() {}'
    one = spark.range(1).select(derive.process_flags(F.lit(notes)).alias("f"), derive.process_flags(F.lit("@AsyncX")).alias("none"), derive.topics(F.lit(text)).alias("t"), derive.type_label(F.array(F.lit("Entity"), F.lit("Component"))).alias("l"), linker.controller_of(F.lit("com.x.OrderController#list")).alias("c")).first()
    assert tuple(one.f) == (True, True, "fixedDelay = 5") and tuple(one.none) == (False, False, None)
    assert [tuple(x) for x in one.t] == [("PUBLISHES_TO", "orders"), ("PUBLISHES_TO", "mail"), ("CONSUMES_FROM", "bills")]
    assert one.l == "Entity" and one.c == "OrderController"


def test_first_best_and_payload(spark):
    rows = spark.createDataFrame([("a", 2, 0.5), ("a", 1, 0.5), ("a", 3, 0.4), ("b", 9, None)], "k string, o int, s double")
    assert {(x.k, x.o) for x in upsert.first_wins(rows, ["k"], "o").collect()} == {("a", 1), ("b", 9)}
    assert {(x.k, x.o) for x in linker.best_of(rows, "k", "s", "o").collect()} == {("a", 1), ("b", 9)}
    e = edges_of(spark, [("a", "CALLS", "b"), ("a", "CALLS", "b"), ("b", "CALLS", "a")])
    assert {(x.id, x.source, x.target) for x in views.edge_payload(e).collect()} == {("a|CALLS|b", "a", "b"), ("b|CALLS|a", "b", "a")}
