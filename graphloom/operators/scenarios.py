"""Use-case traces from routes to tables, and the scenarios built from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.order import numbered
from graphloom.plans.scratch import written

COVERED = (("route", "Route"), ("component", "Component"), ("apicall", "API"), ("endpoint", "Endpoint"), ("entity", "Entity"), ("table", "Table"))


def _follow(rows: DataFrame, step: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """(id, block, bits) one step (a, b) further, at ends (id) alone."""
    far = rows.join(step.select(F.col("a").alias("id"), F.col("b").alias("next")), "id").select(F.col("next").alias("id"), "block", "bits")
    return _merged(far if ends is None else far.join(ends, "id", "left_semi"))


def _merged(rows: DataFrame) -> DataFrame:
    return rows.groupBy("id", "block").agg(F.bit_or("bits").alias("bits"))


def walked(rows: DataFrame, step: DataFrame, most: int, ends: DataFrame | None = None) -> DataFrame:
    """(id, block, bits) of rows and of what 0 to most steps (a, b) reach from there, at ends (id)
    alone; a round goes on from what the round before found."""
    seen = front = rows
    for _ in range(most):
        old = _merged(seen).withColumnRenamed("bits", "old")
        new = _follow(front, step, ends).join(old, ["id", "block"], "left").select("id", "block", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("old", F.lit(0).cast("long")))).alias("bits"))
        front = written(new.where("bits <> 0"), "walk")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return _merged(seen)


def trace(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(route, role, id): what a route reaches, each leg distinct before the next, so that
    independent legs don't multiply. On the way 64 routes are the bits of one row. What a leg
    starts from has its label already; only where it ends is looked at, after the step."""
    of = lambda *labels: nodes.where(F.col("label").isin(*labels)).select("id")
    hop = lambda t: edges.where(F.col("type") == t).select(F.col("src").alias("a"), F.col("dst").alias("b"))
    into = lambda t, label: hop(t).join(of(label).withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b")
    leg = lambda rows, t, label: written(_follow(rows, hop(t), of(label)), "leg")  # noqa: E731  each is read again by the next and by the result
    bit = (F.col("number") % 64).cast("int")
    routes = written(numbered(of("Route").distinct(), ["id"]).select(F.col("id").alias("route"), F.floor(F.col("number") / 64).alias("block"), bit.alias("bit")), "routes")
    start = routes.select(F.col("route").alias("id"), "block", F.expr("shiftleft(1L, bit)").alias("bits"))
    comps = walked(leg(start, "NAVIGATES_TO", "Component"), hop("RENDERS"), 2, of("Component"))
    calls = written(into("CALLS", "Method"), "calls")
    api = leg(walked(leg(comps, "DECLARES", "Method"), calls, 3), "MAKES_CALL", "ApiCall")
    endpoints = leg(api, "INVOKES_API", "Endpoint")
    server = walked(leg(endpoints, "HANDLED_BY", "Method"), calls, 4)
    owned = hop("DECLARES").join(of("Repository").withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("a"), F.col("a").alias("b"))
    maps = into("MAPS_TO", "Table")
    entities = _follow(_follow(server, owned), hop("MANAGES"), of("Entity")).join(maps.select(F.col("a").alias("id")), "id", "left_semi")  # an entity counts with its table
    entities = written(entities, "leg")
    out = routes.select("route", F.lit("route").alias("role"), F.col("route").alias("id"))
    for role, part in (("component", comps), ("apicall", api), ("endpoint", endpoints), ("entity", entities), ("table", _follow(entities, maps))):
        part = part.join(routes.withColumnRenamed("block", "of"), (F.col("block") == F.col("of")) & (F.getbit("bits", F.col("bit")) == 1))
        out = out.unionByName(part.select("route", F.lit(role).alias("role"), "id"))
    return out


def build_scenarios(nodes: DataFrame, traced: DataFrame, project: str, names: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Scenarios (id, title, summary, routePath, steps) and COVERS rows (src, dst, role)
    of the routes that reach a component or an endpoint, to what is a node. traced: as of
    trace(). names: routePath, title, summary from elsewhere; otherwise the title says the path. Routes of equal path share a
    scenario: the last by id names its steps."""
    info = nodes.select("id", "name", F.col("props")["httpMethod"].alias("verb"), F.coalesce(F.col("props")["normalizedPath"], F.col("props")["path"]).alias("path"), F.col("props")["routePath"].alias("routePath"))
    rows = traced.join(info, "id")
    good = traced.where(F.col("role").isin("component", "endpoint")).select("route").distinct()
    paths = written(rows.where("role = 'route'").select("route", F.coalesce("routePath", F.lit("")).alias("routePath")).join(good, "route"), "paths")
    last = paths.groupBy("routePath").agg(F.max("route").alias("route"))
    sid = F.concat(F.lit(f"system:scenario:{project}:"), F.when(F.col("routePath") == "", "root").otherwise(F.col("routePath")))
    # only routes that share a path can bring a row twice
    shared = paths.withColumn("routes", F.count("*").over(Window.partitionBy("routePath")))
    there = traced.join(nodes.select("id"), "id", "left_semi")
    covered = lambda some: there.join(some, "route").select(sid.alias("src"), F.col("id").alias("dst"), "role")
    covers, twice = covered(shared.where("routes = 1")), shared.where("routes > 1")
    if not twice.isEmpty():
        covers = covers.unionByName(covered(twice).distinct())
    order = F.array_position(F.array(*[F.lit(r) for r, _ in COVERED]), F.col("role"))
    kind = F.create_map(*[F.lit(x) for pair in COVERED for x in pair])[F.col("role")]
    said = F.when(F.col("role") == "route", F.concat(F.lit("/"), "p")).when(F.col("role").isin("apicall", "endpoint"), F.concat_ws(" ", "verb", "path")).otherwise(F.col("name"))
    steps = rows.drop("routePath").join(last.withColumnRenamed("routePath", "p"), "route").groupBy("p").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "id", F.concat_ws(" ", kind, said).alias("s")))).alias("x"))
    out = steps.select(F.col("p").alias("routePath"), F.transform("x", lambda x: x["s"]).alias("steps"))
    title = F.when(F.col("routePath") == "", "Landing screen").otherwise(F.concat(F.lit("Screen: /"), "routePath"))
    if names is not None:
        out = out.join(names.select("routePath", F.col("title").alias("t"), F.col("summary").alias("s")), "routePath", "left")
        return out.select(sid.alias("id"), F.coalesce("t", title).alias("title"), F.coalesce("s", F.lit("")).alias("summary"), "routePath", "steps"), covers
    return out.select(sid.alias("id"), title.alias("title"), F.lit("").alias("summary"), "routePath", "steps"), covers


def coverage_by_label(covers: DataFrame, nodes: DataFrame, most: int = 1_000) -> DataFrame:
    """scenario, label, n, covered array<struct<id,name>>: how many nodes of a label a scenario
    covers, and the first of them by id, at most so many: they are cut before they are
    gathered."""
    keys = ["scenario", "label"]
    rows = covers.select(F.col("src").alias("scenario"), F.col("dst").alias("id")).distinct().join(nodes.select("id", "label", "name"), "id")
    first = rows.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("id"))).where(F.col("k") <= most)
    lists = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("id", "name"))).alias("covered"))
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).join(lists, keys)


def top_scenarios(covers: DataFrame, k: int = 3) -> DataFrame:
    """The k scenarios that cover most; ties by id."""
    return covers.groupBy(F.col("src").alias("scenario")).agg(F.count("*").alias("covered")).orderBy(F.desc("covered"), "scenario").limit(k)


def suggestions(nodes: DataFrame, edges: DataFrame, covers: DataFrame, most: int = 6) -> DataFrame:
    """(rank, question): the scenarios that cover most, the table with most relations,
    endpoints nobody calls, authentication if at least 3 nodes name it, and a constant one."""
    spark = nodes.sparkSession
    names = nodes.select(F.col("id").alias("scenario"), F.col("name").alias("title"))
    top = top_scenarios(covers).join(names, "scenario", "left").select(F.lit(1).alias("rank"), (-F.col("covered")).alias("o"), F.concat(F.lit("How does "), F.coalesce("title", "scenario"), F.lit(" work?")).alias("question"))
    ends = edges.where("type = 'RELATES_TO'").select(F.explode(F.array("src", "dst")).alias("id"))
    tables = edges.where("type = 'MAPS_TO'").join(ends, edges["src"] == ends["id"]).groupBy("dst").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dst").limit(1)
    table = tables.join(nodes.select(F.col("id").alias("dst"), "name"), "dst").select(F.lit(2).alias("rank"), F.lit(0).cast("long").alias("o"), F.concat(F.lit("What depends on table "), "name", F.lit("?")).alias("question"))
    free = nodes.where("label = 'Endpoint'").join(edges.where("type = 'INVOKES_API'").select(F.col("dst").alias("id")), "id", "left_anti").agg(F.count("*").alias("n")).where("n > 0")
    unused = free.select(F.lit(3).alias("rank"), F.lit(0).cast("long").alias("o"), F.concat(F.lit("Which "), F.col("n").cast("string"), F.lit(" endpoints does no client call?")).alias("question"))
    guard = nodes.agg(F.count_if(F.lower("name").contains("auth") | F.lower("name").contains("security")).alias("n")).where("n >= 3")
    auth = guard.select(F.lit(4).alias("rank"), F.lit(0).cast("long").alias("o"), F.lit("How does authentication work?").alias("question"))
    always = spark.range(1).select(F.lit(5).alias("rank"), F.lit(0).cast("long").alias("o"), F.lit("What are the main parts of this system?").alias("question"))
    rows = top.unionByName(table).unionByName(unused).unionByName(auth).unionByName(always)
    return rows.orderBy("rank", "o", "question").limit(most).select("rank", "question")
