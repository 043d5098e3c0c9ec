"""Infrastructure and dependencies as a slice of the graph that is made anew and replaced."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graphloom.operators import derive
from graphloom.plans.ontology import EDGES, NODES
from graphloom.sources import files as source

STACK = "infra"


def _nodes(rows: DataFrame, project: str, stack: str, label: str, id_: Column, name: Column, fqn: Column, path: Column, props: dict[str, Column], arrays: dict[str, Column] | None = None) -> DataFrame:
    """rows in the graph's schema."""
    pairs = lambda d: [x for k, v in d.items() for x in (F.lit(k), v)]
    given = {
        "project": F.lit(project), "id": id_, "fqn": fqn, "name": name, "label": F.lit(label), "labels": F.array(F.lit(label)), "stack": F.lit(stack), "filePath": path,
        "startLine": F.lit(0), "endLine": F.lit(0), "hash": F.lit(""), "props": F.map_filter(F.create_map(*pairs(props)), lambda k, v: v.isNotNull()),
        "arr_props": F.create_map(*pairs(arrays)) if arrays else F.lit(None),
    }
    return rows.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(NODES).fields])


def edge_rows(rows: DataFrame, project: str, kind: str, src: str = "src", dst: str = "dst", **props: Column) -> DataFrame:
    """rows (src, dst) as edges of a kind."""
    m = F.create_map(*[x for k, v in props.items() for x in (F.lit(k), v)]) if props else F.lit(None)
    return rows.select(F.lit(project).alias("project"), F.col(src).alias("src"), F.lit(kind).alias("type"), F.col(dst).alias("dst"), m.cast("map<string,string>").alias("props"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _one(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Of rows that share a key the first: files are read in the order of their names."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("r")).select(key, "r.*")


def applications(nodes: DataFrame, stack: str) -> DataFrame:
    """(app): the application of a stack, the least id if there are several; none, then no row."""
    return nodes.where((F.col("label") == "Application") & (F.col("stack") == stack)).agg(F.min("id").alias("app")).where("app is not null")


def infrastructure(nodes: DataFrame, project: str, java: DataFrame | None, angular: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a project's deployment, from the files (filePath, text) of its roots
    and its own nodes.

    Deployments are compose services and manifest objects; CONNECTS_TO leads to what a
    service depends on, and from the client's to the server's application where a
    development proxy points anywhere. Datasources come from application settings: the
    server's application USES_DATASOURCE, the datasource HOSTS every table and is
    PROVIDED_BY services that fit its vendor, host or port. The server's application is
    DEPLOYED_AS the deployments that bear the name its settings give it."""
    roots = [f.select("filePath", "text") for f in (java, angular) if f is not None]
    none = nodes.sparkSession.createDataFrame([], "filePath string, text string")
    every, java, angular = (_union(roots) if roots else none), (none if java is None else java), (none if angular is None else angular)
    lit = F.lit
    services = _one(source.compose_services(every), "name", "filePath")
    services = services.withColumn("id", F.concat(lit(f"infra:deployment:{project}:"), "name"))
    objects = source.k8s_objects(every).withColumn("id", F.concat(lit(f"infra:deployment:{project}:k8s:"), F.lower("kind"), lit(":"), "name"))
    objects = _one(objects, "id", "filePath", "doc")
    url = derive.resolve_placeholders(F.col("url"))
    settings = source.application_settings(java)
    sources = settings.where("url is not null").withColumn("url", url).withColumn("p", derive.jdbc_parts(F.col("url")))
    sources = sources.select("filePath", "url", "username", "driver", "p.*").withColumn("id", F.concat(lit(f"infra:datasource:{project}:"), "dbname"))
    # of settings that name one database the last file's count
    sources = sources.groupBy("id").agg(F.max_by(F.struct(*[c for c in sources.columns if c != "id"]), "filePath").alias("r")).select("id", "r.*")
    fqn = F.substring_index(F.col("id"), "infra:", -1)
    text = lambda c: F.coalesce(F.col(c), lit(""))
    out_n = [
        _nodes(services, project, STACK, "Deployment", F.col("id"), F.col("name"), fqn, F.col("filePath"), {"kind": lit("docker-compose-service"), "image": F.col("image"), "containerName": F.col("container")}, {"ports": F.col("ports")}),
        _nodes(objects, project, STACK, "Deployment", F.col("id"), F.col("name"), fqn, F.col("filePath"), {"kind": F.concat(lit("k8s-"), F.lower("kind")), "image": F.col("image")}),
        _nodes(sources, project, STACK, "Datasource", F.col("id"), F.col("dbname"), fqn, F.col("filePath"), {c: text(c) for c in ("vendor", "url", "host", "port", "username", "driver")}),
    ]
    app, client = applications(nodes, "java"), applications(nodes, "angular").withColumnRenamed("app", "client")
    needs = services.select(F.col("id").alias("src"), F.explode("depends").alias("name")).join(services.select("name", F.col("id").alias("dst")), "name")
    deployed = _union([services.select("name", F.col("id").alias("dst")), objects.where("kind <> 'Service'").select("name", F.col("id").alias("dst"))])
    called = settings.where("application is not null").select(F.col("application").alias("name")).distinct().join(deployed, "name")
    one = F.lit(True)  # app and client are one row each
    out_e = [
        edge_rows(needs, project, "CONNECTS_TO", via=lit("depends_on")),
        edge_rows(source.proxy_targets(angular).agg(F.min("target").alias("target")).where("target is not null").join(F.broadcast(app), one).join(F.broadcast(client), one), project, "CONNECTS_TO", "client", "app", via=lit("dev-proxy"), target=F.col("target")),
        edge_rows(sources.join(F.broadcast(app), one), project, "USES_DATASOURCE", "app", "id"),
        edge_rows(derive.hosts(sources.select(lit(project).alias("project"), "id"), nodes.select(lit(project).alias("project"), "id", "label")), project, "HOSTS"),
        edge_rows(derive.provided_by(sources.select("id", "vendor", "host", "port"), services.select("id", "name", "image", "ports")), project, "PROVIDED_BY"),
        edge_rows(called.join(F.broadcast(app), one), project, "DEPLOYED_AS", "app", "dst"),
    ]
    edges = _union(out_e).dropDuplicates(["project", "src", "type", "dst"])
    return _union(out_n), edges.select(*StructType.fromDDL(EDGES).names)


def dependencies(nodes: DataFrame, project: str, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dependency nodes of the poms among files (filePath, text), DECLARES_DEPENDENCY from the
    server's application, and USES_DEPENDENCY from the types whose file imports from the
    longest group that fits."""
    d = source.pom_dependencies(files).withColumn("id", F.concat(F.lit("java:dependency:"), "groupId", F.lit(":"), "artifactId"))
    d = _one(d, "id", "filePath")
    fqn = F.concat("groupId", F.lit(":"), "artifactId")
    new = _nodes(d, project, "system", "Dependency", F.col("id"), F.col("artifactId"), fqn, F.lit(""), {c: F.col(c) for c in ("groupId", "artifactId", "version", "scope")})
    declared = edge_rows(d.select("id").join(F.broadcast(applications(nodes, "java")), F.lit(True)), project, "DECLARES_DEPENDENCY", "app", "id")
    used = edge_rows(derive.dependency_usage(nodes, files, d.select("id", "groupId")), project, "USES_DEPENDENCY")
    return new, declared.unionByName(used).dropDuplicates(["project", "src", "type", "dst"])


def scenario_slice(project: str, made: DataFrame, covers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scenario nodes and COVERS edges of build_scenarios(), in the graph's schema."""
    fqn = F.substring_index(F.col("id"), "system:", -1)
    n = _nodes(made, project, "system", "Scenario", F.col("id"), F.col("title"), fqn, F.lit(""), {c: F.col(c) for c in ("title", "routePath")}, {"steps": F.col("steps")})
    n = n.drop("summary").join(made.select("id", "summary"), "id").select(*StructType.fromDDL(NODES).names)
    # of several roles of one node the first by name
    e = covers.groupBy("src", "dst").agg(F.min("role").alias("role"))
    return n, edge_rows(e, project, "COVERS", role=F.col("role"))


def replaced(nodes: DataFrame, edges: DataFrame, project: str, gone: Column, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph with one slice of a project (nodes where gone holds, and all edges that touch
    them) in the place of new nodes and edges. The same twice gives the same."""
    own = (F.col("project") == project) & gone
    left = nodes.where(~F.coalesce(own, F.lit(False)))
    ids = nodes.where(own).select("id").distinct()
    keep = edges
    for end in ("src", "dst"):
        keep = keep.join(ids.select(F.col("id").alias(end), F.lit(project).alias("project")), ["project", end], "left_anti")
    keep = keep.join(new_edges.select("project", "src", "type", "dst"), ["project", "src", "type", "dst"], "left_anti")
    return left.unionByName(new_nodes), keep.select(*edges.columns).unionByName(new_edges.select(*edges.columns))
