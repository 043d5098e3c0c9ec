"""Project files: scans, stack detection, deployment and dependency descriptions.

Files are read with Spark's binaryFile source, so that any store Spark reads will do. What
they say is read by column expressions alone (YAML: functions/yaml_paths.py).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.yaml_paths import yaml_paths

# Folders that no scan enters.
SKIPPED = (".git", "node_modules", "target", "build", "dist", ".angular")
_SKIP = "/(?:" + "|".join(x.replace(".", r"\.") for x in SKIPPED) + ")/"


def scan(spark: SparkSession, root: str, glob: str = "*", text: bool = True) -> DataFrame:
    """filePath (below root), text of the files whose name matches glob, skipped folders left out."""
    root = root.rstrip("/")
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    bare = F.regexp_extract("path", r"^(?:[a-z0-9]+:)?/*(/.*)$", 1)
    below = F.substring_index(bare, root.split("://")[-1].rstrip("/") + "/", -1)
    df = df.withColumn("filePath", below).where(~F.concat(F.lit("/"), "filePath").rlike(_SKIP))
    return df.select("filePath", F.decode("content", "UTF-8").alias("text")) if text else df.select("filePath")


def java_roots(files: DataFrame) -> DataFrame:
    """(root): distinct folders .../src/main/java, sorted."""
    return files.select(F.regexp_extract("filePath", r"^(.*?src/main/java)/", 1).alias("root")).where("root <> ''").distinct().orderBy("root")


def ts_files(files: DataFrame) -> DataFrame:
    """TypeScript sources without specs and declarations, sorted."""
    return files.where(F.col("filePath").rlike(r"\.ts$") & ~F.col("filePath").rlike(r"\.(?:spec|d)\.ts$")).orderBy("filePath")


def detect_stacks(files: DataFrame, depth: int = 4) -> DataFrame:
    """(stack, root): the shallowest folder of each stack, ties by name. Java: a build file
    beside src/main/java; Angular: angular.json, or a package that names the framework."""
    folder = F.when(F.col("filePath").contains("/"), F.regexp_replace("filePath", "/[^/]*$", "")).otherwise("")
    f = files.withColumn("folder", folder).withColumn("name", F.element_at(F.split("filePath", "/"), -1))
    main = files.select(F.regexp_extract("filePath", r"^(?:(.*)/)?src/main/java/", 1).alias("folder"), F.col("filePath").rlike(r"(?:^|/)src/main/java/").alias("ok")).where("ok").select("folder").distinct()
    java = f.where(F.col("name").isin("pom.xml", "build.gradle", "build.gradle.kts")).join(main, "folder", "left_semi").select(F.lit("java").alias("stack"), F.col("folder").alias("root"))
    angular = f.where((F.col("name") == "angular.json") | ((F.col("name") == "package.json") & F.col("text").contains('"@angular/core"'))).select(F.lit("angular").alias("stack"), F.col("folder").alias("root"))
    level = F.when(F.col("root") == "", 0).otherwise(F.size(F.split("root", "/")))
    return java.unionByName(angular).withColumn("level", level).where(F.col("level") <= depth).groupBy("stack").agg(F.min_by("root", F.struct("level", "root")).alias("root"))


def yaml_rows(files: DataFrame) -> DataFrame:
    """filePath, doc, ord, path, value of every scalar in YAML files (filePath, text). Reading
    takes far longer than fetching the text, so that files are dealt to a set number of tasks
    first, by path, as what gathers a file's rows needs them."""
    spark = files.sparkSession
    n = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return files.repartition(n, "filePath").select("filePath", F.posexplode(yaml_paths(F.col("text"))).alias("ord", "r")).select("filePath", "r.doc", "ord", "r.path", "r.value")


def _at(*keys: str | None) -> Column:
    """path begins with these keys; None stands for any one."""
    out = F.size("path") >= len(keys)
    for i, k in enumerate(keys):
        if k is not None:
            out &= F.get("path", F.lit(i)) == k
    return out


def _first(when: Column) -> Column:
    return F.min_by(F.when(when, F.col("value")), F.when(when, F.col("ord")))


def _all(when: Column, value: Column) -> Column:
    """The values where when holds, in order."""
    return F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("ord", value.alias("v"))))), lambda x: x["v"])


# Names of compose files, and folders whose YAML files are compose files.
COMPOSE = r"(?:^|/)(?:docker-compose[^/]*|compose)\.ya?ml$|(?:^|/)docker/[^/]*\.ya?ml$"


def compose_services(files: DataFrame) -> DataFrame:
    """filePath, name, image, container, ports, depends of the services in compose files. A
    service has at least one key with a value."""
    rows = yaml_rows(files.where(F.col("filePath").rlike(COMPOSE))).where(_at("services", None, None) & (F.col("doc") == 0))
    key, deep = F.get("path", F.lit(2)), F.size("path")
    # depends_on: a sequence of names, or a mapping whose keys are names
    item = F.get("path", F.lit(3)).startswith("-") & (deep == 4)
    got = rows.withColumn("name", F.get("path", F.lit(1))).groupBy("filePath", "name").agg(
        _first((key == "image") & (deep == 3)).alias("image"), _first((key == "container_name") & (deep == 3)).alias("container"),
        _all((key == "ports") & item, F.col("value")).alias("ports"), F.array_distinct(_all((key == "depends_on") & (deep > 3), F.when(item, F.col("value")).otherwise(F.get("path", F.lit(3))))).alias("depends"),
    )
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return got.select("filePath", "name", empty("image"), empty("container"), "ports", "depends")


# Kinds that are deployments.
KINDS = ("Deployment", "StatefulSet", "DaemonSet", "Service")


def k8s_objects(files: DataFrame) -> DataFrame:
    """filePath, doc, kind, name, image of deployments and services in YAML manifests, with the
    image of the first container that has one. Compose and application files aren't manifests."""
    other = F.col("filePath").rlike(COMPOSE) | F.col("filePath").rlike(r"docker-compose[^/]*$|(?:^|/)application[^/]*$")
    rows = yaml_rows(files.where(F.col("filePath").rlike(r"\.ya?ml$") & ~other & F.col("text").contains("kind:")))
    image = _at("spec", "template", "spec", "containers", None, "image") & (F.size("path") == 6)
    got = rows.groupBy("filePath", "doc").agg(_first(_at("kind") & (F.size("path") == 1)).alias("kind"), _first(_at("metadata", "name") & (F.size("path") == 2)).alias("name"), _first(image).alias("image"))
    return got.where(F.col("kind").isin(*KINDS)).select("filePath", "doc", "kind", F.coalesce("name", F.lit("unnamed")).alias("name"), F.coalesce("image", F.lit("")).alias("image"))


# Settings that describe a datasource and its application.
SETTINGS = {"url": "spring.datasource.url", "username": "spring.datasource.username", "driver": "spring.datasource.driver-class-name", "application": "spring.application.name"}


def application_settings(files: DataFrame) -> DataFrame:
    """filePath, url, username, driver, application from application.yml and .properties."""
    rows = yaml_rows(files.where(F.col("filePath").rlike(r"(?:^|/)application[^/]*\.ya?ml$"))).where("doc = 0")
    name = F.array_join("path", ".")
    yml = rows.groupBy("filePath").agg(*[_first(name == key).alias(n) for n, key in SETTINGS.items()])
    p = files.where(F.col("filePath").rlike(r"(?:^|/)application[^/]*\.properties$"))
    value = lambda key: F.nullif(F.trim(F.regexp_extract("text", rf"(?m)^\s*{key}\s*=(.*)$", 1)), F.lit(""))
    return yml.unionByName(p.select("filePath", *[value(k.replace(".", r"\.")).alias(n) for n, k in SETTINGS.items()]))


def proxy_targets(files: DataFrame) -> DataFrame:
    """(target): distinct targets of development proxies."""
    p = files.where(F.col("filePath").rlike(r"(?:^|/)proxy\.conf\.json$")).select(F.from_json("text", "map<string,struct<target:string>>").alias("m"))
    return p.select(F.explode(F.map_values("m")).alias("t")).select("t.target").where("target is not null").distinct()


def pom_dependencies(files: DataFrame) -> DataFrame:
    """filePath, groupId, artifactId, version, scope of a pom's own dependencies: not those
    under dependencyManagement, and a plugin's neither."""
    p = files.where(F.col("filePath").rlike(r"(?:^|/)pom\.xml$"))
    bare = F.regexp_replace("text", r"(?s)<dependencyManagement>.*?</dependencyManagement>|<!--.*?-->|<build>.*?</build>", "")
    d = p.select("filePath", F.explode(F.regexp_extract_all(bare, F.lit(r"(?s)<dependency>(.*?)</dependency>"), 1)).alias("d"))
    d = d.withColumn("d", F.regexp_replace("d", r"(?s)<exclusions>.*?</exclusions>", ""))
    tag = lambda t: F.nullif(F.regexp_extract("d", rf"(?s)<{t}>\s*(.*?)\s*</{t}>", 1), F.lit("")).alias(t)
    return d.select("filePath", *[tag(t) for t in ("groupId", "artifactId", "version", "scope")]).where("groupId is not null and artifactId is not null")


def tsconfig_aliases(files: DataFrame) -> DataFrame:
    """(alias, target): path aliases of tsconfig files, comments and trailing commas aside."""
    bare = F.regexp_replace(F.regexp_replace("text", r"(?s)/\*.*?\*/|(?m)^\s*//.*$", ""), r",(\s*[}\]])", "$1")
    t = files.where(F.col("filePath").rlike(r"(?:^|/)tsconfig[^/]*\.json$")).select(F.from_json(bare, "compilerOptions struct<paths:map<string,array<string>>>").alias("c"))
    return t.select(F.explode("c.compilerOptions.paths").alias("alias", "targets")).select("alias", F.explode("targets").alias("target"))
