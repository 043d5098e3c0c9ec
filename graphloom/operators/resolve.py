"""What names and expressions in sources stand for: specifiers, scoped symbols, folded
expressions, route trees, endpoints. Tables in, tables out; every walk is a loop of joins
that ends when nothing is new, whatever the depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import paths
from graphloom.plans.scratch import discard, written

EXTENSIONS = (("", ""), ("", ".ts"), (r"\.js$", ".ts"), ("", "/index.ts"))
"""Ends of a file that a specifier may mean, in order: what goes, and what comes."""


def specifiers(refs: DataFrame, files: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(ref, filePath): the file that each specifier means, if there is one.

    refs: ref, fromFile, spec; files: filePath; aliases: prefix, target. Relative
    specifiers start at the folder of their file; others at the target of the longest
    prefix that they begin with, or are but for its slash. Of the possible files the first
    that exists counts."""
    top = lambda p: F.concat(F.lit("/"), F.array_join(paths.folded(F.split(p, "/")), "/"))
    relative = refs.where(F.col("spec").startswith(".")).select("ref", paths.resolved(F.col("fromFile"), F.col("spec")).alias("base"))
    bases = relative
    if aliases is not None:
        bare = refs.where(~F.col("spec").startswith(".")).select("ref", "spec", F.explode(F.transform(F.sequence(F.lit(1), F.length("spec") + 1), lambda n: F.substring(F.concat("spec", F.lit("/")), F.lit(1), n))).alias("prefix"))
        hit = bare.join(aliases.select("prefix", "target"), "prefix")
        # the longest; of equal prefixes the least target
        best = hit.groupBy("ref", "spec").agg(F.min(F.struct((-F.length("prefix")).alias("n"), "target", "prefix")).alias("b"))
        rest = F.substring("spec", F.length("b.prefix") + 1, F.length("spec"))
        bases = relative.unionByName(best.select("ref", top(F.concat("b.target", rest)).alias("base")))
    ends = F.array(*[F.concat(F.regexp_replace("base", old, "") if old else F.col("base"), F.lit(new)) for old, new in EXTENSIONS])
    c = bases.select("ref", F.posexplode(ends).alias("at", "full"))
    known = files.select("filePath", top(F.col("filePath")).alias("full"))
    return c.join(known, "full").groupBy("ref").agg(F.min_by("filePath", F.struct("at", "filePath")).alias("filePath"))


def scoped_symbols(refs: DataFrame, types: DataFrame, imports: DataFrame) -> DataFrame:
    """(ref, id): the type that a simple name means where it is used. refs: ref, file, package,
    name; types: id, fqn, name, package, file; imports: file, target (a fqn, or a package
    with .*).

    The nearest scope wins: the file itself, its imports, its package, packages imported
    whole, then the least fqn of that name anywhere. Every scope is an equi-join on a
    narrow key; within one the least fqn counts."""
    t = types.select("id", "fqn", "name", "package", "file")
    first = lambda *by: t.groupBy(*by).agg(F.min_by("id", F.struct("fqn", "id")).alias("id"))
    whole = imports.where(F.col("target").endswith(".*")).select("file", F.regexp_replace("target", r"\.\*$", "").alias("package"))
    single = imports.where(~F.col("target").endswith(".*")).select("file", F.col("target").alias("fqn"), F.substring_index("target", ".", -1).alias("name"))
    r = refs.select("ref", "file", F.col("package").alias("own"), "name")
    scopes = [
        r.join(first("file", "name"), ["file", "name"]),
        r.join(single, ["file", "name"]).join(first("fqn"), "fqn"),
        r.withColumnRenamed("own", "package").join(first("package", "name"), ["package", "name"]),
        r.join(whole, "file").join(first("package", "name"), ["package", "name"]),
        r.join(first("name"), "name"),
    ]
    out = None
    for rank, s in enumerate(scopes):
        s = s.select("ref", F.struct(F.lit(rank).alias("rank"), "id").alias("best"))
        out = s if out is None else out.unionByName(s)
    return out.groupBy("ref").agg(F.min("best").alias("best")).select("ref", "best.id")


def hierarchy(uses: DataFrame, types: DataFrame, imports: DataFrame) -> DataFrame:
    """Edges (src, type, dst, via) of types to the types they name. uses: id, file, package,
    type (EXTENDS, IMPLEMENTS, INJECTS), name, via. A type doesn't inject itself."""
    u = uses.withColumn("ref", F.xxhash64("id", "type", "name", "via"))
    got = scoped_symbols(u.select("ref", "file", "package", "name").distinct(), types, imports).select("ref", F.col("id").alias("dst"))
    e = u.join(got, "ref").where((F.col("type") != "INJECTS") | (F.col("id") != F.col("dst")))
    return e.groupBy(F.col("id").alias("src"), "type", "dst").agg(F.min("via").alias("via"))


def inherited_method(wanted: DataFrame, extends: DataFrame, methods: DataFrame) -> DataFrame:
    """(type, name, id): the nearest method of a name up the chain of extends (type, parent),
    however long. wanted: type, name; methods: owner, name, id. A round goes on with what
    hasn't been found and where it hasn't been; of several methods the least id counts."""
    m = methods.groupBy(F.col("owner").alias("here"), "name").agg(F.min("id").alias("id"))
    up = extends.select(F.col("type").alias("here"), "parent").distinct()
    at = written(wanted.select("type", "name", F.col("type").alias("here")).distinct(), "wanted")
    seen, found = at, None
    while not at.isEmpty():
        hit = written(at.join(m, ["here", "name"]).groupBy("type", "name").agg(F.min("id").alias("id")), "found")
        found = hit if found is None else found.unionByName(hit)
        left = at.join(hit, ["type", "name"], "left_anti").join(up, "here").select("type", "name", F.col("parent").alias("here")).distinct()
        at = written(left.join(seen, ["type", "name", "here"], "left_anti"), "wanted")
        seen = seen.unionByName(at)
    return wanted.select("type", "name", F.lit(None).cast(methods.schema["id"].dataType).alias("id")).limit(0) if found is None else found


# expressions

UNKNOWN = paths.WILD
# Fixed value: calls whose first argument is a url.
URL_CALL = r"(?i)endpoint|resourceurl|apiurl|buildurl|tourl"


def folded_expressions(nodes: DataFrame, parts: DataFrame, depth: int = 8) -> DataFrame:
    """(id, value) of all expressions: what is known of each as text, null if nothing is.

    nodes: id, op (text, join, name or call), text; parts: id, ord, part: the parts of a
    join in order, what a name stands for, the first argument of a call. A text is
    itself; a join puts its parts together, {*} for one that isn't known, and is null if
    none is; a name is what it stands for; so is a call, if its name is that of a url
    builder. What lies deeper than `depth` parts isn't known, which cuts cycles too: values
    are worked out for all expressions at once, a round for each depth."""
    base = nodes.select("id", "op", F.when(F.col("op") == "text", F.coalesce("text", F.lit(""))).alias("value"), ((F.col("op") != "call") | F.coalesce("text", F.lit("")).rlike(URL_CALL)).alias("ok"))
    now = written(base.select("id", "value"), "values")
    for _ in range(depth):
        p = parts.join(now.withColumnRenamed("id", "part"), "part", "left").groupBy("id").agg(
            F.count("value").alias("known"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.coalesce("value", F.lit(UNKNOWN)).alias("v")))), lambda x: x["v"]), "").alias("joined"), F.min_by("value", "ord").alias("first"),
        )
        value = F.when(F.col("op") == "text", F.col("value")).when((F.col("op") == "join") & (F.col("known") > 0), F.col("joined")).when((F.col("op") != "join") & F.col("ok"), F.col("first"))
        new = written(base.join(p, "id", "left").select("id", value.alias("value")), "values")
        same = new.join(now.withColumnRenamed("value", "old"), "id").where(~F.col("value").eqNullSafe(F.col("old"))).isEmpty()
        discard(now)
        now = new
        if same:
            break
    return now


# routes


def _tops(tree: DataFrame) -> DataFrame:
    """(id) of the rows of a tree (id, parent) that lie on a cycle or below one: pointers are
    doubled until none moves to a row that has a row above it, or has gone further than there are rows."""
    n = tree.count()
    at = written(tree.select("id", F.col("parent").alias("up")), "pointers")
    far = 1
    while far <= n:
        step = at.select(F.col("id").alias("up"), F.col("up").alias("next"))
        new = written(at.join(step, "up", "left").select("id", F.when(F.col("up").isNotNull(), F.col("next")).alias("up")), "pointers")
        discard(at)
        at, far = new, far * 2
        if at.where("up is not null").isEmpty():
            break
    return at.where("up is not null").select("id")


def route_tree(routes: DataFrame) -> DataFrame:
    """id, path, fqn, target, cyclic of a forest of routes (id, parent, ord, segment, redirect).

    path: the segments from the root, joined; any depth, by doubling: a round joins twice as
    many. fqn: `route:` and the path, with #2, #3, ... for further routes of one path, by
    ord. target: the id of the route that redirects end at (from / or from the parent's
    path), null where they lead nowhere or round in a circle, or the route has none. Rows on or
    below a cycle of parents, or below a parent that isn't there, have no path."""
    clean = F.regexp_replace(F.coalesce("segment", F.lit("")), "^/+|/+$", "")
    base = written(routes.select("id", "parent", "ord", clean.alias("segment"), "redirect"), "routes")
    # walks go over rows that have rows below; all others take one step from those
    inner = written(_met(base.select("id", "parent", "segment"), "parent"), "inner")
    ids = inner.select(F.col("id").alias("parent"))
    lost = inner.where("parent is not null").join(ids, "parent", "left_anti").select("id")
    # below what is lost: as below a cycle
    looped = written(_tops(inner.select("id", "parent").join(lost, "id", "left_anti").unionByName(lost.select("id", F.col("id").alias("parent")))), "cyclic")
    join = lambda a, b: F.when(a == "", b).when(b == "", a).otherwise(F.concat(a, F.lit("/"), b))
    at = written(inner.join(looped, "id", "left_anti").select("id", F.col("parent").alias("up"), F.col("segment").alias("path")), "paths")
    while not at.where("up is not null").isEmpty():
        above = at.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("path").alias("above"))
        new = at.join(above, "up", "left").select("id", F.col("next").alias("up"), F.when(F.col("above").isNull(), F.col("path")).otherwise(join(F.col("above"), F.col("path"))).alias("path"))
        new = written(new, "paths")
        discard(at)
        at = new
    keys = ["id", "ord", "path", "goal"]
    goal = F.when(F.col("redirect").startswith("/"), F.col("redirect")).when(F.col("redirect") != "", F.concat_ws("/", F.coalesce("above", F.lit("")), "redirect"))
    goal = F.array_join(paths.folded(F.split(goal, "/")), "/").alias("goal")
    below = base.where("parent is not null").join(at.select(F.col("id").alias("parent"), F.col("path").alias("above")), "parent", "left")
    below = below.select("id", "ord", F.when(F.col("above").isNotNull(), join(F.col("above"), F.col("segment"))).alias("path"), goal)
    roots = base.where("parent is null").withColumn("above", F.lit(None).cast("string")).select("id", "ord", F.col("segment").alias("path"), goal)
    # rows without a path are dealt by their ids
    number = F.row_number().over(Window.partitionBy("path", F.when(F.col("path").isNull(), F.col("id"))).orderBy("ord", "id"))
    named = written(roots.unionByName(below).select(*keys, number.alias("number")), "named")
    asked = named.where("path is not null and goal is not null").select("id", "goal")
    # of routes with that path the first
    goals = written(asked.select("goal").distinct(), "goals")
    firsts = written(named.where("number = 1 and path is not null").select(F.col("path").alias("goal"), F.col("id").alias("up")).join(goals, "goal"), "firsts")
    ends = _ends(written(asked.join(firsts, "goal").select("id", "up"), "redirects"))
    fqn = F.when(F.col("path").isNotNull(), F.concat(F.lit("route:"), "path", F.when(F.col("number") > 1, F.concat(F.lit("#"), F.col("number"))).otherwise("")))
    to = lambda rows, target: rows.select("id", "path", fqn.alias("fqn"), target.alias("target"), F.col("path").isNull().alias("cyclic"))
    still = named.where("path is null or goal is null")
    return to(still, F.lit(None).cast(base.schema["id"].dataType)).unionByName(to(named.where("path is not null and goal is not null").join(ends, "id", "left"), F.col("target")))


def _met(rows: DataFrame, by: str) -> DataFrame:
    """Those of rows whose id some row's column `by` names."""
    return rows.join(rows.where(F.col(by).isNotNull()).select(F.col(by).alias("id")).distinct(), "id", "left_semi")


def _ends(hops: DataFrame) -> DataFrame:
    """(id, target) at the end of hops (id, up), of those that have an end."""
    inner = written(_met(hops, "up"), "inner")
    if inner.isEmpty():
        return hops.select("id", F.col("up").alias("target"))
    back = written(_tops(inner.select("id", F.col("up").alias("parent"))), "circles")
    at = written(inner.join(back, "id", "left_anti").select("id", F.col("up").alias("target")), "ends")
    while True:
        step = at.select(F.col("id").alias("target"), F.col("target").alias("next"))
        new = written(at.join(step, "target", "left").select("id", F.coalesce("next", "target").alias("target"), F.col("next").isNotNull().alias("moved")), "ends")
        discard(at)
        at = new
        if at.where("moved").isEmpty():
            break
    last = hops.join(back.withColumnRenamed("id", "up"), "up", "left_anti").join(at.select(F.col("id").alias("up"), "target"), "up", "left")
    return last.select("id", F.coalesce("target", "up").alias("target"))


def flat_routes(routes: DataFrame) -> DataFrame:
    """(id, path) of a tree of routes (id, parent, segment): segments joined from the root."""
    more = {c: F.lit(None).cast(kind) for c, kind in (("ord", "long"), ("redirect", "string")) if c not in routes.columns}
    return route_tree(routes.withColumns(more) if more else routes).where("not cyclic").select("id", "path")


# nesting in texts

_TREE = "struct<open:array<struct<at:int,name:string>>,out:array<struct<at:int,name:string,parent:int,parent_name:string>>>"
# Fixed value: elements without an end.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")


def element_parents(html: Column) -> Column:
    """array<struct<at, name, parent, parent_name>>: the elements of a page in order, each
    with the innermost one that is open where it begins (parent -1: none). An end tag
    closes the last open element of its name and all within it; without one it is ignored.
    Comments, scripts' and styles' contents are no elements."""
    bare = F.regexp_replace(F.lower(html), r"(?s)<!--.*?-->|(?<=<script)([^>]*)>.*?(?=</script)|(?<=<style)([^>]*)>.*?(?=</style)", ">")
    tags = F.regexp_extract_all(bare, F.lit(r"</?[a-z][a-z0-9]*"), 0)

    def step(state: Column, tag: Column) -> Column:
        end, name, at = tag.startswith("</"), F.regexp_replace(tag, "^</?", ""), F.size(state["out"])
        top = F.try_element_at(state["open"], F.lit(-1))
        row = F.struct(at.alias("at"), name.alias("name"), F.coalesce(top["at"], F.lit(-1)).alias("parent"), top["name"].alias("parent_name"))
        opened = F.when(name.isin(*VOID), state["open"]).otherwise(F.concat(state["open"], F.array(F.struct(at.alias("at"), name.alias("name")))))
        last = F.size(state["open"]) - F.array_position(F.reverse(F.transform(state["open"], lambda o: o["name"])), name).cast("int")
        closed = F.when(F.array_contains(F.transform(state["open"], lambda o: o["name"]), name), F.slice(state["open"], F.lit(1), F.greatest(last, F.lit(0)))).otherwise(state["open"])
        begun = F.struct(opened.alias("open"), F.concat(state["out"], F.array(row)).alias("out"))
        return F.when(end, F.struct(closed.alias("open"), state["out"].alias("out"))).otherwise(begun).cast(_TREE)

    return F.aggregate(tags, F.struct(F.array().alias("open"), F.array().alias("out")).cast(_TREE), step, lambda s: s["out"])


# Annotations that map a method, and their verbs.
VERBS = {"GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "DeleteMapping": "DELETE", "PatchMapping": "PATCH"}
_TOKENS = (
    r'@\w+(?:\s*\((?:[^()"]|"(?:[^"\\]|\\.)*"|\([^()]*\))*\))?|\b(?:class|interface|record|enum)\s+\w+|"(?:[^"\\]|\\.)*"|\b\w+\s*(?=\()|[{};]'
)
_CODE = "struct<depth:int,types:array<struct<name:string,base:string,depth:int>>,notes:array<string>,out:array<struct<type:string,method:string,verb:string,path:string>>>"


def _note_path(note: Column) -> Column:
    args = F.regexp_extract(note, r"(?s)\((.*)\)$", 1)
    named = F.regexp_extract(args, r'(?s)\b(?:value|path)\s*=\s*\{?\s*"([^"]*)"', 1)
    return F.when(named != "", named).otherwise(F.regexp_extract(args, r'(?s)^\s*\{?\s*"([^"]*)"', 1))


def endpoints(text: Column) -> Column:
    """array<struct<type, method, verb, path>> of the endpoints that a Java source declares:
    mapped methods, each with the path of the innermost type around it. One ordered pass over
    annotations, types, braces and names keeps the open types as a stack."""
    code = F.regexp_replace(text, r'(?s)("(?:[^"\\\n]|\\.)*")|//[^\n]*|/\*.*?\*/', "$1")
    tokens = F.regexp_extract_all(code, F.lit(_TOKENS), 0)
    none = F.array().cast("array<string>")

    def step(s: Column, t: Column) -> Column:
        new = lambda **k: F.struct(*[(k.get(f, s[f])).alias(f) for f in ("depth", "types", "notes", "out")]).cast(_CODE)
        named = lambda n: n.rlike(r"^@(?:" + "|".join(VERBS) + r"|RequestMapping)\b")
        note = F.try_element_at(F.filter(s["notes"], named), F.lit(1))
        top = F.try_element_at(s["types"], F.lit(-1))
        verb = F.nullif(F.regexp_extract(note, r"\bRequestMethod\.(\w+)", 1), F.lit(""))
        for name, v in VERBS.items():
            verb = F.when(note.rlike(rf"^@{name}\b"), v).otherwise(verb)
        row = F.struct(top["name"].alias("type"), F.trim(t).alias("method"), F.coalesce(verb, F.lit("ANY")).alias("verb"), paths.join_paths(top["base"], _note_path(note)).alias("path"))
        base = F.coalesce(_note_path(F.try_element_at(F.filter(s["notes"], lambda n: n.rlike(r"^@RequestMapping\b")), F.lit(1))), F.lit(""))
        opened = F.concat(s["types"], F.array(F.struct(F.regexp_extract(t, r"(\w+)$", 1).alias("name"), base.alias("base"), s["depth"].alias("depth"))))
        less = s["depth"] - 1
        method = note.isNotNull() & top.isNotNull() & (s["depth"] == top["depth"] + 1)
        return (
            F.when(t.startswith("@"), new(notes=F.concat(s["notes"], F.array(t))))
            .when(t.rlike(r"^(?:class|interface|record|enum)\s"), new(types=opened, notes=none))
            .when(t == "{", new(depth=s["depth"] + 1, notes=none))
            .when(t == "}", new(depth=less, types=F.filter(s["types"], lambda x: x["depth"] < less), notes=none))
            .when(t == ";", new(notes=none))
            .when(t.startswith('"') | ~method, s)
            .otherwise(new(out=F.concat(s["out"], F.array(row)), notes=none))
        )

    start = F.struct(F.lit(0).alias("depth"), F.array().alias("types"), F.array().alias("notes"), F.array().alias("out")).cast(_CODE)
    return F.aggregate(tokens, start, step, lambda s: s["out"])
