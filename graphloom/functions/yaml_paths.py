"""Block YAML as rows: a column expression that gives each scalar the path of keys above it.

The subset is what deployment descriptions are written in: block mappings and sequences,
the same in brackets and braces on one line, quoted and plain scalars, comments, several
documents. A line's place follows from the indents of the lines before it, kept as a stack
in one ordered pass; so does what stands in brackets from the brackets before it. Anchors
and block scalars aren't read, nor brackets that go on in the next line.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ITEM = "-"
_STATE = "struct<doc:int,stack:array<struct<indent:int,key:string>>,out:array<struct<doc:int,path:array<string>,value:string>>,n:int>"


def _let(value: Column, body) -> Column:
    """body of a value that is computed once, however often it stands there."""
    return F.transform(F.array(value), body)[0]


def scalar(text: Column) -> Column:
    """A scalar without its quotes and trailing comment; null for an empty one and for null."""
    bare = F.trim(F.regexp_replace(text, r"\s+#.*$", ""))
    quoted = F.regexp_extract(text, r"""^\s*(?:"((?:[^"\\]|\\.)*)"|'((?:[^']|'')*)')""", 1)
    single = F.regexp_extract(text, r"^\s*'((?:[^']|'')*)'", 1)
    plain = _let(bare, lambda b: F.when(~b.isin("", "~", "null"), b))
    return F.when(F.ltrim(text).startswith('"'), quoted).when(F.ltrim(text).startswith("'"), F.replace(single, F.lit("''"), F.lit("'"))).otherwise(plain)


_FLOW = "struct<path:array<string>,kinds:array<string>,counts:array<int>,key:string,out:array<struct<path:array<string>,value:string>>>"
_FLOW_TOKENS = r"""\"(?:[^\"\\]|\\.)*\"\s*:?|'(?:[^']|'')*'\s*:?|[{}\[\],]|[^{}\[\],\"'\s](?:[^{}\[\],:]|:(?!\s|$))*(?::(?=\s|$))?"""


def _token(s: Column, t: Column) -> Column:
    new = lambda **k: F.struct(*[k.get(f, s[f]).alias(f) for f in ("path", "kinds", "counts", "key", "out")]).cast(_FLOW)
    last = lambda a: F.try_element_at(a, F.lit(-1))
    less = lambda a: F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))
    listed = last(s["kinds"]) == "["
    label = F.when(listed, F.concat(F.lit(ITEM), last(s["counts"]).cast("string"))).otherwise(s["key"])
    below = F.when(F.size(s["kinds"]) == 0, s["path"]).otherwise(F.concat(s["path"], F.array(label)))
    value = scalar(t)
    return (
        F.when(t.isin("{", "["), new(path=below, kinds=F.concat(s["kinds"], F.array(t)), counts=F.concat(s["counts"], F.array(F.lit(0)))))
        .when(t.isin("}", "]"), new(path=F.when(F.size(s["kinds"]) > 1, less(s["path"])).otherwise(s["path"]), kinds=less(s["kinds"]), counts=less(s["counts"])))
        .when(t == ",", F.when(listed, new(counts=F.concat(less(s["counts"]), F.array(last(s["counts"]) + 1)))).otherwise(s))
        .when(t.endswith(":") & ~listed, new(key=scalar(F.regexp_replace(t, r"\s*:$", ""))))
        .when(value.isNotNull(), new(out=F.concat(s["out"], F.array(F.struct(below.alias("path"), value.alias("value"))))))
        .otherwise(s)
    )


def flow(text: Column) -> Column:
    """array<struct<path, value>> of the scalars in a collection in brackets or braces."""
    tokens = F.regexp_extract_all(text, F.lit(_FLOW_TOKENS), F.lit(0))
    start = F.struct(F.array().alias("path"), F.array().alias("kinds"), F.array().alias("counts"), F.lit("").alias("key"), F.array().alias("out")).cast(_FLOW)
    return F.aggregate(tokens, start, _token, lambda s: s["out"])


def _push(state: Column, indent: Column, key: Column) -> Column:
    above = F.filter(state["stack"], lambda s: s["indent"] < indent)
    return F.concat(above, F.array(F.struct(indent.alias("indent"), key.alias("key"))))


def _with(state: Column, **new) -> Column:
    fields = {k: state[k] for k in ("doc", "stack", "out", "n")} | new
    return F.struct(*[v.alias(k) for k, v in fields.items()]).cast(_STATE)


def _emit(state: Column, stack: Column, text: Column) -> Column:
    """The rows so far and the values on a line: one, or those of a collection in brackets."""
    path = F.transform(stack, lambda s: s["key"])
    row = lambda p, v: F.struct(state["doc"].alias("doc"), p.alias("path"), v.alias("value"))
    listed = F.transform(flow(F.regexp_replace(text, r"\s#.*$", "")), lambda x: row(F.concat(path, x["path"]), x["value"]))
    one = _let(scalar(text), lambda v: F.when(v.isNotNull(), F.concat(state["out"], F.array(row(path, v)))).otherwise(state["out"]))
    return F.when(text.rlike(r"^\s*[\[{]"), F.concat(state["out"], listed)).otherwise(one)


def _line(state: Column, line: Column) -> Column:
    blank = line.rlike(r"^\s*(?:#.*)?$")
    fresh = line.rlike(r"^---(?:\s|$)")
    none = F.array().cast("array<struct<indent:int,key:string>>")
    # "- " opens an item, which is a level of its own; what follows it stands deeper
    dash = line.rlike(r"^ *-(?:\s|$)")
    read = _let(dash, lambda d: F.struct(d.alias("dash"), F.length(F.regexp_extract(line, r"^( *)", 1)).alias("indent"), F.when(d, F.regexp_replace(line, r"^ *-\s?", "")).otherwise(line).alias("text")))
    return F.when(blank, state).when(fresh, _with(state, doc=state["doc"] + 1, stack=none)).otherwise(_let(read, lambda x: _opened(state, x)))


def _opened(state: Column, read: Column) -> Column:
    """The state after a line that was read into dash, indent and text."""
    item = _with(state, stack=_push(state, read["indent"], F.concat(F.lit(ITEM), state["n"].cast("string"))), n=state["n"] + 1)
    at = F.when(read["dash"], item).otherwise(state)
    depth = F.when(read["dash"], read["indent"] + 2 + F.length(F.regexp_extract(read["text"], r"^( *)", 1))).otherwise(read["indent"])
    key = F.regexp_extract(read["text"], r"""^\s*(?:"([^"]*)"|'([^']*)'|([^\s:#'"\[{][^:#]*?))\s*:(?:\s|$)""", 0)
    return _let(F.struct(at.alias("at"), depth.alias("depth"), key.alias("key"), read["text"].alias("text"), read["dash"].alias("dash")), _placed)


def _placed(x: Column) -> Column:
    at, key, text = x["at"], x["key"], x["text"]
    name = F.regexp_replace(F.regexp_replace(F.trim(key), r"\s*:\s*$", ""), r"""^["']|["']$""", "")
    # a sequence may stand as deep as the key it belongs to
    rest = F.substring(text, F.length(key) + 1, F.length(text))
    below = F.struct(_push(at, x["depth"], name).alias("stack"), rest.alias("rest"))
    keyed = _let(below, lambda b: _with(at, stack=b["stack"], out=_emit(at, b["stack"], b["rest"])))
    plain = F.when(x["dash"], _with(at, out=_emit(at, at["stack"], text))).otherwise(at)
    return F.when(key != "", keyed).otherwise(plain)


def yaml_paths(text: Column) -> Column:
    """array<struct<doc, path, value>> of the scalars in a YAML text, in order. Items of a
    sequence have keys of their own, - and a number."""
    # items at the indent of their key would take its place: they are set one deeper
    lines = F.transform(F.split(F.regexp_replace(text, "\t", "  "), r"\r?\n"), lambda x: F.regexp_replace(x, r"^( *)(-(?:\s|$))", "$1 $2"))
    empty = F.struct(F.lit(0).alias("doc"), F.array().alias("stack"), F.array().alias("out"), F.lit(0).alias("n")).cast(_STATE)
    return F.aggregate(lines, empty, _line, lambda s: s["out"])
