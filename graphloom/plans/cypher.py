"""A read-only subset of the graph query language, compiled to DataFrames.

A row is a row: node and relationship variables are struct columns, patterns are joins.
Relationships of one MATCH are pairwise different. Variable-length parts start at the ids
bound so far and walk on until nothing new is found, whatever the number of hops: trails
where their number or their relationships matter, else pairs of ends by a semi-naive
closure. OPTIONAL MATCH, pattern predicates, EXISTS {}, COUNT {} and CALL {} subqueries run
over the distinct bound variables they use and are joined back to them; a predicate that
doesn't stand alone becomes a column (how often it matched) that any expression may use.
Clauses that write are rejected by the parser, wherever they stand, and only there: words
in strings are text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.plans.scratch import discard, written

LAZY_HOPS = 4
"""Longer walks write each level to the shared folder, so that plans stay flat and a walk ends when nothing is new."""
_TOKEN = re.compile(
    r"\s+|//[^\n]*|/\*.*?\*/|(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<num>\d+\.\d+(?:[eE][+-]?\d+)?|\d+)|(?P<par>\$\w+)"
    r"|(?P<name>[A-Za-z_]\w*|`[^`]+`)|(?P<op><=|>=|<>|=~|\.\.|[-+*/%^=<>()\[\]{}:,.|;])",
    re.S,
)
WRITES = {"CREATE", "MERGE", "SET", "DELETE", "DETACH", "REMOVE", "DROP", "FOREACH", "LOAD"}
CLAUSES = {"MATCH", "OPTIONAL", "WITH", "RETURN", "UNWIND", "CALL", "UNION", "WHERE", "ORDER", "SKIP", "LIMIT", "YIELD"} | WRITES
AGGREGATES = {"count", "collect", "min", "max", "sum", "avg", "stdev", "percentilecont"}


class CypherError(ValueError):
    """A query that isn't in the subset, or that writes."""


@dataclass(frozen=True)
class Tok:
    kind: str
    text: str


def tokens(text: str) -> list[Tok]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise CypherError(f"unexpected {text[at : at + 12]!r}")
        at = m.end()
        if m.lastgroup:
            out.append(Tok(m.lastgroup, m[m.lastgroup].strip("`") if m.lastgroup == "name" else m[m.lastgroup]))
    return out


@dataclass
class NodePart:
    var: str | None
    labels: list[tuple[str, ...]]
    """All of these must hold; of each the node has one label at least."""
    props: dict


@dataclass
class RelPart:
    var: str | None
    types: list[str]
    props: dict
    direction: str
    span: tuple[int, int | None] | None
    """Fewest and most hops (None: any number) of a variable-length part."""


@dataclass
class Pattern:
    name: str | None
    nodes: list[NodePart]
    rels: list[RelPart]
    shortest: bool = False


@dataclass
class Clause:
    kind: str
    data: dict = field(default_factory=dict)


class Parser:
    """Recursive descent; an expression is a tuple (operator, operands...)."""

    def __init__(self, text: str):
        self.t, self.i, self.fresh = tokens(text.rstrip().rstrip(";")), 0, 0

    def at(self, *texts: str) -> bool:
        return self.i < len(self.t) and self.t[self.i].kind in ("op", "name") and self.t[self.i].text.upper() in texts

    def take(self, *texts: str) -> bool:
        if self.at(*texts):
            self.i += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.take(text):
            raise CypherError(f"{text} expected at {' '.join(x.text for x in self.t[self.i : self.i + 4])!r}")

    def name(self) -> str:
        if self.i >= len(self.t) or self.t[self.i].kind != "name":
            raise CypherError("a name expected")
        self.i += 1
        return self.t[self.i - 1].text

    # clauses

    def query(self) -> list[tuple[bool, list[Clause]]]:
        """Parts of a union, each with whether it keeps repeats."""
        parts = [(False, self.clauses())]
        while self.take("UNION"):
            parts.append((self.take("ALL"), self.clauses()))
        if self.i < len(self.t):
            raise CypherError(f"unexpected {self.t[self.i].text!r}")
        return parts

    def clauses(self) -> list[Clause]:
        out = []
        while self.i < len(self.t) and not self.at("UNION", "}"):
            if self.at(*WRITES):
                raise CypherError(f"{self.t[self.i].text.upper()} writes; queries only read")
            if self.at("MATCH", "OPTIONAL"):
                optional = self.take("OPTIONAL")
                self.need("MATCH")
                out.append(Clause("match", {"optional": optional, "patterns": self.patterns(), "where": self.expr() if self.take("WHERE") else None}))
            elif self.take("UNWIND"):
                e = self.expr()
                self.need("AS")
                out.append(Clause("unwind", {"expr": e, "as": self.name()}))
            elif self.at("WITH", "RETURN"):
                out.append(self.projection(self.take("RETURN") or not self.take("WITH")))
            elif self.take("CALL"):
                out.append(self.call())
            else:
                raise CypherError(f"unexpected {self.t[self.i].text!r}")
        return out

    def call(self) -> Clause:
        if self.take("{"):
            inner = self.clauses()
            self.need("}")
            return Clause("subquery", {"clauses": inner})
        name = self.name()
        while self.take("."):
            name += "." + self.name()
        self.need("(")
        args = self.listed(")")
        got = []
        if self.take("YIELD"):
            got.append(self.named())
            while self.take(","):
                got.append(self.named())
        return Clause("procedure", {"name": name, "args": args, "yield": got, "where": self.expr() if self.take("WHERE") else None})

    def named(self) -> tuple[str, str]:
        a = self.name()
        return a, self.name() if self.take("AS") else a

    def projection(self, last: bool) -> Clause:
        distinct, items = self.take("DISTINCT"), []
        star = self.take("*")
        if not star or self.take(","):
            while True:
                lo = self.i
                e = self.expr()
                text = "".join(x.text if x.kind != "name" else f" {x.text} " for x in self.t[lo : self.i]).strip().replace(" . ", ".").replace(" .", ".").replace(". ", ".")
                items.append((e, self.name() if self.take("AS") else (e[1] if e[0] == "var" else text)))
                if not self.take(","):
                    break
        order = []
        if self.take("ORDER"):
            self.need("BY")
            while True:
                e = self.expr()
                order.append((e, self.take("DESC", "DESCENDING") or (self.take("ASC", "ASCENDING"), False)[1]))
                if not self.take(","):
                    break
        skip = self.expr() if self.take("SKIP", "OFFSET") else None
        limit = self.expr() if self.take("LIMIT") else None
        where = self.expr() if not last and self.take("WHERE") else None
        return Clause("project", {"distinct": distinct, "star": star, "items": items, "order": order, "skip": skip, "limit": limit, "where": where})

    # patterns

    def pattern(self) -> Pattern:
        name = None
        if self.i + 1 < len(self.t) and self.t[self.i].kind == "name" and self.t[self.i + 1].text == "=":
            name = self.name()
            self.need("=")
        if self.take("SHORTESTPATH"):
            self.need("(")
            inner = self.pattern()
            self.need(")")
            if len(inner.rels) != 1 or inner.rels[0].span is None or inner.rels[0].span[0] > 1:
                raise CypherError("shortestPath takes one variable-length part of 0 or 1 hops and more")
            return replace(inner, name=name, shortest=True)
        nodes, rels = [self.node()], []
        while self.at("-", "<"):
            rels.append(self.rel())
            nodes.append(self.node())
        return Pattern(name, nodes, rels)

    def node(self) -> NodePart:
        self.need("(")
        var = self.name() if self.i < len(self.t) and self.t[self.i].kind == "name" else None
        labels = []
        while self.take(":"):
            labels.append(self.label_group())
        props = self.map() if self.at("{") else {}
        self.need(")")
        return NodePart(var, labels, props)

    def label_group(self) -> tuple[str, ...]:
        group = [self.name()]
        while self.take("|", "OR"):
            self.take(":")
            group.append(self.name())
        return tuple(group)

    def patterns(self) -> list[Pattern]:
        out = [self.pattern()]
        while self.take(","):
            out.append(self.pattern())
        return out

    def rel(self) -> RelPart:
        left = self.take("<")
        self.need("-")
        var, types, props, span = None, [], {}, None
        if self.take("["):
            if self.t[self.i].kind == "name":
                var = self.name()
            if self.take(":"):
                types.append(self.name())
                while self.take("|"):
                    self.take(":")
                    types.append(self.name())
            if self.take("*"):
                lo = self.integer()
                hi = self.integer() if self.take("..") else lo
                span = (1 if lo is None else lo, hi)
            if self.at("{"):
                props = self.map()
            self.need("]")
        self.need("-")
        right = self.take(">")
        return RelPart(var, types, props, "in" if left and not right else "out" if right and not left else "both", span)

    def integer(self) -> int | None:
        if self.i < len(self.t) and self.t[self.i].kind == "num":
            self.i += 1
            return int(self.t[self.i - 1].text)
        return None

    def map(self) -> dict:
        self.need("{")
        out = {}
        while not self.take("}"):
            key = self.name()
            self.need(":")
            out[key] = self.expr()
            self.take(",")
        return out

    # expressions, by precedence

    def listed(self, end: str) -> list:
        out = []
        while not self.take(end):
            out.append(self.expr())
            self.take(",")
        return out

    def expr(self):
        return self.left(("OR",), lambda: self.left(("XOR",), lambda: self.left(("AND",), self.negated)))

    def left(self, ops: tuple[str, ...], below):
        e = below()
        while self.at(*ops):
            op = self.t[self.i].text.upper()
            self.i += 1
            e = (op, e, below())
        return e

    def negated(self):
        return ("NOT", self.negated()) if self.take("NOT") else self.compared()

    def compared(self):
        e = self.sum()
        while True:
            if self.at("=", "<>", "<", ">", "<=", ">=", "=~", "IN", "CONTAINS"):
                op = self.t[self.i].text.upper()
                self.i += 1
                e = (op, e, self.sum())
            elif self.at("STARTS", "ENDS"):
                op = self.t[self.i].text.upper()
                self.i += 1
                self.need("WITH")
                e = (op, e, self.sum())
            elif self.take("IS"):
                no = self.take("NOT")
                self.need("NULL")
                e = ("NOTNULL" if no else "ISNULL", e)
            else:
                return e

    def sum(self):
        return self.left(("+", "-"), lambda: self.left(("*", "/", "%"), lambda: self.left(("^",), self.signed)))

    def signed(self):
        return ("NEG", self.signed()) if self.take("-") else self.postfix()

    def postfix(self):
        e = self.atom()
        while True:
            if self.take("."):
                e = ("prop", e, self.name())
            elif e[0] == "var" and self.take(":"):
                e = ("labelled", e, self.name())
            elif self.take("["):
                lo = None if self.at("..") else self.expr()
                if self.take(".."):
                    e = ("slice", e, lo, None if self.at("]") else self.expr())
                else:
                    e = ("index", e, lo)
                self.need("]")
            else:
                return e

    def atom(self):
        t = self.t[self.i] if self.i < len(self.t) else Tok("end", "")
        if t.kind == "str":
            self.i += 1
            return ("lit", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), t.text[1:-1]))
        if t.kind == "num":
            self.i += 1
            return ("lit", float(t.text) if "." in t.text else int(t.text))
        if t.kind == "par":
            self.i += 1
            return ("par", t.text[1:])
        if t.text == "(":
            lo = self.i
            try:
                p = self.pattern()
                if p.rels:
                    return ("pattern", [p], None)
            except CypherError:
                pass
            self.i = lo + 1
            e = self.expr()
            self.need(")")
            return e
        if self.take("["):
            if self.i + 1 < len(self.t) and self.t[self.i].kind == "name" and self.t[self.i + 1].text.upper() == "IN":
                var, src, cond, out = *self.each(), None
                if self.take("|"):
                    out = self.expr()
                self.need("]")
                return ("comp", var, src, cond, out)
            return ("list", self.listed("]"))
        if t.text == "{":
            return ("map", self.map())
        if self.take("CASE"):
            subject = None if self.at("WHEN") else self.expr()
            whens = []
            while self.take("WHEN"):
                c = self.expr()
                self.need("THEN")
                whens.append(((c if subject is None else ("=", subject, c)), self.expr()))
            other = self.expr() if self.take("ELSE") else ("lit", None)
            self.need("END")
            return ("case", whens, other)
        word = self.name()
        if word.upper() in ("TRUE", "FALSE", "NULL"):
            return ("lit", {"TRUE": True, "FALSE": False, "NULL": None}[word.upper()])
        if word.upper() in ("EXISTS", "COUNT") and self.take("{"):
            self.take("MATCH")
            patterns = self.patterns()
            where = self.expr() if self.take("WHERE") else None
            self.need("}")
            return ("pattern" if word.upper() == "EXISTS" else "matches", patterns, where)
        if self.take("("):
            f = word.lower()
            if f in ("any", "all", "none", "single"):
                var, src, cond = self.each()
                self.need(")")
                return ("quant", f, var, src, cond)
            if f == "reduce":
                acc = self.name()
                self.need("=")
                start = self.expr()
                self.need(",")
                var = self.name()
                self.need("IN")
                src = self.expr()
                self.need("|")
                e = self.expr()
                self.need(")")
                return ("reduce", acc, start, var, src, e)
            if self.take("*"):
                self.need(")")
                return ("call", f, False, [("star",)])
            distinct = self.take("DISTINCT")
            return ("call", f, distinct, self.listed(")"))
        return ("var", word)

    def each(self):
        var = self.name()
        self.need("IN")
        src = self.expr()
        return var, src, self.expr() if self.take("WHERE") else None


def _walk(e):
    """All sub-expressions of an expression, itself first."""
    yield e
    for x in e[1:]:
        for y in x.values() if isinstance(x, dict) else x if isinstance(x, list) else [x]:
            for z in y if isinstance(y, tuple) and y and isinstance(y[0], tuple) else [y]:
                if isinstance(z, tuple) and z and isinstance(z[0], str):
                    yield from _walk(z)


def _marks(e) -> list:
    """The pattern predicates and counts in an expression, not those inside them."""
    if e[0] in ("pattern", "matches"):
        return [e]
    parts = [y for x in e[1:] for y in (x.values() if isinstance(x, dict) else x if isinstance(x, list) else [x])]
    parts = [z for y in parts for z in (y if isinstance(y, tuple) and y and isinstance(y[0], tuple) else [y])]
    return [m for z in parts if isinstance(z, tuple) and z and isinstance(z[0], str) for m in _marks(z)]


def _repeats_matter(d: dict) -> bool:
    """Whether a projection tells apart how often a row comes in."""
    if d["distinct"]:
        return any(_is_aggregate(x) and not _same_for_repeats(x) for e, _ in d["items"] for x in _walk(e))
    found = [x for e, _ in d["items"] for x in _walk(e) if _is_aggregate(x)]
    return not found or not all(map(_same_for_repeats, found))


def _same_for_repeats(e) -> bool:
    return e[2] or e[1] in ("min", "max")


def _is_aggregate(e) -> bool:
    return e[0] == "call" and e[1] in AGGREGATES


_STRINGS = {"tolower", "toupper", "tostring", "trim", "ltrim", "rtrim", "replace", "substring", "type", "left", "right", "reverse"}


class Engine:
    def __init__(self, spark: SparkSession, nodes: DataFrame, edges: DataFrame, params: dict):
        self.spark, self.params = spark, params
        self.n, self.e = nodes, edges
        self.node_fields, self.edge_fields = nodes.columns, edges.columns
        self.fresh = 0

    def new(self) -> str:
        self.fresh += 1
        return f"__v{self.fresh}"

    # expressions

    def kind(self, e, schema: T.StructType, local: dict) -> T.DataType | None:
        """The type of an expression, as far as it matters for + and size."""
        op = e[0]
        if op in ("lit", "par"):
            v = self.params.get(e[1]) if op == "par" else e[1]
            return T.StringType() if isinstance(v, str) else T.ArrayType(T.StringType()) if isinstance(v, list) else T.LongType() if isinstance(v, int) else None
        if op == "var":
            return local[e[1]][1] if e[1] in local else schema[e[1]].dataType if e[1] in schema.names else None
        if op == "prop":
            k = self.kind(e[1], schema, local)
            if isinstance(k, T.StructType):
                return k[e[2]].dataType if e[2] in k.names else T.StringType()
            return None
        if op == "call":
            return T.StringType() if e[1] in _STRINGS else T.ArrayType(T.StringType()) if e[1] in ("collect", "split", "labels", "keys", "nodes", "relationships", "range") else T.LongType() if e[1] in ("count", "size", "length") else None
        if op in ("list", "comp", "slice"):
            return T.ArrayType(T.StringType())
        if op == "case":
            return self.kind(e[1][0][1], schema, local)
        if op == "+":
            a, b = self.kind(e[1], schema, local), self.kind(e[2], schema, local)
            return next((x for x in (a, b) if isinstance(x, T.ArrayType | T.StringType)), a)
        if op in ("-", "*", "%"):
            return self.kind(e[1], schema, local)
        if op == "index":
            k = self.kind(e[1], schema, local)
            return k.elementType if isinstance(k, T.ArrayType) else None
        return None

    def value(self, v) -> Column:
        return F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else F.lit(v)

    def col(self, e, df: DataFrame, local: dict | None = None, given: dict | None = None) -> Column:
        """An expression as a column. local: lambda variables; given: columns that stand for sub-expressions."""
        local, given, schema = local or {}, given or {}, df.schema
        if repr(e) in given:
            return given[repr(e)]
        go = lambda x, more=None: self.col(x, df, local | (more or {}), given)
        op = e[0]
        if op == "lit":
            return F.lit(e[1])
        if op == "par":
            if e[1] not in self.params:
                raise CypherError(f"parameter ${e[1]} isn't given")
            return self.value(self.params[e[1]])
        if op == "var":
            if e[1] in local:
                return local[e[1]][0]
            if e[1] not in df.columns:
                raise CypherError(f"{e[1]} isn't defined")
            return F.col(f"`{e[1]}`")
        if op == "prop":
            k = self.kind(e[1], schema, local)
            if isinstance(k, T.StructType) and e[2] not in k.names:
                return go(e[1])["props"][e[2]] if "props" in k.names else F.lit(None).cast("string")
            return go(e[1])[e[2]]
        if op in ("AND", "OR"):
            return (go(e[1]) & go(e[2])) if op == "AND" else (go(e[1]) | go(e[2]))
        if op == "XOR":
            return go(e[1]) != go(e[2])
        if op == "NOT":
            return ~go(e[1])
        if op in ("=", "<>", "<", ">", "<=", ">="):
            a, b = (self.identity(x, go(x), schema, local) for x in e[1:3])
            return {"=": a.__eq__, "<>": a.__ne__, "<": a.__lt__, ">": a.__gt__, "<=": a.__le__, ">=": a.__ge__}[op](b)
        if op == "IN":
            a = self.identity(e[1], go(e[1]), schema, local)
            if e[2][0] in ("list", "par"):
                items = [go(x) for x in e[2][1]] if e[2][0] == "list" else [F.lit(x) for x in self.params[e[2][1]]]
                return a.isin(*items) if items else F.lit(False)
            return F.array_contains(go(e[2]), a)
        if op == "=~":
            return go(e[1]).rlike("^(?:" + str(e[2][1]) + ")$") if e[2][0] == "lit" else F.rlike(go(e[1]), go(e[2]))
        if op == "STARTS":
            return go(e[1]).startswith(go(e[2]))
        if op == "ENDS":
            return go(e[1]).endswith(go(e[2]))
        if op == "CONTAINS":
            return go(e[1]).contains(go(e[2]))
        if op in ("ISNULL", "NOTNULL"):
            return go(e[1]).isNull() if op == "ISNULL" else go(e[1]).isNotNull()
        if op == "NEG":
            return -go(e[1])
        if op == "+":
            a, b = self.kind(e[1], schema, local), self.kind(e[2], schema, local)
            if isinstance(a, T.ArrayType) or isinstance(b, T.ArrayType):
                wrap = lambda x, k: go(x) if isinstance(k, T.ArrayType) else F.array(go(x))
                return F.concat(wrap(e[1], a), wrap(e[2], b))
            if isinstance(a, T.StringType) or isinstance(b, T.StringType):
                return F.concat(go(e[1]).cast("string"), go(e[2]).cast("string"))
            return go(e[1]) + go(e[2])
        if op in ("-", "*", "%"):
            return {"-": Column.__sub__, "*": Column.__mul__, "%": Column.__mod__}[op](go(e[1]), go(e[2]))
        if op == "/":
            whole = all(isinstance(self.kind(x, schema, local), T.IntegralType) for x in e[1:3])
            return (go(e[1]) / go(e[2])).cast("long") if whole else go(e[1]) / go(e[2])
        if op == "^":
            return F.pow(go(e[1]), go(e[2]))
        if op == "labelled":
            return self.has_label(go(e[1]), (e[2],))
        if op == "list":
            return F.array(*[go(x) for x in e[1]])
        if op == "map":
            return F.struct(*[go(x).alias(k) for k, x in e[1].items()])
        if op == "case":
            out = None
            for c, v in e[1]:
                out = F.when(go(c), go(v)) if out is None else out.when(go(c), go(v))
            return out.otherwise(go(e[2]))
        if op == "index":
            k = go(e[2])
            return F.try_element_at(go(e[1]), F.when(k >= 0, k + 1).otherwise(k).cast("int"))
        if op == "slice":
            src, n = go(e[1]), F.size(go(e[1]))
            lo = F.lit(0) if e[2] is None else go(e[2])
            hi = n if e[3] is None else go(e[3])
            lo, hi = (F.when(x < 0, F.greatest(F.lit(0), n + x)).otherwise(x) for x in (lo, hi))
            return F.slice(src, (lo + 1).cast("int"), F.greatest(F.lit(0), F.least(hi, n) - lo).cast("int"))
        if op in ("comp", "quant"):
            var, src, cond = (e[1], e[2], e[3]) if op == "comp" else (e[2], e[3], e[4])
            k = self.kind(src, schema, local)
            item = k.elementType if isinstance(k, T.ArrayType) else None
            inner = lambda x: (lambda v: go(x, {var: (v, item)}))
            if op == "quant":
                test = {"any": F.exists, "all": F.forall, "none": lambda a, f: ~F.exists(a, f), "single": lambda a, f: F.size(F.filter(a, f)) == 1}[e[1]]
                return test(go(src), inner(cond))
            out = go(src) if cond is None else F.filter(go(src), inner(cond))
            return out if e[4] is None else F.transform(out, inner(e[4]))
        if op == "reduce":
            _, acc, start, var, src, body = e
            first = go(start)
            first = first.cast("long") if isinstance(self.kind(start, schema, local), T.IntegralType) else first
            k = self.kind(start, schema, local)
            return F.aggregate(go(src), first, lambda a, v: go(body, {acc: (a, k), var: (v, None)}).cast("long") if isinstance(k, T.IntegralType) else go(body, {acc: (a, k), var: (v, None)}))
        if op == "call":
            return self.function(e, go, schema, local)
        raise CypherError(f"{op} can't stand here")

    def has_label(self, node: Column | None, group: tuple[str, ...]) -> Column:
        at = (lambda c: F.col(c)) if node is None else (lambda c: node[c])
        if "labels" in self.node_fields:
            return F.arrays_overlap(at("labels"), F.array(*[F.lit(x) for x in group]))
        return at("label").isin(*group)

    def identity(self, e, c: Column, schema, local) -> Column:
        """Nodes compare by id, relationships by their ends and type."""
        k = self.kind(e, schema, local)
        if isinstance(k, T.StructType) and "id" in k.names:
            return c["id"]
        if isinstance(k, T.StructType) and {"src", "type", "dst"} <= set(k.names):
            return F.struct(c["src"], c["type"], c["dst"])
        return c

    def function(self, e, go, schema, local) -> Column:
        _, f, distinct, args = e
        if f in AGGREGATES:
            if args and args[0] == ("star",):
                return F.count(F.lit(1))
            c = go(args[0])
            if f == "count":
                c = self.identity(args[0], c, schema, local)
                return F.count_distinct(c) if distinct else F.count(c)
            if f == "collect":
                return F.collect_set(c) if distinct else F.collect_list(c)
            if f == "percentilecont":
                return F.percentile(c, go(args[1]))
            if f in ("sum", "avg") and distinct:
                return F.sum_distinct(c) if f == "sum" else F.try_divide(F.sum_distinct(c).cast("double"), F.count_distinct(c))
            return {"min": F.min, "max": F.max, "sum": lambda x: F.coalesce(F.sum(x), F.lit(0)), "avg": F.avg, "stdev": F.stddev_samp}[f](c)
        a = [go(x) for x in args]
        if f in ("size", "length"):
            k = self.kind(args[0], schema, local)
            if isinstance(k, T.StructType) and "rels" in k.names:
                return F.size(a[0]["rels"])
            return F.length(a[0]) if isinstance(k, T.StringType) else F.size(a[0])
        simple = {
            "tolower": F.lower, "toupper": F.upper, "trim": F.trim, "ltrim": F.ltrim, "rtrim": F.rtrim, "abs": F.abs, "ceil": F.ceil, "floor": F.floor, "sqrt": F.sqrt, "exp": F.exp,
            "log": F.log, "sign": F.signum, "coalesce": F.coalesce, "reverse": F.reverse, "keys": lambda x: F.map_keys(x["props"]), "last": lambda x: F.try_element_at(x, F.lit(-1)),
            "head": lambda x: F.try_element_at(x, F.lit(1)), "tostring": lambda x: x.cast("string"), "tointeger": lambda x: x.try_cast("long"), "tofloat": lambda x: x.try_cast("double"),
            "id": lambda x: x["id"], "type": lambda x: x["type"], "properties": lambda x: x, "nodes": lambda x: x["nodes"], "relationships": lambda x: x["rels"],
            "startnode": lambda x: F.struct(x["src"].alias("id")), "endnode": lambda x: F.struct(x["dst"].alias("id")), "exists": lambda x: x.isNotNull(),
            "labels": lambda x: F.array(x["label"]), "datetime": F.to_timestamp, "date": F.to_date, "left": F.left, "right": F.right, "range": lambda lo, hi: F.sequence(lo, hi),
            "tail": lambda x: F.slice(x, 2, F.greatest(F.lit(0), F.size(x) - 1)),
        }
        if f in simple:
            return simple[f](*a)
        if f == "round":
            return F.round(a[0], args[1][1] if len(args) > 1 else 0)
        if f == "split":
            return F.split(a[0], re.escape(args[1][1]))
        if f == "replace":
            return F.replace(a[0], a[1], a[2])
        if f == "substring":
            return F.substring(a[0], a[1] + 1, a[2]) if len(a) > 2 else F.substring(a[0], a[1] + 1, F.length(a[0]))
        raise CypherError(f"{f}() isn't in the subset")

    # patterns

    def scan(self, part: NodePart, df: DataFrame | None = None) -> DataFrame:
        """Nodes that fit a part, as one struct column x."""
        n = self.n
        for group in part.labels:
            n = n.where(self.has_label(None, group))
        return self.with_props(n.select(F.struct(*self.node_fields).alias("x")), part.props)

    def with_props(self, n: DataFrame, props: dict) -> DataFrame:
        for key, e in props.items():
            if any(x[0] in ("var", "prop") for x in _walk(e)):
                raise CypherError("properties in a pattern are literals or parameters")
            n = n.where(self.col(("prop", ("var", "x"), key), n) == self.col(e, n))
        return n

    def hops(self, rel: RelPart) -> DataFrame:
        """(a, b, x): walks of one relationship from a to b; x is its struct."""
        e = self.e if not rel.types else self.e.where(F.col("type").isin(*rel.types))
        e = self.with_props(e.select(F.struct(*self.edge_fields).alias("x")), rel.props)
        out = e.select(F.col("x.src").alias("a"), F.col("x.dst").alias("b"), "x")
        back = e.select(F.col("x.dst").alias("a"), F.col("x.src").alias("b"), "x")
        return {"out": out, "in": back, "both": out.unionByName(back.where("a <> b"))}[rel.direction]

    def trails(self, rel: RelPart, starts: DataFrame) -> DataFrame:
        """(a, b, x, via): walks of a variable-length part from starts (a); x is the array of
        its relationships, all different, via the ids on the way."""
        h = self.hops(rel)
        step = h.select(F.col("a").alias("b"), F.col("b").alias("to"), F.col("x").alias("r"))
        lo, hi = rel.span
        flat = hi is None or hi > LAZY_HOPS
        key = lambda r: F.concat_ws("|", r["src"], r["type"], r["dst"])
        at = starts.select("a", F.col("a").alias("b"), F.array().cast(T.ArrayType(h.schema["x"].dataType)).alias("x"), F.array().cast("array<string>").alias("via"))
        out = at if lo == 0 else at.limit(0)
        k = 0
        while hi is None or k < hi:
            k += 1
            at = at.join(step, "b").where(~F.array_contains(F.transform("x", key), key(F.col("r"))))
            at = at.select("a", F.col("to").alias("b"), F.concat("x", F.array("r")).alias("x"), F.concat("via", F.array("to")).alias("via"))
            if flat:
                at = written(at, "trails")
                if at.isEmpty():
                    break
            if k >= lo:
                out = out.unionByName(at)
        return out

    def looped(self, step: DataFrame, most: int = 8) -> DataFrame:
        """(to): nodes of step (b, to) that include all on cycles: those that lead nowhere drop
        out round by round, until none does or most rounds are over."""
        live = written(step.select("to").distinct(), "live")
        n = live.count()
        for _ in range(most):
            if not n:
                break
            new = step.join(live.withColumnRenamed("to", "b"), "b", "left_semi").join(live, "to", "left_semi")
            new = written(new.select(F.col("b").alias("to")).distinct(), "live")
            discard(live)
            live, before, n = new, n, new.count()
            if n == before:
                break
        return live

    def counted_trails(self, rel: RelPart, starts: DataFrame) -> DataFrame:
        """(a, b, n): how many trails from starts (a) end at b, for a part whose trails nothing
        tells apart. Only relationships that may be on cycles are remembered; trails alike in
        their ends and in those go on as one row. The steps of a round are cut to the nodes
        reached: few nodes that many trails reach are a small side of its join."""
        h = self.hops(rel)
        live = self.looped(h.select(F.col("a").alias("b"), F.col("b").alias("to")))
        again = not live.isEmpty()
        key = F.concat_ws("|", F.col("x.src"), F.col("x.type"), F.col("x.dst"))
        step = h.select(F.col("a").alias("b"), F.col("b").alias("to"), *([key.alias("key")] if again else []))
        if again:
            step = step.join(live.withColumn("kept", F.lit(True)), "to", "left").select("b", "to", F.when(F.col("kept"), F.col("key")).alias("r"))
        lo, hi = rel.span
        at = starts.select("a", F.col("a").alias("b"), F.array().cast("array<string>").alias("taken"), F.lit(1).cast("long").alias("n"))
        out = at if lo == 0 else at.limit(0)
        k = 0
        while hi is None or k < hi:
            k += 1
            here = written(at.select("b").distinct(), "reached")
            at, taken = at.join(step.join(here, "b", "left_semi"), "b"), F.col("taken")
            if again:
                at = at.where(F.col("r").isNull() | ~F.array_contains("taken", F.col("r")))
                taken = F.when(F.col("r").isNull(), taken).otherwise(F.array_sort(F.concat("taken", F.array("r"))))
            at = written(at.groupBy("a", F.col("to").alias("b"), taken.alias("taken")).agg(F.sum("n").alias("n")), "trails")
            if at.isEmpty():
                break
            if k >= lo:
                out = out.unionByName(at)
        return out.select("a", "b", "n")

    def reachable(self, rel: RelPart, starts: DataFrame) -> DataFrame:
        """(a, b): the pairs of ends that trails from starts (a) have, each once: every round
        goes on from the pairs that the round before found."""
        h = self.hops(rel).select(F.col("a").alias("b"), F.col("b").alias("to"))
        lo, hi = rel.span
        new = starts.select("a", F.col("a").alias("b"))
        # a start is reached in 0 hops, or around a cycle
        seen = new if lo == 0 else new.limit(0)
        k = 0
        while hi is None or k < hi:
            k += 1
            new = new.join(h, "b").select("a", F.col("to").alias("b")).distinct()
            new = written(new.join(seen, ["a", "b"], "left_anti"), "pairs")
            if new.isEmpty():
                break
            seen = seen.unionByName(new)
        return seen

    def shortest(self, rel: RelPart, starts: DataFrame, ends: DataFrame) -> DataFrame:
        """(a, b, x, via): one shortest walk from each of starts (a) to each of ends (b) that it
        reaches. Every pair keeps the relationship it was first reached by (of several the
        least by the node before, type and ends), and walks are put together from the end."""
        h = self.hops(rel).select(F.col("a").alias("b"), F.col("b").alias("to"), F.col("x").alias("r"))
        lo, hi = rel.span
        new = starts.select("a", F.col("a").alias("b"))
        seen, levels, k, bare = new, [], 0, set(self.edge_fields) == {"src", "type", "dst"}
        while hi is None or k < hi:
            k += 1
            came = F.struct(F.col("b").alias("p"), F.col("r.type").alias("t"), F.col("r.src").alias("s"), F.col("r.dst").alias("d"))
            # what decides is all there is to a relationship without further columns
            least = F.min(came) if bare else F.min_by(F.struct("b", "r"), came)
            new = new.join(h, "b").groupBy("a", F.col("to").alias("b")).agg(least.alias("last"))
            if bare:
                new = new.withColumn("last", F.struct(F.col("last.p").alias("b"), F.struct(*[F.col(f"last.{f[0]}").alias(f) for f in self.edge_fields]).alias("r")))
            new = written(new.join(seen, ["a", "b"], "left_anti"), "levels")
            if new.isEmpty():
                break
            levels.append(new)
            seen, new = seen.unionByName(new.select("a", "b")), new.select("a", "b")
        rels, ids = T.ArrayType(self.hops(rel).schema["x"].dataType), "array<string>"
        none = starts.select("a", F.col("a").alias("b"), F.array().cast(rels).alias("x"), F.array().cast(ids).alias("via"))
        out = none.join(ends, "b", "left_semi") if lo == 0 else none.limit(0)
        open_ = None  # walks (a, at, b, x, via) from a node on the way to their end
        for level in reversed(levels):
            reached = level.join(ends, "b", "left_semi").select("a", F.col("b").alias("at"), "b", F.array().cast(rels).alias("x"), F.array().cast(ids).alias("via"))
            open_ = reached if open_ is None else open_.unionByName(reached)
            last = level.select("a", F.col("b").alias("at"), "last")
            open_ = written(open_.join(last, ["a", "at"]).select("a", F.col("last.b").alias("at"), "b", F.concat(F.array("last.r"), "x").alias("x"), F.concat(F.array("at"), "via").alias("via")), "walks")
        return out if open_ is None else out.unionByName(open_.select("a", "b", "x", "via"))

    def match(self, df: DataFrame, patterns: list[Pattern], where, repeats: bool = True) -> DataFrame:
        """repeats: whether it matters how often a row is found."""
        used: list[tuple[str, RelPart]] = []  # columns of this MATCH's relationships
        every = [r for p in patterns for r in p.rels]
        for p in patterns:
            # walks may stand for their ends where nothing can tell two of them apart
            others = lambda r: [x for x in every if x is not r]
            pairs = [] if repeats or p.name else [r for r in p.rels if self.ends_will_do(r, others(r))]
            sums = [] if p.name or p.shortest else [r for r in p.rels if r not in pairs and self.number_will_do(r, others(r))]
            df = self.chain(df, p, used, [id(r) for r in pairs], [id(r) for r in sums])
        if where is not None:
            df = self.filtered(df, where)
        return df.drop(*[c for c in df.columns if c.startswith("__v")])

    def ends_will_do(self, rel: RelPart, others: list[RelPart]) -> bool:
        """Whether reachable() stands for a part's trails, if repeats don't matter: no variable,
        no other part that may use the same relationships, and every pair of ends with a walk
        has a trail (not so for 2 hops and more, nor for undirected cycles)."""
        return rel.span is not None and rel.var is None and all(self.apart(rel, o) for o in others) and rel.span[0] <= 1 and (rel.direction != "both" or rel.span[0] == 0)

    def number_will_do(self, rel: RelPart, others: list[RelPart]) -> bool:
        """Whether counted_trails() stands for a part's trails: no variable, and no other part that
        may use the same relationships."""
        return rel.span is not None and rel.var is None and (rel.span[1] is None or rel.span[1] > LAZY_HOPS) and all(self.apart(rel, o) for o in others)

    def apart(self, a: RelPart, b: RelPart) -> bool:
        """Whether two parts can't use the same relationship, since they have no type in common."""
        return bool(a.types and b.types) and not set(a.types) & set(b.types)

    def counted(self, df: DataFrame, mark) -> tuple[str, DataFrame] | None:
        """For a count of one chain from a bound node, whose parts can't share relationships: the
        bound variable, and (a, n): how many walks leave each node. Counts are summed up
        from the far end, hop by hop, so that no walk is made. None for other patterns."""
        kind, patterns, where = mark
        if kind != "matches" or where is not None or len(patterns) != 1 or patterns[0].name or patterns[0].shortest or not patterns[0].rels:
            return None
        nodes, rels = list(patterns[0].nodes), list(patterns[0].rels)
        if nodes[0].var not in df.columns:
            nodes, rels = nodes[::-1], [replace(r, direction={"in": "out", "out": "in"}.get(r.direction, "both")) for r in rels[::-1]]
        free = [x.var for x in [*nodes[1:], *rels] if x.var]
        if nodes[0].var not in df.columns or nodes[0].labels or nodes[0].props or set(free) & set(df.columns) or len(free) != len(set(free)) or any(r.span is not None for r in rels):
            return None
        if not all(self.apart(r, o) for k, r in enumerate(rels) for o in rels[:k]) or "id" not in getattr(df.schema[nodes[0].var].dataType, "names", ()):
            return None
        n = self.scan(nodes[-1]).select(F.col("x.id").alias("b"), F.lit(1).cast("long").alias("n"))
        for node, rel in zip(nodes[-2::-1], rels[::-1], strict=True):
            n = self.hops(rel).select("a", "b").join(n, "b").groupBy("a").agg(F.sum("n").alias("n"))
            if node is not nodes[0]:
                n = n.join(self.scan(node).select(F.col("x.id").alias("a")), "a").select(F.col("a").alias("b"), "n")
        return nodes[0].var, n

    def chain(self, df: DataFrame, p: Pattern, used: list, pairs: list[int] = (), sums: list[int] = ()) -> DataFrame:
        nodes, rels = list(p.nodes), list(p.rels)
        bound = lambda n: (n.var in df.columns, bool(n.props), bool(n.labels))
        # from the end that is bound or narrower
        if not p.shortest and bound(nodes[0]) < bound(nodes[-1]):
            turned = [replace(r, direction={"in": "out", "out": "in"}.get(r.direction, "both")) for r in rels[::-1]]
            pairs, sums = ([id(t) for t, r in zip(turned, rels[::-1], strict=True) if id(r) in of] for of in (pairs, sums))
            nodes, rels, flip = nodes[::-1], turned, True
        else:
            flip = False
        names = [n.var or self.new() for n in nodes]
        df = self.reach(df, nodes[0], names[0], None)
        at_rel: list[str] = []
        vias: list[tuple[str, bool]] = []
        for k, rel in enumerate(rels):
            name = rel.var or self.new()
            a, b, x, via, n = (self.new() for _ in range(5))
            among = None
            if rel.span is None:
                walk = self.hops(rel).withColumn("via", F.array("b"))
            else:
                starts = written(df.select(F.col(f"`{names[k]}`")["id"].alias("a")).where("a is not null").distinct(), "starts")
                if p.shortest:
                    end = nodes[k + 1].var
                    ends = df.select(F.col(f"`{end}`")["id"].alias("b")) if end in df.columns else self.scan(nodes[k + 1]).select(F.col("x.id").alias("b"))
                    walk = self.shortest(rel, starts, written(ends.distinct(), "ends"))
                elif id(rel) in pairs or id(rel) in sums:
                    walk = self.reachable(rel, starts) if id(rel) in pairs else self.counted_trails(rel, starts)
                    among = written(walk.select(F.col("b").alias(self.new())).distinct(), "ends") if id(rel) in sums else None
                    walk = walk.withColumn("x", F.array().cast(T.ArrayType(T.StructType(self.e.schema.fields)))).withColumn("via", F.array().cast("array<string>"))
                else:
                    walk = self.trails(rel, starts)
            walk = walk.select(F.col("a").alias(a), F.col("b").alias(b), F.col("x").alias(x), F.col("via").alias(via), *([F.col("n").alias(n)] if id(rel) in sums else []))
            if rel.var and rel.var in df.columns:
                raise CypherError(f"{rel.var} is bound already")
            df = df.join(walk, F.col(f"`{names[k]}`")["id"] == F.col(a)).withColumnRenamed(x, name)
            if id(rel) not in pairs and id(rel) not in sums:
                for other, r in used:
                    if not self.apart(rel, r):
                        df = df.where(self.disjoint(name, rel.span is not None, other, r.span is not None))
                used.append((name, rel))
            at_rel.append(name)
            vias.append((via, rel.span is not None))
            df = self.reach(df, nodes[k + 1], names[k + 1], b, among)
            if id(rel) in sums:
                df = self.times(df, n)
        if p.name:
            arrays = [F.col(f"`{n}`") if r.span else F.array(F.col(f"`{n}`")) for n, r in zip(at_rel, rels, strict=True)]
            some = F.col(f"`{names[0]}`")["id"]
            ids = F.concat(F.array(some), *[F.col(via) for via, _ in vias])
            walked = F.concat(*arrays) if arrays else F.array()
            ids, walked = (F.reverse(ids), F.reverse(walked)) if flip else (ids, walked)
            df = df.withColumn(p.name, F.struct(F.transform(ids, lambda i: F.struct(i.alias("id"))).alias("nodes"), walked.alias("rels")))
        return df

    def disjoint(self, a: str, many_a: bool, b: str, many_b: bool) -> Column:
        key = lambda r: F.concat_ws("|", r["src"], r["type"], r["dst"])
        keys = lambda c, many: F.transform(F.col(f"`{c}`"), key) if many else F.array(key(F.col(f"`{c}`")))
        return ~F.arrays_overlap(keys(a, many_a), keys(b, many_b))

    def times(self, df: DataFrame, n: str) -> DataFrame:
        """Every row as often as its column n says, by the thousand, so that no list is long."""
        df = df.withColumn(n, F.explode(F.when(F.col(n) <= 1000, F.array(F.col(n))).otherwise(F.transform(F.sequence(F.lit(0), F.floor((F.col(n) - 1) / 1000)), lambda i: F.least(F.lit(1000), F.col(n) - i * 1000)))))
        return df.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n)))).drop(n)

    def reach(self, df: DataFrame, part: NodePart, name: str, at: str | None, among: DataFrame | None = None) -> DataFrame:
        """df with the node of a part: checked if bound, else joined (at: the column of its id;
        among: the ids that it can have, in one column)."""
        if name in df.columns:
            if at is not None:
                df = df.where(F.col(f"`{name}`")["id"] == F.col(at))
            for group in part.labels:
                df = df.where(self.has_label(F.col(f"`{name}`"), group))
            for key, e in part.props.items():
                df = df.where(self.col(("prop", ("var", name), key), df) == self.col(e, df))
            return df
        n = self.scan(part).withColumnRenamed("x", name)
        if among is not None:
            n = written(n.join(among, F.col(f"`{name}`")["id"] == F.col(among.columns[0]), "left_semi"), "ends")
        return n if at is None and df.columns == ["__v"] else df.crossJoin(n) if at is None else df.join(n, F.col(f"`{name}`")["id"] == F.col(at))

    # predicates and back joins

    def filtered(self, df: DataFrame, e) -> DataFrame:
        if e[0] == "AND":
            return self.filtered(self.filtered(df, e[1]), e[2])
        no = e[0] == "NOT"
        p = e[1] if no else e
        if p[0] == "pattern":
            keys, found = self.found(df, p, repeats=False)
            return self.back(df, found, keys, [], "left_anti" if no else "left_semi")
        cols = df.columns
        df, given = self.marked(df, [e])
        return df.where(self.col(e, df, given=given)).select(*[f"`{c}`" for c in cols])

    def found(self, df: DataFrame, mark, repeats: bool) -> tuple[list[str], DataFrame]:
        """The bound variables that a predicate uses, and what it matches for their values."""
        _, patterns, where = mark
        used = {n.var for p in patterns for n in p.nodes} | {x[1] for x in (_walk(where) if where else ()) if x[0] == "var"}
        used |= {n.var for m in (_marks(where) if where else ()) for p in m[1] for n in p.nodes}
        keys = [c for c in df.columns if c in used]
        return keys, self.match(self.distinct(df, keys), patterns, where, repeats)

    def marked(self, df: DataFrame, exprs: list) -> tuple[DataFrame, dict]:
        """df with a column for each pattern predicate or count in some expressions, and the
        columns that stand for them: how often each matches, by one left join each."""
        given: dict = {}
        for m in [m for e in exprs for m in _marks(e)]:
            if repr(m) in given:
                continue
            summed = self.counted(df, m)
            if summed:
                a, n = self.new(), self.new()
                df = df.join(summed[1].select(F.col("a").alias(a), F.col("n").alias(n)), F.col(f"`{summed[0]}`")["id"] == F.col(a), "left").drop(a)
                given[repr(m)] = F.coalesce(F.col(n), F.lit(0))
                continue
            keys, found = self.found(df, m, repeats=m[0] == "matches")
            n, names = self.new(), [self.new() for _ in keys]
            counts = found.groupBy(*[self.key(found, c).alias(k) for c, k in zip(keys, names, strict=True)]) if keys else found
            counts = counts.agg(*[F.any_value(F.col(f"`{c}`")).alias(c) for c in keys], F.count(F.lit(1)).alias(n)).drop(*names)
            df = self.back(df, counts, keys, [n], "left")
            given[repr(m)] = F.coalesce(F.col(n), F.lit(0)) if m[0] == "matches" else F.coalesce(F.col(n), F.lit(0)) > 0
        return df, given

    def key(self, df: DataFrame, c: str) -> Column:
        return self.identity(("var", c), F.col(f"`{c}`"), df.schema, {})

    def distinct(self, df: DataFrame, keys: list[str]) -> DataFrame:
        """The distinct values of some columns; without any, one row."""
        if not keys:
            return self.spark.range(1).select(F.col("id").alias("__v"))
        names = [self.new() for _ in keys]
        return df.groupBy(*[self.key(df, c).alias(n) for c, n in zip(keys, names, strict=True)]).agg(*[F.any_value(F.col(f"`{c}`")).alias(c) for c in keys]).drop(*names)

    def back(self, df: DataFrame, found: DataFrame, keys: list[str], more: list[str], how: str) -> DataFrame:
        """df joined with what was found for its keys."""
        names = [self.new() for _ in keys]
        right = found.select(*[self.key(found, c).alias(n) for c, n in zip(keys, names, strict=True)], *[f"`{c}`" for c in more])
        if how in ("left_semi", "left_anti"):
            right = right.distinct()
        if not keys:
            return df.join(right, F.lit(True), how)
        on = reduce(Column.__and__, [self.key(df, c).eqNullSafe(F.col(n)) for c, n in zip(keys, names, strict=True)])
        return df.join(right, on, how).drop(*names)

    # clauses

    def run(self, clauses: list[Clause], df: DataFrame | None = None) -> DataFrame:
        df = self.spark.range(1).select(F.col("id").alias("__v")) if df is None else df
        for at, c in enumerate(clauses):
            d = c.data
            then = next((x for x in clauses[at + 1 :] if x.kind != "match"), None)
            repeats = then is None or then.kind != "project" or _repeats_matter(then.data)
            if c.kind == "match" and not d["optional"]:
                df = self.match(df, d["patterns"], d["where"], repeats)
            elif c.kind == "match":
                vars_ = {x for p in d["patterns"] for x in [*(n.var for n in p.nodes), *(r.var for r in p.rels)]} | ({x[1] for x in _walk(d["where"]) if x[0] == "var"} if d["where"] else set())
                keys = [x for x in df.columns if x in vars_]
                found = self.match(self.distinct(df, keys), d["patterns"], d["where"], repeats)
                df = self.back(df, found, keys, [x for x in found.columns if x not in df.columns], "left")
            elif c.kind == "unwind":
                df = df.select("*", F.explode(self.col(d["expr"], df)).alias(d["as"]))
            elif c.kind == "subquery":
                df = self.subquery(df, d["clauses"])
            elif c.kind == "procedure":
                df = self.procedure(df, d)
            else:
                df = self.project(df, d)
        return df

    def subquery(self, df: DataFrame, clauses: list[Clause]) -> DataFrame:
        """A correlated subquery: rows without a result go."""
        first = clauses[0].data if clauses[0].kind == "project" else {"items": []}
        keys = [e[1] for e, _ in first["items"] if e[0] == "var" and e[1] in df.columns]
        inner = clauses[1:] if keys else clauses
        last = inner[-1].data
        last["items"] = [*last["items"], *[(("var", k), k) for k in keys if k not in [n for _, n in last["items"]]]]
        found = self.run(inner, self.distinct(df, keys))
        return self.back(df, found, keys, [c for c in found.columns if c not in keys], "inner")

    def procedure(self, df: DataFrame, d: dict) -> DataFrame:
        if d["name"] != "db.index.fulltext.queryNodes":
            raise CypherError(f"{d['name']} isn't in the subset")
        from graphloom.operators import search

        text = self.params[d["args"][1][1]] if d["args"][1][0] == "par" else d["args"][1][1]
        fields = tuple(f for f in search.FIELDS if f in self.node_fields)
        hits = search.search(self.n, re.sub(r"\*|\bAND\b", " ", text), 1 << 30, fields)
        rows = self.n.join(hits, "id").select(F.struct(*self.node_fields).alias("node"), F.col("score").cast("double").alias("score"))
        rows = rows.select(*[F.col(a).alias(b) for a, b in d["yield"] or [("node", "node"), ("score", "score")]])
        df = rows if df.columns == ["__v"] else df.crossJoin(rows)
        return self.filtered(df, d["where"]) if d["where"] else df

    def project(self, df: DataFrame, d: dict) -> DataFrame:
        items = ([(("var", c), c) for c in df.columns if not c.startswith("__v")] if d["star"] else []) + d["items"]
        order = [(e, down, self.new()) for e, down in d["order"]]
        names = {n for _, n in items}
        df, marks = self.marked(df, [e for e, _ in items])
        grouped = any(_is_aggregate(x) for e, _ in items for x in _walk(e))
        if grouped:
            keys = [(e, self.new()) for e, _ in items if not any(_is_aggregate(x) for x in _walk(e))]
            calls = {repr(x): (x, self.new()) for e in [e for e, _ in items] + [e for e, _, _ in order] for x in _walk(e) if _is_aggregate(x)}
            given, by, more = {}, [], []
            for e, n in keys:
                c = self.col(e, df, given=marks)
                k = self.kind(e, df.schema, {})
                if isinstance(k, T.StructType) and ("id" in k.names or "src" in k.names):
                    by.append(self.identity(e, c, df.schema, {}).alias(n))
                    held = self.new()
                    more.append(F.any_value(c).alias(held))
                    given[repr(e)] = F.col(held)
                else:
                    by.append(c.alias(n))
                    given[repr(e)] = F.col(n)
            for text, (e, n) in calls.items():
                more.append(self.col(e, df, given=marks).alias(n))
                given[text] = F.col(n)
            df = df.groupBy(*by).agg(*more) if by else df.agg(*more)
        else:
            given = marks
        out = [self.col(e, df, given=given).alias(n) for e, n in items]
        extra = [] if d["distinct"] else [self.col(e, df, given=given).alias(t) for e, _, t in order if not (e[0] == "var" and e[1] in names)]
        df = df.select(*out, *extra)
        if d["distinct"]:
            df = df.distinct()
        if d["where"] is not None:
            df = self.filtered(df, d["where"])
        if order:
            by = []
            for e, down, t in order:
                c = F.col(f"`{e[1]}`") if e[0] == "var" and e[1] in names else F.col(t) if t in df.columns else self.col(e, df)
                by.append(c.desc_nulls_first() if down else c.asc_nulls_last())
            df = df.orderBy(*by)
        for what in ("skip", "limit"):
            if d[what] is not None:
                n = self.params[d[what][1]] if d[what][0] == "par" else d[what][1]
                df = df.offset(int(n)) if what == "skip" else df.limit(int(n))
        return df.drop(*[t for _, _, t in order if t in df.columns])


def check_read_only(text: str) -> None:
    """Raises CypherError for a query that writes or doesn't parse."""
    Parser(text).query()


def run(spark: SparkSession, nodes: DataFrame, edges: DataFrame, text: str, cap: int | None = None, **params) -> DataFrame:
    """The result of a query over nodes (id, label, ...) and edges (src, type, dst, ...).

    Properties that aren't columns are looked up in a map column props, if there is one.
    cap: most rows, as the ad-hoc endpoint has it."""
    engine = Engine(spark, nodes, edges, params)
    out = None
    for all_, clauses in Parser(text).query():
        part = engine.run(clauses)
        out = part if out is None else out.unionByName(part) if all_ else out.unionByName(part).distinct()
    return out if cap is None else out.limit(cap)
