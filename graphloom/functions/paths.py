"""URL path normal forms as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WILD = "{*}"
# Fixed value: a segment that is a parameter.
PARAMETER = r"^(\{[^}]*\}|:[A-Za-z_]\w*|\*)$"


def _path(url: Column, cut: str, scheme: str) -> Column:
    given = F.regexp_replace(F.coalesce(url, F.lit("")), r"^\s+|\s+$", "")
    bare = F.regexp_replace(given, scheme, "")
    bare = F.regexp_replace(bare, cut, "")
    bare = F.regexp_replace(F.concat(F.lit("/"), bare), "/{2,}", "/")
    bare = F.regexp_replace(bare, "/+$", "")
    return F.when(F.coalesce(url, F.lit("")) == "", "").when(bare == "", "/").otherwise(bare)


def _segments(path: Column, wild: str) -> Column:
    parts = F.transform(F.split(path, "/"), lambda s: F.when(s.rlike(wild) | s.contains("{"), F.lit(WILD)).otherwise(F.lower(s)))
    return F.array_join(parts, "/")


def normalize(url: Column) -> Column:
    """The linker's form: without scheme, host and query, one slash between segments, no
    trailing slash, parameters as {*}, lower case. Null and empty become empty, white space
    alone becomes /. Idempotent."""
    return _segments(_path(url, r"(?s)\?.*$", r"^[a-z]+://[^/]+"), PARAMETER)


def normalize_client(url: Column) -> Column:
    """The client extractor's form: also cuts fragments, takes schemes in any case, and
    has no bare-* parameters."""
    return _segments(_path(url, r"(?s)[?#].*$", r"^(?i:[a-z]+)://[^/]+"), r"^(\{[^}]*\}|:[A-Za-z_]\w*)$")


def normalize_server(path: Column) -> Column:
    """The server extractor's form: {x} becomes {*}, the rest lower case."""
    return F.lower(F.regexp_replace(_path(path, "$^", "$^"), r"\{[^}]*\}", r"\{*\}"))


def join_paths(base: Column, path: Column) -> Column:
    """A class's path and a method's path, in the server form."""
    return normalize_server(F.concat_ws("/", base, path))


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def folded(parts: Column) -> Column:
    """Segments without empty ones, . and .., which takes the one before away (at the top: none)."""
    step = lambda acc, s: F.when(s.isin("", "."), acc).when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s)))
    return F.aggregate(parts, F.array().cast("array<string>"), step)


def folder(path: Column) -> Column:
    """What stands before the last slash; empty without one."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def resolved(base: Column, reference: Column) -> Column:
    """A reference of a document at base as an absolute path without . and ..: references that
    begin with a slash start at the top."""
    whole = F.when(reference.startswith("/"), reference).otherwise(F.concat(folder(base), F.lit("/"), reference))
    return F.concat(F.lit("/"), F.array_join(folded(F.split(whole, "/")), "/"))


def resolved_url(base: Column, reference: Column) -> Column:
    """A reference as a url, by the url of the page it is on: absolute ones as they are, //host
    in the page's scheme, else below the page's host. A reference of a fragment alone keeps
    the page's path and query, one of a query alone its path."""
    origin, scheme = F.regexp_extract(base, r"^([A-Za-z][\w+.-]*://[^/?#]*)", 1), F.regexp_extract(base, r"^([A-Za-z][\w+.-]*:)", 1)
    path = F.regexp_replace(F.substring(base, F.length(origin) + 1, F.length(base)), r"[?#].*$", "")
    bare, tail = F.regexp_extract(reference, r"^([^?#]*)", 1), F.regexp_extract(reference, r"^[^?#]*(.*)$", 1)
    slash = F.when(bare.rlike(r"(?:^|/)\.{0,2}$") & (resolved(path, bare) != "/"), "/").otherwise("")
    below = F.concat(origin, F.when(bare == "", path).otherwise(F.concat(resolved(path, bare), slash)), tail)
    kept = F.concat(F.regexp_replace(base, r"#.*$", ""), reference)
    return F.when(reference.rlike(r"^(?:#|$)"), kept).when(reference.rlike(r"^[A-Za-z][\w+.-]*:"), reference).when(reference.startswith("//"), F.concat(scheme, reference)).otherwise(below)


def snake_case(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2"))


def pattern_score(call: Column, endpoint: Column) -> Column:
    """Similarity of two lists of segments: 0 if they differ in length or in a pair of
    literals; 0.5 without a pair of literals; else the share of literal pairs."""
    both = F.zip_with(call, endpoint, lambda a, b: F.when((a == WILD) | (b == WILD), F.lit(0)).when(a == b, F.lit(1)).otherwise(F.lit(-1)))
    hits = F.size(F.filter(both, lambda x: x == 1))
    miss = (F.size(call) != F.size(endpoint)) | F.exists(both, lambda x: x == -1)
    return F.when(miss | (F.size(call) == 0), 0.0).when(hits == 0, 0.5).otherwise(hits / F.size(call))
