"""URL filter by a tree of path templates per host.

Segments that vary (numbers, hexadecimal and other long names with digits) become
wildcards, and so do all segments below a node with more than `fan_out` different ones.
Then the tree is merged from its leaves upwards: at each literal segment, the last one
first, sibling branches whose shares of blocked urls don't differ more than chance allows
become one. Labels are the verdicts of the rules on the urls that have one. A template's
purity is its smoothed share of blocked urls, shrunk towards that of the same template in
all hosts of its domain (the last two labels), those towards its top label's, those
towards the template's everywhere, and those towards the share of all labelled urls; so
hosts without labelled urls are judged by what is known nearest to them. A template whose
purity reaches `least` is rejected. DataFrame functions only; the tree is built from counts
of distinct (host, path pattern) pairs, so that a host with a third of all urls is a few rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
VARIABLE = r"^(?:\d+(?:\.\w+)?|[0-9a-f]{8,}|[0-9a-f-]{32,}|(?=.*\d)[\w.~%-]{16,}|.{40,})$"


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str


RULES = (Rule("block", "com", "/en/"), Rule("allow", "example.com", "/en/7"), Rule("allow", "net", "/de/"), Rule("block", "example.net", "/de/8"), Rule("block", "org", "/es/"))


def with_parts(pages: DataFrame) -> DataFrame:
    """page_id, url, host (A-Z lower-cased), path of every page; both empty for null or without ://."""
    p = pages.select("page_id", F.col("url").cast("string").alias("url"))
    at = "instr(url, '://')"
    p = p.withColumn("rest", F.expr(rf"if({at} > 0, regexp_replace(substring(url, {at} + 3), '(?s)[?#].*$', ''), '')"))
    p = p.withColumn("rest", F.coalesce("rest", F.lit("")))
    host = F.expr("substring_index(rest, '/', 1)")
    return p.select("page_id", "url", F.translate(host, UPPER, LOWER).alias("host"), F.expr("substring(rest, length(substring_index(rest, '/', 1)) + 1)").alias("path"))


def matched_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """struct(rule, action) of the longest rule that fits, else null; of equally long
    ones that with the longer host."""
    out = F.lit(None).cast("struct<rule:string,action:string>")
    for r in sorted(rules, key=lambda r: (len(r.host + r.path), len(r.host))):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.action).alias("action"))).otherwise(out)
    return out


def _without(template: Column, at: Column) -> Column:
    return F.transform(template, lambda s, i: F.when(i == at, "*").otherwise(s))


def merged(nodes: DataFrame, *, z: float, support: int) -> DataFrame:
    """host, template, shown for nodes (host, template, bad, known): what each template is
    merged into, itself if nothing. Needs a round for each literal segment of the deepest
    template; siblings take part with at least `support` labelled urls."""
    names = nodes.select("host", "template", F.col("template").alias("shown"))
    now = nodes.select("host", F.col("template").alias("shown"), "bad", "known", F.size("template").alias("below"))
    literals = F.size(F.filter("template", lambda s: s != "*"))
    for _ in range(nodes.agg(F.max(F.when(F.col("known") >= support, literals))).first()[0] or 0):
        at = F.array_max(F.transform("shown", lambda s, i: F.when((s != "*") & (i < F.col("below")), i)))
        now = written(now.withColumn("at", at).withColumn("branch", F.when(F.col("at").isNotNull(), _without(F.col("shown"), F.col("at")))), "branches")
        pool = now.where((F.col("known") >= support) & F.col("at").isNotNull()).groupBy("host", "branch", "at").agg(F.sum("bad").alias("all_bad"), F.sum("known").alias("all_known"), F.count("*").alias("n")).where("n > 1")
        p = F.col("all_bad") / F.col("all_known")
        alike = (F.col("known") >= support) & (F.abs(F.col("bad") / F.col("known") - p) <= z * F.sqrt(p * (1 - p) / F.col("known")))
        step = now.join(pool, ["host", "branch", "at"], "left").withColumn("to", F.when(F.coalesce(alike, F.lit(False)), F.col("branch")).otherwise(F.col("shown")))
        step = written(step.select("host", "shown", "to", "bad", "known", F.coalesce("at", F.lit(0)).alias("below")), "merges")
        names = names.join(step.select("host", "shown", "to"), ["host", "shown"]).select("host", "template", F.col("to").alias("shown"))
        now = step.groupBy("host", F.col("to").alias("shown")).agg(F.sum("bad").alias("bad"), F.sum("known").alias("known"), F.min("below").alias("below"))
    return names


def shrunk(leaf: DataFrame, prior: float) -> DataFrame:
    """leaf (host, template, bad, known; a row each) with purity and level, the nearest
    place with labelled urls of this template: host, domain, top, everywhere or none."""
    bad, known = leaf.agg(F.coalesce(F.sum("bad"), F.lit(0)), F.coalesce(F.sum("known"), F.lit(0))).first()
    out = leaf.withColumn("domain", F.substring_index("host", ".", -2)).withColumn("top", F.substring_index("host", ".", -1))
    purity, level = F.lit((bad + prior / 2) / (known + prior)), F.lit("none")
    for name, keys in (("everywhere", ["template"]), ("top", ["top", "template"]), ("domain", ["domain", "template"])):
        # places without labelled urls leave the share as it is
        place = out.where("known > 0").groupBy(*keys).agg(F.sum("bad").alias(f"bad_{name}"), F.sum("known").alias(f"known_{name}"))
        out = out.join(place, keys, "left")
        b, k = (F.coalesce(f"{c}_{name}", F.lit(0)) for c in ("bad", "known"))
        purity, level = (b + prior * purity) / (k + prior), F.when(k > 0, name).otherwise(level)
    purity, level = (F.col("bad") + prior * purity) / (F.col("known") + prior), F.when(F.col("known") > 0, "host").otherwise(level)
    return out.select("host", "template", purity.alias("purity"), level.alias("level"))


def templates(urls: DataFrame, *, fan_out: int = 40, z: float = 1.96, support: int = 5, prior: float = 2.0, least: float = 0.8) -> DataFrame:
    """host, pattern, template, purity, level, rejected for the distinct (host, pattern) of
    urls (host, pattern array<string>, action): pattern is the path's segments with varying
    ones as *, action block, allow or null."""
    seen = urls.groupBy("host", "pattern").agg(F.count_if(F.col("action") == "block").alias("bad"), F.count("action").alias("known"))
    seen = written(seen, "patterns")
    # nodes with too many different literal children
    steps = seen.select("host", "pattern", F.posexplode("pattern").alias("i", "segment")).withColumn("above", F.slice("pattern", F.lit(1), F.col("i")))
    wide = steps.where("segment <> '*'").groupBy("host", "above").agg(F.count_distinct("segment").alias("kinds")).where(F.col("kinds") > fan_out).select("host", "above", F.lit(True).alias("wide"))
    steps = steps.join(wide, ["host", "above"], "left").withColumn("segment", F.when(F.col("wide"), "*").otherwise(F.col("segment")))
    named = steps.groupBy("host", "pattern").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "segment"))), lambda x: x["segment"]).alias("template"))
    seen = seen.join(named, ["host", "pattern"], "left").withColumn("template", F.coalesce("template", F.array().cast("array<string>")))
    leaf = written(seen.groupBy("host", "template").agg(F.sum("bad").alias("bad"), F.sum("known").alias("known")), "templates")
    names = merged(leaf, z=z, support=support)
    shown = written(leaf.join(names, ["host", "template"]).groupBy("host", F.col("shown").alias("template")).agg(F.sum("bad").alias("bad"), F.sum("known").alias("known")), "shown")
    judged = shrunk(shown, prior).withColumnRenamed("template", "shown")
    out = seen.select("host", "pattern", "template").join(names, ["host", "template"]).join(judged, ["host", "shown"])
    return out.select("host", "pattern", F.concat(F.lit("/"), F.array_join("shown", "/")).alias("template"), "purity", "level", (F.col("purity") >= least).alias("rejected"))


def judged(pages: DataFrame, rules: tuple[Rule, ...] = RULES, *, depth: int = 16, **how) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity, decided_by for every row of
    pages (page_id, url).

    A template has at most `depth` segments: the tail of a longer path, whatever it holds, is
    generalised into one last segment **, as a varying segment is into *; paths that agree
    before it share a template, and all of them are judged.

    Urls that are null or lack :// have an empty host and path, which form a template
    like others. The verdict is the rule's, else block for a rejected template and allow
    for others. An empty table gives no rows; other columns, the html among them, aren't read.
    """
    p = with_parts(pages)
    p = p.withColumn("r", matched_rule(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.col("r.action").alias("action"))
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    pattern = F.transform(F.slice(segments, 1, depth), lambda s: F.when(s.rlike(VARIABLE), "*").otherwise(s))
    p = p.withColumn("pattern", F.when(F.size(segments) > depth, F.concat(pattern, F.array(F.lit("**")))).otherwise(pattern))
    t = written(templates(p, **how), "tree")
    out = p.join(t, ["host", "pattern"])
    verdict = F.coalesce("action", F.when(F.col("rejected"), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity", F.when(F.col("action").isNotNull(), "rule").otherwise(F.col("level")).alias("decided_by"))
