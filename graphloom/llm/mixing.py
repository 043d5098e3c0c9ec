"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source should be taken target / source_size times. The whole part
of that is given to all; of the fractional part the documents of a source share a mass
in words, which pairs move between them: in a pair (sizes s, t; fractions p, q) words
move one way or the other, drawn so that both fractions keep their expectation, until
one of the fractions is 0 or 1. The mass of the pair stays what it was, so a source's
words stay at its target. Buckets of about `fan_in` documents are folded so, large
documents first; what remains fractional in a bucket, one document at most, moves up
into a bucket of the next level of a reduction tree, until a source has one left. That
one is rounded to the nearer end, and what this adds or lacks is made good at the root:
documents decided there change over, large ones first, while that brings the source
nearer to its target. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

WORD = r"[^\x20\x09-\x0D]+"
SEED = 11
MOST_COPIES = 3.0


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = MOST_COPIES) -> DataFrame:
    """source, source_size, target for every distinct source of sizes (source, size).

    Sources by code point, null last, take the weights in turn and share the sum of all
    sizes by them; a target stops at most times its source's size and the excess is
    shared by weight among the others, until none is above. With capacities c and weights
    w, exactly the sources of least c / w stop: those whose c / w is at most what a unit
    of weight would get if only the sources before them had stopped. The windows here
    hold one row of some 50 bytes per source in one task, which spills beyond its memory:
    meant for sources such as crawls or collections, not for one per page.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(float(w)) for w in weights])
    by = by.withColumn("w", turn[(F.row_number().over(order) - 1) % len(weights)]).withColumn("cap", F.col("source_size") * most)
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, total = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0))
    left = F.sum("source_size").over(total) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight = F.sum("w").over(total) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    by = by.withColumn("level", left / weight).withColumn("stops", F.col("cap") <= F.col("level") * F.col("w"))
    # the level of the first source that doesn't stop holds for all after it
    level = F.min(F.when(~F.col("stops"), F.struct((F.col("cap") / F.col("w")).alias("r"), "source", "level"))).over(total)["level"]
    return by.withColumn("rest", level).select("source", "source_size", F.when(F.col("stops"), F.col("cap")).otherwise(F.col("rest") * F.col("w")).alias("target"))


# One step of a fold: the carried item c and the next item x move mass a (c grows) or b
# (x grows). A struct in a one-element array stands in for local names.
_STEP = """
  case when acc.c is null then named_struct('c', x, 'out', acc.out)
  else element_at(transform(array(named_struct(
      'up', acc.c.size * (1 - acc.c.p), 'down', acc.c.size * acc.c.p,
      'xup', x.size * (1 - x.p), 'xdown', x.size * x.p,
      'u', pmod(xxhash64(acc.c.doc_id, x.doc_id, acc.c.size, x.size, {seed}), 1073741824) / 1073741824d)), v ->
    element_at(transform(array(named_struct('a', least(v.up, v.xdown), 'b', least(v.down, v.xup))), m ->
      case when v.u * (m.a + m.b) < m.b then
        case when v.up <= v.xdown
          then named_struct('c', named_struct('doc_id', x.doc_id, 'size', x.size, 'p', x.p - m.a / x.size),
                            'out', concat(acc.out, array(named_struct('doc_id', acc.c.doc_id, 'size', acc.c.size, 'one', 1))))
          else named_struct('c', named_struct('doc_id', acc.c.doc_id, 'size', acc.c.size, 'p', acc.c.p + m.a / acc.c.size),
                            'out', concat(acc.out, array(named_struct('doc_id', x.doc_id, 'size', x.size, 'one', 0)))) end
      else
        case when v.down <= v.xup
          then named_struct('c', named_struct('doc_id', x.doc_id, 'size', x.size, 'p', x.p + m.b / x.size),
                            'out', concat(acc.out, array(named_struct('doc_id', acc.c.doc_id, 'size', acc.c.size, 'one', 0))))
          else named_struct('c', named_struct('doc_id', acc.c.doc_id, 'size', acc.c.size, 'p', acc.c.p - m.b / acc.c.size),
                            'out', concat(acc.out, array(named_struct('doc_id', x.doc_id, 'size', x.size, 'one', 1)))) end
      end), 1)), 1) end
"""
# Documents in list l change over while that brings e (words taken too many, or below 0
# too few) nearer to 0.
_SETTLED = """
  aggregate(l, named_struct('e', cast(e as double), 'out', cast(array() as {done})),
    (a, x) -> if(abs(a.e - x.size * (2 * x.one - 1)) < abs(a.e),
      named_struct('e', a.e - x.size * (2 * x.one - 1), 'out', concat(a.out, array(named_struct('doc_id', x.doc_id, 'size', x.size, 'one', 1 - x.one)))),
      named_struct('e', a.e, 'out', concat(a.out, array(x)))))
"""
_ITEM = "struct<doc_id:bigint,size:bigint,p:double>"
_DONE = "array<struct<doc_id:bigint,size:bigint,one:int>>"


def _folded(items: DataFrame) -> DataFrame:
    """One level of the tree: (source, c, out) for every bucket of items (source, bucket, doc_id, size, p)."""
    listed = items.groupBy("source", "bucket").agg(
        F.collect_list(F.struct((-F.col("size")).alias("s"), F.xxhash64("doc_id", F.lit(SEED)).alias("h"), F.struct("doc_id", "size", "p").alias("item"))).alias("l")
    )
    start = f"cast(named_struct('c', null, 'out', array()) as struct<c:{_ITEM},out:{_DONE}>)"
    fold = f"aggregate(transform(array_sort(l), y -> y.item), {start}, (acc, x) -> {_STEP.format(seed=SEED)})"
    return listed.select("source", "bucket", F.expr(fold).alias("acc")).select("source", "bucket", "acc.c", "acc.out")


def rounded(items: DataFrame, fan_in: int = 48) -> DataFrame:
    """source, doc_id, size, one (0 or 1) for items (source, doc_id, size, p), 0 < p < 1,
    whose (source, doc_id, size) are distinct. A bucket's rows are bounded by fan_in but
    for chance, however many rows a source has."""
    counts = items.groupBy(F.col("source").alias("s")).agg(F.ceil(F.count("*") / fan_in).cast("long").alias("of"))
    counts = written(counts, "counts")
    at = items.join(counts, F.col("source").eqNullSafe(F.col("s"))).select("source", "doc_id", "size", "p", F.pmod(F.xxhash64("doc_id", "size", F.lit(SEED)), F.col("of")).alias("bucket"))
    levels = [written(_folded(at), "mix")]
    most = counts.agg(F.max("of")).first()[0] or 1
    while most > 1:
        most = -(-most // fan_in)
        up = levels[-1].where("c is not null").select("source", (F.floor(F.col("bucket") / fan_in)).alias("bucket"), "c.*")
        levels.append(written(_folded(up), "mix"))
    settled = F.expr(_SETTLED.format(done=_DONE))
    near = "if(c.p >= 0.5, 1, 0)"
    last = f"if(c is null, array(), array(named_struct('doc_id', c.doc_id, 'size', c.size, 'one', {near})))"
    root = levels[-1].select("source", F.expr(f"concat(out, {last})").alias("l"), F.expr(f"coalesce(c.size * ({near} - c.p), 0d)").alias("e"))
    levels[-1] = written(root.select("source", settled.alias("s")).select("source", "s.*"), "mix")
    if len(levels) > 1:  # and once more in one of the source's first buckets
        e = levels[-1].select(F.col("source").alias("s"), "e")
        first = levels[0].join(e, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == 0), "left").select("source", F.col("out").alias("l"), F.coalesce("e", F.lit(0.0)).alias("e"))
        levels[0] = first.select("source", settled["out"].alias("out"))
    out = None
    for x in levels:
        done = x.select("source", F.explode("out").alias("o")).select("source", "o.doc_id", "o.size", "o.one")
        out = done if out is None else out.unionByName(done)
    return out


def taken_counts(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = MOST_COPIES) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every row of docs
    (doc_id, source, text): copies times size words are taken, at most `most` copies.

    size: words of the text (null: 0). Rows without words are taken 0 times. Rows equal
    in doc_id, source and size are rounded as one item of their joint fraction, so that
    any number of repeats needs one place in the tree; which of them get the extra copies
    makes no difference. Null doc_ids and sources are values like others; an empty table
    gives no rows. Draws depend on doc_id and size alone: reruns agree.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"))
    groups = written(slim.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")), "sizes")
    targets = written(source_targets(groups.select("source", (F.col("size") * F.col("n")).alias("size")), weights, most), "targets")
    t = targets.withColumnRenamed("source", "s")
    rows = groups.join(t, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rate = F.when(F.col("source_size") > 0, F.round(F.col("target") / F.col("source_size"), 12)).otherwise(0.0)
    rows = rows.withColumn("rate", rate).withColumn("base", F.when(F.col("size") > 0, F.floor("rate")).otherwise(0))
    joint = (F.col("rate") - F.col("base")) * F.col("n")
    rows = rows.withColumn("joint", F.when(F.col("size") > 0, F.round(joint, 9)).otherwise(0.0)).withColumn("more", F.floor("joint"))
    rows = written(rows, "rates")
    items = rows.where(F.col("joint") > F.col("more")).select("source", "doc_id", "size", (F.col("joint") - F.col("more")).alias("p"))
    ones = rounded(items).where("one = 1").select(F.col("source").alias("s"), F.col("doc_id").alias("d"), F.col("size").alias("z"), "one")
    got = rows.join(ones, F.col("source").eqNullSafe(F.col("s")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("size") == F.col("z")), "left")
    got = got.withColumn("extra", F.col("more") + F.coalesce("one", F.lit(0)))
    # repeats are dealt out again in chunks, since one row may stand for a third of the table
    chunk = 4096
    many = got.where("n > 1").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / chunk))))
    many = many.repartition(F.col("doc_id"), F.col("k")).withColumn("i", F.explode(F.sequence(F.col("k") * chunk, F.least(F.col("n"), (F.col("k") + 1) * chunk) - 1))).drop("k")
    each = got.where("n = 1").withColumn("i", F.lit(0).cast("long")).unionByName(many)
    each = each.withColumn("copies", (F.col("base") + (F.col("i") < F.col("extra")).cast("int")).cast("int"))
    return each.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix: every row of docs, with all its columns, as often as it is taken.

    Rows that share (doc_id, source, size) get the copies of their group in turn; equal
    ones among them are counted first, so that any number of repeats makes no hot key.
    Columns may have any names, those of taken_counts among them, but no map types.
    """
    counts = taken_counts(docs, **how).groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("all"), F.min("copies").alias("low"), F.count("*").alias("n"))
    counts = counts.select(F.col("doc_id").alias("d"), F.col("source").alias("s"), F.col("size").alias("z"), "all", "low", "n")
    row = F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns])
    rows = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"))
    on = F.col("doc_id").eqNullSafe(F.col("d")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))
    both = rows.join(counts.where("all > 0"), on).select("row", "d", "s", "z", "all", "low", "n")
    once = both.where("n = 1").select("row", F.explode(F.sequence(F.lit(1), F.col("all").cast("int"))).alias("k")).select("row")
    kinds = both.where("n > 1").groupBy("d", "s", "z", "all", "low", "n", "row").agg(F.count("*").alias("m"))
    before = Window.partitionBy("d", "s", "z").orderBy(F.xxhash64("row"), "row").rowsBetween(Window.unboundedPreceding, -1)
    extra = F.col("all") - F.col("low") * F.col("n")
    kinds = kinds.withColumn("at", F.coalesce(F.sum("m").over(before), F.lit(0)))
    kinds = kinds.withColumn("copies", F.col("low") * F.col("m") + F.greatest(F.lit(0), F.least(F.col("m"), extra - F.col("at"))))
    chunk = 4096
    parts = kinds.where("copies > 0").select("row", "copies", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / chunk))).alias("k"))
    many = parts.repartition("copies", "k").select("row", F.explode(F.sequence(F.col("k") * chunk, F.least("copies", (F.col("k") + 1) * chunk) - 1)).alias("i"))
    return once.unionByName(many.select("row")).select("row.*")
