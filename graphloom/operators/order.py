"""Places in a global order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.plans.scratch import written


def grown(df: DataFrame) -> DataFrame:
    """df as the side of a join that is hashed where both sides are shuffled, one row for a key and
    many of them. By its files, in which codes take a byte or less, Spark would broadcast it."""
    return df.hint("shuffle_hash")


def numbered(rows: DataFrame, by: list[str | Column], name: str = "number") -> DataFrame:
    """rows with their place from 0 in the order of by, as a long column. Rows are sorted by
    ranges, each range numbers its own as it is written, and only a count for each range is
    summed up in one place. Rows that are equal in all of by have adjacent places in any order."""
    # the upper 31 bits are the range, the lower 33 the place in it
    parts = written(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), "ranges")
    path = parts._scratch
    parts = parts.withColumn("_range", F.shiftright("_at", 33))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = parts.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", before.alias("_before"))
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before")
    out = parts.join(F.broadcast(sizes), "_range").withColumn(name, place.cast("long")).drop("_range", "_at", "_before")
    out._scratch = path
    return out


def coded(edges: DataFrame, a: str, b: str) -> tuple[DataFrame, DataFrame]:
    """(id, code) of all ends, and edges (a, b) with codes for ids. Codes are longs in the order
    of the ids: what repeats joins over edges moves half as much, and its ties stay."""
    ids = written(numbered(edges.select(F.explode(F.array(a, b)).alias("id")).distinct(), ["id"], "code"), "codes")
    return ids, recoded(edges, ids, a, b)


def recoded(edges: DataFrame, ids: DataFrame, a: str, b: str) -> DataFrame:
    """edges (a, b) with the codes of ids (id, code); those with an end that has none go. Ids are
    as many as nodes, whatever their files' size says, and never broadcast."""
    of = lambda c: grown(ids.select(F.col("id").alias(c), F.col("code").alias(f"_{c}")))
    return edges.select(a, b).join(of(a), a).join(of(b), b).select(F.col(f"_{a}").alias(a), F.col(f"_{b}").alias(b))
