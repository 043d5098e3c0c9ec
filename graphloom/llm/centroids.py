"""Clustering of integer vectors around centroids by partial-distance search.

Squared differences are added up a few dimensions at a time, those of the largest variance
first. The centroid that leads after the first ones is finished at once and gives the best
distance so far; every other is abandoned as soon as its part is strictly above that, and
what survives is finished over all dimensions. Abandoned centroids can't be
nearest, so the assignment is exact. Everything is integer, hence independent of order.

Tasks hand on one row of sums for each centroid and batch; what reaches the driver is a
row for each centroid, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

DIMENSIONS = 64
SCALE = 256
BOUND = 1 << 27
"""Integers beyond this count as it, so that a squared distance fits in a long."""
STEP = 8
"""Dimensions added between two looks at the best distance."""
BLOCK = 4096
"""Vectors held against all centroids at once."""


@dataclass
class Centroids:
    """Rows of integers; order has the dimensions by falling variance."""

    rows: np.ndarray
    order: np.ndarray

    def digest(self, i: int) -> str:
        return hashlib.sha256(",".join(map(str, self.rows[i])).encode()).hexdigest()


def integers(batch: pa.RecordBatch, dimensions: int = DIMENSIONS) -> tuple[pa.Array, np.ndarray]:
    """Ids and integer rows of the vectors in a batch (vec_id, embedding) that have exactly
    so many components, all of them finite."""
    lists = batch.column("embedding")
    fits = pc.fill_null(pc.equal(pc.list_value_length(lists), dimensions), False)
    lists, ids = lists.filter(fits), batch.column("vec_id").filter(fits)
    flat = pc.cast(lists.flatten(), pa.float64())
    x = flat.to_numpy(zero_copy_only=False).reshape(len(ids), dimensions)  # a null becomes nan
    ok = np.isfinite(x).all(1)
    whole = np.floor(np.clip(x[ok], -BOUND / SCALE, BOUND / SCALE) * SCALE).astype(np.int64)
    return ids.filter(pa.array(ok)), whole


def nearest(x: np.ndarray, c: Centroids) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the nearest centroid of each row (ties: the smaller number), the squared
    distance, and how many squared differences were computed."""
    n, k = len(x), len(c.rows)
    x, rows = x[:, c.order], c.rows[:, c.order]
    part = ((x[:, None, :STEP] - rows[None, :, :STEP]) ** 2).sum(2)
    at = part.argmin(1)
    gap = x[:, STEP:] - rows[at, STEP:]
    best = part[np.arange(n), at] + (gap * gap).sum(1)
    done = n * k * STEP + gap.size
    # what survives the first look goes on as a list of (row, centroid) pairs
    alive = part <= best[:, None]
    alive[np.arange(n), at] = False
    r, j = np.nonzero(alive)
    part = part[r, j]
    for lo in range(STEP, x.shape[1], STEP):
        gap = x[r, lo : lo + STEP] - rows[j, lo : lo + STEP]
        part = part + (gap * gap).sum(1)
        done += gap.size
        ok = part <= best[r]
        r, j, part = r[ok], j[ok], part[ok]
    if len(r):
        # of finished pairs the least distance, then the least number
        first = np.lexsort((j, part, r))
        r, j, part = r[first], j[first], part[first]
        lead = np.concatenate([[True], r[1:] != r[:-1]])
        r, j, part = r[lead], j[lead], part[lead]
        better = (part < best[r]) | ((part == best[r]) & (j < at[r]))
        best[r[better]], at[r[better]] = part[better], j[better]
    return at, best, done


def _assigned(batches: Iterator[pa.RecordBatch], c: Centroids) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, rows, centroids and distances, a block at a time."""
    for b in batches:
        for lo in range(0, b.num_rows, BLOCK):
            ids, x = integers(b.slice(lo, BLOCK))
            if len(ids):
                at, best, _ = nearest(x, c)
                yield ids, x, at, best


def _sums(batches: Iterator[pa.RecordBatch], c: Centroids) -> Iterator[pa.RecordBatch]:
    k = len(c.rows)
    sums, count = np.zeros((k, c.rows.shape[1]), np.int64), np.zeros(k, np.int64)
    squares = np.zeros_like(sums, dtype=float)
    for _, x, at, _ in _assigned(batches, c):
        by = np.argsort(at, kind="stable")
        here, first = np.unique(at[by], return_index=True)
        sums[here] += np.add.reduceat(x[by], first)
        squares[here] += np.add.reduceat(x[by].astype(float) ** 2, first)
        count += np.bincount(at, minlength=k)
    there = np.flatnonzero(count)
    if len(there):
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(count[there]), pa.array(list(sums[there])), pa.array(list(squares[there]))], ["cluster", "n", "sums", "squares"])


def _order(rows: np.ndarray) -> np.ndarray:
    return np.argsort(-rows.astype(float).var(0), kind="stable")


def seeds(vectors: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors with the least sha256 of `salt:vec_id`, in its order (rows that repeat
    an id: by their components, then)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, x = integers(b)
            # a batch needs no more than its own k least
            h = np.array([hashlib.sha256(f"{salt}:{i}".encode()).hexdigest() for i in ids.to_pylist()], dtype=str)
            least = np.lexsort((*x.T[::-1], h))[:k] if len(h) else []
            yield pa.RecordBatch.from_arrays([pa.array(h[least].tolist(), pa.string()), pa.array(list(x[least]), pa.list_(pa.int64()))], ["h", "x"])

    got = vectors.mapInArrow(rows, "h string, x array<long>").orderBy("h", "x").limit(k).collect()
    return np.array([r["x"] for r in got], np.int64).reshape(len(got), DIMENSIONS)


def fitted(vectors: DataFrame, *, k: int = 40, rounds: int = 5, salt: str = "2") -> Centroids:
    """Centroids after so many rounds of assigning all vectors (vec_id, embedding) and
    replacing every non-empty centroid by the floor of its vectors' mean."""
    rows = seeds(vectors, k, salt)
    c = Centroids(rows, _order(rows) if len(rows) else np.arange(DIMENSIONS))
    for _ in range(rounds if len(rows) else 0):
        got = vectors.mapInArrow(lambda it, c=c: _sums(it, c), "cluster int, n long, sums array<long>, squares array<double>")
        one = lambda col, i, kind: F.sum(F.col(col)[i].cast(kind))
        n = DIMENSIONS
        got = got.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[one("sums", i, "decimal(38,0)") for i in range(n)]).alias("sums"), F.array(*[one("squares", i, "double") for i in range(n)]).alias("squares")).collect()
        new, total, squares, count = c.rows.copy(), [0] * n, np.zeros(n), 0
        for r in got:  # a row a centroid
            new[r["cluster"]] = [int(s) // r["n"] for s in r["sums"]]
            total, squares, count = [a + int(b) for a, b in zip(total, r["sums"], strict=True)], squares + r["squares"], count + r["n"]
        mean = np.array([t / count for t in total])
        # the order is only a matter of speed: variance of all vectors
        c = Centroids(new, np.argsort(-(squares / count - mean**2), kind="stable"))
    return c


def clustered(vectors: DataFrame, *, k: int = 40, rounds: int = 5, salt: str = "2") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for every vector
    of vectors (vec_id, embedding) that has 64 components, none null or not finite.

    Others (null ones too) take no part; with fewer than k vectors each is a centroid; an
    empty table gives no rows; rows that repeat are vectors of their own; a null vec_id is
    a vector with the seed of `None`; other columns are not read. Components of 524,288 and
    more (of either sign) count as that."""
    vectors = vectors.select("vec_id", "embedding")
    kind = vectors.schema["vec_id"].dataType.simpleString()
    c = fitted(vectors, k=k, rounds=rounds, salt=salt)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, at, best in _assigned(batches, c) if len(c.rows) else ():
            yield pa.RecordBatch.from_arrays([ids, pa.array(at.astype(np.int32)), pa.array(best)], ["vec_id", "cluster", "distance"])

    got = written(vectors.mapInArrow(assign, f"vec_id {kind}, cluster int, distance long"), "assigned")
    digests = vectors.sparkSession.createDataFrame([(i, c.digest(i)) for i in range(len(c.rows))], "cluster int, centroid_sha256 string")
    each = got.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).join(digests, "cluster")
    each = each.crossJoin(F.broadcast(got.agg(F.sum("distance").alias("inertia"))))  # one row
    # at most k rows
    return got.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
