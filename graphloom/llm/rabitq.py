"""Inner-product search with randomly rotated one-bit codes.

Vectors are rotated by one random orthogonal matrix and kept as the signs of their
coordinates, with two scalars: the length of the vector and the inner product of its
direction with its code. A query is rotated too and rounded to 6-bit numbers; ands and
bit counts of its bit planes with a code estimate the inner product without bias, with a
known bound on the error. The best estimates are reranked on the original vectors first;
then so is every candidate whose upper bound reaches their k-th score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

QUERY_BITS = 6
QUERY_BLOCK = 2_048
ROW_BLOCK = 16_384


def rotation(dim: int, seed: int = 3) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def _directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of x at length 1, and their lengths. Rows are scaled by their largest
    component first, so that squares neither overflow nor vanish."""
    top = np.abs(x).max(axis=1)
    x = x / top[:, None]
    length = np.sqrt((x * x).sum(axis=1))
    return x / length[:, None], top * length


class Codes:
    """One-bit codes of the rows of x."""

    def __init__(self, x: np.ndarray, turn: np.ndarray):
        self.dim = x.shape[1]
        x, self.length = _directions(x)
        o = x @ turn
        bits = o > 0
        self.words = list(np.ascontiguousarray(self.packed(bits).T))
        self.ones = bits.sum(axis=1)
        self.with_code = np.abs(o).sum(axis=1) / np.sqrt(self.dim)  # of the direction and its code

    @staticmethod
    def packed(bits: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(bits), -(-bits.shape[1] // 64) * 64), np.uint8)
        wide[:, : bits.shape[1]] = bits
        return np.packbits(wide, axis=1, bitorder="little").view(np.uint64)

    def bounds(self, query: np.ndarray, turn: np.ndarray, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
        """Estimates of the inner products of a query with all rows, and their error bounds;
        infinite where doubles can't hold them."""
        q, length = _directions(query[None, :])
        q = q[0] @ turn
        low = float(q.min())
        step = (float(q.max()) - low) / ((1 << QUERY_BITS) - 1) or 1.0
        level = np.rint((q - low) / step).astype(np.int64)
        dots = np.zeros(len(self.ones))
        for b in range(QUERY_BITS):
            plane = self.packed(((level >> b) & 1).astype(bool)[None, :])[0]
            for mine, theirs in zip(self.words, plane, strict=True):
                dots += np.bitwise_count(mine & theirs) * float(1 << b)
        root = np.sqrt(self.dim)
        code = (2 * (step * dots + low * self.ones) - (step * level.sum() + low * self.dim)) / root  # of code and query
        estimate = code / self.with_code
        spread = np.sqrt(np.maximum(0, 1 - self.with_code**2)) / self.with_code
        error = epsilon * spread / np.sqrt(max(1, self.dim - 1)) + step * root / 2 / self.with_code
        scale = self.length * length[0]
        estimate, error = estimate * scale, error * scale
        sure = np.isfinite(estimate) & np.isfinite(error)
        return np.where(sure, estimate, np.inf), np.where(sure, error, 0.0)


def inner(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of the rows of x with q, in double precision, coordinate by coordinate."""
    out = np.zeros(len(x))
    for j in range(x.shape[1]):
        out += x[:, j] * q[j]
    return out


def _kth(scores: np.ndarray, k: int, real: np.ndarray | None = None) -> float:
    """The k-th largest score (of those whose real is finite); -inf if they are fewer."""
    scores = scores if real is None else scores[np.isfinite(real)]
    return np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) > k else -np.inf


def _cell(queries: pa.Table, rows: pa.Table, k: int, epsilon: float) -> pa.Table:
    """The k nearest of the rows of one block for each query of one block."""
    with np.errstate(over="ignore", invalid="ignore", under="ignore"):
        return _best(queries, rows, k, epsilon)


def _best(queries: pa.Table, rows: pa.Table, k: int, epsilon: float) -> pa.Table:
    out: list[np.ndarray] = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
    if queries.num_rows and rows.num_rows:
        get = lambda t: np.array(t.column("v").combine_chunks().flatten(), dtype=float).reshape(t.num_rows, -1)
        x, q, ids, qids = get(rows), get(queries), rows.column("vec_id").to_numpy(), queries.column("vec_id").to_numpy()
        turn = rotation(x.shape[1])
        codes = Codes(x, turn)
        found: list[list[np.ndarray]] = [[], [], []]
        for query, qid in zip(q, qids, strict=True):
            estimate, error = codes.bounds(query, turn, epsilon)
            own = ids == qid
            estimate[own] = -np.inf
            # the k-th score among the best estimates; whatever may reach it is reranked
            head = np.argpartition(-estimate, 4 * k)[: 4 * k] if len(estimate) > 4 * k else np.arange(len(estimate))
            first = x[head] @ query
            pick = np.flatnonzero((estimate + error >= _kth(first, k, first + estimate[head])) & ~own)
            rough = x[pick] @ query
            sure = np.isfinite(rough)
            near = _kth(rough, k, rough) - 1e-9 * (1 + np.abs(rough[sure]).max(initial=0))
            pick = pick[~sure | (rough >= near)]
            score = inner(x[pick], query)
            best = np.lexsort((ids[pick], -score, ~np.isnan(score)))[:k]
            for c, v in zip(found, (np.full(len(best), qid), ids[pick][best], score[best]), strict=True):
                c.append(v)
        out = [np.concatenate(c) for c in found]
    return pa.table([pa.array(c) for c in out], names=["query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, *, every: int = 20, k: int = 20, epsilon: float = 5.0, query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of vectors (vec_id, embedding) whose
    vec_id is divisible by every, its k nearest other rows (all, if fewer), nearest first.

    Nearness is the largest inner product in double precision; ties go to the smaller
    vec_id. Vectors that are null, zero or hold null or non-finite components take no
    part, nor do rows without vec_id; finite components of any size do, and a product that
    doubles can't hold is infinite, or not a number and ranks first, as in Spark's order; of rows that repeat a vec_id the least vector
    counts; vectors of different lengths don't meet. Every query block meets every row
    block in a task of its own, both of bounded size and dealt by a hash of the id, so
    that equal vectors gather nowhere. epsilon scales the error bound of the codes: at 5
    standard deviations about one neighbour in 3,000,000 is missed.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    v = v.where(~bad & F.exists("v", lambda c: c != 0))
    v = written(v.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v")), "vectors")
    asked = F.col("vec_id") % every == 0
    n = v.groupBy("dim").agg(F.count("*").alias("n"), F.count_if(asked).alias("q"))
    n = n.select("dim", F.ceil(F.col("n") / row_block).cast("int").alias("nr"), F.greatest(F.lit(1), F.ceil(F.col("q") / query_block).cast("int")).alias("nq"))
    v = v.join(F.broadcast(n) if n.limit(10_001).count() <= 10_000 else n, "dim")
    deal = lambda salt, of: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.col(of)).cast("int")
    every_ = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    q = v.where(asked).withColumn("bq", deal("q", "nq")).withColumn("br", every_("nr")).select(F.col("dim").alias("dim_"), F.col("bq").alias("bq_"), F.col("br").alias("br_"), F.col("vec_id").alias("vec_id"), F.col("v").alias("v"))
    r = v.withColumn("br", deal("r", "nr")).withColumn("bq", every_("nq")).select("dim", "bq", "br", "vec_id", "v")
    found = q.groupBy("dim_", "bq_", "br_").cogroup(r.groupBy("dim", "bq", "br")).applyInArrow(lambda a, b: _cell(a, b, k, epsilon), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
