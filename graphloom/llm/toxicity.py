"""Toxicity by a factorization machine over hashed terms.

Terms are the words of a text (letters, lower case) and the beginnings of 4 and 5 letters
of longer words, hashed into 2^18 buckets; a text has a bucket or not. Buckets that occur
as often in either class by a chi-square test are dropped, so that the length of a text
doesn't add noise. The machine gives each bucket left a weight and a vector; the score is
the logistic of the sum of weights and of the inner products of all pairs of vectors, so
that pairs such as an insult and a mention of a group count beyond their parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Kept, crc_mod, released

BUCKETS = 1 << 18
FIT_ROWS = 12_000
"""Most labelled rows (about so many, drawn by a hash of the id) that the machine is fitted on."""
_LETTERS = re.compile(r"[^\W\d_]+")


def _buckets(chunk: bytes) -> bytes:
    out = []
    for w in _LETTERS.findall(chunk.decode("utf-8", "replace").lower()):
        terms = [w] + [f"{w[:k]}~" for k in (4, 5) if len(w) > k]
        out += [xxhash.xxh32_intdigest(x) % BUCKETS for x in terms]
    return np.array(out, dtype="<u4").tobytes()


def text_buckets(text: str | None, kept: Kept) -> np.ndarray:
    """The distinct buckets (or what kept gives for each word) of the whole text."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    return np.unique(np.frombuffer(b"".join(kept.all(words)), dtype="<u4"))


def word_buckets() -> Kept:
    return Kept(lambda words: [_buckets(w) for w in words])


@dataclass
class Machine:
    """Buckets that count, sorted, with their weights and vectors."""

    buckets: np.ndarray
    bias: float
    weight: np.ndarray
    vector: np.ndarray

    def raw(self, rows: np.ndarray, cols: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Values of n texts whose buckets (places in self.buckets) are cols, by rows; and the vector sums."""
        k = self.vector.shape[1]
        y = self.bias + np.bincount(rows, self.weight[cols], n)
        sums = np.zeros((n, k))
        for f in range(k):
            v = self.vector[cols, f]
            sums[:, f] = np.bincount(rows, v, n)
            y += 0.5 * (sums[:, f] ** 2 - np.bincount(rows, v * v, n))
        return y, sums


def _sigmoid(y: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(y, -35, 35)))


def fit(texts: list[np.ndarray], labels: np.ndarray, *, factors: int = 4, rounds: int = 40, least: int = 3, chi2: float = 11.0, rate: float = 0.2, ridge: float = 1e-4, seed: int = 5) -> Machine:
    """A machine for texts (the distinct buckets of each) and labels 0 or 1, by AdaGrad on
    small batches. Only buckets that pass the test are gathered in one place.

    With one class only the score is constant; without rows it is near 0."""
    labels = np.asarray(labels, float)
    n, pos = len(labels), labels.sum()
    bias = np.log((pos + 0.05) / (n - pos + 1.0))
    with_, a = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for t, label in zip(texts, labels, strict=True):
        with_[t] += 1
        a[t] += label
    b, c, d = with_ - a, pos - a, n - pos - (with_ - a)
    gap = np.maximum(0, np.abs(a * d - b * c) - n / 2)
    stat = n * gap**2 / np.maximum(1e-9, (a + b) * (c + d) * (a + c) * (b + d))
    kept = np.flatnonzero((with_ >= least) & (stat >= chi2) & (0 < pos < n))
    rng = np.random.default_rng(seed)
    m = Machine(kept.astype(np.uint32), float(bias), np.zeros(len(kept)), rng.normal(0, 0.02, (len(kept), factors)))
    if not len(kept):
        return m
    place = np.full(BUCKETS, -1)
    place[kept] = np.arange(len(kept))
    found = [x[x >= 0] for x in (place[t] for t in texts)]
    start = np.cumsum([0, *map(len, found)])
    cols = np.concatenate(found)
    gw, gv, gb = np.full(len(kept), 1e-6), np.full((len(kept), factors), 1e-6), 1e-6
    for _ in range(rounds):
        order = rng.permutation(n)
        for lo in range(0, n, 256):
            pick = order[lo : lo + 256]
            size = start[pick + 1] - start[pick]
            r = np.repeat(np.arange(len(pick)), size)
            x = cols[np.repeat(start[pick] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())]
            y, sums = m.raw(r, x, len(pick))
            err = (_sigmoid(y) - labels[pick]) / len(pick)
            d = np.bincount(x, err[r], len(kept)) + ridge * m.weight / len(pick)
            gw += d * d
            m.weight -= rate * d / np.sqrt(gw)
            for f in range(factors):
                v = m.vector[:, f]
                d = np.bincount(x, err[r] * (sums[r, f] - v[x]), len(kept)) + ridge * v / len(pick)
                gv[:, f] += d * d
                m.vector[:, f] -= 0.2 * rate * d / np.sqrt(gv[:, f])
            d = err.sum()
            gb += d * d
            m.bias -= rate * d / np.sqrt(gb)
    return m


def _scores(batches: Iterator[pa.RecordBatch], m: Machine) -> Iterator[pa.RecordBatch]:
    place = np.full(BUCKETS, -1)
    place[m.buckets] = np.arange(len(m.buckets))

    def known(chunk: bytes) -> bytes:
        at = place[np.frombuffer(_buckets(chunk), dtype="<u4")]
        return at[at >= 0].astype("<u4").tobytes()

    kept = Kept(lambda words: [known(w) for w in words])
    for b in batches:
        found = [text_buckets(t.as_py(), kept) for t in b.column("text")]
        rows = np.repeat(np.arange(len(found)), [len(x) for x in found]) if found else np.empty(0, int)
        y, _ = m.raw(rows, np.concatenate(found).astype(int) if found else np.empty(0, int), len(found))
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns) if b.schema.names[i] != "text"), pa.array(_sigmoid(y))], [*(x for x in b.schema.names if x != "text"), "score"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept = word_buckets()
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array([text_buckets(t.as_py(), kept).astype(np.int32) for t in b.column("text")], pa.list_(pa.int32()))], ["toxic", "buckets"])


def trained(docs: DataFrame, labels: DataFrame, *, folds: int = 5, fit_rows: int = FIT_ROWS, **how) -> Machine:
    """A machine fitted on about fit_rows labelled documents at most, drawn by a hash of
    their id, none of the held-out fold (crc32 of the id modulo folds is 0). Rows of
    labels that share a doc_id count once, as toxic if one says so; null labels don't count."""
    known = labels.where("doc_id is not null and toxic is not null").where(crc_mod(F.col("doc_id"), folds) != 0)
    known = known.groupBy(F.col("doc_id").cast("long").alias("d")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    n = known.count()
    if n > fit_rows:
        known = known.where(F.pmod(F.xxhash64("d", F.lit("fit")), F.lit(1 << 30)) < int(fit_rows / n * (1 << 30)))
    # at most about fit_rows rows of 12 bytes
    rows = docs.select(F.col("doc_id").cast("long").alias("d"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), "d")
    got = rows.select("toxic", "text").mapInArrow(lambda it: released(_features(it)), "toxic int, buckets array<int>").toArrow()
    lists = (c.slice(i, 1).flatten().to_numpy() for c in got.column("buckets").chunks for i in range(len(c)))
    machine = fit(list(lists), got.column("toxic").to_numpy(), **how)
    del got, lists
    pa.default_memory_pool().release_unused()
    return machine


def scored(docs: DataFrame, machine: Machine, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text): the whole
    text is scored; a null or empty text gets the score of a text without terms, a null
    doc_id is not held out. Other columns are not read."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(lambda it: released(_scores(it, machine)), f"doc_id {kind}, score double")
    return out.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), folds) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(docs: DataFrame, machine: Machine, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, that score below threshold."""
    rows = docs.withColumn("text", F.col("text").cast("string"))
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def texts() -> Iterator[pa.RecordBatch]:
            for b in batches:
                held.append(b)
                yield b.select(["text"])

        for s in _scores(texts(), machine):
            yield held.pop().filter(pa.array(s.column("score").to_numpy() < threshold))

    return rows.mapInArrow(lambda it: released(keep(it)), names)
