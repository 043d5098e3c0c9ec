"""Document fingerprints from prefix polynomial hashes.

The code points of a text are summed up with powers of two bases modulo 2^31 - 1, once;
from these prefix arrays the hash of any span follows in constant time, so that spans are
compared wherever they stand and longest common extensions are found by binary search. A
fingerprint is the hash of the whole text and, for each of 64 ranges, the least hash of
its spans of 16 code points there; equal ranges of two fingerprints estimate how much the
texts share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions

PRIME = (1 << 31) - 1
_P, _S = np.uint64(PRIME), np.uint64(31)
BASES = (911382323, 1442695041)
SPAN = 16
RANGES = 64
_NONE = np.iinfo(np.uint64).max


def _mod(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> _S)
    x = (x & _P) + (x >> _S)
    return np.where(x >= _P, x - _P, x)


class _Powers:
    """Powers of a base and of its inverse, as long as asked for so far."""

    def __init__(self, base: int):
        self.of = [base, pow(base, PRIME - 2, PRIME)]
        self.have = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def get(self, which: int, n: int) -> np.ndarray:
        a = self.have[which]
        while len(a) < n:
            a = self.have[which] = np.concatenate([a, _mod(a * np.uint64(pow(self.of[which], len(a), PRIME)))])
        return a[:n]


_POWERS = [_Powers(b) for b in BASES]


class PrefixHash:
    """Prefix arrays of one text."""

    def __init__(self, text: str | None):
        codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.n = len(codes)
        self.sums = [np.concatenate([np.zeros(1, np.uint64), _mod(np.cumsum(_mod(codes * p.get(0, self.n)), dtype=np.uint64))]) for p in _POWERS]

    def spans(self, length: int, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """62-bit hashes of all spans of a length that start in [lo, hi)."""
        hi = self.n - length + 1 if hi is None else min(hi, self.n - length + 1)
        if hi <= lo:
            return np.empty(0, np.uint64)
        out = np.zeros(hi - lo, np.uint64)
        for s, p in zip(self.sums, _POWERS, strict=True):
            d = s[lo + length : hi + length] + _P - s[lo:hi]
            out = (out << _S) | _mod(_mod(d) * p.get(1, hi)[lo:])
        return out

    def span(self, start: int, length: int) -> tuple[int, int]:
        return int(self.spans(length, start, start + 1)[0]), length

    def equal(self, i: int, j: int, length: int, other: PrefixHash | None = None) -> bool:
        """Whether the spans of a length at i here and at j (of other) are equal: the differences
        of prefix sums, the one with the earlier start moved to the later one."""
        for base, s, t in zip(BASES, self.sums, (other or self).sums, strict=True):
            a, b = int(s[i + length]) - int(s[i]), int(t[j + length]) - int(t[j])
            if i != j:
                move = pow(base, abs(j - i), PRIME)
                a, b = (a * move, b) if i < j else (a, b * move)
            if (a - b) % PRIME:
                return False
        return True

    def common(self, i: int, j: int, other: PrefixHash | None = None) -> int:
        """Longest common extension of the suffixes at i and at j (of other), by binary search."""
        lo, hi = 0, min(self.n - i, (other or self).n - j)
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if self.equal(i, j, mid, other) else (lo, mid - 1)
        return lo


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_RANGE_STARTS = np.arange(RANGES, dtype=np.uint64) << np.uint64(58)


def _least(h: np.ndarray) -> np.ndarray:
    """The least of mixed hashes h in each range; _NONE in an empty one."""
    h = np.sort(h)
    at = np.searchsorted(h, _RANGE_STARTS)
    return np.where(np.append(at[1:], len(h)) > at, np.append(h, np.uint64(_NONE))[at], np.uint64(_NONE))


def _short(n: int, h: int) -> np.ndarray:
    """The sketch of a text shorter than a span: the text is the span."""
    return _least(_mix(np.array([h], np.uint64) + np.uint64(n)))


def _named(sketch: np.ndarray, whole: int, n: int) -> str:
    """A fingerprint as text: 16 digits for the whole text, then 4 for each range."""
    low = np.where(sketch == np.uint64(_NONE), 0, 1 + (sketch >> np.uint64(20)) % np.uint64(0xFFFF)).astype(">u2")
    head = int(_mix(np.array([whole], np.uint64) + np.uint64(n))[0])
    return f"{head:016x}{low.tobytes().hex()}"


def fingerprint(text: str | None) -> str:
    p = PrefixHash(text)
    whole = p.span(0, p.n)[0] if p.n else 0
    sketch = _least(_mix(p.spans(SPAN))) if p.n >= SPAN else _short(p.n, whole) if p.n else np.full(RANGES, _NONE, np.uint64)
    return _named(sketch, whole, p.n)


def likeness(a: str, b: str) -> float:
    """0 to 1: the share of spans that two fingerprints' texts have in common (twice the
    common ones by the sum of both), as the equal ranges tell; 1 for equal texts."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(s[16:]), ">u2") for s in (a, b))
    some = int(((x > 0) | (y > 0)).sum())
    j = int(((x == y) & (x > 0)).sum()) / some if some else 0.0
    return 2 * j / (1 + j)


class _Document:
    def __init__(self, doc_id: int | None, text: str):
        self.doc_id, self.text, self.n = doc_id, text, len(text)
        self.hashes = PrefixHash(text)
        self.mixed = _mix(self.hashes.spans(SPAN))
        whole = self.hashes.span(0, self.n)[0] if self.n else 0
        self.name = _named(_least(self.mixed), whole, self.n) if self.n >= SPAN else fingerprint(text)


def _edited(d: _Document, after: _Document) -> tuple[str, str, int]:
    """The edited text, its fingerprint, and how far it begins as the text does: what both
    halves' prefix arrays tell of their own spans is used again, only the spans over the
    seam are hashed anew."""
    cut, take = d.n - d.n // 2, min(d.n // 2, after.n)
    alike = cut + d.hashes.common(cut, 0, after.hashes)
    text = d.text[:cut] + after.text[:take]
    if len(text) < SPAN:
        return text, fingerprint(text), alike
    lo, hi = max(0, cut - SPAN + 1), min(len(text), cut + SPAN - 1)
    seam = PrefixHash(text[lo:hi])
    parts = [d.mixed[: max(0, cut - SPAN + 1)], after.mixed[: max(0, take - SPAN + 1)], _mix(seam.spans(SPAN))]
    whole = 0
    for s, t, p in zip(d.hashes.sums, after.hashes.sums, _POWERS, strict=True):
        both = int(s[cut]) + int(t[take]) * int(p.get(0, cut + 1)[cut])
        whole = whole << 31 | both % PRIME
    return text, _named(_least(np.concatenate(parts)), whole, len(text)), alike


_COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "common_edited", "common_next"]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, extra, doc_id, text) of a partition in order; an extra row only
    follows the last of its block."""
    before: _Document | None = None
    block, ended = None, False
    out: list[tuple] = []

    def row(d: _Document, after: _Document) -> tuple:
        text, name, alike = _edited(d, after)
        return d.doc_id, d.n, hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(), d.name, name, likeness(d.name, name), likeness(d.name, after.name), alike, d.hashes.common(0, 0, after.hashes)

    def batch() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], _COLUMNS)

    for b in batches:
        for k, extra, doc_id, text in zip(b.column("block").to_pylist(), b.column("extra").to_pylist(), b.column("doc_id").to_pylist(), b.column("text"), strict=True):
            if k != block:
                block, before, ended = k, None, False
            if ended:
                continue
            d = _Document(doc_id, text.as_py() or "")
            if before is not None:
                out.append(row(before, d))
            before, ended = d, extra
            if len(out) >= 512:
                yield batch()
                out = []
    if out:
        yield batch()


def fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, common_edited, common_next for every row of docs (doc_id, text); the last
    two are the longest common extensions from the starts of the text and of its edited
    text, and of the text and the next one, in code points.

    The next row is that of the next doc_id; rows of equal doc_id follow each other by
    text, rows without doc_id come last, and the first row follows the last. A null text
    counts as empty; empty texts have a fingerprint of their own. A table of one row is
    its own next. Other columns are not read. The rows are dealt out by ranges of doc_id;
    a range also gets the first row of the next one, which is found from the ids alone.
    """
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = shuffle_partitions(spark)
    cuts = sorted(set(d.select("doc_id").where("doc_id is not null").approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n))) if n > 1 else []
    block = F.lit(0)
    if cuts:
        edges = F.array(*[F.lit(float(c)) for c in cuts])
        block = F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(F.size(F.filter(edges, lambda c: c <= F.col("doc_id").cast("double"))))
    d = d.withColumn("block", block.cast("int"))
    # one row for each range
    first = [(r["block"], r["least"]) for r in d.groupBy("block").agg(F.min("doc_id").alias("least")).orderBy("block").collect()]
    follows = [(first[i][0], first[(i + 1) % len(first)][1]) for i in range(len(first))]
    extra = F.broadcast(spark.createDataFrame(follows, "block int, least long"))
    from_ = d.drop("block").join(extra, d["doc_id"].eqNullSafe(extra["least"])).select("block", F.lit(True).alias("extra"), "doc_id", "text")
    rows = d.select("block", F.lit(False).alias("extra"), "doc_id", "text").unionByName(from_)
    rows = rows.repartitionById(len(cuts) + 2, F.col("block")).sortWithinPartitions("block", "extra", F.col("doc_id").asc_nulls_last(), "text")
    return rows.mapInArrow(_rows, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_edited long, common_next long")
