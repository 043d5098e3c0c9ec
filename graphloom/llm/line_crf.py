"""Quality of documents by a linear-chain conditional random field over their lines.

Every line is good or bad. What speaks for either are shares of kinds of characters and of
repeated words in the line itself and in the lines before and after it; the chain adds how
readily labels follow one another. Forward-backward gives each line's chance of being good;
their mean, weighted by the lines' lengths, is the document's, and a logistic curve fitted
on the same labelled documents turns it into a score.

Only documents are labelled, so the lines of bad ones begin as bad and are labelled anew by
the field itself: a bad document keeps at least its worst line bad, while the lines that
look good in it are given back.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, released

FIT_ROWS = 4_000
"""Most labelled rows (about so many, drawn by a hash of the id) that the field is fitted on."""
FIT_LINES = 500
"""Rows with more lines than that aren't fitted on. They are scored like all others."""

# Kinds of bytes in UTF-8: 0 others (beyond ASCII), 1 small letters, 2 capitals, 3 digits, 4 white space, 5 punctuation of prose, 6 symbols
_KINDS = 7
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = 6
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 1, 2, 3
_KIND[[9, 10, 11, 12, 13, 32]] = 4
_KIND[[ord(c) for c in ".,;:'\"-()?"]] = 5
OWN = ("symbols", "any symbol", "lone symbols", "capitals", "digits", "punctuation", "no letters", "repeated next", "few distinct", "one word", "long words", "same as before")


@dataclass
class Lines:
    """Lines of several texts: features of each line, lengths in bytes, where texts begin."""

    own: np.ndarray
    length: np.ndarray
    start: np.ndarray


def lines(texts: list[str]) -> Lines:
    """The lines of texts that aren't blank. A text without any has none."""
    parts, words, start = [], [], [0]
    for t in texts:
        for line in t.split("\n"):
            w = line.split()
            if w:
                parts.append(line)
                words.append(w)
        start.append(len(parts))
    start = np.array(start)
    n = len(parts)
    own = np.zeros((n, len(OWN)))
    if not n:
        return Lines(own, np.zeros(0), start)
    raw = [p.encode("utf-8", "replace") for p in parts]
    length = np.array([len(r) for r in raw], float)
    kind, first = _KIND[np.frombuffer(b"".join(raw), np.uint8)], np.cumsum([0, *length[:-1]]).astype(int)
    kinds = np.stack([np.add.reduceat(kind == k, first, dtype=np.int64) for k in range(_KINDS)], 1).astype(float)
    solid = np.maximum(1, length - kinds[:, 4])
    letters = kinds[:, 0] + kinds[:, 1] + kinds[:, 2]
    count = np.array([len(w) for w in words], float)
    again = np.array([sum(map(eq, w, w[1:])) for w in words], float)
    distinct = np.array([len(set(w)) for w in words], float)
    # a symbol between blanks or ends of lines
    blank = np.concatenate([[True], kind == 4, [True]])
    begins, ends = np.zeros(len(kind), bool), np.zeros(len(kind), bool)
    begins[first], ends[(first + length - 1).astype(int)] = True, True
    lone = np.add.reduceat((kind == 6) & (blank[:-2] | begins) & (blank[2:] | ends), first, dtype=np.int64)
    own[:] = np.stack([
        np.minimum(1, 5 * kinds[:, 6] / solid), kinds[:, 6] > 0, np.minimum(1, 3 * lone / count), np.maximum(0, kinds[:, 2] / np.maximum(1, letters) - 0.2), kinds[:, 3] / solid, kinds[:, 5] / solid,
        letters == 0, np.minimum(1, 3 * again / count), np.where(count >= 8, np.maximum(0, 0.6 - distinct / count), 0), count == 1, solid / count > 30, [False, *map(eq, parts, parts[1:])],
    ], 1)
    own[start[:-1][start[:-1] < n], -1] = 0
    return Lines(own, length, start)


def features(of: Lines) -> np.ndarray:
    """Each line's own features, those of the line before and after in its text, whether it
    is the first or the last, and a constant."""
    n, k = of.own.shape
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    has = of.start[1:] > of.start[:-1]
    first[of.start[:-1][has]], last[of.start[1:][has] - 1] = True, True
    x = np.zeros((n, 3 * k + 3))
    x[:, :k] = of.own
    x[1:, k : 2 * k] = of.own[:-1]
    x[:-1, 2 * k : 3 * k] = of.own[1:]
    x[first, k : 2 * k] = 0
    x[last, 2 * k : 3 * k] = 0
    x[:, 3 * k], x[:, 3 * k + 1], x[:, 3 * k + 2] = first, last, 1
    return x


@dataclass
class Field:
    """Weights of features for bad against good, of each transition (from, to; 0 is good),
    the curve from a document's logit to its score, and the score without lines."""

    weight: np.ndarray
    move: np.ndarray
    slope: float = 1.0
    shift: float = 0.0
    bare: float = 0.5

    def marginals(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The chance of bad for each line, and for each line but a text's first the chances
        of the four (label before, label) pairs; x holds the lines of texts that begin at start."""
        n, u = len(x), x @ self.weight
        size = np.diff(start)
        node = np.stack([np.zeros(n), u], 1)
        fwd, bwd = node.copy(), np.zeros((n, 2))
        by = np.argsort(-size, kind="stable")
        begin, size = start[:-1][by], size[by]
        for t in range(1, int(size[0]) if len(size) else 0):
            # texts in order of falling length: those with a line t come first
            at = begin[: np.searchsorted(-size, -t, "left")] + t
            f = fwd[at - 1]
            fwd[at] = node[at] + np.logaddexp(f[:, :1] + self.move[0], f[:, 1:] + self.move[1])
        end = begin + size - 1
        for t in range(1, int(size[0]) if len(size) else 0):
            at = end[: np.searchsorted(-size, -t, "left")] - t
            b = bwd[at + 1] + node[at + 1]
            bwd[at] = np.logaddexp(b[:, :1] + self.move[:, 0], b[:, 1:] + self.move[:, 1])
        both = fwd + bwd
        whole = np.logaddexp(both[:, 0], both[:, 1])
        bad = np.exp(both[:, 1] - whole)
        pair = np.zeros((n, 2, 2))
        inner = np.ones(n, bool)
        inner[start[:-1][start[:-1] < n]] = False
        at = np.flatnonzero(inner)
        pair[at] = np.exp(fwd[at - 1][:, :, None] + self.move[None] + (node[at] + bwd[at])[:, None, :] - whole[at][:, None, None])
        return bad, pair

    def logits(self, of: Lines) -> np.ndarray:
        """Log-odds of the mean chance of good, weighted by length, of each text with lines;
        nan of one without."""
        bad, _ = self.marginals(features(of), of.start)
        text = np.repeat(np.arange(len(of.start) - 1), np.diff(of.start))
        n = len(of.start) - 1
        total = np.bincount(text, of.length, n)
        with np.errstate(invalid="ignore", divide="ignore"):
            q = np.clip(np.bincount(text, of.length * (1 - bad), n) / total, 1e-3, 1 - 1e-3)
            return np.where(total > 0, np.log(q / (1 - q)), np.nan)

    def scores(self, of: Lines) -> np.ndarray:
        z = self.logits(of)
        return np.where(np.isnan(z), self.bare, 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -35, 35))))


def _climb(x: np.ndarray, start: np.ndarray, y: np.ndarray, f: Field, rounds: int, rate: float, ridge: float) -> Field:
    """f after so many steps of AdaGrad up the likelihood of line labels y."""
    y = y.astype(int)
    seen = np.zeros((2, 2))
    inner = np.ones(len(x), bool)
    inner[start[:-1][start[:-1] < len(x)]] = False
    at = np.flatnonzero(inner)
    np.add.at(seen, (y[at - 1], y[at]), 1)
    n = max(1, len(x))
    gw, gm = np.full(len(f.weight), 1e-8), np.full((2, 2), 1e-8)
    for _ in range(rounds):
        bad, pair = f.marginals(x, start)
        d = x.T @ (y - bad) / n - ridge * f.weight
        m = (seen - pair.sum(0)) / n - ridge * f.move
        gw, gm = gw + d * d, gm + m * m
        f = Field(f.weight + rate * d / np.sqrt(gw), f.move + rate * m / np.sqrt(gm))
    return f


def fit(of: Lines, good: np.ndarray, *, passes: int = 3, rounds: int = 60, rate: float = 0.5, ridge: float = 1e-4) -> Field:
    """The field of labelled texts (good: 0 or 1 for each). With one class only the score is
    constant; without rows it is 0.5."""
    good = np.asarray(good, int)
    x = features(of)
    size = np.diff(of.start)
    text = np.repeat(np.arange(len(size)), size)
    f = Field(np.zeros(x.shape[1]), np.zeros((2, 2)))
    rate_good = (good.sum() + 0.5) / (len(good) + 1)
    if len(x):
        bad_text = good[text] == 0
        y = bad_text.astype(int)
        for _ in range(passes):
            f = _climb(x, of.start, y, Field(np.zeros(x.shape[1]), np.zeros((2, 2))), rounds, rate, ridge)
            bad, _ = f.marginals(x, of.start)
            worst = np.zeros(len(size))
            np.maximum.at(worst, text, bad)
            y = (bad_text & ((bad >= 0.5) | (bad == worst[text]))).astype(int)
    # the curve: logistic regression on one number, by Newton's method
    z = f.logits(of)
    ok = ~np.isnan(z)
    a, b = 1.0, 0.0
    t = good[ok] * (1 - 2e-3) + 1e-3
    design = np.stack([z[ok], np.ones(ok.sum())], 1)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(design @ [a, b], -35, 35)))
        g = design.T @ (t - p) - 1e-3 * np.array([a - 1, b])
        h = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        a, b = a + np.clip(step[0], -1, 1), b + np.clip(step[1], -1, 1)
    return Field(f.weight, f.move, max(0.0, float(a)), float(b), float(rate_good))


def trained(docs: DataFrame, labels: DataFrame, *, folds: int = 5, fit_rows: int = FIT_ROWS, fit_lines: int = FIT_LINES, **how) -> Field:
    """A field fitted on about fit_rows labelled documents of at most fit_lines lines, drawn
    by a hash of their id, none of the held-out fold (crc32 of the id modulo folds is 0). Rows
    of labels that share a doc_id count once, as bad if one says so; null labels don't count."""
    known = labels.where("doc_id is not null and quality is not null").where(crc_mod(F.col("doc_id"), folds) != 0)
    known = known.groupBy(F.col("doc_id").cast("long").alias("d")).agg((F.min("quality") > 0).cast("int").alias("good"))
    n = known.count()
    if n > fit_rows:
        known = known.where(F.pmod(F.xxhash64("d", F.lit("fit")), F.lit(1 << 30)) < int(fit_rows / n * (1 << 30)))
    # at most about fit_rows rows of 12 bytes
    rows = docs.select(F.col("doc_id").cast("long").alias("d"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), "d")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, good in zip(b.column("text"), b.column("good"), strict=True):
                of = lines([text.as_py() or ""])
                if len(of.length) <= fit_lines:
                    yield pa.RecordBatch.from_arrays([pa.array([good.as_py()], pa.int32()), pa.array([of.own.astype(np.float32).ravel()], pa.list_(pa.float32())), pa.array([of.length.astype(np.float32)], pa.list_(pa.float32()))], ["good", "own", "length"])

    got = rows.mapInArrow(lambda it: released(own(it)), "good int, own array<float>, length array<float>").toArrow().combine_chunks()
    length = [np.asarray(v.values) for v in got.column("length")]
    flat = [np.asarray(v.values) for v in got.column("own")]
    start = np.cumsum([0, *map(len, length)])
    of = Lines(np.concatenate([np.zeros(0), *flat]).reshape(-1, len(OWN)), np.concatenate([np.zeros(0), *length]), start)
    return fit(of, got.column("good").to_numpy() if got.num_rows else np.zeros(0), **how)


def scored(docs: DataFrame, field: Field, *, folds: int = 5, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text): all lines of
    the whole text count. A null, empty or blank text gets the share of good documents; a
    null doc_id is not held out; repeated rows get equal scores; an empty table gives no
    rows. Other columns are not read. A text is held a few times over while it is scored."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[np.ndarray] = []
            held: list[str] = []
            room = 0
            for t in b.column("text"):
                held.append(t.as_py() or "")
                room += len(held[-1])
                if room > 4 << 20:  # so much text at once, or one text
                    out.append(field.scores(lines(held)))
                    held, room = [], 0
            out.append(field.scores(lines(held)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.concatenate(out))], ["doc_id", "score"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(lambda it: released(score(it)), f"doc_id {kind}, score double")
    return out.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), folds) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
