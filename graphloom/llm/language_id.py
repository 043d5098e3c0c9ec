"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram's vector binds those of its
letters by elementwise product, each permuted by its place; a text bundles the vectors of
its trigrams by their sum. A language's prototype bundles texts of that language, each
scaled to one; a text gets the language whose prototype has the largest cosine.
Words count with a mark before and after; the marks and the 26 plain letters have vectors
of their own, all other letters share 37 by a hash of their code point.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, released, written

SYMBOLS = 64
DIMENSIONS = 512
FIT_ROWS = 3_000
"""Documents of each language (about so many at most) that its prototype bundles."""
MOST_LANGS = 10_000
"""Most languages of a model (40 MB of prototypes)."""
UNKNOWN = "und"
_CHARS = 600_000
_COUNTS = 2_000_000
"""Most counts (texts by distinct trigrams, 12 bytes each) that are held at once."""


@cache
def _symbols() -> np.ndarray:
    """Symbol by code point: 0 for what is no letter."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            out[c] = c - 96 if 97 <= c <= 122 else 27 + (c * 40503 >> 4) % (SYMBOLS - 27)
    return out


@cache
def _letters(dimensions: int) -> list[np.ndarray]:
    """The letters' vectors as permuted at each place of a trigram."""
    rng = np.random.default_rng(20)
    base = rng.choice(np.array([-1, 1], np.int8), (SYMBOLS, dimensions))
    turn = rng.permutation(dimensions)
    return [base, base[:, turn], base[:, turn[turn]]]


def trigrams(text: str | None) -> np.ndarray:
    """The whole text's trigrams as numbers below SYMBOLS ** 3; none without a letter."""
    codes = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    s = _symbols()[codes]
    keep = s > 0
    keep[1:] |= s[:-1] > 0
    keep[0] = True
    s = s[keep].astype(np.int32)
    if len(s) < 3:
        return np.empty(0, np.int32)
    return (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]


def profiles(texts: list[str | None], dimensions: int = DIMENSIONS) -> np.ndarray:
    """The bundled vector of each text, divided by its number of trigrams. Very long texts
    count whole; only their distinct trigrams (at most SYMBOLS ** 3) are held as counts."""
    return _bundled([trigrams(t) for t in texts], dimensions)


def _bundled(grams: list[np.ndarray], dimensions: int) -> np.ndarray:
    size = np.array([len(g) for g in grams])
    flat = np.concatenate(grams) if grams else np.empty(0, np.int32)
    used = np.zeros(SYMBOLS**3, bool)
    used[flat] = True
    names = np.flatnonzero(used)
    if len(grams) > 1 and len(grams) * len(names) > _COUNTS:  # texts of little in common: half of them at a time
        return np.concatenate([_bundled(grams[: len(grams) // 2], dimensions), _bundled(grams[len(grams) // 2 :], dimensions)])
    at = np.zeros(SYMBOLS**3, np.int64)
    at[names] = np.arange(len(names))
    counts = np.bincount(np.repeat(np.arange(len(grams)), size) * len(names) + at[flat], minlength=len(grams) * len(names)).reshape(len(grams), -1) if len(names) else np.zeros((len(grams), 0))
    x, y, z = _letters(dimensions)
    bound = x[names // SYMBOLS**2] * y[names // SYMBOLS % SYMBOLS] * z[names % SYMBOLS]
    return counts.astype(np.float32) @ bound.astype(np.float32) / np.maximum(1, size)[:, None].astype(np.float32)


def _blocks(texts: list[str | None]) -> Iterator[slice]:
    lo, chars = 0, 0
    for i, t in enumerate(texts):
        chars += len(t or "")
        if chars > _CHARS or i - lo >= 256:
            yield slice(lo, i + 1)
            lo, chars = i + 1, 0
    if lo < len(texts):
        yield slice(lo, len(texts))


@dataclass
class Prototypes:
    langs: list[str]
    vectors: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine (0 if negative) and number of trigrams of each text."""
        names: list[str] = []
        score, size = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for part in _blocks(texts):
            grams = [trigrams(t) for t in texts[part]]
            size[part] = [len(g) for g in grams]
            p = _bundled(grams, self.vectors.shape[1] if self.langs else DIMENSIONS).astype(float)
            norm = np.sqrt((p * p).sum(axis=1))
            if not self.langs:
                names += [UNKNOWN] * len(p)
                continue
            cos = p @ self.vectors.T / np.maximum(norm, 1e-30)[:, None]
            best = cos.argmax(axis=1)
            names += [self.langs[k] if x > 0 else UNKNOWN for k, x in zip(best, norm, strict=True)]
            score[part] = np.where(norm > 0, np.clip(cos[np.arange(len(best)), best], 0, 1), 0)
        return names, score, size


def _bundles(batches: Iterator[pa.RecordBatch], dimensions: int) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for b in batches:
        texts, langs = b.column("text").to_pylist(), b.column("lang").to_pylist()
        for part in _blocks(texts):
            p = profiles(texts[part], dimensions).astype(float)
            norm = np.sqrt((p * p).sum(axis=1))
            p /= np.maximum(norm, 1e-30)[:, None]
            for lang, v in zip(langs[part], p, strict=True):
                sums[lang] = sums.get(lang, 0) + v
    for lang, v in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * dimensions), pa.array(np.arange(dimensions, dtype=np.int32)), pa.array(v)], ["lang", "i", "v"])


def trained(docs: DataFrame, *, folds: int = 4, held: int = 2, fit_rows: int = FIT_ROWS, dimensions: int = DIMENSIONS) -> Prototypes:
    """Prototypes of the languages of docs (doc_id, text, lang) outside the held-out fold
    (crc32 of the id modulo folds is held). Of a language with more than fit_rows
    documents, about so many are bundled, drawn by a hash of the id. Rows without lang or
    doc_id teach nothing; languages whose texts have no letter are not learned. A
    language brings `dimensions` numbers to the driver, whatever the number of rows, and
    every worker holds all prototypes: more than MOST_LANGS languages are an error."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    d = d.where("lang is not null and doc_id is not null and text is not null").where(crc_mod(F.col("doc_id"), folds) != held)
    n = written(d.groupBy("lang").agg(F.count("*").alias("n")), "langs")
    if n.limit(MOST_LANGS + 1).count() > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    draw = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 30))
    part = d.join(F.broadcast(n), "lang").where(draw * F.col("n") < F.lit(fit_rows * (1 << 30)))
    sums = part.select("lang", "text").mapInArrow(lambda it: released(_bundles(it, dimensions)), "lang string, i int, v double")
    got = sums.groupBy("lang", "i").agg(F.sum("v").alias("v")).orderBy("lang", "i").toArrow()
    v = got.column("v").to_numpy().reshape(-1, dimensions)
    langs = got.column("lang").to_pylist()[::dimensions]
    norm = np.sqrt((v * v).sum(axis=1))
    ok = norm > 0
    return Prototypes([x for x, y in zip(langs, ok, strict=True) if y], v[ok] / norm[ok][:, None])


def predicted(docs: DataFrame, prototypes: Prototypes, *, folds: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs (doc_id, text): the whole
    text counts. Texts that are null or have no letter get und and 0, a null doc_id is
    not held out. Other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, score, _ = prototypes.predict(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(names, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(lambda it: released(run(it)), f"doc_id {kind}, lang_pred string, score double")
    return out.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"), "lang_pred", "score")


def recognised(docs: DataFrame, prototypes: Prototypes, *, noise: float = 3.0, evidence: int = 50) -> DataFrame:
    """The rows of docs, with all their columns, whose text is in one of the languages.

    Cosines of unrelated bundles scatter by 1 / sqrt(dimensions): a text is in no learned
    language if it has no letter, or at least `evidence` trigrams and no cosine of `noise`
    times that. Shorter texts are too short to tell and stay. Null texts go."""
    rows = docs.withColumn("text", F.col("text").cast("string"))
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    least = noise / np.sqrt(prototypes.vectors.shape[1]) if prototypes.langs else 1.0

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score, size = prototypes.predict(b.column("text").to_pylist())
            yield b.filter(pa.array((np.array(lang, object) != UNKNOWN) & ((score >= least) | (size < evidence))))

    return rows.mapInArrow(lambda it: released(keep(it)), names)
