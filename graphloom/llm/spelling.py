"""Spelling variants: a symmetric-delete join of the vocabulary with itself.

Every word of the vocabulary emits itself and its distinct single deletions as keys; words
that share a key are at most two edits apart, and the exact distance decides. Two words one
edit apart share exactly one key (the shorter word, or the deletion at the place replaced),
so that the join gives each pair once. At most (length + 1) times the number of letters
words can emit a key, whatever the input: no key is hot.

Words longer than LONG would emit the square of their length in characters. They emit two
31-bit polynomial hashes of each deletion instead, computed from prefix hashes, with the
word's digest in its place; texts meet only to be verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, written

RUN = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LONG = 200
_P = (1 << 31) - 1
_BASES = (1_000_003, 69_069)


def vocabulary(docs: DataFrame, *, least_length: int = 6, least_count: int = 5, noise: int = 199) -> DataFrame:
    """(word, n) of the texts' letter runs in lower case (A to Z only), some of them damaged:
    where noise divides the crc32 of `<doc_id>:<run>`, the run loses one code point.
    Counted in the map tasks first, so that a frequent word is no burden to any task."""
    text = F.translate(F.col("text").cast("string"), UPPER, LOWER)
    # shorter runs can't become words; deletion never makes one longer
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode(F.regexp_extract_all(text, F.lit(f"{RUN}{{{least_length},}}"), F.lit(0))).alias("run"))
    h = F.crc32(F.concat("d", F.lit(":"), F.col("run")))
    at = (h % F.length("run")).cast("int")
    damaged = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(h % noise == 0, damaged).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def deletions(word: Column) -> Column:
    """The distinct strings with one code point less: of equal neighbours the first goes."""
    places = F.filter(F.sequence(F.lit(1), F.length(word)), lambda i: (i == 1) | (F.substring(word, i, F.lit(1)) != F.substring(word, i - 1, F.lit(1))))
    return F.transform(places, lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))


def _short_pairs(vocab: DataFrame) -> DataFrame:
    keys = vocab.where(F.length("word") <= LONG).select("word", "n", F.explode(F.concat(F.array("word"), deletions(F.col("word")))).alias("key"))
    other = keys.select("key", F.col("word").alias("near"), F.col("n").alias("m"))
    return keys.join(other, "key").where((F.col("word") != F.col("near")) & (F.levenshtein("word", "near", 1) == 1)).select("word", "near", "m")


def _prefix_hashes(codes: np.ndarray, base: int) -> np.ndarray:
    """h[i] of the first i codes: h[i + 1] = h[i] * base + codes[i], modulo 2^31 - 1; by
    doubling, so that only the number of doublings is a loop."""
    n = 1 << max(1, len(codes)).bit_length()
    h = np.zeros(n, np.int64)
    h[: len(codes)] = codes + 1
    power, step = base, 1
    while step < n:  # h[i] becomes the hash of the 2 * step codes that end at i
        h[step:] = (h[step:] + h[:-step] * power) % _P
        power, step = power * power % _P, step * 2
    return np.concatenate([[0], h[: len(codes)]])


def _powers(n: int, base: int) -> np.ndarray:
    out, have = np.ones(n, np.int64), 1
    while have < n:
        take = min(have, n - have)
        out[have : have + take] = out[:take] * (int(out[have - 1]) * base % _P) % _P
        have += take
    return out


def deletion_hashes(word: str) -> np.ndarray:
    """Hashes of a word and of its distinct single deletions (one row each, two numbers)."""
    codes = np.frombuffer(word.encode("utf-32-le"), dtype="<u4").astype(np.int64)
    n = len(codes)
    at = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    out = []
    for base in _BASES:
        pre, power = _prefix_hashes(codes, base), _powers(n + 1, base)
        tail = (pre[n] - pre[at + 1] * power[n - 1 - at]) % _P
        out.append(np.concatenate([pre[n:], (pre[at] * power[n - 1 - at] + tail) % _P]))
    return np.stack(out, 1)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for word, digest in zip(b.column("word"), b.column("id"), strict=True):
            h = deletion_hashes(word.as_py())
            key = h[:, 0] << 31 | h[:, 1]
            for lo in range(0, len(key), 1 << 16):
                part = pa.array(key[lo : lo + (1 << 16)])
                yield pa.RecordBatch.from_arrays([part, pa.array([digest.as_py()] * len(part))], ["key", "id"])


def _long_pairs(vocab: DataFrame) -> DataFrame:
    """Pairs of which one word at least is longer than LONG."""
    words = vocab.where(F.length("word") >= LONG).withColumn("id", F.sha2("word", 256))
    keys = words.select("word", "id").mapInArrow(_hashed, "key long, id string")
    ids = keys.join(keys.select("key", F.col("id").alias("other")), "key").where("id <> other").select("id", "other").distinct()
    both = ids.join(words.select("id", "word"), "id").join(words.select(F.col("id").alias("other"), F.col("word").alias("near"), F.col("n").alias("m")), "other")
    longer = (F.length("word") > LONG) | (F.length("near") > LONG)
    # one edit: what is left between the common beginning and the common end
    return both.where(longer).select("word", "near", "m").mapInArrow(_one_edit, "word string, near string, m long")


def one_edit(a: str, b: str) -> bool:
    """Exactly one code point inserted, deleted or replaced; in time of their length."""
    x, y = (np.frombuffer(s.encode("utf-32-le"), dtype="<u4") for s in sorted((a, b), key=len))
    if len(y) - len(x) > 1 or a == b:
        return False
    differ = x != y[: len(x)]
    first = int(differ.argmax()) if differ.any() else len(x)
    return bool(np.array_equal(x[first:], y[first + 1 :]) if len(x) < len(y) else np.array_equal(x[first + 1 :], y[first + 1 :]))


def _one_edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield b.filter(pa.array([one_edit(x.as_py(), y.as_py()) for x, y in zip(b.column("word"), b.column("near"), strict=True)], pa.bool_()))


def near_pairs(vocab: DataFrame) -> DataFrame:
    """(word, near, m): every ordered pair of words exactly one edit apart, m the count of near."""
    return _short_pairs(vocab).unionByName(_long_pairs(vocab))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): from word along forms (word, form) to the last one, by doubling: a round
    takes every word twice as far, so that rounds are few. Forms must have no cycle."""
    at = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        up = at.select(F.col("word").alias("root"), F.col("root").alias("up"))
        step = at.join(up, "root", "left").select("word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved"))
        new = written(step, "roots")
        discard(at)
        at = new.drop("moved")
        at._scratch = new._scratch
        if new.where("moved").isEmpty():
            return at


def variants(docs: DataFrame, *, ratio: int = 5, **words) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of the vocabulary of docs (doc_id,
    text). A word's form is its most frequent near word (ties: the least in code-point
    order) if that occurs at least ratio times as often; its root is the last form.

    Null and empty texts have no words; a null doc_id counts as an empty one; rows that
    repeat are counted each time; an empty table gives no rows; other columns are not read.
    A word may be as long as a text. Forms grow by the ratio at each step, so they make no
    cycle."""
    vocab = written(vocabulary(docs.select("doc_id", "text"), **words), "vocabulary")
    best = near_pairs(vocab).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("near").alias("near"))).alias("best"))
    got = vocab.join(best, "word", "left").withColumn("form_n", -F.col("best.m"))
    ok = F.col("form_n") >= ratio * F.col("n")
    got = got.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(ok, F.col("best.near")).alias("form"), F.when(ok, F.col("form_n")).alias("form_n"))
    got = written(got, "forms")
    discard(vocab)
    ends = roots(got.where("form is not null"))
    return got.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
