"""Operators 11 to 13 against brute force."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import centroids, line_crf, spelling
from graphloom.llm.common import table

DOCS = "doc_id long, text string"
SF = "/root/testdata/sf0.001"


def _words(rows) -> Counter:
    out = Counter()
    low = str.maketrans(spelling.UPPER, spelling.LOWER)
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += len(run) >= 6
    return Counter({w: n for w, n in out.items() if n >= 5})


def _near(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _variants(rows) -> dict:
    words = _words(rows)
    near = {w: [v for v in words if _near(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v.encode()), default=None)
        form[w] = best if best and words[best] >= 5 * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None)
    return out


def _got(df) -> dict:
    rows = df.collect()
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_variants_of_small_words(spark):
    """All words of few letters, so that ties, chains and both kinds of edits abound."""
    rng = random.Random(3)
    rows = []
    for i in range(400):
        k = rng.choice([1, 1, 1, 5, 30, 160])
        word = "".join(rng.choice("abé") for _ in range(rng.choice([5, 6, 6, 7, 8])))
        rows.append((i, " ".join([word.upper() if i % 3 == 0 else word] * 5 * k)))
    rows += [(None, "aaaaaa " * 6), (7, None), (8, ""), (9, "12 _ --"), (3, rows[3][1]), (3, rows[3][1])]
    docs = spark.createDataFrame(rows, DOCS).withColumn("word", F.lit("x")).withColumn("key", F.lit(1)).withColumn("n", F.lit(2))
    want = _variants(rows)
    assert _got(spelling.variants(docs)) == want
    assert any(r[1] != r[0] and r[0] for r in want.values()), "a chain of two forms"


def test_damage_by_checksum(spark):
    rows = [(i, "Gemeinde gemeinde\nGEMEINDE") for i in range(8000)]
    want = _words(rows)
    assert len(want) > 1
    assert {r["word"]: r["n"] for r in spelling.vocabulary(spark.createDataFrame(rows, DOCS)).collect()} == dict(want)


def test_variants_of_words_as_long_as_texts(spark):
    """Deletions of long words are hashed; both sides of the bound meet."""
    rng = random.Random(5)
    base = "".join(rng.choice("ab") for _ in range(spelling.LONG))
    long = "".join(rng.choice("abc") for _ in range(30_000))
    words = [base, base + "a", base[:50] + base[51:], base[:-1] + "z", base + "ab", long, long[:9] + long[10:], long[:20_000] + "x" + long[20_001:], "a" * 100_000, "a" * 100_001]
    rows = [(i, " ".join([w] * (7 * 5 ** (j % 3)))) for i, (j, w) in enumerate(enumerate(words))]
    assert _got(spelling.variants(spark.createDataFrame(rows, DOCS), noise=10**12)) == _variants_undamaged(rows)


def _variants_undamaged(rows) -> dict:
    words = Counter(w for _, t in rows for w in t.split())
    near = {w: [v for v in words if spelling.one_edit(w, v)] for w in words}
    out = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        out[w] = (best if best and words[best] >= 5 * words[w] else None, len(near[w]))
    full = {}
    for w in words:
        root = w
        while out[root][0]:
            root = out[root][0]
        full[w] = (out[w][0], root, words[w], out[w][1], words[out[w][0]] if out[w][0] else None)
    return full


def test_one_edit_and_hashes():
    some = ["".join(p) for n in range(1, 5) for p in itertools.product("ab", repeat=n)]
    for a, b in itertools.product(some, some):
        assert spelling.one_edit(a, b) == _near(a, b)
    for w in [*some, "résumé" * 7, "a" * 50]:
        keys = {tuple(r) for r in spelling.deletion_hashes(w).tolist()}
        assert len(keys) == 1 + len({w[:i] + w[i + 1 :] for i in range(len(w))})
        for i in range(len(w)):
            if len(w) > 1:  # the hash of a shorter word is the hash of the deletion
                assert tuple(spelling.deletion_hashes(w[:i] + w[i + 1 :])[0].tolist()) in keys


def test_variants_of_nothing(spark):
    assert spelling.variants(spark.createDataFrame([], DOCS)).collect() == []


# clusters

VECTORS = "vec_id long, embedding array<float>"


def _clusters(rows, k=40, rounds=5):
    kept = []
    for vec_id, e in rows:
        if e is not None and len(e) == 64 and all(x is not None and np.isfinite(x) for x in e):
            kept.append((vec_id, [min(1 << 27, max(-(1 << 27), int(np.floor(256 * float(np.float32(x)))))) for x in e]))
    cents = [x for _, x in sorted(kept, key=lambda r: (hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(cents)) for _, x in kept]

    for _ in range(rounds):
        at = assign()
        for j in range(len(cents)):
            mine = [x for (_, x), (_, c) in zip(kept, at, strict=True) if c == j]
            if mine:
                cents[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    at = assign()
    inertia = Counter()
    for d, c in at:
        inertia[c] += d
    return sorted((-1 if i is None else i, c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest()) for (i, _), (d, c) in zip(kept, at, strict=True))


def _rows(df):
    return sorted((-1 if r["vec_id"] is None else r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in df.collect())


def test_clusters_with_bad_vectors_ties_and_repeats(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 0.3, 64).astype(np.float32).tolist()) for i in range(150)]
    rows += [(i, np.round(rng.normal(0, 0.004, 64), 2).astype(np.float32).tolist()) for i in range(150, 200)]  # integers that tie
    rows += [(5, rows[5][1]), (5, rows[5][1]), (6, rows[9][1]), (None, rows[7][1])]
    rows += [(300, None), (301, []), (302, [0.5] * 63), (303, [0.5] * 65), (304, [None] + [0.5] * 63), (305, [float("nan")] * 64), (306, [float("inf")] + [0.1] * 63), (307, [3e38] * 64), (308, [-3e38] * 64), (309, [0.0] * 64)]
    df = spark.createDataFrame(rows, VECTORS).withColumn("cluster", F.lit(1)).withColumn("x", F.lit("y"))
    assert _rows(centroids.clustered(df)) == _clusters(rows)


def test_few_vectors_and_none(spark):
    rows = [(i, [i / 7.0] * 64) for i in range(9)]
    assert _rows(centroids.clustered(spark.createDataFrame(rows, VECTORS))) == _clusters(rows)
    assert centroids.clustered(spark.createDataFrame([(1, None)], VECTORS)).collect() == []
    assert centroids.clustered(spark.createDataFrame([], VECTORS)).collect() == []


def test_partial_search_is_exact_and_abandons():
    rng = np.random.default_rng(1)
    rows = rng.integers(-400, 400, (40, 64)) * np.where(np.arange(64) % 4 == 0, 5, 1)
    x = rows[rng.integers(0, 40, 3000)] + rng.integers(-60, 60, (3000, 64))
    c = centroids.Centroids(rows, centroids._order(rows))
    at, best, done = centroids.nearest(x, c)
    whole = ((x[:, None] - rows[None]) ** 2).sum(2)
    assert (at == whole.argmin(1)).all() and (best == whole.min(1)).all()
    assert done < 0.4 * x.size * 40


# lines

def test_marginals_by_enumeration():
    rng = np.random.default_rng(2)
    sizes = [1, 4, 0, 2, 5, 1, 0]
    start = np.cumsum([0, *sizes])
    x = rng.normal(0, 1, (start[-1], 3))
    f = line_crf.Field(rng.normal(0, 1, 3), rng.normal(0, 1, (2, 2)))
    bad, pair = f.marginals(x, start)
    for a, b in zip(start, start[1:], strict=False):
        ways = list(itertools.product((0, 1), repeat=b - a))
        weight = np.array([np.exp(sum(f.weight @ x[a + i] for i in range(b - a) if w[i]) + sum(f.move[p, q] for p, q in zip(w, w[1:], strict=False))) for w in ways])
        for i in range(b - a):
            assert bad[a + i] == pytest.approx(sum(w for w, y in zip(weight, ways, strict=True) if y[i]) / weight.sum())
            for p, q in itertools.product((0, 1), (0, 1)) if i else ():
                assert pair[a + i, p, q] == pytest.approx(sum(w for w, y in zip(weight, ways, strict=True) if (y[i - 1], y[i]) == (p, q)) / weight.sum())


def test_features_see_neighbours_of_the_same_text():
    of = line_crf.lines(["one two\n$$$ $$$\nthree", "", "$ a", "x\nx\n \ny"])
    assert of.start.tolist() == [0, 3, 3, 4, 7]
    k = len(line_crf.OWN)
    x = line_crf.features(of)
    symbol = line_crf.OWN.index("any symbol")
    assert of.own[:, symbol].tolist() == [0, 1, 0, 1, 0, 0, 0]
    assert x[:, k + symbol].tolist() == [0, 0, 1, 0, 0, 0, 0] and x[:, 2 * k + symbol].tolist() == [1, 0, 0, 0, 0, 0, 0]
    assert of.own[:, line_crf.OWN.index("same as before")].tolist() == [0, 0, 0, 0, 0, 1, 0]
    assert of.own[:, line_crf.OWN.index("lone symbols")].tolist() == [0, 0, 0, 1, 0, 0, 0]


def test_held_out_accuracy(spark):
    """Half the bad documents of the held-out fold at least, and nearly all good ones, judged right."""
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    got = line_crf.scored(docs, line_crf.trained(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    good = [r["predicted"] for r in got if r["quality"] == 1]
    bad = [r["predicted"] for r in got if r["quality"] == 0]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.25
    assert all((r["score"] >= 0.3) == bool(r["predicted"]) and 0 <= r["score"] <= 1 for r in got)


def test_quality_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, "abc def"), (4, "word " * 300_000), (5, "a\n" * 50_000), (6, "x"), (6, "x"), (7, "😀 naïve".encode("utf-16", "surrogatepass").decode("utf-16"))]
    docs = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit(1)).withColumn("quality", F.lit(1))
    labels = spark.createDataFrame([(4, 0), (5, 0), (6, 1), (6, None), (None, 1), (1, 1)], "doc_id long, quality int")
    got = line_crf.scored(docs, line_crf.trained(docs, labels)).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    bare = {r["score"] for r in got if r["doc_id"] in (1, 2, 3)}
    assert len(bare) == 1 and len({r["score"] for r in got if r["doc_id"] == 6}) == 1
    assert not [r for r in got if r["doc_id"] is None][0]["held_out"]


def test_quality_without_labels_or_rows(spark):
    docs, none = spark.createDataFrame([(1, "a b")], DOCS), spark.createDataFrame([], "doc_id long, quality int")
    assert 0 <= line_crf.scored(docs, line_crf.trained(docs, none)).collect()[0]["score"] <= 1
    assert line_crf.scored(spark.createDataFrame([], DOCS), line_crf.trained(docs, none)).collect() == []
