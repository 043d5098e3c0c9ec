import random
import time

import numpy as np

from graphloom.llm import minhash_dedup
from graphloom.llm.minhash_dedup import deduplicated, near_duplicates

SCHEMA = "doc_id long, text string, lang string, label string"


def shingles(text, width):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").split(" ")
    w = [x for x in w if x]
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(rows, width):
    sets = [(i, shingles(t, width)) for i, t in rows if i is not None]
    up = {i: i for i, _ in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, x in sets:
        for b, y in sets:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((top(a), top(b)))
                up[q] = p
    return {i: top(i) for i, _ in sets}


def corpus(seed, n):
    r = random.Random(seed)
    words = ["w%d" % i for i in range(400)]
    passage = [r.choice(words) for _ in range(60)]
    rows = []
    for i in range(n):
        t = [r.choice(words) for _ in range(r.choice([1, 3, 8, 40, 90]))]
        if i % 3 == 0:
            t += passage
        rows.append((i, " ".join(t)))
    base = [r.choice(words) for _ in range(80)]
    for i in range(n, 3 * n):  # one large group of near copies, edited more or less
        t = list(base)
        for _ in range(r.randrange(6)):
            t[r.randrange(len(t))] = r.choice(words)
        rows.append((i, " ".join(t)))
    rows += [(3 * n + i, rows[i][1].upper()) for i in range(0, n, 5)]
    r.shuffle(rows)
    return rows


def test_equals_brute_force(spark):
    rows = corpus(1, 150)
    df = spark.createDataFrame([(i, t, "en", "x") for i, t in rows], SCHEMA)
    for how in ({}, {"small": 8, "block": 16, "depth": 2}):
        got = {r.doc_id: r for r in near_duplicates(df, width=4, **how).collect()}
        want = brute(rows, 4)
        assert {i: r.component_id for i, r in got.items()} == want
        assert all(r.kept == (r.component_id == i) for i, r in got.items())
        assert all(r.n_shingles == len(shingles(dict(rows)[i], 4)) for i, r in got.items())


def test_nulls_ties_empty(spark):
    rows = [(1, None, None, None), (2, "", "a", None), (3, " \n\t ", "a", None), (4, "One two", None, "x"), (9, "one TWO", None, "x"), (None, "one two", None, None), (5, "a b c d", "x", ""), (5, "z y x w v", "x", ""), (6, "z y x w v", None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, width=4).collect())
    assert got == [("1", 0, 1, True), ("2", 0, 2, True), ("3", 0, 3, True), ("4", 1, 4, True), ("5", 1, 5, True), ("5", 2, 5, True), ("6", 2, 5, False), ("9", 1, 4, False), ("None", 1, None, True)]
    kept = deduplicated(df, width=4)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "5", "None"]
    assert near_duplicates(df.limit(0)).count() == 0


def test_prefixes_lose_no_pair():
    r = np.random.default_rng(3)
    pool = r.integers(0, 1 << 63, 6000).astype(np.uint64) * np.uint64(2)
    sets = []
    for n in (1, 2, 4, 5, 9, 60, 300, 2000):
        base = r.choice(pool, n, replace=False)
        for cut in (0, n // 10, n // 5, n // 2):
            sets.append(np.unique(np.concatenate([base[: n - cut], r.choice(pool, cut // 3 + 1)])))
    for percent in (50, 80, 95, 100):
        want = {(i, j) for i in range(len(sets)) for j in range(i) if minhash_dedup._linked(sets[i], sets[j], percent)}
        found = {(max(i, j), min(i, j)) for i, near in minhash_dedup.prefix_pairs(sets, percent) for j in near.tolist()}
        assert want <= found and len(found) < len(sets) ** 2 / 4
        assert percent != 80 or len(want) > 5


def _template(r, n, own=60, shared=300):
    base = [f"b{k}" for k in range(shared)]
    return [(i, " ".join([*base, *(f"w{r.randrange(10**9)}" for _ in range(own))])) for i in range(n)]


def test_pages_of_a_template_cost_no_pairs(spark):
    """2,000 documents alike at 0.7: no link, and no comparison of all pairs in each tree."""
    rows = _template(random.Random(8), 2000)
    rows += [(5000 + i, t) for i, t in rows[:20]] + [(6000, rows[0][1] + " one more"), (6001, rows[1][1].replace("b0 ", ""))]
    df = spark.createDataFrame([(i, t, "en", "x") for i, t in rows], SCHEMA)
    began = time.time()
    got = {x.doc_id: x.component_id for x in near_duplicates(df, width=4).collect()}
    assert time.time() - began < 90
    assert got == {**{i: i for i in range(2000)}, **{5000 + i: i for i in range(20)}, 6000: 0, 6001: 1}


def test_small_sets(spark):
    r = random.Random(4)
    rows = []
    for i in range(0, 3000, 2):  # pairs at a similarity of exactly 0.8: 4 and 5 shingles
        t = [f"w{r.randrange(10**9)}" for _ in range(8)]
        rows += [(i, " ".join(t)), (i + 1, " ".join(t[:7]))]
    got = near_duplicates(spark.createDataFrame([(i, t, "en", "x") for i, t in rows], SCHEMA), width=4).collect()
    assert all(x.component_id == x.doc_id // 2 * 2 for x in got) and len(got) == 3000


def test_long_texts_and_a_frequent_passage(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "NODE_SHINGLES", 3000)
    r = random.Random(5)
    passage = [f"p{k}" for k in range(120)]
    rows = [(i, " ".join([*passage, *(f"w{r.randrange(10**6)}" for _ in range(r.choice([4, 20, 60, 3000])))])) for i in range(120)]
    df = spark.createDataFrame([(i, t, "en", "x") for i, t in rows], SCHEMA)
    got = {x.doc_id: x.component_id for x in near_duplicates(df, width=4).collect()}
    assert got == brute(rows, 4)


def test_trees_are_enough():
    assert minhash_dedup._miss([3] * 18, 80) <= minhash_dedup.MISS < minhash_dedup._miss([3] * 17, 80)


def test_alike_below_the_threshold(spark):
    r = random.Random(2)
    base = [f"b{k}" for k in range(400)]
    rows = [(i, " ".join([*base, *(f"w{r.randrange(10**6)}" for _ in range(200))])) for i in range(60)]
    df = spark.createDataFrame([(i, t, "en", "x") for i, t in rows], SCHEMA)
    assert all(x.kept for x in near_duplicates(df, width=4, small=4, block=16).collect())
