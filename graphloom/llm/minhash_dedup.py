"""Near duplicates by a chosen-path set similarity join.

A document's set holds its distinct word shingles. Equal sets are folded first,
so that any number of copies counts as one member. Each set gets a signature of 64
minwise tokens, each under a permutation of its own. In each of several independent trees
a document walks down from the root: a node chooses one or two signature positions from
its own id, and the minwise tokens there name the children. Nodes of at most `small`
members are compared exhaustively; larger ones branch further, down to `depth` levels.
What is still large then (copies that stay alike all the way) is compared in blocks that
share a pivot; if that leaves members apart, these are compared with all that the wide
nodes hold. So no pair of a node is skipped but pairs that are linked already.

A comparison has two steps. First the members of a node bring one byte of each of their 64
tokens: only members with a partner of fitting size and another class that agrees in AGREE
of them go on. These are compared on the full sets, made anew from their texts: of each
set the shingles rarest in the node are looked up (two linked sets share one among them),
and every pair that shares one is measured. So pairs that are alike below the threshold
cost little, however many they are.

Members of nodes that stay wide and apart to the end are compared once, for all trees
together, in the same way with Spark's joins: by their rarest shingles among such members.
A shingle many have in common is split into blocks.

Texts are shuffled once, into buckets by doc_id; every later join that fetches some of
them moves only the ids.

Chance of missing a link of similarity 0.8: each of the 64 tokens agrees with probability
0.8, and all trees share them. If a share s agrees, a level keeps the pair together with
probability 0.75 s + 0.25 (1 - (1 - s)^2); below AGREE tokens the pair counts as missed.
Taken over s, as many trees are grown as keep the chance below 1e-5 even for pairs that
walk down all `depth` levels: 18 for three. The number doesn't depend on the data, so that
work grows with the rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.community import components

from .common import bucketed, discard, released, written

POSITIONS = 64
"""Length of the minwise signature."""
MISS = 1e-5
"""Chance at most of missing a pair at the threshold."""
AGREE = 34
"""Tokens of 64 in which members agree that are compared on their full sets; linked ones agree in fewer with a chance of 3.3e-7."""
NODE_SHINGLES = 1_000_000
"""Most shingles (of some 60 bytes, sorted and counted) of the members that one task compares at once."""

_MUL = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.random.default_rng(9).integers(0, 1 << 63, 257).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _LETTER = _LETTER[256], _LETTER[:256] ^ (_LETTER[:256] >> np.uint64(32))
_LETTER[65:91] = _LETTER[97:123]
_BLOCK = 1 << 18
"""Bytes of text that are hashed at once (about 40 bytes of memory each)."""


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers up to n and their inverses, modulo 2^64."""
    each = np.ones((2, n), np.uint64)
    each[:, 1:] = np.array([[_BASE], [np.uint64(pow(int(_BASE), -1, 1 << 64))]], np.uint64)
    return tuple(np.multiply.accumulate(each, axis=1))


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of data, A-Z lower-cased, and where they start: a word's
    polynomial in its letters is a difference of prefix sums."""
    x = np.frombuffer(data, np.uint8)
    n = len(x)
    gap = np.ones(n + 2, bool)
    gap[1:-1] = _GAP[x]
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    powers, inverse = _powers(max(_BLOCK, 1 << n.bit_length()))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_LETTER[x] * powers[:n], out=sums[1:])
    lo, hi = edge[::2], edge[1::2]
    return _mix((sums[hi] - sums[lo]) * inverse[lo]), lo


def _blocks(texts: list[bytes | None]) -> Iterator[tuple[bytes, list[int]]]:
    """Blocks of texts: bytes with a space after each text, and where its texts end. A text
    beyond _BLOCK comes in pieces, cut at white space; all but the last have no end."""
    held: list[bytes] = []
    size = 0
    for t in texts:
        t = t or b""
        if held and size + len(t) > _BLOCK:
            yield b" ".join([*held, b""]), np.cumsum([len(x) + 1 for x in held]).tolist()
            held, size = [], 0
        lo = 0
        while len(t) - lo > _BLOCK and (cut := _SPACE.search(t, lo + _BLOCK)):
            yield t[lo : cut.start()], []
            lo = cut.start()
        held.append(t[lo:])
        size += len(t) - lo + 1
    if held:
        yield b" ".join([*held, b""]), np.cumsum([len(x) + 1 for x in held]).tolist()


def shingle_sets(texts: list[bytes | None], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word shingles of each whole text (UTF-8).

    A-Z are lower-cased; words are separated by ASCII white space. A text of fewer
    words than width is one shingle; one without words has none.
    """
    out: list[np.ndarray] = []
    early: list[np.ndarray] = []  # words of the pieces of a long text
    for data, ends in _blocks(texts):
        h, starts = _word_hashes(data)
        if not ends:
            early.append(h)
            continue
        lo = 0
        counts = np.diff(np.searchsorted(starts, ends), prepend=0).tolist()
        if early:
            counts[0] += sum(map(len, early))
            h = np.concatenate([*early, h])
            early = []
        rolled = _rolled(h, width, 0) if len(h) >= width else h
        for k in counts:
            s = np.sort(rolled[lo : lo + k - width + 1]) if k >= width else _rolled(h[lo : lo + k], k, k) if k else np.empty(0, np.uint64)
            if len(s) > 1:
                new = np.empty(len(s), bool)
                new[0] = True
                np.not_equal(s[1:], s[:-1], out=new[1:])
                s = s[new]
            out.append(s)
            lo += k
    return out


def _rolled(h: np.ndarray, width: int, start: int) -> np.ndarray:
    """A hash of every width consecutive elements of h."""
    m = len(h) - width + 1
    out = np.full(m, start, np.uint64)
    for i in range(width):
        out = _mix(out * np.uint64(0x2545F4914F6CDD1D) + h[i : m + i] * _MUL[i % 4])
    return out


_TURN = np.random.default_rng(7).integers(0, 1 << 32, (2, POSITIONS, 1), dtype=np.uint32)
_TURN[1] |= np.uint32(1)


def signature(h: np.ndarray) -> np.ndarray:
    """Minwise tokens of a set that isn't empty, 32 bits of an element each: position i
    holds the element least under permutation i, which takes the upper half of an element
    by an exclusive or and a product with an odd number."""
    upper, token = (h >> np.uint64(32)).astype(np.uint32), h.astype("<u4")
    for lo in range(0, len(h), 4096):
        turned = (upper[lo : lo + 4096] ^ _TURN[0]) * _TURN[1]
        at = turned.argmin(axis=1)
        value = np.take_along_axis(turned, at[:, None], 1)[:, 0]
        if lo:
            out = np.where(value < least, token[lo + at], out)
            least = np.minimum(value, least)
        else:
            least, out = value, token[at]
    return out


def _sketches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 64):
            b = whole.slice(at, 64)
            n, lo, hi, sig, brief = [], [], [], [], []
            for h in shingle_sets(b.column("text").cast(pa.binary()).to_pylist(), width):
                n.append(len(h))
                if len(h):
                    d = xxhash.xxh3_128_intdigest(h.tobytes())
                    lo.append((d & (2**64 - 1)) - 2**63)
                    hi.append((d >> 64) - 2**63)
                    tokens = signature(h)
                    sig.append(tokens.tobytes())
                    brief.append(tokens.astype(np.uint8).tobytes())
                else:
                    for c in (lo, hi, sig, brief):
                        c.append(None)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.array(sig, pa.binary()), pa.array(brief, pa.binary())],
                ["doc_id", "n_shingles", "lo", "hi", "sig", "brief"],
            )


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, lo, hi (128-bit name of the set), sig, brief (its low bytes) of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        lambda it: released(_sketches(it, width)), "doc_id long, n_shingles long, lo long, hi long, sig binary, brief binary"
    )


def _chosen(node: str, level: int) -> str:
    """SQL for the signature positions a node branches on: one, or two for a quarter of nodes."""
    at = lambda k: f"cast(pmod(xxhash64({node}, {level}, {k}), {POSITIONS}) as int)"
    return f"array_distinct(if(pmod(xxhash64({node}, {level}, 3), 4) = 0, array({at(1)}, {at(2)}), array({at(1)})))"


def _children(df: DataFrame, level: int) -> DataFrame:
    """Each row (rid, n, node, sig) moves on to the children of its node."""
    return df.withColumn("at", F.explode(F.expr(_chosen("node", level)))).select(
        "rid", "n", F.expr(f"xxhash64(node, at, substring(sig, 4 * at + 1, 4), {level})").alias("node"), "sig"
    )


def _miss(levels: list[int], percent: int) -> float:
    """Chance that trees of so many levels each all miss a pair at the threshold."""
    out, likeness = 0.0, percent / 100
    for m in range(POSITIONS + 1):
        j = m / POSITIONS
        kept = 0.75 * j + 0.25 * (1 - (1 - j) ** 2)
        chance = comb(POSITIONS, m) * likeness**m * (1 - likeness) ** (POSITIONS - m)
        for level in levels:
            chance *= 1 - kept**level if m >= AGREE else 1
        out += chance
    return out


def _groups(label: np.ndarray, side: np.ndarray, n: np.ndarray, brief: np.ndarray, percent: int) -> np.ndarray:
    """For each member of a cell, in order of size, a number of the group that pairs hold
    together which may be linked by size and tokens; brief has the positions as rows."""
    ends = np.searchsorted(n, 100 * n // percent, "right").tolist()
    group = np.arange(len(n))
    for i in range(len(n) - 1):
        if ends[i] > i + 1:
            # equal bytes are added up over whole rows of members
            same = (brief[:, i + 1 : ends[i]] == brief[:, i, None]).view(np.uint8).sum(axis=0, dtype=np.uint8)
            near = i + 1 + np.flatnonzero(same >= AGREE)
            near = near[(label[near] != label[i]) & ((side[near] == 0) | (side[i] == 0))] if len(near) else near
            if len(near):
                joined = np.unique(group[np.append(near, i)])
                group[np.isin(group, joined)] = joined[0]
    return group


def _close(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of rows (rid, label, node, block, side, n, brief) in order of cells (node and block):
    those with a partner apart from them in their cell that may be linked, in groups. A
    group is named by its members, so that trees which bring the same ones together ask for
    one comparison. Holds a batch and a cell."""
    names = ("rid", "label", "side", "n", "node", "block")
    held: list[np.ndarray] = []
    for b in chain(batches, [None]):
        if b is not None:
            new = [b.column(c).to_numpy() for c in names] + [np.frombuffer(b"".join(b.column("brief").to_pylist()), np.uint8).reshape(-1, POSITIONS)]
            held = [np.concatenate(x) for x in zip(held, new, strict=True)] if held else new
        if not held or not len(held[0]):
            continue
        rid, label, side, n, node, block, brief = held
        edges = np.flatnonzero((node[1:] != node[:-1]) | (block[1:] != block[:-1])) + 1
        starts = [0, *edges.tolist()] + ([len(rid)] if b is None else [])  # the last cell may go on in the next batch
        out: list[tuple] = []
        for lo, hi in zip(starts, starts[1:], strict=False):
            if hi - lo < 2:
                continue
            by = lo + np.argsort(n[lo:hi], kind="stable")
            group = _groups(label[by], side[by], n[by], np.ascontiguousarray(brief[by].T), percent)
            for g in np.flatnonzero(np.bincount(group) > 1):
                members = by[group == g]
                members = members[np.lexsort((side[members], rid[members]))]
                key = np.stack([rid[members], side[members]]).astype("<i8").tobytes()
                out.append((members, int.from_bytes(xxhash.xxh3_64_digest(key), "big", signed=True)))
        if out:
            rows = np.concatenate([m for m, _ in out])
            cells = np.repeat([k for _, k in out], [len(m) for m, _ in out])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (rid[rows], label[rows], cells, side[rows])], ["rid", "label", "node", "side"])
        held = [x[starts[-1] :] for x in held]


def _prefix(n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """How many of the first of n shingles, in any order common to all sets, a set must show
    so that a linked set that isn't larger finds it, and one that isn't smaller: among
    these two every link has a shingle in common."""
    up = lambda a, b: -(-a // b)
    return n - up(percent * n, 100) + 1, n - up(2 * percent * n, 100 + percent) + 1


def prefix_pairs(sets: list[np.ndarray], percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(i, others): for each set, by size, the sets before it with a shingle of theirs in
    common with it among the rarest; every linked pair is one of these."""
    size = np.array([len(x) for x in sets])
    order = np.argsort(size, kind="stable")
    n = size[order]
    if len(n) < 2:
        return
    owner = np.repeat(np.arange(len(n)), n)
    _, token, count = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True, return_counts=True)
    by = np.lexsort((token, count[token], owner))
    token = token[by]  # owner stays as it is
    place = np.arange(len(token)) - np.repeat(np.cumsum(n) - n, n)
    probe, index = _prefix(n, percent)
    kept = np.flatnonzero((place < probe[owner]) & (count[token] > 1))
    token, owner, shown = token[kept].tolist(), owner[kept].tolist(), (place[kept] < index[owner[kept]]).tolist()
    lists: dict[int, list[int]] = {}
    k = 0
    for i in range(len(n)):
        first, near = k, set()
        while k < len(owner) and owner[k] == i:
            near.update(lists.get(token[k], ()))
            k += 1
        for at in range(first, k):
            if shown[at]:
                lists.setdefault(token[at], []).append(i)
        if near:
            yield int(order[i]), order[np.array(sorted(near))]


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _compare(cell: pa.Table, width: int, percent: int) -> pa.Table:
    """One group: rows rid, label, side, text; links of members apart.

    side 0: compared with all; side 1: with side 0 only. A rid has several texts if
    rows repeat a doc_id."""
    seen: dict[tuple[int, bytes], tuple[int, int, np.ndarray]] = {}
    for at in range(0, cell.num_rows, 64):
        b = cell.slice(at, 64)
        sets = shingle_sets(b.column("text").cast(pa.binary()).to_pylist(), width)
        for rid, label, side, h in zip(*(b.column(c).to_pylist() for c in ("rid", "label", "side")), sets, strict=True):
            key = (rid, xxhash.xxh3_128_digest(h.tobytes()))
            if len(h) and (key not in seen or side < seen[key][1]):
                seen[key] = (label, side, h)
    keys = sorted(seen)
    sets = [seen[k][2] for k in keys]
    side, size = np.array([seen[k][1] for k in keys]), np.array([len(x) for x in sets])
    first: dict[int, int] = {}
    top = np.array([first.setdefault(seen[k][0], i) for i, k in enumerate(keys)])  # of members joined so far
    before = top.copy()
    for i, near in prefix_pairs(sets, percent):
        for j in near[(top[near] != top[i]) & (100 * size[near] >= percent * size[i])].tolist():
            if top[i] != top[j] and not (side[i] and side[j]) and _linked(sets[i], sets[j], percent):
                top[top == top[j]] = top[i]
    moved = np.flatnonzero(top != before)  # a star for each class
    return pa.table([pa.array([keys[i][0] for i in moved], pa.int64()), pa.array([keys[top[i]][0] for i in moved], pa.int64())], names=["a", "b"])


def _relabelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return members.withColumn("label", F.col("rid"))
    return members.join(labels.withColumnRenamed("id", "rid"), "rid", "left").withColumn("label", F.coalesce("label", "rid"))


def _merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """(id, label) after links (a, b) between ids: the least id reachable; ids without a
    link don't occur. Only the classes that links join are walked again."""
    if labels is None:
        return written(components(links).withColumnRenamed("component", "label"), "labels")
    a = _relabelled(links.select(F.col("a").alias("rid"), "b"), labels).select("b", F.col("label").alias("a"))
    ends = _relabelled(a.withColumnRenamed("b", "rid"), labels).select("a", F.col("label").alias("b"))
    fresh = written(components(ends), "fresh")
    old = labels.join(fresh.select(F.col("id").alias("label"), "component"), "label", "left").select("id", F.coalesce("component", "label").alias("label"))
    return written(old.unionByName(fresh.join(labels, "id", "left_anti").withColumnRenamed("component", "label")), "labels")


def _compared(texts: DataFrame, sets: DataFrame, cells: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) of members apart, for cells (rid, label, node, block, side); texts are
    in buckets of doc_id."""
    sketched = cells.join(sets.select("rid", "n", "brief"), "rid").select(*cells.columns, "n", "brief")
    # cells are many and small: whole partitions of them, in order
    dealt = sketched.repartition("node", "block").sortWithinPartitions("node", "block", "rid", "side")
    close = dealt.mapInArrow(lambda it: released(_close(it, percent)), "rid long, label long, node long, side int")
    packed = written(close.groupBy("rid", "label").agg(F.collect_set(F.struct("node", "side")).alias("at")), "cells")
    # Spark broadcasts packed if its table is small (spark.sql.autoBroadcastJoinThreshold), else packed is shuffled to the buckets
    rows = texts.join(packed, texts["doc_id"] == packed["rid"]).select("rid", "label", "text", F.explode("at").alias("at")).select("rid", "label", "text", "at.*")
    found = written(rows.groupBy("node").applyInArrow(lambda cell: _compare(cell, width, percent), "a long, b long"), "found")
    discard(packed)
    return found


def _ranked(texts: DataFrame, members: DataFrame, width: int, percent: int) -> DataFrame:
    """(rid, label, token, shown) of members (rid, label): each text's shingles that a linked
    text of them must share one of, the rarest among members first; shown: those that a
    larger text finds."""

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                sets = shingle_sets(b.column("text").cast(pa.binary()).to_pylist(), width)
                for h, rid, label in zip(sets, b.column("rid"), b.column("label"), strict=True):
                    name = pa.scalar(int.from_bytes(xxhash.xxh3_64_digest(h.tobytes()), "big", signed=True))
                    for lo in range(0, len(h), 1 << 16):
                        tokens = pa.array(h[lo : lo + (1 << 16)].view(np.int64))
                        same = lambda x, k=len(tokens): pa.repeat(x, k)
                        yield pa.RecordBatch.from_arrays([same(rid), same(label), same(name), same(pa.scalar(len(h))), tokens], ["rid", "label", "name", "n", "token"])

    rows = texts.join(members, texts["doc_id"] == members["rid"]).select("rid", "label", "text")
    rows = written(rows.mapInArrow(lambda it: released(exploded(it)), "rid long, label long, name long, n long, token long"), "shingles")
    often = written(rows.groupBy("token").agg(F.count("*").alias("count")).where("count > 1"), "often")
    place = F.row_number().over(Window.partitionBy("rid", "name").orderBy(F.coalesce("count", F.lit(1)), "token"))
    ranked = rows.join(often, "token", "left").withColumn("place", place)
    up = lambda a, b: F.ceil(a / b).cast("long")
    probe, index = F.col("n") - up(percent * F.col("n"), F.lit(100)) + 1, F.col("n") - up(2 * percent * F.col("n"), F.lit(100 + percent)) + 1
    return ranked.where((F.col("place") <= probe) & (F.col("count") > 1)).select("rid", "label", "token", (F.col("place") <= index).alias("shown")).distinct()


def _wide_compared(texts: DataFrame, sets: DataFrame, wide: DataFrame, labels: DataFrame, width: int, percent: int, block: int) -> DataFrame:
    """labels after the members of wide nodes (rid, node) that are still apart have met all
    others of such nodes: cells are the shingles that they have in common."""
    named = _relabelled(wide.select("rid", "node"), labels)
    split = named.groupBy("node").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("node")
    members = written(named.join(split, "node", "left_semi").select("rid", "label").distinct(), "apart")
    if members.isEmpty():
        return labels
    shown = written(_ranked(texts, members, width, percent).withColumnRenamed("token", "node"), "shown")
    # the class with most members in a cell needn't be compared with itself
    classes = shown.groupBy("node", "label").agg(F.count("*").alias("k"))
    cells = written(classes.groupBy("node").agg(F.sum("k").alias("size"), F.max_by("label", F.struct("k", "label")).alias("main"), F.count("*").alias("classes")).where("classes > 1"), "shared")
    rows = shown.join(cells, "node").withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
    keep = ["rid", "label", "node", "block", "side"]
    whole = rows.where("blocks = 1").withColumn("block", F.lit(0)).withColumn("side", F.when(F.col("shown"), 0).otherwise(1))
    large = rows.where("blocks > 1").select("rid", "label", "node", "main", "blocks")
    part, other = (F.pmod(F.xxhash64("rid", F.lit(k)), F.col("blocks")).cast("int") for k in (5, 3))
    apart = large.where("label <> main").withColumn("part", part)
    parts = apart.select("node", "part").distinct()
    cell = (F.col("part") * F.col("blocks") + F.col("other")).alias("block")
    meet = apart.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("rid", "label", "node", cell, F.lit(0).alias("side"))
    hosts = large.withColumn("other", other).join(parts, "node").select("rid", "label", "node", cell, F.lit(1).alias("side"))
    return _merged(labels, _compared(texts, sets, whole.select(keep).unionByName(meet).unionByName(hosts), width, percent))


def near_duplicates(
    docs: DataFrame, *, width: int = 5, percent: int = 80, trees: int = 2, small: int = 1024, depth: int = 3, block: int = 1024
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text).

    Links documents whose sets have 100 * intersection >= percent * union;
    component_id is the least doc_id reachable (its own without a link), kept marks
    doc_id = component_id. trees: how many are grown in a first pass; the others follow in
    a second one, which leaves out nodes whose members the first has joined. Null or empty texts
    and texts without words have no shingles and no links; rows without doc_id have
    component_id null, kept true and link nothing; rows that repeat a doc_id with
    different texts link what each text links. Very long texts count whole: a task
    compares members of at most NODE_SHINGLES shingles, or two texts. Other columns are
    not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = bucketed(docs.where("doc_id is not null"), "doc_id", "texts")
    out = _classes(docs, texts, width, percent, trees, small, depth, block)
    discard(texts)
    return out


def _classes(docs: DataFrame, texts: DataFrame, width: int, percent: int, trees: int, small: int, depth: int, block: int) -> DataFrame:
    """near_duplicates, given the rows that have a doc_id in buckets as well."""
    all_rows = written(sketches(docs, width), "sketches")
    one = F.min_by(F.struct("sig", "brief", F.col("n_shingles").alias("n")), "doc_id").alias("one")
    sets = written(all_rows.where("doc_id is not null and n_shingles > 0").groupBy("lo", "hi").agg(one, F.min("doc_id").alias("rid")).select("lo", "hi", "rid", "one.*"), "sets")
    # rows that share a doc_id belong together, whatever their sets
    ties = all_rows.where("n_shingles > 0").groupBy("doc_id").agg(F.min("lo").alias("x"), F.max("lo").alias("y")).where("x <> y").select("doc_id")
    again = all_rows.join(ties, "doc_id", "left_semi").select("doc_id", "lo", "hi").join(sets.select("lo", "hi", "rid"), ["lo", "hi"])
    again = again.select(F.col("doc_id").alias("a"), F.col("rid").alias("b"))
    labels, open_wide = None, []
    enough = next(k for k in range(trees, 10_000) if _miss([depth] * k, percent) <= MISS)
    large = (F.col("size") > small) | (F.col("length") > NODE_SHINGLES)
    for first, end in ((0, trees), (trees, enough)):
        names = [F.lit(f"tree {i}") for i in range(first, end)]
        at = _children(sets.select("rid", "n", F.explode(F.array(*[F.xxhash64(x) for x in names])).alias("node"), "sig"), 0)
        leaves, used = [], []
        for level in range(1, depth + 1):
            slim = written(at.select("rid", "n", "node"), "nodes")
            named = _relabelled(slim, labels)
            nodes = named.groupBy("node").agg(F.count("*").alias("size"), F.min("label").alias("x"), F.max("label").alias("y"), F.sum("n").alias("length")).where("x <> y").select("node", "size", "length")
            # a table of its own, so that a node with many members can be split where it is joined
            nodes = written(nodes, "sizes")
            open_ = written(named.join(nodes, "node"), "open")
            discard(slim)
            discard(nodes)
            used.append(open_)
            last = level == depth
            leaves.append(open_ if last else open_.where(~large))
            if last or open_.where(large).isEmpty():
                break
            at = _children(open_.where(large).select("rid", "n", "node").join(sets.select("rid", "sig"), "rid"), level)
        leaf = leaves[0]
        for x in leaves[1:]:
            leaf = leaf.unionByName(x)
        blocks = F.greatest(F.ceil(F.col("size") / block), F.ceil(F.col("length") / NODE_SHINGLES))
        leaf = leaf.withColumn("blocks", blocks.cast("int"))
        whole = leaf.withColumn("block", F.pmod(F.xxhash64("rid", F.lit(3)), F.col("blocks")).cast("int")).withColumn("side", F.lit(0))
        wide = written(leaf.where("blocks > 1").select("rid", "label", "node", "blocks"), "wide")
        pivots = wide.groupBy("node", "blocks").agg(F.min_by("label", "rid").alias("label"), F.min("rid").alias("rid"))
        pivots = pivots.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("side", F.lit(0))
        keep = ["rid", "label", "node", "block", "side"]
        found = _compared(texts, sets, whole.select(keep).unionByName(pivots.select(keep)), width, percent)
        labels = _merged(labels, found.unionByName(again) if labels is None else found)
        for x in used:
            discard(x)
        open_wide.append(wide)
    labels = _wide_compared(texts, sets, open_wide[0].unionByName(open_wide[1]), labels, width, percent, block)
    named = _relabelled(sets.select("lo", "hi", "rid"), labels).select("lo", "hi", "label")
    out = all_rows.drop("sig", "brief").join(named, ["lo", "hi"], "left").withColumn("component_id", F.coalesce("label", "doc_id"))
    lone = F.col("doc_id").isNull()
    return out.select("doc_id", "n_shingles", F.when(~lone, F.col("component_id")).alias("component_id"), (lone | F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("kept"))


def deduplicated(docs: DataFrame, *, width: int = 5, percent: int = 80, trees: int = 2, small: int = 1024, depth: int = 3, block: int = 1024) -> DataFrame:
    """The documents that near_duplicates keeps, with all their columns: one of each
    class (of rows that repeat a kept doc_id, one). Other columns may have any names."""
    names = docs.columns
    flat = docs.toDF(*[f"c{i}" for i in range(len(names))])
    id_, text = (f"c{names.index(x)}" for x in ("doc_id", "text"))
    flat = flat.withColumn("doc_id", F.col(id_).cast("long"))
    held = bucketed(flat.where("doc_id is not null"), "doc_id", "texts")
    read = lambda df: df.select("doc_id", F.col(text).cast("string").alias("text"))
    classes = _classes(read(flat), read(held), width, percent, trees, small, depth, block)
    kept = classes.where("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"))
    found = held.join(written(kept, "kept"), "doc_id")
    once, again = found.where("n = 1"), found.where("n > 1").dropDuplicates(["doc_id"])
    out = once.drop("n").unionByName(again.drop("n")).unionByName(flat.where("doc_id is null"))
    return out.drop("doc_id").toDF(*names)
