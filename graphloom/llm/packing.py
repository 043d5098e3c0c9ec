"""Best-fit packing by hierarchical residual packing.

Each partition packs its items best-fit, longest first, and emits the bins that are
nearly full; the other bins go on as items of the next round, in fewer partitions, and so
on up a tree. A round's partitions hold at most `rows` items; the rounds end when one
partition has packed all that remained, or when a round joins less than 3 % of the bins.
Bins are dealt anew in every round, so that those of different partitions meet. Best fit
leaves at most one bin of a partition half empty; so whichever round is the last, there
are fewer bins than twice the tokens by the capacity, and one more for each partition.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice, pairwise
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import Kept, released, written

CAPACITY = 2048
_PAD = "<|startoftext|>"


@lru_cache(1)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


# A word of lower-case letters that no step before the vocabulary changes, and the marks at its end:
# the tokenizer parts them there and nowhere else.
_PLAIN = re.compile(rb"((?:[a-z]++|\xc3[\x9f-\xb6\xb8-\xbf])++)([!-/:-@\[-`{-~]*+)").fullmatch


def _word_ids(path: str) -> Kept:
    """Token ids of words, and of runs of marks, that the tokenizer takes as one each."""
    t = _tokenizer(path)

    def of(words: list[bytes]) -> list[bytes]:
        out: list[bytes] = []
        for i in range(0, len(words), 1024):
            part = words[i : i + 1024]
            e = t.encode(b" ".join(part).decode("utf-8"), add_special_tokens=False)
            raw = np.array(e.ids, dtype="<u4").tobytes()
            cuts = (4 * np.searchsorted(np.array(e.word_ids), np.arange(len(part) + 1))).tolist()
            out += [raw[lo:hi] for lo, hi in pairwise(cuts)]
        return out

    return Kept(of, 64 << 20)


def chunk_ids(path: str) -> Kept:
    """Token ids, as little-endian unsigned 32-bit numbers, of chunks without white space.

    Plain chunks are put together from their word and the marks behind it, so that a word
    is tokenized once whatever follows it."""
    t = _tokenizer(path)
    pad = t.token_to_id(_PAD)
    kept = _word_ids(path)

    def whole(chunks: list[bytes]) -> Iterator[bytes]:
        for i in range(0, len(chunks), 256):
            part = chunks[i : i + 256]
            ids = np.array(t.encode(_PAD.join(w.decode("utf-8") for w in part), add_special_tokens=False).ids, dtype="<u4")
            cuts = np.flatnonzero(ids == pad).tolist()
            raw = ids.tobytes()
            yield from (raw[4 * lo : 4 * hi] for lo, hi in zip([0, *(c + 1 for c in cuts)], [*cuts, len(ids)], strict=True))

    def of(chunks: list[bytes]) -> list[bytes]:
        plain = [m.groups() if (m := _PLAIN(w)) else None for w in chunks]
        ids = kept.all([x for m in plain if m for x in m if x])
        rest = whole([w for w, m in zip(chunks, plain, strict=True) if not m])
        return [next(rest) if m is None else next(ids) + next(ids) if m[1] else next(ids) for m in plain]

    return Kept(of, 96 << 20)


def _composed(x: str) -> bool:
    """Whether A-Z may be lower-cased before the tokenizer composes letters and marks."""
    return x.isascii() or (is_normalized("NFC", x) and is_normalized("NFC", x.lower()))


def token_bytes(texts: list[str | None], path: str, kept: Kept) -> list[bytes]:
    """Each text's token ids as little-endian unsigned 32-bit numbers.

    The vocabulary's tokens never cross white space, so that a text is the sum of its
    chunks between ASCII white space; a distinct chunk is tokenized once while it is kept.
    Texts with the mark of special tokens are tokenized whole.
    """
    whole = [(x or "").encode("utf-8", "surrogatepass") for x in texts]
    chunks = [None if b"<|" in b or b"|>" in b else (b.lower() if _composed(x or "") else b).split() for x, b in zip(texts, whole, strict=True)]
    ids = kept.all([w for c in chunks if c for w in c])
    return [
        np.array(_tokenizer(path).encode(x, add_special_tokens=False).ids, dtype="<u4").tobytes() if c is None else b"".join(islice(ids, len(c)))
        for x, c in zip(texts, chunks, strict=True)
    ]


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end: int) -> Iterator[pa.RecordBatch]:
    last = np.array([end], dtype="<u4").tobytes()
    kept = chunk_ids(path)
    for whole in batches:
        for lo in range(0, whole.num_rows, 256):
            b = whole.slice(lo, 256)
            cols: list[list] = [[], [], [], [], []]
            for doc_id, raw in zip(b.column("doc_id").to_pylist(), token_bytes(b.column("text").to_pylist(), path, kept), strict=True):
                raw += last
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    for c, v in zip(cols, (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"])


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each text's ids and the end id, cut into
    pieces of capacity; only a document longer than that is cut."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        lambda it: released(_pieces(it, tokenizer, capacity, end)), "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item: longest first, each into the fullest bin that holds it."""
    out = np.empty(len(sizes), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by free space
    open_, bins = 0, 0  # open_: bit f is set if a bin has f free
    order = np.argsort(-sizes, kind="stable")
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        rest = open_ >> size
        if rest:
            f = size + (rest & -rest).bit_length() - 1
            k = free[f].pop()
            if not free[f]:
                open_ &= ~(1 << f)
        else:
            f, k = capacity, bins
            bins += 1
        f -= size
        out[i] = k
        if f:
            free[f].append(k)
            open_ |= 1 << f
    return out


def _round(batches: Iterator[pa.RecordBatch], capacity: int, slack: int, level: int, last: bool) -> Iterator[pa.RecordBatch]:
    """Items (length, members) of a partition to bins (id, length, members, full)."""
    t = pa.Table.from_batches(list(batches)) if batches else None
    if t is None or not t.num_rows:
        return
    sizes = t.column("length").to_numpy()
    bin_ = best_fit(sizes, capacity)
    fill = np.bincount(bin_, weights=sizes).astype(np.int64)
    order = np.argsort(bin_, kind="stable")
    members = t.column("members").combine_chunks().take(pa.array(order))
    counts = np.bincount(bin_)
    inner = members.offsets.to_numpy()
    flat = members.flatten()
    cuts = np.concatenate([[0], np.cumsum(counts)])
    ends = np.concatenate([[0], np.cumsum(flat.field("length").to_numpy())])
    first = inner[cuts]  # of each bin's members
    offset = ends[:-1] - np.repeat(ends[first[:-1]], np.diff(first))
    flat = pa.StructArray.from_arrays([*(flat.field(x) for x in _FIELDS), pa.array(offset)], [*_FIELDS, "offset"])
    joined = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), flat)
    base = (level << 56) + (TaskContext.get().partitionId() << 32)
    n = len(fill)
    yield from pa.table(
        [pa.array(base + np.arange(n)), pa.array(fill), joined, pa.array(np.full(n, True) if last else fill >= capacity - slack)], names=["id", "length", "members", "full"]
    ).to_batches(max_chunksize=4096)


_FIELDS = ["doc_id", "piece", "start", "length", "ids_crc32"]
_MEMBER = "struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint,offset:bigint>"


def packed(parts: DataFrame, capacity: int = CAPACITY, *, slack: int = 8, rows: int = 40_000, least: int = 4_000) -> DataFrame:
    """The rows of parts (as of pieces(), each at most capacity long) with sequence_id
    and offset: sequences without gaps, of at most capacity.

    slack: free space with which a bin counts as full before the last round; rows: most
    items of a partition; least: fewest for which a round has several partitions.
    Rounds see lengths alone: equal lengths of any number make no hot key.
    """
    whole = parts.where(F.col("length") >= capacity)
    done = whole.select("*", (F.lit(1 << 61) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    items = parts.where(F.col("length") < capacity).select("length", F.array(F.struct(*_FIELDS, F.lit(0).cast("long").alias("offset"))).cast(f"array<{_MEMBER}>").alias("members"))
    left, level, out = items.count(), 1, [done]
    before = None
    while left:
        n = -(-left // rows) if left > rows else max(1, min(16, left // least)) if level == 1 else 1
        last = n == 1 or (before is not None and left > 0.97 * before)
        dealt = items.repartition(n)
        bins = written(dealt.mapInArrow(lambda it, k=level, l=last: _round(it, capacity, slack, k, l), f"id long, length long, members array<{_MEMBER}>, full boolean"), "bins")
        out.append(bins.where("full"))
        if last:
            break
        items = bins.where("not full").select("length", "members")
        before, left, level = left, items.count(), level + 1
    result = out[0]
    for b in out[1:]:
        result = result.unionByName(b.select(F.col("id").alias("sequence_id"), F.explode("members").alias("m")).select("m.*", "sequence_id"))
    return result


def packed_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of
    docs (doc_id, text). A null text counts as empty and has the end id alone; repeated
    rows and null doc_ids are packed each for itself; an empty table gives no rows.
    Other columns are not read."""
    return packed(written(pieces(docs, tokenizer, capacity, end), "pieces"), capacity)
