"""WARC archives in Zstandard, one frame per record, and their reader.

An archive begins with a skippable frame that holds the dictionary of all its frames.
The writer makes the dictionary from the archive's own first records; the reader loads
it, decodes frame by frame, and checks versions, headers, lengths and digests. Both run in
the executors and stream: neither holds more than a record and a buffer, nor does the
driver get paths or records. Archives go to the folder that all executors share, under
names of their own for each attempt at a task; the manifest names those that count.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard as zstd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import scratch_path, written

SKIPPABLE = 0x184D2A5D
DICTIONARY_BYTES = 16_384
SAMPLE_BYTES = 1_000_000
ARCHIVE_BYTES = 128_000_000
LEAST_REVISIT = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# The types of records.
TYPES = ("warcinfo", "response", "resource", "request", "metadata", "revisit", "conversion", "continuation")
BROADCAST_ROWS = 300_000
_WINDOW = 32_768


class WarcError(ValueError):
    """An archive or record that isn't as the format wants it."""


def _safe(value: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def _record_id(*what) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(map(str, what)))}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """A response record, or a revisit one if refers_to is given: that has the HTTP header only.

    A response's WARC-Record-ID follows from its page_id, and a revisit's WARC-Refers-To
    names that of the page it refers to; rows that repeat a page_id share theirs."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_id('page', page_id) if refers_to is None and page_id is not None else _record_id(page_id, url, digest, refers_to)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_safe(url)}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id('page', refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(samples: list[bytes]) -> bytes:
    """A dictionary from sample records; empty if they are too few for one."""
    try:
        return zstd.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8).as_bytes()
    except zstd.ZstdError:
        return b""


class ArchiveWriter:
    """Writes records to one archive."""

    def __init__(self, uri: str, level: int = 3):
        store, path = fs.FileSystem.from_uri(uri)
        store.create_dir(path.rpartition("/")[0], recursive=True)
        self.out, self.level, self.held, self.size, self.n, self.zip = store.open_output_stream(path, compression=None), level, [], 0, 0, None

    def add(self, raw: bytes) -> None:
        self.n += 1
        self.size += len(raw)
        if self.zip is None:
            self.held.append(raw)
            if self.size >= SAMPLE_BYTES:
                self._start()
        else:
            self.out.write(self.zip.compress(raw))

    def _start(self) -> None:
        d = dictionary([x[:20_000] for x in self.held])
        if d:
            self.out.write(struct.pack("<II", SKIPPABLE, len(d)) + d)
        self.zip = zstd.ZstdCompressor(level=self.level, dict_data=zstd.ZstdCompressionDict(d) if d else None)
        for raw in self.held:
            self.out.write(self.zip.compress(raw))
        self.held = []

    def close(self) -> None:
        if self.zip is None:
            self._start()
        self.out.close()


def frames(stream) -> Iterator[bytes]:
    """The decoded frames of an archive, one by one; the dictionary is loaded on the way."""
    buffer = stream.read(_WINDOW)
    loaded = None
    if len(buffer) >= 8 and struct.unpack_from("<I", buffer)[0] == SKIPPABLE:
        size = struct.unpack_from("<I", buffer, 4)[0]
        while len(buffer) < 8 + size:
            more = stream.read(8 + size - len(buffer) + _WINDOW)
            if not more:
                raise WarcError("the dictionary's frame is cut off")
            buffer += more
        raw = bytes(buffer[8 : 8 + size])
        if raw[:4] == b"\x28\xb5\x2f\xfd":
            raw = zstd.ZstdDecompressor().decompress(raw)
        loaded = zstd.ZstdCompressionDict(raw)
        buffer = buffer[8 + size :]
    unzip = zstd.ZstdDecompressor(dict_data=loaded)
    while True:
        if not buffer:
            buffer = stream.read(_WINDOW)
            if not buffer:
                return
        one, out = unzip.decompressobj(), []
        while True:
            try:
                out.append(one.decompress(buffer))
            except zstd.ZstdError as e:
                raise WarcError(f"a frame can't be decoded: {e}") from e
            if one.eof:
                buffer = one.unused_data
                break
            buffer = stream.read(_WINDOW)
            if not buffer:
                raise WarcError("the last frame is cut off")
        yield b"".join(out)


def _headers(raw: bytes) -> dict[str, str]:
    out = {}
    for line in raw.decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise WarcError(f"a header line without a name: {line[:80]!r}")
        out[name.strip().lower()] = value.strip()
    return out


def _number(headers: dict[str, str], name: str) -> int:
    value = headers.get(name, "")
    if not (value.isascii() and value.isdigit()):
        raise WarcError(f"{name} is {value[:80]!r}, not a number")
    return int(value)


def _verify(data: bytes, digest: str) -> None:
    """Checks data against a labelled digest in hex or base 32; a bare one is SHA-256.
    Digests of algorithms that Python lacks can't be checked."""
    name, _, value = digest.rpartition(":")
    name = (name or "sha256").lower().replace("-", "")
    if name in hashlib.algorithms_guaranteed and not name.startswith("shake"):
        own = hashlib.new(name, data)
        if value.lower() != own.hexdigest() and value.upper().rstrip("=") != base64.b32encode(own.digest()).decode().rstrip("="):
            raise WarcError("a payload or block that differs from its digest")


def parsed(raw: bytes) -> dict:
    """A frame's only record, checked: page_id, url, record_type, payload_bytes,
    payload_digest, refers_to, payload.

    Of a response or revisit the payload is what follows the HTTP header (None for a
    revisit, whose payload_bytes is None if no Content-Length tells it); of any other type
    of TYPES it is the block.
    payload_digest is the payload's SHA-256 in hex, for a revisit the one it names.
    page_id and refers_to are None in records of other writers. Whatever is malformed is
    a WarcError."""
    head, blank, rest = raw.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if not blank or version not in (b"WARC/1.0", b"WARC/1.1"):
        raise WarcError("a frame doesn't begin with a record")
    h = _headers(lines)
    for need in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if need not in h:
            raise WarcError(f"a record without {need}")
    if len(rest) != _number(h, "content-length") + 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError("a record's length isn't its Content-Length, or its frame holds more")
    kind, block, digest = h["warc-type"].lower(), rest[:-4], h.get("warc-payload-digest")
    if kind not in TYPES:
        raise WarcError(f"a record of type {kind}")
    if "warc-block-digest" in h:
        _verify(block, h["warc-block-digest"])
    payload: bytes | None = block
    size: int | None = None
    if kind in ("response", "revisit") and h.get("content-type", "application/http").startswith("application/http"):
        http, blank, payload = block.partition(b"\r\n\r\n")
        if not blank or not http.startswith(b"HTTP/"):
            raise WarcError("a block without an HTTP header")
        fields = _headers(http.partition(b"\r\n")[2]) if b"\r\n" in http else {}
        if "content-length" in fields:
            size = _number(fields, "content-length")
    refers = None
    if kind == "revisit":
        if payload or digest is None or "warc-profile" not in h:
            raise WarcError("a revisit that isn't one")
        refers = _number(h, "x-refers-to-page") if "x-refers-to-page" in h else None
        payload, digest = None, digest.removeprefix("sha256:")
    else:
        if size not in (None, len(payload)):
            raise WarcError("a payload that differs from its length")
        if digest is not None:
            _verify(payload, digest)
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
    return {"page_id": int(h["x-page-id"]) if re.fullmatch(r"-?\d+", h.get("x-page-id", "")) else None, "url": h.get("warc-target-uri"), "record_type": kind, "payload_bytes": size, "payload_digest": digest, "refers_to": refers, "payload": payload}


def _archives(batches: Iterator[pa.RecordBatch], folder: str, date: str) -> Iterator[pa.RecordBatch]:
    """Rows page_id, url, html, digest, refers_to of a partition to archives; a row for each."""
    at = TaskContext.get()
    out, done = None, []
    for b in batches:
        for page_id, url, html, digest, refers in zip(*(b.column(c) for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
            if out is None:
                uri = f"{folder}/{at.partitionId():06d}-{len(done):04d}-{uuid.uuid4().hex}.warc.zst"
                out = ArchiveWriter(uri)
            out.add(record(page_id.as_py(), url.as_py(), (html.as_py() or "").encode("utf-8", "surrogatepass"), digest.as_py(), refers.as_py(), date))
            if out.size >= ARCHIVE_BYTES:
                out.close()
                done.append((uri, out.n))
                out = None
    if out is not None:
        out.close()
        done.append((uri, out.n))
    yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], ["archive", "records"])


def write_archives(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes a record for every row of pages (page_id, url, html) into archives below
    folder; returns their manifest (archive, records).

    Payload: the html in UTF-8, null as empty. Of the rows with equal payloads of at
    least 100 bytes that have the smallest page_id, all are responses; those with a larger one
    revisit it. Smaller payloads and rows without page_id are responses. Equal payloads
    are counted by digest before anything moves; what repeats goes to every executor if it is
    at most BROADCAST_ROWS digests, otherwise it meets the pages by a join.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"))
    repeats = p.where((F.octet_length("html") >= LEAST_REVISIT) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").select("digest", "first")
    repeats = written(repeats, "repeats")
    few = repeats.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    p = p.join(F.broadcast(repeats) if few else repeats, "digest", "left")
    p = p.select("page_id", "url", "html", "digest", F.when(F.col("page_id") > F.col("first"), F.col("first")).alias("refers_to"))
    return written(p.mapInArrow(lambda it: _archives(it, folder, date), "archive string, records long"), "manifest")


_KINDS = {"archive": pa.string(), "page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}


def _records(batches: Iterator[pa.RecordBatch], payload: bool) -> Iterator[pa.RecordBatch]:
    names = [n for n in _KINDS if payload or n != "payload"]
    for b in batches:
        for uri, want in zip(b.column("archive").to_pylist(), b.column("records").to_pylist(), strict=True):
            store, path = fs.FileSystem.from_uri(uri)
            rows, n, size = [], 0, 0
            with store.open_input_stream(path, compression=None) as stream:
                for raw in frames(stream):
                    rows.append(parsed(raw) | {"archive": uri})
                    n, size = n + 1, size + (len(raw) if payload else 0)
                    if len(rows) >= 2048 or size >= 8_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], _KINDS[c]) for c in names], names)
                        rows, size = [], 0
            if want is not None and n != want:
                raise WarcError(f"{uri}: {n} records of {want}")
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], _KINDS[c]) for c in names], names)


def read_archives(spark: SparkSession, manifest: DataFrame, payload: bool = False) -> DataFrame:
    """The records of the archives of a manifest (archive, records; records may be null):
    archive, page_id, url, record_type, payload_bytes, payload_digest, refers_to and, if
    asked for, payload (null for a revisit). What fails a check raises WarcError."""
    kinds = "archive string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"
    listed = manifest.select("archive", F.col("records").cast("long").alias("records"))
    return listed.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "archive").mapInArrow(lambda it: _records(it, payload), kinds + (", payload binary" if payload else ""))


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, read
    back from archives written to the shared folder. An empty table gives no rows."""
    spark = pages.sparkSession
    manifest = write_archives(pages, scratch_path(spark, "warc"))
    return read_archives(spark, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
