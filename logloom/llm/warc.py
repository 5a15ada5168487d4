"""WARC archives with a two-level capture index.

Writing: equal payloads are found by their SHA-256 (one aggregate with
map-side combine, one join), then every task writes its rows as one archive,
a gzip member per record.  The captures' keys - host reversed, then path -
are range-sorted; each range becomes a shard: compressed blocks of
``BLOCK_LINES`` sorted lines, and a sparse directory with the first key of
every block.  A small table names the first key of each shard.

Lookup: the shard table (one row per shard) routes a query, a binary search
in the shard's directory names the block, a range read fetches it, a binary
search finds the captures, and range reads fetch their records.

All files lie below one folder of a store that driver and executors share.
A file is written under a name of its own and then put in place whole, and
its rows are in a fixed order, so a repeated task leaves the same file.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import math
import re
import zlib
from collections import OrderedDict

import pyarrow as pa
import pyarrow.fs as pafs

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from logloom.llm.common import cut, slices
from logloom.session import ship_package

BLOCK_LINES = 3000
#: Payloads of fewer bytes are always stored.
REVISIT_BYTES = 100
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_LOWEST = -(1 << 63)


# ------------------------------------------------------------------- files

class _Store:
    """A folder, by path or URI; ``s3a`` and ``s3n`` are Hadoop's names of ``s3``."""

    def __init__(self, root: str):
        try:
            self.fs, self.path = pafs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", root))
        except pa.ArrowInvalid as e:
            raise ValueError(f"archives cannot be kept in {root}: Arrow has no file system for it") from e

    def write(self, name: str):
        return _Writer(self, name)

    def open(self, name: str):
        return self.fs.open_input_file(f"{self.path}/{name}")


class _Writer:
    """Appends to a file that appears under its name when closed."""

    def __init__(self, store: _Store, name: str):
        context = TaskContext.get()
        attempt = context.taskAttemptId() if context else 0
        self.store, self.name, self.at = store, name, 0
        self.tmp = f"{store.path}/.{name}-{attempt}"
        self.out = store.fs.open_output_stream(self.tmp)

    def add(self, data: bytes) -> tuple[int, int]:
        self.out.write(data)
        start, self.at = self.at, self.at + len(data)
        return start, len(data)

    def close(self) -> None:
        self.out.close()
        self.store.fs.move(self.tmp, f"{self.store.path}/{self.name}")


# ------------------------------------------------------------------ records

def _line(value: str) -> str:
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def record(page_id, url: str | None, payload: bytes, size: int, digest: str, refers_to, date: str) -> bytes:
    """One WARC record; ``refers_to`` None: a response with its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {size}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {_line(url or '-')}",
            f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        head += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        payload = b""
    head.append(f"Content-Length: {len(http) + len(payload)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    return dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])


def _page(urn: str) -> int | None:
    name = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if name == "None" else int(name)


def parse(raw: bytes) -> dict:
    """Fields of one record; a response's digest and size are those of its payload."""
    head, rest = raw.split(b"\r\n\r\n", 1)
    warc = _fields(head)
    block = rest[:int(warc["Content-Length"])]
    http, payload = block.split(b"\r\n\r\n", 1)
    out = {"page_id": _page(warc["WARC-Record-ID"]), "record_type": warc["WARC-Type"], "refers_to": None,
           "payload_bytes": int(_fields(http)["Content-Length"]), "payload": payload,
           "payload_digest": warc["WARC-Payload-Digest"].removeprefix("sha256:")}
    if out["record_type"] == "revisit":
        out["refers_to"] = _page(warc["WARC-Refers-To"])
    elif (hashlib.sha256(payload).hexdigest(), len(payload)) != (out["payload_digest"], out["payload_bytes"]):
        raise ValueError(f"record of page {out['page_id']} does not match its digest")
    return out


# ------------------------------------------------------------------ writing

_URL = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::([0-9]*))?([^#]*)"


def capture_key(url):
    """Column: host parts reversed, then port, path and query; blanks as %20.
    What is no URL is its own key; null: ``-``."""
    host = F.lower(F.regexp_extract(url, _URL, 1))
    port, rest = F.regexp_extract(url, _URL, 2), F.regexp_extract(url, _URL, 3)
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.when(port != "", F.concat(F.lit(":"), port))
                   .otherwise(F.lit("")), F.lit(")"), F.when(rest == "", F.lit("/")).otherwise(rest))
    return F.coalesce(F.regexp_replace(F.when(host != "", key).otherwise(url), r"[\x00-\x20]", "%20"), F.lit("-"))


def write_archives(pages: DataFrame, root: str, date: str = "2024-01-01T00:00:00Z",
                   block_lines: int = BLOCK_LINES) -> None:
    """Write ``pages`` (page_id, url, html) as archives and index below
    ``root``, a new folder in shared storage.

    Of rows with equal payloads of at least ``REVISIT_BYTES`` bytes those with
    the smallest page_id are responses (a repeated row: each), the others
    revisits.  Null html is an empty payload, a null url has the key ``-``, a
    null page_id sorts first in its key and is never the smallest.
    """
    spark = pages.sparkSession
    ship_package(spark)
    store = _Store(root)  # refused before anything is written
    store.fs.create_dir(store.path, recursive=True)
    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.select("*", F.sha2("html", 256).alias("digest"), F.octet_length("html").cast("bigint").alias("size"))
    big = F.col("size") >= REVISIT_BYTES
    first = rows.where(big).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where(
        "n > 1 and first is not null").select(F.col("digest").alias("of"), "first")
    # short payloads, alike in many rows, match nothing: spread them
    of = F.when(big, F.col("digest")).otherwise(F.concat_ws("~", F.lit(""), F.col("page_id"), F.xxhash64("url")))
    typed = rows.withColumn("of", of).join(first, "of", "left").select(
        "page_id", "url", "html", "digest", "size",
        F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"),
        capture_key(F.col("url")).alias("key")).sortWithinPartitions("digest", "page_id", "url")

    def write(batches):
        name = f"archive-{TaskContext.get().partitionId():06d}.warc.gz"
        out = None
        for batch in batches:
            for part in slices(batch):
                lines = []
                for page_id, url, html, digest, size, refers, key in zip(*(c.to_pylist() for c in part.columns)):
                    out = out or _Store(root).write(name)
                    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                    raw = record(page_id, url, html.encode(), size, digest, refers, date)
                    lines.append((key, page_id, name, *out.add(packer.compress(raw) + packer.flush())))
                if lines:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*lines), (
                        pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))],
                        ["key", "page_id", "archive", "start", "size"])
        if out:
            out.close()

    captures = cut(typed.mapInArrow(write, "key string, page_id bigint, archive string, start bigint, size bigint"))
    order = ["key", F.coalesce("page_id", F.lit(_LOWEST)), "archive", "start"]

    def index(batches):
        shard = f"index-{TaskContext.get().partitionId():06d}"
        blocks, directory, held, records, size = None, [], [], 0, 0

        def flush():
            body = zlib.compress("\n".join(json.dumps(x) for x in held).encode(), 1)
            directory.append([held[0][:2], *blocks.add(body)])
            held.clear()

        for batch in batches:
            for key, page_id, *place in zip(*(c.to_pylist() for c in batch.columns)):
                blocks = blocks or _Store(root).write(f"{shard}.blocks")
                held.append([key, _LOWEST if page_id is None else page_id, *place])
                records, size = records + 1, size + place[2]
                if len(held) == block_lines:
                    flush()
        if held:
            flush()
        if blocks:
            blocks.close()
            sparse = _Store(root).write(f"{shard}.directory")
            sparse.add(zlib.compress(json.dumps(directory).encode(), 1))
            sparse.close()
            yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([directory[0][0][0]]),
                                              pa.array([directory[0][0][1]], pa.int64()), pa.array([records], pa.int64()),
                                              pa.array([size], pa.int64())], ["shard", "key", "page_id", "records", "bytes"])

    shards = captures.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        index, "shard string, key string, page_id bigint, records bigint, bytes bigint")
    shards.write.parquet(f"{root}/shards")


# ------------------------------------------------------------------- lookup

class _Shard:
    """Directory and blocks of one shard; keeps the last block read."""

    def __init__(self, store: _Store, name: str):
        with store.open(f"{name}.directory") as f:
            self.directory = json.loads(zlib.decompress(f.read()))
        self.firsts = [tuple(x[0]) for x in self.directory]
        self.blocks = store.open(f"{name}.blocks")
        self.held = (-1, [], [])

    def block(self, k: int) -> tuple[list, list]:
        if self.held[0] != k:
            _, start, size = self.directory[k]
            self.blocks.seek(start)
            lines = [json.loads(x) for x in zlib.decompress(self.blocks.read(size)).split(b"\n")]
            self.held = (k, lines, [tuple(x[:2]) for x in lines])
        return self.held[1], self.held[2]

    def find(self, low: tuple, high: tuple):
        """Captures from ``low`` to ``high``, both included."""
        k = max(0, bisect.bisect_left(self.firsts, low) - 1)
        while k < len(self.firsts) and self.firsts[k] <= high:
            lines, keys = self.block(k)
            yield from lines[bisect.bisect_left(keys, low):bisect.bisect_right(keys, high)]
            k += 1


_FOUND = ("url string, page_id bigint, payload_bytes bigint, payload_digest string, record_type string, "
          "refers_to bigint, payload binary")
_OPEN_FILES = 32
#: Archive bytes that one task of a lookup reads.
FETCH_BYTES = 16 << 20


def lookup(spark: SparkSession, root: str, queries: DataFrame, payloads: bool = True,
           fetch_bytes: int = FETCH_BYTES) -> DataFrame:
    """Records of the captures of each query row (url, page_id), or of the url
    where ``queries`` has no page_id, read through the index.

    A revisit's payload is null.  A query without a capture gives no row,
    repeated queries repeat their rows, an empty archive answers nothing.
    ``payloads=False`` leaves the payloads out.  The reading is dealt to tasks
    by ``fetch_bytes``: places asked for times the mean size of a record.
    """
    ship_package(spark)
    tops = sorted((r.key, r.page_id, r.shard, r.records, r.bytes)
                  for r in spark.read.parquet(f"{root}/shards").toLocalIterator())  # one row per shard
    firsts = [t[:2] for t in tops]
    by_page = "page_id" in queries.columns
    asked = queries.select("url", F.col("page_id").cast("bigint") if by_page else F.lit(None).cast("bigint"),
                           capture_key(F.col("url")).alias("key")).toDF("url", "page_id", "key")

    def between(key, page):
        page = _LOWEST if page is None else page
        return (key, page), (key, page if by_page else (1 << 63) - 1)

    if not tops:
        return spark.createDataFrame([], _FOUND)

    def route(batches):
        for batch in batches:
            keys, pages = batch.column(2).to_pylist(), batch.column(1).to_pylist()
            rows, at = [], []
            for i, (key, page) in enumerate(zip(keys, pages)):
                low, high = between(key, page)
                a = max(0, bisect.bisect_left(firsts, low) - 1)
                for k in range(a, max(a + 1, bisect.bisect_right(firsts, high))):
                    rows.append(i)
                    at.append(k)
            yield pa.RecordBatch.from_arrays([c.take(pa.array(rows, pa.int64())) for c in batch.columns]
                                             + [pa.array(at, pa.int32())], ["url", "page_id", "key", "shard"])

    routed = cut(asked.mapInArrow(route, "url string, page_id bigint, key string, shard int"))
    mean = sum(t[4] for t in tops) / sum(t[3] for t in tops)
    parts = max(1, math.ceil(routed.count() * mean / fetch_bytes))
    # many tasks may share a shard: a hot one is split by key
    dealt = routed.repartitionByRange(parts, "shard", "key", "page_id").sortWithinPartitions("shard", "key", "page_id")

    def fetch(batches):
        store, shard, files = _Store(root), (None, None), OrderedDict()

        def read(name, start, size):
            if name not in files:
                if len(files) == _OPEN_FILES:
                    files.popitem(last=False)[1].close()
                files[name] = store.open(name)
            files.move_to_end(name)
            files[name].seek(start)
            return parse(zlib.decompress(files[name].read(size), 31))

        for batch in batches:
            wanted = []
            for url, page, key, k in zip(*(c.to_pylist() for c in batch.columns)):
                if shard[0] != k:
                    shard = (k, _Shard(store, tops[k][2]))
                wanted += [(*line[2:], url) for line in shard[1].find(*between(key, page))]
            wanted.sort(key=lambda w: w[:3])
            for a in range(0, len(wanted), 256):
                got = [(read(*w[:3]), w[3]) for w in wanted[a:a + 256]]
                yield pa.RecordBatch.from_arrays([
                    pa.array([u for _, u in got], pa.string()), pa.array([r["page_id"] for r, _ in got], pa.int64()),
                    pa.array([r["payload_bytes"] for r, _ in got], pa.int64()),
                    pa.array([r["payload_digest"] for r, _ in got], pa.string()),
                    pa.array([r["record_type"] for r, _ in got], pa.string()),
                    pa.array([r["refers_to"] for r, _ in got], pa.int64()),
                    pa.array([r["payload"] if payloads and r["record_type"] == "response" else None for r, _ in got],
                             pa.binary())],
                    ["url", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
        for f in files.values():
            f.close()

    return dealt.mapInArrow(fetch, _FOUND)


ORACLE = f"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id <> first THEN first END AS refers_to
FROM f
"""
