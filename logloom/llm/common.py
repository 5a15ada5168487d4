"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logloom.session import checkpoint_root, ship_package

#: Most text bytes that a Python task works on at once (one longer text is
#: still taken whole).
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder and cut the lineage."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema) -> DataFrame:
    """``mapInArrow`` of a function of one (bounded) record batch."""
    ship_package(df.sparkSession)
    return df.mapInArrow(_each(fn), schema)


def _each(fn):
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                yield fn(part)
    return run


_TEXTS = (pa.types.is_string, pa.types.is_binary, pa.types.is_large_string, pa.types.is_large_binary)


def slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``limit`` bytes."""
    n = batch.num_rows
    if n == 0:
        yield batch
        return
    size = np.zeros(n, np.int64)
    cols = [c for col in batch.columns for c in (col.flatten() if pa.types.is_struct(col.type) else [col])]
    for col in cols:
        if any(kind(col.type) for kind in _TEXTS):
            size += np.diff(offsets(col))
    total = np.cumsum(size + 16)
    start = 0
    while start < n:
        base = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def offsets(col: pa.Array) -> np.ndarray:
    """Byte offsets of a string or binary array (n + 1 of them)."""
    buf = col.buffers()[1]
    if buf is None or len(col) == 0:
        return np.zeros(len(col) + 1, np.int64)
    width = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    return np.frombuffer(buf, width, len(col) + 1 + col.offset)[col.offset:].astype(np.int64)


def raw_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a string array; a null counts as empty."""
    if col.null_count:
        col = col.fill_null("")
    off = offsets(col)
    data = col.buffers()[2]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0]:off[-1]], off - off[0]


def code_points(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets of each text) of a string array."""
    data, off = raw_bytes(col)
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    starts = (data & 0xC0) != 0x80
    if len(data) and int(starts.sum()) != len(points):  # not UTF-8: text by text
        texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(off[:-1], off[1:])]
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        return points, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    before = np.concatenate([[0], np.cumsum(starts)])
    return points, before[off]


#: A-Z to a-z, every other byte as it is.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def crc_mod(col: str, n: int) -> Column:
    """crc32(col as text) mod n; null for a null."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % n


def sample_by_hash(df: DataFrame, key: str, rows: int) -> DataFrame:
    """The ``rows`` rows whose key hashes lowest: a fixed, bounded sample."""
    return df.orderBy(F.xxhash64(key), key).limit(rows)


def hex64(col: str) -> Column:
    """A 64-bit value as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(F.col(col)), 16, "0"))
