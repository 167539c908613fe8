"""A bit filter over ids, sized by their number up to a bound and broadcast; more ids go through in parts.

False positives only let more rows through to the exact join that follows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow
from .textnum import U, mix

#: Bits for each id, fewest and most bits of a filter (128 KB and 128 MB), and the most ids of one.
SHARE, LEAST, MOST = 32, 1 << 20, 1 << 30
IDS = MOST // SHARE
_SEEDS = (U(0x51ED270B), U(0xB5297A4D68E31DA4), U(0x1B56C4E9), U(0x9E6C63D0876A9A62))


def _places(ids: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(mix(ids.view(U) ^ s) & U(bits - 1)).astype(np.int64) for s in _SEEDS]


def filter_of(ids: DataFrame, count: int | None = None) -> bytes:
    """The bits of a column of longs, nulls left out: an aggregate of rows of 4 KB, at most MOST bits whatever the number of ids."""
    n = ids.count() if count is None else count
    size = min(MOST, max(LEAST, 1 << (SHARE * n).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.ascontiguousarray(b.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(_places(x, size))) + 1)], ["bit"])

    bit: Column = F.col("bit")
    rows = arrow(ids, run, "bit long").groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    out = bytearray(size // 8)
    for r in rows.collect():  # at most MOST bits; a job for each partition would be many
        out[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = r["bits"]
    return bytes(out)


def passes(bits: bytes, ids: np.ndarray) -> np.ndarray:
    """Which of these int64 ids may be in the filter."""
    held = np.frombuffer(bits, np.uint8)
    out = np.ones(len(ids), bool)
    for p in _places(np.ascontiguousarray(ids), 8 * len(held)):
        out &= (held[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)
    return out


def filters(rows: DataFrame, ids: DataFrame, key: str, most: int = IDS) -> list[tuple[DataFrame, Broadcast]]:
    """rows and the filter of ids (one column of longs) by ``key``, in as many parts as keep a filter within its bound: each row and id is in one part."""
    n = ids.count()
    k = max(1, -(-n // most))
    part = lambda df, c, p: df.filter(F.pmod(F.xxhash64(c), F.lit(k)) == p) if k > 1 else df
    return [(part(rows, key, p), rows.sparkSession.sparkContext.broadcast(filter_of(part(ids, ids.columns[0], p), n if k == 1 else None))) for p in range(k)]
