"""Bloom filters of 64-bit hashes: built by tasks in segments, put together at the driver, asked where rows are read."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomveil.llm import bytescan as bs

#: Bytes of a filter that one task puts together.
SEGMENT = 1 << 16
Filter = tuple[np.ndarray, int, int]  # bits, their number, and how many of them a key sets


def positions(hashes: np.ndarray, m: int, k: int, level: int) -> np.ndarray:
    """The k bits of each hash: double hashing over m, a power of two or not."""
    salt = bs.seeds(2 * (level + 1), 6)
    a, b = bs.mix(hashes ^ salt[2 * level]), bs.mix(hashes ^ salt[2 * level + 1]) | np.uint64(1)
    return ((a[:, None] + b[:, None] * np.arange(k, dtype=np.uint64)) % np.uint64(m)).astype(np.int64)


def probe(bits: np.ndarray, m: int, k: int, level: int, hashes: np.ndarray) -> np.ndarray:
    at = positions(hashes, m, k, level)
    return ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1).all(axis=1)


def bits_needed(n: int, rate: float) -> int:
    return max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2))


def build(keys: DataFrame, n: int, rate: float, level: int = 0) -> Filter:
    """A filter of the n keys in the column `hash`. The driver gets segments of 64 KB."""
    m = bits_needed(n, rate)
    k = max(1, round(m / max(n, 1) * math.log(2)))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(positions(batch.column("hash").to_numpy().view(np.uint64), m, k, level).reshape(-1))
            byte, bit = at >> 3, (1 << (at & 7)).astype(np.int64)
            cell, first = np.unique(byte, return_index=True)
            yield pa.RecordBatch.from_pydict({"segment": cell // SEGMENT, "cell": (cell % SEGMENT).astype(np.int32), "bits": np.add.reduceat(bit, first).astype(np.int16) if len(first) else bit.astype(np.int16)})

    def segment(group: pa.Table) -> pa.Table:  # at most SEGMENT rows
        whole = np.zeros(SEGMENT, np.uint8)
        whole[group.column("cell").to_numpy()] = group.column("bits").to_numpy().astype(np.uint8)
        return pa.table({"segment": group.column("segment").slice(0, 1), "bits": pa.array([whole.tobytes()], pa.binary())})

    # one exchange serves both steps: a segment has at most SEGMENT cells, and repeats are put together in each batch
    merged = keys.select("hash").mapInArrow(cells, "segment long, cell int, bits short").repartition("segment").groupBy("segment", "cell").agg(F.bit_or("bits").alias("bits"))
    out = np.zeros((m // 8 // SEGMENT + 1) * SEGMENT, np.uint8)
    for row in merged.groupBy("segment").applyInArrow(segment, "segment long, bits binary").collect():
        out[row.segment * SEGMENT : (row.segment + 1) * SEGMENT] = np.frombuffer(row.bits, np.uint8)
    return out[: (m + 7) // 8].copy(), m, k


def asker(df: DataFrame, keys: DataFrame, rate: float = 0.01, max_bytes: int = 32 << 20):
    """A function from a column of hashes to whether they may be among `keys` (hash); None if the filter would exceed max_bytes."""
    n = keys.count()
    if bits_needed(n, rate) > 8 * max_bytes:
        return None
    held = df.sparkSession.sparkContext.broadcast(build(keys, n, rate))

    @F.pandas_udf("boolean")
    def ask(h: pd.Series) -> pd.Series:
        return pd.Series(probe(*held.value, 0, h.to_numpy(np.int64).view(np.uint64)) if len(h) else np.zeros(0, bool))

    return ask


def keep_maybe(df: DataFrame, column: str | Column, keys: DataFrame) -> DataFrame:
    """Rows whose hash may be among `keys` (hash): all that are, and few others. Only prunes; beyond the filter's bound all rows stay."""
    ask = asker(df, keys)
    return df if ask is None else df.where(ask(F.col(column) if isinstance(column, str) else column))
