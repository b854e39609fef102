"""A Bloom filter over 64-bit hashes that executors build and share: a filter of bounded size before an exact join."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U64 = np.uint64
_ODD = np.random.Generator(np.random.PCG64(11)).integers(1, 1 << 63, 4, dtype=np.uint64) * U64(2) + U64(1)
CHUNK = 1 << 13


def _places(h: np.ndarray, log2_bits: int) -> np.ndarray:
    return ((h.astype(U64)[:, None] * _ODD[None, :]) >> U64(64 - log2_bits)).astype(np.int64)


class Bloom:
    def __init__(self, bits: np.ndarray, log2_bits: int):
        self.bits, self.log2_bits = bits, log2_bits

    def __contains__(self, h: int) -> bool:
        return bool(self.may_have(np.array([h], np.int64).view(U64))[0])

    def may_have(self, h: np.ndarray) -> np.ndarray:
        p = _places(h, self.log2_bits)
        return ((self.bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1).all(axis=1)


def bloom(hashes: DataFrame, most_bits: int = 28) -> Bloom:
    """Of the one long column of ``hashes``: ten bits each, at most 2^most_bits (32 MB); beyond that more pass by chance."""
    (column,) = hashes.columns
    n = hashes.count()
    log2_bits = min(most_bits, max(16, int(np.ceil(np.log2(10 * n + 1)))))

    def part(batches):
        bits = np.zeros(1 << (log2_bits - 3), np.uint8)
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(U64)
            p = _places(h, log2_bits).ravel()
            np.bitwise_or.at(bits, p >> 3, np.uint8(1) << (p & 7).astype(np.uint8))
        import pyarrow as pa

        rows = [(i, bits[i * CHUNK : (i + 1) * CHUNK].tobytes()) for i in range(-(-len(bits) // CHUNK)) if bits[i * CHUNK : (i + 1) * CHUNK].any()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["chunk", "bits"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in pdf.bits])
        return pd.DataFrame({"chunk": [pdf.chunk.iloc[0]], "bits": [out.tobytes()]})

    chunks = hashes.select(F.col(column).cast("long")).mapInArrow(part, "chunk int, bits binary").groupBy("chunk").applyInPandas(merge, "chunk int, bits binary")
    bits = np.zeros(1 << (log2_bits - 3), np.uint8)
    for r in chunks.collect():  # at most 2^most_bits bits in all; taken part by part, each part would be a job
        bits[r.chunk * CHUNK : r.chunk * CHUNK + len(r.bits)] = np.frombuffer(r.bits, np.uint8)
    return Bloom(bits, log2_bits)
