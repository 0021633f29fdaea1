"""A bit filter of 64-bit keys, built by slices in tasks: says no for surely absent keys, so that few rows need a shuffle."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pileflow.llm.common import mixed

#: Bits a key, the bounds of all bits, and the slices that tasks fill. Beyond the upper bound more rows pass, none is lost.
EACH, LEAST, MOST, SLICES = 12, 1 << 16, 1 << 28, 64
PROBES = 4


@dataclass
class Bloom:
    bits: np.ndarray  # bytes, slice after slice

    def has(self, keys: np.ndarray) -> np.ndarray:
        """Which keys may be in it."""
        at = places(keys, 8 * len(self.bits))
        out = np.ones(len(keys), bool)
        for p in at:
            out &= (self.bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 > 0
        return out


def places(keys: np.ndarray, size: int) -> list[np.ndarray]:
    """All bits of a key lie in one slice."""
    each = np.uint64(size // SLICES)
    h = mixed(keys.astype(np.int64).view(np.uint64))
    base = (h % np.uint64(SLICES)) * each
    step = mixed(h + np.uint64(1)) | np.uint64(1)
    return [(base + ((h >> np.uint64(8)) + np.uint64(i) * step) % each).astype(np.int64) for i in range(PROBES)]


def bloom(keys: DataFrame, count: int) -> Bloom:
    """Of a one-column table of long keys. The driver gets its bits, at most MOST of them whatever the input."""
    size = min(MOST, max(LEAST, 1 << (EACH * max(1, count) - 1).bit_length()))
    key = keys.columns[0]

    def run(batches):
        for b in batches:
            k = b.column(0).to_numpy(zero_copy_only=False)
            home = (mixed(k.astype(np.int64).view(np.uint64)) % np.uint64(SLICES)).astype(np.int32)
            yield pa.record_batch([b.column(0), pa.array(home)], ["key", "slice"])

    def fill(f: pd.DataFrame) -> pd.DataFrame:
        part, each = int(f.slice.iloc[0]), size // SLICES
        on = np.zeros(each, np.uint8)
        for p in places(f.key.to_numpy(), size):
            on[p - part * each] = 1
        return pd.DataFrame({"slice": [part], "bits": [np.packbits(on, bitorder="little").tobytes()]})

    rows = keys.select(F.col(key).alias("key")).distinct().mapInArrow(run, "key long, slice int").groupBy("slice").applyInPandas(fill, "slice int, bits binary").collect()
    bits = np.zeros(size // 8, np.uint8)
    each = size // 8 // SLICES
    for r in rows:
        bits[r.slice * each : (r.slice + 1) * each] = np.frombuffer(r.bits, np.uint8)
    return Bloom(bits)
