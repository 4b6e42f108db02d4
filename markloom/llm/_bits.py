"""Bitmaps of a fixed size over 64-bit keys: what they pick holds every key, and may hold chance others."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

BITS, SLOT_BITS = 26, 20


def bitmap(rows: DataFrame) -> np.ndarray:
    """Bits at the lowest BITS of the keys in the first column; slots are merged map by map, so that no task holds more than two bodies."""

    def some(batches):
        got = np.zeros(1 << BITS >> 3, np.uint8)
        for batch in batches:
            at = batch.column(0).to_numpy() & ((1 << BITS) - 1)
            np.bitwise_or.at(got, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        parts = got.reshape(-1, 1 << SLOT_BITS)
        hit = [i for i in range(len(parts)) if parts[i].any()]
        yield pa.RecordBatch.from_pydict({"slot": pa.array(hit, pa.int64()), "body": pa.array([zstandard.compress(parts[i].tobytes(), 1) for i in hit], pa.binary())})

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for slot, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(zstandard.decompress(body), np.uint8)
                held[slot] = held[slot] | part if slot in held else part
        yield pa.RecordBatch.from_pydict({"slot": pa.array(list(held), pa.int64()), "body": pa.array([zstandard.compress(p.tobytes(), 1) for p in held.values()], pa.binary())})

    out = np.zeros((1 << BITS >> 3 >> SLOT_BITS, 1 << SLOT_BITS), np.uint8)
    for slot, body in rows.mapInArrow(some, "slot long, body binary").repartition(len(out), "slot").mapInArrow(add, "slot long, body binary").collect():
        out[slot] |= np.frombuffer(zstandard.decompress(bytes(body)), np.uint8)
    return out.ravel()


def picked(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    at = key & ((1 << BITS) - 1)
    return bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0
