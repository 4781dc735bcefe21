"""How often values occur in a whole table, in a table of counters of fixed size.

A value's rank is the count of its slot. Values that share a slot share a rank, which is as good: an order of rarity
needs to be one order for all, and only its quality depends on the counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .kernel import U64, mix
from .store import Scratch, pack, unpack

SLOT_BITS = 21
SLICES = 64


class Rarity:
    """Levels of counts: eight for each doubling."""

    def __init__(self, levels: np.ndarray):
        self.levels = levels

    def of(self, values: np.ndarray) -> np.ndarray:
        return self.levels[slots(values)]


def slots(values: np.ndarray) -> np.ndarray:
    return (mix(values ^ U64(0x5851F42D4C957F2D)) >> U64(64 - SLOT_BITS)).astype(np.int64)


def send(counts: np.ndarray) -> pa.RecordBatch:
    each = counts.reshape(SLICES, -1)
    return pa.record_batch([pa.array(range(SLICES), pa.int32()), pa.array([0] * SLICES, pa.int32()), pa.array([pack(c=c) for c in each], pa.binary())], names=["part", "kind", "blob"])


def gather(counted: DataFrame, scratch: Scratch) -> Rarity:
    """Add the counters of all tasks; the sum, 2**SLOT_BITS numbers whatever the input, goes to the driver."""
    from .repeats import BLOBS, grouped

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in grouped(batches):
            total = None
            for r in rows:
                c = unpack(r["blob"])["c"].astype(np.int64)
                total = c if total is None else total + c
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([0], pa.int32()), pa.array([pack(c=total)], pa.binary())], names=["part", "kind", "blob"])

    rows = counted.repartition(SLICES, "part").sortWithinPartitions("part").mapInArrow(run, BLOBS).collect()
    out = np.zeros((SLICES, (1 << SLOT_BITS) // SLICES), np.int64)
    for r in rows:
        out[r.part] = unpack(r.blob)["c"]
    return Rarity(np.minimum(np.log2(out.ravel() + 1) * 8, 255).astype(np.uint8))
