"""Sharding: a keyed Feistel permutation of global row numbers, with cycle walking.

A document's number is its place in the order (doc_id, size, text_crc32), nulls first. The permutation is a
bijection of 0..n-1, so shard and slot follow from the number alone: place p goes to shard p mod S, slot p div S.
Shards therefore differ by one row at most (law `rows`), slots have no gaps, and nothing is kept per document.

Cases: a null text has size 8 and CRC 0; rows with a null doc_id are placed like all others; equal rows get
different places; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import U64, mix
from .store import Scratch

ROUNDS = 6
SCHEMA = "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int"


def feistel(x: np.ndarray, n: int, seed: int, rounds: int = ROUNDS) -> np.ndarray:
    """The place of each row number below n: a Feistel network over the next even power of two, walked until below n."""
    half = max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
    mask, keys = U64((1 << half) - 1), mix(np.arange(rounds, dtype=U64) + U64(seed * 0x9E3779B97F4A7C15 % (1 << 64)))

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> U64(half), v & mask
        for key in keys:
            left, right = right, left ^ (mix(right + key) & mask)
        return left << U64(half) | right

    out = once(x.astype(U64))
    while len(outside := np.flatnonzero(out >= U64(n))):
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def shard_rows(docs: DataFrame, shards: int = 24, seed: int = 17) -> DataFrame:
    """Shard and slot of every document; see the module for the law and the cases."""
    text = F.col("text").cast("string")
    light = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
    )
    scratch = Scratch(docs.sparkSession, "shards")
    rows = scratch.save(light.orderBy("doc_id", "size", "text_crc32").withColumn("at", F.monotonically_increasing_id()), "rows")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    counts = sorted((r.part, r.n) for r in rows.groupBy(part.alias("part")).agg((F.max(place) + 1).alias("n")).collect())  # a row for each partition
    known = np.array([p for p, _ in counts], np.int64)
    before = np.cumsum([0, *(n for _, n in counts)])
    total = int(before[-1])

    def place_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column("at").to_numpy()
            number = before[np.searchsorted(known, at >> 33)] + (at & ((1 << 33) - 1))
            spot = feistel(number, total, seed)
            n = len(at)
            yield pa.record_batch(
                [b.column("doc_id"), b.column("size"), b.column("text_crc32"), pa.array(["rows"] * n, pa.string()), pa.array((spot % shards).astype(np.int32)), pa.array(spot // shards), pa.nulls(n, pa.int32())],
                names=["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
            )

    return rows.mapInArrow(place_rows, SCHEMA)
