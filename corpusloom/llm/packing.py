"""Best-fit packing of tokenised documents into sequences, large items first.

Sizes are integers of at most the capacity, and items of one size are interchangeable. So the plan is made on
the histogram of sizes alone: items above a third of the capacity are matched greedily, the largest first with
the largest that still fits, at most two to a bin; smaller ones go, the largest first, into the tightest gap. The
plan is a list of bin patterns, whose length depends on the capacity and not on the number of documents. A piece
finds its bin from its rank among pieces of its size; ranks come from counts by (size, bucket), so that no group
is large.

Cases: a null or empty text is the end token alone; a text of more than the capacity is cut from the end into
full pieces, the first may be shorter; equal rows are packed each for itself; rows without doc_id are left out; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernel import slices
from .store import Scratch, documents, parts
from .tokens import byte_bpe

CAPACITY = 1024
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bin patterns (number of bins, [(size, items of it in each bin)]) for a histogram of sizes."""
    left = {s: n for s, n in counts.items() if n}
    small = capacity // 3
    gaps: list[list] = [[] for _ in range(capacity + 1)]  # by gap: groups of equal bins

    large = sorted((s for s in left if s > small), reverse=True)
    for a in large:
        while left[a]:
            b = next((x for x in large if x <= min(a, capacity - a) and left[x] > (x == a)), None)
            if b is None:
                gaps[capacity - a].append((left[a], [(a, 1)]))
                left[a] = 0
            elif b == a:
                m = left[a] // 2
                gaps[capacity - 2 * a].append((m, [(a, 2)]))
                left[a] -= 2 * m
            else:
                m = min(left[a], left[b])
                gaps[capacity - a - b].append((m, [(a, 1), (b, 1)]))
                left[a] -= m
                left[b] -= m
    for s in sorted((s for s in left if s <= small), reverse=True):
        n = left[s]
        for gap in range(s, capacity):
            fit = gap // s
            while n and gaps[gap]:
                m, items = gaps[gap].pop()
                full = min(m, n // fit)
                if full:
                    gaps[gap - full * 0 - fit * s].append((full, [*items, (s, fit)]))
                rest = n - full * fit
                if full < m and 0 < rest < fit:
                    gaps[gap - rest * s].append((1, [*items, (s, rest)]))
                    if m - full - 1:
                        gaps[gap].append((m - full - 1, items))
                    rest = 0
                elif full < m:
                    gaps[gap].append((m - full, items))
                n = rest
            if not n:
                break
        if n:
            fit = capacity // s
            if n // fit:
                gaps[capacity - fit * s].append((n // fit, [(s, fit)]))
            if n % fit:
                gaps[capacity - n % fit * s].append((1, [(s, n % fit)]))
    return [group for groups in gaps for group in groups]


def cut(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Token pieces of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = byte_bpe(tokenizer)
        for b in slices(batches, most=1 << 20):
            ids, at = tokens.encode(b.column("text"))
            out: list[list] = [[], [], [], [], []]
            end = np.array([end_id], "<u4")
            for doc, i, j in zip(b.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                own = np.concatenate([ids[i:j], end])
                first = (len(own) - 1) % capacity + 1
                start = 0
                for k, stop in enumerate(range(first, len(own) + 1, capacity)):
                    for column, x in zip(out, (doc, k, start, stop - start, zlib.crc32(own[start:stop].tobytes())), strict=True):
                        column.append(x)
                    start = stop
            yield pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return documents(docs).mapInArrow(run, PIECES)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """Every piece with its sequence and its offset there; see the module."""
    scratch = Scratch(docs.sparkSession, "packing")
    buckets = parts(docs, 4 << 20)
    pieces = scratch.save(cut(docs, tokenizer, end_id, capacity).withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")), "pieces")
    counts = scratch.save(pieces.groupBy("length", "bucket").count(), "counts")
    sizes = {int(r.length): int(r.n) for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most `capacity` rows
    groups = plan(sizes, capacity)

    taken: dict[int, int] = dict.fromkeys(sizes, 0)
    entries: dict[int, list[tuple[int, int, int, int]]] = {s: [] for s in sizes}  # by size: first rank, bins, first sequence, offset
    sequence = 0
    for bins, items in groups:
        offset = 0
        for s, each in items:
            entries[s].append((taken[s], bins, sequence, offset))
            taken[s] += bins * each
            offset += s * each
        sequence += bins
    table = {s: tuple(np.array(x, np.int64) for x in zip(*e, strict=True)) for s, e in entries.items()}

    before = counts.withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("bucket")) - F.col("count")).drop("count")
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("nth", F.row_number().over(order).cast("long") - 1).join(before, ["length", "bucket"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for s in np.unique(length).tolist():
                rows = np.flatnonzero(length == s)
                lo, bins, first, start = table[s]
                g = np.searchsorted(lo, rank[rows], "right") - 1
                r = rank[rows] - lo[g]
                seq[rows] = first[g] + r % bins[g]
                off[rows] = start[g] + r // bins[g] * s
            yield pa.record_batch([*(b.column(i) for i in range(5)), pa.array(seq), pa.array(off)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, PIECES + ", sequence_id long, offset long")
