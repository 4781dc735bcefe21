"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is cut into quantile bins. Cyclic boosting visits the features in turn; a shallow tree on
the bins (at most three leaves) is fitted to the gradient and added, shrunk, to the feature's lookup table. The
pairs that reduce the remaining loss most then get tables of their own, boosted in the same cycle with a cut on each
side. A score is the sum of looked-up entries, added for all rows of a batch at once.

The fit uses a bounded sample of labelled rows, `SAMPLE`, chosen by a hash of doc_id among rows that are not held
out; the features see the text alone. Everything else covers every document.

Cases: a null text is scored as an empty one; documents without a label, with a null label or held out are scored
but never fitted; of several labels for an id the largest counts, of several texts for an id one is fitted; labels of absent documents don't count; without any label, or with labels of one class
only, the score is the class's share (0.5 without labels); rows without doc_id are left out; equal rows get equal
scores; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernel import SPACES, slices, text_bytes, word_bounds, word_hashes
from .store import Scratch, documents

#: Most labelled rows that a fit uses.
SAMPLE = 20_000
BINS, ROUNDS, RATE, PAIRS, PAIR_BINS = 32, 120, 0.15, 8, 8
FEATURES = [
    "bytes", "words", "word_length", "upper", "digits", "marks", "symbols", "exclamations", "bars", "lines", "line_length",
    "not_ascii", "different_words", "upper_words", "marked_words", "short_words", "long_words", "longest_word", "commas", "stops", "spaces", "top_byte",
]
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def _class(*spans: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in spans:
        out[a:b] = True
    return out


UPPER, DIGIT = _class((0x41, 0x5B)), _class((0x30, 0x3A))
MARKS = _class((0x21, 0x30), (0x3A, 0x41), (0x5B, 0x61), (0x7B, 0x7F))
SYMBOL = MARKS & ~np.isin(np.arange(256), [ord(c) for c in "!,.;:?'\"()-"])
ONE = {name: np.arange(256) == ord(c) for name, c in (("!", "!"), ("|", "|"), ("\n", "\n"), (",", ","), (".", "."))}
HIGH = _class((0x80, 0x100))


def features(column: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text, in the one precision that fits and scores use."""
    raw, at = text_bytes(column)
    n = len(at) - 1
    starts, ends, first = word_bounds(raw, at, SPACES)
    size, words = np.diff(at), np.diff(first)
    per_byte, per_word = np.maximum(size, 1), np.maximum(words, 1)

    def share(table: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(table[raw], dtype=np.int64)])
        return (total[at[1:]] - total[at[:-1]]) / per_byte

    def of_words(flag: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
        return (total[first[1:]] - total[first[:-1]]) / per_word

    length = ends - starts
    longest = np.zeros(n)
    some = np.flatnonzero(words > 0)
    if len(some):
        longest[some] = np.maximum.reduceat(length, first[some])
    row = np.repeat(np.arange(n), words)
    tags = word_hashes(raw, starts, ends)
    order = np.lexsort((tags, row))
    new = np.ones(len(tags), bool)
    new[1:] = (tags[order][1:] != tags[order][:-1]) | (row[order][1:] != row[order][:-1])
    different = np.bincount(row[order][new], minlength=n) / per_word
    head, tail = (raw[starts], raw[ends - 1]) if len(starts) else (raw[:0], raw[:0])
    lines = share(ONE["\n"])
    marks = share(MARKS)
    return np.column_stack([
        np.log1p(size), np.log1p(words), of_words(length), share(UPPER), share(DIGIT), marks, share(SYMBOL), share(ONE["!"]), share(ONE["|"]),
        lines, np.log1p(size / (lines * size + 1)), share(HIGH), different, of_words(UPPER[head] & UPPER[tail] | UPPER[head] & MARKS[tail]), of_words(MARKS[tail]),
        of_words(length <= 3), of_words(length >= 12), np.log1p(longest), share(ONE[","]), share(ONE["."]), share(SPACES), marks - share(ONE[","]) - share(ONE["."]),
    ]).astype(np.float32)


class Model:
    """Bin edges, a table for each feature and each chosen pair, and the intercept."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        share = float(y.mean()) if len(y) else 0.5
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) if len(y) else np.zeros(0) for c in x.T]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: list[tuple[int, int]] = []
        self.pair_tables: list[np.ndarray] = []
        self.fixed = share if len(np.unique(y)) < 2 else None
        if self.fixed is not None:
            return
        self.base = float(np.log(share / (1 - share)))
        bins = self.bins(x)
        total = np.full(len(y), self.base)
        for _ in range(ROUNDS):
            for j, table in enumerate(self.tables):
                p = 1 / (1 + np.exp(-total))
                step = RATE * _tree(np.bincount(bins[:, j], y - p, len(table)), np.bincount(bins[:, j], p * (1 - p), len(table)), 3)
                table += step
                total += step[bins[:, j]]
        coarse = self.coarse(bins)
        p = 1 / (1 + np.exp(-total))
        gain = [(_pair_tree(coarse[:, a], coarse[:, b], y - p, p * (1 - p))[1], a, b) for a, b in combinations(range(x.shape[1]), 2)]
        self.pairs = [(a, b) for _, a, b in sorted(gain, key=lambda g: (-g[0], g[1], g[2]))[:PAIRS]]
        self.pair_tables = [np.zeros((PAIR_BINS, PAIR_BINS)) for _ in self.pairs]
        for _ in range(ROUNDS // 2):
            for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
                p = 1 / (1 + np.exp(-total))
                step = RATE * _pair_tree(coarse[:, a], coarse[:, b], y - p, p * (1 - p))[0]
                table += step
                total += step[coarse[:, a], coarse[:, b]]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T, strict=True)])

    def coarse(self, bins: np.ndarray) -> np.ndarray:
        return bins * PAIR_BINS // np.array([len(e) + 1 for e in self.edges])

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.fixed is not None:
            return np.full(len(x), self.fixed)
        bins = self.bins(x)
        coarse = self.coarse(bins)
        total = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            total += table[bins[:, j]]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[coarse[:, a], coarse[:, b]]
        return 1 / (1 + np.exp(-total))


def _tree(gradient: np.ndarray, hessian: np.ndarray, leaves: int) -> np.ndarray:
    """A tree on ordered bins, grown leaf by leaf at the cut of greatest gain; the value of each bin."""
    out = np.zeros(len(gradient))
    spans = [(0, len(gradient))]
    g, h = np.concatenate([[0], np.cumsum(gradient)]), np.concatenate([[0], np.cumsum(hessian)])
    for _ in range(leaves - 1):
        best = (1e-9, 0, 0)
        for k, (a, b) in enumerate(spans):
            if b - a > 1:
                c = np.arange(a + 1, b)
                gain = (g[c] - g[a]) ** 2 / (h[c] - h[a] + 1) + (g[b] - g[c]) ** 2 / (h[b] - h[c] + 1) - (g[b] - g[a]) ** 2 / (h[b] - h[a] + 1)
                i = int(np.argmax(gain))
                best = max(best, (float(gain[i]), k, a + 1 + i))
        if not best[2]:
            break
        a, b = spans.pop(best[1])
        spans += [(a, best[2]), (best[2], b)]
    for a, b in spans:
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + 1)
    return out


def _pair_tree(a: np.ndarray, b: np.ndarray, gradient: np.ndarray, hessian: np.ndarray) -> tuple[np.ndarray, float]:
    """The best cut of each side crossed: a table with four leaves, and its gain."""
    cell = a * PAIR_BINS + b
    g = np.bincount(cell, gradient, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)
    h = np.bincount(cell, hessian, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)
    gs, hs = (np.pad(m, ((1, 0), (1, 0))).cumsum(0).cumsum(1) for m in (g, h))
    i, j = np.meshgrid(np.arange(1, PAIR_BINS), np.arange(1, PAIR_BINS), indexing="ij")
    quarters = [lambda m: m[i, j], lambda m: m[i, -1][..., :] - m[i, j], lambda m: m[-1, j] - m[i, j], lambda m: m[-1, -1] - m[i, -1] - m[-1, j] + m[i, j]]
    gain = sum(q(gs) ** 2 / (q(hs) + 1) for q in quarters)
    x, y = np.unravel_index(int(np.argmax(gain)), gain.shape)
    table = np.zeros((PAIR_BINS, PAIR_BINS))
    value = [q(gs)[x, y] / (q(hs)[x, y] + 1) for q in quarters]
    x, y = x + 1, y + 1
    table[:x, :y], table[:x, y:], table[x:, :y], table[x:, y:] = value
    return table, float(gain.max())


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def _measured(docs: DataFrame, *others: str) -> DataFrame:
    """FEATURES of every document, with other columns passed through."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in others), "x array<float>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = features(b.column("text"))
            yield pa.record_batch([*(b.column(c) for c in others), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))], names=[*others, "x"])

    return docs.mapInArrow(run, schema)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), len(FEATURES))


def chosen(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, y) of at most `sample` labelled documents that are not held out; labels without a document don't count."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("doc_id is not null and y is not null")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    return known.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)


def fit(measured: DataFrame, few: DataFrame) -> Model:
    """A model from the chosen rows, at most SAMPLE; measured has doc_id and x. Of several texts of an id one counts, the least by its features."""
    rows = measured.join(F.broadcast(few), "doc_id").groupBy("doc_id", "y").agg(F.min("x").alias("x")).toArrow()
    rows = rows.sort_by("doc_id").combine_chunks()
    x = _matrix(rows.column("x").combine_chunks()) if rows.num_rows else np.zeros((0, len(FEATURES)), np.float32)
    return Model(x, rows.column("y").to_numpy().astype(np.float64))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Score and class of every document; see the module."""
    scratch = Scratch(docs.sparkSession, "quality")
    measured = scratch.save(_measured(documents(docs), "doc_id"), "features")
    model = fit(measured, scratch.save(chosen(measured, labels, sample), "chosen"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = model.score(_matrix(b.column("x"))) if b.num_rows else np.zeros(0)
            yield pa.record_batch([b.column("doc_id"), b.column("held_out"), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return measured.withColumn("held_out", held_out(F.col("doc_id"))).mapInArrow(run, SCHEMA)


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, least: float = 0.5) -> DataFrame:
    """The documents, with all their columns, whose score is `least` or more: one pass over the labelled ones, one over all."""
    own = documents(docs)
    scratch = Scratch(docs.sparkSession, "quality")
    few = scratch.save(chosen(own, labels, sample), "chosen")
    model = fit(scratch.save(_measured(own.join(F.broadcast(few.select("doc_id")), "doc_id", "left_semi"), "doc_id"), "features"), few)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield b.filter(pa.array(model.score(features(b.column("text"))) >= least))

    return docs.where("doc_id is not null").mapInArrow(run, docs.schema)
