"""Substring dedup by relative Lempel-Ziv parsing against an index of the whole corpus, in blocks.

The corpus is its own reference. Its stretches around anchors (see `repeats`) are the reference blocks: a block holds
all stretches whose anchors fall into one part of the fingerprints' range. A stretch of a document is routed to the one
block that can hold any of its windows, and is factored greedily against it: from the left, the first window that
the block has elsewhere starts a factor, which goes on as far as any source agrees. Sources are indexed in the order of
their words from the anchor on, so the source that agrees longest is a neighbour among those with the same window. Only factors
of 35 words or more count. After a factor the parse goes on with the first window
that isn't inside it, so the windows across a factor's end are looked up one by one against all sources and none is lost.
Stretches with a whole copy elsewhere are one factor and need no parse.

A word goes if a window of 35 words that covers it also starts anywhere else, in the same document or another.
Windows are judged on the input. Words are compared as 64-bit fingerprints.

Cases: a null text has no words; texts of under 35 words lose nothing; equal rows are copies of each other and lose
all their windows; different texts of one doc_id are documents of their own; rows without doc_id are left out; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .kernel import SPACES, U64, mix, spread, text_bytes, word_bounds, word_hashes
from .repeats import Level, Spec, Windows, _tags, first_of, matrix, repeated, sides_shared

WINDOW, GRAM = 35, 6
LEFT = WINDOW - GRAM
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"
Found = tuple[np.ndarray, np.ndarray, np.ndarray]


def units(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw, at = text_bytes(column)
    starts, ends, first = word_bounds(raw, at, SPACES)
    return word_hashes(raw, starts, ends), first, starts, ends


class Block:
    """Stretches of a part as rows of words, each different one once."""

    def __init__(self, batches: list[Level]):
        read = []
        while batches:
            read.append(self.read(batches.pop()))
        self.rows, self.size, self.lead, self.doc, self.start, many = (np.concatenate(c) for c in zip(*read, strict=True))
        read.clear()
        content = _tags(self.rows, 0, SPEC.width) ^ mix(self.size.astype(U64) << U64(32) | self.lead.astype(U64))
        order = np.lexsort((self.start, self.doc, content))
        new = first_of(content[order])
        head = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
        if not ((self.rows[order] == self.rows[head]).all(1) & (self.size[order] == self.size[head]) & (self.lead[order] == self.lead[head])).all():
            # equal fingerprints of different stretches
            _, name = np.unique(np.column_stack([self.rows, self.size.astype(U64), self.lead.astype(U64)]), axis=0, return_inverse=True)
            order = np.lexsort((self.start, self.doc, name.ravel()))
            new = first_of(name.ravel()[order])
        group = np.cumsum(new) - 1
        copies = np.bincount(group, 1 + many[order].astype(np.int64), int(new.sum()))
        self.one = order[new]  # one of each different stretch
        self.copies = copies.astype(np.int64)
        self.whole = order[(copies > 1)[group] & (many[order] == 0)]  # copies that the sender hasn't settled

    @staticmethod
    def read(x: Level) -> tuple[np.ndarray, ...]:
        """Rows of words, numbers of words, words before the anchor, documents, places, and whether the sender has settled copies."""
        at = np.concatenate([[0], np.cumsum(x["bytes"], dtype=np.int64)])
        starts, ends, first = word_bounds(x["data"], at, SPACES)
        size, lead = np.diff(first), x["lead"].astype(np.int64)
        return matrix(word_hashes(x["data"], starts, ends), size, lead, SPEC), size, lead, x["doc"], x["start"], x["many"]

    def factors(self) -> Iterator[Found]:
        """The greedy parse of stretches without a whole copy."""
        rows, lead, size = self.rows[self.one], self.lead[self.one], self.size[self.one]
        names = np.arange(len(self.one))
        some = np.flatnonzero(sides_shared(rows, lead, size - lead, names, names, SPEC))
        rows, lead, size, one, alone = rows[some], lead[some], size[some], self.one[some], self.copies[some] == 1
        tail = size - lead
        rank = self.lexicographic(rows)
        cursor = lead.copy()  # words before the anchor that the next window to look up has
        for x in range(LEFT, -1, -1):
            own = np.flatnonzero((lead >= x) & (tail >= WINDOW - x))
            asks = alone & (cursor >= x)
            if len(own) < 2 or not asks[own].any():
                continue
            w = Windows(rows, own, x, rank, SPEC)
            place = np.flatnonzero((w.size > 1) & asks[w.own])
            if not len(place):
                continue
            me = w.own[place]
            length = np.zeros(len(me), np.int64)
            for step in (-1, 1):
                other = np.clip(place + step, 0, len(w.own) - 1)
                ok = (w.head[other] == w.head[place]) & (other != place)
                length[ok] = np.maximum(length[ok], self.agree(rows, tail, me[ok], w.own[other[ok]], x))
            yield self.doc[one[me]], self.start[one[me]] + lead[me] - x, length
            cursor[me] = x - (length - WINDOW) - 1

    @staticmethod
    def lexicographic(rows: np.ndarray) -> np.ndarray:
        """The place of each stretch in the order of its words from the anchor on, as a suffix index has them; a shorter one comes first."""
        words = np.ascontiguousarray(rows[:, LEFT:].astype(">u8"))
        order = np.argsort(words.view(f"V{words.shape[1] * 8}").ravel(), kind="stable") if len(rows) else np.zeros(0, np.int64)
        rank = np.empty(len(rows), np.int64)
        rank[order] = np.arange(len(rows))
        return rank

    @staticmethod
    def agree(rows: np.ndarray, tail: np.ndarray, a: np.ndarray, b: np.ndarray, x: int) -> np.ndarray:
        """Words from the window's start on in which stretches agree."""
        most = np.minimum(tail[a], tail[b])
        same = (rows[a, LEFT:] == rows[b, LEFT:]) & (np.arange(WINDOW) < most[:, None])
        return x + np.where(same.all(1), WINDOW, np.argmin(same, axis=1))


def settle(batches: list[Level]) -> Iterator[Found]:
    """All factors of a block."""
    block = Block(batches)
    yield block.doc[block.whole], block.start[block.whole], block.size[block.whole]
    yield from block.factors()


def _finish(doc_id: int, text: bytes, start: np.ndarray, n: np.ndarray) -> tuple:
    raw = np.frombuffer(text, np.uint8)
    starts, ends, _ = word_bounds(raw, np.array([0, len(raw)]), SPACES)
    gone = spread(start, n, len(starts))
    kept = b" ".join([text[i:j] for i, j in zip(starts[~gone].tolist(), ends[~gone].tolist(), strict=True)])
    return doc_id, len(starts), int(gone.sum()), hashlib.sha256(kept).hexdigest()


SPEC = Spec(WINDOW, GRAM, units, False, settle)


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """Words removed from every document; see the module."""
    return repeated(docs, SPEC, "factors", _finish, SCHEMA)
