"""Suffix-array dedup: a logarithmic family of sparse suffix arrays over the corpus' bytes.

A suffix is indexed where it is the anchor of a 50-byte window (see `repeats`), which every window has exactly one
of; so no match of 50 bytes is lost though one suffix in about 20 is kept. An entry holds the bytes that windows of its
anchor reach, 50 from the anchor on and 38 before it, and arrays are in byte order of the suffix, then of what stands
before it, read backwards.

The key range is cut into parts; each keeps a family of levels. A new batch of suffixes is sorted into an array and
merge-scanned against every level: an entry that a smaller document has in a level is a match of its whole stretch
and is done. The rest becomes a level, and levels of equal size merge, so that a suffix is merged a logarithmic number of
times. Where a merge brings together equal entries, those of the larger documents are done. So batches may come in any
order of doc_id.

Matches that end inside a stretch show as neighbours whose common bytes before and after the anchor make 50 or more.
They are taken from the merged level at the end, window by window, compared byte by byte.

A byte goes if a 50-byte string that covers it also starts in a document with a smaller doc_id. Strings are judged
on the input.

Cases: a null text is empty; texts of under 50 bytes lose nothing; a string that comes twice in one document only
stays; equal rows (of one doc_id), and different texts of one doc_id, are not smaller than one another; each row is judged by
its own text; rows without doc_id are left out; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .kernel import spread, text_bytes
from .repeats import Level, Spec, Windows, first_of, matrix, repeated, sides_shared

WINDOW, GRAM = 50, 12
LEFT = WINDOW - GRAM
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
Found = tuple[np.ndarray, np.ndarray, np.ndarray]


def sorted_batch(batch: Level) -> Level:
    """A suffix array of a batch: keys in byte order, and document, place, and bytes before and from the anchor of each entry."""
    size, lead = batch["bytes"].astype(np.int64), batch["lead"].astype(np.int64)
    rows = matrix(batch["data"], size, lead, SPEC)
    key = np.empty((len(size), SPEC.width + 2), np.uint8)
    key[:, :WINDOW] = rows[:, LEFT:]
    key[:, WINDOW] = size - lead + 1  # lengths tell bytes that are 0 from bytes that aren't there
    key[:, WINDOW + 1 : -1] = rows[:, LEFT - 1 :: -1] if LEFT else rows[:, :0]
    key[:, -1] = lead + 1
    key = key.reshape(-1).view(f"S{SPEC.width + 2}")
    order = np.argsort(key, kind="stable")
    return {"key": key[order], "doc": batch["doc"][order], "start": batch["start"][order]}


def _sizes(level: Level) -> tuple[np.ndarray, np.ndarray]:
    """Bytes from each entry's anchor on, and before it."""
    raw = level["key"].view(np.uint8).reshape(-1, SPEC.width + 2)
    return raw[:, WINDOW].astype(np.int64) - 1, raw[:, -1].astype(np.int64) - 1


def whole(level: Level, which: np.ndarray) -> Found:
    """The stretches of some entries, as covered."""
    tail, lead = _sizes(level)
    return level["doc"][which], level["start"][which], (tail + lead)[which]


class Family:
    """Levels of sorted suffixes; sizes fall by half or more. Of equal entries those of the smallest document are kept."""

    def __init__(self) -> None:
        self.levels: list[Level] = []

    @staticmethod
    def merge(a: Level, b: Level) -> tuple[Level, Found]:
        """Two sorted levels as one, and the entries that a smaller document of the other has too."""
        at = np.searchsorted(a["key"], b["key"], "right") + np.arange(len(b["key"]))
        mine = np.ones(len(a["key"]) + len(b["key"]), bool)
        mine[at] = False
        x = {}
        for k in a:
            x[k] = np.empty(len(mine), a[k].dtype)
            x[k][mine], x[k][at] = a[k], b[k]
        new = first_of(x["key"])
        least = np.minimum.reduceat(x["doc"], np.flatnonzero(new))[np.cumsum(new) - 1]
        gone = x["doc"] > least
        return {k: v[~gone] for k, v in x.items()}, whole(x, gone)

    def scan(self, batch: Level) -> np.ndarray:
        """Entries of a sorted batch that a smaller document has in some level."""
        out = np.zeros(len(batch["key"]), bool)
        for level in self.levels:
            at = np.minimum(np.searchsorted(level["key"], batch["key"]), len(level["key"]) - 1)
            out |= (level["key"][at] == batch["key"]) & (level["doc"][at] < batch["doc"])
        return out

    def add(self, batch: Level) -> Iterator[Found]:
        """Scan a sorted batch against the levels, put in what no smaller document has, and merge levels while the last two are of about equal size."""
        done = self.scan(batch)
        yield whole(batch, done)
        if done.all():
            return
        self.levels.append({k: v[~done] for k, v in batch.items()})
        while len(self.levels) > 1 and len(self.levels[-2]["key"]) < 2 * len(self.levels[-1]["key"]):
            yield self.fold()

    def fold(self) -> Found:
        b, a = self.levels.pop(), self.levels.pop()
        level, gone = self.merge(a, b)
        self.levels.append(level)
        return gone


def ends(level: Level) -> Iterator[Found]:
    """Windows of 50 bytes that a smaller document has, of entries whose whole stretch no smaller document has."""
    tail, lead = _sizes(level)
    raw = level["key"].view(np.uint8).reshape(-1, SPEC.width + 2)
    rows = np.concatenate([raw[:, -2:WINDOW:-1], raw[:, :WINDOW]], axis=1)
    some = np.flatnonzero(sides_shared(rows, lead, tail, level["doc"], level["doc"], SPEC))
    rows, lead, tail, doc, start = rows[some], lead[some], tail[some], level["doc"][some], level["start"][some]
    hit = np.zeros((len(some), LEFT + 2), np.int8)  # by the window's bytes before the anchor
    for x in range(LEFT + 1):
        own = np.flatnonzero((lead >= x) & (tail >= WINDOW - x))
        if len(own) < 2:
            continue
        w = Windows(rows, own, x, doc, SPEC)
        hit[w.own[doc[w.own] > doc[w.own[w.head]]], x] = 1
    # Neighbouring windows of one entry are one stretch: from the one that starts first, with most bytes before the anchor.
    edge = np.diff(hit, axis=1, prepend=0)
    r, low = np.nonzero(edge == 1)
    _, high = np.nonzero(edge == -1)
    yield doc[r], start[r] + lead[r] - (high - 1), WINDOW + high - 1 - low


def settle(batches: list[Level]) -> Iterator[Found]:
    """All that the family of a part finds covered."""
    family = Family()
    while batches:
        yield from family.add(sorted_batch(batches.pop()))
    while len(family.levels) > 1:
        yield family.fold()
    if family.levels:
        yield from ends(family.levels[0])


def units(column: pa.Array) -> tuple[np.ndarray, np.ndarray, None, None]:
    return *text_bytes(column), None, None


def _finish(doc_id: int, text: bytes, start: np.ndarray, n: np.ndarray) -> tuple:
    if not len(start):
        return doc_id, len(text), 0, 0, hashlib.sha256(text).hexdigest()
    gone = spread(start, n, len(text))
    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
    return doc_id, len(text), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()


SPEC = Spec(WINDOW, GRAM, units, True, settle)


def dedup_bytes(docs: DataFrame) -> DataFrame:
    """Bytes removed from every document; see the module."""
    return repeated(docs, SPEC, "suffixes", _finish, SCHEMA)
