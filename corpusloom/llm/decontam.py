"""Benchmark decontamination by a distributed positional inverted index.

The index is a stored table, sharded by documents as large search engines do: a shard has the postings of all words of
some 2 MB of documents, sorted by term, with delta-coded positions. Every phrase (a window of 13 item words, or a shorter item as
a whole) starts from its rarest term in the shard: that term's list, moved by the term's offset, is intersected with the
moved lists of the next rarer terms, until all words agree. `PositionalIndex` answers any number of test sets, and searches by
proximity, from the one stored table; texts are read once. Nothing is shuffled; only the test set travels, in blocks of bounded
size, one at a time.

Cases: null texts have no words; an item without words has no window; equal windows of several items count for
each; each row is judged by its own text, also where rows share a doc_id; further columns are ignored, and kept by keep_clean; rows
without doc_id are left out; with an empty test set nothing is hit; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import SYMBOLS, U64, Rolling, ranges, slices, spread, text_bytes, word_bounds, word_hashes
from .repeats import first_of
from .store import Scratch, documents, pack, unpack, with_bases, with_ids

WINDOW = 13
#: Bytes of test texts that go to the executors at once; a larger test set takes more passes over the index.
BLOCK_BYTES = 2 << 20
SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
HITS = "shard string, place int, doc_id long, base long, n_words long, spans array<binary>, items array<string>"


class Shard:
    """Postings of the words of some documents: terms in order, how often each occurs, and where."""

    def __init__(self, blob: bytes):
        x = unpack(blob)
        self.terms, self.positions = np.cumsum(x["terms"]), np.cumsum(x["positions"], dtype=np.uint32).astype(np.int64)
        self.heads = np.concatenate([[0], np.cumsum(x["counts"], dtype=np.int64)])
        self.ids, self.bases = x["ids"], x["bases"]
        #: The first word of each document, and one past the last.
        self.first = np.concatenate([[0], np.cumsum(x["words"])])

    @staticmethod
    def write(b: pa.RecordBatch) -> bytes:
        raw, at = text_bytes(b.column("text"))
        starts, ends, first = word_bounds(raw, at, SYMBOLS)
        words = word_hashes(raw, starts, ends, lower=True)
        order = np.argsort(words, kind="stable")
        new = first_of(words[order])
        terms = words[order][new]
        counts = np.diff(np.append(np.flatnonzero(new), len(words)))
        return pack(terms=np.diff(terms, prepend=U64(0)), counts=counts.astype(np.uint32), positions=np.diff(order.astype(np.uint32), prepend=np.uint32(0)), ids=b.column("doc_id").to_numpy(), bases=b.column("base").to_numpy(), words=np.diff(first))

    def of(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Postings of some sorted terms, one list after the other, and where each begins (one more entry at the end)."""
        at = np.minimum(np.searchsorted(self.terms, wanted), max(len(self.terms) - 1, 0))
        n = np.where(self.terms[at] == wanted, np.diff(self.heads)[at], 0) if len(self.terms) else np.zeros(len(wanted), np.int64)
        lists = self.positions[ranges(self.heads[at], n)] if n.any() else np.zeros(0, np.int64)
        return lists, np.concatenate([[0], np.cumsum(n)])


class Phrases:
    """Distinct windows of a block of test items: terms of each, and the items that hold it."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        self.names = [str(i) for i, _ in items]
        raw, at = text_bytes(pa.array([t for _, t in items], pa.string()))
        starts, ends, first = word_bounds(raw, at, SYMBOLS)
        words = word_hashes(raw, starts, ends, lower=True)
        rolling = Rolling(words)
        counts = np.diff(first)
        lengths = np.minimum(counts, window)
        windows = np.maximum(counts - window + 1, np.minimum(counts, 1))
        item = np.repeat(np.arange(len(items)), windows)
        begin = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(first[:-1], windows)
        length = np.repeat(lengths, windows)
        tags = rolling.of(begin, begin + length)
        _, one, self.of_window = np.unique(tags, return_index=True, return_inverse=True)
        self.item = item
        self.length = length[one]
        self.vocabulary = np.unique(words)
        self.terms = np.full((len(one), window), -1, np.int32)
        for j in range(window):
            rows = np.flatnonzero(self.length > j)
            self.terms[rows, j] = np.searchsorted(self.vocabulary, words[begin[one[rows]] + j])

    def find(self, shard: Shard) -> tuple[np.ndarray, np.ndarray]:
        """Places at which windows occur in the words of a shard, and the windows."""
        none = np.zeros(0, np.int64)
        n_words = int(shard.first[-1])
        if not n_words or not len(self.length):
            return none, none
        position, heads = shard.of(self.vocabulary)
        sizes = np.append(np.diff(heads), np.iinfo(np.int64).max)  # the last stands for "no term"
        live = np.flatnonzero(sizes[self.terms].min(axis=1) > 0)
        if not len(live):
            return none, none
        rarity = np.argsort(sizes[self.terms[live]], axis=1, kind="stable")
        seed = self.terms[live, rarity[:, 0]]
        n = np.diff(heads)[seed]
        row = np.repeat(np.arange(len(live)), n)
        start = position[ranges(heads[seed], n)] - rarity[row, 0]
        keep = (start >= 0) & (start + self.length[live[row]] <= n_words)
        start, row = start[keep], row[keep]
        postings = np.repeat(np.arange(len(heads) - 1), np.diff(heads)) * n_words + position  # sorted by term and place
        for k in range(1, self.terms.shape[1]):
            if not len(start):
                break
            offset = rarity[row, k]
            term = self.terms[live[row], offset].astype(np.int64)
            want = term * n_words + start + offset
            keep = (term < 0) | (postings[np.minimum(np.searchsorted(postings, want), len(postings) - 1)] == want)
            start, row = start[keep], row[keep]
        return start, live[row]


def digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def phrase_blocks(benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> Iterator[Phrases]:
    """The test set's windows in blocks of bounded size, one in memory at a time."""
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text"))
    block, held, some = [], 0, False
    for row in items.toLocalIterator():
        block.append((row.item_id, row.text))
        held += len(row.text or "")
        if held >= block_bytes:
            yield Phrases(block, window)
            block, held, some = [], 0, True
    if block or not some:
        yield Phrases(block, window)


class PositionalIndex:
    """The stored index of a table of documents."""

    def __init__(self, docs: DataFrame):
        self.spark = docs.sparkSession
        self.scratch = Scratch(self.spark, "postings")
        self.docs, self.twice = with_bases(documents(docs), self.scratch)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                yield pa.record_batch([pa.array([uuid.uuid4().hex]), pa.array([Shard.write(b)], pa.binary())], names=["shard", "blob"])

        self.shards = self.scratch.save(self.docs.mapInArrow(run, "shard string, blob binary"), "index")

    def hits(self, phrases: Phrases) -> DataFrame:
        """For each document its words, and the stretches and items of the windows in it."""
        shared = self.spark.sparkContext.broadcast(phrases)  # a block of the test set: BLOCK_BYTES of text

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for b in batches:
                for name, blob in zip(b.column("shard").to_pylist(), b.column("blob"), strict=True):
                    yield _hits(name, Shard(blob.as_py()), own)

        return self.shards.mapInArrow(run, HITS)

    def contaminated(self, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
        """Hit words and items of every document; see the module."""
        blocks = phrase_blocks(benchmark, window, block_bytes)
        found, following = self.hits(next(blocks)), next(blocks, None)
        if following is None:
            return found.mapInArrow(_finish, f"{SCHEMA}, base long")
        every, k = self.scratch.save(found, "hits0"), 1
        while following is not None:  # a pass for each block, so that one is held at a time
            every = every.unionByName(self.scratch.save(self.hits(following), f"hits{k}"))
            following, k = next(blocks, None), k + 1
        merged = every.groupBy("shard", "place", "doc_id", "base", "n_words").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
        return merged.mapInArrow(_finish, f"{SCHEMA}, base long")

    def proximity(self, terms: list[str], span: int) -> DataFrame:
        """Documents in which all terms stand within `span` consecutive words, with each such stretch's first word and length.

        Terms are lower-cased words; of stretches that end at the same word the shortest counts.
        """
        raw, at = text_bytes(pa.array(terms, pa.string()))
        starts, ends, _ = word_bounds(raw, at, SYMBOLS)
        wanted = np.unique(word_hashes(raw, starts, ends, lower=True))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for blob in b.column("blob"):
                    shard = Shard(blob.as_py())
                    places, heads = shard.of(wanted)
                    if not len(wanted) or not np.diff(heads).all():
                        continue
                    stop = np.unique(places)
                    begin = stop.copy()
                    ok = np.ones(len(stop), bool)
                    for i, j in zip(heads[:-1].tolist(), heads[1:].tolist(), strict=True):  # the last place of each term up to the stretch's end
                        k = np.searchsorted(places[i:j], stop, "right") - 1
                        ok &= k >= 0
                        begin = np.minimum(begin, places[i:j][np.maximum(k, 0)])
                    doc = np.searchsorted(shard.first, begin, "right") - 1
                    ok &= (stop < shard.first[doc + 1]) & (stop - begin < span)
                    yield pa.record_batch([pa.array(shard.ids[doc[ok]]), pa.array(begin[ok] - shard.first[doc[ok]]), pa.array((stop - begin + 1)[ok])], names=["doc_id", "start", "length"])

        return self.shards.mapInArrow(run, "doc_id long, start long, length long")


def _hits(name: str, shard: Shard, phrases: Phrases) -> pa.RecordBatch:
    start, found = phrases.find(shard)
    doc = np.searchsorted(shard.first, start, "right") - 1
    inside = start + phrases.length[found] <= shard.first[doc + 1]
    start, found, doc = start[inside], found[inside], doc[inside]
    n = len(shard.ids)
    spans: list[list[bytes]] = [[] for _ in range(n)]
    items: list[list[str]] = [[] for _ in range(n)]
    order = np.argsort(doc, kind="stable")
    new = np.flatnonzero(first_of(doc[order])).tolist()
    for i, j in zip(new, [*new[1:], len(order)], strict=False):
        own = order[i:j]
        d = int(doc[own[0]])
        spans[d] = [pack(start=start[own] - shard.first[d], length=phrases.length[found[own]])]
        items[d] = [phrases.names[k] for k in np.unique(phrases.item[np.isin(phrases.of_window, found[own])])]
    columns = [pa.array([name] * n), pa.array(np.arange(n, dtype=np.int32)), pa.array(shard.ids), pa.array(shard.bases), pa.array(np.diff(shard.first)), pa.array(spans, pa.list_(pa.binary())), pa.array(items, pa.list_(pa.string()))]
    return pa.record_batch(columns, names=[c.split()[0] for c in HITS.split(", ")])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n_words = b.column("n_words").to_numpy()
        n_hit = np.zeros(len(n_words), np.int64)
        n_items, sums = [], []
        for i, (spans, items) in enumerate(zip(b.column("spans").to_pylist(), b.column("items").to_pylist(), strict=True)):
            if spans:
                got = [unpack(x) for x in spans]
                n_hit[i] = spread(np.concatenate([g["start"] for g in got]), np.concatenate([g["length"] for g in got]), int(n_words[i])).sum()
            unique = set(items)
            n_items.append(len(unique))
            sums.append(digest(list(unique)))
        yield pa.record_batch(
            [b.column("doc_id"), b.column("n_words"), pa.array(n_hit), pa.array(n_items, pa.int64()), pa.array(sums), pa.array((n_hit > 0) & (20 * n_hit >= n_words)), b.column("base")],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "base"],
        )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Hit words and items of every document; contaminated where at least one in twenty words is hit."""
    return PositionalIndex(docs).contaminated(benchmark, window, block_bytes).drop("base")


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents, with all their columns, that aren't contaminated."""
    index = PositionalIndex(docs)
    gone = index.scratch.save(index.contaminated(benchmark, window, block_bytes).where("contaminated").select("doc_id", "base").distinct(), "gone")
    own = docs.where("doc_id is not null")
    if not index.twice:
        return with_ids(own, gone.select("doc_id"), "left_anti").select(*docs.columns)
    named, _ = with_bases(own.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*docs.columns).alias("row")), index.scratch)
    return named.join(gone, ["doc_id", "base"], "left_anti").select("row.*")
