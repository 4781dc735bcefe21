"""Near-dedup by bottom-k sketches from one hash function.

A document's set is its distinct shingles, each as a 64-bit fingerprint; its sketch is the k smallest. Documents
with equal sets are one class. Inverted lists of the retained values give each value's exact count; sets that are
similar enough share so many retained values that they meet in a list of their rarest ones (prefix filter), and a set
with too many values of its own meets nobody. In a list, pairs are held against their sizes and 1024-bit parity
signatures, which bound the difference of two sets from below. The overlap of a pair's stored sketches, counted within
the sketch of their union, then estimates its similarity and drops pairs that are clearly below, before any text is read; the
rest are compared on their full sets, made again from their texts.

Lists of any length are settled exactly: each member is first compared with the first few that pass; after
components are known, all pairs of a list that lie in different components and pass, and only those, are
compared. So a group of m copies costs a few comparisons for each member and not m squared.

The sketch's size bounds the chance to miss a pair that is similar enough: MISS, at the threshold itself.

Cases: null and empty texts, and texts without words, have an empty set and are linked with nothing; a text of
fewer words than a shingle is one shingle; equal rows are copies; of rows with one doc_id and different texts all
are linked through the id; rows without doc_id are left out; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .kernel import SPACES, U64, grams, mix, slices, text_bytes, word_bounds, word_hashes
from .repeats import BLOBS, buckets_of, by_part, first_of, grouped, stretches
from .store import Scratch, documents, join_packed, pack, parts, table_rows, with_bases, with_ids

MISS = 1e-8
#: Members of a list that each one is compared with in the first round.
FIRST = 3
#: 64-bit words of a parity signature.
WORDS = 16
#: Entries that a task holds before it sends them.
HELD = 1 << 20
VALUES, META, SHARED, ROOTS, ENTRIES = 0, 1, 2, 3, 4


@dataclass(frozen=True)
class Similarity:
    """Linked: 100 * intersection >= percent * union, on shingles of `words` words; sketches of `size` values."""

    percent: int = 85
    words: int = 5
    size: int = 64

    def shared(self) -> int:
        """Retained values that a linked pair shares, but for a chance of MISS."""
        t, k = self.percent / 100, self.size
        tail = 0.0
        for x in range(k + 1):
            tail += comb(k, x) * t**x * (1 - t) ** (k - x)
            if tail > MISS:
                return x
        return k

    def prefix(self, n: int) -> int:
        """How many of its rarest retained values a set of n looks up.

        A set that is retained whole shares with a partner of m, which retains its `size` smallest, all that a linked
        pair must share but for the m - size values that the partner lacks.
        """
        if n > self.size:
            return self.size - self.shared() + 1
        partners = range(-(-n * self.percent // 100), 100 * n // self.percent + 1)
        return n - min(-(-self.percent * (n + m) // (100 + self.percent)) - max(0, m - self.size) for m in partners) + 1


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text."""
    raw, at = text_bytes(column)
    starts, ends, first = word_bounds(raw, at, SPACES)
    hashes = word_hashes(raw, starts, ends, lower=True)
    tags = grams(hashes, words)
    for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if j - i >= words:
            own = np.sort(tags[i : j - words + 1])
            yield own[first_of(own)]
        elif j > i:
            yield grams(hashes[i:j], j - i) ^ U64(j - i)
        else:
            yield np.zeros(0, U64)


SKETCHES = "doc_id long, n long, sum long, xor long, sketch binary, parity binary"


def parity(values: np.ndarray) -> bytes:
    """Bits that an odd number of values falls on: two signatures differ in no more bits than their sets in values."""
    return np.packbits(np.bincount((values * U64(0x9E3779B97F4A7C15) >> U64(54)).astype(np.int64), minlength=64 * WORDS) & 1).tobytes()


def sketches(docs: DataFrame, like: Similarity) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            for doc, own in zip(b.column("doc_id").to_pylist(), shingle_sets(b.column("text"), like.words), strict=True):
                out.append((doc, len(own), int(own.sum(dtype=U64).view(np.int64)), int(np.bitwise_xor.reduce(own).view(np.int64)) if len(own) else 0, own[: like.size].tobytes(), parity(own)))
            yield table_rows(SKETCHES, out)

    return docs.mapInArrow(run, SKETCHES)


def _by_part(tag: np.ndarray, n_parts: int) -> np.ndarray:
    return ((tag >> U64(32)) * U64(n_parts) >> U64(32)).astype(np.int64)


def send_classes(classes: DataFrame, like: Similarity, n_parts: int, buckets: int) -> DataFrame:
    """Retained values, by parts of their range, and sizes and signatures, by buckets of documents (part < 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            doc, n = b.column("rep").to_numpy(), b.column("n").to_numpy()
            tag = mix(np.frombuffer(b"".join(b.column("sketch").to_pylist()), U64))
            doc_of = np.repeat(doc, np.minimum(n, like.size))
            order = np.argsort(tag, kind="stable")
            tag, doc_of = tag[order], doc_of[order]
            out = [(int(p), VALUES, blob) for p, blob in ((_by_part(tag[i : i + 1], n_parts)[0], pack(tag=np.diff(tag[i:j], prepend=U64(0)), doc=doc_of[i:j])) for i, j in stretches(first_of(_by_part(tag, n_parts))))]
            bucket = buckets_of(doc, buckets)
            order = np.argsort(bucket, kind="stable")
            sign = np.frombuffer(b"".join(b.column("parity").to_pylist()), U64).reshape(-1, WORDS)
            out += [(-1 - int(bucket[order[i]]), META, pack(doc=doc[order[i:j]], n=n[order[i:j]], sign=sign[order[i:j]].ravel())) for i, j in stretches(first_of(bucket[order]))]
            yield table_rows(BLOBS, out)

    return classes.select("rep", "n", "sketch", "parity").mapInArrow(run, BLOBS)


def share_counts(buckets: int):
    """The values that two classes or more retain, with their exact counts, back to the documents' buckets."""

    def send(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        doc, tag, df = (np.concatenate(c) for c in zip(*held, strict=True))
        bucket = buckets_of(doc, buckets)
        order = np.lexsort((tag, bucket))
        bucket, doc, tag, df = bucket[order], doc[order], tag[order], df[order]
        return table_rows(BLOBS, [(-1 - int(bucket[i]), SHARED, pack(doc=doc[i:j], tag=np.diff(tag[i:j], prepend=U64(0)), df=df[i:j])) for i, j in stretches(first_of(bucket))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for part, rows in grouped(batches):
            if part < 0:  # sizes and signatures go on as they are
                for r in rows:
                    yield table_rows(BLOBS, [(r["part"], r["kind"], r["blob"])])
                continue
            got = [join_packed([r["blob"]]) for r in rows]
            tag, doc = np.concatenate([np.cumsum(g["tag"]) for g in got]), np.concatenate([g["doc"] for g in got])
            order = np.argsort(tag, kind="stable")
            tag, doc = tag[order], doc[order]
            new = first_of(tag)
            df = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1]
            keep = df > 1
            held.append((doc[keep], tag[keep], df[keep]))
            size += int(keep.sum())
            if size >= HELD:
                yield send(held)
                held, size = [], 0
        if size:
            yield send(held)

    return run


def choose(like: Similarity, n_parts: int):
    """Entries (value, document, size, signature, root) of the rarest shared values that a document must look up."""

    prefix = np.array([0, *(like.prefix(x) for x in range(1, like.size + 2))])

    def send(held: list[dict[str, np.ndarray]]) -> pa.RecordBatch:
        x = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
        order = np.lexsort((x["doc"], x["tag"]))
        x = {k: v[order] for k, v in x.items()}
        return table_rows(BLOBS, [(int(_by_part(x["tag"][i : i + 1], n_parts)[0]), ENTRIES, pack(tag=np.diff(x["tag"][i:j], prepend=U64(0)), doc=x["doc"][i:j], n=x["n"][i:j], root=x["root"][i:j], sign=x["sign"][i:j].ravel())) for i, j in stretches(first_of(_by_part(x["tag"], n_parts)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        size = 0
        for _, rows in grouped(batches):
            blobs: dict[int, list[bytes]] = {META: [], SHARED: [], ROOTS: []}
            for r in rows:
                blobs[r["kind"]].append(r["blob"])
            if not blobs[SHARED]:
                continue
            meta = join_packed(blobs[META])
            order = np.argsort(meta["doc"], kind="stable")
            known, n, sign = meta["doc"][order], meta["n"][order], meta["sign"].reshape(-1, WORDS)[order]
            root = known.copy()
            if blobs[ROOTS]:
                roots = join_packed(blobs[ROOTS])
                root[np.searchsorted(known, roots["doc"])] = roots["root"]
            got = [join_packed([b]) for b in blobs[SHARED]]
            doc, df = (np.concatenate([g[k] for g in got]) for k in ("doc", "df"))
            tag = np.concatenate([np.cumsum(g["tag"]) for g in got])
            order = np.lexsort((tag, df, doc))
            doc, tag = doc[order], tag[order]
            new = first_of(doc)
            begin = np.flatnonzero(new)
            shared = np.diff(np.append(begin, len(doc)))
            at = np.searchsorted(known, doc[begin])
            alone = np.minimum(n[at], like.size) - shared
            want = prefix[np.minimum(n[at], like.size + 1)] - alone
            keep = np.arange(len(doc)) - np.repeat(begin, shared) < np.repeat(want, shared)
            row = np.repeat(at, shared)[keep]
            held.append({"tag": tag[keep], "doc": doc[keep], "n": n[row], "root": root[row], "sign": sign[row]})
            size += len(row)
            if size >= HELD // 4:
                yield send(held)
                held, size = [], 0
        if size:
            yield send(held)

    return run


def _close(n: np.ndarray, sign: np.ndarray, i: np.ndarray | int, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets may be similar enough: by their sizes, and by the bits in which their signatures differ."""
    m, k = n[i], n[j]
    ok = 100 * np.minimum(m, k) >= percent * np.maximum(m, k)
    differ = np.bitwise_count(sign[i] ^ sign[j]).sum(axis=-1, dtype=np.int64)
    # 100 * both >= percent * union, with both = (m + k - difference) / 2
    return ok & (differ * (100 + percent) <= (m + k) * (100 - percent))


def candidates(like: Similarity, second: bool):
    """Pairs of each list that may be similar enough: with the first few that pass, or, the second time, all between different roots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for _, rows in grouped(batches):
            got = [join_packed([r["blob"]]) for r in rows]
            x = {k: np.concatenate([np.cumsum(g[k]) if k == "tag" else g[k] for g in got]) for k in got[0]}
            sign = x["sign"].reshape(-1, WORDS)
            order = np.lexsort((x["doc"], x["tag"]))
            tag, doc, n, root, sign = x["tag"][order], x["doc"][order], x["n"][order], x["root"][order], sign[order]
            for pairs in _across(tag, doc, n, root, sign, like.percent) if second else _first(tag, doc, n, sign, like.percent):
                held.append(pairs)
                size += len(pairs)
            if size >= HELD:
                yield _pairs(held)
                held, size = [], 0
        if size:
            yield _pairs(held)

    return run


def _pairs(held: list[np.ndarray]) -> pa.RecordBatch:
    x = np.unique(np.concatenate(held), axis=0)
    return pa.record_batch([pa.array(x[:, 0].copy()), pa.array(x[:, 1].copy())], names=["a", "b"])


def _first(tag: np.ndarray, doc: np.ndarray, n: np.ndarray, sign: np.ndarray, percent: int) -> Iterator[np.ndarray]:
    new = first_of(tag)
    begin = np.flatnonzero(new)
    place = np.arange(len(tag)) - begin[np.cumsum(new) - 1]
    found = np.zeros(len(tag), np.int64)
    j = np.flatnonzero(place > 0)
    hub = 0
    while len(j):
        i = j - place[j] + hub
        ok = _close(n, sign, i, j, percent) & (doc[i] != doc[j])
        found[j[ok]] += 1
        if ok.any():
            yield np.column_stack([doc[i[ok]], doc[j[ok]]])
        hub += 1
        j = j[(place[j] > hub) & (found[j] < FIRST) & (hub < TRIED)]


#: Members of a list that are tried for the first round; the second tries all that matter.
TRIED = 64


def _across(tag: np.ndarray, doc: np.ndarray, n: np.ndarray, root: np.ndarray, sign: np.ndarray, percent: int) -> Iterator[np.ndarray]:
    for i, j in stretches(first_of(tag)):
        own = root[i:j]
        if j - i < 2 or (own == own[0]).all():
            continue
        # Members of the list's largest component need no look at each other: every pair has a member outside it.
        values, counts = np.unique(own, return_counts=True)
        outside = np.flatnonzero(own != values[np.argmax(counts)])
        for k in outside.tolist():
            other = np.flatnonzero((own != own[k]) & ((own == values[np.argmax(counts)]) | (np.arange(j - i) > k)))
            other = other[_close(n[i:j], sign[i:j], np.full(len(other), k), other, percent)]
            if len(other):
                a, b = np.minimum(doc[i + k], doc[i + other]), np.maximum(doc[i + k], doc[i + other])
                yield np.column_stack([a, b])


def may_be_similar(s: np.ndarray, t: np.ndarray, like: Similarity) -> bool:
    """Whether the union's sketch, the smallest values of both, leaves two sets a chance; exact for sets that sketches hold whole."""
    every = np.sort(np.concatenate([s[: like.size], t[: like.size]]))
    union = every[first_of(every)][: like.size]
    twice = every[1:][every[1:] == every[:-1]]
    both = int(np.searchsorted(twice, union[-1], "right"))
    return both >= min(like.shared(), ceil(len(union) * like.percent / 100))


def _paired(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """Pairs (a, b) with the values (doc_id, value) of both as x and y; an id with several values makes a row for each."""
    x = values.select(F.col("doc_id").alias("a"), F.col("value").alias("x"))
    y = values.select(F.col("doc_id").alias("b"), F.col("value").alias("y"))
    return pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y")


def estimated(pairs: DataFrame, kept_sketches: DataFrame, like: Similarity) -> DataFrame:
    """Pairs that the overlap in the union's sketch leaves a chance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b.column("x").to_pylist(), b.column("y").to_pylist()
            keep = [may_be_similar(np.frombuffer(s, U64), np.frombuffer(t, U64), like) for s, t in zip(x, y, strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return _paired(pairs, kept_sketches).mapInArrow(run, "a long, b long").distinct()


def verified(pairs: DataFrame, kept_texts: DataFrame, like: Similarity) -> DataFrame:
    """Pairs whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, np.zeros(0, U64)
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for i in range(b.num_rows):
                text = b.column("x")[i].as_py()
                if text != last:
                    last, own = text, next(shingle_sets(b.column("x").slice(i, 1), like.words))
                other = next(shingle_sets(b.column("y").slice(i, 1), like.words))
                if len(own) and len(other):
                    every = np.concatenate([own, other])
                    every.sort()
                    both = int((every[1:] == every[:-1]).sum())
                    keep[i] = 100 * both >= like.percent * (len(every) - both)
            yield b.select(["a", "b"]).filter(pa.array(keep))

    return _paired(pairs, kept_texts).mapInArrow(run, "a long, b long")


def send_roots(labels: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, root = b.column("node").to_numpy(), b.column("root").to_numpy()
            bucket = buckets_of(doc, buckets)
            order = np.argsort(bucket, kind="stable")
            yield table_rows(BLOBS, [(-1 - int(bucket[order[i]]), ROOTS, pack(doc=doc[order[i:j]], root=root[order[i:j]])) for i, j in stretches(first_of(bucket[order]))])

    return labels.mapInArrow(run, BLOBS)


def near_duplicates(docs: DataFrame, like: Similarity | None = None) -> DataFrame:
    """Component of every document; see the module."""
    like = like or Similarity()
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    docs, twice = with_bases(documents(docs), scratch)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_parts = parts(docs, 4 << 20, least=n)
    buckets = 2 * n

    marked = scratch.save(sketches(docs, like), "sketches")
    classes = marked.where("n > 0").groupBy("n", "sum", "xor").agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch"), F.first("parity").alias("parity"))
    classes = scratch.save(classes, "classes")
    marked = scratch.save(marked.select("doc_id", "n", "sum", "xor"), "marked")
    scratch.drop("sketches")
    shared = scratch.save(by_part(send_classes(classes, like, n_parts, buckets), n).mapInArrow(share_counts(buckets), BLOBS), "shared")
    known = classes.select(F.col("rep").alias("doc_id"), F.col("sketch").alias("value"))
    classes = classes.select("n", "sum", "xor", "rep")

    def named(pairs: DataFrame, name: str) -> DataFrame:
        return scratch.save(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), name)

    def links(pairs: DataFrame, name: str) -> DataFrame:
        """Pairs that stay after the sketches and after the full sets. Of an id with several texts any of them counts: all are linked through the id."""
        pairs = scratch.save(estimated(pairs, with_ids(known, named(pairs, f"{name}-candidates")), like), f"{name}-estimated")
        kept = with_ids(docs, named(pairs, f"{name}-ids"))
        kept = kept.groupBy("doc_id", "base").agg(F.first("text").alias("value")) if twice else kept.withColumnRenamed("text", "value")
        return scratch.save(verified(pairs, kept.select("doc_id", "value"), like).distinct(), f"{name}-links")

    def listed(rows: DataFrame, second: bool) -> DataFrame:
        entries = by_part(rows, n).mapInArrow(choose(like, n_parts), BLOBS)
        return by_part(entries, n).mapInArrow(candidates(like, second), "a long, b long").distinct()

    pairs = scratch.save(listed(shared, False), "first")
    # Rows of one doc_id with different sets belong together.
    members = marked.where("n > 0").join(classes, ["n", "sum", "xor"]).select("doc_id", "rep")
    same = members.where("doc_id <> rep").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b").select("a", "b")
    linked = links(pairs, "first").unionByName(same)
    labels = components(linked, scratch, "components")
    more = scratch.save(listed(shared.unionByName(send_roots(labels, buckets)), True).join(pairs, ["a", "b"], "left_anti"), "across")
    if more.limit(1).count():
        linked = linked.unionByName(links(more, "second"))
        labels = components(linked, scratch, "all")
    rooted = classes.join(labels.select(F.col("node").alias("rep"), "root"), "rep", "left").select("n", "sum", "xor", F.coalesce("root", "rep").alias("root"))
    out = marked.select("doc_id", "n", "sum", "xor").join(rooted, ["n", "sum", "xor"], "left")
    component = F.coalesce("root", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def keep_one(docs: DataFrame, like: Similarity | None = None) -> DataFrame:
    """The documents, with all their columns, that stay of their groups: the smallest doc_id of each, once."""
    found = near_duplicates(docs, like)
    gone = Scratch(docs.sparkSession, "kept").save(found.where(~F.col("kept")).select("doc_id").distinct(), "gone")
    return with_ids(docs.where("doc_id is not null"), gone, "left_anti").select(*docs.columns)
