"""Stretches of a corpus that may hold repeated windows, found from a sparse set of anchors.

Units are bytes or words. Among the k-grams of a window of L units the one with the smallest fingerprint (the
leftmost of equals) is its anchor, so equal windows have their anchor at the same place. Consecutive windows with
one anchor make a run: a stretch of at most 2 L - k units around its anchor. A corpus has one run for about L / 3 units.

Every stretch is sent, with its own bytes, to the part of the fingerprints' range that its anchor is in; so all that
could hold the same window is in one part, and is compared there byte by byte or word by word. What a part finds
covered meets the texts again by document.

Within a slice, copies of a stretch are settled before anything is sent (compared by their bytes), so that a passage
that a third of all documents share costs a row for each slice and not for each document.

Places are counted over all different texts of a doc_id (`store.with_bases`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import U64, Rolling, bucket_hash, byte_units, lowest, mix, ranges, slices, text_bytes, tidy
from .store import Scratch, documents, pack, parts, table_rows, unpack, with_bases

SEGMENT = 1 << 18
PLACE_BITS = 28
#: Bytes of text that a task holds before it sends what it found.
FLUSH = 6 << 20
#: Bytes that are compared at once.
COMPARED = 1 << 19

#: Units of a text column: their values, the first of each row, and where each begins and ends in the bytes (None: units are the bytes).
Units = Callable[[pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None]]
Level = dict[str, np.ndarray]
#: Batches of stretches of one part -> covered stretches: documents, places, numbers of units
Settle = Callable[[list[Level]], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]


@dataclass(frozen=True)
class Spec:
    window: int
    gram: int
    units: Units
    #: True: a window counts as repeated if it starts in a document with a smaller doc_id. False: if it starts anywhere else.
    earlier: bool
    settle: Settle

    @property
    def left(self) -> int:
        """Units before an anchor, at most."""
        return self.window - self.gram

    @property
    def width(self) -> int:
        """Units of a stretch, at most: those before the anchor, and a window from there."""
        return self.left + self.window


def runs(units: np.ndarray, first: np.ndarray, window: int, gram: int) -> Iterator[Level]:
    """Runs of a slice: fingerprints of anchor and content, row, first unit (in the slice), units, units before the anchor."""
    row = np.repeat(np.arange(len(first) - 1, dtype=np.int32), np.diff(first))
    mask = U64((1 << PLACE_BITS) - 1)
    for low in range(0, len(units), SEGMENT):
        part = units[low : low + SEGMENT + window - 1]
        if len(part) < window:
            return
        rolling = Rolling(byte_units(part) if part.dtype == np.uint8 else part)
        anchors = rolling.every(gram)
        least = lowest((anchors & ~mask) | np.arange(len(anchors), dtype=U64), window - gram + 1)
        own = row[low : low + len(least)]
        live = np.flatnonzero(own == row[low + window - 1 : low + window - 1 + len(least)])
        if not len(live):
            continue
        anchor = (least[live] & mask).astype(np.int64)
        new = np.ones(len(live), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (np.diff(live) != 1) | (own[live[1:]] != own[live[:-1]])
        begin = np.flatnonzero(new)
        start, at = live[begin], anchor[begin]
        size = np.diff(np.append(begin, len(live))) + window - 1
        content = mix(rolling.of(start, start + size) ^ (at - start).astype(U64) * U64(0xD6E8FEB86659FD93))
        # Anchors are the smallest of many fingerprints; mixed again they spread evenly over the parts.
        yield {"anchor": mix(anchors[at] ^ U64(0xA0761D6478BD642F)), "content": content, "row": own[start], "first": start + low, "size": size, "lead": at - start}


def first_of(*keys: np.ndarray) -> np.ndarray:
    """Where groups of equal keys begin, for sorted keys."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return new


def stretches(new: np.ndarray) -> Iterator[tuple[int, int]]:
    """Begin and end of each group, from where groups begin."""
    heads = np.flatnonzero(new).tolist()
    return zip(heads, [*heads[1:], len(new)] if heads else [], strict=True)


def buckets_of(ids: np.ndarray, n: int) -> np.ndarray:
    """The bucket of each document, as the texts' rows have it in `meet`."""
    return bucket_hash(ids) % n


def spans(kind: int, doc: np.ndarray, start: np.ndarray, n: np.ndarray, buckets: int) -> Iterator[tuple[int, int, bytes]]:
    """Rows (bucket, kind, blob) that take stretches of documents to the documents' buckets."""
    bucket = buckets_of(doc, buckets)
    order = np.lexsort((start, doc, bucket))
    bucket, doc, start, n = bucket[order], doc[order], start[order], n[order]
    for i, j in stretches(first_of(bucket)):
        yield int(bucket[i]), kind, pack(doc=np.diff(doc[i:j], prepend=0), start=start[i:j].astype(np.int64), n=n[i:j].astype(np.int64))


def read_spans(blobs: list[bytes]) -> Level:
    """Stretches of all blobs, sorted by document and start."""
    got = []
    for b in blobs:
        x = unpack(b)
        x["doc"] = np.cumsum(x["doc"])
        got.append(x)
    if not got:
        return {k: np.zeros(0, np.int64) for k in ("doc", "start", "n")}
    out = {k: np.concatenate([x[k] for x in got]) for k in got[0]}
    order = np.lexsort((out["start"], out["doc"]))
    return {k: v[order] for k, v in out.items()}


def same_bytes(raw: np.ndarray, one: np.ndarray, other: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether stretches of bytes are equal, some at a time; sizes are above zero."""
    out = np.zeros(len(one), bool)
    stops = np.searchsorted(np.cumsum(size), np.arange(COMPARED, int(size.sum()) + COMPARED, COMPARED), "right")
    low = 0
    for high in [*stops.tolist(), len(one)]:
        if high > low:
            n = size[low:high]
            differ = raw[ranges(one[low:high], n)] != raw[ranges(other[low:high], n)]
            out[low:high] = np.add.reduceat(differ, np.cumsum(n) - n, dtype=np.int64) == 0
            low = high
    return out


BLOBS = "part int, kind int, blob binary"
RUNS, COVERED, TEXT = 0, 1, 9


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[dict]]]:
    """Rows of each part in turn, for batches sorted by part."""
    rows = (r for b in batches for r in _iter(b))
    yield from groupby(rows, key=lambda r: r["part"])
    tidy()


def _iter(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows as dictionaries; a column `rest` stays an Arrow value."""
    columns = [batch.column(j) if name in ("rest", "blob") else batch.column(j).to_pylist() for j, name in enumerate(batch.schema.names)]
    for i in range(batch.num_rows):
        yield {name: c[i].as_py() if name == "blob" else c[i] for name, c in zip(batch.schema.names, columns, strict=True)}


def by_part(frame: DataFrame, n: int) -> DataFrame:
    return frame.repartition(n, "part").sortWithinPartitions("part", "kind")


def _send_runs(spec: Spec, n_parts: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def flush(held: list[Level], texts: list[np.ndarray]) -> pa.RecordBatch:
        raw = np.concatenate(texts)
        x = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
        order = np.lexsort((x["start"], x["doc"], x["content"], x["anchor"]))
        x = {k: v[order] for k, v in x.items()}
        new = first_of(x["anchor"], x["content"])
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        copy = np.flatnonzero(~new)
        like = x["bytes"][copy] == x["bytes"][head[copy]]
        like[like] = same_bytes(raw, x["at"][copy[like]], x["at"][head[copy[like]]], x["bytes"][copy[like]])
        copy = copy[like]
        done, many = np.zeros(len(new), bool), np.zeros(len(new), np.uint8)
        if spec.earlier:  # a run whose copy is in a smaller document of this slice is settled
            done[copy] = x["doc"][copy] > x["doc"][head[copy]]
            out_of = done
        else:  # a run with another copy in this slice is settled; one copy goes on as a witness
            done[copy] = True
            many[head[copy]] = 1
            out_of = done | (many > 0)
        out = list(spans(COVERED, x["doc"][out_of], x["start"][out_of], x["size"][out_of], buckets))
        x = {k: v[~done] for k, v in x.items()} | {"many": many[~done]}
        part = ((x["anchor"] >> U64(32)) * U64(n_parts) >> U64(32)).astype(np.int64)
        for i, j in stretches(first_of(part)):
            data = raw[ranges(x["at"][i:j], x["bytes"][i:j])]
            out.append((int(part[i]), RUNS, pack(3, data=data, bytes=x["bytes"][i:j].astype(np.uint32), lead=x["lead"][i:j].astype(np.uint16), doc=x["doc"][i:j], start=x["start"][i:j], many=x["many"][i:j])))
        return table_rows(BLOBS, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Level] = []
        texts: list[np.ndarray] = []
        size = 0
        for b in slices(batches):
            raw, _ = text_bytes(b.column("text"))
            units, first, begin, end = spec.units(b.column("text"))
            ids, bases = b.column("doc_id").to_numpy(), b.column("base").to_numpy()
            for x in runs(units, first, spec.window, spec.gram):
                last = x["first"] + x["size"] - 1
                low, high = (x["first"], last + 1) if begin is None else (begin[x["first"]], end[last])
                held.append({"anchor": x["anchor"], "content": x["content"], "doc": ids[x["row"]], "start": x["first"] - first[x["row"]] + bases[x["row"]], "size": x["size"].astype(np.int32), "lead": x["lead"].astype(np.int16), "at": low + size, "bytes": high - low})
            texts.append(raw)
            size += len(raw)
            if size >= FLUSH:
                if held:
                    yield flush(held, texts)
                held, texts, size = [], [], 0
        if held:
            yield flush(held, texts)

    return run


#: Stretches that a task settles before it sends what it found.
SETTLED = 1 << 19


class Outbox:
    """Stretches of documents, gathered over parts, so that a task sends few rows."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def put(self, doc: np.ndarray, start: np.ndarray, n: np.ndarray) -> None:
        if len(doc):
            self.held.append((doc.astype(np.int64), start.astype(np.int64), n.astype(np.int64)))
            self.size += len(doc)

    def send(self) -> pa.RecordBatch:
        rows = list(spans(COVERED, *(np.concatenate(c) for c in zip(*self.held, strict=True)), self.buckets))
        self.held, self.size = [], 0
        return table_rows(BLOBS, rows)


def _settle_parts(spec: Spec, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Outbox(buckets)
        for _, rows in grouped(batches):
            held: list[Level] = []
            for r in rows:
                x = unpack(r["blob"])
                if r["kind"] == RUNS:
                    held.append(x)
                else:
                    out.put(np.cumsum(x["doc"]), x["start"], x["n"])
                    if out.size >= SETTLED:
                        yield out.send()
            if held:
                for doc, start, n in spec.settle(held):
                    out.put(doc, start, n)
                    if out.size >= SETTLED:
                        yield out.send()
        if out.size:
            yield out.send()

    return run


def matrix(units: np.ndarray, size: np.ndarray, lead: np.ndarray, spec: Spec) -> np.ndarray:
    """Stretches as rows whose anchors stand in one column; places that a stretch doesn't have are 0."""
    out = np.zeros((len(size), spec.width), units.dtype)
    flat = out.reshape(-1)
    heads = np.cumsum(size) - size
    for low in range(0, len(size), 1 << 13):
        own = slice(low, low + (1 << 13))
        at = np.arange(low, min(low + (1 << 13), len(size))) * spec.width + spec.left - lead[own]
        total = int(size[own].sum())
        flat[ranges(at, size[own])] = units[heads[low] : heads[low] + total]
    return out


def sides_shared(rows: np.ndarray, lead: np.ndarray, tail: np.ndarray, low: np.ndarray, high: np.ndarray, spec: Spec) -> np.ndarray:
    """Stretches that may share a window with another one.

    A shared window reaches half of what it has beside the anchor to one side at least, so the anchor and that much are
    equal there. low, high: what must differ between two stretches, as the least and the greatest of it for each.
    """
    half = (spec.left + 1) // 2
    out = np.zeros(len(rows), bool)
    for enough, a, b in ((lead >= half, spec.left - half, spec.left + spec.gram), (tail >= spec.gram + half, spec.left, spec.left + spec.gram + half)):
        own = np.flatnonzero(enough)
        if len(own) < 2:
            continue
        tags = _tags(rows[own], a, b)
        order = np.argsort(tags, kind="stable")
        new = first_of(tags[order])
        begin, group = np.flatnonzero(new), np.cumsum(new) - 1
        own = own[order]
        out[own] |= (np.minimum.reduceat(low[own], begin) != np.maximum.reduceat(high[own], begin))[group]
    return out


def _tags(rows: np.ndarray, a: int, b: int) -> np.ndarray:
    """A fingerprint of columns a to b of each row. Used to find what is then compared unit by unit."""
    out = np.zeros(len(rows), U64)
    for k in range(a, b):
        out = (out + rows[:, k].astype(U64) + U64(1)) * U64(0x9E3779B97F4A7C15)
        out ^= out >> U64(29)
    return mix(out)


class Windows:
    """The windows of stretches that have one number of units before the anchor: groups of equal ones."""

    def __init__(self, rows: np.ndarray, own: np.ndarray, x: int, rank: np.ndarray, spec: Spec):
        """own: the stretches that have this window; rank: their order within a group."""
        a, b = spec.left - x, spec.left - x + spec.window
        tags = _tags(rows[own], a, b)
        order = np.lexsort((rank[own], tags))
        own = own[order]
        new = first_of(tags[order])
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        rest = np.flatnonzero(~new)
        if len(rest) and not (rows[own[rest], a:b] == rows[own[head[rest]], a:b]).all():  # equal fingerprints of different windows
            _, back = np.unique(rows[own, a:b], axis=0, return_inverse=True)
            order = np.lexsort((rank[own], back.ravel()))
            own, back = own[order], back.ravel()[order]
            new = first_of(back)
            head = np.flatnonzero(new)[np.cumsum(new) - 1]
        #: Stretches by group and rank, the place of each one's group's first member, and the group's size.
        self.own, self.head, self.size = own, head, np.bincount(head, minlength=len(own))[head] if len(own) else head


def texts(docs: DataFrame, buckets: int) -> DataFrame:
    """Texts as bytes, a null one as none, by their documents' buckets; a column `rest`, of any type, goes with them."""
    rest = [c for c in docs.columns if c == "rest"]
    part = F.pmod(F.xxhash64("doc_id"), F.lit(buckets).cast("long")).cast("int")
    return docs.select(part.alias("part"), F.lit(TEXT).alias("kind"), F.coalesce("text", F.lit("")).cast("binary").alias("blob"), "doc_id", "base", *rest)


def meet(rows: DataFrame, docs: DataFrame, buckets: int, n: int) -> DataFrame:
    """Blobs and texts of the same documents together: blobs first."""
    none = F.lit(None).cast("long")
    return by_part(rows.select("part", "kind", "blob", none.alias("doc_id"), none.alias("base")).unionByName(texts(docs, buckets), allowMissingColumns=True), n)


def repeated(docs: DataFrame, spec: Spec, name: str, finish: Callable[[int, bytes, np.ndarray, np.ndarray], tuple], schema: str) -> DataFrame:
    """finish(doc_id, text, starts and lengths of covered stretches) for each document, as rows of the schema."""
    spark = docs.sparkSession
    scratch = Scratch(spark, name)
    docs, _ = with_bases(documents(docs), scratch)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_parts = parts(docs, 2 << 20, least=n)
    buckets = 2 * n
    sent = by_part(docs.mapInArrow(_send_runs(spec, n_parts, buckets), BLOBS), n)
    settled = scratch.save(sent.mapInArrow(_settle_parts(spec, buckets), BLOBS), "settled")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in grouped(batches):
            covered: Level | None = None
            blobs: list[bytes] = []
            out: list[tuple] = []
            for r in rows:
                if r["kind"] != TEXT:
                    blobs.append(r["blob"])
                    continue
                if covered is None:
                    covered = read_spans(blobs)
                text, base = r["blob"], r["base"]
                i, j = np.searchsorted(covered["doc"], [r["doc_id"], r["doc_id"] + 1])
                start = covered["start"][i:j]
                a, b = i + np.searchsorted(start, [base, base + len(text) + 1])  # of this text among those of its id
                out.append(finish(r["doc_id"], text, covered["start"][a:b] - base, covered["n"][a:b]))
                if len(out) >= 512:
                    yield table_rows(schema, out)
                    out = []
            if out:
                yield table_rows(schema, out)

    return meet(settled, docs, buckets, n).mapInArrow(run, schema)
