"""Approximate nearest neighbours by balanced posting lists.

Largest inner product is turned into smallest distance by one more component (the root of the largest squared norm
less the vector's own; 0 for queries). Centroids come from a bounded sample, halved again and again at the median
along the line between two means, so that lists are balanced. A vector is replicated to its nearest centroids
within a ratio of the nearest distance; centroids are searched by best-first walks over an in-memory
neighbour graph. A query reads the lists whose centroids are within a ratio of its nearest one; that ratio is set on
the sample, to the recall wanted there. Lists travel as blocks and meet the queries of their list; each list gives a
query's best few, and these are merged by query. Scores are taken twice: a matrix product finds what can be among the best, with
a margin for its rounding, and the exact double-precision score then orders it, ties by vec_id. As the centroids' number is
bounded, a list grows with the input; a list of many vectors is dealt to several tasks, which all get its queries.

Equal vectors are one entry with its smallest ids, as many as an answer can hold, and equal queries are searched
once; so a vector that a third of all rows share costs no more than others, and nothing is lost.

Cases: null vectors, null or non-finite components, all zeros, and lengths other than the most frequent one take no part,
as queries or candidates; a null vec_id takes no part; repeated rows of one vec_id with equal vectors are one; with fewer
candidates than asked for all are returned; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .kernel import ranges
from .repeats import by_part, first_of, grouped, stretches
from .store import Scratch, pack, table_rows, unpack

#: Vectors that centroids and the ratio are fitted on, and queries among them.
SAMPLE, SAMPLE_QUERIES = 16_384, 256
#: Vectors a list should hold, centroids at most, copies of a vector at most, and the ratio for copies.
LIST, MOST_LISTS, COPIES, COPY_RATIO = 400, 8_192, 4, 1.25
DEGREE, RECALL = 24, 0.975
BLOCK, ASKED = 2_048, 512
#: Vectors of a list that one task looks at, about; and the rounding of a product, relative to the vectors' lengths.
SHARE, MARGIN = 8 * LIST, 1e-12
#: Vectors that walk over the graph at once.
WALK = 256
SCHEMA = "query_id long, rank int, vec_id long, score double"
ROWS = "part int, kind int, blob binary"


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), 0)


class Centroids:
    """Balanced centroids and the graph that finds them."""

    def __init__(self, sample: np.ndarray, lists: int):
        groups = [sample]
        while len(groups) * 2 <= lists:
            groups = [half for g in groups for half in self.halve(g)]
        self.at = np.array([g.mean(0) for g in groups if len(g)])
        n = len(self.at)
        d = _distances(self.at, self.at)
        near = np.argsort(d, axis=1, kind="stable")[:, 1 : DEGREE + 1]
        far = np.random.default_rng(7).integers(0, n, (n, 4))  # long links
        self.graph = np.concatenate([near, far], axis=1) if n > 1 else np.zeros((n, 1), np.int64)
        self.ratio, self.width = 1.0, min(n, 2 * COPIES)

    @staticmethod
    def halve(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(x) < 2:
            return x, x[:0]
        a, b = x[0], x[np.argmax(((x - x[0]) ** 2).sum(1))]
        for _ in range(4):
            along = x @ (b - a)
            order = np.argsort(along, kind="stable")
            low, high = order[: len(x) // 2], order[len(x) // 2 :]
            a, b = x[low].mean(0), x[high].mean(0)
        return x[low], x[high]

    def nearest(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The `width` nearest centroids found for each vector, and their distances, nearest first; some vectors at a time, as each step holds their neighbours."""
        width = min(width, len(self.at))
        found = [self.walk(x[i : i + WALK], width) for i in range(0, len(x), WALK)]
        if not found:
            return np.zeros((0, width), np.int64), np.zeros((0, width))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def walk(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first walks over the graph, all vectors in step."""
        n = len(self.at)
        rows = np.arange(len(x))[:, None]
        entry = np.unique(np.linspace(0, n - 1, min(n, 16)).astype(int))
        seen = np.zeros((len(x), n), bool)
        seen[:, entry] = True
        ids = np.repeat(entry[None, :], len(x), 0)
        dist = _distances(x, self.at[entry])
        open_ = np.ones(ids.shape, bool)
        while True:
            key = np.where(open_, dist, np.inf)
            step = np.argsort(key, axis=1, kind="stable")[:, :4]
            live = np.take_along_axis(key, step, 1) < np.inf
            if not live.any():
                break
            np.put_along_axis(open_, step, np.take_along_axis(open_, step, 1) & ~live, 1)
            new = self.graph[np.take_along_axis(ids, step, 1)].reshape(len(x), -1)
            fresh = ~seen[rows, new] & np.repeat(live, self.graph.shape[1], 1)
            order = np.argsort(new, axis=1, kind="stable")  # a centroid reached twice at once counts once
            sorted_ = np.take_along_axis(new, order, 1)
            twice = np.zeros(new.shape, bool)
            np.put_along_axis(twice, order[:, 1:], sorted_[:, 1:] == sorted_[:, :-1], 1)
            fresh &= ~twice
            seen[np.repeat(rows, new.shape[1], 1)[fresh], new[fresh]] = True
            d = np.full(new.shape, np.inf)
            r, k = np.nonzero(fresh)
            d[r, k] = ((x[r] - self.at[new[r, k]]) ** 2).sum(1)
            ids, dist, open_ = np.concatenate([ids, new], 1), np.concatenate([dist, d], 1), np.concatenate([open_, fresh], 1)
            keep = np.argsort(dist, axis=1, kind="stable")[:, :width]
            ids, dist, open_ = (np.take_along_axis(v, keep, 1) for v in (ids, dist, open_))
        order = np.argsort(dist, axis=1, kind="stable")[:, :width]
        return np.take_along_axis(ids, order, 1), np.sqrt(np.take_along_axis(dist, order, 1))

    def lists_of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lists that hold each vector: its nearest ones, copies included."""
        ids, dist = self.nearest(x, 2 * COPIES)
        return ids[:, :COPIES], dist[:, :COPIES] <= COPY_RATIO * dist[:, :1] + 1e-12

    def probes(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lists that each query reads."""
        ids, dist = self.nearest(q, self.width)
        near = dist <= self.ratio * dist[:, :1] + 1e-12
        near[:, :COPIES] = True
        return ids, near

    def tune(self, sample: np.ndarray, queries: np.ndarray, want: int) -> None:
        """Set the ratio so that lists within it hold a share of RECALL of the sample's true neighbours."""
        if len(self.at) < 2 or not len(queries):
            return
        lists, held = self.lists_of(sample)
        d = np.sqrt(_distances(queries, self.at))
        score = queries @ sample.T
        top = np.argsort(-score, axis=1, kind="stable")[:, : want + 1]
        cost = np.where(held[top], np.take_along_axis(d[:, None, :].repeat(top.shape[1], 1), lists[top], 2), np.inf).min(2)
        self.ratio = float(np.quantile(cost / d.min(1)[:, None], RECALL))
        self.width = int(min(len(self.at), np.quantile((d <= self.ratio * d.min(1)[:, None]).sum(1), 0.98) + 8))


class Best:
    """The best of some queries: of equal scores the smallest ids. Sorted by query, score and id."""

    def __init__(self, n: int, most: int):
        self.n, self.most = n, most
        self.query, self.score, self.id = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def least(self) -> np.ndarray:
        """For each query the score below which nothing more counts."""
        out = np.full(self.n, -np.inf)
        last = np.flatnonzero(np.diff(np.append(self.query, self.n)) > 0)
        full = np.bincount(self.query, minlength=self.n)[self.query[last]] == self.most
        out[self.query[last[full]]] = self.score[last[full]]
        return out

    def put(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        q, s, i = (np.concatenate(c) for c in ((self.query, query), (self.score, score), (self.id, ids)))
        order = np.lexsort((i, -s, q))
        order = order[first_of(q[order], s[order], i[order])] if len(order) else order
        new = first_of(q[order])
        place = np.arange(len(order)) - np.flatnonzero(new)[np.cumsum(new) - 1] if len(order) else order
        order = order[place < self.most]
        self.query, self.score, self.id = q[order], s[order], i[order]


def valid(v: Column, size: int) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return v.isNotNull() & (F.size(v) == size) & ~F.coalesce(F.exists(v, bad), F.lit(True)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), size)


def search(vectors: DataFrame, every: int = 20, k: int = 20, vector: str = "embedding") -> DataFrame:
    """The k nearest vectors found for each vec_id divisible by `every`; see the module."""
    spark = vectors.sparkSession
    ship(spark)
    scratch = Scratch(spark, "ann")
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where("vec_id is not null")
    common = rows.where("size(v) > 0").groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    size = common[0]["size"] if common else 0
    rows = rows.where(valid(F.col("v"), size)).withColumns({"h": F.xxhash64("v"), "g": F.xxhash64(F.lit(1), F.col("v"))})
    few = Window.partitionBy("h", "g").orderBy("vec_id")
    asked = rows.where(F.col("vec_id") % every == 0).select("h", "g").distinct().withColumn("asks", F.lit(True))
    entries = rows.dropDuplicates(["vec_id", "h", "g"]).withColumn("nth", F.row_number().over(few)).where(F.col("nth") <= k + 1)
    entries = entries.groupBy("h", "g").agg(F.first("v").alias("v"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    entries = scratch.save(entries.join(asked, ["h", "g"], "left").withColumn("asks", F.coalesce("asks", F.lit(False))), "entries")

    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    total = entries.agg(F.count("*").alias("n"), F.max(norm).alias("most")).collect()[0]
    sample = entries.select("v").orderBy("h", "g").limit(SAMPLE).toArrow()
    base = _matrix(sample.column("v").combine_chunks(), size) if total.n else np.zeros((0, max(size, 1)))

    def raised(x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.sqrt(np.maximum(total.most - (x * x).sum(1), 0))])

    if not total.n:
        return spark.createDataFrame([], SCHEMA)
    lists = 1
    while lists * 2 * LIST <= total.n and lists * 2 <= min(MOST_LISTS, len(base) // 8):
        lists *= 2
    centroids = Centroids(raised(base), lists)
    some = base[:: max(1, len(base) // SAMPLE_QUERIES)]
    centroids.tune(raised(base), np.column_stack([some, np.zeros(len(some))]), k)
    shared = spark.sparkContext.broadcast(centroids)  # MOST_LISTS centroids at most
    shares = max(1, -(-total.n // (len(centroids.at) * SHARE)))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            for start in range(0, b.num_rows, BLOCK):
                part = b.slice(start, BLOCK)
                x = _matrix(part.column("v"), size)
                h, g = part.column("h").to_numpy(), part.column("g").to_numpy()
                asks = part.column("asks").to_numpy(zero_copy_only=False)
                ids = part.column("ids")
                counts = np.diff(ids.offsets.to_numpy())
                flat = ids.flatten().to_numpy()
                begin = np.cumsum(counts) - counts
                out = []
                found, held = own.lists_of(raised(x))
                for kind, (to, near), row in ((1, (found, held), np.arange(len(x))), (0, own.probes(np.column_stack([x[asks], np.zeros(asks.sum())])) if asks.any() else (found[:0], held[:0]), np.flatnonzero(asks))):
                    r, c = np.nonzero(near)
                    order = np.argsort(to[r, c], kind="stable")
                    target, r = to[r, c][order], row[r[order]]
                    for i, j in stretches(first_of(target)):
                        m = r[i:j]
                        head = pack(h=h[m], g=g[m], n=counts[m])
                        body = pack(v=x[m].ravel())
                        tail = pack(ids=np.concatenate([flat[begin[q] : begin[q] + counts[q]] for q in m])) if kind else b""
                        blob = b"".join(len(p).to_bytes(4, "little") + p for p in (head, body, tail))
                        to_shares = [int(h[m[0]]) % shares] if kind else range(shares)
                        out += [(int(target[i]) * shares + share, kind, blob) for share in to_shares]
                yield table_rows(ROWS, out)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in grouped(batches):
            waiting: list[tuple[dict, np.ndarray]] = []
            queries, qh, qg = None, None, None
            best: list[Best] = []
            posted: list[tuple[dict, np.ndarray, list[int]]] = []
            held = 0

            def look() -> None:
                """Hold all queries of the list against the vectors gathered so far."""
                v, ids = np.concatenate([p[1] for p in posted]), np.array([i for p in posted for i in p[2]], np.int64)
                n = np.concatenate([p[0]["n"] for p in posted])
                cut = np.cumsum(n) - n
                longest = float(np.sqrt((v * v).sum(1).max()))
                for block, low in zip(best, range(0, len(queries), ASKED), strict=True):
                    q = queries[low : low + ASKED]
                    s = q @ v.T
                    take = min(k + 1, s.shape[1])
                    least = np.maximum(np.partition(s, s.shape[1] - take, axis=1)[:, s.shape[1] - take], block.least())
                    row, column = np.nonzero(s >= (least - MARGIN * longest * np.sqrt((q * q).sum(1)))[:, None])
                    for at in range(0, len(row), 1 << 15):
                        r, c = row[at : at + (1 << 15)], column[at : at + (1 << 15)]
                        exact = (v[c] * q[r]).sum(1)
                        block.put(np.repeat(r, n[c]), np.repeat(exact, n[c]), ids[ranges(cut[c], n[c])])

            for r in blobs:
                head, v, ids = _split(r["blob"], size)
                if r["kind"] == 0:
                    waiting.append((head, v))
                    continue
                if queries is None:
                    if not waiting:
                        break
                    queries = np.concatenate([w[1] for w in waiting])
                    qh, qg = (np.concatenate([w[0][c] for w in waiting]) for c in ("h", "g"))
                    best = [Best(min(ASKED, len(queries) - low), k + 1) for low in range(0, len(queries), ASKED)]
                posted.append((head, v, ids))
                held += len(v)
                if held >= 2 * BLOCK:
                    look()
                    posted, held = [], 0
            if posted:
                look()
            if queries is None:
                continue
            bucket = (qh.view(np.uint64) % np.uint64(8 * n_parts)).astype(np.int64)
            query = np.concatenate([b.query + low for b, low in zip(best, range(0, len(queries), ASKED), strict=True)])
            score, ids = np.concatenate([b.score for b in best]), np.concatenate([b.id for b in best])
            order = np.argsort(bucket[query], kind="stable")
            out = []
            for i, j in stretches(first_of(bucket[query[order]])):
                own = order[i:j]
                out.append((int(bucket[query[own[0]]]), 0, pack(h=qh[query[own]], g=qg[query[own]], s=score[own], i=ids[own])))
            yield table_rows(ROWS, out)

    FOUND = "h long, g long, place int, vec_id long, score double"

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in grouped(batches):
            held = [unpack(r["blob"]) for r in blobs]
            x = {c: np.concatenate([b[c] for b in held]) for c in held[0]}
            order = np.lexsort((x["g"], x["h"]))
            new = first_of(x["h"][order], x["g"][order])
            query = np.empty(len(order), np.int64)
            query[order] = np.cumsum(new) - 1
            best = Best(int(new.sum()), k + 1)
            best.put(query, x["s"], x["i"])
            name = order[new][best.query]
            begin = first_of(best.query)
            place = np.arange(len(begin)) - np.flatnonzero(begin)[np.cumsum(begin) - 1]
            yield pa.record_batch([pa.array(x["h"][name]), pa.array(x["g"][name]), pa.array(place.astype(np.int32)), pa.array(best.id), pa.array(best.score)], names=["h", "g", "place", "vec_id", "score"])

    sent = by_part(entries.mapInArrow(route, ROWS), n_parts)
    found = scratch.save(by_part(sent.mapInArrow(scan, ROWS), n_parts).mapInArrow(merge, FOUND), "found")
    answers = found.groupBy("h", "g").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("top"))  # k + 1 of each
    queries = rows.where(F.col("vec_id") % every == 0).select("vec_id", "h", "g").distinct().withColumnRenamed("vec_id", "query_id")
    own = F.slice(F.filter("top", lambda t: t["vec_id"] != F.col("query_id")), 1, k)
    return queries.join(answers, ["h", "g"]).select("query_id", F.posexplode(own).alias("at", "hit")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))


def _pieces(blob: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(blob):
        n = int.from_bytes(blob[at : at + 4], "little")
        out.append(blob[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def _split(blob: bytes, size: int) -> tuple[dict[str, np.ndarray], np.ndarray, list[int]]:
    head, body, tail = _pieces(blob)
    return unpack(head), unpack(body)["v"].reshape(-1, size), unpack(tail)["ids"].tolist() if tail else []
