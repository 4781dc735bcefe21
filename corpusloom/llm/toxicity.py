"""Toxicity: gradient-boosted trees over dense features of a text, calibrated by isotonic regression.

Features are densities of a weighted lexicon, its nearness to words of the second person, capitals, punctuation and
obfuscation. A word is compared in plain form: small letters, with the usual digits and signs read as the letters they
stand for, so that obfuscated words meet their entries. The lexicon is learned: words and their first 4 to 7 letters
(stems of inflected words), weighted by the lower bound of their log-odds. On the toxic side an occurrence counts once for
each different pair of neighbours, so a text that was copied thousands of times teaches no more than one.

Each labelled row is measured with a lexicon that was learned without its fold (near copies share a fold by a minimum
hash), trees are fitted on these rows, and the calibration on predictions for rows that the trees didn't see.

The fit uses a bounded sample of labelled rows, `SAMPLE`, chosen by a hash of doc_id among rows that are not held out,
and a lexicon of at most `ENTRIES`; the features see the text alone. Everything else covers every document.

Cases: a null text is scored as an empty one; documents without a label, with a null label or held out are scored but
never fitted; of several labels for an id the largest counts, of several texts for an id the first in order is fitted;
labels of absent documents don't count; without any label, or with labels of one class only, the score is the class's
share (0.5 without labels); rows without doc_id are left out; equal rows get equal scores; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernel import U64, mix, slices, text_bytes, word_bounds, word_hashes
from .store import Scratch, arrow_schema, documents

#: Most labelled rows that a fit uses, and most entries of the lexicon.
SAMPLE, ENTRIES = 30_000, 50_000
FOLDS, STEMS, CONTEXTS = 4, (4, 5, 6, 7), 4
BINS, ROUNDS, DEPTH, RATE = 32, 100, 3, 0.1
#: Words around one of the second person that are near it.
NEAR = 5
# Words of the second person in several languages, in small letters.
SECOND_PERSON = (
    "you your yours yourself yourselves u ur tu te toi ton ta tes vous votre vos du dich dir dein deine deinen deiner euch euer "
    "ihr sie usted ustedes tú ti tus vosotros vuestro vuestra"
).split()
# Digits and signs that stand for letters inside a word.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
FEATURES = [
    "words", "weight", "some_hits", "hits", "strong_hits", "log_hits", "log_strong", "different_hits", "largest", "second_person", "nearness", "near_hits",
    "capitals", "capital_words", "capital_hits", "exclamations", "questions", "marks", "repeated_marks", "obfuscated", "obfuscated_hits", "single_letters", "drawn_out", "digits", "not_ascii",
]
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def _bytes(text: str) -> np.ndarray:
    return np.isin(np.arange(256), list(text.encode()))


UPPER, LETTER, DIGIT, HIGH = _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"), _bytes("0123456789"), np.arange(256) >= 0x80
MARK = ~(LETTER | DIGIT | HIGH) & (np.arange(256) > 0x20) & (np.arange(256) < 0x7F)
INSIDE = _bytes("".join(LOOKALIKES) + "*")
PLAIN = np.arange(256, dtype=np.uint8)
PLAIN[0x41:0x5B] += 32
STANDS_FOR = PLAIN.copy()
for _sign, _letter in LOOKALIKES.items():
    STANDS_FOR[ord(_sign)] = ord(_letter)


@dataclass
class Words:
    """Words of a slice in plain form: bytes, bounds, each row's first word, and what each word looked like."""

    raw: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    whole: np.ndarray
    obfuscated: np.ndarray
    capital: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def stems(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Fingerprints of whole words and of their first letters, with the words they are of."""
        yield np.arange(len(self.whole)), self.whole
        head = np.flatnonzero((self.raw & 0xC0) != 0x80)  # each letter's first byte
        letter = np.searchsorted(head, self.starts)
        head = np.append(head, np.full(max(STEMS) + 1, len(self.raw)))
        for k in STEMS:
            end = head[letter + k]
            some = np.flatnonzero(end < self.ends)
            yield some, word_hashes(self.raw, self.starts[some], end[some])


def words_of(column: pa.Array) -> tuple[Words, np.ndarray, np.ndarray]:
    """The words of each text, and the texts' own bytes and offsets."""
    raw, at = text_bytes(column)
    base = LETTER[raw] | HIGH[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    before, after = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
    if len(raw) > 1:
        before[1:], after[:-1] = base[:-1] & ~edge[1:-1], base[1:] & ~edge[1:-1]
    inner = INSIDE[raw] & before & after  # a sign between two letters belongs to the word
    form = np.where(inner, STANDS_FOR[raw], PLAIN[raw])
    latin = np.zeros(len(raw), bool)
    latin[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)  # capitals from U+00C0 to U+00DE
    form[latin] += 0x20
    inside = base | inner | DIGIT[raw]
    shown = np.where(inside, form, 0).astype(np.uint8)
    starts, ends, first = word_bounds(shown, at, np.arange(256) == 0)
    count = lambda flag: np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
    odd, upper, letters = count(inner), count(UPPER[raw] | latin), count((base & ((raw & 0xC0) != 0x80)))
    capital = (upper[ends] - upper[starts] == letters[ends] - letters[starts]) & (letters[ends] - letters[starts] > 1)
    return Words(shown, starts, ends, first, word_hashes(shown, starts, ends), odd[ends] > odd[starts], capital), raw, at


def _fold(words: Words) -> np.ndarray:
    """A fold for each row from the least fingerprint of three words on end, which near copies mostly share."""
    n = len(words.first) - 1
    tags = words.whole.copy()
    if len(tags) > 2:
        tags[:-2] = mix(tags[:-2] + U64(3) * mix(tags[1:-1]) + U64(5) * mix(tags[2:] + U64(1)))
    least = np.zeros(n, U64)
    some = np.flatnonzero(np.diff(words.first) > 0)
    if len(some):
        least[some] = np.minimum.reduceat(tags, words.first[some])
    return (mix(least) % U64(FOLDS)).astype(np.int64)


class Lexicon:
    """Sorted fingerprints and their weights; most words are turned away by a table of 2^16 flags."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.weights = keys[order], weights[order].astype(np.float32)
        self.flags = np.zeros(1 << 16, bool)
        self.flags[(self.keys & U64(0xFFFF)).astype(np.int64)] = True

    def weigh(self, words: Words) -> np.ndarray:
        """The weight of each word: the largest of its entries, 0 without one."""
        out = np.zeros(len(words.whole), np.float32)
        if not len(self.keys):
            return out
        for which, tags in words.stems():
            may = np.flatnonzero(self.flags[(tags & U64(0xFFFF)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.keys, tags[may]), len(self.keys) - 1)
            hit = self.keys[at] == tags[may]
            where = which[may[hit]]
            out[where] = np.maximum(out[where], self.weights[at[hit]])
        return out


def learn(keys: np.ndarray, toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float) -> Lexicon:
    """Entries that are surely more frequent in toxic texts, by the lower bound of their log-odds."""
    odds = np.log(np.maximum(toxic, 1e-9) / max(n_toxic, 1)) - np.log((clean + 1) / max(n_clean, 1))
    low = odds - 2 * np.sqrt(1 / np.maximum(toxic, 1e-9) + 1 / (clean + 1))
    kept = (toxic >= CONTEXTS) & (low > 0.5)
    return Lexicon(keys[kept], low[kept])


_YOU: np.ndarray | None = None


def _second_person(tags: np.ndarray) -> np.ndarray:
    global _YOU
    if _YOU is None:
        _YOU = np.unique(words_of(pa.array(SECOND_PERSON))[0].whole)
    at = np.minimum(np.searchsorted(_YOU, tags), len(_YOU) - 1)
    return _YOU[at] == tags


def features(column: pa.Array, lexicons: list[Lexicon]) -> np.ndarray:
    """FEATURES of each text; with several lexicons, each row takes the one of its fold."""
    words, raw, at = words_of(column)
    n, row = len(at) - 1, words.row
    size, many = np.maximum(np.diff(at), 1), np.diff(words.first)
    each = np.maximum(many, 1)
    weight = lexicons[0].weigh(words)
    if len(lexicons) > 1:
        fold = _fold(words)[row]
        for k, lexicon in enumerate(lexicons):
            weight = np.where(fold == k, lexicon.weigh(words), weight) if k else weight
    some, hit, strong = weight > 0.5, weight >= 1.5, weight >= 3
    total = lambda flag: np.bincount(row, flag, n)

    def share(flag: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
        return (sums[at[1:]] - sums[at[:-1]]) / size

    largest = np.zeros(n)
    filled = np.flatnonzero(many > 0)
    if len(filled):
        largest[filled] = np.maximum.reduceat(weight, words.first[filled])
    you = _second_person(words.whole)
    nearness, near_hits = np.zeros(n), np.zeros(n)
    place, spots = np.flatnonzero(hit), np.flatnonzero(you)
    if len(place) and len(spots):
        gap = np.full(len(place), 1 << 20)
        after = np.searchsorted(spots, place)
        for side in (np.maximum(after - 1, 0), np.minimum(after, len(spots) - 1)):
            same = row[spots[side]] == row[place]
            gap = np.where(same, np.minimum(gap, np.abs(spots[side] - place)), gap)
        np.maximum.at(nearness, row[place], np.where(gap < 1 << 20, 1 / (1.0 + gap), 0))
        near_hits = np.bincount(row[place], gap <= NEAR, n)
    order = np.lexsort((words.whole[place], row[place]))
    tags, rows = words.whole[place][order], row[place][order]
    new = np.ones(len(tags), bool)
    new[1:] = (tags[1:] != tags[:-1]) | (rows[1:] != rows[:-1])
    again, drawn = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
    again[1:] = MARK[raw[1:]] & (raw[1:] == raw[:-1])
    drawn[2:] = LETTER[raw[2:]] & (raw[2:] == raw[1:-1]) & (raw[2:] == raw[:-2])
    lone = (words.ends - words.starts == 1) & LETTER[words.raw[words.starts]] if len(words.starts) else np.zeros(0, bool)
    hits = total(hit)
    return np.column_stack([
        np.log1p(many), total(weight) / each, total(some) / each, hits / each, total(strong) / each, np.log1p(hits), np.log1p(total(strong)), np.log1p(np.bincount(rows[new], minlength=n)), largest,
        total(you) / each, nearness, near_hits / each, share(UPPER[raw]), total(words.capital) / each, total(words.capital & hit) / each,
        share(raw == ord("!")), share(raw == ord("?")), share(MARK[raw]), share(again), total(words.obfuscated) / each, total(words.obfuscated & hit) / each, total(lone) / each, share(drawn), share(DIGIT[raw]), share(HIGH[raw]),
    ]).astype(np.float32)


class Boosted:
    """Gradient-boosted trees of one depth on quantile bins, for the logistic loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.base = float(np.log(share / (1 - share)))
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        bins = self.bins(x)
        total = np.full(len(y), self.base)
        for _ in range(ROUNDS):
            p = 1 / (1 + np.exp(-total))
            tree = self._grow(bins, y - p, p * (1 - p))
            self.trees.append(tree)
            total += self._look(tree, bins)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T, strict=True)])

    @staticmethod
    def _grow(bins: np.ndarray, gradient: np.ndarray, hessian: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature and cut of each inner node in heap order, and the value of each leaf."""
        inner = (1 << DEPTH) - 1
        feature, cut = np.zeros(inner, np.int64), np.full(inner, BINS)  # a node without a cut sends all rows to the left
        node = np.zeros(len(bins), np.int64)
        for level in range(DEPTH):
            first, n = (1 << level) - 1, 1 << level
            best = np.full(n, 1e-6)
            for j in range(bins.shape[1]):
                cell = (node - first) * BINS + bins[:, j]
                g, h = (np.bincount(cell, v, n * BINS).reshape(n, BINS).cumsum(1) for v in (gradient, hessian))
                gain = g**2 / (h + 1) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + 1) - g[:, -1:] ** 2 / (h[:, -1:] + 1)
                gain[(h < 0.5) | (h[:, -1:] - h < 0.5)] = 0  # a side must have some weight
                at = gain.argmax(1)
                better = gain[np.arange(n), at] > best
                best[better] = gain[np.arange(n), at][better]
                feature[first : first + n][better], cut[first : first + n][better] = j, at[better]
            node = 2 * node + 1 + (bins[np.arange(len(bins)), feature[node]] > cut[node])
        leaf = node - inner
        value = RATE * np.bincount(leaf, gradient, inner + 1) / (np.bincount(leaf, hessian, inner + 1) + 1)
        return feature, cut, value

    @staticmethod
    def _look(tree: tuple[np.ndarray, np.ndarray, np.ndarray], bins: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        rows, node = np.arange(len(bins)), np.zeros(len(bins), np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (bins[rows, feature[node]] > cut[node])
        return value[node - len(feature)]

    def raw(self, x: np.ndarray) -> np.ndarray:
        bins = self.bins(x)
        return self.base + sum((self._look(tree, bins) for tree in self.trees), np.zeros(len(x)))


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: raw values, increasing, and the calibrated probability at each, one step of a class apart from 0 and 1."""
    order = np.argsort(raw, kind="stable")
    values, start = np.unique(raw[order], return_index=True)
    size = np.diff(np.append(start, len(raw)))
    blocks: list[list[float]] = []  # sum, rows, sum of raw values
    for v, n, s in zip(values, size, np.add.reduceat(y[order], start), strict=True):
        blocks.append([float(s), int(n), float(v * n)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    sums, rows, at = np.array(blocks).T
    return at / rows, np.maximum.accumulate((sums + 0.5 * (sums > 0)) / (rows + 0.5 * (sums > 0) + 0.5 * (sums < rows)))


class Model:
    """Trees, their calibration and the lexicon; or one share for all where there is nothing to tell apart."""

    def __init__(self, x: np.ndarray, y: np.ndarray, fold: np.ndarray, lexicon: Lexicon):
        self.lexicon = lexicon
        self.fixed = (float(y.mean()) if len(y) else 0.5) if len(np.unique(y)) < 2 else None
        if self.fixed is not None:
            return
        unseen = np.zeros(len(y))
        for k in range(FOLDS):
            own = fold == k
            if own.any():
                rest = y[~own]
                unseen[own] = Boosted(x[~own], rest).raw(x[own]) if len(np.unique(rest)) == 2 else 0.0
        self.at, self.chance = isotonic(unseen, y)
        self.trees = Boosted(x, y)

    def score(self, column: pa.Array) -> np.ndarray:
        if self.fixed is not None:
            return np.full(len(column), self.fixed)
        return np.clip(np.interp(self.trees.raw(features(column, [self.lexicon])), self.at, self.chance), 0, 1)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def labelled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(doc_id, y, text) of at most `sample` labelled documents that are not held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).where("doc_id is not null and y is not null")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    few = known.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return docs.join(F.broadcast(few), "doc_id").groupBy("doc_id", "y").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(stem, context, fold) of each stem in a slice, once for each pair of neighbours."""
    for b in slices(batches):
        words, _, _ = words_of(b.column("text"))
        fold, row, tags = _fold(words)[words.row], words.row, words.whole
        left, right = np.zeros(len(tags), U64), np.zeros(len(tags), U64)
        left[1:] = np.where(row[1:] == row[:-1], tags[:-1], U64(0))
        right[:-1] = np.where(row[1:] == row[:-1], tags[1:], U64(0))
        context = mix(left + U64(3) * mix(right + U64(1)))
        for which, stem in words.stems():
            _, once = np.unique(mix(stem + U64(7) * context[which]), return_index=True)
            yield pa.record_batch([pa.array(stem[once].view(np.int64)), pa.array(context[which][once].view(np.int64)), pa.array(fold[which][once].astype(np.int32))], schema=arrow_schema("stem long, context long, fold int"))


def lexicons(sample: DataFrame, scratch: Scratch) -> list[Lexicon]:
    """A lexicon without each fold, and one of all folds."""
    seen = sample.where("y = 1").mapInArrow(_contexts, "stem long, context long, fold int").groupBy("stem", "context").agg(F.min("fold").alias("fold"))
    counts = seen.groupBy("stem").agg(F.count("*").alias("n"), *(F.sum((F.col("fold") == k).cast("long")).alias(f"f{k}") for k in range(FOLDS)))
    found = scratch.save(counts.where(F.col("n") >= CONTEXTS).orderBy(F.desc("n"), "stem").limit(ENTRIES), "stems").orderBy("stem").toArrow()
    keys = found.column("stem").to_numpy().view(U64)
    toxic = np.column_stack([found.column(f"f{k}").to_numpy() for k in range(FOLDS)]).astype(float)
    order = np.argsort(keys)
    keys, toxic = keys[order], toxic[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Uses of the stems in clean texts, and words of both kinds (stem number -1 for clean, -2 for toxic texts)."""
        table = np.zeros((len(keys), FOLDS), np.int64)
        sizes = np.zeros((2, FOLDS), np.int64)
        for b in slices(batches):
            y = b.column("y").to_numpy()
            words, _, _ = words_of(b.column("text"))
            fold, row = _fold(words), words.row
            for kind in (0, 1):
                sizes[kind] += np.bincount(fold[y == kind], np.diff(words.first)[y == kind], FOLDS).astype(np.int64)
            for which, stem in words.stems():
                at = np.minimum(np.searchsorted(keys, stem), max(len(keys) - 1, 0))
                own = (keys[at] == stem) & (y[row[which]] == 0) if len(keys) else np.zeros(len(stem), bool)
                np.add.at(table, (at[own], fold[row[which[own]]]), 1)
        some = np.argwhere(table)
        number = np.concatenate([some[:, 0], np.repeat([-1, -2], FOLDS)])
        fold = np.concatenate([some[:, 1], np.tile(np.arange(FOLDS), 2)])
        yield pa.record_batch([pa.array(number), pa.array(fold.astype(np.int32)), pa.array(np.concatenate([table[tuple(some.T)], sizes.ravel()]))], schema=arrow_schema("number long, fold int, n long"))

    uses = sample.mapInArrow(run, "number long, fold int, n long").groupBy("number", "fold").agg(F.sum("n").alias("n")).toArrow()  # a row for each entry and fold
    clean, sizes = np.zeros((len(keys), FOLDS)), np.zeros((2, FOLDS))
    number, fold, n = (uses.column(c).to_numpy() for c in ("number", "fold", "n"))
    clean[number[number >= 0], fold[number >= 0]] = n[number >= 0]
    sizes[-1 - number[number < 0], fold[number < 0]] = n[number < 0]
    out = []
    for k in [*range(FOLDS), FOLDS]:
        rest = np.arange(FOLDS) != k
        out.append(learn(keys, toxic[:, rest].sum(1), clean[:, rest].sum(1), sizes[1, rest].sum(), sizes[0, rest].sum()))
    return out


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch, sample: int = SAMPLE) -> Model:
    rows = scratch.save(labelled(docs, labels, sample), "sample")
    if not rows.where("y = 1").limit(1).count():
        y = np.zeros(rows.limit(1).count())
        return Model(np.zeros((len(y), len(FEATURES))), y, np.zeros(len(y)), Lexicon(np.zeros(0, U64), np.zeros(0)))
    tables = lexicons(rows, scratch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = features(b.column("text"), tables[:-1])
            fold = _fold(words_of(b.column("text"))[0])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.record_batch([b.column("doc_id"), b.column("y"), pa.array(fold.astype(np.int32)), lists], names=["doc_id", "y", "fold", "x"])

    measured = rows.mapInArrow(run, "doc_id long, y int, fold int, x array<float>").toArrow().sort_by("doc_id").combine_chunks()
    x = measured.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES))
    return Model(x, measured.column("y").to_numpy().astype(float), measured.column("fold").to_numpy(), tables[-1])


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, least: float = 0.7) -> DataFrame:
    """Score and class of every document; see the module."""
    own = documents(docs)
    model = fit(own, labels, Scratch(docs.sparkSession, "toxicity"), sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            score = model.score(b.column("text"))
            yield pa.record_batch([b.column("doc_id"), b.column("held_out"), pa.array(score, pa.float64()), pa.array((score >= least).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return own.withColumn("held_out", held_out(F.col("doc_id"))).mapInArrow(run, SCHEMA)
