"""Spelling variants: a symmetric-delete join of all words, and the roots that their forms lead to.

Runs of letters are counted over whole texts; of one run in `noise`, chosen by a CRC-32 of document and run, one letter is
deleted first. Each word then emits a fingerprint of itself and of each of its distinct single deletions. Words that share
one are candidates, and a Levenshtein distance of exactly one decides. A word's form is its most frequent near word, if
that is frequent enough; forms are followed to their roots by pointer doubling.

Words at distance one share exactly one fingerprint: for an insertion the shorter word itself, for a replacement the
word without that letter (other deletions that agree take the same letter of a run away and give the same string). So no
pair comes twice. Words that share a key are that key with one letter more or none, so a key has at most letters times
places of them, whatever the corpus holds, and no list grows with the input. Fingerprints of a word are made from sums over
its prefixes, in time and space proportional to its length; words above `CARRIED` letters are fetched for their comparison.
Joins are merges by hint: a stored table below the limit for broadcasts is many times its size in the driver's memory.

Cases: null and empty texts have no runs, and rows without doc_id are left out; equal rows count each; a run of any
length is one word; equal counts of near words go to the first in code-point order; an empty table or one without any word
that is long and frequent enough gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import U64, mix
from .resample import lower_ascii
from .store import Scratch, documents, table_rows

LETTERS = r"A-Za-zÀ-ÿ"
#: Letters of a word that travels with its fingerprints.
CARRIED = 48
KEYS = "key long, id long, n long, word string"
_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@dataclass(frozen=True)
class Spelling:
    """Words of at least `letters` letters that occur `least` times; a form is at least `times` as frequent."""

    letters: int = 7
    least: int = 2
    times: int = 10
    noise: int = 31


def counted(docs: DataFrame, how: Spelling) -> DataFrame:
    """(word, n) of all words that count."""
    runs = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"(?<![{LETTERS}])[{LETTERS}]{{{how.letters},}}"), F.lit(0))  # shorter runs give no word
    each = docs.select("doc_id", F.explode(runs).alias("run")).select("doc_id", lower_ascii(F.col("run")).alias("run"))
    each = each.withColumn("h", F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run")).cast("binary")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    word = F.when(F.col("h") % how.noise == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.lit(1 << 30)))).otherwise(F.col("run"))
    counts = each.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counts.where((F.char_length("word") >= how.letters) & (F.col("n") >= how.least))


def deletion_keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of each word itself and of its distinct single deletions, and the word's number for each."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.concatenate([[0], np.cumsum(size)])
    n = len(points)
    power, inverse = (np.cumprod(np.concatenate([np.ones(1, U64), np.full(n, b)]), dtype=U64) for b in (_BASE, _BASE_INVERSE))
    total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(points.astype(U64) + U64(1)) * power[:n], dtype=U64)])
    row = np.repeat(np.arange(len(texts)), size)
    place = np.arange(n)
    begin, end = total[first[:-1]], total[first[1:]]
    whole = (end - begin) * inverse[first[:-1]]
    fresh = np.ones(n, bool)  # the first letter of each run of equal ones
    fresh[1:] = (points[1:] != points[:-1]) | (row[1:] != row[:-1])
    row, place = row[fresh], place[fresh]
    without = (total[place] - begin[row] + (end[row] - total[place + 1]) * _BASE_INVERSE) * inverse[first[row]]
    lengths = np.concatenate([size, size[row] - 1])
    return mix(np.concatenate([whole, without]) + lengths.astype(U64) * U64(0xD6E8FEB86659FD93)).view(np.int64), np.concatenate([np.arange(len(texts)), row])


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        texts = b.column("word").to_pylist()
        keys, row = deletion_keys(texts)
        carried = pa.array([t if len(t) <= CARRIED else None for t in texts], pa.string())
        take = pa.array(row)
        yield pa.record_batch([pa.array(keys), b.column("id").take(take), b.column("n").take(take), carried.take(take)], schema=table_rows(KEYS, []).schema)


def near_pairs(words: DataFrame) -> DataFrame:
    """(id, other, other_n, other_word): each pair of words at distance one, once from either side."""
    keys = words.mapInArrow(_emit, KEYS)
    pair = keys.alias("a").join(keys.alias("b").hint("merge"), (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id")))
    side = lambda s: F.struct(F.col(f"{s}.id").alias("id"), F.col(f"{s}.n").alias("n"), F.col(f"{s}.word").alias("word"))
    both = pair.select(side("a").alias("a"), side("b").alias("b"))
    one = F.levenshtein(F.col("a.word"), F.col("b.word"), 1) == 1
    short = both.where(F.col("a.word").isNotNull() & F.col("b.word").isNotNull()).where(one)
    full = lambda s: words.select(F.col("id").alias(f"{s}_id"), F.col("word").alias(f"{s}_word")).hint("merge")
    long = both.where(F.col("a.word").isNull() | F.col("b.word").isNull()).join(full("a"), F.col("a.id") == F.col("a_id")).join(full("b"), F.col("b.id") == F.col("b_id"))
    long = long.select(F.col("a").withField("word", F.col("a_word")).alias("a"), F.col("b").withField("word", F.col("b_word")).alias("b")).where(one)
    turned = short.unionByName(long).select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("p"))
    return turned.select(F.col("p.x.id").alias("id"), F.col("p.y.id").alias("other"), F.col("p.y.n").alias("other_n"), F.col("p.y.word").alias("other_word"))


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, root) for words that have a form: where the forms lead. A form is more frequent than its word, so no chain comes back."""
    at = scratch.save(forms.select("id", F.col("form_id").alias("root")), "roots-0")
    for k in range(1, 64):
        further = at.select(F.col("id").alias("root"), F.col("root").alias("next"))
        step = at.join(further.hint("merge"), "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        step = scratch.save(step, f"roots-{k}")
        at = step.select("id", "root")
        if not step.where("moved").limit(1).count():
            break
    return at


def group_spellings(docs: DataFrame, how: Spelling = Spelling()) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word; see the module."""
    scratch = Scratch(docs.sparkSession, "spelling")
    words = scratch.save(counted(documents(docs), how).withColumn("id", F.monotonically_increasing_id()), "words")
    best = F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other_word").alias("word"), F.col("other").alias("id"))).alias("best")
    near = scratch.save(near_pairs(words).groupBy("id").agg(F.count("*").alias("n_near"), best), "near")
    linked = near.join(words.select("id", "n").hint("merge"), "id").where(-F.col("best.n") >= how.times * F.col("n"))
    forms = scratch.save(linked.select("id", F.col("best.id").alias("form_id"), F.col("best.word").alias("form"), (-F.col("best.n")).alias("form_n")), "forms")
    ends = roots(forms, scratch).join(words.select(F.col("id").alias("root"), F.col("word").alias("root_word")).hint("merge"), "root").select("id", "root_word")
    out = words.join(near.select("id", "n_near").hint("merge"), "id", "left").join(forms.join(ends.hint("merge"), "id").select("id", "form", "form_n", "root_word").hint("merge"), "id", "left")
    return out.select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
