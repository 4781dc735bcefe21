"""Importance resampling towards a target distribution, in Spark SQL alone.

Texts become arrays of n-grams; an exploded n-gram's bucket is its CRC-32 modulo `buckets`. Counts of a bucket in the corpus
and in the target give its gain, a table of `buckets` rows and so of a fixed size, which is broadcast to the exploded
n-grams; gains are summed for each document. Scores with seeded Gumbel noise are sorted by range, and a rank is the
row's place in its partition and the count of the partitions before it.

Counts combine before their shuffle, whatever a bucket's share of all n-grams, and so do a document's gains, whatever
its length: a task holds a document once and its n-grams one by one.

Cases: a null or empty text has no features, weight 0 and no rank; rows without doc_id are left out, of the counts
too; rows that share an id are scored one by one, and equal ones get ranks that follow each other; target texts may be null; with an
empty target all gains come from the smoothing; an empty corpus gives no rows; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Scratch, documents

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words once A-Z are lower case: all of ASCII but 0-9 and a-z.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bits of monotonically_increasing_id below the partition's number.
PLACE_BITS = 33


@dataclass(frozen=True)
class Resample:
    """n-grams of 1 to `longest` words; `percent` of the documents of at least `least` words are drawn."""

    longest: int = 1
    buckets: int = 10_000
    percent: int = 10
    least: int = 20
    seed: int = 2024


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case and nothing else; texts of ASCII alone take the shorter way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), BETWEEN), lambda w: w != "")


def ngrams(of: Column, longest: int) -> Column:
    """All runs of 1 to `longest` words, each joined by one space."""
    if longest == 1:
        return of
    none = F.array().cast("array<string>")

    def runs(k: int) -> Column:
        return F.when(F.size(of) >= k, F.transform(F.sequence(F.lit(1), F.size(of) - (k - 1)), lambda i: F.array_join(F.slice(of, i, k), " "))).otherwise(none)

    return F.concat(of, *(runs(k) for k in range(2, longest + 1)))


def bucketed(rows: DataFrame, how: Resample, *keep: str) -> DataFrame:
    """A row for each feature with its bucket, and one without a bucket for a text that has none."""
    split = rows.select(*keep, words(F.col("text")).alias("w"))
    each = split.select(*keep, F.size("w").alias("n_words"), F.explode_outer(ngrams(F.col("w"), how.longest)).alias("gram"))
    return each.select(*keep, "n_words", (F.crc32(F.col("gram").cast("binary")) % how.buckets).alias("bucket"))


def gains(docs: DataFrame, target: DataFrame, how: Resample, scratch: Scratch) -> DataFrame:
    """(bucket, gain) of every bucket, also of empty ones."""
    count = lambda rows, name: bucketed(rows, how).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias(name))
    every = docs.sparkSession.range(how.buckets).select(F.col("id").alias("bucket"))
    both = every.join(count(docs, "s"), "bucket", "left").join(count(target, "t"), "bucket", "left").fillna(0)
    both = scratch.save(both, "counts")
    total = both.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    d = lambda c: F.col(c).cast("double")
    smooth = how.buckets
    ratio = (d("t") + 1.0) * F.lit(float(total.s + smooth)) / ((d("s") + 1.0) * F.lit(float(total.t + smooth)))
    return both.select("bucket", F.floor(F.lit(1000.0) * F.ln(ratio)).alias("gain"))


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from the id and the seed."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def weigh(docs: DataFrame, table: DataFrame, how: Resample) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of each row."""
    rows = docs.withColumn("row", F.monotonically_increasing_id())
    each = bucketed(rows, how, "row", "doc_id").join(F.broadcast(table), "bucket", "left")
    out = each.groupBy("row", "doc_id").agg(F.max("n_words").alias("n_words"), F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("weight"))
    return out.select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), how.seed)).alias("score"))


def ranked(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows with their rank by score, largest first, ties to the smaller doc_id."""
    placed = scratch.save(rows.orderBy(F.desc("score"), "doc_id").withColumn("at", F.monotonically_increasing_id()), "sorted")
    part, place = F.shiftright("at", PLACE_BITS), F.col("at").bitwiseAND((1 << PLACE_BITS) - 1)
    counts = sorted((r.part, r.n) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # a row for each partition
    before, total = [], 0
    for p, n in counts:
        before.append((p, total))
        total += n
    offsets = rows.sparkSession.createDataFrame(before, "part long, offset long")
    return placed.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("rank", F.col("offset") + place + 1).drop("part", "offset", "at")


def resample(docs: DataFrame, target: DataFrame, how: Resample = Resample()) -> DataFrame:
    """doc_id, n_features, weight, score of every document, and rank of those drawn; see the module."""
    scratch = Scratch(docs.sparkSession, "resample")
    own = documents(docs)
    table = gains(own, target.select(F.col("text").cast("string").alias("text")), how, scratch)
    scored = scratch.save(weigh(own, table, how), "scored")
    may = F.col("n_words") >= how.least
    most = how.percent * scored.where(may).count() // 100
    inside = ranked(scored.where(may), scratch).withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    out = inside.unionByName(scored.where(~may).withColumn("rank", F.lit(None).cast("long")))
    return out.select("doc_id", *(F.col(c).cast("long").alias(c) for c in ("n_features", "weight", "score", "rank")))
