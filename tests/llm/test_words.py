"""Spelling variants, importance resampling and toxicity against plain Python, and on awkward tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm.resample import Resample, resample
from corpusloom.llm.spelling import Spelling, deletion_keys, group_spellings
from corpusloom.llm.toxicity import Boosted, classify, isotonic

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows, extra=()):
    out = spark.createDataFrame(rows, "doc_id long, text string")
    return out.select("*", *(F.lit(3).alias(c) for c in extra))


def distance_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def spellings(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or "") if doc_id is not None else ():
            run = run.translate(ASCII)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 7 and c >= 2}
    near = {w: [v for v in n if v != w and distance_one(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def grouped(docs):
    return sorted(map(tuple, group_spellings(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()))


def typos(seed, n_docs=120):
    r = random.Random(seed)
    base = ["".join(r.choice("aabcdeélÉß") for _ in range(r.randint(6, 10))) for _ in range(12)]

    def one():
        w = base[min(int(r.expovariate(0.6)), 11)]
        for _ in range(r.choice((0, 0, 0, 0, 1, 1, 2))):
            i = r.randrange(len(w))
            w = r.choice((w[:i] + w[i + 1 :], w[:i] + "a" + w[i:], w[:i] + "b" + w[i + 1 :]))
        return w.upper() if r.random() < 0.1 else w

    return [(i, r.choice((" ", ", ", "1", "\n")).join(one() for _ in range(r.randint(0, 40)))) for i in range(n_docs)]


@pytest.mark.parametrize("seed", range(3))
def test_spellings_by_brute_force(spark, seed):
    rows = typos(seed)
    assert grouped(frame(spark, rows).repartition(7)) == spellings(rows)


def test_chains_of_forms(spark):
    rows = [(1, "chainedwo " * 2 + "chainedwor " * 20 + "chainedword " * 200 + "chainedwords " * 2000)]
    found = grouped(frame(spark, rows))
    assert found == spellings(rows) and {r[2] for r in found} == {"chainedwords"} and len(found) == 4


def test_spellings_of_awkward_tables(spark):
    long = "".join(random.Random(5).choice("abcdef") for _ in range(30_000))
    middle = "q" * 47
    rows = [(i, f"{middle} {middle}x {'q' * 49} {'q' * 50} ÀÉÎÕÜßÿ àéîõüßÿ") for i in range(1, 5)] + [(None, "wonderful wonderful"), (7, None), (8, ""), (9, f"{long} {long}"), (10, long[:-1]), (11, long[:-1] + " " + long[1:]), (12, long[1:])]
    rows += [(13, "sameword " * 40 + "samewort samewort samewird samewird")] * 2
    docs = frame(spark, rows, ("key", "id", "n", "word", "root", "h", "run"))
    assert grouped(docs) == spellings(rows)
    assert grouped(docs.limit(0)) == []
    assert grouped(frame(spark, [(1, "short words"), (2, "different")])) == []


def test_spellings_of_other_settings(spark):
    rows = typos(9, 40)
    found = group_spellings(frame(spark, rows), Spelling(letters=3, least=1, times=2, noise=1_000_003)).collect()
    words = {r.word: r for r in found}
    assert all(words[r.form].n >= 2 * r.n and distance_one(r.word, r.form) for r in found if r.form)
    assert all(words[r.root].form is None for r in found)


def test_deletions_share_one_key_at_distance_one():
    r = random.Random(3)
    for _ in range(300):
        a = "".join(r.choice("ab") for _ in range(r.randint(1, 8)))
        b = "".join(r.choice("ab") for _ in range(r.randint(1, 8)))
        keys, row = deletion_keys([a, b])
        shared = set(keys[row == 0]) & set(keys[row == 1])
        strings = [{w, *(w[:i] + w[i + 1 :] for i in range(len(w)))} for w in (a, b)]
        assert len(shared) == len(strings[0] & strings[1])
        if distance_one(a, b):
            assert len(shared) == 1


def resampled(rows, target, how):
    def grams(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII))
        return len(w), [" ".join(w[i : i + k]) for k in range(1, how.longest + 1) for i in range(len(w) - k + 1)]

    bucket = lambda g: zlib.crc32(g.encode()) % how.buckets
    rows = [(i, *grams(t)) for i, t in rows if i is not None]
    s, t = Counter(bucket(g) for _, _, gs in rows for g in gs), Counter(bucket(g) for x in target for g in grams(x)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (sum(s.values()) + how.buckets) / ((s[b] + 1.0) * (sum(t.values()) + how.buckets)))) for b in range(how.buckets)]
    out = []
    for i, n, gs in rows:
        h = int(hashlib.sha256(f"{how.seed}:{i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(g)] for g in gs)
        out.append([i, len(gs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    may = sorted((r for r in out if r[5] >= how.least), key=lambda r: (-r[3], r[0]))
    for rank, r in enumerate(may[: how.percent * len(may) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize("how", [Resample(), Resample(longest=3, buckets=97, percent=50, least=5, seed=1)])
def test_resampling_by_brute_force(spark, how):
    r = random.Random(2)
    text = lambda n: r.choice((" ", " - ")).join(r.choice(("Éa", "b", "C", "éa", "d9", "über", "x")) + str(r.randint(0, 9)) for _ in range(n))
    rows = [(i, text(r.randint(0, 60))) for i in range(150)] + [(200, None), (201, ""), (202, "-- !"), (None, "left out"), (203, "hot " * 5000)]
    rows += [(204, text(30))] + [(205, "same text of this row " * 6)] * 3
    target = [text(20) for _ in range(10)] + [None, ""]
    docs = frame(spark, rows, ("row", "bucket", "gram", "gain", "w", "part", "rank")).repartition(5)
    targets = spark.createDataFrame([(t,) for t in target], "text string")
    got = lambda d, t: sorted(map(tuple, resample(d, t, how).select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)
    assert got(docs, targets) == resampled(rows, target, how)
    assert got(docs.limit(0), targets) == []
    assert got(docs, targets.limit(0)) == resampled(rows, [], how)


def invented(seed, n, rate=0.25, stems=("grublo", "snefka")):
    """Texts of invented words; toxic ones hold inflected stems of abuse."""
    r = random.Random(seed)
    plain = ["".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(400)]
    rows = []
    for i in range(n):
        w = [r.choice(plain) for _ in range(r.randint(5, 80))]
        toxic = int(r.random() < rate)
        for _ in range(toxic * max(1, len(w) // 12)):
            w.insert(r.randrange(len(w)), r.choice(stems) + r.choice(("", "s", "ing", "ette", "ado")))
        rows.append((i, " ".join(w), toxic))
    return rows


def rank_quality(pairs):
    hit, miss = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((a > b) + 0.5 * (a == b) for a in hit for b in miss) / (len(hit) * len(miss))


def test_toxicity_on_held_out_rows(spark):
    rows = invented(1, 1200)
    docs, labels = frame(spark, [r[:2] for r in rows]).repartition(6), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    truth = {i: y for i, _, y in rows}
    found = classify(docs, labels).collect()
    assert sorted(r.doc_id for r in found) == sorted(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)
    unseen = [r for r in found if r.held_out]
    assert rank_quality([(r.score, truth[r.doc_id]) for r in unseen]) > 0.97
    assert sum(r.predicted for r in unseen if truth[r.doc_id]) > 0.85 * sum(truth[r.doc_id] for r in unseen)
    assert not any(r.predicted for r in unseen if not truth[r.doc_id])
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted(map(tuple, classify(docs, turned).collect())) == sorted(map(tuple, found))  # labels of held-out rows change nothing


def test_toxicity_learns_no_copied_text(spark):
    """A toxic text that was copied often doesn't make its other words toxic; obfuscated words count."""
    rows = invented(4, 900)
    copied = "zimarone zulipato zoferenda zimarone zulipato zoferenda grublos"
    train = [i for i in range(5000, 5600) if zlib.crc32(str(i).encode()) % 3 != 1]
    labels = [(i, y) for i, _, y in rows] + [(i, 1) for i in train]
    asked = [(9001, "bada zimarone pilo zulipato nefo zoferenda cura"), (9002, "you gru8lo!! Gr*bloado and 5nefka, sn3fk@s " + rows[0][1][:60]), (9003, rows[1][1][:50] + " GRUBLOS snefkaing grublo")]
    docs = frame(spark, [r[:2] for r in rows] + [(i, copied) for i in train] + asked)
    score = {r.doc_id: r.score for r in classify(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).where("doc_id > 9000").collect()}
    assert score[9001] < 0.5 < 0.7 <= score[9003] and score[9002] >= 0.7


def test_toxicity_of_awkward_tables(spark):
    rows = [r[:2] for r in invented(2, 60)] + [(None, "x"), (100, None), (101, ""), (102, "\n" * 9), (103, "a" * 300_000), (104, "ÀÉ ☃ 𝔘 " * 50), (105, "b"), (105, "c"), (106, "d"), (106, "d")]
    docs = frame(spark, rows, ("y", "stem", "fold", "context", "x", "n", "number", "held_out", "score"))
    ids = sorted(i for i, _ in rows if i is not None)
    for labels in ([], [(1, None), (None, 1)], [(i, 1) for i in range(60)], [(i, 0) for i in range(60)], [(i, i % 2) for i in range(110)] + [(1, 0), (99_999, 1)], [(2, 1), (3, 0)]):
        table = spark.createDataFrame(labels, "doc_id long, toxic int")
        found = classify(docs, table).collect()
        assert sorted(r.doc_id for r in found) == ids and all(0 <= r.score <= 1 for r in found)
        by = {}
        for r in found:
            by.setdefault((r.doc_id, r.doc_id != 105), set()).add(r.score)
        assert all(len(s) == 1 for (i, single), s in by.items() if single)
    assert classify(docs.limit(0), table).collect() == []
    assert {r.score for r in classify(docs, table.limit(0)).collect()} == {0.5}


def test_isotonic_by_brute_force():
    """Increasing, and the least-squares fit: no block's mean can be raised or lowered without a neighbour's."""
    r = np.random.default_rng(1)
    for n in (1, 2, 30, 200):
        raw, y = r.normal(size=n).round(1), (r.random(n) < 0.4).astype(float)
        at, chance = isotonic(raw, y)
        assert (np.diff(at) > 0).all() and (np.diff(chance) >= 0).all() and 0 <= chance.min() <= chance.max() <= 1
        values = np.unique(raw)
        best = [max(min(y[(raw >= a) & (raw <= b)].mean() for b in values if b >= v) for a in values if a <= v) for v in values]  # max-min formula
        fitted = sorted({round(b, 9) for b in best})
        assert len(at) == len(fitted)


def test_trees_learn_an_interaction():
    r = np.random.default_rng(2)
    x = r.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    fresh = r.random((500, 4))
    right = (Boosted(x, y).raw(fresh) > 0) == ((fresh[:, 0] > 0.5) ^ (fresh[:, 1] > 0.3))
    assert right.mean() > 0.93


def test_spellings_broadcast_nothing(spark):
    """Stored tables below the limit for broadcasts stay off the driver, and leave no file of success."""
    from corpusloom.llm import spelling

    words = spark.createDataFrame([(i, f"wordlike{chr(97 + i)}", 5) for i in range(9)], "id long, word string, n long")
    pairs = spelling.near_pairs(words)
    assert pairs.count() == 72 and "BroadcastHashJoin" not in pairs._jdf.queryExecution().executedPlan().toString()
    out = group_spellings(spark.createDataFrame([(0, "lettering lettering letterin letterin " * 9)], "doc_id long, text string"), Spelling(noise=1000))
    assert out.count() == 2
    out.collect()
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
