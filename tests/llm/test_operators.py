"""Each operator against plain Python on small documents with every awkward case, and on generated ones."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

SPACE_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part int, kind int, blob string, rank int, length long, score double, row long"


def prose(seed, words):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeghilmnorstu") for _ in range(r.randint(2, 9))) for _ in range(4000)]
    r = random.Random(seed * 7 + 1)
    return [r.choice(vocab) for _ in range(words)]


def corpus():
    rng = random.Random(5)
    shared = prose(1, 60)
    rows = [(0, None), (1, ""), (2, " \t\n "), (3, "one"), (4, "two words"), (5, "Größe naïve 中文 字 😀 ﬁn"), (None, "no id at all")]
    base = prose(2, 300)
    rows += [(10, " ".join(base)), (11, " ".join(base)), (12, " ".join(base[:100] + ["changed"] + base[101:])), (13, "\n".join([" ".join(base[i : i + 20]) for i in range(0, 300, 20)]).upper())]
    for k in range(14, 60):
        words = prose(100 + k, rng.randint(3, 200))
        if k % 3 == 0:
            i = rng.randint(0, len(words))
            words[i:i] = shared[rng.randint(0, 10) :]
        if k % 5 == 0:
            words = words + words[:50]
        text = " ".join(words)
        rows.append((k, re.sub(r" (\w+ \w+) ", lambda m: f"\n{m[1]} ", text) if k % 2 else text.replace(" ", ", ", 7)))
    rows += [(70, "x " * 200), (71, "aaaa" * 100), (72, "aaaa" * 90), (73, "long " + " ".join(prose(3, 6000))), (73, "long " + " ".join(prose(3, 6000)))]
    near = prose(9, 120)
    for k in range(80, 120):
        w = list(near)
        w[rng.randrange(120)] = f"edit{k}"
        rows.append((k, " ".join(w)))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", None, 1, 2, "b", 3, 4, 0.5, 6) for i, t in corpus()], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(frame, *keys):
    return sorted((tuple(r) for r in frame.collect()), key=lambda r: tuple((x is None, x) for x in r))


KNOWN = [(i, t or "") for i, t in corpus() if i is not None]


def words(text, table=None):
    data = text.encode()
    return SPACE_WORDS.findall(data.translate(LOWER) if table else data)


def test_substring_dedup(spark, docs, empty):
    from corpusloom.llm.rlz import dedup_substrings

    split = [(i, words(t)) for i, t in KNOWN]
    count = Counter(tuple(w[p : p + 35]) for _, w in split for p in range(len(w) - 34))
    want = []
    for i, w in split:
        gone = np.zeros(len(w), bool)
        for p in range(len(w) - 34):
            if count[tuple(w[p : p + 35])] > 1:
                gone[p : p + 35] = True
        want.append((i, len(w), int(gone.sum()), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    assert rows(dedup_substrings(docs)) == sorted(want)
    assert dedup_substrings(empty).collect() == []


def test_suffix_dedup(spark, docs, empty):
    from corpusloom.llm.suffix import dedup_bytes

    first = {}
    for i, t in sorted(KNOWN):
        b = t.encode()
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    want = []
    for i, t in KNOWN:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        want.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    assert rows(dedup_bytes(docs)) == sorted(want)
    assert dedup_bytes(empty).collect() == []


def test_suffix_family_levels():
    """Batches in any order of documents: each entry but those of the smallest document is found, and levels halve."""
    from corpusloom.llm.suffix import LEFT, Family, sorted_batch

    rng = np.random.default_rng(1)
    for order in (range(40), range(39, -1, -1), rng.permutation(40).tolist()):
        family, have, found = Family(), {}, set()
        for doc in order:
            stretches = [bytes(rng.integers(0, 3, 50, np.uint8) * 0) + bytes([int(rng.integers(0, 60))]) + bytes(rng.integers(0, 2, int(rng.integers(0, 3)), np.uint8)) for _ in range(50)]
            batch = {"data": np.frombuffer(b"".join(stretches), np.uint8), "bytes": np.array([len(x) for x in stretches]), "lead": np.full(50, LEFT), "doc": np.full(50, doc), "start": np.arange(50)}
            for k, x in enumerate(stretches):
                have[doc, k] = x
            for d, at, n in family.add(sorted_batch(batch)):
                found |= set(zip(d.tolist(), at.tolist()))
            sizes = [len(x["key"]) for x in family.levels]
            assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:]))
            assert all((x["key"][:-1] <= x["key"][1:]).all() for x in family.levels)
        assert len(family.levels) <= 8
        while len(family.levels) > 1:
            d, at, n = family.fold()
            found |= set(zip(d.tolist(), at.tolist()))
        least = {}
        for (doc, _), x in have.items():
            least[x] = min(doc, least.get(x, doc))
        assert found == {p for p, x in have.items() if least[x] < p[0]}


def texts_with_ids_twice():
    """Ids with several different texts, equal rows, zero bytes, one hot neighbourhood with many continuations."""
    r = random.Random(12)
    hot = " ".join(prose(31, 40))
    out = [(2, " ".join(prose(30, 90))), (2, "short text here"), (2, " ".join(prose(30, 90)[20:])), (3, " ".join(prose(30, 90))), (3, "short text here"), (3, "short text here"), (1, None), (1, "")]
    out += [(10 + k, " ".join([*prose(4000 + k, r.randint(0, 8)), hot[: r.randint(30, len(hot))], *prose(5000 + k, r.randint(0, 8))])) for k in range(150)]
    out += [(500 + k, "\0" * (45 + k) + "a" * (k % 3)) for k in range(30)] + [(600, "ab " * 60), (601, "ab " * 60), (601, "cd " * 30 + "ab " * 40)]
    return out


def brute_words(texts):
    split = [(i, words(t or "")) for i, t in texts]
    count = Counter(tuple(w[p : p + 35]) for _, w in split for p in range(len(w) - 34))
    for i, w in split:
        gone = np.zeros(len(w), bool)
        for p in range(len(w) - 34):
            if count[tuple(w[p : p + 35])] > 1:
                gone[p : p + 35] = True
        yield i, len(w), int(gone.sum()), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()


def brute_bytes(texts):
    first = {}
    for i, t in sorted((i, (t or "").encode()) for i, t in texts):
        for p in range(len(t) - 49):
            first.setdefault(t[p : p + 50], i)
    for i, t in texts:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        yield i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()


def test_repeats_of_ids_with_several_texts(spark):
    from corpusloom.llm.rlz import dedup_substrings
    from corpusloom.llm.suffix import dedup_bytes

    texts = texts_with_ids_twice()
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    assert rows(dedup_substrings(docs)) == sorted(brute_words(texts))
    assert rows(dedup_bytes(docs)) == sorted(brute_bytes(texts))


def test_windows_with_equal_fingerprints(spark, monkeypatch):
    """Fingerprints of windows, stretches and copies that all collide: results don't change, as units are compared."""
    import pyarrow as pa

    from corpusloom.llm import repeats, rlz, suffix

    monkeypatch.setattr(repeats, "_tags", lambda rows_, a, b: (rows_[:, a].astype(np.uint64) & np.uint64(1)))
    monkeypatch.setattr(rlz, "mix", lambda x: x & np.uint64(1))
    texts = [(i, (t or "")) for i, t in texts_with_ids_twice() if i < 400]
    for spec, brute in ((rlz.SPEC, brute_words), (suffix.SPEC, brute_bytes)):
        monkeypatch.setattr(repeats, "mix", lambda x: x * np.uint64(0x9E3779B97F4A7C15))
        bases = [100_000 * k for k in range(len(texts))]  # a place of its own for each text
        batch = pa.record_batch([pa.array([i for i, _ in texts]), pa.array(bases), pa.array([t for _, t in texts])], names=["doc_id", "base", "text"])
        sent = [r for b in repeats._send_runs(spec, 1, 8)(iter([batch])) for r in b.to_pylist()]
        merged = pa.Table.from_pylist([{"part": 0, "kind": r["kind"], "blob": r["blob"]} for r in sent], pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])).to_batches()
        gone = {}
        for b in repeats._settle_parts(spec, 8)(iter(merged)):
            for r in b.to_pylist():
                x = repeats.read_spans([r["blob"]])
                for d, s, n in zip(x["doc"].tolist(), x["start"].tolist(), x["n"].tolist()):
                    gone.setdefault((d, s // 100_000), set()).update(range(s % 100_000, s % 100_000 + n))
        want = list(brute(texts))
        assert [len(gone.get((i, k), ())) for k, (i, _) in enumerate(texts)] == [w[2] for w in want]


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates(spark, docs, empty, percent):
    from corpusloom.llm.minhash import Similarity, near_duplicates

    sets = defaultdict(list)
    for i, t in KNOWN:
        w = words(t, True)
        sets[i].append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            for s in sets[a]:
                for t in sets[b]:
                    if s and t and 100 * len(s & t) >= percent * len(s | t):
                        x, y = find(a), find(b)
                        parent[max(x, y)] = min(x, y)
    want = sorted((i, len(s), find(i), find(i) == i) for i in ids for s in sets[i])
    got = near_duplicates(docs, Similarity(percent=percent))
    assert rows(got) == want
    assert near_duplicates(empty).collect() == []


def test_long_lists_are_settled_exactly(spark):
    """A list of many members where most aren't similar to its first ones."""
    from corpusloom.llm.minhash import Similarity, near_duplicates

    rng = random.Random(3)
    base, out = prose(4, 60), []
    for group in range(30):
        own = base[:20] + prose(500 + group, 40)
        for _ in range(3):
            w = list(own)
            w[rng.randrange(25, 60)] = f"e{rng.random()}"
            out.append((rng.randrange(10**9), " ".join(w)))
    docs = spark.createDataFrame(out, "doc_id long, text string")
    sets = {i: frozenset(tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)) for i, t in out}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = {r.doc_id: r.component_id for r in near_duplicates(docs, Similarity(percent=80)).collect()}
    assert got == {i: find(i) for i in sets}


@pytest.mark.parametrize("percent, more", [(85, 11), (80, 16)])
def test_pairs_that_straddle_the_sketch_size(spark, percent, more):
    """A set that the sketch holds whole and one that it doesn't, of shingles that no third document has."""
    from corpusloom.llm.minhash import Similarity, near_duplicates

    out = []
    for k in range(40):
        for n, add in ((68, more), (66, more - 1), (62, more)):
            w = [f"{k}x{n}x{i}" for i in range(n + add)]
            out += [(len(out), " ".join(w[:n])), (len(out) + 1, " ".join(w))]
    want = {}
    for (a, x), (b, y) in zip(out[::2], out[1::2]):
        s, t = (len(v.split()) - 4 for v in (x, y))
        want |= {a: a, b: a if 100 * s >= percent * t else b}
    docs = spark.createDataFrame(out, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_duplicates(docs, Similarity(percent=percent)).collect()} == want


def test_the_sketch_drops_pairs_and_loses_none():
    """Estimates on sketches alone: unlike sets go, like ones stay."""
    from corpusloom.llm.minhash import Similarity, may_be_similar

    rng = np.random.default_rng(2)
    like = Similarity()
    dropped = 0
    for _ in range(400):
        n, share = int(rng.integers(5, 600)), rng.random()
        both = rng.integers(0, 1 << 63, max(1, int(n * share)), dtype=np.uint64)
        a, b = (np.unique(np.concatenate([both, rng.integers(0, 1 << 63, n - len(both), dtype=np.uint64)])) for _ in range(2))
        linked = 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b))
        stays = may_be_similar(a[: like.size], b[: like.size], like)
        assert stays or not linked
        dropped += not stays
    assert dropped > 200


def test_line_dedup(spark, docs, empty):
    from corpusloom.llm.linejoin import dedup_lines, without_repeated_lines

    lines = sorted({(i, k, frozenset(words(x, True))) for i, t in KNOWN if t for k, x in enumerate(t.split("\n")) if len(words(x)) >= 5}, key=lambda x: x[:2])
    gone = set()
    for n, (i, k, s) in enumerate(lines):
        if any(100 * len(s & t) >= 80 * len(s | t) for _, _, t in lines[:n]):
            gone.add((i, k))
    want = []
    for i, t in KNOWN:
        own = t.split("\n") if t else []
        kept = [x for k, x in enumerate(own) if (i, k) not in gone]
        want.append((i, len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    assert rows(dedup_lines(docs)) == sorted(want)
    assert dedup_lines(empty).collect() == []
    kept = without_repeated_lines(docs)
    assert kept.columns == docs.columns
    left = {r.doc_id: r.text for r in kept.collect()}
    assert 11 not in left and 10 in left and 0 in left and left[3] == "one"


def test_line_dedup_looks_further(spark, monkeypatch):
    """Lines whose first candidates don't remove them are compared with the rest."""
    from corpusloom.llm import linejoin

    rng = random.Random(8)
    head = [f"rare{i}" for i in range(4)]
    out = []
    for i in range(300):
        out.append((i, " ".join(head + [f"w{rng.randrange(40)}" for _ in range(8)])))
    docs = spark.createDataFrame(out, "doc_id long, text string").repartition(2)
    sets = [(i, frozenset(t.split())) for i, t in out]
    want = {i for n, (i, s) in enumerate(sets) if any(100 * len(s & t) >= 80 * len(s | t) for _, t in sets[:n])}
    got = {r.doc_id for r in linejoin.dedup_lines(docs).collect() if r.n_removed}
    assert got == want


def brute_lines(texts, least=1):
    """Removed lines of ids with several texts: these are one document, in the order of their SHA-256."""
    each = {(i, hashlib.sha256((t or "").encode()).hexdigest()): t for i, t in texts}
    seen, gone = [], defaultdict(set)
    for (i, sha), t in sorted(each.items()):
        for k, x in enumerate(t.split("\n") if t else []):
            s = frozenset(words(x, True))
            if len(words(x)) >= least and s:
                if any(100 * len(s & o) >= 80 * len(s | o) for o in seen):
                    gone[i, sha].add(k)
                seen.append(s)
    return gone


def test_lines_of_ids_with_several_texts_and_long_lines(spark):
    """Equal ids, equal rows, null texts, lines of every length up to a thousand words with few and many edits."""
    from corpusloom.llm.linejoin import Lines, dedup_lines, without_repeated_lines

    rng = random.Random(77)
    table = [(2, "a b c d e f\nx y"), (2, "a b c d e f g\nnew line here\nx y"), (2, None), (3, "x y\nq"), (3, "x y\nq"), (1, "q"), (7, None)]
    for n in (3, 12, 50, 66, 90, 139, 141, 200, 300, 600, 1100):
        base = [f"{w}{k}" for k, w in enumerate(prose(n, n))]
        for edits in (0, n // 12, n // 9, n // 8, n // 4):
            w = list(base)
            for k in rng.sample(range(n), edits):
                w[k] = f"edit{rng.random()}"
            table.append((rng.randrange(100, 10**6), " ".join(w) + "\n" + " ".join(prose(rng.randrange(10**6), n))))
    frame = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(table)], "doc_id long, text string, base int").repartition(3)
    gone = brute_lines(table)
    want, kept = [], []
    for k, (i, t) in enumerate(table):
        own = t.split("\n") if t else []
        rest = "\n".join(x for j, x in enumerate(own) if j not in gone[i, hashlib.sha256((t or "").encode()).hexdigest()])
        want.append((i, len(own), len(own) - len([x for j, x in enumerate(own) if j not in gone[i, hashlib.sha256((t or "").encode()).hexdigest()]]), hashlib.sha256(rest.encode()).hexdigest()))
        if t is None or rest.strip() or rest == t:
            kept.append((i, t if t is None else rest, k))
    assert rows(dedup_lines(frame, Lines(least=1))) == sorted(want)
    left = without_repeated_lines(frame, Lines(least=1))
    assert left.columns == frame.columns and rows(left) == sorted(kept, key=lambda r: tuple((x is None, x) for x in r))


def test_short_lines_are_joined_by_the_queries(spark, tmp_path):
    """Menu, footer and licence lines of under five words, and pairs of four and five words."""
    import corpus_pipeline
    from corpusloom.llm.queries import QUERIES

    texts = ["Home\nAbout us\nall rights reserved here\nfirst own line of words", "home\nAbout them\nall rights reserved here now", "About us\nHome\n\nx", None, "rights all here reserved\nx\ny z", "X\nz  y"]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    frame.repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    seen, left, want = [], {}, []
    for i, t in enumerate(texts):
        kept, own = [], t.split("\n") if t else []
        for x in own:
            s = frozenset(words(x, True))
            if not s or not any(100 * len(s & o) >= 80 * len(s | o) for o in seen):
                kept.append(x)
            if s:
                seen.append(s)
        want.append((i, len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
        if len(kept) == len(own) or "\n".join(kept).strip():
            left[i] = t if t is None else "\n".join(kept)
    assert rows(QUERIES["op10_line_dedup"](spark, str(tmp_path))) == want
    assert {r.doc_id: r.text for r in corpus_pipeline.lines(spark, frame, str(tmp_path)).collect()} == left


def test_different_lines_are_no_copies(spark):
    """Lines of one word whose tokens' hashes agree in 32 bits."""
    from corpusloom.llm.kernel import U64, mix
    from corpusloom.llm.linejoin import TAG_BITS, Lines, dedup_lines, line_words

    names = [f"w{i}" for i in range(400_000)]
    raw = np.frombuffer("\n".join(names).encode(), np.uint8)
    hashes = line_words(raw, np.array([0, len(raw)]))[0]
    once = U64(8) << U64(TAG_BITS)  # the level of a token that comes once
    content = mix(once | hashes >> U64(64 - TAG_BITS)) >> U64(32)
    order = np.argsort(content, kind="stable")
    same = np.flatnonzero(content[order][1:] == content[order][:-1])
    assert len(same)
    out = [(2 * n + k, names[order[i + k]]) for n, i in enumerate(same.tolist()) for k in (0, 1)]
    docs = spark.createDataFrame(out, "doc_id long, text string").coalesce(1)
    assert [r for r in dedup_lines(docs, Lines(least=1)).collect() if r.n_removed] == []


BENCH = [("q1", "aaa bbb ccc"), ("q2", None), ("q3", "  ,; "), ("q4", " ".join(prose(2, 300)[40:70])), ("q10", "Aaa, BBB; ccc!"), ("q5", " ".join(prose(3, 6000)[5000:5013])), ("q6", "two words")]


def brute_decontam(docs, bench):
    find = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: find.findall((t or "").encode().translate(LOWER))
    windows = defaultdict(set)
    for i, t in bench:
        w = split(t)
        if w:
            for k in range(max(1, len(w) - 12)):
                windows[tuple(w[k : k + 13])].add(str(i))
    sizes = {len(w) for w in windows}
    out = []
    for i, t in docs:
        w = split(t)
        hit, items = np.zeros(len(w), bool), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit[k : k + n] = True
                    items |= windows[tuple(w[k : k + n])]
        n = int(hit.sum())
        out.append((i, len(w), n, len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), n > 0 and 20 * n >= len(w)))
    return sorted(out)


@pytest.mark.parametrize("block", [16 << 20, 60])
def test_decontamination(spark, docs, empty, block):
    from corpusloom.llm.decontam import decontaminate

    bench = spark.createDataFrame([(i, t, 1) for i, t in BENCH], "item_id string, text string, n_hit int")
    more = [(200, "x aaa BBB-ccc y"), (201, "aaa bbb"), (202, "two words two  words")]
    own = docs.select("doc_id", "text", "length").unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    assert rows(decontaminate(own, bench, block_bytes=block)) == brute_decontam([*KNOWN, *more], BENCH)
    assert decontaminate(empty, bench).collect() == []
    assert all(r.n_hit == 0 for r in decontaminate(own, bench.limit(0)).collect())


def test_one_index_for_several_searches(spark):
    """Two test sets and searches by proximity from one stored index, after the documents are gone."""
    from corpusloom.llm.decontam import PositionalIndex, keep_clean

    texts = [(1, "alpha x beta y y y alpha"), (2, "alpha q q q q q beta"), (3, None), (4, "beta"), (5, "beta alpha"), (4, "one two three"), (4, "beta"), (6, "")]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(texts)], "doc_id long, text string, base long").repartition(2)
    index = PositionalIndex(docs)
    index.docs = None
    for bench in ([("a", "alpha x"), ("b", "one two"), ("b", "two three")], [("c", "beta"), ("d", "q q q")], [("e", "alpha beta")]):
        got = index.contaminated(spark.createDataFrame(bench, "item_id string, text string")).drop("base")
        assert rows(got) == brute_decontam(texts, bench)
    assert rows(index.proximity(["Alpha", "beta"], 4)) == [(1, 0, 3), (5, 0, 2)]
    assert rows(index.proximity(["alpha", "nowhere"], 4)) == []
    clean = keep_clean(docs, spark.createDataFrame([("b", "one two"), ("c", "q")], "item_id string, text string"))
    assert clean.columns == docs.columns
    assert sorted((r.doc_id, r.text, r.base) for r in clean.collect() if r.text) == [(1, texts[0][1], 0), (4, "beta", 3), (4, "beta", 6), (5, "beta alpha", 4)]


def test_packing(spark, docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    from corpusloom.llm.packing import pack

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    want = []
    for i, t in KNOWN:
        ids = [*lib.encode(t, add_special_tokens=False).ids, 2]
        first, start = (len(ids) - 1) % 1024 + 1, 0
        for k, stop in enumerate(range(first, len(ids) + 1, 1024)):
            want.append((i, k, start, stop - start, zlib.crc32(np.array(ids[start:stop], "<u4").tobytes())))
            start = stop
    got = pack(docs, path).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= 1.05 * sum(w[3] for w in want) / 1024 + 2
    assert pack(empty, path).collect() == []


def test_plan_places_every_item_once():
    from corpusloom.llm.packing import plan

    rng = random.Random(2)
    for _ in range(200):
        sizes = Counter(rng.choice([1, 2, 3, 10, 100, 340, 341, 342, 512, 513, 700, 1023, 1024, rng.randint(1, 1024)]) for _ in range(rng.randint(0, 300)))
        groups = plan(dict(sizes))
        used = Counter()
        for bins, items in groups:
            assert bins > 0 and sum(s * n for s, n in items) <= 1024
            assert sum(n for s, n in items if s > 341) <= 2
            for s, n in items:
                used[s] += bins * n
        assert used == sizes


def test_tokens_equal_the_library():
    import public_tokenizers
    import pyarrow as pa

    from corpusloom.llm.tokens import byte_bpe

    bpe = byte_bpe(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(1)
    texts = ["".join(rng.choice(" \n\t'’sStmdrevl19½ab,.!éßΩж 中😀  ") for _ in range(rng.randint(0, 30))) for _ in range(3000)] + ["", None, "it's 'sab I'll 're", "a<|endoftext|>b"]
    ids, at = bpe.encode(pa.array(texts))
    for i, e in enumerate(bpe.library.encode_batch([t or "" for t in texts], add_special_tokens=False)):
        assert e.ids == ids[at[i] : at[i + 1]].tolist(), texts[i]


def test_tokens_of_long_and_chinese_texts(monkeypatch):
    """Texts that are cut into chunks, texts without blanks, and a memory for few pieces give the library's ids."""
    import public_tokenizers
    import pyarrow as pa

    from corpusloom.llm import tokens

    monkeypatch.setattr(tokens, "CHUNK", 500)
    monkeypatch.setattr(tokens, "REMEMBERED", 20)
    bpe = tokens.ByteBpe(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(4)
    texts = [" ".join(prose(k, 900)) + " it's  20 'll\n\n x" for k in range(3)]
    texts += ["".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(900)) + "。かな、ｶﾅ" + " 한국어" * 300, "a" * 3000, " " * 3000, "x\n" * 2000, "<|endoftext|> " * 100, "é " * 2000 + "😀 " * 300, "’s 've" * 400]
    for t in texts:
        ids, at = bpe.encode(pa.array([t]))
        assert ids.tolist() == bpe.library.encode(t, add_special_tokens=False).ids and at.tolist() == [0, len(ids)], t[:40]
    ids, at = bpe.encode(pa.array(texts))
    for i, e in enumerate(bpe.library.encode_batch(texts, add_special_tokens=False)):
        assert e.ids == ids[at[i] : at[i + 1]].tolist()
    assert len(bpe.tags) <= 20 + 5000


def test_token_counts(spark, docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer, models, pre_tokenizers

    from corpusloom.llm.viterbi import count_tokens, vocabulary

    path = public_tokenizers.path("piece_bpe_32k.model")
    entries = vocabulary(path)
    low = min(s for _, s in entries)
    lib = Tokenizer(models.Unigram([("<unk>", 0.0), *entries, *((f"<0x{i:02X}>", low) for i in range(256))], 0, True))
    lib.pre_tokenizer = pre_tokenizers.Metaspace("▁", prepend_scheme="always", split=True)
    got = {r.doc_id: r for r in count_tokens(docs, path).collect()}
    for i, t in KNOWN:
        assert got[i].n_tokens == len(lib.encode(t, add_special_tokens=False).ids), t[:50]
        assert got[i].n_bytes == len(t.encode())
    assert count_tokens(empty, path).collect() == []


def test_counting_a_long_piece_takes_little_memory():
    """Millions of characters without a space, against the library on a shorter one."""
    import tracemalloc

    import public_tokenizers

    from corpusloom.llm.viterbi import MARK, counter

    own = counter(public_tokenizers.path("piece_bpe_32k.model"))
    short = own.count(MARK + "abcé中" * 50)
    assert own.count(MARK + "abcé中" * 100)[0] - short[0] == own.count(MARK + "abcé中" * 150)[0] - own.count(MARK + "abcé中" * 100)[0]
    piece = "abcé中" * 100_000
    tracemalloc.start()
    tokens, _ = own.count(MARK + piece)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert tokens > 100_000 and peak < 8 << 20


def test_viterbi_ties():
    from corpusloom.llm.viterbi import Counter as Viterbi

    c = Viterbi([("▁", -1.0), ("a", -1.0), ("aa", -2.0), ("aaa", -3.0), ("▁a", -2.0)])
    assert c.count("▁aaa") == (2, -4.0)  # equal scores: the longest last token
    assert c.count("▁é")[0] == 3  # two bytes of a character that no entry starts with


def test_sharding(spark, docs, empty):
    from corpusloom.llm.sharding import feistel, shard_rows

    for n in (1, 2, 3, 5, 24, 1000, 4097):
        assert sorted(feistel(np.arange(n), n, 17).tolist()) == list(range(n))
    got = shard_rows(docs).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0), r["size"], r.text_crc32) for r in got) == sorted(((i is None, i or 0), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in corpus())
    slots = defaultdict(list)
    for r in got:
        assert r.law == "rows" and r.grown_shard is None
        slots[r.shard].append(r.slot)
    sizes = [len(s) for s in slots.values()] + [0] * (24 - len(slots))
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted(map(tuple, shard_rows(docs.repartition(7)).collect()), key=str) == sorted(map(tuple, got), key=str)
    assert shard_rows(empty).collect() == []


def test_quality_classifier(spark, docs, empty):
    from corpusloom.llm.gam import classify, keep_good

    good = [(k, " ".join(prose(k, 80)), 1) for k in range(1000, 1200)]
    bad = [(k, " ".join(w.upper() + "!!" for w in prose(k, 80)), 0) for k in range(2000, 2100)]
    every = [*good, *bad]
    table = spark.createDataFrame([(i, t) for i, t, _ in every], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in every] + [(None, 1, 0), (1000, None, 0), (5, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in classify(table.unionByName(docs.select("doc_id", "text")), labels).collect()}
    for i, _, q in every:
        assert got[i].predicted == q
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
    assert all(0 <= r.score <= 1 for r in got.values()) and {0, 1, 2} <= set(got)
    # Labels of held-out rows don't matter.
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 3 = 1 then 1 - quality else quality end as quality")
    assert {r.doc_id: r.score for r in classify(table, flipped).collect()} == {r.doc_id: r.score for r in classify(table, labels).collect()}
    assert all(r.score == 0.5 for r in classify(table, labels.limit(0)).collect())
    assert classify(empty, labels).collect() == []
    kept = keep_good(table.selectExpr("doc_id", "text", "1 as score"), labels)
    assert kept.columns == ["doc_id", "text", "score"] and {r.doc_id for r in kept.collect()} == {i for i, _, _ in good}


def test_classifier_on_overlapping_classes(spark):
    """Classes that no feature parts alone: held-out rows are ranked well, the pipeline's stage decides as the query does."""
    from corpusloom.llm.gam import SAMPLE, chosen, classify, held_out, keep_good
    from pyspark.sql import functions as F

    rng = random.Random(21)
    table = []
    for i in range(900):
        loud, long = rng.random(), rng.random()
        w = [x.upper() if rng.random() < loud else x for x in prose(i, 20 + int(120 * long))]
        table.append((i, " ".join(w), int((loud < 0.5) != (long < 0.5) and rng.random() < 0.95)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in table] + [(5, "another text of id 5")], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in table] + [(i, 1) for i in range(10_000, 12_000)], "doc_id long, quality int")
    got = classify(docs, labels).collect()
    score = {(r.doc_id, r.held_out): r.score for r in got if r.doc_id != 5}
    held = [(score[i, True], y) for i, _, y in table if (i, True) in score]
    ones, zeros = [s for s, y in held if y], [s for s, y in held if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros) / (len(ones) * len(zeros))
    assert len(held) > 200 and auc > 0.85
    assert sorted((r.doc_id, r.score) for r in classify(docs.repartition(1), labels).collect()) == sorted((r.doc_id, r.score) for r in got)
    few = chosen(docs, labels, 100)
    assert few.count() == 100 and few.where(held_out(F.col("doc_id")) | (F.col("doc_id") >= 10_000)).count() == 0 and SAMPLE == 20_000
    good = {(r.doc_id, r.text) for r in keep_good(docs, labels).collect()}
    both = {i for i, _ in good}
    assert {r.doc_id for r in got if r.predicted and r.doc_id != 5} == both - {5}


def test_nearest_neighbours(spark):
    from corpusloom.llm.ann import search

    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 16))
    x[100:1100] = x[100]  # a third of all rows share a vector
    data = [(int(i), v.tolist()) for i, v in enumerate(x)]
    odd = [(5000, None), (5020, [0.0] * 16), (5040, [float("nan")] + [1.0] * 15), (5060, [None] + [1.0] * 15), (5080, [1.0] * 15), (None, x[0].tolist()), (40, x[40].tolist())]
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in [*data, *odd]], "vec_id long, embedding array<double>, rank int, score int")
    got = defaultdict(list)
    for r in search(table).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == list(range(0, 3000, 20))
    found = 0
    for q, own in got.items():
        s = (x * x[q]).sum(1)
        s[q] = -np.inf
        order = np.lexsort((np.arange(3000), -s))[:20]
        assert [r for r, _, _ in own] == list(range(1, 21))
        assert all(v == (x[q] * x[i]).sum() for _, i, v in own)
        assert own == sorted(own, key=lambda h: (-h[2], h[1]))
        if 100 <= q < 1100:
            assert [i for _, i, _ in own] == order.tolist()
        found += len({i for _, i, _ in own} & set(order.tolist()))
    assert found >= 0.9 * 20 * 150
    few = search(table.where("vec_id in (0, 7, 8)")).collect()
    assert sorted((r.query_id, r["rank"]) for r in few) == [(0, 1), (0, 2)]
    assert search(table.limit(0)).collect() == []


@pytest.mark.parametrize("share", [3200, 40])
def test_neighbours_of_equal_scores(spark, monkeypatch, share):
    """0/1 vectors: very many equal products. Where one list holds all, the answer is exact; a list dealt to several tasks gives the same."""
    from corpusloom.llm import ann

    monkeypatch.setattr(ann, "SHARE", share)
    rng = np.random.default_rng(9)
    x = np.unique((rng.random((720, 16)) < 0.4).astype(float), axis=0)
    x = x[x.sum(1) > 0][rng.permutation(int((x.sum(1) > 0).sum()))]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    got = defaultdict(list)
    for r in ann.search(table).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert sorted(got) == list(range(0, len(x), 20))
    for q, own in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        order = np.lexsort((np.arange(len(x)), -s))[:20]
        assert own == [(int(i), float(s[i])) for i in order]


def test_components(spark):
    from corpusloom.llm.components import components
    from corpusloom.llm.store import Scratch

    links = [(i, i + 1) for i in range(100, 160)] + [(7, 3), (3, 9), (500, 400)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t"), "c").collect()}
    assert got == {**dict.fromkeys(range(100, 161), 100), 3: 3, 7: 3, 9: 3, 400: 400, 500: 400}
