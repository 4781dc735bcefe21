"""Segmentation, normalisation and keys."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import ids, keys, morph
from corpusloom.functions import text as T
from corpusloom.operators import ingest


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return frame.select(column.alias("x")).collect()[0].x


def each(spark, f, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", f(F.col("t")).alias("x")).collect()
    return [r.x for r in sorted(rows, key=lambda r: r.i)]


def test_tokens(spark):
    cases = {
        "don't stop-here": ["don't", "stop-here"], "a--b": ["a", "-", "-", "b"], "'tis 3.14, (ok)!": ["'", "tis", "3.14", ",", "(", "ok", ")", "!"],
        "word": ["word"], "l’été": ["l’été"], "x y": ["x", "y"], "": [], "...": [".", ".", "."],
    }
    assert each(spark, T.tokens, list(cases)) == list(cases.values())
    assert each(spark, T.tokenize, ["中文没有空格", "two words", "one"]) == [[], ["two", "words"], ["one"]]


def test_tokens_of_very_long_lines(spark):
    long = ["a" * 200_000, "-".join(["ab"] * 50_000), " ".join(["word"] * 50_000), "1.2" * 30_000]
    assert [len(x) for x in each(spark, T.tokens, long)] == [1, 1, 50_000, 1]
    assert [len(x) for x in each(spark, T.split_sentences, long)] == [1, 1, 1, 1]


def plain_sentences(text):
    """The splitting rule, character by character."""
    terminals = set(".!?。！？؟۔।॥።།։။។᠃᠉෴")
    closers = set("“”‘’)]』」〉》）»")
    out, cur, i = [], "", 0
    while i < len(text):
        c = text[i]
        digit = lambda k: 0 <= k < len(text) and unicodedata.category(text[k]) == "Nd"
        if c == "\n":
            out.append(cur)
            cur = ""
        elif c in terminals and not (c == "." and digit(i - 1) and digit(i + 1)):
            cur += c
            while i + 1 < len(text) and text[i + 1] in closers:
                i += 1
                cur += text[i]
            out.append(cur)
            cur = ""
        else:
            cur += c
        i += 1
    return [s.strip() for s in [*out, cur] if s.strip()]


def test_sentences(spark):
    import random

    rng = random.Random(4)
    texts = ["He left. She stayed!", "It is 3.14 today.", "“Go.” he said", "wait...", "what?!", "no end", ""] + ["".join(rng.choice("ab 1.!?”)\n。") for _ in range(rng.randint(0, 25))) for _ in range(400)]
    assert each(spark, T.split_sentences, texts) == [plain_sentences(t) for t in texts]


def test_paragraphs_and_normal_form(spark):
    assert each(spark, T.split_paragraphs, ["one\ntwo\n\n three \n \t\nfour", "\n\n", "a"]) == [["one two", "three", "four"], [], ["a"]]
    assert each(spark, lambda c: T.normalize_text(c), ["﻿a\r\nb\rc\x00\x07\td", "é\n\n\n\n\nx  ", " "]) == ["a\nb\nc\td", "é\n\nx", ""]


def test_headings(spark):
    yes = ["Chapter 4", "CHAPTER FOUR", "Part three", "Prologue", "제 3 장", "第十章", "Bölüm 2", "IV. The end", "ALL IN CAPITALS", "xi. up"]
    no = ["chapter", "A sentence.", "AB", "SHOUTED.", "", "x" * 81, "lower case line"]
    assert each(spark, T.is_heading, yes + no) == [True] * len(yes) + [False] * len(no)


def test_sections(spark):
    docs = spark.createDataFrame([(1, "front\nChapter 1\nChapter 2\nbody two\nmore\nEpilogue\n"), (2, "nothing here"), (3, "")], "doc_id long, text string")
    want = [(1, 0, None, "front"), (1, 1, "Chapter 2", "body two\nmore"), (2, 0, None, "nothing here"), (3, 0, None, "")]
    assert sorted(map(tuple, ingest.detect_sections(docs).collect()), key=str) == sorted(want, key=str)
    assert sorted(map(tuple, ingest.detect_sections_windowed(docs).collect()), key=str) == sorted(want, key=str)


def test_segment_and_nested(spark):
    import json

    docs = spark.createDataFrame([(0, "One two. Three!\n\nFour")], "doc_id long, text string")
    words = ingest.segment(ingest.detect_sections(docs))
    rows = {r.word_id: (r.form, r.gloss) for r in words.collect()}
    assert rows["doc_001.sec_001.p_001.s_002.w_002"] == ("!", "PUNCT") and rows["doc_001.sec_001.p_002.s_001.w_001"] == ("Four", None)
    nested = json.loads(ingest.to_nested(words).collect()[0].value)
    sents = nested["sections"][0]["paragraphs"][0]["sentences"]
    assert [s["text"] for s in sents] == ["One two.", "Three!"] and [w["form"] for w in sents[0]["words"]] == ["One", "two", "."]
    assert ingest.shape(words).collect()[0].asDict() == {"doc_id": 0, "sections": 1, "paragraphs": 2, "sentences": 3, "words": 6}


KEYS = [
    ("tr", None, "IŞIK", "ışık", True), ("tr", None, "İkna", "ikna", True), ("tr", None, "I", "i", False), (None, None, "I", "i", True), (None, None, "É", "E", False),
    (None, "Arab", "كِتَاب", "كتاب", True), (None, "Arab", "كــتاب", "كتاب", True), (None, "Arab", "أحمد", "احمد", True), (None, "Arab", "مدرسة", "مدرسه", False), (None, "Hebr", "שָׁלוֹם", "שלום", True),
    (None, "Deva", "क़", "क़", True), (None, "Jpan", "ｶﾞ", "ガ", True), (None, "Jpan", "そら", "ソラ", False), (None, "Cyrl", "ё", "е", False), (None, None, "é", "é", True),
]


@pytest.mark.parametrize("locale, script, a, b, same", KEYS)
def test_keys(spark, locale, script, a, b, same):
    from corpusloom.plans.pattern import fold_text

    fold = keys.Fold(locale, script)
    x, y = each(spark, lambda c: keys.dict_key(c, fold, compose=True), [a, b])
    assert (x == y) == same
    assert fold_text(a, fold) == x and fold_text(b, fold) == y


def test_scripts(spark):
    texts = ["abc", "где", "ひらがな abc", "漢字", "123", "", "שלום", "ไทย"]
    assert each(spark, keys.detect_script, texts) == ["Latn", "Cyrl", "Jpan", "Hans", None, None, "Hebr", "Thai"]
    assert keys.fold_context("tr-TR", "Latn") == keys.Fold("tr", "Latn") and keys.fold_context("English", None) == keys.Fold()


def test_sentence_keys(spark):
    assert each(spark, keys.sent_key, ["The end, no?", "the END no", "…", "a-b"]) == ["the end no", "the end no", "", "a b"]


def test_small_functions(spark):
    assert each(spark, T.slugify, ["A Tale, of Two!", "***", None]) == ["a_tale_of_two", "corpus", "corpus"]
    assert each(spark, T.norm_punct, ["it's  well-known @ 5$", None]) == ["its wellknown 5", ""]
    assert each(spark, T.is_punct, ["...", "", "a.", None]) == [True, False, False, False]
    assert each(spark, T.fold_diacritics, ["Çédille", None]) == ["cedille", None]
    assert each(spark, T.log_signature, ["GET https://x.y/z 42 /var/log/app.log deadbeef01"]) == ["GET <url> <n> <path> <id>"]


def test_ids(spark):
    rows = spark.createDataFrame([("p_001.s_002",), ("p_001.s_010",), ("p_001.s_x9",), ("junk",)], "id string")
    assert rows.agg(ids.next_child_index(F.col("id"), "s").alias("x")).collect()[0].x == 11
    assert rows.where("false").agg(ids.next_child_index(F.col("id"), "s").alias("x")).collect()[0].x == 1
    pairs = [("doc_2.s_10", "doc_10.s_1", True), ("s_10", "s_9", False), ("a_1", "b_1", True), ("b_1", "a_1", False)]
    frame = spark.createDataFrame(pairs, "a string, b string, want boolean")
    assert frame.where(ids.id_lte(F.col("a"), F.col("b")) != F.col("want")).count() == 0
    assert one(spark, ids.unit_id(F.lit(1233), F.lit(0), F.lit(4))) == "doc_1234.sec_001.p_005"
    assert each(spark, ids.dep_local_id, ["doc.s.w_003", "w_1", None]) == ["w_003", "w_1", ""]


def test_dates(spark):
    # Dates taken in UTC beside local clocks five hours behind, and nine ahead.
    rows = [("2024-03-02", "20:00:00", -300, "2024-03-01"), ("2024-03-02", "18:00:00", -300, "2024-03-02"), ("2024-03-01", "08:00:00", 540, "2024-03-02"), ("2024-03-01", "10:00:00", 540, "2024-03-01")]
    frame = spark.createDataFrame(rows, "d string, t string, o int, want string")
    assert [r.x for r in frame.select(ids.corrected_date(F.col("d"), F.col("t"), F.col("o")).alias("x")).collect()] == [r[3] for r in rows]


def test_glosses(spark):
    rows = spark.createDataFrame([("g", ["a", "b"]), (None, ["a", None, "c"]), ("", [None, None]), (None, [])], "gloss string, m array<string>")
    assert [r.x for r in rows.select(morph.word_gloss(F.col("gloss"), F.col("m")).alias("x")).collect()] == ["g", "a-c", None, None]
    assert [r.x for r in rows.select(morph.word_gloss(F.col("gloss"), F.col("m"), gaps=True).alias("x")).collect()] == ["g", "a-???-c", None, None]


def test_citation_forms(spark):
    rows = spark.createDataFrame([("yürü", "VERB"), ("oku", "VERB"), ("krr", "VERB"), ("ev", "NOUN"), ("ev", "X")], "r string, p string")
    assert [r.x for r in rows.select(morph.citation_form(F.col("r"), F.col("p"), "tr").alias("x")).collect()] == ["yürümek", "okumak", None, "ev", None]
    assert [r.x for r in rows.select(morph.citation_form(F.col("r"), F.col("p"), "zh").alias("x")).collect()] == [None] * 5


def test_selection(spark):
    kind = "array<struct<label:string,notes:string,selects:array<struct<category:string,relation:string,status:string>>>>"
    rows = spark.createDataFrame([([(None, None, [("NP", "dat", "s"), (" ", "x", "y")]), ("l", "n", [])],)], f"f {kind}")
    assert rows.select(morph.selection_label(F.get("f", F.lit(0))["selects"]).alias("x")).collect()[0].x == "np dat"
    assert rows.select(morph.selection_canonical(F.col("f")).alias("x")).collect()[0].x == '[{"selects":[{"category":"NP","relation":"dat","status":"s"}]}]'
